"""Each operator against a brute-force version on small tables with nulls, empty texts, ties and repeated rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import ann, decontam, graph, jaccard, lines, mixing, quality, sais, sharding, suffixes, urls, warc
from trackloom.llm import text as tx

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, id bigint, body string, hash int"


def documents(spark, texts, ids=None, sources=None):
    """Documents with extra columns whose names clash with inner ones."""
    data = [(i if ids is None else ids[i], t, "en", None if sources is None else sources[i], len(t or ""), "r", 0, "b", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, SCHEMA)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def sample_texts(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "UPPER", "x"]
    texts = []
    for _ in range(n):
        kind = rng.random()
        if texts and kind < 0.2:
            texts.append(rng.choice(texts))
        elif texts and kind < 0.5:
            base = (rng.choice(texts) or "a b").split(" ")
            base[rng.randrange(len(base))] = "changed"
            texts.append(" ".join(base))
        else:
            texts.append(" ".join(rng.choice(vocabulary) + rng.choice(["", ",", "\n", "!"]) for _ in range(rng.choice([1, 3, 8, 40, 90]))))
    return [*texts, None, "", "  \n ", "a", texts[0], ("same words again " * 60).strip()]


@pytest.mark.parametrize("window", [10, 4])
def test_decontamination(spark, window):
    texts = sample_texts(2)
    rng = random.Random(4)
    items = [" ".join(t.split(" ")[s : s + rng.choice([2, 5, 12, 20])]) for t in texts[:25] if t for s in [rng.randrange(3)]] + [None, "", "...", "w1", "nowhere to be found at all"]
    got = decontam.decontaminate(documents(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"), window=window)
    found = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got.collect()}
    for d, text in enumerate(texts):
        w, hit, hits = words_of(text), set(), set()
        for i, item in enumerate(items):
            v = words_of(item)
            n = min(window, len(v))
            grams = {tuple(v[p : p + n]) for p in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if n and tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    hits.add(str(i))
        assert found[d] == (len(w), len(hit), sorted(hits)), d


def test_decontamination_of_repeats_and_empty_tables(spark):
    docs = documents(spark, ["a b c", "a b c", "x"], ids=[1, 1, None])
    got = decontam.decontaminate(docs, spark.createDataFrame([(1, "b c")], "item_id bigint, text string"))
    assert sorted((r.doc_id or 0, r.n_hit) for r in got.collect()) == [(0, 0), (1, 2), (1, 2)]
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert {r.n_hit for r in decontam.decontaminate(docs, none).collect()} == {0}
    assert decontam.decontaminate(docs.limit(0), none).count() == 0
    kept = decontam.clean_documents(docs, spark.createDataFrame([(1, "b c")], "item_id bigint, text string"))
    assert kept.columns == docs.columns and [r.text for r in kept.collect()] == ["x"]


def test_quality(spark):
    rng = random.Random(5)
    good = [" ".join(rng.choice(["tree", "river", "stone", "light"]) for _ in range(30)) for _ in range(120)]
    bad = [" ".join(rng.choice(["BUY$$", "WIN!!", "FREE##"]) for _ in range(30)) for _ in range(120)]
    texts = [t for pair in zip(good, bad) for t in pair] + ["", None]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(240)] + [(0, 0), (1, None)], "doc_id bigint, quality int")
    scored = docs.withColumn("_score", quality.score(spark, "text", quality.fit(docs, labels))).collect()
    assert all((r._score >= 0.5) == (r.doc_id % 2 == 0) for r in scored if r.doc_id < 240) and all(0 <= r._score <= 1 for r in scored)
    assert [r.h for r in spark.range(20).select(quality.held_out("id").alias("h")).collect()] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(20)]
    unlabelled = docs.select(quality.score(spark, "text", quality.fit(docs, labels.limit(0))).alias("_score")).distinct().collect()
    assert all(abs(r._score - 0.5) < 0.2 for r in unlabelled)


def brute_targets(sizes):
    total, names = sum(sizes.values()), sorted(sizes, key=lambda k: (k is None, k or ""))
    weight = {k: i % 3 + 1 for i, k in enumerate(names)}
    capped, target = set(), {}
    while True:
        left, open_ = total - sum(3 * sizes[k] for k in capped), [k for k in names if k not in capped]
        for k in open_:
            target[k] = left * weight[k] / sum(weight[o] for o in open_)
        above = [k for k in open_ if target[k] > 3 * sizes[k]]
        if not above:
            return {k: 3 * sizes[k] if k in capped else target[k] for k in names}
        capped |= set(above)


def test_mixing(spark):
    texts = sample_texts(6, 80)
    rng = random.Random(7)
    sources = [rng.choice(["a", "b", "b", "b", "Ä", None, "z"]) for _ in texts]
    got = mixing.mix_sources(documents(spark, texts, sources=sources)).collect()
    sizes = {}
    for t, s in zip(texts, sources):
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = brute_targets(sizes), {}
    for r in got:
        s = sources[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-9 for s in sizes)
    again = mixing.mix_sources(documents(spark, texts, sources=sources).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)
    out = mixing.mixed_documents(documents(spark, texts, sources=sources))
    assert out.columns == documents(spark, texts).columns
    words = {}
    for r in out.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        words[r.source] = words.get(r.source, 0) + n
    longest = max(len((t or "").split()) for t in texts)
    assert all(abs(words.get(s, 0) - want[s]) <= 4 * longest for s in sizes)
    assert mixing.mix_sources(documents(spark, texts).limit(0)).count() == 0


def brute_components(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("wide", [64, 3])
def test_jaccard_join(spark, monkeypatch, wide):
    monkeypatch.setattr(jaccard, "WIDE", wide)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 4)
    texts = sample_texts(8, 90)
    rng = random.Random(9)
    base = [f"v{i}" for i in range(60)]
    for _ in range(25):  # a chain of near copies
        base = list(base)
        base[rng.randrange(60)] = f"e{rng.random()}"
        texts.append(" ".join(base))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark, texts)).collect()}
    assert got == dict(enumerate(brute_components(texts)))


def test_one_of_each_group_stays(spark):
    texts = ["a b c d e f g", "A b c d e f g", "other", "other", None, "", None]
    docs = documents(spark, texts, ids=[5, 3, 7, 7, 1, 2, None])
    kept = jaccard.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (1, ""), (2, ""), (3, "A b c d e f g"), (7, "other")]
    assert jaccard.drop_near_copies(docs.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 55)], "a bigint, b bigint")
    assert {(r.node, r.label) for r in graph.components(edges).collect()} == {(i, 1) for i in range(1, 41)} | {(50, 50), (55, 50), (60, 50)}


def jump_plain(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return b


def test_sharding(spark):
    texts = [*sample_texts(10, 200), "dup", "dup"]
    ids = [*range(len(texts) - 2), 999, 999]
    ids[3] = None
    got = sharding.shard_documents(documents(spark, texts, ids=ids), 8).collect()
    assert len(got) == len(texts)
    for r in got:
        key = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:16], 16)
        assert (r.shard, r.grown_shard) == (jump_plain(key, 8), jump_plain(key, 9)) and r.grown_shard in (r.shard, 8)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    sizes = {(r.doc_id, r["size"], r.text_crc32) for r in got}
    assert sizes == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts)}
    docs = documents(spark, texts, ids=ids)
    assert sharding.with_shards(docs, 8).columns == [*docs.columns, "shard", "slot"]


def test_warc_round_trip(spark, tmp_path):
    pages = [(i, f"http://x.org/{i}", t) for i, t in enumerate(["<p>é</p>", "", None, "<p>é</p>", "b" * 5000, "<p>é</p>", ""])] + [(10**12, None, "far\r\n\r\nWARC/1.1"), (None, "u", "lonely")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    for n, least in ((1, 0), (2, 5)):
        root = f"file://{tmp_path}/w{n}"
        manifest = warc.write_warc(df, root, shards=3, file_bytes=2000, min_revisit_bytes=least)
        back = warc.read_warc(spark, root).collect()
        assert len(back) == len(pages) == sum(r.records for r in manifest.collect())
        first = {}
        for i, _, t in sorted(p for p in pages if p[0] is not None):
            if len((t or "").encode()) >= least:
                first.setdefault((t or ""), i)
        for r in back:
            text = next(t for i, _, t in pages if str(i) == ("None" if r.page == "null" else r.page)) or ""
            origin = first.get(text)
            revisit = r.page != "null" and origin is not None and str(origin) != r.page
            assert (r.record_type, r.refers) == (("revisit", str(origin)) if revisit else ("response", None))
            assert r.payload_bytes == len(text.encode()) and bytes(r.payload) == (b"" if revisit else text.encode())
    again = f"file://{tmp_path}/w3"
    files = {r.file: (r.crc32, r.bytes) for r in warc.write_warc(df.repartition(5), again, shards=3, file_bytes=2000).collect()}
    assert files == {r.file: (r.crc32, r.bytes) for r in spark.read.parquet(f"file://{tmp_path}/w1/_manifest").collect()}


def test_range_bounds_are_exact(spark):
    ids = spark.createDataFrame([(i,) for i in [*range(100), 10**15, 10**15 + 1]], "id bigint")
    bounds = warc.range_bounds(ids, 4)
    counts = np.bincount(np.searchsorted(bounds, [*range(100), 10**15, 10**15 + 1]))
    assert len(counts) == 4 and max(counts) - min(counts) <= 8


@pytest.mark.parametrize("words", [6, 7, 8])
def test_decontamination_of_a_short_document_alone(spark, words):
    long, short = " ".join(f"w{i}" for i in range(10)), " ".join(f"w{i}" for i in range(words))
    items = spark.createDataFrame([(0, long), (1, "w1 w2 w3 w4 w5")], "item_id bigint, text string")
    got = decontam.decontaminate(documents(spark, [short]).repartition(1), items).collect()
    assert [(r.n_words, r.n_hit, r["items"]) for r in got] == [(words, 5, ["1"])]


def test_line_dedup(spark):
    rng = random.Random(11)
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 3, 8, 25]))) for _ in range(40)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    texts += [texts[0], texts[1] + "\n", None, "", "\n\n"]
    found = lines.repeated_lines(documents(spark, texts))
    got = {r.doc_id: (r.n_lines, sorted({i for b in r.blocks for i in range(b.start, b.end)})) for r in found.collect()}
    parts = [t.split("\n") if t else [] for t in texts]
    for d, own in enumerate(parts):
        count = [len(x.split()) for x in own]
        gone = {i for p in parts[:d] for lo, hi in lines.common_blocks(p, own, count, 20) for i in range(lo, hi)}
        assert got[d] == (len(own), sorted(gone)), d
    kept = lines.delete_lines(documents(spark, texts), found)
    assert kept.filter("kept = ''").count() >= 1


def test_line_dedup_tries_all_partners(spark):
    rng = random.Random(13)
    one, two, three = (" ".join(f"{c}{i}" for i in range(20)) for c in "pqr")
    texts = ["\n".join(x) for x in (["x", one, "y", one, "z"], ["q", one, "r"], ["s", one, "t"], ["u", two, three, "v"], ["w", three, two], ["k", three, "l", two, "m"], ["n", one, "o", one])]
    pool = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([1, 8, 25]))) for _ in range(12)]
    texts += ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 12))) for _ in range(60)]
    texts += [*texts[:20], None, ""]
    found = lines.repeated_lines(documents(spark, texts)).collect()
    got = {r.doc_id: sorted({i for b in r.blocks for i in range(b.start, b.end)}) for r in found}
    parts = [t.split("\n") if t else [] for t in texts]
    for d, own in enumerate(parts):
        count = [len(x.split()) for x in own]
        assert got[d] == sorted({i for p in parts[:d] for lo, hi in lines.common_blocks(p, own, count, 20) for i in range(lo, hi)}), d
    assert got[2] == [1]


def test_patience_aligns_equal_lines_in_order():
    rng = random.Random(12)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(10))] for _ in range(2))
        pairs = lines.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))


def test_url_rules(spark):
    given = ["http://a.example.org/es/x", "https://EXAMPLE.org/en/12?q", "http://example.org", "ftp://b.com/fr/", "http://xcom/fr/", "no url", None, "", "http://shop.com/de/a#x", "http://x.net/casino/", "http://x.net/casinos", "http://example.org/es/casino"]
    rules = [urls.host_rule(r, v) for r, v in urls.HOST_RULES] + [urls.path_rule(w) for w in urls.BLOCKED_WORDS]
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(list(enumerate(given)), "page_id bigint, url string"), rules).collect()}
    assert [got[i] for i in range(len(given))] == [
        ("a.example.org", "example.org/es/", "block"), ("example.org", "example.org/en/1", "block"), ("example.org", None, "allow"), ("b.com", "com/fr/", "allow"), ("xcom", None, "allow"),
        ("", None, "allow"), ("", None, "allow"), ("", None, "allow"), ("shop.com", "com/de/", "block"), ("x.net", "*casino*", "block"), ("x.net", None, "allow"), ("example.org", "example.org/es/", "block"),
    ]
    assert {t for t, r in urls.rule_index(rules, {"org": 9, "example": 5, "es": 1}).items() if any(x.name == "example.org/es/" for x in r)} == {"es"}


@pytest.mark.parametrize("measure", ["ip", "l2"])
def test_nearest_vectors(spark, measure):
    rng = np.random.default_rng(13)
    vectors = rng.normal(size=(400, 16)).astype(np.float32)
    vectors[5:15] = vectors[4]
    data = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (None, [1.0] * 16), (904, [1.0]), (7, vectors[7].tolist())]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0 or vec_id is null or vec_id > 899"), 20, measure=measure).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 400, 20))
    hits = 0
    v = vectors.astype(np.float64)
    for q, rows in got.items():
        score = v @ v[q] if measure == "ip" else -((v - v[q]) ** 2).sum(1)
        order = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:20]
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and all(abs(score[i] - s) < 1e-9 for _, i, s in rows)
        hits += len({i for _, i, _ in rows} & set(order))
    assert hits / (20 * len(got)) >= 0.9
    assert ann.nearest(df.limit(0), df.limit(0), 20).count() == 0
    assert ann.nearest(df.limit(3), df.limit(1), 20).count() == 2


def test_suffix_arrays_and_common_prefixes():
    rng = random.Random(14)
    for _ in range(150):
        alphabet = rng.choice([2, 3, 5])
        s = np.array([rng.randint(1, alphabet) for _ in range(rng.randint(1, 60))] + [0])
        sa = sais.suffix_array(s, alphabet + 1)
        assert list(sa) == sorted(range(len(s)), key=lambda i: list(s[i:]))
        plcp = sais.common_prefixes(s.astype(np.uint8), sa, 1000, np.array([0]))
        for k in range(1, len(s)):
            i, j, n = sa[k], sa[k - 1], 0
            while i + n < len(s) and j + n < len(s) and s[i + n] == s[j + n]:
                n += 1
            assert plcp[i] == n


def brute_repeats(texts, length):
    seen, out = set(), []
    for t in texts:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if data[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(data[p : p + length])
        edges = [i for i in range(len(data)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((len(data), sum(gone), len(edges), bytes(c for c, g in zip(data, gone) if not g)))
    return out


@pytest.mark.parametrize(("length", "hot"), [(100, 1 << 17), (40, 3)])
def test_suffix_dedup(spark, length, hot):
    rng = random.Random(15)
    passages = ["".join(rng.choice("abcdé ") for _ in range(160)) for _ in range(4)]
    texts = ["".join(rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("abcdeé fgh") for _ in range(90)) for _ in range(rng.randrange(5))) for _ in range(40)]
    texts += [texts[0], "ab" * 150, "b" + "ab" * 130, None, "", "x" * 99, "x" * 250]
    docs = documents(spark, texts)
    spans = suffixes.repeated_spans(docs, length=length, hot=hot, shard_bytes=2000)
    kept = {r.row: bytes(r.kept) for r in suffixes.remaining_bytes(docs, spans).collect()}
    got = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), kept[r.row]) for r in spans.collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, length)


def test_suffix_dedup_of_repeated_rows(spark):
    text = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(80))
    docs = documents(spark, [text, text, text], ids=[None, 2, 2])
    got = sorted((r.doc_id or 0, len(r.spans)) for r in suffixes.repeated_spans(docs).collect())
    assert got == [(0, 1), (2, 0), (2, 1)]
    assert suffixes.repeated_spans(docs.limit(0)).count() == 0


def test_text_chunks_keep_texts_whole():
    import pyarrow as pa

    column = pa.array(["ab", None, "", "cdé" * 10, "x"]).slice(1)
    got = [bytes(d[o[i] : o[i + 1]]) for _, d, o in tx.text_chunks(column, 8) for i in range(len(o) - 1)]
    assert got == [b"", b"", ("cdé" * 10).encode(), b"x"]

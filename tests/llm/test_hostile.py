"""Inputs made to break an operator: colliding texts, odd URLs, extreme vectors, very long texts, clashing names, empty tables."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_repeats, documents
from trackloom.llm import ann, decontam, jaccard, lines, mixing, quality, sais, sharding, suffixes, urls, warc
from trackloom.llm import text as tx

#: The Thue-Morse word and its complement: equal under any polynomial modulo 2**64.
MORSE = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
ESROM = MORSE.translate(str.maketrans("ab", "ba"))


def test_span_hashes_tell_apart_what_power_sums_cannot():
    data = np.frombuffer((MORSE + ESROM).encode(), np.uint8)
    sums = tx.prefix_hash(data)
    a, b = tx.span_hash(sums, np.array([0, 2048]), np.array([2048, 4096]))
    assert a != b
    rng = random.Random(3)
    data = np.array([rng.choice(b"ab") for _ in range(5000)], np.uint8)
    sums, seen = tx.prefix_hash(data), {}
    for i, h in enumerate(tx.window_hash(sums, 9).tolist()):
        assert seen.setdefault(data[i : i + 9].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)
    starts, ends = np.array([0, 7, 100]), np.array([5000, 9, 164])
    assert tx.span_hash(sums, starts, ends)[2] == tx.window_hash(sums, 64)[100]


def test_colliding_texts_in_all_operators(spark):
    docs = documents(spark, [MORSE, ESROM])
    found = decontam.decontaminate(docs, spark.createDataFrame([(0, MORSE)], "item_id bigint, text string")).collect()
    assert {r.doc_id: r.n_hit for r in found} == {0: 1, 1: 0}
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()} == {0: 0, 1: 1}
    tail = "\n" + " ".join(f"w{i}" for i in range(10))
    longer = documents(spark, [" ".join(f"v{i}" for i in range(12)) + " " + MORSE + tail, " ".join(f"v{i}" for i in range(12)) + " " + ESROM + tail])
    assert [r.blocks for r in lines.repeated_lines(longer).collect()] == [[], []]
    texts = [MORSE, ESROM]
    spans = {r.doc_id: sum(s.end - s.start for s in r.spans) for r in suffixes.repeated_spans(docs, length=1024).collect()}
    assert spans == {i: removed for i, (_, removed, _, _) in enumerate(brute_repeats(texts, 1024))}


def plain_blocks(a, b):
    """Patience diff written from its definition: pairs of equal lines."""
    pairs = []

    def align(alo, ahi, blo, bhi):
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            pairs.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        end = []
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            end.append((ahi, bhi))
        one_a, one_b = a[alo:ahi], b[blo:bhi]
        unique = [(alo + i, blo + one_b.index(x)) for i, x in enumerate(one_a) if one_a.count(x) == 1 and one_b.count(x) == 1]
        best = [[] for _ in unique]
        for i, (_, j) in enumerate(unique):  # longest increasing sequence, by trying all ends
            best[i] = max((best[h] for h in range(i) if unique[h][1] < j), key=len, default=[]) + [unique[i]]
        chain = max(best, key=len, default=[])
        if chain:
            i, j = alo, blo
            for x, y in chain:
                align(i, x, j, y)
                pairs.append((x, y))
                i, j = x + 1, y + 1
            align(i, ahi, j, bhi)
        pairs.extend(end)

    align(0, len(a), 0, len(b))
    return sorted(pairs)


def plain_deleted(a, b, least):
    pairs, gone, run = plain_blocks(a, b), set(), []
    for p in [*pairs, None]:
        if run and (p is None or p != (run[-1][0] + 1, run[-1][1] + 1)):
            if sum(len(b[j].split()) for _, j in run) >= least:
                gone |= {j for _, j in run}
            run = []
        if p:
            run.append(p)
    return gone


def test_line_dedup_from_its_definition(spark):
    """Every line that aligns with any earlier document goes; chains that are not unique in length are left out of the sample."""
    x, y, z = (" ".join(f"{c}{i}" for i in range(22)) for c in "xyz")
    texts = [f"{x}\n{y}\n{z}", f"{z}\n{x}\n{y}", f"{z}\n{x}\n{y}", f"head\n{x}\nmid\n{y}", f"{x}\n{x}", f"alone\n{x} more\nother"]
    for n in range(30):  # passages of 20 words and more between lines of their own
        rng = random.Random(n)
        texts.append("\n".join(t for k in rng.sample(range(8), 3) for t in (f"own {n} {k}", " ".join(f"p{k}w{i}" for i in range(20 + k)))))
    got = {r.doc_id: {i for b in r.blocks for i in range(b.start, b.end)} for r in lines.repeated_lines(documents(spark, texts)).collect()}
    parts = [t.split("\n") for t in texts]
    for d in range(6):
        assert got[d] == set().union(*[plain_deleted(parts[p], parts[d], 20) for p in range(d)]), d
    for d in range(6, len(texts)):  # of two passages in another order, either may align
        assert got[d] <= {i for i, line in enumerate(parts[d]) if any(line in p for p in parts[:d])}
    assert got[2] == {0, 1, 2} and not got[5]


def test_url_index_changes_nothing():
    rng = random.Random(5)
    words = ["casino", "login", "é", "signup", "x", "de", "fr", "K", "Casino", " ", ".", "/", "-", "1", "org", "com", "example", "\n", "İ"]
    rules = [urls.host_rule(r, v) for r, v in urls.HOST_RULES] + [urls.path_rule(w) for w in urls.BLOCKED_WORDS] + [urls.host_rule("x.org/a", "block"), urls.host_rule("a.b/", "allow")]
    everything = urls.compiled({"": rules})
    for _ in range(40):
        counts = {w: rng.randrange(9) for w in words}
        index = urls.compiled(urls.rule_index(rules, counts))
        for _ in range(60):
            host = "".join(rng.choice(words) for _ in range(rng.randrange(5))).replace("/", "").lower()
            path = "/" + "".join(rng.choice(words) for _ in range(rng.randrange(8)))
            assert urls.best_rule(host, path, index) == urls.best_rule(host, path, everything), (host, path)


def test_odd_urls_equal_sql(spark):
    import duckdb

    given = ["http://x.net/écasino/", "http://x.net/casinoé", "http://a b.org/x", "http://a b.org/casino", "http://x.net/a\nlogin\nb", "HTTP://WWW.EXAMPLE.ORG/es/é", "://", "http://", "http://é.com/fr/", "http://K.com/de/", "a://b://c.com/de/"]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(given)))
    want = {r[0]: r[1:] for r in con.execute(urls.OP8_SQL).fetchall()}
    rules = [urls.host_rule(r, v) for r, v in urls.HOST_RULES] + [urls.path_rule(w) for w in urls.BLOCKED_WORDS]
    judged = urls.judge_urls(spark.createDataFrame(list(enumerate(given)), "page_id bigint, url string"), rules).collect()
    assert {r.page_id: (r.host, r.path, None if (r.rule or "*")[0] == "*" else r.rule, r.verdict) for r in judged} == want


@pytest.mark.parametrize("scale", [1e22, 1e-30, 1.0])
def test_vectors_of_extreme_size(spark, scale):
    rng = np.random.default_rng(17)
    vectors = (rng.normal(size=(60, 8)) * scale).astype(np.float32)
    vectors[20] *= np.float32(1e-7)  # a query far below the others
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    v = vectors.astype(np.float64)
    for q in (0, 20, 40):
        score = v @ v[q]
        want = [int(i) for i in np.lexsort((np.arange(60), -score)) if i != q][:20]
        assert [i for _, i in sorted(got[q])] == want


@pytest.mark.parametrize("measure", ["ip", "l2"])
def test_vectors_of_mixed_sizes(spark, measure):
    """One huge vector and some large ones among many small ones, more than the shortlist holds."""
    rng = np.random.default_rng(18)
    vectors = (rng.normal(size=(1500, 8)) * 1e-12).astype(np.float32)
    vectors[3] *= np.float32(1e38)
    vectors[3] *= np.float32(1e4)
    vectors[5:9] *= np.float32(1e10)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0"), 20, measure=measure).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    v, hits = vectors.astype(np.float64), 0
    for q, found in got.items():
        score = v @ v[q] if measure == "ip" else -((v - v[q]) ** 2).sum(1)
        hits += len(found & set([int(i) for i in np.lexsort((np.arange(1500), -score)) if i != q][:20]))
    assert len(got) == 30 and hits / (20 * len(got)) >= 0.9


@pytest.mark.parametrize("measure", ["ip", "l2"])
def test_vectors_that_codes_cannot_tell_apart(spark, measure):
    """Far more vectors than the shortlist holds differ by less than their codes do, some rows are copies, and some lie far out of the sample's way."""
    rng = np.random.default_rng(19)
    centre = rng.normal(size=32)
    vectors = (centre + rng.normal(size=(3000, 32)) * 1e-4).astype(np.float32)
    vectors[2000:2400] = vectors[2000]
    vectors[2900:] = rng.standard_t(1, size=(100, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0"), 20, measure=measure).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    v = vectors.astype(np.float64)
    assert len(got) == 60
    for q, found in got.items():
        score = sum(x * c for x, c in zip(v[q], v.T)) if measure == "ip" else -sum((c - x) ** 2 for x, c in zip(v[q], v.T))
        assert [i for _, i in sorted(found)] == [int(i) for i in np.lexsort((np.arange(3000), -score)) if i != q][:20]


def test_repeated_rows_are_not_squared(spark):
    """Each row meets one text of its own, however often a row repeats."""
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(6))
    rows = [(i % 2, text, "x") for i in range(600)] + [(None, text, "x")] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row_key string").repartition(3)
    for found, kept in ((lines.repeated_lines(docs), lines.delete_lines), (suffixes.repeated_spans(docs), suffixes.remaining_bytes)):
        table = found.persist()
        assert table.count() == 900
        texts = kept(docs, table)
        assert texts.count() == 900 and texts.select("row").distinct().count() == 900
        assert "CartesianProduct" not in texts._jdf.queryExecution().toString()
    spans = suffixes.repeated_spans(docs)
    assert spans.filter("size(spans) = 0").count() == 1  # the first row keeps all
    assert lines.repeated_lines(docs).filter("size(blocks) = 0").count() == 1


@pytest.mark.parametrize("kind", ["clusters", "row", "repeated"])
def test_range_bounds_take_few_jobs(spark, kind):
    rng = np.random.default_rng(19)
    far = rng.integers(-(1 << 60), 1 << 60, 50)
    ids = {"clusters": (far[:, None] + np.arange(200)).ravel(), "row": np.arange(10_000), "repeated": np.repeat([5, 7, 9], 3000)}[kind]
    df = spark.createDataFrame([(int(i),) for i in ids] + [(None,)], "id bigint")
    tracker, group = spark.sparkContext.statusTracker(), f"bounds-{kind}"
    spark.sparkContext.setJobGroup(group, "bounds")
    bounds = warc.range_bounds(df, 2000)
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 12
    size = np.bincount(np.searchsorted(bounds, ids), minlength=len(bounds) + 1)
    assert (np.diff(bounds) > 0).all() and size.max() <= (3000 if kind == "repeated" else 6) and size.min() > 0


def test_urls_that_are_no_header_lines(spark, tmp_path):
    given = ["http://a/\r\n\r\nX: y", "http://a/\nb", " lead", "trail ", "a\x00b\x7f", "100%25 %0A", "plain é ü", "", "a: b: c", "\u2028", "%"]
    df = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(given)], "page_id bigint, url string, html string")
    root = f"file://{tmp_path}/odd"
    warc.write_warc(df, root)
    assert {r.page: r.url for r in warc.read_warc(spark, root).collect()} == {str(i): u for i, u in enumerate(given)}
    with pytest.raises(TypeError):
        warc.write_warc(df.withColumn("page_id", F.lit("x")), f"file://{tmp_path}/text")


def test_shards_of_archives_follow_the_bytes(spark, tmp_path):
    df = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.expr("repeat(md5(string(id)), 100)").alias("html"))
    assert warc.shard_count(df, shard_bytes=10_000) == 13 and warc.shard_count(df.limit(0)) == 1
    root = f"file://{tmp_path}/many"
    files = warc.write_warc(df, root, shards=13).collect()
    assert len({r.file.rsplit("-", 1)[0] for r in files}) == 13 and {r.records for r in files} <= {3, 4}
    none = f"file://{tmp_path}/none"
    warc.write_warc(df.limit(0), none)
    assert warc.read_warc(spark, none).count() == 0


def test_texts_longer_than_a_chunk(spark):
    rng = random.Random(21)
    vocabulary = [f"word{i}" for i in range(5000)]
    long = " ".join(rng.choice(vocabulary) + ("\n" if i % 12 == 0 else "") for i in range(60_000))
    assert len(long) > tx.CHUNK_BYTES
    edited = long.replace("word17 ", "changed ")
    texts = ["short text", long, edited, long, None, ""]
    docs = documents(spark, texts)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()} == dict(enumerate(brute_components(texts)))
    item = " ".join(long.split()[30_000:30_015])
    hits = {r.doc_id: r.n_hit for r in decontam.decontaminate(docs, spark.createDataFrame([(0, item)], "item_id bigint, text string")).collect()}
    assert hits[1] >= 15 and hits[3] == hits[1] and hits[0] == hits[4] == 0
    assert {r.doc_id: len(r.blocks) > 0 for r in lines.repeated_lines(docs).collect()} == {0: False, 1: False, 2: True, 3: True, 4: False, 5: False}
    spans = {r.doc_id: sum(s.end - s.start for s in r.spans) for r in suffixes.repeated_spans(docs).collect()}
    assert spans == {i: removed for i, (_, removed, _, _) in enumerate(brute_repeats(texts, 100))}
    model = quality.fit(docs, spark.createDataFrame([(0, 0), (1, 1), (2, 1)], "doc_id bigint, quality int"))
    assert docs.select(quality.score(spark, "text", model).alias("s")).filter("s between 0 and 1").count() == len(texts)
    sizes = {r.doc_id: r["size"] for r in sharding.shard_documents(docs, 3).collect()}
    assert sizes[1] == len(long.encode()) + 1
    assert {r.doc_id: r["size"] for r in mixing.mix_sources(docs).collect()}[1] == len(re.findall(r"[^\x20\x09-\x0D]+", long))


def test_one_word_repeated_in_item_and_document(spark):
    docs = documents(spark, ["again " * 3000, "again " * 9, "again and again"])
    found = decontam.decontaminate(docs, spark.createDataFrame([(0, "again " * 5000), (1, "again and")], "item_id bigint, text string")).collect()
    assert {r.doc_id: (r.n_hit, r["items"]) for r in found} == {0: (3000, ["0"]), 1: (0, []), 2: (2, ["1"])}


def test_training_sample_is_bounded_by_ids_and_bytes(spark):
    docs = documents(spark, ["some words here"] * 50 + [f"text number {i} of many" for i in range(40)], ids=[1] * 50 + list(range(2, 42)))
    labels = spark.createDataFrame([(i, i % 2) for i in range(42)] + [(3, None)], "doc_id bigint, quality int")
    names = {"id_col": "doc_id", "text_col": "text", "label_col": "quality"}
    allowed = {i for i in range(1, 42) if i != 3} & {r.doc_id for r in labels.filter(~quality.held_out("doc_id")).collect()}
    assert quality.training_sample(docs, labels, limit=100, max_bytes=1 << 20, **names).count() == len(allowed)
    assert quality.training_sample(docs, labels, limit=5, max_bytes=1 << 20, **names).count() <= 5
    few = quality.training_sample(docs, labels, limit=100, max_bytes=1000, **names).collect()
    assert 0 < len(few) < len(allowed) and sum(3 * len(r.buckets) for r in few) <= 1000


def test_character_grams_stay_inside_words_and_texts():
    texts = ["aé b", "", "xyz", "é"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    bucket, first = quality.character_grams(data, offsets, 3)
    # "aé " and "é b" touch a space at an end only; " b" has two characters; "xyz" is whole; nothing spans two texts
    assert np.diff(first).tolist() == [1, 0, 1, 0]
    again, _ = quality.character_grams(np.frombuffer("aé\tb".encode(), np.uint8), np.array([0, 5]), 3)
    assert again[0] == bucket[0]  # all whitespace is one character


CLASHING = ["_hkey", "_one", "shard", "slot", "_bucket", "_score", "_text_key", "_times", "_copy", "_row", "carried", "id", "text_key", "row", "body", "key", "size", "may", "skey", "hkey", "before", "_part", "one", "tie"]


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages_keep_columns_of_any_name(spark, stage, tmp_path):
    texts = ["a plain text of some words that go on", "a plain text of some words that go on", None, "", "one two three four five six seven eight nine ten eleven"]
    docs = documents(spark, texts, sources=["s", "s", None, "t", "t"]).select("doc_id", "text", "lang", "source", "n_chars")
    names = [c for c in CLASHING if not (stage == len(corpus_pipeline.STAGES) - 1 and c in ("shard", "slot"))]
    wide = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in names])
    wide.write.parquet(f"{tmp_path}/docs")
    wide = spark.read.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(i, 1) for i in range(5)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "two three four five six seven eight nine ten eleven")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.STAGES[stage][1](spark, wide, str(tmp_path))
    assert out.columns[: len(wide.columns)] == wide.columns
    rows = out.collect()
    assert rows and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in names)
    plain = corpus_pipeline.STAGES[stage][1](spark, wide.select(docs.columns), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in plain)


def test_session_settings_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    jaccard.jaccard_components(documents(spark, ["a b c d e f", "a b c d e f"])).collect()
    assert spark.conf.get(key) == before


def test_empty_tables(spark):
    none = documents(spark, ["x"]).limit(0)
    assert lines.repeated_lines(none).count() == 0 and sharding.shard_documents(none, 4).count() == 0 and sharding.with_shards(none, 4).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    assert urls.judge_urls(spark.createDataFrame([], "page_id bigint, url string"), [urls.path_rule("x")]).count() == 0
    model = quality.fit(none, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert quality.good_documents(none, model, 0.3).count() == 0


def test_mix_of_one_hot_source_splits_it(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 1 + int(id % 7))").alias("text"), F.when(F.col("id") % 3 == 0, "rare").otherwise("hot").alias("source"))
    got = mixing.mix_sources(rows)
    taken = {r.target: r.t for r in got.groupBy("target").agg(F.sum("taken").alias("t")).collect()}
    assert all(abs(k - v) <= 0.5 for k, v in taken.items())


@pytest.mark.parametrize("few", [1024, 2])
def test_induced_sorting_on_several_levels(few, monkeypatch):
    monkeypatch.setattr(sais, "FEW_SYMBOLS", few)
    rng = random.Random(31)
    pieces = ["".join(rng.choice("abc") for _ in range(9)) for _ in range(6)]
    for text in ("".join(rng.choice(pieces) for _ in range(400)), "ab" * 700, "a" * 900, "".join(rng.choice("ab") for _ in range(3000))):
        s = np.append(np.frombuffer(text.encode(), np.uint8).astype(np.int64), 0)
        assert sais.suffix_array(s, 256).tolist() == sorted(range(len(s)), key=lambda i: (text + "\0")[i:])


def test_wide_block_with_rows_outside_its_group(spark, monkeypatch):
    """Rows that link only with some of a block, not with its pivots, are found."""
    monkeypatch.setattr(jaccard, "WIDE", 4)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 3)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    rng = random.Random(41)
    base = [f"v{i}" for i in range(80)]
    texts = []
    for group in range(3):  # groups that share half their words in order, too little to link
        half = base[:40] + [f"g{group}x{i}" for i in range(40)]
        for _ in range(14):
            own = list(half)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(40, 80)] = f"e{rng.random()}"
            texts.append(" ".join(own[: rng.randrange(70, 81)]))
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark, texts)).collect()}
    assert got == dict(enumerate(brute_components(texts)))

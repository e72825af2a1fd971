"""Periodic runs of words, by uniting classes of suffixes in order of falling common prefix.

A run is a stretch of words with a smallest period q that repeats at least
``times`` times and that no neighbouring word extends. Suffixes of a document are
sorted by doubling, neighbours in that order are joined by their longest common
prefix, the longest first, as Kruskal joins edges. Each class keeps its positions
in order. When two classes unite at a common prefix of l words, positions i and
j that become neighbours at a distance q of at most l have exactly l words in
common, so words i to j + l have period q, and no smaller one, as a position in
between would belong to the class. Each run arises once so, from its first word.

Prefixes shorter than any run needs are never joined; for runs of 24 words and
three periods those of under 16 words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.rows import quoted

MIN_WORDS = 24
MIN_TIMES = 3
SLICE_BYTES = 1 << 20  # texts are handled in slices of about this size, long ones alone
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def least_prefix(min_words: int, times: int) -> int:
    """The shortest common prefix that the first word of a run has with the word one period later."""
    return min(max(min_words - q, (times - 1) * q) for q in range(1, max(min_words, 1) + 1))


def doubled_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """ranks[k][i] tells apart the stretches of 2**k symbols from i on; the last list has no two alike and is an order of all suffixes.

    A rank is the first place of its group in that order, so a stretch that is
    alone keeps its rank and is not sorted again.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    value = symbols[order]
    fresh = np.concatenate([[True], value[1:] != value[:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    ranks = [rank.astype(np.int32)]
    alone = fresh & np.append(fresh[1:], True)
    open_, width = order[~alone], 1
    while len(open_):
        after = np.where(open_ + width < n, rank[np.minimum(open_ + width, n - 1)] + 1, 0)
        key = rank[open_] * (n + 1) + after
        by_key = np.argsort(key, kind="stable")
        open_, key = open_[by_key], key[by_key]
        group, at = rank[open_], np.arange(len(open_))
        starts = np.maximum.accumulate(np.where(np.concatenate([[True], group[1:] != group[:-1]]), at, 0))
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[open_] = group + np.maximum.accumulate(np.where(fresh, at, 0)) - starts
        ranks.append(rank.astype(np.int32))
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
        width *= 2
    return ranks


def neighbour_prefixes(ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix of each with the next)."""
    n = len(ranks[-1])
    order = np.empty(n, dtype=np.int64)
    order[ranks[-1]] = np.arange(n)
    x, y = order[:-1], order[1:]
    length = np.zeros(max(n - 1, 0), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        i, j = x + length, y + length
        inside = (i < n) & (j < n)
        same = inside & (ranks[k][np.minimum(i, n - 1)] == ranks[k][np.minimum(j, n - 1)])
        length += same.astype(np.int64) << k
    return order, length


def periodic_runs(symbols: np.ndarray, min_words: int = MIN_WORDS, times: int = MIN_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of whole numbers, by start and period. ``times`` is 2 or more."""
    if times < 2:
        raise ValueError("runs need two periods at least")
    if len(symbols) < max(min_words, times):
        return []
    order, prefix = neighbour_prefixes(doubled_ranks(symbols))
    edges = np.flatnonzero(prefix >= least_prefix(min_words, times))
    edges = edges[np.argsort(-prefix[edges], kind="stable")]
    nodes = np.unique(np.concatenate([edges, edges + 1]))
    left, right, levels = np.searchsorted(nodes, edges).tolist(), np.searchsorted(nodes, edges + 1).tolist(), prefix[edges].tolist()
    places = order[nodes].tolist()
    node_of = dict(zip(places, range(len(places)), strict=True))
    parent, members, words = list(range(len(places))), [[p] for p in places], symbols.tolist()

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    runs, seeds, level = [], [], -1

    def settle() -> None:
        """Keep the seeds that are still neighbours after all unions of their level."""
        for i, j in seeds:
            ordered = members[root(node_of[i])]
            if ordered[bisect_left(ordered, i) + 1] == j:
                runs.append((i, j - i + level, j - i))
        seeds.clear()

    for a, b, common in zip(left, right, levels, strict=True):
        if common != level:
            settle()
            level = common
        a, b = root(a), root(b)
        if len(members[a]) < len(members[b]):
            a, b = b, a
        large, small = members[a], members[b]
        parent[b], members[b] = a, None
        if len(small) * 16 > len(large) > 64:  # then one sort moves less than many insertions
            new = set(small)
            large.extend(small)
            large.sort()
            met = [(i, j) for i, j in zip(large, large[1:]) if (i in new) != (j in new)]
        else:
            met, before = [], -1
            for p in small:
                at = bisect_left(large, p)
                if at and large[at - 1] != before:
                    met.append((large[at - 1], p))
                if at < len(large):
                    met.append((p, large[at]))
                large.insert(at, p)
                before = p
        for i, j in met:
            q = j - i
            if (times - 1) * q <= common and q + common >= min_words and (i == 0 or words[i - 1] != words[j - 1]):
                seeds.append((i, j))
    settle()
    return sorted(runs)


def without_repeats(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: all but those that a run holds after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def _may_repeat(symbols: np.ndarray, width: int) -> np.ndarray:
    """Positions whose ``width`` next symbols, by hash, occur once more; at least all that do."""
    hash_, have = symbols.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1
    while have < width:
        step = min(have, width - have)
        if len(hash_) <= step:
            return np.zeros(0, dtype=np.int64)
        mixed = hash_[:-step] ^ (hash_[:-step] >> np.uint64(31))
        hash_ = (mixed * np.uint64(0xBF58476D1CE4E5B9) + hash_[step:]) * np.uint64(0x94D049BB133111EB)
        have += step
    order = np.argsort(hash_, kind="stable")
    same = hash_[order[1:]] == hash_[order[:-1]]
    return order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]


def runs_of_texts(texts: list[bytes], min_words: int = MIN_WORDS, times: int = MIN_TIMES) -> tuple[list[list[bytes]], list[list[tuple[int, int, int]]]]:
    """(words, runs) of each text. Only texts that repeat as many words as a run needs are sorted; no word of one equals a word of another."""
    words = [t.split() for t in texts]  # of bytes: at space and \t \n \v \f \r
    symbols, start, base = [], [0], 0
    for w in words:
        number: dict[bytes, int] = {}
        symbols.append(np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, len(w)) + base)
        base += len(number)
        start.append(start[-1] + len(w))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    whole = np.concatenate(symbols) if symbols else np.zeros(0, np.int64)
    chosen = np.unique(np.searchsorted(start, _may_repeat(whole, least_prefix(min_words, times)), side="right") - 1)
    if len(chosen):
        offsets = np.concatenate([[0], np.cumsum([len(symbols[d]) for d in chosen])])
        for first, length, period in periodic_runs(np.concatenate([symbols[d] for d in chosen]), min_words, times):
            at = int(np.searchsorted(offsets, first, side="right")) - 1
            runs[chosen[at]].append((first - int(offsets[at]), length, period))
    return words, runs


def _slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    lo, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def _collapse(batches, min_words, times):
    """mapInArrow body: (id, text) -> id, n_words, runs, collapsed."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        texts = batch.column(1).cast(pa.large_binary())
        for lo, hi in _slices(texts, SLICE_BYTES):
            words, runs = runs_of_texts([t or b"" for t in texts.slice(lo, hi - lo).to_pylist()], min_words, times)
            kept = []
            for w, r in zip(words, runs, strict=True):
                if r:
                    w = [x for x, stays in zip(w, without_repeats(len(w), r).tolist(), strict=True) if stays]
                kept.append(b" ".join(w))
            found = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
            columns = [batch.column(0).slice(lo, hi - lo), pa.array([len(w) for w in words], pa.int64()), pa.array(found, kind), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])


def collapsed_runs(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, times: int = MIN_TIMES) -> DataFrame:
    """A row for each document: id, n_words, runs (start, length, period; by start and period), collapsed.

    Words are separated by space, \\t, \\n, \\v, \\f and \\r and compared as bytes.
    ``collapsed`` holds the words that stay, joined by one space. Null and empty
    texts have no words. Rows with equal ids are separate documents. Other
    columns are ignored. Each document is handled by itself, so nothing is
    shuffled; a task holds about SLICE_BYTES of text, or one longer text, with
    some hundred bytes for each of its words where it repeats.
    """
    rows = documents.select(F.col(quoted(id_col)).alias("_id"), F.col(quoted(text_col)).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = rows.mapInArrow(lambda it: _collapse(it, min_words, times), f"id {kind}, n_words bigint, runs array<{RUN}>, collapsed string")
    return out.withColumnRenamed("id", id_col)


def strongest_run(runs: Column) -> Column:
    """The run with the most periods, of those the first by start and period; null if there is none."""
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda best, r: F.when(more(best, r), r).otherwise(best))


def with_planted_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): every tenth document, by the CRC-32 of its id, with its words from some place on replaced by a repetition of the first of them.

    Null ids are left as they are.
    """
    id_, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    h = F.crc32(id_.cast("string").cast("binary"))
    g = F.floor(h / F.lit(10)).cast("bigint")
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = documents.select(id_.alias(id_col), text.alias(text_col), F.when(h % 10 == 0, words).alias("_w"), g.alias("_g"))
    n = F.size("_w")
    a = (F.col("_g") % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.col("_g") % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_w", a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice("_w", F.lit(1), a), tail), " ")
    return rows.select(id_col, F.when(F.col("_w").isNotNull() & (n > 0), planted).otherwise(F.col(quoted(text_col))).alias(text_col))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapsed_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), strongest_run(F.col("runs")).alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("bigint")
    return best.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

"""Removal of repeated byte strings with suffix arrays.

Every byte that a string of ``length`` bytes covers which also starts earlier is
removed. Strings that can repeat are brought together first: each window of
``length`` bytes chooses the smallest of its k-gram hashes as its anchor, so
equal windows have equal anchors, and only windows whose anchor occurs twice go
on. The windows of one anchor occurrence are a context of a few dozen bytes more
than ``length``; equal contexts are folded into their first occurrence. Contexts
go to shards by anchor. A shard sorts the suffixes of its contexts by induced
sorting and reads the groups of equal windows off the permuted common prefixes;
the first window of each group stays, all others are removed.

An anchor whose contexts could outgrow a shard (a common line between many
different neighbours) is split: each of its contexts is cut again by longer
grams, and the pieces go to shards by these. Of a longer gram that is still too
common every window goes on alone; equal ones are folded by their bytes, which
leaves one of each. So no shard holds much more than ``shard_bytes``.

Folding tells contexts of one anchor apart by a 62-bit hash; bytes are compared
in the shards.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trackloom.llm import text as tx
from trackloom.llm.bits import bit_filter, frequency_filters, frequency_level, hash_ranges, passes
from trackloom.llm.rows import row_key
from trackloom.llm.sais import common_prefixes, suffix_array
from trackloom.llm.store import stored

GRAM = 32  # bytes of an anchor
SHARD_BYTES = 400_000  # of contexts in a shard, about
HOT = 1 << 17  # occurrences from which on an anchor's contexts are folded in several tasks
FILTER_LOG2 = 25  # bits of the filter of anchors: 4 MB for each of two levels
PACKED = 1 << 16  # occurrences that a task folds and packs at a time
_SEGMENT = 1 << 23
_RUNS = "array<struct<first:int,last:int>>"


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor occurrences of a chunk of texts: (anchor hash, context hash, first and last window start), starts within the chunk."""
    gram = min(gram, length)
    width = length - gram + 1
    n = len(data) - length + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    sums = tx.prefix_hash(data)
    hash_ = tx.window_hash(sums, gram)
    size = np.diff(offsets)
    usable = np.arange(n) + length <= np.repeat(offsets[1:], size)[:n]
    first, last, where = [], [], []
    for lo in range(0, n, _SEGMENT):  # the position takes 24 bits beside 40 of the hash
        part = hash_[lo : min(lo + _SEGMENT, n) + width - 1]
        low = tx.sliding((part >> np.uint64(24) << np.uint64(24)) | np.arange(len(part), dtype=np.uint64), width, np.minimum)
        place = (low & np.uint64((1 << 24) - 1)).astype(np.int64) + lo
        ok = usable[lo : lo + len(place)]
        edge = np.ones(len(place), dtype=bool)
        edge[1:] = (place[1:] != place[:-1]) | ~ok[:-1]
        starts = np.flatnonzero(edge & ok)
        stop = np.ones(len(place), dtype=bool)
        stop[:-1] = edge[1:] | ~ok[1:]
        ends = np.flatnonzero(stop & ok)
        first.append(starts + lo)
        last.append(ends + lo)
        where.append(place[starts])
    first, last, where = (np.concatenate(x) for x in (first, last, where))
    # smallest hashes crowd at the low end; mixed again they spread over filters and parts
    return tx.mix(hash_[where]), tx.span_hash(sums, first, last + length), first, last


def _ordered(table: pa.Table, before: list[str] = ()) -> pa.Table:
    """Rows in order of the columns ``before`` and then of place: null ids last, id, row, first."""
    keys = {k: table[k] for k in before} | {"none": pc.is_null(table["id"]), "id": table["id"], "row": table["row"], "first": table["first"]}
    return table.take(pc.sort_indices(pa.table(keys), [(k, "ascending") for k in keys]))


def _folded(table: pa.Table) -> pa.Table:
    """The first occurrence of each context."""
    table = _ordered(table.combine_chunks(), ["anchor", "context"])
    anchor, context = table["anchor"].to_numpy(), table["context"].to_numpy()
    fresh = np.ones(len(anchor), dtype=bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])
    return table.filter(pa.array(fresh))


def _scan(batches, length, filters, log2, schema):
    """mapInArrow body: (row, id, text key, digest, text) -> a row per document, and rows of packed anchor occurrences.

    Occurrences are folded within the batch. part: the range of the anchor's
    hash; from 2**log2 on the range of the context's hash, for hot anchors; from
    2 * 2**log2 on for documents, which carry the runs of windows whose anchors
    may repeat.
    """
    ranges = 1 << log2

    def packed(batch, found):
        anchor, context, first, last, owner, level = (np.concatenate(x) for x in zip(*found, strict=True))
        at = pa.array(owner)
        part = np.where(level > 1, ranges + (context >> np.uint64(64 - log2)).astype(np.int64), (anchor >> np.uint64(64 - log2)).astype(np.int64))
        rows = {"anchor": pa.array(anchor.view(np.int64)), "context": pa.array(context.view(np.int64)), "row": batch.column(0).take(at), "id": batch.column(1).take(at), "first": pa.array(first.astype(np.int32)), "last": pa.array(last.astype(np.int32))}
        table = _folded(pa.table(rows | {"part": pa.array(part.astype(np.int32))}))
        table = table.take(pa.array(np.argsort(table["part"].to_numpy(), kind="stable"))).combine_chunks()
        parts, begin = np.unique(table["part"].to_numpy(), return_index=True)
        bounds = pa.array(np.append(begin, len(table)).astype(np.int32))
        lists = {f"{c}s": pa.ListArray.from_arrays(bounds, pa.concat_arrays(table[c].chunks) if table[c].num_chunks else pa.array([], rows[c].type)) for c in rows}
        return _filled({"part": pa.array(parts)} | lists, schema)

    for batch in batches:
        found, size = [], 0
        for at, data, offsets in tx.text_chunks(batch.column(4)):
            anchor, context, first, last = anchors(data, offsets, length)
            level = frequency_level(filters.value, anchor)
            keep = level > 0
            anchor, context, first, last, level = anchor[keep], context[keep], first[keep], last[keep], level[keep]
            owner = np.searchsorted(offsets, first, side="right") - 1
            first, last = first - offsets[owner], last - offsets[owner]
            start = np.ones(len(first), dtype=bool)
            start[1:] = (owner[1:] != owner[:-1]) | (first[1:] != last[:-1] + 1)
            end = np.append(start[1:], True) if len(start) else start
            runs = pa.StructArray.from_arrays([pa.array(first[start].astype(np.int32)), pa.array(last[end].astype(np.int32))], names=["first", "last"])
            runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[start], np.arange(len(offsets))).astype(np.int32)), runs)
            row, id_, key, sha = (batch.column(c).slice(at, len(offsets) - 1) for c in range(4))
            yield _filled({"part": pa.array((2 * ranges + row.to_numpy() % ranges).astype(np.int32)), "row": row, "id": id_, "text_key": key, "text_sha256": sha, "n_bytes": pa.array(np.diff(offsets)), "runs": runs}, schema)
            if len(anchor):
                found.append((anchor, context, first, last, owner + at, level))
                size += len(anchor)
            if size >= PACKED:
                yield packed(batch, found)
                found, size = [], 0
        if found:
            yield packed(batch, found)


def _filled(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A batch of the schema with nulls for the columns that are not given."""
    n = len(columns["part"])
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _fold(log2, shard_bytes, length, schema):
    """applyInArrow body: a part -> documents as they are; runs of windows that stay (no shard) and contexts to compare (with a shard; -1 if the anchor has to be split)."""
    ranges = 1 << log2

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        if part >= 2 * ranges:
            return table.select([f.name for f in schema if f.name not in ("first", "last", "shard")]).append_column("first", pa.nulls(len(table), pa.int32())).append_column("last", pa.nulls(len(table), pa.int32())).append_column("shard", pa.nulls(len(table), pa.int64())).select(schema.names)
        flat = _folded(pa.table({c: pc.list_flatten(table[f"{c}s"]) for c in ("anchor", "context", "row", "id", "first", "last")}))
        anchor = flat["anchor"].to_numpy()
        heads = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        many = np.repeat(np.diff(np.append(heads, len(anchor))) > 1, np.diff(np.append(heads, len(anchor))))
        if part >= ranges:
            shard = np.full(len(anchor), -1)
            alone = np.zeros(len(anchor), dtype=bool)
        else:
            size = flat["last"].to_numpy().astype(np.int64) - flat["first"].to_numpy() + length
            of_anchor = np.repeat(np.add.reduceat(size, heads), np.diff(np.append(heads, len(anchor)))) if len(anchor) else size
            shards = max(1, -(-int(size[many].sum()) // shard_bytes))
            shard = part * (1 << 20) + (tx.mix(anchor.view(np.uint64)) % np.uint64(shards)).astype(np.int64)
            shard[of_anchor > shard_bytes] = -1
            alone = ~many  # nothing to compare with: all windows stay
        n = len(anchor)
        columns = {"part": pa.array(np.full(n, part, np.int32)), "row": flat["row"], "id": flat["id"], "first": flat["first"], "last": flat["last"], "shard": pa.array(shard, mask=alone)}
        return pa.table([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    return run


def _contexts(batches, length):
    """mapInArrow body: (row, id, text, wanted [(shard, first, last)]) -> one row for each context with its bytes."""
    for batch in (b.slice(lo, 1024) for b in batches for lo in range(0, b.num_rows, 1024)):
        wanted = batch.column(3)
        items, bounds = wanted.flatten(), wanted.offsets.to_numpy() - wanted.offsets[0].as_py()
        shard, first, last = (items.field(i) for i in range(3))
        lo, hi = first.to_numpy().astype(np.int64), last.to_numpy().astype(np.int64) + length
        owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
        out = []
        for row, data, offsets in tx.text_chunks(batch.column(2)):
            for i in range(bounds[row], bounds[row + len(offsets) - 1]):
                base = offsets[owner[i] - row]
                out.append(data[base + lo[i] : base + hi[i]].tobytes())
        at = pa.array(owner)
        yield pa.RecordBatch.from_arrays([shard, batch.column(0).take(at), batch.column(1).take(at), first, pa.array(out, pa.binary())], names=["shard", "row", "id", "first", "body"])


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def first_windows(bodies: list[bytes], place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the contexts that occur nowhere earlier: (context, first, last) in runs.

    place: for each context the global place of its first window; places of
    later windows follow on it.
    """
    size = np.array([len(b) for b in bodies], dtype=np.int64)
    start = np.cumsum(size + 1) - size - 1
    symbols = np.frombuffer(b"\xfe".join(bodies) + b"\xfe", np.uint8).astype(np.int64) + 1
    symbols = np.append(symbols, 0)
    sa = suffix_array(symbols, 256)
    prefix = common_prefixes(symbols.astype(np.uint8), sa, int(size.max()) + 8, start)
    owner = np.repeat(np.arange(len(bodies)), size + 1)
    inside = np.arange(len(symbols) - 1) - start[owner]
    whole = np.append(inside + length <= size[owner], False)
    group = np.cumsum(prefix[sa] < length)
    keep = whole[sa]
    at, group = sa[keep], group[keep]
    where = place[owner[at]] + inside[at]
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.repeat(np.minimum.reduceat(where, heads), np.diff(np.append(heads, len(at)))) if len(at) else where
    flags = np.zeros(len(symbols), dtype=bool)
    flags[at[where == least]] = True  # a separator ends each run
    first, last = _ranges(flags)
    return owner[first], inside[first], inside[last]


def _shard(length):
    """applyInArrow body: the contexts of a shard -> runs of windows that stay."""

    def run(table: pa.Table) -> pa.Table:
        table = _ordered(table.combine_chunks())
        row, first = table["row"].to_numpy(), table["first"].to_numpy().astype(np.int64)
        rank = np.cumsum(np.concatenate([[0], row[1:] != row[:-1]]))
        at, lo, hi = first_windows(table["body"].to_pylist(), (rank << 32) + first, length)
        return pa.table({"row": pa.array(row[at]), "first": pa.array((first[at] + lo).astype(np.int32)), "last": pa.array((first[at] + hi).astype(np.int32))})

    return run


def _pieces(batches, length, gram):
    """mapInArrow body: (row, id, first, body) -> the pieces of each context by anchors of ``gram`` bytes: anchor, row, id, first, body."""
    for batch in batches:
        found, owner, first, bodies = [], [], [], []
        for at, data, offsets in tx.text_chunks(batch.column(3)):
            anchor, _, lo, hi = anchors(data, offsets, length, gram)
            mine = np.searchsorted(offsets, lo, side="right") - 1
            found.append(anchor)
            owner.append(mine + at)
            first.append(lo - offsets[mine])
            bodies.extend(data[i : j + length].tobytes() for i, j in zip(lo, hi, strict=True))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        at = pa.array(join(owner, np.int64))
        start = batch.column(2).take(at).to_numpy().astype(np.int64) + join(first, np.int64)
        columns = [pa.array(join(found, np.uint64).view(np.int64)), batch.column(0).take(at), batch.column(1).take(at), pa.array(start.astype(np.int32)), pa.array(bodies, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["anchor", "row", "id", "first", "body"])


def _single(batches, length):
    """mapInArrow body: (row, id, first, body) -> every window by itself."""
    for batch in batches:
        owner, first, bodies = [], [], []
        for i, (start, body) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            for w in range(len(body) - length + 1):
                owner.append(i)
                first.append(start + w)
                bodies.append(body[w : w + length])
        at = pa.array(owner, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(first, pa.int32()), pa.array(bodies, pa.binary())], names=["row", "id", "first", "body"])


def _split_anchors(contexts: DataFrame, kind: str, length: int, shard_bytes: int) -> tuple[DataFrame, DataFrame]:
    """For contexts (row, id, first, body) of anchors that are too common: (pieces with their shard, runs of windows that stay)."""
    pieces = contexts.mapInArrow(lambda it: _pieces(it, length, (GRAM + length) // 2), f"anchor bigint, row bigint, id {kind}, first int, body binary")
    pieces = stored(pieces, "pieces")
    sizes = pieces.groupBy("anchor").agg(F.sum(F.octet_length("body").cast("bigint")).alias("bytes"))
    common = stored(sizes.filter(F.col("bytes") > shard_bytes).select("anchor"), "common-pieces")
    shards = max(1, -(-(pieces.agg(F.sum(F.octet_length("body").cast("bigint"))).first()[0] or 0) // shard_bytes))
    rest = pieces.join(common, "anchor", "left_anti").withColumn("shard", -1 - F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    alone = pieces.join(common, "anchor", "left_semi").select("row", "id", "first", "body").mapInArrow(lambda it: _single(it, length), f"row bigint, id {kind}, first int, body binary")
    place = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "first")).alias("f")
    once = alone.groupBy("body").agg(place).select("f.row", "f.first", F.col("f.first").alias("last"))
    return rest.select("shard", "row", "id", "first", "body"), once


def _spans(batches, length):
    """mapInArrow body: (row, n_bytes, runs, kept) -> row, the byte ranges to remove."""
    for batch in batches:
        n = batch.column(1).to_numpy()
        found, kept = batch.column(2), batch.column(3)
        cuts = []
        for column in (found, kept):
            items, bounds = column.flatten(), column.offsets.to_numpy() - column.offsets[0].as_py()
            cuts.append((items.field("first").to_numpy(), items.field("last").to_numpy(), bounds))
        out = []
        for d in range(batch.num_rows):
            gone = np.zeros(max(int(n[d]) - length + 1, 0), dtype=bool)
            for (first, last, bounds), value in zip(cuts, (True, False), strict=True):
                for i in range(bounds[d], bounds[d + 1]):
                    gone[first[i] : last[i] + 1] = value
            lo, hi = _ranges(gone)
            hi = hi + length
            joins = np.flatnonzero(lo[1:] > hi[:-1]) + 1 if len(lo) else lo
            lo, hi = (lo[np.concatenate([[0], joins])], hi[np.concatenate([joins - 1, [len(hi) - 1]])]) if len(lo) else (lo, hi)
            out.append([{"start": int(a), "end": int(b)} for a, b in zip(lo, hi, strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["row", "spans"])


def repeated_spans(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, shard_bytes: int = SHARD_BYTES, hot: int = HOT) -> DataFrame:
    """One row per document: row, id, text_key, text_sha256, n_bytes, spans (array of byte ranges to remove, apart and in order).

    A document comes before another if its id is smaller; null ids come last,
    and rows with one id follow in the order in which they are read. Null, empty
    and short texts (under ``length`` bytes) keep all. Of repeated rows the first
    stays. Columns other than the named ones are ignored.
    """
    spark = documents.sparkSession
    body = F.coalesce(F.col(text_col), F.lit(""))
    keyed = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("body"))
    id_type = keyed.schema["id"].dataType
    filters = frequency_filters(keyed.select("body"), lambda data, offsets: anchors(data, offsets, length)[0], (2, hot), FILTER_LOG2)
    log2 = hash_ranges(spark)
    kind = id_type.simpleString()
    doc = f"part int, row bigint, id {kind}, text_key bigint, text_sha256 string, n_bytes bigint, runs {_RUNS}"
    packed = f"anchors array<bigint>, contexts array<bigint>, rows array<bigint>, ids array<{kind}>, firsts array<int>, lasts array<int>"
    result = f"{doc}, first int, last int, shard bigint"
    arrow = lambda ddl: to_arrow_schema(T.StructType.fromDDL(ddl))
    scan_schema, fold_schema = arrow(f"{doc}, {packed}"), arrow(result)
    source = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.sha2(body, 256).alias("text_sha256"), F.col(text_col).alias("body"))
    scanned = source.mapInArrow(lambda it: _scan(it, length, filters, log2, scan_schema), f"{doc}, {packed}")
    folded = stored(scanned.groupBy("part").applyInArrow(_fold(log2, shard_bytes, length, fold_schema), result), "folded")
    filters.destroy()
    docs = folded.filter("n_bytes IS NOT NULL").select("row", "id", "text_key", "text_sha256", "n_bytes", "runs")
    alone = folded.filter("first IS NOT NULL AND shard IS NULL").select("row", "first", "last")
    compared = folded.filter("shard IS NOT NULL").groupBy("row").agg(F.collect_list(F.struct("shard", "first", "last")).alias("wanted"))
    wanted = stored(compared.join(docs.select("row", F.col("id").alias("_id"), F.col("text_key").alias("_key")), "row"), "wanted")
    texts = keyed.filter(passes(bit_filter(wanted, "_key"), F.col("text_key")))
    texts = texts.withColumn("_row", row_key(F.col("id"), F.col("text_key"))).dropDuplicates(["_row"])  # of repeated rows one text
    texts = texts.join(wanted.withColumn("_row", row_key(F.col("_id"), F.col("_key"))), "_row")
    bodies = texts.select("row", "id", "body", "wanted").mapInArrow(lambda it: _contexts(it, length), f"shard bigint, row bigint, id {kind}, first int, body binary")
    any_common = wanted.filter(F.exists("wanted", lambda w: w["shard"] < 0)).limit(1).count() > 0
    sorted_ = "row bigint, first int, last int"
    if any_common:
        bodies = stored(bodies, "bodies")
        pieces, once = _split_anchors(bodies.filter("shard < 0").select("row", "id", "first", "body"), kind, length, shard_bytes)
        bodies = bodies.filter("shard >= 0").union(pieces)
        alone = alone.union(once)
    kept = bodies.groupBy("shard").applyInArrow(_shard(length), sorted_)
    kept = kept.union(alone).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("kept"))
    parts = docs.filter(F.size("runs") > 0).select("row", "n_bytes", "runs").join(kept, "row", "left").withColumn("kept", F.coalesce("kept", F.array().cast(_RUNS)))
    spans = stored(parts.mapInArrow(lambda it: _spans(it, length), "row bigint, spans array<struct<start:bigint,end:bigint>>").filter(F.size("spans") > 0), "spans")
    out = docs.drop("runs").join(spans, "row", "left")
    return out.select("row", F.col("id").alias(id_col), "text_key", "text_sha256", "n_bytes", F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"))


def _cut(batches):
    """mapInArrow body: (row, text, spans) -> row, the bytes that stay."""
    for batch in (b.slice(lo, 256) for b in batches for lo in range(0, b.num_rows, 256)):
        out = []
        for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data, end, parts = (text or "").encode("utf-8"), 0, []
            for span in gone:
                parts.append(data[end : span["start"]])
                end = span["end"]
            out.append(b"".join([*parts, data[end:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["row", "kept"])


def remaining_bytes(documents: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, kept) for rows of ``repeated_spans``: what stays of each text, as bytes (a cut may split a character)."""
    keyed = documents.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("body"))
    keyed = keyed.filter(passes(bit_filter(spans, "text_key"), F.col("_key")))
    once = keyed.select(row_key(F.col("_id"), F.col("_key")).alias("_row"), "body").dropDuplicates(["_row"])  # of repeated rows one text
    texts = once.join(spans.withColumn("_row", row_key(F.col(id_col), F.col("text_key"))), "_row").select("row", "body", "spans")
    return texts.mapInArrow(_cut, "row bigint, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["start"])
    found = stored(repeated_spans(documents).withColumns({"n_removed": removed, "n_spans": F.size("spans").cast("bigint")}), "repeats")
    changed = remaining_bytes(documents, found.filter("n_removed > 0 AND n_removed < n_bytes"))
    changed = changed.select("row", F.sha2("kept", 256).alias("sha")).groupBy("row").agg(F.min("sha").alias("sha"))
    sha = F.when(F.col("n_removed") == 0, F.col("text_sha256")).when(F.col("n_removed") == F.col("n_bytes"), F.sha2(F.lit(b""), 256)).otherwise(F.col("sha"))
    return found.join(changed, "row", "left").select("doc_id", "n_bytes", "n_removed", "n_spans", sha.alias("kept_sha256"))

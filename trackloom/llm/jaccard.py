"""N-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

The product of the incidence matrix with its transpose counts the n-grams that
two documents share. Only entries that may reach the threshold are computed:

* Documents with equal words in equal order are one row of the matrix.
* All sets are sorted by one order, common n-grams last. For a similarity of t
  two documents share an n-gram among the first n - ceil(t n) + 1 of each (the
  head). The product runs over these columns first and adds up the overlap of
  each pair; pairs whose count and sizes rule out the threshold are discarded.
* Columns of the head with many rows (groups of near copies) would give all
  pairs; their rows are gathered in blocks instead. A block is multiplied with a
  few pivot rows of its own and part by part with itself; rows that links have
  joined by then need no further product among them. Only the rows outside the
  block's largest joined group are multiplied with the whole block, as far as
  sizes allow a link. Tasks return a spanning forest of links, not the pairs.
* For the pairs that are left the remaining columns are multiplied, over whole
  texts, which gives the exact overlap.

Columns are hashes of n-grams. Every link is computed or checked again on the
words themselves, so equal hashes of different n-grams make no links.

The order goes by document frequency, counted over all documents and kept in bit
filters of fixed size, one for each level. Every filter is a function of the
n-gram alone, so a wrong bit changes the order for all documents alike: filters
decide the cost, never the result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm import text as tx
from trackloom.llm.bits import bit_filter, frequency_filters, frequency_level, passes
from trackloom.llm.graph import components
from trackloom.llm.rows import picked, quoted, restored, text_key
from trackloom.llm.store import stored

LEVELS = (2, 4, 16, 64, 512)  # document frequencies that the order tells apart
WIDE = 64  # rows from which on a column is multiplied in blocks
BLOCK_ROWS = 256  # rows of a part of a block
PIVOTS = 4  # rows of a block that all its parts see
DENSE, COLUMNS = 16, 2048  # rows from which on a task multiplies a column as a dense one, and how many at a time
PAIRS = 256  # pairs whose sets a task holds at a time


def gram_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted within it: (hashes, offset of each text)."""
    starts, ends, first = tx.word_spans(data, offsets, tx.NOT_SPACE)
    words = tx.span_hash(tx.prefix_hash(data, tx.LOWER_CODE), starts, ends)
    count = np.diff(first)
    grams = tx.gram_hash(words, width)
    text_of = np.repeat(np.arange(len(count)), count)
    inside = np.arange(len(grams)) + width <= first[1:][text_of[: len(grams)]]
    hashes, owner = [grams[inside]], [text_of[: len(grams)][inside]]
    for n in range(1, width):  # texts of fewer words are one n-gram
        short = np.flatnonzero(count == n)
        if len(short):
            hashes.append(tx.gram_hash(words, n)[first[short]])
            owner.append(short)
    hash_, owner_ = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((hash_, owner_))
    hash_, owner_ = hash_[order], owner_[order]
    fresh = np.ones(len(hash_), dtype=bool)
    fresh[1:] = (hash_[1:] != hash_[:-1]) | (owner_[1:] != owner_[:-1])
    hash_, owner_ = hash_[fresh], owner_[fresh]
    return hash_, np.searchsorted(owner_, np.arange(len(count) + 1))


def _tail(n, percent: int):
    """n-grams after the head: ceil(percent n / 100) - 1."""
    return -(-percent * n // 100) - 1


def exact_grams(text: bytes | None, width: int) -> set:
    """The distinct n-grams of a text, as tuples of its words."""
    words = (text or b"").lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(width)), strict=False))


def _heads(batches, width, percent, levels):
    """mapInArrow body: (id, text key, text) -> id, text key, n, digest of the words, and of its head the n-grams that may be elsewhere too, with their places."""
    for batch in batches:
        n_all, digests, grams, places = [], [], [], []
        for _, data, offsets in tx.text_chunks(batch.column(2)):
            hash_, first = gram_sets(data, offsets, width)
            n = np.diff(first)
            for i in range(len(n)):
                words = data[offsets[i] : offsets[i + 1]].tobytes().lower().split()
                digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
            n_all.append(n)
            level = frequency_level(levels.value, hash_)
            order = np.argsort(np.repeat(np.arange(len(n)), n) * 8 + level, kind="stable")
            place = np.arange(len(hash_)) - np.repeat(first[:-1], n)
            keep = (place < np.repeat(np.where(n > 0, n - _tail(n, percent), 0), n)) & (level[order] > 0)
            bounds = pa.array(np.concatenate([[0], np.cumsum(keep)])[first].astype(np.int32))
            grams.append(pa.ListArray.from_arrays(bounds, pa.array(hash_[order][keep].view(np.int64))))
            places.append(pa.ListArray.from_arrays(bounds, pa.array(place[keep].astype(np.int32))))
        join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
        lists = lambda x, kind: pa.concat_arrays(x) if x else pa.array([], pa.list_(kind))
        rows = [batch.column(0), batch.column(1), join(n_all), pa.array(digests, pa.binary()), lists(grams, pa.int64()), lists(places, pa.int32())]
        yield pa.RecordBatch.from_arrays(rows, names=["id", "text_key", "n", "digest", "grams", "places"])


def _sets(column, width) -> list[np.ndarray]:
    """Hashes of the distinct n-grams of each text."""
    out = []
    for _, data, offsets in tx.text_chunks(column):
        hash_, first = gram_sets(data, offsets, width)
        out.extend(hash_[first[i] : first[i + 1]] for i in range(len(first) - 1))
    return out


def _linked(overlap, n_a, n_b, percent):
    return 100 * overlap >= percent * (n_a + n_b - overlap)


def _bodies(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _verified(batches, width, percent):
    """mapInArrow body: (a, b, text of a, text of b) -> the pairs that link."""
    for batch in (b.slice(lo, PAIRS) for b in batches for lo in range(0, b.num_rows, PAIRS)):
        sets: dict = {}  # texts that come in several pairs are cut up once
        for column in (2, 3):
            for row, body in zip(batch.column(column - 2).to_pylist(), _bodies(batch.column(column)), strict=True):
                if row not in sets:
                    sets[row] = exact_grams(body, width)
        link = []
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = sets[a], sets[b]
            link.append(_linked(len(x & y), len(x), len(y), percent))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(link, pa.bool_()))


def _link_matrix(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of hashes link with which."""
    size = np.array([len(s) for s in sets])
    hash_, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(hash_, kind="stable")
    hash_, owner = hash_[order], owner[order]
    cuts = np.flatnonzero(np.concatenate([[True], hash_[1:] != hash_[:-1], [True]]))
    width = np.diff(cuts)
    overlap = np.zeros((len(sets), len(sets)), dtype=np.int32)
    for c in np.flatnonzero((width > 1) & (width <= DENSE)):  # columns of few rows: their pairs
        few = owner[cuts[c] : cuts[c + 1]]
        overlap[np.ix_(few, few)] += 1
    wide = np.flatnonzero(width > DENSE)
    for lo in range(0, len(wide), COLUMNS):  # the others as dense matrices
        part = wide[lo : lo + COLUMNS]
        incidence = np.zeros((len(sets), len(part)), dtype=np.float32)
        at = np.concatenate([np.arange(cuts[c], cuts[c + 1]) for c in part])
        incidence[owner[at], np.repeat(np.arange(len(part)), width[part])] = 1
        overlap += (incidence @ incidence.T).astype(np.int32)
    return _linked(overlap, size[:, None], size[None, :], percent)


def _forest(link: np.ndarray, check) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links; ``check`` confirms an edge before it counts."""
    forest, seen = [], np.zeros(len(link), dtype=bool)
    for root in range(len(link)):
        stack = [] if seen[root] else [root]
        seen[root] = True
        while stack:
            at = stack.pop()
            near = [int(x) for x in np.flatnonzero(link[at] & ~seen) if check(at, int(x))]
            seen[near] = True
            forest += [(at, x) for x in near]
            stack += near
    return forest


def _block_links(width, percent):
    """applyInArrow body: rows (row, body, once each) that meet in a part of a block -> a spanning forest of their links."""

    def run(table: pa.Table) -> pa.Table:
        rows, column = table["row"].to_numpy(), table["body"].combine_chunks()
        _, first = np.unique(rows, return_index=True)
        rows, column = rows[first], column.take(pa.array(first))
        link = _link_matrix(_sets(column, width), percent)
        bodies, exact = _bodies(column), {}

        def grams(i):
            if i not in exact:
                exact[i] = exact_grams(bodies[i], width)
            return exact[i]

        forest = _forest(link, lambda i, j: _linked(len(grams(i) & grams(j)), len(grams(i)), len(grams(j)), percent))
        edges = np.array(forest, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(rows[edges[:, 0]]), "b": pa.array(rows[edges[:, 1]])})

    return run


def _dealt(count: Column, size: int) -> Column:
    return F.greatest(F.ceil(count / size), F.lit(1)).cast("int")


def block_links(visits: DataFrame, texts: DataFrame, known: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join the rows of each block of ``visits`` (block, row, n) as all links between them do.

    First each block's rows are dealt into parts of about BLOCK_ROWS, and every
    part is multiplied with itself and with the block's pivots: as many texts as
    visits. With these links and the ``known`` ones, rows fall into groups. Every
    link that is still missing has an end outside the largest group of its block;
    so only those rows (dealt by size and into parts) meet the rest, part by part
    of about BLOCK_ROWS, and only rows whose sizes may link.
    """
    run = _block_links(width, percent)
    counted = visits.groupBy("block").agg(F.count(F.lit(1)).alias("rows"), F.min(F.struct(F.xxhash64("row").alias("k"), "row")).alias("p0"))
    parts = counted.select("block", _dealt(F.col("rows"), BLOCK_ROWS).alias("parts"))
    place = F.pmod(F.xxhash64("row", "block"), F.col("parts")).cast("int")
    placed = stored(visits.join(parts, "block").select("block", "row", "n", "parts", place.alias("part")), "block-parts")
    # pivots: in each of PIVOTS classes of rows by hash, the row with the least hash
    kind = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(PIVOTS))
    pivots = placed.groupBy("block", "parts", kind.alias("kind")).agg(F.min(F.struct(F.xxhash64("row", F.lit(2)).alias("k"), "row")).alias("p"))
    pivots = pivots.select("block", F.col("p.row").alias("row"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    meet = placed.select("block", "row", "part").union(pivots.select("block", "row", "part")).join(texts, "row")
    first = stored(meet.groupBy("block", "part").applyInArrow(run, "a bigint, b bigint"), "block-links")
    labels = components(known.union(first))
    grouped = stored(placed.join(labels.withColumnRenamed("node", "row"), "row", "left").select("block", "row", "n", F.coalesce("label", "row").alias("label")), "block-groups")
    largest = grouped.groupBy("block", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("block").agg(F.max(F.struct("c", "label")).alias("top")).select("block", F.col("top.label").alias("main"))
    band = F.floor(F.log("n") / math.log(100 / percent) + 1e-9).cast("int")  # rows that link are in the same or in adjacent bands
    marked = stored(grouped.join(largest, "block").select("block", "row", band.alias("band"), (F.col("label") != F.col("main")).alias("outside")), "block-marks")
    sizes = marked.groupBy("block", "band").agg(F.count(F.lit(1)).alias("rows"), F.count_if("outside").alias("out"))
    # tiles: a part of the outside rows of a band, by a part of all rows of that band or of a neighbour
    near = sizes.select("block", "band", _dealt(F.col("rows"), BLOCK_ROWS).alias("all_parts"))
    outer = sizes.filter("out > 0").select("block", F.col("band").alias("out_band"), _dealt(F.col("out"), BLOCK_ROWS).alias("out_parts"))
    met = outer.withColumn("band", F.explode(F.array(*[F.col("out_band") + i for i in (-1, 0, 1)]))).join(near, ["block", "band"])
    met = stored(met, "block-tiles")
    deal = lambda parts, salt: F.pmod(F.xxhash64("row", "block", F.lit(salt)), F.col(parts)).cast("int")
    span = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    inner = marked.join(met, ["block", "band"]).select("block", "row", "out_band", "band", deal("all_parts", 3).alias("q"), span("out_parts").alias("p"))
    outside = marked.filter("outside").withColumnRenamed("band", "out_band").join(met, ["block", "out_band"]).select("block", "row", "out_band", "band", deal("out_parts", 4).alias("p"), span("all_parts").alias("q"))
    tile = ["block", "out_band", "band", "p", "q"]
    tiles = inner.select(*tile, "row").union(outside.select(*tile, "row")).join(texts, "row")
    return first.union(stored(tiles.groupBy(*tile).applyInArrow(run, "a bigint, b bigint"), "block-links"))


def jaccard_components(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, text_key, n_shingles, component_id, and row_id (one of a component's rows has row_id = component_row).

    A set has the distinct n-grams of ``width`` whitespace words, A-Z lowered; a
    text of fewer words is one n-gram; null, empty and blank texts have none and
    link with nothing. Documents link when their Jaccard similarity is percent/100
    or more; component_id is the smallest id that links reach (a null id only if
    the component has no other). Repeated rows and ties link as equal sets.
    Columns other than the named ones are ignored.
    """
    source = documents.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("body"))
    levels = frequency_filters(source.select("body"), lambda data, offsets: gram_sets(data, offsets, width)[0], LEVELS)

    keyed = source.select("id", text_key("body").alias("text_key"), "body")
    id_type = keyed.schema["id"].dataType.simpleString()
    heads = keyed.mapInArrow(lambda it: _heads(it, width, percent, levels), f"id {id_type}, text_key string, n bigint, digest binary, grams array<bigint>, places array<int>")
    heads = stored(heads.withColumn("row", F.monotonically_increasing_id()), "heads")
    levels.destroy()

    # rows of the matrix: one per distinct sequence of words; null ids come last among the members of a class
    plain = heads.select("row", "id", "text_key", "n", "digest")
    classes = plain.filter("n > 0").groupBy("digest").agg(F.min("row").alias("rep"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    classes = stored(classes.drop("members"), "classes")
    member = plain.join(classes, "digest", "left").select("row", "id", "text_key", "n", F.coalesce("rep", "row").alias("rep"), F.coalesce("least_id", "id").alias("least_id"))
    member = stored(member, "members")
    copies = member.filter("row != rep").select("row")

    # columns of the head with at least two rows
    slim = heads.filter(F.size("grams") > 0).select("row", "n", "grams", "places").join(copies, "row", "left_anti")
    entries = slim.select("row", "n", F.explode(F.arrays_zip("grams", "places")).alias("e")).select("row", "n", F.col("e.grams").alias("hash"), F.col("e.places").alias("place"))
    rows_of = entries.groupBy("hash").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    entries = stored(entries.join(stored(rows_of, "columns"), "hash"), "entries")

    # product over narrow columns: overlaps of pairs within the head
    narrow = entries.filter(F.col("rows") < WIDE)
    a, b = (narrow.select("hash", *[F.col(c).alias(f"{c}_{s}") for c in ("row", "n", "place")]) for s in "ab")
    bound = "100 * least(n_a, n_b) >= {p} * greatest(n_a, n_b) AND (100 + {p}) * (least(n_a - place_a, n_b - place_b) + least(place_a, place_b)) >= {p} * (n_a + n_b)".format(p=percent)
    pairs = a.join(b, "hash").filter(f"row_a < row_b AND {bound}")
    pairs = pairs.groupBy("row_a", "row_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("head_overlap"))
    tail = lambda n: f"((({percent} * {n} + 99) div 100) - 1)"
    pairs = pairs.filter(f"{100 + percent} * (head_overlap + greatest({tail('n_a')}, {tail('n_b')})) >= {percent} * (n_a + n_b)")
    pairs = stored(pairs.select(F.col("row_a").alias("a"), F.col("row_b").alias("b")), "pairs")

    # wide columns: every row that has one visits the blocks of the rows that it meets there
    wide = entries.filter(F.col("rows") >= WIDE).select("hash", "row")
    heart = wide.groupBy("hash").agg(F.min(F.struct(F.xxhash64("row").alias("k"), "row")).alias("heart"))
    block_of = wide.join(heart, "hash").groupBy("row").agg(F.min("heart").alias("heart")).select("row", F.col("heart.row").alias("block"))
    met = wide.join(block_of, "row").select("hash", "block").distinct()
    visits = wide.join(met, "hash").select("block", "row").distinct().join(heads.select("row", "n"), "row")
    visits = stored(visits, "visits")

    # whole texts of the rows that are left
    needed = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).union(visits.select("row")).distinct()
    needed = stored(needed.join(member.select("row", F.col("id").alias("_id"), F.col("text_key").alias("_key")), "row"), "needed")
    filter_ = bit_filter(needed.select(F.xxhash64("_key").alias("k")), "k")
    near = keyed.filter(passes(filter_, F.xxhash64("text_key")))
    texts = near.join(needed, near["id"].eqNullSafe(needed["_id"]) & (near["text_key"] == needed["_key"])).select("row", "body").dropDuplicates(["row"])
    texts = stored(texts, "texts")
    filter_.destroy()

    # product over the remaining columns
    with_b = pairs.join(texts.select(F.col("row").alias("b"), F.col("body").alias("body_b")), "b")
    with_a = with_b.join(texts.select(F.col("row").alias("a"), F.col("body").alias("body_a")), "a").select("a", "b", "body_a", "body_b")
    links = stored(with_a.mapInArrow(lambda it: _verified(it, width, percent), "a bigint, b bigint"), "links")
    if visits.head(1):
        links = links.union(block_links(visits, texts, links, width, percent))

    labels = stored(components(links).select(F.col("node").alias("rep"), "label").join(member.filter("row = rep").select("rep", "least_id"), "rep"), "labels")
    # one small row for each group; it is joined with the labels of classes, not with every member
    groups = stored(labels.groupBy("label").agg(F.min("least_id").alias("group_id")), "groups")
    labels = labels.join(groups, "label").select("rep", "label", "group_id")
    out = member.join(stored(labels, "labels"), "rep", "left")
    return out.select(
        F.col("id").alias(id_col), "text_key", F.col("n").alias("n_shingles"), F.coalesce("group_id", "least_id").alias("component_id"),
        F.col("row").alias("row_id"), F.coalesce("label", "rep").alias("component_row"),
    )


def drop_near_copies(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id, with all its columns, whatever their names.

    Texts without words all stay. Of rows with one id and text that are the first
    of their group, one stays.
    """
    found = jaccard_components(documents, id_col=id_col, text_col=text_col, **options).filter("n_shingles > 0")
    found = stored(found.select(F.col(quoted(id_col)).alias("id"), "text_key", "component_row"), "near-copies")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_key")
    first = found.groupBy("component_row").agg(F.min(order).alias("k"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    first = stored(first.select(F.col("k.id").alias("id"), F.col("k.text_key").alias("text_key"), "component_row"), "first-copies")
    others = found.join(first.select("component_row").distinct(), "component_row", "left_semi").select("id", "text_key")
    kept, grouped = picked(documents, stored(others.distinct(), "in-groups"), id_col, text_col)
    keep = first.select(F.col("id").alias("key_id"), F.col("text_key").alias("key_text"))
    firsts = grouped.join(keep, F.col("id").eqNullSafe(F.col("key_id")) & (F.col("text_key") == F.col("key_text")), "left_semi").dropDuplicates(["id", "text_key"])
    return restored(kept.union(firsts))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")

"""Deterministic sharded WARC writer and reader.

Records are range-sorted by id over shards with exact boundaries, so the same
rows always make the same files. A task writes the gzip members of its records
into files under temporary names, beginning a new file when one has reached the
wanted compressed size. Tasks report their files in a manifest; what the
manifest names is renamed into place, so leftovers of lost or repeated tasks
never count. Headers and digests are made anew from the payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from trackloom.llm.bits import bit_filter, passes
from trackloom.llm.prefix import running_totals
from trackloom.llm.rows import quoted
from trackloom.llm.store import new_path, stored

DATE = "1970-01-01T00:00:00Z"  # of records whose table has no date
SHARD_BYTES = 16 << 20  # payload bytes of a shard, about
WRITE_ROWS = 64  # records that a task has in Python at a time


_PLAIN = re.compile(r"[^\x00-\x20\x7f](?:[^\x00-\x1f\x7f]*[^\x00-\x20\x7f])?")


def header_value(text: str) -> tuple[str, bool]:
    """(value for a header line, whether it is escaped): a text that cannot stand in a line as it is gets percent escapes.

    Control characters would end the line or be lost, and so would blanks at the
    ends. An escaped text has its percent signs escaped too, so it comes back
    as it was; ``plain_value`` undoes it.
    """
    if not text or _PLAIN.fullmatch(text):
        return text, False
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", text), True


def plain_value(value: str, escaped: bool) -> str:
    return re.sub(r"%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), value) if escaped else value


def _headers(page: str, url: str, length: int, digest: str, refers: str | None, date: str) -> tuple[list[str], bytes]:
    """The lines of a record's header before those of its block, and the head of the block."""
    target, escaped = header_value(url)
    name = lambda key: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}')}>"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {name(page)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"X-Page-ID: {page}",
        f"X-Payload-Length: {length}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if escaped:
        lines.append("X-Target-Escaped: percent")
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers)}", f"X-Refers-To-Page: {refers}"]
    return lines, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length


def _record(page: str, url: str, payload: bytes, digest: str, refers: str | None, date: str) -> list[bytes]:
    """One WARC record in pieces; a revisit has the headers of its payload but not the payload."""
    lines, head = _headers(page, url, len(payload), digest, refers, date)
    body = b"" if refers is not None else payload
    block = hashlib.sha1(head)
    block.update(body)
    lines += [f"WARC-Block-Digest: sha1:{base64.b32encode(block.digest()).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(head) + len(body)}"]
    return ["\r\n".join(lines).encode() + b"\r\n\r\n" + head, body, b"\r\n\r\n"]


class _Counted:
    """A stream that counts the bytes and their CRC on the way to another."""

    def __init__(self, out):
        self.out, self.size, self.crc = out, 0, 0

    def write(self, data) -> int:
        self.out.write(data)
        self.size += len(data)
        self.crc = zlib.crc32(data, self.crc)
        return len(data)

    def flush(self) -> None:
        pass


def _place(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root)


def _write(batches, root, file_bytes, level, date):
    """mapInArrow body: records sorted by (shard, id) -> the files that this attempt wrote under temporary names."""
    system, base = _place(root)
    context = TaskContext.get()
    temporary = f"{base}/_temporary/{context.partitionId()}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
    system.create_dir(temporary, recursive=True)
    done, shard, number, out, records = [], None, 0, None, 0

    def close():
        nonlocal out
        if out is not None:
            out.out.close()
            done.append((f"shard-{shard:06d}-{number:05d}.warc.gz", f"{temporary}/shard-{shard:06d}-{number:05d}.warc.gz", records, out.size, out.crc))
            out = None

    for batch in batches:
        for row in (r for lo in range(0, batch.num_rows, WRITE_ROWS) for r in batch.slice(lo, WRITE_ROWS).to_pylist()):
            if out is None or row["shard"] != shard or out.size >= file_bytes:
                close()
                number = number + 1 if row["shard"] == shard else 0
                shard, records = row["shard"], 0
                out = _Counted(system.open_output_stream(f"{temporary}/shard-{shard:06d}-{number:05d}.warc.gz", compression=None))
            with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=level, mtime=0, filename="") as member:
                for piece in _record(row["page"], row["url"] or "", row["payload"], row["digest"], row["refers"], date):
                    member.write(piece)
            records += 1
    close()
    columns = list(zip(*done, strict=True)) or [[], [], [], [], []]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["file", "temporary", "records", "bytes", "crc32"])


def _commit(batches, root):
    """mapInArrow body: manifest rows -> the same, after their files have been renamed into place; a repeated task finds the work done."""
    system, base = _place(root)
    for batch in batches:
        for row in batch.to_pylist():
            if system.get_file_info(row["temporary"]).type != fs.FileType.NotFound:
                system.move(row["temporary"], f"{base}/{row['file']}")
        yield batch


def range_bounds(ids: DataFrame, shards: int) -> np.ndarray:
    """Upper ends of ``shards`` ranges of the column ``id`` with nearly equal counts.

    Counts are exact, so the ends depend on the rows alone. Rows are counted by
    id, the ids sorted by range partitions with running totals, and the ids at
    which a range is full are collected: one for each range, in one pass however
    the ids lie.
    """
    counts = ids.filter("id IS NOT NULL").groupBy("id").count()
    total = ids.agg(F.count("id")).first()[0]
    if not total or shards <= 1:
        return np.zeros(0, np.int64)
    upto = running_totals(counts, ["id"], {"before": "count"})
    filled = lambda rows: F.floor(rows * F.lit(shards) / F.lit(total))
    full = upto.filter((filled(F.col("before") + F.col("count")) > filled(F.col("before"))) & (F.col("before") + F.col("count") < total))
    return np.sort(full.select("id").toPandas()["id"].to_numpy(np.int64))


def shard_by_range(column: Column, bounds: np.ndarray) -> Column:
    """Number of the range of an id; nulls are in the first."""

    @F.arrow_udf("int")
    def find(ids: pa.Array) -> pa.Array:
        least = int(bounds[0]) if len(bounds) else 0
        return pa.array(np.searchsorted(bounds, ids.fill_null(least).to_numpy()).astype(np.int32))

    return find(column)


def shard_count(pages: DataFrame, html_col: str = "html", shard_bytes: int = SHARD_BYTES) -> int:
    """Shards for all payloads of the table at about ``shard_bytes`` each."""
    total = pages.agg(F.sum(F.octet_length(F.col(quoted(html_col))).cast("bigint"))).first()[0] or 0
    return max(1, -(-total // shard_bytes))


def write_warc(pages: DataFrame, root: str, *, shards: int | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0, file_bytes: int = 64 << 20, level: int = 6, date: str = DATE) -> DataFrame:
    """Write one record per page below the URI ``root`` and return the manifest: file, records, bytes, crc32.

    Of pages with equal payloads of at least min_revisit_bytes, the one with the
    smallest id is a response and the others are revisits of it. A null html is
    an empty payload, a null url an empty target; a url with control characters
    is escaped in the header and comes back as it was. Ids are whole numbers (a
    column of another type is an error); pages with a null id are always
    responses of page "null", and rows that repeat an id are revisits of the same
    page only if an id is smaller. Other columns are ignored. Shards are ranges
    of ids with equal counts, as many as the payloads' bytes ask for unless
    ``shards`` is given, each in a task of its own.
    """
    if not isinstance(pages.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} is not a column of whole numbers")
    shards = shards or shard_count(pages, html_col)
    id_col, url_col, html_col = quoted(id_col), quoted(url_col), quoted(html_col)
    body = F.coalesce(F.col(html_col), F.lit(""))
    payloads = pages.select(F.col(id_col).cast("bigint").alias("page"), F.sha1(F.encode(body, "UTF-8")).alias("sha1"), F.octet_length(body).alias("size"))
    first = payloads.filter(F.col("size") >= min_revisit_bytes).groupBy("sha1").agg(F.min("page").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("sha1", "first")
    first = stored(first, "repeated-payloads")
    bounds = range_bounds(pages.select(F.col(id_col).cast("bigint").alias("id")), shards)
    full = pages.select(F.col(id_col).cast("bigint").alias("page"), F.col(url_col).alias("url"), F.encode(body, "UTF-8").alias("payload"), F.sha1(F.encode(body, "UTF-8")).alias("sha1"))
    # only pages whose payload may occur twice are joined; the others go to their shards at once
    twice = passes(bit_filter(first.withColumn("k", F.xxhash64("sha1")), "k"), F.xxhash64("sha1"))
    marked = full.withColumn("twice", twice)
    joined = marked.filter("twice").join(first, "sha1", "left").unionByName(marked.filter("NOT twice").withColumn("first", F.lit(None).cast("bigint")))
    refers = F.when((F.col("first") < F.col("page")) & (F.octet_length("payload") >= min_revisit_bytes), F.col("first"))
    digest = _base32(F.unhex("sha1"))
    records = joined.select(shard_by_range(F.col("page"), bounds).alias("shard"), F.col("page").alias("id"), F.coalesce(F.col("page").cast("string"), F.lit("null")).alias("page"), "url", "payload", digest.alias("digest"), refers.cast("string").alias("refers"))
    # a shard is one range; the sort keeps its records in order of id, ties by digest
    records = records.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("id").asc_nulls_first(), "digest", "url").drop("id")
    schema = "file string, temporary string, records bigint, bytes bigint, crc32 bigint"
    manifest = stored(records.mapInArrow(lambda it: _write(it, root, file_bytes, level, date), schema), "warc-files")
    committed = manifest.repartition(max(1, min(shards, 64)), "file").mapInArrow(lambda it: _commit(it, root), schema)
    committed.select("file", "records", "bytes", "crc32").write.parquet(f"{root}/_manifest")
    return manifest.sparkSession.read.parquet(f"{root}/_manifest")


def _base32(raw: Column) -> Column:
    @F.arrow_udf("string")
    def code(values: pa.Array) -> pa.Array:
        return pa.array([base64.b32encode(x).decode() for x in values.to_pylist()], pa.string())

    return code(raw)


_FIELDS = "page string, url string, record_type string, digest string, refers string, payload binary, payload_bytes bigint"


def _read(batches, root, whole):
    """mapInArrow body: manifest rows -> the records of their files, checked against the manifest and their own digests."""
    system, base = _place(root)
    for batch in batches:
        for entry in batch.to_pylist():
            rows = []
            with system.open_input_stream(f"{base}/{entry['file']}", compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="rb") as stream:
                while line := stream.readline():
                    headers = {}
                    while (line := stream.readline()) not in (b"\r\n", b""):
                        key, _, value = line.decode().removesuffix("\r\n").partition(": ")
                        headers[key] = value
                    block = stream.read(int(headers["Content-Length"]))
                    if base64.b32encode(hashlib.sha1(block).digest()).decode() != headers["WARC-Block-Digest"][5:]:
                        raise ValueError(f"damaged block in {entry['file']}")
                    stream.read(4)
                    payload = block.partition(b"\r\n\r\n")[2]
                    if headers["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != headers["WARC-Payload-Digest"][5:]:
                        raise ValueError(f"damaged payload in {entry['file']}")
                    url = plain_value(headers["WARC-Target-URI"], "X-Target-Escaped" in headers)
                    rows.append((headers["X-Page-ID"], url, headers["WARC-Type"], headers["WARC-Payload-Digest"][5:], headers.get("X-Refers-To-Page"), payload if whole else None, int(headers["X-Payload-Length"])))
                    if len(rows) >= 256:
                        yield _table(rows)
                        entry["records"] -= len(rows)
                        rows = []
            if len(rows) != entry["records"]:
                raise ValueError(f"{entry['file']} has other records than its manifest says")
            yield _table(rows)


def _table(rows):
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64()]
    columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _FIELDS.split(", ")])


def read_warc(spark: SparkSession, root: str, *, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest below ``root`` names; revisits have no payload, only its length and digest."""
    manifest = spark.read.parquet(f"{root}/_manifest")
    n = max(1, min(manifest.count(), 4096))
    return manifest.repartition(n, "file").mapInArrow(lambda it: _read(it, root, payloads), _FIELDS)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), root, file_bytes=2 << 20)
    back = read_warc(spark, root, payloads=False)
    return back.select(F.expr("try_cast(page AS bigint)").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers").cast("bigint").alias("refers_to"))

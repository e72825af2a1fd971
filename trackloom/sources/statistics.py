"""Statistic files as a data source of Spark, to read and to write.

A file is ``<folder>/<experiment>_<statistic>.csv``: some lines before the
header, the header, then a line for each object and time. Which files are opened
follows from filters on folder, statistic and detail that Spark pushes down, so
asking for one channel of some experiments opens these files only. A long file
is read by several tasks, and many small ones by one. Lines are streamed; no task
holds a file whole.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Fixed names: file name patterns of the statistics; a group in them is the detail (channel or object).
STATISTICS = {
    "displacement": r"Displacement\^2",
    "speed": r"Speed",
    "mean_intensity": r"Intensity_Mean_Ch=(\d+)_Img=1",
    "min_intensity": r"Intensity_Min_Ch=(\d+)_Img=1",
    "object_distance": r"Shortest_Distance_to_Surfaces_Surfaces=([^.]+)",
    "position": r"Position\.csv",
    "volume": r"Volume",
    "area": r"Area",
    "time_index": r"_Time_Index",
}
PREAMBLE_LINES = 3
FORMAT = "track_statistics"
SCHEMA = "folder_name string, stat_folder string, file_name string, statistic string, detail string, f map<string,string>"
SPLIT_BYTES = 64 << 20  # of files to a task
OPEN_BYTES = 1 << 20  # that opening a file counts as
BATCH_LINES = 8192


class FilePart(NamedTuple):
    """Lines that begin in bytes [start, end) of a file, as one statistic; ``path`` is one of the file system of the URI ``root``."""

    root: str
    path: str
    statistic: str
    detail: str
    start: int
    end: int


class FileParts(InputPartition):
    """Parts that one task reads, one after the other."""

    def __init__(self, parts: list[FilePart]):
        super().__init__(None)
        self.parts = parts


def packed(parts: list[FilePart], most: int, tasks: int) -> list[FileParts]:
    """Parts in their order, for at least ``tasks`` tasks if there are as many parts, of at most ``most`` bytes each where a task has several."""
    sizes = [p.end - p.start + OPEN_BYTES for p in parts]
    most, out, held = min(most, sum(sizes) // max(1, tasks)), [], 0
    for part, size in zip(parts, sizes, strict=True):
        if not out or held + size > most:
            out.append(FileParts([]))
            held = 0
        out[-1].parts.append(part)
        held += size
    return out or [FileParts([])]


def _fields(line: str) -> list[str]:
    return [x.replace('"', "").strip() for x in line.rstrip("\r\n").split(",")]


class StatisticsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = [p for p in options.get("path", "").split("\n") if p]
        self.preamble = int(options.get("preamble", PREAMBLE_LINES))
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.tasks = int(options.get("tasks", 1))
        self.wanted: dict[str, set[str]] = {"folder_name": set(json.loads(options["folders"]))} if "folders" in options else {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 - Spark's name
        """Equality and lists on folder_name, statistic and detail choose files; Spark applies all others."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute in (("folder_name",), ("statistic",), ("detail",)):
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def _wants(self, name: str, value: str) -> bool:
        return name not in self.wanted or value in self.wanted[name]

    def partitions(self) -> list[FileParts]:
        """Lists the folders on the driver: a name and a size for each file, no contents."""
        found = []
        for root in self.roots:
            system, base = fs.FileSystem.from_uri(root)
            for info in system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)):
                folder, _, name = info.path.rpartition("/")
                if info.type != fs.FileType.File or not name.endswith(".csv") or not self._wants("folder_name", folder.rpartition("/")[2]):
                    continue
                for statistic, pattern in STATISTICS.items():
                    match = re.search(pattern, name) if self._wants("statistic", statistic) else None
                    detail = match[1] if match and match.re.groups else ""
                    if match and self._wants("detail", detail):
                        found += [FilePart(root, info.path, statistic, detail, lo, min(lo + self.split, info.size)) for lo in range(0, max(info.size, 1), self.split)]
        return packed(found, self.split, self.tasks)

    def read(self, partition: FileParts) -> Iterator[pa.RecordBatch]:
        systems = {root: fs.FileSystem.from_uri(root)[0] for root in {p.root for p in partition.parts}}
        for part in partition.parts:
            with systems[part.root].open_input_file(part.path) as file:
                yield from self._batches(file, part)

    def _batches(self, file: pa.NativeFile, part: FilePart) -> Iterator[pa.RecordBatch]:
        lines = io.BufferedReader(file)
        for _ in range(self.preamble):
            lines.readline()
        header = _fields(lines.readline().decode())
        at = [i for i, n in enumerate(header) if n]  # a trailing comma makes an unnamed last field
        if part.start > lines.tell():  # a line that begins earlier is the earlier part's
            lines.seek(part.start - 1)
            lines.readline()
        place, rows = lines.tell(), []
        while place < part.end and (line := lines.readline()):
            place += len(line)
            text = line.decode()
            if text.strip():
                rows.append(text)
            if len(rows) == BATCH_LINES:
                yield self._batch(rows, header, at, part)
                rows = []
        if rows:
            yield self._batch(rows, header, at, part)

    def _batch(self, rows: list[str], header: list[str], at: list[int], part: FilePart) -> pa.RecordBatch:
        folder, _, name = part.path.rpartition("/")
        n, k = len(rows), len(at)
        split = pc.split_pattern(pa.array(rows, pa.string()), ",")
        starts, length = split.offsets.to_numpy()[:-1, None], pc.list_value_length(split).to_numpy()[:, None]
        place = (starts + np.array(at, dtype=np.int32)).ravel()
        missing = (length <= np.array(at, dtype=np.int32)).ravel()  # of lines with fewer fields than the header
        values = pc.utf8_trim_whitespace(pc.replace_substring(split.values, '"', "")).take(pa.array(place, mask=missing))
        names = pa.array([header[i] for i in at], pa.string()).take(pa.array(np.tile(np.arange(k), n)))
        fields = pa.MapArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), names, values)
        same = [folder.rpartition("/")[2], folder, name, part.statistic, part.detail]
        columns = [pa.repeat(pa.scalar(x, pa.string()), n) for x in same]
        return pa.RecordBatch.from_arrays([*columns, fields], names=["folder_name", "stat_folder", "file_name", "statistic", "detail", "f"])


class Written(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str]]):
        self.moves = moves


class StatisticsWriter(DataSourceArrowWriter):
    """Rows (folder, file, header, line), those of a file together: files under temporary names, which the commit turns into theirs."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.root, self.overwrite = options["path"], overwrite
        self.preamble = int(options.get("preamble", PREAMBLE_LINES))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        system, base = fs.FileSystem.from_uri(self.root)
        attempt, moves, open_, out = TaskContext.get().taskAttemptId(), [], None, None
        for batch in batches:
            ends = pc.run_end_encode(pc.binary_join_element_wise(batch["folder"], batch["file"], "/")).run_ends.to_pylist() if len(batch) else []
            for lo, hi in zip([0, *ends], ends):  # noqa: B905 - the ends are one fewer
                key = (batch["folder"][lo].as_py(), batch["file"][lo].as_py())
                if key != open_:
                    if out:
                        out.close()
                    open_, target = key, f"{base}/{key[0]}/{key[1]}"
                    system.create_dir(f"{base}/{key[0]}", recursive=True)
                    moves.append((f"{base}/{key[0]}/.{key[1]}.{attempt}", target))
                    out = system.open_output_stream(moves[-1][0], compression=None)
                    out.write(("\n" * self.preamble + batch["header"][lo].as_py() + "\n").encode())
                out.write(("\n".join(batch["line"].slice(lo, hi - lo).to_pylist()) + "\n").encode())
        if out:
            out.close()
        return Written(moves)

    def commit(self, messages: list[Written]) -> None:
        system, _ = fs.FileSystem.from_uri(self.root)
        moves = [m for x in messages if x for m in x.moves]
        targets = [t for _, t in moves]
        if len(set(targets)) != len(targets):
            self.abort(messages)
            raise ValueError("the lines of a statistic file came from several tasks: repartition by folder and file")
        for source, target in moves:
            system.move(source, target)

    def abort(self, messages: list[Written]) -> None:
        system, _ = fs.FileSystem.from_uri(self.root)
        for source, _ in (m for x in messages if x for m in x.moves):
            if system.get_file_info(source).type == fs.FileType.File:
                system.delete_file(source)


class StatisticsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> StatisticsReader:
        return StatisticsReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> StatisticsWriter:
        return StatisticsWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(StatisticsSource)

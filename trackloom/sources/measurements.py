"""Measurement files of tracked objects, and experiment metadata."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.operators.ids import first_rows, unique_track_ids
from trackloom.operators.joins import natural_join, with_metadata
from trackloom.schema import METADATA, OBSERVATION_KEYS
from trackloom.sources.statistics import FORMAT, register

#: Fixed names: headers of the measures of the statistics, and the columns that they become.
MEASURES = {
    "displacement": {"Displacement^2": "displacement"},
    "speed": {"Speed": "speed"},
    "mean_intensity": {"Intensity Mean": "red_lym"},
    "min_intensity": {"Intensity Min": "dist_org"},
    "object_distance": {"Shortest Distance to Surfaces": "dist_org"},
    "position": {"Position X": "x", "Position Y": "y", "Position Z": "z"},
    "volume": {"Volume": "volume"},
    "area": {"Area": "area"},
}
KEYS = OBSERVATION_KEYS


def read_metadata(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Experiments with a fixed schema; columns that the file lacks are null."""
    wanted = T.StructType.fromDDL(METADATA)
    raw = spark.read.option("header", True).option("sep", sep).csv(path)
    return raw.select(*[(F.col(f.name) if f.name in raw.columns else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in wanted])


def with_stats_folders(metadata: DataFrame, data_dir: str, column: str) -> DataFrame:
    """Statistics folders by the rule of the metadata: if any is missing, all are ``<data_dir>/<basename>_Statistics``."""
    missing = metadata.agg(F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0)).alias("_any")).withColumn("_one", F.lit(1))
    built = F.concat(F.lit(data_dir.rstrip("/") + "/"), F.col("basename"), F.lit("_Statistics"))
    joined = metadata.withColumn("_one", F.lit(1)).join(missing, "_one")
    return joined.withColumn(column, F.when(F.col("_any") == 1, built).otherwise(F.col(column))).drop("_one", "_any")


@dataclass(frozen=True)
class StatisticFiles:
    """The statistic files below the folders ``roots`` (URIs)."""

    spark: SparkSession
    roots: tuple[str, ...]

    def read(self, statistic: str, folders: list[str] | None = None, detail: str | None = None) -> DataFrame:
        """Lines of one statistic as ``statistics.SCHEMA``, of some folders (by their own names) and one detail, if given; no other files are opened.

        Every call loads anew: scans of one loaded table share what was pushed down last.
        """
        register(self.spark)
        source = self.spark.read.format(FORMAT).option("tasks", self.spark.sparkContext.defaultParallelism)
        source = source if folders is None else source.option("folders", json.dumps(folders))  # names by the thousand make a slow filter
        rows = source.load("\n".join(self.roots)).filter(F.col("statistic") == statistic)
        return rows if detail is None else rows.filter(F.col("detail") == detail)


def read_statistics(spark: SparkSession, roots: str | list[str]) -> StatisticFiles:
    return StatisticFiles(spark, (roots,) if isinstance(roots, str) else tuple(roots))


def _value(name: str, kind: str = "double") -> F.Column:
    return F.nullif(F.try_element_at(F.col("f"), F.lit(name)), F.lit("")).try_cast(kind)


def observations(files: StatisticFiles, statistic: str, measures: dict[str, str] | None = None, folders: list[str] | None = None, detail: str | None = None) -> DataFrame:
    """Rows of one statistic: keys, the file's ``detail``, and measures (header -> name).

    Batch exports name their image in a column and give the time as an index in
    a ``_Time_Index`` file; there the image is the experiment and the time is
    taken from that file.
    """
    rows = files.read(statistic, folders, detail)
    measures = MEASURES[statistic] if measures is None else measures
    image = F.nullif(F.try_element_at(F.col("f"), F.lit("Original Image Name")), F.lit(""))
    base = F.coalesce(image, F.regexp_extract("folder_name", r"^(.*?)_Statistics$", 1))
    spans = {n: _value(h) for n, h in (("_birth", "Birth [s]"), ("_death", "Death [s]"))}
    out = rows.select("stat_folder", base.alias("basename"), image.isNotNull().alias("_batch"), _value("Time", "int").alias("time"), _value("TrackID", "string").alias("track_id"), _value("ID", "bigint").alias("id"), "detail", *[_value(h).alias(n) for h, n in measures.items()], *[c.alias(n) for n, c in spans.items()])
    index = files.read("time_index", folders)
    index = index.select("stat_folder", image.alias("basename"), _value("TrackID", "string").alias("track_id"), _value("ID", "bigint").alias("id"), _value("Time Index", "int").alias("_index"), *[c.alias(n) for n, c in spans.items()]).filter("basename IS NOT NULL")
    keys = ["stat_folder", "basename", "track_id", "id", "_birth", "_death"]
    joined = natural_join([out, index], keys, "left")
    return joined.withColumn("time", F.when(F.col("_batch"), F.coalesce("_index", "time")).otherwise(F.col("time"))).drop("_index", "_batch", "_birth", "_death")


def _last(folder: str) -> Column:
    """Name of the folder at the end of a path."""
    return F.regexp_extract(F.rtrim(F.col(folder), F.lit("/")), r"([^/]+)$", 1)


def folders_of(metadata: DataFrame, folder: str) -> list[str]:
    """Names of the experiments' folders; the metadata has a row for each experiment."""
    return sorted(r[0] for r in metadata.select(_last(folder)).dropna().distinct().collect())


def chosen(files: StatisticFiles, statistic: str, metadata: DataFrame, folder: str, wanted: Column, measures: dict[str, str] | None = None) -> DataFrame:
    """Rows of the files whose detail (channel or object) is the one that the metadata of their experiment asks for.

    The asked details are a few; the files of each are read with its own filters.
    """
    asked = metadata.select("basename", F.col(folder).alias("_folder"), _last(folder).alias("_last"), wanted.cast("string").alias("_detail")).dropna().distinct()
    of_detail: dict[str, set[str]] = {}
    for r in asked.select("_detail", "_last").distinct().collect():
        of_detail.setdefault(r["_detail"], set()).add(r["_last"])
    parts = [observations(files, statistic, measures, sorted(of_detail[d]), d) for d in sorted(of_detail)]
    rows = reduce(DataFrame.unionByName, parts or [observations(files, statistic, measures, []).limit(0)])
    met = (rows["basename"] == asked["basename"]) & (rows["stat_folder"].endswith(asked["_folder"])) & (rows["detail"] == asked["_detail"])
    return rows.join(asked, met).select(*[rows[c] for c in rows.columns if c != "detail"])


def raw_tcell_tracks(files: StatisticFiles, metadata: DataFrame, folder: str = "tcell_stats_folder") -> DataFrame:
    """One row per cell and time with displacement, speed, dist_org, red_lym and position, joined from the statistic files.

    The dye and distance files are those of the channels or the tumour that the
    metadata names; both kinds of distance end in one column.
    """
    mine = folders_of(metadata, folder)
    dye = chosen(files, "mean_intensity", metadata, folder, F.col("dead_dye_channel"))
    by_object = chosen(files, "object_distance", metadata.filter("imaris_object_distance"), folder, F.col("tumor_name"))
    by_channel = chosen(files, "min_intensity", metadata.filter("NOT coalesce(imaris_object_distance, false)"), folder, F.col("organoid_distance_channel"))
    plain = [observations(files, kind, folders=mine).drop("detail") for kind in ("displacement", "speed", "position")]
    return natural_join([*plain[:2], by_object.unionByName(by_channel), dye, plain[2]], KEYS)


def raw_organoid_tracks(files: StatisticFiles, metadata: DataFrame, folder: str = "organoid_stats_folder") -> DataFrame:
    """One row per organoid and time with volume, dead_dye_mean, area and position.

    An experiment has one organoid line, so of several rows of the metadata for it
    (one for each kind of T cell) the first by number, well and line counts.
    """
    once = first_rows(metadata, ["basename"], ["exp_nr", "well", "tcell_line"])
    mine = folders_of(once, folder)
    dye = chosen(files, "mean_intensity", once, folder, F.col("dead_dye_channel"), {"Intensity Mean": "dead_dye_mean"})
    position = observations(files, "position", {"Position X": "pos_x", "Position Y": "pos_y", "Position Z": "pos_z"}, mine).drop("detail")
    return natural_join([observations(files, "volume", folders=mine).drop("detail"), dye, observations(files, "area", folders=mine).drop("detail"), position], KEYS)


def organoid_table(files: StatisticFiles, metadata: DataFrame, folder: str = "organoid_stats_folder") -> DataFrame:
    """``raw_organoid_tracks`` with the metadata of the experiments, and track ids that are unique over all of them."""
    once = first_rows(metadata, ["basename"], ["exp_nr", "well", "tcell_line"]).drop("tcell_stats_folder", "organoid_stats_folder")
    rows = with_metadata(raw_organoid_tracks(files, metadata, folder), once, ["basename"])
    return unique_track_ids(rows, ["basename", "stat_folder"])

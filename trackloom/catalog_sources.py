"""Registered queries over files: statistic files, metadata, saved tables and lists, written from the tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.catalog import _KEYS, CLASSED, PROCESSED, _classed, _processed, _r, query, rounded
from trackloom.functions.columns import without_blanks
from trackloom.operators import composition, death, filters, ids, joins
from trackloom.plans import surrogates as s
from trackloom.schema import METADATA
from trackloom.sources import exports, tables
from trackloom.sources import measurements as m

# An experiment is a hundred users: files stay small however many users there are.
_BASE_SQL = "'Exp' || (number // 100)"
_FILES = {
    "Displacement^2": ("Displacement^2", "displacement"),
    "Speed": ("Speed", "speed"),
    "Intensity_Mean_Ch=3_Img=1": ("Intensity Mean", "red_lym"),
    "Intensity_Mean_Ch=7_Img=1": ("Intensity Mean", "displacement"),  # another channel, which the metadata does not name
    "Intensity_Min_Ch=10_Img=1": ("Intensity Min", "dist_org"),
}


def _base() -> F.Column:
    return F.concat(F.lit("Exp"), F.floor(F.col("number") / 100).cast("string"))


def _id() -> F.Column:
    return (F.col("number") * 1000 + F.col("time")).cast("bigint")


def _folder() -> F.Column:
    return F.concat(_base(), F.lit("_Statistics"))


def _keys() -> list[F.Column]:
    """Time, TrackID and ID as they stand in a file; every seventh time the object has no track."""
    return [F.col("time"), F.when(F.col("time") % 7 != 0, F.col("track_id")), _id()]


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells, derived once: each statistic is a pass over them."""
    return tables.written(s.cells(spark, sf_dir), "cells")


def _written(spark: SparkSession, cells: DataFrame) -> str:
    """Statistic files of all cells; returns their root."""
    root = exports.new_folder(spark, "statistics")
    parts = [exports.statistic_lines(cells, _folder(), F.concat(_base(), F.lit(f"_{name}.csv")), f"{header},Time,TrackID,ID,", [F.col(c), *_keys()]) for name, (header, c) in _FILES.items()]
    place = [F.col("number").cast("double"), F.col("time").cast("double"), F.lit(0.5)]
    parts.append(exports.statistic_lines(cells, _folder(), F.concat(_base(), F.lit("_Position.csv")), "Position X,Position Y,Position Z,Time,TrackID,ID,", [*place, *_keys()]))
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    exports.write_statistics(lines, root)
    return root


_OBSERVED = s.CELLS + f", seen AS (SELECT {_BASE_SQL} AS basename, time, CASE WHEN time % 7 <> 0 THEN track_id END AS track_id, CAST(number * 1000 + time AS BIGINT) AS id, number, speed, displacement, red_lym, dist_org FROM cells)"


@query(_OBSERVED + f" SELECT basename, time, track_id, id, {_r('speed')} FROM seen")
def statistic_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statistic from all files of all experiments, in one scan."""
    found = m.read_statistics(spark, _written(spark, _cells(spark, sf_dir)))
    return rounded(m.observations(found, "speed").select("basename", "time", "track_id", "id", "speed"))


@query(s.CELLS + f" SELECT {_BASE_SQL} AS basename, time, track_id, {_r('speed')} FROM cells")
def batch_export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder for all experiments; the image names the experiment, and the index file has the time."""
    cells, root = s.cells(spark, sf_dir), exports.new_folder(spark, "batch")
    file = lambda kind: F.concat(F.lit("Batch"), F.floor(F.col("number") / 100).cast("string"), F.lit(f"_{kind}.csv"))
    rest = [_base(), F.lit(0.0), F.col("time").cast("double"), F.col("track_id"), _id()]
    header = "Original Image Name,Birth [s],Death [s],TrackID,ID,"
    speed = exports.statistic_lines(cells, F.lit("Batch_Statistics"), file("Speed"), f"Speed,Time,{header}", [F.col("speed"), F.lit(-1), *rest])
    index = exports.statistic_lines(cells, F.lit("Batch_Statistics"), file("Time_Index"), f"Time Index,{header}", [F.col("time"), *rest])
    exports.write_statistics(speed.unionByName(index), root)
    return rounded(m.observations(m.read_statistics(spark, root), "speed").select("basename", "time", "track_id", "speed"))


def _experiments(cells: DataFrame) -> DataFrame:
    """Metadata of all experiments, with the columns of the schema in their order."""
    values = {"organoid_line": F.lit("13T"), "exp_nr": F.floor(F.col("first") / 100).cast("int"), "dead_dye_channel": F.lit(3), "organoid_distance_channel": F.lit(10), "tcell_contact_threshold": F.lit(10.0), "tcell_dead_dye_threshold": F.lit(s.CELL_DYE), "organoid_contact_threshold": F.lit(s.ORGANOID_DISTANCE), "imaris_object_distance": F.lit(False)}
    found = cells.groupBy(_base().alias("basename")).agg(F.min("number").alias("first"))
    names = [(part.split()[0], part.split()[1]) for part in METADATA.replace("\n", " ").split(",")]
    return found.select("basename", *[values.get(n, F.lit(None)).cast(t).alias(n) for n, t in names if n != "basename"])


def _metadata(spark: SparkSession, cells: DataFrame) -> DataFrame:
    """The experiments' metadata by way of a file."""
    path = exports.new_folder(spark, "metadata")
    tables.write_delimited(_experiments(cells), path, ",")
    return m.with_stats_folders(m.read_metadata(spark, path), "", "tcell_stats_folder")


@query(_OBSERVED + " SELECT basename, CAST(min(number) // 100 AS INTEGER) AS exp_nr, '13T' AS organoid_line, 3 AS dead_dye_channel, CAST(NULL AS VARCHAR) AS tumor_name, false AS imaris_object_distance, '/' || basename || '_Statistics' AS tcell_stats_folder FROM seen GROUP BY basename")
def metadata_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata read from a delimited file, with default folders."""
    return _metadata(spark, s.cells(spark, sf_dir)).select("basename", "exp_nr", "organoid_line", "dead_dye_channel", "tumor_name", "imaris_object_distance", "tcell_stats_folder")


@query(_OBSERVED + f" SELECT basename, time, track_id, id, {_r('displacement', 'speed', 'dist_org', 'red_lym', 'CAST(number AS DOUBLE) AS x', 'CAST(time AS DOUBLE) AS y')} FROM seen")
def raw_tcell_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw table joined from the files that the metadata asks for."""
    cells = _cells(spark, sf_dir)
    raw = m.raw_tcell_tracks(m.read_statistics(spark, _written(spark, cells)), _metadata(spark, cells))
    return rounded(raw.select("basename", "time", "track_id", "id", "displacement", "speed", "dist_org", "red_lym", "x", "y"))


@query(_OBSERVED + f" SELECT basename, time, track_id, id, {_r('CASE WHEN number // 100 % 2 = 0 THEN dist_org + 0.5 ELSE dist_org END AS dist_org', 'red_lym')} FROM seen")
def raw_tcell_by_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other experiment takes the distance to the tumour's surface instead of the channel's."""
    cells = _cells(spark, sf_dir)
    root = _written(spark, cells)
    even = F.floor(F.col("number") / 100) % 2 == 0
    name = F.concat(_base(), F.lit("_Shortest_Distance_to_Surfaces_Surfaces=tumor.csv"))
    header = "Shortest Distance to Surfaces,Time,TrackID,ID,"
    exports.write_statistics(exports.statistic_lines(cells.filter(even), _folder(), name, header, [F.col("dist_org") + 0.5, *_keys()]), root)
    by_object = F.col("exp_nr") % 2 == 0
    metadata = _metadata(spark, cells).withColumns({"imaris_object_distance": by_object, "tumor_name": F.when(by_object, F.lit("tumor"))})
    return rounded(m.raw_tcell_tracks(m.read_statistics(spark, root), metadata).select("basename", "time", "track_id", "id", "dist_org", "red_lym"))


_GROWN_SQL = s.ORGANOIDS + ", grown AS (SELECT *, CAST(track_id AS BIGINT) // 10 AS batch, CAST(track_id AS BIGINT) * 1000 + time + 500 AS id FROM organoids)"


def _organoid_files(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """(root of the statistic files of all organoids, their metadata): ten organoids are an experiment, with two rows in the metadata."""
    number = F.col("track_id").cast("bigint")
    base = F.concat(F.lit("Org"), F.floor(number / 10).cast("string"))
    rows, root = tables.written(s.organoids(spark, sf_dir), "organoid-rows"), exports.new_folder(spark, "organoids")
    keys = [F.col("time"), F.col("track_id"), number * 1000 + F.col("time") + 500]
    files = {"Volume": ("Volume", [F.col("volume")]), "Area": ("Area", [F.col("area")]), "Intensity_Mean_Ch=3_Img=1": ("Intensity Mean", [F.col("dead_dye_mean")]), "Intensity_Mean_Ch=4_Img=1": ("Intensity Mean", [F.col("volume")])}
    files["Position"] = ("Position X,Position Y,Position Z", [F.col("volume") * 2, F.col("area") / 4, F.lit(0.5)])
    folder = F.concat(base, F.lit("_Statistics"))
    lines = [exports.statistic_lines(rows, folder, F.concat(base, F.lit(f"_{name}.csv")), f"{header},Time,TrackID,ID,", [*values, *keys]) for name, (header, values) in files.items()]
    exports.write_statistics(joins.stacked(lines), root)
    both = rows.select(base.alias("basename"), F.floor(number / 10).cast("int").alias("exp_nr")).distinct()
    both = both.select("*", F.explode(F.array(F.lit("CD4"), F.lit("CD8"))).alias("tcell_line"))
    values = {"organoid_line": F.lit("13T"), "well": F.lit("well1"), "date": F.lit("23/05/2019"), "dead_dye_channel": F.lit(3)}
    names = [(part.split()[0], part.split()[1]) for part in METADATA.replace("\n", " ").split(",")]
    metadata = tables.written(both.select(*[(F.col(n) if n in both.columns else values.get(n, F.lit(None))).cast(t).alias(n) for n, t in names]), "organoid-metadata")
    return root, m.with_stats_folders(metadata, "", "organoid_stats_folder")


@query(_GROWN_SQL + f", ranked AS (SELECT batch, CAST(row_number() OVER (ORDER BY 'Org' || batch) AS VARCHAR) AS place FROM (SELECT DISTINCT batch FROM grown)) SELECT 'Org' || batch AS basename, place || '_' || track_id AS track_id, track_id AS original_track_id, time, id, '13T' AS organoid_line, 'CD4' AS tcell_line, CAST(batch AS INTEGER) AS exp_nr, {_r('volume', 'dead_dye_mean', 'area', 'volume * 2 AS pos_x', 'area / 4 AS pos_y')} FROM grown JOIN ranked USING (batch)")
def raw_organoid_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1-S5 for organoids: the raw table from the files that the metadata asks for, with unique track ids."""
    root, metadata = _organoid_files(spark, sf_dir)
    table = m.organoid_table(m.read_statistics(spark, root), metadata)
    return rounded(table.select("basename", "track_id", "original_track_id", "time", "id", "organoid_line", "tcell_line", "exp_nr", "volume", "dead_dye_mean", "area", "pos_x", "pos_y"))


@query(PROCESSED + f" SELECT track_id, time, {_r('speed')} FROM processed")
def saved_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that is built once, saved, and loaded again where it exists."""
    path = exports.new_folder(spark, "saved")
    build = lambda: _processed(spark, sf_dir).select("track_id", "time", "speed")
    tables.reused(spark, path, build)
    return rounded(tables.reused(spark, path, build))


@query(s.CELLS + f" SELECT track_id, time, well, {_r('speed')} FROM cells")
def delimited_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited text with a header, read back."""
    path = exports.new_folder(spark, "delimited")
    tables.write_delimited(s.cells(spark, sf_dir).select("track_id", "time", "well", "speed"), path)
    return rounded(spark.read.option("header", True).option("sep", "\t").schema("track_id string, time int, well string, speed double").csv(path))


@query(CLASSED + " SELECT 'E' || exp_nr AS basename, cluster2, string_agg(track_id, ',' ORDER BY track_id) AS ids FROM classed GROUP BY ALL")
def id_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of id lists per experiment, read back."""
    tracks = _classed(spark, sf_dir)
    originals = tracks.select(F.concat(F.lit("E"), F.col("exp_nr").cast("string")).alias("basename"), "track_id", F.col("track_id").alias("original_track_id"))
    path = exports.new_folder(spark, "lists")
    tables.write_id_lists(composition.ids_per_class(tracks, originals, "basename"), path, "basename")
    back = spark.read.schema("basename string, cluster2 bigint, ids array<string>").json(path)
    return back.filter(F.size("ids") > 0).select("basename", "cluster2", F.array_join("ids", ",").alias("ids"))


@query(CLASSED + ", lists AS (SELECT 'E' || exp_nr AS basename, cluster2, string_agg(track_id, ',' ORDER BY track_id) AS ids FROM classed GROUP BY ALL) SELECT basename, string_agg(cluster2 || ':c(' || ids || ')', ',' ORDER BY cluster2) AS line FROM lists GROUP BY basename")
def backprojection_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of an experiment as one line of text without blanks."""
    tracks = _classed(spark, sf_dir)
    lists = tracks.groupBy(F.concat(F.lit("E"), F.col("exp_nr").cast("string")).alias("basename"), "cluster2").agg(F.array_sort(F.collect_set("track_id")).alias("ids"))
    each = F.concat(F.col("cluster2").cast("string"), F.lit(": c("), F.array_join("ids", ", "), F.lit(")"))
    lines = lists.groupBy("basename").agg(F.array_sort(F.collect_list(F.struct("cluster2", each.alias("text")))).alias("parts"))
    return lines.select("basename", without_blanks(F.array_join(F.col("parts.text"), ", ")).alias("line"))


@query(_OBSERVED + f", meta AS (SELECT basename, CAST(min(number) // 100 AS INTEGER) AS exp_nr FROM seen WHERE number < 1000 GROUP BY basename) SELECT basename, time, id, {_r('speed')}, meta.exp_nr FROM seen LEFT JOIN meta USING (basename)")
def cells_with_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every observation stays; experiments that the metadata lacks have nulls."""
    seen = s.cells(spark, sf_dir).select(_base().alias("basename"), "time", _id().alias("id"), "speed")
    known = _experiments(s.cells(spark, sf_dir)).filter("exp_nr < 10").select("basename", "exp_nr")
    return rounded(joins.with_metadata(seen, known, ["basename"]))


_WELL_SQL = s.ORGANOIDS + f", wells AS (SELECT {s.WELL}, count(DISTINCT track_id) AS n_tracks FROM organoids GROUP BY ALL)"


@query(_WELL_SQL + f" SELECT track_id, time, {s.WELL}, n_tracks, {_r('volume')} FROM organoids JOIN wells USING ({s.WELL})")
def guarded_well_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows joined with one row per well; a right side that repeats a well would be an error."""
    organoids = s.organoids(spark, sf_dir)
    wells = organoids.groupBy(*death.WELL_KEY).agg(F.countDistinct("track_id").alias("n_tracks"))
    return rounded(joins.join_once(organoids, wells, death.WELL_KEY).select("track_id", "time", *death.WELL_KEY, "n_tracks", "volume"))


@query(_WELL_SQL + f" SELECT track_id, time, {s.WELL}, starting, {_r('volume')} FROM organoids LEFT JOIN (SELECT {s.WELL}, count(DISTINCT track_id) AS starting FROM organoids WHERE time = 1 AND exp_nr < 2 GROUP BY ALL) USING ({s.WELL})")
def guarded_well_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6 as a left join: wells that the right side lacks keep their rows."""
    organoids = s.organoids(spark, sf_dir)
    wells = organoids.filter("time = 1 AND exp_nr < 2").groupBy(*death.WELL_KEY).agg(F.countDistinct("track_id").alias("starting"))
    return rounded(joins.join_once(organoids, wells, death.WELL_KEY, "left").select("track_id", "time", *death.WELL_KEY, "starting", "volume"))


@query(CLASSED + f" SELECT track_id, {', '.join(_KEYS)}, cluster2 FROM classed WHERE cluster2 <> 1")
def outlier_class_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tracks but those of one class."""
    return filters.without_class(_classed(spark, sf_dir), "cluster2", 1)


@query(s.CELLS + f" SELECT track_id, time, {_r('CAST(speed AS DOUBLE) AS speed', 'CAST(NULL AS DOUBLE) AS red_lym')} FROM cells UNION ALL SELECT track_id, time, CAST(NULL AS DOUBLE) AS speed, {_r('red_lym')} FROM cells")
def union_missing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of different columns below each other."""
    cells = s.cells(spark, sf_dir)
    return rounded(joins.stacked([cells.select("track_id", "time", "speed"), cells.select("track_id", "time", "red_lym")]))


@query(CLASSED + " SELECT exp_nr, " + ", ".join(f"count(*) FILTER (WHERE cluster2 = {c}) AS class_{c}" for c in range(1, 7)) + " FROM classed GROUP BY exp_nr")
def class_counts_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small pivot, of known classes."""
    return composition.counts_wide(_classed(spark, sf_dir), ["exp_nr"], "cluster2", list(range(1, 7)))


@query(s.FRAGMENTS + f", placed AS (SELECT *, volume * 2 AS pos_x, area / 3 AS pos_y, CAST(time AS DOUBLE) AS pos_z FROM fragments) SELECT track_id, time, {s.WELL}, {_r('avg(pos_x) AS pos_x', 'avg(pos_y) AS pos_y', 'avg(pos_z) AS pos_z', 'sum(volume) AS volume')} FROM placed GROUP BY ALL HAVING sum(volume) <> 0")
def fragment_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: fragments merged with their mean position."""
    placed = s.fragments(spark, sf_dir).withColumns({"pos_x": F.col("volume") * 2, "pos_y": F.col("area") / 3, "pos_z": F.col("time").cast("double")})
    return rounded(death.merge_fragments(placed).select("track_id", "time", *death.WELL_KEY, "pos_x", "pos_y", "pos_z", "volume"))


@query(s.CELLS + " SELECT track_id, count(*) AS n_rows FROM cells GROUP BY track_id HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: keys that occur more than once."""
    return ids.duplicate_keys(s.cells(spark, sf_dir), ["track_id"])

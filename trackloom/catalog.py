"""Registered queries over the generic tables, each with SQL for the same rows.

Doubles are rounded to six digits on both sides; queries without SQL are
iterative or use fitted models and are held against invariants in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions.columns import at_most_is_contact, below_is_contact, dead_flag
from trackloom.operators import classify, composition, death, embed, features, filters, ids, joins, kmeans, normalize, qc, series, similarity, smooth, spatial
from trackloom.plans import organoid, tcell
from trackloom.plans import surrogates as s
from trackloom.sources.measurements import with_stats_folders
from trackloom.sources.tables import session_table, written

QUERIES: dict = {}
SQL: dict = {}

WELL = s.WELL
#: Processed cells: flags and runs on the gap-filled series, with SQL of the same steps.
_STEP = tcell.Settings(duration=s.TCELL_DURATION, min_length=s.TCELL_MIN, max_length=s.TCELL_MAX)
_KEYS = ["organoid_line", "tcell_line", "exp_nr", "well"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = "WITH " + sql.strip()
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _r(*columns: str) -> str:
    return ", ".join(f"round({c.rsplit(' AS ', 1)[0]}, 6) + 0.0 AS {c.rsplit(' AS ', 1)[-1]}" for c in columns)


# ---- organoids -----------------------------------------------------------------------------------


@query(s.ORGANOIDS + f"SELECT track_id, time, {WELL}, {_r('volume', 'dead_dye_sum', 'area', 'dead_dye_mean', 'time2')} FROM organoids")
def fragment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of an organoid merged, with the volume-weighted mean dye."""
    return rounded(s.organoids(spark, sf_dir))


LONG = s.ORGANOIDS + f", long AS (SELECT * EXCLUDE (rows_) FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS rows_ FROM organoids) WHERE rows_ > {s.ORGANOID_MIN})"
CURVE = LONG + f", curve AS (SELECT time, time2, {WELL}, sum(volume) AS volume, sum(dead_dye_sum) AS dead_dye_sum, sum(dead_dye_sum) / nullif(sum(volume), 0) AS dead_dye_mean FROM long GROUP BY ALL)"
_CURVE_COLUMNS = f"time, {WELL}, " + _r("time2", "volume", "dead_dye_sum", "dead_dye_mean")


@query(CURVE + f"SELECT {_CURVE_COLUMNS} FROM curve")
def well_death_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: death curve of each well."""
    return rounded(death.well_curve(s.organoids(spark, sf_dir), s.ORGANOID_MIN))


@query(CURVE + f"SELECT {_CURVE_COLUMNS} FROM curve WHERE time <= {s.ORGANOID_DURATION}")
def well_death_curve_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: the same up to the experiment's duration, inclusive."""
    return rounded(organoid.well_curves(s.organoids(spark, sf_dir), s.ORGANOID_MIN, s.ORGANOID_DURATION)[1])


SCALED = s.ORGANOIDS + """, scaled AS (SELECT *, CASE WHEN hi = lo THEN 50.0 ELSE (dead_dye_mean - lo) / (hi - lo) * 100.0 END AS dead_dye_mean_rescaled FROM organoids, (SELECT min(dead_dye_mean) AS lo, max(dead_dye_mean) AS hi FROM organoids)),
scaled_long AS (SELECT * EXCLUDE (rows_) FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS rows_ FROM scaled) WHERE rows_ > %d),
with_max AS (SELECT *, max(dead_dye_mean) OVER k AS max_dead_dye_mean, max(dead_dye_mean_rescaled) OVER k AS max_dead_dye_mean_rescaled, min(time) OVER (PARTITION BY track_id) AS t0 FROM scaled_long WINDOW k AS (PARTITION BY track_id, %s)),
alive AS (SELECT * FROM with_max WHERE track_id IN (SELECT track_id FROM with_max WHERE time = t0 AND dead_dye_mean < %r AND volume > %r)),
peaks AS (SELECT track_id, min(time) AS peak FROM alive JOIN (SELECT track_id, max(dead_dye_mean) AS top FROM alive GROUP BY 1) USING (track_id) WHERE dead_dye_mean = top GROUP BY 1),
individual AS (SELECT alive.* REPLACE (CASE WHEN time > peak THEN max_dead_dye_mean_rescaled ELSE dead_dye_mean_rescaled END AS dead_dye_mean_rescaled) FROM alive JOIN peaks USING (track_id))
""" % (s.ORGANOID_MIN, WELL, s.ORGANOID_DYE, s.ORGANOID_VOLUME)
_INDIVIDUAL = f"SELECT track_id, time, {WELL}, " + _r("dead_dye_mean", "dead_dye_mean_rescaled", "max_dead_dye_mean", "max_dead_dye_mean_rescaled", "volume") + " FROM individual"


def _individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return organoid.individual_curves(s.organoids(spark, sf_dir), F.lit(s.ORGANOID_DYE), s.ORGANOID_MIN, s.ORGANOID_VOLUME)


def _individual_columns(df: DataFrame) -> DataFrame:
    return rounded(df.select("track_id", "time", *death.WELL_KEY, "dead_dye_mean", "dead_dye_mean_rescaled", "max_dead_dye_mean", "max_dead_dye_mean_rescaled", "volume"))


@query(SCALED + _INDIVIDUAL)
def individual_death_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organoids that start alive, with the plateau after their maximum."""
    return _individual_columns(_individual(spark, sf_dir))


@query(SCALED + _INDIVIDUAL + f" WHERE time <= {s.ORGANOID_DURATION}")
def individual_death_curve_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q10, P10: the same up to the experiment's duration."""
    return _individual_columns(filters.until(_individual(spark, sf_dir), s.ORGANOID_DURATION))


@query(SCALED + f"SELECT track_id, {WELL}, " + _r("max(dead_dye_mean) AS max_dead_dye_mean", "max(dead_dye_mean_rescaled) AS max_dead_dye_mean_rescaled") + " FROM scaled_long GROUP BY ALL")
def track_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest raw and rescaled dye of each organoid."""
    scaled = normalize.rescaled(s.organoids(spark, sf_dir), {"dead_dye_mean": "dead_dye_mean_rescaled"}, (0.0, 100.0))
    return rounded(death.track_maxima(filters.tracks_of_length(scaled, s.ORGANOID_MIN, strict=True), ["dead_dye_mean", "dead_dye_mean_rescaled"]))


@query(SCALED + "SELECT DISTINCT track_id FROM alive")
def alive_at_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organoids that are alive and large at their first time."""
    long = filters.tracks_of_length(s.organoids(spark, sf_dir), s.ORGANOID_MIN, strict=True)
    return filters.alive_and_large_at_start(long, F.lit(s.ORGANOID_DYE), s.ORGANOID_VOLUME).select("track_id").distinct()


@query(SCALED + f"SELECT track_id, max_dead_dye_mean > {s.ORGANOID_DYE} AS ever_dead, count(*) AS n_rows FROM individual GROUP BY ALL")
def ever_dead_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks above and not above the threshold at their maximum."""
    dead, live = filters.ever_dead(_individual(spark, sf_dir), F.lit(s.ORGANOID_DYE))
    both = dead.withColumn("ever_dead", F.lit(True)).unionByName(live.withColumn("ever_dead", F.lit(False)))
    return both.groupBy("track_id", "ever_dead").agg(F.count(F.lit(1)).alias("n_rows"))


AUC = CURVE + f""", res AS (SELECT *, CASE WHEN hi = lo THEN 50.0 ELSE (dead_dye_mean - lo) / (hi - lo) * 100.0 END AS v FROM (SELECT *, min(dead_dye_mean) OVER (PARTITION BY exp_nr) AS lo, max(dead_dye_mean) OVER (PARTITION BY exp_nr) AS hi FROM curve)),
norm AS (SELECT *, v - first_value(v) OVER (PARTITION BY {WELL} ORDER BY time2) AS y FROM res),
strips AS (SELECT *, (time2 - lag(time2) OVER w) * (y + lag(y) OVER w) / 2 AS strip FROM norm WHERE time < {s.ORGANOID_DURATION} WINDOW w AS (PARTITION BY {WELL} ORDER BY time2))
"""


@query(AUC + f"SELECT {WELL}, " + _r("coalesce(sum(strip), 0.0) AS auc", "arg_max(y, time2) - arg_min(y, time2) AS delta") + " FROM strips GROUP BY ALL")
def auc_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q11: area under the curve and increase per well."""
    return rounded(organoid.auc_table(death.well_curve(s.organoids(spark, sf_dir), s.ORGANOID_MIN), s.ORGANOID_DURATION))


GRID = SCALED + f""", flagged AS (SELECT *, CASE WHEN dead_dye_mean < {s.ORGANOID_DYE} THEN 0 WHEN dead_dye_mean IS NOT NULL THEN 1 END AS dead FROM individual),
grid AS (SELECT * FROM (SELECT DISTINCT {WELL}, time FROM flagged) JOIN (SELECT DISTINCT {WELL}, track_id FROM flagged) USING ({WELL})),
completed AS (SELECT grid.*, flagged.dead FROM grid LEFT JOIN flagged USING ({WELL}, time, track_id)),
fill_w AS (SELECT * REPLACE (last_value(dead IGNORE NULLS) OVER (PARTITION BY {WELL} ORDER BY time, track_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dead) FROM completed),
fill_t AS (SELECT * REPLACE (last_value(dead IGNORE NULLS) OVER (PARTITION BY {WELL}, track_id ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dead) FROM completed),
stick_w AS (SELECT * REPLACE (max(dead) OVER (PARTITION BY {WELL}, track_id ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dead) FROM fill_w),
stick_t AS (SELECT * REPLACE (max(dead) OVER (PARTITION BY {WELL}, track_id ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dead) FROM fill_t)
"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = _individual(spark, sf_dir).withColumn("dead", dead_flag("dead_dye_mean", F.lit(s.ORGANOID_DYE)))
    return joins.complete_grid(flagged.select(*death.WELL_KEY, "time", "track_id", "dead"), death.WELL_KEY, "time", "track_id")


@query(GRID + f"SELECT {WELL}, time, track_id, dead FROM completed")
def grid_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every time of a well for every organoid of it."""
    return _grid(spark, sf_dir)


@query(GRID + f"SELECT {WELL}, time, track_id, dead FROM fill_w")
def fill_well(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward fill in order of time and id inside the well."""
    return series.carry_forward(_grid(spark, sf_dir), ["dead"], death.WELL_KEY, ["time", "track_id"])


@query(GRID + f"SELECT {WELL}, time, track_id, dead FROM fill_t")
def fill_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward fill inside the organoid."""
    return series.fill_forward(_grid(spark, sf_dir), ["dead"], [*death.WELL_KEY, "track_id"], ["time"])


@query(GRID + f"SELECT {WELL}, time, track_id, dead FROM stick_w")
def sticky_death(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Once dead, dead for the rest."""
    return series.sticky(fill_well(spark, sf_dir), "dead", [*death.WELL_KEY, "track_id"])


def _percent_sql(source: str, where: str = "") -> str:
    return GRID + f""", counts AS (SELECT time, {WELL}, count(*) FILTER (dead = 1) AS n, count(*) AS rows_ FROM {source} GROUP BY ALL),
started AS (SELECT *, max(CASE WHEN time = 1 THEN rows_ END) OVER (PARTITION BY {WELL}) AS starting_nr_organoids FROM counts),
shares AS (SELECT *, n * 100 / nullif(starting_nr_organoids, 0) AS perc FROM started)
SELECT time, {WELL}, n, starting_nr_organoids, {_r('perc')}, {_r('perc_dead_norm')} FROM (SELECT *, perc - first_value(perc) OVER (PARTITION BY {WELL} ORDER BY time) AS perc_dead_norm FROM shares){where}"""


@query(_percent_sql("stick_w"))
def pct_dead_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12: percentage of dead organoids over time."""
    return rounded(death.percentage_dead(_individual(spark, sf_dir), F.lit(s.ORGANOID_DYE)))


@query(_percent_sql("stick_t"))
def pct_dead_curve_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12 with each organoid's own values carried forward."""
    return rounded(death.percentage_dead(_individual(spark, sf_dir), F.lit(s.ORGANOID_DYE), fill_scope="track"))


@query(_percent_sql("stick_w", f" WHERE time <= {s.ORGANOID_DURATION}"))
def pct_dead_curve_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12 up to the experiment's duration."""
    return pct_dead_curve(spark, sf_dir).filter(F.col("time") <= s.ORGANOID_DURATION)


LOESS = CURVE + f""", ends AS (SELECT *, greatest(time - min(time) OVER (PARTITION BY {WELL}), max(time) OVER (PARTITION BY {WELL}) - time) AS reach FROM curve),
pairs AS (SELECT e.*, c.time - e.time AS d, c.dead_dye_mean AS y, coalesce((1 - abs((c.time - e.time) / nullif(CAST(e.reach AS DOUBLE), 0)) ** 3) ** 3, 1.0) AS w FROM ends e JOIN curve c USING ({WELL})),
sums AS (SELECT {WELL}, time, {', '.join(f'sum(w * d ** {i}) AS s{i}' for i in range(5))}, {', '.join(f'sum(w * d ** {i} * y) AS t{i}' for i in range(3))} FROM (SELECT * REPLACE (CAST(d AS DOUBLE) AS d) FROM pairs) GROUP BY ALL)
SELECT {WELL}, time, {_r('(t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / nullif(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2), 0) AS smooth')} FROM sums"""


@query(LOESS)
def loess_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local quadratic regression of the well curves."""
    return rounded(smooth.local_quadratic(death.well_curve(s.organoids(spark, sf_dir), s.ORGANOID_MIN), "time", "dead_dye_mean", death.WELL_KEY))


# ---- ids, joins, funnel --------------------------------------------------------------------------

RAW = s.CELLS + ", raw AS (SELECT *, 'E' || exp_nr AS basename, 'folder' || exp_nr || '/E' || exp_nr || '_Statistics' AS stat_folder, CASE WHEN number % 50 = 7 THEN NULL ELSE track_id END AS raw_id FROM cells)"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("exp_nr").cast("string")
    c = s.cells(spark, sf_dir).withColumns({"basename": F.concat(F.lit("E"), e), "stat_folder": F.concat(F.lit("folder"), e, F.lit("/E"), e, F.lit("_Statistics"))})
    return c.withColumn("raw_id", F.when(F.col("number") % 50 == 7, None).otherwise(F.col("track_id")))


@query(RAW + ", ranks AS (SELECT name, row_number() OVER (ORDER BY name) AS k FROM (SELECT DISTINCT basename || stat_folder AS name FROM raw)) SELECT k || '_' || coalesce(raw_id, 'NA') AS track_id, raw_id AS original_track_id, time, basename FROM raw JOIN ranks ON name = basename || stat_folder")
def unique_track_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that are unique across experiments."""
    raw = _raw(spark, sf_dir).drop("track_id").withColumnRenamed("raw_id", "track_id")
    return ids.unique_track_ids(raw, ["basename", "stat_folder"]).select("track_id", "original_track_id", "time", "basename")


@query(RAW + "SELECT coalesce(raw_id, 'NA') AS track_id, time, count(*) AS n_rows FROM raw GROUP BY ALL HAVING count(*) > 1")
def duplicate_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: keys that would stop the run, here untracked cells that share a name."""
    return ids.duplicate_keys(_raw(spark, sf_dir).select(F.coalesce("raw_id", F.lit("NA")).alias("track_id"), "time"), ["track_id", "time"])


@query(s.CELLS + "SELECT track_id, min(time) AS time, arg_min(organoid_line, time) AS organoid_line FROM cells GROUP BY 1")
def first_row_per_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2, O3: the first row of each track."""
    return ids.first_rows(s.cells(spark, sf_dir), ["track_id"], ["time"]).select("track_id", "time", "organoid_line")


_STATS = [("speed", 0), ("displacement", 1), ("red_lym", 2)]


@query(RAW + ", " + ", ".join(f"t{i} AS (SELECT stat_folder, basename, time, raw_id, number, {c} FROM raw)" for c, i in _STATS)
       + " SELECT stat_folder, t0.basename, t0.time, t0.raw_id, t0.number, " + _r("speed", "displacement", "red_lym") + " FROM t0 "
       + " ".join(f"JOIN (SELECT stat_folder AS f{i}, time AS m{i}, raw_id AS r{i}, number AS n{i}, {c} FROM t{i}) ON f{i} = stat_folder AND m{i} = time AND r{i} IS NOT DISTINCT FROM raw_id AND n{i} = number" for c, i in _STATS[1:]))
def natural_join_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the same observation joined, null ids included."""
    raw = _raw(spark, sf_dir)
    keys = ["stat_folder", "basename", "time", "raw_id", "number"]
    return rounded(joins.natural_join([raw.select(*keys, c) for c, _ in _STATS], keys))


_META = [("E0", "folder0/E0_Statistics", 6.0), ("E1", None, 5.0), ("E2", "folder2/E2_Statistics", 4.0), ("E9", None, 3.0)]


@query("meta AS (SELECT * FROM (VALUES " + ", ".join(f"('{b}', {('NULL' if f is None else repr(f))}, CAST({t} AS DOUBLE))" for b, f, t in _META) + ") m(basename, tcell_stats_folder, organoid_contact_threshold)), "
       "filled AS (SELECT basename, CASE WHEN (SELECT max(CASE WHEN tcell_stats_folder IS NULL THEN 1 ELSE 0 END) FROM meta) = 1 THEN 'data/' || basename || '_Statistics' ELSE tcell_stats_folder END AS tcell_stats_folder, organoid_contact_threshold FROM meta), "
       + RAW + " SELECT filled.*, time, number, " + _r("speed") + " FROM filled LEFT JOIN (SELECT basename, time, number, speed FROM raw) USING (basename)")
def metadata_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata with default folders and its observations; an experiment without any stays."""
    meta = with_stats_folders(spark.createDataFrame(_META, "basename string, tcell_stats_folder string, organoid_contact_threshold double"), "data/", "tcell_stats_folder")
    return rounded(joins.with_observations(meta, _raw(spark, sf_dir).select("basename", "time", "number", "speed"), ["basename"]))


# ---- processed cells -----------------------------------------------------------------------------

NEAR = s.CELLS + f""", cut AS (SELECT a.*, 'C' || exp_nr AS experiment, CAST(number % 5 = time % 5 AS INTEGER) AS contact_lym FROM cells a WHERE time <= {s.TCELL_DURATION})"""


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with a stand-in for the contact between cells and with thresholds of their own."""
    c = s.cells(spark, sf_dir).withColumn("contact_lym", (F.col("number") % 5 == F.col("time") % 5).cast("int"))
    return c.withColumns({"organoid_contact_threshold": F.lit(s.ORGANOID_DISTANCE), "tcell_dead_dye_threshold": F.lit(s.CELL_DYE)})


_M = tcell.MEASURES
GAPS = NEAR + f""", spans AS (SELECT track_id, min(time) AS lo, max(time) AS hi FROM cut GROUP BY 1),
spine AS (SELECT track_id, t AS time FROM spans JOIN (SELECT DISTINCT time AS t FROM cut) ON t BETWEEN lo AND hi),
sides AS (SELECT spine.track_id, spine.time, {', '.join(_M)}, cut.time AS seen FROM spine LEFT JOIN cut ON cut.track_id = spine.track_id AND cut.time = spine.time),
ends AS (SELECT *, last_value(seen IGNORE NULLS) OVER b AS t0, first_value(seen IGNORE NULLS) OVER a AS t1, {', '.join(f'last_value({c} IGNORE NULLS) OVER b AS {c}0, first_value({c} IGNORE NULLS) OVER a AS {c}1' for c in _M)} FROM sides
  WINDOW b AS (PARTITION BY track_id ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY track_id ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT track_id, time, {', '.join(f'CASE WHEN seen IS NOT NULL THEN CAST({c} AS DOUBLE) ELSE {c}0 + ({c}1 - {c}0) * (time - t0) / (t1 - t0) END AS {c}' for c in _M)} FROM ends)
"""


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.until(_observed(spark, sf_dir), s.TCELL_DURATION)


@query(GAPS + f"SELECT track_id, time, {_r(*_M)} FROM filled")
def gap_fill_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner gaps interpolated."""
    return rounded(series.gap_fill(_cut(spark, sf_dir), _M))


ROLLED = GAPS + ", rolled AS (SELECT *, CASE WHEN count(speed) OVER w = 10 THEN avg(speed) OVER w END AS meanspeed FROM filled WINDOW w AS (PARTITION BY track_id ORDER BY time ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"
BACK = ROLLED + ", back AS (SELECT * REPLACE (first_value(meanspeed IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS meanspeed) FROM rolled)"


@query(ROLLED + f"SELECT track_id, time, {_r('meanspeed')} FROM rolled")
def rolling_mean_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean speed over the last ten rows."""
    return rounded(series.rolling_mean(series.gap_fill(_cut(spark, sf_dir), _M), "speed", 10, "meanspeed").select("track_id", "time", "meanspeed"))


@query(BACK + f"SELECT track_id, time, {_r('meanspeed')} FROM back")
def carry_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next known mean speed carried backward."""
    rolled = series.rolling_mean(series.gap_fill(_cut(spark, sf_dir), _M), "speed", 10, "meanspeed")
    return rounded(series.carry_backward(rolled, "meanspeed").select("track_id", "time", "meanspeed"))


@query(s.CELLS + "SELECT track_id, time, time - min(time) OVER (PARTITION BY track_id) AS time2 FROM cells")
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time since the first row of the track."""
    return series.relative_time(s.cells(spark, sf_dir)).select("track_id", "time", "time2")


@query(s.CELLS + f"SELECT track_id, time FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM cells WHERE time > 0 AND time < {s.TCELL_DURATION}) WHERE n >= {s.TCELL_MIN}")
def min_length_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open time window, then tracks of a minimum length."""
    return filters.tracks_of_length(filters.between(s.cells(spark, sf_dir), 0, s.TCELL_DURATION), s.TCELL_MIN).select("track_id", "time")


@query(s.CELLS + f"SELECT track_id, time FROM (SELECT *, time - min(time) OVER (PARTITION BY track_id) AS time2 FROM cells) WHERE time2 < {s.TCELL_MAX}")
def truncate_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part of each track."""
    return filters.truncated(series.relative_time(s.cells(spark, sf_dir)), s.TCELL_MAX).select("track_id", "time")


@query(s.CELLS + f", r AS (SELECT *, time - min(time) OVER (PARTITION BY track_id) AS time2 FROM cells) SELECT track_id, time FROM r WHERE track_id IN (SELECT track_id FROM r WHERE time2 = 0 AND red_lym < {s.CELL_DYE})")
def alive_first_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks that are alive at their first point."""
    return filters.alive_at_start(series.relative_time(s.cells(spark, sf_dir)), F.lit(s.CELL_DYE)).select("track_id", "time")


@query(s.CELLS + f"SELECT track_id, time, CASE WHEN dist_org > {s.ORGANOID_DISTANCE} THEN 0 ELSE 1 END AS contact, CASE WHEN dist_org < {s.ORGANOID_DISTANCE} THEN 1 ELSE 0 END AS below, CASE WHEN red_lym < {s.CELL_DYE} THEN 0 ELSE 1 END AS death FROM cells")
def contact_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact and death flags with their bounds."""
    far, dye = F.lit(s.ORGANOID_DISTANCE), F.lit(s.CELL_DYE)
    return s.cells(spark, sf_dir).select("track_id", "time", at_most_is_contact("dist_org", far).alias("contact"), below_is_contact("dist_org", far).alias("below"), dead_flag("red_lym", dye).alias("death"))


RUNS = s.CELLS + f""", flags AS (SELECT track_id, time, CASE WHEN dist_org > {s.ORGANOID_DISTANCE} THEN 0 ELSE 1 END AS contact FROM cells),
runs AS (SELECT *, sum(1 - contact) OVER (PARTITION BY track_id ORDER BY time) AS run FROM flags)"""


@query(RUNS + " SELECT track_id, time, contact, CAST(sum(contact) OVER (PARTITION BY track_id, run ORDER BY time) AS BIGINT) AS contact2 FROM runs")
def contact_run_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running count of consecutive contacts."""
    flags = s.cells(spark, sf_dir).select("track_id", "time", at_most_is_contact("dist_org", F.lit(s.ORGANOID_DISTANCE)).alias("contact"))
    return series.run_length(flags, "contact", "contact2")


PROCESSED = BACK + f""", meta AS (SELECT track_id, arg_min(organoid_line, time) AS organoid_line, arg_min(tcell_line, time) AS tcell_line, arg_min(exp_nr, time) AS exp_nr, arg_min(well, time) AS well FROM cut GROUP BY 1),
corrected AS (SELECT back.*, organoid_line, tcell_line, exp_nr, well, CASE WHEN dist_org > {s.ORGANOID_DISTANCE} THEN 0 ELSE 1 END AS contact FROM back JOIN meta USING (track_id) WHERE meanspeed IS NOT NULL),
longer AS (SELECT * EXCLUDE (n_) FROM (SELECT *, count(*) OVER (PARTITION BY track_id) AS n_ FROM corrected WHERE time > 0 AND time < {s.TCELL_DURATION}) WHERE n_ >= {s.TCELL_MIN}),
equal AS (SELECT * FROM (SELECT *, time - min(time) OVER (PARTITION BY track_id) AS time2 FROM longer) WHERE time2 < {s.TCELL_MAX}),
living AS (SELECT * FROM equal WHERE track_id IN (SELECT track_id FROM equal WHERE time2 = 0 AND red_lym < {s.CELL_DYE})),
counted AS (SELECT * EXCLUDE (run), sum(contact) OVER (PARTITION BY track_id, run ORDER BY time) AS contact2 FROM (SELECT *, CASE WHEN red_lym < {s.CELL_DYE} THEN 0 ELSE 1 END AS death, sum(1 - contact) OVER (PARTITION BY track_id ORDER BY time) AS run FROM living)),
quart AS (SELECT exp_nr, quantile_cont(meanspeed, 0.75) AS q FROM counted GROUP BY 1),
processed AS (SELECT counted.* REPLACE (CAST(contact2 AS BIGINT) AS contact2, CASE WHEN meanspeed < q OR contact = 1 THEN 0.0 ELSE contact_lym END AS contact_lym) FROM counted JOIN quart USING (exp_nr))
"""
_CARRIED = [*_KEYS, "organoid_contact_threshold", "tcell_dead_dye_threshold"]
_PROCESSED_COLUMNS = ["track_id", "time", "time2", *_KEYS, "contact", "death", "contact2", *_M, "meanspeed"]


def _processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived once in a session, as the queries of whole branches read it for the layout, the features and the rows that get classes."""

    def build() -> DataFrame:
        return normalize.active_contact(written(tcell.flagged_tracks(_observed(spark, sf_dir), _STEP, _CARRIED), "flagged-tracks"))  # read three times

    return session_table(spark, "processed-rows", sf_dir, build)


@query(PROCESSED + f"SELECT track_id, time, time2, {', '.join(_KEYS)}, contact, death, contact2, {_r(*_M, 'meanspeed')} FROM processed")
def processed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: the processed table of cell tracks."""
    return rounded(_processed(spark, sf_dir).select(*_PROCESSED_COLUMNS))


@query(PROCESSED + f"SELECT track_id, time, {_r('contact_lym')} FROM processed")
def active_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contact between cells, only while active in the environment."""
    return rounded(_processed(spark, sf_dir).select("track_id", "time", "contact_lym"))


_STAGES = {"unfiltered": "cells", "filt_exp_duration": "cut", "filt_minlength": "longer", "filt_deadcellstart": "living"}
FUNNEL = PROCESSED + ", funnel AS (SELECT * FROM " + " LEFT JOIN ".join(f"(SELECT {', '.join(_KEYS)}, count(DISTINCT track_id) AS {n} FROM {t} GROUP BY ALL)" + (f" USING ({', '.join(_KEYS)})" if i else "") for i, (n, t) in enumerate(_STAGES.items())) + ") "


@query(FUNNEL + "SELECT * FROM funnel")
def track_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks after each filter stage."""
    return tcell.track_funnel(_observed(spark, sf_dir), _STEP, _CARRIED)


@query(FUNNEL + f"SELECT {', '.join(_KEYS)}, stage, nr_tracks FROM funnel UNPIVOT INCLUDE NULLS (nr_tracks FOR stage IN ({', '.join(_STAGES)}))")
def track_funnel_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel unpivoted."""
    return qc.funnel_long(track_funnel(spark, sf_dir), list(_STAGES))


# ---- space ---------------------------------------------------------------------------------------

_BRUTE = "SELECT a.track_id, a.well, {} FROM points a LEFT JOIN points b ON a.well = b.well AND a.track_id <> b.track_id GROUP BY ALL"
_DISTANCE = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query(s.POINTS + _BRUTE.format(_r(f"coalesce(min({_DISTANCE}), CAST('inf' AS DOUBLE)) AS nearest")))
def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance to the nearest other point of the group."""
    return rounded(spatial.nearest_neighbour(s.points(spark, sf_dir), ["well"]))


@query(s.POINTS + _BRUTE.format(f"max(CASE WHEN {_DISTANCE} < {s.CELL_DISTANCE} * (0.2 + a.vec_id % 3 / 5) THEN 1 ELSE 0 END) AS contact"))
def neighbour_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether another point is nearer than the point's own threshold."""
    own = s.points(spark, sf_dir).withColumn("threshold", F.lit(s.CELL_DISTANCE) * (F.lit(0.2) + F.col("vec_id") % 3 / F.lit(5.0)))
    return spatial.within_distance(own, ["well"], "threshold", s.CELL_DISTANCE).select("track_id", "well", "contact")


# ---- normalisation, features, shares -------------------------------------------------------------


def _normal_sql(upper: float, p: float) -> str:
    cols = {"displacement": "q_disp", "speed": "q_speed", "red_lym": "q_red"}
    stats = ", ".join(f"avg({c}) AS m_{n}, stddev_samp({c}) AS d_{n}, min({c}) AS lo_{n}, max({c}) AS hi_{n}, quantile_cont({c}, 0.75) AS q75_{n}" for c, n in cols.items())
    z = ", ".join(f"(lo_{n} - m_{n}) / nullif(d_{n}, 0) AS z0_{n}, CASE WHEN hi_{n} > q75_{n} THEN (hi_{n} - m_{n}) / nullif(d_{n}, 0) ELSE (lo_{n} - m_{n}) / nullif(d_{n}, 0) END AS z1_{n}, CASE WHEN {c} > q75_{n} THEN ({c} - m_{n}) / nullif(d_{n}, 0) ELSE (lo_{n} - m_{n}) / nullif(d_{n}, 0) END AS z_{n}" for c, n in cols.items())
    scaled = ", ".join(f"CASE WHEN z1_{n} = z0_{n} THEN {upper / 2} ELSE (z_{n} - z0_{n}) / (z1_{n} - z0_{n}) * {upper} END AS u_{n}" for n in cols.values())
    top = ", ".join(f"quantile_cont(u_{n}, {p}) AS top_{n}" for n in cols.values())
    contact = ", ".join(f"CASE WHEN max({c}) OVER e = min({c}) OVER e THEN 0.5 ELSE ({c} - min({c}) OVER e) / (max({c}) OVER e - min({c}) OVER e) END AS s_{c}" for c in ("contact", "contact_lym"))
    return PROCESSED + f""", st AS (SELECT exp_nr, {stats} FROM processed GROUP BY 1), zz AS (SELECT processed.*, {z} FROM processed JOIN st USING (exp_nr)), uu AS (SELECT *, {scaled} FROM zz), tt AS (SELECT exp_nr, {top} FROM uu GROUP BY 1),
normal AS (SELECT track_id, time, {', '.join(_KEYS)}, contact, contact2, speed, displacement, red_lym, contact_lym, {', '.join(f'u_{n} / nullif(top_{n}, 0) AS {n}' for n in cols.values())}, {contact} FROM uu JOIN tt USING (exp_nr) WINDOW e AS (PARTITION BY exp_nr)) """


_NORMAL_COLUMNS = ["q_disp", "q_speed", "q_red", "s_contact", "s_contact_lym"]


def _normal(spark: SparkSession, sf_dir: str, settings) -> DataFrame:
    return normalize.normalized(_processed(spark, sf_dir), settings)


@query(_normal_sql(*normalize.MODEL) + f"SELECT track_id, time, exp_nr, {_r(*_NORMAL_COLUMNS)} FROM normal")
def normalize_exp_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalisation as for a trained model."""
    return rounded(_normal(spark, sf_dir, normalize.MODEL).select("track_id", "time", "exp_nr", *_NORMAL_COLUMNS))


@query(_normal_sql(*normalize.CLUSTER) + f"SELECT track_id, time, exp_nr, {_r(*_NORMAL_COLUMNS)} FROM normal")
def normalize_exp_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalisation as for clustering."""
    return rounded(_normal(spark, sf_dir, normalize.CLUSTER).select("track_id", "time", "exp_nr", *_NORMAL_COLUMNS))


@query(_normal_sql(*normalize.SMALL_SAMPLE) + f"SELECT track_id, time, exp_nr, {_r(*_NORMAL_COLUMNS)} FROM normal")
def normalize_exp_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalisation as for small samples."""
    return rounded(_normal(spark, sf_dir, normalize.SMALL_SAMPLE).select("track_id", "time", "exp_nr", *_NORMAL_COLUMNS))


FEATURE_SQL = {
    **{f"mean_{n}": f"avg({c})" for n, c in (("speed", "q_speed"), ("displacement", "q_disp"), ("red_lym", "q_red"))},
    **{f"median_{n}": f"median({c})" for n, c in (("speed", "q_speed"), ("displacement", "q_disp"))},
    **{f"{n}_sd": f"stddev_samp({c})" for n, c in (("speed", "q_speed"), ("displacement", "q_disp"), ("red_lym", "q_red"))},
    **{f"q3_{n}": f"quantile_cont({c}, 0.9)" for n, c in (("speed", "q_speed"), ("disp", "q_disp"), ("red", "q_red"))},
    "contact": "avg(s_contact)", "mean_contact2": "avg(contact2)",
}


@query(_normal_sql(*normalize.MODEL) + f"SELECT track_id, {_r(*[f'{v} AS {k}' for k, v in FEATURE_SQL.items()])}, max(contact2) AS contact2 FROM normal GROUP BY 1")
def track_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen features per track."""
    return rounded(features.track_features(_normal(spark, sf_dir, normalize.MODEL)))


CLASSED = PROCESSED + f", classed AS (SELECT DISTINCT track_id, {', '.join(_KEYS)}, CAST(track_id AS BIGINT) % 6 + 1 AS cluster2 FROM processed) "


def _shares_sql(keys: list[str]) -> str:
    k = ", ".join(keys)
    return CLASSED + f", counts AS (SELECT {k}, cluster2, count(*) AS num_cluster FROM classed GROUP BY ALL), shares AS (SELECT *, CAST(sum(num_cluster) OVER (PARTITION BY {k}) AS BIGINT) AS total_cell FROM counts) "


def _classed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for each track; written, as shares and lists read it several times and the whole chain is behind it."""
    return written(_processed(spark, sf_dir).select("track_id", *_KEYS).distinct().withColumn("cluster2", F.col("track_id").cast("bigint") % 6 + 1), "classed")


@query(_shares_sql(_KEYS) + f"SELECT *, {_r('num_cluster * 100 / total_cell AS percentage')} FROM shares")
def class_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each class per well."""
    return rounded(composition.class_shares(_classed(spark, sf_dir), group=_KEYS))


@query(_shares_sql(_KEYS[:3]) + f"SELECT *, {_r('num_cluster * 100 / total_cell AS percentage')} FROM shares")
def class_share_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with all wells of an experiment together."""
    return rounded(composition.class_shares(_classed(spark, sf_dir), group=_KEYS[:3]))


@query(_shares_sql(_KEYS) + f", labels AS (SELECT DISTINCT cluster2 FROM shares), wells AS (SELECT DISTINCT {', '.join(_KEYS)}, total_cell FROM shares) SELECT wells.*, labels.cluster2, coalesce(num_cluster, 0) AS num_cluster, {_r('coalesce(num_cluster, 0) * 100 / wells.total_cell AS percentage')} FROM wells CROSS JOIN labels LEFT JOIN (SELECT {', '.join(_KEYS)}, cluster2, num_cluster FROM shares) USING ({', '.join(_KEYS)}, cluster2)")
def class_share_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares with zeros for classes that a well lacks."""
    return rounded(joins.zero_fill(composition.class_shares(_classed(spark, sf_dir), group=_KEYS), "cluster2", _KEYS, "total_cell", ["num_cluster", "percentage"]))


PROFILE = PROCESSED + f", prof AS (SELECT CAST(track_id AS BIGINT) % 6 + 1 AS cluster2, CAST(avg(contact2) AS DOUBLE) AS contact_len, CAST(avg(contact) AS DOUBLE) AS n_contact_org, median(displacement) AS displacement2, median(speed) AS speed, avg(contact_lym) AS interaction_t_cells, median(red_lym) AS death FROM processed GROUP BY 1), sc AS (SELECT cluster2, {', '.join(f'CASE WHEN max({n}) OVER () = min({n}) OVER () THEN 50.0 ELSE ({n} - min({n}) OVER ()) / (max({n}) OVER () - min({n}) OVER ()) * 100.0 END AS {n}' for n in composition.PROFILE)} FROM prof) "


@query(PROFILE + f"SELECT cluster2, variable, {_r('value')} FROM sc UNPIVOT (value FOR variable IN ({', '.join(composition.PROFILE)}))")
def cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative behaviour of each class."""
    rows = _processed(spark, sf_dir).withColumn("cluster2", F.col("track_id").cast("bigint") % 6 + 1)
    return rounded(composition.class_profile(rows))


@query(CLASSED + ", lists AS (SELECT 'E' || exp_nr AS basename, cluster2, string_agg(track_id, ',' ORDER BY track_id) AS ids FROM classed GROUP BY ALL), grid AS (SELECT * FROM (SELECT DISTINCT 'E' || exp_nr AS basename FROM classed), (SELECT DISTINCT cluster2 FROM classed)) SELECT basename, cluster2, coalesce(ids, '') AS ids FROM grid LEFT JOIN lists USING (basename, cluster2)")
def backprojection_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each class per experiment, empty classes included."""
    tracks = _classed(spark, sf_dir)
    originals = tracks.select(F.concat(F.lit("E"), F.col("exp_nr").cast("string")).alias("basename"), "track_id", F.col("track_id").alias("original_track_id"))
    lists = composition.ids_per_class(tracks, originals, "basename")
    return lists.select("basename", "cluster2", F.array_join("ids", ",").alias("ids"))


@query(RUNS + " SELECT exp_nr, organoid_line, well, floor(c / 1.0) * 1.0 AS bin, count(*) AS n FROM (SELECT track_id, time, contact AS c FROM flags) JOIN cells USING (track_id, time) GROUP BY ALL")
def contact_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with and without contact."""
    rows = s.cells(spark, sf_dir).withColumn("contact", at_most_is_contact("dist_org", F.lit(s.ORGANOID_DISTANCE)))
    return rounded(qc.histogram(rows, "contact", 1.0, ["exp_nr", "organoid_line", "well"]))


@query(s.CELLS + "SELECT organoid_line, exp_nr, well, count(red_lym) AS n, " + _r("min(red_lym) AS lowest", "quantile_cont(red_lym, 0.25) AS q25", "quantile_cont(red_lym, 0.5) AS q50", "quantile_cont(red_lym, 0.75) AS q75", "max(red_lym) AS highest") + " FROM cells WHERE time = 1 GROUP BY ALL")
def dye_at_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of the dye at time 1."""
    return rounded(qc.five_numbers(s.cells(spark, sf_dir).filter("time = 1"), "red_lym", ["organoid_line", "exp_nr", "well"]))


# ---- mining --------------------------------------------------------------------------------------


@query(s.CELLS + "SELECT track_id, time, CASE WHEN CAST('0x' || substr(md5(track_id || '-123'), 1, 8) AS BIGINT) % 100 < 95 THEN 'train' ELSE 'test' END AS part FROM cells")
def train_valid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks dealt into training and test by hash."""
    train, test = classify.split_tracks(s.cells(spark, sf_dir))
    return train.select("track_id", "time", F.lit("train").alias("part")).union(test.select("track_id", "time", F.lit("test")))


_DTW = _NORMAL_COLUMNS

_COST = "sqrt(" + " + ".join(f"(p[{{i}}][{c}] - y[{c}]) * (p[{{i}}][{c}] - y[{c}])" for c in range(1, len(_DTW) + 1)) + ")"
#: Row after row of the warping table of each pair; p and q are the points of its tracks, d the row so far.
WARPED = "RECURSIVE " + _normal_sql(*normalize.CLUSTER).strip() + f""",
points_ AS (SELECT track_id, list([{', '.join(_DTW)}] ORDER BY time) AS p FROM normal GROUP BY 1),
both_ AS (SELECT a.track_id AS src, b.track_id AS dst, a.p AS p, b.p AS q FROM points_ a JOIN points_ b ON a.track_id < b.track_id),
dp AS (SELECT src, dst, p, q, 1 AS i, list_reduce(list_transform(q, lambda y: [{_COST.format(i=1)}]), lambda acc, x: list_append(acc, acc[-1] + x[1])) AS d FROM both_
  UNION ALL SELECT src, dst, p, q, i + 1, list_reduce(list_concat([[d[1] + c[1]]], list_transform(range(2, len(q) + 1), lambda j: [c[j], d[j], d[j - 1]])), lambda acc, x: list_append(acc, least(x[2] + x[1], acc[-1] + x[1], x[3] + 2 * x[1])))
  FROM (SELECT *, list_transform(q, lambda y: {_COST.format(i='i + 1')}) AS c FROM dp WHERE i < len(p))),
warped AS (SELECT src, dst, d[-1] AS dist FROM dp WHERE i = len(p))"""


def _nearest_sql(k: int) -> str:
    return f""", nearest AS (SELECT * FROM (SELECT src, row_number() OVER (PARTITION BY src ORDER BY dist, src <> dst, dst) AS rank, dst, dist FROM
(SELECT * FROM warped UNION ALL SELECT dst, src, dist FROM warped UNION ALL SELECT track_id, track_id, 0.0 FROM points_ WHERE (SELECT count(*) FROM points_) > 1)) WHERE rank <= {k})"""


#: Widths by bisection, as many steps as the operator takes at most.
FUZZY = WARPED + _nearest_sql(15) + """,
lists_ AS (SELECT src, list(dist ORDER BY dist, dst) AS d, list(dst ORDER BY dist, dst) AS t FROM nearest WHERE src <> dst GROUP BY 1),
start_ AS (SELECT *, coalesce(list_min(list_filter(d, lambda x: x > 0)), 0) AS rho, log2(greatest(len(d), 2)) AS target FROM lists_),
widths AS (SELECT src, d, t, rho, target, CAST(0 AS DOUBLE) AS lo, CAST('inf' AS DOUBLE) AS hi, CAST(1 AS DOUBLE) AS sigma, 0 AS step FROM start_
  UNION ALL SELECT src, d, t, rho, target, CASE WHEN total > target THEN lo ELSE sigma END, CASE WHEN total > target THEN sigma ELSE hi END,
    CASE WHEN total > target THEN (lo + sigma) / 2 WHEN isinf(hi) THEN sigma * 2 ELSE (sigma + hi) / 2 END, step + 1
  FROM (SELECT *, list_sum(list_transform(d, lambda x: exp(-greatest(x - rho, 0) / sigma))) AS total FROM widths WHERE step < 64) WHERE abs(total - target) >= 1e-9),
settled AS (SELECT * FROM widths QUALIFY row_number() OVER (PARTITION BY src ORDER BY step DESC) = 1),
one_way AS (SELECT src, unnest(t) AS dst, unnest(list_transform(d, lambda x: exp(-greatest(x - rho, 0) / greatest(sigma, 1e-12)))) AS w FROM settled),
two_way AS (SELECT src, dst, sum(w) AS s, count(*) AS c, min(w) AS a, max(w) AS b FROM (SELECT * FROM one_way UNION ALL SELECT dst, src, w FROM one_way) GROUP BY 1, 2)"""


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.track_series(_normal(spark, sf_dir, normalize.CLUSTER), _DTW)


@query(WARPED + f" SELECT src, dst, {_r('dist')} FROM warped")
def dtw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warping distances of all pairs of tracks."""
    return similarity.dtw_pairs(_series(spark, sf_dir), len(_DTW), digits=6)


@query(WARPED + _nearest_sql(10) + f" SELECT src, CAST(rank AS INTEGER) AS rank, dst, {_r('dist')} FROM nearest")
def dtw_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest tracks by warping distance."""
    return rounded(similarity.nearest_by_bounds(_series(spark, sf_dir), len(_DTW), 10)[0])


@query(FUZZY + f" SELECT src, dst, {_r('CASE WHEN c > 1 THEN s - a * b ELSE s END AS weight')} FROM two_way")
def fuzzy_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: symmetric membership weights."""
    return rounded(embed.fuzzy_graph(similarity.nearest_by_bounds(_series(spark, sf_dir), len(_DTW), 15)[0]))


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laid out once in a session; the map, its classes and the forests refer to one layout."""

    def build() -> DataFrame:
        return embed.layout(embed.fuzzy_graph(similarity.nearest_by_bounds(_series(spark, sf_dir), len(_DTW), 15)[0]))

    return session_table(spark, "layout-of-tracks", sf_dir, build)


@query()
def umap_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: two-dimensional layout of the tracks."""
    return _layout(spark, sf_dir)


@query()
def behaviour_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6, M5: layout and clusters, made once in a session, as profiles, shares and forests refer to one map."""
    return session_table(spark, "behaviour-map", sf_dir, lambda: kmeans.best_kmeans(_layout(spark, sf_dir), 6, ["v1", "v2"]))


@query()
def kmeans_best_of_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: the best of several k-means runs."""
    vectors = s.vectors(spark, sf_dir)
    return kmeans.best_kmeans(vectors, 10, _components(vectors))


def _components(vectors: DataFrame) -> list[str]:
    return [c for c in vectors.columns if c not in ("track_id", "label")]


def _forest(spark: SparkSession, sf_dir: str, trees: int = 100):
    vectors = s.vectors(spark, sf_dir)
    train, test = classify.split_tracks(vectors)
    return classify.train_forest(train, "label", _components(vectors), trees=trees), train, test


@query()
def rf_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes predicted by a random forest."""
    model, _, _ = _forest(spark, sf_dir)
    return classify.predict(model, s.vectors(spark, sf_dir), "label").select("track_id", "label", "predicted")


@query()
def rf_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts and class errors on held-out tracks."""
    model, _, test = _forest(spark, sf_dir)
    return classify.confusion(classify.predict(model, test, "label"), "label")


@query()
def rf_error_by_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out error against the number of trees."""
    model, _, test = _forest(spark, sf_dir)
    return classify.error_by_trees(model, test, "label")


@query()
def rf_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of each feature."""
    model, train, _ = _forest(spark, sf_dir)
    return classify.importance(model, _components(train))

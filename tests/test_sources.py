"""Readers on files written by hand, table helpers, models, a stream."""

import random

import pytest
from pyspark.sql import functions as F

from trackloom.operators import classify
from trackloom.sources import measurements as m
from trackloom.sources import tables
from trackloom.streaming import ingest


def write(folder, name, header, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n\n====\n" + header + "\n" + "".join(x + "\n" for x in lines))


def test_statistic_files(spark, tmp_path):
    meta = "basename,organoid_line,tcell_line,exp_nr,well,date,dead_dye_channel,organoid_distance_channel,tcell_contact_threshold,tcell_dead_dye_threshold,tcell_stats_folder,organoid_contact_threshold,organoid_dead_dye_threshold,organoid_stats_folder,tumor_name,imaris_object_distance"
    (tmp_path / "meta.csv").write_text(meta + "\nE1,13T,CD4,1,well1,23/05/2019,3,10,10,10,,0.0015,10,,,FALSE\nE2,13T,CD8,1,well2,23/05/2019,2,10,10,10,,0.0015,10,,tumor,TRUE\n")
    for e, channel in (("E1", 3), ("E2", 2)):
        folder = tmp_path / f"{e}_Statistics"
        stat = lambda name, measure, values, folder=folder, e=e: write(folder, f"{e}_{name}.csv", f"{measure},Time,TrackID,ID,", [f"{v},{t},{k},{i}," for v, t, k, i in values])
        cells = [(1, 1000, 1), (2, 1000, 2), (1, "", 3)]
        for name, measure in (("Displacement^2", "Displacement^2"), ("Speed", "Speed"), (f"Intensity_Mean_Ch={channel}_Img=1", "Intensity Mean"), ("Intensity_Mean_Ch=7_Img=1", "Intensity Mean")):
            stat(name, measure, [(10 * i + (100 if "Ch=7" in name else 0), t, k, i) for t, k, i in cells])
        if e == "E1":
            stat("Intensity_Min_Ch=10_Img=1", "Intensity Min", [(i, t, k, i) for t, k, i in cells])
        else:
            stat("Shortest_Distance_to_Surfaces_Surfaces=tumor", "Shortest Distance to Surfaces", [(i + 0.5, t, k, i) for t, k, i in cells])
        write(folder, f"{e}_Position.csv", "Position X,Position Y,Position Z,Time,TrackID,ID,", [f"{i},{i},{i},{t},{k},{i}," for t, k, i in cells])
    metadata = m.with_stats_folders(m.read_metadata(spark, str(tmp_path / "meta.csv")), str(tmp_path), "tcell_stats_folder")
    assert [r.tcell_stats_folder for r in metadata.orderBy("basename").collect()] == [f"{tmp_path}/{e}_Statistics" for e in ("E1", "E2")]
    raw = m.raw_tcell_tracks(m.read_statistics(spark, str(tmp_path)), metadata)
    got = sorted((r.basename, r.time, r.track_id or "", r.id, r.dist_org, r.red_lym, r.x) for r in raw.collect())
    assert got == [("E1", 1, "", 3, 3.0, 30.0, 3.0), ("E1", 1, "1000", 1, 1.0, 10.0, 1.0), ("E1", 2, "1000", 2, 2.0, 20.0, 2.0), ("E2", 1, "", 3, 3.5, 30.0, 3.0), ("E2", 1, "1000", 1, 1.5, 10.0, 1.0), ("E2", 2, "1000", 2, 2.5, 20.0, 2.0)]


def test_batch_export_takes_time_from_the_index(spark, tmp_path):
    folder = tmp_path / "B_Statistics"
    header = "{},Original Image Name,Time,Birth [s],Death [s],TrackID,ID,"
    write(folder, "B_Speed.csv", header.format("Speed"), ["5,imgA,99,0,9,7,1,", "6,imgB,98,0,9,7,1,"])
    write(folder, "B_Time_Index.csv", header.format("Time Index"), ["1,imgA,0,0,9,7,1,", "2,imgB,0,0,9,7,1,"])
    rows = m.observations(m.read_statistics(spark, str(tmp_path)), "speed")
    assert sorted((r.basename, r.time, r.speed) for r in rows.collect()) == [("imgA", 1, 5.0), ("imgB", 2, 6.0)]


def test_only_asked_files_are_opened(spark, tmp_path):
    """Files of other folders, statistics and channels can't be read, and nobody tries."""
    for e in ("E1", "E2"):
        for name in ("Intensity_Mean_Ch=3_Img=1", "Intensity_Mean_Ch=4_Img=1", "Speed"):
            write(tmp_path / f"{e}_Statistics", f"{e}_{name}.csv", "Intensity Mean,Speed,Time,TrackID,ID,", [f"{i},{i},{i},t,{i}," for i in range(3)])
    bad = [p for p in tmp_path.rglob("*.csv") if p.name != "E1_Intensity_Mean_Ch=3_Img=1.csv"]
    for p in bad:
        p.write_bytes(b"\xff\xfe\xff\n" * 9)  # no text
    metadata = spark.createDataFrame([("E1", "E1_Statistics", 3)], "basename string, folder string, channel int")
    rows = m.chosen(m.read_statistics(spark, str(tmp_path)), "mean_intensity", metadata, "folder", F.col("channel"))
    assert sorted(r.red_lym for r in rows.collect()) == [0.0, 1.0, 2.0]
    plan = m.read_statistics(spark, str(tmp_path)).read("speed", ["E1_Statistics"])
    assert plan.rdd.getNumPartitions() == 1


def test_long_files_are_read_in_parts(spark, tmp_path):
    from trackloom.sources import statistics

    lines = [f"{i / 2},{i},t{i % 3}µ,{i}," for i in range(500)]
    write(tmp_path / "E_Statistics", "E_Speed.csv", "Speed,Time,TrackID,ID,", lines)
    write(tmp_path / "E_Statistics", "E_Volume.csv", "Volume,Time,TrackID,ID,", [])
    (tmp_path / "E_Statistics" / "E_Area.csv").write_text("")
    statistics.register(spark)
    for size in (1, 37, 1000, 1 << 20):
        table = lambda size=size: spark.read.format(statistics.FORMAT).option("split_bytes", size if size > 1 else 13).load(str(tmp_path))
        speed = table().filter("statistic = 'speed'")
        assert sorted(int(r.f["Time"]) for r in speed.collect()) == list(range(500))
        assert speed.filter("f['TrackID'] = 't1µ'").count() == 167
        assert table().filter("statistic IN ('volume', 'area')").count() == 0


def test_statistics_are_written_and_read_again(spark, tmp_path):
    from trackloom.sources import exports

    rows = [(f"E{i % 3}_Statistics", f"E{i % 3}_Speed.csv", "Speed,Time,TrackID,ID,", f"{i / 4},{i},t,{i},") for i in range(90)]
    lines = spark.createDataFrame(rows, "folder string, file string, header string, line string").repartition(7)
    exports.write_statistics(lines, f"file://{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").rglob("*.csv")) == ["E0_Speed.csv", "E1_Speed.csv", "E2_Speed.csv"]
    back = m.observations(m.read_statistics(spark, f"file://{tmp_path}/out"), "speed")
    assert sorted((r.basename, r.time, r.speed) for r in back.collect()) == sorted((f"E{i % 3}", i, i / 4) for i in range(90))


def test_tables_are_reused(spark, tmp_path):
    built = []
    build = lambda: built.append(1) or spark.range(3).toDF("x")
    path = str(tmp_path / "t")
    for force in (False, False, True):
        assert tables.reused(spark, path, build, force=force).count() == 3
    assert len(built) == 2
    assert tables.reused(spark, path, build, given=spark.range(1)).count() == 1
    tables.write_delimited(spark.range(2), str(tmp_path / "d"))
    tables.write_id_lists(spark.createDataFrame([("E", 1, ["a"])], "basename string, c int, ids array<string>"), str(tmp_path / "j"), "basename")
    assert spark.read.json(str(tmp_path / "j")).collect()[0].ids == ["a"]


def test_a_failed_build_is_built_again(spark, tmp_path):
    import pytest

    path = str(tmp_path / "t")
    with pytest.raises(Exception, match="no"):
        tables.reused(spark, path, lambda: spark.range(5).select(F.raise_error(F.lit("no")).alias("x")))
    assert tables.reused(spark, path, lambda: spark.range(5).toDF("x")).count() == 5


def test_session_tables_follow_their_source(spark, tmp_path):
    source, built = str(tmp_path / "in"), []
    build = lambda: built.append(1) or spark.read.parquet(source)
    for n, times in ((3, 1), (3, 1), (4, 2)):
        if n != 3 or not built:
            spark.range(n).write.mode("overwrite").parquet(source)
        assert tables.session_table(spark, "test-table", source, build).count() == n
        assert len(built) == times


def test_model_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(str(i), float(i % 2), "ab"[i % 2]) for i in range(40)], "track_id string, f double, label string")
    model = classify.train_forest(df, "label", ["f"], trees=5)
    model.write().overwrite().save(str(tmp_path / "model"))
    from pyspark.ml import PipelineModel

    again = classify.predict(PipelineModel.load(str(tmp_path / "model")), df, "label")
    assert again.filter("predicted = label").count() == 40
    assert classify.permutation_importance(model, df, "label", ["f"])["f"] > 0.1


def test_features_are_dealt_anew_in_one_pass(spark):
    """Each feature took a join and a scoring of all tracks of its own; the losses stay those of one feature after the other."""
    rng = random.Random(6)
    data = [(str(i), x, y, None if i == 7 else rng.random(), "ab"[x + 0.3 * y > 0.6]) for i in range(120) for x, y in [(rng.random(), rng.random())]]
    df = spark.createDataFrame(data, "track_id string, x double, y double, z double, label string")
    model = classify.train_forest(df, "label", ["x", "y", "z"], trees=8)
    jobs = lambda: {j for j in spark.sparkContext.statusTracker().getJobIdsForGroup("dealt")}
    counts = []
    for names in (["x"], ["x", "y", "z"]):
        before = len(jobs())
        spark.sparkContext.setJobGroup("dealt", "dealt")
        lost = classify.permutation_importance(model, df, "label", names)
        counts.append(len(jobs()) - before)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] == counts[0]
    place = lambda *key: {r.track_id: i for i, r in enumerate(df.select("track_id", F.xxhash64("track_id", *key).alias("h")).orderBy("h", "track_id").collect())}
    n, m = place(), {i: t for t, i in place(F.lit(5)).items()}
    rows = {r[0]: r for r in data}
    right = lambda k: spark.createDataFrame([tuple(rows[m[n[r[0]]]][i] if i == k else v for i, v in enumerate(r)) for r in data], df.schema)
    share = [classify.accuracy(classify.predict(model, right(k), "label")) for k in range(4)]
    assert lost == pytest.approx({c: share[0] - share[k + 1] for k, c in enumerate("xyz")}) and lost["x"] > 0


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1, 1.0, 5.0, 2.0, 10.0), ("a", 50, 1.0, 5.0, 2.0, 10.0), ("b", 2, 3.0, 15.0, 2.0, 10.0)], "track_id string, time int, dist_org double, red_lym double, organoid_contact_threshold double, tcell_dead_dye_threshold double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    query = ingest.flagged(stream, 10).writeStream.format("memory").queryName("flagged").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r.track_id, r.contact, r.death) for r in spark.table("flagged").collect()) == [("a", 1, 0), ("b", 0, 1)]
    merged = ingest.merged_fragments(spark.createDataFrame([("a", "2024-01-01 00:00:01", 1.0, 3.0), ("a", "2024-01-01 00:00:02", 3.0, 7.0)], "track_id string, at string, volume double, dead_dye_mean double").withColumn("at", F.to_timestamp("at")), "at", "1 minute", "1 minute", ["track_id"])
    assert [r.dead_dye_mean for r in merged.collect()] == [6.0]


def test_small_files_share_a_task(spark, tmp_path):
    """A task for each file made the seconds grow with the files."""
    from trackloom.sources import statistics

    for e in range(300):
        write(tmp_path / f"E{e}_Statistics", f"E{e}_Speed.csv", "Speed,Time,TrackID,ID,", [f"{e},{t},t,{t}," for t in range(3)])
    folders = [f"E{e}_Statistics" for e in range(0, 300, 2)]
    rows = m.read_statistics(spark, str(tmp_path)).read("speed", folders)
    assert rows.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    assert sorted((r.folder_name, r.f["Time"]) for r in rows.collect()) == sorted((f, str(t)) for f in folders for t in range(3))
    part = lambda size: statistics.FilePart("", "f", "speed", "", 0, size)
    sizes = lambda parts: [[p.end for p in x.parts] for x in parts]
    one = statistics.OPEN_BYTES
    assert sizes(statistics.packed([part(x) for x in (0, 0, 9 * one, 0, 0, 0)], 3 * one, 2)) == [[0, 0], [9 * one], [0, 0, 0]]
    assert sizes(statistics.packed([part(0)] * 4, 64 * one, 4)) == [[0]] * 4 and sizes(statistics.packed([], one, 4)) == [[]]


def test_ragged_and_quoted_lines(spark, tmp_path):
    write(tmp_path / "E_Statistics", "E_Speed.csv", "Speed, ,Time,TrackID,ID,", ['"1.5",x,1,"a ",7,', "2.5,,2", "   ", " 3 ,y,3,b,9,more,fields", ""])
    found = m.read_statistics(spark, str(tmp_path)).read("speed").collect()
    assert [r.f for r in found] == [{"Speed": "1.5", "Time": "1", "TrackID": "a", "ID": "7"}, {"Speed": "2.5", "Time": "2", "TrackID": None, "ID": None}, {"Speed": "3", "Time": "3", "TrackID": "b", "ID": "9"}]

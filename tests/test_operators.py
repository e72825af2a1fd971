"""Hand-made boundary cases of the track operators."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackloom.functions.columns import at_most_is_contact, below_is_contact, rescale
from trackloom.operators import composition, death, filters, ids, joins, normalize, series, similarity, smooth, spatial


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_gaps_are_filled_inside_only(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 5, 8.0), ("b", 3, 0.0), ("b", 4, 1.0)], "track_id string, time int, v double")
    assert rows(series.gap_fill(df, ["v"]), "track_id", "time", "v") == [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 4.0), ("a", 4, 6.0), ("a", 5, 8.0), ("b", 3, 0.0), ("b", 4, 1.0)]


def test_gap_fill_lies_between_neighbours(spark):
    rng = random.Random(3)
    data = [(str(t), i, rng.random()) for t in range(5) for i in range(1, 30) if rng.random() < 0.6]
    got = series.gap_fill(spark.createDataFrame(data, "track_id string, time int, v double"), ["v"]).collect()
    known = {(t, i): v for t, i, v in data}
    for t in {d[0] for d in data}:
        times = sorted(i for k, i in known if k == t)
        for r in (r for r in got if r.track_id == t):
            lo, hi = max(i for i in times if i <= r.time), min(i for i in times if i >= r.time)
            assert min(known[t, lo], known[t, hi]) - 1e-12 <= r.v <= max(known[t, lo], known[t, hi]) + 1e-12


@pytest.mark.parametrize(("n", "kept"), [(9, 0), (10, 10)])
def test_mean_of_ten_needs_ten(spark, n, kept):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(1, n + 1)], "track_id string, time int, speed double")
    out = series.carry_backward(series.rolling_mean(df, "speed", 10, "m"), "m").dropna()
    assert out.count() == kept


def test_run_length_and_sticky(spark):
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate([0, 1, 1, 0, 1, 1, 1])], "track_id string, time int, c int")
    assert [r.n for r in series.run_length(df, "c", "n").orderBy("time").collect()] == [0, 1, 2, 0, 1, 2, 3]
    df = spark.createDataFrame([("a", i, c) for i, c in enumerate([0, 1, 0, 0])], "track_id string, time int, c int")
    assert [r.c for r in series.sticky(df, "c").orderBy("time").collect()] == [0, 1, 1, 1]


def test_plateau_starts_after_the_first_maximum(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 10.0, 90.0), ("a", 2, 5.0, 50.0, 90.0), ("a", 3, 5.0, 50.0, 90.0), ("a", 4, 2.0, 20.0, 90.0)], "track_id string, time int, s double, v double, m double")
    assert [r.v for r in series.plateau(df, "s", "v", "m").orderBy("time").collect()] == [10.0, 50.0, 90.0, 90.0]


def test_contact_bounds(spark):
    r = spark.range(1).select(at_most_is_contact(F.lit(2.0), F.lit(2.0)).alias("a"), below_is_contact(F.lit(2.0), F.lit(2.0)).alias("b"), at_most_is_contact(F.lit(None).cast("double"), F.lit(2.0)).alias("c")).collect()[0]
    assert (r.a, r.b, r.c) == (1, 0, None)


def test_rescale_of_a_constant_is_the_middle(spark):
    assert spark.range(1).select(rescale(F.lit(3.0), F.lit(3.0), F.lit(3.0), (0.0, 100.0)).alias("x")).collect()[0].x == 50.0


def test_track_length_bounds(spark):
    df = spark.createDataFrame([("a", i) for i in range(3)], "track_id string, time int")
    assert filters.tracks_of_length(df, 3).count() == 3
    assert filters.tracks_of_length(df, 3, strict=True).count() == 0


def test_untracked_objects_trip_the_guard(spark):
    df = spark.createDataFrame([("E", None, 1), ("E", None, 1)], "basename string, track_id string, time int")
    named = ids.unique_track_ids(df, ["basename"])
    assert {r.track_id for r in named.collect()} == {"1_NA"}
    with pytest.raises(ids.DuplicateRows):
        ids.require_unique(named, ["track_id", "time"])


def test_null_keys_join_and_empty_experiments_stay(spark):
    a = spark.createDataFrame([(None, 1, 2.0)], "k string, t int, x double")
    b = spark.createDataFrame([(None, 1, 3.0)], "k string, t int, y double")
    assert rows(joins.natural_join([a, b], ["k", "t"]), "x", "y") == [(2.0, 3.0)]
    m = spark.createDataFrame([("E1",), ("E2",)], "basename string")
    assert joins.with_observations(m, spark.createDataFrame([("E1", 1)], "basename string, t int"), ["basename"]).count() == 2


def test_nearest_neighbour_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    points = [(f"p{i}", f"w{i % 3}", *map(float, rng.normal(size=3))) for i in range(90)] + [("alone", "w9", 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(points, "track_id string, well string, x double, y double, z double")
    got = {r.track_id: r.nearest for r in spatial.nearest_neighbour(df, ["well"]).collect()}
    for p in points:
        d = [math.dist(p[2:], q[2:]) for q in points if q[1] == p[1] and q[0] != p[0]]
        assert got[p[0]] == pytest.approx(min(d, default=math.inf))
    own = df.withColumn("threshold", F.lit(0.5))
    near = {r.track_id: r.contact for r in spatial.within_distance(own, ["well"], "threshold", 0.5).collect()}
    assert near == {k: int(v < 0.5) for k, v in got.items()}


def test_fill_scopes_differ(spark):
    key = ("L", "CD4", 1, "w", "d")
    data = [(*key, 1, "a", 0), (*key, 1, "b", 1), (*key, 2, "b", 1)]
    df = spark.createDataFrame(data, "organoid_line string, tcell_line string, exp_nr int, well string, date string, time int, track_id string, dead int")
    grid = joins.complete_grid(df, death.WELL_KEY, "time", "track_id")
    well = series.fill_forward(grid, ["dead"], death.WELL_KEY, ["time", "track_id"])
    own = series.fill_forward(grid, ["dead"], [*death.WELL_KEY, "track_id"], ["time"])
    assert rows(well.filter("time = 2 and track_id = 'a'"), "dead") == [(1,)]
    assert rows(own.filter("time = 2 and track_id = 'a'"), "dead") == [(0,)]


def test_rows_of_a_grid_are_not_broadcast(spark):
    """Files of repeated values are small beside their rows, which the driver then could not hold."""
    data = [("L", "CD4", 1, "w", "d", t, str(i), t % 2) for t in range(1, 5) for i in range(300) if (t + i) % 4]
    df = spark.createDataFrame(data, "organoid_line string, tcell_line string, exp_nr int, well string, date string, time int, track_id string, dead int")
    grid = joins.complete_grid(df, death.WELL_KEY, "time", "track_id")
    above = grid._jdf.queryExecution().sparkPlan().toString().split("Scan parquet")
    assert "SortMergeJoin" in above[0] and sum(x.count("Broadcast") for x in above) <= 1  # of the join of times and tracks
    known = {r[5:7]: r[7] for r in data}
    assert rows(grid, "time", "track_id", "dead") == sorted(((t, str(i), known.get((t, str(i)))) for t in range(1, 5) for i in range(300)), key=lambda r: r[:2])


def test_zero_fill_and_empty_classes(spark):
    tracks = spark.createDataFrame([("a", "w1", 1), ("b", "w1", 2), ("c", "w2", 1)], "track_id string, well string, cluster2 int")
    shares = composition.class_shares(tracks, group=["well"])
    full = joins.zero_fill(shares, "cluster2", ["well"], "total_cell", ["num_cluster", "percentage"])
    assert rows(full.filter("well = 'w2' and cluster2 = 2"), "num_cluster", "percentage", "total_cell") == [(0, 0.0, 1)]
    assert all(abs(r.p - 100) < 1e-9 for r in full.groupBy("well").agg(F.sum("percentage").alias("p")).collect())
    lists = composition.ids_per_class(tracks, tracks.select(F.col("well").alias("basename"), "track_id", F.col("track_id").alias("original_track_id")), "basename")
    assert rows(lists.filter("basename = 'w2'"), "cluster2", "ids") == [(1, ["c"]), (2, [])]


def test_zero_volume_row_goes(spark):
    df = spark.createDataFrame([("a", 1, "L", "C", 1, "w", "d", 0.0, 5.0, 1.0)], "track_id string, time int, organoid_line string, tcell_line string, exp_nr int, well string, date string, volume double, dead_dye_mean double, area double")
    assert death.merge_fragments(df).count() == 0


def test_normalised_values_stay_in_range(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(str(i), i % 2, rng.random(), rng.random(), rng.random(), i % 3 % 2, float(i % 2)) for i in range(60)], "track_id string, exp_nr int, displacement double, speed double, red_lym double, contact int, contact_lym double")
    for r in normalize.normalized(df, normalize.MODEL).collect():
        assert 0 <= r.q_disp <= 1.01 and 0 <= r.s_contact <= 1


@pytest.mark.parametrize("leaf,fan", [(4, 2), (32, 16)])
def test_nearest_neighbour_on_any_density(spark, leaf, fan):
    rng = np.random.default_rng(2)
    clump = rng.normal(size=(200, 2)) * 1e-9
    groups = {
        "clump": np.concatenate([clump, rng.normal(size=(20, 2)) * 1e8, [[0.0, 1.0], [-0.0, 1.0]]]),
        "line": np.stack([np.arange(150.0) ** 3, np.zeros(150)], axis=1),
        "equal": np.full((120, 2), 3.5),
        "pair": np.array([[1.0, 1.0], [4.0, 5.0]]),
        None: rng.uniform(-1, 1, size=(60, 2)),
    }
    points = [(f"p{i}", g, float(x), float(y)) for g, v in groups.items() for i, (x, y) in enumerate(v)]
    points += [("null", "pair", None, 0.0), ("nan", "pair", 0.0, math.nan), ("alone", "w", 0.0, 0.0)]
    df = spark.createDataFrame(points, "track_id string, well string, x double, y double")
    found = spatial.nearest_neighbour(df, ["well"], axes=["x", "y"], leaf=leaf, fan=fan)
    got = {(r.track_id, r.well): r.nearest for r in found.collect()}
    assert len(got) == len(points) and found.count() == len(points)
    for g, v in groups.items():
        d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
        np.fill_diagonal(d, np.inf)
        for i, want in enumerate(d.min(axis=1)):
            assert got[f"p{i}", g] == pytest.approx(want, rel=1e-12)
    assert all(math.isinf(got[k]) for k in (("null", "pair"), ("nan", "pair"), ("alone", "w")))
    assert spatial.nearest_neighbour(df.limit(0), ["well"], axes=["x", "y"]).count() == 0


def test_within_distance_of_a_dense_group(spark, monkeypatch):
    """All points within one cube as wide as the largest threshold: contacts are right, and no point meets all others."""
    visits = []
    plain = spatial._nearest_in
    monkeypatch.setattr(spatial, "_nearest_in", lambda v, *rest: visits.append(v.count()) or plain(v, *rest))
    rng = np.random.default_rng(4)
    place = np.concatenate([rng.uniform(0, 1, size=(1500, 2)), [[0.5, 0.5]] * 3, [[9.0, 9.0], [9.0, 9.5]]])
    own = rng.uniform(0, 0.03, size=len(place))
    own[-2:] = 0.5, 0.6
    df = spark.createDataFrame([(i, 0, float(x), float(y), float(o)) for i, ((x, y), o) in enumerate(zip(place, own, strict=True))], "track_id int, well int, x double, y double, own double")
    got = {r.track_id: r.contact for r in spatial.within_distance(df, ["well"], "own", 1.0, axes=["x", "y"]).collect()}
    d = np.sqrt(((place[:, None] - place[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert got == dict(enumerate((d.min(axis=1) < own).astype(int).tolist()))
    assert len(visits) == 2 and sum(visits) < 8 * len(place)


def test_nearest_neighbour_visits_few_leaves(spark, monkeypatch):
    """A clump with far points among it: visits grow with the points, not with their square."""
    visits = []
    plain = spatial._nearest_in
    monkeypatch.setattr(spatial, "_nearest_in", lambda v, *rest: visits.append(v.count()) or plain(v, *rest))
    rng = np.random.default_rng(3)
    for n in (1000, 2000):
        place = np.concatenate([rng.normal(size=(n, 2)) * 1e-3, rng.normal(size=(n // 50, 2)) * 1e6])
        df = spark.createDataFrame([(i, 0, float(x), float(y)) for i, (x, y) in enumerate(place)], "track_id int, well int, x double, y double")
        spatial.nearest_neighbour(df, ["well"], axes=["x", "y"])
    assert visits[1] < 6 * 1020 and visits[3] < 2.6 * visits[1]


def _dtw_plain(a, b):
    n, m = len(a), len(b)
    total = [[math.inf] * m for _ in range(n)]
    for i in range(n):
        for j in range(m):
            c = math.dist(a[i], b[j])
            if i == j == 0:
                total[i][j] = c
            if i:
                total[i][j] = min(total[i][j], total[i - 1][j] + c)
            if j:
                total[i][j] = min(total[i][j], total[i][j - 1] + c)
            if i and j:
                total[i][j] = min(total[i][j], total[i - 1][j - 1] + 2 * c)
    return total[-1][-1]


def test_dtw(spark):
    rng = np.random.default_rng(5)
    tracks = {f"t{i}": rng.normal(size=(rng.integers(1, 9), 2)) for i in range(9)}
    tracks["copy"] = tracks["t0"]
    data = [(k, t, float(x), float(y)) for k, v in tracks.items() for t, (x, y) in enumerate(v)]
    edges = similarity.dtw_pairs(similarity.track_series(spark.createDataFrame(data, "track_id string, time int, x double, y double"), ["x", "y"]), 2, blocks=3)
    got = {(r.src, r.dst): r.dist for r in edges.collect()}
    assert len(got) == 45
    for (a, b), d in got.items():
        assert a < b and d == pytest.approx(_dtw_plain(tracks[a], tracks[b]))
    assert got["copy", "t0"] == 0
    near = similarity.nearest_tracks(edges, 3)
    assert near.filter("rank = 1 and src != dst").count() == 0 and near.count() == 30


def test_equal_tracks_are_computed_once(spark):
    """Twenty copies of twelve tracks, as a larger table repeats them: all pairs and the nearest are those of the tracks, the work that of twelve."""
    rng = np.random.default_rng(9)
    kinds = [rng.normal(size=(rng.integers(2, 7), 2)) for _ in range(12)]
    tracks = {f"{i:03d}": kinds[i * 7 % 12] for i in range(240)}
    data = [(k, t, float(x), float(y)) for k, v in tracks.items() for t, (x, y) in enumerate(v)]
    series = similarity.track_series(spark.createDataFrame(data, "track_id string, time int, x double, y double"), ["x", "y"])
    plain = {(i, j): round(_dtw_plain(kinds[i], kinds[j]), 6) for i in range(12) for j in range(12)}
    want = {(a, b): plain[int(a) * 7 % 12, int(b) * 7 % 12] for a in tracks for b in tracks}
    got = {(r.src, r.dst): r.dist for r in similarity.dtw_pairs(series, 2, digits=6).collect()}
    assert len(got) == 240 * 239 // 2 and all(a < b and d == pytest.approx(want[a, b]) for (a, b), d in got.items())
    near, work = similarity.nearest_by_bounds(series, 2, 25, block_tracks=4)
    found = {}
    for r in near.collect():
        found.setdefault(r.src, []).append((r["rank"], r.dst, r.dist))
    assert len(found) == 240 and work.first()["pairs"] == 240 * 239 // 2 and work.first()["full"] <= 66
    for a, rows in found.items():
        rows.sort()
        order = sorted(tracks, key=lambda b: (want[a, b], a != b, b))[:25]
        assert [b for _, b, _ in rows] == order and [d for *_, d in rows] == pytest.approx([want[a, b] for b in order], abs=1e-6)


@pytest.mark.parametrize("k", [1, 3, 6])
def test_nearest_by_bounds_equals_all_pairs(spark, k):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(6, 2)) * 8
    tracks = {f"t{i:03}": np.cumsum(rng.normal(size=(rng.integers(1, 15), 2)), axis=0) * 0.3 + centres[i % 6] for i in range(90)}
    tracks |= {"copy1": tracks["t000"], "copy2": tracks["t000"], "far": np.full((4, 2), 1e6)}
    data = [(t, i, float(x), float(y)) for t, v in tracks.items() for i, (x, y) in enumerate(v)]
    series = similarity.track_series(spark.createDataFrame(data, "track_id string, time int, x double, y double"), ["x", "y"])
    got, work = similarity.nearest_by_bounds(series, 2, k, block_tracks=10)
    want = similarity.nearest_tracks(similarity.dtw_pairs(series, 2, blocks=2), k)
    plain = lambda df: sorted((r.src, r.rank, r.dst, round(r.dist, 6)) for r in df.collect())
    assert plain(got) == plain(want) and got.count() == len(tracks) * k
    done = work.first()
    assert done.pairs == len(tracks) * (len(tracks) - 1) // 2 and done.full < 0.5 * done.pairs


def test_bounds_are_below_distances():
    rng = np.random.default_rng(7)
    tracks = [np.cumsum(rng.normal(size=(n, 3)), axis=0) for n in (1, 2, 3, 9, 9, 14)]
    table = pa.table({"track_id": list("abcdef"), "length": [len(t) for t in tracks], "series": [t.ravel() for t in tracks]})
    t = similarity.Tracks(table, 3)
    i, j = (x.ravel() for x in np.indices((6, 6)))
    dist = similarity.distances(t, i, j)
    assert dist == pytest.approx([_dtw_plain(tracks[a], tracks[b]) for a, b in zip(i, j, strict=True)])
    assert (similarity.box_bounds(t, i, j) <= dist + 1e-9).all()
    for share in (0.3, 0.7, 1.0):
        t.bound = np.full(6, np.quantile(dist, share))
        within, full = similarity.distances_within(t, i, j)
        near = dist <= t.bound[0]
        assert within[near] == pytest.approx(dist[near]) and full == np.isfinite(within).sum() <= 36


def test_bounds_in_single_precision():
    """Below the distances, near them where the tracks have no common offset, of any scale; none where an entry is missing or infinite."""
    rng = np.random.default_rng(8)
    for scale, offset in ((1.0, 0.0), (1e30, 0.0), (1e-30, 0.0), (1.0, 1e7)):
        tracks = [rng.normal(size=(n, 3)) * scale + offset for n in rng.integers(1, 30, 40)] + [np.full((5, 3), offset + 1e4 * scale)]
        t = similarity.Tracks(pa.table({"track_id": [f"{i:02}" for i in range(41)], "length": [len(x) for x in tracks], "series": [x.ravel() for x in tracks]}), 3)
        seen = np.full((20, 21), np.nan)
        for a, b, least in similarity.least_distances(t, np.arange(20), np.arange(20, 41)):
            seen[np.ix_(a, b - 20)] = least
        dist = similarity.distances(t, *similarity._across(20, 21)).reshape(20, 21)
        assert (seen <= dist).all() and (seen >= 0.99 * dist).all()
    tracks[0][0], tracks[1][0] = np.nan, np.inf
    t = similarity.Tracks(pa.table({"track_id": [f"{i:02}" for i in range(41)], "length": [len(x) for x in tracks], "series": [x.ravel() for x in tracks]}), 3)
    for a, b, least in similarity.least_distances(t, np.arange(20), np.arange(20, 41)):
        assert not np.isfinite(least[a <= 1]).any() and np.isfinite(least[a > 1]).all()


def test_nearest_of_unlike_tracks(spark):
    """Tracks that are all about equally far: hardly more than the nearest are computed in full."""
    rng = np.random.default_rng(10)
    data = [(f"t{i:03}", length, rng.normal(size=length * 4).tolist()) for i, length in enumerate(rng.integers(9, 12, 400).tolist())]
    tracks = spark.createDataFrame(data, "track_id string, length int, series array<double>")
    got, work = similarity.nearest_by_bounds(tracks, 4, 4)
    want = similarity.nearest_tracks(similarity.dtw_pairs(tracks, 4), 4)
    plain = lambda df: sorted((r.src, r["rank"], r.dst, round(r.dist, 6)) for r in df.collect())
    assert plain(got) == plain(want)
    done = work.first()
    assert done.pairs == 400 * 399 // 2 and done.full < 0.15 * done.pairs


def test_one_track_and_none(spark):
    one = spark.createDataFrame([("a", 2, [1.0, 2.0]), ("b", 0, [])], "track_id string, length int, series array<double>")
    assert [tuple(r) for r in similarity.nearest_by_bounds(one, 1, 3)[0].collect()] == [("a", 1, "a", 0.0)]
    assert similarity.dtw_pairs(one, 1).count() == 0
    assert similarity.nearest_by_bounds(one.limit(0), 1, 3)[0].count() == 0


def test_repeated_rows_fail_the_action(spark):
    from trackloom.plans import tcell

    rows = [("a", t, 1.0 * t, 2.0, 3.0, 4.0, 0.0, "L", "CD4", 1, "w", 5.0, 10.0) for t in range(1, 30)]
    kind = "track_id string, time int, speed double, displacement double, dist_org double, red_lym double, contact_lym double, organoid_line string, tcell_line string, exp_nr int, well string, organoid_contact_threshold double, tcell_dead_dye_threshold double"
    carried = ["organoid_line", "tcell_line", "exp_nr", "well", "organoid_contact_threshold", "tcell_dead_dye_threshold"]
    settings = tcell.Settings(duration=28, min_length=5, max_length=20)
    good, bad = spark.createDataFrame(rows, kind), spark.createDataFrame(rows + rows[4:5], kind)
    assert tcell.processed_tracks(good, settings, carried).count() == 20
    plans = [tcell.processed_tracks(bad, settings, carried), tcell.track_funnel(bad, settings, carried)]  # no job yet
    for df in plans:
        with pytest.raises(Exception, match=series.REPEATED):
            df.collect()
    assert tcell.processed_tracks(bad, settings, carried, check=False).count() == 20


def test_funnel_by_last_stage(spark):
    from trackloom.operators import qc

    rows = [("w1", "a", 0, 0), ("w1", "b", 0, 1), ("w1", "b", 2, 3), ("w2", "c", 0, 1), ("w3", "c", 2, 2)]
    reached = spark.createDataFrame(rows, "well string, track_id string, _from int, _reach int")
    got = {r[0]: tuple(r)[1:] for r in qc.funnel_by_reach(reached, ["p", "q", "r", "s"], ["well"]).collect()}
    assert got == {"w1": (2, 1, 1, 1), "w2": (1, 1, None, None)}


def test_local_regression_equals_sums_over_pairs(spark):
    """A long curve with large times, repeated points and a null, short curves, and a null group."""
    rng = np.random.default_rng(9)
    far = np.sort(rng.choice(5000, 700)) * 1000.0
    curves = {"long": [(1e9 + float(t), float(v)) for t, v in zip(far, rng.normal(size=700), strict=True)], None: [(float(t), t * 0.5) for t in range(5)]}
    curves |= {"three": [(0.0, 1.0), (1.0, 2.0), (2.0, 5.0)], "one": [(4.0, 1.0)], "same": [(4.0, 1.0)] * 6, "gap": [(float(t), None if t == 3 else t * 1.0) for t in range(8)]}
    df = spark.createDataFrame([(g, x, y) for g, v in curves.items() for x, y in v], "g string, x double, y double")
    got = {(r.g, r.x): r.smooth for r in smooth.local_quadratic(df, "x", "y", ["g"]).collect()}
    assert set(got) == {(g, x) for g, v in curves.items() for x, _ in v}
    for g, v in curves.items():
        x, y = np.array([p[0] for p in v]), np.array([p[1] or 0.0 for p in v])
        for x0 in set(x):
            d = (x - x0) / max(x.max() - x.min(), 1)
            w = (1 - np.abs(d / np.abs(d).max()) ** 3) ** 3 if np.abs(d).max() else np.ones(len(x))
            if len(set(d[w > 0])) < 3:
                assert got[g, x0] is None
                continue
            a = np.stack([np.ones(len(d)), d, d * d], axis=1)
            assert got[g, x0] == pytest.approx(np.linalg.solve(a.T * w @ a, a.T * w @ y)[0], rel=1e-7, abs=1e-9)


def test_kmeans_sends_one_row_a_round(spark):
    """However many tasks there are, the driver gets one row of sums."""
    from trackloom.operators import kmeans

    rng = np.random.default_rng(8)
    points = rng.normal(size=(500, 2))
    rows = spark.createDataFrame([(p.tolist(),) for p in points], "_values array<double>").repartition(24)
    centres = rng.normal(size=(3, 4, 2))
    got = kmeans._totals(rows, centres).collect()
    total = np.frombuffer(got[0]["sums"]).reshape(3, 4, 4)
    assert len(got) == 1 and (total[:, :, 0].sum(axis=1) == 500).all() and np.allclose(total[:, :, 2:].sum(axis=1), points.sum(axis=0))


def test_quartiles_of_a_large_facet(spark):
    from trackloom.operators import qc

    df = spark.range(1_000_000).selectExpr("IF(id % 1000 = 0, NULL, 'big') AS f", "id % 2 AS g", "pmod(xxhash64(id), 1000003) / 7.0D AS v")
    got = {(r.f, r.g): tuple(r)[2:] for r in qc.five_numbers(df, "v", ["f", "g"]).collect()}
    q = F.percentile("v", [0.25, 0.5, 0.75])
    want = {(r.f, r.g): (r.n, r.lo, *r.q, r.hi) for r in df.groupBy("f", "g").agg(F.count("v").alias("n"), F.min("v").alias("lo"), q.alias("q"), F.max("v").alias("hi")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_kmeans_from_many_starts(spark):
    from trackloom.operators import kmeans

    rng = np.random.default_rng(8)
    centres = np.array([[0, 0], [9, 0], [0, 9], [9, 9]])
    place = np.concatenate([rng.normal(size=(60, 2)) + c for c in centres])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(place)], "i int, x double, y double").repartition(5)
    found = kmeans.best_kmeans(df, 4, ["x", "y"], starts=20).toPandas().sort_values("i")
    assert found.groupby(found.i // 60).cluster2.nunique().eq(1).all() and found.cluster2.nunique() == 4
    mean = found.groupby("cluster2")[["x", "y"]].mean()
    near = ((place[:, None] - mean.to_numpy()) ** 2).sum(2).argmin(1)
    assert (mean.index.to_numpy()[near] == found.cluster2.to_numpy()).all()
    assert kmeans.best_kmeans(df.limit(0), 4, ["x", "y"]).count() == 0
    assert kmeans.best_kmeans(df.limit(1), 4, ["x", "y"], starts=3).count() == 1


def test_what_is_known_next_is_found_in_one_scan(spark):
    """Frames from a row to the end of its track were read anew for each row, so a track of n rows took n squared."""
    rng = random.Random(9)
    data = [(t, i, rng.random() if rng.random() < 0.3 else None) for t in "ab" for i in range(200) if rng.random() < 0.8]
    df = spark.createDataFrame(data, "track_id string, time int, v double")
    carried, filled = series.carry_backward(df, "v"), series.gap_fill(df, ["v"])
    for found in (carried, filled):
        assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    known = {t: [(i, v) for k, i, v in data if k == t and v is not None] for t in "ab"}
    assert rows(carried.filter("v IS NOT NULL"), "track_id", "time", "v") == sorted((t, i, min((j, w) for j, w in known[t] if j >= i)[1]) for t, i, _ in data if any(j >= i for j, _ in known[t]))
    times = {i for _, i, _ in data}
    got = rows(filled, "track_id", "time", "v")
    assert [r[:2] for r in got] == [(t, i) for t in "ab" for i in sorted(times) if known[t][0][0] <= i <= known[t][-1][0]]
    for t, i, v in got:
        assert v == pytest.approx(np.interp(i, *zip(*known[t])))


def test_memberships_of_many_tracks_are_bisected_together(monkeypatch):
    """A track took up to 64 steps of its own."""
    from trackloom.operators import embed

    rng = np.random.default_rng(5)
    lists = [np.sort(rng.gamma(2, 3, n)) for n in rng.choice([9, 14], 300)] + [np.zeros(14), np.r_[0.0, 0.0, rng.random(12)], np.zeros(0), np.ones(14)]
    calls, exp = [], np.exp
    monkeypatch.setattr(embed.np, "exp", lambda x: calls.append(1) or exp(x))
    found = embed._weights(embed.pd.Series(lists))
    assert len(calls) <= 3 * 65
    for d, w in zip(lists, found):
        rho, target = min(d[d > 0], default=0.0), math.log2(max(len(d), 2))
        sigma, lo, hi = 1.0, 0.0, math.inf
        for _ in range(64):
            total = exp(-np.maximum(d - rho, 0) / sigma).sum()
            if abs(total - target) < 1e-9:
                break
            lo, hi = (lo, sigma) if total > target else (sigma, hi)
            sigma = sigma * 2 if hi == math.inf else (lo + hi) / 2
        assert len(w) == len(d) and np.allclose(w, exp(-np.maximum(d - rho, 0) / max(sigma, 1e-12)), rtol=1e-12, atol=0)


def test_pairs_are_made_by_all_cores(spark):
    """The tiles of few tracks came to one task by their bytes, which then made the pairs and handed them on to all copies alone."""
    rng = random.Random(12)
    data = [(f"{i:03d}-{copy}", 3, values) for i in range(90) for values in [[rng.random() for _ in range(3)]] for copy in range(3)]
    found = similarity.dtw_pairs(spark.createDataFrame(data, "track_id string, length int, series array<double>"), 1)
    apart = found.filter(F.substring("src", 1, 3) != F.substring("dst", 1, 3))
    sizes = [r["count"] for r in apart.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 90 * 89 // 2 * 9 and found.count() == 270 * 269 // 2
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(sizes) < 0.6 * sum(sizes)


def test_layout_keeps_edges_in_order(spark, monkeypatch):
    """An epoch's moves of a track were spread over all tasks, so few were added up before the shuffle."""
    from trackloom.operators import embed

    kept, written = {}, embed.written
    monkeypatch.setattr(embed, "written", lambda df, name: kept.setdefault(name, written(df, name)))
    rng = random.Random(4)
    edges = [(str(i), str((i + j) % 300), rng.random()) for i in range(300) for j in (1, 2, 5, 299, 298, 295)]
    rng.shuffle(edges)
    embed.layout(spark.createDataFrame(edges, "src string, dst string, weight double").repartition(3), epochs=1)
    files = {}
    for r in kept["layout-edges"].select(F.input_file_name().alias("f"), "s").collect():
        files.setdefault(r.f, []).append(r.s)
    assert sum(map(len, files.values())) == len(edges) and len(files) == spark.sparkContext.defaultParallelism
    spans = sorted((s[0], s[-1]) for s in files.values() if s == sorted(s))
    assert len(spans) == len(files) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_kmeans_deals_its_rows_evenly(spark):
    """Every round waited for the partition that had most rows, whatever the cores."""
    from trackloom.operators import kmeans

    df = spark.range(400, numPartitions=1).select(F.col("id").alias("i"), F.rand(3).alias("x"), F.rand(4).alias("y"))
    found = kmeans.best_kmeans(df, 3, ["x", "y"], starts=4, rounds=3)
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 2 * min(sizes)


def test_carry_forward_over_partitions(spark):
    """One scope over several partitions, some without a known value, beside short scopes and a null one."""
    rows = [("big", t, "k", 1.0 * t if t % 97 == 5 else None, "x" if t == 40 else None) for t in range(600)]
    rows += [(g, t, "k", float(t) if t % 2 else None, None) for g in ("a", "b", None) for t in range(3)]
    df = spark.createDataFrame(rows, "g string, t int, k string, v double, s string").repartition(3)
    keys = lambda d: sorted(map(tuple, d.collect()), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = series.carry_forward(df, ["v", "s"], ["g"], ["t", "k"])
        assert keys(got) == keys(series.fill_forward(df, ["v", "s"], ["g"], ["t", "k"]))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_local_regression_reproduces_a_parabola(spark):
    df = spark.createDataFrame([("g", float(i), 2.0 * i * i - i + 3) for i in range(12)], "g string, x double, y double")
    for r in smooth.local_quadratic(df, "x", "y", ["g"]).collect():
        assert r.smooth == pytest.approx(2 * r.x * r.x - r.x + 3)


def test_quantiles_equal_percentile(spark, monkeypatch):
    from trackloom.operators import quantiles

    monkeypatch.setattr(quantiles, "ACCURACY", 100)
    df = spark.range(30_000).selectExpr("id % 3 AS g", "CASE WHEN id % 5 = 0 THEN 7.0D WHEN id % 97 = 0 THEN NULL ELSE pmod(xxhash64(id), 100000) / 7.0D END AS v")
    df = df.union(spark.range(40).selectExpr("9L", "CAST(id AS DOUBLE)")).union(spark.range(2).selectExpr("10L", "CAST(NULL AS DOUBLE)"))
    wanted = {"a": ("v", 0.75), "b": ("v", 0.9999), "c": ("v", 0.0), "d": ("v", 1.0), "e": ("v", 0.5)}
    got = quantiles.group_quantiles(df, "g", wanted)
    want = df.groupBy("g").agg(*[F.percentile(c, q).alias(n) for n, (c, q) in wanted.items()])
    pairs = zip(sorted(map(tuple, got.select(want.columns).collect())), sorted(map(tuple, want.collect())), strict=True)
    assert all(a == b if b[1] is None else a == pytest.approx(b, rel=1e-12) for a, b in pairs)


def test_rows_are_numbered_in_order(spark):
    from trackloom.operators.numbering import numbered

    got = numbered(spark.range(500).selectExpr("(id * 7919) % 500 AS k").repartition(6), ["k"]).collect()
    assert sorted((r.k, r.n) for r in got) == [(i, i) for i in range(500)]


def test_a_join_that_would_multiply_rows_is_refused(spark):
    from trackloom.operators.ids import DuplicateRows

    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(1, 5), (1, 6)], "k int, y int")
    with pytest.raises(DuplicateRows):
        joins.join_once(left, right, ["k"])
    assert joins.join_once(left, right.limit(1), ["k"]).count() == 1

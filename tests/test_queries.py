"""Each registered query against its SQL on the smallest tables, and invariants of those without SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from trackloom import catalog, catalog_models, catalog_sources  # noqa: F401
from trackloom.operators import classify

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(5)
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    return [tuple(float(x) if number(x) and x == x else x if isinstance(x, (str, bool)) else None for x in row) for row in df.astype(object).to_numpy().tolist()], list(df.columns)


def same(spark_df, sql_df):
    (a, names), (b, others) = plain(spark_df), plain(sql_df)
    assert names == others
    key = lambda r: tuple((x is None, str(type(x)), 0 if x is None else x) for x in r)
    assert len(a) == len(b)
    for r, s in zip(sorted(a, key=key), sorted(b, key=key), strict=True):
        assert all(v == pytest.approx(w) if isinstance(v, float) else v == w for v, w in zip(r, s, strict=True)), (r, s)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    same(catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.SQL[name]).fetchdf())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_invariants(spark):
    split = catalog.train_valid_split(spark, SF)
    assert split.select("track_id").distinct().count() == split.select("track_id", "part").distinct().count()
    funnel = catalog.track_funnel(spark, SF).fillna(0).collect()
    assert all(r.unfiltered >= r.filt_exp_duration >= r.filt_minlength >= r.filt_deadcellstart for r in funnel)
    graph = catalog.fuzzy_graph(spark, SF).toPandas()
    pairs = {(a, b): w for a, b, w in graph[["src", "dst", "weight"]].itertuples(index=False)}
    assert all(0 <= w <= 1 and pairs[b, a] == pytest.approx(w) for (a, b), w in pairs.items())
    predicted = catalog.rf_predict(spark, SF)
    assert predicted.count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    errors = catalog.rf_error_by_trees(spark, SF).toPandas()
    assert errors["error"].between(0, 1).all() and set(errors["trees"]) == set(range(1, 101))
    found = catalog.kmeans_best_of_n(spark, SF).toPandas()
    names = [c for c in found.columns if c not in ("track_id", "label", "cluster2")]
    assert len(names) == 64
    centres = found.groupby("cluster2")[names].mean()
    for r in found.itertuples():
        d = ((centres.to_numpy() - [getattr(r, c) for c in names]) ** 2).sum(1)
        assert centres.index[d.argmin()] == r.cluster2 or d.min() == pytest.approx(d[list(centres.index).index(r.cluster2)], rel=0.2)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_forest_takes_all_components(spark):
    found = catalog.rf_importance(spark, SF).toPandas()
    assert set(found["feature"]) == {f"f{i}" for i in range(64)}
    assert found.loc[~found["feature"].isin([f"f{i}" for i in range(8)]), "importance"].sum() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_forest_has_the_trees_of_the_reference(spark):
    assert len(classify.forest_of(catalog._forest(spark, SF)[0]).trees) == 100


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_shares_of_predicted_classes(spark, monkeypatch):
    tracks = catalog._classed(spark, SF).toPandas()
    classes = spark.createDataFrame([(r.track_id, i % 2 + 1) for i, r in enumerate(tracks.itertuples())], "track_id string, cluster2 int")
    monkeypatch.setattr(catalog_models, "_map_classes", lambda spark, sf_dir: classes)
    found = catalog_models.predicted_shares(spark, SF).toPandas()
    wells = found.groupby(catalog._KEYS, dropna=False)
    assert set(found["cluster2"]) <= {"1", "2"} and wells["percentage"].sum().round(3).eq(100).all()
    assert (wells["num_cluster"].sum() == wells["total_cell"].first()).all() and wells["total_cell"].first().sum() == len(tracks)
    profile = catalog_models.behaviour_profile(spark, SF).toPandas()
    assert set(profile["cluster2"]) == {1, 2} and profile["value"].between(0, 100).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_classes_are_derived_once(spark):
    """Each reading of the classes ran the whole chain of tracks anew."""
    for name in ("backprojection_lists", "class_share_zero_filled"):
        files = catalog.QUERIES[name](spark, SF).inputFiles()
        assert files and not any("events.parquet" in f for f in files)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_organoids_and_grid_rows_are_derived_once(spark):
    """The grid read its rows three times, and the curves the organoids, each time from the line items."""
    for name, table in (("grid_complete", "grid-rows"), ("individual_death_curve", "organoid-rows")):
        files = catalog.QUERIES[name](spark, SF).inputFiles()
        assert any(table in f for f in files) and not any("lineitem.parquet" in f for f in files)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_processed_rows_are_derived_once(spark):
    """The active contacts ran the chain of tracks three times, and each part of a branch did so anew."""
    files = [catalog.QUERIES[name](spark, SF).inputFiles() for name in ("processed_tracks", "active_contact")]
    assert files[0] == files[1] and all("processed-rows" in f for f in files[0])


def test_behaviour_map_is_made_once(spark, monkeypatch, tmp_path):
    """The map ran its k-means beside that of the profiles, shares and forests."""
    points = spark.range(60).select(F.col("id").cast("string").alias("track_id"), (F.col("id") % 6 * 9.0).alias("v1"), F.rand(2).alias("v2"))
    monkeypatch.setattr(catalog, "_layout", lambda spark, sf_dir: points)
    whole, classes = catalog.behaviour_map(spark, str(tmp_path)), catalog_models._map_classes(spark, str(tmp_path))
    assert whole.inputFiles() and sorted(whole.inputFiles()) == sorted(classes.inputFiles())
    assert whole.columns == ["track_id", "v1", "v2", "cluster2"] and sorted(map(tuple, whole.select("track_id", "cluster2").collect())) == sorted(map(tuple, classes.collect()))
    assert whole.count() == 60 and whole.select("cluster2").distinct().count() == 6

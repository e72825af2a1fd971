"""Bags, votes and importance against plain counts."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.ml.linalg import Vectors

from trackloom.operators import bagging

TREES = 6
NAMES = ["a", "b", "noise"]


def plain_weight(track, tree, seed=123):
    u = int(hashlib.md5(f"{track}-{tree}-{seed}".encode()).hexdigest()[:8], 16) / 2**32
    return sum(u >= p for p in bagging.POISSON)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(4)
    rows = []
    for i in range(60):
        kind = ("x", "y", "z")[i % 3]
        rows.append((f"t{i}", kind, {"x": 0.0, "y": 4.0, "z": 0.0}[kind] + rng.random(), {"x": 0.0, "y": 0.0, "z": 4.0}[kind] + rng.gauss(0, 1.5), rng.random()))
    return rows


@pytest.fixture(scope="module")
def forest(spark, data):
    tracks = spark.createDataFrame(data, "track_id string, cluster2 string, a double, b double, noise double")
    return tracks, bagging.train_bagged(tracks, "cluster2", NAMES, trees=TREES)


def plain_votes(data, forest, values=None):
    """track -> {tree: class} for the trees that did not see the track."""
    found = {}
    for track, _, *features in data:
        vector = Vectors.dense(values[track] if values else features)
        found[track] = {n: forest.labels.labels[int(t.predict(vector))] for n, t in enumerate(forest.trees, 1) if plain_weight(track, n) == 0}
    return found


def test_weights(spark, data):
    tracks = spark.createDataFrame([(r[0],) for r in data], "track_id string")
    got = {(r.track_id, r.tree): r.weight for r in bagging.bag_weights(tracks, 50).collect()}
    assert got == {(r[0], n): plain_weight(r[0], n) for r in data for n in range(1, 51)}
    assert sum(got.values()) / len(got) == pytest.approx(1, abs=0.06)
    assert sum(w == 0 for w in got.values()) / len(got) == pytest.approx(0.368, abs=0.03)


def test_a_tree_learns_from_its_bag_only(spark, data, forest):
    _, model = forest
    assert len(model.trees) == TREES
    for n, tree in enumerate(model.trees, 1):
        weights = Counter()
        for track, kind, *_ in data:
            weights[kind] += plain_weight(track, n)
        root = tree._call_java("rootNode").impurityStats().stats()
        assert sorted(root) == pytest.approx(sorted(float(w) for w in weights.values()))


def test_predictions_and_error(data, forest):
    tracks, model = forest
    votes = plain_votes(data, model)

    def winner(of):
        count = Counter(of.values())
        return max(model.labels.labels, key=lambda c: (count[c], -model.labels.labels.index(c))) if count else None

    got = {r.track_id: r for r in bagging.oob_predictions(model, tracks, "cluster2").collect()}
    assert {t: r.predicted for t, r in got.items()} == {t: winner(v) for t, v in votes.items()}
    errors = {(r.trees, r.label): r.error for r in bagging.oob_error_by_trees(model, tracks, "cluster2").collect()}
    for n in range(1, TREES + 1):
        wrong = {}
        for track, kind, *_ in data:
            won = winner({k: v for k, v in votes[track].items() if k <= n})
            if won is not None:
                for key in (kind, "all"):
                    wrong.setdefault(key, []).append(won != kind)
        for key in ("x", "y", "z", "all"):
            want = sum(wrong[key]) / len(wrong[key]) if key in wrong else None
            assert errors[n, key] == (pytest.approx(want) if want is not None else None)


def test_importance_equals_one_feature_at_a_time(spark, data, forest):
    tracks, model = forest
    order = {r.track_id: r.k for r in tracks.selectExpr("track_id", "xxhash64(track_id, 5) AS k").collect()}
    ids = sorted(order, key=lambda t: (order[t], t))
    features = {t: f for t, _, *f in data}
    base = plain_votes(data, model)
    want = {}
    for at, name in enumerate(NAMES):
        dealt = {}
        for i, t in enumerate(ids):
            dealt[t] = list(features[t])
            dealt[t][at] = features[ids[i - 1]][at]
        after = plain_votes(data, model, dealt)
        for key in ("x", "y", "z", "all"):
            lost = []
            for n in range(1, TREES + 1):
                mine = [(t, kind) for t, kind, *_ in data if n in base[t] and key in (kind, "all")]
                if mine:
                    lost.append(sum((base[t][n] == k) - (after[t][n] == k) for t, k in mine) / len(mine))
            mean = sum(lost) / len(lost)
            spread = (sum((x - mean) ** 2 for x in lost) / (len(lost) - 1)) ** 0.5 / len(lost) ** 0.5 if len(lost) > 1 else 0.0
            want[name, key] = (mean, spread)
    got = {(r.feature, r.label): r for r in bagging.class_importance(model, tracks, "cluster2").collect()}
    assert set(got) == set(want)
    for key, (mean, spread) in want.items():
        assert got[key].loss == pytest.approx(mean) and got[key].spread == pytest.approx(spread)
        assert got[key].scaled == (pytest.approx(mean / spread) if spread > 0 else None)
    assert got["a", "all"].loss > got["noise", "all"].loss


def test_null_features_and_labels_take_no_part(spark, data, forest):
    tracks, model = forest
    more = tracks.union(spark.createDataFrame([("n1", None, 1.0, 1.0, 1.0), ("n2", "x", None, 1.0, 1.0)], tracks.schema))
    assert bagging.oob_predictions(model, more, "cluster2").count() == len(data)
    assert {r.label for r in bagging.class_importance(model, more, "cluster2").select("label").distinct().collect()} == {"x", "y", "z", "all"}


def test_votes_are_summed_up_where_they_are(spark, data, forest, monkeypatch):
    """The error by trees needs no window and no join of votes, and importance hashes a track's bags once, not once for each copy."""
    stored, plain = [], bagging.written
    monkeypatch.setattr(bagging, "written", lambda df, name: stored.append((name, df.columns)) or plain(df, name))
    tracks, model = forest
    plan = bagging.oob_error_by_trees(model, tracks, "cluster2")._jdf.queryExecution().toString()
    assert "Window" not in plan and "Join" not in plan
    bagging.class_importance(model, tracks, "cluster2")
    assert "_unseen" in dict(stored)["importance-rows"]

"""Forests whose bags are known: error, confusion and importance from tracks that a tree has not seen.

The weight of a track in the bag of a tree is a Poisson(1) number, as drawing
with replacement gives it, and comes from a hash of the tree and the track. So
bags never change, need no storage, and any task can tell which trees may vote on
a track.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml.classification import DecisionTreeClassificationModel, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.operators.features import FEATURES
from trackloom.operators.numbering import numbered
from trackloom.sources.tables import written

#: Cumulative Poisson(1): a uniform number is as many as it reaches.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(12)]
AT_ONCE = 4  # trees that are trained side by side
_ROWS = 1024  # tracks whose votes a task sums up at a time


def bag_weight(track: Column, tree: Column, seed: int) -> Column:
    """How often the bag of a tree holds a track."""
    digest = F.md5(F.concat_ws("-", track.cast("string"), tree.cast("string"), F.lit(str(seed))))
    uniform = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(1 << 32)
    count = lambda u: sum(((u >= p).cast("int") for p in POISSON[1:]), (u >= POISSON[0]).cast("int"))
    return F.transform(F.array(uniform), count)[0]  # so that the hash is computed once


def bag_weights(tracks: DataFrame, trees: int = 100, track: str = "track_id", seed: int = 123) -> DataFrame:
    """(track, tree, weight) for trees 1, 2, .."""
    rows = tracks.select(track, F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"))
    return rows.select(track, "tree", bag_weight(F.col(track), F.col("tree"), seed).alias("weight"))


@dataclass
class BaggedForest:
    trees: list[DecisionTreeClassificationModel]
    labels: StringIndexerModel
    features: list[str]
    seed: int


def _vectors(tracks: DataFrame, labels: StringIndexerModel | None, label: str, features: list[str], track: str) -> DataFrame:
    """(track, _label, _index, _values); rows with a null label or feature are left out."""
    complete = tracks.dropna(subset=[label, *features])
    rows = complete.select(F.col(track), F.col(label).cast("string").alias("_label"), F.array(*[F.col(c).cast("double") for c in features]).alias("_values"))
    return labels.transform(rows) if labels else rows


def train_bagged(tracks: DataFrame, label: str = "cluster2", features: list[str] | None = None, *, trees: int = 100, depth: int = 5, track: str = "track_id", seed: int = 123) -> BaggedForest:
    """One tree for each bag, each split choosing among the square root of all features.

    The vectors are written once; a tree reads those of its bag. Some trees are
    trained side by side, as one alone leaves executors idle.
    """
    features = features or FEATURES
    rows = _vectors(tracks, None, label, features, track)
    labels = StringIndexer(inputCol="_label", outputCol="_index", stringOrderType="alphabetAsc", handleInvalid="skip").fit(rows)
    table = written(labels.transform(rows), "forest-vectors").withColumn("_features", array_to_vector("_values"))

    def grow(n: int) -> DecisionTreeClassificationModel:
        bag = table.withColumn("_weight", bag_weight(F.col(track), F.lit(n), seed).cast("double")).filter("_weight > 0")
        one = RandomForestClassifier(labelCol="_index", featuresCol="_features", weightCol="_weight", numTrees=1, bootstrap=False, subsamplingRate=1.0, featureSubsetStrategy="sqrt", maxDepth=depth, seed=seed + n)
        return one.fit(bag).trees[0]

    with ThreadPoolExecutor(AT_ONCE) as pool:
        return BaggedForest(list(pool.map(inheritable_thread_target(tracks.sparkSession)(grow), range(1, trees + 1))), labels, features, seed)


def with_votes(forest: BaggedForest, rows: DataFrame) -> DataFrame:
    """Adds ``_votes``, the class that each tree gives, to rows with ``_values``; written, as what follows would be compiled together with all trees."""
    kept = rows.columns
    scored = rows.withColumn("_features", array_to_vector("_values"))
    for n, tree in enumerate(forest.trees, 1):
        scored = tree.setFeaturesCol("_features").setPredictionCol(f"_tree{n}").setRawPredictionCol("").setProbabilityCol("").transform(scored)
    votes = F.array(*[F.col(f"_tree{n}") for n in range(1, len(forest.trees) + 1)])
    return written(scored.select(*[c for c in kept if c != "_values"], votes.alias("_votes")), "votes")


def _unseen_votes(forest: BaggedForest, tracks: DataFrame, label: str, track: str) -> DataFrame:
    """(track, _label, tree, vote): votes of the trees whose bag lacks the track."""
    rows = with_votes(forest, _vectors(tracks, forest.labels, label, forest.features, track))
    each = rows.select(track, "_label", F.posexplode("_votes").alias("_at", "vote"))
    each = each.select(track, "_label", (F.col("_at") + 1).alias("tree"), F.col("vote").cast("int").alias("vote"))
    return each.filter(bag_weight(F.col(track), F.col("tree"), forest.seed) == 0)


def _winner(counts: list[Column]) -> Column:
    """Number of the class with most votes, the first of several; null without votes."""
    most = F.greatest(*counts) if len(counts) > 1 else counts[0]
    return F.when(most > 0, F.array_position(F.array(*counts), most).cast("int") - 1)


def _class_counts(forest: BaggedForest) -> list[Column]:
    return [F.count_if(F.col("vote") == i) for i in range(len(forest.labels.labels))]


def _named(forest: BaggedForest, number: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in forest.labels.labels]), number)


def _unseen(forest: BaggedForest, track: str) -> Column:
    """Places of the trees whose bag lacks the track, in order."""
    return F.filter(F.sequence(F.lit(0), F.lit(len(forest.trees) - 1)), lambda i: bag_weight(F.col(track), i + 1, forest.seed) == 0)


def _sums_by_trees(batches, trees: int, classes: int):
    """mapInArrow body: (class, votes, unseen trees) -> for each tree and class, how many tracks the trees so far get wrong, and how many they vote on."""
    wrong, n, seen = np.zeros((trees, classes), np.int64), np.zeros((trees, classes), np.int64), np.zeros(classes, bool)
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS):
            part = batch.slice(lo, _ROWS)
            index = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            votes = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(index), trees)
            unseen = part.column(2)
            row, at = np.repeat(np.arange(len(index)), pc.list_value_length(unseen).to_numpy(zero_copy_only=False)), unseen.flatten().to_numpy(zero_copy_only=False)
            counts = np.zeros((len(index), classes), np.int32)
            voted = np.full((len(index), trees), -1)
            voted[row, at] = votes[row, at]
            seen[index] = True
            for tree in range(trees):
                who = np.flatnonzero(voted[:, tree] >= 0)
                counts[who, voted[who, tree]] += 1
                some = counts.any(axis=1)
                n[tree] += np.bincount(index[some], minlength=classes)
                wrong[tree] += np.bincount(index[some & (counts.argmax(axis=1) != index)], minlength=classes)
    at, label = np.nonzero(np.broadcast_to(seen, n.shape))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(label, pa.int32()), pa.array(wrong[at, label]), pa.array(n[at, label])], names=["at", "class", "wrong", "n"])


def oob_predictions(forest: BaggedForest, tracks: DataFrame, label: str, track: str = "track_id") -> DataFrame:
    """(track, label, predicted): the class most voted for by trees that did not see the track; null if all did."""
    votes = _unseen_votes(forest, tracks, label, track)
    counts = votes.groupBy(track).agg(*[c.alias(f"_c{i}") for i, c in enumerate(_class_counts(forest))])
    winner = _winner([F.col(f"_c{i}") for i in range(len(forest.labels.labels))])
    won = counts.select(track, _named(forest, winner).alias("predicted"))
    rows = tracks.dropna(subset=[label, *forest.features]).select(track, F.col(label).cast("string").alias("label"))
    return rows.join(won, track, "left")


def oob_error_by_trees(forest: BaggedForest, tracks: DataFrame, label: str, track: str = "track_id") -> DataFrame:
    """(trees, label, error): wrong share of the first 1, 2, .. trees' votes on tracks they did not see, per class and for "all".

    Tracks count as soon as a tree can vote on them. Votes are summed up tree by tree
    in the task that holds the track, which passes on only sums per tree and class.
    """
    names, n = forest.labels.labels, len(forest.trees)
    rows = with_votes(forest, _vectors(tracks, forest.labels, label, forest.features, track).withColumn("_unseen", _unseen(forest, track)))
    sums = rows.select("_index", "_votes", "_unseen").mapInArrow(lambda it: _sums_by_trees(it, n, len(names)), "at int, class int, wrong bigint, n bigint")
    labelled = sums.groupBy("at", "class").agg(F.sum("wrong").alias("wrong"), F.sum("n").alias("n"))
    every = labelled.groupBy("at").agg(F.sum("wrong").alias("wrong"), F.sum("n").alias("n"))
    error = F.when(F.col("n") > 0, F.col("wrong") / F.col("n")).alias("error")
    trees = F.col("at") + 1
    each = labelled.select(trees.alias("trees"), _named(forest, F.col("class")).alias("label"), error)
    return each.union(every.select(trees.alias("trees"), F.lit("all").alias("label"), error))


def class_importance(forest: BaggedForest, tracks: DataFrame, label: str, track: str = "track_id", seed: int = 5) -> DataFrame:
    """(feature, label, loss, spread, scaled): accuracy that trees lose on tracks they did not see when a feature is dealt anew, per class and for "all".

    loss is the mean over trees, spread its standard error, scaled their ratio
    (null where the spread is 0). Each track meets another in a random order once,
    is written once as it is and once for each feature with the other's value, and
    all that is scored in one pass.
    """
    rows = _vectors(tracks, forest.labels, label, forest.features, track).withColumn("_key", F.xxhash64(track, F.lit(seed)))
    rows = written(numbered(rows, ["_key", track], "_n").withColumn("_unseen", _unseen(forest, track)), "importance-rows")  # hashed once, not for each copy
    count = rows.count()
    other = rows.select(F.pmod(F.col("_n") + 1, F.lit(max(count, 1))).alias("_n"), F.col("_values").alias("_other"))
    copies = rows.join(other, "_n").withColumn("_at", F.explode(F.sequence(F.lit(-1), F.lit(len(forest.features) - 1))))
    dealt = F.transform("_values", lambda x, i: F.when(i == F.col("_at"), F.get("_other", i)).otherwise(x))
    scored = with_votes(forest, copies.select("_label", "_index", "_at", "_unseen", dealt.alias("_values")))
    each = scored.select("_label", "_index", "_at", "_votes", F.explode("_unseen").alias("_tree")).withColumn("_vote", F.get("_votes", F.col("_tree")))
    right = each.groupBy("_tree", "_at", "_label").agg(F.count_if(F.col("_vote") == F.col("_index")).alias("right"), F.count(F.lit(1)).alias("n"))
    right = written(right, "importance-counts")
    both = right.union(right.groupBy("_tree", "_at").agg(F.sum("right").alias("right"), F.sum("n").alias("n")).select("_tree", "_at", F.lit("all").alias("_label"), "right", "n"))
    before = both.filter("_at < 0").select("_tree", "_label", (F.col("right") / F.col("n")).alias("before"))
    lost = both.filter("_at >= 0").join(before, ["_tree", "_label"]).withColumn("lost", F.col("before") - F.col("right") / F.col("n"))
    found = lost.groupBy("_at", "_label").agg(F.avg("lost").alias("loss"), (F.coalesce(F.stddev_samp("lost"), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("spread"))
    names = F.array(*[F.lit(x) for x in forest.features])
    return found.select(F.get(names, F.col("_at")).alias("feature"), F.col("_label").alias("label"), "loss", "spread", F.when(F.col("spread") > 0, F.col("loss") / F.col("spread")).alias("scaled"))

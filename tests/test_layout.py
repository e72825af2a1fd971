"""The layout of tracks against its definition, and what it is for; tables shared in a session."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import embed
from trackloom.sources import tables

CLIQUES = [(f"{side}{i}", f"{side}{j}", 1.0 if i + j < 5 else 0.5) for side in "ab" for i in range(6) for j in range(6) if i != j]
GRAPH = "src string, dst string, weight double"


def test_one_epoch_equals_numpy(spark):
    ids, negatives, seed = sorted({e[0] for e in CLIQUES}), 5, 3
    start = spark.createDataFrame([(t,) for t in ids], "track_id string").select("track_id", *[((embed._unit("track_id", F.lit(seed + i)) - 0.5) * 20).alias(f"v{i}") for i in (0, 1)]).toPandas().set_index("track_id")
    at = start.loc[ids].to_numpy()
    drawn = spark.range(len(ids)).select(F.col("id").alias("s"), F.explode(F.sequence(F.lit(1), F.lit(negatives))).alias("draw"))
    drawn = drawn.select("s", F.pmod(F.xxhash64("s", "draw", F.lit(seed), F.lit(0)), F.lit(len(ids))).alias("d")).collect()
    a, b = embed.curve_parameters(0.1)
    moves = np.zeros_like(at)
    for src, dst, weight in CLIQUES:
        s, d = ids.index(src), ids.index(dst)
        d2 = ((at[s] - at[d]) ** 2).sum()
        moves[s] += np.clip(-2 * a * b * d2 ** (b - 1) / (1 + a * d2**b) * weight * (at[s] - at[d]), -4, 4)
    for r in drawn:
        if r.s != r.d:
            d2 = ((at[r.s] - at[r.d]) ** 2).sum()
            moves[r.s] += np.clip(2 * b / ((0.001 + d2) * (1 + a * d2**b)) * (at[r.s] - at[r.d]), -4, 4)
    found = embed.layout(spark.createDataFrame(CLIQUES, GRAPH), epochs=1, negatives=negatives, seed=seed).toPandas().set_index("track_id").loc[ids].to_numpy()
    assert found == pytest.approx(at + np.clip(moves, -4, 4))


def test_linked_tracks_end_nearer(spark):
    graph = spark.createDataFrame(CLIQUES, GRAPH)
    found = embed.layout(graph).toPandas().set_index("track_id").sort_index()
    ids = sorted({e[0] for e in CLIQUES})
    assert list(found.index) == ids
    apart = np.linalg.norm(found.to_numpy()[:, None] - found.to_numpy()[None], axis=2)
    linked = np.array([[s != d and s[0] == d[0] for d in ids] for s in ids])
    unlinked = np.array([[s[0] != d[0] for d in ids] for s in ids])
    assert apart[linked].mean() < 0.7 * apart[unlinked].mean()
    assert embed.layout(spark.createDataFrame([], GRAPH), epochs=1).count() == 0


def test_session_table_is_built_once(spark):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for source in ("one", "one", "two"):
        assert tables.session_table(spark, "numbers", source, build).count() == 3
    assert len(built) == 2

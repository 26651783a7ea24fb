"""Blocks of vectors: few visits where vectors lie apart, and matrices in place of rows per pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from devprism.operators import blocks, density, neighbors
from test_bruteforce import dbscan, frame, l1


def test_vectors_visit_few_blocks(spark):
    x = np.random.default_rng(2).normal(size=(3000, 2))
    found = blocks.dealt(frame(spark, x).withColumn("w", F.lit(1)), 2, True, 100)
    assert len(found.names) >= 25
    sizes = [r["count"] for r in found.rows.groupBy("block").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) < 300
    met = blocks.visits(found.rows.select("block", "id", "x", "s"), found, 0.05)
    assert met.count() < 3000 * 4


def test_no_row_per_pair_of_vectors(spark):
    x = np.random.default_rng(3).normal(size=(50, 5))
    plan = neighbors.knn_join(frame(spark, x), 3, 5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Bucketizer" not in plan
    points = frame(spark, x).withColumn("w", F.lit(1).cast("bigint"))
    assert "Join" not in neighbors.eps_join(points, 1.0, 5)._jdf.queryExecution().executedPlan().toString()


def test_forest_connects_what_the_graph_does():
    rng = np.random.default_rng(4)
    for _ in range(20):
        weight = rng.integers(0, 9, (7, 11))
        weight[rng.random(weight.shape) < 0.6] = 6
        weight = np.minimum(weight, 6)
        u, v, w = blocks.forest(weight, 6)
        edges = [(i, 7 + j, weight[i, j]) for i in range(7) for j in range(11) if weight[i, j] < 6]

        def parts(some, level):
            label = list(range(18))
            for _ in range(18):
                for a, b, x in some:
                    if x <= level:
                        label[a] = label[b] = min(label[a], label[b])
            return label

        for level in range(6):
            assert parts(edges, level) == parts(list(zip(u, v, w)), level)


@pytest.mark.parametrize("width", [3, 20])
def test_grid_beyond_two_dimensions(spark, width):
    rng = np.random.default_rng(6)
    x = np.round(np.r_[rng.normal(0, 0.1, (60, width)), rng.normal(1, 0.1, (60, width)), rng.normal(0.5, 0.6, (40, width))], 2)
    x[:10] = x[0]
    radii, least = ([0.305, 0.455, 0.605] if width == 3 else [2.005, 2.405, 3.005]), [3, 8]
    got = {}
    model = density.DensityModel(frame(spark, x), width, radii, least)
    model.blocks = blocks.dealt(model.vectors, width, False, 16)
    model.cores = model._block_cores()
    for r in model.weighted_clusters().collect():
        got[r.fit, tuple(r.x)] = r.cluster
    assert (np.abs(l1(x)[None] - np.array(radii)[:, None, None]) > 1e-9).all()
    for j, m in enumerate(least):
        for i, e in enumerate(radii):
            core, want = dbscan(x, e, m)
            fit = j * len(radii) + i
            assert all(got[fit, tuple(p)] == (int(c) * 3 + 1 if c >= 0 else -1) for p, c in zip(x, want))
            assert i == 0 or core.any()

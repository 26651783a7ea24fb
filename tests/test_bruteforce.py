"""Neighbor joins, density clustering and silhouette against plain NumPy on small fixtures.

The fixtures hold copies of one point for a third of all rows, points at exactly the radius, and
splits of crowded cells are forced.
"""

import numpy as np
import pytest
from pyspark.sql import functions as F

from devprism.operators import components, density, neighbors, silhouette, spectral, vectors


def fixture(n=240, width=3, seed=7):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, width)) * 0.8, 2)
    x[: n // 3] = x[0]
    x[n // 3] = x[0] + np.eye(width)[0] * 0.5
    order = rng.permutation(n)
    return x[order]


def frame(spark, x, partitions=4):
    rows = [(int(i) * 3 + 1, [float(v) for v in p]) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, x array<double>").repartition(partitions)


def l1(x):
    return np.abs(x[:, None, :] - x[None, :, :]).sum(-1)


@pytest.mark.parametrize("width,cell_rows", [(1, 4096), (2, 8), (3, 4096), (3, 8), (20, 16)])
def test_radius_join(spark, width, cell_rows):
    x = fixture(width=width)
    eps = 0.5 if width < 20 else 9.0
    points = frame(spark, x).withColumn("w", F.lit(1).cast("bigint"))
    got = neighbors.eps_join(points, eps, width, cell_rows=cell_rows).collect()
    pairs = [(r.a, r.b) for r in got]
    dist = l1(x)
    sure = {(i * 3 + 1, j * 3 + 1) for i, j in zip(*np.where(np.triu(dist <= eps - 1e-9, 1)))}
    possible = {(i * 3 + 1, j * 3 + 1) for i, j in zip(*np.where(np.triu(dist <= eps + 1e-9, 1)))}
    assert len(pairs) == len(set(pairs)) and sure <= set(pairs) <= possible


@pytest.mark.parametrize("width,k,cell_rows", [(2, 5, 20), (3, 4, 4096), (20, 3, 30)])
def test_nearest(spark, width, k, cell_rows):
    x = fixture(width=width)
    got = {}
    for r in neighbors.knn_join(frame(spark, x), k, width, cell_rows=cell_rows).collect():
        got.setdefault(r.id, {})[r["rank"]] = (r.neighbor, r.dist)
    dist = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    for i in range(len(x)):
        mine = got[i * 3 + 1]
        assert sorted(mine) == list(range(1, k + 1))
        others = sorted((round(dist[i, j], 12), j * 3 + 1) for j in range(len(x)) if j != i)[:k]
        assert [mine[r][1] for r in sorted(mine)] == pytest.approx([d for d, _ in others])
        if others[0][0] == 0 and others[k - 1][0] == 0:
            assert [mine[r][0] for r in sorted(mine)] == [n for _, n in others]


def test_fewer_points_than_neighbors(spark):
    x = np.array([[0.0, 0.0], [1.0, 0.0], [1.0, 0.0]])
    got = neighbors.knn_join(frame(spark, x), 5, 2).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == {1: 2, 4: 2, 7: 2}


def dbscan(x, eps, least):
    """Textbook version; a border point goes to the first cluster in id order."""
    near = l1(x) <= eps
    core = near.sum(1) >= least
    label = np.full(len(x), -1)
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack, label[i] = [i], i
            while stack:
                for j in np.where(near[stack.pop()])[0]:
                    if core[j] and label[j] < 0:
                        label[j] = i
                        stack.append(j)
    out = label.copy()
    for i in range(len(x)):
        if not core[i]:
            hits = label[near[i] & core]
            out[i] = hits.min() if len(hits) else -1
    return core, out


@pytest.mark.parametrize("eps,least", [(0.3, 4), (0.5, 5), (0.9, 12), (0.05, 100)])
def test_density(spark, eps, least):
    x = fixture(width=2)
    core, label = dbscan(x, eps, least)
    expected = {i * 3 + 1: (int(c) * 3 + 1 if c >= 0 else -1) for i, c in enumerate(label)}
    assert {r.id: r.cluster for r in density.density_cluster(frame(spark, x), eps, least, 2).collect()} == expected
    flags = {r.id: r.is_core for r in density.core_flags(frame(spark, x, 16), eps, least, 2).collect()}
    assert flags == {i * 3 + 1: bool(c) for i, c in enumerate(core)}


@pytest.mark.parametrize("width,eps,least", [(1, 0.2, 6), (3, 0.7, 5), (20, 9.0, 4)])
def test_density_in_other_widths_with_crowded_cells(spark, monkeypatch, width, eps, least):
    monkeypatch.setattr(density, "CELL_ROWS", 3)
    x = fixture(width=width)
    core, label = dbscan(x, eps, least)
    assert 0 < core.sum() < len(x)
    expected = {i * 3 + 1: (int(c) * 3 + 1 if c >= 0 else -1) for i, c in enumerate(label)}
    assert {r.id: r.cluster for r in density.density_cluster(frame(spark, x), eps, least, width).collect()} == expected


def test_density_grid(spark):
    x = fixture(150, 2)
    radii, least = [0.2, 0.35, 0.6], [3, 6, 80]
    model = density.DensityModel(frame(spark, x), 2, radii, least)
    members = model.points.join(model.weighted_clusters().select("fit", "x", "cluster"), "x")
    got = {(r.eps, r.min_samples, r.id): r.cluster for r in model.named(members).collect()}
    counts = {(r.eps, r.min_samples): r.cores for r in model.core_counts().collect()}
    for e in radii:
        for m in least:
            core, label = dbscan(x, e, m)
            assert counts[e, m] == core.sum()
            assert [got[e, m, i * 3 + 1] for i in range(len(x))] == [int(c) * 3 + 1 if c >= 0 else -1 for c in label]


def test_cluster_numbers(spark):
    df = spark.createDataFrame([(1, 7), (2, -1), (3, 4), (4, 7)], "id bigint, cluster bigint")
    assert {r.id: r.cluster for r in density.number_clusters(df).collect()} == {1: 1, 2: -1, 3: 0, 4: 1}


def mean_silhouette(x, label):
    dist, scores = l1(x), []
    for i in range(len(x)):
        own = (label == label[i]) & (np.arange(len(x)) != i)
        if not own.any():
            scores.append(0.0)
            continue
        a = dist[i, own].mean()
        b = min(dist[i, label == c].mean() for c in set(label) if c != label[i])
        scores.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return np.mean(scores)


@pytest.mark.parametrize("buckets", [1, 4, 64])
def test_silhouette(spark, buckets):
    x = fixture(180, 3)
    rng = np.random.default_rng(1)
    fits = {0: rng.integers(-1, 4, len(x)), 1: np.r_[5, rng.integers(0, 2, len(x) - 1)], 2: np.zeros(len(x), int)}
    rows = [(f, i, int(c), [float(v) for v in x[i]], 1) for f, cs in fits.items() for i, c in enumerate(cs)]
    labels = spark.createDataFrame(rows, "fit int, id bigint, cluster bigint, x array<double>, w bigint")
    got = {r.fit: (r.clusters, r.silhouette) for r in silhouette.silhouette_l1(labels, buckets).collect()}
    assert set(got) == {0, 1}
    for f in got:
        assert got[f][0] == len(set(fits[f])) and got[f][1] == pytest.approx(mean_silhouette(x, fits[f]), abs=1e-9)


def test_weighted_silhouette(spark):
    x = fixture(120, 2)
    label = (x[:, 0] > 0.3).astype(int)
    points = frame(spark, x)
    marks = spark.createDataFrame([(i * 3 + 1, int(c)) for i, c in enumerate(label)], "id bigint, cluster bigint")
    merged = vectors.distinct_points(points).join(marks, "id").withColumn("fit", F.lit(0))
    got = silhouette.silhouette_l1(merged).first().silhouette
    assert got == pytest.approx(mean_silhouette(x, label), abs=1e-9)


def test_best_config(spark):
    scores = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7), (3, -1.0)], "fit int, silhouette double")
    assert silhouette.best_config(scores, ["fit"]).first().fit == 1
    assert silhouette.best_config(scores.filter("fit = 3"), ["fit"]).count() == 0


def test_components(spark):
    chains = [(g, i + 100 * c, i + 1 + 100 * c) for g in (0, 1) for c in range(3) for i in range(20)]
    star = [(2, 5, i) for i in range(6, 60)] + [(2, 4, 59)]
    edges = spark.createDataFrame(chains + star, "g int, u bigint, v bigint")
    got = {(r.g, r.id): r.label for r in components.connected_components(edges).collect()}
    assert all(got[g, n] == 100 * (n // 100) for g in (0, 1) for n in (0, 20, 113, 220))
    assert {v for (g, _), v in got.items() if g == 2} == {4} and len(got) == 126 + 56


def test_thinned_edges_keep_components_at_every_level(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), int(u), int(v), int(l)) for g, u, v, l in zip(rng.integers(0, 2, 600), rng.integers(0, 60, 600), rng.integers(0, 60, 600), rng.integers(0, 4, 600))]
    edges = spark.createDataFrame(rows, "g int, u bigint, v bigint, level int").repartition(3)
    thin = [tuple(r) for r in components.thin_edges(edges).collect()]
    assert len(thin) < 400

    def parts(es, g, level):
        label = list(range(60))
        for _ in range(60):
            for eg, u, v, l in es:
                if eg == g and l <= level:
                    label[u] = label[v] = min(label[u], label[v])
        return label

    for g in (0, 1):
        for level in range(4):
            assert parts(thin, g, level) == parts(rows, g, level)


def test_spectral_labels(spark):
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(0, 0.1, (40, 2)), rng.normal(5, 0.1, (40, 2))]
    points = frame(spark, x)
    graph = spectral.affinity_graph(points, 2, 6)
    assert graph.filter("src >= dst or weight not in (0.5, 1.0)").count() == 0
    labels = spectral.spectral_cluster(points, graph, 2)
    assert labels.count() == 80 and labels.select("cluster").distinct().count() <= 3


@pytest.mark.parametrize("partitions", [1, 16])
def test_same_result_on_any_partitioning(spark, partitions):
    x = fixture(150, 2)
    got = {r.id: r.cluster for r in density.density_cluster(frame(spark, x, partitions), 0.4, 5, 2).collect()}
    assert got == {r.id: r.cluster for r in density.density_cluster(frame(spark, x, 3), 0.4, 5, 2).collect()}

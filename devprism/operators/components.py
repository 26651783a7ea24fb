"""Connected components of many edge sets at once, by alternating star operations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from devprism.runtime import cut_lineage


def _oriented(edges: DataFrame) -> DataFrame:
    """``(g, u, v)`` with ``u > v``, each edge once."""
    kept = edges.filter(F.col("u") != F.col("v"))
    return kept.select("g", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbor of a node to the smallest node around it."""
    both = edges.unionByName(edges.select("g", F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("g", "u").agg(F.min("v").alias("m"))
    lowest = lowest.select("g", "u", F.least("u", "m").alias("m"))
    linked = both.filter("v > u").join(lowest, ["g", "u"])
    return linked.select("g", F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbors to the smallest of them."""
    lowest = edges.groupBy("g", "u").agg(F.min("v").alias("m"))
    linked = edges.join(lowest, ["g", "u"]).filter("v <> m")
    moved = linked.select("g", F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.withColumnRenamed("m", "v")).distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("g", "u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``(g, id, label)`` for every node of ``edges(g, u, v)``; the label is the smallest id.

    Each round is two joins on a node whose other side has one row per node; the minimum itself
    is combined map-side, so a node with very many neighbors is no hot task. The number of rounds
    grows with the logarithm of the longest path. The driver only compares fingerprints.
    """
    current = cut_lineage(_oriented(edges))
    before = _fingerprint(current)
    for _ in range(max_rounds):
        current = cut_lineage(_small_star(_large_star(current)))
        after = _fingerprint(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = current.select("g", F.col("v").alias("id"), F.col("v").alias("label")).distinct()
    return current.select("g", F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots)


def _forest(us: np.ndarray, vs: np.ndarray, order: np.ndarray) -> list[int]:
    """Positions of the edges that join two trees, lowest level first."""
    nodes, places = np.unique(np.concatenate([us, vs]), return_inverse=True)
    left, right = places[: len(us)].tolist(), places[len(us) :].tolist()
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for e in order.tolist():
        a, b = root(left[e]), root(right[e])
        if a != b:
            parent[a] = b
            kept.append(e)
    return kept


def thin_edges(edges: DataFrame) -> DataFrame:
    """Drop edges ``(g, u, v, level)`` that other edges of the same batch make redundant.

    Within a batch, an edge whose ends are already joined by edges of no higher level changes no
    component at any level. Memory is one Arrow batch, and the result is exact whatever the split.
    """

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby("g", sort=False):
                order = np.argsort(part["level"].to_numpy(), kind="stable")
                kept = _forest(part["u"].to_numpy(), part["v"].to_numpy(), order)
                yield part.iloc[kept]

    return edges.select("g", "u", "v", "level").mapInPandas(shrink, edges.select("g", "u", "v", "level").schema)

"""Exact neighbor joins: all pairs within a Manhattan radius, and k nearest by Euclidean distance."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from devprism.functions.numbers import UNROLL, add_up, l1_distance
from devprism.operators import blocks
from devprism.operators.blocks import sign_patterns, widest
from devprism.operators.vectors import distinct_points
from devprism.runtime import broadcast_if_small, land

CELL_ROWS = 4096  # a grid cell with more rows is split


def signed_sum(x: Column, signs: tuple[int, ...]) -> Column:
    """Sum of ``x`` under ``signs``; it never moves further than the Manhattan distance does."""
    if len(signs) <= UNROLL:
        return add_up([x[i] if s > 0 else -x[i] for i, s in enumerate(signs)])
    weights = F.array(*[F.lit(float(s)) for s in signs])
    return F.aggregate(F.zip_with(x, weights, lambda v, w: v * w), F.lit(0.0), lambda t, v: t + v)


def eps_join(points: DataFrame, eps: float, width: int, cell_rows: int | None = None) -> DataFrame:
    """``(a, b, wa, wb, dist)`` with ``a < b`` for all pairs of ``points(id, x, w)`` within ``eps``.

    A sum of all coordinates with any signs differs by no more than the distance, and spreads far
    wider than one coordinate. So rows meet on the grid cell of the two or three widest such sums
    and on half of the neighboring cells; the other half is the same pairs seen from the other
    side. A crowded cell is split: its rows get one of several parts and the rows that look for it
    visit every part, so no task holds a whole crowded cell. The remaining sums weed out most
    meetings before a distance is computed. Beyond two dimensions cells hold few rows, and blocks of rows are compared
    as matrices instead.
    """
    if width > 2:
        return blocks.within(points, eps, width, cell_rows)
    cell_rows = cell_rows or CELL_ROWS
    patterns = sign_patterns(width)
    sums = points.select("id", "x", "w", F.array(*[signed_sum(F.col("x"), s) for s in patterns]).alias("s"))
    axes = widest(sums, "s", len(patterns))[: min(3, len(patterns))]
    side = float(eps) * (1 + 1e-9) + 1e-12  # rounding must not move a neighbor two cells away
    names = [f"c{i}" for i in range(len(axes))]
    rows = sums.withColumns({n: F.floor(F.col("s")[d] / F.lit(side)) for n, d in zip(names, axes)})

    crowded = rows.groupBy(*names).agg(F.count("*").alias("n")).filter(F.col("n") > cell_rows)
    parts = broadcast_if_small(crowded.select(*names, F.ceil(F.col("n") / cell_rows).cast("int").alias("parts")))
    split = F.coalesce("parts", F.lit(1))

    build = rows.join(parts, names, "left").select(
        *names, F.pmod(F.xxhash64("id"), split).cast("int").alias("part"),
        F.col("id").alias("b_id"), F.col("x").alias("b_x"), F.col("w").alias("b_w"), F.col("s").alias("b_s"),
    )
    forward = [o for o in product((-1, 0, 1), repeat=len(axes)) if o >= (0,) * len(axes)]
    visits = F.array(
        *[
            F.struct(
                *[(F.col(n) + step).alias(n) for n, step in zip(names, offset)],
                F.lit(not any(offset)).alias("same"),
            )
            for offset in forward
        ]
    )
    probe = rows.select("id", "x", "w", "s", F.explode(visits).alias("v")).select("id", "x", "w", "s", "v.*")
    probe = probe.join(parts, names, "left").select(
        *names, "same", "id", "x", "w", "s", F.explode(F.sequence(F.lit(0), split - 1)).alias("part")
    )
    slack = side + 1e-9
    close = [F.abs(F.col("s")[i] - F.col("b_s")[i]) <= slack for i in range(len(patterns))]
    near = probe.join(build, [*names, "part"]).filter(
        reduce(lambda p, q: p & q, close, ~F.col("same") | (F.col("id") < F.col("b_id")))
    )
    dist = l1_distance(F.col("x"), F.col("b_x"), width)
    first = F.col("id") < F.col("b_id")
    return near.withColumn("dist", dist).filter(F.col("dist") <= eps).select(
        F.least("id", "b_id").alias("a"),
        F.greatest("id", "b_id").alias("b"),
        F.when(first, F.col("w")).otherwise(F.col("b_w")).alias("wa"),
        F.when(first, F.col("b_w")).otherwise(F.col("w")).alias("wb"),
        "dist",
    )


def knn_join(points: DataFrame, k: int, width: int, cell_rows: int | None = None) -> DataFrame:
    """``(id, neighbor, dist, rank)``: exactly ``k`` nearest other rows, ties by the lower id.

    Equal vectors are one row; only their first ``k + 1`` ids can ever be neighbors. Vectors are dealt over blocks, those
    of the own block bound the distance of the k-th, and only blocks within that are visited, whose vectors
    are compared as matrices. ``cell_rows`` sets the vectors of a block; without it they follow from their number.
    """
    vectors = land(distinct_points(points.select("id", "x")), "knn_vectors")
    lowest = Window.partitionBy("x").orderBy("id")
    first_ids = points.select("id", "x").withColumn("r", F.row_number().over(lowest)).filter(F.col("r") <= k + 1)
    copies = first_ids.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids"))

    # A vector's own row stays in, at distance 0, for the sake of its copies.
    near = blocks.nearest(vectors, k + 1, width, cell_rows)
    best = Window.partitionBy("v").orderBy("dist", "o")
    short = near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).select("v", "o", "dist")

    ids = vectors.join(copies, "x").select(F.col("id").alias("o"), "ids")
    listed = short.join(ids, "o").select("v", "dist", F.explode("ids").alias("neighbor"))
    ordered = Window.partitionBy("v").orderBy("dist", "neighbor")
    top = listed.withColumn("r", F.row_number().over(ordered)).filter(F.col("r") <= k + 1)
    entry = F.struct("dist", "neighbor")
    lists = top.groupBy("v").agg(F.array_sort(F.collect_list(entry)).alias("near"))
    by_vector = vectors.select(F.col("id").alias("v"), "x").join(lists, "v").select("x", "near")

    own = F.filter(F.col("near"), lambda e: e["neighbor"] != F.col("id"))
    members = points.select("id", "x").join(by_vector, "x").select("id", F.slice(own, 1, k).alias("near"))
    flat = members.select("id", F.posexplode("near").alias("pos", "e"))
    return flat.select("id", F.col("e.neighbor").alias("neighbor"), F.col("e.dist").alias("dist"), (F.col("pos") + 1).alias("rank"))

"""Pearson correlation of all feature pairs, and a rule that picks uncorrelated features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long table ``(a, b, r)`` for ``a`` before ``b`` in ``cols``, and the diagonal.

    Each row is turned into its own feature pairs and summed up map-side, so only one partial
    aggregate per pair and task is shuffled. A pair counts only the rows where both values are
    present; a pair with a constant side has no correlation.
    """
    values = F.array(*[F.col(c).cast("double") for c in cols])
    first = df.select(values.alias("v")).select("v", F.posexplode("v").alias("i", "x"))
    rest = F.slice("v", F.col("i") + 1, F.lit(len(cols)))
    pairs = first.select("i", "x", F.posexplode(rest).alias("step", "y"))
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    pairs = pairs.withColumns({"x": F.when(both, F.col("x")), "y": F.when(both, F.col("y"))})
    moments = pairs.groupBy("i", "step").agg(
        F.covar_pop("x", "y").alias("cov"),
        (F.stddev_pop("x") * F.stddev_pop("y")).alias("scale"),
        ((F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))).alias("varies"),
    )
    names = F.array(*[F.lit(c) for c in cols])
    return moments.select(
        names[F.col("i")].alias("a"),
        names[F.col("i") + F.col("step")].alias("b"),
        F.when(F.col("varies"), F.try_divide(F.col("cov"), F.col("scale"))).alias("r"),
    )


def select_uncorrelated(matrix: DataFrame, cols: Sequence[str], threshold: float = 0.8) -> list[str]:
    """Walk ``cols`` in order and keep a feature unless it correlates too strongly with a kept one.

    ``matrix`` is the output of :func:`correlation_matrix`: features squared, whatever the data size.
    """
    strong = matrix.filter((F.col("a") != F.col("b")) & (F.abs("r") >= threshold))
    linked = {frozenset((row.a, row.b)) for row in strong.collect()}
    kept: list[str] = []
    for name in cols:
        if not any(frozenset((name, other)) in linked for other in kept):
            kept.append(name)
    return kept

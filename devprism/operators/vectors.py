"""Feature matrices as rows ``(id, x)``: scaling, 2-D projection, cluster profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """z-scores with the population deviation; a constant column becomes 0.

    Mean and deviation of all columns are one row, read as a scalar subquery.
    """
    moments = [
        F.struct(
            F.avg(c).alias("mean"),
            F.when(F.min(c) < F.max(c), F.stddev_pop(c)).alias("deviation"),
        ).alias(f"s{i}")
        for i, c in enumerate(cols)
    ]
    stats = df.agg(F.struct(*moments).alias("stats")).scalar()
    scaled = {
        c: F.coalesce(
            F.try_divide(F.col(c).cast("double") - F.col(f"_stats.s{i}.mean"), F.col(f"_stats.s{i}.deviation")),
            F.lit(0.0),
        )
        for i, c in enumerate(cols)
    }
    return df.withColumn("_stats", stats).withColumns(scaled).drop("_stats")


def load_matrices(
    all_features: DataFrame, commit_features: DataFrame, key: str = "author"
) -> tuple[DataFrame, DataFrame]:
    """The two standardized matrices: all features, and commit features without incomplete rows."""
    complete = commit_features.dropna("any")
    numeric = lambda df: [c for c in df.columns if c != key]
    return standardize(all_features, numeric(all_features)), standardize(complete, numeric(complete))


def to_points(df: DataFrame, id: str, cols: Sequence[str]) -> DataFrame:
    return df.select(F.col(id).alias("id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x"))


def distinct_points(points: DataFrame) -> DataFrame:
    """One row per different vector: smallest id, vector, number of copies.

    Copies are merged map-side, so a vector that a third of all rows share is one row from here
    on and its copies never meet as pairs.
    """
    return points.groupBy("x").agg(F.min("id").alias("id"), F.count("*").alias("w")).select("id", "x", "w")


def cluster_profile(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("cluster",)) -> DataFrame:
    """Mean of every feature per cluster."""
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])


def project_2d(points: DataFrame) -> DataFrame:
    """First two principal components, ``(id, x1, x2)``; signs are arbitrary."""
    vectors = points.select("id", array_to_vector("x").alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="plane").fit(vectors)
    plane = vector_to_array(F.col("plane"))
    return model.transform(vectors).select("id", plane[0].alias("x1"), plane[1].alias("x2"))

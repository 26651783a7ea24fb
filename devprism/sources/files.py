"""Delimited project files, found by walking a folder tree."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from devprism.functions.numbers import nan_to_null
from devprism.operators.features import MEAN_METRICS
from devprism.operators.mining import drop_index_columns

# The endings of the four files a project consists of, and their separators.
KINDS = {"commitsID.csv": "\t", "input.csv": ",", "input_EB.csv": ",", "failures.csv": "\t"}


def read_delimited(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    types: dict[str, str] | None = None,
    multi_line: bool = True,
    **options: object,
) -> DataFrame:
    """Header file with quoted fields; columns in ``types`` are cast by name.

    Bodies may span lines, which keeps Spark from splitting a file; pass ``multi_line=False`` for
    files of one line per row.
    """
    reader = spark.read.options(header=True, sep=sep, multiLine=multi_line, escape='"', **options)
    df = drop_index_columns(reader.csv(path))
    casts = {c: F.col(f"`{c}`").try_cast(t) for c, t in (types or {}).items() if c in df.columns}
    return df.withColumns(casts) if casts else df


def read_tsv(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    return read_delimited(spark, path, "\t", types)


def read_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    return read_delimited(spark, path, ",", types)


def read_scsv(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    return read_delimited(spark, path, ";", types)


@dataclass(frozen=True)
class ProjectTree:
    """The four tables of all complete projects, each with a ``project`` column."""

    commit_ids: DataFrame
    bug: DataFrame
    bug_eb: DataFrame
    failures: DataFrame


def project_folders(spark: SparkSession, root: str) -> DataFrame:
    """Folders that hold all four kinds of file. Only the listing is read, no file content."""
    listing = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.csv")
    path = F.col("path")
    kind = F.lit(None).cast("string")
    for ending in KINDS:
        kind = F.when(path.endswith(ending), F.lit(ending)).otherwise(kind)
    files = listing.load(root).select(
        F.regexp_replace(path, "/[^/]*$", "").alias("folder"), kind.alias("kind")
    )
    complete = files.groupBy("folder").agg(F.count_distinct("kind").alias("kinds"))
    return complete.filter(F.col("kinds") == len(KINDS)).select("folder")


def _headers(spark: SparkSession, root: str, ending: str, complete: DataFrame) -> list[tuple[str, list[str]]]:
    """Each different first line of the complete projects' files of one kind, with the files that have it.

    One row per project file reaches the driver, as many as there are projects to name in a scan.
    """
    lines = spark.read.options(recursiveFileLookup=True, pathGlobFilter=f"*{ending}").text(root)
    named = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")
    first = named.filter("at = 0").groupBy("path").agg(F.first("value").alias("header"))
    folder = F.regexp_replace("path", "/[^/]*$", "").alias("folder")
    kept = first.select("path", "header", folder).join(complete, "folder", "left_semi")
    grouped = kept.groupBy("header").agg(F.collect_list("path").alias("paths")).orderBy("header")
    return [(r["header"], r["paths"]) for r in grouped.collect()]


def clean_metrics(df: DataFrame) -> DataFrame:
    """Metrics as numbers: ``fix`` and ``bug`` may be written as words or digits, NaN means no value."""

    def number(name: str) -> Column:
        word = F.lower(F.trim(F.col(name).cast("string")))
        return F.when(word == "true", 1.0).when(word == "false", 0.0).otherwise(word.try_cast("double"))

    named = {c: number(c) for c in (*MEAN_METRICS, "fix") if c in df.columns}
    df = nan_to_null(df.withColumns(named), list(named)) if named else df
    return df.withColumn("bug", number("bug").cast("int")) if "bug" in df.columns else df


def read_project_tree(spark: SparkSession, root: str) -> ProjectTree:
    """Read each kind of file and keep the complete projects.

    Projects may order their columns differently or lack some: files with the same header line are one
    scan, and the scans are put together by column name.
    """
    folders = project_folders(spark, root)

    def read(ending: str) -> DataFrame:
        parts = []
        for _, paths in _headers(spark, root, ending, folders):
            reader = spark.read.options(header=True, sep=KINDS[ending], escape='"')
            rows = drop_index_columns(reader.csv(paths)).withColumn("_path", F.col("_metadata.file_path"))
            parts.append(rows.withColumn("project", F.regexp_extract("_path", "([^/]+)/[^/]*$", 1)).drop("_path"))
        if not parts:
            return spark.createDataFrame([], "project string, transactionid string, `issue.names` string")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

    failures = read("failures.csv")
    names = [F.col(f"`{c}`") for c in ("issue.names", "issue_names") if c in failures.columns]
    return ProjectTree(
        read("commitsID.csv"),
        clean_metrics(read("input.csv")),
        clean_metrics(read("input_EB.csv")),
        failures.select("project", F.coalesce(*names).alias("issue_names")),
    )

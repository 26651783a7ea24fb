"""What the iterative operators need from the cluster: a shared folder and size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster the folder has to be
    one that every executor can read after another executor is lost.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="devprism-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows land in the shared folder and the plan restarts from them."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def land(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike a checkpoint the table keeps column pruning, filter push-down and size statistics, so
    it is the better choice for a table that several later plans read in part.
    """
    path = f"{shared_folder(df.sparkSession)}/devprism/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_most(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has no more than ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Broadcast hint behind a row count; above the bound the join shuffles as usual."""
    return F.broadcast(df) if at_most(df, rows) else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition rows by ``key`` if their input has fewer files than there are cores.

    For work that costs much per row on a few large row groups. A table of many files is already
    spread by its scan and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition rows that cost much each, however few bytes they are.

    Run-time coalescing goes by bytes and would leave a short table that a join multiplies to one task.
    """
    spark = df.sparkSession
    wanted = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(wanted, *keys)


def in_order(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema, *order: str) -> DataFrame:
    """Rows of a table of summaries, or of checked length, pass one task batch by batch, sorted if asked."""
    rows = df.repartition(1)
    return (rows.sortWithinPartitions(*order) if order else rows).mapInPandas(run, schema)


def summarised(df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema) -> DataFrame:
    """``run`` on a whole table of summaries, such as topics by topics, in one task; no rows stay none."""

    def at_once(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            yield run(pd.concat(held, ignore_index=True))

    return in_order(df, at_once, schema)

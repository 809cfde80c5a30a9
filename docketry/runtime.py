"""What every operator needs from the session: tables, checkpoints, sizes."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and work tables.

    A cluster names it in ``spark.checkpoint.dir``; only a session without that
    setting (a test on one machine) gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = tempfile.mkdtemp(prefix="docketry-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` by a copy in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rows_up_to(df: DataFrame, bound: int) -> list | None:
    """The rows of ``df`` if there are at most ``bound``, else None.

    Only ``bound + 1`` rows ever reach the driver, so this is the size check to
    make before something is broadcast.
    """
    rows = df.limit(bound + 1).collect()
    return None if len(rows) > bound else rows


def spread(df: DataFrame, *by: str, per: int | None = None) -> DataFrame:
    """Rows spread evenly over the shuffle partitions (``per`` overrides how many)."""
    n = per or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *[F.col(c) for c in by]) if by else df.repartition(n)


def widen(df: DataFrame) -> DataFrame:
    """``df`` on at least as many partitions as there are cores, for costly passes over few files."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= n else df.repartition(n)


def head_table(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of an ordered ``df`` as a literal table.

    Below a Python function a limit becomes a sort of all rows; as the end of a
    plan it is a bounded heap in each task. ``n`` must be small: the rows pass
    through the driver.
    """
    return df.sparkSession.createDataFrame(df.limit(n).collect(), df.schema)

"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A single-node session for tests and the benchmark.

    On a cluster the session comes from spark-submit; no operator sets
    configuration of its own.
    """
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("papertally")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        # call-site capture costs a round trip per column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, which driver and
    executors share.

    Where none is named a session on one machine (tests) gets a temporary one;
    on a cluster that would lose data, so it is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError(
            "spark.checkpoint.dir must name a folder that the driver and all executors share"
        )
    global _TEMPORARY
    if _TEMPORARY is None:
        _TEMPORARY = tempfile.mkdtemp(prefix="papertally-")
    return _TEMPORARY


_TEMPORARY: str | None = None


def shared_path(spark: SparkSession) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_folder(spark)}/papertally/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table written to the shared folder (this is an action).

    For results that several later steps read: they are computed once, survive
    the loss of executors, and later plans know their size.
    """
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores when it is read in fewer pieces than there are.

    A small table in one file is one task, whatever is computed from its rows.
    A table of many files stays as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

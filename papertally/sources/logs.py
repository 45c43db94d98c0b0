"""Log-file inventory and the call log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papertally.functions.text import log_namespace
from papertally.operators.reports import call_log_rows


def file_names(spark: SparkSession, folder: str) -> DataFrame:
    """(name) of the files in a folder; contents are not read."""
    listed = spark.read.format("binaryFile").load(folder).select("path")
    return listed.select(F.element_at(F.split("path", "/"), -1).alias("name"))


def log_inventory(names: DataFrame) -> DataFrame:
    """(namespace, files): log files per text before the first ``.log``."""
    return (
        names.select(log_namespace(F.col("name")).alias("namespace"))
        .where(F.col("namespace").isNotNull())
        .groupBy("namespace")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def append_calls(calls: DataFrame, path: str) -> None:
    """Append call rows to the log, one folder per day (an action)."""
    rows = call_log_rows(calls).withColumn("day", F.col("creation").cast("date"))
    rows.write.mode("append").partitionBy("day").parquet(path)


def rewrite_without(rows: DataFrame, path: str) -> None:
    """Write what a purge leaves to a new path (an action)."""
    rows.write.mode("overwrite").parquet(path)

"""Sheets as CSV: the first row is the header."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def sheet_header(spark: SparkSession, path: str) -> list[str]:
    """Header cells of a sheet. Reads the first line only."""
    first = spark.read.option("header", False).option("inferSchema", False).csv(path).head()
    return [c if c is not None else "" for c in first] if first else []


def read_sheet(spark: SparkSession, path: str, header: Sequence[str] | None = None) -> DataFrame:
    """All cells as text. Short rows are padded with null, extra cells dropped;
    of columns with one name the last counts.

    Give ``header`` when it is known: it saves the look at the first line.
    """
    names = list(header) if header is not None else sheet_header(spark, path)
    unique = [f"_c{i}" for i in range(len(names))]
    schema = StructType([StructField(n, StringType()) for n in unique])
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    last = {name: i for i, name in enumerate(names)}
    return rows.select(*[F.col(unique[last[n]]).alias(n) for n in dict.fromkeys(names)])


def write_sheet(df: DataFrame, path: str) -> None:
    """Write rows under a header, missing values as empty cells (an action)."""
    text = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    text.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)

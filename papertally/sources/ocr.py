"""Word boxes from the tab-separated output of an OCR run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papertally.functions.numbers import try_double

# Columns of the file, level of a word, lowest confidence.
COLUMNS = [
    "level", "page_num", "block_num", "par_num", "line_num", "word_num",
    "left", "top", "width", "height", "conf", "text",
]
WORD_LEVEL = "5"
MIN_CONFIDENCE = 30


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows, all text, with the ``file`` they come from. Quotes mean nothing."""
    schema = ", ".join(f"{c} string" for c in COLUMNS)
    return (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("header", True)
        .option("quote", "")
        .option("enforceSchema", True)
        .csv(path)
        .withColumn("file", F.col("_metadata.file_name"))
    )


def _whole(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"\A[+-]?[0-9]+\z"), F.trim(c).try_cast("int"))


def word_boxes(rows: DataFrame, page_width: Column, page_height: Column, page: Column) -> DataFrame:
    """(page, line, text, bbox): words that are sure enough and have a size.

    The line is named by its block, paragraph and line number.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\A\s+|\s+\z", "")
    sides = {c: _whole(F.col(c)) for c in ("left", "top", "width", "height")}
    kept = (
        rows.where(F.col("level") == WORD_LEVEL)
        .withColumn("text", text)
        .withColumns(sides)
        .where((F.col("text") != "") & (F.coalesce(try_double(F.col("conf")), F.lit(-1.0)) >= MIN_CONFIDENCE))
        .where((F.col("width") > 0) & (F.col("height") > 0) & F.col("left").isNotNull() & F.col("top").isNotNull())
    )
    return kept.select(
        page.alias("page"),
        F.struct(
            F.col("block_num").alias("block"), F.col("par_num").alias("par"), F.col("line_num").alias("line")
        ).alias("line"),
        "text",
        F.struct(
            F.round(F.col("left") / page_width, 4).alias("x"),
            F.round(F.col("top") / page_height, 4).alias("y"),
            F.round(F.col("width") / page_width, 4).alias("w"),
            F.round(F.col("height") / page_height, 4).alias("h"),
        ).alias("bbox"),
    )

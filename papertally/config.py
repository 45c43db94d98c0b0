"""Small configuration tables turned into DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def config_frame(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Rows known at plan time as a local relation.

    Going through Arrow keeps the size visible to the optimizer, so a join with
    it becomes a broadcast join by Spark's own size check, without a hint.
    """
    fields = StructType.fromDDL(schema)
    if not rows:
        return spark.createDataFrame([], fields)
    columns = list(zip(*rows))
    table = pa.table({f.name: pa.array(list(v)) for f, v in zip(fields, columns)})
    return spark.createDataFrame(table).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]
    )


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool | int | float):
        return str(value).lower()
    escaped = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def literal_map(entries: Mapping[str, object]) -> Column:
    """A constant map, written as one expression."""
    return F.expr("map(" + ", ".join(_sql(x) for kv in entries.items() for x in kv) + ")")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    A column expression is text: using a costly one several times inside another
    computes it as often. Here it is bound to a lambda variable instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_array(values: Sequence[object], element: str = "string") -> Column:
    """A constant array, written as one expression."""
    listed = ", ".join(_sql(v) for v in values)
    return F.expr(f"CAST(array({listed}) AS array<{element}>)")

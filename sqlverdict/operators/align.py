"""Both sides of a comparison brought into one shape."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, FloatType, StringType, StructField, StructType

from sqlverdict.functions.sqltypes import EXACT
from sqlverdict.operators.columns import col


def round_scale(tolerance: float) -> int:
    """Digits after the point that a tolerance leaves."""
    return max(0, round(-math.log10(tolerance)))


def rounded(value: Column, scale: int | None, kind: DataType) -> list[Column]:
    """The comparison keys of a value: a fixed-point number and, for floating point, whether it is NaN (else NaN would be NULL)."""
    if scale is None:
        return [value]
    fixed = F.round(value.cast(EXACT), scale)
    if isinstance(kind, FloatType | DoubleType):
        return [F.when(~F.isnan(value), fixed), F.coalesce(F.isnan(value), F.lit(False))]
    return [fixed]


def aligned(frame: DataFrame, names: list[str], numeric: set[str], scale: int | None) -> DataFrame:
    """The shared columns in expected order, numbers rounded; only these columns are read."""
    kinds = {f.name: f.dataType for f in frame.schema.fields}
    return frame.select(*[(F.round(col(n).cast(EXACT), scale) if n in numeric and scale is not None else col(n)).alias(n) for n in names])


def expected_frame(spark: SparkSession, rows: list[dict[str, Any]], schema: StructType | None) -> DataFrame:
    """Authored rows as a relation: missing cells are NULL, no rows keep the columns, types are cast where they are known."""
    names = schema.fieldNames() if schema is not None else list(dict.fromkeys(n for r in rows for n in r))
    if not names:
        return spark.createDataFrame([], StructType([]))
    if not rows:
        return spark.createDataFrame([], schema if schema is not None else StructType([StructField(n, StringType()) for n in names]))
    kinds = dict(zip(names, (f.dataType for f in schema.fields), strict=True)) if schema is not None else {}
    literal = lambda r, n: (F.lit(r.get(n)).cast(kinds[n]) if n in kinds else F.lit(r.get(n))).alias(n)
    parts = [spark.range(1).select(*[literal(r, n) for n in names]) for r in rows[:1]]
    if len(rows) == 1:
        return parts[0]
    if kinds:
        # values travel as text and are cast by the engine, as literals in SQL would be
        text = StructType([StructField(f"c{i}", StringType()) for i in range(len(names))])
        as_text = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
        if all(not isinstance(r.get(n), list | dict | tuple) for r in rows for n in names):
            return spark.createDataFrame([tuple(as_text(r.get(n)) for n in names) for r in rows], text).select(*[F.col(f"c{i}").cast(kinds[n]).alias(n) for i, n in enumerate(names)])
    out = parts[0]
    for r in rows[1:]:
        out = out.unionAll(spark.range(1).select(*[literal(r, n) for n in names]))
    return out

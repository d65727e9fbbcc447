"""Data-quality expectations, as many as possible in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlverdict.operators.bagdiff import SAMPLE
from sqlverdict.operators.columns import col


def null_count(frame: DataFrame, column: str) -> DataFrame:
    return frame.agg(F.count_if(col(column).isNull()).alias("n"))


def null_sample(frame: DataFrame, column: str, limit: int = SAMPLE) -> DataFrame:
    return frame.where(col(column).isNull()).limit(limit)


def repeated_values(frame: DataFrame, column: str) -> DataFrame:
    """Values, NULL left out, that more than one row has: the value and n."""
    return frame.where(col(column).isNotNull()).groupBy(col(column)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique_count(frame: DataFrame, column: str) -> DataFrame:
    """How many values are repeated."""
    return repeated_values(frame, column).agg(F.count(F.lit(1)).alias("n"))


def fused(frame: DataFrame, null_checked: list[str], unique_checked: list[str]) -> DataFrame:
    """One row: n_rows, nulls_<i> for each null-checked column and repeats_<i> for each unique-checked one.

    Row and NULL counts are one aggregation over a scan of the columns that are checked; each unique check is a
    partial aggregation by its column. The one-row results are put side by side.
    """
    head = frame.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(col(c).isNull()).alias(f"nulls_{i}") for i, c in enumerate(null_checked)])
    for i, c in enumerate(unique_checked):
        head = head.join(F.broadcast(unique_count(frame, c).withColumnRenamed("n", f"repeats_{i}")))  # one row each
    return head

"""Differences of rows aligned on a key: one full outer join, one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlverdict.functions.sqltypes import EXACT
from sqlverdict.operators.bagdiff import SAMPLE
from sqlverdict.operators.columns import col

#: Presence of each side; data columns are renamed by ordinal, so nothing can clash.
E_HERE, A_HERE = "in_expected", "in_actual"


def keyed_join(expected: DataFrame, actual: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """e0.., in_expected, a0.., in_actual: rows aligned by equality of the keys, so that NULL keys align with nothing."""
    side = lambda f, p, mark: f.select(*[col(n).alias(f"{p}{i}") for i, n in enumerate(names)], F.lit(True).alias(mark))
    at = [names.index(k) for k in keys]
    return side(expected, "e", E_HERE).join(side(actual, "a", A_HERE), [F.col(f"e{i}") == F.col(f"a{i}") for i in at], "full_outer")


def same(e: Column, a: Column, numeric: bool, null_equality: str, tolerance: float) -> Column:
    """Whether two values match; never NULL. NaN matches NaN and an infinity itself, as in a comparison of bags."""
    match = F.coalesce(e == a, F.lit(False))
    if numeric:
        # what no fixed point holds (NaN, infinities, huge numbers) can only be equal
        match = match | F.coalesce(F.abs(e.try_cast(EXACT) - a.try_cast(EXACT)) <= F.lit(repr(tolerance)).cast(EXACT), F.lit(False))
    return match | (e.isNull() & a.isNull()) if null_equality == "equal" else match


def keyed_stats(joined: DataFrame, keys: list[str], names: list[str], numeric: set[str], null_equality: str = "equal", tolerance: float = 0.0) -> DataFrame:
    """One row: expected_rows, actual_rows, missing, extra and m0, m1, ...: mismatches of each column that is no key."""
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    here, there = F.col(E_HERE).isNotNull(), F.col(A_HERE).isNotNull()
    values = [(i, n) for i, n in enumerate(names) if n not in keys]
    return joined.agg(
        count(here).alias("expected_rows"),
        count(there).alias("actual_rows"),
        count(~there).alias("missing"),
        count(~here).alias("extra"),
        *[count(here & there & ~same(F.col(f"e{i}"), F.col(f"a{i}"), n in numeric, null_equality, tolerance)).alias(f"m{k}") for k, (i, n) in enumerate(values)],
    )


def one_sided(joined: DataFrame, names: list[str], side: str) -> DataFrame:
    """Rows without a partner (missing or extra), under their own names."""
    p, absent = ("e", A_HERE) if side == "missing" else ("a", E_HERE)
    return joined.where(F.col(absent).isNull()).select(*[F.col(f"{p}{i}").alias(n) for i, n in enumerate(names)])


def sample(joined: DataFrame, names: list[str], side: str, limit: int = SAMPLE) -> DataFrame:
    return one_sided(joined, names, side).limit(limit)


def duplicate_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has, with their number n; keys with a NULL are left out."""
    return frame.select(*[col(k) for k in keys]).dropna("any", subset=keys).groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def mismatches_long(stats: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """column, mismatches: the per-column counts of keyed_stats as rows."""
    values = [n for n in names if n not in keys]
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"m{k}").alias("mismatches")) for k, n in enumerate(values)])
    return stats.select(F.explode(pairs).alias("x")).select("x.column", "x.mismatches")

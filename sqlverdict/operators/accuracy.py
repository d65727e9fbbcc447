"""Execution accuracy: do two results hold the same rows, whatever their columns are called?"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Literal

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DecimalType, DoubleType, FloatType, IntegralType, StringType

from sqlverdict.operators import bagdiff

Multiplicity = Literal["multiset", "set"]
SAMPLE = 5

def positional(frame: DataFrame) -> DataFrame:
    """The same rows with columns named by ordinal, which also makes repeated names safe."""
    return frame.toDF(*[f"c{i}" for i in range(len(frame.columns))])


def differences(actual: DataFrame, gold: DataFrame, multiplicity: Multiplicity = "multiset") -> DataFrame:
    """One row: expected_rows, actual_rows, missing, extra, by position; set: over distinct rows."""
    counted = bagdiff.balances(positional(gold), positional(actual), [f"c{i}" for i in range(len(gold.columns))])
    if multiplicity == "multiset":
        return bagdiff.summary(counted)
    once = counted.select("n_expected", "n_actual")
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    e, a = F.col("n_expected"), F.col("n_actual")
    return once.agg(total("n_expected").alias("expected_rows"), total("n_actual").alias("actual_rows"), count((e > 0) & (a == 0)).alias("missing"), count((a > 0) & (e == 0)).alias("extra"))


def difference_sample(actual: DataFrame, gold: DataFrame, side: str, multiplicity: Multiplicity = "multiset", limit: int = SAMPLE) -> DataFrame:
    """Some of the rows that only one side has, under that side's own names."""
    n = len(gold.columns)
    counted = bagdiff.balances(positional(gold), positional(actual), [f"c{i}" for i in range(n)])
    if multiplicity == "set":
        counted = counted.withColumns({c: F.least(F.col(c), F.lit(1)) for c in ("n_expected", "n_actual")})
    found = bagdiff.sample(counted, [f"c{i}" for i in range(n)], side, limit)
    return found.toDF(*(gold if side == "missing" else actual).columns)


def ordinals(frame: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their place in the result's own order (c0, c1, ... and nth), and what holds them until unpersisted.

    A sorted result's partitions are in order, and so are the ids given within them; the few rows of the partitions'
    sizes give what comes before each. The result is held on disk, so that both readings see the same order.
    """
    rows = positional(frame).withColumn("at", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    part = F.shiftrightunsigned("at", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    nth = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("part", part).join(before, "part").withColumn("nth", nth).drop("part", "at", "before"), rows


def same_sequence(actual: DataFrame, gold: DataFrame) -> bool:
    """Equal rows in equal order."""
    if len(actual.columns) != len(gold.columns):
        return False
    (a, held_a), (g, held_g) = ordinals(actual), ordinals(gold)
    names = [c for c in a.columns if c != "nth"]
    joined = a.select("nth", F.struct(*names).alias("a")).join(g.select("nth", F.struct(*names).alias("g")), "nth", "full_outer")
    try:
        return joined.where(~F.col("a").eqNullSafe(F.col("g"))).isEmpty()
    finally:
        held_a.unpersist()
        held_g.unpersist()


#: What a column's values are compared as: numbers with numbers, everything else with its own type only.
EXACT, FLOATING = "exact", "floating"


def domain(kind: DataType) -> str:
    if isinstance(kind, IntegralType | DecimalType | BooleanType):
        return EXACT
    return FLOATING if isinstance(kind, DoubleType | FloatType) else "string" if isinstance(kind, StringType) else kind.simpleString()


def _as_exact(value: Column, kind: DataType) -> Column:
    """All digits of an exact number as text, without zeros at the end of a fraction; booleans are 0 and 1."""
    if isinstance(kind, BooleanType):
        return value.cast("int").cast("string")
    if not isinstance(kind, DecimalType) or kind.scale <= 0:
        return value.cast("string")
    plain = F.regexp_replace(F.format_number(value, kind.scale), ",", "")
    return F.regexp_replace(F.regexp_replace(plain, r"0+$", ""), r"\.$", "")


def comparable(value: Column, kind: DataType, as_floating: bool = False) -> Column:
    """A value in a form that is equal for equal values: digits for exact numbers, doubles where a side is floating."""
    own = domain(kind)
    if own == FLOATING or (own == EXACT and as_floating):
        return value.cast("double")
    return _as_exact(value, kind) if own == EXACT else value


def _hashed(*values: Column) -> Column:
    return F.coalesce(F.sum(F.xxhash64(*values).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def fingerprints(frame: DataFrame) -> DataFrame:
    """One row for each column: place, rows, domain, nulls, total and, for numbers, total_floating (sums of hashes, blind to order)."""
    own = positional(frame)
    aggs, numbers = [], {EXACT, FLOATING}
    for i, f in enumerate(own.schema.fields):
        v = F.col(f.name)
        floating = _hashed(comparable(v, f.dataType, True)) if domain(f.dataType) in numbers else F.first(F.lit(None).cast("decimal(38,0)"))
        aggs += [F.count_if(v.isNull()).alias(f"n{i}"), _hashed(comparable(v, f.dataType)).alias(f"t{i}"), floating.alias(f"f{i}")]
    row = own.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    each = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(domain(f.dataType)).alias("domain"), F.col(f"n{i}").alias("nulls"), F.col(f"t{i}").alias("total"), F.col(f"f{i}").alias("total_floating")) for i, f in enumerate(own.schema.fields)])
    return row.select("rows", F.explode(each).alias("x")).select("x.place", "rows", "x.domain", "x.nulls", "x.total", "x.total_floating")


def _fits(a, g) -> bool:
    """Whether two columns' fingerprints allow them to be equal."""
    if (a.rows, a.nulls) != (g.rows, g.nulls):
        return False
    if a.domain == g.domain:
        return a.total == g.total
    return {a.domain, g.domain} == {EXACT, FLOATING} and a.total_floating == g.total_floating


def _pair_prints(frame: DataFrame, places: list[tuple[int, int]], floating: set[int]) -> dict[tuple[int, int], object]:
    """Fingerprints of pairs of columns, all in one aggregation."""
    own = positional(frame)
    value = lambda i: comparable(F.col(f"c{i}"), own.schema[f"c{i}"].dataType, i in floating)
    if not places:
        return {}
    row = own.agg(*[_hashed(value(i), value(j)).alias(f"p{k}") for k, (i, j) in enumerate(places)]).first()
    return dict(zip(places, row, strict=True))


def by_value(actual: DataFrame, gold: DataFrame, multiplicity: Multiplicity = "multiset", ordered: bool = False) -> bool:
    """Whether some one-to-one assignment of gold columns to actual columns makes the results equal.

    Columns whose fingerprints differ can't be the same, nor can pairs of columns whose pairs of values differ, so
    that few assignments are left, and all of these are compared as a whole. Columns of one side that are the same as
    each other stand for each other: only one order of theirs is tried.
    """
    empty_a, empty_g = actual.isEmpty(), gold.isEmpty()
    if empty_a or empty_g:
        return empty_a and empty_g
    width = len(actual.columns)
    if width != len(gold.columns):
        return False
    left, right = positional(actual), positional(gold)
    once = (lambda f: f.distinct()) if multiplicity == "set" and not ordered else (lambda f: f)
    kinds = lambda f: [domain(x.dataType) for x in f.schema.fields]
    # where one side of a comparison may be floating, its numbers are compared as doubles
    mixed = {EXACT, FLOATING} <= {*kinds(left), *kinds(right)}
    have, want = (sorted(fingerprints(once(f)).collect(), key=lambda r: r.place) for f in (left, right))
    options = [[j for j in range(width) if _fits(have[i], want[j])] for i in range(width)]
    if not all(options):
        return False
    number = lambda f: {i for i, k in enumerate(kinds(f)) if mixed and k in (EXACT, FLOATING)}
    doubtful = [i for i in range(width) if len(options[i]) > 1]
    near = sorted({j for i in doubtful for j in options[i]})
    pairs_a = _pair_prints(once(left), [(i, k) for i in range(width) for k in doubtful if i != k], number(left))
    pairs_g = _pair_prints(once(right), [(i, k) for i in range(width) for k in near if i != k], number(right))
    same = [(i, k) for i in near for k in near if i < k and domain(right.schema[f"c{i}"].dataType) == domain(right.schema[f"c{k}"].dataType)]
    equal_g = right.agg(*[F.bool_and(F.col(f"c{i}").eqNullSafe(F.col(f"c{k}"))).alias(f"s{n}") for n, (i, k) in enumerate(same)]).first() if same else []
    twin = {}
    for (i, k), yes in zip(same, equal_g, strict=True):
        if yes:
            twin[k] = twin.get(i, i)

    def assignments(i: int, taken: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        if i == width:
            yield taken
            return
        tried = set()
        for j in options[i]:
            if j in taken or twin.get(j, j) in tried:
                continue
            if all(pairs_a.get((k, i)) is None or pairs_g.get((m, j)) is None or pairs_a[k, i] == pairs_g[m, j] for k, m in enumerate(taken)):
                tried.add(twin.get(j, j))
                yield from assignments(i + 1, (*taken, j))

    for at in assignments(0, ()):
        floating = [FLOATING in (have[i].domain, want[j].domain) for i, j in enumerate(at)]
        a = left.select(*[comparable(F.col(f"c{i}"), left.schema[f"c{i}"].dataType, floating[i]).alias(f"c{i}") for i in range(width)])
        g = right.select(*[comparable(F.col(f"c{j}"), right.schema[f"c{j}"].dataType, floating[i]).alias(f"c{i}") for i, j in enumerate(at)])
        if equal(a, g, multiplicity, ordered):
            return True
    return False


def equal(actual: DataFrame, gold: DataFrame, multiplicity: Multiplicity = "multiset", ordered: bool = False) -> bool:
    """Equality by position. An order that matters outranks a set comparison."""
    if len(actual.columns) != len(gold.columns):
        return actual.isEmpty() and gold.isEmpty()
    if ordered:
        return same_sequence(actual, gold)
    d = differences(actual, gold, multiplicity).first()
    return d.missing == 0 and d.extra == 0

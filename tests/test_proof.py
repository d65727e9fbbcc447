"""Proofs: forms of a condition that are provable, forms that aren't, and a seeded run whose proofs are held against data."""

import random

import pytest
from pyspark.sql import functions as F
from sqlverdict.contract import OPEN, PROVEN, views
from sqlverdict.plans.proof import PlanEquivalence, ordered, ordered_text

from tests.conftest import SF

OPS = ["<", "<=", ">", ">=", "="]
FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "=": "="}


@pytest.fixture(scope="module")
def grid(spark, tmp_path_factory):
    """Every mix of small integers, decimals and doubles, NULLs too, where rounding shows."""
    session = spark.newSession()
    numbers = [None, -1, 0, 1, 2, 3]
    frame = session.range(216).selectExpr("id AS k", *[f"element_at(array({', '.join('NULL' if n is None else str(n) for n in numbers)}), cast((id div {6**i}) % 6 + 1 AS int)) AS {c}" for i, c in enumerate("ijn")])
    frame = frame.selectExpr("k", "cast(i AS int) AS i", "cast(j AS bigint) AS j", "cast(n / 10 AS decimal(8,2)) AS d", "n / 10D AS x")
    path = str(tmp_path_factory.mktemp("grid"))
    frame.write.mode("overwrite").parquet(path)
    session.read.parquet(path).createOrReplaceTempView("grid")
    return session


class Conditions:
    """Conjunctions of comparisons, as (column, operator, number), written in one of several ways."""

    def __init__(self, seed):
        self.r = random.Random(seed)

    def drawn(self):
        return [(c := self.r.choice("ijdx"), self.r.choice(OPS), self.r.randint(-2, 4) / (10 if c in "dx" else 1)) for _ in range(self.r.randint(1, 3))]

    def written(self, members):
        out = []
        for c, op, n in self.r.sample(members, len(members)):
            name, n = self.r.choice([c, c, f"g.{c}", c.upper()]), f"{n:g}"
            m = self.r.choice([0, 1, 3])
            moved = f"{m - float(n):g}"  # m - column op number, the same where numbers are exact
            out.append(self.r.choice([f"{name} {op} {n}", f"{n} {FLIP[op]} {name}", f"{m} - {name} {FLIP[op]} {moved}"]))
            if op != "=" and self.r.random() < 0.3:  # a weaker bound
                out.append(f"{name} {op} {float(n) + (1 if '<' in op else -1):g}")
        return " AND ".join(out)

    def pair(self):
        members = self.drawn()
        other = list(members)
        if self.r.random() < 0.4:
            k = self.r.randrange(len(other))
            c, op, n = other[k]
            other[k] = (c, self.r.choice(OPS), n + self.r.choice([0, 1, 0.1]))
        return self.written(members), self.written(other)


def test_no_proof_is_false(grid):
    drawn, judge = Conditions(11), PlanEquivalence()
    pairs = [drawn.pair() for _ in range(300)]
    sql = lambda c: f"SELECT k FROM grid g WHERE {c}"
    proven = [(a, b) for a, b in pairs if judge.judge(grid, sql(a), sql(b)).equivalence == "equivalent"]
    assert len(proven) > 40
    differ = lambda a, b: F.count_if(F.coalesce(F.expr(a), F.lit(False)) != F.coalesce(F.expr(b), F.lit(False)))
    for at in range(0, len(proven), 50):
        some = proven[at : at + 50]
        found = grid.table("grid").alias("g").agg(*[differ(a, b).alias(f"p{i}") for i, (a, b) in enumerate(some)]).first()
        assert [p for p, n in zip(some, found, strict=True) if n] == []


def test_rounding_is_never_proven_away(grid):
    judge = lambda a, b: PlanEquivalence().judge(grid, a, b).equivalence
    grid.createDataFrame([(0.2, 1)], "x double, a int").write.mode("overwrite").saveAsTable("odd_doubles")
    try:
        for table, name in (("grid", "x"), ("grid g", "g.x"), ("default.odd_doubles o", "o.x"), ("(SELECT k AS a, x FROM grid) s", "s.x"), ("grid a JOIN grid b ON a.k = b.k", "b.x")):
            for op in OPS:
                assert judge(f"SELECT 1 AS one FROM {table} WHERE 0.3 - {name} {op} 0.1", f"SELECT 1 AS one FROM {table} WHERE {name} {FLIP[op]} 0.2") == "unknown"
        assert grid.sql("SELECT count_if(0.3 - x = 0.1) AS l, count_if(x = 0.2) AS r FROM default.odd_doubles").first() == (0, 1)
        assert judge("SELECT k FROM grid g WHERE 0.3 - g.d = 0.1", "SELECT k FROM grid g WHERE g.d = 0.2") == "equivalent"
    finally:
        grid.sql("DROP TABLE odd_doubles")


def test_the_registered_pairs(spark):
    session = views(spark, SF)
    for a, b in PROVEN.values():
        assert PlanEquivalence().judge(session, a, b).equivalence == "equivalent", (a, b)
    for a, b in OPEN.values():
        assert PlanEquivalence().judge(session, a, b).equivalence == "unknown", (a, b)


@pytest.mark.parametrize(
    ("sql", "kind"),
    [("SELEKT k FROM grid", "parse_failed"), ("SELECT k FROM grid; SELECT i FROM grid", "not_single_statement"), ("SELECT absent FROM grid", "normalize_failed"), ("SELECT uuid() AS k FROM grid", "non_deterministic"), ("SELECT k FROM grid WHERE i < (SELECT rand() * 9)", "non_deterministic")],
)
def test_reasons(grid, sql, kind):
    found = PlanEquivalence().judge(grid, sql, "SELECT k FROM grid")
    assert (found.equivalence, found.error.kind) == ("unknown", kind)


@pytest.mark.parametrize(
    ("sql", "yes"),
    [("SELECT k FROM grid ORDER BY i DESC", True), ("SELECT k FROM grid ORDER BY i LIMIT 7 OFFSET 2", True), ("WITH s AS (SELECT k FROM grid) SELECT k FROM s ORDER BY 1", True), ("SELECT k FROM grid", False), ("SELECT k FROM (SELECT k FROM grid ORDER BY k) s", False), ("SELECT rank() OVER (PARTITION BY i ORDER BY j) AS r FROM grid", False), ("SELECT 'order by' AS o FROM grid", False)],
)
def test_ordered(grid, sql, yes):
    assert ordered(grid, sql) is yes
    assert ordered_text(sql) is yes


def test_what_spark_alone_tells(grid):
    assert not ordered(grid, "SELECT k FROM grid SORT BY k")
    assert not ordered(grid, "no query at all")

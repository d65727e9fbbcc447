import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from sqlverdict.judging import CallableSolver
from sqlverdict.model import ColumnPresence, ColumnType, ComparisonConfig, CostBudget, EvalCase, ExpectationSuite, GoldQuery, NotNull, RowCount, SourceRef, TypedResultSet, Unique, UntypedResultSet
from pyspark.sql import functions as F
from sqlverdict.operators import accuracy, bagdiff, keyeddiff
from sqlverdict.runner import Engine
from sqlverdict.scorers import ExecutionAccuracy, ExpectationSuiteScorer, FirstDecisive, ResultSetEquivalence, SemanticEquivalence, observed_equivalence

HERE = SourceRef(name="here")


@pytest.fixture
def score(spark):
    engine = Engine(spark)

    def run(sql, expected, scorer=None, budget=None, **config):
        case = EvalCase(id="c", input="q", expected=expected, source=HERE, comparison=ComparisonConfig(**config), cost_budget=CostBudget(max_seconds=budget) if budget else None)
        report = engine.evaluate(case, CallableSolver(lambda _: sql), [scorer or ResultSetEquivalence()])
        return report.scores[0]

    return run


def typed(rows, ddl="id bigint, v double"):
    return TypedResultSet(rows=rows, schema=[dict(zip(("name", "type"), c.strip().split(" ", 1), strict=True)) for c in ddl.split(", ")])


def table(*rows, names="id, v", kinds=("BIGINT", "DOUBLE")):
    body = ", ".join("(" + ", ".join(f"CAST({x} AS {k})" for x, k in zip(r, kinds, strict=True)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


def test_bags_count_duplicates(score):
    s = score(table((1, 1), (1, 1)), typed([{"id": 1, "v": 1}]))
    assert (s.verdict, s.diff.missing_row_count, s.diff.extra_row_count, s.basis) == ("fail", 0, 1, "observed")
    assert score(table((1, 1), (2, "NULL")), typed([{"id": 2}, {"id": 1, "v": 1}])).passed


@pytest.mark.parametrize(("value", "good"), [("1.0000000001", True), ("1.000001", False)])
def test_tolerance_rounds(score, value, good):
    assert score(table((1, value)), typed([{"id": 1, "v": 1.0}])).passed is good


def test_without_tolerance_values_are_exact(score):
    assert not score(table((1, "1.0000000001D")), typed([{"id": 1, "v": 1.0}]), float_tolerance=0).passed


def test_nan_is_not_null(score):
    assert not score(table((1, "'NaN'")), typed([{"id": 1}])).passed
    assert score(table((1, "'NaN'")), GoldQuery(sql=table((1, "'NaN'")))).passed


def test_samples_are_bounded(score):
    s = score("SELECT id, CAST(1 AS DOUBLE) AS v FROM range(30)", typed([]))
    assert (s.diff.extra_row_count, len(s.diff.sample_extra_rows)) == (30, 20)


def test_columns_and_types(score):
    s = score("SELECT CAST(1 AS INT) AS id, 2 AS w", typed([{"id": 1, "v": 1}]))
    assert (s.diff.missing_columns, s.diff.unexpected_columns) == (["v"], ["w"])
    assert [(t.column, t.expected, t.actual) for t in s.diff.type_mismatches] == [("id", "bigint", "int")]
    assert score("SELECT 1 AS id", UntypedResultSet(rows=[{"id": 1}])).passed
    s = score("SELECT CAST(1.0 AS DOUBLE) AS v, CAST(1 AS BIGINT) AS id", typed([{"id": 1, "v": 1}]), column_order="strict")
    assert s.diff.column_order_mismatch


def test_reserved_names(score):
    sql = "SELECT CAST(1 AS BIGINT) AS `order`, CAST(2 AS BIGINT) AS in_expected, CAST(3 AS BIGINT) AS `a.b`"
    assert score(sql, GoldQuery(sql=sql)).passed
    assert score(sql, GoldQuery(sql=sql), match_key=["order"]).passed


def test_keyed(score):
    s = score(table((1, 10), (2, 99)), typed([{"id": 1, "v": 10}, {"id": 2, "v": 20}]), match_key=["id"])
    assert [(c.column, c.unexpected_count) for c in s.diff.column_mismatches] == [("v", 1)]
    assert (s.diff.missing_row_count, s.diff.extra_row_count) == (0, 0)


@pytest.mark.parametrize(("value", "good"), [("10.5", True), ("10.51", False)])
def test_keyed_tolerance_is_a_band(score, value, good):
    assert score(table((1, value)), typed([{"id": 1, "v": 10.0}]), match_key=["id"], float_tolerance=0.5).passed is good


def test_null_keys_never_align(score):
    rows = [{"v": 1}, {"v": 2}]
    s = score(table(("NULL", 1), ("NULL", 2)), typed(rows), match_key=["id"])
    assert (s.diff.missing_row_count, s.diff.extra_row_count) == (2, 2)


def test_repeated_keys_are_told_by_side(score):
    twice, once = [{"id": 1, "v": 1}, {"id": 1, "v": 2}], table((1, 1))
    assert "expected" in score(once, typed(twice), match_key=["id"]).explanation
    assert "actual" in score(table((1, 1), (1, 2)), typed(twice[:1]), match_key=["id"]).explanation
    assert "match_key" in score(once, typed(twice[:1]), match_key=["w"]).explanation


def test_null_equality(score):
    rows = typed([{"id": 1}])
    assert score(table((1, "NULL")), rows, match_key=["id"]).passed
    assert not score(table((1, "NULL")), rows, match_key=["id"], null_equality="distinct").passed
    assert "match_key" in score(table((1, "NULL")), rows, null_equality="distinct").explanation


def test_failures_are_values(score):
    assert score("SELECT * FROM does_not_exist_xyz", typed([])).explanation.startswith("query execution failed")
    assert score("SLECT 1", typed([])).verdict == "fail"
    assert "duplicate" in score("SELECT 1 AS x, 2 AS x", typed([])).explanation
    s = score("SELECT 1 AS n", GoldQuery(sql="SELECT * FROM does_not_exist_xyz"))
    assert s.metadata == {"gold_query_failed": True}
    assert s.explanation.startswith("gold query failed:")
    late = score("SELECT 1 AS n", GoldQuery(sql="SELECT CAST('x' AS INT) AS n FROM range(2)"))
    assert late.metadata == {"gold_query_failed": True}
    late = score("SELECT CAST('x' AS INT) AS n FROM range(2)", GoldQuery(sql="SELECT 1 AS n"))
    assert not late.metadata


def test_budget_cancels(score):
    s = score("SELECT count(*) AS n FROM range(10000000) a JOIN range(10000000) b ON a.id % 1000 > b.id", GoldQuery(sql="SELECT 1 AS n"), budget=0.5)
    assert "budget" in s.explanation
    assert score("SELECT 1 AS n", UntypedResultSet(rows=[{"n": 1}])).passed


def test_suite(score):
    sql = "SELECT * FROM (VALUES (1, NULL), (1, 'x'), (NULL, 'y')) AS t(id, email)"
    suite = lambda *e: ExpectationSuite(expectations=list(e))
    s = score(sql, suite(RowCount(exact=3), RowCount(min=4), ColumnPresence(column="Email"), ColumnType(column="id", expected_type="int4"), NotNull(column="email"), Unique(column="id"), Unique(column="email"), NotNull(column="nope")), ExpectationSuiteScorer())
    assert [o.passed for o in s.outcomes] == [True, False, False, True, False, False, True, False]
    assert [o.count for o in s.outcomes[4:7]] == [1, 1, 0]
    assert s.outcomes[5].sample_rows == [{"id": 1, "n": 2}]
    with pytest.raises(TypeError):
        score(sql, typed([]), ExpectationSuiteScorer())


@pytest.fixture
def ex(score):
    return lambda sql, gold, **o: score(sql, GoldQuery(sql=gold), ExecutionAccuracy(**o))


def test_execution_accuracy(ex):
    up, down = (f"SELECT id FROM range(5) ORDER BY id {d}" for d in ("ASC", "DESC"))
    assert ex("SELECT id AS other FROM range(5)", "SELECT id FROM range(5)").passed
    assert not ex(down, up).passed
    assert ex(down, up, row_order="ignore").passed
    assert not ex(down, f"({up})", multiplicity="set").passed
    s = ex("SELECT 1 AS a UNION ALL SELECT 1", "SELECT 1 AS a")
    assert (s.verdict, s.diff.extra_row_count, s.diff.sample_extra_rows) == ("fail", 1, [{"a": 1}])
    assert ex("SELECT 1 AS a UNION ALL SELECT 1", "SELECT 1 AS a", multiplicity="set").passed
    assert not ex("SELECT 1 AS a, 2 AS b", "SELECT 2 AS a, 1 AS b").passed
    assert ex("SELECT 1 AS a, 2 AS b", "SELECT 2 AS a, 1 AS b", column_alignment="by_value").passed
    assert not ex("SELECT 1 AS a, 2 AS b", "SELECT 2 AS a", column_alignment="by_value").passed


CELL = st.sampled_from([0, 1, 2, None])


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=st.data(), width=st.integers(1, 4))
def test_by_value_is_a_search_over_permutations(spark, data, width):
    from collections import Counter
    from itertools import permutations

    row = st.lists(CELL, min_size=width, max_size=width).map(tuple)
    gold = data.draw(st.lists(row, min_size=1, max_size=5))
    perm = data.draw(st.permutations(range(width)))
    actual = [tuple(r[i] for i in perm) for r in gold] if data.draw(st.booleans()) else data.draw(st.lists(row, min_size=1, max_size=5))
    frame = lambda rows: spark.createDataFrame(rows, ", ".join(f"x{i} int" for i in range(width)))
    for kind, count in (("multiset", Counter), ("set", set)):
        want = any(count(actual) == count([tuple(r[i] for i in p) for r in gold]) for p in permutations(range(width)))
        assert accuracy.by_value(frame(actual), frame(gold), kind) == want


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(e=st.lists(st.tuples(CELL, CELL), max_size=8), a=st.lists(st.tuples(CELL, CELL), max_size=8))
def test_bag_diff_is_a_difference_of_counters(spark, e, a):
    from collections import Counter

    frame = lambda rows: spark.createDataFrame(rows, "x int, y int")
    d = bagdiff.bag_diff(frame(e), frame(a)).first()
    missing, extra = Counter(e) - Counter(a), Counter(a) - Counter(e)
    assert tuple(d) == (len(e), len(a), missing.total(), extra.total())
    counted = bagdiff.balances(frame(e), frame(a), ["x", "y"])
    assert Counter(map(tuple, bagdiff.one_sided(counted, ["x", "y"], "missing").collect())) == missing


def test_by_value_compares_exactly(spark):
    same = lambda a, b, **o: accuracy.by_value(spark.sql(f"SELECT {a}"), spark.sql(f"SELECT {b}"), **o)
    assert not same("9007199254740992L AS a", "9007199254740993L AS a")
    assert not same("DATE '2024-01-01' AS a", "'2024-01-01' AS a")
    assert not same("1 AS a", "'1' AS a")
    assert not same("CAST(1.5 AS DECIMAL(38,18)) AS a", "CAST('1.500000000000000001' AS DECIMAL(38,18)) AS a")
    assert same("CAST(1.50 AS DECIMAL(10,2)) AS a, 7 AS b, true AS c", "CAST(7 AS DECIMAL(12,3)) AS x, 1 AS y, CAST(1.5 AS DECIMAL(5,1)) AS z")
    assert same("CAST(-1200 AS DECIMAL(10,2)) AS a", "-1200 AS a")
    assert same("CAST('NaN' AS DOUBLE) AS a, 2.0D AS b", "2 AS a, CAST('NaN' AS FLOAT) AS b")
    assert same("0.0D AS a", "-0.0D AS a")


def test_by_value_with_columns_alike(spark):
    wide = spark.range(12).selectExpr("id AS k", *[f"id % 4 AS a{i}" for i in range(8)])
    turned = spark.range(12).selectExpr(*[f"id % 4 AS a{i}" for i in range(7)], "3 - id % 4 AS a7", "id AS k")
    assert accuracy.by_value(wide, wide.select(*reversed(wide.columns)))
    assert accuracy.by_value(wide, wide.select(*reversed(wide.columns)), "set")
    assert not accuracy.by_value(wide, turned)
    # pairs of columns agree here, triples don't
    cube = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0)], "a int, b int, c int")
    other = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (1, 0, 0), (1, 1, 1)], "a int, b int, c int")
    assert not accuracy.by_value(cube, other)
    assert accuracy.by_value(cube, cube.select("c", "a", "b"))


def test_long_orders(spark):
    up = spark.range(5000, numPartitions=7).selectExpr("id", "id % 3 AS r").repartition(5).orderBy("id")
    assert accuracy.same_sequence(up, spark.range(5000, numPartitions=3).selectExpr("id", "id % 3 AS r"))
    assert not accuracy.same_sequence(up, up.orderBy("r", "id"))
    assert not accuracy.same_sequence(up, up.where("id < 4999"))


def test_values_that_fixed_points_lack(spark):
    rows = "SELECT * FROM VALUES (1, CAST('NaN' AS DOUBLE)), (2, CAST('Infinity' AS DOUBLE)), (3, 1e300), (4, 2.0D), (5, CAST(NULL AS DOUBLE)) t(k, v)"
    e = spark.sql(rows)
    stats = lambda a, nulls="equal": keyeddiff.keyed_stats(keyeddiff.keyed_join(e, a, ["k"], ["k", "v"]), ["k"], ["k", "v"], {"k", "v"}, nulls, 1e-9).first().m0
    assert stats(e) == 0
    assert stats(e, "distinct") == 1
    assert stats(e.withColumn("v", -F.col("v"))) == 3


def test_rows_that_lack_often(spark):
    n = 3 * bagdiff.CHUNK + 5
    counted = bagdiff.balances(spark.range(n).selectExpr("1 AS x"), spark.range(2).selectExpr("1 AS x"), ["x"])
    assert bagdiff.summary(counted).first().missing == n - 2
    assert bagdiff.one_sided(counted, ["x"], "missing").count() == n - 2
    assert bagdiff.one_sided(counted, ["x"], "extra").count() == 0


def test_first_decisive(score, spark):
    spark.range(3).createOrReplaceTempView("three")
    gold = GoldQuery(sql="SELECT id FROM three WHERE id > 1")
    s = score("SELECT id FROM three WHERE 1 < id", gold, observed_equivalence())
    assert (s.verdict, s.basis, len(s.metadata["first_decisive"])) == ("pass", "proven", 1)
    s = score("SELECT id FROM three WHERE id >= 2", gold, observed_equivalence())
    assert (s.verdict, s.basis, len(s.metadata["first_decisive"])) == ("pass", "observed", 2)
    s = score("SELECT id FROM three WHERE id >= 1", gold, observed_equivalence())
    assert (s.verdict, s.diff.extra_row_count) == ("fail", 1)
    with pytest.raises(ValueError):
        FirstDecisive([])
    assert score("SELECT id FROM three", gold, SemanticEquivalence()).verdict == "inconclusive"

"""The engine's own queries and their SQL twins, by name."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sqlverdict.metrics.layer import Dimension, Manifest, Measure, Metric, MetricQuery, SemanticModel
from sqlverdict.model import ColumnPresence, ColumnType, NotNull, RowCount, Unique
from sqlverdict.operators import accuracy, align, bagdiff, checks, keyeddiff
from sqlverdict.plans.proof import PlanEquivalence, ordered
from sqlverdict.scorers import outcomes_frame
from sqlverdict.sources.session import QueryRunner

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

E = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
A = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
 CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 0.01 WHEN o_orderkey % 7 = 0 THEN o_totalprice + CAST('1e-11' AS DOUBLE) ELSE o_totalprice END AS o_totalprice
 FROM orders WHERE o_orderkey % 17 <> 0
 UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 101 = 0"""
#: The same pair with NULLs put in.
EN = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders"
AN = "SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 0.25 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 19 <> 0"
NAMES = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
NUMBERS = {"o_orderkey", "o_custkey", "o_totalprice"}


def views(spark: SparkSession, sf_dir: str, tables: list[str] = TABLES) -> SparkSession:
    """A session of its own with tables as views, so that other calls' views don't matter."""
    session = spark.newSession()
    for t in tables:
        session.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return session


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        # a table's schema is read only for queries that name it; those that name none say what they read elsewhere
        named = [t for t in TABLES if re.search(rf"\b{t}\b", f"{sql} {inspect.getsource(f)}")] or TABLES
        QUERIES[f.__name__] = lambda spark, sf_dir: f(views(spark, sf_dir, named), sf_dir)
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _pair(s: SparkSession, e: str = E, a: str = A) -> tuple[DataFrame, DataFrame]:
    return s.sql(e), s.sql(a)


def _balance_sql(e: str, a: str, names: list[str], rounded: dict[str, int] | None = None) -> str:
    """Common tables e, a and g (rows with their balance) for a bag difference in SQL."""
    cols = ", ".join(f"round(CAST(CAST({n} AS VARCHAR) AS DECIMAL(38,18)), {rounded[n]}) AS {n}" if rounded and n in rounded else n for n in names)
    keys = ", ".join(names)
    return f"WITH e AS (SELECT {cols} FROM ({e}) x), a AS (SELECT {cols} FROM ({a}) x), u AS (SELECT *, 1 AS e_, 0 AS a_ FROM e UNION ALL SELECT *, 0, 1 FROM a), g AS (SELECT {keys}, sum(e_) AS ne, sum(a_) AS na FROM u GROUP BY {keys}) "


SUMMARY = "SELECT coalesce(sum(ne),0)::BIGINT AS expected_rows, coalesce(sum(na),0)::BIGINT AS actual_rows, coalesce(sum(greatest(ne-na,0)),0)::BIGINT AS missing, coalesce(sum(greatest(na-ne,0)),0)::BIGINT AS extra FROM g"
AT9 = dict.fromkeys(NUMBERS, 9)


@query("SELECT count(*)::BIGINT AS n FROM lineitem")
def row_count(s: SparkSession, _: str) -> DataFrame:
    return s.table("lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*)::BIGINT AS n FROM orders WHERE o_orderkey % 5 = 0")
def not_null_count(s: SparkSession, _: str) -> DataFrame:
    return checks.null_count(s.sql(EN), "o_orderstatus")


@query("SELECT o_orderkey, NULL::VARCHAR AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 = 0 ORDER BY o_orderkey LIMIT 20")
def not_null_sample(s: SparkSession, _: str) -> DataFrame:
    return checks.null_sample(s.sql(EN), "o_orderstatus", 2**31 - 1).orderBy("o_orderkey").limit(20)


@query("SELECT count(*)::BIGINT AS n FROM (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1)")
def unique_count(s: SparkSession, _: str) -> DataFrame:
    return checks.unique_count(s.table("lineitem"), "l_orderkey")


@query("SELECT l_orderkey, count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, l_orderkey LIMIT 20")
def unique_sample(s: SparkSession, _: str) -> DataFrame:
    return checks.repeated_values(s.table("lineitem"), "l_orderkey").orderBy(F.desc("n"), "l_orderkey").limit(20)


@query(
    "SELECT 'row_count' AS kind, NULL::VARCHAR AS \"column\", (SELECT count(*) FROM orders) >= 1 AS passed, -1::BIGINT AS count"
    " UNION ALL SELECT 'column_presence', 'o_orderkey', true, -1 UNION ALL SELECT 'column_presence', 'nope', false, -1"
    " UNION ALL SELECT 'column_type', 'o_orderkey', true, -1 UNION ALL SELECT 'column_type', 'o_totalprice', false, -1"
    " UNION ALL SELECT 'not_null', 'o_orderstatus', false, (SELECT count(*) FROM orders WHERE o_orderkey % 5 = 0)"
    " UNION ALL SELECT 'not_null', 'o_orderkey', true, 0 UNION ALL SELECT 'unique', 'o_orderkey', true, 0"
    " UNION ALL SELECT 'unique', 'o_orderstatus', false, (SELECT count(*) FROM (SELECT 1 FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS x FROM orders) WHERE x IS NOT NULL GROUP BY x HAVING count(*) > 1))"
)
def suite_outcomes(s: SparkSession, _: str) -> DataFrame:
    suite = [RowCount(minimum=1), ColumnPresence(column="o_orderkey"), ColumnPresence(column="nope"), ColumnType(column="o_orderkey", expected_type="INT8"), ColumnType(column="o_totalprice", expected_type="DECIMAL(10,2)"), NotNull(column="o_orderstatus"), NotNull(column="o_orderkey"), Unique(column="o_orderkey"), Unique(column="o_orderstatus")]
    return outcomes_frame(s.sql(EN), suite, s).fillna(-1, ["count"])


@query("SELECT * FROM (VALUES ('o_orderkey', true, true), ('o_custkey', true, true), ('nope', false, false)) t(\"column\", present, type_ok)")
def column_checks(s: SparkSession, _: str) -> DataFrame:
    from sqlverdict.functions.sqltypes import SqlType

    have = {f.name: SqlType.of(f.dataType) for f in s.table("orders").schema.fields}
    rows = [(c, c in have, have.get(c) == SqlType.model_validate("int8")) for c in ("o_orderkey", "o_custkey", "nope")]
    return s.createDataFrame(rows, "column string, present boolean, type_ok boolean")


@query("SELECT * FROM (VALUES (1::BIGINT, 'Ada', 10.50::DOUBLE), (2, NULL, 5.00), (3, 'Cy', NULL)) t(id, name, amount)")
def expected_relation(s: SparkSession, _: str) -> DataFrame:
    rows = [{"id": 1, "name": "Ada", "amount": "10.50"}, {"id": 2, "amount": 5}, {"id": 3, "name": "Cy"}]
    return align.expected_frame(s, rows, StructType.fromDDL("id bigint, name string, amount decimal(10,2)")).withColumn("amount", F.col("amount").cast("double"))


@query("SELECT 1::BIGINT AS id, 'x' AS name WHERE false")
def expected_relation_empty(s: SparkSession, _: str) -> DataFrame:
    return align.expected_frame(s, [], StructType.fromDDL("id bigint, name string"))


@query("SELECT o_orderkey, round(CAST(CAST(o_totalprice AS VARCHAR) AS DECIMAL(38,18)), 1)::DOUBLE AS o_totalprice FROM orders")
def aligned_round(s: SparkSession, _: str) -> DataFrame:
    return align.aligned(s.table("orders"), ["o_orderkey", "o_totalprice"], {"o_totalprice"}, align.round_scale(0.1)).withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


def _diff(s: SparkSession, scale: int | None = 9, numbers: set[str] = NUMBERS) -> DataFrame:
    return bagdiff.balances(*_pair(s), NAMES, numbers, scale)


@query(_balance_sql(E, A, NAMES, AT9) + SUMMARY)
def bag_diff_summary(s: SparkSession, _: str) -> DataFrame:
    return bagdiff.summary(_diff(s))


@query(_balance_sql(E, A, NAMES) + SUMMARY)
def bag_no_tolerance(s: SparkSession, _: str) -> DataFrame:
    return bagdiff.summary(_diff(s, None))


@query(_balance_sql(E, A, NAMES, dict.fromkeys(NUMBERS, 1)) + SUMMARY)
def bag_float_tolerance(s: SparkSession, _: str) -> DataFrame:
    return bagdiff.summary(_diff(s, align.round_scale(0.1)))


@query(f"SELECT count(*)::BIGINT AS n FROM ({E} EXCEPT ALL ({A}))")
def bag_missing_count(s: SparkSession, _: str) -> DataFrame:
    return bagdiff.summary(_diff(s, None)).select(F.col("missing").alias("n"))


@query(f"SELECT count(*)::BIGINT AS n FROM (({A}) EXCEPT ALL {E})")
def bag_extra_count(s: SparkSession, _: str) -> DataFrame:
    return bagdiff.summary(_diff(s, None)).select(F.col("extra").alias("n"))


@query(f"SELECT * FROM ({E} EXCEPT ALL ({A})) ORDER BY 1, 2, 3, 4 LIMIT 20")
def bag_missing_sample(s: SparkSession, _: str) -> DataFrame:
    return bagdiff.one_sided(_diff(s, None), NAMES, "missing").orderBy(*NAMES).limit(20)


@query(f"SELECT * FROM (({A}) EXCEPT ALL {E}) ORDER BY 1, 2, 3, 4 LIMIT 20")
def bag_extra_sample(s: SparkSession, _: str) -> DataFrame:
    return bagdiff.one_sided(_diff(s, None), NAMES, "extra").orderBy(*NAMES).limit(20)


DUP_E, DUP_A = "SELECT l_returnflag, l_linestatus FROM lineitem", "SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber <> 3"


@query(_balance_sql(DUP_E, DUP_A, ["l_returnflag", "l_linestatus"]) + SUMMARY)
def bag_duplicates(s: SparkSession, _: str) -> DataFrame:
    return bagdiff.bag_diff(*_pair(s, DUP_E, DUP_A))


NUL_E = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer"
NUL_A = "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer"


@query(_balance_sql(NUL_E, NUL_A, ["c_custkey", "c_mktsegment"]) + SUMMARY)
def bag_null_equal(s: SparkSession, _: str) -> DataFrame:
    return bagdiff.bag_diff(*_pair(s, NUL_E, NUL_A))


PER_TABLE = {"nation": ["n_nationkey", "n_name"], "customer": ["c_custkey", "c_name"], "supplier": ["s_suppkey", "s_name"], "part": ["p_partkey", "p_name"], "labels": ["doc_id", "toxic"]}


@query(" UNION ALL ".join(f"SELECT '{t}' AS tbl, * FROM ({_balance_sql(f'SELECT {c[0]}, {c[1]} FROM {t}', f'SELECT {c[0]}, {c[1]} FROM {t} WHERE {c[0]} % 7 <> 0', c)}{SUMMARY}) x{i}" for i, (t, c) in enumerate(PER_TABLE.items())))
def bag_per_table_summary(s: SparkSession, _: str) -> DataFrame:
    parts = [bagdiff.bag_diff(s.table(t).select(*c), s.table(t).select(*c).where(f"{c[0]} % 7 <> 0")).select(F.lit(t).alias("tbl"), "*") for t, c in PER_TABLE.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


JOINED = f"(SELECT *, true AS here FROM ({E}) x) e FULL OUTER JOIN (SELECT *, true AS here FROM ({A}) y) a ON e.o_orderkey = a.o_orderkey"


@query("SELECT " + ", ".join(f"coalesce({p}.{n}, {repr('') if n == 'o_orderstatus' else -999}) AS {p}{i}" for p in "ea" for i, n in enumerate(NAMES)) + f", e.here AS in_expected, a.here AS in_actual FROM {JOINED}")
def keyed_join(s: SparkSession, _: str) -> DataFrame:
    # the markers tell which side is absent, so its NULLs can be shown as plain values
    shown = {f"{p}{i}": "" if n == "o_orderstatus" else -999 for p in "ea" for i, n in enumerate(NAMES)}
    return keyeddiff.keyed_join(*_pair(s), ["o_orderkey"], NAMES).fillna(shown)


@query(f"SELECT e.o_orderkey, e.o_custkey, e.o_orderstatus, e.o_totalprice FROM {JOINED} WHERE a.here IS NULL")
def keyed_missing(s: SparkSession, _: str) -> DataFrame:
    return keyeddiff.one_sided(keyeddiff.keyed_join(*_pair(s), ["o_orderkey"], NAMES), NAMES, "missing")


@query(f"SELECT a.o_orderkey, a.o_custkey, a.o_orderstatus, a.o_totalprice FROM {JOINED} WHERE e.here IS NULL")
def keyed_extra(s: SparkSession, _: str) -> DataFrame:
    return keyeddiff.one_sided(keyeddiff.keyed_join(*_pair(s), ["o_orderkey"], NAMES), NAMES, "extra")


def _stats_sql(e: str, a: str, keys: list[str], names: list[str], numbers: set[str], nulls: str, tolerance: str) -> str:
    both = "e.here IS NOT NULL AND a.here IS NOT NULL"

    def same(n: str) -> str:
        near = f"abs(CAST(e.{n} AS DECIMAL(38,18)) - CAST(a.{n} AS DECIMAL(38,18))) <= CAST('{tolerance}' AS DECIMAL(38,18))" if n in numbers else f"e.{n} = a.{n}"
        return f"coalesce({near}, false)" + (f" OR (e.{n} IS NULL AND a.{n} IS NULL)" if nulls == "equal" else "")

    values = [n for n in names if n not in keys]
    on = " AND ".join(f"e.{k} = a.{k}" for k in keys)
    count = lambda c, n: f"coalesce(sum(CASE WHEN {c} THEN 1 ELSE 0 END), 0)::BIGINT AS {n}"
    stats = [count("e.here IS NOT NULL", "expected_rows"), count("a.here IS NOT NULL", "actual_rows"), count("a.here IS NULL", "missing"), count("e.here IS NULL", "extra"), *[count(f"{both} AND NOT ({same(n)})", f"m{i}") for i, n in enumerate(values)]]
    return f"SELECT {', '.join(stats)} FROM (SELECT *, true AS here FROM ({e}) x) e FULL OUTER JOIN (SELECT *, true AS here FROM ({a}) y) a ON {on}"


N3 = ["o_orderkey", "o_orderstatus", "o_totalprice"]


def _stats(s: SparkSession, e: str, a: str, keys: list[str], names: list[str], numbers: set[str], nulls: str = "equal", tolerance: float = 1e-9) -> DataFrame:
    return keyeddiff.keyed_stats(keyeddiff.keyed_join(*_pair(s, e, a), keys, names), keys, names, numbers, nulls, tolerance)


@query(_stats_sql(EN, AN, ["o_orderkey"], N3, {"o_totalprice"}, "equal", "0.000000001"))
def keyed_stats_equal(s: SparkSession, _: str) -> DataFrame:
    return _stats(s, EN, AN, ["o_orderkey"], N3, {"o_totalprice"})


@query(_stats_sql(EN, AN, ["o_orderkey"], N3, {"o_totalprice"}, "distinct", "0.000000001"))
def keyed_stats_distinct(s: SparkSession, _: str) -> DataFrame:
    return _stats(s, EN, AN, ["o_orderkey"], N3, {"o_totalprice"}, "distinct")


@query(_stats_sql(EN, AN, ["o_orderkey"], N3, {"o_totalprice"}, "equal", "0.5"))
def keyed_stats_tolerance(s: SparkSession, _: str) -> DataFrame:
    return _stats(s, EN, AN, ["o_orderkey"], N3, {"o_totalprice"}, tolerance=0.5)


CE, CA = "SELECT conv_id, turn, role, text FROM conversations", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'x' ELSE role END AS role, text FROM conversations WHERE conv_id % 9 <> 0"


@query(_stats_sql(CE, CA, ["conv_id", "turn"], ["conv_id", "turn", "role", "text"], set(), "equal", "0"))
def keyed_stats_composite(s: SparkSession, _: str) -> DataFrame:
    return _stats(s, CE, CA, ["conv_id", "turn"], ["conv_id", "turn", "role", "text"], set())


KE = "SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey END AS k, c_name FROM customer"


@query(_stats_sql(KE, KE, ["k"], ["k", "c_name"], set(), "equal", "0"))
def keyed_null_key(s: SparkSession, _: str) -> DataFrame:
    return _stats(s, KE, KE, ["k"], ["k", "c_name"], set())


@query(f"SELECT e.o_orderkey, e.o_custkey, e.o_orderstatus, e.o_totalprice FROM {JOINED} WHERE a.here IS NULL ORDER BY 1 LIMIT 20")
def keyed_missing_sample(s: SparkSession, d: str) -> DataFrame:
    return keyed_missing(s, d).orderBy("o_orderkey").limit(20)


@query(f"SELECT a.o_orderkey, a.o_custkey, a.o_orderstatus, a.o_totalprice FROM {JOINED} WHERE e.here IS NULL ORDER BY 1 LIMIT 20")
def keyed_extra_sample(s: SparkSession, d: str) -> DataFrame:
    return keyed_extra(s, d).orderBy("o_orderkey").limit(20)


@query("SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def dup_keys_expected(s: SparkSession, _: str) -> DataFrame:
    return keyeddiff.duplicate_keys(s.table("lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"SELECT o_orderkey, count(*)::BIGINT AS n FROM ({A}) WHERE o_orderkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def dup_keys_actual(s: SparkSession, _: str) -> DataFrame:
    return keyeddiff.duplicate_keys(s.sql(A), ["o_orderkey"])


@query("SELECT unnest(['o_orderstatus', 'o_totalprice']) AS \"column\", unnest([m0, m1]) AS mismatches FROM (" + _stats_sql(EN, AN, ["o_orderkey"], N3, {"o_totalprice"}, "equal", "0.000000001") + ")")
def column_mismatch_long(s: SparkSession, d: str) -> DataFrame:
    return keyeddiff.mismatches_long(keyed_stats_equal(s, d), ["o_orderkey"], N3)


def _verdicts(s: SparkSession, pairs: dict[str, bool]) -> DataFrame:
    return s.createDataFrame(list(pairs.items()), "name string, equal boolean")


@query("SELECT * FROM (VALUES ('same', true), ('fewer', false), ('repeated', false), ('width', false)) t(name, equal)")
def ex_multiset(s: SparkSession, _: str) -> DataFrame:
    a, b = s.sql("SELECT n_nationkey, n_name FROM nation"), s.sql("SELECT n_nationkey AS x, n_name AS y FROM nation ORDER BY 2")
    return _verdicts(s, {"same": accuracy.equal(a, b), "fewer": accuracy.equal(a, b.where("x > 0")), "repeated": accuracy.equal(a, b.unionAll(b)), "width": accuracy.equal(a, b.select("x"))})


@query("SELECT * FROM (VALUES ('repeated', true), ('fewer', false)) t(name, equal)")
def ex_set(s: SparkSession, _: str) -> DataFrame:
    a = s.sql("SELECT n_regionkey FROM nation")
    return _verdicts(s, {"repeated": accuracy.equal(a, a.distinct(), "set"), "fewer": accuracy.equal(a, a.where("n_regionkey > 0"), "set")})


@query("SELECT * FROM (VALUES ('same', true), ('reversed', false)) t(name, equal)")
def ex_ordered(s: SparkSession, _: str) -> DataFrame:
    up, down = (s.sql(f"SELECT p_partkey FROM part ORDER BY p_partkey {d}") for d in ("ASC", "DESC"))
    return _verdicts(s, {"same": accuracy.equal(up, up, ordered=True), "reversed": accuracy.equal(up, down, ordered=True)})


@query("SELECT * FROM (VALUES ('permuted', true), ('changed', false), ('both empty', true)) t(name, equal)")
def ex_by_value(s: SparkSession, _: str) -> DataFrame:
    a = s.sql("SELECT p_partkey, p_name, p_brand, p_size FROM part")
    b = s.sql("SELECT p_size AS a, p_name AS b, p_partkey AS c, p_brand AS d FROM part")
    return _verdicts(s, {"permuted": accuracy.by_value(a, b), "changed": accuracy.by_value(a, b.withColumn("a", F.col("a") + 1)), "both empty": accuracy.by_value(a.limit(0), b.select("a").limit(0))})


@query(
    "SELECT 'wide integers' AS name, NOT EXISTS (SELECT 9007199254740992 + p_partkey FROM part EXCEPT ALL SELECT 9007199254740993 + p_partkey FROM part) AS equal"
    " UNION ALL SELECT 'date and text', false UNION ALL SELECT 'integer and decimal', NOT EXISTS (SELECT CAST(p_size AS DECIMAL(12,2)) FROM part EXCEPT ALL SELECT CAST(p_size AS DECIMAL(12,2)) FROM part)"
    " UNION ALL SELECT 'twins', true UNION ALL SELECT 'shuffled twins', false"
)
def ex_by_value_exact(s: SparkSession, _: str) -> DataFrame:
    one = lambda e: s.sql(f"SELECT {e} FROM part")
    twins = ", ".join(f"p_size AS s{i}" for i in range(8))
    # the same eight sets of values, but other rows: one column is turned against the others
    turned = ", ".join(f"{'51 - p_size' if i == 7 else 'p_size'} AS s{i}" for i in range(8))
    both = lambda e: one(e).unionAll(s.sql(f"SELECT {re.sub('p_size', '51 - p_size', e)} FROM part"))
    return _verdicts(s, {
        "wide integers": accuracy.by_value(one("9007199254740992 + p_partkey AS k"), one("9007199254740993 + p_partkey AS k")),
        "date and text": accuracy.by_value(one("DATE '2024-01-01' AS d"), one("'2024-01-01' AS d")),
        "integer and decimal": accuracy.by_value(one("p_size AS a, p_partkey AS k"), one("p_partkey AS x, CAST(p_size AS DECIMAL(12,2)) AS y")),
        "twins": accuracy.by_value(one(f"p_partkey, {twins}"), one(f"{twins}, p_partkey")),
        "shuffled twins": accuracy.by_value(both(twins), both(turned)),
    })


P_E, P_A = "SELECT p_brand, p_size FROM part", "SELECT p_brand, p_size FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT p_brand, -1 FROM part WHERE p_partkey % 5 = 0"


@query(_balance_sql(P_E, P_A, ["p_brand", "p_size"]) + SUMMARY)
def ex_missing_extra(s: SparkSession, _: str) -> DataFrame:
    e, a = _pair(s, P_E, P_A)
    return accuracy.differences(a, e)


@query(_balance_sql(P_E, P_A, ["p_brand", "p_size"]) + "SELECT sum(ne)::BIGINT AS expected_rows, sum(na)::BIGINT AS actual_rows, count(*) FILTER (WHERE ne > 0 AND na = 0)::BIGINT AS missing, count(*) FILTER (WHERE na > 0 AND ne = 0)::BIGINT AS extra FROM g")
def ex_missing_extra_set(s: SparkSession, _: str) -> DataFrame:
    e, a = _pair(s, P_E, P_A)
    return accuracy.differences(a, e, "set")


@query("SELECT i::INTEGER AS place, (SELECT count(*) FROM supplier)::BIGINT AS rows, 0::BIGINT AS nulls, i = 0 AS same_as_key FROM range(3) t(i)")
def ex_column_fingerprints(s: SparkSession, _: str) -> DataFrame:
    prints = accuracy.fingerprints(s.sql("SELECT s_suppkey, s_name, s_acctbal FROM supplier"))
    key = accuracy.fingerprints(s.sql("SELECT s_suppkey FROM supplier")).select(F.col("total").alias("key"))
    return prints.join(F.broadcast(key)).select("place", "rows", "nulls", (F.col("total") == F.col("key")).alias("same_as_key"))  # key: one row


REPORTS = "SELECT doc_id AS id, quality = 1 AS passed, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'hard' WHEN doc_id % 3 = 1 THEN 'easy' ELSE 'medium' END AS difficulty FROM labels"


@query(f"SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE passed)::BIGINT AS passed, coalesce(round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6), 0.0)::DOUBLE AS accuracy FROM ({REPORTS})")
def benchmark_accuracy(s: SparkSession, _: str) -> DataFrame:
    from sqlverdict.report import accuracy_frame

    return accuracy_frame(s.sql(REPORTS))


@query(f"SELECT difficulty, count(*)::BIGINT AS total, count(*) FILTER (WHERE passed)::BIGINT AS passed, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy FROM ({REPORTS}) WHERE difficulty IS NOT NULL GROUP BY 1")
def accuracy_by_difficulty(s: SparkSession, _: str) -> DataFrame:
    from sqlverdict.report import accuracy_frame

    return accuracy_frame(s.sql(REPORTS), "difficulty")


#: Forms of one question each over part, with a key to tell them apart: those that the judge has to prove ...
PROVEN = {
    "sizes between": ("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20", "SELECT p_partkey FROM part WHERE 20 >= p_size AND p_size >= 10"),
    "size solved": ("SELECT p_partkey FROM part WHERE 40 - p_size < 15 AND p_partkey > 3", "SELECT p_partkey FROM part WHERE p_partkey > 3 AND p_size > 25"),
    "weaker bounds": ("SELECT p_partkey, p_size FROM part WHERE p_size > 7 AND p_size > 30 AND p_size <= 44 AND p_size < 60", "SELECT p_partkey, p_size FROM part WHERE p_size <= 44 AND p_size > 30"),
    "qualified solved": ("SELECT q.p_partkey FROM part q WHERE 100 - q.p_partkey >= 50", "SELECT q.p_partkey FROM part q WHERE q.p_partkey <= 50"),
    "join sides": ("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (2, 1)", "SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey IN (1, 2)"),
    "named step": ("WITH big AS (SELECT * FROM part WHERE p_size > 5 + 20) SELECT p_brand, count(*) AS n FROM big GROUP BY p_brand", "SELECT p_brand, count(*) AS n FROM part WHERE p_size > 25 GROUP BY p_brand"),
    "no disjunct": ("SELECT s_suppkey FROM supplier WHERE NOT (s_nationkey < 4 OR s_suppkey = 1)", "SELECT s_suppkey FROM supplier WHERE s_suppkey <> 1 AND s_nationkey >= 4"),
}
#: ... and those that it must leave open: rounding, other rows, other names, or results that change.
OPEN = {
    "double solved": ("SELECT p_partkey FROM part WHERE 0.3 - p_retailprice = 0.1", "SELECT p_partkey FROM part WHERE p_retailprice = 0.2"),
    "qualified double solved": ("SELECT q.p_partkey FROM part q WHERE 1000.3 - q.p_retailprice > 0.1", "SELECT q.p_partkey FROM part q WHERE q.p_retailprice < 1000.2"),
    "joined double solved": ("SELECT c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE 0.3 - c_acctbal < 0.1", "SELECT c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_acctbal > 0.2"),
    "next size": ("SELECT p_partkey FROM part WHERE p_size > 25", "SELECT p_partkey FROM part WHERE p_size >= 25"),
    "repeated brands": ("SELECT p_brand FROM part", "SELECT p_brand FROM part GROUP BY p_brand"),
    "renamed": ("SELECT p_size AS s FROM part", "SELECT p_size AS t FROM part"),
    "drawn": ("SELECT p_partkey FROM part WHERE rand() < 0.5", "SELECT p_partkey FROM part WHERE rand() < 0.5"),
    "dated": ("SELECT p_partkey, current_date() AS d FROM part", "SELECT p_partkey, current_date() AS d FROM part"),
    "literal rows": ("SELECT v FROM VALUES (3), (4) l(v) WHERE v < 4", "SELECT v FROM VALUES (3), (4) l(v) WHERE v = 3"),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {str(k in PROVEN).lower()})" for k in [*PROVEN, *OPEN]) + ") t(name, proven)")
def proof_matrix(s: SparkSession, _: str) -> DataFrame:
    judge = PlanEquivalence()
    return s.createDataFrame([(k, judge.judge(s, a, b).equivalence == "equivalent") for k, (a, b) in (PROVEN | OPEN).items()], "name string, proven boolean")


@query(" UNION ALL ".join(f"SELECT '{k}' AS name, (SELECT count(*) FROM ({a}) x)::BIGINT AS n_left, (SELECT count(*) FROM ({b}) x)::BIGINT AS n_right FROM part WHERE p_partkey = 1" for k, (a, b) in PROVEN.items()))
def proof_soundness(s: SparkSession, _: str) -> DataFrame:
    """What a proof says: of each proven pair the left query's rows, for both queries (part has a row of key 1)."""
    judge = PlanEquivalence()
    rows = [(k, s.sql(a).count()) for k, (a, b) in (PROVEN | OPEN).items() if judge.judge(s, a, b).equivalence == "equivalent"]
    return s.createDataFrame([(k, n, n) for k, n in rows], "name string, n_left long, n_right long")


def sales() -> Manifest:
    """A semantic layer over orders and customer."""
    orders = SemanticModel("sales", "orders", {"order": ("primary", "o_orderkey"), "customer": ("foreign", "o_custkey")}, {"ordered_at": Dimension("ordered_at", "cast(o_orderdate as date)", "day"), "is_large": Dimension("is_large", "o_totalprice >= 100000"), "status": Dimension("status", "o_orderstatus")}, {"total": Measure("total", "sum", "cast(o_totalprice as decimal(18,2))"), "orders": Measure("orders", "sum", "1")}, "ordered_at")
    customers = SemanticModel("customers", "customer", {"customer": ("primary", "c_custkey")}, {"segment": Dimension("segment", "c_mktsegment")}, {})
    metrics = [Metric("revenue", "simple", "total"), Metric("order_count", "simple", "orders"), Metric("average", "ratio", numerator="revenue", denominator="order_count"), Metric("doubled", "derived", expr="revenue * 2", inputs=(("revenue", "revenue"),))]
    return Manifest([orders, customers], metrics)


def _metric(s: SparkSession, **q: object) -> DataFrame:
    found = sales().compile(MetricQuery(**q), s)
    dates = {f.name: F.col(f"`{f.name}`").cast("string") for f in found.schema.fields if f.dataType.typeName() == "date"}
    found = found.withColumns(dates) if dates else found
    return found.select(*[F.round(F.col(f"`{f.name}`").cast("double"), 2).alias(f.name) if f.dataType.typeName() in ("decimal", "double") else F.col(f"`{f.name}`") for f in found.schema.fields])


REV = "round(sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE, 2)"


@query(f"SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS metric_time__month, {REV} AS revenue, count(*)::BIGINT AS order_count FROM orders GROUP BY 1")
def metric_simple_month(s: SparkSession, _: str) -> DataFrame:
    return _metric(s, metrics=["revenue", "order_count"], group_by=["metric_time__month"])


@query("SELECT o_orderstatus AS order__status, round(sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE / count(*), 2) AS average FROM orders GROUP BY 1")
def metric_ratio(s: SparkSession, _: str) -> DataFrame:
    return _metric(s, metrics=["average"], group_by=["order__status"])


@query("SELECT round(2 * sum(CAST(o_totalprice AS DECIMAL(18,2)))::DOUBLE, 2) AS doubled FROM orders")
def metric_derived(s: SparkSession, _: str) -> DataFrame:
    return _metric(s, metrics=["doubled"])


@query(f"SELECT strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS metric_time__year, {REV} AS revenue FROM orders WHERE o_totalprice >= 100000 GROUP BY 1 ORDER BY 1 DESC LIMIT 3")
def metric_where_order_limit(s: SparkSession, _: str) -> DataFrame:
    return _metric(s, metrics=["revenue"], group_by=["metric_time__year"], where=["{{ Dimension('order__is_large') }} = true"], order_by=["-metric_time__year"], limit=3)


@query("SELECT c_mktsegment AS customer__segment, o_totalprice >= 100000 AS order__is_large, count(*)::BIGINT AS order_count FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def metric_two_dims(s: SparkSession, _: str) -> DataFrame:
    return _metric(s, metrics=["order_count"], group_by=["customer__segment", "order__is_large"])


@query("SELECT true AS same, false AS other")
def metric_result_bag(s: SparkSession, _: str) -> DataFrame:
    from sqlverdict.metrics.layer import same_rows

    q = lambda g: sales().compile(MetricQuery(metrics=["revenue"], group_by=[g]), s)
    return s.createDataFrame([(same_rows(q("metric_time__month"), q("order__ordered_at__month").withColumnRenamed("order__ordered_at__month", "metric_time__month")), same_rows(q("metric_time__month"), q("metric_time__year")))], "same boolean, other boolean")


GOLD = {
    "join_having": ("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 10", lambda s: s.table("customer").join(s.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n")).where("n > 10")),
    "window_topk": ("SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) t WHERE r <= 3", lambda s: s.table("customer").groupBy("c_nationkey").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("c_acctbal")).alias("b"), "c_custkey"))), 1, 3).alias("t")).select("c_nationkey", F.explode("t.c_custkey").alias("c_custkey"))),
    "rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", lambda s: s.table("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))),
    "exists_anti": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", lambda s: s.table("customer").join(s.table("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")),
    "as_of": ("SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_purchase FROM events", None),
}


def _gold(name: str) -> None:
    sql, frame = GOLD[name]
    cols = {"join_having": ["n_name", "n"], "window_topk": ["c_nationkey", "c_custkey"], "rollup": ["l_returnflag", "l_linestatus", "n"], "exists_anti": ["c_custkey"], "as_of": ["event_id", "last_purchase"]}[name]

    def run(s: SparkSession, _: str) -> DataFrame:
        from pyspark.sql import Window

        gold = s.sql(sql)
        if frame is None:
            w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
            model = s.table("events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("ts")), ignorenulls=True).over(w).alias("last_purchase"))
        else:
            model = frame(s)
        return bagdiff.bag_diff(gold, model, cols)

    run.__name__ = f"gold_tpch_{name}"
    query(f"SELECT count(*)::BIGINT AS expected_rows, count(*)::BIGINT AS actual_rows, 0::BIGINT AS missing, 0::BIGINT AS extra FROM ({sql}) t")(run)


for _name in GOLD:
    _gold(_name)


#: Queries that both dialects read alike: what a source gives back is compared row by row.
PASSED_ON = {
    "intersect": "SELECT c_nationkey AS k FROM customer WHERE c_custkey % 3 = 0 INTERSECT SELECT s_nationkey FROM supplier",
    "except": "SELECT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0",
    "recursive": "WITH RECURSIVE step(n, total) AS (SELECT 1 AS n, 1 AS total UNION ALL SELECT n + 1, total + n + 1 FROM step WHERE n < 20) SELECT n_name, total FROM step JOIN nation ON n = n_nationkey",
    "range_join": "SELECT r_name, count(*) AS n, min(p_partkey) AS least FROM part JOIN region ON p_size > 10 * r_regionkey AND p_size <= 10 * r_regionkey + 15 GROUP BY r_name",
    "grouping_sets": "SELECT o_orderstatus, o_custkey % 5 AS fifth, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_custkey % 5))",
}


def _passed_on(name: str) -> None:
    sql = PASSED_ON[name]

    def run(s: SparkSession, _: str) -> DataFrame:
        return QueryRunner(s, "").run(sql).frame

    run.__name__ = f"passed_on_{name}"
    query(sql)(run)


for _name in PASSED_ON:
    _passed_on(_name)


#: Whether the last step of a query orders its rows.
ORDERED = {
    "by key": ("SELECT n_name FROM nation ORDER BY n_nationkey", True),
    "top few": ("SELECT n_name FROM nation ORDER BY 1 LIMIT 3", True),
    "inside": ("SELECT count(*) AS n FROM (SELECT n_name FROM nation ORDER BY 1 LIMIT 3) x", False),
    "ranked": ("SELECT row_number() OVER (ORDER BY n_name) AS r FROM nation", False),
    "named step": ("WITH x AS (SELECT n_name FROM nation) SELECT n_name FROM x ORDER BY n_name DESC", True),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', {str(v).lower()})" for k, (_, v) in ORDERED.items()) + ") t(name, ordered)")
def order_detection(s: SparkSession, _: str) -> DataFrame:
    """Tells from analyzed plans which queries over nation promise an order."""
    return s.createDataFrame([(k, ordered(s, sql)) for k, (sql, _) in ORDERED.items()], "name string, ordered boolean")


@query("SELECT 'ok' AS kind, (SELECT count(*) FROM nation)::BIGINT AS rows UNION ALL SELECT 'query_failed', 0 UNION ALL SELECT 'duplicate_columns', 0 UNION ALL SELECT 'budget_exceeded', 0")
def execution_errors(s: SparkSession, _: str) -> DataFrame:
    """What running good and bad queries gives: an error's kind, or the rows."""
    runs = [QueryRunner(s, "").run("SELECT * FROM nation"), QueryRunner(s, "").run("SELECT * FROM does_not_exist"), QueryRunner(s, "").run("SELECT 1 AS x, 2 AS x"), QueryRunner(s, "", 0.5).run("SELECT count(*) AS n FROM range(10000000) a JOIN range(10000000) b ON a.id % 1000 > b.id", materialize=True)]
    return s.createDataFrame([(r.error.kind if r.error else "ok", 0 if r.error else r.frame.count()) for r in runs], "kind string, rows long")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

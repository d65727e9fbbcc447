import json
import sqlite3
import time
import zipfile

import pytest
from sqlverdict.judging import CallableSolver
from sqlverdict.model import EvalCase, ExecutionError, GoldQuery, SourceRef
from sqlverdict.runner import Engine
from sqlverdict.scorers import ExecutionAccuracy
from sqlverdict.sources import benchmarks
from sqlverdict.sources.benchmarks import Archive, FetchError, import_archive, load_bird, load_spider
from sqlverdict.sources.registry import Registry, schema_ddl
from sqlverdict.sources.session import BudgetExceeded, QueryRunner, within


def test_runs_give_values_or_errors(spark):
    run = QueryRunner(spark, "").run
    assert run("SELECT 1 AS n").rows == [{"n": 1}]
    empty = run("SELECT 1 AS n WHERE false")
    assert (empty.rows, empty.schema_.names) == ([], ["n"])
    assert run("SELECT NULL AS x").rows == [{"x": None}]
    e = run("SELECT * FROM does_not_exist_xyz").error
    assert (e.kind, e.condition, e.sqlstate) == ("query_failed", "TABLE_OR_VIEW_NOT_FOUND", "42P01")
    assert "does_not_exist_xyz" in json.dumps(e.params)
    assert run("SELECT 1 AS x, 2 AS x").error.kind == "duplicate_columns"
    assert run("SLECT 1").error is not None
    made = run("CREATE OR REPLACE TEMPORARY VIEW made AS SELECT 1 AS a")
    assert (made.error, made.rows) == (None, [])
    assert run("SELECT CAST('x' AS INT) AS n FROM range(1)", materialize=True).error.condition == "CAST_INVALID_INPUT"


def test_budgets(spark):
    slow = "SELECT count(*) AS n FROM range(10000000) a JOIN range(10000000) b ON a.id % 1000 > b.id"
    began = time.monotonic()
    runner = QueryRunner(spark, "", 0.5)
    r = runner.run(slow, materialize=True)
    assert (r.error.kind, r.rows) == ("budget_exceeded", [])
    assert 0.5 <= r.latency_seconds <= time.monotonic() - began < 20
    assert "used up" in runner.run("SELECT 1").error.message
    assert QueryRunner(spark, "").run("SELECT 1 AS n").rows == [{"n": 1}]
    with pytest.raises(BudgetExceeded):
        within(spark, lambda: 1, 0)


def test_scalars(spark):
    runner = QueryRunner(spark, "")
    assert runner.scalar(spark.sql("SELECT 7 AS n")) == 7
    assert isinstance(runner.scalar(spark.range(2)), ExecutionError)
    assert isinstance(runner.scalar(spark.sql("SELECT 1 AS a, 2 AS b")), ExecutionError)


def test_files_and_names(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p/t.parquet"))
    spark.range(2).write.json(str(tmp_path / "j/u.json"))
    spark.range(4).write.option("header", "true").csv(str(tmp_path / "c/v.csv"))
    spark.range(5).write.orc(str(tmp_path / "o/w.orc"))
    registry = Registry(spark)
    for kind, folder, table, n in (("parquet", "p", "t", 3), ("json", "j", "u", 2), ("csv", "c", "v", 4), ("orc", "o", "w", 5)):
        session = registry.resolve(SourceRef(name=kind, kind=kind, config={"path": str(tmp_path / folder)}))
        assert session.table(table).count() == n
    ref = SourceRef(name="parquet", kind="parquet", config={"path": str(tmp_path / "p")})
    assert registry.resolve(ref) is registry.resolve(ref)
    with pytest.raises(ValueError, match="bound"):
        registry.resolve(SourceRef(name="parquet", kind="parquet", config={"path": str(tmp_path / "o")}))
    assert "CREATE TABLE t (\n  id bigint\n);" in schema_ddl(registry.resolve(ref), ["t"])
    registry.close_all()
    registry.close_all()


@pytest.fixture
def database(tmp_path):
    path = tmp_path / "database" / "shop" / "shop.sqlite"
    path.parent.mkdir(parents=True)
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE items (id INTEGER, name TEXT, price REAL, odd)")
        db.executemany("INSERT INTO items VALUES (?, ?, ?, ?)", [(1, "apple", 3, 1), (2, "pear", 2.5, "x"), (3, None, None, None)])
        db.execute("CREATE TABLE none (a)")
    return path


def test_sqlite(spark, database, monkeypatch):
    ref = SourceRef(name="shop", kind="sqlite", config={"path": str(database)})
    rows = Registry(spark).resolve(ref).table("items").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "apple", 3.0, "1"), (2, "pear", 2.5, "x"), (3, None, None, None)]
    monkeypatch.setattr("sqlverdict.sources.sqlite.BATCH", 1)
    session = Registry(spark).resolve(ref)
    assert session.table("items").count() == 3
    assert session.table("none").columns == ["a"]
    with pytest.raises(FileNotFoundError):
        Registry(spark).resolve(SourceRef(name="no", kind="sqlite", config={"path": "/no/such/file"}))


def test_sqlite_dialect(spark, database):
    """Gold queries that only SQLite understands are judged by what SQLite returns."""
    ref = SourceRef(name="dialect", kind="sqlite", config={"path": str(database)})
    engine = Engine(spark)

    def judged(gold, answer, **options):
        case = EvalCase(id="c", input="q", expected=GoldQuery(sql=gold), source=ref, cost_budget={"max_seconds": options.pop("seconds", 60)})
        return engine.evaluate(case, CallableSolver(lambda c: answer), [ExecutionAccuracy(**options)])

    # a name in double quotes that is no column is a string; ifnull, glob, || of numbers, loose comparison
    gold = "SELECT name, price || '' FROM items WHERE name GLOB \"*p*\" AND price > '1' OR name IS NULL ORDER BY ifnull(name, 'zz')"
    assert judged(gold, "SELECT name, CAST(price AS TEXT) FROM items WHERE name LIKE '%p%' OR name IS NULL ORDER BY name IS NULL, name").passed
    assert not judged(gold, "SELECT name, CAST(price AS TEXT) FROM items WHERE name LIKE '%p%' OR name IS NULL ORDER BY name").passed
    assert judged(gold, "SELECT price || '', name FROM items WHERE id < 4", row_order="ignore", column_alignment="by_value").passed
    assert "no such function" in judged("SELECT nofunction(1)", "SELECT 1").scores[0].explanation
    assert judged(gold, "SELEC 1").result.error.kind == "query_failed"
    endless = "WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n) SELECT count(*) FROM n"
    assert judged("SELECT 1", endless, seconds=0.5).result.error.kind == "budget_exceeded"


def test_benchmarks(database, tmp_path):
    root = tmp_path
    (root / "dev.json").write_text(json.dumps([{"db_id": "shop", "question": "How many?", "query": "SELECT count(*) FROM items"}]))
    (case,) = load_spider(root)
    assert (case.id, case.expected.sql, case.source.kind) == ("spider/shop/0", "SELECT count(*) FROM items", "sqlite")
    assert "CREATE TABLE items" in case.metadata["schema_ddl"]
    (root / "dev.json").write_text(json.dumps([{"question_id": 7, "db_id": "shop", "question": "Q", "evidence": "E", "SQL": "SELECT 1", "difficulty": "simple"}, {"db_id": "shop", "question": "Q", "SQL": "SELECT 1"}]))
    one, two = load_bird(root)
    assert (one.id, one.input, one.metadata["difficulty"]) == ("bird/7", "Q\nEvidence: E", "simple")
    assert (two.id, two.input) == ("bird/shop/1", "Q")
    assert next(load_bird(root, include_evidence=False)).input == "Q"


def test_archives(database, tmp_path):
    (tmp_path / "dev.json").write_text(json.dumps([{"db_id": "shop"}]))
    archive = tmp_path / "a.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.write(tmp_path / "dev.json", "top/dev.json")
        z.write(database, "top/database/shop/shop.sqlite")
    spec = Archive("toy", 1, "database")
    found = import_archive(archive, spec, tmp_path / "cache")
    assert isinstance(found, FetchError)
    digest = found.message.split()[-1]
    assert found.kind == "untrusted"
    assert import_archive(archive, Archive("toy", 1, "database", "0" * 64), tmp_path / "cache").kind == "hash_mismatch"
    target = import_archive(archive, Archive("toy", 1, "database", digest), tmp_path / "cache")
    assert (target / "database/shop/shop.sqlite").is_file()
    assert import_archive(archive, spec, tmp_path / "cache", trust=True) == target
    assert import_archive(archive, Archive("toy", 2, "database"), tmp_path / "other", trust=True).kind == "wrong_case_count"
    assert import_archive(archive, Archive("toy", 1, "nowhere"), tmp_path / "other", trust=True).kind == "bad_database"
    archive.write_text("no zip")
    assert import_archive(archive, spec, tmp_path / "other", trust=True).kind == "bad_archive"
    assert import_archive(tmp_path / "none", spec, tmp_path).kind == "not_found"
    assert benchmarks.ARCHIVES["bird"].cases == 1534

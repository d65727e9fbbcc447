"""Sources: named sets of tables, registered as temporary views of one session."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import closing
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from sqlverdict.model import SourceRef
from sqlverdict.sources import sqlite
from sqlverdict.sources.session import shared_dir


def _files(spark: SparkSession, ref: SourceRef) -> dict[str, DataFrame]:
    options = {k: v for k, v in ref.config.items() if k not in ("path", "tables")}
    reader = spark.read.format(ref.kind).options(**({"header": "true", "inferSchema": "true"} | options if ref.kind == "csv" else options))
    tables = ref.config.get("tables")
    if tables is None:
        # by Spark's own file systems: a folder can be in any store that it reads
        folder = spark._jvm.org.apache.hadoop.fs.Path(ref.config["path"])
        found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
        names = sorted((f.getPath().getName(), f.getPath().toString(), f.isDirectory()) for f in found)
        tables = {n.split(".")[0]: path for n, path, is_dir in names if n.endswith(f".{ref.kind}") or is_dir}
    return {name: reader.load(path) for name, path in tables.items()}


def _sqlite(spark: SparkSession, ref: SourceRef) -> dict[str, DataFrame]:
    """SQLite tables as views, for plans and checks; queries of such a source run in SQLite (see QueryRunner)."""
    path = ref.config["path"]
    if path != ":memory:" and not Path(path).is_file():
        raise FileNotFoundError(path)
    quote = lambda n: '"' + n.replace('"', '""') + '"'
    with closing(sqlite.connect(path)) as db:
        names = [n for (n,) in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        return {n: sqlite.frame_of(spark, db, f"SELECT * FROM {quote(n)}", shared_dir(spark)) for n in names}


def _jdbc(spark: SparkSession, ref: SourceRef) -> dict[str, DataFrame]:
    options = {k: v for k, v in ref.config.items() if k != "tables"}
    return {t: spark.read.format("jdbc").options(**options, dbtable=t).load() for t in ref.config["tables"]}


def _catalog(spark: SparkSession, ref: SourceRef) -> dict[str, DataFrame]:
    if ref.config.get("database"):
        spark.catalog.setCurrentDatabase(ref.config["database"])
    return {}


BUILDERS: dict[str, Callable[[SparkSession, SourceRef], dict[str, DataFrame]]] = {**dict.fromkeys(("parquet", "csv", "json", "orc"), _files), "sqlite": _sqlite, "jdbc": _jdbc, "catalog": _catalog}


class Registry:
    """Sources by name. A name stands for one source only."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._known: dict[str, tuple[SourceRef, SparkSession, list[str]]] = {}

    def resolve(self, ref: SourceRef) -> SparkSession:
        """A session with the source's tables as views; sources don't see each other's views."""
        if ref.name in self._known:
            known, session, _ = self._known[ref.name]
            if known != ref:
                raise ValueError(f"source {ref.name!r} is bound to another configuration")
            return session
        session = self.spark if ref.kind == "catalog" else self.spark.newSession()
        tables = BUILDERS[ref.kind](session, ref)
        for name, frame in tables.items():
            frame.createOrReplaceTempView(f"`{name}`")
        self._known[ref.name] = (ref, session, list(tables))
        return session

    def close_all(self) -> None:
        for _, session, names in self._known.values():
            for n in names:
                session.catalog.dropTempView(n)
        self._known.clear()


def schema_ddl(spark: SparkSession, tables: list[str]) -> str:
    """CREATE TABLE text of tables, for prompts."""
    lines = []
    for t in tables:
        columns = ",\n".join(f"  {f.name} {f.dataType.simpleString()}" + (f" COMMENT '{c}'" if (c := f.metadata.get("comment")) else "") for f in spark.table(f"`{t}`").schema.fields)
        lines.append(f"CREATE TABLE {t} (\n{columns}\n);")
    return "\n\n".join(lines)

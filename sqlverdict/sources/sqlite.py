"""SQLite databases: queries run in SQLite's own dialect, and their results become DataFrames."""

from __future__ import annotations

import sqlite3
import threading
import uuid
from contextlib import closing

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Rows that are read at a time.
BATCH = 10_000
_KINDS = {int: "bigint", float: "double", bytes: "binary"}
_CASTS = {"bigint": int, "double": float, "binary": bytes, "string": lambda v: v.decode("utf-8", "replace") if isinstance(v, bytes) else str(v)}


class Interrupted(Exception):
    """A query that was stopped at the end of its time."""


def connect(path: str) -> sqlite3.Connection:
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True, check_same_thread=False) if path != ":memory:" else sqlite3.connect(path, check_same_thread=False)
    db.text_factory = lambda b: b.decode("utf-8", "replace")
    return db


def _kind(types: set[type]) -> str:
    """Columns have no types of their own: text, unless all values agree (integers and reals are doubles together)."""
    if types == {int, float}:
        return "double"
    return _KINDS.get(next(iter(types)), "string") if len(types) == 1 else "string"


def frame_of(spark: SparkSession, db: sqlite3.Connection, sql: str, folder: str) -> DataFrame:
    """A query's rows. One reading finds the columns' types, the next brings the rows over, batch by batch."""
    cursor = db.execute(sql)
    if cursor.description is None:
        return spark.createDataFrame([], StructType([]))
    names = [d[0] for d in cursor.description]
    types: list[set[type]] = [set() for _ in names]
    while rows := cursor.fetchmany(BATCH):
        for have, column in zip(types, zip(*rows, strict=True), strict=True):
            have.update(map(type, column))
    kinds = [_kind(t - {type(None)}) for t in types]
    schema = StructType.fromDDL(", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    casts = [_CASTS[k] for k in kinds]
    cursor, path, frame = db.execute(sql), f"{folder}/sqlite-{uuid.uuid4().hex}", None
    while rows := cursor.fetchmany(BATCH):
        part = spark.createDataFrame([tuple(None if v is None else cast(v) for v, cast in zip(r, casts, strict=True)) for r in rows], schema)
        if frame is None and len(rows) < BATCH:
            return part.toDF(*names)
        # what is larger than a batch goes to Parquet, not through the driver's memory at once
        part.write.mode("append").parquet(path)
        frame = path
    return (spark.read.schema(schema).parquet(path) if frame else spark.createDataFrame([], schema)).toDF(*names)


def result(spark: SparkSession, path: str, sql: str, folder: str, seconds: float | None = None) -> DataFrame:
    """What a query gives in the database itself, within some seconds."""
    with closing(connect(path)) as db:
        over = threading.Event()

        def stop() -> None:
            over.set()
            db.interrupt()

        timer = threading.Timer(seconds, stop) if seconds is not None else None
        if timer:
            timer.start()
        try:
            return frame_of(spark, db, sql, folder)
        except sqlite3.OperationalError as e:
            if over.is_set():
                raise Interrupted(f"exceeded the budget of {seconds:g} s") from e
            raise
        finally:
            if timer:
                timer.cancel()

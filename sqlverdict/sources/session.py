"""Running queries: errors as values, budgets, cancellation."""

from __future__ import annotations

import sqlite3
import tempfile
import threading
import time
import uuid
from collections.abc import Callable
from typing import Any, TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from sqlverdict.model import ExecutionError, ExecutionResult
from sqlverdict.operators.columns import duplicates
from sqlverdict.sources import sqlite

T = TypeVar("T")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see; a temporary one only where no cluster names one, as in tests."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp()


FAILURES = (PySparkException, Py4JJavaError, sqlite3.Error)


def _told(exc: BaseException, name: str) -> Any:
    method = getattr(exc, name, None)
    try:
        return method() if callable(method) else None
    except Exception:  # some errors have no JVM side left to ask
        return None


def execution_error(exc: BaseException, kind: str = "query_failed") -> ExecutionError:
    """What an engine's exception says: message, SQLSTATE, condition and parameters where it has them."""
    message = str(exc).strip().split("\n\nJVM stacktrace")[0] or type(exc).__name__
    params = _told(exc, "getMessageParameters")
    return ExecutionError(kind=kind, message=message, cause=exc, sqlstate=_told(exc, "getSqlState"), condition=_told(exc, "getCondition"), params={str(k): str(v) for k, v in params.items()} if params else None)


class BudgetExceeded(Exception):
    """Work that was cancelled at the end of its time."""


def within(spark: SparkSession, work: Callable[[], T], seconds: float | None) -> T:
    """The result of work, whose Spark jobs are cancelled if it takes longer than seconds."""
    if seconds is None:
        return work()
    if seconds <= 0:
        raise BudgetExceeded("the budget is used up")
    context, group = spark.sparkContext, f"budget-{uuid.uuid4().hex}"
    out: dict[str, Any] = {}

    def run() -> None:
        context.setJobGroup(group, "within a budget", True)
        try:
            out["value"] = work()
        except BaseException as e:
            out["error"] = e

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        # a job may start just after the others of its group were cancelled
        for _ in range(50):
            context.cancelJobGroup(group)
            thread.join(0.1)
            if not thread.is_alive():
                break
        raise BudgetExceeded(f"exceeded the budget of {seconds:g} s")
    if "error" in out:
        raise out["error"]
    return out["value"]


class QueryRunner:
    """Runs the queries of one case against one pool of seconds; with a database, in that SQLite file and its dialect."""

    def __init__(self, spark: SparkSession, model_sql: str, max_seconds: float | None = None, untyped: bool = False, database: str | None = None) -> None:
        self.spark, self.model_sql, self.left, self.untyped, self.database = spark, model_sql, max_seconds, untyped, database

    def attempt(self, work: Callable[[], T], kind: str = "query_failed") -> T | ExecutionError:
        """work within what is left of the budget; failures are returned."""
        if self.left is not None and self.left <= 0:
            return ExecutionError(kind="budget_exceeded", message="the query budget is used up")
        began = time.monotonic()
        try:
            return within(self.spark, work, self.left)
        except (BudgetExceeded, sqlite.Interrupted) as e:
            return ExecutionError(kind="budget_exceeded", message=str(e), cause=e)
        except FAILURES as e:
            return execution_error(e, kind)
        finally:
            if self.left is not None:
                self.left -= time.monotonic() - began

    def run(self, sql: str, materialize: bool = False) -> ExecutionResult:
        """A lazy result of a query; materialize runs it now, so that failures at run time show here."""
        began = time.monotonic()

        def work() -> DataFrame:
            if self.database is not None:
                return sqlite.result(self.spark, self.database, sql, shared_dir(self.spark), self.left)
            frame = self.spark.sql(sql)
            if materialize:
                frame.write.format("noop").mode("overwrite").save()
            return frame

        found = self.attempt(work)
        latency = time.monotonic() - began
        if isinstance(found, ExecutionError):
            return ExecutionResult(error=found, latency_seconds=latency)
        if twice := duplicates(found):
            return ExecutionResult(error=ExecutionError(kind="duplicate_columns", message=f"duplicate output column(s): {', '.join(map(repr, twice))}"), latency_seconds=latency)
        return ExecutionResult(frame=found, latency_seconds=latency, untyped=self.untyped)

    def scalar(self, frame: DataFrame) -> Any | ExecutionError:
        """The one value of a result with one row and one column."""
        found = self.attempt(lambda: frame.limit(2).collect())
        if isinstance(found, ExecutionError):
            return found
        if len(found) != 1 or len(frame.columns) != 1:
            return ExecutionError(kind="query_failed", message=f"expected one row and one column, got {len(found)} and {len(frame.columns)}")
        return found[0][0]

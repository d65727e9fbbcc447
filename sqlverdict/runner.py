"""Running cases: one, with an assertion, or many."""

from __future__ import annotations

import weakref
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from typing import Any, Protocol

from pydantic import Field
from pyspark.sql import SparkSession

from sqlverdict.model import CaseReport, EvalCase, SolverOutput, Strict
from sqlverdict.report import COLLECTOR, render_case
from sqlverdict.scorers import ScoreContext, Scorer
from sqlverdict.sources.registry import Registry
from sqlverdict.sources.session import QueryRunner


class Solver(Protocol):
    def solve(self, case: EvalCase) -> SolverOutput: ...


class BenchmarkSummary(Strict):
    total: int
    passed: int
    accuracy: float
    reports: list[CaseReport] = Field(default_factory=list)


class Engine:
    """A session with its sources."""

    def __init__(self, spark: SparkSession | None = None) -> None:
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.sources = Registry(self.spark)

    def evaluate(self, case: EvalCase, solver: Solver, scorers: Sequence[Scorer]) -> CaseReport:
        """solver, then query, then scorers; failures are part of the report. A result that several scorers read is kept."""
        output = solver.solve(case)
        if output.output is None:
            return CaseReport(case=case, output=output)
        session = self.sources.resolve(case.source)
        database = case.source.config.get("path") if case.source.kind == "sqlite" else None
        runner = QueryRunner(session, output.output, case.cost_budget.max_seconds if case.cost_budget else None, untyped=case.source.kind == "sqlite", database=database)
        result = runner.run(output.output)
        shared = result.frame is not None and len(scorers) > 1
        if shared:
            result.frame.persist()
        try:
            context = ScoreContext(session, runner)
            scores = [s.score(case, output, result, context=context) for s in scorers]
        finally:
            if shared:
                result.frame.unpersist()
        return CaseReport(case=case, output=output, result=result, scores=scores)

    def assert_eval(self, case: EvalCase, solver: Solver, scorers: Sequence[Scorer]) -> CaseReport:
        """As evaluate, recorded; anything but a pass, an inconclusive result too, is an AssertionError."""
        report = self.evaluate(case, solver, scorers)
        COLLECTOR.record(report)
        if not report.passed:
            raise AssertionError(render_case(report))
        return report

    def benchmark(self, cases: Iterable[EvalCase], solver: Solver, scorers: Sequence[Scorer], limit: int | None = None, threads: int = 1) -> BenchmarkSummary:
        """passed / total over cases (0.0 without any); threads run several cases' jobs at a time."""
        todo = list(islice(cases, limit))
        for source in {c.source.name: c.source for c in todo}.values():
            self.sources.resolve(source)
        one = lambda c: self.evaluate(c, solver, scorers)
        if threads > 1:
            with ThreadPoolExecutor(threads) as pool:
                reports = list(pool.map(one, todo))
        else:
            reports = [one(c) for c in todo]
        passed = sum(r.passed for r in reports)
        return BenchmarkSummary(total=len(reports), passed=passed, accuracy=passed / len(reports) if reports else 0.0, reports=reports)


_CASES: weakref.WeakKeyDictionary[Callable[..., Any], list[EvalCase]] = weakref.WeakKeyDictionary()


def eval_case(*cases: EvalCase, **fields: Any) -> Callable[[Callable[..., Any]], Callable[..., Any]]:
    """Attach cases to a test function; the pytest plugin runs it once for each."""

    own = [*cases, *([EvalCase(**fields)] if fields else [])]
    if not own:
        raise ValueError("eval_case needs a case")

    def mark(function: Callable[..., Any]) -> Callable[..., Any]:
        _CASES[function] = [*own, *_CASES.get(function, [])]
        return function

    return mark


def cases_of(function: Callable[..., Any]) -> list[EvalCase]:
    return list(_CASES.get(function, []))

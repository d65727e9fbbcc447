"""Decide on Spark whether a query returns the right answer."""

from importlib import import_module
from typing import Any

__version__ = "0.2.0"

#: What users need, by the module that has it; a module is loaded when something of it is first used.
_PUBLIC = {
    "model": ("CaseReport", "ColumnPresence", "ColumnType", "EvalCase", "ExecutionError", "ExecutionResult", "ExpectationSuite", "GoldQuery", "NotNull", "RowCount", "ScoreResult", "SolverOutput", "SourceRef", "TypedResultSet", "Unique", "UntypedResultSet"),
    "runner": ("BenchmarkSummary", "Engine", "eval_case"),
    "judging": ("CallableSolver", "LlmJudge", "PromptSolver", "StubLlm"),
    "scorers": ("ExecutionAccuracy", "ExpectationSuiteScorer", "FirstDecisive", "ResultSetEquivalence", "SemanticEquivalence", "observed_equivalence"),
    "plans.proof": ("PlanEquivalence",),
}
_HOME = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str) -> Any:
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)

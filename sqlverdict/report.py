"""Reports: accuracy, text for people, JSON for machines."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlverdict.model import CaseReport, ResultSetDiff


def accuracy_frame(reports: DataFrame, by: str | None = None) -> DataFrame:
    """total, passed and accuracy of reports (with a boolean passed), over all or by a column whose NULLs are left out."""
    rows = reports if by is None else reports.where(F.col(by).isNotNull())
    n, good = F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed")
    share = F.coalesce(F.round(F.avg(F.col("passed").cast("int").cast("double")), 6), F.lit(0.0)).alias("accuracy")
    return rows.agg(n, good, share) if by is None else rows.groupBy(by).agg(n, good, share)


def table(rows: list[dict[str, Any]], limit: int = 20) -> str:
    """Rows as aligned text."""
    if not rows:
        return "(no rows)"
    names = list(rows[0])
    cells = [names, *[["NULL" if r.get(n) is None else str(r[n]) for n in names] for r in rows[:limit]]]
    widths = [max(len(c[i]) for c in cells) for i in range(len(names))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(c, widths, strict=True)).rstrip() for c in cells]
    return "\n".join([lines[0], "  ".join("-" * w for w in widths), *lines[1:]])


def render_diff(diff: ResultSetDiff) -> str:
    parts = [f"rows: expected {diff.expected_row_count}, actual {diff.actual_row_count}, missing {diff.missing_row_count}, extra {diff.extra_row_count}"]
    parts += [f"missing columns: {', '.join(diff.missing_columns)}"] * bool(diff.missing_columns)
    parts += [f"unexpected columns: {', '.join(diff.unexpected_columns)}"] * bool(diff.unexpected_columns)
    parts += ["columns are in another order"] * diff.column_order_mismatch
    parts += [f"type of {t.column}: expected {t.expected}, actual {t.actual}" for t in diff.type_mismatches]
    parts += [f"values of {c.column} differ in {c.unexpected_count} row(s)" for c in diff.column_mismatches]
    for name, rows in (("missing", diff.sample_missing_rows), ("extra", diff.sample_extra_rows)):
        parts += [f"sample of {name} rows:\n{table(rows)}"] * bool(rows)
    return "\n".join(parts)


def render_case(report: CaseReport) -> str:
    """What happened to one case."""
    lines = [f"case {report.case.id}: {'passed' if report.passed else 'failed'}"]
    if report.output.error is not None:
        return "\n".join([*lines, f"solver error ({report.output.error.kind}): {report.output.error.message}"])
    lines.append(f"query: {report.output.output}")
    for s in report.scores:
        lines.append(f"{s.scorer}: {s.verdict}" + (f" ({s.basis})" if s.basis else "") + (f": {s.explanation}" if s.explanation else ""))
        lines += [render_diff(s.diff)] * (s.diff is not None)
        lines += [f"  {o.kind}{f' {o.column}' if o.column else ''}: {o.detail}" for o in s.outcomes if not o.passed]
    return "\n".join(lines)


def render_summary(reports: Iterable[CaseReport]) -> str:
    found = list(reports)
    good = sum(r.passed for r in found)
    return f"{good} of {len(found)} cases passed" + (f" ({good / len(found):.1%})" if found else "")


def run_report_json(reports: Iterable[CaseReport]) -> str:
    """All reports as JSON; rows and causes of errors stay out."""
    found = list(reports)
    body = {"total": len(found), "passed": sum(r.passed for r in found), "cases": [r.model_dump(mode="json") | {"passed": r.passed} for r in found]}
    return json.dumps(body, indent=2, default=str)


class Collector:
    """Gathers the reports of a run."""

    def __init__(self) -> None:
        self.reports: list[CaseReport] = []

    def record(self, report: CaseReport) -> None:
        self.reports.append(report)

    def clear(self) -> None:
        self.reports.clear()


COLLECTOR = Collector()

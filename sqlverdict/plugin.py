"""A pytest plugin: a case fixture for @eval_case tests, a summary and a JSON report, with xdist's workers merged."""

from __future__ import annotations

from pathlib import Path

import pytest

from sqlverdict.model import CaseReport
from sqlverdict.report import COLLECTOR, render_summary, run_report_json
from sqlverdict.runner import cases_of


def pytest_addoption(parser: pytest.Parser) -> None:
    parser.getgroup("sqlverdict").addoption("--verdict-json", default=None, help="write the run's reports to this file")


def pytest_generate_tests(metafunc: pytest.Metafunc) -> None:
    cases = cases_of(metafunc.function)
    if cases and "case" in metafunc.fixturenames:
        metafunc.parametrize("case", cases, ids=[c.id for c in cases])


def pytest_sessionstart(session: pytest.Session) -> None:
    COLLECTOR.clear()


def pytest_sessionfinish(session: pytest.Session) -> None:
    output = getattr(session.config, "workeroutput", None)
    if output is not None:  # an xdist worker: its reports go to the controller
        output["sqlverdict"] = [r.model_dump_json(exclude={"result"}) for r in COLLECTOR.reports]
    elif path := session.config.getoption("--verdict-json", None):
        Path(path).write_text(run_report_json(COLLECTOR.reports), encoding="utf-8")


@pytest.hookimpl(optionalhook=True)
def pytest_testnodedown(node: object, error: object) -> None:
    for text in getattr(node, "workeroutput", {}).get("sqlverdict", []):
        COLLECTOR.record(CaseReport.model_validate_json(text))


def pytest_terminal_summary(terminalreporter: pytest.TerminalReporter) -> None:
    if COLLECTOR.reports:
        terminalreporter.write_sep("-", "sqlverdict")
        terminalreporter.write_line(render_summary(COLLECTOR.reports))

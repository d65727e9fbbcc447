"""Commands: run tests, benchmarks and project benchmarks, import archives, look at the environment."""

from __future__ import annotations

import argparse
import json
import subprocess
import sys
from pathlib import Path

from sqlverdict import __version__
from sqlverdict.report import render_summary, run_report_json, table


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("sqlverdict").getOrCreate()


def _difficulties(summary) -> list[dict]:
    rows: dict[str, list[bool]] = {}
    for r in summary.reports:
        if level := r.case.metadata.get("difficulty"):
            rows.setdefault(level, []).append(r.passed)
    return [{"difficulty": k, "total": len(v), "passed": sum(v), "accuracy": f"{sum(v) / len(v):.1%}"} for k, v in sorted(rows.items())]


def _finish(summary, path: str | None) -> int:
    print(render_summary(summary.reports))
    if rows := _difficulties(summary):
        print(table(rows))
    if path:
        Path(path).write_text(run_report_json(summary.reports), encoding="utf-8")
    return 0


def run(a: argparse.Namespace, rest: list[str]) -> int:
    return subprocess.call([sys.executable, "-m", "pytest", "-p", "sqlverdict.plugin", *([f"--verdict-json={a.json}"] if a.json else []), *rest])


def bench(a: argparse.Namespace, _: list[str]) -> int:
    from sqlverdict.judging import SCHEMA_PROMPT, PromptSolver
    from sqlverdict.runner import Engine
    from sqlverdict.scorers import ExecutionAccuracy
    from sqlverdict.sources.benchmarks import load_bird, load_spider

    cases = load_spider(a.root, a.split) if a.dataset == "spider" else load_bird(a.root, a.split)
    # as these benchmarks score: one aligns columns by value, the other compares sets of rows
    scorer = ExecutionAccuracy(column_alignment="by_value") if a.dataset == "spider" else ExecutionAccuracy(row_order="ignore", multiplicity="set")
    return _finish(Engine(_spark()).benchmark(cases, PromptSolver(a.model, SCHEMA_PROMPT), [scorer], a.limit), a.json)


def project_bench(a: argparse.Namespace, _: list[str]) -> int:
    from sqlverdict.judging import SCHEMA_PROMPT, PromptSolver
    from sqlverdict.runner import Engine
    from sqlverdict.scorers import ExecutionAccuracy, ExpectationSuiteScorer
    from sqlverdict.sources.project import ProjectError, project_cases, source_from_profile

    source = source_from_profile(a.project, a.profiles_dir, a.target)
    cases = source if isinstance(source, ProjectError) else project_cases(a.target_dir or Path(a.project) / "target", source, a.cases, a.mode)
    if isinstance(cases, ProjectError):
        print(cases.message, file=sys.stderr)
        return 2
    scorer = ExpectationSuiteScorer() if a.mode == "tests" else ExecutionAccuracy(row_order="ignore", multiplicity="set")
    return _finish(Engine(_spark()).benchmark(cases, PromptSolver(a.model, SCHEMA_PROMPT), [scorer], a.limit), a.json)


def metric_bench(a: argparse.Namespace, _: list[str]) -> int:
    from sqlverdict.judging import MetricJudge, MetricSolver
    from sqlverdict.metrics.layer import Manifest, MetricError, metric_equivalence, run_metric_benchmark
    from sqlverdict.sources.project import ProjectError, metric_cases

    target = Path(a.target_dir or Path(a.project) / "target")
    cases, manifest = metric_cases(target, a.cases), Manifest.read(target)
    for found in (cases, manifest):
        if isinstance(found, ProjectError | MetricError):
            print(found.message, file=sys.stderr)
            return 2
    scorer = metric_equivalence(manifest, _spark(), MetricJudge(a.grader_model) if a.grader_model else None)
    summary = run_metric_benchmark(cases[: a.limit], MetricSolver(a.model), [scorer])
    print(json.dumps(summary))
    if a.json:
        Path(a.json).write_text(json.dumps(summary), encoding="utf-8")
    return 0


def fetch(a: argparse.Namespace, _: list[str]) -> int:
    from sqlverdict.sources.benchmarks import ARCHIVES, FetchError, import_archive

    found = import_archive(a.archive, ARCHIVES[a.dataset], a.cache_dir, a.trust, a.force)
    print(found.message if isinstance(found, FetchError) else found)
    return 1 if isinstance(found, FetchError) else 0


def doctor(a: argparse.Namespace, _: list[str]) -> int:
    import importlib.util

    print(f"sqlverdict {__version__}, python {sys.version.split()[0]}")
    for name in ("pyspark", "pydantic", "yaml", "litellm"):
        print(f"{name}: {'found' if importlib.util.find_spec(name) else 'not installed'}")
    try:
        print(f"spark: {_spark().sql('SELECT 1').first()[0] == 1 and 'runs queries'}")
    except Exception as e:
        print(f"spark: {e}")
        return 1
    if a.sqlite:
        from sqlverdict.model import SourceRef
        from sqlverdict.sources.registry import Registry

        try:
            session = Registry(_spark()).resolve(SourceRef(name="doctor", kind="sqlite", config={"path": a.sqlite}))
            print(f"sqlite: {len(session.catalog.listTables())} tables")
        except Exception as e:
            print(f"sqlite: {e}")
            return 1
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("sqlverdict", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(f, name: str, *arguments: tuple) -> None:
        own = sub.add_parser(name, help=f.__doc__)
        own.set_defaults(f=f)
        for names, options in arguments:
            own.add_argument(*names, **options)

    arg = lambda *names, **options: (names, options)
    common = (arg("--model", required=True), arg("--limit", type=int), arg("--json"))
    where = (arg("project"), arg("--target-dir"), arg("--profiles-dir"), arg("--target"))
    command(run, "run", arg("--json"))
    command(bench, "bench", arg("dataset", choices=("spider", "bird")), arg("root"), arg("--split", default="dev"), *common)
    command(project_bench, "project-bench", *where, arg("--cases"), arg("--mode", choices=("authored", "model", "tests"), default="authored"), *common)
    command(metric_bench, "metric-bench", *where, arg("--cases", required=True), arg("--grader-model"), *common)
    command(fetch, "fetch", arg("dataset", choices=("spider", "bird")), arg("archive"), arg("--cache-dir", default=str(Path.home() / ".cache" / "sqlverdict")), arg("--trust", action="store_true"), arg("--force", action="store_true"))
    command(doctor, "doctor", arg("--sqlite"))
    return p


def main(args: list[str] | None = None) -> int:
    found, rest = parser().parse_known_args(args)
    if rest and found.command != "run":
        parser().error(f"unrecognized arguments: {' '.join(rest)}")
    return found.f(found, rest)


if __name__ == "__main__":
    sys.exit(main())

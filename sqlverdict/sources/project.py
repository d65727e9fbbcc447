"""A transformation project's build artifacts: its tables, tests and metrics as cases and as context for prompts."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path
from typing import Any, Literal

import yaml

from sqlverdict.metrics.layer import Manifest, MetricCase, MetricError, MetricQuery
from sqlverdict.model import EvalCase, ExpectationSuite, Failure, GoldQuery, NotNull, SourceRef, Unique

Mode = Literal["authored", "model", "tests"]
#: The oldest manifest format that is read.
OLDEST = 10


class ProjectError(Failure):
    kind: Literal["target_not_found", "unsupported_version", "unreadable", "cases_required", "profile_not_found", "unsupported_adapter"]


@dataclass(frozen=True)
class ProjectColumn:
    name: str
    type: str | None = None
    description: str | None = None


@dataclass(frozen=True)
class ProjectTest:
    kind: str
    column: str | None


@dataclass(frozen=True)
class ProjectTable:
    """A model or source: how it is called, what it holds, how it is made, what is tested."""

    name: str
    relation: str
    columns: tuple[ProjectColumn, ...]
    description: str | None = None
    sql: str | None = None
    tests: tuple[ProjectTest, ...] = ()


@dataclass(frozen=True)
class Project:
    models: tuple[ProjectTable, ...]
    sources: tuple[ProjectTable, ...]
    metrics: Manifest | None = None
    descriptions: dict[str, Any] | None = None

    def schema_text(self, select: list[str] | None = None, include_sources: bool = True, include_models: bool = True) -> str:
        """CREATE TABLE text of the chosen tables."""
        tables = [*(self.sources if include_sources else ()), *(self.models if include_models else ())]
        blocks = []
        for t in tables:
            if select is not None and t.name not in select:
                continue
            lines = [f"  {c.name}{f' {c.type}' if c.type else ''}{',' if i < len(t.columns) - 1 else ''}{f'  -- {c.description}' if c.description else ''}" for i, c in enumerate(t.columns)]
            blocks.append("\n".join([*([f"-- {t.description}"] if t.description else []), f"CREATE TABLE {t.relation} (", *lines, ");"]))
        return "\n\n".join(blocks)

    def metrics_text(self) -> str:
        """Metrics and semantic models for prompts; dimensions that several models share are listed once."""
        if self.metrics is None:
            return ""
        parts = []
        if self.metrics.metrics:
            parts.append("Metrics:\n" + "\n".join(f"  {m.name} ({m.kind})" for m in self.metrics.metrics.values()))
        seen: set[str] = set()
        for m in self.metrics.models.values():
            dims = [d for d in m.dimensions.values() if d.name not in seen]
            seen |= {d.name for d in dims}
            lines = [f"Semantic model: {m.name}"]
            lines += ["  entities: " + ", ".join(f"{n} ({t})" for n, (t, _) in m.entities.items())] * bool(m.entities)
            lines += ["  dimensions: " + ", ".join(f"{d.name} ({'time, ' + d.grain if d.grain else 'categorical'})" for d in dims)] * bool(dims)
            lines += ["  measures: " + ", ".join(f"{x.name} ({x.agg})" for x in m.measures.values())] * bool(m.measures)
            parts.append("\n".join(lines))
        return "\n\n".join(parts)


def read_yaml(path: str | Path) -> Any | ProjectError:
    try:
        return yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError) as e:
        return ProjectError(kind="unreadable", message=f"can't read {path}: {e}", cause=e)


def read_project(target: str | Path) -> Project | ProjectError:
    """manifest.json (version 10 or later), with catalog.json's types and semantic_manifest.json's metrics where there are any."""
    folder = Path(target)
    path = folder / "manifest.json"
    if not path.is_file():
        return ProjectError(kind="target_not_found", message=f"no manifest.json in {folder}")
    try:
        data = json.loads(path.read_text(encoding="utf-8"))
        catalog = json.loads((folder / "catalog.json").read_text(encoding="utf-8")) if (folder / "catalog.json").is_file() else {}
    except (OSError, ValueError) as e:
        return ProjectError(kind="unreadable", message=f"can't read the artifacts in {folder}: {e}", cause=e)
    version = str(data.get("metadata", {}).get("dbt_schema_version", "")).rstrip("/").rsplit("/", 1)[-1].removesuffix(".json").removeprefix("v")
    if not version.isdigit() or int(version) < OLDEST:
        return ProjectError(kind="unsupported_version", message=f"manifest version {version or 'unknown'}; {OLDEST} or later is needed")
    tests: dict[str, list[ProjectTest]] = {}
    for n in data.get("nodes", {}).values():
        if n.get("resource_type") == "test" and (own := n.get("test_metadata")):
            tests.setdefault(n.get("attached_node") or next(iter(n.get("depends_on", {}).get("nodes", [])), ""), []).append(ProjectTest(own["name"], n.get("column_name") or own.get("kwargs", {}).get("column_name")))

    def table(key: str, n: dict[str, Any], known: dict[str, Any]) -> ProjectTable:
        declared, typed = n.get("columns", {}), known.get(key, {}).get("columns")
        told = lambda c: declared.get(c, {}).get("description") or None
        if typed:
            columns = tuple(ProjectColumn(c, x["type"], told(c)) for c, x in sorted(typed.items(), key=lambda i: i[1]["index"]))
        else:
            columns = tuple(ProjectColumn(c, x.get("data_type"), told(c)) for c, x in declared.items())
        return ProjectTable(n["name"], n.get("relation_name") or n["name"], columns, n.get("description") or None, n.get("compiled_code"), tuple(tests.get(key, ())))

    models = tuple(table(k, n, catalog.get("nodes", {})) for k, n in data.get("nodes", {}).items() if n.get("resource_type") == "model")
    sources = tuple(table(k, n, catalog.get("sources", {})) for k, n in data.get("sources", {}).items())
    metrics = Manifest.read(folder)
    return Project(models, sources, None if isinstance(metrics, MetricError) else metrics)


def project_cases(target: str | Path, source: SourceRef, cases: str | Path | None = None, mode: Mode = "authored") -> list[EvalCase] | ProjectError:
    """authored: from a cases file; model: each documented model's own query; tests: its data tests as a suite."""
    project = read_project(target)
    if isinstance(project, ProjectError):
        return project
    if mode == "authored":
        if cases is None:
            return ProjectError(kind="cases_required", message="the authored mode needs a cases file")
        entries = read_yaml(cases)
        if isinstance(entries, ProjectError):
            return entries
        return [EvalCase(id=e.get("id") or f"authored/{i}", input=e["question"], expected=GoldQuery(sql=e["gold_sql"]), source=source, metadata={"schema_ddl": project.schema_text(e.get("select"))}) for i, e in enumerate(entries or [])]
    out = []
    for m in project.models:
        if not m.description:
            continue
        if mode == "model" and m.sql:
            out.append(EvalCase(id=f"model/{m.name}", input=m.description, expected=GoldQuery(sql=m.sql), source=source, metadata={"schema_ddl": project.schema_text()}))
        checks = [NotNull(column=t.column) if t.kind == "not_null" else Unique(column=t.column) for t in m.tests if t.kind in ("not_null", "unique") and t.column]
        if mode == "tests" and checks:
            out.append(EvalCase(id=f"tests/{m.name}", input=m.description, expected=ExpectationSuite(expectations=checks), source=source, metadata={"schema_ddl": project.schema_text()}))
    return out


def metric_cases(target: str | Path, cases: str | Path) -> list[MetricCase] | ProjectError:
    """Cases of {question, metrics, group_by, where, order_by, limit, id} entries, with the metrics as context."""
    project = read_project(target)
    if isinstance(project, ProjectError):
        return project
    entries = read_yaml(cases)
    if isinstance(entries, ProjectError):
        return entries
    fields = ("metrics", "group_by", "where", "order_by", "limit")
    return [MetricCase(id=e.get("id") or f"metric/{i}", input=e["question"], expected=MetricQuery(**{k: e[k] for k in fields if k in e}), metadata={"sl_context": project.metrics_text()}) for i, e in enumerate(entries or [])]


def source_from_profile(project_dir: str | Path, profiles_dir: str | Path | None = None, target: str | None = None) -> SourceRef | ProjectError:
    """The source that a project's profile names. Passwords are never put into it."""
    folder = Path(project_dir)
    project, profiles = read_yaml(folder / "dbt_project.yml"), read_yaml(Path(profiles_dir or folder) / "profiles.yml")
    for found in (project, profiles):
        if isinstance(found, ProjectError):
            return found
    profile = (profiles or {}).get((project or {}).get("profile"))
    output = ((profile or {}).get("outputs") or {}).get(target or (profile or {}).get("target"))
    if not isinstance(output, dict):
        return ProjectError(kind="profile_not_found", message=f"no profile for {folder.name} with such a target")
    kind, name = output.get("type"), str((project or {}).get("profile"))
    if kind == "sqlite" or (kind == "duckdb" and str(output.get("path", "")).endswith((".sqlite", ".db3"))):
        path = Path(str(output["path"]))
        return SourceRef(name=name, kind="sqlite", config={"path": str(path if path.is_absolute() else folder / path)})
    if kind == "postgres":
        return SourceRef(name=name, kind="jdbc", config={"url": f"jdbc:postgresql://{output.get('host', 'localhost')}:{output.get('port', 5432)}/{output.get('dbname', '')}", "user": output.get("user"), "tables": []})
    if kind in ("spark", "databricks"):
        return SourceRef(name=name, kind="catalog", config={"database": output["schema"]} if output.get("schema") else {})
    return ProjectError(kind="unsupported_adapter", message=f"no source for adapter {kind!r}")

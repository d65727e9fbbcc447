"""Text-to-SQL benchmarks: cases from their files, and archives verified before use."""

from __future__ import annotations

import hashlib
import json
import shutil
import sqlite3
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any, Literal

from sqlverdict.model import EvalCase, Failure, GoldQuery, SourceRef


def _case(source: str, case_id: str, question: str, gold: str, db_id: str, path: Path, **metadata: Any) -> EvalCase:
    ref = SourceRef(name=f"{source}/{db_id}", kind="sqlite", config={"path": str(path)})
    return EvalCase(id=case_id, input=question, expected=GoldQuery(sql=gold), source=ref, metadata={"source": source, "db_id": db_id, "schema_ddl": sqlite_ddl(str(path))} | metadata)


_DDL: dict[str, str] = {}


def sqlite_ddl(path: str) -> str:
    """The CREATE statements of a database, read once; empty if there is no file."""
    if path not in _DDL:
        if not Path(path).is_file():
            return ""
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            _DDL[path] = "\n\n".join(sql for (sql,) in db.execute("SELECT sql FROM sqlite_master WHERE sql IS NOT NULL AND name NOT LIKE 'sqlite_%' ORDER BY rowid"))
    return _DDL[path]


def load_spider(root: str | Path, split: str = "dev") -> Iterator[EvalCase]:
    """Cases of <split>.json with the databases in database/<db_id>/<db_id>.sqlite."""
    for i, r in enumerate(json.loads((Path(root) / f"{split}.json").read_text(encoding="utf-8"))):
        yield _case("spider", f"spider/{r['db_id']}/{i}", r["question"], r["query"], r["db_id"], Path(root) / "database" / r["db_id"] / f"{r['db_id']}.sqlite", split=split)


def load_bird(root: str | Path, split: str = "dev", include_evidence: bool = True) -> Iterator[EvalCase]:
    """Cases of <split>.json with the databases in <split>_databases; a record's evidence is put after its question."""
    for i, r in enumerate(json.loads((Path(root) / f"{split}.json").read_text(encoding="utf-8"))):
        evidence, db = r.get("evidence") or "", r["db_id"]
        question = f"{r['question']}\nEvidence: {evidence}" if evidence and include_evidence else r["question"]
        more = {"difficulty": r["difficulty"]} if "difficulty" in r else {}
        case_id = f"bird/{r['question_id']}" if r.get("question_id") is not None else f"bird/{db}/{i}"
        yield _case("bird", case_id, question, r["SQL"], db, Path(root) / f"{split}_databases" / db / f"{db}.sqlite", split=split, evidence=evidence, **more)


class FetchError(Failure):
    kind: Literal["untrusted", "hash_mismatch", "bad_archive", "wrong_case_count", "bad_database", "not_found"]


@dataclass(frozen=True)
class Archive:
    """What an archive of a benchmark must be; digest None: not pinned, so it has to be trusted."""

    name: str
    cases: int
    databases: str
    digest: str | None = None
    split: str = "dev"


#: The published sizes, folders and SHA-256 digests of two benchmarks' archives.
ARCHIVES = {
    "bird": Archive("bird", 1534, "dev_databases", "cdd6d19faeb45a23970b98d3ef6c40a87987c95459c2cf12076897a60cf5a630"),
    "spider": Archive("spider", 1034, "database", "00636695dabed6b5f4b8328a16b13e069a2f16591d5efcce57660669c85b121b"),
}


def _integrity(root: Path, spec: Archive) -> FetchError | None:
    records = json.loads((root / f"{spec.split}.json").read_text(encoding="utf-8"))
    if len(records) != spec.cases:
        return FetchError(kind="wrong_case_count", message=f"{len(records)} cases, expected {spec.cases}")
    for db in sorted({r["db_id"] for r in records}):
        path = root / spec.databases / db / f"{db}.sqlite"
        try:
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as connection:
                if connection.execute("PRAGMA integrity_check").fetchone()[0] != "ok":
                    return FetchError(kind="bad_database", message=f"{db} is damaged")
        except sqlite3.Error as e:
            return FetchError(kind="bad_database", message=f"{db}: {e}", cause=e)
    return None


def import_archive(archive: str | Path, spec: Archive, cache: str | Path, trust: bool = False, force: bool = False) -> Path | FetchError:
    """A verified, unpacked copy of a local archive in a folder named by its digest.

    The digest is compared with the pinned one, or must be trusted; the number of cases and the databases are
    checked before the copy takes its place.
    """
    path = Path(archive)
    if not path.is_file():
        return FetchError(kind="not_found", message=f"no archive at {path}")
    digest = hashlib.sha256()
    with path.open("rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    found = digest.hexdigest()
    if spec.digest is not None and found != spec.digest:
        return FetchError(kind="hash_mismatch", message=f"the archive's SHA-256 is {found}, pinned is {spec.digest}")
    if spec.digest is None and not trust:
        return FetchError(kind="untrusted", message=f"no SHA-256 is pinned; the archive has {found}")
    target = Path(cache) / spec.name / found
    if target.is_dir() and not force:
        return target
    work = target.with_suffix(".new")
    shutil.rmtree(work, ignore_errors=True)
    try:
        with zipfile.ZipFile(path) as z:
            if any(Path(n).is_absolute() or ".." in Path(n).parts for n in z.namelist()):
                return FetchError(kind="bad_archive", message="the archive has paths outside its folder")
            z.extractall(work)
        for nested in work.rglob(f"{spec.databases}.zip"):
            with zipfile.ZipFile(nested) as z:
                if any(Path(n).is_absolute() or ".." in Path(n).parts for n in z.namelist()):
                    return FetchError(kind="bad_archive", message="the archive has paths outside its folder")
                z.extractall(nested.parent)
        root = next(p.parent for p in sorted(work.rglob(f"{spec.split}.json"), key=lambda p: len(p.parts)))
    except (zipfile.BadZipFile, StopIteration) as e:
        shutil.rmtree(work, ignore_errors=True)
        return FetchError(kind="bad_archive", message=str(e) or f"no {spec.split}.json in the archive", cause=e)
    if bad := _integrity(root, spec):
        shutil.rmtree(work, ignore_errors=True)
        return bad
    shutil.rmtree(target, ignore_errors=True)
    target.parent.mkdir(parents=True, exist_ok=True)
    shutil.move(str(root), str(target))
    shutil.rmtree(work, ignore_errors=True)
    return target

"""Proofs that two queries are equivalent, from their plans alone: no data is read.

A proof is one of: the analyzed plans have the same semantics; the optimized plans give the same result; they do
after two rewrites that Catalyst lacks (a filter implied by a stricter one on the same column is dropped, and
constant - column is solved for the column), which hold where the conditions refer to integers and decimals alone, and
speak of results, not of overflow errors. Everything else is "unknown"; nothing is ever refuted.

What would make a comparison unsound is shut out: output names and types must agree; anything whose value changes
between runs is refused; the rule that evaluates literal tables is switched off and plans over such tables are
refused, since equal data would pass for equal queries.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal

from pyspark.sql import SparkSession

from sqlverdict.model import NormalizationError, SemanticVerdict
from sqlverdict.sources.session import FAILURES

#: Functions whose results change between runs or places.
UNSTABLE = {
    "rand", "randn", "random", "uuid", "shuffle", "randstr", "uniform",
    "currenttimestamp", "currentdate", "currenttime", "now", "localtimestamp", "currentuser", "currenttimezone",
    "currentbatchtimestamp", "unixtimestamp", "monotonicallyincreasingid", "sparkpartitionid", "inputfilename",
    "inputfileblockstart", "inputfileblocklength", "sparkversion", "currentdatabase", "currentcatalog",
}
FOLDING = "org.apache.spark.sql.catalyst.optimizer.ConvertToLocalRelation"
EXCLUDED = "spark.sql.optimizer.excludedRules"


class _Refused(Exception):
    def __init__(self, kind: str, message: str) -> None:
        super().__init__(message)
        self.kind = kind


def _nodes(tree):
    """All expression and plan classes in a plan's JSON, simple names in lower case."""
    if isinstance(tree, dict):
        if "class" in tree:
            yield str(tree["class"]).rsplit(".", 1)[-1].rstrip("$").lower()
        for v in tree.values():
            yield from _nodes(v)
    elif isinstance(tree, list):
        for v in tree:
            yield from _nodes(v)


class Query:
    """A parsed and analyzed query."""

    def __init__(self, spark: SparkSession, sql: str) -> None:
        text = sql.strip()
        try:
            spark._jsparkSession.sessionState().sqlParser().parsePlan(text.rstrip(";").rstrip())
        except FAILURES as e:
            # a semicolon with more after it is a second statement
            bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`", "", text)
            kind = "not_single_statement" if re.search(r";\s*\S", bare) else "parse_failed"
            raise _Refused(kind, str(e).split("\n")[0]) from e
        try:
            self.execution = spark.sql(text.rstrip(";"))._jdf.queryExecution()
            self.analyzed = self.execution.analyzed()
        except FAILURES as e:
            raise _Refused("normalize_failed", str(e).split("\n")[0]) from e
        # subqueries are in the plan's JSON only as text, so names are looked for there, too
        tree = json.loads(self.analyzed.toJSON())
        names = set(_nodes(tree)) | {w.lower().replace("_", "") for w in re.findall(r"\b([A-Za-z_]+)\(", self.analyzed.toString())}
        if not self.analyzed.deterministic() or names & UNSTABLE:
            raise _Refused("non_deterministic", "the query's result changes between runs")
        if "localrelation" in names or "LocalRelation" in self.analyzed.toString():
            raise _Refused("normalize_failed", "the query reads a literal table, whose data would count as part of the query")
        out = self.analyzed.output()
        self.shape = [(out.apply(i).name().lower(), out.apply(i).dataType().json()) for i in range(out.size())]


def _number(text: str) -> Decimal | None:
    return Decimal(text) if re.fullmatch(r"-?\d{1,15}(?:\.\d{1,9})?", text) else None


_COLUMN = r"[A-Za-z_][\w.]*"
_NUMBER = r"-?\d{1,15}(?:\.\d{1,9})?"
_FLIPPED = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
_COMPARISON = re.compile(rf"^\(?\s*(?:({_COLUMN})\s*(<=|>=|<|>|=)\s*({_NUMBER})|({_NUMBER})\s*(<=|>=|<|>|=)\s*({_COLUMN})|({_NUMBER})\s*-\s*({_COLUMN})\s*(<=|>=|<|>|=)\s*({_NUMBER}))\s*\)?$")


def _split_and(where: str) -> list[str] | None:
    """The members of a conjunction without parentheses around several of them; None where it has other operators."""
    if re.search(r"\b(or|not|between|case|in|like|select|is)\b|['\"`]", where, re.I):
        return None
    return [p.strip() for p in re.split(r"\band\b", where, flags=re.I)]


def simplified(sql: str) -> str:
    """The query with its conjunction of simple comparisons reduced: the strictest bound of each column stays."""
    m = re.fullmatch(r"(?is)(\s*select\b(?:(?!\bselect\b|\bwhere\b).)*)\bwhere\b((?:(?!\bselect\b|\bgroup\b|\border\b|\blimit\b|\bhaving\b|\bunion\b|\bexcept\b|\bintersect\b).)*)(.*)", sql)
    members = m and _split_and(m[2])
    if not members:
        return sql
    bounds: dict[tuple[str, str], tuple[Decimal, bool]] = {}
    rest: list[str] = []
    for member in members:
        c = _COMPARISON.match(member)
        if not c:
            rest.append(member)
            continue
        if c[1]:
            column, op, number = c[1], c[2], _number(c[3])
        elif c[6]:
            column, op, number = c[6], _FLIPPED[c[5]], _number(c[4])
        else:  # n - column op k: column flipped-op n - k
            column, op, number = c[8], _FLIPPED[c[9]], _number(c[7]) - _number(c[10])
        if op == "=":
            rest.append(f"{column} = {number}")
            continue
        key = (column.lower(), op[0])
        strict = len(op) == 1
        old = bounds.get(key)
        tighter = old is None or (number > old[0] if op[0] == ">" else number < old[0]) or (number == old[0] and strict)
        if tighter:
            bounds[key] = (number, strict)
    parts = sorted(rest) + [f"{c} {o}{'' if s else '='} {n}" for (c, o), (n, s) in sorted(bounds.items())]
    return f"{m[1]}WHERE {' AND '.join(parts)} {m[3]}"


def _children(plan):
    found = plan.children()
    return [found.apply(i) for i in range(found.size())]


def _exact(query: Query) -> bool:
    """Whether all that the query's conditions refer to, in any relation and under any name, is exact: doubles round.

    The types are those of the analyzed plan's attributes. A decimal is exact if a difference with a number of the
    rewrites (15 and 9 digits) keeps all its digits within the 38 that there are.
    """
    plans = [query.analyzed]
    while plans:
        plan = plans.pop()
        plans += _children(plan)
        if plan.getClass().getSimpleName() not in ("Filter", "Join"):
            continue
        refs = plan.references().toSeq()
        for kind in (refs.apply(i).dataType() for i in range(refs.size())):
            name = kind.typeName()
            if name.startswith("decimal"):
                if kind.precision() - kind.scale() > 28 or kind.scale() > 9:
                    return False
            elif name not in ("byte", "short", "integer", "long"):
                return False
    return True


class PlanEquivalence:
    """Compares plans; the method of a confirmed pair is "plan", or "rewrite" if it took the rewrites."""

    def judge(self, spark: SparkSession, left: str, right: str) -> SemanticVerdict:
        old = spark.conf.get(EXCLUDED, None)
        spark.conf.set(EXCLUDED, f"{old},{FOLDING}" if old else FOLDING)
        try:
            a, b = Query(spark, left), Query(spark, right)
            if a.shape != b.shape:
                return SemanticVerdict(method="plan", equivalence="unknown", detail="output names or types differ")
            if self._same(a, b):
                return SemanticVerdict(method="plan", equivalence="equivalent")
            one, two = simplified(left), simplified(right)
            if (one != left or two != right) and _exact(a) and _exact(b):
                a, b = Query(spark, one), Query(spark, two)
                if a.shape == b.shape and self._same(a, b):
                    return SemanticVerdict(method="rewrite", equivalence="equivalent")
            return SemanticVerdict(method="plan", equivalence="unknown", detail="the plans differ")
        except _Refused as e:
            return SemanticVerdict(method="plan", equivalence="unknown", detail=str(e) or e.kind, error=NormalizationError(kind=e.kind, message=str(e) or e.kind))
        except FAILURES as e:  # such as a constant division by zero while folding
            message = str(e).split("\n")[0] or type(e).__name__
            return SemanticVerdict(method="plan", equivalence="unknown", detail=message, error=NormalizationError(kind="normalize_failed", message=message))
        finally:
            spark.conf.unset(EXCLUDED) if old is None else spark.conf.set(EXCLUDED, old)

    @staticmethod
    def _same(a: Query, b: Query) -> bool:
        return a.analyzed.sameResult(b.analyzed) or a.execution.optimizedPlan().sameResult(b.execution.optimizedPlan())


def ordered(spark: SparkSession, sql: str) -> bool:
    """Whether a query has an ORDER BY at its top; orders in windows and subqueries don't count, nor does SORT BY."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql.strip().rstrip(";"))
    except FAILURES:
        return False
    while True:
        name = plan.getClass().getSimpleName()
        if name == "Sort":
            return bool(getattr(plan, "global")())
        if name not in ("GlobalLimit", "LocalLimit", "Offset", "UnresolvedWith", "WithCTE"):
            return False
        plan = plan.child()


def ordered_text(sql: str) -> bool:
    """The same for queries in a dialect that Spark doesn't parse: an ORDER BY outside of all parentheses and literals."""
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|\[[^\]]*\]|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    while (inner := re.sub(r"\([^()]*\)", " ", bare)) != bare:
        bare = inner
    return bool(re.search(r"\border\s+by\b", bare, re.I))

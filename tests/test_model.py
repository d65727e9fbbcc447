import pytest
from pydantic import ValidationError
from sqlverdict.functions.sqltypes import SqlType
from sqlverdict.model import Column, EvalCase, ExpectationSuite, GoldQuery, RowCount, ScoreResult, SolverError, SolverOutput, SourceRef, TypedResultSet, UntypedResultSet
from sqlverdict.operators.align import round_scale
from sqlverdict.operators.columns import reconcile

HERE = SourceRef(name="here")


@pytest.mark.parametrize(("a", "b", "same"), [("BIGINT", "int8", True), ("varchar", " TEXT ", True), ("decimal(10,2)", "DECIMAL(10, 2)", True), ("decimal(10,2)", "decimal(10,3)", False), ("int[]", "array<int>", True), ("double precision", "float8", True), ("int", "bigint", False), ("no such type", "no such type", True), ("no such type", "another", False)])
def test_types(a, b, same):
    left, right = SqlType.model_validate(a), SqlType.model_validate(b)
    assert (left == right) is same
    if same:
        assert hash(left) == hash(right)


def test_types_keep_their_text():
    t = SqlType.model_validate("Int8")
    assert (t.raw, t.canonical, t.model_dump()) == ("Int8", "bigint", "Int8")
    assert SqlType.model_validate("geometry(4326)").canonical is None
    with pytest.raises(ValidationError):
        SqlType.model_validate(" ")


@pytest.mark.parametrize(("tolerance", "scale"), [(1e-9, 9), (0.1, 1), (0.5, 0), (1.0, 0), (100, 0), (3e-4, 4)])
def test_round_scale(tolerance, scale):
    assert round_scale(tolerance) == scale


def test_expected_rows_are_typed_if_they_have_a_schema():
    case = lambda e: EvalCase(id="a", input="q", expected=e, source=HERE).expected
    assert isinstance(case({"rows": [{"a": 1}]}), UntypedResultSet)
    assert isinstance(case({"rows": [], "schema": [{"name": "a", "type": "int"}]}), TypedResultSet)
    assert isinstance(case({"kind": "gold", "sql": "SELECT 1"}), GoldQuery)


@pytest.mark.parametrize(
    "make",
    [
        lambda: EvalCase(id="", input="q", expected=GoldQuery(sql="x"), source=HERE),
        lambda: EvalCase(id="a", input="q", expected=GoldQuery(sql="x"), source=HERE, other=1),
        lambda: SourceRef(name="a", dialect="duckdb"),
        lambda: TypedResultSet(rows=[], schema=[Column(name="a", type="int"), Column(name="a", type="int")]),
        lambda: ExpectationSuite(expectations=[]),
        lambda: RowCount(exact=-1),
        lambda: SolverOutput(),
        lambda: SolverOutput(output="x", error=SolverError(kind="auth", message="m")),
        lambda: ScoreResult(scorer="s", verdict="inconclusive", basis="observed"),
        lambda: ScoreResult(scorer="s", verdict="inconclusive", score=0.5),
        lambda: ScoreResult(scorer="s", verdict="pass", score=1.5),
    ],
)
def test_invalid_values_are_rejected(make):
    with pytest.raises(ValidationError):
        make()


def test_causes_are_not_serialized():
    e = SolverError(kind="auth", message="m", cause=ValueError("secret"))
    assert "secret" not in e.model_dump_json()
    assert SolverError.model_validate_json(e.model_dump_json()).message == "m"


def test_reconcile():
    m = reconcile(["b", "A", "c"], ["a", "b", "c"], "strict")
    assert (m.in_both, m.missing, m.unexpected, m.order_mismatch) == (["b", "c"], ["a"], ["A"], False)
    assert reconcile(["b", "a"], ["a", "b"], "strict").order_mismatch
    assert not reconcile(["b", "a"], ["a", "b"]).order_mismatch

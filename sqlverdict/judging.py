"""Language models as solvers and judges, behind one small protocol. No provider is needed to import this."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from typing import Annotated, Any, Literal, Protocol

from pydantic import Field, ValidationError, model_validator

from sqlverdict.metrics.layer import MetricCase, MetricQuery, MetricSolverOutput
from sqlverdict.model import Count, EvalCase, ExecutionResult, Failure, GoldQuery, ProviderFailure, ScoreResult, SolverError, SolverOutput, Strict, Text
from sqlverdict.scorers import FirstDecisive, ScoreContext, SemanticEquivalence

Share = Annotated[float, Field(ge=0, le=1)]


class LlmError(Failure):
    kind: ProviderFailure | Literal["malformed_response"]
    provider: str | None = None


class Usage(Strict):
    prompt_tokens: Count | None = None
    completion_tokens: Count | None = None
    latency_seconds: Annotated[float, Field(ge=0)] | None = None
    cost_usd: Annotated[float, Field(ge=0)] | None = None


class Completion(Strict):
    text: str
    usage: Usage = Field(default_factory=Usage)


class Llm(Protocol):
    def complete(self, prompt: str) -> Completion | LlmError: ...


class StubLlm:
    """Answers from a list, then from its last entry; keeps the prompts."""

    def __init__(self, *answers: str | LlmError) -> None:
        self.answers, self.prompts = list(answers), []

    def complete(self, prompt: str) -> Completion | LlmError:
        self.prompts.append(prompt)
        answer = self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]
        return answer if isinstance(answer, LlmError) else Completion(text=answer)


class LiteLlm:
    """A model by name through the litellm package, where that is installed."""

    #: That package's exceptions and what they are here.
    KINDS = {"Timeout": "timeout", "RateLimitError": "rate_limit", "AuthenticationError": "auth", "ContextWindowExceededError": "context_window_exceeded", "BadRequestError": "bad_request", "ServiceUnavailableError": "unavailable", "APIConnectionError": "unavailable"}

    def __init__(self, model: str, temperature: float | None = None, timeout: float | None = None) -> None:
        self.model, self.options = model, {k: v for k, v in (("temperature", temperature), ("timeout", timeout)) if v is not None}

    def complete(self, prompt: str) -> Completion | LlmError:
        try:
            import litellm
        except ImportError as e:
            return LlmError(kind="unavailable", message="litellm is not installed", cause=e)
        try:
            r = litellm.completion(model=self.model, messages=[{"role": "user", "content": prompt}], **self.options)
        except Exception as e:  # that package raises many types
            return LlmError(kind=self.KINDS.get(type(e).__name__, "unknown"), message=str(e) or type(e).__name__, provider=getattr(e, "llm_provider", None), cause=e)
        used = getattr(r, "usage", None)
        return Completion(text=r.choices[0].message.content or "", usage=Usage(prompt_tokens=getattr(used, "prompt_tokens", None), completion_tokens=getattr(used, "completion_tokens", None)))


def resolve(model: str | Llm, **options: Any) -> Llm:
    return LiteLlm(model, **options) if isinstance(model, str) else model


def fenced(text: str) -> str:
    """What stands in the first code fence, else the whole text."""
    m = re.search(r"```[\w+-]*[ \t]*\n?(.*?)```", text, re.S)
    return (m[1] if m else text).strip()


class CallableSolver:
    """A function of the case that returns SQL; what it raises is the solver's error."""

    def __init__(self, function: Callable[[EvalCase], str]) -> None:
        self.function = function

    def solve(self, case: EvalCase) -> SolverOutput:
        try:
            sql = self.function(case)
        except Exception as e:
            return SolverOutput(error=SolverError(kind="solver_failed", message=str(e) or type(e).__name__, cause=e))
        return SolverOutput(output=sql) if sql and sql.strip() else SolverOutput(error=SolverError(kind="empty_response", message="the solver returned no SQL"))


PROMPT = "Write one {dialect} SQL query that answers the question. Reply with the query in a code fence.\n\nQuestion: {input}\n"
SCHEMA_PROMPT = "Write one {dialect} SQL query that answers the question over these tables. Reply with the query in a code fence.\n\n{schema}\n\nQuestion: {input}\n"


class PromptSolver:
    """Asks a model for SQL."""

    def __init__(self, model: str | Llm, template: str = PROMPT, **options: Any) -> None:
        self.llm, self.template = resolve(model, **options), template
        self.model = model if isinstance(model, str) else type(model).__name__

    def solve(self, case: EvalCase) -> SolverOutput:
        found = self.llm.complete(self.template.format_map({"dialect": case.source.dialect, "input": case.input, "schema": case.metadata.get("schema_ddl", "")}))
        if isinstance(found, LlmError):
            kind = "solver_failed" if found.kind == "malformed_response" else found.kind
            return SolverOutput(error=SolverError(kind=kind, message=found.message, provider=found.provider, cause=found.cause))
        sql = fenced(found.text)
        if not sql:
            return SolverOutput(error=SolverError(kind="empty_response", message="the model returned no SQL"))
        return SolverOutput(output=sql, metadata={"model": self.model}, **found.usage.model_dump())


class JudgeReply(Strict):
    score: float
    reason: str = ""


class JudgeExample(Strict):
    actual_output: Text
    expected_output: Text | None = None
    score: Share
    reason: Text


class RubricBand(Strict):
    low: Share
    high: Share
    description: Text

    @model_validator(mode="after")
    def _in_order(self) -> RubricBand:
        if self.low > self.high:
            raise ValueError("a band's low is above its high")
        return self


def ask_judge(llm: Llm, prompt: str) -> JudgeReply | LlmError:
    """A graded reply, its score brought into 0 to 1."""
    found = llm.complete(prompt)
    if isinstance(found, LlmError):
        return found
    try:
        reply = JudgeReply.model_validate(json.loads(fenced(found.text)))
    except (ValueError, ValidationError) as e:
        return LlmError(kind="malformed_response", message=f"can't read the reply: {e}", cause=e)
    return reply.model_copy(update={"score": min(1.0, max(0.0, reply.score))})


class LlmJudge:
    """A grader model scores against criteria; without a readable grade the result is inconclusive."""

    name = "llm_judge"

    def __init__(self, *, model: str | Llm, criteria: str, steps: Sequence[str] = (), examples: Sequence[JudgeExample] = (), rubric: Sequence[RubricBand] = (), threshold: float = 0.5, show: Sequence[str] = ("input", "actual_output", "expected_output"), **options: Any) -> None:
        self.llm, self.criteria, self.steps, self.examples = resolve(model, **({"temperature": 0.0} | options)), criteria, steps, examples
        self.rubric, self.threshold, self.show = rubric, threshold, show

    def prompt(self, fields: dict[str, str]) -> str:
        parts = [f"Grade the actual output from 0 to 1.\nCriteria: {self.criteria}"]
        parts += ["Steps:\n" + "\n".join(f"{i}. {s}" for i, s in enumerate(self.steps, 1))] * bool(self.steps)
        parts += ["Scores:\n" + "\n".join(f"{b.low:g} to {b.high:g}: {b.description}" for b in self.rubric)] * bool(self.rubric)
        parts += ["Examples:\n" + "\n".join(f"actual: {e.actual_output}\n" + f"expected: {e.expected_output}\n" * bool(e.expected_output) + f"score {e.score:g}: {e.reason}" for e in self.examples)] * bool(self.examples)
        parts += [f"{n.replace('_', ' ')}:\n{fields[n]}" for n in self.show if fields.get(n)]
        return "\n\n".join([*parts, 'Reply with JSON: {"score": number, "reason": text}'])

    def graded(self, fields: dict[str, str]) -> ScoreResult:
        reply = ask_judge(self.llm, self.prompt(fields))
        if isinstance(reply, LlmError):
            return ScoreResult(scorer=self.name, verdict="inconclusive", explanation=f"judge failed ({reply.kind}): {reply.message}")
        return ScoreResult(scorer=self.name, verdict="pass" if reply.score >= self.threshold else "fail", score=reply.score, basis="judged", explanation=reply.reason or None)

    def score(self, case: EvalCase, output: SolverOutput, result: ExecutionResult, *, context: ScoreContext) -> ScoreResult:
        expected = case.expected.sql if isinstance(case.expected, GoldQuery) else case.expected.model_dump_json(exclude={"kind"})
        return self.graded({"input": case.input, "actual_output": output.output or "", "expected_output": expected})


def sql_judge(model: str | Llm) -> LlmJudge:
    """A judge of whether two queries always return the same rows."""
    return LlmJudge(
        model=model,
        criteria="Both queries return the same rows whatever is in the tables. Spelling, layout, aliases and equivalent conditions don't matter; another filter, join, aggregate or column does.",
        examples=[
            JudgeExample(actual_output="SELECT name FROM staff WHERE NOT age < 30", expected_output="SELECT name FROM staff WHERE age >= 30", score=1.0, reason="one condition written in two ways"),
            JudgeExample(actual_output="SELECT max(price) FROM goods", expected_output="SELECT avg(price) FROM goods", score=0.0, reason="another aggregate"),
        ],
    )


def judged_equivalence(model: str | Llm) -> FirstDecisive:
    """A proof where there is one, else a judge; nothing is run."""
    return FirstDecisive([SemanticEquivalence(), sql_judge(model)])


class MetricSolver:
    """Asks a model for a metric query."""

    def __init__(self, model: str | Llm, **options: Any) -> None:
        self.llm = resolve(model, **options)

    def solve(self, case: MetricCase) -> MetricSolverOutput:
        layer = case.metadata.get("sl_context", "")
        found = self.llm.complete(f"Write a metric query that answers the question.\n\n{layer}\n\nQuestion: {case.input}\n\n" + 'Reply with JSON: {"metrics": [], "group_by": [], "where": [], "order_by": [], "limit": null}')
        if isinstance(found, LlmError):
            return MetricSolverOutput(error=SolverError(kind="solver_failed" if found.kind == "malformed_response" else found.kind, message=found.message))
        try:
            return MetricSolverOutput(query=MetricQuery.model_validate(json.loads(fenced(found.text))))
        except (ValueError, ValidationError) as e:
            return MetricSolverOutput(error=SolverError(kind="empty_response" if not found.text.strip() else "solver_failed", message=f"can't read the reply: {e}"))


class MetricJudge(LlmJudge):
    """A judge of metric queries."""

    name = "metric_judge"

    def __init__(self, model: str | Llm, threshold: float = 0.5, **options: Any) -> None:
        super().__init__(model=model, criteria="Both metric queries answer the question alike: the same metrics, groups, filters, order and limit.", threshold=threshold, **options)

    def score(self, case: MetricCase, query: MetricQuery) -> ScoreResult:  # type: ignore[override]
        return self.graded({"input": case.input, "actual_output": query.model_dump_json(), "expected_output": case.expected.model_dump_json()})

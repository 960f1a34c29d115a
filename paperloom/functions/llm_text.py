"""Prompts, providers and retry rules around language models; everything offline is deterministic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.operators.evaluate import JUDGE_FIELDS

#: Fixed value: what is answered without sources.
NO_ANSWER = "I cannot find enough information in the provided sources."


def answer_prompt(question: Column, context: Column, history: Column | None = None) -> Column:
    """Question, numbered passages and, where there is one, the conversation so far."""
    past = F.lit("") if history is None else F.when(F.coalesce(history, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("Conversation so far (to understand the question, not as a source):\n"), history, F.lit("\n\n")))
    return F.concat(F.lit("Answer from the numbered passages alone and cite them like [Source 1]. Say so if they don't suffice.\n\n"), past, F.lit("Passages:\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def hyde_prompt(question: Column, sentences: int = 10) -> Column:
    """A hypothetical passage that would answer the question."""
    return F.concat(F.lit(f"Write a passage of at most {sentences} sentences, as a paper might, that answers: "), question)


def multi_query_prompt(question: Column, count: int = 3) -> Column:
    """Rephrased search queries as JSON."""
    return F.concat(F.lit(f'Give {count} different search queries as JSON {{"queries": [...]}} for: '), question)


def agent_prompt(question: Column, context: Column) -> Column:
    """A sufficiency verdict as JSON."""
    return F.concat(F.lit('Do these passages suffice? Reply as JSON {"sufficient": true or false, "reason": "...", "improved_query": "..."}.\nQuestion: '), question, F.lit("\nPassages:\n"), context)


def judge_prompt(question: Column, answer: Column, reference: Column, context: Column) -> Column:
    """Six scores from 0 to 5 as JSON."""
    return F.concat(F.lit(f"Score the answer from 0 to 5 as JSON with the keys {', '.join(JUDGE_FIELDS)} and reason.\nQuestion: "), question, F.lit("\nAnswer: "), answer, F.lit("\nReference: "), reference, F.lit("\nContext:\n"), context)


def mock_generate(prompt: Column) -> Column:
    """E5: the offline provider: a fixed verdict for sufficiency prompts, else the fixed answer."""
    return F.when(prompt.contains('"sufficient"'), F.lit('{"sufficient": true, "reason": "mock", "improved_query": ""}')).otherwise(F.lit(NO_ANSWER))


GENERATORS: dict[str, Callable[[Column], Column]] = {"mock": mock_generate, "none": mock_generate, "": mock_generate}


def message_text(payload: Column) -> Column:
    """The text of a chat or responses payload, by the first path that has one; else empty."""
    paths = ("$.choices[0].message.content", "$.choices[0].text", "$.output_text", "$.output[0].content[0].text", "$.message.content", "$.response")
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(payload, p)), F.lit("")) for p in paths], F.lit(""))


def is_quota_error(message: str, status: int | None = None) -> bool:
    """too many requests, or a message about quota."""
    low = message.lower()
    return status == 429 or "429" in low or any(w in low for w in ("quota", "resource_exhausted", "rate limit"))


def is_retriable(status: int) -> bool:
    """too many requests and server errors."""
    return status == 429 or 500 <= status < 600


def retry_wait(attempt: int, header: str | None = None) -> float:
    """Ten seconds per attempt, two minutes at most, longer if the server asks for it."""
    wait = min(120.0, 10.0 * attempt)
    try:
        return max(wait, float(header)) if header else wait
    except ValueError:
        return wait


def judge_budgets(limit: int) -> tuple[int, int]:
    """Characters of context for the first try and, if that fails for its size, the second."""
    return limit, max(3000, limit // 2)

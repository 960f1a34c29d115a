"""Answers scored by a model, and by the share of sentences that are supported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import llm_text
from paperloom.functions import text as T
from paperloom.operators import evaluate, retrieve
from paperloom.runtime import durable

KEYS = ["question_id", "strategy"]
RAGAS_FIELDS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")


def judge_answers(results: DataFrame, call: Callable[[DataFrame, str, str], DataFrame], limit: int = 12_000) -> DataFrame:
    """E8 over results (question_id, strategy, question, answer, reference_answer, expected_sources,
    blocks: array of source, heading, text): (question_id, strategy, question, six scores, reason,
    raw, error).

    ``call(df, key, text)`` asks the model and returns (key, answer, error). Answers that are errors
    or no JSON are asked for again with half the context (3000 characters at least); what fails
    then has its error and no scores. Repeated keys count once; NULL texts read as empty.
    """
    once = durable(results.dropDuplicates(KEYS).withColumn("_id", F.monotonically_increasing_id()))
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    shown = F.transform(F.coalesce("blocks", F.array().cast("array<struct<source:string,heading:string,text:string>>")), lambda b: F.struct(F.coalesce(b.source, F.lit("unknown source")).alias("source"), F.coalesce(b.heading, F.lit("")).alias("heading"), F.coalesce(b.text, F.lit("")).alias("text")))
    sources = F.to_json(F.coalesce("expected_sources", F.array().cast("array<string>")))

    def ask(rows: DataFrame, budget: int) -> DataFrame:
        reference = F.concat(empty("reference_answer"), F.lit("\nExpected sources: "), sources)
        prompts = rows.select("_id", llm_text.judge_prompt(empty("question"), empty("answer"), reference, retrieve.judge_context(shown, budget)).alias("prompt"))
        got = call(prompts, "_id", "prompt").withColumn("scores", evaluate.parse_judge(F.col("answer")))
        return durable(got.select("_id", "answer", "scores", F.coalesce("error", F.when(F.col("scores").isNull(), F.lit("no JSON in the answer"))).alias("error")))

    first, second = llm_text.judge_budgets(limit)
    tried = ask(once, first)
    again = ask(once.join(tried.where("error is not null").select("_id"), "_id", "left_semi"), second)
    answers = tried.where("error is null").union(again)
    return once.join(answers.withColumnRenamed("answer", "raw"), "_id").select(*KEYS, "question", *[F.col(f"scores.{f}").alias(f) for f in evaluate.JUDGE_FIELDS], "scores.reason", "raw", "error")


def support_metrics(samples: DataFrame, share: float = 0.5) -> DataFrame:
    """E9 without a model, over samples (question_id, strategy, question, answer, reference_answer,
    contexts): adds faithfulness and context_recall, the shares of the answer's and the reference's
    sentences of whose words at least ``share`` stand in the contexts, answer_relevancy, the share of
    the question's words in the answer, and context_precision, the share of contexts that hold
    words of the reference. NULL where there is nothing to take a share of."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w]+"), lambda w: w != ""))
    every = words(F.array_join(F.coalesce("contexts", F.array().cast("array<string>")), " "))
    held = lambda s, bag: F.size(F.array_intersect(words(s), bag)) >= share * F.size(words(s))

    def part(items: Column, test: Callable[[Column], Column]) -> Column:
        return F.round(F.size(F.filter(items, test)) / F.nullif(F.size(items), F.lit(0)), 6)

    answer, reference = T.split_sentences(F.coalesce("answer", F.lit(""))), T.split_sentences(F.coalesce("reference_answer", F.lit("")))
    asked = words(F.col("question"))
    return samples.withColumns({
        "faithfulness": part(answer, lambda s: held(s, every)), "context_recall": part(reference, lambda s: held(s, every)),
        "answer_relevancy": F.round(F.size(F.array_intersect(asked, words(F.col("answer")))) / F.nullif(F.size(asked), F.lit(0)), 6),
        "context_precision": part(F.coalesce("contexts", F.array().cast("array<string>")), lambda c: F.size(F.array_intersect(words(c), words(F.col("reference_answer")))) >= share * F.size(words(F.col("reference_answer")))),
    })


def remote_metrics(samples: DataFrame, call: Callable[[DataFrame, str, str], DataFrame], fields: tuple[str, ...] = RAGAS_FIELDS) -> DataFrame:
    """E9 by a service: each sample is sent as JSON (user_input, response, reference, retrieved_contexts),
    each answer is JSON with the metrics; adds them and ``error``. What isn't a number is NULL."""
    rows = durable(samples.dropDuplicates(KEYS).withColumn("_id", F.monotonically_increasing_id()))
    payload = F.to_json(F.struct(F.col("question").alias("user_input"), F.col("answer").alias("response"), F.col("reference_answer").alias("reference"), F.filter(F.coalesce("contexts", F.array().cast("array<string>")), lambda c: T.strip(F.coalesce(c, F.lit(""))) != "").alias("retrieved_contexts")))
    got = call(rows.select("_id", payload.alias("payload")), "_id", "payload")
    number = lambda f: F.get_json_object("answer", f"$.{f}").try_cast("double")
    return rows.join(got.select("_id", *[F.when(~F.isnan(number(f)), number(f)).alias(f) for f in fields], "error"), "_id").drop("_id")

"""Question grouping, retrieval metrics, score parsing and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators.relational import forward_fill_group

# Names and order of scores.
JUDGE_FIELDS = ("answer_correctness", "faithfulness", "answer_relevance", "context_usefulness", "completeness", "overall_quality")


def question_groups(rows: DataFrame, order: str = "item_id") -> DataFrame:
    """Rows with a number or a question start a group; rows below add answers (all) and sources
    (distinct, in order). Rows before the first group are left out.

    Columns: head (the group's order value), question_id, question, question_type, reference_answers,
    expected_sources. A blank number is replaced by the group's ordinal.
    """
    nr, q = T.strip(F.coalesce("question_nr", F.lit(""))), T.strip(F.coalesce("question", F.lit("")))
    filled = forward_fill_group(rows, order, (nr != "") | (q != "")).where("head is not null")
    answer, source = T.strip(F.coalesce("answer", F.lit(""))), T.strip(F.coalesce("source", F.lit("")))
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), answer.alias("a"), source.alias("s"), nr.alias("nr"), q.alias("q"), T.strip(F.coalesce("question_type", F.lit(""))).alias("t"))))
    g = filled.groupBy("head").agg(parts.alias("x"), F.max("ordinal").alias("n"))
    out = g.select("head", "n", F.col("x")[0].alias("f"), F.array_compact(F.transform("x", lambda e: F.when(e.a != "", e.a))).alias("reference_answers"), F.array_distinct(F.array_compact(F.transform("x", lambda e: F.when(e.s != "", e.s)))).alias("expected_sources"))
    return out.select("head", T.clean_question_id(F.col("f.nr"), F.col("n")).alias("question_id"), F.col("f.q").alias("question"), F.col("f.t").alias("question_type"), "reference_answers", "expected_sources")


def retrieval_metrics(chunks: Column, expected: Column) -> dict[str, Column]:
    """A1 to A3 on one row's arrays: recall, precision (matched expected over distinct retrieved
    names, so it may exceed 1), reciprocal rank of the first match, and the counts.

    NULL arrays read as empty; without expected sources all scores are 0.
    """
    chunks = F.coalesce(chunks, F.array().cast("array<struct<document_id:string,title:string,source_identifier:string,doi:string>>"))
    want = F.filter(F.coalesce(expected, F.array().cast("array<string>")), lambda e: T.strip(F.coalesce(e, F.lit(""))) != "")
    wanted = F.transform(want, T.normalize_source)
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    name = lambda c: F.when(~blank(c.document_id), c.document_id).when(~blank(c.title), c.title).otherwise(F.coalesce(c.source_identifier, F.lit("")))
    retrieved = F.array_distinct(F.filter(F.transform(chunks, lambda c: T.normalize_source(name(c))), lambda n: n != ""))
    aliases = F.transform(chunks, lambda c: F.transform(F.array(c.document_id, c.title, c.source_identifier, c.doi), T.normalize_source))
    hit = lambda w: F.array_position(F.transform(aliases, lambda row: F.exists(row, lambda a: T.sources_match(a, w))), F.lit(True))
    ranks = F.filter(F.transform(wanted, hit), lambda r: r > 0)
    n, m, r = F.size(want), F.size(ranks), F.size(retrieved)
    zero = F.lit(0.0)
    return {
        "retrieval_recall": F.when(n > 0, F.round(m / n, 6)).otherwise(zero),
        "retrieval_precision": F.when((n > 0) & (r > 0), F.round(m / r, 6)).otherwise(zero),
        "mrr": F.when(m > 0, F.round(1.0 / F.array_min(ranks), 6)).otherwise(zero),
        "expected_source_count": n,
        "retrieved_source_count": r,
        "matched_source_count": m,
    }


def strategy_summary(rows: DataFrame) -> DataFrame:
    """A4: per strategy the number of questions and the means of the metrics; partial averages."""
    mean = lambda c: F.round(F.avg(c), 6)
    return rows.groupBy("strategy").agg(
        F.count("*").alias("n_questions"), mean("retrieval_recall").alias("mean_retrieval_recall"), mean("retrieval_precision").alias("mean_retrieval_precision"), mean("mrr").alias("mean_mrr"),
        mean("matched_source_count").alias("mean_matched_source_count"), mean(F.coalesce(F.col("second_retrieval_used").cast("int"), F.lit(0))).alias("second_retrieval_rate"),
    )


def valid_means(df: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """Per group and metric the number and mean of valid scores (no NULL, no NaN)."""
    ok = {m: F.when(~F.isnan(m), F.col(m)) for m in metrics}
    aggs = [c for m in metrics for c in (F.count(ok[m]).alias(f"n_valid_{m}"), F.round(F.avg(ok[m]), 6).alias(f"mean_{m}"))]
    return df.groupBy(group).agg(F.count("*").alias("n_questions"), *aggs)


def has_valid_metric(summary: DataFrame) -> DataFrame:
    """One row telling whether any metric of any group has a valid score."""
    cols = [c for c in summary.columns if c.startswith("n_valid_")]
    any_valid = F.greatest(*[F.col(c) for c in cols]) > 0 if len(cols) > 1 else F.col(cols[0]) > 0
    return summary.agg(F.coalesce(F.bool_or(any_valid), F.lit(False)).alias("has_valid_metric"))


def parse_judge(raw: Column) -> Column:
    """The six scores of a judge's answer, clamped to 0..5 (0 where absent or no number), and
    the reason; NULL where no JSON is found."""
    j = T.recover_json(raw)
    got = F.from_json(j, "map<string,string>")
    fields = [F.greatest(F.lit(0.0), F.least(F.lit(5.0), F.coalesce(F.try_element_at(got, F.lit(f)).try_cast("double"), F.lit(0.0)))).alias(f) for f in JUDGE_FIELDS]
    return F.when(j.isNotNull(), F.struct(*fields, T.strip(F.coalesce(F.try_element_at(got, F.lit("reason")), F.lit(""))).alias("reason")))


def parse_query_list(raw: Column, original: Column, limit: int) -> Column:
    """The queries of a model's answer with the original put first if it is absent, repeated
    ones (case and white space aside) out, cut at ``limit`` (which may drop the last)."""
    j = T.recover_json(raw)
    listed = F.coalesce(F.from_json(F.get_json_object(j, "$.queries"), "array<string>"), F.when(j.startswith("["), F.from_json(j, "array<string>")), F.array().cast("array<string>"))
    clean = F.filter(F.transform(listed, lambda x: T.strip(F.coalesce(x, F.lit("None")))), lambda x: x != "")
    full = F.when(F.array_contains(clean, original), clean).otherwise(F.concat(F.array(original), clean))
    key = lambda x: T.squeeze(F.lower(x))
    keys = F.transform(full, key)
    first = F.filter(full, lambda x, i: (F.element_at(keys, i + 1) != "") & (F.array_position(keys, F.element_at(keys, i + 1)) == i + 1))
    return F.slice(first, 1, limit)


def parse_agent_decision(raw: Column, original: Column) -> Column:
    """(sufficient, reason, improved_query) of a model's verdict. Any value but false, null, 0
    and empty counts as sufficient, the text "false" included; a blank query falls back to the original."""
    j = T.recover_json(raw)
    s = F.get_json_object(j, "$.sufficient")
    typed = F.schema_of_variant(F.variant_get(F.try_parse_json(j), "$.sufficient", "variant"))
    text_value = typed == "STRING"
    true = F.when(text_value, s != "").otherwise(F.coalesce(~s.isin("false", "null", "0", "0.0", "[]", "{}", ""), F.lit(False)))
    better = F.get_json_object(j, "$.improved_query")
    return F.struct(F.coalesce(true, F.lit(False)).alias("sufficient"), F.coalesce(F.get_json_object(j, "$.reason"), F.lit("")).alias("reason"), F.when(F.coalesce(better, F.lit("")) == "", original).otherwise(better).alias("improved_query"))

"""Queries of question grouping, metrics, parsing and summaries, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import evaluate
from paperloom.operators.relational import as_number, collect_outer, keep_first, last_write_wins
from paperloom.runtime import table

CUSTOM = ["retrieval_recall", "retrieval_precision", "mrr", "matched_source_count", "second_retrieval_rate"]
JUDGE = list(evaluate.JUDGE_FIELDS)
RAGAS = ["faithfulness", "context_recall"]


def question_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's questions with all their answers and sources."""
    g = evaluate.question_groups(table(spark, sf, "benchmark_questions"))
    return g.select("question_id", "question", "question_type", F.array_join("reference_answers", "\n\n").alias("reference_answer"), F.size("reference_answers").alias("n_answers"), F.array_join("expected_sources", "|").alias("expected_sources"))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return keep_first(table(spark, sf, "strategy_results").select("result_id", "strategy", "question_id", "chunks", "second_retrieval_used", "answered_at"), ["result_id"], ["answered_at"])


def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Every result against its question's expected sources. A small set of question
    groups is met by an equi-join; alias matching stays within the row."""
    q = evaluate.question_groups(table(spark, sf, "benchmark_questions")).groupBy("question_id").agg(F.min_by("expected_sources", "head").alias("expected"))
    r = _results(spark, sf).withColumn("question_id", T.clean_question_id(F.col("question_id"), F.lit("")))
    # the benchmark cites file names; documents stand for them by author and year
    m = evaluate.retrieval_metrics(F.col("chunks"), F.col("expected"))
    return r.join(q, "question_id", "left").select("result_id", "strategy", "second_retrieval_used", *[c.alias(n) for n, c in m.items()])


def title_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A1 to A3 against sources that are retrieved for sure where anything is: each result's first title
    and third document, a file name among them; results that retrieved nothing count as 0."""
    r = _results(spark, sf)
    want = F.array(F.coalesce(F.try_element_at("chunks", F.lit(1))["title"], F.lit("")), F.concat(F.coalesce(F.try_element_at("chunks", F.lit(3))["document_id"], F.lit("none such")), F.lit(".pdf")), F.lit("unrelated work"))
    m = evaluate.retrieval_metrics(F.col("chunks"), want)
    return r.select("result_id", "strategy", "second_retrieval_used", *[c.alias(n) for n, c in m.items()])


def strategy_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A4 over the title metrics."""
    return evaluate.strategy_summary(title_metrics(spark, sf))


def _summary(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "evaluation_summary")
    return keep_first(s, ["run_id", "strategy"], ["collected_at"])


def judge_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Valid counts and means of the judge's scores of each strategy."""
    return evaluate.valid_means(_summary(spark, sf), "strategy", [f"judge_mean_{f}" for f in JUDGE])


def valid_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A7 over the summary by strategy."""
    return evaluate.has_valid_metric(evaluate.valid_means(_summary(spark, sf), "strategy", [f"ragas_mean_{f}" for f in RAGAS]))


def collected_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The three summaries joined by strategy, later runs winning column by column."""
    s = _summary(spark, sf)
    parts = {}
    for name, fields in (("custom", CUSTOM), ("judge", JUDGE), ("ragas", RAGAS)):
        cols = [f"{name}_{f if f == 'second_retrieval_rate' else 'mean_' + f}" for f in fields]
        sub = s.select("strategy", "run_id", *[as_number(F.col(c)).alias(c.removeprefix(f"{name}_")) for c in cols])
        parts[name] = last_write_wins(sub, "strategy", ["run_id"], [c.removeprefix(f"{name}_") for c in cols])
    return collect_outer(parts, "strategy")


def judge_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores written as a model would, in prose or a code fence, read back and clamped."""
    s = _summary(spark, sf)
    body = F.to_json(F.struct(*[F.when(~F.isnan(f"judge_mean_{f}"), F.col(f"judge_mean_{f}")).alias(f) for f in JUDGE], F.lit(" well grounded ").alias("reason")))
    kind = F.pmod("run_id", F.lit(4))
    raw = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("My verdict: "), body, F.lit(" as asked."))).otherwise(F.lit("no verdict"))
    p = s.select("run_id", "strategy", evaluate.parse_judge(raw).alias("j"))
    return p.select("run_id", "strategy", F.col("j").isNotNull().alias("parsed"), *[F.round(f"j.{f}", 4).alias(f) for f in JUDGE], "j.reason")


def query_list(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval queries written as a model would, read back with the question among them."""
    r = table(spark, sf, "strategy_results").select("result_id", "question", "retrieval_queries").distinct()
    listed = F.coalesce("retrieval_queries", F.array().cast("array<string>"))
    body = F.to_json(F.struct(F.concat(listed, listed, F.array(F.replace("question", F.lit(" "), F.lit("  ")), F.lit("  a  further question "))).alias("queries")))
    kind = F.pmod("result_id", F.lit(3))
    raw = F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("Sure: "), body)).otherwise(F.lit("none"))
    return r.select("result_id", F.array_join(evaluate.parse_query_list(raw, F.coalesce("question", F.lit("")), 3), "|").alias("queries"))


def agent_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Sufficiency verdicts in several spellings, read back."""
    r = table(spark, sf, "strategy_results").select("result_id", "question", "context_sufficient", "rewritten_query").distinct()
    flag = F.when(F.pmod("result_id", F.lit(3)) == 0, F.coalesce(F.col("context_sufficient").cast("string"), F.lit("null"))).when(F.pmod("result_id", F.lit(3)) == 1, F.lit('"false"')).otherwise(F.lit("0"))
    raw = F.concat(F.lit('{"sufficient": '), flag, F.lit(', "improved_query": '), F.to_json(F.array("rewritten_query")).substr(F.lit(2), F.length(F.to_json(F.array("rewritten_query"))) - 2), F.lit("}"))
    d = r.select("result_id", evaluate.parse_agent_decision(raw, F.coalesce("question", F.lit(""))).alias("d"))
    return d.select("result_id", "d.sufficient", "d.improved_query")


def result_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Flat rows of results: contexts that aren't blank, the query that was sent."""
    r = table(spark, sf, "strategy_results").select("result_id", "strategy", "question_id", "question", "answer", "chunks", "retrieval_query", "retrieval_queries").distinct()
    sent = F.when(F.size(F.coalesce("retrieval_queries", F.array().cast("array<string>"))) > 0, F.array_join("retrieval_queries", "|")).otherwise(F.coalesce("retrieval_query", F.lit("")))
    shown = F.filter(F.transform(F.coalesce("chunks", F.array().cast("array<struct<document_id:string,title:string,source_identifier:string,doi:string>>")), lambda c: F.coalesce(c.title, F.lit(""))), lambda t: T.strip(t) != "")
    return r.select("result_id", "strategy", T.clean_question_id(F.col("question_id"), F.lit("")).alias("question_id"), F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"), sent.alias("sent"), F.array_join(shown, "|").alias("contexts"))


def strategy_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Question and strategy pairs still to be run: all of the fixed question list
    with the fixed strategies, without those that have an answer."""
    names = spark.createDataFrame([(s,) for s in ("classic", "reranked", "hyde", "hyde_reranked", "multi_query", "agentic")], "strategy string")
    q = evaluate.question_groups(table(spark, sf, "benchmark_questions")).select("question_id").distinct()
    done = _results(spark, sf).select(T.clean_question_id(F.col("question_id"), F.lit("")).alias("question_id"), "strategy").distinct()
    return q.crossJoin(F.broadcast(names)).join(done, ["question_id", "strategy"], "left_anti")


QUERIES = {f.__name__: f for f in (question_groups, retrieval_metrics, title_metrics, strategy_summary, judge_summary, valid_metrics, collected_summary, judge_scores, query_list, agent_decision, result_rows, strategy_grid)}

_T = r"regexp_replace({x}, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"


def _t(x: str) -> str:
    return _T.replace("{x}", f"coalesce({x}, '')")


def _qid(raw: str, fallback: str) -> str:
    v = _t(raw)
    n = f"TRY_CAST({v} AS DOUBLE)"
    return f"CASE WHEN {v} = '' THEN {fallback} WHEN {n} IS NOT NULL AND {n} = floor({n}) THEN CAST(CAST({n} AS BIGINT) AS VARCHAR) ELSE {v} END"


_GROUPS = f"""b AS (SELECT *, {_t('question_nr')} AS nr, {_t('question')} AS q, {_t('answer')} AS a, {_t('source')} AS s, sum(CASE WHEN {_t('question_nr')} <> '' OR {_t('question')} <> '' THEN 1 ELSE 0 END) OVER (ORDER BY item_id) AS g FROM benchmark_questions),
qg AS (SELECT g, min(item_id) AS head, {_qid('min_by(nr, item_id)', 'CAST(g AS VARCHAR)')} AS question_id, min_by(q, item_id) AS question, min_by({_t('question_type')}, item_id) AS question_type,
  coalesce(list(a ORDER BY item_id) FILTER (WHERE a <> ''), []) AS answers, coalesce(list(s ORDER BY item_id) FILTER (WHERE s <> ''), []) AS srcs FROM b WHERE g > 0 GROUP BY g)"""
_FIRST_SEEN = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"


def _src(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '\\.[a-z0-9]+$', ''), '[^a-z0-9]+', ' ', 'g'))"


_METRICS = f"""n AS (SELECT *, list_filter(list_transform(coalesce(chunks, []), lambda c: {_src("CASE WHEN coalesce(c.document_id, '') <> '' THEN c.document_id WHEN coalesce(c.title, '') <> '' THEN c.title ELSE coalesce(c.source_identifier, '') END")}), lambda x: x <> '') AS names,
  list_transform(coalesce(chunks, []), lambda c: [{_src('c.document_id')}, {_src('c.title')}, {_src('c.source_identifier')}, {_src('c.doi')}]) AS al, list_filter(coalesce(expected, []), lambda e: trim(coalesce(e, '')) <> '') AS want FROM r),
h AS (SELECT *, list_filter(list_transform(list_transform(want, lambda e: {_src('e')}), lambda w: coalesce(list_position(list_transform(al, lambda row: len(list_filter(row, lambda a: a <> '' AND w <> '' AND (contains(a, w) OR contains(w, a)))) > 0), true), 0)), lambda p: p > 0) AS ranks, len(list_distinct(names)) AS rc FROM n),
m AS (SELECT result_id, strategy, second_retrieval_used, CASE WHEN len(want) > 0 THEN round(len(ranks)::DOUBLE / len(want), 6) ELSE 0 END AS retrieval_recall, CASE WHEN len(want) > 0 AND rc > 0 THEN round(len(ranks)::DOUBLE / rc, 6) ELSE 0 END AS retrieval_precision,
  CASE WHEN len(ranks) > 0 THEN round(1.0::DOUBLE / list_min(ranks), 6) ELSE 0 END AS mrr, CAST(len(want) AS INT) AS expected_source_count, CAST(rc AS INT) AS retrieved_source_count, CAST(len(ranks) AS INT) AS matched_source_count FROM h)"""
_RESULTS = "(SELECT * EXCLUDE (rn) FROM (SELECT result_id, strategy, question_id, chunks, second_retrieval_used, row_number() OVER (PARTITION BY result_id ORDER BY answered_at) AS rn FROM strategy_results) WHERE rn = 1)"
_TITLES = f"r AS (SELECT *, [coalesce(chunks[1].title, ''), coalesce(chunks[3].document_id, 'none such') || '.pdf', 'unrelated work'] AS expected FROM {_RESULTS})"
_ONCE = "s AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY run_id, strategy ORDER BY collected_at) AS rn FROM evaluation_summary) WHERE rn = 1)"
_VALID = lambda c: f"count(CASE WHEN CAST({c} AS VARCHAR) <> 'nan' THEN 1 END) AS n_valid_{c}, round(avg(CASE WHEN CAST({c} AS VARCHAR) <> 'nan' THEN {c} END), 6) AS mean_{c}"


def _collected() -> str:
    ctes, cols = [], []
    for name, fields in (("custom", CUSTOM), ("judge", JUDGE), ("ragas", RAGAS)):
        parts = []
        for f in fields:
            c = f"{name}_{f if f == 'second_retrieval_rate' else 'mean_' + f}"
            v = f"CASE WHEN CAST({c} AS VARCHAR) <> 'nan' THEN round({c}, 4) END"
            parts.append(f"max_by({v}, run_id) FILTER (WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> 'nan') AS {c}")
            cols.append(c)
        ctes.append(f"{name} AS (SELECT strategy, {', '.join(parts)} FROM s GROUP BY strategy)")
    return f"WITH {_ONCE}, {', '.join(ctes)} SELECT strategy, {', '.join(cols)} FROM custom FULL JOIN judge USING (strategy) FULL JOIN ragas USING (strategy)"


_CLAMP = lambda f: f"CASE WHEN run_id % 4 < 3 THEN round(greatest(0, least(5, coalesce(CASE WHEN CAST(judge_mean_{f} AS VARCHAR) <> 'nan' THEN judge_mean_{f} END, 0))), 4) END AS {f}"

ORACLES = {
    "question_groups": f"WITH {_GROUPS} SELECT question_id, question, question_type, array_to_string(answers, chr(10) || chr(10)) AS reference_answer, CAST(len(answers) AS INT) AS n_answers, array_to_string({_FIRST_SEEN.replace('{l}', 'srcs')}, '|') AS expected_sources FROM qg",
    "retrieval_metrics": f"WITH {_GROUPS}, e AS (SELECT question_id AS qid, min_by({_FIRST_SEEN.replace('{l}', 'srcs')}, head) AS expected FROM qg GROUP BY 1), r AS (SELECT x.*, expected FROM {_RESULTS} x LEFT JOIN e ON qid = {_qid('question_id', chr(39) * 2)}), {_METRICS} SELECT * FROM m",
    "title_metrics": f"WITH {_TITLES}, {_METRICS} SELECT * FROM m",
    "strategy_summary": f"WITH {_TITLES}, {_METRICS} SELECT strategy, count(*) AS n_questions, round(avg(retrieval_recall), 6) AS mean_retrieval_recall, round(avg(retrieval_precision), 6) AS mean_retrieval_precision, round(avg(mrr), 6) AS mean_mrr, round(avg(matched_source_count), 6) AS mean_matched_source_count, round(avg(CAST(coalesce(second_retrieval_used, false) AS INT)), 6) AS second_retrieval_rate FROM m GROUP BY 1",
    "judge_summary": f"WITH {_ONCE} SELECT strategy, count(*) AS n_questions, {', '.join(_VALID('judge_mean_' + f) for f in JUDGE)} FROM s GROUP BY 1",
    "valid_metrics": f"WITH {_ONCE} SELECT coalesce(bool_or(CAST(ragas_mean_faithfulness AS VARCHAR) <> 'nan' OR CAST(ragas_mean_context_recall AS VARCHAR) <> 'nan'), false) AS has_valid_metric FROM s",
    "collected_summary": _collected(),
    "judge_scores": f"WITH {_ONCE} SELECT run_id, strategy, run_id % 4 < 3 AS parsed, {', '.join(_CLAMP(f) for f in JUDGE)}, CASE WHEN run_id % 4 < 3 THEN 'well grounded' END AS reason FROM s",
    "query_list": r"""WITH r AS (SELECT DISTINCT result_id, coalesce(question, '') AS o, CASE WHEN result_id % 3 = 2 THEN [] ELSE list_concat(list_concat(coalesce(retrieval_queries, []), coalesce(retrieval_queries, [])), [coalesce(replace(question, ' ', '  '), 'None'), '  a  further question ']) END AS l FROM strategy_results),
c AS (SELECT result_id, o, list_filter(list_transform(l, lambda x: trim(coalesce(x, 'None'))), lambda x: x <> '') AS l FROM r),
f AS (SELECT result_id, CASE WHEN list_contains(l, o) THEN l ELSE list_prepend(o, l) END AS l FROM c),
k AS (SELECT result_id, l, list_transform(l, lambda x: trim(regexp_replace(lower(x), '[\s\p{Z}]+', ' ', 'g'))) AS k FROM f)
SELECT result_id, array_to_string(list_filter(l, lambda x, i: k[i] <> '' AND list_position(k, k[i]) = i)[1:3], '|') AS queries FROM k""",
    "agent_decision": """WITH r AS (SELECT DISTINCT result_id, question, context_sufficient, rewritten_query FROM strategy_results)
SELECT result_id, CASE result_id % 3 WHEN 0 THEN coalesce(context_sufficient, false) WHEN 1 THEN true ELSE false END AS sufficient, CASE WHEN coalesce(rewritten_query, '') = '' THEN coalesce(question, '') ELSE rewritten_query END AS improved_query FROM r""",
    "result_rows": f"""SELECT DISTINCT result_id, strategy, {_qid('question_id', chr(39) * 2)} AS question_id, coalesce(question, '') AS question, coalesce(answer, '') AS answer, CASE WHEN len(coalesce(retrieval_queries, [])) > 0 THEN array_to_string(retrieval_queries, '|') ELSE coalesce(retrieval_query, '') END AS sent,
  array_to_string(list_filter(list_transform(coalesce(chunks, []), lambda c: coalesce(c.title, '')), lambda t: trim(t) <> ''), '|') AS contexts FROM strategy_results""",
    "strategy_grid": f"WITH {_GROUPS}, n AS (SELECT unnest(['classic', 'reranked', 'hyde', 'hyde_reranked', 'multi_query', 'agentic']) AS strategy) SELECT DISTINCT question_id, strategy FROM qg, n WHERE NOT EXISTS (SELECT 1 FROM strategy_results x WHERE x.strategy = n.strategy AND {_qid('x.question_id', chr(39) * 2)} = qg.question_id)",
}

"""Queries and SQL of the operators of this subpackage, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import entity, leak, neardup, ocr, pairs, rankfuse, spans, split, tokens
from paperloom.runtime import table

SCORES = ["judge_mean_overall_quality", "custom_mean_mrr", "ragas_mean_faithfulness"]


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All pieces of the texts above the limit."""
    texts = split.texts_to_split(table(spark, sf, "chunks"), table(spark, sf, "extracted_documents"))
    return split.split_oversized(texts, "text", ["kind", "item_key", "position"], oversized_only=True).distinct()


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The texts that the splitter had to cut."""
    texts = split.texts_to_split(table(spark, sf, "chunks"), table(spark, sf, "extracted_documents"))
    pieces = split.split_oversized(texts, "text", ["kind", "item_key", "position"], oversized_only=True)
    return pieces.where("piece_index > 0").select("kind", "item_key", "position").distinct()


def p2_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate pairs of sources and papers with their marginal match probability."""
    sources = table(spark, sf, "sources").select(F.col("source_id").alias("id"), "title", "authors", "doi", "journal", F.col("publication_date").alias("date"))
    papers = table(spark, sf, "extracted_documents").select(F.col("document_id").alias("id"), *[F.col(f"metadata.{c}").alias(c) for c in ("title", "authors", "doi", "journal")], F.col("metadata.publication_date").alias("date"))
    matches = entity.match_records(sources, papers)
    return matches.select(F.col("r").alias("document_id"), F.col("l").alias("source_id"), F.round("confidence", 6).alias("confidence"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs more likely one paper than not."""
    return p2_matches(spark, sf).where("confidence >= 0.5").select("document_id", "source_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The kinds of scan noise of each section."""
    return ocr.scan_noise(table(spark, sf, "extracted_documents"))


def p3_repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Every section's text and its repair."""
    return ocr.repair_sections(table(spark, sf, "extracted_documents"))


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    return rankfuse.fuse_scores(table(spark, sf, "evaluation_summary"), "run_id", "strategy", SCORES)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The first strategy of each run."""
    return rankfuse.winners(_fused(spark, sf), "run_id", "strategy").select("run_id", "strategy")


def p4_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """All strategies of all runs in their fused order."""
    return rankfuse.ranking(_fused(spark, sf), "run_id", "strategy").withColumn("fused_score", F.round("fused_score", 9))


#: Found pairs are those of three-word sequences at 0.6, as TESTDATA.md states them.
P5 = {"shingle": 3, "threshold": 0.6}


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of near-duplicate chunks."""
    members, links = neardup.near_duplicates(table(spark, sf, "chunks"), "chunk_id", "text", **P5)
    found = neardup.expand_pairs(members, links)
    return found.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Each chunk with its class of equal texts and its group, named by their least chunk_id, and its
    class's number of links (five words, 0.8)."""
    members, links = neardup.near_duplicates(table(spark, sf, "chunks"), "chunk_id", "text")
    g = neardup.groups(members, links)
    least = g.groupBy("class").agg(F.min("id").alias("class_id"), F.first("component").alias("component"))
    named = least.select("class", "class_id", "component").join(least.groupBy("component").agg(F.min("class_id").alias("group_id")), "component")
    return g.join(named.select("class", "class_id", "group_id"), "class").select(F.col("id").alias("chunk_id"), "class_id", "group_id", "links")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Results with a defective answer."""
    return pairs.defects(table(spark, sf, "strategy_results"), "result_id", "question", "answer").drop("margin")


def p7_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Defective answers with how far above its threshold each is."""
    out = pairs.defects(table(spark, sf, "strategy_results"), "result_id", "question", "answer")
    return out.withColumn("margin", F.round("margin", 4))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode_column(table(spark, sf, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, sf: str, edited: bool = True) -> DataFrame:
    return leak.leaks(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "benchmark_questions"), "item_id", ["question", "answer"], edited=edited)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold ten consecutive words of an item."""
    hit = _leaks(spark, sf, edited=False)
    return hit.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Aligned leaks, edited copies included."""
    return _leaks(spark, sf).withColumnRenamed("doc", "doc_id").withColumnRenamed("item", "item_id")


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents that share a verbatim span."""
    members, _, met = spans.shared_spans(table(spark, sf, "documents"), "doc_id", "text")
    out = spans.expand_pairs(members, met)
    return out.select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p10_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Per document, its shared spans and how much of it they cover."""
    out = spans.coverage(table(spark, sf, "documents"), "doc_id", "text")
    return out.select(F.col("id").alias("doc_id"), F.col("rep").alias("class_id"), "n_chars", "spans", "shared_chars", "copies", "links")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name -> callable."""
    return {f.__name__: f for f in (p1_found, p1_pieces, p2_found, p2_matches, p3_found, p3_repaired, p4_found, p4_ranking, p5_found, p5_groups, p7_found, p7_flags, p8_ids, p9_found, p9_leaks, p10_found, p10_spans)}


_WORDS = r"regexp_extract_all(lower(%s), '[\p{L}\p{N}]+')"

_P4 = """
WITH once AS (SELECT run_id, strategy, max(CASE WHEN CAST(judge_mean_overall_quality AS VARCHAR) <> 'nan' THEN judge_mean_overall_quality END) AS a,
    max(CASE WHEN CAST(custom_mean_mrr AS VARCHAR) <> 'nan' THEN custom_mean_mrr END) AS b, max(CASE WHEN CAST(ragas_mean_faithfulness AS VARCHAR) <> 'nan' THEN ragas_mean_faithfulness END) AS c
  FROM evaluation_summary WHERE run_id IS NOT NULL AND strategy IS NOT NULL GROUP BY 1, 2),
long AS (SELECT run_id, strategy, 'a' AS m, a AS s FROM once WHERE a IS NOT NULL UNION ALL SELECT run_id, strategy, 'b', b FROM once WHERE b IS NOT NULL UNION ALL SELECT run_id, strategy, 'c', c FROM once WHERE c IS NOT NULL),
ranked AS (SELECT *, rank() OVER (PARTITION BY run_id, m ORDER BY s DESC) AS r, min(s) OVER (PARTITION BY run_id, m) AS lo, max(s) OVER (PARTITION BY run_id, m) AS hi FROM long),
fused AS (SELECT o.run_id, o.strategy, round(coalesce(sum(1.0::DOUBLE / (60 + r)), 0), 12) AS f, round(coalesce(sum(CASE WHEN hi > lo THEN (s - lo) / (hi - lo) ELSE 0.5::DOUBLE END), 0), 9) AS z
  FROM once o LEFT JOIN ranked USING (run_id, strategy) GROUP BY 1, 2),
final AS (SELECT run_id, strategy, f, row_number() OVER (PARTITION BY run_id ORDER BY f DESC, z DESC, strategy) AS n FROM fused)
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB statements of the same results, where SQL can state them."""
    size = r"""CASE WHEN regexp_matches(t, '[^\s\p{Z}\x1c-\x1f\x85]') THEN greatest(len(regexp_extract_all(t, '[\p{L}\p{M}\p{N}_]+(?:[-''][\p{L}\p{M}\p{N}_]+)?|[^\p{L}\p{M}\p{N}_\s\p{Z}]')), CAST(ceil(length(t) / 4.0) AS INT)) ELSE 0 END"""
    return {
        "p1_found": f"""
WITH x AS (SELECT 'chunk' AS kind, chunk_id AS item_key, chunk_index AS position, text AS t FROM chunks
  UNION ALL SELECT 'section', document_id, s."order", s.text FROM (SELECT document_id, unnest(sections) AS s FROM extracted_documents))
SELECT DISTINCT kind, item_key, CAST(position AS INT) AS position FROM x WHERE t IS NOT NULL AND {size} > 520""",
        "p4_found": _P4 + "SELECT run_id, strategy FROM final WHERE n = 1",
        "p4_ranking": _P4 + "SELECT run_id, strategy, round(f, 9) AS fused_score, CAST(n AS INT) AS fused_rank FROM final",
        "p5_found": f"""
WITH w AS (SELECT DISTINCT chunk_id, {_WORDS % "text"} AS ws FROM chunks WHERE text IS NOT NULL),
g AS (SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS s FROM w WHERE len(ws) >= 3),
n AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS k FROM g a JOIN g b USING (s) WHERE a.chunk_id < b.chunk_id GROUP BY 1, 2)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM p JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE k >= 0.6::DOUBLE * (x.n + y.n - k)""",
        "p5_groups": f"""
WITH RECURSIVE w AS (SELECT DISTINCT chunk_id, lower(text) AS t, {_WORDS % "text"} AS ws FROM chunks WHERE text IS NOT NULL AND len({_WORDS % "text"}) >= 5),
k AS (SELECT t, min(chunk_id) AS class_id, any_value(ws) AS ws FROM w GROUP BY t),
g AS (SELECT DISTINCT t, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s FROM k),
n AS (SELECT t, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.t AS a, b.t AS b, count(*) AS k FROM g a JOIN g b USING (s) WHERE a.t <> b.t GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.t = a JOIN n y ON y.t = b WHERE k >= 0.8::DOUBLE * (x.n + y.n - k)),
r(a, b) AS (SELECT t, t FROM k UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT r.a AS t, min(k.class_id) AS group_id FROM r JOIN k ON k.t = r.b GROUP BY 1),
l AS (SELECT a AS t, count(*) AS links FROM e GROUP BY 1)
SELECT DISTINCT w.chunk_id, k.class_id, c.group_id, coalesce(l.links, 0) AS links FROM w JOIN k USING (t) JOIN c USING (t) LEFT JOIN l USING (t)""",
        "p9_found": f"""
WITH d AS (SELECT doc_id, {_WORDS % "text"} AS ws FROM documents WHERE text IS NOT NULL),
q AS (SELECT item_id, {_WORDS % "t"} AS ws FROM (SELECT item_id, unnest([question, answer]) AS t FROM benchmark_questions) WHERE t IS NOT NULL),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 8), lambda i: array_to_string(ws[i:i + 9], ' '))) AS s FROM d WHERE len(ws) >= 10),
qg AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(ws) - 8), lambda i: array_to_string(ws[i:i + 9], ' '))) AS s FROM q WHERE len(ws) >= 10)
SELECT DISTINCT doc_id, item_id FROM dg JOIN qg USING (s)""",
        "p10_found": """
WITH w AS (SELECT doc_id, md5(substr(text, i, 300)) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)),
r AS (SELECT s FROM w GROUP BY s HAVING count(DISTINCT doc_id) > 1),
k AS (SELECT DISTINCT doc_id, s FROM w SEMI JOIN r USING (s))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b USING (s) WHERE a.doc_id < b.doc_id""",
    }

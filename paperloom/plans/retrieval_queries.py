"""Queries of retrieval, fusion, contexts and the strategies, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.config import RetrievalProfile
from paperloom.functions import embed
from paperloom.functions import text as T
from paperloom.operators import retrieve
from paperloom.operators.relational import keep_first, rank_in_groups
from paperloom.runtime import durable, spread, table

PROFILE = RetrievalProfile(allow_overrides=True)


def hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """E3 over documents, vectors rounded."""
    v = embed.hash_embedding(spread(table(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text")
    return v.select("doc_id", F.posexplode("embedding").alias("bucket", "value")).where("value <> 0").withColumn("value", F.round("value", 6))


def _queries(df: DataFrame) -> DataFrame:
    """The stated query set: every row whose id is divisible by 20."""
    return df.where("vec_id % 20 = 0")


def knn_l2(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest rows of each query by squared distance."""
    e = table(spark, sf, "embeddings")
    return retrieve.knn(_queries(e), e, "vec_id", "vec_id", "embedding", 20).select("query", "id", F.round("distance", 6).alias("distance"), "rank")


def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """The same by cosine."""
    e = table(spark, sf, "embeddings")
    return retrieve.knn(_queries(e), e, "vec_id", "vec_id", "embedding", 20, "cosine").select("query", "id", F.round("distance", 6).alias("distance"), "rank")


def knn_label_vote(spark: SparkSession, sf: str) -> DataFrame:
    """R2 with an exact second score: of 20 candidates the 8 whose labels agree with the query's first."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    hits = retrieve.knn(_queries(table(spark, sf, "embeddings")), table(spark, sf, "embeddings"), "vec_id", "vec_id", "embedding", PROFILE.top_k)
    x = hits.join(e.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query").join(e.select(F.col("vec_id").alias("id"), F.col("label").alias("cl")), "id")
    from pyspark.sql import Window

    w = Window.partitionBy("query").orderBy(F.desc(F.col("ql") == F.col("cl")), "rank")
    return x.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= PROFILE.top_n).select("query", "id", "rank", "new_rank")


def _ranked_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Per journal two ranked lists of retrieved rows: by distance and by rerank score."""
    s = keep_first(table(spark, sf, "sources").select("source_id", "journal", "distance", "rerank_score"), ["source_id"], ["distance"]).where("coalesce(journal, '') <> ''")
    near = rank_in_groups(s.where("distance is not null").withColumn("near", -F.col("distance")), ["journal"], "near", [F.asc("source_id")], "rank").select("journal", "source_id", F.lit(0).alias("list"), "rank")
    best = rank_in_groups(s.where("rerank_score is not null"), ["journal"], "rerank_score", [F.asc("source_id")], "rank").select("journal", "source_id", F.lit(1).alias("list"), "rank")
    return near.union(best)


def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """The fused first eight of each journal."""
    return retrieve.fuse_ranked(_ranked_sources(spark, sf), "journal", "source_id", 8)


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks").select("chunk_id", "document_id", "text", "chunk_index", "section_type", "heading", F.col("metadata.title").alias("title"), F.col("metadata.doi").alias("doi"), "loaded_at")
    return keep_first(c.where("chunk_id is not null"), ["chunk_id"], ["loaded_at"])


def context_format(spark: SparkSession, sf: str) -> DataFrame:
    """The context of each document's first eight chunks."""
    from pyspark.sql import Window

    w = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")
    first = _chunks(spark, sf).where("coalesce(text, '') <> ''").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= PROFILE.top_n)
    block = retrieve.context_block(F.col("title"), F.col("document_id"), F.col("heading"), F.col("section_type"), F.col("doi"), F.col("text"))
    return retrieve.format_context(first.withColumn("block", block), "document_id", "rank", "block")


def judge_context(spark: SparkSession, sf: str) -> DataFrame:
    """The retrieved chunks of each result as a judge sees them, within 300 characters."""
    r = table(spark, sf, "strategy_results").select("result_id", "chunks").where("chunks is not null")
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    name = lambda c: F.when(~blank(c.document_id), c.document_id).when(~blank(c.title), c.title).otherwise(F.lit("unknown source"))
    blocks = F.transform("chunks", lambda c: F.struct(name(c).alias("source"), F.coalesce(c.doi, F.lit("")).alias("heading"), F.coalesce(c.title, F.lit("")).alias("text")))
    return r.select("result_id", retrieve.judge_context(blocks, 300).alias("context")).distinct()


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "strategy_results").select("run_id", "result_id", "question", "answer").distinct()
    user = r.select("run_id", "result_id", F.lit(0).alias("part"), F.lit("user").alias("role"), F.col("question").alias("content"))
    return user.union(r.select("run_id", "result_id", F.lit(1), F.lit("assistant"), F.col("answer")))


def history(spark: SparkSession, sf: str) -> DataFrame:
    """The last six turns of each run and the user's recent questions."""
    return retrieve.history_text(_turns(spark, sf), "run_id", ["result_id", "part"])


def history_query(spark: SparkSession, sf: str) -> DataFrame:
    """Each run's next retrieval query, its last question asked again."""
    h = retrieve.history_text(_turns(spark, sf), "run_id", ["result_id", "part"])
    last = table(spark, sf, "strategy_results").groupBy("run_id").agg(F.max_by("question", "result_id").alias("question"))
    return h.join(last, "run_id").select("run_id", retrieve.history_query(F.col("question"), F.col("user_questions")).alias("retrieval_query"))


def chunk_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """The flat metadata of every chunk, lists as JSON, absent values as empty text or 0."""
    c = table(spark, sf, "chunks")
    text = ["chunk_id", "document_id", "section_type", "heading", "extraction_method", "source_type", "source_identifier"]
    nested = ["title", "doi", "pmid", "pmcid", "journal", "publication_date"]
    out = c.select(
        *[F.coalesce(n, F.lit("")).alias(n) for n in text], *[F.coalesce(n, F.lit(0)).alias(n) for n in ("chunk_index", "section_order", "token_count", "sentence_count")],
        *[F.coalesce(f"metadata.{n}", F.lit("")).alias(n) for n in nested], F.coalesce(F.array_join("metadata.authors", "; "), F.lit("")).alias("author_names"), F.coalesce("provenance.chunker", F.lit("")).alias("chunker"),
    )
    return out.distinct()


def formatted_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieved rows in their response form, author lists written as text read back."""
    s = table(spark, sf, "sources")
    joined = F.when(F.pmod("source_id", F.lit(2)) == 0, F.to_json("authors")).otherwise(F.array_join("authors", ";"))
    e = lambda c: F.coalesce(c, F.lit(""))
    return s.select("source_id", e("title").alias("title"), F.array_join(T.parse_authors(joined), "|").alias("authors"), e("doi").alias("doi"), e("journal").alias("journal"), e("publication_date").alias("publication_date"), e("section_type").alias("section_type"), e("heading").alias("heading"), F.coalesce("chunk_index", F.lit(0)).alias("chunk_index")).distinct()


def text_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: chunks and questions embedded, the 20 nearest chunks of every stated question
    (items divisible by 20), reranked lexically, the first eight formatted as a context."""
    chunks = spread(durable(_chunks(spark, sf).where("coalesce(text, '') <> ''")))
    asked = table(spark, sf, "benchmark_questions").where("item_id % 20 = 0 and coalesce(question, '') <> ''").select("item_id", "question")
    vectors = durable(embed.hash_embedding(chunks, "chunk_id", "text"))
    hits = retrieve.knn(embed.hash_embedding(asked, "item_id", "question"), vectors, "item_id", "chunk_id", "embedding", PROFILE.top_k)
    rows = hits.withColumnRenamed("id", "chunk_id").join(chunks, "chunk_id").join(asked.select(F.col("item_id").alias("query"), F.col("question").alias("query_text")), "query")
    best = retrieve.lexical_rerank(rows, PROFILE.top_n)
    block = retrieve.context_block(F.col("title"), F.col("document_id"), F.col("heading"), F.col("section_type"), F.col("doi"), F.col("text"))
    return retrieve.format_context(best.withColumn("block", block), "query", "rank", "block").withColumnRenamed("query", "item_id")


def strategies(spark: SparkSession, sf: str) -> DataFrame:
    """Q1 to Q6 over every chunk for the stated questions: each item's answer stands in for the
    hypothetical passage, its sentences for the rephrased queries; each third verdict is no."""
    from paperloom.operators.strategies import Strategies

    chunks = spread(durable(_chunks(spark, sf).where("coalesce(text, '') <> ''").select("chunk_id", "text")))
    vectors = durable(embed.hash_embedding(chunks, "chunk_id", "text"))
    verdict = F.when(F.pmod("item_id", F.lit(3)) == 0, F.lit('{"sufficient": false, "improved_query": "dogs and owners"}')).otherwise(F.lit('Verdict: {"sufficient": true}'))
    asked = table(spark, sf, "benchmark_questions").where("item_id % 20 = 0 and coalesce(question, '') <> ''")
    asked = asked.select("item_id", "question", F.col("answer").alias("passage"), F.to_json(F.struct(T.split_sentences(F.coalesce("answer", F.lit(""))).alias("queries"))).alias("query_json"), verdict.alias("verdict_json"))
    s = Strategies(chunks, vectors, asked)
    out = None
    for name in ("classic", "reranked", "hyde", "hyde_reranked", "multi_query", "agentic"):
        one = s.run(name).select(F.lit(name).alias("strategy"), "item_id", "chunk_id", "rank", F.round("score", 6).alias("score"))
        out = one if out is None else out.union(one)
    return out


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts by event type, the plan that the streaming job also runs."""
    from paperloom.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, sf, "events"))


QUERIES = {f.__name__: f for f in (hash_embedding, knn_l2, knn_cosine, knn_label_vote, rrf_fusion, context_format, judge_context, history, history_query, chunk_metadata, formatted_chunks, text_retrieval, strategies, event_windows)}

_SQ = r"trim(regexp_replace(coalesce({x}, ''), '[\s\p{Z}\x0b\x1c-\x1f\x85]+', ' ', 'g'))"
_KNN = """WITH q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS e, label FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT query, c.vec_id AS id, round({d}, 9) AS distance, q.label AS ql, c.label AS cl FROM q, embeddings c),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM d)"""
_L2 = _KNN.replace("{d}", "list_distance(q.e, c.embedding::DOUBLE[]) ** 2")
_HISTORY = f"""WITH t AS (SELECT DISTINCT run_id, result_id, 0 AS part, 'user' AS role, question AS content FROM strategy_results UNION SELECT DISTINCT run_id, result_id, 1, 'assistant', answer FROM strategy_results),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY result_id DESC, part DESC) AS n, {_SQ.replace('{x}', 'content')} AS c FROM t),
x AS (SELECT *, CASE WHEN length(c) > 1200 THEN regexp_replace(substr(c, 1, 1200), ' [^ ]*$', '') || ' ...' ELSE c END AS cut, row_number() OVER (PARTITION BY run_id, role = 'user' AND c <> '' ORDER BY n) AS u FROM n WHERE n <= 6),
h AS (SELECT run_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || cut, chr(10) ORDER BY n DESC) AS history,
  coalesce(string_agg('- ' || substr(c, 1, 500), chr(10) ORDER BY n DESC) FILTER (WHERE role = 'user' AND c <> '' AND u <= 3), '') AS user_questions FROM x GROUP BY run_id)
"""
_SPLIT = "list_filter(string_split_regex(lower(coalesce({x}, '')), '[\\s\\p{{Z}}\\x0b\\x1c-\\x1f\\x85]+'), lambda w: w <> '')"
_WORDS = "list_distinct(list_filter(string_split_regex(lower(coalesce({x}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: w <> ''))"


def _vectors(name: str, table: str, key: str) -> str:
    """Tables of non-zero unit values of the hash embedding of ``text``."""
    return f"""{name}w AS (SELECT {key}, sha256(unnest({_SPLIT.format(x='text')})) AS h FROM {table}),
{name}s AS (SELECT {key}, ('0x' || substr(h, 1, 8))::UBIGINT % 64 AS b, sum(CASE WHEN ('0x' || substr(h, 9, 2))::UBIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS v FROM {name}w GROUP BY 1, 2),
{name}v AS (SELECT {key}, b, v / sqrt(sum(v * v) OVER (PARTITION BY {key})) AS v FROM {name}s WHERE v <> 0)"""


_RETRIEVED = f"""WITH c AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at) AS n FROM chunks WHERE chunk_id IS NOT NULL) WHERE n = 1 AND coalesce(text, '') <> ''),
q AS (SELECT item_id, question AS text FROM benchmark_questions WHERE item_id % 20 = 0 AND coalesce(question, '') <> ''),
{_vectors('c', 'c', 'chunk_id')},
{_vectors('q', 'q', 'item_id')},
n AS (SELECT chunk_id, CASE WHEN count(v) > 0 THEN 1 ELSE 0 END AS n FROM c LEFT JOIN cv USING (chunk_id) GROUP BY 1),
d AS (SELECT item_id, chunk_id, sum(qv.v * cv.v) AS dot FROM qv JOIN cv USING (b) GROUP BY 1, 2),
k AS (SELECT q.item_id, n.chunk_id, round(greatest(1 + n.n - 2 * coalesce(dot, 0), 0), 9) AS distance FROM q CROSS JOIN n LEFT JOIN d ON d.item_id = q.item_id AND d.chunk_id = n.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, chunk_id) AS rank FROM k),
s AS (SELECT r.item_id, r.rank, c.*, round(len(list_intersect({_WORDS.format(x='q.text')}, {_WORDS.format(x='c.text')}))::DOUBLE / len({_WORDS.format(x='q.text')}), 9) AS score FROM r JOIN c USING (chunk_id) JOIN q USING (item_id) WHERE rank <= 20),
t AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, rank) AS new_rank FROM s)
"""


def _strategies_sql() -> str:
    """Q1 to Q6: all texts that are searched for, their nearest chunks, then one part a strategy."""
    from paperloom.plans.text_queries import _sentences

    key = "trim(regexp_replace(lower({x}), '[\\s\\p{Z}]+', ' ', 'g'))"
    k1 = key.replace("{x}", "x")
    lexical = f"round(CASE WHEN len({_WORDS.format(x='a.text')}) > 0 THEN len(list_intersect({_WORDS.format(x='a.text')}, {_WORDS.format(x='c.text')}))::DOUBLE / len({_WORDS.format(x='a.text')}) ELSE 0 END, 9)"
    head = f"""WITH c AS (SELECT chunk_id, text FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at) AS n FROM chunks WHERE chunk_id IS NOT NULL) WHERE n = 1 AND coalesce(text, '') <> ''),
b AS (SELECT item_id, question, answer, {_sentences("coalesce(answer, '')")} AS l0 FROM benchmark_questions WHERE item_id % 20 = 0 AND coalesce(question, '') <> ''),
l1 AS (SELECT item_id, CASE WHEN list_contains(l0, question) THEN l0 ELSE list_prepend(question, l0) END AS l FROM b),
l2 AS (SELECT item_id, list_filter(l, lambda x, i: {k1} <> '' AND list_position(list_transform(l, lambda x: {k1}), {k1}) = i)[1:3] AS l FROM l1),
a AS (SELECT 'q' || item_id AS qid, item_id, 'question' AS kind, 0 AS list, question AS text FROM b
 UNION ALL SELECT 'p' || item_id, item_id, 'passage', 0, answer FROM b WHERE coalesce(answer, '') <> ''
 UNION ALL SELECT 's' || item_id, item_id, 'second', 0, 'dogs and owners' FROM b WHERE item_id % 3 = 0
 UNION ALL SELECT 'l' || item_id || '#' || i, item_id, 'list', i, x FROM (SELECT item_id, unnest(range(0, len(l))) AS i, unnest(l) AS x FROM l2) WHERE x <> ''),
{_vectors('c', 'c', 'chunk_id')},
{_vectors('e', 'a', 'qid')},
n AS (SELECT chunk_id, CASE WHEN count(v) > 0 THEN 1 ELSE 0 END AS n FROM c LEFT JOIN cv USING (chunk_id) GROUP BY 1),
d AS (SELECT qid, chunk_id, sum(ev.v * cv.v) AS dot FROM ev JOIN cv USING (b) GROUP BY 1, 2),
k AS (SELECT a.qid, a.item_id, a.kind, a.list, n.chunk_id, round(greatest(1 + n.n - 2 * coalesce(dot, 0), 0), 9) AS distance FROM a CROSS JOIN n LEFT JOIN d ON d.qid = a.qid AND d.chunk_id = n.chunk_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, chunk_id) AS rank FROM k),
s AS (SELECT r.*, {lexical} AS score FROM r JOIN c USING (chunk_id) JOIN a USING (qid) WHERE rank <= 20 AND r.kind <> 'list'),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS new_rank FROM s),
f AS (SELECT item_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min([list, rank]) AS first FROM r WHERE kind = 'list' AND rank <= 10 GROUP BY 1, 2),
g AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, first) AS rank FROM f),
z AS (
"""
    plain = lambda name, kind, more="": f"SELECT '{name}' AS strategy, item_id, chunk_id, rank, -distance AS score FROM r WHERE kind = '{kind}' AND rank <= 6{more}"
    again = lambda name, kind: f"SELECT '{name}', item_id, chunk_id, new_rank, score FROM t WHERE kind = '{kind}' AND new_rank <= 6"
    parts = [plain("classic", "question"), again("reranked", "question"), plain("hyde", "passage"), again("hyde_reranked", "passage"), "SELECT 'multi_query', item_id, chunk_id, rank, score FROM g WHERE rank <= 6", plain("agentic", "question", " AND item_id % 3 <> 0"), again("agentic", "second")]
    return head + "\nUNION ALL ".join(parts) + ") SELECT strategy, item_id, chunk_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM z"


ORACLES = {
    "strategies": _strategies_sql(),
    "text_retrieval": _RETRIEVED + """SELECT item_id, string_agg('[Source ' || new_rank || '] ' || CASE WHEN coalesce(metadata.title, '') <> '' THEN metadata.title WHEN document_id <> '' THEN document_id ELSE 'Unknown source' END || '; ' || CASE WHEN coalesce(heading, '') <> '' THEN heading WHEN coalesce(section_type, '') <> '' THEN section_type ELSE 'section' END
 || CASE WHEN coalesce(metadata.doi, '') <> '' THEN '; DOI: ' || metadata.doi ELSE '' END || chr(10) || text, chr(10) || chr(10) ORDER BY new_rank) AS context FROM t WHERE new_rank <= 8 GROUP BY 1""",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "hash_embedding": """WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[\\s\\p{Z}\\x0b\\x1c-\\x1f\\x85]+'), lambda w: w <> '')) AS w FROM documents),
h AS (SELECT doc_id, sha256(w) AS h FROM w),
s AS (SELECT doc_id, CAST(('0x' || substr(h, 1, 8))::UBIGINT % 64 AS INT) AS bucket, sum(CASE WHEN ('0x' || substr(h, 9, 2))::UBIGINT % 2 = 0 THEN 1 ELSE -1 END) AS v FROM h GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS n FROM s GROUP BY 1)
SELECT doc_id, bucket, round(v / n, 6) AS value FROM s JOIN n USING (doc_id) WHERE v <> 0""",
    "knn_l2": _L2 + "SELECT query, id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20",
    "knn_cosine": _KNN.replace("{d}", "1 - list_cosine_similarity(q.e, c.embedding::DOUBLE[])") + "SELECT query, id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM r WHERE rank <= 20",
    "knn_label_vote": _L2 + ", z AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY (ql = cl) DESC, rank) AS new_rank FROM r WHERE rank <= 20) SELECT query, id, CAST(rank AS INT) AS rank, CAST(new_rank AS INT) AS new_rank FROM z WHERE new_rank <= 8",
    "rrf_fusion": """WITH s AS (SELECT DISTINCT source_id, journal, distance, rerank_score FROM sources WHERE coalesce(journal, '') <> ''),
l AS (SELECT journal, source_id, 0 AS list, row_number() OVER (PARTITION BY journal ORDER BY distance, source_id) AS rank FROM s WHERE distance IS NOT NULL
 UNION ALL SELECT journal, source_id, 1, row_number() OVER (PARTITION BY journal ORDER BY rerank_score DESC, source_id) FROM s WHERE rerank_score IS NOT NULL),
f AS (SELECT journal, source_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fusion_score, min([list, rank]) AS first FROM l GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY journal ORDER BY fusion_score DESC, first) AS rank FROM f)
SELECT journal, source_id, fusion_score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 8""",
    "context_format": """WITH c AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at) AS n FROM chunks WHERE chunk_id IS NOT NULL) WHERE n = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS r FROM c WHERE coalesce(text, '') <> '')
SELECT document_id, string_agg('[Source ' || r || '] ' || CASE WHEN coalesce(metadata.title, '') <> '' THEN metadata.title WHEN document_id <> '' THEN document_id ELSE 'Unknown source' END || '; ' || CASE WHEN coalesce(heading, '') <> '' THEN heading WHEN coalesce(section_type, '') <> '' THEN section_type ELSE 'section' END
 || CASE WHEN coalesce(metadata.doi, '') <> '' THEN '; DOI: ' || metadata.doi ELSE '' END || chr(10) || text, chr(10) || chr(10) ORDER BY r) AS context FROM r WHERE r <= 8 GROUP BY 1""",
    "judge_context": """WITH r AS (SELECT DISTINCT result_id, chunks FROM strategy_results WHERE chunks IS NOT NULL),
t AS (SELECT result_id, array_to_string(list_transform(chunks, lambda c, i: '[Source ' || i || ': ' || CASE WHEN coalesce(c.document_id, '') <> '' THEN c.document_id WHEN coalesce(c.title, '') <> '' THEN c.title ELSE 'unknown source' END || '; ' || coalesce(c.doi, '') || ']' || chr(10) || coalesce(c.title, '')), chr(10) || chr(10)) AS w FROM r)
SELECT DISTINCT result_id, CASE WHEN length(w) <= 300 THEN w ELSE regexp_replace(substr(w, 1, 300), '\\n[^\\n]*$', '') || chr(10) || '[Context truncated for judging]' END AS context FROM t""",
    "history": _HISTORY + "SELECT * FROM h",
    "history_query": _HISTORY + """, q AS (SELECT run_id, max_by(question, result_id) AS question FROM strategy_results GROUP BY 1)
SELECT run_id, CASE WHEN user_questions = '' THEN question ELSE 'Recent user questions:' || chr(10) || user_questions || chr(10) || chr(10) || 'Current question:' || chr(10) || question || chr(10) END AS retrieval_query FROM h JOIN q USING (run_id)""",
    "chunk_metadata": "SELECT DISTINCT "
    + ", ".join(f"coalesce({n}, '') AS {n}" for n in ("chunk_id", "document_id", "section_type", "heading", "extraction_method", "source_type", "source_identifier"))
    + ", "
    + ", ".join(f"coalesce({n}, 0) AS {n}" for n in ("chunk_index", "section_order", "token_count", "sentence_count"))
    + ", "
    + ", ".join(f"coalesce(metadata.{n}, '') AS {n}" for n in ("title", "doi", "pmid", "pmcid", "journal", "publication_date"))
    + ", coalesce(array_to_string(metadata.authors, '; '), '') AS author_names, coalesce(provenance.chunker, '') AS chunker FROM chunks",
    "formatted_chunks": """SELECT DISTINCT source_id, coalesce(title, '') AS title, CASE WHEN source_id % 2 = 0 THEN coalesce(array_to_string(authors, '|'), '')
  ELSE coalesce(array_to_string(list_filter(list_transform(string_split(array_to_string(authors, ';'), ';'), lambda x: trim(x)), lambda x: x <> ''), '|'), '') END AS authors, coalesce(doi, '') AS doi, coalesce(journal, '') AS journal, coalesce(publication_date, '') AS publication_date, coalesce(section_type, '') AS section_type, coalesce(heading, '') AS heading, coalesce(chunk_index, 0) AS chunk_index FROM sources""",
}

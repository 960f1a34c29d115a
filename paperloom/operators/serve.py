"""Search and chat requests as DataFrames; a web server would only pass rows in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.config import RetrievalProfile
from paperloom.functions import embed, llm_text
from paperloom.functions import text as T
from paperloom.operators import retrieve


def request_error(query: Column, top_k: Column, top_n: Column, turns: Column) -> Column:
    """Why a request is refused, NULL if it isn't: a blank query, more than six turns, top_k
    outside 1..100 or top_n outside 1..30 (both may be absent)."""
    return (
        F.when(T.strip(F.coalesce(query, F.lit(""))) == "", F.lit("empty_query"))
        .when(F.coalesce(turns, F.lit(0)) > 6, F.lit("too_many_turns"))
        .when(top_k.isNotNull() & ~top_k.between(1, 100), F.lit("top_k_out_of_range"))
        .when(top_n.isNotNull() & ~top_n.between(1, 30), F.lit("top_n_out_of_range"))
    )


def search(requests: DataFrame, chunks: DataFrame, vectors: DataFrame, profile: RetrievalProfile = RetrievalProfile()) -> DataFrame:
    """O6 and R2 over requests (request_id, query): (request_id, rank, chunk_id, text, distance,
    rerank_score) of the best passages; blank queries find nothing."""
    top_k, top_n, rerank = profile.resolve()
    asked = requests.where(T.strip(F.coalesce("query", F.lit(""))) != "")
    hits = retrieve.knn(embed.hash_embedding(asked, "request_id", "query"), vectors, "request_id", "chunk_id", "embedding", top_k)
    rows = hits.withColumnRenamed("id", "chunk_id").join(chunks.select("chunk_id", "text"), "chunk_id").join(asked.select(F.col("request_id").alias("query"), F.col("query").alias("query_text")), "query")
    best = retrieve.lexical_rerank(rows, top_n) if rerank else retrieve.no_rerank(rows.withColumn("rerank_score", F.lit(None).cast("double")), top_n)
    return best.select(F.col("query").alias("request_id"), "rank", "chunk_id", "text", "distance", "rerank_score")


def chat(requests: DataFrame, chunks: DataFrame, vectors: DataFrame, profile: RetrievalProfile = RetrievalProfile(), generate: str = "mock") -> DataFrame:
    """O6 over requests (request_id, query, history, user_questions): (request_id, answer, sources).
    The retrieval query knows the user's recent questions; without passages the fixed answer is given."""
    aware = requests.withColumn("query", retrieve.history_query(F.col("query"), F.col("user_questions")))
    found = search(aware, chunks, vectors, profile)
    context = retrieve.format_context(found.withColumn("block", retrieve.context_block(F.col("chunk_id"), F.col("chunk_id"), F.lit(None), F.lit(None), F.lit(None), F.col("text"))), "request_id", "rank", "block")
    sources = found.groupBy("request_id").agg(F.count("*").alias("sources"))
    out = requests.join(context, "request_id", "left").join(sources, "request_id", "left")
    answer = llm_text.GENERATORS[generate](llm_text.answer_prompt(F.col("query"), F.coalesce("context", F.lit("")), F.col("history")))
    return out.select("request_id", F.when(F.col("sources").isNull(), F.lit(llm_text.NO_ANSWER)).otherwise(answer).alias("answer"), F.coalesce("sources", F.lit(0)).alias("sources"))


def health(vectors: DataFrame, profile: RetrievalProfile = RetrievalProfile()) -> DataFrame:
    """One row with the number of passages and the pipeline in force."""
    top_k, top_n, rerank = profile.resolve()
    return vectors.agg(F.count("*").alias("chunks")).select(F.lit("ok").alias("status"), "chunks", F.lit(profile.name).alias("pipeline"), F.lit(top_k).alias("top_k"), F.lit(top_n).alias("top_n"), F.lit(rerank).alias("rerank"))

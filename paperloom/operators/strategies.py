"""The retrieval strategies as plans over questions; texts of language models enter as columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import embed
from paperloom.operators import evaluate, retrieve


@dataclass(frozen=True)
class StrategyConfig:
    """Sizes of the strategies' steps."""

    context_k: int = 6
    rerank_candidates: int = 20
    queries: int = 3
    per_query: int = 10
    agent_second: int = 20


class Strategies:
    """Plans over ``chunks`` (chunk_id, text) with their ``vectors`` (chunk_id, embedding) and
    ``questions`` (item_id, question, passage, query_json, verdict_json), item_id unique.

    Every plan gives (item_id, chunk_id, rank, score); questions that retrieve nothing have no row.
    """

    def __init__(self, chunks: DataFrame, vectors: DataFrame, questions: DataFrame, config: StrategyConfig = StrategyConfig()):
        self.chunks, self.vectors, self.questions, self.config = chunks, vectors, questions, config

    def _hits(self, text: Column, k: int, questions: DataFrame | None = None) -> DataFrame:
        q = (self.questions if questions is None else questions).select("item_id", text.alias("t")).where("coalesce(t, '') <> ''")
        return retrieve.knn(embed.hash_embedding(q, "item_id", "t"), self.vectors, "item_id", "chunk_id", "embedding", k)

    @staticmethod
    def _plain(hits: DataFrame) -> DataFrame:
        return hits.select(F.col("query").alias("item_id"), F.col("id").alias("chunk_id"), "rank", (-F.col("distance")).alias("score"))

    def _reranked(self, hits: DataFrame, text: Column, top_n: int) -> DataFrame:
        asked = self.questions.select(F.col("item_id").alias("query"), text.alias("query_text"))
        rows = hits.withColumnRenamed("id", "chunk_id").join(self.chunks.select("chunk_id", "text"), "chunk_id").join(asked, "query")
        return retrieve.lexical_rerank(rows, top_n).select(F.col("query").alias("item_id"), "chunk_id", "rank", F.col("rerank_score").alias("score"))

    def classic(self) -> DataFrame:
        """Q1: nearest chunks of the question."""
        return self._plain(self._hits(F.col("question"), self.config.context_k))

    def reranked(self) -> DataFrame:
        """Q2: more candidates, reranked by the question."""
        return self._reranked(self._hits(F.col("question"), self.config.rerank_candidates), F.col("question"), self.config.context_k)

    def hyde(self) -> DataFrame:
        """Q3: nearest chunks of a hypothetical passage."""
        return self._plain(self._hits(F.col("passage"), self.config.context_k))

    def hyde_reranked(self) -> DataFrame:
        """Q4: the same with more candidates, reranked by the passage, not the question."""
        return self._reranked(self._hits(F.col("passage"), self.config.rerank_candidates), F.col("passage"), self.config.context_k)

    def multi_query(self) -> DataFrame:
        """Q5: lists of several queries, fused by reciprocal ranks."""
        c = self.config
        listed = self.questions.select("item_id", F.posexplode(evaluate.parse_query_list(F.coalesce("query_json", F.lit("")), F.col("question"), c.queries)).alias("n", "t"))
        keyed = listed.select(F.concat_ws("#", F.col("item_id").cast("string"), F.col("n").cast("string")).alias("item_id"), "t", F.col("item_id").alias("owner"), "n")
        hits = self._hits(F.col("t"), c.per_query, keyed)
        rows = hits.join(keyed.select(F.col("item_id").alias("query"), "owner", "n"), "query").select(F.col("owner").alias("item_id"), F.col("id").alias("chunk_id"), F.col("n").alias("list"), "rank")
        return retrieve.fuse_ranked(rows, "item_id", "chunk_id", c.context_k).select("item_id", "chunk_id", "rank", F.col("fusion_score").alias("score"))

    def agentic(self) -> DataFrame:
        """Q6: where the verdict is insufficient, a second, reranked retrieval replaces the first."""
        c = self.config
        d = self.questions.withColumn("d", evaluate.parse_agent_decision(F.coalesce("verdict_json", F.lit("")), F.col("question")))
        short = d.where("not d.sufficient").select("item_id", F.col("d.improved_query").alias("question"), "passage")
        second = Strategies(self.chunks, self.vectors, short, c)
        again = second._reranked(second._hits(F.col("question"), c.agent_second), F.col("question"), c.context_k)
        return self.classic().join(short.select("item_id"), "item_id", "left_anti").unionByName(again)

    def run(self, name: str) -> DataFrame:
        """The plan of a strategy by name."""
        if name not in ("classic", "reranked", "hyde", "hyde_reranked", "multi_query", "agentic"):
            raise ValueError(f"no strategy {name!r}")
        return getattr(self, name)()

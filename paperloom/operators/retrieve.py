"""Nearest neighbours, reranking, fusion of ranked lists, contexts and conversation history."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions import text as T

#: Vectors of one block; a block of 64 doubles each takes 2 MB.
BLOCK = 4096
#: Fixed value: what stands for an empty context.
NO_CONTEXT = "No relevant context found."


def _blocks(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """(dim, block, rows): packed blocks of at most about BLOCK vectors of one length."""
    n = df.count()
    rows = df.select(F.col(key).alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null and size(v) > 0")
    return rows.groupBy(F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // BLOCK)))).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias(name))


def knn(queries: DataFrame, corpus: DataFrame, query_key: str, corpus_key: str, vector: str, k: int, metric: str = "l2") -> DataFrame:
    """(query, id, distance, rank): exact k nearest rows for each of a stated set of queries.

    Both sides are packed into blocks of bounded size; each pair of blocks is one matrix product
    that keeps k rows a query, so what is shuffled is k rows per query and block. The corpus stays
    where its salt puts it and every salt gets all blocks of queries, by a shuffled merge join: no
    side is broadcast, none has to fit in memory. ``l2`` is the squared distance, ``cosine`` one
    minus the cosine. Ties go to the smaller id; NULL ids and vectors are left out; vectors meet
    those of their own length only; queries find themselves.
    """
    width = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q = _blocks(queries, query_key, vector, "q").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    c = _blocks(corpus, corpus_key, vector, "c").withColumn("salt", F.pmod(F.col("block"), F.lit(width)).cast("int"))
    grid = q.hint("merge").join(c.hint("merge"), ["dim", "salt"])
    kq, kc = dict(queries.dtypes)[query_key], dict(corpus.dtypes)[corpus_key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"query": [], "id": [], "distance": []}
            for qs, cs in zip(batch.column("q"), batch.column("c")):
                qs, cs = qs.as_py(), cs.as_py()
                a, b = np.array([x["v"] for x in qs], dtype=np.float64), np.array([x["v"] for x in cs], dtype=np.float64)
                if metric == "cosine":
                    a = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
                    b = b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
                    d = 1.0 - a @ b.T
                else:
                    d = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0.0)
                d = np.round(d, 9)
                ids = np.array([x["id"] for x in cs], dtype=object)
                edge = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                for i, x in enumerate(qs):
                    near = np.flatnonzero(d[i] <= edge[i])  # with all ties of the last place
                    near = sorted(near, key=lambda j: (d[i, j], ids[j]))[:k]
                    out["query"] += [x["id"]] * len(near)
                    out["id"] += [ids[j] for j in near]
                    out["distance"] += [float(d[i, j]) for j in near]
            yield pa.RecordBatch.from_pydict(out, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(f"query {kq}, id {kc}, distance double")
    target = to_arrow_schema(struct)
    w = Window.partitionBy("query").orderBy("distance", "id")
    return grid.select("q", "c").mapInArrow(run, struct).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(corpus: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """The k nearest rows of one query vector by squared distance; a top-k, no full sort."""
    from paperloom.functions.embed import squared_l2

    d = squared_l2(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return corpus.withColumn("distance", F.round(d, 9)).orderBy("distance", key).limit(k)


def lexical_score(query: Column, text: Column) -> Column:
    """An offline reranking score: the share of the query's distinct words that the text holds."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w]+"), lambda w: w != ""))
    q = words(query)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, words(text))) / F.size(q)).otherwise(F.lit(0.0))


def no_rerank(hits: DataFrame, top_n: int) -> DataFrame:
    """The first results as they are."""
    return hits.where(F.col("rank") <= top_n)


def lexical_rerank(hits: DataFrame, top_n: int) -> DataFrame:
    """R4, offline: results of (query, rank, query_text, text) by lexical score, then as before."""
    w = Window.partitionBy("query").orderBy(F.desc("rerank_score"), "rank")
    scored = hits.withColumn("rerank_score", F.round(lexical_score(F.col("query_text"), F.col("text")), 9))
    return scored.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= top_n).withColumn("rank", F.col("new_rank")).drop("new_rank")


RERANKERS: dict[str, Callable[[DataFrame, int], DataFrame]] = {"": no_rerank, "none": no_rerank, "off": no_rerank, "false": no_rerank, "lexical": lexical_rerank}


def get_reranker(name: str) -> Callable[[DataFrame, int], DataFrame]:
    """A reranker by name; others are registered by the user."""
    try:
        return RERANKERS[(name or "").strip().lower()]
    except KeyError:
        raise ValueError(f"no reranker {name!r}; registered: {sorted(RERANKERS)}") from None


def fuse_ranked(ranked: DataFrame, group: str, item: str, top_n: int, constant: int = 60) -> DataFrame:
    """(group, item, fusion_score, rank) from rows (group, item, list, rank): sums of
    1/(constant + rank), ties to what was seen first (lower list, then rank). Sums are partial."""
    sums = ranked.where(F.col(item).isNotNull()).groupBy(group, item).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("fusion_score"), F.min(F.struct("list", "rank")).alias("first"))
    w = Window.partitionBy(group).orderBy(F.desc("fusion_score"), "first")
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n).drop("first")


def context_block(title: Column, document: Column, heading: Column, kind: Column, doi: Column, text: Column) -> Column:
    """One passage of T19 without its number: the line after '[Source i] ', and the text."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    name = F.when(~blank(title), title).when(~blank(document), document).otherwise(F.lit("Unknown source"))
    part = F.when(~blank(heading), heading).when(~blank(kind), kind).otherwise(F.lit("section"))
    return F.concat(name, F.lit("; "), part, F.when(~blank(doi), F.concat(F.lit("; DOI: "), doi)).otherwise(F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))


def format_context(hits: DataFrame, group: str, rank: str, block: str) -> DataFrame:
    """(group, context): the numbered passages of each group in rank order, divided by blank lines."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(block).alias("b"))))
    rows = hits.groupBy(group).agg(ordered.alias("x"))
    numbered = F.transform("x", lambda e, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit("] "), e.b))
    return rows.select(group, F.when(F.size("x") == 0, F.lit(NO_CONTEXT)).otherwise(F.array_join(numbered, "\n\n")).alias("context"))


def judge_context(blocks: Column, limit: int) -> Column:
    """Numbered passages (array of source, heading, text) cut at the limit, back to a line end."""
    parts = F.transform(blocks, lambda e, i: F.concat(F.lit("[Source "), (i + 1).cast("string"), F.lit(": "), e.source, F.lit("; "), e.heading, F.lit("]\n"), e.text))
    whole = F.array_join(parts, "\n\n")
    return F.when(F.length(whole) <= limit, whole).otherwise(F.concat(F.regexp_replace(F.substring(whole, 1, limit), r"\n[^\n]*\z", ""), F.lit("\n[Context truncated for judging]")))


def history_text(turns: DataFrame, conversation: str, order: list[str], last: int = 6) -> DataFrame:
    """T20 and T21 over (conversation, role, content): (conversation, history, user_questions).

    The last six turns, white space collapsed, cut at 1200 characters; every role but user reads
    Assistant. The questions are the last three non-blank user turns among them, 500 characters each.
    """
    w = Window.partitionBy(conversation).orderBy(*[F.desc(c) for c in order])
    recent = turns.withColumn("n", F.row_number().over(w)).where(F.col("n") <= last)
    t = T.squeeze(F.coalesce("content", F.lit("")))
    cut = F.when(F.length(t) > 1200, F.concat(F.regexp_replace(F.substring(t, 1, 1200), r" [^ ]*\z", ""), F.lit(" ..."))).otherwise(t)
    line = F.concat(F.when(F.col("role") == "user", F.lit("User: ")).otherwise(F.lit("Assistant: ")), cut)
    rows = recent.select(conversation, (-F.col("n")).alias("o"), "role", t.alias("t"), line.alias("line"))
    g = rows.groupBy(conversation).agg(F.sort_array(F.collect_list(F.struct("o", "role", "t", "line"))).alias("x"))
    asked = F.filter("x", lambda e: (e.role == "user") & (e.t != ""))
    asked = F.slice(asked, F.greatest(F.lit(1), F.size(asked) - 2), 3)
    return g.select(conversation, F.array_join(F.transform("x", lambda e: e.line), "\n").alias("history"), F.array_join(F.transform(asked, lambda e: F.concat(F.lit("- "), F.substring(e.t, 1, 500))), "\n").alias("user_questions"))


def history_query(query: Column, user_questions: Column) -> Column:
    """The question with the user's recent ones, or alone if there are none."""
    return F.when(F.coalesce(user_questions, F.lit("")) == "", query).otherwise(F.concat(F.lit("Recent user questions:\n"), user_questions, F.lit("\n\nCurrent question:\n"), query, F.lit("\n")))

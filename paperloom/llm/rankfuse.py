"""One ranking from several differently scaled scores (reciprocal rank fusion)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.relational import rank_in_groups


def fuse_scores(df: DataFrame, group: str, item: str, scores: list[str], constant: int = 60) -> DataFrame:
    """(group, item, fused_score, fused_rank): items of each group by the sum of 1/(constant+rank).

    Each score is ranked by itself, highest first, equal scores share the better rank; a NULL or
    NaN score adds nothing. Ties of the sum go to the higher mean of the scores scaled to the
    group's range, then to the smaller item. Repeated rows count once (the highest of each score);
    rows without group or item, and empty tables, give nothing; other columns are not read.

    A group is never ranked in one task, see rank_in_groups.
    """
    src = df.select(F.col(group).alias("g"), F.col(item).alias("i"), *[F.col(s).cast("double").alias(f"s{k}") for k, s in enumerate(scores)])
    src = src.where("g is not null and i is not null")
    clean = [F.when(~F.isnan(f"s{k}"), F.col(f"s{k}")) for k in range(len(scores))]
    once = src.groupBy("g", "i").agg(*[F.max(c).alias(f"s{k}") for k, c in enumerate(clean)])
    long = once.select("g", "i", F.posexplode(F.array(*[f"s{k}" for k in range(len(scores))])).alias("m", "s")).where("s is not null")
    shape = long.groupBy("g", "m").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    placed = long.join(shape, ["g", "m"]).select("g", "i", "m", "s", F.expr("case when hi > lo then (s - lo) / (hi - lo) else 0.5D end").alias("scaled"))
    ranked = rank_in_groups(placed, ["g", "m"], "s", [], "rank", competition=True)
    # summed in a fixed order, so that equal ranks give equal sums
    parts = F.array_sort(F.collect_list(F.struct(F.col("rank").alias("rank"), F.col("scaled").alias("scaled"))))
    fused = ranked.groupBy("g", "i").agg(parts.alias("p"))
    fused = fused.select("g", "i", F.expr(f"aggregate(p, 0D, (a, x) -> a + 1D / ({constant} + x.rank))").alias("fused_score"), F.expr("aggregate(p, 0D, (a, x) -> a + x.scaled)").alias("scaled"))
    everyone = once.select("g", "i").join(fused, ["g", "i"], "left")
    out = everyone.select("g", "i", F.round(F.coalesce("fused_score", F.lit(0.0)), 12).alias("fused_score"), F.round(F.coalesce("scaled", F.lit(0.0)), 9).alias("scaled"))
    return out.select(F.col("g").alias(group), F.col("i").alias(item), "fused_score", "scaled")


def ranking(fused: DataFrame, group: str, item: str) -> DataFrame:
    """The fused items with ``fused_rank`` (1 first) within their group."""
    out = rank_in_groups(fused, [group], "fused_score", [F.desc("scaled"), F.asc(item)], "fused_rank")
    return out.select(group, item, "fused_score", F.col("fused_rank").cast("int").alias("fused_rank"))


def winners(fused: DataFrame, group: str, item: str) -> DataFrame:
    """The first item of each group: a pre-aggregated maximum, no sort. A group all of whose
    scores are missing has its smallest item first."""
    best = fused.groupBy(group).agg(F.max(F.struct("fused_score", "scaled")).alias("best"))
    ties = fused.join(best, group).where((F.col("fused_score") == F.col("best.fused_score")) & (F.col("scaled") == F.col("best.scaled")))
    return ties.groupBy(group).agg(F.min(item).alias(item))

"""Small relational helpers: keep-first, forward fill, anti-join skip, upsert, outer collection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.runtime import durable


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first in an explicit order; NULL keys are one group.

    A pre-aggregated minimum of (order, row), so a hot key is reduced map-side, not sorted.
    """
    o = [F.col(c) if isinstance(c, str) else c for c in order]
    rest = [c for c in df.columns if c not in keys]
    comparable = [c for c in rest if not isinstance(df.schema[c].dataType, _maps())]
    if len(comparable) < len(rest):  # maps can't be compared: sort within the key instead
        w = Window.partitionBy(*keys).orderBy(*o)
        return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    best = df.groupBy(*keys).agg(F.min(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(o)], F.struct(*[F.col(c) for c in rest]).alias("row"))).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.row.{c}").alias(c) for c in rest]).select(*df.columns)


def _maps() -> tuple:
    from pyspark.sql.types import MapType, VariantType

    return (MapType, VariantType)


def forward_fill_group(df: DataFrame, order: str, is_head: Column, partitions: int | None = None) -> DataFrame:
    """Each row with ``head``: the order value of the last head row at or before it (NULL before
    the first), and ``ordinal``: the number of heads up to there. Rows are range-partitioned by the
    order; each range's last head and count are carried over by a table of one row per range, so no
    task sees more than its range. Ties in the order share their head; rows with a NULL order come
    first.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = df.withColumn("_head", F.when(is_head, F.col(order)))
    ranged = durable(marked.repartitionByRange(n, F.col(order).asc_nulls_first()).withColumn("_pid", F.spark_partition_id()))
    last = ranged.groupBy("_pid").agg(F.max("_head").alias("_last"), F.count("_head").alias("_heads"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    carry = last.select("_pid", F.max("_last").over(before).alias("_carry"), F.coalesce(F.sum("_heads").over(before), F.lit(0)).alias("_count"))
    inside = Window.partitionBy("_pid").orderBy(F.col(order).asc_nulls_first())
    out = ranged.withColumn("_own", F.max("_head").over(inside)).withColumn("_n", F.count("_head").over(inside)).join(F.broadcast(carry), "_pid", "left")
    out = out.withColumn("head", F.coalesce("_own", "_carry")).withColumn("ordinal", F.col("_n") + F.col("_count"))
    return out.drop("_head", "_pid", "_own", "_carry", "_n", "_count")


def rank_in_groups(df: DataFrame, groups: list[str], score: str, ties: list[Column], name: str, cuts: int = 15, competition: bool = False) -> DataFrame:
    """Rows with their rank in their group by a descending numeric score (no NULL or NaN).

    A group is never ranked in one task: approximate quantiles (mergeable sketches) cut its scores
    into ranges, counts of the ranges give offsets, and only within a range rows are sorted. Equal
    scores lie in one range. ``ties`` order equal scores; with ``competition`` they share the better
    rank instead. The result is exact whatever the quantiles are.
    """
    shape = df.groupBy(*groups).agg(F.percentile_approx(score, [x / (cuts + 1) for x in range(1, cuts + 1)], 1000).alias("_cuts"))
    placed = df.join(shape, groups).withColumn("_range", F.expr(f"size(filter(_cuts, c -> c < `{score}`))")).drop("_cuts")
    sizes = placed.groupBy(*groups, "_range").agg(F.count("*").alias("_n"))
    above = Window.partitionBy(*groups).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*groups, "_range", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    inside = Window.partitionBy(*groups, "_range").orderBy(F.desc(score), *([] if competition else ties))
    number = F.rank() if competition else F.row_number()
    return placed.join(offsets, [*groups, "_range"]).withColumn(name, F.col("_above") + number.over(inside)).drop("_range", "_above")


def split_existing(new: DataFrame, existing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(missing, skipped): rows whose key the store lacks, and those it has; duplicates survive."""
    keys = existing.select(key).distinct()
    return new.join(keys, key, "left_anti"), new.join(keys, key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Insert or replace by key: old rows without a new version, and all new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def collect_outer(summaries: dict[str, DataFrame], key: str) -> DataFrame:
    """Summaries joined by key, each column prefixed by its summary's name; keys of any are kept."""
    parts = [df.select(key, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c != key]) for name, df in summaries.items()]
    return reduce(lambda a, b: a.join(b, key, "full_outer"), parts)


def last_write_wins(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Per key and column the value last written (by the order) that is no NULL: partial maxima."""
    o = F.struct(*order)
    return df.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), o)).alias(c) for c in columns])


def as_number(c: Column) -> Column:
    """P5: a number rounded to four places; blank, nan and NULL give NULL."""
    n = c.cast("string").try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n), F.round(n, 4))

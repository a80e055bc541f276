"""Exact order statistics per group without holding a group in memory.

Values are counted (map-side combined), placed in a fixed number of equal-width buckets per group, and
only the buckets that hold a wanted rank are sorted. The three rank rules of level measurement coexist.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def rank_position(rule: str, p: float, total: Column) -> Column:
    """0-based, possibly fractional rank."""
    if rule == "linear":
        return (total - 1) * F.lit(p)
    if rule == "nearest":
        return F.floor((total - 1) * F.lit(p) + 0.5).cast("double")
    if rule == "floor":
        return F.floor((total - 1) * F.lit(p)).cast("double")
    if rule == "index":
        return F.least(F.floor(total * F.lit(p)), total - 1).cast("double")
    raise ValueError(rule)


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, tuple[str, float]]
) -> DataFrame:
    """One row per key with a column per wanted quantile ``{name: (rule, p)}``. NULL values are ignored."""
    if not keys:
        keyed = df.withColumn("_all", F.lit(0))
        return exact_quantiles(keyed, ["_all"], value, wanted).drop("_all")
    keys = list(keys)
    counted = (
        df.select(*keys, F.col(value).cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    infinity = F.lit(float("inf"))
    finite = F.when(F.abs(F.col("_v")) < infinity, F.col("_v"))
    span = counted.groupBy(*keys).agg(
        F.min(finite).alias("_lo"), F.max(finite).alias("_hi"), F.sum("_c").alias("_total")
    )
    bucket = (
        F.when(F.col("_v") == -infinity, F.lit(-1))
        .when(F.col("_v") == infinity, F.lit(BUCKETS))
        .when(F.col("_hi") <= F.col("_lo"), F.lit(0))
        .otherwise(
            F.least(
                F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BUCKETS),
                F.lit(BUCKETS - 1),
            )
        )
        .cast("int")
    )
    placed = (
        counted.join(span, keys)
        .withColumn("_b", bucket)
        .select(*keys, "_v", "_c", "_total", "_b")
    )
    sizes = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"), F.first("_total").alias("_total"))
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))

    ranks = []
    for name, (rule, p) in wanted.items():
        position = rank_position(rule, p, F.col("_total"))
        low = F.floor(position)
        weight = position - low
        high = F.least(low + 1, F.col("_total") - 1)
        ranks.append(F.struct(F.lit(name).alias("q"), low.cast("long").alias("r"), (1 - weight).alias("w")))
        ranks.append(F.struct(F.lit(name).alias("q"), high.cast("long").alias("r"), weight.alias("w")))
    targets = (
        sizes.withColumn("_rank", F.explode(F.array(*ranks)))
        .filter(
            (F.col("_rank.w") > 0)
            & (F.col("_rank.r") >= F.col("_before"))
            & (F.col("_rank.r") < F.col("_before") + F.col("_n"))
        )
        .groupBy(*keys, "_b", "_before")
        .agg(F.collect_list("_rank").alias("_ranks"))
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    hits = (
        placed.drop("_total")
        .join(targets, [*keys, "_b"])
        .withColumn("_cum", F.sum("_c").over(inside) + F.col("_before"))
        .withColumn("_rank", F.explode("_ranks"))
        .filter((F.col("_rank.r") < F.col("_cum")) & (F.col("_rank.r") >= F.col("_cum") - F.col("_c")))
    )
    return hits.groupBy(*keys).agg(
        *[
            F.sum(F.when(F.col("_rank.q") == name, F.col("_v") * F.col("_rank.w"))).alias(name)
            for name in wanted
        ]
    )


def quantiles_of(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], rule: str, p: float, prefix: str = "m_"
) -> DataFrame:
    """The same quantile of several columns in one pass: the columns become rows, then columns again."""
    long = df.select(
        *keys,
        F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("_m"),
    ).select(*keys, F.col("_m.name").alias("_name"), F.col("_m.x").alias("_x"))
    found = exact_quantiles(long, [*keys, "_name"], "_x", {"_q": (rule, p)})
    return found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == c, F.col("_q"))).alias(f"{prefix}{c}") for c in columns]
    )

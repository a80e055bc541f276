"""Interval joins and interval algebra on timed rows.

Joins place intervals in time bins and equi-join on (key, bin); each pair is kept only in the first bin both
sides share, so nothing is deduplicated afterwards. Existence questions (semi, anti) are answered by running
maxima instead, without forming pairs at all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolake.operators.ordered import previous_row, running, slice_no

HOUR = 3600.0


def point_join(points: DataFrame, at: Column, intervals: DataFrame, keys: Sequence[str], start: str, end: str,
               width: float) -> DataFrame:
    """Points inside half-open intervals [start, end). Column names of both sides must differ except keys."""
    binned_points = points.withColumn("_at", at).withColumn("_bin", slice_no("_at", width))
    spread = intervals.filter(F.col(end) > F.col(start)).withColumn(
        "_bin", F.explode(F.sequence(slice_no(start, width), slice_no(end, width)))
    )
    return (
        binned_points.join(spread, [*keys, "_bin"])
        .filter((F.col(start) <= F.col("_at")) & (F.col("_at") < F.col(end)))
        .drop("_bin", "_at")
    )


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], l: tuple[str, str], r: tuple[str, str],
                 width: float, more_than: float = 0.0) -> DataFrame:
    """Pairs overlapping by more than ``more_than``; adds ``overlap``."""
    ls, le, rs, re = l[0], l[1], r[0], r[1]
    a = left.withColumn("_la", slice_no(ls, width)).withColumn(
        "_bin", F.explode(F.sequence("_la", F.greatest(F.col("_la"), slice_no(le, width))))
    )
    b = right.withColumn("_ra", slice_no(rs, width)).withColumn(
        "_bin", F.explode(F.sequence("_ra", F.greatest(F.col("_ra"), slice_no(re, width))))
    )
    overlap = F.least(F.col(le), F.col(re)) - F.greatest(F.col(ls), F.col(rs))
    return (
        a.join(b, [*keys, "_bin"])
        .filter(F.col("_bin") == F.greatest("_la", "_ra"))
        .withColumn("overlap", overlap)
        .filter(F.col("overlap") > more_than)
        .drop("_bin", "_la", "_ra")
    )


def isolated(df: DataFrame, keys: Sequence[str], start: str, end: str, tie: Sequence[str], more_than: float,
             width: float = HOUR) -> DataFrame:
    """Rows that no other row of the same key overlaps by more than ``more_than``.

    An earlier row overlaps if the largest earlier end reaches past start + x; a later one if the smallest later
    start (of rows longer than x) lies before end − x.
    """
    order = [start, end, *tie]
    slices = slice_no(start, width)
    long_enough = F.col(end) - F.col(start) > more_than
    seen = running(df, keys, slices, order, {"_reach": ("max", F.col(end))}, inclusive=False)
    seen = running(
        seen, keys, slices, order, {"_next": ("min", F.when(long_enough, F.col(start)))}, inclusive=False, reverse=True
    )
    hit_before = long_enough & (F.col("_reach") - F.col(start) > more_than)
    hit_after = long_enough & (F.col(end) - F.col("_next") > more_than)
    return seen.filter(
        ~F.coalesce(hit_before, F.lit(False)) & ~F.coalesce(hit_after, F.lit(False))
    ).drop("_reach", "_next")


def merge_intervals(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end",
                    aggs: dict[str, Column] | None = None, width: float = HOUR) -> DataFrame:
    """Union of intervals: overlapping or touching rows become one."""
    # Equal intervals count once while islands are numbered: two passes must not order ties differently.
    order = [start, end]
    slices = slice_no(start, width)
    spans = df.select(*keys, start, end).distinct()
    seen = running(spans, keys, slices, order, {"_reach": ("max", F.col(end))}, inclusive=False)
    flagged = seen.withColumn(
        "_new", F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), 1).otherwise(0)
    )
    numbered = running(flagged, keys, slices, order, {"_island": ("sum", F.col("_new"))})
    members = df.join(numbered.drop("_reach", "_new"), [*keys, start, end]) if aggs else numbered
    return members.groupBy(*keys, "_island").agg(
        F.min(start).alias(start), F.max(end).alias(end),
        *[column.alias(name) for name, column in (aggs or {}).items()],
    ).drop("_island")


def gaps(df: DataFrame, durations: DataFrame, keys: Sequence[str], minimum: float, pad: float = 0.0,
         width: float = HOUR) -> DataFrame:
    """What the intervals leave uncovered in [0, duration], at least ``minimum`` long, widened by ``pad``."""
    merged = merge_intervals(df.select(*keys, "start", "end"), keys, width=width)
    between = previous_row(merged, keys, slice_no("start", width), ["start"], ["end"])
    inner = between.select(*keys, F.coalesce("prev_end", F.lit(0.0)).alias("lo"), F.col("start").alias("hi"))
    tail = (
        merged.groupBy(*keys).agg(F.max("end").alias("lo"))
        .join(durations.select(*keys, "duration"), keys)
        .select(*keys, "lo", F.col("duration").alias("hi"))
    )
    empty = durations.join(merged, keys, "left_anti").select(*keys, F.lit(0.0).alias("lo"), F.col("duration").alias("hi"))
    return (
        inner.unionByName(tail).unionByName(empty)
        .filter(F.col("hi") - F.col("lo") >= minimum)
        .join(durations.select(*keys, "duration"), keys)
        .select(
            *keys,
            F.greatest(F.lit(0.0), F.col("lo") - pad).alias("start"),
            F.least(F.col("duration"), F.col("hi") + pad).alias("end"),
        )
    )


def rewindow(df: DataFrame, piece: float, step: float, minimum: float) -> DataFrame:
    """Cut intervals longer than ``piece`` into pieces that start every ``step``; a short last piece is dropped.

    The number of full pieces is the number of steps taken while more than ``piece`` remains.
    """
    length = F.col("end") - F.col("start")
    guess = F.greatest(F.lit(0), F.ceil((length - piece) / step).cast("int"))

    def longer(k):  # the loop's own test, so that rounding in the quotient cannot add or lose a piece
        return (F.col("end") - (F.col("start") + k * step) > piece).cast("int")

    full = guess + longer(guess) - F.when(guess > 0, 1 - longer(guess - 1)).otherwise(0)
    k = F.col("_k")
    begin = F.col("start") + k * step
    return (
        df.withColumn("_full", full)
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_full"))))
        .select(
            *[c for c in df.columns if c not in ("start", "end")],
            begin.alias("start"),
            F.when(k < F.col("_full"), begin + piece).otherwise(F.col("end")).alias("end"),
        )
        .filter(F.col("end") - F.col("start") >= minimum)
    )


def gap_pieces(df: DataFrame, piece: float, minimum: float) -> DataFrame:
    """Cut a gap into consecutive pieces of at most ``piece``, stopping when less than ``minimum`` is left."""
    length = F.col("end") - F.col("start")
    count = F.greatest(F.lit(0), (F.floor((length - minimum) / piece) + 1).cast("int"))
    begin = F.col("start") + F.col("_k") * piece
    return (
        df.withColumn("_count", count)
        .filter("_count > 0")
        .withColumn("_k", F.explode(F.expr("sequence(0, _count - 1)")))
        .select(
            *[c for c in df.columns if c not in ("start", "end")],
            begin.alias("start"),
            F.least(F.col("end"), begin + piece).alias("end"),
        )
    )


def coverage_semi(windows: DataFrame, needed: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Windows whose core [core_start, core_end) meets any needed interval."""
    wanted = needed.filter("end > start").select(*keys, F.col("start").alias("_ns"), F.col("end").alias("_ne")).withColumn(
        "_bin", F.explode(F.sequence(slice_no("_ns", width), slice_no("_ne", width)))
    )
    cores = windows.withColumn("_bin", F.explode(F.sequence(slice_no("core_start", width), slice_no("core_end", width))))
    condition = [cores[k] == wanted[k] for k in [*keys, "_bin"]] + [
        F.least(cores["core_end"], wanted["_ne"]) > F.greatest(cores["core_start"], wanted["_ns"])
    ]
    return cores.join(wanted, condition, "left_semi").drop("_bin").dropDuplicates(windows.columns)

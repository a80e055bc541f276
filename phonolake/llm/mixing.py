"""Mixing sources to target weights by entropy balancing, with built-in functions only.

Document rates are the least-informative change of "take everything once" that meets each source's token target:
rate = min(2, exp(lambda * size)), lambda being the source's multiplier in the convex dual. The dual is solved by Newton
steps kept inside a bracket. A step is one aggregation over (source, size) counts, so its work does not grow with the
hottest source's rows, and multipliers stay in a table, one row a source.

Rates become whole copies by walking each source's documents in the order of draw - fraction, the draw being hashed: a
document that fits what is left of the target gets one copy more, one that does not is passed over. The walk goes by
grouped rounds over 4 096 bins. A round takes the bins that fit whole, then enters the first that does not, or steps over
it if it holds one document. Documents larger than what is left are out of all later rounds, so a round is a range of
draws and a largest size, and the walk ends when nothing left fits. Rows of one id, source and size (repeated rows, null ids)
draw alike; the last 22 bits of a key are drawn from the row's place in the scan, so that they too are taken one by one. What
the walk still leaves (rows alike in all 62 bits) is less than a four-millionth of the source, and a few single documents close
most of it.

Edge cases: null texts and texts without words have size 0 and are taken 0 words; a null source is a source of its own,
ranked last; a source without words has target 0; repeated rows are told apart by their place alone; very long texts are
counted whole; columns of any name pass through; an empty table gives no rows. Every choice hangs on hashes of the data (and,
between rows that are alike, of their place in the scan), so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonolake.llm.text_stats import WORD
from phonolake.session import stage

DRAWN, PLACED = 40, 22  # bits of a key: the draw less the fraction, then the row's place
END = 1 << (DRAWN + PLACED)
WIDEST = DRAWN + PLACED - 12  # 4 096 bins over all keys


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources(source, source_size) -> with ``target``: words by weight, none above ``most`` times its source.

    With m = most * size / weight, the sources of smallest m are the ones that stop: walking up m, a source stops while
    its m is at most (words left) / (weight left). One row per source is sorted, never documents.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = sources.withColumn("_w", F.element_at(cycle, ((F.row_number().over(rank) - 1) % len(weights) + 1).cast("int")))
    w = w.withColumn("_cap", most * F.col("source_size")).withColumn("_m", F.col("_cap") / F.col("_w"))
    up = Window.orderBy("_m", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = (
        w.withColumn("_left", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weight", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_stops", F.col("_m") * F.col("_weight") <= F.col("_left"))
        # Once one source does not stop, none with a larger m does, and all of them share one level.
        .withColumn("_level", F.max(F.when(~F.col("_stops"), F.col("_left") / F.col("_weight"))).over(everything))
    )
    target = F.when(F.col("_stops") | F.col("_level").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_level") * F.col("_w")))
    return w.select("source", "source_size", target.alias("target"))


def rate(multiplier: Column, size: Column, most: float) -> Column:
    return F.least(F.lit(most), F.exp(F.least(multiplier * size, F.lit(50.0))))


def solve(sizes: DataFrame, goals: DataFrame, most: float = 2.0, steps: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """Multiplier per source: sizes(source, size, docs), goals(source, source_size, target) -> goals + lambda.

    The dual is taken in its log form: the step divides log(words taken / target) by the curvature, the sum of
    size**2 * rate over documents below the cap, as a part of the words. Words taken rise in lambda, so a step that
    leaves the bracket [lo, hi] is replaced by the bracket's middle.
    """
    shape = sizes.groupBy("source").agg(F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    state = (
        goals.join(shape.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        # exp(lambda * least) = most puts every document at the cap; exp(-40) leaves no word.
        .withColumn("hi", F.log(F.lit(most)) / F.col("least")).withColumn("lo", -40.0 / F.col("least"))
        .withColumn("lam", F.when(F.col("target") >= most * F.col("source_size"), F.col("hi")).otherwise(F.lit(0.0)))
        .withColumn("open", F.col("least").isNotNull() & (F.col("target") < most * F.col("source_size")))
    )
    state = stage(state, "dual")
    for _ in range(steps):
        if state.filter("open").isEmpty():
            break
        now = state.filter("open").select("source", "lam")
        x = F.col("size").cast("double")
        r = rate(F.col("lam"), x, most)
        seen = (
            sizes.alias("h").join(now.alias("n"), F.col("h.source").eqNullSafe(F.col("n.source")))
            .groupBy(F.col("h.source").alias("_s"))
            .agg(F.sum(F.col("docs") * x * r).alias("words"),
                 F.sum(F.when(r < most, F.col("docs") * x * x * r).otherwise(0.0)).alias("curve"))
        )
        gap = F.col("words") - F.col("target")
        step = (
            state.join(seen, F.col("source").eqNullSafe(F.col("_s")), "left")
            .withColumn("hi", F.when(F.col("open") & (gap > 0), F.col("lam")).otherwise(F.col("hi")))
            .withColumn("lo", F.when(F.col("open") & (gap < 0), F.col("lam")).otherwise(F.col("lo")))
            .withColumn("to", F.col("lam") - F.log(F.col("words") / F.col("target")) * F.col("words") / F.when(F.col("curve") > 0, F.col("curve")))
            .withColumn("to", F.when((F.col("to") > F.col("lo")) & (F.col("to") < F.col("hi")), F.col("to"))
                        .otherwise((F.col("lo") + F.col("hi")) / 2))
        )
        met = F.abs(gap) <= tolerance * F.col("target") + 1e-6
        state = stage(
            step.select(
                "source", "source_size", "target", "least", "hi", "lo",
                F.when(F.col("open") & ~met, F.col("to")).otherwise(F.col("lam")).alias("lam"),
                (F.col("open") & ~met & (F.col("hi") - F.col("lo") > 1e-15)).alias("open")),
            "dual")
    else:
        if not state.filter("open").isEmpty():
            raise RuntimeError(f"the dual of some source is not solved after {steps} steps")
    return state.select("source", "source_size", "target", "lam")


def draw(*columns: Column) -> Column:
    """A hashed number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _with_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows joined with the one row of their source; Spark broadcasts the plan while it is small."""
    plan = plan.select(*[F.col(c).alias(f"__{c}") for c in plan.columns])
    return rows.join(plan, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")


def _drawn(rows: DataFrame, most: int) -> DataFrame:
    """Adds __rate, __floor and __key (draw less fraction, then place) to rows(__rid, doc_id, source, __size) with their source's plan."""
    full = F.col("__target") >= most * F.col("__source_size")
    r = F.when(full, F.lit(float(most))).otherwise(rate(F.col("__lam"), F.col("__size").cast("double"), float(most)))
    rows = rows.withColumn("__rate", r).withColumn("__floor", F.floor("__rate"))
    v = draw(F.col("doc_id"), F.col("source"), F.col("__size")) - (F.col("__rate") - F.col("__floor"))
    drawn = F.least(F.floor((v + 1) * float(1 << (DRAWN - 1))), F.lit((1 << DRAWN) - 1)).cast("long")
    placed = F.shiftrightunsigned(F.xxhash64("__rid", F.lit(2)), 64 - PLACED)
    return rows.withColumn("__key", F.shiftleft(drawn, PLACED) + placed)


def _copies(most: int) -> Column:
    """Whole copies before the last gaps are closed: one more where a round of the walk takes the row."""
    taken = F.exists("__rounds", lambda r: (F.col("__size") <= r.cap) & (F.col("__key") >= r.lo) & (F.col("__key") < r.upto))
    extra = (F.col("__floor") < most) & (F.col("__size") > 0) & F.coalesce(taken, F.lit(False))
    return F.col("__floor") + F.when(extra, 1).otherwise(0)


def walked(room: DataFrame, gaps: DataFrame) -> DataFrame:
    """room(source, __size, __key), gaps(source, gap) -> source, rounds: what each round takes, as (cap, lo, upto).

    A round over [lo, hi) has bins of 2**shift keys. The first bin that does not fit whole is the next round's range.
    """
    least = room.groupBy(F.col("source").alias("_s")).agg(F.min("__size").alias("least"))
    state = gaps.join(least, F.col("source").eqNullSafe(F.col("_s"))).select(
        "source", "gap", "least", F.lit(0).cast("long").alias("lo"), F.lit(END).alias("hi"), F.lit(WIDEST).alias("shift"),
        F.expr("CAST(array() AS ARRAY<STRUCT<cap: BIGINT, lo: BIGINT, upto: BIGINT>>)").alias("rounds"))
    state = stage(state, "walk")
    going = (F.col("gap") >= F.col("least")) & (F.col("lo") < END)
    order = Window.partitionBy("source").orderBy("bin")
    while not (now := state.filter(going)).isEmpty():
        near = _with_source(room, now.select("source", "gap", "lo", "hi", "shift")).filter(
            (F.col("__size") <= F.col("__gap")) & (F.col("__key") >= F.col("__lo")) & (F.col("__key") < F.col("__hi")))
        bins = near.withColumn("bin", F.expr("shiftright(__key - __lo, __shift)")).groupBy("source", "bin").agg(
            F.sum("__size").alias("gain"), F.count(F.lit(1)).alias("docs"), F.max("__gap").alias("gap"))
        fits = F.col("reach") <= F.col("gap")
        seen = bins.withColumn("reach", F.sum("gain").over(order)).groupBy(F.col("source").alias("_s")).agg(
            F.sum(F.when(fits, F.col("gain"))).alias("used"), F.min(F.when(~fits, F.struct("bin", "docs"))).alias("over"))
        edge = F.expr("lo + shiftleft(over.bin, shift)")
        past = F.expr("lo + shiftleft(over.bin + 1, shift)")
        enter = F.col("over").isNotNull() & (F.col("over.docs") > 1) & (F.col("shift") > 0)
        upto = F.when(F.col("over").isNotNull(), edge).otherwise(F.col("hi"))
        taken = F.struct(F.col("gap").alias("cap"), F.col("lo"), upto.alias("upto"))
        step = state.join(seen, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("going", going)
        state = stage(step.select(
            "source",
            F.when(F.col("going"), F.col("gap") - F.coalesce("used", F.lit(0))).otherwise(F.col("gap")).alias("gap"), "least",
            F.when(~F.col("going"), F.col("lo")).when(enter, edge).when(F.col("over").isNotNull(), past).otherwise(F.col("hi")).alias("lo"),
            F.when(~F.col("going"), F.col("hi")).when(enter, past).otherwise(F.lit(END)).alias("hi"),
            F.when(~F.col("going"), F.col("shift")).when(enter, F.greatest(F.col("shift") - 12, F.lit(0))).otherwise(F.lit(WIDEST)).alias("shift"),
            F.when(F.col("going") & F.col("used").isNotNull(), F.array_append("rounds", taken)).otherwise(F.col("rounds")).alias("rounds")), "walk")
    return state.select("source", "rounds")


def solution(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """(plan: one row per source with its target, multiplier and level; chosen: at most 64 rows per source, by their place in the
    scan of docs, that get one copy more). Only ids and sizes are gathered, never texts."""
    compact = stage(
        docs.select(F.monotonically_increasing_id().alias("__rid"), "doc_id", "source", word_count(F.col("text")).alias("__size")), "sizes")
    sizes = stage(compact.groupBy("source", F.col("__size").alias("size")).agg(F.count(F.lit(1)).alias("docs")), "size-counts")
    goals = targets(sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size")), weights, share, most)
    solved = stage(solve(sizes, stage(goals, "targets"), most), "multipliers")

    drawn = _drawn(_with_source(compact, solved), most)
    gaps = drawn.groupBy("source").agg(
        (F.floor(F.max("__target") + 0.5) - F.sum(F.col("__floor") * F.col("__size"))).cast("long").alias("gap"))
    room = stage(drawn.filter((F.col("__floor") < most) & (F.col("__size") > 0)).select("source", "__size", "__key"), "room")
    rounds = walked(room, gaps).withColumnRenamed("source", "_s")
    plan = stage(solved.join(rounds, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-plan")

    # Close what is left per source with a few single documents.
    taken = _drawn(_with_source(compact, plan), most).withColumn("__copies", _copies(most))
    gaps = taken.groupBy("source").agg((F.max("__target") - F.sum(F.col("__copies") * F.col("__size"))).alias("gap"))
    room = taken.filter((F.col("__copies") < most) & (F.col("__size") > 0))
    kind = [F.floor(F.log2(F.col("__size"))).alias("class"), (F.xxhash64("doc_id", "__size", F.lit(1)) % 2).alias("half")]
    pick = (
        room.groupBy("source", *kind).agg(F.min(F.struct("__key", "__size", "doc_id", "__rid")).alias("c"))
        .groupBy(F.col("source").alias("_s"))
        .agg(F.sort_array(F.collect_list(F.struct(F.col("c.__size").alias("size"), "c.__key", F.col("c.__rid").alias("rid"))), asc=False).alias("candidates"))
    )
    greedy = F.expr("""
        aggregate(candidates, struct(CAST(gap AS DOUBLE) AS gap, CAST(array() AS ARRAY<BIGINT>) AS rids),
                  (a, c) -> IF(c.size <= a.gap + 0.5, struct(a.gap - c.size AS gap, concat(a.rids, array(c.rid)) AS rids), a)).rids""")
    chosen = gaps.join(pick, F.col("source").eqNullSafe(F.col("_s"))).select(F.explode(greedy).alias("__chosen"))
    return plan, stage(chosen, "mix-chosen")


def decided(docs: DataFrame, plan: DataFrame, chosen: DataFrame, most: int = 2) -> DataFrame:
    """docs (the same scan), each row a struct ``row``, with size, source_size, target, rate and copies. A row is decided where it
    is read: its source's plan and the few chosen rows come to it, so texts are not shuffled."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(
        whole, "doc_id", "source", F.monotonically_increasing_id().alias("__rid"), word_count(F.col("text")).alias("__size"))
    rows = _drawn(_with_source(rows, plan), most).join(chosen, F.col("__rid") == F.col("__chosen"), "left")
    copies = _copies(most) + F.when(F.col("__chosen").isNotNull(), 1).otherwise(0)
    return rows.select("row", *[F.col(f"__{c}").alias(c) for c in ("size", "source_size", "target", "rate")], copies.cast("long").alias("copies"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """docs(doc_id, source, text) -> doc_id, source, size, source_size, target, rate, copies, taken, one row per input row."""
    docs = docs.select("doc_id", "source", "text")
    plan, chosen = solution(docs, weights, share, most)
    return decided(docs, plan, chosen, most).select(
        "row.doc_id", "row.source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))

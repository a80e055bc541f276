"""Word-error scoring of transcript rows and the groups it is reported in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolake.functions.text import tokens
from phonolake.functions.wordalign import align


def with_errors(rows: DataFrame, reference: str = "text", hypothesis: str = "prediction") -> DataFrame:
    """Adds hits, substitutions, deletions, insertions and the predicted word count."""
    aligned = rows.withColumn("_a", align(tokens(F.col(reference)), tokens(F.col(hypothesis)))).withColumn(
        "predicted_words", F.size(tokens(F.col(hypothesis))).cast("long")
    )
    return aligned.select("*", "_a.*").drop("_a")


def error_sums() -> list[Column]:
    words = F.sum(F.col("hits") + F.col("substitutions") + F.col("deletions"))
    errors = F.sum(F.col("substitutions") + F.col("deletions") + F.col("insertions"))
    return [
        F.count(F.lit(1)).alias("examples"),
        words.alias("reference_words"),
        F.when(words > 0, errors / words).alias("wer"),
        F.sum("substitutions").alias("substitutions"),
        F.sum("deletions").alias("deletions"),
        F.sum("insertions").alias("insertions"),
    ]


def wer_block(scored: DataFrame, keys: list[str], negative: Column) -> DataFrame:
    """Summed counts per key; on instrumental rows, how many were given words and how many words."""
    return scored.groupBy(*keys).agg(
        *error_sums(),
        F.count_if(negative).alias("instrumental_examples"),
        F.count_if(negative & (F.col("predicted_words") > 0)).alias("instrumental_false_positives"),
        F.sum(F.when(negative, F.col("predicted_words")).otherwise(0)).alias("instrumental_invented_words"),
    )


def overlapping_groups(scored: DataFrame) -> DataFrame:
    """Each row tagged with every report group it belongs to; groups overlap, so a row is counted in several."""
    seen, first = F.col("used_for_selection"), F.col("first_annotated_phrase")
    spoken = F.col("text") != ""
    tags = [F.lit("all"), F.when(~seen, F.lit("unseen_excerpts")), F.when(first, F.lit("first_annotated_phrases"))]
    for source in ("mixture", "vocals"):
        here = F.col("source") == source
        tags += [
            F.when(here, F.lit(source)), F.when(here & spoken, F.lit(source + "_positive")),
            F.when(here & ~seen, F.lit(source + "_unseen")),
        ]
    tags.append(F.when(~spoken, F.lit("instrumental")))
    return scored.withColumn("group", F.explode(F.array_compact(F.array(*tags))))


def joined_songs(rows: DataFrame) -> DataFrame:
    """Reference and prediction of a song in time order, to be scored once as a whole."""
    ordered = F.array_sort(F.collect_list(F.struct("start", "text", "prediction")))
    return rows.groupBy("song").agg(ordered.alias("_r")).select(
        "song",
        F.array_join(F.transform("_r", lambda r: r["text"]), " ").alias("text"),
        F.array_join(F.transform("_r", lambda r: r["prediction"]), " ").alias("prediction"),
    )


def suggestion_outcomes(scored: DataFrame, changed: DataFrame) -> DataFrame:
    """Per suggestion the change in errors of its line: helpful, harmful or neutral."""
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    keys = ["rec_id", "line_no"]
    before = scored.select(*keys, errors.alias("errors_before"))
    after = changed.select(*keys, errors.alias("errors_after"))
    delta = F.col("errors_after") - F.col("errors_before")
    return after.join(before, keys).withColumn("error_delta", delta).withColumn(
        "outcome", F.when(delta < 0, "helpful").when(delta > 0, "harmful").otherwise("neutral")
    )


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("helpful", "harmful", "neutral")],
        F.count(F.lit(1)).alias("suggestions"),
        F.sum("errors_before").alias("baseline_errors"),
        F.sum("errors_after").alias("all_accepted_errors"),
    )


def first_phrases(rows: DataFrame, selected: DataFrame) -> DataFrame:
    """Marks each song's first phrase with text and the rows already used for model selection."""
    first = rows.filter(F.col("text") != "").groupBy("song").agg(F.min("start").alias("_first"))
    used = selected.select("song", "start", "end").distinct().withColumn("_used", F.lit(True))
    return (
        rows.join(first, "song", "left")
        .join(used, ["song", "start", "end"], "left")
        .withColumns({
            "used_for_selection": F.coalesce("_used", F.lit(False)),
            "first_annotated_phrase": F.coalesce((F.col("text") != "") & (F.col("start") == F.col("_first")), F.lit(False)),
        })
        .drop("_first", "_used")
    )


def opening_lines(lines: DataFrame) -> DataFrame:
    """First non-blank line of each song whose reference is complete (no line says 'not transcribed')."""
    incomplete = lines.filter(F.lower("text").contains("not transcribed")).select("song").distinct()
    return (
        lines.join(incomplete, "song", "left_anti")
        .filter(F.trim("text") != "")
        .groupBy("song")
        .agg(F.min("start").alias("start"), F.min_by("text", F.struct("start", "line_no")).alias("text"))
    )


def variant_comparison(lines: DataFrame, variants: list[str]) -> DataFrame:
    """Lines, lines to review, recovered lines and seconds per variant, side by side."""
    wide = lines.groupBy("rec_id").pivot("variant", variants).agg(
        F.count(F.lit(1)).alias("lines"), F.count_if("needs_review").alias("review_lines"),
        F.count_if("recovered").alias("recovered_lines"), F.round(F.sum("seconds"), 2).alias("seconds"),
    )
    return wide


def paired_baseline(rows: DataFrame, predictions: DataFrame, keys: list[str], labels: list[str]) -> DataFrame:
    """Problems that forbid reusing a stored baseline: missing, extra or differing rows. Empty means reusable."""
    a = rows.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in labels], F.lit(True).alias("_here"))
    b = predictions.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in labels], "prediction", F.lit(True).alias("_there"))
    both = a.join(b, keys, "full_outer")
    same = F.lit(True)
    for c in labels:
        same = same & F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    return both.select(
        *keys,
        F.when(F.col("_there").isNull(), "missing prediction")
        .when(F.col("_here").isNull(), "extra prediction")
        .when(~same, "labels differ")
        .when(F.col("prediction").isNull(), "incomplete prediction")
        .alias("problem"),
    ).filter(F.col("problem").isNotNull())

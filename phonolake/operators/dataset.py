"""Building and guarding evaluation and training tables of annotated recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolake.functions.text import artist_identity
from phonolake.operators.intervals import isolated
from phonolake.operators.ordered import ordinals

#: Start, end and kind; what follows them, without the blanks around it, is the text.
ANNOTATION_HEAD = r"^\s*(\S+)\s+(\S+)\s+(\S+)"


def seeded_order(seed: int, *columns: str) -> Column:
    """Hash that gives a reproducible pseudo-random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def seeded_rank(df: DataFrame, keys: list[str], seed: int, columns: list[str], out: str = "rank") -> DataFrame:
    """0-based position in seeded order per key; hash prefixes are the slices, so no key is one task."""
    group = keys or ["_all"]
    based = df if keys else df.withColumn("_all", F.lit(0))
    hashed = based.withColumn("_h", seeded_order(seed, *columns))
    ranked = ordinals(
        hashed, group, {"_prefix": F.substring("_h", 1, 3)}, [F.col("_h"), *[F.col(c) for c in columns]], out
    )
    return ranked.drop("_h", *([] if keys else ["_all"]))


def split_artists(rows: DataFrame, seed: int = 42, share: float = 0.15) -> DataFrame:
    """Every recording of an artist goes to one split; 15 % of the artists, at least one, are held out."""
    artists = rows.select(artist_identity(F.col("artist")).alias("identity")).distinct()
    ranked = seeded_rank(artists, [], seed, ["identity"])
    count = artists.agg(F.greatest(F.lit(1.0), F.bround(F.count(F.lit(1)) * share, 0)).alias("_held")).withColumn("_k", F.lit(0))
    assigned = ranked.withColumn("_k", F.lit(0)).join(count, "_k").select(
        "identity", F.when(F.col("rank") < F.col("_held"), "validation").otherwise("train").alias("split")
    )
    return rows.withColumn("identity", artist_identity(F.col("artist"))).join(assigned, "identity").drop("identity")


def expand_sources(rows: DataFrame) -> DataFrame:
    """Vocals and mixture for rows with text, the mixture only for instrumental rows."""
    sources = F.when(F.col("text") == "", F.array(F.lit("mixture"))).otherwise(
        F.array(F.lit("vocals"), F.lit("mixture"))
    )
    return rows.withColumn("source", F.explode(sources))


def annotation_reason() -> Column:
    """First rule a parsed annotation breaks, or NULL; the order of the rules matters."""
    length = F.col("end") - F.col("start")
    return (
        F.when(F.col("_doubt"), "uncertain_excluded")
        .when(F.col("start").isNull() | F.col("end").isNull() | F.col("kind").isNull(), "malformed_excluded")
        .when(~((length >= 1) & (length <= 30)) | (F.col("start") < 0), "duration_excluded")
        .when(~F.col("kind").isin("a", "b", "d"), "overlapping_different_words_excluded")
        .when((F.col("kind") != "d") & (F.trim("text") == ""), "empty_positive_excluded")
    )


def parse_annotations(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines(song, annotation_line, raw) to (kept rows, counts by reason); nothing is dropped uncounted."""
    from phonolake.functions.text import clock_seconds

    blanks = " \t\n\x0b\f\r"
    once = lambda *columns: F.inline(F.array(F.struct(*columns)))
    # Each step is a generator: a filter is not pushed through it, so long texts are matched once and not once per rule.
    lined = lines.select("song", "annotation_line", once(F.col("raw").alias("raw"))).filter(F.trim("raw") != "")
    headed = lined.select("*", once(F.regexp_extract("raw", ANNOTATION_HEAD, 0).alias("_head"))).select(
        "song", "annotation_line", "_head", once(
            F.col("raw").rlike(r"[*?]").alias("_doubt"),
            F.when(F.col("_head") != "", F.trim(F.btrim(F.substring("raw", F.length("_head") + 1, F.length("raw")), F.lit(blanks)))).otherwise("").alias("text")))
    field = lambda i: F.nullif(F.regexp_extract("_head", ANNOTATION_HEAD, i), F.lit(""))
    parsed = headed.select("song", "annotation_line", "text", "_doubt", once(
        clock_seconds(field(1)).alias("start"), clock_seconds(field(2)).alias("end"), F.lower(field(3)).alias("kind"),
    )).select("song", "annotation_line", "start", "end", "kind", "text", once(annotation_reason().alias("reason")))
    counts = parsed.groupBy(
        F.coalesce("reason", F.when(F.col("kind") == "d", "negative").otherwise("positive")).alias("reason")
    ).agg(F.count(F.lit(1)).alias("rows"))
    kept = parsed.filter(F.col("reason").isNull()).select(
        "song", "annotation_line", "start", "end", "kind", F.when(F.col("kind") == "d", "").otherwise(F.col("text")).alias("text")
    )
    return kept, counts


def negatives_sampled(rows: DataFrame, seed: int = 43) -> DataFrame:
    """All positives and max(1, positives div 9) seeded negatives per split."""
    positives = rows.filter(F.col("text") != "")
    negatives = rows.filter(F.col("text") == "")
    ranked = seeded_rank(negatives, ["split"], seed, ["song", "start", "source"])
    quota = positives.groupBy("split").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 9)).alias("_quota"))
    kept = ranked.join(quota, "split", "left").filter(F.col("rank") < F.coalesce("_quota", F.lit(1))).drop("rank", "_quota")
    return positives.unionByName(kept.select(*positives.columns))


def balanced_subset(rows: DataFrame, total: int, seed: int = 44) -> DataFrame:
    """Per song at most max(1, total div songs) seeded rows, and ``total`` rows in song order; the cap is the feature."""
    songs = rows.agg(F.count_distinct("song").alias("_songs")).withColumn("_k", F.lit(0))
    ranked = seeded_rank(rows, ["song"], seed, ["start", "source"]).withColumn("_k", F.lit(0)).join(songs, "_k")
    share = F.greatest(F.lit(1), F.floor(F.lit(total) / F.greatest(F.lit(1), F.col("_songs"))))
    kept = ranked.filter(F.col("rank") < share).drop("_k", "_songs")
    return kept.orderBy("song", "rank").limit(total)


def fresh_artist_songs(songs: DataFrame, seen: DataFrame, count: int, seed: int = 7) -> DataFrame:
    """One seeded song for each of ``count`` artists that are not in ``seen``; ``fresh_artist_shortage`` tells when too few exist."""
    identity = artist_identity(F.col("artist"))
    known = seen.select(identity.alias("identity")).distinct()
    fresh = songs.withColumn("identity", identity).join(known, "identity", "left_anti").withColumn(
        "_h", seeded_order(seed, "song")
    )
    one = fresh.groupBy("identity").agg(F.min_by("song", "_h").alias("song"), F.min("_h").alias("_h"))
    return one.orderBy("_h").limit(count).select("identity", "song")


def fresh_artist_shortage(songs: DataFrame, seen: DataFrame, count: int) -> DataFrame:
    """One row (wanted, available, short): how many artists not in ``seen`` there are, and how many are lacking."""
    available = F.count_distinct("identity").cast("long")
    return seen_artist_exclusion(songs, seen).agg(
        F.lit(count).cast("long").alias("wanted"), available.alias("available"),
        F.greatest(F.lit(0).cast("long"), F.lit(count) - available).alias("short"))


def stratified_speakers(clips: DataFrame, per_group: int = 4, per_speaker: int = 3, seed: int = 7) -> DataFrame:
    """Per group some seeded speakers, per speaker some seeded clips of 2 to 25 seconds."""
    speakers = seeded_rank(clips.select("group", "speaker").distinct(), ["group"], seed, ["speaker"]).filter(
        F.col("rank") < per_group
    ).drop("rank")
    eligible = clips.filter((F.col("duration") >= 2) & (F.col("duration") <= 25)).join(speakers, ["group", "speaker"], "left_semi")
    return seeded_rank(eligible, ["group", "speaker"], seed, ["clip_id"]).filter(F.col("rank") < per_speaker).drop("rank")


def seen_artist_exclusion(songs: DataFrame, seen: DataFrame) -> DataFrame:
    known = seen.select(artist_identity(F.col("artist")).alias("identity")).distinct()
    return songs.withColumn("identity", artist_identity(F.col("artist"))).join(known, "identity", "left_anti")


def trusted_intervals(rows: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """Rows that no other annotation of the same key overlaps by more than 0.05 s."""
    return isolated(rows, keys, "start", "end", tie, 0.05)


def reference_lookup(selected: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, missing songs, duplicated reference names)."""
    duplicated = references.groupBy("song").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return (
        selected.join(references.select("song", "reference"), "song"),
        selected.join(references, "song", "left_anti"),
        duplicated,
    )


def manifest_violations(rows: DataFrame) -> DataFrame:
    """(rule, rows): every rule a manifest breaks."""
    spoken = F.trim("text") != ""
    length = F.col("end") - F.col("start")
    checks = {
        "unknown split": ~F.col("split").isin("train", "validation"),
        "segment duration": ~((length >= 1) & (length <= 30)),
        "annotation kind": ~F.col("kind").isin("a", "b", "d"),
        "uncertain text": F.col("text").rlike(r"[*?]"),
        "text and kind disagree": spoken == (F.col("kind") == "d"),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in checks.items()]))
    per_row = rows.select(F.explode(broken).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))

    def leak(identity, rule):
        sides = rows.select(identity.alias("_id"), "split").groupBy("_id").agg(
            F.bool_or(F.col("split") == "train").alias("_t"), F.bool_or(F.col("split") == "validation").alias("_v")
        )
        return sides.filter(F.col("_t") & F.col("_v")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 0").select(
            F.lit(rule).alias("rule"), "rows"
        )

    both = rows.agg(
        F.count_if(F.col("split") == "train").alias("_t"), F.count_if(F.col("split") == "validation").alias("_v")
    ).filter("_t = 0 OR _v = 0").select(F.lit("both splits required").alias("rule"), F.lit(1).cast("long").alias("rows"))
    return (
        per_row.unionByName(leak(F.lower(F.trim(F.col("song").cast("string"))), "song leakage"))
        .unionByName(leak(artist_identity(F.trim("artist")), "artist leakage"))
        .unionByName(both)
    )


def selection_changes(selected: DataFrame, stored: DataFrame) -> DataFrame:
    """Songs that make a new selection differ from the frozen one."""
    return selected.select("song").exceptAll(stored.select("song")).withColumn("change", F.lit("added")).unionByName(
        stored.select("song").exceptAll(selected.select("song")).withColumn("change", F.lit("removed"))
    )


def manifest_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("examples"), F.round(F.sum(F.col("end") - F.col("start")) / 60, 2).alias("minutes"),
        F.count_if(F.col("text") == "").alias("negatives"),
    )

"""From a side to a disc plan: trimming, validation and positions; where it divides is chosen in ``splits``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phonolake.functions.text import cd_time, cue_escape, isrc, sector_of, two
from phonolake.operators.ordered import SLICE, ordinals, running, slice_no

SECTOR = 588
DISC_RATE = 44100
LEAD_IN = 150
MAXIMUM_TRACKS = 99
MAXIMUM_SECONDS = 80 * 60
MINIMUM_SECONDS = 4.0

def trim_to_music(samples: DataFrame, tracks: DataFrame, threshold_db: float, width: int = SLICE) -> DataFrame:
    """Move inner track ends to the first and last loud sample. ``tracks(rec_id, track, start, end)``, disjoint.

    Only samples that reach the threshold take part, once per position whatever the number of channels.
    """
    loud = samples.filter(F.abs("v") >= 10 ** (threshold_db / 20)).select("rec_id", "n").distinct()
    spread = tracks.withColumn("_bin", F.explode(F.sequence(slice_no("start", width), slice_no(F.col("end") - 1, width))))
    found = (
        loud.withColumn("_bin", slice_no("n", width))
        .join(spread, ["rec_id", "_bin"])
        .filter((F.col("n") >= F.col("start")) & (F.col("n") < F.col("end")))
        .groupBy("rec_id", "track")
        .agg(F.min("n").alias("_first"), (F.max("n") + 1).alias("_last"))
    )
    ends = tracks.groupBy("rec_id").agg(F.min("track").alias("_a"), F.max("track").alias("_z"))
    joined = tracks.join(found, ["rec_id", "track"], "left").join(ends, "rec_id")
    music = F.when(F.col("track") == F.col("_a"), F.col("start")).otherwise(F.col("_first"))
    quiet = F.when(F.col("track") == F.col("_z"), F.col("end")).otherwise(F.col("_last"))
    usable = F.coalesce(music < quiet, F.lit(False))
    return joined.select(
        "rec_id", "track", F.when(usable, music).otherwise(F.col("start")).alias("start"),
        F.when(usable, quiet).otherwise(F.col("end")).alias("end"),
    )


def plan_diff(old: DataFrame, new: DataFrame, rate: int) -> DataFrame:
    """Two plans(rec_id, track, start): same count → worst signed move, otherwise the change in count, as a sentence."""
    a = old.select("rec_id", "track", F.col("start").alias("_o"))
    b = new.select("rec_id", "track", F.col("start").alias("_n"))
    counts = old.groupBy("rec_id").agg(F.count(F.lit(1)).alias("previous")).join(
        new.groupBy("rec_id").agg(F.count(F.lit(1)).alias("proposed")), "rec_id", "full_outer"
    ).na.fill(0)
    move = F.col("_n") - F.col("_o")
    moves = a.join(b, ["rec_id", "track"]).groupBy("rec_id").agg(
        F.max_by(move, F.struct(F.abs(move), -F.col("track"))).alias("move")
    )
    seconds = F.coalesce(F.col("move"), F.lit(0)) / rate
    same = F.col("previous") == F.col("proposed")
    shift = F.when(seconds == 0, ", starts unchanged").otherwise(F.concat(
        F.format_string(", starts shift by at most %.1f s ", F.abs(seconds)), F.when(seconds < 0, "(earlier)").otherwise("(later)")))
    change = F.when(same, shift).otherwise(F.format_string(", %d before", "previous"))
    return counts.join(moves, "rec_id", "left").select(
        "rec_id", "previous", "proposed", F.when(same, seconds).alias("worst_move_s"),
        F.concat(F.format_string("%d planned", "proposed"), change).alias("sentence"))


def plan_from_regions(regions: DataFrame, lengths: DataFrame) -> DataFrame:
    """Regions(rec_id, region, name, start, end, cd_order) to tracks: tagged ones only, where any is tagged."""
    tagged = F.coalesce(F.col("cd_order") > 0, F.lit(False))
    switch = regions.groupBy("rec_id").agg(F.bool_or(tagged).alias("_any"))
    kept = (
        regions.join(switch, "rec_id").join(lengths, "rec_id")
        .filter(~F.col("_any") | tagged)
        .withColumns({
            "start": F.least(F.greatest(F.col("start"), F.lit(0)), F.col("frames")),
            "end": F.least(F.greatest(F.col("end"), F.lit(0)), F.col("frames")),
        })
        .filter("end > start")
    )
    placed = ordinals(
        kept.withColumn("_key", F.when(F.col("_any"), F.col("cd_order")).otherwise(0)), ["rec_id"],
        {"_k": F.col("_key"), "_part": slice_no("region", 4096)}, [F.col("_key"), F.col("region")], "_pos",
    )
    title = F.when(F.trim(F.coalesce("name", F.lit(""))) == "", "Track").otherwise(F.trim("name"))
    return placed.select("rec_id", (F.col("_pos") + 1).alias("track"), title.alias("title"), "start", "end")


def even_pregaps(plan: DataFrame, seconds: float) -> DataFrame:
    """The same pregap before every track but the first, snapped to 1/75 s."""
    frames = int(min(10.0, max(0.0, seconds)) * 75 + 0.5)
    return plan.withColumn("pregap", F.when(F.col("track") == 1, 0).otherwise(frames).cast("long"))


def assemble(files: DataFrame, gap_seconds: float) -> DataFrame:
    """Files(disc_id, position, title, frames) end to end on one timeline with even pregaps."""
    laid = running(
        files, ["disc_id"], slice_no("position", 4096), ["position"],
        {"track": ("sum", F.lit(1).cast("long")), "end": ("sum", F.col("frames"))},
    )
    named = F.trim(F.coalesce("title", F.lit("")))
    title = F.when(named == "", F.concat(F.lit("Track "), two(F.col("track")))).otherwise(named)
    return even_pregaps(
        laid.select("disc_id", "track", title.alias("title"), (F.col("end") - F.col("frames")).alias("start"), "end"),
        gap_seconds,
    )


def disc_positions(plan: DataFrame, lengths: DataFrame, rate: int) -> DataFrame:
    """Start and length in sectors of every track, and the lead-out, counted from the 150-sector lead-in."""
    joined = plan.join(lengths, "disc_id")
    first = sector_of(F.col("start"), rate, F.col("frames"))
    last = sector_of(F.col("end"), rate, F.col("frames"), True)
    sized = joined.withColumns({
        "sectors": F.greatest(F.lit(0).cast("long"), last - first),
        "_gap": F.when(F.col("track") == 1, 0).otherwise(F.col("pregap")).cast("long"),
    })
    placed = running(
        sized, ["disc_id"], slice_no("track", 1024), ["track"], {"_upto": ("sum", F.col("_gap") + F.col("sectors"))}
    ).withColumn("start_sector", F.col("_upto") - F.col("sectors") + LEAD_IN)
    ends = sized.groupBy("disc_id").agg((F.sum(F.col("_gap") + F.col("sectors")) + LEAD_IN).alias("lead_out"))
    return placed.join(ends, "disc_id").select("disc_id", "track", "title", "start_sector", "sectors", "lead_out")


def cue_sheet(positions: DataFrame) -> DataFrame:
    """Sheet lines per track: header, escaped title, index time."""
    return positions.select(
        "disc_id", "track",
        F.concat(
            F.lit("  TRACK "), two(F.col("track")), F.lit(' AUDIO\n    TITLE "'), cue_escape(F.col("title")),
            F.lit('"\n    INDEX 01 '), cd_time(F.col("start_sector") - LEAD_IN),
        ).alias("sheet"),
    )


def image_sheet(plan: DataFrame, positions: DataFrame, performer: str = "") -> DataFrame:
    """Sheet of one continuous image per disc, as rows to be put out in order of track: row 0 is the disc's own header.

    Times count from the start of the image; a track with a pregap states where that begins as index 00.
    """
    name = F.concat(F.lit("disc-"), F.col("disc_id").cast("string"))
    by = F.concat(F.lit('PERFORMER "'), cue_escape(F.lit(performer)), F.lit('"\n')) if performer else F.lit("")
    header = positions.select("disc_id").distinct().select(
        "disc_id", F.lit(0).cast("long").alias("track"),
        F.concat(F.lit('TITLE "'), name, F.lit('"\n'), by, F.lit('FILE "'), name, F.lit('.wav" WAVE')).alias("sheet"))
    gap = F.when(F.col("track") == 1, 0).otherwise(F.coalesce("pregap", F.lit(0)))
    begin = F.col("start_sector") - LEAD_IN
    index = F.when(gap > 0, F.concat(F.lit("    INDEX 00 "), cd_time(begin - gap), F.lit("\n"))).otherwise("")
    lines = positions.join(plan.select("disc_id", "track", "pregap"), ["disc_id", "track"]).select(
        "disc_id", "track", F.concat(
            F.lit("  TRACK "), two(F.col("track")), F.lit(' AUDIO\n    TITLE "'), cue_escape(F.col("title")), F.lit('"\n'), index,
            F.lit("    INDEX 01 "), cd_time(begin)).alias("sheet"))
    return header.unionByName(lines)


def pq_sheet(positions: DataFrame) -> DataFrame:
    """Disc timing counted from the lead-in: (disc_id, entry, start, length) per track and, as entry AA, the lead-out."""
    tracks = positions.select(
        "disc_id", two(F.col("track")).alias("entry"), cd_time(F.col("start_sector")).alias("start"), cd_time(F.col("sectors")).alias("length"))
    out = positions.select("disc_id", "lead_out").distinct().select(
        "disc_id", F.lit("AA").alias("entry"), cd_time(F.col("lead_out")).alias("start"), F.lit(None).cast("string").alias("length"))
    return tracks.unionByName(out)


def plan_issues(plan: DataFrame, lengths: DataFrame, rate: int) -> DataFrame:
    """(disc_id, severity, message) for every rule a plan breaks."""
    joined = lengths.join(plan, "disc_id", "left")
    label = F.concat(F.lit("Track "), two(F.col("track")))
    empty = (F.col("start") < 0) | (F.col("end") > F.col("frames")) | (F.col("end") <= F.col("start"))
    sectors = F.greatest(
        F.lit(0).cast("long"),
        sector_of(F.col("end"), rate, F.col("frames"), True) - sector_of(F.col("start"), rate, F.col("frames")),
    )
    seconds = sectors * SECTOR / DISC_RATE
    issue = lambda when, severity, text: F.when(when, F.struct(F.lit(severity).alias("severity"), text.alias("message")))
    present = F.col("track").isNotNull()
    per_track = joined.filter(present).select(
        "disc_id",
        F.explode(F.array_compact(F.array(
            issue(empty, "error", F.concat(label, F.lit(" covers no audio."))),
            issue(~empty & (seconds < MINIMUM_SECONDS), "error", F.concat(label, F.lit(" is shorter than 4 s."))),
            issue(~empty & (F.trim(F.coalesce("title", F.lit(""))) == ""), "warning", F.concat(label, F.lit(" has no title."))),
            issue(~empty & (F.coalesce("isrc", F.lit("")) != "") & (isrc(F.col("isrc")) == ""), "warning", F.concat(label, F.lit(" has an invalid ISRC."))),
        ))).alias("i"),
    ).select("disc_id", "i.*")
    gap = F.when(F.col("track") == 1, 0).otherwise(F.coalesce("pregap", F.lit(0)))
    totals = joined.withColumn("_sec", F.when(present & ~empty, sectors + gap).otherwise(0)).groupBy("disc_id").agg(
        F.count("track").alias("_tracks"), F.sum("_sec").alias("_total")
    )
    whole = totals.select(
        "disc_id",
        F.explode(F.array_compact(F.array(
            issue(F.col("_tracks") == 0, "error", F.lit("Add at least one track.")),
            issue(F.col("_tracks") > MAXIMUM_TRACKS, "error", F.lit("A CD holds at most 99 tracks.")),
            issue(F.col("_total") / 75 > MAXIMUM_SECONDS, "error", F.lit("The tracks are longer than a CD.")),
        ))).alias("i"),
    ).select("disc_id", "i.*")
    return per_track.unionByName(whole)


LEAD_OUT = 0xAA


def tracks_from_toc(entries: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Table of contents(disc_id, number, start, is_data) to tracks, with rejected discs and reasons.

    A table has at most 100 entries, so its window is small. ``sessions(disc_id, session, first, last, lead_out)`` meet the
    entries by disc and range of numbers: listing a session's numbers would make a hundred rows of one, unseen by the planner.
    """
    order = Window.partitionBy("disc_id").orderBy(F.when(F.col("number") == LEAD_OUT, 1000).otherwise(F.col("number")))
    seen = entries.withColumns({
        "_next": F.lead("number").over(order), "_next_start": F.lead("start").over(order),
        "_copies": F.count(F.lit(1)).over(Window.partitionBy("disc_id", "number")),
    })
    def session_of(tracks, number, session, lead_out):
        side = sessions.select(F.col("disc_id").alias("_d"), F.col("session").alias(session), F.col("first").alias("_f"),
                               F.col("last").alias("_l"), F.col("lead_out").alias(lead_out))
        met = (F.col("disc_id") == F.col("_d")) & F.col(number).between(F.col("_f"), F.col("_l"))
        return tracks.join(side, met, "left").drop("_d", "_f", "_l")

    tracks = session_of(seen.filter(F.col("number") != LEAD_OUT), "number", "_s", "_own_out")
    joined = session_of(tracks, "_next", "_ns", "_next_out")
    crosses = ~F.col("is_data") & (F.col("_next") != LEAD_OUT) & (F.col("_s") != F.col("_ns"))
    end = F.when(F.coalesce(crosses, F.lit(False)), F.col("_own_out")).otherwise(F.col("_next_start"))
    laid = joined.withColumn("_end", end)
    problem = (
        F.when(F.col("_copies") > 1, "repeated entry")
        .when(~F.col("number").between(1, 99), "invalid track number")
        .when(F.col("_next").isNull(), "no lead-out")
        .when((F.col("_next") != LEAD_OUT) & (F.col("_next") != F.col("number") + 1), "missing track")
        .when((F.col("start") < 0) | (F.col("_next_start") <= F.col("start")), "invalid sector range")
        .when((F.col("_end") <= F.col("start")) | (F.col("_end") > F.col("_next_start")), "invalid session lead-out")
    )
    checked = laid.withColumn("problem", problem)
    rejects = checked.filter(F.col("problem").isNotNull()).groupBy("disc_id").agg(F.min_by("problem", "number").alias("reason"))
    good = checked.join(rejects, "disc_id", "left_anti").select(
        "disc_id", "number", "start", (F.col("_end") - F.col("start")).alias("length"), "is_data"
    )
    return good, rejects

"""Audio and transcript shaped views over the given tables, once as DataFrames and once as SQL text."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.operators.ordered import ordinals
from phonolake.operators.weighting import weighting_response

SIG_RATE = 100
LR_RATE = 1000
#: Short responses for the fixtures, which SQL can sum lag by lag: the K weighting as made for 48 kHz, the activity high-pass
#: as made for 8 kHz behind a mean of three. Without that mean the fixture's noise crosses zero too often to be programme.
K_TAPS = [round(float(x), 12) for x in weighting_response("K", 48_000, 24)]
ACTIVITY_TAPS = [round(float(x), 12) for x in np.convolve(weighting_response("activity", 8_000, 22), [1 / 3] * 3)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mono signal, 100 Hz: (rec_id, ch, n, v)."""
    events = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).alias("rec_id"), "ts", "event_id", "value"
    )
    placed = ordinals(
        events,
        ["rec_id"],
        {"_day": F.to_date("ts"), "_hour": F.hour("ts")},
        [F.col("ts"), F.col("event_id")],
    )
    return placed.select(
        "rec_id", F.lit(0).cast("long").alias("ch"), "n", ((F.col("value") - 100.0) / 350.0).alias("v")
    )


def lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stereo pair, 1000 Hz: (rec_id, n, l, r), with quiet stretches."""
    order = [
        "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax",
    ]
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).alias("rec_id"), *order)
    placed = ordinals(
        lines,
        ["rec_id"],
        {"_day": F.col("l_shipdate"), "_orders": F.floor(F.col("l_orderkey") / 2**26)},
        [F.col(c) for c in order],
    )
    stretch = F.floor(F.col("n") / 1000) % 5
    level = F.when(stretch == 4, 0.0001).when(stretch == 3, 0.2).otherwise(1.0)
    return placed.select(
        "rec_id",
        "n",
        ((F.col("l_quantity") - 25.5) / 25.5 * level).alias("l"),
        ((F.col("l_discount") - 0.05) / 0.05 * level).alias("r"),
    )


def stereo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stereo pair as samples (rec_id, ch, n, v)."""
    return lr(spark, sf_dir).selectExpr("rec_id", "n", "stack(2, 0L, l, 1L, r) AS (ch, v)").select(
        "rec_id", "ch", "n", "v"
    )


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short analysis frames (rec_id, frame, i, v)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("label").cast("long").alias("rec_id"),
        F.col("vec_id").alias("frame"),
        F.posexplode("embedding").alias("i", "v"),
    ).select("rec_id", "frame", F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v"))


def _timed(i, word):
    """A word of the line at hand with its times and probability."""
    i, size = i.cast("long"), F.length(word).cast("long")
    start = (F.col("line_no") * 100 + i * 0.25).cast("double")
    doubtful = (F.col("rec_id") + F.col("line_no")) % 3 == 0
    p = F.when(doubtful, ((size * 7 + i) % 100) / 100.0).otherwise(0.6 + ((size + i) % 40) / 100.0)
    return F.struct(i.alias("i"), start.alias("w_start"), (start + 0.2).alias("w_end"), word.alias("word"), p.alias("p"))


def _split(text):
    return F.filter(F.split(text, r"[ \n\t\r]+"), lambda w: w != "")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed words (rec_id, line_no, i, w_start, w_end, word, p)."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("rec_id"), F.col("turn").alias("line_no"), F.posexplode(_split("text")).alias("i", "word"))
    return turns.select("rec_id", "line_no", _timed(F.col("i"), F.col("word")).alias("w")).select("rec_id", "line_no", "w.*")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per transcript line with its words: a line is one utterance, so its word list is short. Texts travel to their
    line and are split there; timed words would be ten times their size. A generator step, through which no filter is pushed, has
    them split once."""
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("rec_id"), F.col("turn").alias("line_no")).agg(
        F.collect_list("text").alias("_texts"))
    timed = F.array_sort(F.flatten(F.transform("_texts", lambda t: F.transform(_split(t), lambda w, i: _timed(i, w)))))
    return turns.select("rec_id", "line_no", F.explode(F.array(timed)).alias("words")).filter(F.size("words") > 0).select(
        "rec_id", "line_no",
        F.array_min(F.transform("words", lambda w: w["w_start"])).alias("start"),
        F.array_max(F.transform("words", lambda w: w["w_end"])).alias("end"),
        "words",
        F.exists("words", lambda w: w["p"] < 0.5).alias("needs_review"),
        F.array_join(F.transform("words", lambda w: w["word"]), " ").alias("text"),
    )


def pass2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second reading of the words: one-letter and very doubtful words are missed, some get a prefix."""
    base = words(spark, sf_dir).filter((F.length("word") > 1) & (F.col("p") >= 0.1))
    return base.withColumn(
        "word", F.when(F.col("i") % 11 == 5, F.concat(F.lit("x"), "word")).otherwise(F.col("word"))
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage annotations (song, artist, start, end, kind, text); the text is the whole document."""
    d = table(spark, sf_dir, "documents")
    guest = F.when(F.col("doc_id") % 17 == 0, " feat. guest").otherwise("")
    doubt = F.when(F.col("doc_id") % 13 == 0, "?").otherwise("")
    digit = F.col("doc_id") % 10
    start = (F.col("doc_id") * 7) % 300
    return d.select(
        F.col("doc_id").alias("song"),
        F.concat("source", F.lit("_"), "lang", guest).alias("artist"),
        start.cast("double").alias("start"),
        (start + F.col("n_chars") % 40).cast("double").alias("end"),
        F.when(digit == 0, "d").when(digit == 1, "b").when(digit == 2, "c").otherwise("a").alias("kind"),
        F.concat("text", doubt).alias("text"),
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation cells (corpus, recording, severity, planted, found, gain)."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        F.col("l_returnflag").alias("corpus"),
        F.col("l_suppkey").alias("recording"),
        F.col("l_linenumber").cast("long").alias("severity"),
        F.col("l_quantity").alias("planted"),
        (F.col("l_quantity") * (1 - F.col("l_discount") * 5)).alias("found"),
        (F.col("l_tax") * 100 - F.col("l_discount") * 40).alias("gain"),
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timeline clips (timeline_id, clip_id, source_id, source_start, length, timeline_start)."""
    o = table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 10).alias("timeline_id"),
        F.col("o_orderkey").alias("clip_id"),
        (F.col("o_custkey") % 7).alias("source_id"),
        "o_orderdate",
        F.col("o_orderkey"),
    )
    placed = ordinals(
        o,
        ["timeline_id"],
        {"_day": F.col("o_orderdate"), "_block": F.floor(F.col("o_orderkey") / 2**24)},
        [F.col("o_orderdate"), F.col("o_orderkey")],
        "pos",
    )
    return placed.select(
        "timeline_id",
        "clip_id",
        "source_id",
        F.lit(0).cast("long").alias("source_start"),
        ((F.col("clip_id") * 37) % 500 + 50).alias("length"),
        (F.col("pos") * 400).alias("timeline_start"),
    )




def _fir_sql(taps: list[float]) -> str:
    return "+".join(f"({t!r}::DOUBLE)*coalesce(lag(v,{k}) OVER w,0)" for k, t in enumerate(taps))


SQL = {
    "v_sig": """SELECT user_id%4 AS rec_id, CAST(0 AS BIGINT) AS ch,
        row_number() OVER (PARTITION BY user_id%4 ORDER BY ts,event_id)-1 AS n, (value-100.0)/350.0 AS v FROM events""",
    "v_lr": """SELECT rec_id, n,
        l*CASE CAST(floor(n/1000) AS BIGINT)%5 WHEN 4 THEN 0.0001::DOUBLE WHEN 3 THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS l,
        r*CASE CAST(floor(n/1000) AS BIGINT)%5 WHEN 4 THEN 0.0001::DOUBLE WHEN 3 THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END AS r
        FROM (SELECT l_suppkey%4 AS rec_id, row_number() OVER (PARTITION BY l_suppkey%4 ORDER BY l_shipdate,l_orderkey,
        l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_discount,l_tax)-1 AS n,
        (l_quantity-25.5::DOUBLE)/25.5::DOUBLE AS l, (l_discount-0.05::DOUBLE)/0.05::DOUBLE AS r FROM lineitem)""",
    "v_stereo": """SELECT rec_id, CAST(0 AS BIGINT) AS ch, n, l AS v FROM v_lr
        UNION ALL SELECT rec_id, CAST(1 AS BIGINT), n, r FROM v_lr""",
    "v_k": f"SELECT rec_id, ch, n, {_fir_sql(K_TAPS)} AS v FROM v_stereo WINDOW w AS (PARTITION BY rec_id, ch ORDER BY n)",
    "v_active": f"SELECT rec_id, ch, n, v, {_fir_sql(ACTIVITY_TAPS)} AS a FROM v_stereo WINDOW w AS (PARTITION BY rec_id, ch ORDER BY n)",
    "v_frames": """SELECT CAST(label AS BIGINT) AS rec_id, vec_id AS frame,
        CAST(generate_subscripts(embedding,1)-1 AS BIGINT) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings""",
    "v_words": r"""SELECT rec_id, line_no, i, CAST(line_no*100+i*0.25::DOUBLE AS DOUBLE) AS w_start,
        CAST(line_no*100+i*0.25::DOUBLE AS DOUBLE)+0.2::DOUBLE AS w_end, word,
        CASE WHEN (rec_id+line_no)%3=0 THEN ((length(word)*7+i)%100)/100.0::DOUBLE
             ELSE 0.6::DOUBLE+((length(word)+i)%40)/100.0::DOUBLE END AS p
        FROM (SELECT rec_id, line_no, CAST(generate_subscripts(ws,1)-1 AS BIGINT) AS i, unnest(ws) AS word
              FROM (SELECT conv_id AS rec_id, turn AS line_no,
                    list_filter(regexp_split_to_array(text,'[ \n\t\r]+'), lambda w: w<>'') AS ws FROM conversations))""",
    "v_lines": """SELECT rec_id, line_no, min(w_start) AS "start", max(w_end) AS "end", string_agg(word,' ' ORDER BY i) AS text,
        bool_or(p<0.5) AS needs_review FROM v_words GROUP BY rec_id, line_no""",
    "v_pass2": """SELECT rec_id, line_no, i, w_start, w_end, CASE WHEN i%11=5 THEN 'x'||word ELSE word END AS word, p
        FROM v_words WHERE length(word)>1 AND p>=0.1::DOUBLE""",
    "v_ann": """SELECT doc_id AS song, source||'_'||lang||CASE WHEN doc_id%17=0 THEN ' feat. guest' ELSE '' END AS artist,
        CAST((doc_id*7)%300 AS DOUBLE) AS "start", CAST((doc_id*7)%300+n_chars%40 AS DOUBLE) AS "end",
        CASE doc_id%10 WHEN 0 THEN 'd' WHEN 1 THEN 'b' WHEN 2 THEN 'c' ELSE 'a' END AS kind,
        text||CASE WHEN doc_id%13=0 THEN '?' ELSE '' END AS text FROM documents""",
    "v_cells": """SELECT l_returnflag AS corpus, l_suppkey AS recording, CAST(l_linenumber AS BIGINT) AS severity, l_quantity AS planted,
        l_quantity*(1-l_discount*5) AS found, l_tax*100-l_discount*40 AS gain FROM lineitem""",
    "v_clips": """SELECT o_custkey%10 AS timeline_id, o_orderkey AS clip_id, o_custkey%7 AS source_id, CAST(0 AS BIGINT) AS source_start,
        (o_orderkey*37)%500+50 AS length,
        400*(row_number() OVER (PARTITION BY o_custkey%10 ORDER BY o_orderdate,o_orderkey)-1) AS timeline_start FROM orders""",
}


def with_views(sql: str, views: dict[str, str] | None = None) -> str:
    """Put the views a query names (and those they name) in front of it as CTEs."""
    views = views or SQL
    needed: list[str] = []

    def need(text: str) -> None:
        for name in views:
            if name not in needed and re.search(rf"\b{name}\b", text):
                need(views[name])
                if name not in needed:
                    needed.append(name)

    need(sql)
    if not needed:
        return sql
    ctes = ", ".join(f"{name} AS ({views[name]})" for name in needed)
    body = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body[: len(head)].upper() == head:
            return f"{head}{ctes}, {body[len(head):]}"
    return f"WITH {ctes} {body}"

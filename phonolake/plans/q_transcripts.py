"""Queries for transcripts and their scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolake.functions import text as X
from phonolake.operators import dataset as D
from phonolake.operators import intervals as I
from phonolake.operators import scoring as C
from phonolake.operators import transcripts as R
from phonolake.plans import views as V
from phonolake.plans.q_transforms import r6
from phonolake.plans.registry import query
from phonolake.sources import transcripts as src

TOK = r"regexp_extract_all(lower(replace({},'’','''')),'[\p{{L}}\p{{N}}_]+')"


def tok(x):
    return TOK.format(x)


def _documents(spark, d):
    lines = V.lines(spark, d).withColumn(
        "words", F.transform("words", lambda w: F.struct(
            w["w_start"].alias("start"), w["w_end"].alias("end"), w["word"].alias("word"), w["p"].alias("probability")))
    )
    return src.to_documents(lines)


def _ranges(spark, d):
    """Recordings last 140 s per turn seen, minus a second for each tenth one, so that some transcripts overrun."""
    turns = V.table(spark, d, "conversations").groupBy(F.col("conv_id").alias("rec_id")).agg(F.max("turn").alias("t"))
    return turns.select("rec_id", F.lit(5.0).alias("offset"), (F.col("t") * 100 + 40.0).cast("double").alias("duration"))


_INGEST = """rg AS (SELECT rec_id, max(line_no)*100+40.0::DOUBLE AS dur FROM v_lines GROUP BY rec_id),
bad AS (SELECT rec_id, arg_min(p, line_no) AS reason FROM (SELECT l.rec_id, line_no, CASE WHEN "end">dur+0.25 THEN 'invalid line timings' WHEN "start">=least(dur,"end") THEN 'line outside the audio range' END AS p
 FROM v_lines l JOIN rg USING (rec_id)) WHERE p IS NOT NULL GROUP BY rec_id)"""


@query("src04_transcript_lines", f"""WITH {_INGEST} SELECT rec_id, line_no, round("start"+5,3) AS "start", round(least(dur,"end")+5,3) AS "end", text, needs_review,
  CAST(len(string_split(text,' ')) AS BIGINT) AS words FROM v_lines JOIN rg USING (rec_id) WHERE rec_id NOT IN (SELECT rec_id FROM bad)""")
def _(spark, d):
    good, _ = src.ingest(src.parse_transcripts(_documents(spark, d)), _ranges(spark, d))
    return good.select("rec_id", "line_no", r6("start", 3).alias("start"), r6("end", 3).alias("end"), "text", "needs_review",
                       F.size("words").cast("long").alias("words"))


@query("src04_transcript_rejects", f"WITH {_INGEST} SELECT rec_id, reason FROM bad")
def _(spark, d):
    return src.ingest(src.parse_transcripts(_documents(spark, d)), _ranges(spark, d))[1]


@query("fun27_transcript_json", """SELECT rec_id, CAST(count(*) AS BIGINT) AS lines, CAST(sum(len(string_split(text,' '))) AS BIGINT) AS words, round(max("end"),3) AS last_end FROM v_lines GROUP BY rec_id""")
def _(spark, d):
    return src.parse_transcripts(_documents(spark, d)).groupBy("rec_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.size("words")).alias("words"), r6(F.max("end"), 3).alias("last_end"))


def _ms(x):
    return f"CAST(floor({x}*1000+0.5) AS BIGINT)"


def _srt(x):
    m = _ms(x)
    return f"printf('%02d:%02d:%02d,%03d', {m}//3600000, {m}//60000%60, {m}//1000%60, {m}%1000)"


@query("snk01_transcript_export", f"""WITH c AS (SELECT rec_id, line_no, "start", "end", trim(regexp_replace(text,'\\s+',' ','g')) AS t FROM v_lines),
k AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY "start", line_no) AS cue FROM c WHERE t<>'')
SELECT rec_id, line_no, cue, t AS txt, printf('[%02d:%02d.%02d]', CAST(floor("start"*100+0.5) AS BIGINT)//6000, CAST(floor("start"*100+0.5) AS BIGINT)//100%60, CAST(floor("start"*100+0.5) AS BIGINT)%100)||t AS lrc,
 cue||chr(10)||{_srt('"start"')}||' --> '||{_srt('"end"')}||chr(10)||t||chr(10) AS srt FROM k""")
def _(spark, d):
    return R.export_lines(V.lines(spark, d))


def _figures(lines):
    """Recogniser figures derived from the line, as the given tables hold none."""
    size = F.length("text")
    return lines.withColumns({
        "avg_logprob": -(size % 12) / 10.0, "no_speech_prob": (size % 10) / 10.0, "compression_ratio": 1.0 + (size % 20) / 10.0,
    })


_FIG = """fg AS (SELECT *, -(length(text)%12)/10.0::DOUBLE AS lp, (length(text)%10)/10.0::DOUBLE AS ns, 1.0::DOUBLE+(length(text)%20)/10.0::DOUBLE AS cr FROM v_lines)"""


@query("flt02_needs_review", f"WITH {_FIG} SELECT rec_id, line_no, (lp< -0.8 OR ns>0.5 OR cr>2.4 OR needs_review) AS review FROM fg")
def _(spark, d):
    return _figures(V.lines(spark, d)).select("rec_id", "line_no", R.needs_review().alias("review"))


@query("flt03_stage_annotations", f"""WITH t AS (SELECT rec_id, line_no, i, word, CASE i%4 WHEN 0 THEN '['||word||']' WHEN 1 THEN '[Music]' WHEN 2 THEN word ELSE '(applause)' END AS text FROM v_words)
SELECT rec_id, line_no, i, text FROM t WHERE NOT (regexp_matches(trim(text),'^[\\[(♪♫]') AND array_to_string({tok('text')},' ') IN ('music','instrumental','silence','applause'))""")
def _(spark, d):
    k = F.col("i") % 4
    text = F.when(k == 0, F.concat(F.lit("["), "word", F.lit("]"))).when(k == 1, "[Music]").when(k == 2, F.col("word")).otherwise("(applause)")
    return V.words(spark, d).withColumn("text", text).filter(~X.is_stage_annotation(F.col("text"))).select("rec_id", "line_no", "i", "text")


@query("flt04_credible_lines", f"""WITH {_FIG}, w AS (SELECT rec_id, line_no, avg(p) AS a, avg(CASE WHEN p>=0.5 THEN 1.0::DOUBLE ELSE 0 END) AS s FROM v_words WHERE len({tok('word')})>0 GROUP BY 1,2)
SELECT rec_id, line_no, coalesce(lp>=-1 AND ns<=0.7 AND cr<=2.4 AND a>=0.5 AND s>=0.6, false) AS credible FROM fg LEFT JOIN w USING (rec_id, line_no)""")
def _(spark, d):
    return _figures(V.lines(spark, d)).select("rec_id", "line_no", R.credible().alias("credible"))


@query("join01_words_in_intervals", """WITH w AS (SELECT DISTINCT rec_id, w_start, w_end, word FROM v_words),
iv AS (SELECT rec_id, line_no, "start"+1.1::DOUBLE AS s, "end"-1.1::DOUBLE AS e FROM v_lines WHERE "end"-1.1::DOUBLE>"start"+1.1::DOUBLE)
SELECT iv.rec_id, line_no AS interval_id, string_agg(trim(word),' ' ORDER BY w_start, w_end, word) AS text, CAST(count(*) AS BIGINT) AS words FROM iv JOIN w ON w.rec_id=iv.rec_id AND (w_start+w_end)/2>=s AND (w_start+w_end)/2<e GROUP BY 1,2""")
def _(spark, d):
    words = V.words(spark, d)
    doubled = words.unionByName(words)  # every word reported twice, as overlapping decodes do
    intervals = V.lines(spark, d).select(
        "rec_id", F.col("line_no").alias("interval_id"), (F.col("start") + 1.1).alias("start"), (F.col("end") - 1.1).alias("end"))
    return R.words_in_intervals(doubled, intervals)


_ISO = """SELECT artist, song, "start", "end" FROM v_ann a WHERE NOT EXISTS (SELECT 1 FROM v_ann b WHERE b.artist=a.artist AND b.song<>a.song AND least(a."end",b."end")-greatest(a."start",b."start")>0.05)"""


@query("join02_isolated_intervals", _ISO)
def _(spark, d):
    return D.trusted_intervals(V.annotations(spark, d).select("artist", "song", "start", "end"), ["artist"], ["song"])


@query("join03_best_overlap", """WITH a AS (SELECT rec_id, line_no AS lid, "start"-CASE WHEN line_no>0 THEN 60 ELSE 0 END AS s, "end" AS e FROM v_lines),
b AS (SELECT rec_id, line_no AS rid, min(w_start) AS s, max(w_end) AS e FROM v_pass2 GROUP BY 1,2),
p AS (SELECT a.rec_id, lid, rid, least(a.e,b.e)-greatest(a.s,b.s) AS o FROM a JOIN b ON a.rec_id=b.rec_id AND least(a.e,b.e)-greatest(a.s,b.s)>0.08),
k AS (SELECT *, row_number() OVER (PARTITION BY rec_id, lid ORDER BY o DESC, rid) AS k, count(*) OVER (PARTITION BY rec_id, lid) AS "overlaps" FROM p)
SELECT rec_id, lid, "overlaps", rid, round(o,6) AS overlap FROM k WHERE k=1""")
def _(spark, d):
    left = _stretched(spark, d).select("rec_id", F.col("line_no").alias("lid"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))
    right = V.pass2(spark, d).groupBy("rec_id", F.col("line_no").alias("rid")).agg(F.min("w_start").alias("r_start"), F.max("w_end").alias("r_end"))
    return R.best_overlap(left, right, ["rec_id"]).withColumn("overlap", r6("overlap"))


_LN = """ln AS (SELECT rec_id, line_no, "start"-CASE WHEN line_no>0 THEN 60 ELSE 0 END AS s, "end" AS e FROM v_lines)"""


def _stretched(spark, d):
    """Lines that begin a minute early, so that neighbours share words."""
    early = F.when(F.col("line_no") > 0, 60).otherwise(0)
    return V.lines(spark, d).select("rec_id", "line_no", (F.col("start") - early).alias("start"), "end")


@query("join04_retry_words", f"""WITH {_LN}, m AS (SELECT rec_id, line_no, i, w_start, word, (w_start+w_end)/2 AS mid FROM v_words),
o AS (SELECT m.*, (SELECT count(*) FROM ln WHERE ln.rec_id=m.rec_id AND mid>=s AND mid<e) AS c, (SELECT min(ln.line_no) FROM ln WHERE ln.rec_id=m.rec_id AND mid>=s AND mid<e) AS owner FROM m)
SELECT rec_id, owner, string_agg(word,' ' ORDER BY w_start, line_no, i, word) AS suggestion FROM o WHERE c=1 GROUP BY 1,2""")
def _(spark, d):
    return R.retry_words(V.words(spark, d), _stretched(spark, d))


@query("join04_retry_ranges", """WITH b AS (SELECT rec_id, min("start") AS a, max("end") AS z FROM v_lines GROUP BY 1)
SELECT rec_id, line_no, CAST(floor(greatest(greatest(0,a),"start"-3)*1000) AS BIGINT) AS from_sample, CAST(greatest(floor(greatest(greatest(0,a),"start"-3)*1000),ceil(least(z,"end"+3)*1000)) AS BIGINT) AS to_sample FROM v_lines JOIN b USING (rec_id)""")
def _(spark, d):
    lines = V.lines(spark, d)
    bounds = lines.groupBy("rec_id").agg(F.min("start").alias("range_start"), F.max("end").alias("range_end"))
    return R.retry_ranges(lines, bounds, 1000)


@query("join05_coverage_semi", """SELECT DISTINCT a.song, a."start" AS core_start, a."end" AS core_end FROM v_ann a JOIN v_ann b ON a.artist=b.artist AND b.kind='d' AND b."end">b."start"
 AND least(a."end",b."end")>greatest(a."start",b."start")""")
def _(spark, d):
    a = V.annotations(spark, d)
    windows = a.select("artist", "song", F.col("start").alias("core_start"), F.col("end").alias("core_end"))
    return I.coverage_semi(windows, a.filter("kind = 'd'"), ["artist"], 30.0).select("song", "core_start", "core_end")


def _shaped_lines(spark, d):
    return V.lines(spark, d)


_DUR = """du AS (SELECT rec_id, max("end")+20 AS dur FROM v_lines GROUP BY 1)"""
_GAP = _DUR + """, gp AS (SELECT rec_id, coalesce(lag(m) OVER (PARTITION BY rec_id ORDER BY "start"),0) AS lo, "start" AS hi FROM (SELECT *, max("end") OVER (PARTITION BY rec_id ORDER BY "start") AS m FROM v_lines)
 UNION ALL SELECT rec_id, max("end"), max("end")+20 FROM v_lines GROUP BY 1)"""


def _durations(lines):
    return lines.groupBy("rec_id").agg((F.max("end") + 20).alias("duration"))


@query("set03_merge_intervals", """WITH r AS (SELECT artist, "start" AS s, "end" AS e, max("end") OVER (PARTITION BY artist ORDER BY "start","end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM v_ann),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR s>m THEN 1 ELSE 0 END) OVER (PARTITION BY artist ORDER BY s,e ROWS UNBOUNDED PRECEDING) AS g FROM r)
SELECT artist, min(s) AS "start", max(e) AS "end", CAST(count(*) AS BIGINT) AS merged FROM g GROUP BY artist, g""")
def _(spark, d):
    return I.merge_intervals(V.annotations(spark, d).select("artist", "start", "end"), ["artist"], aggs={"merged": F.count(F.lit(1))})


@query("set04_gaps", f"""WITH {_GAP} SELECT gp.rec_id, round(greatest(0,lo-0.6),6) AS "start", round(least(dur,hi+0.6),6) AS "end" FROM gp JOIN du USING (rec_id) WHERE hi-lo>=0.75""")
def _(spark, d):
    lines = V.lines(spark, d).select("rec_id", "start", "end")
    return I.gaps(lines, _durations(lines), ["rec_id"], 0.75, 0.6).select("rec_id", r6("start").alias("start"), r6("end").alias("end"))


@query("set05_rewindow", """WITH RECURSIVE w(rec_id, line_no, s, e) AS (SELECT rec_id, line_no, "start", "end" FROM v_lines UNION ALL SELECT rec_id, line_no, s+12, e FROM w WHERE e-s>14)
SELECT rec_id, line_no, round(s,6) AS "start", round(CASE WHEN e-s>14 THEN s+14 ELSE e END,6) AS "end" FROM w WHERE CASE WHEN e-s>14 THEN 14 ELSE e-s END>=0.75""")
def _(spark, d):
    out = I.rewindow(V.lines(spark, d).select("rec_id", "line_no", "start", "end"), 14.0, 12.0, 0.75)
    return out.withColumns({"start": r6("start"), "end": r6("end")})


@query("set05_gap_pieces", f"""WITH RECURSIVE {_GAP}, w(rec_id, s, e) AS (SELECT rec_id, lo, hi FROM gp WHERE hi-lo>=0.9 UNION ALL SELECT rec_id, s+12, e FROM w WHERE e-(s+12)>=0.9)
SELECT rec_id, round(s,6) AS "start", round(least(e,s+12),6) AS "end" FROM w""")
def _(spark, d):
    lines = V.lines(spark, d).select("rec_id", "start", "end")
    out = I.gap_pieces(I.gaps(lines, _durations(lines), ["rec_id"], 0.9), 12.0, 0.9)
    return out.withColumns({"start": r6("start"), "end": r6("end")})


@query("set04_recovery_windows", f"""WITH RECURSIVE {_GAP}, a AS (SELECT gp.rec_id, greatest(0,lo-0.6) AS s, least(dur,hi+0.6) AS e FROM gp JOIN du USING (rec_id) WHERE hi-lo>=0.75
 UNION ALL SELECT rec_id, greatest(0,"start"-0.6), least(dur,"end"+0.6) FROM v_lines JOIN du USING (rec_id) WHERE needs_review),
r AS (SELECT *, max(e) OVER (PARTITION BY rec_id ORDER BY s,e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM a),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR s>m THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY s,e ROWS UNBOUNDED PRECEDING) AS g FROM r),
u AS (SELECT rec_id, min(s) AS s, max(e) AS e FROM g GROUP BY rec_id, g),
w(rec_id, s, e) AS (SELECT rec_id, s, e FROM u UNION ALL SELECT rec_id, s+12, e FROM w WHERE e-s>14)
SELECT rec_id, round(s,6) AS "start", round(CASE WHEN e-s>14 THEN s+14 ELSE e END,6) AS "end" FROM w WHERE CASE WHEN e-s>14 THEN 14 ELSE e-s END>=0.75""")
def _(spark, d):
    lines = V.lines(spark, d).select("rec_id", "line_no", "start", "end", "needs_review")
    return R.recovery_windows(lines, _durations(lines)).select("rec_id", r6("start").alias("start"), r6("end").alias("end"))


@query("win26_boundary_duplicates", f"""WITH w AS (SELECT rec_id, line_no, i, w_start-CASE WHEN i%2=1 THEN 0.15::DOUBLE ELSE 0 END AS ws, w_end, word, array_to_string({tok('word')},' ') AS k FROM v_words),
l AS (SELECT *, lag(k) OVER o AS pk, lag(ws) OVER o AS ps, lag(w_end) OVER o AS pe FROM w WINDOW o AS (PARTITION BY rec_id ORDER BY ws, line_no, i))
SELECT rec_id, line_no, i, word FROM l WHERE NOT coalesce(k=pk AND least(w_end,pe)-greatest(ws,ps)>0.5*least(w_end-ws,pe-ps),false)""")
def _(spark, d):
    words = V.words(spark, d).withColumn("w_start", F.col("w_start") - F.when(F.col("i") % 2 == 1, 0.15).otherwise(0.0))
    return R.drop_boundary_duplicates(words).select("rec_id", "line_no", "i", "word")


@query("top03_review_budget", f"""WITH RECURSIVE {_GAP}, wk AS (SELECT * FROM (SELECT rec_id, line_no, i, w_start, w_end, row_number() OVER (PARTITION BY rec_id, line_no ORDER BY p, i) AS k FROM v_words) WHERE k=1),
fi AS (SELECT w.rec_id, w.line_no, min(w.i) AS f FROM v_words w JOIN wk USING (rec_id, line_no) WHERE w.i<=wk.i AND wk.w_end-w.w_start<=12 GROUP BY 1,2),
la AS (SELECT w.rec_id, w.line_no, max(w.i) AS l FROM v_words w JOIN wk USING (rec_id, line_no) JOIN fi USING (rec_id, line_no) JOIN v_words x ON x.rec_id=w.rec_id AND x.line_no=w.line_no AND x.i=fi.f
 WHERE w.i>=wk.i AND w.w_end-x.w_start<=12 GROUP BY 1,2),
c AS (SELECT l.rec_id, l.line_no, CASE WHEN l."end"-l."start"<=16 THEN l."start" ELSE min(w.w_start) END AS s, CASE WHEN l."end"-l."start"<=16 THEN l."end" ELSE max(w.w_end) END AS e, avg(w.p) AS a
 FROM v_lines l JOIN fi USING (rec_id, line_no) JOIN la USING (rec_id, line_no) JOIN v_words w ON w.rec_id=l.rec_id AND w.line_no=l.line_no AND (l."end"-l."start"<=16 OR w.i BETWEEN f AND la.l)
 WHERE needs_review AND len({tok('l.text')})>=2 GROUP BY l.rec_id, l.line_no, l."start", l."end"),
un AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY 1-a DESC, s, line_no) AS k FROM c),
ch AS (SELECT * FROM un WHERE k<=6), tk AS (SELECT rec_id, count(*) AS t FROM ch GROUP BY 1),
w(rec_id, s, e) AS (SELECT rec_id, lo, hi FROM gp WHERE hi-lo>=0.9 UNION ALL SELECT rec_id, s+12, e FROM w WHERE e-(s+12)>=0.9),
gk AS (SELECT rec_id, s, least(e,s+12) AS e, row_number() OVER (PARTITION BY rec_id ORDER BY s) AS k FROM w)
SELECT rec_id, 'line' AS kind, round(s,6) AS "start", round(e,6) AS "end" FROM ch UNION ALL SELECT gk.rec_id, 'gap', round(s,6), round(e,6) FROM gk LEFT JOIN tk USING (rec_id) WHERE k<=8-coalesce(t,0)""")
def _(spark, d):
    lines = V.lines(spark, d)
    return R.review_budget(lines, _durations(lines), 8).select("rec_id", "kind", r6("start").alias("start"), r6("end").alias("end"))


_SUG = """sg AS (SELECT rec_id, line_no, string_agg(word,' ' ORDER BY i) AS text FROM v_pass2 GROUP BY 1,2)"""


def _second(spark, d):
    ordered = F.array_sort(F.collect_list(F.struct("i", "word")))
    return V.pass2(spark, d).groupBy("rec_id", "line_no").agg(
        F.array_join(F.transform(ordered, lambda w: w["word"]), " ").alias("text"))


@query("set12_attach_suggestions", f"""WITH {_SUG}, {_GAP} SELECT l.rec_id, l.line_no, round(l."start",3) AS "start", round(l."end",3) AS "end", l.text, (needs_review OR sg.text IS NOT NULL) AS needs_review, sg.text AS second_opinion
 FROM v_lines l LEFT JOIN sg ON sg.rec_id=l.rec_id AND sg.line_no=l.line_no AND l.needs_review
 UNION ALL SELECT rec_id, CAST(-1 AS BIGINT), round(lo,3), round(hi,3), '', true, 'possible words' FROM gp WHERE hi-lo>=0.9""")
def _(spark, d):
    lines = V.lines(spark, d)
    spoken = _second(spark, d).join(lines.filter("needs_review"), ["rec_id", "line_no"], "left_semi").select(
        "rec_id", "line_no", F.lit("line").alias("kind"), F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), "text")
    missing = I.gaps(lines.select("rec_id", "start", "end"), _durations(lines), ["rec_id"], 0.9).select(
        "rec_id", F.lit(None).cast("long").alias("line_no"), F.lit("gap").alias("kind"), "start", "end", F.lit("possible words").alias("text"))
    out = R.attach_suggestions(lines, spoken.unionByName(missing))
    return out.withColumns({"start": r6("start", 3), "end": r6("end", 3)})


_KEY = "array_to_string({},'')"


@query("set13_confirmed_proposals", f"""WITH {_SUG}, vw AS (SELECT rec_id, line_no, text FROM v_lines UNION ALL SELECT rec_id, line_no, upper(text) FROM sg)
SELECT sg.rec_id, sg.line_no, sg.text, CAST(count(*) AS BIGINT) AS confirmation_views FROM sg JOIN vw ON vw.rec_id=sg.rec_id AND vw.line_no=sg.line_no GROUP BY 1,2,3
HAVING bool_and({_KEY.format(tok("regexp_replace(lower(vw.text),'\\balright\\b','all right','g')"))}={_KEY.format(tok("regexp_replace(lower(sg.text),'\\balright\\b','all right','g')"))})""")
def _(spark, d):
    proposals = _second(spark, d)
    views = V.lines(spark, d).select("rec_id", "line_no", "text").unionByName(proposals.withColumn("text", X.upper_each(F.col("text"))))
    return R.confirmed_proposals(proposals, views)


@query("set11_merge_passes")
def _(spark, d):
    lines = _figures(V.lines(spark, d))
    # The second reading of V.pass2, taken from the lines' own words.
    read = F.transform(F.filter("words", lambda w: (F.length(w["word"]) > 1) & (w["p"] >= 0.1)), lambda w: F.struct(
        w["i"].alias("i"), (w["w_start"] - 0.3).alias("w_start"), w["w_end"].alias("w_end"),
        F.when(w["i"] % 11 == 5, F.concat(F.lit("x"), w["word"])).otherwise(w["word"]).alias("word"), w["p"].alias("p")))
    second = V.lines(spark, d).select("rec_id", "line_no", F.explode(F.array(read)).alias("words")).filter(F.size("words") > 0).withColumns({
        "start": F.array_min(F.transform("words", lambda w: w["w_start"])), "end": F.array_max(F.transform("words", lambda w: w["w_end"])),
        "text": F.array_join(F.transform("words", lambda w: w["word"]), " "), "needs_review": F.lit(False),
        "avg_logprob": F.lit(-0.4), "no_speech_prob": F.lit(0.1), "compression_ratio": F.lit(1.4)})
    return R.merge_passes(lines, second).withColumns({"start": r6("start"), "end": r6("end")})


@query("set02_word_dedup", """SELECT rec_id, CAST(count(*) AS BIGINT) AS words FROM (SELECT DISTINCT rec_id, round(w_start,3) AS a, round(w_end,3) AS b, word FROM v_words) GROUP BY rec_id""")
def _(spark, d):
    w = V.words(spark, d)
    return w.unionByName(w).withColumns({"a": F.round("w_start", 3), "b": F.round("w_end", 3)}).dropDuplicates(
        ["rec_id", "a", "b", "word"]).groupBy("rec_id").agg(F.count(F.lit(1)).alias("words"))


# --- scoring ---------------------------------------------------------------------------------------------


def _pairs(spark, d):
    """Each line with its second reading as the prediction; every fifth song is instrumental."""
    lines = V.lines(spark, d).select("rec_id", "line_no", "start", "end", "text")
    out = lines.join(_second(spark, d).withColumnRenamed("text", "prediction"), ["rec_id", "line_no"], "left")
    silent = (F.col("rec_id") + F.col("line_no")) % 5 == 0
    return out.select(
        F.col("rec_id").alias("song"), "line_no", "start", "end", F.when(silent, "").otherwise(F.col("text")).alias("text"),
        F.coalesce("prediction", F.lit("")).alias("prediction"), F.when(silent, "d").otherwise("a").alias("kind"),
        F.when(F.col("line_no") % 2 == 0, "mixture").otherwise("vocals").alias("source"))


# Counts follow from how the second reading was made: missed words are deletions, changed ones substitutions. A
# changed word that the reference line also holds would make the alignment ambiguous; such words are counted in `amb`.
_LEX = f"""lx AS (SELECT w.rec_id, w.line_no, CASE WHEN (w.rec_id+w.line_no)%5=0 THEN 'd' ELSE 'a' END AS kind, w.i, len({tok('w.word')}) AS n, p2.word IS NOT NULL AS heard,
 coalesce(len({tok('p2.word')}),0) AS hn, p2.word<>w.word AND p2.word IS NOT NULL AS changed FROM v_words w LEFT JOIN v_pass2 p2 USING (rec_id, line_no, i)),
ls AS (SELECT rec_id AS song, line_no, kind, sum(CASE WHEN kind='a' THEN n ELSE 0 END) AS rw, sum(CASE WHEN kind='a' AND NOT heard THEN n ELSE 0 END) AS del,
 sum(CASE WHEN kind='a' AND changed AND n>0 THEN 1 ELSE 0 END) AS sub, sum(CASE WHEN kind='a' AND changed AND n=0 THEN 1 WHEN kind='d' THEN hn ELSE 0 END) AS ins, sum(hn) AS pw FROM lx GROUP BY 1,2,3)"""
_BLOCK = """CAST(count(*) AS BIGINT) AS examples, CAST(sum(rw) AS BIGINT) AS reference_words, round(CASE WHEN sum(rw)>0 THEN sum(sub+del+ins)/sum(rw)::DOUBLE END,6) AS wer,
 CAST(sum(sub) AS BIGINT) AS substitutions, CAST(sum(del) AS BIGINT) AS deletions, CAST(sum(ins) AS BIGINT) AS insertions"""


@query("agg32_word_errors", f"""WITH {_LEX} SELECT song, {_BLOCK}, CAST(count(CASE WHEN kind='d' THEN 1 END) AS BIGINT) AS instrumental_examples,
 CAST(count(CASE WHEN kind='d' AND pw>0 THEN 1 END) AS BIGINT) AS instrumental_false_positives, CAST(sum(CASE WHEN kind='d' THEN pw ELSE 0 END) AS BIGINT) AS instrumental_invented_words FROM ls GROUP BY song""")
def _(spark, d):
    return C.wer_block(C.with_errors(_pairs(spark, d)), ["song"], F.col("kind") == "d").withColumn("wer", r6("wer"))


@query("fun09_word_alignment", f"WITH {_LEX} SELECT song, line_no, CAST(rw-del-sub AS BIGINT) AS hits, CAST(sub AS BIGINT) AS substitutions, CAST(del AS BIGINT) AS deletions, CAST(ins AS BIGINT) AS insertions FROM ls")
def _(spark, d):
    return C.with_errors(_pairs(spark, d)).select("song", "line_no", "hits", "substitutions", "deletions", "insertions")


_GRP = """gr AS (SELECT ls.*, CASE WHEN line_no%2=0 THEN 'mixture' ELSE 'vocals' END AS source, line_no=0 AS used, kind='a' AND line_no=min(CASE WHEN kind='a' THEN line_no END) OVER (PARTITION BY song) AS fst FROM ls),
tg AS (SELECT *, unnest(list_filter(['all', CASE WHEN NOT used THEN 'unseen_excerpts' END, CASE WHEN fst THEN 'first_annotated_phrases' END, source, CASE WHEN kind='a' THEN source||'_positive' END,
 CASE WHEN NOT used THEN source||'_unseen' END, CASE WHEN kind='d' THEN 'instrumental' END], lambda x: x IS NOT NULL)) AS "group" FROM gr)"""


@query("agg33_report_groups", f"""WITH {_LEX}, {_GRP} SELECT "group", {_BLOCK} FROM tg GROUP BY 1""")
def _(spark, d):
    rows = _pairs(spark, d)
    marked = C.first_phrases(rows, rows.filter("line_no = 0"))
    return C.overlapping_groups(C.with_errors(marked)).groupBy("group").agg(*C.error_sums()).withColumn("wer", r6("wer"))


@query("win25_first_phrases", f"""WITH {_LEX}, {_GRP} SELECT song, line_no, used AS used_for_selection, fst AS first_annotated_phrase FROM gr""")
def _(spark, d):
    rows = _pairs(spark, d)
    return C.first_phrases(rows, rows.filter("line_no = 0")).select("song", "line_no", "used_for_selection", "first_annotated_phrase")


@query("agg34_joined_songs", f"""WITH {_LEX} SELECT song, CAST(sum(rw) AS BIGINT) AS reference_words, CAST(sum(pw) AS BIGINT) AS predicted_words FROM ls GROUP BY song""")
def _(spark, d):
    scored = C.with_errors(C.joined_songs(_pairs(spark, d)))
    return scored.select("song", (F.col("hits") + F.col("substitutions") + F.col("deletions")).alias("reference_words"), "predicted_words")


@query("agg35_suggestion_outcomes", f"""WITH {_LEX}, e AS (SELECT song, line_no, sub+del+ins AS b, CASE WHEN kind='a' THEN 0 ELSE rw END AS a FROM ls WHERE kind='a')
SELECT CAST(count(CASE WHEN a<b THEN 1 END) AS BIGINT) AS helpful, CAST(count(CASE WHEN a>b THEN 1 END) AS BIGINT) AS harmful, CAST(count(CASE WHEN a=b THEN 1 END) AS BIGINT) AS neutral,
 CAST(count(*) AS BIGINT) AS suggestions, CAST(sum(b) AS BIGINT) AS baseline_errors, CAST(sum(a) AS BIGINT) AS all_accepted_errors FROM e""")
def _(spark, d):
    rows = _pairs(spark, d).filter("kind = 'a'").withColumnRenamed("song", "rec_id")
    before = C.with_errors(rows)
    after = C.with_errors(rows.withColumn("prediction", F.col("text")))
    return C.outcome_totals(C.suggestion_outcomes(before, after))


@query("agg36_variant_comparison", """WITH l AS (SELECT rec_id, line_no, needs_review, unnest(['base','tuned']) AS variant, line_no%3=1 AS rec, "end"-"start" AS sec FROM v_lines)
SELECT rec_id, """ + ", ".join(f"""CAST(count(CASE WHEN variant='{v}' THEN 1 END) AS BIGINT) AS {v}_lines, CAST(count(CASE WHEN variant='{v}' AND needs_review THEN 1 END) AS BIGINT) AS {v}_review_lines,
 CAST(count(CASE WHEN variant='{v}' AND rec THEN 1 END) AS BIGINT) AS {v}_recovered_lines, round(sum(CASE WHEN variant='{v}' THEN sec END),2) AS {v}_seconds""" for v in ("base", "tuned")) + " FROM l GROUP BY rec_id")
def _(spark, d):
    lines = V.lines(spark, d).select(
        "rec_id", "needs_review", (F.col("line_no") % 3 == 1).alias("recovered"), (F.col("end") - F.col("start")).alias("seconds"),
        F.explode(F.array(F.lit("base"), F.lit("tuned"))).alias("variant"))
    return C.variant_comparison(lines, ["base", "tuned"])


@query("agg37_opening_lines", """WITH l AS (SELECT rec_id AS song, line_no, "start", CASE WHEN needs_review AND line_no=2 THEN 'Not transcribed' ELSE text END AS text FROM v_lines)
SELECT song, round(min("start"),3) AS "start", arg_min(text, line_no) AS text FROM l WHERE song NOT IN (SELECT song FROM l WHERE contains(lower(text),'not transcribed')) AND trim(text)<>'' GROUP BY song""")
def _(spark, d):
    gap = F.col("needs_review") & (F.col("line_no") == 2)
    lines = V.lines(spark, d).select(F.col("rec_id").alias("song"), "line_no", "start", F.when(gap, "Not transcribed").otherwise(F.col("text")).alias("text"))
    return C.opening_lines(lines).withColumn("start", r6("start", 3))


@query("join08_paired_baseline", """WITH a AS (SELECT rec_id, line_no, text FROM v_lines), b AS (SELECT rec_id, line_no, CASE WHEN line_no%4=1 THEN upper(text) ELSE text END AS text, CASE WHEN needs_review THEN NULL ELSE text END AS prediction FROM v_lines WHERE line_no<>3)
SELECT * FROM (SELECT a.rec_id, a.line_no, CASE WHEN b.rec_id IS NULL THEN 'missing prediction' WHEN a.text IS DISTINCT FROM b.text THEN 'labels differ' WHEN prediction IS NULL THEN 'incomplete prediction' END AS problem
 FROM a LEFT JOIN b USING (rec_id, line_no)) WHERE problem IS NOT NULL""")
def _(spark, d):
    lines = V.lines(spark, d)
    stored = lines.filter("line_no <> 3").select(
        "rec_id", "line_no", F.when(F.col("line_no") % 4 == 1, F.upper("text")).otherwise(F.col("text")).alias("text"),
        F.when(~F.col("needs_review"), F.col("text")).alias("prediction"))
    return C.paired_baseline(lines, stored, ["rec_id", "line_no"], ["text"])

"""Queries for dataset building, evaluation and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolake.functions import levels as L
from phonolake.functions import text as X
from phonolake.operators import dataset as D
from phonolake.operators import evaluate as E
from phonolake.operators import segments as G
from phonolake.operators import signal as S
from phonolake.operators import transforms as P
from phonolake.plans import views as V
from phonolake.plans.q_segments import _EQ, _SHOULDER, EVT, RUNS, _events
from phonolake.plans.q_transcripts import tok
from phonolake.plans.q_transforms import r6
from phonolake.plans.registry import query
from phonolake.session import stage

_ID = r"regexp_replace(lower(split_part(artist,' - ',1)),'\s+(feat\.?|ft\.?|featuring)\s+[\s\S]*$','')"


def _raw(spark, d):
    """Annotation files as raw lines: 'mm:ss mm:ss kind text', the text being the whole document on one line."""
    clock = lambda s: F.concat(X.two(F.floor(s / 60).cast("long")), F.lit(":"), X.two((s % 60).cast("long")))
    flat = F.regexp_replace("text", r"\s+", " ")
    return V.annotations(spark, d).select(
        "song", F.lit(1).alias("annotation_line"), F.concat_ws(" ", clock(F.col("start")), clock(F.col("end")), "kind", flat).alias("raw"))


# DuckDB's \s is ASCII; so is Java's without (?U).
_KEPT = r"""rw AS (SELECT song, "start", "end", kind, regexp_replace(text,'\s+',' ','g') AS t FROM v_ann),
rz AS (SELECT *, CASE WHEN regexp_matches(t,'[*?]') THEN 'uncertain_excluded' WHEN NOT ("end"-"start" BETWEEN 1 AND 30) THEN 'duration_excluded' WHEN kind NOT IN ('a','b','d') THEN 'overlapping_different_words_excluded'
 WHEN kind<>'d' AND trim(t)='' THEN 'empty_positive_excluded' END AS reason FROM rw),
kp AS (SELECT z.song, artist, z."start", z."end", z.kind, CASE WHEN z.kind='d' THEN '' ELSE trim(t) END AS text FROM rz z JOIN v_ann USING (song) WHERE reason IS NULL)"""


def _kept(spark, d):
    kept, _ = D.parse_annotations(_raw(spark, d))
    return kept.join(V.annotations(spark, d).select("song", "artist"), "song").drop("annotation_line")


@query("src05_annotations", f"WITH {_KEPT} SELECT song, \"start\", \"end\", kind, md5(text) AS text_md5 FROM kp")
def _(spark, d):
    return _kept(spark, d).select("song", "start", "end", "kind", F.md5("text").alias("text_md5"))


@query("src05_annotation_counts", f"WITH {_KEPT} SELECT coalesce(reason, CASE WHEN kind='d' THEN 'negative' ELSE 'positive' END) AS reason, CAST(count(*) AS BIGINT) AS rows FROM rz GROUP BY 1")
def _(spark, d):
    return D.parse_annotations(_raw(spark, d))[1]


_SPLIT = _KEPT + f""", ia AS (SELECT DISTINCT {_ID} AS identity FROM kp), ir AS (SELECT identity, row_number() OVER (ORDER BY md5('42|'||identity), identity)-1 AS k, count(*) OVER () AS n FROM ia),
sp AS (SELECT kp.*, CASE WHEN k<greatest(1,round_even(n*0.15,0)) THEN 'validation' ELSE 'train' END AS split FROM kp JOIN ir ON ir.identity={_ID}),
ex AS (SELECT *, unnest(CASE WHEN text='' THEN ['mixture'] ELSE ['vocals','mixture'] END) AS source FROM sp),
ng AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY md5('43|'||song||'|'||"start"||'|'||source), song, "start", source)-1 AS k FROM ex WHERE text=''),
qa AS (SELECT split, greatest(1,count(*)//9) AS q FROM ex WHERE text<>'' GROUP BY 1),
mf AS (SELECT song, artist, "start", "end", kind, text, split, source FROM ex WHERE text<>'' UNION ALL SELECT song, artist, "start", "end", kind, text, split, source FROM ng LEFT JOIN qa USING (split) WHERE k<coalesce(q,1))"""


def _split(spark, d):
    """Parsed and assigned once: the later steps each read the table more than once."""
    return stage(D.split_artists(stage(_kept(spark, d), "annotations")), "split")


def _manifest(spark, d):
    return D.negatives_sampled(D.expand_sources(_split(spark, d)))


@query("ds01_artist_split", f"WITH {_SPLIT} SELECT song, artist, split FROM sp")
def _(spark, d):
    return _split(spark, d).select("song", "artist", "split")


@query("ds02_expand_sources", f"WITH {_SPLIT} SELECT song, split, source, kind FROM ex")
def _(spark, d):
    return D.expand_sources(_split(spark, d)).select("song", "split", "source", "kind")


@query("top04_sampled_negatives", f"WITH {_SPLIT} SELECT song, split, source, kind FROM mf")
def _(spark, d):
    return _manifest(spark, d).select("song", "split", "source", "kind")


@query("snk02_manifest_summary", f"""WITH {_SPLIT} SELECT split, CAST(count(*) AS BIGINT) AS examples, round(sum("end"-"start")/60,2) AS minutes, CAST(count(CASE WHEN text='' THEN 1 END) AS BIGINT) AS negatives FROM mf GROUP BY split""")
def _(spark, d):
    return D.manifest_summary(_manifest(spark, d))


@query("ds03_manifest_violations", f"""WITH a AS (SELECT song, artist, "start", "end", kind, text, CASE WHEN song%6=0 THEN 'validation' ELSE 'train' END AS split FROM v_ann),
v AS (SELECT unnest(list_filter([CASE WHEN NOT ("end"-"start" BETWEEN 1 AND 30) THEN 'segment duration' END, CASE WHEN kind NOT IN ('a','b','d') THEN 'annotation kind' END,
 CASE WHEN regexp_matches(text,'[*?]') THEN 'uncertain text' END, CASE WHEN (trim(text)<>'')=(kind='d') THEN 'text and kind disagree' END], lambda x: x IS NOT NULL)) AS rule FROM a),
l AS (SELECT {_ID} AS i FROM a GROUP BY 1 HAVING count(DISTINCT split)=2)
SELECT rule, CAST(count(*) AS BIGINT) AS rows FROM v GROUP BY 1 UNION ALL SELECT 'artist leakage', CAST(count(*) AS BIGINT) FROM l HAVING count(*)>0""")
def _(spark, d):
    rows = V.annotations(spark, d).withColumn("split", F.when(F.col("song") % 6 == 0, "validation").otherwise("train"))
    return D.manifest_violations(rows)


@query("join06_seen_artists", f"""WITH s AS (SELECT DISTINCT {_ID} AS identity FROM v_ann WHERE kind='b') SELECT song, {_ID} AS identity FROM v_ann WHERE {_ID} NOT IN (SELECT identity FROM s)""")
def _(spark, d):
    a = V.annotations(spark, d)
    return D.seen_artist_exclusion(a, a.filter("kind = 'b'")).select("song", "identity")


@query("join07_reference_lookup", """SELECT 'found' AS part, CAST(count(*) AS BIGINT) AS rows FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'missing', CAST(count(*) AS BIGINT) FROM documents ANTI JOIN labels USING (doc_id)
 UNION ALL SELECT 'duplicated', CAST(count(*) AS BIGINT) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*)>1)""")
def _(spark, d):
    songs = V.table(spark, d, "documents").select(F.col("doc_id").alias("song"))
    refs = V.table(spark, d, "labels").select(F.col("doc_id").alias("song"), F.col("quality").alias("reference"))
    parts = D.reference_lookup(songs, refs)
    out = None
    for name, part in zip(("found", "missing", "duplicated"), parts):
        one = part.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


@query("set07_missing_references", "SELECT doc_id AS song FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def _(spark, d):
    return V.table(spark, d, "documents").select(F.col("doc_id").alias("song")).exceptAll(
        V.table(spark, d, "labels").select(F.col("doc_id").alias("song")))


@query("set08_capped_excerpts", """WITH p AS (SELECT conv_id, turn, text, unnest(['base','tuned']) AS model FROM conversations),
c AS (SELECT DISTINCT conv_id, turn FROM p WHERE CASE model WHEN 'base' THEN length(text)>600 ELSE length(text)>500 AND turn%2=0 END)
SELECT p.conv_id, p.turn, model, CASE WHEN c.conv_id IS NOT NULL THEN length(text) ELSE 0 END AS rescored FROM p LEFT JOIN c ON c.conv_id=p.conv_id AND c.turn=p.turn""")
def _(spark, d):
    p = V.table(spark, d, "conversations").withColumn("model", F.explode(F.array(F.lit("base"), F.lit("tuned"))))
    long_base = p.filter((F.col("model") == "base") & (F.length("text") > 600)).select("conv_id", "turn")
    long_tuned = p.filter((F.col("model") == "tuned") & (F.length("text") > 500) & (F.col("turn") % 2 == 0)).select("conv_id", "turn")
    capped = long_base.union(long_tuned).distinct()
    again = p.join(capped, ["conv_id", "turn"], "left_semi").select("conv_id", "turn", "model", F.length("text").cast("long").alias("new"))
    return p.join(again, ["conv_id", "turn", "model"], "left").select("conv_id", "turn", "model", F.coalesce("new", F.lit(0)).alias("rescored"))


@query("top05_balanced_subset", f"""WITH {_SPLIT}, x AS (SELECT artist, song, "start", source, row_number() OVER (PARTITION BY artist ORDER BY md5('44|'||"start"||'|'||song||source), "start", song||source)-1 AS k FROM mf),
n AS (SELECT count(DISTINCT artist) AS s FROM mf) SELECT artist, song, source, CAST(k AS BIGINT) AS rank FROM x, n WHERE k<greatest(1,200//greatest(1,s)) ORDER BY artist, k LIMIT 200""")
def _(spark, d):
    rows = stage(_manifest(spark, d), "manifest").select(F.col("artist").alias("song"), "start", F.concat(F.col("song").cast("string"), "source").alias("source"), F.col("song").alias("number"), F.col("source").alias("kind_of"))
    return D.balanced_subset(rows, 200).select(F.col("song").alias("artist"), F.col("number").alias("song"), F.col("kind_of").alias("source"), "rank")


_FRESH = f"""sn AS (SELECT DISTINCT {_ID} AS identity FROM v_ann WHERE kind='b'), fr AS (SELECT song, {_ID} AS identity, md5('7|'||song) AS h FROM v_ann WHERE {_ID} NOT IN (SELECT identity FROM sn)),
f1 AS (SELECT identity, song, h, row_number() OVER (PARTITION BY identity ORDER BY h) AS k FROM fr), chosen AS (SELECT identity, song FROM f1 WHERE k=1 ORDER BY h LIMIT 5)"""


@query("top06_fresh_artists", f"WITH {_FRESH} SELECT identity, song FROM chosen")
def _(spark, d):
    a = V.annotations(spark, d)
    return D.fresh_artist_songs(a, a.filter("kind = 'b'"), 5)


@query("top06_artist_shortage", f"""SELECT CAST(2000 AS BIGINT) AS wanted, CAST(count(DISTINCT {_ID}) AS BIGINT) AS available, CAST(greatest(0, 2000-count(DISTINCT {_ID})) AS BIGINT) AS short
 FROM v_ann WHERE {_ID} NOT IN (SELECT {_ID} FROM v_ann WHERE kind='b')""")
def _(spark, d):
    a = V.annotations(spark, d)
    return D.fresh_artist_shortage(a, a.filter("kind = 'b'"), 2000)


@query("ds04_acceptance_set", f"""WITH {_FRESH}, t AS (SELECT artist, song, "start", "end", {_ID} AS identity FROM v_ann a WHERE NOT EXISTS (SELECT 1 FROM v_ann b WHERE b.artist=a.artist AND b.song<>a.song AND least(a."end",b."end")-greatest(a."start",b."start")>0.05))
SELECT t.song, t."start", t."end", CASE WHEN c.song IS NULL THEN 'context' ELSE 'selected' END AS role FROM t JOIN (SELECT DISTINCT identity FROM chosen) i USING (identity) LEFT JOIN chosen c ON c.song=t.song""")
def _(spark, d):
    a = V.annotations(spark, d)
    chosen = D.fresh_artist_songs(a, a.filter("kind = 'b'"), 5)
    trusted = D.trusted_intervals(a.select("artist", "song", "start", "end"), ["artist"], ["song"])
    named = trusted.withColumn("identity", X.artist_identity(F.col("artist"))).join(chosen.select("identity"), "identity", "left_semi")
    return named.join(chosen.select("song", F.lit(True).alias("_s")), "song", "left").select(
        "song", "start", "end", F.when(F.col("_s"), "selected").otherwise("context").alias("role"))


@query("ds04_selection_changes", """WITH a AS (SELECT doc_id AS song FROM documents WHERE n_chars>500), b AS (SELECT doc_id AS song FROM labels WHERE quality=1)
SELECT song, 'added' AS change FROM (SELECT song FROM a EXCEPT ALL SELECT song FROM b) UNION ALL SELECT song, 'removed' FROM (SELECT song FROM b EXCEPT ALL SELECT song FROM a)""")
def _(spark, d):
    chosen = V.table(spark, d, "documents").filter("n_chars > 500").select(F.col("doc_id").alias("song"))
    stored = V.table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("song"))
    return D.selection_changes(chosen, stored)


@query("top07_stratified_speakers", """WITH c AS (SELECT c_mktsegment AS g, c_nationkey AS sp, o_orderkey AS id, (o_orderkey*7%300)/10.0::DOUBLE AS dur FROM orders JOIN customer ON o_custkey=c_custkey),
s AS (SELECT g, sp, row_number() OVER (PARTITION BY g ORDER BY md5('7|'||sp), sp) AS k FROM (SELECT DISTINCT g, sp FROM c)),
e AS (SELECT c.*, row_number() OVER (PARTITION BY c.g, c.sp ORDER BY md5('7|'||id), id) AS k FROM c JOIN s ON s.g=c.g AND s.sp=c.sp AND s.k<=4 WHERE dur BETWEEN 2 AND 25)
SELECT g AS "group", sp AS speaker, id AS clip_id, dur AS duration FROM e WHERE k<=3""")
def _(spark, d):
    clips = V.table(spark, d, "orders").join(V.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_mktsegment").alias("group"), F.col("c_nationkey").alias("speaker"), F.col("o_orderkey").alias("clip_id"),
        ((F.col("o_orderkey") * 7 % 300) / 10.0).alias("duration"))
    return D.stratified_speakers(clips)


@query("top09_worst_cells", "SELECT corpus, recording, severity, planted, found, round(gain,6)+0.0::DOUBLE AS gain FROM v_cells ORDER BY gain, corpus, recording, severity, planted, found LIMIT 50")
def _(spark, d):
    return E.worst_cells(V.cells(spark, d), 50).withColumn("gain", r6("gain"))


@query("agg29_scorecard", """SELECT coalesce(corpus,'ALL') AS corpus, coalesce(severity,-1) AS severity, CAST(count(*) AS BIGINT) AS cells, round(avg(gain),6)+0.0::DOUBLE AS mean_gain, round(min(gain),6)+0.0::DOUBLE AS worst_gain,
 CAST(count(CASE WHEN gain<0 THEN 1 END) AS BIGINT) AS below_nothing, round(avg(CASE WHEN planted>0 THEN least(1,found/planted) END),5) AS recall FROM v_cells GROUP BY GROUPING SETS ((corpus),(severity),())""")
def _(spark, d):
    return E.scorecard(V.cells(spark, d)).withColumns({"mean_gain": r6("mean_gain"), "worst_gain": r6("worst_gain"), "recall": r6("recall", 5)})


@query("agg30_false_event_rates", "WITH r AS (SELECT corpus, recording, sum(found)/60 AS per_second FROM v_cells GROUP BY 1,2) SELECT corpus, round(median(per_second),6) AS median_rate, round(max(per_second),6) AS max_rate FROM r GROUP BY corpus")
def _(spark, d):
    rates = V.cells(spark, d).groupBy("corpus", "recording").agg((F.sum("found") / 60).alias("per_second"))
    return E.false_event_rates(rates).select("corpus", r6("median_rate").alias("median_rate"), r6("max_rate").alias("max_rate"))


@query("agg31_population_profile", f"""WITH {RUNS}, k AS (SELECT rec_id, ch, 20*log10(max(abs(v))/sqrt(avg(v*v))) AS crest FROM v_stereo GROUP BY 1,2), p AS (SELECT rec_id, ch, count(*) AS c, avg(e-s) AS pl FROM runs GROUP BY 1,2),
x AS (SELECT CASE k.ch WHEN 0 THEN 'left' ELSE 'right' END AS corpus, crest, coalesce(c,0) AS c, coalesce(pl,0) AS pl FROM k LEFT JOIN p ON p.rec_id=k.rec_id AND p.ch=k.ch)
SELECT corpus, round(min(crest),6) AS crest_min, round(median(crest),6) AS crest_median, round(max(crest),6) AS crest_max, round(avg(CASE WHEN c>0 THEN 1.0::DOUBLE ELSE 0 END),6) AS clipped_share, round(avg(pl),6) AS mean_plateau FROM x GROUP BY corpus""")
def _(spark, d):
    s = V.stereo(spark, d)
    crest = s.groupBy("rec_id", "ch").agg((20 * F.log10(F.max(F.abs("v")) / F.sqrt(F.avg(F.col("v") * F.col("v"))))).alias("crest_db"))
    runs = G.clipped_runs(s, 0.9).groupBy("rec_id", "ch").agg(F.count(F.lit(1)).alias("clipped"), F.avg(F.col("end") - F.col("start")).alias("plateau"))
    recs = crest.join(runs, ["rec_id", "ch"], "left").select(
        F.when(F.col("ch") == 0, "left").otherwise("right").alias("corpus"), "crest_db", F.coalesce("clipped", F.lit(0)).alias("clipped"),
        F.coalesce("plateau", F.lit(0.0)).alias("plateau"))
    out = E.population_profile(recs)
    return out.withColumns({c: r6(c) for c in out.columns if c != "corpus"})


@query("agg27_programme_peak", "WITH k AS (SELECT rec_id, abs(v) AS a, row_number() OVER (PARTITION BY rec_id ORDER BY abs(v))-1 AS k, count(*) OVER (PARTITION BY rec_id) AS n FROM v_sig) SELECT rec_id, round(a,6) AS peak FROM k WHERE k=floor(n*0.9995)")
def _(spark, d):
    return E.programme_peak(V.sig(spark, d), True).withColumn("peak", r6("peak"))


_PLANT = """pk AS (SELECT rec_id, max(abs(v)) AS p FROM v_sig GROUP BY 1), pl AS (SELECT rec_id, sev, ch, n, v/(p*sev) AS clean, greatest(-1,least(1,v/(p*sev))) AS v, abs(v)>p*sev AS damaged
 FROM (SELECT v_sig.*, p, unnest([0.25::DOUBLE,0.5::DOUBLE,0.75::DOUBLE]) AS sev FROM v_sig JOIN pk USING (rec_id)))"""


def _cells(spark, d):
    s = V.sig(spark, d)
    return E.plant_clipping(s, E.programme_peak(s, False), [0.25, 0.5, 0.75])


@query("ds05_plant_clipping", f"WITH {_PLANT} SELECT rec_id, sev AS severity, ch, n, round(clean,6)+0.0::DOUBLE AS clean, round(v,6)+0.0::DOUBLE AS v, damaged FROM pl")
def _(spark, d):
    return _cells(spark, d).withColumns({"clean": r6("clean"), "v": r6("v")})


@query("ds05_plant_gaps", "SELECT rec_id, ch, n, round(CASE WHEN n%400 BETWEEN 50 AND 79 THEN 0 ELSE v END,6)+0.0::DOUBLE AS v, (n%400 BETWEEN 50 AND 79) AS damaged FROM v_sig")
def _(spark, d):
    s = V.sig(spark, d)
    starts = s.select("rec_id", (F.floor(F.col("n") / 400) * 400 + 50).alias("start")).distinct()
    return E.plant_gaps(s, starts.withColumn("end", F.col("start") + 30)).withColumn("v", r6("v"))


@query("agg28_damaged_snr", f"WITH {_PLANT} SELECT rec_id, sev AS severity, CAST(count(CASE WHEN damaged THEN 1 END) AS BIGINT) AS damaged, round(10*log10(sum(CASE WHEN damaged THEN clean*clean END)/greatest(sum(CASE WHEN damaged THEN (clean-v)*(clean-v) END),1e-30)),5)+0.0::DOUBLE AS snr_db FROM pl GROUP BY 1,2")
def _(spark, d):
    return E.damaged_snr(_cells(spark, d), ["rec_id", "severity"]).withColumn("snr_db", r6("snr_db", 5))


@query("agg28_segmental_snr", f"""WITH {_PLANT}, g AS (SELECT rec_id, sev, n//64 AS k, sum(clean*clean) AS s, sum((clean-v)*(clean-v)) AS e, count(*) AS c FROM pl GROUP BY 1,2,3)
SELECT rec_id, sev AS severity, round(avg(greatest(-10,least(35,10*log10(s/greatest(e,1e-30))))),5)+0.0::DOUBLE AS segmental_db FROM g WHERE s>0 AND c=64 GROUP BY 1,2""")
def _(spark, d):
    return E.segmental_snr(_cells(spark, d), ["rec_id", "severity"], 64).withColumn("segmental_db", r6("segmental_db", 5))


@query("ds07_evaluation_harness", f"""WITH {_PLANT}, m AS (SELECT *, unnest(['stretch','mute']) AS method FROM pl), f AS (SELECT *, CASE WHEN NOT damaged THEN v WHEN method='stretch' THEN v*1.25 ELSE 0 END AS w FROM m),
z AS (SELECT rec_id, sev, method, count(CASE WHEN damaged THEN 1 END) AS damaged, 10*log10(sum(CASE WHEN damaged THEN clean*clean END)/greatest(sum(CASE WHEN damaged THEN (clean-v)*(clean-v) END),1e-30)) AS raw,
 10*log10(sum(CASE WHEN damaged THEN clean*clean END)/greatest(sum(CASE WHEN damaged THEN (clean-w)*(clean-w) END),1e-30)) AS sc FROM f GROUP BY 1,2,3)
SELECT rec_id, sev AS severity, method, CAST(damaged AS BIGINT) AS damaged, round(raw,5)+0.0::DOUBLE AS raw_db, round(sc,5)+0.0::DOUBLE AS score_db, round(sc-raw,5)+0.0::DOUBLE AS gain FROM z""")
def _(spark, d):
    methods = {
        "stretch": lambda c: c.withColumn("v", F.when(F.col("damaged"), F.col("v") * 1.25).otherwise(F.col("v"))),
        "mute": lambda c: c.withColumn("v", F.when(F.col("damaged"), 0.0).otherwise(F.col("v"))),
    }
    return E.evaluate(_cells(spark, d), methods).withColumns({c: r6(c, 5) for c in ("raw_db", "score_db", "gain")})


@query("ds06_reference_screen", f"""WITH {RUNS}, f AS (SELECT rec_id, max(n)+1 AS frames, count(*) AS c FROM v_stereo GROUP BY 1), k AS (SELECT rec_id, sum(e-s) AS c FROM runs GROUP BY 1)
SELECT f.rec_id, CASE WHEN frames<5000 THEN 'too short' WHEN coalesce(k.c,0)/f.c::DOUBLE>0.007 THEN 'already clipped' END AS reason, round(coalesce(k.c,0)/f.c::DOUBLE,6) AS clipped_share FROM f LEFT JOIN k ON k.rec_id=f.rec_id""")
def _(spark, d):
    s = V.stereo(spark, d)
    return E.screen_references(s, G.clipped_runs(s, 0.9), 5000, 0.007).withColumn("clipped_share", r6("clipped_share"))


@query("agg26_declip_routing", f"""WITH {RUNS}, l AS (SELECT rec_id, ch, max(n)+1 AS f FROM v_stereo GROUP BY 1,2), k AS (SELECT rec_id, ch, sum(e-s) AS c, avg(e-s) AS m FROM runs GROUP BY 1,2),
x AS (SELECT l.rec_id, l.ch, coalesce(c,0)/f::DOUBLE AS fr, coalesce(m,0) AS mr FROM l LEFT JOIN k ON k.rec_id=l.rec_id AND k.ch=l.ch)
SELECT rec_id, ch, round(fr,6) AS fraction, round(mr,6) AS mean_run, CASE WHEN fr<=0 THEN 'none' WHEN fr<least(1,greatest(0,-0.50+1.10*ln(greatest(1.5,mr))-0.22*ln(greatest(1.5,mr))*ln(greatest(1.5,mr)))) THEN 'sparse' ELSE 'peak' END AS method FROM x""")
def _(spark, d):
    s = V.stereo(spark, d)
    lengths = s.groupBy("rec_id", "ch").agg((F.max("n") + 1).alias("frames"))
    return E.declip_routing(G.clipped_runs(s, 0.9), lengths).withColumns({"fraction": r6("fraction"), "mean_run": r6("mean_run")})


@query("fun22_tolerated_fraction", "SELECT DISTINCT l_quantity AS run, round(least(1,greatest(0,-0.50+1.10*ln(greatest(1.5,l_quantity))-0.22*ln(greatest(1.5,l_quantity))*ln(greatest(1.5,l_quantity)))),6) AS tolerated FROM lineitem")
def _(spark, d):
    runs = V.table(spark, d, "lineitem").select(F.col("l_quantity").alias("run")).distinct()
    return runs.withColumn("tolerated", r6(E.tolerated_fraction(F.col("run"))))


@query("agg24_event_rates", f"""WITH {EVT}, f AS (SELECT rec_id, max(n)+1 AS frames FROM v_stereo GROUP BY 1)
SELECT evs.rec_id, kind, CAST(count(*) AS BIGINT) AS candidates, CAST(count(CASE WHEN c>=0.65 THEN 1 END) AS BIGINT) AS accepted, round(avg(c),6) AS mean_confidence, round(count(CASE WHEN c>=0.65 THEN 1 END)/(max(frames)/1000.0::DOUBLE/60),5) AS per_minute FROM evs JOIN f ON f.rec_id=evs.rec_id GROUP BY 1,2""")
def _(spark, d):
    clips, clicks = _events(spark, d)
    out = E.event_rates(clips.unionByName(clicks), P.frames_per_recording(V.stereo(spark, d)), V.LR_RATE)
    return out.withColumns({"mean_confidence": r6("mean_confidence"), "per_minute": r6("per_minute", 5)})


@query("agg24_crackle_decision", """WITH e AS (SELECT rec_id, count(CASE WHEN abs(v)>=0.98 THEN 1 END) AS ev, count(CASE WHEN abs(v)>=0.9 AND abs(v)<0.98 THEN 1 END) AS rj, max(n)+1 AS f FROM v_sig GROUP BY 1)
SELECT rec_id, CAST(ev+rj AS BIGINT) AS candidates, round(ev*100/f::DOUBLE,6) AS density, round(CASE WHEN ev+rj>0 THEN ev/(ev+rj)::DOUBLE ELSE 0 END,6) AS acceptance, (ev>=3 AND ev*100/f::DOUBLE>=0.25 AND ev/greatest(1,ev+rj)::DOUBLE>=0.2) AS decrackle FROM e""")
def _(spark, d):
    a = F.abs("v")
    counts = V.sig(spark, d).groupBy("rec_id").agg(
        F.count_if(a >= 0.98).alias("events"), F.count_if((a >= 0.9) & (a < 0.98)).alias("rejected"), (F.max("n") + 1).alias("frames"))
    return E.crackle_decision(counts, V.SIG_RATE).withColumns({"density": r6("density"), "acceptance": r6("acceptance")})


@query("agg25_treatment", f"""WITH {RUNS}, {_SHOULDER}, c AS (SELECT rec_id, count(*) AS c, avg(abs(v)) AS cf FROM v_stereo WHERE abs(v)>=0.98 GROUP BY 1),
q AS (SELECT rec_id, lev, greatest(lev,lev+greatest(0.001*lev,os)) AS est, least(1,greatest(0,os/(0.12*lev))) AS sv, 0.58+0.16*len+0.14*con+0.12*least(1,greatest(0,8*(lev-0.9)/0.9)) AS cf FROM sc),
p AS (SELECT rec_id, count(*) AS c, avg(sv) AS sv, max(20*log10(greatest(lev,est)/lev)) AS hr FROM q WHERE cf>=0.65 GROUP BY 1),
s AS (SELECT rec_id, max(n)+1 AS f, 10*log10(sum((l-r)*(l-r))/sum((l+r)*(l+r))) AS sm FROM v_lr GROUP BY 1),
x AS (SELECT s.rec_id, c.c AS cc, c.cf, p.c AS pc, sv, hr, f, floor(least(1,greatest(0.2,0.20+0.80/(1+exp(-5*((sm+14)/6-0.55)))))/0.05+0.5)*0.05 AS w FROM s LEFT JOIN c ON c.rec_id=s.rec_id LEFT JOIN p ON p.rec_id=s.rec_id)
SELECT rec_id, cc IS NOT NULL AS repair_clicks, CASE WHEN cc/greatest(1/60.0::DOUBLE,f/1000.0::DOUBLE/60)>120 AND cf<0.68 THEN 6.5::DOUBLE ELSE 7.0::DOUBLE END AS click_sensitivity, CASE WHEN cc IS NULL THEN 0.65::DOUBLE ELSE 1.0::DOUBLE END AS click_strength,
 pc IS NOT NULL AS repair_clips, round(CASE WHEN pc IS NULL THEN 0.65::DOUBLE ELSE floor(least(0.95,greatest(0.60,0.58+sv*0.34))/0.05+0.5)*0.05 END,4) AS declip_strength,
 round(floor(least(12,greatest(1,coalesce(hr,4)+0.5))/0.5+0.5)*0.5,4) AS declip_headroom_db, round(CASE WHEN -20*log10(greatest(w,1e-6))<3 THEN 1.0::DOUBLE ELSE w END,4) AS side_level FROM x""")
def _(spark, d):
    s = V.stereo(spark, d)
    clicks = s.filter(F.abs("v") >= 0.98).select("rec_id", F.abs("v").alias("confidence"))
    clips = G.score_clipped(G.clipped_runs(s, 0.9), s, threshold=0.9)
    l, r = F.col("l"), F.col("r")
    side = V.lr(spark, d).groupBy("rec_id").agg((10 * F.log10(F.sum((l - r) * (l - r)) / F.sum((l + r) * (l + r)))).alias("side_to_mid_db"))
    out = E.treatment(clicks, clips, side, P.frames_per_recording(s), V.LR_RATE)
    return out.withColumns({c: r6(c, 4) for c in ("declip_strength", "declip_headroom_db", "side_level")})


# --- scalar functions ---------------------------------------------------------------------------------------


@query("fun01_tokens", f"SELECT doc_id, CAST(len({tok('text')}) AS BIGINT) AS tokens, md5(array_to_string({tok('text')},' ')) AS md5 FROM documents")
def _(spark, d):
    t = X.tokens(F.col("text"))
    return V.table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("tokens"), F.md5(F.array_join(t, " ")).alias("md5"))


_RK = "array_to_string(" + tok(r"regexp_replace(lower(text),'\balright\b','all right','g')") + ",'')"


@query("fun02_reading_key", f"SELECT conv_id, turn, md5({_RK}) AS reading_key FROM (SELECT conv_id, turn, text||' Alright' AS text FROM conversations)")
def _(spark, d):
    return V.table(spark, d, "conversations").select("conv_id", "turn", F.md5(X.reading_key(F.concat("text", F.lit(" Alright")))).alias("reading_key"))


@query("fun03_artist_identity", f"SELECT song, {_ID} AS identity FROM v_ann")
def _(spark, d):
    return V.annotations(spark, d).select("song", X.artist_identity(F.col("artist")).alias("identity"))


_TOKS = f"""tk AS (SELECT l.rec_id, l.line_no, {tok('l.text')} AS a, {tok('p.text')} AS b FROM v_lines l JOIN (SELECT rec_id, line_no, string_agg(word,' ' ORDER BY i) AS text FROM v_pass2 GROUP BY 1,2) p USING (rec_id, line_no))"""


@query("fun04_contained_in_order", f"""WITH {_TOKS} SELECT rec_id, line_no, list_reduce(list_prepend(0, list_transform(a, lambda x: list_position(b, x)*0+0)), lambda s, x: s)=0 AND
 list_reduce(list_prepend('0', a), lambda s, x: CASE WHEN b[CAST(s AS INT)+1]=x THEN CAST(CAST(s AS INT)+1 AS VARCHAR) ELSE s END)=CAST(len(b) AS VARCHAR) AS contained FROM tk""".replace(
    "list_reduce(list_prepend(0, list_transform(a, lambda x: list_position(b, x)*0+0)), lambda s, x: s)=0 AND\n ", ""))
def _(spark, d):
    from phonolake.plans.q_transcripts import _second

    both = V.lines(spark, d).join(_second(spark, d).withColumnRenamed("text", "shorter"), ["rec_id", "line_no"])
    return both.select("rec_id", "line_no", X.contains_in_order(X.tokens(F.col("shorter")), X.tokens(F.col("text"))).alias("contained"))


@query("fun05_added_words_supported")
def _(spark, d):
    lines = V.lines(spark, d)
    kept = F.array_join(F.transform(F.filter("words", lambda w: w["p"] >= 0.5), lambda w: w["word"]), " ")
    return lines.select("rec_id", "line_no", X.added_words_supported(X.tokens(kept), F.col("words")).alias("supported"))


@query("fun07_text_replacement", """SELECT conv_id, turn, text AS before, replace(text,'the','THE') AS after, CAST((length(text)-length(replace(text,'the','')))//3 AS BIGINT) AS changed FROM conversations WHERE contains(text,'the')""")
def _(spark, d):
    change = X.replace_preview(F.col("text"), "the", "THE", match_case=True, whole_words=False)
    return V.table(spark, d, "conversations").select("conv_id", "turn", change.alias("c")).filter("c.changed > 0").select("conv_id", "turn", "c.*")


@query("fun07_apply_and_undo", """SELECT conv_id, turn, CASE WHEN turn%3=0 THEN text||'!' ELSE replace(text,'the','THE') END AS applied, text AS undone FROM conversations WHERE contains(text,'the') AND turn%3<>0
UNION ALL SELECT conv_id, turn, text||'!', text||'!' FROM conversations WHERE contains(text,'the') AND turn%3=0""")
def _(spark, d):
    # Every third line is changed by someone else between the preview and its use.
    change = X.replace_preview(F.col("text"), "the", "THE", match_case=True, whole_words=False)
    rows = V.table(spark, d, "conversations").select("conv_id", "turn", "text", change.alias("c")).filter("c.changed > 0")
    now = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    applied = X.apply_replacement(now, F.col("c.before"), F.col("c.after"))
    return rows.select("conv_id", "turn", applied.alias("applied"), X.undo_replacement(applied, F.col("c.before"), F.col("c.after")).alias("undone"))


@query("fun07_whole_word_replacement")
def _(spark, d):
    change = X.replace_preview(F.col("text"), "the and", "THE  AND")
    return V.table(spark, d, "conversations").select("conv_id", "turn", change.alias("c")).filter("c.changed > 0").select("conv_id", "turn", "c.changed")


@query("fun08_safe_names", r"""WITH n AS (SELECT page_id, trim(url) AS u FROM pages), c AS (SELECT page_id, u, regexp_replace(regexp_replace(substring(regexp_replace(regexp_replace(u,'[\x00-\x1f"<>|:*?\\/]','_','g'),'[. ]+$',''),1,96),'[. ]+$',''),'^$','Track') AS name FROM n)
SELECT page_id, name, trim(regexp_replace(replace(u,'"',''''),'[\x00-\x1f\x7f]',' ','g')) AS cue FROM c""")
def _(spark, d):
    return V.table(spark, d, "pages").select("page_id", X.safe_file_name(F.col("url")).alias("name"), X.cue_escape(F.trim("url")).alias("cue"))


@query("fun10_isrc", """WITH t AS (SELECT p_partkey, CASE WHEN p_partkey%5=0 THEN 'bad '||p_partkey ELSE 'us-s1z-'||substring(lpad(CAST(p_partkey AS VARCHAR),7,'0'),1,2)||'-'||substring(lpad(CAST(p_partkey AS VARCHAR),7,'0'),3) END AS raw FROM part),
c AS (SELECT *, upper(regexp_replace(raw,'[^A-Za-z0-9]','','g')) AS x FROM t), v AS (SELECT *, CASE WHEN regexp_matches(x,'^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$') THEN x ELSE '' END AS isrc FROM c)
SELECT p_partkey, isrc, CASE WHEN isrc<>'' AND CAST(substring(isrc,8) AS BIGINT)+98500<=99999 THEN substring(isrc,1,7)||lpad(CAST(CAST(substring(isrc,8) AS BIGINT)+98500 AS VARCHAR),5,'0') ELSE '' END AS advanced FROM v""")
def _(spark, d):
    key = F.lpad(F.col("p_partkey").cast("string"), 7, "0")
    raw = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("bad "), F.col("p_partkey").cast("string"))).otherwise(
        F.concat(F.lit("us-s1z-"), F.substring(key, 1, 2), F.lit("-"), F.substring(key, 3, 5)))
    return V.table(spark, d, "part").select("p_partkey", X.isrc(raw).alias("isrc"), X.isrc_advance(raw, F.lit(98500)).alias("advanced"))


@query("fun10_upc", """WITH t AS (SELECT p_partkey, lpad(CAST(p_partkey*7919+100000000000 AS VARCHAR),12,'0')||CAST(p_partkey%10 AS VARCHAR) AS s FROM part),
w AS (SELECT *, list_sum(list_transform(range(1,13), lambda k: CAST(s[k:k] AS INT)*CASE WHEN k%2=1 THEN 1 ELSE 3 END)) AS x FROM t)
SELECT p_partkey, CASE WHEN (10-x%10)%10=CAST(s[13:13] AS INT) THEN s ELSE '' END AS upc FROM w""")
def _(spark, d):
    raw = F.concat(F.lpad((F.col("p_partkey") * 7919 + 100000000000).cast("string"), 12, "0"), (F.col("p_partkey") % 10).cast("string"))
    return V.table(spark, d, "part").select("p_partkey", X.upc(raw).alias("upc"))


@query("fun11_timecodes", """WITH t AS (SELECT o_orderkey, o_orderkey*37%400000 AS f, o_totalprice/50 AS s FROM orders)
SELECT o_orderkey, printf('%02d:%02d:%02d', f//4500, f//75%60, f%75) AS cd, printf('%d:%02d:%02d.%03d', ms//3600000, ms//60000%60, ms//1000%60, ms%1000) AS clock, round(CAST(ms//60000 AS DOUBLE)*60+(ms//1000%60),6) AS seconds FROM (SELECT *, CAST(floor(s*1000+0.5) AS BIGINT) AS ms FROM t)""")
def _(spark, d):
    t = V.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 37 % 400000).alias("f"), (F.col("o_totalprice") / 50).alias("s"))
    ms = X.milliseconds(F.col("s"))
    text = F.concat(F.floor(ms / 60000).cast("string"), F.lit(":"), X.two(F.floor(ms / 1000) % 60))
    return t.select("o_orderkey", X.cd_time(F.col("f")).alias("cd"), X.clock_time(F.col("s")).alias("clock"), r6(X.clock_seconds(text)).alias("seconds"))


@query("fun12_sectors", """WITH t AS (SELECT o_orderkey, o_orderkey*9973%20000000 AS n FROM orders), x AS (SELECT *, n*44100.0::DOUBLE/48000/588.0::DOUBLE AS s FROM t)
SELECT o_orderkey, CAST(CASE WHEN n<=0 THEN 0 ELSE floor(s+0.5) END AS BIGINT) AS start_sector, CAST(CASE WHEN n<=0 THEN 0 WHEN n>=10000000 THEN ceil(s) ELSE floor(s+0.5) END AS BIGINT) AS end_sector FROM x""")
def _(spark, d):
    n = F.col("o_orderkey") * 9973 % 20000000
    limit = F.lit(10000000)
    return V.table(spark, d, "orders").select("o_orderkey", X.sector_of(n, 48000, limit).alias("start_sector"), X.sector_of(n, 48000, limit, True).alias("end_sector"))


@query("fun13_level_helpers", """SELECT l_orderkey, l_linenumber, round(20*log10(l_quantity/50),6)+0.0::DOUBLE AS db, round(least(1,greatest(0,(l_quantity-10)/30)),6) AS ramp, round(round_even(l_quantity/4,0)*4,6) AS quantized,
 floor((20*log10(l_quantity/50)+1e-6)*2)/2+0.0::DOUBLE AS half_db FROM lineitem""")
def _(spark, d):
    q = F.col("l_quantity")
    return V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(L.amplitude_db(q / 50)).alias("db"), r6(L.ramp(q, 10.0, 40.0)).alias("ramp"),
        r6(L.quantize(q, 4.0)).alias("quantized"), (L.floor_half_db(L.amplitude_db(q / 50)) + F.lit(0.0)).alias("half_db"))


@query("fun14_partner_gain", """WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity/50 AS a, l_discount*10 AS r FROM lineitem) SELECT l_orderkey, l_linenumber, round(least(1,greatest(0,-r*a+sqrt(greatest(0,1-a*a*(1-r*r))))),6)+0.0::DOUBLE AS partner FROM t""")
def _(spark, d):
    return V.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", r6(L.partner_gain(F.col("l_quantity") / 50, F.col("l_discount") * 10)).alias("partner"))


@query("fun23_note_names", """WITH t AS (SELECT o_orderkey, o_totalprice/100+20 AS hz FROM orders), m AS (SELECT *, 69+12*log2(hz/440) AS midi FROM t), k AS (SELECT *, CAST(round_even(midi,0) AS INT) AS k FROM m)
SELECT o_orderkey, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][k%12+1]||CAST(k//12-1 AS VARCHAR) AS note, CAST(round_even((midi-k)*100,0) AS INT) AS cents FROM k""")
def _(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", X.note_name(F.col("o_totalprice") / 100 + 20).alias("x")).select("o_orderkey", "x.note", "x.cents")


@query("fun24_row_fingerprint", """SELECT doc_id, sha256('{"doc_id":'||doc_id||',"lang":"'||lang||'","n_chars":'||n_chars||',"source":"'||source||'"}') AS fingerprint FROM documents""")
def _(spark, d):
    cols = {c: F.col(c) for c in ("source", "lang", "doc_id", "n_chars")}
    return V.table(spark, d, "documents").select("doc_id", X.fingerprint(cols).alias("fingerprint"))


@query("ds08_cache_validity", """WITH a AS (SELECT doc_id, sha256('{"doc_id":'||doc_id||',"n_chars":'||n_chars||'}') AS f FROM documents), b AS (SELECT doc_id, sha256('{"doc_id":'||doc_id||',"n_chars":'||(n_chars+CASE WHEN lang='de' THEN 1 ELSE 0 END)||'}') AS f FROM documents)
SELECT doc_id, CASE WHEN a.f=b.f THEN 'valid' ELSE 'stale' END AS state FROM a JOIN b USING (doc_id)""")
def _(spark, d):
    docs = V.table(spark, d, "documents")
    now = docs.select("doc_id", X.fingerprint({"doc_id": F.col("doc_id"), "n_chars": F.col("n_chars")}).alias("now"))
    edited = F.col("n_chars") + F.when(F.col("lang") == "de", 1).otherwise(0)
    stored = docs.select("doc_id", X.fingerprint({"doc_id": F.col("doc_id"), "n_chars": edited}).alias("stored"))
    return now.join(stored, "doc_id").select("doc_id", F.when(F.col("now") == F.col("stored"), "valid").otherwise("stale").alias("state"))


@query("fun25_sample_ranges", """WITH t AS (SELECT song, round_even("start"*16000,0) AS a, round_even("end"*16000,0) AS b, 300*16000 AS f FROM v_ann) SELECT song, CAST(a AS BIGINT) AS "from", CAST(least(b,f) AS BIGINT) AS "to", (a>=0 AND a<f AND b>a AND b<=f+1600) AS ok FROM t""")
def _(spark, d):
    return V.annotations(spark, d).select("song", X.sample_range(F.col("start"), F.col("end"), 16000, F.lit(300 * 16000)).alias("r")).select("song", "r.*")


@query("fun26_stable_hash", """SELECT page_id, CAST(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), flatten(list_transform(string_split(url,''), lambda c: [CAST(unicode(c)%256 AS BIGINT), CAST(unicode(c)//256 AS BIGINT)]))),
 lambda h, x: (xor(h,x)*16777619)&4294967295)&2147483647 AS BIGINT) AS hash FROM pages""")
def _(spark, d):
    return V.table(spark, d, "pages").select("page_id", X.fnv1a(F.col("url")).alias("hash"))

"""Queries for segmentation and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolake.operators import segments as G
from phonolake.operators import signal as S
from phonolake.operators import transforms as P
from phonolake.plans import views as V
from phonolake.plans.q_transforms import r6
from phonolake.plans.registry import query
from phonolake.session import stage

SIL = """bp AS (SELECT rec_id, n//256 AS block, max(abs(v)) AS pk FROM v_stereo GROUP BY 1,2), fr AS (SELECT rec_id, max(n)+1 AS frames FROM v_stereo GROUP BY 1),
sq AS (SELECT rec_id, block, block-row_number() OVER (PARTITION BY rec_id ORDER BY block) AS g FROM bp WHERE pk<pow(10.0::DOUBLE,-40.0::DOUBLE/20)),
sil AS (SELECT rec_id, min(block)*256 AS s, least((max(block)+1)*256, max(frames)) AS e FROM sq JOIN fr USING (rec_id) GROUP BY rec_id, g HAVING least((max(block)+1)*256, max(frames))-min(block)*256>=500)"""


def _silences(spark, d, samples=None):
    samples = samples or V.stereo(spark, d)
    frames = P.frames_per_recording(samples)
    return G.detect_silences(S.block_peaks(samples), frames, "peak", V.LR_RATE, 500.0, [-40.0]), frames


@query("win05_silences", f"WITH {SIL} SELECT rec_id, -40.0::DOUBLE AS threshold_db, s AS \"start\", e AS \"end\" FROM sil")
def _(spark, d):
    return _silences(spark, d)[0]


@query("join12_threshold_grid", """WITH bp AS (SELECT rec_id, n//256 AS block, max(abs(v)) AS pk FROM v_stereo GROUP BY 1,2), g AS (SELECT CAST(unnest(range(-70,-24)) AS DOUBLE) AS threshold_db)
SELECT rec_id, threshold_db, CAST(count(*) AS BIGINT) AS quiet_blocks FROM bp JOIN g ON pk<pow(10.0::DOUBLE,threshold_db/20) GROUP BY 1,2""")
def _(spark, d):
    samples = V.stereo(spark, d)
    grid = F.transform(F.sequence(F.lit(-70), F.lit(-25)), lambda x: x.cast("double"))
    quiet = F.filter(grid, lambda db: F.col("peak") < F.pow(F.lit(10.0), db / 20))
    return S.block_peaks(samples).select("rec_id", F.explode(quiet).alias("threshold_db")).groupBy(
        "rec_id", "threshold_db").agg(F.count(F.lit(1)).alias("quiet_blocks"))


@query("set09_split_by_silence", f"""WITH {SIL}, o AS (SELECT rec_id, s, e, lag(e) OVER (PARTITION BY rec_id ORDER BY s) AS pe FROM sil),
r AS (SELECT rec_id, coalesce(pe,0) AS a, s AS b FROM o UNION ALL SELECT fr.rec_id, coalesce(m,0), frames FROM fr LEFT JOIN (SELECT rec_id, max(e) AS m FROM sil GROUP BY 1) USING (rec_id))
SELECT rec_id, CAST(a AS BIGINT) AS "start", CAST(b AS BIGINT) AS "end" FROM r WHERE b-a>100""")
def _(spark, d):
    silences, frames = _silences(spark, d)
    silences, frames = stage(silences, "silences"), stage(frames, "frames")
    return G.split_by_silence(silences, frames, V.LR_RATE)


@query("set09_trim_silences", f"""WITH {SIL}, c AS (SELECT rec_id, s+50 AS s, e-50 AS e FROM sil WHERE e-s-100>=100)
SELECT v.rec_id, v.ch, CAST(v.n-coalesce((SELECT sum(c.e-c.s) FROM c WHERE c.rec_id=v.rec_id AND c.e<=v.n),0) AS BIGINT) AS n, round(v.v,6)+0.0::DOUBLE AS v
FROM v_stereo v WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.rec_id=v.rec_id AND v.n>=c.s AND v.n<c.e)""")
def _(spark, d):
    samples = V.stereo(spark, d)
    silences, _ = _silences(spark, d, samples)
    return P.delete_ranges(samples, G.silence_cuts(silences, V.LR_RATE)).withColumn("v", r6("v"))


@query("win03_steps", """SELECT rec_id, ch, n, round(v,6)+0.0::DOUBLE AS v, round(abs(v-lag(v) OVER w),6) AS step, round(abs(v-(lag(v) OVER w+lead(v) OVER w)/2),6) AS curvature
  FROM v_sig WINDOW w AS (PARTITION BY rec_id, ch ORDER BY n)""")
def _(spark, d):
    return G.steps(V.sig(spark, d)).withColumns({c: r6(c) for c in ("v", "step", "curvature")})


@query("win04_local_threshold", """WITH c AS (SELECT rec_id, ch, n, v, abs(v-(lag(v) OVER w+lead(v) OVER w)/2) AS x FROM v_stereo WINDOW w AS (PARTITION BY rec_id, ch ORDER BY n)),
b AS (SELECT DISTINCT rec_id, ch, n//25 AS block FROM c), h AS (SELECT b.rec_id, b.ch, b.block, x, v FROM b JOIN c ON b.rec_id=c.rec_id AND b.ch=c.ch AND c.n>=b.block*25-6 AND c.n<b.block*25+25+6),
m AS (SELECT rec_id, ch, block, median(x) AS median, sqrt(avg(v*v)) AS rms FROM h GROUP BY 1,2,3),
d AS (SELECT rec_id, ch, block, any_value(m.median) AS median, any_value(rms) AS rms, median(abs(x-m.median)) AS mad FROM h JOIN m USING (rec_id, ch, block) GROUP BY 1,2,3)
SELECT rec_id, ch, block, round(median,6) AS median, round(mad,6) AS mad, round(median+10.25*greatest(1.4826*mad,0.25*median,rms*0.00475,2e-7),6) AS threshold FROM d""")
def _(spark, d):
    curved = G.steps(V.stereo(spark, d))
    out = G.local_threshold(curved, "curvature", V.LR_RATE, 10.25, 0.00475)
    return out.withColumns({c: r6(c) for c in ("median", "mad", "threshold")})


RUNS = """hot AS (SELECT rec_id, ch, n, abs(v) AS a, CASE WHEN v>0 THEN 1 ELSE -1 END AS pol FROM v_stereo WHERE abs(v)>=0.9),
hb AS (SELECT *, CASE WHEN n-lag(n) OVER (PARTITION BY rec_id, ch, pol ORDER BY n)<=2 THEN 0 ELSE 1 END AS nw FROM hot),
hg AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id, ch, pol ORDER BY n) AS g FROM hb),
runs AS (SELECT rec_id, ch, pol, min(n) AS s, max(n)+1 AS e, count(*) AS hits, max(a) AS lev FROM hg GROUP BY rec_id, ch, pol, g HAVING max(n)+1-min(n)>=3)"""


@query("win06_clipped_runs", f"""WITH {RUNS} SELECT rec_id, ch, CAST(pol AS INT) AS polarity, s AS "start", e AS "end", CAST(hits AS BIGINT) AS hits, round(lev,6) AS level FROM runs""")
def _(spark, d):
    return G.clipped_runs(V.stereo(spark, d), 0.9).withColumn("level", r6("level"))


_SHOULDER = """st AS (SELECT *, abs(v-lag(v) OVER (PARTITION BY rec_id, ch ORDER BY n)) AS d FROM v_stereo),
nb AS (SELECT runs.*, st.n, st.v, st.d, greatest(2e-7,lev*1e-4) AS tol FROM runs JOIN st ON runs.rec_id=st.rec_id AND runs.ch=st.ch AND st.n BETWEEN s-5 AND e-1+5),
fg AS (SELECT rec_id, ch, pol, s, e, lev, avg(CASE WHEN n>s AND n<e THEN CASE WHEN d<=greatest(1e-8,0.12*tol) THEN 1.0::DOUBLE ELSE 0 END END) AS eq,
 avg(CASE WHEN n>s AND n<e THEN d END) AS ind, max(CASE WHEN n>s AND n<e THEN d END) AS inm, avg(CASE WHEN n<=s OR n>=e THEN d END) AS sh,
 max(CASE WHEN n<s OR n>=e THEN abs(v) END) AS outp, max(CASE WHEN n=s THEN d END) AS si, max(CASE WHEN n=e THEN d END) AS so FROM nb GROUP BY 1,2,3,4,5,6),
sc AS (SELECT *, least(1,greatest(0,(sh/greatest(1e-9,coalesce(ind,0))-1.5)/6)) AS con, least(1,greatest(0,(e-s-3+1)/6.0::DOUBLE)) AS len, greatest(coalesce(si,0),coalesce(so,0))*(e-s+2)*0.20 AS os FROM fg)"""


@query("win06_clipped_scores", f"""WITH {RUNS}, {_SHOULDER}, r AS (SELECT *, 0.58+0.16*len+0.14*con+0.12*least(1,greatest(0,8*(lev-0.9)/0.9)) AS cf FROM sc)
SELECT rec_id, ch, CAST(pol AS INT) AS polarity, s AS "start", e AS "end", round(lev,6) AS level, round(cf,6) AS confidence, round(least(1,greatest(0,os/(0.12*lev))),6) AS severity,
 round(greatest(lev,lev+greatest(0.001*lev,os)),6) AS estimated_peak FROM r WHERE cf>=0.65""")
def _(spark, d):
    s = V.stereo(spark, d)
    out = G.score_clipped(G.clipped_runs(s, 0.9), s, threshold=0.9)
    return out.withColumns({c: r6(c) for c in ("level", "confidence", "severity", "estimated_peak")})


_EQ = """ep AS (SELECT *, lag(v) OVER (PARTITION BY rec_id, ch ORDER BY n) AS pv FROM v_stereo),
ee AS (SELECT *, greatest(abs(v),abs(pv)) AS l FROM ep WHERE v*pv>0 AND greatest(abs(v),abs(pv))>=0.1 AND abs(v-pv)<=greatest(2e-7,greatest(abs(v),abs(pv))*1e-4)),
runs AS (SELECT rec_id, ch, CAST(sign(v) AS INT) AS pol, min(n)-1 AS s, max(n)+1 AS e, max(l) AS lev FROM (SELECT *, n-row_number() OVER (PARTITION BY rec_id, ch, sign(v) ORDER BY n) AS g FROM ee) GROUP BY rec_id, ch, sign(v), g HAVING max(n)-min(n)+2>=3)"""


@query("win07_automatic_rail", f"""WITH {_EQ}, {_SHOULDER}, r AS (SELECT *, 0.50*coalesce(eq,0)+0.32*con+0.18*greatest(len,0.35) AS cf FROM sc
 WHERE coalesce(outp,0)<=lev+1.5*greatest(2e-7,lev*1e-4) AND eq>0 AND inm<=1.5*greatest(2e-7,lev*1e-4) AND (e-s>=6 OR sh>=0.001*lev))
SELECT rec_id, ch, pol AS polarity, s AS "start", e AS "end", round(lev,6) AS level, round(cf,6) AS confidence, round(least(1,greatest(0,os/(0.12*lev))),6) AS severity,
 round(greatest(lev,lev+greatest(0.001*lev,os)),6) AS estimated_peak FROM r WHERE cf>=0.65""")
def _(spark, d):
    s = V.stereo(spark, d)
    runs = G.equal_runs(s).filter(F.col("end") - F.col("start") >= 3).drop("inside", "slope_in", "slope_out")
    return G.score_clipped(runs, s).withColumns({c: r6(c) for c in ("level", "confidence", "severity", "estimated_peak")})


_QW = """hp AS (SELECT rec_id, ch, n//50 AS hop, sum(v*v) AS p, count(*) AS c FROM v_stereo GROUP BY 1,2,3),
qw AS (SELECT rec_id, ch, hop, sqrt(sum(p) OVER w/1000) AS rms, sum(c) OVER w AS k FROM hp WINDOW w AS (PARTITION BY rec_id, ch ORDER BY hop ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
qq AS (SELECT rec_id, ch, rms, hop, row_number() OVER (PARTITION BY rec_id, ch ORDER BY rms, hop) AS k FROM qw WHERE k=1000 AND rms>0)"""


@query("win16_quietest_window", f"""WITH {_QW} SELECT rec_id, ch, round(rms,9) AS rms FROM qq WHERE k=1""")
def _(spark, d):
    return G.quietest_window(V.stereo(spark, d), 50, 20).select("rec_id", "ch", r6("rms", 9).alias("rms"))


@query("agg22_noise_to_programme", f"""WITH {_QW}, w AS (SELECT rec_id, ch, sqrt(avg(v*v)) AS a FROM v_stereo GROUP BY 1,2)
SELECT rec_id, round(min(20*log10(a/rms)),5) AS separation_db FROM w JOIN qq USING (rec_id, ch) WHERE k=1 GROUP BY rec_id""")
def _(spark, d):
    return G.noise_to_programme(V.stereo(spark, d), 50, 20).withColumn("separation_db", r6("separation_db", 5))


def _events(spark, d):
    """Two detectors over the same signal: loud peaks as clicks, clipped runs as clips."""
    s = V.stereo(spark, d)
    clips = G.clipped_runs(s, 0.9).select(
        "rec_id", "ch", F.lit("clip").alias("kind"), "start", "end", (F.col("hits") / (F.col("end") - F.col("start"))).alias("confidence")
    )
    clicks = s.filter(F.abs("v") >= 0.98).select(
        "rec_id", "ch", F.lit("click").alias("kind"), F.col("n").alias("start"), (F.col("n") + 1).alias("end"), F.abs("v").alias("confidence")
    )
    return clips, clicks


EVT = RUNS + """, evs AS (SELECT rec_id, ch, 'clip' AS kind, s, e, hits/(e-s)::DOUBLE AS c FROM runs UNION ALL SELECT rec_id, ch, 'click', n, n+1, abs(v) FROM v_stereo WHERE abs(v)>=0.98),
ef AS (SELECT *, CASE WHEN s<=max(e) OVER (PARTITION BY rec_id, ch ORDER BY s, e, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM evs),
eg AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id, ch ORDER BY s, e, kind ROWS UNBOUNDED PRECEDING) AS g FROM ef),
ek AS (SELECT *, row_number() OVER (PARTITION BY rec_id, ch, g ORDER BY c DESC, kind DESC) AS k FROM eg),
mrg AS (SELECT rec_id, ch, min(s) AS "start", max(e) AS "end", max(CASE WHEN k=1 THEN kind END) AS kind, max(CASE WHEN k=1 THEN c END) AS confidence, count(*) AS merged FROM ek GROUP BY rec_id, ch, g)"""


@query("set01_merge_events", f"""WITH {EVT} SELECT rec_id, ch, "start", "end", kind, round(confidence,6) AS confidence, CAST(merged AS BIGINT) AS merged FROM mrg""")
def _(spark, d):
    return G.join_events(*_events(spark, d)).withColumn("confidence", r6("confidence"))


@query("top08_strongest_event", f"""WITH {EVT}, k AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY confidence DESC, ch, "start", "end", kind DESC) AS k FROM mrg)
SELECT rec_id, ch, "start", "end", kind, round(confidence,6) AS confidence FROM k WHERE k=1""")
def _(spark, d):
    return G.strongest_event(G.join_events(*_events(spark, d)).drop("merged")).withColumn("confidence", r6("confidence"))

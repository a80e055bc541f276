"""Queries for the block record and what is decided from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolake.functions.levels import amplitude_db
from phonolake.operators import blocks as B
from phonolake.operators import loudness as N
from phonolake.operators import segments as G
from phonolake.operators import transforms as P
from phonolake.plans import views as V
from phonolake.plans.q_loudness import _tp_sql
from phonolake.plans.q_transforms import r6
from phonolake.plans.registry import query
from phonolake.session import stage

_DB = "CASE WHEN {0}>0 THEN {1}*log10({0}) ELSE '-inf'::DOUBLE END"


def _db(x, k=10):
    return _DB.format(f"({x})", k)


TRIM = """hb AS (SELECT rec_id, n//100 AS block, CASE WHEN abs(v)>1e-9 THEN least(127,greatest(0,CAST(floor(-20*log10(abs(v))/0.5) AS INT))) END AS bin, count(*) AS c
  FROM (SELECT * FROM v_stereo WHERE abs(v)>1e-9 UNION ALL SELECT rec_id, ch, n, 1e-30::DOUBLE FROM v_stereo WHERE abs(v)<=1e-9) GROUP BY 1,2,3),
hc AS (SELECT *, greatest(1,floor(sum(c) OVER (PARTITION BY rec_id, block)*0.005)) AS t, sum(CASE WHEN bin IS NOT NULL THEN c ELSE 0 END) OVER (PARTITION BY rec_id, block ORDER BY bin) AS cum FROM hb),
trim AS (SELECT rec_id, block, -(min(bin)+0.5::DOUBLE)*0.5::DOUBLE AS trimmed_peak_db FROM hc WHERE bin IS NOT NULL AND cum>=t GROUP BY 1,2)"""

BLK = TRIM + f""", sg AS (SELECT *, sign(a) AS s, lag(sign(a)) OVER (PARTITION BY rec_id, ch ORDER BY n) AS ps FROM v_active),
ac AS (SELECT rec_id, ch, n//100 AS block, count(*) AS f, sum(v*v) AS p, sum(a*a) AS ap, max(abs(v)) AS pk, sum(CASE WHEN s*ps<0 THEN 1 ELSE 0 END) AS zc, sum(v) AS t,
  count(CASE WHEN abs(v)>=0.999969 THEN 1 END) AS cl, sum(v*cos(2*pi()*50*n/1000)) AS c50, sum(v*sin(2*pi()*50*n/1000)) AS s50,
  sum(v*cos(2*pi()*60*n/1000)) AS c60, sum(v*sin(2*pi()*60*n/1000)) AS s60 FROM sg GROUP BY 1,2,3),
bb AS (SELECT rec_id, block, max(f) AS frames, count(*) AS channels, {_db('sum(p)/(max(f)*count(*))')} AS rms_db, {_db('sum(ap)/(max(f)*count(*))')} AS activity_rms_db, {_db('max(pk)', 20)} AS peak_db,
  {_db('2*(pow(sum(c50)/count(*),2)+pow(sum(s50)/count(*),2))/(max(f)*max(f))')} AS hum50_db,
  {_db('2*(pow(sum(c60)/count(*),2)+pow(sum(s60)/count(*),2))/(max(f)*max(f))')} AS hum60_db,
  max(zc)*1000/max(f)::DOUBLE AS zc_per_s, max(CASE WHEN ch=0 THEN p END)/max(f) AS left_ms, max(CASE WHEN ch=1 THEN p END)/max(f) AS right_ms,
  max(CASE WHEN ch=0 THEN t END)/max(f) AS left_mean, max(CASE WHEN ch=1 THEN t END)/max(f) AS right_mean, sum(cl) AS clipped FROM ac GROUP BY 1,2),
blk AS (SELECT bb.*, coalesce(trimmed_peak_db,'-inf'::DOUBLE) AS trimmed_peak_db FROM bb LEFT JOIN trim USING (rec_id, block))"""

CLS = BLK + """, pc AS (SELECT rec_id, quantile_cont(activity_rms_db,0.1) AS p10, quantile_cont(activity_rms_db,0.5) AS p50, quantile_cont(activity_rms_db,0.9) AS p90 FROM blk GROUP BY rec_id),
fl AS (SELECT *, CASE WHEN p90-p10>=10 THEN p10 END AS noise_floor_db, CASE WHEN p90-p10>=10 THEN greatest(-55,p10+10) WHEN p50>-55 THEN -55 END AS threshold_db FROM pc),
cls AS (SELECT blk.*, threshold_db, noise_floor_db, CASE WHEN threshold_db IS NULL THEN 'none' WHEN activity_rms_db>threshold_db AND peak_db>-35 AND zc_per_s>=150 AND zc_per_s<=400 THEN 'active'
  WHEN NOT isinf(rms_db) AND rms_db>-90 THEN 'quiet' ELSE 'none' END AS class,
  CASE WHEN NOT isinf(trimmed_peak_db) AND NOT isinf(peak_db) AND peak_db-trimmed_peak_db>6 THEN trimmed_peak_db ELSE peak_db END AS robust FROM blk JOIN fl USING (rec_id))"""


def _blocks(spark, d):
    return B.block_summary(V.stereo(spark, d), V.LR_RATE, V.ACTIVITY_TAPS)


def _block_table(spark, d):
    """The block record written once: a ten-thousandth of the samples, read by several branches afterwards."""
    return stage(_blocks(spark, d), "blocks")


@query("agg12_block_summary", f"""WITH {BLK} SELECT rec_id, block, CAST(frames AS BIGINT) AS frames, CAST(channels AS BIGINT) AS channels, round(rms_db,5)+0.0::DOUBLE AS rms_db,
  round(activity_rms_db,5)+0.0::DOUBLE AS activity_rms_db, round(peak_db,5)+0.0::DOUBLE AS peak_db, round(zc_per_s,4) AS zc_per_s,
  round(left_ms,8) AS left_ms, round(right_ms,8) AS right_ms, round(left_mean,8)+0.0::DOUBLE AS left_mean, round(right_mean,8)+0.0::DOUBLE AS right_mean, CAST(clipped AS BIGINT) AS clipped FROM blk""")
def _(spark, d):
    return _blocks(spark, d).select(
        "rec_id", "block", "frames", "channels", *[r6(c, 5).alias(c) for c in ("rms_db", "activity_rms_db", "peak_db")],
        r6("zc_per_s", 4).alias("zc_per_s"), *[r6(c, 8).alias(c) for c in ("left_ms", "right_ms", "left_mean", "right_mean")],
        "clipped",
    )


@query("agg13_trimmed_peak", f"WITH {TRIM} SELECT rec_id, block, round(trimmed_peak_db,4) AS trimmed_peak_db FROM trim")
def _(spark, d):
    return B.trimmed_peak(V.stereo(spark, d), 100).withColumn("trimmed_peak_db", r6("trimmed_peak_db", 4))


@query("agg14_block_classes", f"""WITH {CLS} SELECT rec_id, class, CAST(count(*) AS BIGINT) AS blocks, round(max(threshold_db),5) AS threshold_db, round(max(noise_floor_db),5) AS noise_floor_db FROM cls GROUP BY 1,2""")
def _(spark, d):
    return B.classify(_block_table(spark, d), V.LR_RATE).groupBy("rec_id", "class").agg(
        F.count(F.lit(1)).alias("blocks"), r6(F.max("threshold_db"), 5).alias("threshold_db"),
        r6(F.max("noise_floor_db"), 5).alias("noise_floor_db"),
    )


@query("flt05_program_blocks", f"""WITH {CLS} SELECT rec_id, block FROM blk WHERE activity_rms_db>-55 AND peak_db>-35 AND zc_per_s>=150 AND zc_per_s<=400""")
def _(spark, d):
    return _blocks(spark, d).filter(B.is_program(F.lit(-55.0), V.LR_RATE)).select("rec_id", "block")


_ACTIVE = """, act AS (SELECT *, sum(frames) OVER (PARTITION BY rec_id ORDER BY block)-frames AS before, sum(frames) OVER (PARTITION BY rec_id) AS al FROM cls WHERE class='active'),
ref AS (SELECT rec_id, 20*log10(max(abs(v))) AS peak_db FROM v_stereo GROUP BY rec_id),
ev AS (SELECT rec_id, greatest(0,max(robust)-max(ref.peak_db)) AS tail_db, coalesce(least(3,greatest(0,max(robust)-max(CASE WHEN before<floor(al*0.5) THEN robust END))),0) AS novelty_db
  FROM act JOIN ref USING (rec_id) GROUP BY rec_id)"""
_EV = CLS + _ACTIVE


# Plateaus (ft) and, per recording, how many of them have two consistent others in the ten seconds before (fr).
FLAT = """fp AS (SELECT *, lag(v) OVER w AS pv, lead(v) OVER w AS nv FROM v_stereo WINDOW w AS (PARTITION BY rec_id, ch ORDER BY n)),
fe AS (SELECT *, greatest(abs(v),abs(pv)) AS lev FROM fp WHERE v*pv>0 AND greatest(abs(v),abs(pv))>=0.1 AND abs(v-pv)<=greatest(2e-7,greatest(abs(v),abs(pv))*1e-4)),
fi AS (SELECT rec_id, ch, sign(v) AS s, min(n)-1 AS a, max(n)+1 AS b, max(lev) AS lev, max(abs(v-pv)) AS ins FROM (SELECT *, n-row_number() OVER (PARTITION BY rec_id, ch, sign(v) ORDER BY n) AS g FROM fe) GROUP BY rec_id, ch, sign(v), g),
ft AS (SELECT i.* FROM fi i JOIN fp x ON x.rec_id=i.rec_id AND x.ch=i.ch AND x.n=a JOIN fp y ON y.rec_id=i.rec_id AND y.ch=i.ch AND y.n=b
  WHERE b-a>=3 AND lev<0.999969 AND ins<=1.5*greatest(2e-7,1e-4*lev) AND coalesce(abs(x.v-x.pv),0)>=0.001*lev AND coalesce(abs(y.v-y.pv),0)>=0.001*lev),
fo AS (SELECT t1.rec_id, t1.ch, t1.b, max(t2.lev) AS top FROM ft t1 JOIN ft t2 ON t1.rec_id=t2.rec_id AND t1.ch=t2.ch AND t2.b BETWEEN t1.b-10000 AND t1.b GROUP BY 1,2,3),
fc AS (SELECT o.rec_id, o.ch, o.b, max(top) AS top, count(CASE WHEN 20*log10(top/t2.lev)<=1.0 THEN 1 END) AS n FROM fo o JOIN ft t2 ON o.rec_id=t2.rec_id AND o.ch=t2.ch AND t2.b BETWEEN o.b-10000 AND o.b GROUP BY 1,2,3),
fk AS (SELECT rec_id, max(abs(v)) AS pk FROM v_stereo GROUP BY rec_id),
fr AS (SELECT fk.rec_id, CAST(count(c.b) AS BIGINT) AS alarms, count(c.b)>0 AS flat_tops FROM fk LEFT JOIN fc c ON c.rec_id=fk.rec_id AND n>=3 AND 20*log10(top)>=20*log10(pk)-3 GROUP BY fk.rec_id)"""


def _flat_tops(spark, d, samples):
    peaks = samples.groupBy("rec_id").agg(amplitude_db(F.max(F.abs("v"))).alias("peak_db"))
    return G.repeated_flat_tops(G.flat_tops(samples), peaks, V.LR_RATE)


def snapshot_sql(classes: str = CLS, top: str = "quantile_cont(robust,0.99)") -> str:
    """Level, advice and status from the blocks of ``classes``; whole-recording figures always from all samples."""
    return f"""WITH {classes}{_ACTIVE}, {_tp_sql()}, {FLAT},
ex AS (SELECT rec_id, ref.peak_db, 20*log10(true_peak) AS tpd, cl, flat_tops AS ft FROM ref JOIN tp USING (rec_id) JOIN fr USING (rec_id) JOIN (SELECT rec_id, count(CASE WHEN abs(v)>=0.999969 THEN 1 END) AS cl FROM v_stereo GROUP BY rec_id) USING (rec_id)),
q AS (SELECT rec_id, quantile_cont(rms_db,0.5) AS prms, {top} AS sp, sum(frames)/1000.0::DOUBLE AS sec FROM act GROUP BY rec_id),
a AS (SELECT *, CASE WHEN peak_db-sp>6 THEN 0 ELSE least(3,greatest(0,tpd-peak_db)) END AS prem, sec+1e-9>=10 AS settled FROM ex LEFT JOIN q USING (rec_id) LEFT JOIN ev USING (rec_id)),
b AS (SELECT *, sp+prem AS pp, CASE WHEN settled THEN floor((least(96,greatest(-96,CASE WHEN cl>0 OR ft THEN least(-1-tpd,-1) ELSE -1-tpd END))+1e-6)*2)/2 ELSE 0 END AS g FROM a)
SELECT rec_id, round(sec,6) AS active_seconds, round(prms,5)+0.0::DOUBLE AS program_rms_db, round(pp,5)+0.0::DOUBLE AS program_peak_db, round(greatest(0,pp-prms),5) AS crest_db,
 g+0.0::DOUBLE AS suggested_gain_db, round(least(0.95,1-exp(-sec/30))/(1+novelty_db/6),6) AS confidence,
 CASE WHEN cl>0 THEN 'Clipping' WHEN ft THEN 'UpstreamClipping' WHEN tpd>=0 THEN 'AboveTarget' WHEN sec IS NULL THEN 'WaitingForSignal' WHEN NOT settled THEN 'Analyzing' WHEN g<0 THEN 'AboveTarget' WHEN g>0 THEN 'TooLow' ELSE 'Good' END AS status FROM b"""


def snapshot_columns(out):
    return out.withColumns({
        "active_seconds": r6("active_seconds"), "confidence": r6("confidence"), "suggested_gain_db": F.col("suggested_gain_db") + F.lit(0.0),
        **{c: r6(c, 5) for c in ("program_rms_db", "program_peak_db", "crest_db")},
    })


@query("agg15_level_snapshot", snapshot_sql())
def _(spark, d):
    s = stage(V.stereo(spark, d), "stereo")
    extremes = N.true_peak(s).join(
        s.groupBy("rec_id").agg(
            amplitude_db(F.max(F.abs("v"))).alias("peak_db"), F.count_if(F.abs("v") >= 0.999969).alias("clipped")
        ), "rec_id",
    ).join(_flat_tops(spark, d, s).select("rec_id", "flat_tops"), "rec_id")
    return snapshot_columns(B.level_snapshot(stage(B.block_summary(s, V.LR_RATE, V.ACTIVITY_TAPS), "blocks"), stage(extremes, "extremes"), V.LR_RATE))


@query("agg16_channel_balance", f"""WITH {CLS} SELECT rec_id, round(least(60,greatest(-60,10*log10(sum(left_ms)/sum(right_ms)))),5)+0.0::DOUBLE AS balance_db,
  round(20*log10(greatest(abs(avg(left_mean)),abs(avg(right_mean)))),4)+0.0::DOUBLE AS dc_db FROM cls WHERE class='active' GROUP BY rec_id""")
def _(spark, d):
    out = B.channel_balance(B.classify(_block_table(spark, d), V.LR_RATE))
    return out.select("rec_id", r6("balance_db", 5).alias("balance_db"), r6("dc_db", 4).alias("dc_db"))


@query("agg17_peak_evidence", f"WITH {_EV} SELECT rec_id, round(tail_db,5) AS tail_db, round(novelty_db,5) AS novelty_db FROM ev")
def _(spark, d):
    s = V.stereo(spark, d)
    reference = s.groupBy("rec_id").agg(amplitude_db(F.max(F.abs("v"))).alias("reference_db"))
    out = B.peak_evidence(B.classify(stage(B.block_summary(s, V.LR_RATE, V.ACTIVITY_TAPS), "blocks"), V.LR_RATE), reference)
    return out.select("rec_id", r6("tail_db", 5).alias("tail_db"), r6("novelty_db", 5).alias("novelty_db"))


@query("agg18_hum_decision", f"""WITH {CLS}, m AS (SELECT rec_id, count(*) AS c, median(hum50_db) AS l5, median(hum60_db) AS l6, median(hum50_db-rms_db) AS d5, median(hum60_db-rms_db) AS d6 FROM cls WHERE class='quiet' GROUP BY rec_id),
h AS (SELECT *, c>=10 AND l5>=-80 AND d5>=-3 AS h5, c>=10 AND l6>=-80 AND d6>=-3 AS h6 FROM m)
SELECT rec_id, CAST(c AS BIGINT) AS quiet_blocks, CAST(CASE WHEN h5 AND (NOT h6 OR l5>=l6) THEN 50 WHEN h6 THEN 60 ELSE 0 END AS INT) AS hum_hz,
  round(CASE WHEN h5 AND (NOT h6 OR l5>=l6) THEN l5 WHEN h6 THEN l6 END,5) AS hum_db FROM h""")
def _(spark, d):
    return B.hum_decision(B.classify(_block_table(spark, d), V.LR_RATE)).withColumn("hum_db", r6("hum_db", 5))


@query("win09_repeated_flat_tops", f"WITH {FLAT} SELECT rec_id, alarms, flat_tops FROM fr")
def _(spark, d):
    return _flat_tops(spark, d, V.stereo(spark, d))


@query("win10_zero_crossings", """WITH s AS (SELECT rec_id, ch, n, sign(a) AS s, lag(sign(a)) OVER (PARTITION BY rec_id, ch ORDER BY n) AS p FROM v_active),
c AS (SELECT rec_id, ch, n//100 AS block, sum(CASE WHEN s*p<0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN s<>0 AND s<>p THEN 1 ELSE 0 END) AS b FROM s GROUP BY 1,2,3)
SELECT rec_id, block, CAST(max(a) AS BIGINT) AS both_signed, CAST(max(b) AS BIGINT) AS current_signed FROM c GROUP BY 1,2""")
def _(spark, d):
    return G.zero_crossings(V.stereo(spark, d), 100, V.LR_RATE, V.ACTIVITY_TAPS)


RUN = f"""rs AS (SELECT rec_id, ch, n, v, a, sign(a) AS s, lag(sign(a)) OVER (PARTITION BY rec_id, ch ORDER BY n) AS p FROM v_active),
r1 AS (SELECT rec_id, n//10 AS sub, {_db('sqrt(sum(a*a)/count(*))', 20)} AS lv FROM rs GROUP BY 1,2),
r2 AS (SELECT rec_id, ch, n//100 AS block, sum(CASE WHEN s<>0 AND s<>p THEN 1 ELSE 0 END) AS zc, max(abs(v)) AS pk, count(*) AS f FROM rs GROUP BY 1,2,3),
r3 AS (SELECT rec_id, block, max(zc)/(max(f)/1000.0::DOUBLE) AS zc_per_s, {_db('max(pk)', 20)} AS peak_db FROM r2 GROUP BY 1,2 HAVING max(f)=100),
r4 AS (SELECT rec_id, sub//10 AS block, median(lv) AS activity_rms_db FROM r1 GROUP BY 1,2),
ro AS (SELECT * FROM r3 JOIN r4 USING (rec_id, block)),
rf AS (SELECT *, list_sort(list(CASE WHEN activity_rms_db BETWEEN -80 AND -55 THEN activity_rms_db END) OVER (PARTITION BY rec_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'ASC', 'NULLS LAST')[10] AS floor_db FROM ro),
rp AS (SELECT *, activity_rms_db>greatest(-55,coalesce(floor_db+10,-55)) AND peak_db>-60 AND zc_per_s>=150 AND zc_per_s<=400 AS program FROM rf),
ra AS (SELECT *, max(CASE WHEN program THEN block END) OVER (PARTITION BY rec_id ORDER BY block) AS last_program FROM rp)"""


def _run_out(spark, d):
    blocks = stage(B.run_out_blocks(V.stereo(spark, d), V.LR_RATE, V.ACTIVITY_TAPS), "run_out_blocks")
    return B.run_out_program(B.quietest_so_far(blocks), V.LR_RATE)


@query("win12_run_out_blocks", f"WITH {RUN} SELECT rec_id, block, round(activity_rms_db,5)+0.0::DOUBLE AS activity_rms_db, round(peak_db,5)+0.0::DOUBLE AS peak_db, round(zc_per_s,4) AS zc_per_s FROM ro")
def _(spark, d):
    out = B.run_out_blocks(V.stereo(spark, d), V.LR_RATE, V.ACTIVITY_TAPS)
    return out.withColumns({"activity_rms_db": r6("activity_rms_db", 5), "peak_db": r6("peak_db", 5), "zc_per_s": r6("zc_per_s", 4)})


@query("win13_floor_so_far", f"WITH {RUN} SELECT rec_id, block, round(floor_db,5)+0.0::DOUBLE AS floor_db, program FROM rp")
def _(spark, d):
    return _run_out(spark, d).select("rec_id", "block", r6("floor_db", 5).alias("floor_db"), "program")


@query("win14_fading_tail", f"""WITH {RUN}, m AS (SELECT rec_id, block, floor_db,
  median(activity_rms_db) OVER (PARTITION BY rec_id ORDER BY block ROWS BETWEEN 29 PRECEDING AND 20 PRECEDING) AS a,
  median(activity_rms_db) OVER (PARTITION BY rec_id ORDER BY block ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) AS b,
  median(activity_rms_db) OVER (PARTITION BY rec_id ORDER BY block ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c,
  count(*) OVER (PARTITION BY rec_id ORDER BY block ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS n FROM rp)
SELECT rec_id, block, (n=30 AND NOT isinf(a) AND NOT isinf(b) AND NOT isinf(c) AND NOT coalesce(c<=floor_db+1.5,false) AND a-b>=0.15 AND b-c>=0.15) AS fading FROM m""")
def _(spark, d):
    return B.fading_tail(_run_out(spark, d)).select("rec_id", "block", "fading")


@query("join16_last_program", f"WITH {RUN} SELECT rec_id, block, program, CAST(coalesce(last_program,-1) AS BIGINT) AS last_program FROM ra")
def _(spark, d):
    return B.last_program(_run_out(spark, d)).select("rec_id", "block", "program", F.coalesce("last_program", F.lit(-1)).alias("last_program"))


# Recordings are replayed with everything past a quarter of their length 1000 times quieter, so that sides do end.
_SIDE = """q_all AS (SELECT rec_id, max(n) AS top FROM v_lr GROUP BY rec_id), q_side AS (SELECT s.rec_id, ch, n,
  CASE WHEN n*4>top THEN v*0.001::DOUBLE ELSE v END AS v FROM v_stereo s JOIN q_all USING (rec_id)), q_active AS (SELECT rec_id, ch, n, v,
  """ + V._fir_sql(V.ACTIVITY_TAPS) + """ AS a FROM q_side WINDOW w AS (PARTITION BY rec_id, ch ORDER BY n)), """


def ending_sides(spark, d):
    s = V.stereo(spark, d)
    top = V.lr(spark, d).groupBy("rec_id").agg(F.max("n").alias("_top"))
    quiet = F.when(F.col("n") * 4 > F.col("_top"), F.col("v") * 0.001).otherwise(F.col("v"))
    return s.join(top, "rec_id").select("rec_id", "ch", "n", quiet.alias("v"))


_FADE = """fm AS (SELECT rec_id, block, floor_db,
  median(activity_rms_db) OVER (PARTITION BY rec_id ORDER BY block ROWS BETWEEN 29 PRECEDING AND 20 PRECEDING) AS a,
  median(activity_rms_db) OVER (PARTITION BY rec_id ORDER BY block ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) AS b,
  median(activity_rms_db) OVER (PARTITION BY rec_id ORDER BY block ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c,
  count(*) OVER (PARTITION BY rec_id ORDER BY block ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS n FROM rp),
fd AS (SELECT rec_id, block, (n=30 AND NOT isinf(a) AND NOT isinf(b) AND NOT isinf(c) AND NOT coalesce(c<=floor_db+1.5,false) AND a-b>=0.15 AND b-c>=0.15) AS fading FROM fm),
fe AS (SELECT ra.*, fading, min(CASE WHEN program THEN block END) OVER (PARTITION BY rec_id ORDER BY block) AS first_program FROM ra JOIN fd USING (rec_id, block)),
fw AS (SELECT *, max(CASE WHEN program THEN 2*block WHEN fading AND block-first_program>=29 THEN 2*block+1 END) OVER (PARTITION BY rec_id ORDER BY block) AS e FROM fe),
"""


@query("win15_hold_trigger", f"""WITH {_SIDE}{RUN.replace('v_active', 'q_active')}, {_FADE}
h AS (SELECT rec_id, min(block) AS trigger_block, arg_min(last_program, block) AS last_program, arg_min(e//2, block) AS upto FROM fw WHERE (block-(e//2+e%2*30))/10.0::DOUBLE>=5 GROUP BY rec_id)
SELECT rec_id, trigger_block, CAST(last_program AS BIGINT) AS last_program, CAST(least(trigger_block,upto+40) AS BIGINT) AS keep_to_block FROM h""")
def _(spark, d):
    blocks = stage(B.run_out_blocks(ending_sides(spark, d), V.LR_RATE, V.ACTIVITY_TAPS), "run_out_blocks")
    program = B.run_out_program(B.quietest_so_far(blocks), V.LR_RATE)
    return B.hold_trigger(B.last_program(B.fading_tail(program)), 5.0)


@query("join15_stereo_correlation", "SELECT rec_id, round(sum(l*r)/sqrt(sum(l*l)*sum(r*r)),6)+0.0::DOUBLE AS correlation FROM v_lr GROUP BY rec_id")
def _(spark, d):
    pairs = P.stereo_pairs(V.stereo(spark, d))
    l, r = F.col("l"), F.col("r")
    return pairs.groupBy("rec_id").agg(r6(F.sum(l * r) / F.sqrt(F.sum(l * l) * F.sum(r * r))).alias("correlation"))

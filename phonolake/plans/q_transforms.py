"""Queries for sample-wise transforms and block statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolake.functions import levels as L
from phonolake.operators import signal as S
from phonolake.operators import transforms as P
from phonolake.plans import views as V
from phonolake.plans.registry import query
from phonolake.sources import samples as src


def r6(name, digits=6):
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    column = F.col(name) if isinstance(name, str) else name
    return F.round(column, digits) + F.lit(0.0)


def _gains(samples):
    """One gain per recording, derived from its id: -3 dB per step."""
    return samples.select("rec_id").distinct().withColumn("gain_db", F.col("rec_id") * -3.0)


@query("src01_load_samples", """
WITH c AS (SELECT rec_id, ch, count(*) AS frames, min(n) AS lo, max(n) AS hi, count(CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 1 END) AS bad
           FROM v_stereo GROUP BY 1,2)
SELECT rec_id, CAST(count(*) AS BIGINT) AS channels, CAST(max(frames) AS BIGINT) AS frames,
  CASE WHEN min(frames)<>max(frames) THEN 'unequal channel lengths' WHEN min(lo)<>0 OR max(hi)<>max(frames)-1 THEN 'missing positions'
       WHEN sum(bad)>0 THEN 'non-finite samples' ELSE 'ok' END AS state FROM c GROUP BY rec_id""")
def _(spark, d):
    return src.recording_states(V.stereo(spark, d))


@query("prj01_gain", """SELECT rec_id, ch, n, round(v*pow(10.0::DOUBLE, rec_id*-3.0::DOUBLE/20),6)+0.0::DOUBLE AS v FROM v_stereo""")
def _(spark, d):
    s = V.stereo(spark, d)
    return P.gain(s, _gains(s)).select("rec_id", "ch", "n", r6("v").alias("v"))


@query("prj01_gain_report", """SELECT rec_id, round(max(abs(v))*pow(10.0::DOUBLE, rec_id*-3.0::DOUBLE/20),6) AS peak,
  CAST(0 AS BIGINT) AS rejected FROM v_stereo GROUP BY rec_id""")
def _(spark, d):
    s = V.stereo(spark, d)
    return P.gain_report(s, _gains(s)).select("rec_id", r6("peak").alias("peak"), "rejected")


@query("prj02_peak_normalize", """SELECT rec_id, ch, n, round(v*pow(10.0::DOUBLE,-1.0::DOUBLE/20)/p,6)+0.0::DOUBLE AS v, false AS silent
  FROM (SELECT *, max(abs(v)) OVER (PARTITION BY rec_id) AS p FROM v_stereo)""")
def _(spark, d):
    return P.peak_normalize(V.stereo(spark, d), -1.0).withColumn("v", r6("v"))


@query("prj03_remove_dc", """SELECT rec_id, ch, n, round(v-avg(v) OVER (PARTITION BY rec_id, ch),6)+0.0::DOUBLE AS v FROM v_stereo""")
def _(spark, d):
    return P.remove_dc(V.stereo(spark, d)).withColumn("v", r6("v"))


@query("prj04_sanitize", """SELECT rec_id, ch, CAST(count(CASE WHEN l_discount=0 THEN 1 END) AS BIGINT) AS invalid, CAST(count(*) AS BIGINT) AS samples,
  round(sum(CASE WHEN l_discount=0 THEN 0 ELSE l_quantity/l_discount END),3) AS total
  FROM (SELECT l_suppkey%4 AS rec_id, CAST(0 AS BIGINT) AS ch, l_quantity, l_discount FROM lineitem) GROUP BY rec_id, ch""")
def _(spark, d):
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity") / F.col("l_discount"))
    s = V.table(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 4).alias("rec_id"), F.lit(0).cast("long").alias("ch"), ratio.alias("v")
    )
    totals = P.sanitize(s).groupBy("rec_id", "ch").agg(r6(F.sum("v"), 3).alias("total"))
    return P.invalid_counts(s).join(totals, ["rec_id", "ch"])


@query("prj05_swap_channels", "SELECT rec_id, 1-ch AS ch, n, round(v,6)+0.0::DOUBLE AS v FROM v_stereo")
def _(spark, d):
    return P.swap_channels(V.stereo(spark, d)).withColumn("v", r6("v"))


@query("prj05_invert", "SELECT rec_id, ch, n, round(CASE WHEN ch=1 THEN -v ELSE v END,6)+0.0::DOUBLE AS v FROM v_stereo")
def _(spark, d):
    return P.invert(V.stereo(spark, d), 1).withColumn("v", r6("v"))


@query("prj05_balance", "SELECT rec_id, ch, n, round(v*pow(10.0::DOUBLE, CASE ch WHEN 0 THEN 1.5::DOUBLE ELSE -2.0::DOUBLE END/20),6)+0.0::DOUBLE AS v FROM v_stereo")
def _(spark, d):
    return P.balance(V.stereo(spark, d), 1.5, -2.0).withColumn("v", r6("v"))


@query("prj05_mono_mixdown", "SELECT rec_id, CAST(0 AS BIGINT) AS ch, n, round((l+r)/2,6)+0.0::DOUBLE AS v FROM v_lr")
def _(spark, d):
    return P.mono_mixdown(V.stereo(spark, d)).withColumn("v", r6("v"))


@query("prj05_mono_to_stereo", "SELECT rec_id, unnest([CAST(0 AS BIGINT), CAST(1 AS BIGINT)]) AS ch, n, round(v,6)+0.0::DOUBLE AS v FROM v_sig")
def _(spark, d):
    return P.mono_to_stereo(V.sig(spark, d)).withColumn("v", r6("v"))


@query("prj05_extract_channel", "SELECT rec_id, CAST(0 AS BIGINT) AS ch, n, round(r,6)+0.0::DOUBLE AS v FROM v_lr")
def _(spark, d):
    return P.extract_channel(V.stereo(spark, d), 1).withColumn("v", r6("v"))


@query("prj06_mid_side", "SELECT rec_id, n, round((l+r)*0.5::DOUBLE,6)+0.0::DOUBLE AS mid, round((l-r)*0.5::DOUBLE,6)+0.0::DOUBLE AS side FROM v_lr")
def _(spark, d):
    return P.mid_side(P.stereo_pairs(V.stereo(spark, d))).select("rec_id", "n", r6("mid").alias("mid"), r6("side").alias("side"))


@query("prj06_side_scale", """SELECT rec_id, n, round((l+r)*0.5::DOUBLE+(l-r)*0.5::DOUBLE*0.6::DOUBLE,6)+0.0::DOUBLE AS l,
  round((l+r)*0.5::DOUBLE-(l-r)*0.5::DOUBLE*0.6::DOUBLE,6)+0.0::DOUBLE AS r FROM v_lr""")
def _(spark, d):
    return P.side_scale(V.lr(spark, d), 0.6).select("rec_id", "n", r6("l").alias("l"), r6("r").alias("r"))


@query("prj07_reverse_range", """SELECT rec_id, ch, CASE WHEN n>=100 AND n<900 THEN 999-n ELSE n END AS n, round(v,6)+0.0::DOUBLE AS v FROM v_stereo""")
def _(spark, d):
    return P.reverse_range(V.stereo(spark, d), F.lit(100), F.lit(900)).withColumn("v", r6("v"))


_T = "CASE WHEN f<=1 THEN 1.0::DOUBLE ELSE n/(f-1)::DOUBLE END"


@query("prj08_legacy_fades", f"""
WITH t AS (SELECT rec_id, n, v, {_T} AS t FROM (SELECT *, max(n) OVER (PARTITION BY rec_id)+1 AS f FROM v_sig)),
g AS (SELECT rec_id, n, v, unnest(['linear','log','exp','s-curve','equal-power']) AS curve, t FROM t)
SELECT rec_id, n, curve, round(v*greatest(0,least(1,CASE curve WHEN 'linear' THEN t WHEN 'log' THEN ln(1+9*t)/ln(10)
  WHEN 'exp' THEN (exp(3*t)-1)/(exp(3)-1) WHEN 's-curve' THEN (1/(1+exp(-12*(t-0.5::DOUBLE)))-1/(1+exp(6)))/(1/(1+exp(-6))-1/(1+exp(6)))
  ELSE sin(t*pi()/2) END)),6)+0.0::DOUBLE AS faded_in,
  round(v*greatest(0,least(1,CASE curve WHEN 'linear' THEN 1-t WHEN 'log' THEN 1-ln(1+9*t)/ln(10)
  WHEN 'exp' THEN 1-(exp(3*t)-1)/(exp(3)-1) WHEN 's-curve' THEN 1-(1/(1+exp(-12*(t-0.5::DOUBLE)))-1/(1+exp(6)))/(1/(1+exp(-6))-1/(1+exp(6)))
  ELSE sin((1-t)*pi()/2) END)),6)+0.0::DOUBLE AS faded_out FROM g""")
def _(spark, d):
    s = V.sig(spark, d)
    t = s.join(P.frames_per_recording(s), "rec_id").withColumn(
        "t", F.when(F.col("frames") <= 1, 1.0).otherwise(F.col("n") / (F.col("frames") - 1))
    )
    curves = ["linear", "log", "exp", "s-curve", "equal-power"]
    options = F.array(*[
        F.struct(F.lit(c).alias("curve"), (F.col("v") * L.legacy_fade(F.col("t"), c)).alias("a"),
                 (F.col("v") * L.legacy_fade(F.col("t"), c, False)).alias("b")) for c in curves
    ])
    return t.select("rec_id", "n", F.inline(options)).select(
        "rec_id", "n", "curve", r6("a").alias("faded_in"), r6("b").alias("faded_out")
    )


def _law(t):
    return f"""CASE shape WHEN 'EqualPower' THEN sin({t}*pi()/2) WHEN 'SCurve' THEN (1-cos({t}*pi()))/2
      WHEN 'DecibelLinear' THEN (pow(10.0::DOUBLE,{t}*60/20)-1)/(pow(10.0::DOUBLE,3)-1) ELSE {t} END"""


@query("prj09_timeline_fades", f"""
WITH t AS (SELECT rec_id, n, v, n/greatest(1,f-1)::DOUBLE AS t, unnest(['Linear','EqualPower','SCurve','DecibelLinear']) AS shape
  FROM (SELECT *, max(n) OVER (PARTITION BY rec_id)+1 AS f FROM v_sig))
SELECT rec_id, n, shape, round(v*{_law('t')},6)+0.0::DOUBLE AS faded_in, round(v*{_law('(1-t)')},6)+0.0::DOUBLE AS faded_out FROM t""")
def _(spark, d):
    s = V.sig(spark, d)
    t = s.join(P.frames_per_recording(s), "rec_id").withColumn("t", L.fade_position(F.col("n"), F.col("frames")))
    shapes = F.explode(F.array(*[F.lit(x) for x in ("Linear", "EqualPower", "SCurve", "DecibelLinear")]))
    return t.withColumn("shape", shapes).select(
        "rec_id", "n", "shape", r6(F.col("v") * L.fade_in(F.col("t"), F.col("shape"))).alias("faded_in"),
        r6(F.col("v") * L.fade_out(F.col("t"), F.col("shape"))).alias("faded_out"),
    )


_EDITS = "SELECT rec_id, b*1000+100 AS s, b*1000+350 AS e FROM (SELECT DISTINCT rec_id, n//1000 AS b FROM v_lr)"


def _ranges(spark, d):
    lr = V.lr(spark, d)
    return lr.select("rec_id", F.floor(F.col("n") / 1000).alias("b")).distinct().select(
        "rec_id", (F.col("b") * 1000 + 100).alias("start"), (F.col("b") * 1000 + 350).alias("end")
    )


@query("prj10_delete_ranges", f"""
WITH e AS ({_EDITS})
SELECT v.rec_id, v.ch, v.n-250*(CASE WHEN v.n%1000>=350 THEN v.n//1000+1 ELSE v.n//1000 END) AS n, round(v.v,6)+0.0::DOUBLE AS v
FROM v_stereo v WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.rec_id=v.rec_id AND v.n>=e.s AND v.n<e.e)""")
def _(spark, d):
    return P.delete_ranges(V.stereo(spark, d), _ranges(spark, d)).withColumn("v", r6("v"))


@query("prj10_insert_silence", """
WITH e AS (SELECT DISTINCT rec_id, (n//1000)*1000+100 AS s FROM v_lr)
SELECT rec_id, ch, n+10*(CASE WHEN n%1000>=100 THEN n//1000+1 ELSE n//1000 END) AS n, round(v,6)+0.0::DOUBLE AS v FROM v_stereo
UNION ALL SELECT rec_id, unnest([CAST(0 AS BIGINT),CAST(1 AS BIGINT)]) AS ch, n, 0.0::DOUBLE AS v
  FROM (SELECT rec_id, s+10*(s//1000)+unnest(range(10)) AS n FROM e)""")
def _(spark, d):
    inserts = _ranges(spark, d).select("rec_id", "start", F.lit(10).cast("long").alias("length"))
    return P.insert_silence(V.stereo(spark, d), inserts).withColumn("v", r6("v"))


@query("prj10_keep_range", """SELECT rec_id, ch, n-s AS n, round(v,6)+0.0::DOUBLE AS v FROM (SELECT *, f//4 AS s, f-f//4 AS e FROM
  (SELECT *, max(n) OVER (PARTITION BY rec_id)+1 AS f FROM v_stereo)) WHERE n>=s AND n<e""")
def _(spark, d):
    s = V.stereo(spark, d)
    quarter = F.floor(F.col("frames") / 4)
    ranges = P.frames_per_recording(s).select("rec_id", quarter.alias("start"), (F.col("frames") - quarter).alias("end"))
    return P.keep_range(s, ranges).withColumn("v", r6("v"))


@query("prj11_mix", """SELECT rec_id, ch, n, round(v*0.25::DOUBLE+v*0.5::DOUBLE*0.75::DOUBLE,6)+0.0::DOUBLE AS v FROM v_stereo""")
def _(spark, d):
    s = V.stereo(spark, d)
    return P.mix(s, s.withColumn("v", F.col("v") * 0.5), 0.75).withColumn("v", r6("v"))


@query("prj11_residual_levels", """WITH q AS (SELECT rec_id, v-greatest(-32768,least(32767,round_even(v*32768,0)))/32768 AS x FROM v_sig)
  SELECT rec_id, round(max(abs(x)),9) AS peak, round(sqrt(avg(x*x)),9) AS rms FROM q GROUP BY rec_id""")
def _(spark, d):
    s = V.sig(spark, d)
    q = P.quantise(s, 16).drop("code")
    return P.signal_levels(P.residual(s, q)).select("rec_id", r6("peak", 9).alias("peak"), r6("rms", 9).alias("rms"))


@query("prj13_quantise", """SELECT rec_id, ch, n, CAST(greatest(-32768,least(32767,round_even(v*32768,0))) AS BIGINT) AS code,
  round(greatest(-32768,least(32767,round_even(v*32768,0)))/32768,6)+0.0::DOUBLE AS v FROM v_stereo""")
def _(spark, d):
    return P.quantise(V.stereo(spark, d), 16).withColumn("v", r6("v"))


@query("prj13_exact_16_bit", """SELECT rec_id, bool_and(v*32768=trunc(v*32768) AND v*32768 BETWEEN -32768 AND 32767) AS exact_16_bit FROM v_stereo GROUP BY rec_id""")
def _(spark, d):
    return P.exact_16_bit(V.stereo(spark, d))


@query("prj14_mono_choice", """
WITH e AS (SELECT rec_id, sum(l*l) AS el, sum(r*r) AS er, sum((l+r)*(l+r)*0.25::DOUBLE) AS em FROM v_lr GROUP BY rec_id),
c AS (SELECT rec_id, CASE WHEN em>=0.25*greatest(el,er) THEN 'mix' WHEN el>=er THEN 'left' ELSE 'right' END AS source FROM e)
SELECT rec_id, n, round(CASE source WHEN 'mix' THEN (l+r)*0.5::DOUBLE WHEN 'left' THEN l ELSE r END,6)+0.0::DOUBLE AS v, source FROM v_lr JOIN c USING (rec_id)""")
def _(spark, d):
    return P.to_mono(V.lr(spark, d)).withColumn("v", r6("v"))


@query("prj15_recognition_gain", """SELECT rec_id, round(p,6) AS peak, round(CASE WHEN p<=1e-8 THEN 1.0 WHEN p<0.15 THEN least(20.0,0.8/p) ELSE least(1.0,0.98/p) END,6) AS gain
  FROM (SELECT rec_id, max(abs(v)) AS p FROM v_stereo GROUP BY rec_id)""")
def _(spark, d):
    return P.recognition_gain(V.stereo(spark, d)).select("rec_id", r6("peak").alias("peak"), r6("gain").alias("gain"))


@query("agg01_file_statistics", """SELECT rec_id, ch, round(max(abs(v)),6) AS peak, round(sqrt(avg(v*v)),6) AS rms, round(avg(v)*100,6)+0.0::DOUBLE AS dc_percent,
  CAST(count(CASE WHEN abs(v)>=0.999969 THEN 1 END) AS BIGINT) AS clipped, CAST(0 AS BIGINT) AS invalid, CAST(count(*) AS BIGINT) AS frames FROM v_stereo GROUP BY rec_id, ch""")
def _(spark, d):
    out = S.file_statistics(V.stereo(spark, d))
    return out.withColumns({c: r6(c) for c in ("peak", "rms", "dc_percent")})


@query("agg01_statistics_by_channel", """SELECT rec_id, round(20*log10(max(abs(l))),6)+0.0::DOUBLE AS peak_db_l, round(20*log10(max(abs(r))),6)+0.0::DOUBLE AS peak_db_r,
  round(20*log10(sqrt(avg(l*l))),6)+0.0::DOUBLE AS rms_db_l, round(20*log10(sqrt(avg(r*r))),6)+0.0::DOUBLE AS rms_db_r,
  CAST(count(CASE WHEN abs(l)>=0.999969 THEN 1 END)+count(CASE WHEN abs(r)>=0.999969 THEN 1 END) AS BIGINT) AS clipped FROM v_lr GROUP BY rec_id""")
def _(spark, d):
    out = S.statistics_by_channel(S.file_statistics(V.stereo(spark, d)))
    return out.withColumns({c: r6(c) for c in out.columns if "_db_" in c})


@query("agg02_block_peaks", "SELECT rec_id, n//256 AS block, round(max(abs(v)),6) AS peak FROM v_stereo GROUP BY rec_id, n//256")
def _(spark, d):
    return S.block_peaks(V.stereo(spark, d)).withColumn("peak", r6("peak"))


@query("agg03_block_activity", """WITH m AS (SELECT rec_id, n//256 AS block, n, max(abs(v)) AS a FROM v_stereo GROUP BY rec_id, n//256, n),
 k AS (SELECT *, row_number() OVER (PARTITION BY rec_id, block ORDER BY a) AS k, count(*) OVER (PARTITION BY rec_id, block) AS c FROM m)
 SELECT rec_id, block, round(a,6) AS activity FROM k WHERE k=CAST(floor((c-1)*0.75) AS BIGINT)+1""")
def _(spark, d):
    return S.block_activity(V.stereo(spark, d)).withColumn("activity", r6("activity"))


_PYR = """p0 AS (SELECT rec_id, ch, n//64 AS bin, min(v) AS mn, max(v) AS mx, avg(v*v) AS ms FROM v_stereo GROUP BY 1,2,3),
p1 AS (SELECT rec_id, ch, bin//4 AS bin, min(mn) AS mn, max(mx) AS mx, avg(ms) AS ms FROM (SELECT *, max(bin) OVER (PARTITION BY rec_id, ch) AS b FROM p0) WHERE b+1>64 GROUP BY 1,2,3),
p2 AS (SELECT rec_id, ch, bin//4 AS bin, min(mn) AS mn, max(mx) AS mx, avg(ms) AS ms FROM (SELECT *, max(bin) OVER (PARTITION BY rec_id, ch) AS b FROM p1) WHERE b+1>64 GROUP BY 1,2,3),
p3 AS (SELECT rec_id, ch, bin//4 AS bin, min(mn) AS mn, max(mx) AS mx, avg(ms) AS ms FROM (SELECT *, max(bin) OVER (PARTITION BY rec_id, ch) AS b FROM p2) WHERE b+1>64 GROUP BY 1,2,3),
pyr AS (SELECT 0 AS lev, * FROM p0 UNION ALL SELECT 1, * FROM p1 UNION ALL SELECT 2, * FROM p2 UNION ALL SELECT 3, * FROM p3)"""


def _pyramid(spark, d):
    s = V.stereo(spark, d)
    return s, S.pyramid(s)


@query("agg04_pyramid", f"WITH {_PYR} SELECT rec_id, ch, lev AS level, bin, round(mn,6)+0.0::DOUBLE AS mn, round(mx,6)+0.0::DOUBLE AS mx, round(ms,9)+0.0::DOUBLE AS ms FROM pyr")
def _(spark, d):
    _, p = _pyramid(spark, d)
    return p.withColumns({"mn": r6("mn"), "mx": r6("mx"), "ms": r6("ms", 9)})


@query("agg05_range_summary", f"""WITH {_PYR},
q AS (SELECT rec_id, b*1000 AS s0, b*1000+CASE b%3 WHEN 0 THEN 100 WHEN 1 THEN 300 ELSE 700 END AS s1 FROM (SELECT DISTINCT rec_id, n//1000 AS b FROM v_lr WHERE n%1000=999)),
w AS (SELECT *, CASE WHEN s1-s0<128 THEN -1 WHEN (s1-s0)//256>=2 THEN 1 ELSE 0 END AS lev FROM q),
x AS (SELECT w.rec_id, p.ch, s0, s1, mn, mx, ms FROM w JOIN pyr p ON p.rec_id=w.rec_id AND p.lev=w.lev AND p.bin>=s0//CASE w.lev WHEN 1 THEN 256 ELSE 64 END
  AND p.bin<=(s1-1)//CASE w.lev WHEN 1 THEN 256 ELSE 64 END
 UNION ALL SELECT w.rec_id, v.ch, s0, s1, v.v, v.v, v.v*v.v FROM w JOIN v_stereo v ON v.rec_id=w.rec_id AND w.lev=-1 AND v.n>=s0 AND v.n<s1)
SELECT rec_id, ch, s0, s1, round(min(mn),6)+0.0::DOUBLE AS mn, round(max(mx),6)+0.0::DOUBLE AS mx, round(sqrt(avg(ms)),6) AS rms FROM x GROUP BY 1,2,3,4""")
def _(spark, d):
    s, p = _pyramid(spark, d)
    whole = V.lr(spark, d).groupBy("rec_id", F.floor(F.col("n") / 1000).alias("b")).count().filter("count = 1000")
    size = F.when(F.col("b") % 3 == 0, 100).when(F.col("b") % 3 == 1, 300).otherwise(700)
    q = whole.select("rec_id", (F.col("b") * 1000).alias("s0"), (F.col("b") * 1000 + size).alias("s1"))
    return S.range_summary(s, p, q).withColumns({c: r6(c) for c in ("mn", "mx", "rms")})

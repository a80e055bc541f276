"""Queries for spectra and the detectors built on them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from phonolake.functions import text as X
from phonolake.operators import blocks as B
from phonolake.operators import detect as D
from phonolake.operators import intervals as I
from phonolake.operators import loudness as N
from phonolake.operators import segments as G
from phonolake.operators import spectrum as Z
from phonolake.operators import transforms as P
from phonolake.operators.weighting import weighted
from phonolake.plans import views as V
from phonolake.plans.q_blocks import BLK
from phonolake.plans.q_segments import SIL, _silences
from phonolake.plans.q_transcripts import _second
from phonolake.plans.q_transforms import r6
from phonolake.plans.registry import query
from phonolake.session import stage

SIZE, HOP = 64, 32

# Both channels, 64-sample frames every 32 samples, Hann, transformed by sums: spc per channel, spg the mean power of both.
SPG = """fq AS (SELECT rec_id, ch, n, v, unnest([n//32, n//32-1]) AS frame FROM v_stereo), fm AS (SELECT rec_id, max(n) AS mx FROM v_lr GROUP BY 1),
fx AS (SELECT fq.rec_id, ch, frame, n-frame*32 AS i, v*(0.5-0.5*cos(2*pi()*(n-frame*32)/64)) AS x FROM fq JOIN fm ON fm.rec_id=fq.rec_id WHERE frame>=0 AND frame*32+63<=mx AND n-frame*32<64),
spc AS (SELECT rec_id, ch, frame, bin, (pow(sum(x*cos(2*pi()*bin*i/64)),2)+pow(sum(x*sin(2*pi()*bin*i/64)),2))*pow(2/32.0::DOUBLE,2) AS p FROM fx, (SELECT unnest(range(33)) AS bin) GROUP BY 1,2,3,4),
spg AS (SELECT rec_id, frame, bin, avg(p) AS p FROM spc GROUP BY 1,2,3)"""


def _spec(spark, d):
    """Spectra of both channels."""
    return stage(Z.spectrum(Z.framed(V.stereo(spark, d), SIZE, HOP)), "spectrum")


def _mean_spec(spark, d):
    """Their mean power, as channel 0."""
    return Z.mean_spectrum(Z.framed(V.stereo(spark, d), SIZE, HOP)).select(
        "rec_id", F.lit(0).cast("long").alias("ch"), "frame", "bin", "p")


_W = {
    "Hann": "0.5-0.5*cos({a})", "Hamming": "0.54-0.46*cos({a})", "Blackman": "0.42-0.5*cos({a})+0.08*cos(2*{a})",
    "BlackmanHarris": "0.35875-0.48829*cos({a})+0.14128*cos(2*{a})-0.01168*cos(3*{a})",
    "Nuttall": "0.355768-0.487396*cos({a})+0.144232*cos(2*{a})-0.012604*cos(3*{a})",
    "FlatTop": "0.21557895-0.41663158*cos({a})+0.277263158*cos(2*{a})-0.083578947*cos(3*{a})+0.006947368*cos(4*{a})",
    "Gaussian": "exp(-0.5*pow((i-32)/(0.4*32),2))",
    "Tukey": "CASE WHEN i<16 THEN 0.5*(1-cos(pi()*i/16)) WHEN i>48 THEN 0.5*(1-cos(pi()*(64-i)/16)) ELSE 1 END",
}
_BES = "(1" + "".join(f"+pow({{q}},{k})/{float(math.factorial(k)) ** 2!r}::DOUBLE" for k in range(1, 36)) + ")"
_W["Kaiser"] = "CASE WHEN i<=0 THEN 0 ELSE " + _BES.format(q="(8.6*8.6*(1-pow((i-32)/32,2))/4)") + "/" + _BES.format(q="(8.6*8.6/4)") + " END"


@query("fun16_window_energies", "WITH k AS (SELECT rec_id, frame, v, CAST(i AS DOUBLE) AS i, unnest([" + ",".join(f"'{k}'" for k in Z.WINDOWS) + "]) AS kind FROM v_frames) SELECT rec_id, frame, kind, round(sum(pow(v*CASE kind "
       + " ".join(f"WHEN '{k}' THEN {_W[k].format(a='(2*pi()*i/64)')}" for k in Z.WINDOWS) + " END,2)),8) AS energy FROM k GROUP BY 1,2,3")
def _(spark, d):
    return Z.windowed_energy(V.frames(spark, d), 64).withColumn("energy", r6("energy", 8))


def _cheb_sql(length: int, db: float) -> str:
    m, beta = length - 1, math.cosh(math.acosh(10 ** (db / 20)) / (length - 1))
    x = f"({beta!r}::DOUBLE*cos(pi()*k/{length}))"
    t = f"CASE WHEN abs({x})<=1 THEN cos({m}*acos(least(1,greatest(-1,{x})))) ELSE pow(sign({x}),{m})*cosh({m}*acosh(greatest(1,abs({x})))) END"
    return (f"ck AS (SELECT unnest(range({length})) AS k), cr AS (SELECT a.k AS i, sum(({t.replace('*k/', '*b.k/')})*cos(2*pi()*b.k*(a.k-{m / 2})/{length})) AS w FROM ck a, ck b GROUP BY 1), "
            "cheb AS (SELECT i, w/max(abs(w)) OVER () AS w FROM cr)")


@query("fun16_chebyshev_energies", f"WITH {_cheb_sql(64, 60.0)} SELECT rec_id, frame, round(sum(pow(v*w,2)),8) AS energy FROM v_frames JOIN cheb ON cheb.i=v_frames.i GROUP BY 1,2")
def _(spark, d):
    w = Z.window_table(spark, 64).filter("kind = 'DolphChebyshev'")
    return V.frames(spark, d).join(w, "i").groupBy("rec_id", "frame").agg(r6(F.sum(F.pow(F.col("v") * F.col("w"), 2)), 8).alias("energy"))


@query("fun16_overlap_gain", f"WITH {_cheb_sql(64, 60.0)}, ki AS (SELECT CAST(i AS DOUBLE) AS i, unnest([" + ",".join(f"'{k}'" for k in Z.WINDOWS) + "]) AS kind FROM (SELECT unnest(range(64)) AS i)), "
       + "wn AS (SELECT kind, CAST(i AS BIGINT) AS i, CASE kind " + " ".join(f"WHEN '{k}' THEN {_W[k].format(a='(2*pi()*i/64)')}" for k in Z.WINDOWS) + " END AS w FROM ki UNION ALL SELECT 'DolphChebyshev', i, w FROM cheb), "
       + """fr AS (SELECT rec_id, max(n)+1 AS f FROM v_sig GROUP BY 1), cs AS (SELECT rec_id, n FROM v_sig JOIN fr USING (rec_id) WHERE n>=63 AND n<((f-64)//32)*32+32),
ov AS (SELECT rec_id, n, kind, sum(w) AS w FROM cs JOIN wn ON wn.i%32=cs.n%32 GROUP BY 1,2,3), hp AS (SELECT rec_id, n%32 AS pl, kind, any_value(w) AS w, count(*) AS c FROM ov GROUP BY 1,2,3),
x AS (SELECT rec_id, kind, sum(c) AS covered, avg(w) AS m, max(w)-min(w) AS r FROM hp GROUP BY 1,2)
SELECT rec_id, kind, CAST(covered AS BIGINT) AS covered, round(m,8) AS constant, round(CASE WHEN abs(m)>=1e-12 THEN r/abs(m) END,8) AS ripple, coalesce(r/abs(m)<=1e-6 AND abs(m)>=1e-12,false) AS satisfied FROM x""")
def _(spark, d):
    out = Z.overlap_gain(V.sig(spark, d).select("rec_id", "n"), Z.window_table(spark, 64), 64, 32)
    return out.withColumns({"constant": r6("constant", 8), "ripple": r6("ripple", 8)})


@query("fun17_dft_frames", """SELECT rec_id, frame, bin, round((pow(sum(x*cos(2*pi()*bin*i/64)),2)+pow(sum(x*sin(2*pi()*bin*i/64)),2))*pow(2/32.0::DOUBLE,2),9) AS p
 FROM (SELECT rec_id, frame, i, v*(0.5-0.5*cos(2*pi()*i/64)) AS x FROM v_frames), (SELECT CAST(unnest(range(33)) AS INT) AS bin) GROUP BY 1,2,3""")
def _(spark, d):
    return Z.dft_sums(V.frames(spark, d), 64, 33).select("rec_id", "frame", "bin", r6("p", 9).alias("p"))


@query("fun17_spectrogram", f"WITH {SPG} SELECT rec_id, frame, CAST(bin AS INT) AS bin, round(p,8) AS p FROM spg")
def _(spark, d):
    return _mean_spec(spark, d).select("rec_id", "frame", "bin", r6("p", 8).alias("p"))


@query("fun18_log_bins", "SELECT o_orderkey, round(CASE WHEN o_totalprice/20<=30 THEN 0 WHEN o_totalprice/20>=16000 THEN 95 ELSE ln(o_totalprice/20/30)/ln(16000/30.0::DOUBLE)*95 END,6) AS position FROM orders")
def _(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", r6(Z.log_bin(F.col("o_totalprice") / 20, 30.0, 16000.0, 96)).alias("position"))


_HW = "list_max(list_transform(range(1,13), lambda k: CASE WHEN f*k>=500 OR abs(bin-f*k*0.064)/greatest(1,f*k*0.03*0.064)>=1 THEN 0.0::DOUBLE WHEN abs(bin-f*k*0.064)/greatest(1,f*k*0.03*0.064)<=0.5 THEN 1.0::DOUBLE ELSE 0.5+0.5*cos(pi()*(abs(bin-f*k*0.064)/greatest(1,f*k*0.03*0.064)-0.5)*2) END))"


@query("fun19_harmonic_mask", f"""WITH {SPG}, w AS (SELECT rec_id, bin, p, {_HW} AS w FROM (SELECT rec_id, bin, p, 60.0::DOUBLE+rec_id*20 AS f FROM spg)) SELECT rec_id, round(sum(p*w)/sum(p),6) AS share FROM w GROUP BY rec_id""")
def _(spark, d):
    weight = Z.harmonic_weight(F.col("bin"), 60.0 + F.col("rec_id") * 20, SIZE / 1000.0, 1000.0)
    return _mean_spec(spark, d).groupBy("rec_id").agg(r6(F.sum(F.col("p") * weight) / F.sum("p")).alias("share"))


@query("fun20_connected_regions")
def _(spark, d):
    cells = stage(_mean_spec(spark, d), "spectrum").select("rec_id", "frame", "bin", Z.magnitude_db(F.col("p")).alias("db"))
    return Z.connected_regions(cells).groupBy("rec_id", "label").agg(
        F.count(F.lit(1)).alias("cells"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"),
        F.min("bin").alias("low_bin"), F.max("bin").alias("high_bin"))


def _curve_sql(c):
    h = lambda us, f: f"sqrt(1+pow(2*pi()*{f}*{us!r}::DOUBLE*1e-6,2))"
    def raw(f):
        out = f"{h(c[2], f)}/{h(c[1], f)}"
        if c[3] > 0:
            out += f"/pow({h(c[3], f)},{c[5] / 6.0!r}::DOUBLE)"
        if c[4] > 0:
            out += f"*(2*pi()*{f}*{c[4]!r}::DOUBLE*1e-6)/{h(c[4], f)}"
        return out
    return f"20*log10(greatest(1e-12,({raw('hz')})/({raw('1000.0::DOUBLE')})))"


@query("fun21_playback_curves", "WITH h AS (SELECT p_partkey, p_retailprice*10 AS hz FROM part), e AS (SELECT p_partkey, hz, unnest([" + ",".join(f"'{c[0]}'" for c in Z.CURVES) + "]) AS curve FROM h) SELECT p_partkey, curve, round(CASE curve "
       + " ".join(f"WHEN '{c[0]}' THEN {_curve_sql(c)}" for c in Z.CURVES) + " END,6)+0.0::DOUBLE AS response_db, round(10*log10((1+pow(2*pi()*hz*15e-6,2))/(1+pow(2*pi()*hz*50e-6,2))),6)+0.0::DOUBLE AS emphasis_db FROM e")
def _(spark, d):
    hz = F.col("p_retailprice") * 10
    rows = F.array(*[F.struct(F.lit(c[0]).alias("curve"), r6(Z.curve_db(hz, c)).alias("response_db")) for c in Z.CURVES])
    return V.table(spark, d, "part").select("p_partkey", r6(Z.emphasis_db(hz)).alias("emphasis_db"), F.inline(rows))


@query("fun15_k_weighting", "SELECT rec_id, n//100 AS sub, round(sum(v*v)/100,9) AS ms FROM v_k GROUP BY 1,2 HAVING count(*)=200")
def _(spark, d):
    heard = weighted(V.stereo(spark, d), V.LR_RATE, "K", response=V.K_TAPS)
    return N.sub_blocks(heard, V.LR_RATE).withColumn("ms", r6("ms", 9))


def _hummed(spark, d):
    """Mains hum of 50 Hz and its octave is planted in every other recording, so that both decisions occur."""
    n = F.col("n")
    hum = 0.3 * F.sin(2 * math.pi * 50 * n / 1000) + 0.2 * F.sin(2 * math.pi * 100 * n / 1000)
    return V.stereo(spark, d).withColumn("v", F.col("v") + F.when(F.col("rec_id") % 2 == 0, hum).otherwise(0.0))


_HUM = """hv AS (SELECT rec_id, ch, n, v+CASE WHEN rec_id%2=0 THEN 0.3*sin(2*pi()*50*n/1000)+0.2*sin(2*pi()*100*n/1000) ELSE 0 END AS v FROM v_stereo), hm AS (SELECT rec_id, max(n) AS mx FROM v_lr GROUP BY 1),
hf AS (SELECT hq.rec_id, ch, frame, n-frame*256 AS i, v FROM (SELECT rec_id, ch, n, v, unnest([n//256, n//256-1]) AS frame FROM hv) hq JOIN hm ON hm.rec_id=hq.rec_id WHERE frame>=0 AND frame*256+511<=mx),
hw AS (SELECT rec_id, frame FROM hf GROUP BY 1,2 HAVING 10*log10(greatest(1e-12,sum(v*v)/1024))>-100 AND sum(CASE WHEN v=0 THEN 1.0::DOUBLE ELSE 0 END)/1024<0.95),
hp AS (SELECT rec_id, ch, frame, bin, (pow(sum(v*w*cos(2*pi()*bin*i/512)),2)+pow(sum(v*w*sin(2*pi()*bin*i/512)),2))*pow(2/256.0::DOUBLE,2) AS p FROM (SELECT *, 0.5-0.5*cos(2*pi()*i/512) AS w FROM hf SEMI JOIN hw USING (rec_id, frame)), (SELECT unnest(range(1,235)) AS bin) GROUP BY 1,2,3,4),
ha AS (SELECT rec_id, bin, avg(p) AS p FROM hp GROUP BY 1,2), hg AS (SELECT 45+i*0.25::DOUBLE AS f, h FROM (SELECT unnest(range(81)) AS i), (SELECT CAST(unnest(range(1,9)) AS INT) AS h) WHERE (45+i*0.25::DOUBLE)*h<450),
hl AS (SELECT rec_id, f, h, avg(CASE WHEN abs(bin*1.953125-f*h)<=2 THEN p END) AS ln, median(CASE WHEN abs(bin*1.953125-f*h)>=3.5 THEN p END) AS fl FROM ha JOIN hg ON abs(bin*1.953125-f*h)<=8 GROUP BY 1,2,3),
hx AS (SELECT *, 10*log10(greatest(1e-18,ln)/greatest(1e-18,fl)) AS x, 10*log10(greatest(1e-18,ln)) AS db FROM hl WHERE ln IS NOT NULL AND fl IS NOT NULL),
hc AS (SELECT rec_id, f, sum(CASE WHEN hit THEN greatest(0,x-3)/sqrt(h) ELSE 0 END) AS sc, count(*) FILTER (hit) AS su, max(h) FILTER (hit) AS hi, coalesce(bool_or(hit AND h<=2),false) AS lo, coalesce(avg(x) FILTER (hit),0) AS ex, list(h) FILTER (hit) AS fam FROM (SELECT *, x>=5.5 AND db>-85 AS hit FROM hx) GROUP BY 1,2),
hb AS (SELECT * FROM hc QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY sc DESC, f)=1), hr AS (SELECT hb.rec_id, max(hc.sc) AS rv FROM hb JOIN hc ON hc.rec_id=hb.rec_id AND abs(hc.f-hb.f)>=2.5 GROUP BY 1),
hk AS (SELECT rec_id, max(n)+1 AS fr, least(40,(max(n)+1)//2048) AS c FROM v_lr GROUP BY 1 HAVING max(n)+1>=2048),
hd AS (SELECT hk.rec_id, blk, CASE WHEN c=1 THEN 0 ELSE CAST(round_even(blk*(fr-2048)/(c-1.0::DOUBLE),0) AS BIGINT) END AS st FROM hk, (SELECT unnest(range(40)) AS blk) WHERE blk<c),
ht AS (SELECT hb.rec_id, h, o, greatest(5,f*h+o*12.0::DOUBLE) AS hz FROM (SELECT rec_id, f, unnest(fam) AS h FROM hb WHERE su>=2 AND lo) hb, (SELECT unnest([-1,0,1]) AS o) WHERE f*h+12<480),
hs AS (SELECT hv.rec_id, ch, blk, h, o, pow(sum(v*(0.5-0.5*cos(2*pi()*(n-st)/2048))*cos(2*pi()*hz*(n-st)/1000)),2)+pow(sum(v*(0.5-0.5*cos(2*pi()*(n-st)/2048))*sin(2*pi()*hz*(n-st)/1000)),2) AS q FROM hv JOIN hd ON hd.rec_id=hv.rec_id AND n>=st AND n<st+2048 JOIN ht ON ht.rec_id=hv.rec_id GROUP BY 1,2,3,4,5),
hz AS (SELECT rec_id, blk, h, sum(q) FILTER (o=0)*pow(4/2048.0::DOUBLE,2)/2 AS ln, sum(q) FILTER (o<>0)*pow(4/2048.0::DOUBLE,2)/4 AS fl FROM hs GROUP BY 1,2,3),
hh AS (SELECT rec_id, blk FROM hz WHERE 10*log10(greatest(1e-18,ln))-10*log10(greatest(1e-18,fl))>=5.5 AND 10*log10(greatest(1e-18,ln))>-85 GROUP BY 1,2 HAVING count(*)>=2 AND min(h)<=2),
hpp AS (SELECT hb.*, sc-coalesce(rv,0) AS sep, coalesce(k.k,0)/coalesce(hk.c,1)::DOUBLE AS pe FROM hb LEFT JOIN hr USING (rec_id) LEFT JOIN hk USING (rec_id) LEFT JOIN (SELECT rec_id, count(*) AS k FROM hh GROUP BY 1) k USING (rec_id)),
he AS (SELECT *, su>=2 AND sc>4 AND lo AND pe>=0.68 AND sep>=0.5 AS det, least(1,greatest(0,(sep-0.5)/7.5)) AS ap FROM hpp),
hum AS (SELECT rec_id, round_even(f/0.1::DOUBLE,0)*0.1::DOUBLE AS hum_hz, coalesce(hi,1) AS harmonics, su, ex, sep, pe, round_even(least(65,greatest(25,28+ex*1.35)),0) AS q, CASE WHEN det THEN round_even(least(0.9,greatest(0.35,(ex-3)/20))/0.05::DOUBLE,0)*0.05::DOUBLE ELSE 0.0::DOUBLE END AS amount,
 CASE WHEN det THEN least(0.98,greatest(0,0.16+su*0.07+least(1,greatest(0,(ex-6)/12))*0.27+pe*0.28+ap*0.10)) ELSE least(0.54,greatest(0,least(1,greatest(0,(ex-8)/12))*0.20+pe*0.24+ap*0.10)) END AS conf, det FROM he)"""


def _hum(spark, d):
    s = stage(_hummed(spark, d), "hummed")
    power = stage(Z.programme_spectra(s, 512).groupBy("rec_id", "bin").agg(F.avg("p").alias("p")), "hum-power")
    comb = stage(Z.hum_comb(power, 1000 / 512, 1000.0), "hum-comb")
    return Z.hum_estimate(comb, Z.hum_persistence(s, comb, V.LR_RATE))


@query("agg19_hum_comb", f"WITH {_HUM} SELECT rec_id, round(hum_hz,4) AS hum_hz, CAST(harmonics AS INT) AS harmonics, CAST(su AS BIGINT) AS supported, round(ex,4) AS mean_excess, round(sep,4) AS separation, round(pe,6) AS persistence, q, round(amount,4) AS amount, round(conf,5) AS confidence, det AS detected FROM hum")
def _(spark, d):
    return _hum(spark, d).withColumns({
        "hum_hz": r6("hum_hz", 4), "mean_excess": r6("mean_excess", 4), "separation": r6("separation", 4), "persistence": r6("persistence"),
        "amount": r6("amount", 4), "confidence": r6("confidence", 5), "harmonics": F.col("harmonics").cast("int")})


_DYN = """db AS (SELECT rec_id, n//50 AS k, sum(l*l+r*r) AS p, sum(pow((l+r)/2,2)) AS m, sum(pow((l-r)/2,2)) AS s, count(*) AS c, count(CASE WHEN l=0 THEN 1 END)+count(CASE WHEN r=0 THEN 1 END) AS z FROM v_lr GROUP BY 1,2),
dg AS (SELECT *, 10*log10(greatest(1e-12,p/(2*c))) AS db FROM db), dl AS (SELECT * FROM dg WHERE db>-100 AND z<2*c*0.95), dq AS (SELECT rec_id, quantile_cont(db,0.1) AS a, quantile_cont(db,0.3) AS t, quantile_cont(db,0.6) AS e FROM dl GROUP BY 1),
ds AS (SELECT rec_id, 10*log10(sum(s)/sum(m)) AS sm FROM dl JOIN dq USING (rec_id) WHERE db>=t GROUP BY 1), dx AS (SELECT rec_id, least(1,greatest(-1,sum(l*r)/greatest(1e-12,sqrt(sum(l*l)*sum(r*r))))) AS co FROM v_lr GROUP BY 1),
dyn AS (SELECT rec_id, a AS floor_db, e AS active_db, greatest(0,e-a) AS dynamic_db, co, sm FROM dq JOIN ds USING (rec_id) JOIN dx USING (rec_id))"""


@query("agg20_global_dynamics", f"WITH {_DYN} SELECT rec_id, round(floor_db,5) AS floor_db, round(active_db,5) AS active_db, round(dynamic_db,5) AS dynamic_db, round(co,6)+0.0::DOUBLE AS correlation, round(sm,5)+0.0::DOUBLE AS side_to_mid_db FROM dyn")
def _(spark, d):
    out = D.global_dynamics(V.lr(spark, d), V.LR_RATE)
    return out.withColumns({"floor_db": r6("floor_db", 5), "active_db": r6("active_db", 5), "dynamic_db": r6("dynamic_db", 5), "correlation": r6("correlation"), "side_to_mid_db": r6("side_to_mid_db", 5)})


@query("agg21_band_energies", f"""WITH {SPG} SELECT rec_id, frame, round(10*log10(greatest(1e-18,coalesce(sum(CASE WHEN bin BETWEEN 4 AND 8 THEN p END),0))),5)+0.0::DOUBLE AS low_db, round(10*log10(greatest(1e-18,coalesce(sum(CASE WHEN bin BETWEEN 13 AND 25 THEN p END),0))),5)+0.0::DOUBLE AS high_db FROM spg GROUP BY 1,2""")
def _(spark, d):
    out = Z.band_energies(_mean_spec(spark, d), {"low_db": (60, 130), "high_db": (200, 400)}, 1000 / SIZE)
    return out.select("rec_id", "frame", r6("low_db", 5).alias("low_db"), r6("high_db", 5).alias("high_db"))


_RUM = """re AS (SELECT rec_id, frame, 10*log10(greatest(1e-18,coalesce(sum(CASE WHEN bin BETWEEN 1 AND 2 THEN p END),0))) AS s, 10*log10(greatest(1e-18,coalesce(sum(CASE WHEN bin BETWEEN 4 AND 8 THEN p END),0))) AS b FROM spg GROUP BY 1,2),
rq AS (SELECT rec_id, median(r) AS m, avg(CASE WHEN r>=-20+0.55*17 THEN 1.0::DOUBLE ELSE 0 END) AS p FROM (SELECT rec_id, CASE WHEN s<=-90 THEN -200 ELSE s-b END AS r FROM re) GROUP BY 1), rc AS (SELECT *, least(1,greatest(0,(m+20)/17)) AS c FROM rq),
rum AS (SELECT rec_id, m AS ratio_db, p AS persistence, (c>=0.55 AND p>=0.5) AS det, CASE WHEN c>=0.55 AND p>=0.5 THEN round_even(least(40,greatest(28,28+least(1,greatest(0,(m+12)/18))*12)),0) ELSE 28.0::DOUBLE END AS cutoff_hz,
 CASE WHEN c>=0.55 AND p>=0.5 THEN c ELSE least(c,0.54) END AS conf FROM rc)"""


@query("agg21_rumble_decision", f"WITH {SPG}, {_RUM} SELECT rec_id, round(ratio_db,5)+0.0::DOUBLE AS ratio_db, round(persistence,6) AS persistence, det AS detected, cutoff_hz, round(conf,6) AS confidence FROM rum")
def _(spark, d):
    out = Z.rumble_decision(stage(_mean_spec(spark, d), "spectrum"), 1000 / SIZE, (5, 40), (60, 130))
    return out.withColumns({"ratio_db": r6("ratio_db", 5), "persistence": r6("persistence"), "confidence": r6("confidence")})


_QF = """qf AS (SELECT rec_id, frame FROM spg GROUP BY 1,2 HAVING sum(p)<1e-5)"""


def _quiet_profile(spark, d):
    spec = stage(_mean_spec(spark, d), "spectrum")
    quiet = spec.groupBy("rec_id", "frame").agg(F.sum("p").alias("t")).filter("t < 1e-5")
    return Z.noise_profile(spec, quiet)


@query("agg23_noise_profile", f"WITH {SPG}, {_QF} SELECT rec_id, CAST(bin AS INT) AS bin, round(avg(sqrt(p)),9) AS magnitude FROM spg SEMI JOIN qf USING (rec_id, frame) GROUP BY 1,2")
def _(spark, d):
    return _quiet_profile(spark, d).withColumn("magnitude", r6("magnitude", 9))


@query("win17_tonal_scrub", f"""WITH {SPG}, {_QF}, pr AS (SELECT rec_id, bin, avg(sqrt(p)) AS m FROM spg SEMI JOIN qf USING (rec_id, frame) GROUP BY 1,2),
s AS (SELECT rec_id, bin, m, median(m) OVER (PARTITION BY rec_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS f5, median(m) OVER (PARTITION BY rec_id ORDER BY bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS f3 FROM pr)
SELECT rec_id, CAST(bin AS INT) AS bin, round(least(m,CASE WHEN bin IN (0,32) THEN m WHEN bin IN (1,31) THEN f3 ELSE f5 END),9) AS scrubbed FROM s""")
def _(spark, d):
    return Z.tonal_scrub(_quiet_profile(spark, d), 33).select("rec_id", "bin", r6("scrubbed", 9).alias("scrubbed"))


_BURST = SPG + """, sm AS (SELECT rec_id, ch, frame, bin, (p+coalesce(lag(p) OVER w,0)+coalesce(lead(p) OVER w,0))/3 AS p FROM spc WINDOW w AS (PARTITION BY rec_id, ch, frame ORDER BY bin)), tt AS (SELECT rec_id, ch, frame, sum(p) AS t FROM sm GROUP BY 1,2,3),
cx AS (SELECT *, avg(p) OVER (PARTITION BY rec_id, ch, bin ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 3 PRECEDING) AS b, avg(p) OVER (PARTITION BY rec_id, ch, bin ORDER BY frame ROWS BETWEEN 2 FOLLOWING AND 5 FOLLOWING) AS a,
 count(*) OVER (PARTITION BY rec_id, ch, bin ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS n FROM sm), cb AS (SELECT cx.*, t, greatest(b,a,1e-18,t*1e-4) AS base FROM cx JOIN tt USING (rec_id, ch, frame)),
bu AS (SELECT rec_id, ch, frame, bin, p, t, base, 10*log10(greatest(1e-18,p/base)) AS c, 10*log10(greatest(1e-18,p/base))*sqrt(greatest(0,(p-base)/t)) AS s FROM cb WHERE n=13 AND bin BETWEEN 2 AND 29 AND t>1e-12),
sd AS (SELECT * FROM bu WHERE c>=9 AND s>=1.5)"""


@query("win18_burst_scores", f"WITH {_BURST} SELECT rec_id, ch, frame, CAST(bin AS INT) AS bin, round(c,5) AS contrast_db, round(s,5) AS score FROM sd")
def _(spark, d):
    out = Z.burst_scores(_spec(spark, d), 2, 6, 2, 29)
    return out.select("rec_id", "ch", "frame", "bin", r6("contrast_db", 5).alias("contrast_db"), r6("score", 5).alias("score"))


@query("win18_strongest_burst", f"WITH {_BURST}, k AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY s DESC, frame, bin, ch) AS k FROM sd) SELECT rec_id, ch, frame, CAST(bin AS INT) AS bin, round(s,5) AS score FROM k WHERE k=1")
def _(spark, d):
    return Z.strongest_burst(Z.burst_scores(_spec(spark, d), 2, 6, 2, 29)).select("rec_id", "ch", "frame", "bin", r6("score", 5).alias("score"))


# Growth one frame and one bin at a time, as a recursion stopped by its own rule.
_GROWN = """RECURSIVE bz AS (SELECT rec_id, ch, n, v+CASE WHEN n%1500>=700+ch*4 AND n%1500<740+ch*4 THEN (2.5::DOUBLE-ch)*sin(2*pi()*(200+rec_id*50)*n/1000) ELSE 0 END AS v FROM v_stereo),
""" + _BURST.replace("v_stereo", "bz") + """, lf(rec_id, ch, frame, bin, base, l) AS (SELECT rec_id, ch, frame, bin, base, frame FROM sd UNION ALL SELECT lf.rec_id, lf.ch, lf.frame, lf.bin, lf.base, l-1 FROM lf JOIN sm ON sm.rec_id=lf.rec_id AND sm.ch=lf.ch AND sm.bin=lf.bin AND sm.frame=l-1 WHERE lf.frame-l<=4 AND sm.p>2*lf.base),
ll AS (SELECT rec_id, ch, frame, bin, base, min(l) AS l FROM lf GROUP BY ALL),
rt(rec_id, ch, frame, bin, base, l, r) AS (SELECT *, frame FROM ll UNION ALL SELECT rt.rec_id, rt.ch, rt.frame, rt.bin, rt.base, l, r+1 FROM rt JOIN sm ON sm.rec_id=rt.rec_id AND sm.ch=rt.ch AND sm.bin=rt.bin AND sm.frame=r+1 WHERE r-l<=4 AND sm.p>2*rt.base),
rr AS (SELECT rec_id, ch, frame, bin, l, max(r) AS r FROM rt GROUP BY ALL HAVING max(r)-l+1<=4),
e0 AS (SELECT rr.*, sd.p-sd.base AS x, sd.c, sd.s, sd.t FROM rr JOIN sd USING (rec_id, ch, frame, bin)),
lo(rec_id, ch, frame, bin, x, b) AS (SELECT rec_id, ch, frame, bin, x, bin FROM e0 UNION ALL SELECT lo.rec_id, lo.ch, lo.frame, lo.bin, x, lo.b-1 FROM lo JOIN cb ON cb.rec_id=lo.rec_id AND cb.ch=lo.ch AND cb.frame=lo.frame AND cb.bin=lo.b-1 WHERE lo.b>2 AND cb.p>=1.8*cb.base AND cb.p-cb.base>=0.015*x),
hi(rec_id, ch, frame, bin, x, b) AS (SELECT rec_id, ch, frame, bin, x, bin FROM e0 UNION ALL SELECT hi.rec_id, hi.ch, hi.frame, hi.bin, x, hi.b+1 FROM hi JOIN cb ON cb.rec_id=hi.rec_id AND cb.ch=hi.ch AND cb.frame=hi.frame AND cb.bin=hi.b+1 WHERE hi.b<29 AND cb.p>=1.8*cb.base AND cb.p-cb.base>=0.015*x),
e1 AS (SELECT e0.*, lw.b AS low, hw.b AS high FROM e0 JOIN (SELECT rec_id, ch, frame, bin, min(b) AS b FROM lo GROUP BY ALL) lw USING (rec_id, ch, frame, bin) JOIN (SELECT rec_id, ch, frame, bin, max(b) AS b FROM hi GROUP BY ALL) hw USING (rec_id, ch, frame, bin)),
e2 AS (SELECT e1.rec_id, e1.ch, e1.frame, e1.bin, l, r, c, s, t, low, high, sum(CASE WHEN cb.bin BETWEEN 2 AND 29 AND cb.bin BETWEEN low-2 AND high+4 THEN greatest(0,p-base) ELSE 0 END) AS band, sum(CASE WHEN cb.bin BETWEEN 2 AND 29 THEN greatest(0,p-base) ELSE 0 END) AS whole,
 sum(CASE WHEN cb.bin BETWEEN low-2 AND high+4 THEN cb.b ELSE 0 END) AS e, sum(CASE WHEN cb.bin BETWEEN low-2 AND high+4 THEN cb.a ELSE 0 END) AS f FROM e1 JOIN (SELECT rec_id, ch, frame, bin, p, base, b, a FROM cb) cb ON cb.rec_id=e1.rec_id AND cb.ch=e1.ch AND cb.frame=e1.frame GROUP BY ALL),
gr AS (SELECT e2.rec_id, ch, frame, bin, greatest(0,(l-2)*32+32) AS st, least(mf*32+64,(r+4)*32+32) AS sp, frame*32+32 AS pk, greatest(0,(low-2)*15.625::DOUBLE) AS lh, least(500.0::DOUBLE,(high+4)*15.625::DOUBLE) AS hh, c, s
 FROM e2 JOIN (SELECT rec_id, max(frame) AS mf FROM spc GROUP BY 1) USING (rec_id) WHERE high-low+1<=greatest(12,bin*0.85) AND band>=0.55*whole AND greatest(e,f)<=4*least(e,f)+t*0.002)"""


def _bursts(spark, d):
    """Short tones are planted every 1.5 s, four samples later and weaker on the right."""
    n, ch = F.col("n"), F.col("ch")
    tone = (2.5 - ch) * F.sin(2 * math.pi * (200 + F.col("rec_id") * 50) * n / 1000)
    planted = (n % 1500 >= 700 + ch * 4) & (n % 1500 < 740 + ch * 4)
    s = V.stereo(spark, d).withColumn("v", F.col("v") + F.when(planted, tone).otherwise(0.0))
    return Z.grown_bursts(stage(Z.spectrum(Z.framed(s, SIZE, HOP)), "spectrum"), 2, 6, 2, 29, 4, HOP, SIZE, 1000.0)


@query("win18_grown_bursts", f"WITH {_GROWN} SELECT rec_id, ch, CAST(st AS BIGINT) AS \"start\", CAST(sp AS BIGINT) AS stop, CAST(pk AS BIGINT) AS peak, lh AS low_hz, hh AS high_hz, round(s,5) AS score FROM gr")
def _(spark, d):
    return _bursts(spark, d).select("rec_id", "ch", "start", "stop", "peak", "low_hz", "high_hz", r6("score", 5).alias("score"))


@query("win18_united_burst", f"""WITH {_GROWN}, pc AS (SELECT * FROM gr QUALIFY row_number() OVER (PARTITION BY rec_id, ch ORDER BY s DESC, frame, bin)=1), tp AS (SELECT * FROM pc QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY s DESC, ch)=1)
SELECT tp.rec_id, tp.ch, CAST(min(pc.st) AS BIGINT) AS "start", CAST(max(pc.sp) AS BIGINT) AS stop, CAST(tp.pk AS BIGINT) AS peak, min(pc.lh) AS low_hz, max(pc.hh) AS high_hz, round(tp.s,5) AS score, count(*) AS channels
FROM tp JOIN pc ON pc.rec_id=tp.rec_id AND abs(pc.pk-tp.pk)<=10 AND pc.sp>tp.st AND pc.st<tp.sp AND pc.hh>tp.lh AND pc.lh<tp.hh GROUP BY tp.rec_id, tp.ch, tp.pk, tp.s""")
def _(spark, d):
    out = Z.united_burst(_bursts(spark, d), 1000.0)
    return out.select("rec_id", "ch", "start", "stop", "peak", "low_hz", "high_hz", r6("score", 5).alias("score"), "channels")


@query("udx01_spectral_map", f"WITH {SPG} SELECT rec_id, ch, frame, round(sum(p*bin)/sum(p),5) AS centroid FROM spc GROUP BY 1,2,3")
def _(spark, d):
    def centroid(x):
        import numpy as np

        power = np.abs(x) ** 2
        return [float((power * np.arange(len(power))).sum() / power.sum())]

    return Z.spectral_map(Z.framed(V.stereo(spark, d), SIZE, HOP), centroid).select("rec_id", "ch", "frame", r6(F.col("value")[0], 5).alias("centroid"))


@query("join11_lag_correlation", """WITH k AS (SELECT CAST(unnest(range(1,33)) AS INT) AS lag) SELECT a.rec_id, lag, round(sum(a.v*b.v)/sqrt(sum(a.v*a.v)*sum(b.v*b.v)),6)+0.0::DOUBLE AS correlation FROM v_sig a, k, v_sig b WHERE b.rec_id=a.rec_id AND b.n=a.n+lag GROUP BY 1,2""")
def _(spark, d):
    return D.lag_correlations(V.sig(spark, d), list(range(1, 33))).withColumn("correlation", r6("correlation"))


_DELAY_SQL = """df AS (SELECT rec_id, n//2 AS k, l-lag(l) OVER w AS dl, r-lag(r) OVER w AS dr FROM v_lr WHERE n%2=0 WINDOW w AS (PARTITION BY rec_id ORDER BY n)), dgl AS (SELECT CAST(unnest(range(-8,9)) AS INT) AS lag),
dc AS (SELECT a.rec_id, lag, sum(a.dl*b.dr)/sqrt(sum(a.dl*a.dl)*sum(b.dr*b.dr)) AS c FROM df a, dgl, df b WHERE a.dl IS NOT NULL AND b.dr IS NOT NULL AND b.rec_id=a.rec_id AND b.k=a.k+lag GROUP BY 1,2),
dk AS (SELECT rec_id, lag, c, (SELECT max(c) FROM dc z WHERE z.rec_id=dc.rec_id AND z.lag=0) AS c0 FROM dc QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY c DESC, lag)=1),
dv AS (SELECT dk.rec_id, dk.lag, dk.c, dk.c-c0 AS gain, dk.c-coalesce(max(dc.c),-1) AS con, -dk.lag*2.0::DOUBLE AS ms FROM dk LEFT JOIN dc ON dc.rec_id=dk.rec_id AND abs(dc.lag-dk.lag)>1 GROUP BY dk.rec_id, dk.lag, dk.c, c0),
del AS (SELECT rec_id, lag, c, CASE WHEN lag<>0 AND c>=0.5 AND gain>=0.05 AND con>=0.08 THEN round_even(ms/0.01::DOUBLE,0)*0.01::DOUBLE ELSE 0.0::DOUBLE END AS delay_ms,
 CASE WHEN lag<>0 AND c>=0.5 AND gain>=0.05 AND con>=0.08 THEN least(0.95,greatest(0,greatest(0,c)*least(1,greatest(0,(abs(ms)-0.08)/0.52))*least(1,greatest(0,(gain-0.05)/0.25))*least(1,greatest(0,(con-0.08)/0.27)))) ELSE 0.0::DOUBLE END AS conf FROM dv)"""


@query("win22_channel_delay", """WITH sh AS (SELECT rec_id, n, l, CASE WHEN rec_id%2=0 THEN 0.9*coalesce(lag(l,6) OVER (PARTITION BY rec_id ORDER BY n),0)+0.1*r ELSE r END AS r FROM v_lr), """
       + "{delay} SELECT rec_id, lag AS best_lag, round(c,6)+0.0::DOUBLE AS best, round(delay_ms,4)+0.0::DOUBLE AS delay_ms, round(conf,6) AS confidence FROM del".replace("{delay}", _DELAY_SQL.replace("v_lr", "sh")))
def _(spark, d):
    # In every other recording the right channel follows the left by six samples.
    pairs = V.lr(spark, d)
    moved = pairs.select("rec_id", (F.col("n") + 6).alias("n"), F.col("l").alias("_l"))
    late = pairs.join(moved, ["rec_id", "n"], "left").withColumn(
        "r", F.when(F.col("rec_id") % 2 == 0, 0.9 * F.coalesce("_l", F.lit(0.0)) + 0.1 * F.col("r")).otherwise(F.col("r"))).drop("_l")
    return D.channel_delay(late, V.LR_RATE, 2, 16.0).select(
        "rec_id", "best_lag", r6("best").alias("best"), r6("delay_ms", 4).alias("delay_ms"), r6("confidence").alias("confidence"))


@query("win23_robust_delay", """WITH df AS (SELECT rec_id, n//1000 AS win, n//2 AS k, l-lag(l) OVER w AS dl, r-lag(r) OVER w AS dr FROM v_lr WHERE n%2=0 WINDOW w AS (PARTITION BY rec_id, n//1000 ORDER BY n)), g AS (SELECT unnest(range(-8,9)) AS lag),
c AS (SELECT a.rec_id, a.win, lag, CASE WHEN sqrt(sum(a.dl*a.dl)*sum(b.dr*b.dr))>1e-12 THEN sum(a.dl*b.dr)/sqrt(sum(a.dl*a.dl)*sum(b.dr*b.dr)) ELSE 0 END AS c FROM df a, g, df b WHERE a.dl IS NOT NULL AND b.dr IS NOT NULL AND b.rec_id=a.rec_id AND b.win=a.win AND b.k=a.k+lag GROUP BY 1,2,3),
k AS (SELECT *, row_number() OVER (PARTITION BY rec_id, win ORDER BY c DESC, lag) AS k FROM c), t AS (SELECT rec_id, win, c, -lag*2.0::DOUBLE AS ms FROM k WHERE k=1), m AS (SELECT rec_id, median(ms) AS med FROM t WHERE c>=0.1 GROUP BY 1),
s AS (SELECT rec_id, median(abs(ms-med)) AS mad, avg(CASE WHEN abs(ms-med)<=0.5 THEN 1.0::DOUBLE ELSE 0 END)*count(*) AS ag FROM t JOIN m USING (rec_id) WHERE c>=0.1 GROUP BY 1), a AS (SELECT rec_id, count(*) AS w FROM t GROUP BY 1)
SELECT rec_id, CAST(w AS BIGINT) AS windows, round(med,6)+0.0::DOUBLE AS median_ms, round(mad,6) AS mad_ms, round(ag/w,6) AS confidence FROM a JOIN m USING (rec_id) JOIN s USING (rec_id)""")
def _(spark, d):
    out = D.robust_delay(V.lr(spark, d), V.LR_RATE, 1000, 2, 16.0)
    return out.withColumns({c: r6(c) for c in ("median_ms", "mad_ms", "confidence")})


@query("win19_tempo")
def _(spark, d):
    s = V.stereo(spark, d)
    return D.tempo(s, V.LR_RATE, 32).withColumn("confidence", r6("confidence"))


@query("win21_pitch")
def _(spark, d):
    out = D.pitch(V.stereo(spark, d), V.LR_RATE, 256)
    return out.withColumns({"hz": r6("hz"), "confidence": r6("confidence")})


@query("win24_speed_report")
def _(spark, d):
    out = D.speed_report(V.stereo(spark, d), V.LR_RATE, 512, 128)
    return out.withColumns({c: r6(c) for c in ("peak_percent", "rms_percent", "confidence")})


@query("win29_exponential_meter", f"WITH b AS (SELECT rec_id, n//100 AS block, sum(l*r)/sqrt(sum(l*l)*sum(r*r)) AS c FROM v_lr GROUP BY 1,2) SELECT rec_id, block, round(list_reduce(list_prepend(0.0::DOUBLE, list(c) OVER (PARTITION BY rec_id ORDER BY block)), lambda s, x: s*0.85::DOUBLE+x*0.15::DOUBLE),6)+0.0::DOUBLE AS meter FROM b")
def _(spark, d):
    l, r = F.col("l"), F.col("r")
    blocks = V.lr(spark, d).groupBy("rec_id", F.floor(F.col("n") / 100).cast("long").alias("block")).agg((F.sum(l * r) / F.sqrt(F.sum(l * l) * F.sum(r * r))).alias("c"))
    return D.exponential_meter(blocks, "c").select("rec_id", "block", r6("meter").alias("meter"))


@query("win08_impulse_candidates", """WITH c AS (SELECT rec_id, ch, n, v, abs(v-(lag(v) OVER w+lead(v) OVER w)/2) AS x FROM v_stereo WINDOW w AS (PARTITION BY rec_id, ch ORDER BY n)),
b AS (SELECT DISTINCT rec_id, ch, n//25 AS block FROM c), h AS (SELECT b.rec_id, b.ch, b.block, x, v FROM b JOIN c ON b.rec_id=c.rec_id AND b.ch=c.ch AND c.n>=b.block*25-6 AND c.n<b.block*25+25+6),
m AS (SELECT rec_id, ch, block, median(x) AS md, sqrt(avg(v*v)) AS rms FROM h GROUP BY 1,2,3), d AS (SELECT rec_id, ch, block, any_value(m.md) AS md, any_value(rms) AS rms, median(abs(x-m.md)) AS mad FROM h JOIN m USING (rec_id, ch, block) GROUP BY 1,2,3),
t AS (SELECT rec_id, ch, block, md+(15-9.5)*greatest(1.4826*mad,0.25*md,rms*(0.008-0.0065),2e-7) AS th FROM d), o AS (SELECT c.*, th, x/th AS q FROM c JOIN t ON t.rec_id=c.rec_id AND t.ch=c.ch AND t.block=c.n//25 WHERE x>0.45*th),
g AS (SELECT *, n-row_number() OVER (PARTITION BY rec_id, ch ORDER BY n) AS g FROM o) SELECT rec_id, ch, min(n) AS "start", max(n)+1 AS "end", round(max(q),5) AS ratio, round(max(abs(v)),6) AS peak FROM g GROUP BY rec_id, ch, g HAVING max(q)>1 AND max(n)-min(n)+1<=3""")
def _(spark, d):
    return D.impulse_candidates(V.stereo(spark, d), V.LR_RATE, 10.0).withColumns({"ratio": r6("ratio", 5), "peak": r6("peak")})


@query("win08_impulse_scores")
def _(spark, d):
    s = V.stereo(spark, d)
    out = D.score_impulses(D.impulse_candidates(s, V.LR_RATE, 10.0), s, V.LR_RATE)
    return out.withColumns({"confidence": r6("confidence"), "severity": r6("severity")})


@query("join09_matched_gaps")
def _(spark, d):
    s = V.stereo(spark, d)
    silences, _ = _silences(spark, d, s)
    planted = V.lr(spark, d).select("rec_id", (F.floor(F.col("n") / 5000) * 5000 + 4000).cast("long").alias("start")).distinct().withColumn("end", F.col("start") + 1000)
    return D.match_events(planted, silences.select("rec_id", "start", "end"))


_PAUSE = """hp AS (SELECT rec_id, n//20 AS h, avg(pow((l+r)/2,2)) AS p FROM v_lr GROUP BY 1,2), he AS (SELECT rec_id, h, sqrt((sum(p) OVER (PARTITION BY rec_id ORDER BY h ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))/3) AS e FROM hp),
ht AS (SELECT rec_id, max(e) AS t FROM he GROUP BY 1), hq AS (SELECT he.rec_id, h, h-row_number() OVER (PARTITION BY he.rec_id ORDER BY h) AS g FROM he JOIN ht ON ht.rec_id=he.rec_id WHERE e<=greatest(1e-8,t*0.06)),
pz AS (SELECT rec_id, min(h)/50.0::DOUBLE AS s, (max(h)+1)/50.0::DOUBLE AS e FROM hq GROUP BY rec_id, g HAVING max(h)-min(h)+1>=30)"""


@query("set06_pauses", f"WITH {_PAUSE} SELECT rec_id, round(s,6) AS \"start\", round(e,6) AS \"end\" FROM pz")
def _(spark, d):
    return D.pauses(D.mono(V.stereo(spark, d)), V.LR_RATE).select("rec_id", r6("start").alias("start"), r6("end").alias("end"))


@query("set06_phrase_windows")
def _(spark, d):
    mean = stage(D.mono(V.stereo(spark, d)), "mean")
    # A tenth of the declared rate stretches the recordings to minutes, so that there is something to cut.
    slow = D.pauses(mean, V.SIG_RATE, 600)
    lengths = mean.groupBy("rec_id").agg((F.count(F.lit(1)) / V.SIG_RATE).alias("duration"))
    return D.phrase_windows(slow, lengths)


@query("fun06_useful_gaps")
def _(spark, d):
    lines = V.lines(spark, d)
    # Readings of the gap behind each line: every fifth repeats the line's last three words, as a held word would.
    spoken = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    echo = F.array_join(F.slice(spoken, F.greatest(F.lit(1), F.size(spoken) - 2), 3), " ")
    found = lines.select(
        "rec_id", (F.col("end") + 0.1).alias("start"), (F.col("end") + 1.0).alias("end"),
        F.when(F.col("line_no") % 5 == 0, echo).otherwise(F.array_join(F.slice(spoken, 1, 3), " ")).alias("text"),
        F.least(F.lit(3), F.size(spoken)).alias("words"))
    return D.useful_gaps(found, lines).select("rec_id", r6("start").alias("start"), "text")


@query("flt01_usable_intervals", "WITH i AS (SELECT DISTINCT rec_id, n//250 AS id FROM v_lr) SELECT rec_id, id AS interval_id FROM i WHERE EXISTS (SELECT 1 FROM v_stereo v WHERE v.rec_id=i.rec_id AND v.n>=id*250 AND v.n<id*250+125 AND abs(v.v)>1e-8)")
def _(spark, d):
    lr = V.lr(spark, d)
    number = F.floor(F.col("n") / 250).cast("long")
    intervals = lr.select("rec_id", number.alias("interval_id")).distinct().withColumns({"from": F.col("interval_id") * 250, "to": F.col("interval_id") * 250 + 125})
    return D.usable_intervals(V.stereo(spark, d), intervals, 4096).select("rec_id", "interval_id")


@query("fun06_plausible_differences")
def _(spark, d):
    both = V.lines(spark, d).join(_second(spark, d).withColumnRenamed("text", "candidate"), ["rec_id", "line_no"])
    return both.select("rec_id", "line_no", D.plausible_difference(X.tokens(F.col("text")), X.tokens(F.col("candidate"))).alias("plausible"))


# Quiet windows picked one after another: the quietest that overlaps none picked before.
_QUIET = """nw AS (SELECT rec_id, frame AS win, 10*log10(greatest(1e-12,sum(v*v)/count(*))) AS db, avg(CASE WHEN v=0 THEN 1.0::DOUBLE ELSE 0 END) AS z FROM (SELECT fq.rec_id, frame, v FROM fq JOIN fm ON fm.rec_id=fq.rec_id WHERE frame>=0 AND frame*32+63<=mx AND n-frame*32<64) GROUP BY 1,2),
nv AS (SELECT rec_id, win, db FROM nw WHERE db>-100 AND z<0.95),
ng(rec_id, k, picked) AS (SELECT DISTINCT rec_id, 0, CAST([] AS BIGINT[]) FROM nv UNION ALL SELECT ng.rec_id, k+1, list_append(any_value(picked), arg_min(win, {'a': round(db,9), 'b': win})) FROM ng JOIN nv ON nv.rec_id=ng.rec_id AND NOT list_contains(picked, win) AND NOT list_contains(picked, win-1) AND NOT list_contains(picked, win+1) WHERE k<8 GROUP BY ng.rec_id, k),
np AS (SELECT rec_id, unnest(picked) AS win FROM (SELECT * FROM ng QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY k DESC)=1))"""

_NOISE = _QUIET + """, nh AS (SELECT np.rec_id, count(DISTINCT win) AS quiet, 10*log10(greatest(1e-18,avg(p) FILTER (bin BETWEEN 20 AND 28)))-10*log10(greatest(1e-18,avg(p) FILTER (bin BETWEEN 7 AND 12))) AS hx FROM np JOIN spg ON spg.rec_id=np.rec_id AND spg.frame=np.win GROUP BY 1),
n1 AS (SELECT *, least(1,greatest(0,(floor_db+90)/35)) AS fe FROM dyn JOIN nh USING (rec_id)), n2 AS (SELECT *, least(0.96,greatest(0,0.45*least(1,greatest(0,(dynamic_db-5)/13))+0.35*least(1,greatest(0,(quiet-2)/6.0::DOUBLE))+0.20*fe)) AS c, round_even(least(12,greatest(0,1.5+fe*6.5+greatest(0,hx)*0.25))/0.5::DOUBLE,0)*0.5::DOUBLE AS red FROM n1),
noi AS (SELECT rec_id, quiet, hx, least(-45,greatest(-78,round_even(floor_db+8,0))) AS th, red, round_even(greatest(0,least(10,greatest(0,14-red),2+greatest(0,hx)*0.55+greatest(0,12-dynamic_db)*0.2))/0.5::DOUBLE,0)*0.5::DOUBLE AS hs, round_even(least(600,greatest(250,300+dynamic_db*8))/25.0::DOUBLE,0)*25.0::DOUBLE AS rel,
 (c>=0.55 AND dynamic_db>=7 AND quiet>=2 AND floor_db>-88 AND red>=2) AS det, c FROM n2)"""


def _quiet_windows(spark, d):
    """Frames of both channels as windows: level, whether they hold sound."""
    frames = Z.framed(V.stereo(spark, d), SIZE, HOP)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    silent = F.size(F.filter("v", lambda x: x == 0))
    level = 10 * F.log10(F.greatest(F.lit(1e-12), F.sum(square) / (SIZE * F.count(F.lit(1)))))
    windows = frames.groupBy("rec_id", F.col("frame").alias("win")).agg(F.round(level, 9).alias("rms_db"), (F.sum(silent) / (SIZE * F.count(F.lit(1)))).alias("_z"))
    return Z.quietest_apart(stage(windows.select("rec_id", "win", "rms_db", ((F.col("rms_db") > -100) & (F.col("_z") < 0.95)).alias("valid")), "windows"))


@query("agg21_quiet_windows", f"WITH RECURSIVE {SPG}, {_QUIET} SELECT rec_id, win FROM np")
def _(spark, d):
    return _quiet_windows(spark, d).select("rec_id", "win")


def _noise(spark, d, spec, dynamics):
    quiet = _quiet_windows(spark, d)
    held = spec.join(quiet.select("rec_id", F.col("win").alias("frame")), ["rec_id", "frame"], "left_semi")
    hiss = held.groupBy("rec_id").agg(
        (Z.band_db(held, 300, 450, 1000 / SIZE, []) - Z.band_db(held, 100, 200, 1000 / SIZE, [])).alias("hiss_excess"), F.count_distinct("frame").alias("quiet_windows"))
    return D.noise_recommendation(dynamics, hiss, V.LR_RATE)


@query("agg21_noise_recommendation", f"WITH RECURSIVE {SPG}, {_DYN}, {_NOISE} SELECT rec_id, CAST(quiet AS BIGINT) AS quiet_windows, round(hx,5) AS hiss_excess, th AS threshold_db, red AS reduction_db, hs AS hiss_db, 3000.0::DOUBLE AS hiss_hz, rel AS release_ms, det AS detected, round(CASE WHEN det THEN c ELSE least(c,0.54) END,6) AS confidence FROM noi")
def _(spark, d):
    spec = stage(_mean_spec(spark, d), "spectrum")
    out = _noise(spark, d, spec, D.global_dynamics(V.lr(spark, d), V.LR_RATE))
    return out.withColumns({"hiss_excess": r6("hiss_excess", 5), "confidence": r6("confidence")})


@query("agg38_cleanup_rows", f"""WITH RECURSIVE {SPG}, {_RUM}, {_DYN}, {_NOISE}, {_HUM}, {_DELAY_SQL}, ba AS (SELECT rec_id, least(12,greatest(-12,10*log10(greatest(1e-18,sum(l*l))/greatest(1e-18,sum(r*r))))) AS b FROM v_lr GROUP BY 1),
w AS (SELECT rec_id, cutoff_hz, ratio_db, rum.conf AS rc, rum.det AS rd, hum_hz, amount, hum.conf AS hc, hum.det AS hd, red, hs, CASE WHEN noi.det THEN noi.c ELSE least(noi.c,0.54) END AS nc, noi.det AS nd, b, delay_ms, greatest(least(1,greatest(0,(abs(b)-0.5)/5.5)),del.conf) AS bc
 FROM rum LEFT JOIN hum USING (rec_id) LEFT JOIN noi USING (rec_id) LEFT JOIN ba USING (rec_id) LEFT JOIN del USING (rec_id)),
x AS (SELECT rec_id, 'vinyl' AS profile, 'highpass' AS kind, cutoff_hz AS value, ratio_db AS more, rc AS confidence, rd AS enabled FROM w UNION ALL SELECT rec_id, unnest(['vinyl','transfer']), 'hum', hum_hz, amount, hc, hd FROM w UNION ALL SELECT rec_id, 'vinyl', 'noise', red, hs, nc, nd FROM w
 UNION ALL SELECT rec_id, 'transfer', 'balance', b, delay_ms, bc, bc>=0.55 FROM w UNION ALL SELECT rec_id, 'transfer', 'noise', least(red,8), least(hs,6), nc, nd FROM w)
SELECT rec_id, profile, kind, round(coalesce(value,0),4)+0.0::DOUBLE AS value, round(coalesce(more,0),4)+0.0::DOUBLE AS more, round(coalesce(confidence,0),4) AS confidence, coalesce(enabled,false) AS enabled FROM x""")
def _(spark, d):
    spec = stage(_mean_spec(spark, d), "spectrum")
    dynamics = stage(D.global_dynamics(V.lr(spark, d), V.LR_RATE), "dynamics")
    pairs = V.lr(spark, d)
    power = lambda c: F.greatest(F.lit(1e-18), F.sum(F.col(c) * F.col(c)))
    balance = pairs.groupBy("rec_id").agg((10 * F.log10(power("l") / power("r"))).alias("balance_db")).join(
        D.channel_delay(pairs, V.LR_RATE, 2, 16.0).select("rec_id", "delay_ms", F.col("confidence").alias("delay_confidence")), "rec_id")
    rows = D.cleanup_rows(
        Z.rumble_decision(spec, 1000 / SIZE, (5, 40), (60, 130)), _hum(spark, d), _noise(spark, d, spec, dynamics), balance)
    return rows.withColumns({"value": r6("value", 4), "more": r6("more", 4), "confidence": r6("confidence", 4)})


@query("udx03_gated_mean", f"WITH {BLK}, k AS (SELECT rec_id, rms_db AS x FROM blk WHERE rms_db>-70), g AS (SELECT rec_id, -0.691::DOUBLE+10*log10(greatest(1e-12,avg(pow(10.0::DOUBLE,(x+0.691::DOUBLE)/10))))-10 AS g FROM k GROUP BY 1) SELECT rec_id, round(-0.691::DOUBLE+10*log10(greatest(1e-12,avg(pow(10.0::DOUBLE,(x+0.691::DOUBLE)/10)))),5)+0.0::DOUBLE AS gated, CAST(count(*) AS BIGINT) AS kept FROM k JOIN g USING (rec_id) WHERE x>g GROUP BY 1")
def _(spark, d):
    blocks = B.block_summary(V.stereo(spark, d), V.LR_RATE, V.ACTIVITY_TAPS)
    return N.gated_mean(blocks, "rms_db", ["rec_id"], 10.0).withColumn("gated", r6("gated", 5))


@query("udx04_split_interval", """WITH RECURSIVE w(rec_id, line_no, s, e) AS (SELECT rec_id, line_no, "start", "end" FROM v_lines UNION ALL SELECT rec_id, line_no, s+12, e FROM w WHERE e-s>14)
SELECT rec_id, line_no, round(s,6) AS "start", round(CASE WHEN e-s>14 THEN s+14 ELSE e END,6) AS "end" FROM w WHERE CASE WHEN e-s>14 THEN 14 ELSE e-s END>=0.75""")
def _(spark, d):
    from phonolake.functions.tablefn import register_split_interval

    register_split_interval(spark)
    V.lines(spark, d).select("rec_id", "line_no", "start", "end").createOrReplaceTempView("phonolake_lines")
    return spark.sql("""SELECT rec_id, line_no, round(w.piece_start, 6) AS start, round(w.piece_end, 6) AS end
        FROM phonolake_lines, LATERAL split_interval(start, end, 14D, 12D) w WHERE w.piece_end - w.piece_start >= 0.75""")

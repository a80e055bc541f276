"""Queries for loudness measurement and levelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolake.operators import loudness as N
from phonolake.operators import transforms as P
from phonolake.operators.weighting import weighted
from phonolake.plans import views as V
from phonolake.plans.q_transforms import r6
from phonolake.plans.registry import query
from phonolake.session import stage

SUB = "sub AS (SELECT rec_id, n//100 AS sub, sum(v*v)/100 AS ms FROM v_k GROUP BY 1,2 HAVING count(*)=200)"
_L = "-0.691::DOUBLE+10*log10(greatest(1e-12::DOUBLE,{}))"
MOV = SUB + ", mov AS (SELECT rec_id, sub, {} AS m, {} AS st FROM sub)".format(
    _L.format("avg(ms) OVER (PARTITION BY rec_id ORDER BY sub ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"),
    _L.format("avg(ms) OVER (PARTITION BY rec_id ORDER BY sub ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"),
)
_PW = "pow(10.0::DOUBLE,({}+0.691::DOUBLE)/10)"
INT = MOV + f""", ib AS (SELECT rec_id, m FROM mov WHERE sub>=3 AND m>-70),
ig AS (SELECT rec_id, {_L.format('avg(' + _PW.format('m') + ')')}-10 AS g FROM ib GROUP BY rec_id),
integ AS (SELECT rec_id, {_L.format('avg(' + _PW.format('m') + ')')} AS integrated, count(*) AS kept FROM ib JOIN ig USING (rec_id) WHERE m>g GROUP BY rec_id),
rb AS (SELECT rec_id, st FROM mov WHERE sub>=29 AND (sub+1)%10=0 AND st>-70),
rg AS (SELECT rec_id, {_L.format('avg(' + _PW.format('st') + ')')}-20 AS g FROM rb GROUP BY rec_id),
rk AS (SELECT rec_id, st, row_number() OVER (PARTITION BY rec_id ORDER BY st)-1 AS k, count(*) OVER (PARTITION BY rec_id) AS c FROM rb JOIN rg USING (rec_id) WHERE st>g),
rng AS (SELECT rec_id, greatest(0, max(CASE WHEN k=floor((c-1)*0.95+0.5) THEN st END)-max(CASE WHEN k=floor((c-1)*0.10+0.5) THEN st END)) AS range_lu FROM rk GROUP BY rec_id)"""


def _tp_sql():
    lag = ", ".join(f"lag(v,{k}) OVER w AS t{k}" for k in range(1, 12))
    phases = []
    for taps in N.TRUE_PEAK_TAPS:
        terms = "+".join(f"({c!r}::DOUBLE)*{'v' if k == 0 else f't{k}'}" for k, c in enumerate(taps))
        phases.append(f"abs({terms})")
    best = "greatest(abs(v)," + ",".join(f"coalesce({p},0)" for p in phases) + ")"
    return f"""pads AS (SELECT rec_id, ch, max(n)+unnest(range(1,12)) AS n, 0.0::DOUBLE AS v FROM v_stereo GROUP BY rec_id, ch),
hist AS (SELECT rec_id, v, {lag} FROM (SELECT rec_id, ch, n, v FROM v_stereo UNION ALL SELECT rec_id, ch, n, v FROM pads)
  WINDOW w AS (PARTITION BY rec_id, ch ORDER BY n)),
tp AS (SELECT rec_id, max({best}) AS true_peak FROM hist GROUP BY rec_id)"""


MEASURE = INT + ", " + _tp_sql() + """, meas AS (SELECT e.rec_id, coalesce(integrated,'-inf'::DOUBLE) AS integrated, coalesce(range_lu,0) AS range_lu,
  20*log10(true_peak) AS true_peak_db FROM (SELECT DISTINCT rec_id FROM mov) e LEFT JOIN integ USING (rec_id) LEFT JOIN rng USING (rec_id) JOIN tp USING (rec_id))"""


def _heard(spark, d):
    return weighted(V.stereo(spark, d), V.LR_RATE, "K", response=V.K_TAPS)


def _moving(spark, d):
    return N.moving_loudness(N.sub_blocks(_heard(spark, d), V.LR_RATE))


def _measures(spark, d):
    return N.measure(V.stereo(spark, d), V.LR_RATE, response=V.K_TAPS)


@query("agg06_sub_block_power", f"WITH {SUB} SELECT rec_id, sub, round(ms,9) AS ms FROM sub")
def _(spark, d):
    return N.sub_blocks(_heard(spark, d), V.LR_RATE).withColumn("ms", r6("ms", 9))


@query("win01_moving_loudness", f"""WITH {MOV} SELECT rec_id, sub, round(m,6) AS momentary, round(st,6) AS short_term, sub>=3 AS momentary_full,
  (sub>=29 AND (sub+1)%10=0) AS short_term_full FROM mov""")
def _(spark, d):
    return _moving(spark, d).drop("ms").withColumns({"momentary": r6("momentary"), "short_term": r6("short_term")})


@query("win02_maximum_loudness", f"WITH {MOV} SELECT rec_id, round(max(m),6) AS max_momentary, round(max(st),6) AS max_short_term FROM mov GROUP BY rec_id")
def _(spark, d):
    return N.maximum_loudness(_moving(spark, d)).select("rec_id", r6("max_momentary").alias("max_momentary"), r6("max_short_term").alias("max_short_term"))


@query("agg07_integrated_loudness", f"WITH {INT} SELECT rec_id, round(integrated,6) AS integrated, CAST(kept AS BIGINT) AS kept FROM integ")
def _(spark, d):
    return N.integrated_lufs(_moving(spark, d)).withColumn("integrated", r6("integrated"))


@query("agg08_loudness_range", f"WITH {INT} SELECT rec_id, round(range_lu,6) AS range_lu FROM rng")
def _(spark, d):
    return N.loudness_range(_moving(spark, d)).withColumn("range_lu", r6("range_lu"))


@query("agg09_true_peak", f"WITH {_tp_sql()} SELECT rec_id, round(true_peak,6) AS true_peak, round(20*log10(true_peak),6)+0.0::DOUBLE AS true_peak_db FROM tp")
def _(spark, d):
    return N.true_peak(V.stereo(spark, d)).select("rec_id", r6("true_peak").alias("true_peak"), r6("true_peak_db").alias("true_peak_db"))


_TG = "tg(target,tl,tpk,tol,mr) AS (VALUES " + ",".join(
    f"('{t[0]}',{t[1]}::DOUBLE,{t[2]}::DOUBLE,{t[3]}::DOUBLE,{t[4]}::DOUBLE)" for t in N.TARGETS) + ")"


@query("agg10_loudness_compliance", f"""WITH {MEASURE}, {_TG},
x AS (SELECT rec_id, target, abs(integrated-tl)<=tol+1e-9 AS loudness_ok, true_peak_db<=tpk+1e-9 AS peak_ok, (mr<=0 OR range_lu<=mr+1e-9) AS range_ok,
 least(tl-integrated, tpk-true_peak_db) AS g FROM meas, tg)
SELECT rec_id, target, loudness_ok, peak_ok, range_ok, round(g,6)+0.0::DOUBLE AS suggested_gain, (loudness_ok AND peak_ok AND range_ok) AS passed FROM x""")
def _(spark, d):
    return N.compliance(_measures(spark, d)).withColumn("suggested_gain", r6("suggested_gain"))


_CHECKS = """ck AS (SELECT rec_id, target, 'integrated' AS name, integrated AS measured, tl-tol AS low, tl+tol AS high, printf('%.1f to %.1f LUFS', tl-tol, tl+tol) AS required FROM meas, tg
 UNION ALL SELECT rec_id, target, 'true peak', true_peak_db, NULL, tpk, printf('up to %.1f dBTP', tpk) FROM meas, tg UNION ALL SELECT rec_id, target, 'range', range_lu, NULL, mr, printf('up to %.1f LU', mr) FROM meas, tg WHERE mr>0),
cp AS (SELECT *, (low IS NULL OR measured>=low-1e-9) AND measured<=high+1e-9 AS passed FROM ck)"""


@query("agg10_compliance_checks", f"WITH {MEASURE}, {_TG}, {_CHECKS} SELECT rec_id, target, name, round(measured,6)+0.0::DOUBLE AS measured, low, high, required, passed FROM cp")
def _(spark, d):
    return N.compliance_checks(_measures(spark, d)).withColumn("measured", r6("measured"))


@query("fun28_compliance_sentences", f"""WITH {MEASURE}, {_TG}, {_CHECKS}, f AS (SELECT rec_id, target, string_agg(name, ', ' ORDER BY name) FILTER (WHERE NOT passed) AS bad FROM cp GROUP BY 1,2),
g AS (SELECT rec_id, target, tl-integrated AS w, least(tl-integrated, tpk-true_peak_db) AS g FROM meas, tg)
SELECT rec_id, target, CASE WHEN bad IS NULL THEN 'meets '||target ELSE 'misses '||target||' on '||bad END || CASE WHEN abs(g)>0.05 THEN printf('; gain %+.1f dB', g) ELSE '' END
 || CASE WHEN abs(g)>0.05 AND w-g>0.1 THEN printf(', %.1f dB left to limiting', w-g) ELSE '' END AS sentence FROM f JOIN g USING (rec_id, target)""")
def _(spark, d):
    return N.compliance_sentences(_measures(spark, d))


def _match_sql(goal, ceiling, same="false"):
    return f"""WITH {MEASURE}, s AS (SELECT min(integrated) AS q, avg(integrated) AS a, max(CASE WHEN rec_id=2 THEN integrated END) AS ref FROM meas WHERE NOT isinf(integrated)),
p AS (SELECT meas.*, {goal} AS goal, {goal}-integrated AS req, {ceiling}-true_peak_db AS alw, {same} AS idle FROM meas, s),
g AS (SELECT *, least(req,alw) AS gain, greatest(0,req-least(req,alw)) AS sf FROM p)
SELECT rec_id, round(integrated,6) AS measured, round(true_peak_db,6)+0.0::DOUBLE AS true_peak_db, round(CASE WHEN idle THEN 0 ELSE req END,6)+0.0::DOUBLE AS requested,
 round(CASE WHEN idle THEN 0 ELSE gain END,6)+0.0::DOUBLE AS gain_db, round(CASE WHEN idle THEN 0 ELSE sf END,6)+0.0::DOUBLE AS shortfall,
 (NOT idle AND abs(gain)>0.05) AS applies, round(integrated+CASE WHEN idle THEN 0 ELSE gain END,6)+0.0::DOUBLE AS resulting,
 CASE WHEN idle THEN 'anchor of the set' WHEN sf>0.05 AND alw<0 AND req>0 THEN printf('peaks exceed the ceiling by %.1f dB, lowered', -alw)
  WHEN sf>0.05 THEN printf('stays %.1f dB short under the ceiling', sf)
  WHEN abs(gain)<=0.05 THEN 'on target' ELSE 'gain applied' END AS note FROM g"""


def _plan(spark, d, mode, **kw):
    plan = N.loudness_match(_measures(spark, d), mode, **kw)
    names = ["measured", "true_peak_db", "requested", "gain_db", "shortfall", "resulting"]
    return plan.withColumns({c: r6(c) for c in names})


@query("agg11_loudness_match_average", _match_sql("s.a", "-1.0::DOUBLE"))
def _(spark, d):
    return _plan(spark, d, "average")


@query("agg11_loudness_match_quietest", _match_sql("s.q", "-1.0::DOUBLE"))
def _(spark, d):
    return _plan(spark, d, "quietest")


@query("agg11_loudness_match_target", _match_sql("-14.0::DOUBLE", "-1.0::DOUBLE"))
def _(spark, d):
    return _plan(spark, d, "target", target="Spotify / YouTube")


@query("agg11_loudness_match_reference", _match_sql("s.ref", "-1.0::DOUBLE", "(rec_id=2)"))
def _(spark, d):
    return _plan(spark, d, "reference", reference=2)


@query("fun28_match_summary", f"""WITH {MEASURE}, s AS (SELECT avg(integrated) AS a FROM meas), g AS (SELECT s.a, s.a-integrated AS req, least(s.a-integrated, -1.0::DOUBLE-true_peak_db) AS gain FROM meas, s)
SELECT printf('%d recordings to %.1f LUFS by the average of the set, peaks under -1.0 dBTP: %d change, %d stay short, %d without loudness', count(*), max(a), count(CASE WHEN abs(gain)>0.05 THEN 1 END), count(CASE WHEN req-gain>0.05 THEN 1 END), 0) AS summary FROM g""")
def _(spark, d):
    return N.match_summary(N.loudness_match(_measures(spark, d), "average"), "the average of the set")


@query("ds11_levelling_job", f"""WITH {MEASURE}, s AS (SELECT avg(integrated) AS a FROM meas),
g AS (SELECT rec_id, CASE WHEN abs(least(a-integrated,-1.0::DOUBLE-true_peak_db))>0.05 THEN least(a-integrated,-1.0::DOUBLE-true_peak_db) ELSE 0 END AS gain FROM meas, s)
SELECT rec_id, ch, n, round(v*pow(10.0::DOUBLE,gain/20),6)+0.0::DOUBLE AS v FROM v_stereo JOIN g USING (rec_id)""")
def _(spark, d):
    samples = V.stereo(spark, d)
    plan = N.loudness_match(N.measure(samples, V.LR_RATE, response=V.K_TAPS), "average")
    gains = plan.withColumn("gain_db", F.when(F.col("applies"), F.col("gain_db")).otherwise(0.0))
    # One row a recording, written first: its size is known, so the samples are not shuffled by recording.
    return P.gain(samples, stage(gains, "gains")).select("rec_id", "ch", "n", r6("v").alias("v"))

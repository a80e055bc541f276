"""Queries of the click detector, over the stereo pair with planted pulses."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolake.operators import evaluate as E
from phonolake.operators import impulses as I
from phonolake.operators import segments as G
from phonolake.operators import transforms as P
from phonolake.plans import views as V
from phonolake.plans.q_segments import _SHOULDER, RUNS
from phonolake.plans.q_transforms import r6
from phonolake.plans.registry import query
from phonolake.session import stage

LIMITS = I.Limits(V.LR_RATE, 10.0, 2.0, 10.0)
KEEP = 0.3

# Every 500 samples one of five shapes: a step of one sample, a plateau at full scale, a bipolar click, a hump, a train.
PULSE = """CASE (n//500)%5 WHEN 0 THEN CASE WHEN n%500=250 THEN 0.6 ELSE 0 END WHEN 1 THEN CASE WHEN n%500 BETWEEN 250 AND 252 THEN 1.2 ELSE 0 END
 WHEN 2 THEN CASE n%500 WHEN 250 THEN 0.5 WHEN 251 THEN -0.5 ELSE 0 END WHEN 3 THEN CASE WHEN n%500 BETWEEN 250 AND 257 THEN 0.4-0.025*(n%500-253)*(n%500-254) ELSE 0 END
 ELSE CASE WHEN n%500 BETWEEN 250 AND 275 AND n%500%4=2 THEN 0.5 ELSE 0 END END"""
CLICKED = f"v_clicked AS (SELECT rec_id, ch, n, greatest(-0.95::DOUBLE,least(0.95::DOUBLE,0.05::DOUBLE*v+(1-0.3::DOUBLE*ch)*CAST({PULSE} AS DOUBLE))) AS v FROM v_stereo)"


def clicked(spark, d):
    """The stereo pair, quietly, with a planted pulse every half second, limited at 0.95."""
    pulse = F.expr(f"CAST({PULSE.replace('n//500', 'n div 500')} AS DOUBLE)")
    v = 0.05 * F.col("v") + (1 - 0.3 * F.col("ch")) * pulse
    return V.stereo(spark, d).withColumn("v", F.greatest(F.lit(-0.95), F.least(F.lit(0.95), v)))


LEVELS = f"""{CLICKED}, cv AS (SELECT rec_id, ch, n, v, abs(v-(lag(v) OVER w+lead(v) OVER w)/2) AS x, v-lag(v) OVER w AS d FROM v_clicked WINDOW w AS (PARTITION BY rec_id, ch ORDER BY n)),
bk AS (SELECT DISTINCT rec_id, ch, n//25 AS block FROM cv), hh AS (SELECT bk.*, x, v, n//25=block AS home FROM bk JOIN cv ON bk.rec_id=cv.rec_id AND bk.ch=cv.ch AND n>=block*25-6 AND n<block*25+25+6),
mm AS (SELECT rec_id, ch, block, median(x) AS md, sqrt(avg(v*v)) AS rms, median(CASE WHEN home THEN abs(v) END) AS am FROM hh GROUP BY 1,2,3),
dd AS (SELECT rec_id, ch, block, any_value(md) AS md, any_value(rms) AS rms, any_value(am) AS am, median(abs(x-md)) AS mad FROM hh JOIN mm USING (rec_id, ch, block) GROUP BY 1,2,3),
mk AS (SELECT cv.*, rms, greatest(1.13*am,0.5*rms) AS ref, md+5.5*greatest(1.4826*mad,0.25*md,rms*0.0015,2e-7) AS th FROM cv JOIN dd ON dd.rec_id=cv.rec_id AND dd.ch=cv.ch AND dd.block=cv.n//25)"""
BENT = """ht AS (SELECT *, n-row_number() OVER (PARTITION BY rec_id, ch ORDER BY n) AS g FROM mk WHERE x>0.45*th),
hi AS (SELECT *, min(n) OVER (PARTITION BY rec_id, ch, g) AS lo, max(n) OVER (PARTITION BY rec_id, ch, g) AS hi FROM ht), sg AS (SELECT * FROM hi WHERE x>th),
sl AS (SELECT *, max(n) OVER w AS la, max(hi) OVER w AS hl FROM sg WINDOW w AS (PARTITION BY rec_id, ch ORDER BY n RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING)),
se AS (SELECT *, greatest(lo,la-9) AS s, least(hl+1,greatest(lo,la-9)+10) AS e, row_number() OVER (PARTITION BY rec_id, ch ORDER BY n) AS k FROM sl), sx AS (SELECT *, e+1 AS e1 FROM se),
nx AS (SELECT a.rec_id, a.ch, a.n, a.la, a.s, a.e, a.k, b.n AS nxt FROM sx a ASOF LEFT JOIN sg b ON a.rec_id=b.rec_id AND a.ch=b.ch AND a.e1<=b.n),
gr AS (SELECT * FROM nx WHERE k=1 UNION ALL SELECT nx.* FROM gr JOIN nx ON nx.rec_id=gr.rec_id AND nx.ch=gr.ch AND nx.n=gr.nxt),
bent AS (SELECT gr.rec_id, gr.ch, s, e, max(sg.x/sg.th) AS q, arg_max(sg.n, {x: sg.x, m: -sg.n}) AS pk FROM gr JOIN sg ON sg.rec_id=gr.rec_id AND sg.ch=gr.ch AND sg.n BETWEEN gr.n AND gr.la GROUP BY 1,2,3,4)"""
GATES = """gn AS (SELECT bent.rec_id, bent.ch, s, e, e-s AS z, cv.n, cv.v, cv.d FROM bent JOIN cv ON cv.rec_id=bent.rec_id AND cv.ch=bent.ch AND cv.n BETWEEN greatest(0,s-greatest(3*(e-s),8)) AND e+greatest(3*(e-s),8)),
ns AS (SELECT *, n>=s AND n<e AS i, n<s AND n>=s-greatest(2*z,4) AS b, n>=e AND n<e+greatest(2*z,4) AS a FROM gn),
fg0 AS (SELECT rec_id, ch, s, e, z, sum(CASE WHEN i THEN d*d END)/greatest(1e-12,sum(CASE WHEN i THEN v*v END)) AS ri, sum(CASE WHEN NOT i THEN d*d END)/greatest(1e-12,sum(CASE WHEN NOT i THEN v*v END)) AS ro,
 coalesce(max(CASE WHEN n=s-1 THEN v END),0) AS v0, max(CASE WHEN i THEN v END) AS ih, min(CASE WHEN i THEN v END) AS il, max(CASE WHEN b THEN v END) AS bh, min(CASE WHEN b THEN v END) AS bl,
 max(CASE WHEN a THEN v END) AS ah, min(CASE WHEN a THEN v END) AS al, sqrt(avg(CASE WHEN i THEN v*v END)) AS rin, sqrt(avg(v*v)) AS rall, coalesce(sqrt(avg(CASE WHEN b THEN v*v END)),0) AS rb, coalesce(sqrt(avg(CASE WHEN a THEN v*v END)),0) AS ra FROM ns GROUP BY 1,2,3,4,5),
fg1 AS (SELECT *, greatest(abs(ih-v0),abs(il-v0)) AS am, coalesce(greatest(abs(bh-v0),abs(bl-v0)),0) AS db, coalesce(greatest(abs(ah-v0),abs(al-v0)),0) AS da FROM fg0),
fg2 AS (SELECT *, least(1,greatest(0,(ri/greatest(1e-6,ro)-1.5)/4)) AS hf, 1-least(1,greatest(0,(da-db)/greatest(am,db,1e-12))) AS rec, least(1,greatest(0,(am/greatest(rin,1e-12)-1.5)/6)) AS pk,
 CASE WHEN ih-v0>0.25*am AND il-v0<-0.25*am THEN 0.15 ELSE 0 END AS bi, least(0.5,greatest(0,(ra/(rb+0.01*rall)-2)/4)) AS pe FROM fg1),
sb AS (SELECT rec_id, ch, s, e, (0.35*hf+0.30*rec+0.20*pk+bi)*(1-pe) AS c, 1-exp(-0.5*am/greatest(rall,1e-12)) AS sv FROM fg2 WHERE hf>=0.15 AND rec>=CASE WHEN z<=3 THEN 0.33 ELSE 0.55 END)"""
LOUD = """lq AS (SELECT *, abs(v)/greatest(1e-9,ref+0.1*rms) AS q, n-row_number() OVER (PARTITION BY rec_id, ch ORDER BY n) AS g FROM mk WHERE abs(v)>1.5*ref),
lr0 AS (SELECT rec_id, ch, min(n) AS s, max(n)+1 AS e, arg_min(q,n) FILTER (WHERE q>=3) AS q FROM lq GROUP BY rec_id, ch, g HAVING max(n)+1-min(n)<=10 AND count(*) FILTER (WHERE q>=3)>0),
ln AS (SELECT lr0.*, e-s AS z, cv.n, cv.v, cv.n>=e+greatest(2,e-s) AND cv.n<e+greatest(2,e-s)+3*(e-s) AS l FROM lr0 JOIN cv ON cv.rec_id=lr0.rec_id AND cv.ch=lr0.ch AND cv.n BETWEEN s-16 AND e+greatest(16,greatest(2,e-s)+3*(e-s))),
lf AS (SELECT rec_id, ch, s, e, q, max(CASE WHEN n=s-1 THEN v END) AS v0, max(CASE WHEN n>=s AND n<e THEN v END) AS ih, min(CASE WHEN n>=s AND n<e THEN v END) AS il, max(CASE WHEN l THEN v END) AS lh, min(CASE WHEN l THEN v END) AS ll,
 count(CASE WHEN l THEN 1 END) AS kl, count(CASE WHEN n<s THEN 1 END) AS kb, count(CASE WHEN n>=e AND n<e+16 THEN 1 END) AS ka, sqrt(avg(CASE WHEN n<s THEN v*v END)) AS rb, sqrt(avg(CASE WHEN n>=e AND n<e+16 THEN v*v END)) AS ra FROM ln GROUP BY 1,2,3,4,5),
sa AS (SELECT rec_id, ch, s, e, least(1,greatest(0,0.65+(q-3)/20)) AS c, least(1,greatest(0,(q-5)/15)) AS sv FROM lf WHERE kb=16 AND ka=16 AND kl>=2 AND greatest(abs(ih-v0),abs(il-v0))>1e-9
 AND greatest(abs(lh-v0),abs(ll-v0))<=0.5*greatest(abs(ih-v0),abs(il-v0)) AND ra<=2.5*rb)"""
MERGE = f"""ev AS (SELECT * FROM sb UNION ALL SELECT * FROM sa), ek AS (SELECT * FROM ev WHERE c>={KEEP}),
e1 AS (SELECT *, CASE WHEN s<=1+max(e) OVER (PARTITION BY rec_id, ch ORDER BY s, e, c, sv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM ek),
e2 AS (SELECT *, sum(nw) OVER (PARTITION BY rec_id, ch ORDER BY s, e, c, sv ROWS UNBOUNDED PRECEDING) AS g FROM e1), pt AS (SELECT DISTINCT rec_id, ch, g, s, s+10 AS lim FROM e2),
pn AS (SELECT a.rec_id, a.ch, a.g, a.s, a.lim, b.s AS nxt, row_number() OVER (PARTITION BY a.rec_id, a.ch, a.g ORDER BY a.s) AS k FROM pt a ASOF LEFT JOIN pt b ON a.rec_id=b.rec_id AND a.ch=b.ch AND a.g=b.g AND a.lim<=b.s),
pc AS (SELECT * FROM pn WHERE k=1 UNION ALL SELECT pn.* FROM pc JOIN pn ON pn.rec_id=pc.rec_id AND pn.ch=pc.ch AND pn.g=pc.g AND pn.s=pc.nxt),
e3 AS (SELECT e2.rec_id, e2.ch, e2.g, pc.s AS p, e2.s, e2.e, c, sv, row_number() OVER (PARTITION BY e2.rec_id, e2.ch, e2.g, pc.s ORDER BY sv DESC, e2.s, e2.e, c DESC) AS k FROM e2 JOIN pc ON pc.rec_id=e2.rec_id AND pc.ch=e2.ch AND pc.g=e2.g AND e2.s>=pc.s AND e2.s<pc.lim),
e4 AS (SELECT rec_id, ch, max(e)-min(s)<=10 AS w, min(s) AS ms, max(e) AS me, max(c) AS mc, max(sv) AS mv, min(CASE WHEN k=1 THEN s END) AS bs, min(CASE WHEN k=1 THEN e END) AS be, min(CASE WHEN k=1 THEN c END) AS bc, min(CASE WHEN k=1 THEN sv END) AS bv, count(*) AS merged FROM e3 GROUP BY rec_id, ch, g, p),
imp AS (SELECT rec_id, ch, CASE WHEN w THEN ms ELSE bs END AS s, CASE WHEN w THEN me ELSE be END AS e, CASE WHEN w THEN mc ELSE bc END AS c, CASE WHEN w THEN mv ELSE bv END AS sv, merged FROM e4),
imk AS (SELECT *, CASE WHEN e-s<=2 THEN 'click' ELSE 'pop' END AS kind FROM imp)"""
FOUND = f"{LEVELS}, {BENT}, {GATES}, {LOUD}, {MERGE}"
CLIPS = f"{RUNS}, {_SHOULDER}, clp AS (SELECT *, 0.58+0.16*len+0.14*con+0.12*least(1,greatest(0,8*(lev-0.9)/0.9)) AS cf FROM sc)".replace("v_stereo", "v_clicked")


def _marked(samples):
    return stage(I.marked_samples(samples, LIMITS), "marked")


def _impulses(spark, d):
    return I.impulse_events(clicked(spark, d), LIMITS, KEEP)


def _clips(samples):
    return G.score_clipped(G.clipped_runs(samples, 0.9), samples, threshold=0.9)


@query("win08_span_limited", f"""WITH RECURSIVE {LEVELS}, {BENT} SELECT rec_id, ch, s AS "start", e AS "end", pk AS peak, round(q,5) AS ratio FROM bent""")
def _(spark, d):
    return I.bent_spans(_marked(clicked(spark, d)), LIMITS).withColumn("ratio", r6("ratio", 5))


@query("win08_amplitude_pass", f"""WITH {LEVELS}, {LOUD} SELECT rec_id, ch, s AS "start", e AS "end", round(c,6) AS confidence, round(sv,6)+0.0::DOUBLE AS severity FROM sa""")
def _(spark, d):
    marked = _marked(clicked(spark, d))
    return I.loud_spans(marked, marked, LIMITS).withColumns({c: r6(c) for c in ("confidence", "severity")})


@query("set01_detected_events", f"""WITH RECURSIVE {FOUND} SELECT rec_id, ch, kind, s AS "start", e AS "end", round(c,6) AS confidence, round(sv,6) AS severity, CAST(merged AS BIGINT) AS merged FROM imk""")
def _(spark, d):
    return _impulses(spark, d).withColumns({c: r6(c) for c in ("confidence", "severity")})


@query("top08_detected_strongest", f"""WITH RECURSIVE {FOUND}, {CLIPS}, al AS (SELECT rec_id, ch, s, e, kind, c FROM imk UNION ALL SELECT rec_id, ch, s, e, 'clip', cf FROM clp WHERE cf>=0.65),
k AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY round(c,9) DESC, ch, s, e, kind DESC) AS k FROM al) SELECT rec_id, ch, s AS "start", e AS "end", kind, round(c,6) AS confidence FROM k WHERE k=1""")
def _(spark, d):
    clips = _clips(clicked(spark, d)).withColumn("kind", F.lit("clip"))
    fields = ["rec_id", "ch", "start", "end", "kind", "confidence"]
    both = _impulses(spark, d).select(*fields).unionByName(clips.select(*fields)).withColumn("confidence", r6("confidence", 9))
    return G.strongest_event(both).withColumn("confidence", r6("confidence"))


@query("agg24_detected_rates", f"""WITH RECURSIVE {FOUND}, f AS (SELECT rec_id, max(n)+1 AS frames FROM v_stereo GROUP BY 1), al AS (SELECT rec_id, kind, c FROM imk)
SELECT al.rec_id, kind, CAST(count(*) AS BIGINT) AS candidates, CAST(count(CASE WHEN c>=0.65 THEN 1 END) AS BIGINT) AS accepted, round(avg(c),6) AS mean_confidence, round(count(CASE WHEN c>=0.65 THEN 1 END)/(max(frames)/1000.0::DOUBLE/60),5) AS per_minute FROM al JOIN f ON f.rec_id=al.rec_id GROUP BY 1,2""")
def _(spark, d):
    out = E.event_rates(_impulses(spark, d), P.frames_per_recording(V.stereo(spark, d)), V.LR_RATE)
    return out.withColumns({"mean_confidence": r6("mean_confidence"), "per_minute": r6("per_minute", 5)})


@query("agg24_detected_crackle", f"""WITH RECURSIVE {LEVELS}, {BENT}, {GATES}, {LOUD}, al AS (SELECT * FROM sb UNION ALL SELECT * FROM sa), f AS (SELECT rec_id, max(n)+1 AS f FROM v_stereo GROUP BY 1),
x AS (SELECT f.rec_id, any_value(f) AS f, count(CASE WHEN c>=0.65 THEN 1 END) AS ev, count(CASE WHEN c<0.65 THEN 1 END) AS rj FROM f LEFT JOIN al ON al.rec_id=f.rec_id GROUP BY 1)
SELECT rec_id, CAST(ev+rj AS BIGINT) AS candidates, round(ev*1000/f::DOUBLE,6) AS density, round(CASE WHEN ev+rj>0 THEN ev/(ev+rj)::DOUBLE ELSE 0 END,6) AS acceptance, (ev>=3 AND ev*1000/f::DOUBLE>=0.25 AND ev/greatest(1,ev+rj)::DOUBLE>=0.2) AS decrackle FROM x""")
def _(spark, d):
    samples = stage(clicked(spark, d), "clicked")
    scored = I.both_passes(_marked(samples), LIMITS).groupBy("rec_id").agg(
        F.count_if(F.col("confidence") >= 0.65).alias("events"), F.count_if(F.col("confidence") < 0.65).alias("rejected"))
    counts = P.frames_per_recording(samples).join(scored, "rec_id", "left").fillna(0, ["events", "rejected"])
    return E.crackle_decision(counts, V.LR_RATE).withColumns({"density": r6("density"), "acceptance": r6("acceptance")})


@query("agg25_detected_treatment", f"""WITH RECURSIVE {FOUND}, {CLIPS}, c AS (SELECT rec_id, count(*) AS c, avg(c) AS cf FROM imk WHERE c>=0.65 GROUP BY 1),
q AS (SELECT rec_id, lev, greatest(lev,lev+greatest(0.001*lev,os)) AS est, least(1,greatest(0,os/(0.12*lev))) AS sv FROM clp WHERE cf>=0.65),
p AS (SELECT rec_id, count(*) AS c, avg(sv) AS sv, max(20*log10(greatest(lev,est)/lev)) AS hr FROM q GROUP BY 1),
s AS (SELECT rec_id, max(n)+1 AS f, 10*log10(sum((l-r)*(l-r))/sum((l+r)*(l+r))) AS sm FROM v_lr GROUP BY 1),
x AS (SELECT s.rec_id, c.c AS cc, c.cf, p.c AS pc, sv, hr, f, floor(least(1,greatest(0.2,0.20+0.80/(1+exp(-5*((sm+14)/6-0.55)))))/0.05+0.5)*0.05 AS w FROM s LEFT JOIN c ON c.rec_id=s.rec_id LEFT JOIN p ON p.rec_id=s.rec_id)
SELECT rec_id, cc IS NOT NULL AS repair_clicks, CASE WHEN cc/greatest(1/60.0::DOUBLE,f/1000.0::DOUBLE/60)>120 AND cf<0.68 THEN 6.5::DOUBLE ELSE 7.0::DOUBLE END AS click_sensitivity, CASE WHEN cc IS NULL THEN 0.65::DOUBLE ELSE 1.0::DOUBLE END AS click_strength,
 pc IS NOT NULL AS repair_clips, round(CASE WHEN pc IS NULL THEN 0.65::DOUBLE ELSE floor(least(0.95,greatest(0.60,0.58+sv*0.34))/0.05+0.5)*0.05 END,4) AS declip_strength,
 round(floor(least(12,greatest(1,coalesce(hr,4)+0.5))/0.5+0.5)*0.5,4) AS declip_headroom_db, round(CASE WHEN -20*log10(greatest(w,1e-6))<3 THEN 1.0::DOUBLE ELSE w END,4) AS side_level FROM x""")
def _(spark, d):
    clicks = _impulses(spark, d).filter(F.col("confidence") >= 0.65)
    l, r = F.col("l"), F.col("r")
    side = V.lr(spark, d).groupBy("rec_id").agg((10 * F.log10(F.sum((l - r) * (l - r)) / F.sum((l + r) * (l + r)))).alias("side_to_mid_db"))
    samples = clicked(spark, d)
    out = E.treatment(clicks, _clips(samples), side, P.frames_per_recording(samples), V.LR_RATE)
    return out.withColumns({c: r6(c, 4) for c in ("declip_strength", "declip_headroom_db", "side_level")})

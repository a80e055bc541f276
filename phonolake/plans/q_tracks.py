"""Queries for track plans, timelines, catalogues and disc positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolake.operators import segments as G
from phonolake.operators import signal as S
from phonolake.operators import splits as L
from phonolake.operators import timeline as M
from phonolake.operators import tracks as K
from phonolake.operators import transforms as P
from phonolake.plans import views as V
from phonolake.plans.q_segments import SIL, _silences
from phonolake.plans.q_transforms import r6
from phonolake.plans.registry import query
from phonolake.session import scratch_path, stage
from phonolake.sources import catalog as A

_SETTINGS = [float(x) for x in range(-70, -24)]


def _sweep(spark, d):
    s = V.stereo(spark, d)
    frames = stage(P.frames_per_recording(s), "frames")
    silences = G.detect_silences(S.block_activity(s), frames, "activity", V.LR_RATE, 600.0, _SETTINGS)
    return stage(silences, "silences"), frames


_ACT = """am AS (SELECT rec_id, n//256 AS block, n, max(abs(v)) AS a FROM v_stereo GROUP BY 1,2,3), ak AS (SELECT *, row_number() OVER (PARTITION BY rec_id, block ORDER BY a) AS k, count(*) OVER (PARTITION BY rec_id, block) AS c FROM am),
act AS (SELECT rec_id, block, a FROM ak WHERE k=CAST(floor((c-1)*0.75) AS BIGINT)+1), fr AS (SELECT rec_id, max(n)+1 AS frames FROM v_stereo GROUP BY 1),
th AS (SELECT CAST(unnest(range(-70,-24)) AS DOUBLE) AS db), sq AS (SELECT rec_id, db, block, block-row_number() OVER (PARTITION BY rec_id, db ORDER BY block) AS g FROM act, th WHERE a<pow(10.0::DOUBLE,db/20)),
sw AS (SELECT rec_id, db, min(block)*256 AS s, least((max(block)+1)*256,max(frames)) AS e FROM sq JOIN fr USING (rec_id) GROUP BY rec_id, db, g HAVING least((max(block)+1)*256,max(frames))-min(block)*256>=600)"""


@query("top01_sweep_silences", f"WITH {_ACT} SELECT rec_id, db AS threshold_db, s AS \"start\", e AS \"end\" FROM sw")
def _(spark, d):
    return _sweep(spark, d)[0]


@query("top02_split_candidates", f"WITH {_ACT} SELECT rec_id, db AS threshold_db, CAST(s+(e-s)//2 AS BIGINT) AS position, CAST(e-s AS BIGINT) AS weight FROM sw JOIN fr USING (rec_id) WHERE s+(e-s)//2>=2000 AND frames-(s+(e-s)//2)>=2000")
def _(spark, d):
    return L.split_candidates(*_sweep(spark, d), 2000)


def _choice(quiet: str, splits: int = 0) -> str:
    """Boundaries ``bd`` from silences ``sw(rec_id, db, s, e)``, lengths ``fr`` and settings ``th``: the heaviest choice, and
    with ``splits`` the heaviest of that many where there is one (``exact``)."""
    counts = range(1, splits + 1)
    more = "".join(f", [CAST(NULL AS BIGINT)] AS s{k}, CAST([] AS BOOLEAN[]) AS t{k}" for k in counts)
    prior = lambda k: f"(w+{f's{k - 1}[pred+1]' if k > 1 else '0'})"
    taken = lambda k: f"coalesce({prior(k)}>coalesce(s{k}[i],-1),false)"
    step = "".join(f", list_append(s{k}, CASE WHEN {taken(k)} THEN {prior(k)} ELSE s{k}[i] END), list_append(t{k}, {taken(k)})" for k in counts)
    flag = "CASE k " + "".join(f"WHEN {k} THEN t{k}[j] " for k in counts) + "ELSE tk[j] END" if splits else "tk[j]"
    start = f"CASE WHEN s{splits}[n+1] IS NULL THEN -1 ELSE {splits} END" if splits else "-1"
    return f"""RECURSIVE {quiet}, cd AS (SELECT rec_id, db, CAST(s+(e-s)//2 AS BIGINT) AS p, CAST(e-s AS BIGINT) AS w FROM sw JOIN fr USING (rec_id) WHERE s+(e-s)//2>=2000 AND frames-(s+(e-s)//2)>=2000),
cn AS (SELECT rec_id, db, p, w, row_number() OVER (PARTITION BY rec_id, db ORDER BY p) AS c, count(*) OVER (PARTITION BY rec_id, db ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND 2000 PRECEDING) AS pred FROM cd),
gr AS (SELECT rec_id, db, count(*) AS n FROM cn GROUP BY 1,2),
dp AS (SELECT rec_id, db, n, CAST(1 AS BIGINT) AS i, [CAST(0 AS BIGINT)] AS sc, CAST([] AS BOOLEAN[]) AS tk{more} FROM gr
 UNION ALL SELECT rec_id, db, n, i+1, list_append(sc, greatest(w+sc[pred+1], sc[i])), list_append(tk, w+sc[pred+1]>sc[i]){step} FROM dp JOIN cn USING (rec_id, db) WHERE c=i),
bk AS (SELECT rec_id, db, n AS j, {start} AS k, CAST([] AS BIGINT[]) AS kept, tk{"".join(f", t{k}" for k in counts)} FROM dp WHERE i=n+1
 UNION ALL SELECT rec_id, db, CASE WHEN {flag} THEN pred ELSE j-1 END, CASE WHEN {flag} THEN k-1 ELSE k END, CASE WHEN {flag} THEN list_prepend(p, kept) ELSE kept END, tk{"".join(f", t{k}" for k in counts)} FROM bk JOIN cn USING (rec_id, db) WHERE c=j AND j>0 AND k<>0),
ch AS (SELECT rec_id, db, kept FROM bk WHERE j=0 OR k=0),
bd AS (SELECT fr.rec_id, th.db, list_concat([CAST(0 AS BIGINT)], coalesce(kept, []), [CAST(frames AS BIGINT)]) AS bs FROM fr CROSS JOIN th LEFT JOIN ch ON ch.rec_id=fr.rec_id AND ch.db=th.db)"""


#: Plateaus ``pl`` of boundaries ``bd``: setting after setting, compared with the first answer of the run.
_PLATEAUS = """pw AS (SELECT rec_id, db, bs AS held, db AS low FROM bd WHERE db=-70
 UNION ALL SELECT pw.rec_id, bd.db, CASE WHEN ag THEN held ELSE bs END, CASE WHEN ag THEN low ELSE bd.db END FROM pw JOIN bd ON bd.rec_id=pw.rec_id AND bd.db=pw.db+1,
  LATERAL (SELECT len(bs)=len(held) AND coalesce(list_max(list_transform(range(1,least(len(bs),len(held))+1), lambda x: abs(bs[x]-held[x]))),0)<=500 AS ag)),
sp AS (SELECT rec_id, low, max(db) AS high FROM pw GROUP BY 1,2), md AS (SELECT *, round((low+high)/2) AS mid FROM sp),
pl AS (SELECT md.rec_id, CAST(len(bs)-1 AS BIGINT) AS tracks, low AS low_db, high AS high_db, mid AS chosen_db, bs FROM md JOIN bd ON bd.rec_id=md.rec_id AND bd.db=md.mid)"""
_RANKED = """rk AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY high_db-low_db DESC, low_db) AS rank FROM pl)
SELECT rec_id, tracks, low_db, high_db, chosen_db, array_to_string(bs, ',') AS boundaries, CAST(rank AS INT) AS rank, """
_BEST = "row_number() OVER (PARTITION BY rec_id ORDER BY CASE WHEN tracks>1 AND high_db-low_db>=4 THEN 0 WHEN tracks=1 THEN 1 ELSE 2 END, rank)=1 AS best"


@query("top02_strongest_splits", f"WITH {_choice(_ACT)} SELECT rec_id, db AS threshold_db, array_to_string(bs, ',') AS boundaries FROM bd")
def _(spark, d):
    return L.strongest_splits(*_sweep(spark, d), 2000, _SETTINGS).withColumn("boundaries", F.array_join("boundaries", ","))


@query("top02_exact_splits", f"WITH {_choice(_ACT, 2)} SELECT rec_id, db AS threshold_db, array_to_string(bs, ',') AS boundaries, len(bs)=4 AS exact FROM bd")
def _(spark, d):
    return L.exact_splits(*_sweep(spark, d), 2000, 3, _SETTINGS).withColumn("boundaries", F.array_join("boundaries", ","))


@query("top01_threshold_sweep", f"WITH {_choice(_ACT)}, {_PLATEAUS}, {_RANKED} {_BEST} FROM rk")
def _(spark, d):
    chosen = L.choose_plateau(L.plateaus(L.strongest_splits(*_sweep(spark, d), 2000, _SETTINGS), 500))
    return chosen.withColumn("boundaries", F.array_join("boundaries", ","))


#: Pauses that compete: one per order on 48 sides, each falling silent at one of nine settings; every eighth side has short ones.
_SETS = "th AS (SELECT CAST(unnest(range(-70,-24)) AS DOUBLE) AS db), sd AS (SELECT DISTINCT o_custkey%48 AS rec_id, 200000 AS frames FROM orders)"
_PAUSES = """pa AS (SELECT o_custkey%48 AS rec_id, (o_orderkey*7919)%198000 AS s, CASE WHEN o_custkey%48%8=0 THEN 100+(o_orderkey*31)%1100 ELSE 400+(o_orderkey*31)%1600 END AS len, -72+5*((o_orderkey*13)%9) AS lvl FROM orders),
pt AS (SELECT rec_id, db, s, s+len AS e FROM pa, th WHERE db>lvl)"""
_PLAIN = f"{_SETS}, {_PAUSES}, fr AS (SELECT * FROM sd), sw AS (SELECT * FROM pt WHERE e-s>=600)"
#: The same sides twice: with long gaps, and, numbered from 1000, with shorter ones.
_TWICE = f"""{_SETS}, {_PAUSES}, fr AS (SELECT * FROM sd UNION ALL SELECT rec_id+1000, frames FROM sd),
sw AS (SELECT * FROM pt WHERE e-s>=1250 UNION ALL SELECT rec_id+1000, db, s, e FROM pt WHERE e-s>=600)"""
_RELAXED = """dv AS (SELECT DISTINCT rec_id FROM pl WHERE tracks>1),
px AS (SELECT * FROM pl), re AS (SELECT rec_id-1000 AS rec_id FROM dv WHERE rec_id>=1000 AND rec_id-1000 NOT IN (SELECT rec_id FROM dv)),
pr AS (SELECT px.* REPLACE (px.rec_id%1000 AS rec_id), px.rec_id>=1000 AS relaxed FROM px WHERE (px.rec_id>=1000)=(px.rec_id%1000 IN (SELECT rec_id FROM re)))"""


def _pauses(spark, d):
    o = V.table(spark, d, "orders")
    key, side = F.col("o_orderkey"), F.col("o_custkey") % 48
    length = F.when(side % 8 == 0, 100 + (key * 31) % 1100).otherwise(400 + (key * 31) % 1600)
    frames = stage(o.select(side.alias("rec_id"), F.lit(200_000).cast("long").alias("frames")).distinct(), "frames")
    at, level = (key * 7919) % 198_000, -72 + 5 * ((key * 13) % 9)
    # Settings are whole decibels: above the level means from the next one upward.
    silences = o.select(side.alias("rec_id"), at.alias("start"), (at + length).alias("end"), (level + 1).cast("double").alias("from_db"))
    return stage(silences.filter(F.col("end") - F.col("start") >= 600), "pauses"), frames


@query("top02_competing_splits", f"WITH {_choice(_PLAIN)} SELECT rec_id, db AS threshold_db, array_to_string(bs, ',') AS boundaries FROM bd")
def _(spark, d):
    return L.strongest_splits(*_pauses(spark, d), 2000, _SETTINGS).withColumn("boundaries", F.array_join("boundaries", ","))


@query("top02_counted_splits", f"WITH {_choice(_PLAIN, 5)} SELECT rec_id, db AS threshold_db, array_to_string(bs, ',') AS boundaries, len(bs)=7 AS exact FROM bd")
def _(spark, d):
    return L.exact_splits(*_pauses(spark, d), 2000, 6, _SETTINGS).withColumn("boundaries", F.array_join("boundaries", ","))


@query("top01_relaxed_sweep", f"WITH {_choice(_TWICE)}, {_PLATEAUS}, {_RELAXED}, {_RANKED.replace('FROM pl', 'FROM pr')} relaxed, {_BEST} FROM rk")
def _(spark, d):
    silences, frames = _pauses(spark, d)
    out = L.sweep_tracks(silences, frames, _SETTINGS, 2000, 500, 1250)
    return out.withColumn("boundaries", F.array_join("boundaries", ","))


@query("top01_sweep_for_tracks", f"""WITH {_choice(_TWICE, 5)}, {_PLATEAUS}, {_RELAXED}, {_RANKED.replace('FROM pl', 'FROM pr')} relaxed,
 tracks=6 AND row_number() OVER (PARTITION BY rec_id ORDER BY CASE WHEN tracks=6 THEN 0 ELSE 1 END, rank)=1 AS best FROM rk""")
def _(spark, d):
    silences, frames = _pauses(spark, d)
    out = L.sweep_tracks(silences, frames, _SETTINGS, 2000, 500, 1250, tracks=6)
    return out.withColumn("boundaries", F.array_join("boundaries", ","))


_SAID = """CASE WHEN NOT bool_or(best) THEN printf('never 6 tracks; settings give %s', array_to_string(list_sort(list(DISTINCT tracks)), ', ')) WHEN max(CASE WHEN best THEN tracks END)=1 THEN 'one track, no gap divides it'
 ELSE printf('%d tracks, the same from %.0f to %.0f dB', max(CASE WHEN best THEN tracks END), max(CASE WHEN best THEN low_db END), max(CASE WHEN best THEN high_db END))||CASE WHEN bool_or(best AND relaxed) THEN ', by shorter gaps' ELSE '' END END AS sentence"""


@query("fun28_sweep_sentences", f"""WITH {_choice(_TWICE)}, {_PLATEAUS}, {_RELAXED}, sq AS ({_RANKED.replace('FROM pl', 'FROM pr').replace('rk AS', 'WITH rk AS')} relaxed, {_BEST} FROM rk)
SELECT rec_id, {_SAID} FROM sq GROUP BY rec_id""")
def _(spark, d):
    return L.sweep_sentences(L.sweep_tracks(*_pauses(spark, d), _SETTINGS, 2000, 500, 1250))


@query("fun28_counted_sweep_sentences", f"""WITH {_choice(_TWICE, 5)}, {_PLATEAUS}, {_RELAXED}, sq AS ({_RANKED.replace('FROM pl', 'FROM pr').replace('rk AS', 'WITH rk AS')} relaxed,
 tracks=6 AND row_number() OVER (PARTITION BY rec_id ORDER BY CASE WHEN tracks=6 THEN 0 ELSE 1 END, rank)=1 AS best FROM rk)
SELECT rec_id, {_SAID} FROM sq GROUP BY rec_id""")
def _(spark, d):
    return L.sweep_sentences(L.sweep_tracks(*_pauses(spark, d), _SETTINGS, 2000, 500, 1250, tracks=6), 6)


_TRK = f"""WITH {SIL}, b AS (SELECT rec_id, CAST(s+(e-s)//2 AS BIGINT) AS m FROM sil), p AS (SELECT rec_id, m FROM b UNION ALL SELECT rec_id, 0 FROM fr UNION ALL SELECT rec_id, frames FROM fr),
t AS (SELECT rec_id, m AS s, lead(m) OVER (PARTITION BY rec_id ORDER BY m) AS e, row_number() OVER (PARTITION BY rec_id ORDER BY m) AS track FROM p), trk AS (SELECT * FROM t WHERE e>s)"""


def _tracks(spark, d, samples):
    """Cut in the middle of every silence."""
    silences, frames = _silences(spark, d, samples)
    middle = F.col("start") + F.floor((F.col("end") - F.col("start")) / 2)
    cuts = silences.groupBy("rec_id").agg(F.array_sort(F.collect_list(middle)).alias("c")).join(frames, "rec_id", "right").select(
        "rec_id", F.concat(F.array(F.lit(0).cast("long")), F.coalesce("c", F.array().cast("array<long>")), F.array("frames")).alias("c"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("c") - 1), lambda i: F.struct(
        i.cast("long").alias("track"), F.element_at("c", i).alias("start"), F.element_at("c", i + 1).alias("end")))
    return cuts.select("rec_id", F.inline(pairs)).filter("end > start")


@query("join10_trim_to_music", _TRK + """, f AS (SELECT trk.rec_id, track, min(n) AS a, max(n)+1 AS z FROM trk JOIN v_stereo v ON v.rec_id=trk.rec_id AND n>=s AND n<e AND abs(v)>=0.01 GROUP BY 1,2),
g AS (SELECT trk.*, CASE WHEN trk.track=min(trk.track) OVER (PARTITION BY trk.rec_id) THEN s ELSE a END AS m, CASE WHEN trk.track=max(trk.track) OVER (PARTITION BY trk.rec_id) THEN e ELSE z END AS q FROM trk LEFT JOIN f ON f.rec_id=trk.rec_id AND f.track=trk.track)
SELECT rec_id, track, CAST(CASE WHEN m<q THEN m ELSE s END AS BIGINT) AS "start", CAST(CASE WHEN m<q THEN q ELSE e END AS BIGINT) AS "end" FROM g""")
def _(spark, d):
    s = V.stereo(spark, d)
    return K.trim_to_music(s, _tracks(spark, d, s), -40.0)


@query("join17_plan_diff", _TRK + """, w AS (SELECT rec_id, track, s, CASE WHEN track=1 THEN s ELSE s+(rec_id-1)*37*track END AS s2 FROM trk), c AS (SELECT rec_id, count(*) AS n, max(CASE WHEN rec_id=0 THEN 1 ELSE 0 END) AS one FROM trk GROUP BY 1),
m AS (SELECT rec_id, arg_max(s2-s, abs(s2-s)) AS mv FROM w GROUP BY 1)
SELECT c.rec_id, CAST(n AS BIGINT) AS previous, CAST(n-one AS BIGINT) AS proposed, CASE WHEN one=0 THEN mv/1000.0::DOUBLE END AS worst_move_s,
 printf('%d planned', n-one) || CASE WHEN one=1 THEN printf(', %d before', n) WHEN mv=0 THEN ', starts unchanged' ELSE printf(', starts shift by at most %.1f s (%s)', abs(mv)/1000.0::DOUBLE, CASE WHEN mv<0 THEN 'earlier' ELSE 'later' END) END AS sentence FROM c JOIN m USING (rec_id)""")
def _(spark, d):
    old = stage(_tracks(spark, d, V.stereo(spark, d)), "tracks")
    moved = F.when(F.col("track") == 1, F.col("start")).otherwise(F.col("start") + (F.col("rec_id") - 1) * 37 * F.col("track"))
    # The second plan shifts every later boundary; recording 0 also loses its first track.
    new = old.withColumn("start", moved).filter(~((F.col("rec_id") == 0) & (F.col("track") == 1)))
    return K.plan_diff(old, new, V.LR_RATE)


def _files(spark, d):
    """A disc per customer: one file per order."""
    o = V.table(spark, d, "orders")
    frames = ((F.col("o_orderkey") * 37) % 500 + 50) * 4410
    title = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.concat("o_orderpriority", F.lit(' "'), F.col("o_orderkey").cast("string"), F.lit('"')))
    return o.select(F.col("o_custkey").alias("disc_id"), F.col("o_orderkey").alias("position"), title.alias("title"), frames.alias("frames"))


_ASM = """fl AS (SELECT o_custkey AS disc_id, o_orderkey AS position, CASE WHEN o_orderkey%5=0 THEN '' ELSE o_orderpriority||' "'||o_orderkey||'"' END AS title, ((o_orderkey*37)%500+50)*4410 AS f FROM orders),
asm AS (SELECT disc_id, row_number() OVER w AS track, title AS raw, sum(f) OVER w AS e, f FROM fl WINDOW w AS (PARTITION BY disc_id ORDER BY position)),
pln AS (SELECT disc_id, track, CASE WHEN trim(raw)='' THEN printf('Track %02d', track) ELSE trim(raw) END AS title, CAST(e-f AS BIGINT) AS s, CAST(e AS BIGINT) AS e, CASE WHEN track=1 THEN 0 ELSE 150 END AS pregap FROM asm),
ln AS (SELECT disc_id, max(e) AS frames FROM pln GROUP BY 1),
sc AS (SELECT pln.*, frames, CASE WHEN s<=0 THEN 0 ELSE floor(s*44100.0::DOUBLE/44100/588.0::DOUBLE+0.5) END AS a, CASE WHEN e<=0 THEN 0 WHEN e>=frames THEN ceil(e*44100.0::DOUBLE/44100/588.0::DOUBLE) ELSE floor(e*44100.0::DOUBLE/44100/588.0::DOUBLE+0.5) END AS z FROM pln JOIN ln USING (disc_id)),
ps AS (SELECT disc_id, track, title, CAST(sum(pregap+greatest(0,z-a)) OVER w-greatest(0,z-a)+150 AS BIGINT) AS start_sector, CAST(greatest(0,z-a) AS BIGINT) AS sectors, CAST(sum(pregap+greatest(0,z-a)) OVER (PARTITION BY disc_id)+150 AS BIGINT) AS lead_out FROM sc WINDOW w AS (PARTITION BY disc_id ORDER BY track))"""


def _plan(spark, d):
    plan = K.assemble(_files(spark, d), 2.0)
    lengths = _files(spark, d).groupBy("disc_id").agg(F.sum("frames").alias("frames"))
    return plan, lengths


@query("win28_assemble", f"WITH {_ASM} SELECT disc_id, CAST(track AS BIGINT) AS track, title, s AS \"start\", e AS \"end\", CAST(pregap AS BIGINT) AS pregap FROM pln")
def _(spark, d):
    return _plan(spark, d)[0]


@query("win27_disc_positions", f"WITH {_ASM} SELECT disc_id, CAST(track AS BIGINT) AS track, title, start_sector, sectors, lead_out FROM ps")
def _(spark, d):
    return K.disc_positions(*_plan(spark, d), 44100)


@query("snk05_cue_sheet", f"""WITH {_ASM} SELECT disc_id, CAST(track AS BIGINT) AS track, printf('  TRACK %02d AUDIO', track)||chr(10)||'    TITLE "'||trim(replace(title,'"',''''))||'"'||chr(10)||
 printf('    INDEX 01 %02d:%02d:%02d', (start_sector-150)//4500, (start_sector-150)//75%60, (start_sector-150)%75) AS sheet FROM ps""")
def _(spark, d):
    return K.cue_sheet(K.disc_positions(*_plan(spark, d), 44100))


def _cd(x):
    return f"printf('%02d:%02d:%02d', ({x})//4500, ({x})//75%60, ({x})%75)"


@query("snk05_image_sheet", f"""WITH {_ASM} SELECT disc_id, CAST(0 AS BIGINT) AS track, 'TITLE "disc-'||disc_id||'"'||chr(10)||'PERFORMER "House Band"'||chr(10)||'FILE "disc-'||disc_id||'.wav" WAVE' AS sheet FROM (SELECT DISTINCT disc_id FROM ps)
 UNION ALL SELECT disc_id, CAST(track AS BIGINT), printf('  TRACK %02d AUDIO', track)||chr(10)||'    TITLE "'||trim(replace(ps.title,'"',''''))||'"'||chr(10)||
 CASE WHEN pregap>0 THEN '    INDEX 00 '||{_cd("start_sector-150-pregap")}||chr(10) ELSE '' END||'    INDEX 01 '||{_cd("start_sector-150")} FROM ps JOIN pln USING (disc_id, track)""")
def _(spark, d):
    plan, lengths = _plan(spark, d)
    return K.image_sheet(plan, K.disc_positions(plan, lengths, 44100), "House Band")


@query("snk05_pq_rows", f"""WITH {_ASM} SELECT disc_id, printf('%02d', track) AS entry, {_cd("start_sector")} AS start, {_cd("sectors")} AS length FROM ps
 UNION ALL SELECT DISTINCT disc_id, 'AA', {_cd("lead_out")}, NULL FROM ps""")
def _(spark, d):
    return K.pq_sheet(K.disc_positions(*_plan(spark, d), 44100))


@query("ds09_plan_issues", f"""WITH {_ASM}, q AS (SELECT sc.*, CASE WHEN track%5=0 THEN s ELSE e END AS e2, CASE WHEN track%7=0 THEN '' ELSE title END AS t2, CASE WHEN track%4=0 THEN 'US-BAD' ELSE 'USS1Z9900001' END AS isrc FROM sc),
r AS (SELECT *, e2<=s AS emp, greatest(0,(CASE WHEN e2>=frames THEN ceil(e2/588.0::DOUBLE) ELSE floor(e2/588.0::DOUBLE+0.5) END)-a) AS sec FROM q),
i AS (SELECT disc_id, unnest(list_filter([CASE WHEN emp THEN 'error|'||printf('Track %02d covers no audio.', track) END, CASE WHEN NOT emp AND sec*588/44100.0::DOUBLE<4 THEN 'error|'||printf('Track %02d is shorter than 4 s.', track) END,
 CASE WHEN NOT emp AND t2='' THEN 'warning|'||printf('Track %02d has no title.', track) END, CASE WHEN NOT emp AND isrc='US-BAD' THEN 'warning|'||printf('Track %02d has an invalid ISRC.', track) END], lambda x: x IS NOT NULL)) AS m FROM r
 UNION ALL SELECT disc_id, 'error|A CD holds at most 99 tracks.' FROM r GROUP BY 1 HAVING count(*)>99 UNION ALL SELECT disc_id, 'error|The tracks are longer than a CD.' FROM r GROUP BY 1 HAVING sum(CASE WHEN emp THEN 0 ELSE sec+pregap END)/75>4800)
SELECT disc_id, split_part(m,'|',1) AS severity, split_part(m,'|',2) AS message FROM i""")
def _(spark, d):
    plan, lengths = _plan(spark, d)
    broken = plan.withColumns({
        "end": F.when(F.col("track") % 5 == 0, F.col("start")).otherwise(F.col("end")),
        "title": F.when(F.col("track") % 7 == 0, "").otherwise(F.col("title")),
        "isrc": F.when(F.col("track") % 4 == 0, "US-BAD").otherwise("USS1Z9900001"),
    })
    return K.plan_issues(broken, lengths, 44100)


_TOC = _ASM + """, en AS (SELECT disc_id, track AS number, s AS st, track%6=0 AS dt FROM pln UNION ALL SELECT disc_id, 170, frames, false FROM ln UNION ALL SELECT disc_id, track, s, false FROM pln WHERE disc_id%50=0 AND track=2),
so AS (SELECT disc_id, max(CASE WHEN track=4 THEN s-1000 END) AS lo FROM pln GROUP BY 1),
ne AS (SELECT *, lead(number) OVER w AS nx, lead(st) OVER w AS ns, count(*) OVER (PARTITION BY disc_id, number) AS c FROM en WINDOW w AS (PARTITION BY disc_id ORDER BY CASE WHEN number=170 THEN 1000 ELSE number END)),
nf AS (SELECT ne.*, CASE WHEN NOT dt AND number=3 AND nx=4 THEN lo ELSE ns END AS en FROM ne JOIN so USING (disc_id) WHERE number<>170),
np AS (SELECT *, CASE WHEN c>1 THEN 'repeated entry' WHEN number>99 THEN 'invalid track number' WHEN nx<>170 AND nx<>number+1 THEN 'missing track' WHEN ns<=st THEN 'invalid sector range' WHEN en<=st OR en>ns THEN 'invalid session lead-out' END AS problem FROM nf)"""


def _toc(spark, d):
    plan, lengths = _plan(spark, d)
    plan = stage(plan, "plan")
    entries = plan.select("disc_id", F.col("track").alias("number"), "start", (F.col("track") % 6 == 0).alias("is_data"))
    out = lengths.select("disc_id", F.lit(170).cast("long").alias("number"), F.col("frames").alias("start"), F.lit(False).alias("is_data"))
    twice = entries.filter("disc_id % 50 = 0 AND number = 2").withColumn("is_data", F.lit(False))
    fourth = plan.filter("track = 4").select("disc_id", (F.col("start") - 1000).alias("_o"))
    two = lengths.select("disc_id").join(fourth, "disc_id", "left").select("disc_id", F.inline(F.array(
        F.struct(F.lit(1).alias("session"), F.lit(1).cast("long").alias("first"), F.lit(3).cast("long").alias("last"), F.col("_o").alias("lead_out")),
        F.struct(F.lit(2).alias("session"), F.lit(4).cast("long").alias("first"), F.lit(99).cast("long").alias("last"), F.lit(None).cast("long").alias("lead_out")))))
    return K.tracks_from_toc(entries.unionByName(out).unionByName(twice), two)


@query("win30_disc_tracks", f"WITH {_TOC} SELECT disc_id, CAST(number AS BIGINT) AS number, st AS \"start\", CAST(en-st AS BIGINT) AS length, dt AS is_data FROM np WHERE disc_id NOT IN (SELECT disc_id FROM np WHERE problem IS NOT NULL)")
def _(spark, d):
    return _toc(spark, d)[0]


@query("win30_rejected_discs", f"WITH {_TOC} SELECT DISTINCT disc_id, problem AS reason FROM np WHERE problem IS NOT NULL")
def _(spark, d):
    return _toc(spark, d)[1]


@query("set10_plan_from_regions", """WITH r AS (SELECT o_custkey AS rec_id, o_orderkey AS region, o_orderpriority AS name, (o_orderkey*7919)%100000-500 AS s, (o_orderkey*7919)%100000+(o_orderkey%900)-600 AS e, CASE WHEN o_custkey%3=0 AND o_orderkey%2=0 THEN CAST(o_orderkey%7+1 AS INT) END AS cd FROM orders),
a AS (SELECT *, bool_or(coalesce(cd>0,false)) OVER (PARTITION BY rec_id) AS an FROM r), k AS (SELECT *, least(100000,greatest(0,s)) AS s1, least(100000,greatest(0,e)) AS e1 FROM a WHERE NOT an OR coalesce(cd>0,false))
SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY CASE WHEN an THEN cd ELSE 0 END, region) AS track, trim(name) AS title, s1 AS "start", e1 AS "end" FROM k WHERE e1>s1""")
def _(spark, d):
    o = V.table(spark, d, "orders")
    at = (F.col("o_orderkey") * 7919) % 100000
    regions = o.select(
        F.col("o_custkey").alias("rec_id"), F.col("o_orderkey").alias("region"), F.col("o_orderpriority").alias("name"),
        (at - 500).alias("start"), (at + F.col("o_orderkey") % 900 - 600).alias("end"),
        F.when((F.col("o_custkey") % 3 == 0) & (F.col("o_orderkey") % 2 == 0), F.col("o_orderkey") % 7 + 1).cast("int").alias("cd_order"))
    lengths = o.select(F.col("o_custkey").alias("rec_id")).distinct().withColumn("frames", F.lit(100000).cast("long"))
    return K.plan_from_regions(regions, lengths)


# --- timelines ---------------------------------------------------------------------------------------------


@query("join14_neighbour_pairs", """WITH c AS (SELECT *, timeline_start+length AS te FROM v_clips), n AS (SELECT *, lead(clip_id) OVER w AS nc, lead(timeline_start) OVER w AS ns, lead(te) OVER w AS ne, lead(timeline_start,2) OVER w AS n2, lead(te,2) OVER w AS e2 FROM c WINDOW w AS (PARTITION BY timeline_id ORDER BY timeline_start, te, clip_id))
SELECT timeline_id, clip_id, coalesce(nc,-1) AS next_clip_id, CAST(CASE WHEN ns IS NULL THEN 0 ELSE greatest(0,least(te,ne)-greatest(timeline_start,ns)) END AS BIGINT) AS overlap, CAST(CASE WHEN ns IS NULL THEN 0 ELSE greatest(0,ns-te) END AS BIGINT) AS gap, (n2 IS NOT NULL AND least(te,e2)-greatest(timeline_start,n2)>0) AS triple FROM n""")
def _(spark, d):
    return M.neighbour_pairs(V.clips(spark, d), 1_000_000).withColumn("next_clip_id", F.coalesce("next_clip_id", F.lit(-1)))


def _sources(spark, d):
    return V.sig(spark, d).withColumnRenamed("rec_id", "source_id")


@query("join13_clip_samples", """SELECT timeline_id, clip_id, ch, source_start+n-source_start+timeline_start AS t, round(v,6)+0.0::DOUBLE AS v FROM v_clips JOIN v_sig ON rec_id=source_id AND n>=source_start AND n<source_start+length""")
def _(spark, d):
    return M.clip_samples(V.clips(spark, d), _sources(spark, d)).select("timeline_id", "clip_id", "ch", "t", r6("v").alias("v"))


@query("join13_missing_sources", "SELECT timeline_id, clip_id, source_id FROM v_clips WHERE source_id NOT IN (SELECT DISTINCT rec_id FROM v_sig)")
def _(spark, d):
    return M.missing_sources(V.clips(spark, d), _sources(spark, d))


_FCLIP = """fc AS (SELECT *, timeline_start+length AS te, (clip_id%7-3)*1.5::DOUBLE AS gain_db, clip_id%60 AS fi, clip_id%90 AS fo, ['Linear','EqualPower','SCurve','DecibelLinear'][clip_id%4+1] AS shape FROM v_clips),
nb AS (SELECT *, lead(clip_id) OVER w AS nc, lead(timeline_start) OVER w AS ns, lead(te) OVER w AS ne, lead(shape) OVER w AS nsh, lag(timeline_start) OVER w AS ps, lag(te) OVER w AS pe FROM fc WINDOW w AS (PARTITION BY timeline_id ORDER BY timeline_start, te, clip_id)),
cs AS (SELECT nb.*, n AS i, n+timeline_start AS t, v FROM nb JOIN v_sig ON rec_id=source_id AND n<length),
xo AS (SELECT timeline_id, clip_id, nc, t, v FROM cs WHERE nc IS NOT NULL AND t>=greatest(timeline_start,ns) AND t<least(te,ne)), xi AS (SELECT a.timeline_id, a.clip_id, b.t, b.v AS w FROM nb a JOIN cs b ON b.timeline_id=a.timeline_id AND b.clip_id=a.nc AND b.t>=greatest(a.timeline_start,a.ns) AND b.t<least(a.te,a.ne)),
xc AS (SELECT timeline_id, clip_id, sum(coalesce(v,0)*coalesce(w,0)) AS p, sum(coalesce(v,0)*coalesce(v,0))*sum(coalesce(w,0)*coalesce(w,0)) AS e FROM xo FULL JOIN xi USING (timeline_id, clip_id, t) GROUP BY 1,2),
co AS (SELECT timeline_id, clip_id, CASE WHEN sqrt(e)>0 THEN greatest(0,p/sqrt(e)) ELSE 0 END AS rho FROM xc)"""


def _fclips(spark, d):
    shape = F.element_at(F.array(*[F.lit(x) for x in ("Linear", "EqualPower", "SCurve", "DecibelLinear")]), (F.col("clip_id") % 4 + 1).cast("int"))
    return V.clips(spark, d).withColumns({
        "gain_db": (F.col("clip_id") % 7 - 3) * 1.5, "fade_in": F.col("clip_id") % 60, "fade_out": F.col("clip_id") % 90, "fade_shape": shape})


@query("ds10_crossfade_correlations", f"WITH {_FCLIP} SELECT co.timeline_id, co.clip_id, nc AS next_clip_id, round(rho,6) AS correlation FROM co JOIN nb USING (timeline_id, clip_id)")
def _(spark, d):
    return M.crossfade_correlations(_fclips(spark, d), _sources(spark, d), 1_000_000).withColumn("correlation", r6("correlation"))


def _fade(t, shape):
    u = f"least(1,greatest(0,{t}))"
    return f"CASE {shape} WHEN 'EqualPower' THEN sin({u}*pi()/2) WHEN 'SCurve' THEN (1-cos({u}*pi()))/2 WHEN 'DecibelLinear' THEN (pow(10.0::DOUBLE,{u}*60/20)-1)/(pow(10.0::DOUBLE,3)-1) ELSE {u} END"


_MIX = _FCLIP + f""", e1 AS (SELECT cs.*, coalesce(rho,0) AS rho, CASE WHEN ps IS NULL THEN 0 ELSE greatest(0,least(te,pe)-greatest(timeline_start,ps)) END AS ld, CASE WHEN ns IS NULL THEN 0 ELSE greatest(0,least(te,ne)-greatest(timeline_start,ns)) END AS tr, ns-timeline_start AS na,
 CASE WHEN least(fi,length)+least(fo,length)>length THEN floor(least(fi,length)*(length/(least(fi,length)+least(fo,length))::DOUBLE)) ELSE least(fi,length) END AS hd, CASE WHEN least(fi,length)+least(fo,length)>length THEN floor(least(fo,length)*(length/(least(fi,length)+least(fo,length))::DOUBLE)) ELSE least(fo,length) END AS tl FROM cs LEFT JOIN co USING (timeline_id, clip_id)),
e2 AS (SELECT *, {_fade('(i-na)/greatest(1,tr-1)::DOUBLE', 'nsh')} AS a FROM e1),
e3 AS (SELECT *, CASE WHEN ld>0 AND i<ld THEN {_fade('i/greatest(1,ld-1)::DOUBLE', 'shape')} WHEN ld=0 AND i<hd THEN {_fade('i/greatest(1,hd-1)::DOUBLE', 'shape')} ELSE 1 END AS gi,
 CASE WHEN tr>0 AND i>=na AND i<na+tr THEN least(1,greatest(0,-rho*a+sqrt(greatest(0,1-a*a*(1-rho*rho))))) WHEN tr=0 AND i-(length-tl)>=0 THEN {_fade('(1-(i-(length-tl))/greatest(1,tl-1)::DOUBLE)', 'shape')} ELSE 1 END AS gof FROM e2)"""


@query("ds10_timeline_mix", f"WITH {_MIX} SELECT timeline_id, CAST(0 AS BIGINT) AS ch, t, round(sum(v*gi*gof*pow(10.0::DOUBLE,gain_db/20)),6)+0.0::DOUBLE AS v FROM e3 GROUP BY timeline_id, t")
def _(spark, d):
    clips, sources = stage(_fclips(spark, d), "clips"), stage(_sources(spark, d), "sources")
    rho = M.crossfade_correlations(clips, sources, 1_000_000)
    return M.render(clips, sources, rho, 1_000_000).withColumn("v", r6("v"))


@query("ds10_timeline_issues", f"""WITH {_FCLIP}, sl AS (SELECT rec_id, max(n)+1-2150 AS len FROM v_sig GROUP BY 1), n2 AS (SELECT *, lead(timeline_start,2) OVER w AS s2 FROM fc WINDOW w AS (PARTITION BY timeline_id ORDER BY timeline_start, te, clip_id)),
i AS (SELECT timeline_id, clip_id, unnest(list_filter([CASE WHEN len IS NULL THEN 'error|source not loaded' END, CASE WHEN length>len THEN 'warning|reads past the source' END, CASE WHEN len IS NOT NULL AND fi+fo>length THEN 'warning|fades longer than the clip' END,
 CASE WHEN len IS NOT NULL AND te>s2 THEN 'warning|three clips overlap' END], lambda x: x IS NOT NULL)) AS m FROM n2 LEFT JOIN sl ON rec_id=source_id) SELECT timeline_id, clip_id, split_part(m,'|',1) AS severity, split_part(m,'|',2) AS message FROM i""")
def _(spark, d):
    # Sources are declared shorter than they are, so that some clips read past their end.
    lengths = _sources(spark, d).groupBy("source_id").agg((F.max("n") + 1 - 2150).alias("source_length"))
    return M.timeline_issues(_fclips(spark, d), lengths, 1_000_000)


# --- catalogue ---------------------------------------------------------------------------------------------


@query("src02_file_catalogue")
def _(spark, d):
    return A.file_catalogue(spark, d, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "extension", "format")


@query("src02_duplicate_files")
def _(spark, d):
    return A.duplicate_files(spark, d, "*.parquet").select("hash", "length", "copies")


@query("src03_sidecars", """SELECT url AS path, CAST(page_id%3+1 AS BIGINT) AS markers, page_id AS first_position FROM pages WHERE page_id%4<>1""")
def _(spark, d):
    pages = V.table(spark, d, "pages")
    size, ticks = F.length("html").cast("long"), F.col("page_id") * 1000
    path = F.concat(F.col("page_id").cast("string"), F.lit(" "), "url")  # one file a page, also where two pages share their URL
    files = pages.select(path.alias("path"), size.alias("length"), ticks.alias("ticks"))
    marks = F.transform(F.sequence(F.lit(0), (F.col("page_id") % 3).cast("int")), lambda i: F.struct(F.lit("cue").alias("name"), (F.col("page_id") + i).alias("position")))
    stale = F.when(F.col("page_id") % 4 == 1, 1).otherwise(0)  # a quarter of the files changed since
    unstamped = F.col("page_id") % 4 == 2  # and a quarter never had a stamp
    side = pages.select(path.alias("path"), F.to_json(F.struct(
        marks.alias("markers"), F.when(~unstamped, size + stale).alias("audio_length_bytes"), ticks.alias("audio_write_ticks"))).alias("json"))
    return A.valid_sidecars(side, files).select(F.expr("substring(path, instr(path, ' ') + 1)").alias("path"), F.size("markers").cast("long").alias("markers"), F.element_at("markers", 1)["position"].alias("first_position"))


@query("src06_montage_documents", "SELECT timeline_id, clip_id, source_id, (source_id IN (SELECT DISTINCT rec_id FROM v_sig)) AS loaded FROM v_clips")
def _(spark, d):
    clip = F.struct("clip_id", "source_id", "source_start", "length", "timeline_start")
    # One document per timeline and thousand clips, as a montage file is one person's work and stays small.
    docs = V.clips(spark, d).groupBy("timeline_id", F.floor(F.col("timeline_start") / 400000).alias("part")).agg(F.collect_list(clip).alias("clips")).select(
        "timeline_id", F.to_json(F.struct(F.lit("montage").alias("title"), "clips")).alias("json"))
    known = _sources(spark, d).select("source_id").distinct().withColumn("_k", F.lit(True))
    return A.parse_montages(docs).join(known, "source_id", "left").select("timeline_id", "clip_id", "source_id", F.coalesce("_k", F.lit(False)).alias("loaded"))


@query("snk03_output_plan", """WITH f AS (SELECT page_id AS item, CASE WHEN page_id%10=3 THEN 'out/'||upper(split_part(url,'/',3))||'.wav' ELSE 'in/'||split_part(url,'/',3)||'.mp3' END AS path FROM pages),
o AS (SELECT item, path, 'out/'||regexp_replace(list_extract(string_split(path,'/'),-1),'\\.[^.]*$','')||'.wav' AS output FROM f), s AS (SELECT *, lower(output) IN (SELECT lower(path) FROM f) AS src FROM o),
w AS (SELECT lower(output) AS k, min(item) AS win FROM s WHERE NOT src GROUP BY 1), e AS (SELECT DISTINCT lower('out/'||split_part(url,'/',3)||'.wav') AS k FROM pages WHERE page_id%7=0)
SELECT item, output, CASE WHEN src THEN 'failed: output collides with a source file' WHEN item<>win THEN 'failed: output path collision' WHEN e.k IS NOT NULL THEN 'exists' ELSE 'ready' END AS status FROM s LEFT JOIN w ON w.k=lower(output) LEFT JOIN e ON e.k=lower(output)""")
def _(spark, d):
    pages = V.table(spark, d, "pages")
    host = F.split_part("url", F.lit("/"), F.lit(3))
    path = F.when(F.col("page_id") % 10 == 3, F.concat(F.lit("out/"), F.upper(host), F.lit(".wav"))).otherwise(F.concat(F.lit("in/"), host, F.lit(".mp3")))
    existing = pages.filter("page_id % 7 = 0").select(F.concat(F.lit("out/"), host, F.lit(".wav")).alias("path"))
    return A.output_plan(pages.select(F.col("page_id").alias("item"), path.alias("path")), "out", ".wav", existing)


@query("snk06_normalised_tags", """SELECT p_partkey AS file_id, p_name AS title, p_brand AS artist, CASE WHEN p_partkey%3=2 THEN '' ELSE p_type END AS album, CASE WHEN p_partkey%3=2 THEN CAST(p_size AS VARCHAR) ELSE '' END AS track, '' AS genre, '' AS year,
 CASE WHEN p_partkey%3=2 THEN 'side '||p_type||chr(10)||'plain' ELSE '' END AS comment FROM part""")
def _(spark, d):
    k = F.col("p_partkey") % 3
    def pick(a, b, c):
        return F.when(k == 0, a).when(k == 1, b).otherwise(c)
    note = F.concat(F.lit("side "), "p_type", F.lit("\nTrack: "), F.col("p_size").cast("string"), F.lit("\n plain "))
    rows = F.array(
        F.struct(pick("INAM", "TIT2", "NAME").alias("key"), F.col("p_name").alias("value")),
        F.struct(pick("IART", "TPE1", "AUTH").alias("key"), F.concat(F.lit(" "), "p_brand").alias("value")),
        F.struct(pick("IPRD", "TALB", "ANNO").alias("key"), F.when(k == 2, note).otherwise(F.col("p_type")).alias("value")))
    return A.normalise_tags(V.table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), F.inline(rows)))


@query("snk04_partitioned_write", "SELECT rec_id, CAST(count(*) AS BIGINT) AS blocks, round(sum(pk),5) AS total FROM (SELECT rec_id, n//256 AS block, max(abs(v)) AS pk FROM v_stereo GROUP BY 1,2) GROUP BY rec_id")
def _(spark, d):
    path = scratch_path(spark, "block_peaks")
    peaks = S.block_peaks(V.stereo(spark, d))
    A.write_partitioned(peaks, path, ["rec_id"])
    A.write_partitioned(peaks.filter("rec_id = 1"), path, ["rec_id"])  # the same partition again changes nothing
    return spark.read.parquet(path).groupBy(F.col("rec_id").cast("long").alias("rec_id")).agg(
        F.count(F.lit(1)).alias("blocks"), r6(F.sum("peak"), 5).alias("total"))

"""Disc tables and catalogues at sizes where a list of numbers or a whole file would not fit."""

from phonolake.operators import tracks as K


def test_sessions_meet_entries_by_range_without_listing_numbers(spark):
    entries = spark.createDataFrame(
        [(1, 1, 0, False), (1, 2, 100, False), (1, 3, 300, False), (1, 170, 500, False), (2, 1, 0, False), (2, 170, 9, False)],
        "disc_id long, number long, start long, is_data boolean")
    last = 10**12  # a listed range of this length could not be made at all
    sessions = spark.createDataFrame(
        [(1, 1, 1, 2, 250), (1, 2, 3, last, None)], "disc_id long, session int, first long, last long, lead_out long")
    good, rejects = K.tracks_from_toc(entries, sessions)
    assert sorted((r.disc_id, r.number, r.length) for r in good.collect()) == [(1, 1, 100), (1, 2, 150), (1, 3, 200), (2, 1, 9)]
    assert rejects.count() == 0


def test_equal_files_are_hashed_piece_by_piece(spark, tmp_path, monkeypatch):
    from phonolake.sources import catalog as A

    for name, body in (("a.bin", b"x" * 100), ("b %20#1.bin", b"x" * 100), ("c.bin", b"y" * 100), ("d e.bin", b"z")):
        (tmp_path / name).write_bytes(body)
    found = A.duplicate_files(spark, str(tmp_path))
    assert [(r.length, r.copies, r.first_path.rsplit("/", 1)[1]) for r in found.collect()] == [(100, 2, "a.bin")]
    assert "sha2" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_clip_joins_slices_not_samples(spark):
    from pyspark.sql import functions as F

    from phonolake.operators import timeline as M

    sources = spark.range(2000).select(F.lit(1).cast("long").alias("source_id"), F.lit(0).cast("long").alias("ch"), F.col("id").alias("n"), F.col("id").cast("double").alias("v"))
    clips = spark.createDataFrame([(1, 1, 1, 250, 20, 1000), (1, 2, 1, 1990, 50, 2000), (1, 3, 9, 0, 5, 0), (1, 4, 1, 0, 0, 0)],
                                  "timeline_id long, clip_id long, source_id long, source_start long, length long, timeline_start long")
    out = M.clip_samples(clips, sources)
    got = sorted((r.clip_id, r.t, r.v) for r in out.collect())
    assert got == [(1, 1000 + i, 250.0 + i) for i in range(20)] + [(2, 2000 + i, 1990.0 + i) for i in range(10)]
    assert "inline" in out._jdf.queryExecution().optimizedPlan().toString()


def test_mix_sums_only_shared_stretches(spark):
    import math
    import random
    from collections import defaultdict

    from phonolake.operators import timeline as M

    rng = random.Random(3)
    shapes = ["Linear", "EqualPower", "SCurve", "DecibelLinear", None]
    sources = [(s, c, n, rng.choice([0.5, -1.0, 0.25, float("nan"), None]) if n % 9 == 0 else rng.uniform(-1, 1)) for s in (1, 2) for c in (0, 1) for n in range(400)]
    clips, at = [], 0
    for k in range(60):
        at += rng.choice([0, 5, 40, 90, 200])
        clips.append((k % 2, k, rng.choice([1, 2, 3]), rng.randrange(390), rng.choice([0, 1, 30, 150]), at, rng.choice([-6.0, 0.0, 3.0]), rng.randrange(60), rng.randrange(60), shapes[k % 5]))
    rho = [(t, k, rng.random()) for t, k, *_ in clips if k % 3]

    def law(t, shape):
        u = min(1.0, max(0.0, t))
        return {"EqualPower": math.sin(u * math.pi / 2), "SCurve": (1 - math.cos(u * math.pi)) / 2, "DecibelLinear": (10 ** (3 * u) - 1) / 999}.get(shape, u)

    want, by_source, rhos = defaultdict(float), defaultdict(list), {(t, k): r for t, k, r in rho}
    for s, c, n, v in sources:
        by_source[s].append((c, n, v))
    for line in (0, 1):
        row = sorted((c for c in clips if c[0] == line), key=lambda c: (c[5], c[5] + c[4], c[1]))
        for k, (_, clip, source, first, length, start, db, fin, fout, shape) in enumerate(row):
            def common(o):
                return max(0, min(start + length, o[5] + o[4]) - max(start, o[5]))

            before, after = row[k - 1] if k else None, row[k + 1] if k + 1 < len(row) else None
            lead, trail = common(before) if before else 0, common(after) if after else 0
            head, tail = min(fin, length), min(fout, length)
            if head + tail > length:
                head, tail = math.floor(head * (length / (head + tail))), math.floor(tail * (length / (head + tail)))
            for c, n, v in by_source[source]:
                i = n - first
                if not 0 <= i < length or v is None or math.isnan(v):
                    continue
                g = law(i / max(1, lead - 1), shape) if lead > 0 and i < lead else law(i / max(1, head - 1), shape) if lead == 0 and i < head else 1.0
                if trail > 0 and after[5] - start <= i < after[5] - start + trail:
                    a, r = law((i - after[5] + start) / max(1, trail - 1), after[9]), rhos.get((line, clip), 0.0)
                    g *= min(1.0, max(0.0, -r * a + math.sqrt(max(0.0, 1 - a * a * (1 - r * r)))))
                elif trail == 0 and i - (length - tail) >= 0:
                    g *= law(1 - (i - (length - tail)) / max(1, tail - 1), shape)
                want[line, c, start + i] += v * g * 10 ** (db / 20)

    out = M.render(
        spark.createDataFrame(clips, "timeline_id long, clip_id long, source_id long, source_start long, length long, timeline_start long, "
                                     "gain_db double, fade_in long, fade_out long, fade_shape string"),
        spark.createDataFrame(sources, "source_id long, ch long, n long, v double"),
        spark.createDataFrame(rho, "timeline_id long, clip_id long, correlation double"), 1_000)
    rows = out.collect()
    got = {(r.timeline_id, r.ch, r.t): r.v for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    lone = out._jdf.queryExecution().optimizedPlan().toString().split("Union")[1].split("Aggregate [timeline_id")[0]
    assert "MapInArrow" in lone and "_alone" in lone


def test_packed_samples_are_not_filtered_inside_the_generator(spark):
    from phonolake.operators import timeline as M

    clips = spark.createDataFrame([(1, 1, 1, 2, 3, 0)], "timeline_id long, clip_id long, source_id long, source_start long, length long, timeline_start long")
    sources = spark.createDataFrame([(1, 0, n, float(n)) for n in range(9)], "source_id long, ch long, n long, v double")
    out = M.clip_samples(clips, sources)
    assert [(r.t, r.v) for r in out.orderBy("t").collect()] == [(0, 2.0), (1, 3.0), (2, 4.0)]
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()

"""Rules of transcripts, intervals, scoring and datasets on small literal inputs."""

import random

from pyspark.sql import functions as F

from phonolake.functions import text as X
from phonolake.functions.wordalign import align_counts
from phonolake.operators import dataset as D
from phonolake.operators import detect
from phonolake.operators import intervals as I
from phonolake.operators import scoring as C
from phonolake.operators import transcripts as R


def test_words_by_midpoint_once(spark):
    words = spark.createDataFrame(
        [(1, 0.0, 1.0, "a"), (1, 0.0, 1.0, "a"), (1, 0.9, 1.3, "b"), (1, 1.9, 2.3, "c")], "rec_id long, w_start double, w_end double, word string")
    spans = spark.createDataFrame([(1, 7, 0.5, 2.0)], "rec_id long, interval_id long, start double, end double")
    assert R.words_in_intervals(words, spans).first().text == "a b"


def test_isolated_equals_pairwise(spark):
    rng = random.Random(4)
    data = [(k, i, float(s), float(s + rng.randint(0, 6))) for k in (0, 1) for i, s in enumerate(rng.sample(range(300), 60))]
    df = spark.createDataFrame(data, "k long, id long, start double, end double")
    got = {(r.k, r.id) for r in I.isolated(df, ["k"], "start", "end", ["id"], 0.05, width=10).collect()}
    want = {(k, i) for k, i, s, e in data
            if not any(k == k2 and i != i2 and min(e, e2) - max(s, s2) > 0.05 for k2, i2, s2, e2 in data)}
    assert got == want


def test_rewindow_steps(spark):
    df = spark.createDataFrame([(1, 0.0, 30.0), (2, 0.0, 14.0), (3, 0.0, 0.5)], "id long, start double, end double")
    got = sorted((r.id, r.start, r.end) for r in I.rewindow(df, 14.0, 12.0, 0.75).collect())
    assert got == [(1, 0.0, 14.0), (1, 12.0, 26.0), (1, 24.0, 30.0), (2, 0.0, 14.0)]


def test_alignment_against_plain_distance():
    rng = random.Random(5)
    for _ in range(60):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 9))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 9))]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        h, s, d, i = align_counts(a, b)
        assert s + d + i == row[-1] and h + s + d == len(a) and h + s + i == len(b) and min(h, s, d, i) >= 0


def test_error_rate_counts_invented_words(spark):
    rows = spark.createDataFrame([("one two", "one two three", "a"), ("", "noise here", "d")], "text string, prediction string, kind string")
    got = C.wer_block(C.with_errors(rows), [], F.col("kind") == "d").first()
    assert got.wer == 1.5 and got.instrumental_false_positives == 1 and got.instrumental_invented_words == 2


def line(start, end, text, p=0.9, **extra):
    words = text.split()
    step = (end - start) / max(1.0, len(words))
    ws = [{"i": i, "w_start": start + i * step, "w_end": start + (i + 1) * step, "word": w + " ", "p": p} for i, w in enumerate(words)]
    start, end = float(start), float(end)
    return {"rec_id": 1, "start": start, "end": end, "text": text, "needs_review": False, "words": ws, "avg_logprob": -0.2,
            "no_speech_prob": 0.1, "compression_ratio": 1.2, **extra}


SCHEMA = ("rec_id long, start double, end double, text string, needs_review boolean, words array<struct<i: long, w_start: double, "
          "w_end: double, word: string, p: double>>, avg_logprob double, no_speech_prob double, compression_ratio double")


def merged(spark, primary, candidates):
    out = R.merge_passes(spark.createDataFrame(primary, SCHEMA), spark.createDataFrame(candidates, SCHEMA))
    return [(r.text, r.origin, r.alternative_text) for r in out.orderBy("start").collect()]


def test_second_pass_fills_gaps_and_supersedes(spark):
    primary = [line(0, 2, "hello world"), line(50, 52, "far away")]
    assert merged(spark, primary, [line(20, 22, "new words")]) == [
        ("hello world", "primary", ""), ("new words", "recovered", ""), ("far away", "primary", "")]
    assert merged(spark, primary, [line(0, 2, "hello big world")])[0] == ("hello big world", "superseded", "hello world")
    assert merged(spark, primary, [line(0, 2, "yellow whirled")])[0] == ("hello world", "primary", "yellow whirled")
    assert merged(spark, primary, [line(20, 22, "doubtful words", p=0.2)]) == merged(spark, primary, [line(0, 2, "hello world")])


def test_annotation_reasons_in_order(spark):
    raw = [("00:01 00:03 a la la", ), ("00:01 00:03 a what?",), ("00:01 00:01 a short",), ("x 00:03 a bad",), ("00:01 00:03 c two voices",),
           ("00:01 00:03 a",), ("00:05 00:09 d ignored",)]
    lines = spark.createDataFrame([("s", i, r[0]) for i, r in enumerate(raw)], "song string, annotation_line int, raw string")
    kept, counts = D.parse_annotations(lines)
    assert {r.reason: r["rows"] for r in counts.collect()} == {
        "positive": 1, "uncertain_excluded": 1, "duration_excluded": 1, "malformed_excluded": 1, "overlapping_different_words_excluded": 1,
        "empty_positive_excluded": 1, "negative": 1}
    assert sorted((r.start, r.text) for r in kept.collect()) == [(1.0, "la la"), (5.0, "")]


def test_artists_stay_in_one_split(spark):
    rows = spark.createDataFrame([(f"s{i}", f"A{i % 10}" + (" feat. B" if i % 3 == 0 else "")) for i in range(60)], "song string, artist string")
    split = D.split_artists(rows)
    per = split.groupBy(X.artist_identity(F.col("artist")).alias("a")).agg(F.count_distinct("split").alias("n"))
    assert per.filter("n > 1").count() == 0
    assert split.select(X.artist_identity(F.col("artist")).alias("a"), "split").distinct().filter("split = 'validation'").count() == 2


def test_codes_and_times(spark):
    one = spark.range(1).select(
        X.isrc(F.lit("us-s1z-99-00001")).alias("isrc"), X.isrc_advance(F.lit("USS1Z9900001"), F.lit(2)).alias("next"),
        X.upc(F.lit("036000291452")).alias("upc"), X.srt_time(F.lit(3661.0005)).alias("srt"), X.clock_seconds(F.lit("1:02:03.5")).alias("s"),
        X.clock_seconds(F.lit("1:x")).alias("bad"), X.note_name(F.lit(440.0))["note"].alias("note"), X.safe_file_name(F.lit("NUL.wav")).alias("nul")).first()
    assert (one.isrc, one.next, one.upc, one.srt, one.s, one.bad, one.note, one.nul) == (
        "USS1Z9900001", "USS1Z9900003", "0036000291452", "01:01:01,001", 3723.5, None, "A4", "_NUL.wav")


def test_whole_word_search_respects_apostrophes(spark):
    text = spark.createDataFrame([("don't do it, I don’t  do",)], "t string")
    got = text.select(X.replace_preview(F.col("t"), "do", "DO").alias("r")).first().r
    assert got.after == "don't DO it, I don’t  DO" and got.changed == 2


def test_gap_matching_is_one_to_one(spark):
    planted = spark.createDataFrame([(1, 100, 200), (1, 300, 400), (1, 900, 950)], "rec_id long, start long, end long")
    found = spark.createDataFrame([(1, 90, 390)], "rec_id long, start long, end long")
    got = {r.start: r.matched for r in detect.match_events(planted, found).collect()}
    assert got == {100: True, 300: False, 900: False}


def test_phrases_cover_everything(spark):
    quiet = spark.createDataFrame([(1, 10.0, 11.0), (1, 22.0, 23.0), (1, 45.0, 46.0), (1, 70.0, 71.0)], "rec_id long, start double, end double")
    lengths = spark.createDataFrame([(1, 100.0), (2, 25.0), (3, 80.0)], "rec_id long, duration double")
    rows = detect.phrase_windows(quiet, lengths).orderBy("rec_id", "core_start").collect()
    out = [r for r in rows if r.rec_id == 1]
    assert [r.core_end for r in out] == [22.88, 45.88, 70.88, 85.44, 100.0]
    assert out[0].core_start == 0 and all(a.core_end == b.core_start for a, b in zip(out, out[1:]))
    assert all(p.end - p.start >= 20 for p in out)
    assert [(r.start, r.end) for r in rows if r.rec_id == 2] == [(0.0, 25.0)]
    assert [r.core_end for r in rows if r.rec_id == 3] == [26.0, 52.0, 80.0]


def test_common_words_against_a_plain_table():
    from phonolake.functions.wordalign import common_subsequence

    rng = random.Random(8)
    for _ in range(100):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(row[j] + (x == y), row[j + 1], new[-1]))
            row = new
        assert common_subsequence(a, b) == row[-1]


def test_useful_gaps(spark):
    lines = spark.createDataFrame([(1, 0.0, 2.0, "walking down the road")], "rec_id long, start double, end double, text string")
    found = spark.createDataFrame(
        [(1, 2.2, 3.0, "the road", 2), (1, 2.2, 3.0, "another street", 2), (1, 9.0, 9.9, "oh la la road", 4), (1, 9.0, 9.9, "the road", 2)],
        "rec_id long, start double, end double, text string, words int")
    got = sorted((r.start, r.text) for r in detect.useful_gaps(found, lines).collect())
    assert got == [(2.2, "another street"), (9.0, "the road")]


def test_long_lines_are_checked_where_they_are_weakest(spark):
    words = [{"i": i, "w_start": float(i), "w_end": i + 0.9, "word": f"w{i} ", "p": 0.1 if i == 30 else 0.9} for i in range(60)]
    rows = [(1, 0, 0.0, 59.9, " ".join(f"w{i}" for i in range(60)), True, words), (1, 1, 70.0, 100.0, "not these words", True, words)]
    lines = spark.createDataFrame(rows, "rec_id long, line_no long, start double, end double, text string, needs_review boolean, "
                                  "words array<struct<i: long, w_start: double, w_end: double, word: string, p: double>>")
    got = R.review_budget(lines, spark.createDataFrame([(1, 100.0)], "rec_id long, duration double")).filter("kind = 'line'").collect()
    assert [(r.line_no, r.start, r.end) for r in got] == [(0, 19.0, 30.9)]


def test_recovered_words_lose_what_a_neighbour_holds(spark):
    primary = [line(0, 2, "we walk along")]
    got = merged(spark, primary, [line(1, 5, "walk along the river bank")])
    assert got[0] == ("we walk along", "primary", "walk along the river bank") and [g[1] for g in got[1:]] == ["recovered"]
    assert "along" not in got[1][0].split()


def test_tempo_of_a_pulse_train(spark):
    """A burst every 43 hops of 512 samples at 44 100 Hz is 120.2 beats a minute; a recording of silence has no tempo."""
    from pyspark.sql import functions as F

    beat = 43 * 512
    pulses = spark.range(60 * beat).select(
        F.lit(1).cast("long").alias("rec_id"), F.lit(0).cast("long").alias("ch"), F.col("id").alias("n"),
        F.when(F.col("id") % beat < 512, 0.5).otherwise(0.0).alias("v"))
    silence = spark.range(60 * beat).select(
        F.lit(2).cast("long").alias("rec_id"), F.lit(0).cast("long").alias("ch"), F.col("id").alias("n"), F.lit(0.0).alias("v"))
    got = {r.rec_id: r for r in detect.tempo(pulses.unionByName(silence), 44_100, 512).collect()}
    assert abs(got[1].bpm - 60 * 44_100 / beat) < 0.2 and got[1].confidence > 0.9
    assert got[2].bpm == 0 and got[2].confidence == 0


def test_merging_passes_reads_its_inputs_a_fixed_number_of_times(spark):
    """The result is a plan over tables written once, not one that grows with every branch."""
    word = "struct<i: long, w_start: double, w_end: double, word: string, p: double>"
    fields = f"rec_id long, start double, end double, text string, needs_review boolean, avg_logprob double, no_speech_prob double, compression_ratio double, words array<{word}>"
    ws = [(0, 0.0, 0.5, "one", 0.9), (1, 0.5, 1.0, "two", 0.9)]
    rows = spark.createDataFrame([(1, 0.0, 1.0, "one two", False, -0.2, 0.1, 1.2, ws)], fields)
    plan = R.merge_passes(rows, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 4 and plan.count("LogicalRDD") == 0


def test_words_of_candidates_stay_in_their_row(spark, monkeypatch):
    from phonolake import session

    plans, write = {}, session.stage
    monkeypatch.setattr(session, "stage", lambda df, label: plans.update({label: df._jdf.queryExecution().optimizedPlan().toString()}) or write(df, label))
    held = [line(0, 2, "hello world"), line(50, 52, "far away")]
    assert merged(spark, held, [line(1, 9, "world one two three")])[1:2] == [("one two three", "recovered", "")]
    assert "posexplode" not in plans["groups"] and "Window" not in plans["groups"]


def test_loose_words_in_consecutive_runs(spark):
    word = lambda a, b: (a, b, f"w{a}")
    rows = [
        (0, [word(0.0, 1.0), word(1.0, 2.0), word(2.0, 3.0), word(3.0, 3.0), word(4.0, 5.0), word(5.0, 6.0)], [(1.2, 1.6), (9.0, 9.5)]),
        (1, [word(0.0, 1.0), word(1.0, 2.0)], None), (2, [word(0.0, 1.0)], [(0.5, 2.0)]), (3, [word(0.0, 1.0)], [(0.0, 0.5)]), (4, [], [])]
    table = spark.createDataFrame(rows, "k int, words array<struct<w_start double, w_end double, word string>>, spans array<struct<_s double, _e double>>")
    runs = table.withColumn("loose", R.loose_words(F.col("words"), F.col("spans"))).select("k", R.consecutive("loose").alias("runs")).collect()
    assert {r.k: [[x["at"] for x in run] for run in r.runs or []] for r in runs} == {0: [[0], [2], [4, 5]], 1: [[0, 1]], 2: [], 3: [[0]], 4: []}

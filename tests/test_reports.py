"""Check lists, sentences, sheets and the live level figures on small literal inputs."""

from phonolake.operators import dataset as D
from phonolake.operators import loudness as N
from phonolake.operators import splits as L
from phonolake.operators import tracks as K
from phonolake.streaming import monitors as S


def test_check_list_and_sentences(spark):
    rows = [(1, -23.2, 5.0, -3.0), (2, -30.0, 25.0, -2.5), (3, float("-inf"), 0.0, float("-inf"))]
    loudness = spark.createDataFrame(rows, "rec_id long, integrated double, range_lu double, true_peak_db double")
    checks = {(r.rec_id, r.target, r.name): r.passed for r in N.compliance_checks(loudness).collect()}
    assert len(checks) == 3 * (2 * len(N.TARGETS) + 1)  # one target limits the range
    assert checks[1, "EBU R128", "integrated"] and checks[1, "EBU R128", "range"]
    assert not checks[2, "EBU R128", "integrated"] and not checks[2, "EBU R128", "range"] and checks[2, "EBU R128", "true peak"]
    assert not checks[3, "EBU R128", "integrated"] and checks[3, "EBU R128", "true peak"]
    passed = {(r.rec_id, r.target): r.passed for r in N.compliance(loudness).collect()}
    for (rec, target), whole in passed.items():
        assert whole == all(ok for (r, t, _), ok in checks.items() if (r, t) == (rec, target))
    said = {r.rec_id: r.sentence for r in N.compliance_sentences(loudness).filter("target = 'EBU R128'").collect()}
    assert said == {1: "meets EBU R128; gain +0.2 dB",
                    2: "misses EBU R128 on integrated, range; gain +1.5 dB, 5.5 dB left to limiting",
                    3: "misses EBU R128 on integrated"}


def test_sweep_sentences(spark):
    rows = [(1, 3, -60.0, -50.0, True, False), (1, 1, -70.0, -61.0, False, False), (2, 2, -40.0, -36.0, True, True),
            (3, 1, -70.0, -25.0, True, False), (4, 5, -70.0, -60.0, False, False), (4, 2, -59.0, -25.0, False, False)]
    swept = spark.createDataFrame(rows, "rec_id long, tracks long, low_db double, high_db double, best boolean, relaxed boolean")
    got = {r.rec_id: r.sentence for r in L.sweep_sentences(swept, 3).collect()}
    assert got == {1: "3 tracks, the same from -60 to -50 dB", 2: "2 tracks, the same from -40 to -36 dB, by shorter gaps",
                   3: "one track, no gap divides it", 4: "never 3 tracks; settings give 2, 5"}


def test_sheets(spark):
    second = 44_100
    plan = spark.createDataFrame([(7, 1, 'a "b"', 0, 10 * second, 0), (7, 2, "", 10 * second, 20 * second, 150)],
                                 "disc_id long, track long, title string, start long, end long, pregap long")
    lengths = spark.createDataFrame([(7, 20 * second)], "disc_id long, frames long")
    positions = K.disc_positions(plan, lengths, second)
    sheet = [r.sheet for r in K.image_sheet(plan, positions, "X").orderBy("track").collect()]
    assert sheet == ['TITLE "disc-7"\nPERFORMER "X"\nFILE "disc-7.wav" WAVE',
                     "  TRACK 01 AUDIO\n    TITLE \"a 'b'\"\n    INDEX 01 00:00:00",
                     '  TRACK 02 AUDIO\n    TITLE "Audio CD"\n    INDEX 00 00:10:00\n    INDEX 01 00:12:00']
    rows = [tuple(r) for r in K.pq_sheet(positions).orderBy("entry").collect()]
    assert rows == [(7, "01", "00:02:00", "00:10:00"), (7, "02", "00:14:00", "00:10:00"), (7, "AA", "00:24:00", None)]


def test_artist_shortage(spark):
    songs = spark.createDataFrame([("A", 1), ("a feat. b", 2), ("C", 3), ("D", 4)], "artist string, song long")
    seen = songs.filter("song = 4")
    assert tuple(D.fresh_artist_shortage(songs, seen, 5).first()) == (5, 2, 3)
    assert tuple(D.fresh_artist_shortage(songs, seen, 1).first()) == (1, 2, 0)


def test_true_peak_by_block_merges_to_the_whole(spark):
    values = [0.9 if n % 7 < 3 else -0.6 for n in range(95)]
    samples = spark.createDataFrame([(1, 0, n, v) for n, v in enumerate(values)], "rec_id long, ch long, n long, v double")
    blocks = {r.block: r.true_peak for r in N.true_peak(samples, 10).collect()}
    assert set(blocks) == set(range(10))
    assert max(blocks.values()) == N.true_peak(samples).first().true_peak


def test_extremes_of_batches_merge(spark):
    schema = "rec_id long, block long, peak_db double, true_peak_db double, clipped long"
    rows = [(1, 0, -6.0, -5.5, 0), (1, 1, -3.0, -2.0, 2), (1, 2, -9.0, -9.0, 1), (2, 0, -20.0, -19.0, 0)]
    blocks = spark.createDataFrame(rows, schema)
    parts = S.batch_extremes(blocks.filter("block < 1")).unionByName(S.batch_extremes(blocks.filter("block >= 1")))
    whole = S.batch_extremes(blocks).orderBy("rec_id").collect()
    assert S.batch_extremes(parts).orderBy("rec_id").collect() == whole
    assert tuple(whole[0]) == (1, -3.0, -2.0, 3)
    assert {r.block for r in S.rolling_levels(blocks.filter("rec_id = 1"), 2).collect()} == {1, 2}

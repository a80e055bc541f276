"""Registered queries keep their contract; streams give the batch answer for any batching."""

import math

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from phonolake.session import scratch_path
from phonolake.sources.packets import to_packets
from phonolake.streaming import monitors as S

SF = "/root/testdata/sf0.001"


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200


def test_flagship_runs(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 4 and {"rec_id", "gain_db", "note"} <= set(rows[0].asDict())


def tone_with_run_out(spark, rate=2000, music=4, quiet=8):
    n = F.col("id")
    loud = F.sin(2 * math.pi * 300 * n / rate) * 0.5
    hiss = (F.rand(7) - 0.5) * 0.002
    return spark.range(rate * (music + quiet)).select(
        F.lit(1).cast("long").alias("rec_id"), F.lit(0).cast("long").alias("ch"), n.alias("n"),
        F.when(n < rate * music, loud).otherwise(hiss).alias("v"))


@pytest.mark.parametrize("milliseconds", [7, 20, 100, 250])
def test_run_out_triggers_once_the_hold_has_passed_whatever_the_packets(spark, milliseconds):
    packets = to_packets(tone_with_run_out(spark), 2 * milliseconds, 2000)
    path = scratch_path(spark, "runout")
    packets.repartitionByRange(2, "seq").write.parquet(path)
    out = S.run(S.run_out_monitor(S.read_packets(spark, path), 2000, 5.0), "runout")
    assert out.count() == 120 and out.select("block").distinct().count() == 120
    assert out.filter("triggered").agg(F.min("block")).first()[0] == 89  # 40 blocks of music, then fifty of quiet


def test_late_packets_wait_for_their_turn(spark):
    packets = to_packets(tone_with_run_out(spark), 200, 2000)
    path = scratch_path(spark, "swapped")
    swapped = F.when(F.col("seq") % 10 == 3, F.col("seq") + 4).otherwise(F.col("seq"))
    for low in range(0, 120, 30):
        packets.filter(swapped.between(low, low + 29)).write.mode("append").parquet(path)
    got = S.run(S.run_out_monitor(S.read_packets(spark, path, 1), 2000, 5.0), "swapped").orderBy("block").collect()
    assert [r.block for r in got] == list(range(120))
    assert min(r.block for r in got if r.triggered) == 89


def closing(packets, path):
    """The empty packet that ends a capture, as the last file."""
    packets.agg(F.max("ts").alias("ts")).select(
        F.lit(-1).cast("long").alias("take_id"), F.lit(-1).cast("long").alias("seq"), F.expr("ts + interval 1 hour").alias("ts"),
        F.lit(0).cast("long").alias("ch"), F.array().cast("array<double>").alias("v")).write.mode("append").parquet(path)


def arriving(packets, order, path, parts):
    """Packets written in ``parts`` files by arrival order (a column), one micro-batch each, then the closing packet."""
    top = packets.agg(F.max(order)).first()[0] + 1
    for k in range(parts):
        packets.filter((order >= k * top / parts) & (order < (k + 1) * top / parts)).coalesce(1).write.mode("append").parquet(path)
    closing(packets, path)


def stereo_packets(spark, milliseconds=20):
    left = tone_with_run_out(spark)
    return to_packets(left.unionByName(left.withColumn("ch", F.lit(1).cast("long")).withColumn("v", F.col("v") * 0.5)), 2 * milliseconds, 2000)


def blocks_of(spark, packets, path):
    rows = S.run(S.run_out_monitor(S.read_packets(spark, path, 1), 2000, 5.0), "monitor").collect()
    return sorted((r.block, round(r.level_db, 6), r.program, r.triggered) for r in rows)


IN_ORDER: dict = {}


@pytest.mark.parametrize("case", ["lost near the end", "late by more than a hundred", "first one late", "one channel late", "doubled"])
def test_stream_equals_batch_whatever_the_arrival(spark, case):
    """600 packets of 20 ms: the monitor's blocks are those of the packets in order, once each."""
    packets = stereo_packets(spark)
    seq, arrival = F.col("seq"), F.col("seq")
    if case == "lost near the end":
        packets = packets.filter("seq <> 590")
    elif case == "late by more than a hundred":
        arrival = F.when(seq == 50, 350).otherwise(seq)  # six seconds behind, inside the 30 that the watermark allows
    elif case == "first one late":
        arrival = F.when(seq == 0, 130).otherwise(seq)
    elif case == "one channel late":
        arrival = F.when((seq % 50 == 20) & (F.col("ch") == 1), seq + 120).otherwise(seq)
    else:
        packets = packets.unionByName(packets.filter("seq % 3 = 0"))
    lost = case.startswith("lost")
    if lost not in IN_ORDER:
        in_order = scratch_path(spark, "in-order")
        packets.dropDuplicates(["seq", "ch"]).coalesce(1).write.parquet(in_order)
        closing(packets, in_order)
        IN_ORDER[lost] = blocks_of(spark, packets, in_order)
    path = scratch_path(spark, "arriving")
    arriving(packets, arrival, path, 6)
    got, want = blocks_of(spark, packets, path), IN_ORDER[lost]
    assert got == want and len(got) == (119 if case.startswith("lost") else 120)
    assert min(b for b, _, _, triggered in got if triggered) == 89


def test_live_loudness_waits_for_late_packets(spark):
    packets = stereo_packets(spark)
    late, plain = scratch_path(spark, "late"), scratch_path(spark, "plain")
    arriving(packets, F.when(F.col("seq") % 97 == 5, F.col("seq") + 260).otherwise(F.col("seq")), late, 5)
    arriving(packets, F.col("seq"), plain, 1)
    read = lambda path: sorted(
        (str(r["at"]), round(r.loudness, 9)) for r in S.run(S.live_loudness(S.live_weighted(S.read_packets(spark, path, 1), 2000), 2000, "400 milliseconds", 4), "live").collect())
    assert read(late) == read(plain) and len(read(plain)) == 117


def test_contact_and_capacity_in_order(spark):
    """The trigger and the stop come from the same packet when every fifth packet is seven places late."""
    packets = to_packets(tone_with_run_out(spark).withColumn("v", F.when(F.col("n") < 4033, F.col("v") * 0.0005).otherwise(F.col("v"))), 40, 2000)
    paths = [scratch_path(spark, x) for x in ("late", "plain")]
    arriving(packets, F.when(F.col("seq") % 5 == 0, F.col("seq") + 7).otherwise(F.col("seq")), paths[0], 40)
    arriving(packets, F.col("seq"), paths[1], 1)
    for monitor, name in ((lambda p: S.contact_trigger(p, 2000), "contact"), (lambda p: S.capacity_stop(p, 8010), "capacity")):
        late, plain = (sorted(map(tuple, S.run(monitor(S.read_packets(spark, p, 1)), name).collect())) for p in paths)
        assert late == plain and len(plain) == 1
        if name == "capacity":
            assert plain == [(1, 200, 8040)]


def test_batch_and_stream_agree_on_the_trigger(spark):
    from phonolake.operators import blocks as B

    samples = tone_with_run_out(spark)
    blocks = B.run_out_blocks(samples, 2000)
    program = B.fading_tail(B.run_out_program(B.quietest_so_far(blocks), 2000))
    got = B.hold_trigger(B.last_program(program), 5.0).first()
    assert (got.trigger_block, got.last_program, got.keep_to_block) == (89, 39, 79)


def test_resumed_stream_counts_every_packet_once(spark):
    packets = to_packets(tone_with_run_out(spark), 200, 2000)
    path, table, mark = (scratch_path(spark, x) for x in ("in", "out", "mark"))
    for part in ("seq < 50", "seq >= 50"):
        packets.filter(part).write.mode("append").parquet(path)
        S.append_batches(S.read_packets(spark, path), table, mark)
    got = spark.read.parquet(table)
    assert got.count() == got.select("seq").distinct().count() == 120


def test_packets_written_by_stretches_of_time_bound_every_batch(spark):
    """Twelve files of 100 packets in order, then the closing one: the monitor's blocks are those of one batch."""
    from phonolake.sources.packets import write_packets

    packets = stereo_packets(spark)
    pieces, whole = write_packets(packets, "pieces", per_file=100), write_packets(packets, "whole")
    files = spark.read.parquet(pieces).filter("take_id >= 0").groupBy(F.col("_metadata.file_modification_time").alias("at"), F.input_file_name()).agg(
        F.count(F.lit(1)).alias("rows"), F.min("seq").alias("low"), F.max("seq").alias("high")).orderBy("at").collect()
    assert [f.rows for f in files] == [100] * 12 and all(a.high < b.low for a, b in zip(files, files[1:]))
    assert blocks_of(spark, packets, pieces) == blocks_of(spark, packets, whole)

"""Live capture monitors as Structured Streaming jobs over packets(take_id, seq, ts, ch, v).

Packets carry event time (take start + position). A capture ends with an empty closing packet whose time lies past
the watermark, so that the last windows are released. Every job is a DataFrame transformation; ``run`` starts it
with a checkpoint in the shared folder.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phonolake.functions.levels import amplitude_db, is_finite, lufs
from phonolake.operators.blocks import level_snapshot
from phonolake.operators.signal import CLIP_LEVEL
from phonolake.operators.weighting import weighting_response
from phonolake.session import scratch_path

PACKETS = T.StructType([
    T.StructField("take_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("ch", T.LongType()), T.StructField("v", T.ArrayType(T.DoubleType())),
])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
LATE = "30 seconds"  # how far behind the newest packet one may come


def read_packets(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PACKETS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


@contextmanager
def _rocks(spark: SparkSession):
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def run(stream: DataFrame, label: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process everything available, append the results to a parquet table and read it back."""
    spark = stream.sparkSession
    path, checkpoint = path or scratch_path(spark, label), checkpoint or scratch_path(spark, f"{label}-checkpoint")
    with _rocks(spark):
        job = (
            stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start()
        )
        job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


# --- packets and windows --------------------------------------------------------------------------------


METER_MICROS = 100_000


def _reduced(x: str) -> list:
    """Figures of the samples in the array column ``x``."""
    good = F.filter(x, lambda v: v.isNotNull() & is_finite(v))
    return [
        F.array_max(F.transform(good, F.abs)).alias("peak"),
        F.aggregate(good, F.lit(0.0), lambda a, v: a + v * v).alias("power"),
        F.size(F.filter(x, lambda v: v.isNotNull())).alias("values"),
        F.size(F.filter(good, lambda v: F.abs(v) >= CLIP_LEVEL)).alias("clipped"),
        F.size(F.filter(x, lambda v: v.isNotNull() & ~is_finite(v))).alias("invalid"),
    ]


def packet_meter(packets: DataFrame, rate: int) -> DataFrame:
    """One row per packet and 100 ms it touches: the packet's samples are reduced where they lie, before any shuffle.

    Sample i of a packet is due at ts + floor(i * 1e6 / rate) microseconds, so the samples of a window are a slice of the
    array. A closing packet keeps one row without values.
    """
    micros, size = F.unix_micros("ts"), F.coalesce(F.size("v"), F.lit(0))
    first = F.floor(micros / METER_MICROS)
    last = F.floor((micros + F.floor(F.greatest(size - 1, F.lit(0)) * 1_000_000 / rate)) / METER_MICROS)
    at = lambda w: F.greatest(F.lit(0), F.ceil((w * METER_MICROS - micros) * rate / 1_000_000)).cast("int")
    cut = packets.select("take_id", "ts", "v", F.explode(F.sequence(first, last)).alias("w"))
    begin, end = at(F.col("w")), at(F.col("w") + 1)
    cut = cut.withColumn("x", F.slice("v", begin + 1, F.greatest(end - begin, F.lit(0))))
    return cut.select("take_id", F.timestamp_micros(F.greatest(micros, F.col("w") * METER_MICROS)).alias("ts"), *_reduced("x"))


def _metered(parts: DataFrame) -> DataFrame:
    total = lambda c: F.sum(c).cast("long").alias(c)
    return parts.groupBy(F.window("ts", "100 milliseconds"), "take_id").agg(
        F.max("peak").alias("peak"), F.sum("power").alias("power"), total("values"), total("clipped"), total("invalid"))


def block_meter(packets: DataFrame, rate: int, late: str = "10 seconds") -> DataFrame:
    """Peak, power, clipped and invalid counts per take and 100 ms."""
    return _metered(packet_meter(packets, rate).withWatermark("ts", late))


def live_loudness(packets: DataFrame, rate: int, span: str, rows: int) -> DataFrame:
    """Momentary (400 ms, 4 rows) or short-term (3 s, 30 rows) loudness of the packets that ``live_weighted`` gives, none of
    which crosses a 100 ms border. Partial windows at the start are left out by the row count.
    """
    size = rate // 10
    blocks = _metered(packets.select("take_id", "ts", *_reduced("v"))).filter("values > 0").withColumn("ts", F.window_time("window"))
    return (
        blocks.groupBy(F.window("ts", span, "100 milliseconds").alias("span"), "take_id")
        .agg(F.avg(F.col("power") / size).alias("ms"), F.count(F.lit(1)).alias("blocks"))
        .filter(F.col("blocks") == rows)
        .select("take_id", F.col("span.end").alias("at"), lufs(F.col("ms")).alias("loudness"))
    )


def sessions(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """Takes: a pause longer than ``gap`` closes one. stream(take_id, ts, …)."""
    return (
        stream.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("s"), "take_id")
        .agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"))
        .select("take_id", "first", "last", "rows")
    )


def plateau_alarm(tops: DataFrame, peaks: DataFrame | None = None, late: str = "30 seconds") -> DataFrame:
    """tops(take_id, ch, ts, level): per channel, windows of 10 s every second with three plateaus within 1 dB of the highest, which
    itself lies within 3 dB of the take's peak where peaks(take_id, peak) are given."""
    windows = (
        tops.withWatermark("ts", late)
        .groupBy(F.window("ts", "10 seconds", "1 second").alias("w"), "take_id", "ch")
        .agg(F.max("level").alias("top"), F.count(F.lit(1)).alias("tops"), F.collect_list("level").alias("levels"))
    )
    near = F.size(F.filter("levels", lambda x: 20 * F.log10(F.col("top") / x) <= 1.0))
    out = windows.select("take_id", "ch", F.col("w.end").alias("at"), "tops", "top", near.alias("consistent")).filter("consistent >= 3")
    return out if peaks is None else out.join(peaks, "take_id").filter(20 * F.log10(F.col("peak") / F.col("top")) <= 3.0).drop("peak")


def unique_packets(packets: DataFrame, late: str = "10 seconds") -> DataFrame:
    return packets.withWatermark("ts", late).dropDuplicatesWithinWatermark(["take_id", "ch", "seq"])


def without_pauses(packets: DataFrame, pauses: DataFrame) -> DataFrame:
    """Drop packets that begin inside a pause(take_id, from_ts, to_ts), and the first packet after it."""
    p = pauses.select(F.col("take_id").alias("_t"), "from_ts", "to_ts", "resume_seq")
    inside = (F.col("take_id") == F.col("_t")) & (
        ((F.col("ts") >= F.col("from_ts")) & (F.col("ts") < F.col("to_ts"))) | (F.col("seq") == F.col("resume_seq"))
    )
    return packets.join(p, inside, "left_anti")


def late_audit(packets: DataFrame, seconds: float) -> DataFrame:
    """Batch audit: packets that arrived (seq order) after a packet newer by more than the allowed lateness.

    The newest earlier time is a running maximum, sliced by arrival.
    """
    from phonolake.operators.ordered import running, slice_no

    seen = running(
        packets.withColumn("_us", F.unix_micros("ts")), ["take_id", "ch"], slice_no("arrival", 65_536), ["arrival"],
        {"_newest": ("max", F.col("_us"))}, inclusive=False,
    )
    late = F.coalesce(F.col("_newest") - F.col("_us") > int(seconds * 1_000_000), F.lit(False))
    return seen.groupBy("take_id").agg(F.count(F.lit(1)).alias("packets"), F.count_if(late).alias("late"))


# --- keyed state ------------------------------------------------------------------------------------------

RUN_OUT = T.StructType([
    T.StructField("take_id", T.LongType()), T.StructField("block", T.LongType()), T.StructField("level_db", T.DoubleType()),
    T.StructField("floor_db", T.DoubleType()), T.StructField("program", T.BooleanType()),
    T.StructField("fading", T.BooleanType()), T.StructField("seconds_waited", T.DoubleType()),
    T.StructField("triggered", T.BooleanType()),
])
CONTACT = T.StructType([
    T.StructField("take_id", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("peak", T.DoubleType()),
    T.StructField("step", T.DoubleType()), T.StructField("preroll_seq", T.LongType()),
])
LIMIT = T.StructType([
    T.StructField("take_id", T.LongType()), T.StructField("stop_seq", T.LongType()), T.StructField("frames", T.LongType()),
])


def in_turn(waiting: dict, due: int, channels: int, watermark_us: int):
    """Takes the packets whose turn it is out of ``waiting`` {seq: {ch: (us, samples)}}: (packets, next number due).

    A packet's turn has come when it is the next one and whole (as many channels as the take has shown), or when the
    watermark has passed it, since nothing earlier can arrive then: what is still missing is lost.
    """
    ready = []
    for seq in sorted(waiting):
        parts = waiting[seq]
        if not (seq == due and len(parts) >= channels) and max(us for us, _ in parts.values()) > watermark_us:
            break
        ready.append((seq, waiting.pop(seq)))
        due = seq + 1
    return ready, due


def stacked(parts: dict, channels: int):
    """channels × samples of one packet; a channel that got lost is silent, and so is what is not finite."""
    import numpy as np

    rows = {c: np.asarray(v, dtype=float) for c, (_, v) in parts.items()}
    size = max(len(v) for v in rows.values())
    numbers = sorted(rows) if len(rows) >= channels else sorted(set(rows) | set(range(channels)))[:channels]
    out = np.zeros((len(numbers), size))
    for i, c in enumerate(numbers):
        if c in rows:
            out[i, :len(rows[c])] = rows[c]
    return np.nan_to_num(out, nan=0.0, posinf=0.0, neginf=0.0)


def block_records(x, before, rate: int, response):
    """(level_db, peak_db, crossings per second) of each whole 100 ms block of x (channels × samples), the rule of
    ``blocks.run_out_blocks``. ``before`` holds the samples that came first, at least as many as the response has taps."""
    import numpy as np

    from phonolake.operators.weighting import filtered

    small, big = rate // 100, rate // 10
    count = x.shape[1] // big
    lead = before.shape[1]
    a = np.vstack([filtered(row, response) for row in np.hstack([before, x])])[:, max(lead - 1, 0):]
    if not lead:  # nothing came before: the first sample has no predecessor to cross from
        a = np.hstack([np.full((len(x), 1), np.nan), a])
    sign = np.sign(a[:, : count * big + 1])
    cross = (sign[:, 1:] != 0) & (sign[:, 1:] != sign[:, :-1]) & ~np.isnan(sign[:, :-1])
    crossings = cross.reshape(len(x), count, big).sum(axis=2).max(axis=0) * rate / big
    power = (a[:, 1 : count * big + 1] ** 2).reshape(len(x), count, 10, small).mean(axis=(0, 3))
    peak = np.abs(x[:, : count * big]).reshape(len(x), count, big).max(axis=(0, 2))
    with np.errstate(divide="ignore"):
        levels = np.median(10 * np.log10(power), axis=1)
        return list(zip(levels.tolist(), (20 * np.log10(peak)).tolist(), crossings.tolist()))


class SideMonitor:
    """The batch rules (``quietest_so_far``, ``fading_tail``, ``waiting``) one block at a time. All it keeps is the ten
    quietest levels, the last thirty levels, the first programme block and the block from which the hold counts."""

    def __init__(self, rate, hold, minimum_peak_db, block=0, quiet=(), recent=(), first=-1, since=-1, done=False):
        self.rate, self.hold, self.minimum_peak_db = rate, hold, minimum_peak_db
        self.block, self.quiet, self.recent = block, list(quiet), list(recent)
        self.first, self.since, self.done = first, since, done

    def kept(self):
        return (self.block, self.quiet, self.recent, self.first, self.since, self.done)

    def falling(self) -> bool:
        import math
        import statistics

        from phonolake.operators import blocks as B

        if self.first < 0 or self.block - self.first < 29 or len(self.recent) < 30:
            return False
        thirds = [statistics.median(self.recent[i:i + 10]) for i in (0, 10, 20)]
        settled = len(self.quiet) == B.FLOOR_BLOCKS and thirds[2] <= self.quiet[-1] + 1.5
        return all(map(math.isfinite, thirds)) and not settled and min(thirds[0] - thirds[1], thirds[1] - thirds[2]) >= 0.15

    def see(self, level: float, peak: float, crossings: float):
        from phonolake.operators import blocks as B

        floor = self.quiet[-1] if len(self.quiet) == B.FLOOR_BLOCKS else None
        gate = B.PROGRAM_BLOCK_DB if floor is None else max(B.PROGRAM_BLOCK_DB, floor + B.SEPARATION_DB)
        program = level > gate and peak > self.minimum_peak_db and 150 <= crossings <= 0.4 * self.rate
        self.recent = [*self.recent, level][-30:]
        if program and self.first < 0:
            self.first = self.block
        fading = not program and self.falling()
        if program or fading:
            self.since = self.block + fading * B.SETTLING_BLOCKS
        if B.MEDIUM_FLOOR_DB <= level <= B.PROGRAM_BLOCK_DB:
            self.quiet = sorted([*self.quiet, level])[: B.FLOOR_BLOCKS]
        waited = max(0, self.block - self.since) / 10 if self.since >= 0 else 0.0
        self.done = self.done or (self.since >= 0 and waited >= self.hold)
        row = (self.block, level, floor, program, fading, waited, self.done)
        self.block += 1
        return row


#: Least peak (-42 dBFS) and least step (-48 dBFS) of a contact, how far each stands above the usual, the crest
#: over the packet's own level, and the seconds before anything counts.
CONTACT_LEAST, CONTACT_ABOVE, CONTACT_CREST, WARM_UP = (0.007943, 0.003981), (8.0, 10.0), 2.5, 0.15


def stands_out(loudness, usual) -> bool:
    """loudness: (peak, rms) of the samples and of their steps; usual: the learned rms of both."""
    import numpy as np

    peaks, levels = loudness[:, 0], loudness[:, 1]
    gates = np.maximum(CONTACT_LEAST, usual * CONTACT_ABOVE)
    return bool((peaks >= gates).all() and peaks[0] >= max(levels[0], usual[0]) * CONTACT_CREST)


def learned(powers, levels, seconds: float):
    """Usual powers after one more packet: a slow mean (1.5 s) into which no packet enters at more than twice the usual."""
    import numpy as np

    ceiling = np.maximum(2 * np.sqrt(powers), np.array(CONTACT_LEAST) / 4)
    return powers + (np.minimum(levels, ceiling) ** 2 - powers) * min(0.08, max(0.001, seconds / 1.5))


def _processors():
    """Defined on first use: the base class needs the streaming module of the running Spark."""
    from pyspark.sql.streaming import StatefulProcessor

    import numpy as np
    import pandas as pd

    class InTurn(StatefulProcessor):
        """Gives packets to ``take`` in their order. One that is early waits in the state until the ones before it are here or
        the event-time watermark has passed it; a timer at the earliest waiting packet brings that about without new input."""

        def init(self, handle) -> None:
            self.handle = handle
            self.queue = handle.getValueState(
                "queue", "due long, channels int, timer long, waiting array<struct<seq: long, ch: long, us: long, v: array<double>>>")
            self.begin(handle)

        def handleInputRows(self, key, rows, timerValues):
            yield from self.turn(key, list(rows), timerValues.getCurrentWatermarkInMs())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            yield from self.turn(key, [], max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()), fired=True)

        def turn(self, key, frames, watermark_ms, fired=False):
            due, channels, timer, held = self.queue.get() if self.queue.exists() else (0, 0, -1, [])
            waiting: dict = {}
            for seq, ch, us, v in held:
                waiting.setdefault(seq, {})[ch] = (us, v)
            for frame in frames:
                for seq, ch, us, v in zip(frame["seq"], frame["ch"], frame["us"], frame["v"]):
                    if v is not None and len(v) and seq >= due:
                        waiting.setdefault(int(seq), {})[int(ch)] = (int(us), v)
            channels = max([channels, *map(len, waiting.values())])
            ready, due = in_turn(waiting, due, channels, watermark_ms * 1000)
            out = self.take(key, [(seq, max(us for us, _ in p.values()), stacked(p, channels)) for seq, p in ready])
            first = min((max(us for us, _ in p.values()) for p in waiting.values()), default=None)
            wanted = -1 if first is None else -(-first // 1000)
            if timer >= 0 and timer != wanted and not fired:
                self.handle.deleteTimer(timer)
            if wanted >= 0 and (timer != wanted or fired):
                self.handle.registerTimer(wanted)
            rows = [(s, c, us, [float(x) for x in v]) for s, p in sorted(waiting.items()) for c, (us, v) in sorted(p.items())]
            self.queue.update((int(due), int(channels), int(wanted), rows))
            yield out

        def close(self) -> None:
            pass

    def unpacked(value, fields: int):
        """(channels × samples, further fields) of a state whose first two fields are channels and samples."""
        channels, flat, *more = value
        return np.array(flat, dtype=float).reshape(channels, -1), more[:fields]

    class RunOut(InTurn):
        """End-of-side monitor for packets of any length: blocks are cut from the joined samples."""

        def __init__(self, rate: int, hold: float, minimum_peak_db: float, response) -> None:
            self.setting = (rate, min(60.0, max(5.0, hold)), minimum_peak_db)
            self.rate, self.response = rate, np.asarray(response, dtype=float)

        def begin(self, handle) -> None:
            self.tail = handle.getValueState("tail", "channels int, samples array<double>, lead int")
            self.side = handle.getValueState(
                "side", "block long, quiet array<double>, recent array<double>, first long, since long, done boolean")

        def take(self, key, packets):
            out = []
            if packets:
                tail, (lead,) = unpacked(self.tail.get(), 1) if self.tail.exists() else (np.empty((0, 0)), (0,))
                monitor = SideMonitor(*self.setting, *(self.side.get() if self.side.exists() else ()))
                x = np.hstack(([tail] if tail.size else []) + [p for _, _, p in packets])
                before, fresh = x[:, :lead], x[:, lead:]
                out = [(key[0], *monitor.see(*record)) for record in block_records(fresh, before, self.rate, self.response)]
                used = lead + len(out) * (self.rate // 10)
                lead = min(used, len(self.response) + 1)
                tail = x[:, used - lead:]
                self.tail.update((len(tail), tail.ravel().tolist(), int(lead)))
                block, quiet, recent, first, since, done = monitor.kept()
                self.side.update((block, quiet, recent, first, since, bool(done)))
            return pd.DataFrame(out, columns=RUN_OUT.names)

    class Weighted(InTurn):
        """Filtered samples, cut at 100 ms borders; a channel's last samples wait in the state for the next packet."""

        def __init__(self, response, rate: int) -> None:
            self.response, self.rate = np.asarray(response, dtype=float), rate

        def begin(self, handle) -> None:
            self.tail = handle.getValueState("tail", "channels int, samples array<double>")

        def parts(self, us, y):
            due = us + np.floor(np.arange(len(y)) * 1e6 / self.rate).astype(np.int64)
            edge = np.flatnonzero(np.diff(due // METER_MICROS)) + 1
            for start, piece in zip([0, *edge], np.split(y, edge)):
                yield pd.Timestamp(int(due[start]), unit="us", tz="UTC"), piece.tolist()

        def handleInputRows(self, key, rows, timerValues):
            frames = list(rows)
            closing = [(key[0], int(seq), pd.Timestamp(int(us), unit="us", tz="UTC"), key[1], [])
                       for f in frames for seq, us, v in zip(f["seq"], f["us"], f["v"]) if v is None or not len(v)]
            if closing:  # a closing packet goes on as it is, to move the windows behind this one
                yield pd.DataFrame(closing, columns=PACKETS.names)
            yield from self.turn(key, frames, timerValues.getCurrentWatermarkInMs())

        def take(self, key, packets):
            from phonolake.operators.weighting import filtered

            out = []
            tail, _ = unpacked(self.tail.get(), 0) if self.tail.exists() else (np.empty((1, 0)), ())
            for seq, us, x in packets:
                joined = np.hstack([tail, x])
                y = filtered(joined[0], self.response)[tail.shape[1]:]
                out.extend((key[0], seq, ts, key[1], v) for ts, v in self.parts(us, y))
                tail = joined[:, max(0, joined.shape[1] - len(self.response)):]
            if packets:
                self.tail.update((len(tail), tail.ravel().tolist()))
            frame = pd.DataFrame(out, columns=PACKETS.names)
            return frame if out else frame.astype({"ts": "datetime64[us, UTC]"})

    class Contact(InTurn):
        """Contact trigger: the first packet that stands out from what the take has sounded like so far."""

        FIELDS = "powers array<double>, frames long, last array<double>, recent array<long>, fired boolean"

        def __init__(self, rate: int, preroll: float = 0.25) -> None:
            self.rate, self.preroll = rate, preroll

        def begin(self, handle) -> None:
            self.state = handle.getValueState("take", self.FIELDS)

        def take(self, key, packets):
            powers, frames, last, recent, fired = self.state.get() if self.state.exists() else ([0.0, 0.0], 0, [], [], False)
            usual, last, recent, out = np.array(powers, dtype=float), np.array(last, dtype=float), list(recent), []
            for seq, _, x in packets:
                if fired:
                    break
                joined = np.hstack([last[:, None] if len(last) else np.zeros((len(x), 1)), x])
                loudness = np.array([[np.abs(y).max(), np.sqrt((y * y).mean())] for y in (x, np.diff(joined, axis=1))])
                last = joined[:, -1]
                held = int(np.ceil(self.preroll * self.rate / x.shape[1])) + 1
                recent = [*recent, seq][-max(2, held):]
                fired = frames >= max(1, round(self.rate * WARM_UP)) and stands_out(loudness, np.sqrt(usual))
                if fired:
                    out.append((key[0], seq, *loudness[:, 0].tolist(), recent[0]))
                usual = learned(usual, loudness[:, 1], x.shape[1] / self.rate)
                frames += x.shape[1]
            self.state.update((usual.tolist(), int(frames), last.tolist(), [int(r) for r in recent], bool(fired)))
            return pd.DataFrame(out, columns=CONTACT.names)

    class Capacity(InTurn):
        """Reports the packet in which a take reaches its frame limit."""

        def __init__(self, limit: int) -> None:
            self.limit = limit

        def begin(self, handle) -> None:
            self.state = handle.getValueState("frames", "frames long, stopped boolean")

        def take(self, key, packets):
            frames, stopped = self.state.get() if self.state.exists() else (0, False)
            out = []
            for seq, _, x in packets:
                if stopped:
                    break
                frames += x.shape[1]
                if frames >= self.limit:
                    stopped = True
                    out.append((key[0], seq, frames))
            self.state.update((int(frames), stopped))
            return pd.DataFrame(out, columns=LIMIT.names)

    return RunOut, Contact, Capacity, Weighted


def _keyed(packets: DataFrame, processor, schema: T.StructType, keys=("take_id",), late: str = LATE, **more) -> DataFrame:
    """The processor per take, with a watermark that tells it which packets can still come."""
    timed = packets.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return timed.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime", **more)


def run_out_monitor(packets: DataFrame, rate: int, hold: float = 12.0, minimum_peak_db: float = -60.0, response=None, late: str = LATE) -> DataFrame:
    """Blocks of each take with the decisions of the end-of-side monitor."""
    taps = response if response is not None else weighting_response("activity", rate)
    return _keyed(packets, _processors()[0](rate, hold, minimum_peak_db, list(taps)), RUN_OUT, late=late)


def live_weighted(packets: DataFrame, rate: int, kind: str = "K", response=None, late: str = LATE) -> DataFrame:
    """Packets with filtered samples, keyed by take and channel; their times stay event times for the windows after it."""
    taps = response if response is not None else weighting_response(kind, rate)
    return _keyed(packets, _processors()[3](list(taps), rate), PACKETS, ("take_id", "ch"), late, eventTimeColumnName="ts")


def contact_trigger(packets: DataFrame, rate: int, preroll: float = 0.25, late: str = LATE) -> DataFrame:
    """First contact of each take, with the packet its 250 ms pre-roll starts at."""
    return _keyed(packets, _processors()[1](rate, preroll), CONTACT, late=late)


def capacity_stop(packets: DataFrame, limit_frames: int, late: str = LATE) -> DataFrame:
    return _keyed(packets, _processors()[2](limit_frames), LIMIT, late=late)


# --- batch-wise recompute and exactly-once ------------------------------------------------------------------


def append_batches(stream: DataFrame, path: str, checkpoint: str, shape=lambda df: df) -> None:
    """Idempotent sink: each micro-batch owns one partition, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        shape(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("batch_id").parquet(path)

    job = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    job.awaitTermination()


def rolling_levels(blocks: DataFrame, keep: int = 1200) -> DataFrame:
    """The retained block table: the latest ``keep`` blocks of each take (two minutes), by a range filter."""
    newest = blocks.groupBy("rec_id").agg(F.max("block").alias("_newest"))
    return blocks.join(newest, "rec_id").filter(F.col("block") > F.col("_newest") - keep).drop("_newest")


def batch_extremes(blocks: DataFrame) -> DataFrame:
    """What a micro-batch adds to the figures of whole takes: one row per take, merged by maximum and sum."""
    return blocks.groupBy("rec_id").agg(
        F.max("peak_db").alias("peak_db"), F.max("true_peak_db").alias("true_peak_db"),
        F.sum("clipped").cast("long").alias("clipped"))


def append_levels(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Level assistant: the block records of every micro-batch below ``path/blocks``, its extremes below ``path/extremes``.

    Both belong to the batch's own partition, so a repeated batch replaces itself in both.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.withColumn("batch_id", F.lit(batch_id)).persist()
        for name, rows in (("blocks", kept), ("extremes", batch_extremes(kept).withColumn("batch_id", F.lit(batch_id)))):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{path}/{name}")
        kept.unpersist()

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def rolling_snapshot(
    blocks: DataFrame, extremes: DataFrame, alarms: DataFrame, rate: int, keep: int = 1200, full_scan: bool = False
) -> DataFrame:
    """Levels and advice as they stand: programme figures from the latest ``keep`` blocks, peaks and clipping from all.

    A full scan keeps every block and takes the highest programme peak instead of a high percentile. ``extremes`` are
    those of all batches; ``alarms(rec_id, flat_tops)``.
    """
    merged = extremes.groupBy("rec_id").agg(
        F.max("peak_db").alias("peak_db"), F.max("true_peak_db").alias("true_peak_db"), F.sum("clipped").alias("clipped"))
    whole = merged.join(alarms.select("rec_id", "flat_tops"), "rec_id", "left").na.fill(False, ["flat_tops"])
    return level_snapshot(blocks if full_scan else rolling_levels(blocks, keep), whole, rate, full_scan=full_scan)

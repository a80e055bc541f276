"""MinHash near-deduplication by a multi-index Hamming join.

A document's set holds the hashes of its distinct word shingles. Its signature has ``ROWS`` minima, of which ``b`` = 16
bits each are kept; the signature distance of two documents is the number of rows that differ. The rows are split into
``CHUNKS`` chunks. By the pigeonhole principle two signatures at most ``REACH`` = 2 * CHUNKS - 1 apart differ in at
most one row of some chunk, so every chunk is filed once per allowed error: under its rows with one row left out. All
pairs within REACH of 64 rows share a bucket; at similarity 0.8 the distance is 12.8 on average and above 31 with a
probability under 1e-6.

Documents with equal sets are one class and one representative from the start. Buckets are then worked off without
listing their pairs. First each bucket compares its members with one centre (the member met most often over all buckets, so
a text that many copies stem from is a centre); each comparison is exact, on full sets, and also yields what the member adds
to the centre's set and lacks of it. Links become components. Two members of one bucket that are in one component already
need no comparison. The others share a centre, and their overlap follows exactly from their differences to it: they are
compared block by block, and only links that join two components come out. So no similar pair of a bucket goes unseen, and
what is shuffled grows with the number of members and their differences, not with pairs; the comparisons inside blocks do
grow with the square of the members that no component holds together.

Edge cases: null and empty texts, and texts without a word, have an empty set and no links; texts of fewer words than a
shingle have one shingle; rows that repeat an id and text are one class; a class whose ids are all null has a null
component; an empty table gives no rows. ``docs`` must be a stable scan (a table), since rows are told apart by their
place in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.llm.components import components
from phonolake.llm.text_stats import Numbering
from phonolake.session import stage

ROWS, CHUNK = 64, 4
CHUNKS = ROWS // CHUNK
REACH = 2 * CHUNKS - 1
BLOCK, BLOCK_BYTES = 512, 16 << 20
BROADCAST_ROWS = 1_000_000  # ids of 8 bytes: 8 MB at most


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text; word hashes are kept for one batch."""

    def __init__(self, width: int):
        self.width, self.number, self.hashes = width, Numbering(), np.empty(0, dtype=np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        seen = len(self.number)
        ids = np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))
        if len(self.number) > seen:
            fresh = list(self.number)[seen:] if seen == 0 else self._tail(seen)
            self.hashes = np.concatenate([self.hashes, np.array([xxhash.xxh64_intdigest(w) for w in fresh], dtype=np.uint64)])
        h = self.hashes[ids]
        width = min(self.width, len(h))
        out = np.full(len(h) - width + 1, np.uint64(width))
        with np.errstate(over="ignore"):
            for i in range(width):
                out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i:len(h) - width + 1 + i])
        return np.unique(out)

    def _tail(self, seen: int) -> list[bytes]:
        from itertools import islice

        return list(islice(reversed(self.number), len(self.number) - seen))[::-1]


def signature(hashes: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """Row minima over the set, taken in blocks so that memory does not grow with the text."""
    low = np.full(len(salts), np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 4096):
            block = hashes[at:at + 4096]
            spread = (block[None, :] ^ salts[:, None]) * np.uint64(0xD6E8FEB86659FD93)
            np.minimum(low, (spread ^ (spread >> np.uint64(32))).min(axis=1), out=low)
    return (mixed(low) & np.uint64(0xFFFF)).astype("<u2")


def salts(rows: int = ROWS) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(np.arange(1, rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def chunk_keys(sig: np.ndarray) -> list[int]:
    """One key per chunk and left-out row: the chunk's number, the row's number and the other rows."""
    keys = []
    for c in range(CHUNKS):
        rows = [int(x) for x in sig[c * CHUNK:(c + 1) * CHUNK]]
        for out in range(CHUNK):
            kept = [x for i, x in enumerate(rows) if i != out]
            keys.append((c * CHUNK + out) << 48 | kept[0] << 32 | kept[1] << 16 | kept[2])
    return keys


SKETCH = "rid long, n long, class_hi long, class_lo long, keys array<long>"


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(rid, n, class_hi, class_lo, keys) per row of docs(rid, text): set size, 128-bit set name, bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = salts()
        for batch in batches:
            shingle, out = Shingler(width), []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = shingle(text.as_py())
                if len(hashes) == 0:
                    out.append((rid, 0, None, None, None))
                    continue
                name = xxhash.xxh128_digest(hashes.tobytes())
                hi, lo = np.frombuffer(name, dtype="<i8")
                out.append((rid, len(hashes), int(hi), int(lo), chunk_keys(signature(hashes, salt))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], t) for i, t in enumerate(
                    (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))],
                names=["rid", "n", "class_hi", "class_lo", "keys"])

    return docs.select("rid", "text").mapInArrow(run, SKETCH)


def if_small(ids: DataFrame) -> DataFrame:
    """Broadcast a staged table of ids after counting it; beyond the bound Spark joins by shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


COMPARED = "a long, centre long, n long, centre_n long, shared long, added binary, removed binary"


def compared(star: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The staged pairs star(a, centre) with the exact overlap of their full sets and what ``a`` adds to the centre's set
    and lacks of it. Only texts named in a pair move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None  # rows of one centre follow each other
        for batch in batches:
            shingle, out = Shingler(width), []
            for a, centre, x, y in zip(*(batch.column(i) for i in range(4))):
                if centre != last:
                    last, held = centre, shingle(y.as_py())
                mine = shingle(x.as_py())
                added = np.setdiff1d(mine, held, assume_unique=True)
                shared = len(mine) - len(added)
                removed = np.setdiff1d(held, mine, assume_unique=True)
                out.append((a.as_py(), centre.as_py(), len(mine), len(held), shared, added.tobytes(), removed.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], pa.int64() if i < 5 else pa.binary()) for i in range(7)],
                names=["a", "centre", "n", "centre_n", "shared", "added", "removed"])

    def texts(side: str, name: str) -> DataFrame:
        ids = stage(star.select(F.col(side).alias("rid")).distinct(), f"named-{side}")
        return docs.join(if_small(ids), "rid").select(F.col("rid").alias(side), F.col("text").alias(name))

    both = star.join(texts("a", "x"), "a").join(texts("centre", "y"), "centre")
    return both.select("a", "centre", "x", "y").sortWithinPartitions("centre").mapInArrow(run, COMPARED)


def _runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """Tables of whole groups, a group being a run of rows alike in the first ``columns`` columns."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        last = [table.column(i)[-1] for i in range(columns)]
        start = table.num_rows - 1
        while start and all(table.column(i)[start - 1] == last[i] for i in range(columns)):
            start -= 1
        if start:
            yield table.slice(0, start)
        held = table.slice(start).combine_chunks()
    if held is not None:
        yield held


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the given sets. Members found once only cannot count and leave first; the rest is
    multiplied as 0/1 columns, a few thousand at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    members, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = np.flatnonzero(times > 1)
    place = np.full(len(members), -1)
    place[often] = np.arange(len(often))
    column = place[column]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    order = order[np.searchsorted(column[order], 0):]
    for at in range(0, len(often), 4096):
        part = order[np.searchsorted(column[order], at):np.searchsorted(column[order], at + 4096)]
        marks = np.zeros((len(sets), min(4096, len(often) - at)), dtype=np.float32)
        marks[owner[part], column[part] - at] = 1
        out += marks @ marks.T
    return out


def linked_inside(live: DataFrame, percent: int) -> DataFrame:
    """live(centre, a, root, n, centre_n, added, removed, size, bytes) -> links (a, b) between members of one centre whose
    roots differ. With R and A what two members lack of and add to the centre C, their overlap is exactly
    |C| - |R1 or R2| + |A1 and A2|, so members are compared by their differences alone. Members are cut into blocks; each
    pair of blocks is a task's group of its own. Only true links come out, and no more of them than join roots."""
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    cut = live.withColumn("blocks", F.greatest(blocks, F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    dealt = (
        cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("centre", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"),
                "a", "root", "n", "centre_n", "added", "removed")
        .repartition("centre", "p", "q").sortWithinPartitions("centre", "p", "q")
    )

    def links(rows, root, n, centre_n, added, removed):
        added, removed = ([np.frombuffer(x, dtype="<u8") for x in column] for column in (added, removed))
        lacks = np.array([len(x) for x in removed], dtype=np.float64)
        both = centre_n - (lacks[:, None] + lacks[None, :] - shared_counts(removed)) + shared_counts(added)
        close = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        joined = {r: r for r in root.tolist()}

        def top(r):
            while joined[r] != r:
                r = joined[r]
            return r

        for i, j in zip(*np.nonzero(np.triu(close & (root[:, None] != root[None, :]), 1))):
            x, y = top(int(root[i])), top(int(root[j]))
            if x != y:
                joined[max(x, y)] = min(x, y)
                yield int(rows[i]), int(rows[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, 3):
            key = [table.column(i).to_numpy() for i in range(3)]
            numbers = [table.column(i).to_numpy() for i in (3, 4, 5, 6)]
            edge = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            out = []
            for start, end in zip([0, *edge], [*edge, len(key[0])]):
                rows, root, n, centre_n = (x[start:end] for x in numbers)
                if len(rows) > 1 and (root != root[0]).any():
                    sides = (table.column(i).slice(start, end - start).to_pylist() for i in (7, 8))
                    out.extend(links(rows, root, n, int(centre_n[0]), *sides))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """docs(rid, doc_id, text), rid unique -> rid, doc_id, n_shingles, component_id, first_rid, one row per input row.

    ``first_rid`` is the row that stays: the one of the smallest id, among equals the first in the table.
    """
    texts = docs.select("rid", "text")
    sk = stage(sketches(texts, width), "sketches")
    some = sk.filter("n > 0")
    classes = stage(some.groupBy("n", "class_hi", "class_lo").agg(F.min("rid").alias("rep")), "class-heads")
    member = stage(
        some.select("rid", "n", "class_hi", "class_lo").join(classes, ["n", "class_hi", "class_lo"]).select("rid", "rep"), "classes")
    copies = stage(member.filter("rid <> rep").select("rid"), "copies")
    reps = some.join(if_small(copies), "rid", "left_anti")

    filed = reps.select("rid", F.explode("keys").alias("key"))
    shared = stage(filed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "shared-keys")
    inside = stage(filed.join(shared, "key"), "buckets")
    met = inside.groupBy("rid").agg(F.sum("size").alias("met"))
    ranked = inside.join(met, "rid")
    centres = stage(
        ranked.groupBy("key").agg(F.max(F.struct("met", F.negative("rid").alias("first"))).alias("top"))
        .select("key", F.negative("top.first").alias("centre")), "centres")
    star = inside.join(centres, "key").filter("rid <> centre").select(F.col("rid").alias("a"), "centre").distinct()
    met_centre = stage(compared(stage(star, "star"), texts, width), "compared")
    links = met_centre.filter(100 * F.col("shared") >= percent * (F.col("n") + F.col("centre_n") - F.col("shared")))
    links = stage(links.select("a", F.col("centre").alias("b")), "star-links")
    roots = stage(components(links), "star-components")

    rooted = met_centre.join(roots.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    rooted = stage(rooted.drop("shared"), "rooted")
    several = stage(
        rooted.groupBy("centre").agg(
            F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"),
            F.sum(F.octet_length("added") + F.octet_length("removed")).alias("bytes"))
        .filter("lo <> hi").select("centre", "size", "bytes"), "several-roots")
    more = stage(linked_inside(rooted.join(several, "centre"), percent), "inner-links")

    whole = stage(components(links.unionByName(more)), "components") if not more.isEmpty() else roots
    label = (
        sk.select("rid", F.col("n").alias("n_shingles")).join(member, "rid", "left")
        .join(whole.withColumnRenamed("node", "rep"), "rep", "left")
        .select("rid", "n_shingles", F.coalesce("root", "rep", "rid").alias("root"))
        .join(docs.select("rid", "doc_id"), "rid")
    )
    label = stage(label, "labels")
    first = stage(label.groupBy("root").agg(
        F.min("doc_id").alias("component_id"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")), "heads")
    return label.join(first, "root").select("rid", "doc_id", "n_shingles", "component_id", F.col("first.rid").alias("first_rid"))


def numbered(docs: DataFrame) -> DataFrame:
    return docs.withColumn("rid", F.monotonically_increasing_id())

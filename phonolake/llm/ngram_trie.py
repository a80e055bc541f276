"""N-gram language model in an Elias-Fano trie of memory-mapped levels.

Level 1 is the vocabulary: sorted 63-bit word names with exact counts; a word's number is its place. Level k holds the
k-grams by (number of their first k-1 words on level k-1, number of the last word). Context times vocabulary plus word makes
the whole level one rising sequence, which is Elias-Fano coded: the children of a context are neighbours, and the borders in
the unary high bits point to them. A query goes to its border and compares from there: the place where it is found is the
number of the k-gram and the context of the next level.

Smoothing is interpolated absolute discounting: p_k = max(n - D, 0) / n(context) + D * types / n(context) * p_(k-1), ending
in the add-0.1 unigram with one share for unknown words. The discounted share of each k-gram and the weight of each context
are kept as 16-bit logarithms.

Levels are cut into shards by name or context range, one file each in the shared folder; shards grow in number with the
text, so a shard is of bounded size but for the followers of one context, at most the vocabulary. Tasks count within
themselves first and shuffle packed counts (sorted differences, compressed), never occurrences. Texts are cut into words
twice, for the vocabulary and for their numbers, which are written once; all later steps read the numbers. Scoring maps the
files and shuffles nothing. A file is written under a name of its task and then moved, so a repeated task is harmless.

Edge cases: a null or empty text is one end token; a null id counts as held out and never trains; repeated rows count
as often as they occur; a table without training rows gives an empty vocabulary, where every token is unknown and has
the probability one share in one; other columns are not read.
"""

from __future__ import annotations

import json
import mmap
import os
import tempfile
import uuid
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.llm.elias_fano import EliasFano, encode
from phonolake.llm.files import file_system
from phonolake.session import scratch_path, stage

NAMES = 1 << 63
DISCOUNT = 0.75
STEP = 4096  # 16-bit codes: log10 in steps of 1 / 4096, down to -16
WORDS_KEPT = 300_000
TOKENS_AT_ONCE = 1_000_000
SHARD_BYTES = 24 << 20
SHARES = 10.0 ** (np.arange(1 << 16) / -STEP)
END = b""


def name_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


def logs(p: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) * STEP), 0, 65535).astype(np.uint16)


def shares(codes: np.ndarray) -> np.ndarray:
    return SHARES[codes]


def pack(numbers: np.ndarray) -> bytes:
    """Differences of a rising sequence, byte planes apart, compressed."""
    gaps = np.diff(numbers.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(counts.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_counts(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel().astype(np.int64)


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts with their counts summed."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k)
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


# Files of arrays: a line of JSON with the layout, then the arrays on 64-byte borders.

def save(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    layout, at = {}, 0
    for key, a in arrays.items():
        layout[key] = [str(a.dtype), len(a), at]
        at += (a.nbytes + 63) // 64 * 64
    head = json.dumps(layout).encode()
    head += b" " * (-(len(head) + 1) % 64) + b"\n"
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)
    part = f"{root}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(head)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes())
            out.write(b"\0" * (-a.nbytes % 64))
    system.move(part, f"{root}/{name}")


def load(folder: str, name: str) -> dict[str, np.ndarray]:
    """Arrays mapped from a file; from a store that cannot be mapped, a copy without a name is mapped."""
    from pyarrow import fs

    system, root = file_system(folder)
    if isinstance(system, fs.LocalFileSystem):
        file = open(f"{root}/{name}", "rb")  # noqa: SIM115
    else:
        file = tempfile.TemporaryFile()  # gone from the folder at once, and from the disk when the map goes
        with system.open_input_stream(f"{root}/{name}") as source:
            while block := source.read(8 << 20):
                file.write(block)
        file.flush()
    with file:
        whole = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
    end = whole.find(b"\n") + 1
    return {
        key: np.frombuffer(whole, dtype=dtype, count=n, offset=end + at)
        for key, (dtype, n, at) in json.loads(whole[:end]).items()
    }


class Vocabulary:
    """Level 1 over all shards: names to numbers, numbers to counts."""

    def __init__(self, folder: str, shards: list[dict]):
        self.folder, self.shards = folder, shards
        self.first = np.array([s["first"] for s in shards] + [shards[-1]["first"] + shards[-1]["n"] if shards else 0])
        self.size, self.total = int(self.first[-1]), sum(s["total"] for s in shards)
        self.held: dict[int, tuple[EliasFano, np.ndarray]] = {}

    def part(self, i: int):
        if i not in self.held:
            arrays = load(self.folder, f"words-{self.shards[i]['shard']}")
            self.held[i] = EliasFano(arrays), arrays["counts"]
        return self.held[i]

    def numbers(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number or -1, count) of each name."""
        out, count = np.full(len(names), -1, dtype=np.int64), np.zeros(len(names), dtype=np.int64)
        if not self.shards:
            return out, count
        order = np.argsort(names)
        names = names[order]
        lows = np.array([s["low"] for s in self.shards], dtype=np.uint64)
        where = np.searchsorted(lows, names, side="right") - 1
        for i in np.unique(where):
            if i < 0:
                continue
            mine = np.flatnonzero(where == i)
            words, counts = self.part(int(i))
            at = words.find(names[mine])
            seen = at >= 0
            out[order[mine[seen]]] = at[seen] + self.first[i]
            count[order[mine[seen]]] = counts[at[seen]]
        return out, count


    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Count of each number; 0 for -1."""
        distinct, back = np.unique(numbers, return_inverse=True)
        out = np.zeros(len(distinct), dtype=np.int64)
        edges = np.searchsorted(distinct, self.first)
        for i in np.flatnonzero(np.diff(edges)):
            a, b = edges[i], edges[i + 1]
            out[a:b] = self.part(int(i))[1][distinct[a:b] - self.first[i]]
        return out[back]


class Level:
    """Level k > 1 over all shards: (context, word) to number and discounted share, context to weight."""

    def __init__(self, folder: str, order: int, shards: list[dict], words: int):
        self.folder, self.order, self.shards, self.words = folder, order, shards, words
        self.held: dict[int, dict] = {}
        self.lows = np.array([s["low"] for s in shards], dtype=np.int64)
        self.first = np.array([s["first"] for s in shards], dtype=np.int64)
        self.size = sum(s["n"] for s in shards)

    def part(self, i: int) -> dict:
        if i not in self.held:
            a = load(self.folder, f"grams{self.order}-{self.shards[i]['shard']}")
            ids = EliasFano({k.split(".")[1]: v for k, v in a.items() if k.startswith("ids.")})
            self.held[i] = {"ids": ids, "share": a["share"], "weight": a["weight"]}
        return self.held[i]

    def look(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number or -1, share, weight of the context; 0 and 1 where unseen), for known contexts in rising order."""
        number = np.full(len(context), -1, dtype=np.int64)
        share, weight = np.zeros(len(context)), np.ones(len(context))
        edges = np.append(np.searchsorted(context, self.lows), len(context))
        for i in np.flatnonzero(np.diff(edges)):
            p, a, b = self.part(int(i)), edges[i], edges[i + 1]
            b = a + int(np.searchsorted(context[a:b], self.lows[i] + len(p["weight"])))  # a shard without grams has no file
            local = context[a:b] - self.lows[i]
            weight[a:b] = shares(p["weight"][local])
            ask = np.flatnonzero(word[a:b] >= 0)
            found = p["ids"].find(local[ask] * self.words + word[a:b][ask])
            hit = np.flatnonzero(found >= 0)
            number[a + ask[hit]] = found[hit] + self.first[i]
            share[a + ask[hit]] = shares(p["share"][found[hit]])
        return number, share, weight


def level_arrays(context: np.ndarray, word: np.ndarray, count: np.ndarray, discount: float, words: int | None = None
                 ) -> dict[str, np.ndarray]:
    """Arrays of one shard from its k-grams, sorted by (context - low, word); a weight for each context that has any."""
    starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
    sizes = np.diff(np.append(starts, len(context)))
    total = np.add.reduceat(count, starts)
    ids = context * (words or int(word.max()) + 1) + word
    out = {f"ids.{k}": v for k, v in encode(ids, int(ids[-1]) + 1).items()}
    out["share"] = logs((count - discount) / np.repeat(total, sizes))
    out["weight"] = logs(discount * sizes / total)
    return out


class Places(dict):
    """Words to their place in the order of first appearance."""

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place


class Words:
    """Words of a task to small numbers, with the names of the new ones; forgets all when full."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.local = Places()
        self.names = np.empty(0, dtype=np.uint64)
        self.numbers = np.empty(0, dtype=np.int64)

    def tokens(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        words.append(END)
        return np.fromiter(map(self.local.__getitem__, words), dtype=np.int64, count=len(words))

    def fresh(self) -> np.ndarray:
        """Names of all words met, brought up to date."""
        new = [name_of(w) for w in islice(self.local, len(self.names), None)]
        if new:
            self.names = np.concatenate([self.names, np.array(new, dtype=np.uint64)])
        return self.names

    def numbered(self, vocabulary: Vocabulary) -> np.ndarray:
        """Numbers of all words met, brought up to date."""
        new = self.fresh()[len(self.numbers):]
        if len(new):
            self.numbers = np.concatenate([self.numbers, vocabulary.numbers(new)[0]])
        return self.numbers


def chunks(batches: Iterator[pa.RecordBatch], words: Words, column: int):
    """(rows so far as (batch, row) lists, token arrays), about TOKENS_AT_ONCE tokens at a time."""
    rows, held, n = [], [], 0
    for batch in batches:
        for i, text in enumerate(batch.column(column)):
            ids = words.tokens(text.as_py())
            rows.append(tuple(batch.column(c)[i].as_py() for c in range(column)))
            held.append(ids)
            n += len(ids)
            if n >= TOKENS_AT_ONCE:
                yield rows, held
                rows, held, n = [], [], 0
                if len(words.local) > WORDS_KEPT:
                    words.clear()
    if rows:
        yield rows, held


def _sharded(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    edge = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(shard)) if len(shard) else np.array([0])
    spans = list(zip(edge[:-1], edge[1:]))
    return pa.RecordBatch.from_arrays(
        [pa.array([int(shard[a]) for a, _ in spans], pa.int64()), pa.array([pack(keys[a:b]) for a, b in spans], pa.binary()),
         pa.array([pack_counts(counts[a:b]) for a, b in spans], pa.binary())], names=["shard", "keys", "counts"])


PACKED = "shard long, keys binary, counts binary"
BUILT = "shard long, low long, n long, total long"


class Pool:
    """Counts of a task, merged whenever many have come together."""

    def __init__(self, most: int = 4_000_000):
        self.keys, self.counts, self.held, self.most = [], [], 0, most

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        if not len(keys):
            return
        self.keys.append(keys), self.counts.append(counts)
        self.held += len(keys)
        if self.held > self.most and len(self.keys) > 1:
            k, c = merged(self.keys, self.counts)
            self.keys, self.counts, self.held = [k], [c], len(k)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        k, c = merged(self.keys, self.counts) if self.keys else (np.empty(0, np.uint64), np.empty(0, np.int64))
        self.keys, self.counts, self.held = [], [], 0
        return k, c


def number_chunks(batches: Iterator[pa.RecordBatch], kind: str):
    """(slices of batches, numbers, lengths, starts) of about TOKENS_AT_ONCE tokens; the numbers are the last column."""
    parts, held, sizes, n = [], [], [], 0

    def whole():
        lengths = np.concatenate(sizes)
        return parts, np.concatenate(held).astype(np.int64), lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])

    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        _, edges, data = column.buffers()
        edges = np.frombuffer(edges, np.int64 if pa.types.is_large_binary(column.type) else np.int32)
        edges = edges[column.offset:column.offset + len(column) + 1].astype(np.int64)
        at = 0
        while at < len(column):
            width = np.dtype(kind).itemsize
            to = min(len(column), int(np.searchsorted(edges, edges[at] + (TOKENS_AT_ONCE - n) * width)))
            to = max(to, at + 1)
            held.append(np.frombuffer(data, np.uint8)[edges[at]:edges[to]].view(kind))
            sizes.append(np.diff(edges[at:to + 1]) // width)
            parts.append(batch.slice(at, to - at))
            n, at = n + len(held[-1]), to
            if n >= TOKENS_AT_ONCE:
                yield whole()
                parts, held, sizes, n = [], [], [], 0
    if parts:
        yield whole()


def _shifted(values: np.ndarray, starts: np.ndarray, fill: int) -> np.ndarray:
    """The value one place earlier in the same text; ``fill`` at its start."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[starts] = fill
    return out


class Model:
    """All levels, opened from a plain description that travels with the tasks."""

    def __init__(self, plan: dict):
        self.plan = plan
        self.vocabulary = Vocabulary(plan["folder"], plan["words"])
        self.levels = [Level(plan["folder"], k + 2, s, self.vocabulary.size) for k, s in enumerate(plan["levels"])]

    def end(self) -> int:
        """Number of the end token, which also opens every text."""
        return int(self.vocabulary.numbers(np.array([name_of(END)], dtype=np.uint64))[0][0])

    def walk(self, number: np.ndarray, starts: np.ndarray, end: int, p: np.ndarray | None = None):
        """Numbers of the longest-order contexts per token, and, given p (the unigram), the interpolated probability."""
        context = _shifted(number, starts, end)
        for level in self.levels:
            key = np.where(context < 0, -1, context * (level.words + 1) + number + 1)
            order = np.argsort(key)
            key = key[order]
            known = int(np.searchsorted(key, 0))
            order, key = order[known:], key[known:]
            first = np.ones(len(key), dtype=bool)
            first[1:] = key[1:] != key[:-1]
            one, spread = order[first], np.cumsum(first) - 1
            found, share, weight = level.look(context[one], number[one])
            if p is not None:
                p = p.copy()
                p[order] = share[spread] + weight[spread] * p[order]
            gram = np.full(len(number), -1, dtype=np.int64)
            gram[order] = found[spread]
            context = _shifted(gram, starts, -1)
        return context, p


def count_words(docs: DataFrame, shards: int) -> DataFrame:
    def run(batches):
        words, pool = Words(), Pool()
        for _, arrays in chunks(batches, words, 0):
            counts = np.bincount(np.concatenate(arrays))
            local = np.flatnonzero(counts)
            pool.add(words.fresh()[local], counts[local])
        keys, counts = pool.take()
        if len(keys):
            yield _sharded(keys, counts, (keys // np.uint64(NAMES // shards + 1)).astype(np.int64))

    return docs.select("text").mapInArrow(run, PACKED)


def number_type(plan: dict) -> str:
    return "<i4" if sum(s["n"] for s in plan["words"]) < 1 << 31 else "<i8"


NUMBERED = "doc_id long, held_out boolean, numbers binary"


def numbered(docs: DataFrame, plan: dict) -> DataFrame:
    """docs(doc_id, held_out, text) -> NUMBERED: the vocabulary's number of every token, -1 for unknown words."""
    kind = number_type(plan)

    def run(batches):
        vocabulary, words = Vocabulary(plan["folder"], plan["words"]), Words()
        for rows, arrays in chunks(batches, words, 2):
            numbers = words.numbered(vocabulary)[np.concatenate(arrays)].astype(kind)
            edges = np.cumsum([0] + [len(a) for a in arrays]) * numbers.itemsize
            binary = pa.Array.from_buffers(
                pa.large_binary(), len(rows), [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(numbers.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), binary.cast(pa.binary())],
                names=["doc_id", "held_out", "numbers"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, NUMBERED)


def count_grams(texts: DataFrame, plan: dict, contexts: int, shards: int) -> DataFrame:
    """Packed (context, word) counts one level above the plan's last, from texts(numbers)."""
    kind = number_type(plan)

    def run(batches):
        model, pool = Model(plan), Pool()
        size, width, end = model.vocabulary.size, -(-contexts // shards), model.end()
        for _, number, _, starts in number_chunks(batches, kind):
            context, _ = model.walk(number, starts, end)
            fit = context >= 0
            keys, counts = np.unique(context[fit].astype(np.uint64) * np.uint64(size) + number[fit].astype(np.uint64), return_counts=True)
            pool.add(keys, counts)
            if pool.held > pool.most:  # still many after merging: hand them on
                keys, counts = pool.take()
                yield _sharded(keys, counts, (keys // np.uint64(size * width)).astype(np.int64))
        keys, counts = pool.take()
        if len(keys):
            yield _sharded(keys, counts, (keys // np.uint64(size * width)).astype(np.int64))

    return texts.select("numbers").mapInArrow(run, PACKED)


def _gathered(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    pool = Pool()
    for k, c in zip(group.column("keys"), group.column("counts")):
        pool.add(unpack(k.as_py()), unpack_counts(c.as_py()))
    return pool.take()


def _built(shard: int, low: int, n: int, total: int) -> pa.Table:
    return pa.table({"shard": pa.array([shard], pa.int64()), "low": pa.array([low], pa.int64()),
                     "n": pa.array([n], pa.int64()), "total": pa.array([total], pa.int64())})


def _shard_list(built: DataFrame, label: str) -> list[dict]:
    """The shards' descriptions, some dozen bytes for each SHARD_BYTES of text, with running first numbers."""
    out, first = [], 0
    for r in stage(built, label).orderBy("shard").collect():
        out.append(r.asDict() | {"first": first})
        first += r["n"]
    return out


def _gram_builder(folder: str, k: int, vocabulary: int, width: int, discount: float):
    def build(key, group):
        shard = key[0].as_py()
        keys, counts = _gathered(group)
        context = (keys // np.uint64(vocabulary)).astype(np.int64) - shard * width
        word = (keys % np.uint64(vocabulary)).astype(np.int64)
        arrays = level_arrays(context, word, counts, discount, vocabulary)
        weight = np.zeros(width, dtype=np.uint16)  # of contexts without followers: 1
        weight[context[np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))]] = arrays["weight"]
        save(folder, f"grams{k}-{shard}", arrays | {"weight": weight})
        return _built(shard, shard * width, len(keys), int(counts.sum()))

    return build


def train_words(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> dict:
    """docs(text) -> plan: the folder of the levels and the shards of the vocabulary."""
    folder = scratch_path(docs.sparkSession, "ngram-trie")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-int(size) // shard_bytes))

    def words(key, group):
        shard = key[0].as_py()
        names, counts = _gathered(group)
        low = int(shard * (NAMES // shards + 1))
        save(folder, f"words-{shard}", encode(names, NAMES) | {"counts": counts})
        return _built(shard, low, len(names), int(counts.sum()))

    built = count_words(docs, shards).groupBy("shard").applyInArrow(words, BUILT)
    return {"folder": folder, "shards": shards, "words": _shard_list(built, "word-shards"), "levels": []}


def train_levels(texts: DataFrame, plan: dict, order: int = 3, discount: float = DISCOUNT) -> dict:
    """The plan with levels up to ``order``, from the training rows of ``numbered``, read once a level."""
    vocabulary = contexts = sum(s["n"] for s in plan["words"])
    plan, shards = plan | {"levels": list(plan["levels"])}, plan["shards"]
    for k in range(2, order + 1):
        if not contexts:
            break
        width = -(-contexts // shards)
        counted = count_grams(texts, plan, contexts, shards)
        plan["levels"].append(_shard_list(counted.groupBy("shard").applyInArrow(
            _gram_builder(plan["folder"], k, vocabulary, width, discount), BUILT), f"gram-shards-{k}"))
        contexts = sum(s["n"] for s in plan["levels"][-1])
    return plan


def train(docs: DataFrame, order: int = 3, discount: float = DISCOUNT, shard_bytes: int = SHARD_BYTES) -> dict:
    """docs(text) -> plan: the folder of the levels and their shards."""
    plan = train_words(docs, shard_bytes)
    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), "text")
    return train_levels(stage(numbered(rows, plan), "numbered"), plan, order, discount)


SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def score_numbered(texts: DataFrame, plan: dict) -> DataFrame:
    """NUMBERED -> SCORES, one row per input row."""
    kind = number_type(plan)

    def run(batches):
        model = Model(plan)
        total, size, end = model.vocabulary.total, model.vocabulary.size, model.end()
        for parts, number, lengths, starts in number_chunks(batches, kind):
            p = (model.vocabulary.counts(number) + 0.1) / (total + 0.1 * (size + 1))
            _, full = model.walk(number, starts, end, p)
            sums = [np.add.reduceat(x, starts) for x in ((number >= 0).astype(np.int64), np.log10(p), np.log10(full))]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([b.column(0) for b in parts]), pa.concat_arrays([b.column(1) for b in parts]),
                 pa.array(lengths, pa.int64()), pa.array(sums[0], pa.int64()),
                 pa.array(np.full(len(lengths), total), pa.int64()), pa.array(sums[1], pa.float64()), pa.array(sums[2], pa.float64())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return texts.select("doc_id", "held_out", "numbers").mapInArrow(run, SCORES)


def score(docs: DataFrame, plan: dict) -> DataFrame:
    """docs(doc_id, held_out, text) -> SCORES, one row per input row."""
    return score_numbered(numbered(docs, plan), plan)


def train_and_score(docs: DataFrame, order: int = 3) -> DataFrame:
    """Learns from rows whose crc32(doc_id as text) mod 10 is not 0 and scores every row."""
    bucket = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10, F.lit(0))
    docs = docs.select("doc_id", (bucket == 0).alias("held_out"), "text")
    plan = train_words(docs.filter(~F.col("held_out")))
    texts = stage(numbered(docs, plan), "numbered")
    return score_numbered(texts, train_levels(texts.filter(~F.col("held_out")), plan, order))

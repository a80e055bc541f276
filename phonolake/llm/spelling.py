"""Spelling variants: words one edit apart, found by pivotal grams, and the chains from rare forms to common ones.

Two words one insertion, deletion or replacement apart share a bigram that the edit did not touch. Bigrams are ranked by how
many words hold them, rarest first. A word's prefix is its three rarest bigrams (with all others of the last one's rank); among
them a dynamic programme chooses two that do not overlap and are rarest together, its pivots. An edit spoils at most one of two
disjoint pivots, so of two near words the one whose prefix ends earlier has a pivot in the prefix of the other. Pivots are
therefore looked up in the index of prefixes, under position limits: counted from the end that the edit left alone, a bigram keeps its
place. What lies on that side is equal as well, and so is one half of the other side; their hashes belong to the key, so only
words that differ within a quarter of their length or so meet, however common a bigram is. Candidates are verified by edit
distance.

Words are counted where a text is read, in dictionaries flushed at ``FLUSH`` entries, then by a grouped sum. The rank of
bigrams is a table of the alphabet's pairs (at most 90 x 90), the only thing the driver holds. Chains are followed by pointer
doubling, one join a round, since a form has at least five times its word's occurrences.

Every join asks for a merge join: entries are made by ``mapInArrow`` and words are read from compressed files, so the planner,
which sees the files only, would broadcast tables of many times the size it counts on.

Edge cases: null and empty texts have no runs; a null doc_id is written as the empty string; repeated rows count each; very
long texts are read in stretches cut between runs; ties go to the smaller word in code-point order; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.session import stage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
STRETCH = 1 << 20
FLUSH = 200_000
GRAM = 2
EDITS = 1


def stretches(text: str) -> Iterator[str]:
    """The text in pieces of about STRETCH characters, none of which ends inside a run."""
    at = 0
    while len(text) - at > STRETCH:
        inside = RUN.match(text, at + STRETCH)
        end = inside.end() if inside else at + STRETCH
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def spelt(doc_id, run: str, every: int) -> str:
    """The run, short of one code point where its hash says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % every else run[:h % len(run)] + run[h % len(run) + 1:]


def word_counts(docs: DataFrame, every: int = 199, shortest: int = 6, least: int = 5) -> DataFrame:
    """docs(doc_id, text) -> word, n: words of at least ``shortest`` code points that occur at least ``least`` times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), pa.array(list(known.values()), pa.int64())], names=["word", "n"])
            known.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for stretch in stretches((text.as_py() or "").translate(LOWER)):
                    for run, n in Counter(RUN.findall(stretch)).items():
                        if len(run) >= shortest and len(word := spelt(doc_id, run, every)) >= shortest:
                            known[word] += n
                    if len(known) >= FLUSH:
                        yield flushed()
        yield flushed()

    parts = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def pivots(grams: list[tuple[int, int]], weights: list[int], count: int = EDITS + 1, apart: int = GRAM) -> list[int]:
    """Indexes of ``count`` grams (rank, position), no two of which overlap, of the least total weight.

    best[k] after the grams up to some position is the cheapest choice of k of them; a gram extends what was best before
    the grams it overlaps. Grams come in no order; None where there are no ``count`` disjoint ones.
    """
    order = sorted(range(len(grams)), key=lambda i: grams[i][1])
    tables: list[list[tuple[int, list[int]] | None]] = [[(0, [])] + [None] * count]
    for j, i in enumerate(order):
        free = sum(grams[o][1] <= grams[i][1] - apart for o in order[:j])
        row = list(tables[-1])
        for k in range(1, count + 1):
            base = tables[free][k - 1]
            if base is not None and (row[k] is None or base[0] + weights[i] < row[k][0]):
                row[k] = (base[0] + weights[i], [*base[1], i])
        tables.append(row)
    return tables[-1][count][1] if tables[-1][count] else None


def prefix_and_pivots(word: str, rank: dict[str, int], sizes: dict[str, int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(prefix, pivots) of a word as (rank, position) of its bigrams."""
    grams = sorted((rank[word[i:i + GRAM]], i) for i in range(len(word) - GRAM + 1))
    core = grams[:GRAM * EDITS + 1]
    prefix = core + [g for g in grams[len(core):] if g[0] == core[-1][0]]
    chosen = pivots(core, [sizes[word[i:i + GRAM]] for _, i in core])
    return prefix, [core[i] for i in chosen]


class Hashes:
    """Polynomial hashes of any stretch of a word, from one pass over it."""

    BASE, PRIME = 1_000_003, (1 << 61) - 1

    def __init__(self, word: str):
        self.sums, self.powers = [0], [1]
        for c in word:
            self.sums.append((self.sums[-1] * self.BASE + ord(c)) % self.PRIME)
            self.powers.append(self.powers[-1] * self.BASE % self.PRIME)

    def __call__(self, a: int, b: int) -> int:
        return (self.sums[b] - self.sums[a] * self.powers[b - a]) % self.PRIME


def keys_of(hashes: Hashes, length: int, place: int, spread: int) -> set[int]:
    """Keys of what a word and a near one share if the bigram at ``place`` is untouched.

    The edit lies after the bigram, so that the word is equal up to its end, or before it, so that the rest is equal. Of the
    changed side, m long, either the half beside the bigram (m // 2) or the far one (the other m - m // 2) is equal too. m is
    that of the word with ``spread`` 0; the other word tries the lengths up to ``spread`` away.
    """
    end, out = place + GRAM, set()
    for side, own in ((0, length - end), (1, place)):
        for m in range(max(0, own - spread), own + spread + 1):
            near, far = m // 2, m - m // 2
            if near <= own:
                out.add(hash((side, 0, near, end, hashes(0, end + near))) if side == 0 else
                        hash((side, 0, near, length - place, hashes(place - near, length))))
            if near and far <= own:  # an empty half beside the bigram is always equal
                out.add(hash((side, 1, far, end, hashes(0, end), hashes(length - far, length))) if side == 0 else
                        hash((side, 1, far, length - place, hashes(0, far), hashes(place, length))))
    return out


def gram_sizes(words: DataFrame) -> dict[str, int]:
    """Words that hold each bigram: at most 90 x 90 entries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for word in batch.column(0):
                held.update(set(map("".join, zip(w := word.as_py(), w[1:]))))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["gram", "n"])

    sums = words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in sums.collect()}


def near_pairs(words: DataFrame) -> DataFrame:
    """words(word, n) with words of at least four code points -> a, b: every pair at distance one, in both directions.

    Entries carry numbers and hashes, so a word of any length costs in proportion to its bigrams of the last rank.
    """
    sizes = gram_sizes(words)
    rank = {g: i for i, g in enumerate(sorted(sizes, key=lambda g: (sizes[g], g)))}
    numbered = stage(words.select(F.monotonically_increasing_id().alias("id"), "word"), "numbered-words")

    def cut(pivot: bool):
        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            types = dict(id=pa.int64(), last=pa.int32(), length=pa.int32(), key=pa.int64())
            for batch in batches:
                out: list[tuple] = []
                for number, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    prefix, chosen = prefix_and_pivots(word, rank, sizes)
                    hashes = Hashes(word)
                    found = {key for _, i in (chosen if pivot else prefix) for key in keys_of(hashes, len(word), i, EDITS if pivot else 0)}
                    out += ((number, prefix[-1][0], len(word), key) for key in found)
                columns = zip(*out) if out else [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], names=list(types))

        name = "a" if pivot else "b"
        return numbered.mapInArrow(entries, "id long, last int, length int, key long").select(
            "key", *[F.col(c).alias(f"{name}_{c}") for c in ("id", "last", "length")])

    met = cut(True).join(cut(False).hint("merge"), "key").filter(
        (F.col("a_last") <= F.col("b_last")) & (F.abs(F.col("a_length") - F.col("b_length")) <= EDITS) & (F.col("a_id") != F.col("b_id")))
    pairs = met.select(F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct()
    spelled = pairs.join(numbered.select(F.col("id").alias("a_id"), F.col("word").alias("a")).hint("merge"), "a_id").join(
        numbered.select(F.col("id").alias("b_id"), F.col("word").alias("b")).hint("merge"), "b_id")
    near = spelled.filter(F.levenshtein("a", "b", EDITS) == EDITS).select("a", "b")
    return near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))


def roots(forms: DataFrame) -> DataFrame:
    """forms(word, form) without null forms -> word, root: the last form reached, by pointer doubling."""
    state = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = state.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        step = stage(step, "spelling-roots")
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        state = step.select("word", "root")


def variants(docs: DataFrame, every: int = 199, shortest: int = 6, least: int = 5, times: int = 5) -> DataFrame:
    """docs(doc_id, text) -> word, form, root, n, n_near, form_n, one row per word."""
    if shortest < 4:
        raise ValueError("a word needs two disjoint bigrams among its three rarest: four code points")
    words = stage(word_counts(docs, every, shortest, least), "words")
    best = (
        near_pairs(words).join(words.select(F.col("word").alias("b"), F.col("n").alias("b_n")).hint("merge"), "b")
        .groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    )
    clear = -F.col("best.less") >= times * F.col("n")
    chosen = stage(
        words.join(best.hint("merge"), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(clear, F.col("best.form")).alias("form"),
            F.when(clear, -F.col("best.less")).alias("form_n")), "spelling-forms")
    ends = roots(chosen.filter(F.col("form").isNotNull()).select("word", "form"))
    return chosen.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

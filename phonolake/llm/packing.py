"""Packing by power-of-two decomposition.

Each document (token ids, then one end id) is cut into pieces of ``longest`` ids and then into the powers of two of the
rest, longest first. A piece is a sequence of its own: none crosses a document, and none needs padding because its
length is a power of two. Pieces of one length form a bucket; a trainer draws each batch from one bucket.

Nothing is shuffled: pieces are made where their document is read. ``sequence_id`` numbers the pieces of a scan partition in the
order of its rows, above the partition's number in the upper 31 bits (room for 2**33 pieces a partition), so the same table
gives the same ids whatever executor runs a task. Token ids of words seen before come from a bounded cache of byte strings.
Added tokens of the tokenizer's JSON (``<|endoftext|>``) are found first and give their own id; what lies between them is
encoded alone. ``write_buckets`` files the pieces by length.

Edge cases: a null or empty text is one piece holding the end id; repeated rows are packed each; a very long text is encoded
whole, in memory in proportion to it; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
WORDS_CACHED = 400_000
ROW_BITS = 33  # of a row's place in the scan, below the partition's number

#: A blank with other white space beside it, or at an end of the text: such a text is not cut at its blanks.
_LOOSE_BLANK = re.compile(r"\s | \s|^ | $")


class Encoder:
    """Text to little-endian 32-bit ids. A single blank between two other characters always starts a new token, so
    words are encoded once, with the blank in front, and looked up afterwards."""

    def __init__(self, ranks_path: str, pattern: str, added: dict[str, int] | None = None):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words: dict[str, bytes] = {}
        self.added = {token: np.array([i], dtype="<u4").tobytes() for token, i in (added or {}).items()}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut_at_added = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if added else None

    def plain(self, text: str) -> bytes:
        return np.array(self.encode(text), dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.cut_at_added:
            first, *more = self.cut_at_added(text)
            if more:
                return self.between(first) + b"".join(self.added[x] if k % 2 == 0 else self.between(x) for k, x in enumerate(more))
        return self.between(text)

    def between(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if not text or _LOOSE_BLANK.search(text):
            return self.plain(text)
        known, out = self.words, []
        first, *rest = text.split(" ")
        out.append(self.plain(first))
        for word in rest:
            ids = known.get(word)
            if ids is None:
                if len(known) >= WORDS_CACHED:
                    known.clear()
                ids = known[word] = self.plain(" " + word)
            out.append(ids)
        return b"".join(out)


def added_tokens(json_path: str) -> dict[str, int]:
    """The added tokens of a tokenizer's JSON with their ids."""
    with open(json_path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    for token in added:
        if token["lstrip"] or token["rstrip"] or token["single_word"]:
            raise ValueError(f"{token['content']} takes in what stands beside it")
    return {token["content"]: token["id"] for token in added}


def piece_lengths(total: int, longest: int) -> list[int]:
    """``longest`` as often as it fits, then the powers of two in the rest, falling."""
    whole, rest = divmod(total, longest)
    return [longest] * whole + [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]


def pack(docs: DataFrame, longest: int = 1024, end_id: int = 0, ranks_path: str | None = None,
         json_path: str | None = None) -> DataFrame:
    """docs(doc_id, text) -> one row per piece (PIECES). Other ranks have the added tokens of their own JSON, if one is given."""
    import public_tokenizers

    if longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    path, pattern = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    added = added_tokens(json_path or public_tokenizers.path("byte_bpe_50k.json")) if json_path or not ranks_path else {}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(path, pattern, added), np.array([end_id], dtype="<u4").tobytes()
        packed = 0
        for batch in batches:
            doc, piece, start, length, crc, total, sequence = ([] for _ in range(7))
            for doc_id, text, place in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = memoryview(encode(text or "") + end)
                n, at = len(ids) // 4, 0
                for k, size in enumerate(piece_lengths(n, longest)):
                    doc.append(doc_id), piece.append(k), start.append(at), length.append(size), total.append(n)
                    crc.append(zlib.crc32(ids[4 * at:4 * (at + size)]))
                    sequence.append((place >> ROW_BITS << ROW_BITS) + packed)
                    packed += 1
                    at += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()),
                 *[pa.array(x, pa.int64()) for x in (start, length, crc, total, sequence, [0] * len(doc))]],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id()).mapInArrow(cut, PIECES)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Files the pieces by length, one folder a power of two, so that a batch is read from one bucket.

    A task writes at most one file a bucket; rows are sorted by length first so that it holds one open at a time.
    """
    pieces.sortWithinPartitions("length").write.partitionBy("length").parquet(path)

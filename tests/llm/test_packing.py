"""Pieces against the tokenizer itself."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from phonolake.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ENCODER = P.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é\n\t'sé12.,   　<|end>")), max_size=40))
def test_word_cache_gives_the_tokenizers_ids(text):
    want = TOKENIZER.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ENCODER(text), dtype="<u4").tolist() == want


def test_lengths_are_powers_of_two():
    for total in (1, 2, 3, 1023, 1024, 1025, 5000, 123_457):
        lengths = P.piece_lengths(total, 1024)
        assert sum(lengths) == total and all(x <= 1024 and x & (x - 1) == 0 for x in lengths)
        assert sum(x < 1024 for x in lengths) <= 10


def test_pieces_cover_every_id_once(stable, tokenizer):
    texts = [(r.doc_id, r.text) for r in stable.select("doc_id", "text").collect()]
    want = Counter()
    for doc_id, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        at = 0
        for n in P.piece_lengths(len(ids), 1024):
            want[doc_id, at, n, zlib.crc32(ids[at:at + n].tobytes()), len(ids), 0] += 1
            at += n
    rows = P.pack(stable).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.offset) for r in rows) == want
    assert len({r.sequence_id for r in rows}) == len(rows)
    again = P.pack(stable).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_sequence_ids_of_late_and_large_partitions(spark):
    """Pieces of a partition are numbered in turn above its number: long documents and any number of partitions fit a long."""
    docs = spark.createDataFrame([(i, "word " * (3000 if i == 0 else 3)) for i in range(40)], "doc_id long, text string").repartition(7)
    ids = [r.sequence_id for r in P.pack(docs, longest=2).collect()]
    assert len(set(ids)) == len(ids)
    assert len({i >> P.ROW_BITS for i in ids}) > 1 and max(i & (1 << P.ROW_BITS) - 1 for i in ids) >= 1500
    assert ((1 << 30) - 1 << P.ROW_BITS) + (1 << P.ROW_BITS) - 1 < 1 << 63


def test_buckets_hold_one_length(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (3 * i)) for i in range(60)], "doc_id long, text string")
    pieces = P.pack(docs, longest=16)
    P.write_buckets(pieces, str(tmp_path / "buckets"))
    assert sorted(x.name for x in (tmp_path / "buckets").glob("length=*")) == sorted(f"length={1 << k}" for k in range(5))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    assert sorted(map(str, back.select(pieces.columns).collect())) == sorted(map(str, pieces.withColumn("length", F.col("length").cast("int")).collect()))


def test_empty_table(nothing):
    assert P.pack(nothing).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        P.pack(nothing, longest=1000)


WHOLE = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ADDED = P.Encoder(
    public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, P.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", "<", " ", "  ", "\n", "a", "word", "é", "'s", "12", " b c "]), max_size=15))
def test_added_tokens_have_their_own_id(parts):
    text = "".join(parts)
    assert np.frombuffer(ADDED(text), dtype="<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_pieces_of_documents_with_added_tokens(spark):
    texts = ["end <|endoftext|> next", "<|endoftext|>", "a  <|endoftext|><|endoftext|>\n b", "none of <|it|>"]
    rows = P.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for doc_id, text in enumerate(texts):
        ids, at, want = np.array(WHOLE.encode(text, add_special_tokens=False).ids + [0], dtype="<u4"), 0, set()
        for n in P.piece_lengths(len(ids), 1024):
            want.add((at, n, zlib.crc32(ids[at:at + n].tobytes()), len(ids)))
            at += n
        assert {(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == doc_id} == want

"""Classes by block naming against a plain dictionary of texts."""

import random
from collections import defaultdict

import pytest

from phonolake.llm import exact_dedup as E


def plain(rows):
    groups = defaultdict(list)
    fold = str.maketrans(E.UPPER, E.LOWER)
    for doc_id, text in rows:
        groups[(text or "").translate(fold)].append(doc_id)
    key = lambda x: (x is not None, x)
    return sorted((str(d), str(max(ids, key=key)), len(ids)) for ids in groups.values() for d in ids), len(groups)


@pytest.mark.parametrize("block", [4, 1024])
def test_edge_cases(documents, block):
    got = E.exact_groups(documents, block).select("row.doc_id", "row.text", "keep_id", "group_size", "kept").collect()
    want, groups = plain([(r.doc_id, r.text) for r in got])
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == groups and len(got) == documents.count()


def test_blocks_that_agree_in_part(spark):
    """Same length and first block, different middle or end; odd numbers of blocks; many copies of one text."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(300)) for _ in range(3)]
    texts += [texts[0][:150] + "c" + texts[0][151:], texts[0][:299] + "c", texts[0][:296], "C" * 260, "c" * 260, "c" * 261]
    rows = [(i, texts[i % len(texts)] if i < 60 else texts[0]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = E.exact_groups(docs, 8).select("row.doc_id", "keep_id", "group_size", "kept").collect()
    want, groups = plain(rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == groups


def test_empty_table(nothing):
    assert E.exact_groups(nothing).count() == 0

"""Near words, forms and roots against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phonolake.llm import spelling as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:]


def brute(docs):
    words, out = counted(docs), {}
    for w, n in words.items():
        near = sorted((-m, v) for v, m in words.items() if one_apart(w, v))
        form = near[0][1] if near and -near[0][0] >= 5 * n else None
        out[w] = [form, n, len(near), words[form] if form else None]
    def root(w):
        return w if out[w][0] is None else root(out[w][0])
    return {w: (f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


def check(spark, docs):
    table = spark.createDataFrame([(*d, "mine", "mine", 3) for d in docs], "doc_id long, text string, word string, form string, n int")
    rows = S.variants(table).collect()
    want = brute(docs)
    assert len(rows) == len(want)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == want
    return want


def edited(rng, word, alphabet):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1:], word[:i] + rng.choice(alphabet) + word[i:], word[:i] + rng.choice(alphabet) + word[i + 1:]])


@pytest.mark.parametrize("alphabet", ["ab", "abcdeé", "abcdefghijklmnopqrstuvwxyzÿ×"])
def test_against_all_pairs(spark, alphabet):
    rng = random.Random(len(alphabet))
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(6, 11))) for _ in range(60)]
    docs = []
    for w in base:
        forms = [w, edited(rng, w, alphabet)]
        forms.append(edited(rng, forms[1], alphabet))
        for k, f in enumerate(forms):
            docs += [(rng.randrange(10_000), f" {f.upper() if 'é' not in f and 'ÿ' not in f else f}, ")] * rng.choice([1, 5, 6, 30 // (k + 1), 160 // 6 ** k])
    want = check(spark, docs)
    assert any(v[0] for v in want.values()) and any(v[3] for v in want.values())


def test_real_vocabulary(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(300).collect()]
    docs += [(10_000 + i, t[:3] + t[4:]) for i, (_, t) in enumerate(docs) if t]
    check(spark, docs)


def test_edge_cases(spark):
    long = "alphabet " * 300_000 + "x" * 3_000_000 + " alphabet"
    docs = [(1, None), (2, ""), (3, " 12 !"), (None, "null id words " * 6), (4, "Repeated repeateD"), (4, "Repeated repeateD"), (4, "Repeated"), (5, long)]
    check(spark, docs)
    assert S.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="four code points"):
        S.variants(spark.createDataFrame([], "doc_id long, text string"), shortest=3)


def test_very_long_words(spark):
    word = "ab" * 8_000
    docs = [(i, w) for w, n in ((word, 30), (word[:9_001] + word[9_002:], 5), (word + "c", 6), ("x" * 20_000, 5)) for i in range(n)]
    check(spark, docs)


def test_stretches_end_between_runs(monkeypatch):
    monkeypatch.setattr(S, "STRETCH", 7)
    for text in ("", "abc", "one two three four", "a" * 30 + " b", "1234567 89 abc"):
        parts = list(S.stretches(text))
        assert "".join(parts) == text
        assert [w for p in parts for w in S.RUN.findall(p)] == S.RUN.findall(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(1, 50)), min_size=2, max_size=7, unique_by=lambda g: g[0]))
def test_pivots_are_the_cheapest_disjoint_pair(grams):
    pairs = [(i, j) for i in range(len(grams)) for j in range(i) if abs(grams[i][0] - grams[j][0]) >= 2]
    got = S.pivots([(0, p) for p, _ in grams], [w for _, w in grams])
    if not pairs:
        assert got is None
    else:
        assert abs(grams[got[0]][0] - grams[got[1]][0]) >= 2
        assert sum(grams[i][1] for i in got) == min(grams[i][1] + grams[j][1] for i, j in pairs)


def test_joins_broadcast_nothing(spark, tmp_path):
    path = str(tmp_path / "words")
    spark.createDataFrame([(a + "ight" + b, 5) for a in "lnrs" for b in "ly"], "word string, n long").write.parquet(path)
    docs = spark.createDataFrame([(i, "nightly lightly") for i in range(6)], "doc_id long, text string")
    for result in (S.near_pairs(spark.read.parquet(path)), S.variants(docs)):
        assert result.count()
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan

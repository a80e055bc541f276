"""Prefixes and masks against a loop over turns."""

from phonolake.llm import preference as P

SCHEMA = "pair_id long, side string, turn long, role string, text string, prompt string, part string"


def plain(turns):
    pairs = {}
    for pair, side, turn, role, text in turns:
        pairs.setdefault(pair, {"chosen": [], "rejected": []})[side].append((turn, role or "", text or ""))
    out = {}
    for pair, sides in pairs.items():
        a, b = ([(r, t) for _, r, t in sorted(sides[s], key=lambda x: (x[0] is None, x[0] or 0, x[1], x[2]))] for s in ("chosen", "rejected"))
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1

        def show(part):
            text, spans = "", []
            for role, words in part:
                start = len(text) + len(f"<|im_start|>{role}\n")
                text += f"<|im_start|>{role}\n{words}<|im_end|>\n"
                if role == "assistant":
                    spans.append(f"{start}:{len(text) - 1}")
            return text, ",".join(spans)

        out[pair] = (k, show(a[:k])[0], *show(a[k:]), *show(b[k:]))
    return out


def check(spark, turns):
    df = spark.createDataFrame([(*t, "clash", "clash") for t in turns], SCHEMA)
    got = {r.pair_id: (r.prompt_turns, r.prompt, r.chosen, r.chosen_mask, r.rejected, r.rejected_mask) for r in P.format_pairs(df).collect()}
    assert got == plain(turns)


def test_pairs(spark):
    u, s, a = "user", "system", "assistant"
    both = lambda p, *turns: [(p, side, i, r, t) for side in ("chosen", "rejected") for i, (r, t) in enumerate(turns)]
    check(spark, [
        *both(1, (s, "be kind"), (u, "hellö 🙂")), (1, "chosen", 2, a, "hi"), (1, "rejected", 2, a, "go away"), (1, "rejected", 3, u, "oh"),
        *both(2, (u, "same"), (a, "same")),
        (3, "chosen", 0, u, "x"), (3, "rejected", 0, u, "y"), (3, "chosen", 1, a, "z"), (3, "chosen", 2, a, ""),
        (4, "chosen", 0, None, None), (4, "rejected", 0, "", ""), (4, "rejected", None, a, "late"),
        (5, "rejected", 7, a, "only side"),
        (None, "chosen", 1, a, "tie"), (None, "chosen", 1, a, "tie"), (None, "rejected", 1, a, "tie"),
        *both(6, *[(u if i % 2 else a, "word " * 50) for i in range(200)]), (6, "chosen", 900, a, "end"),
    ])


def test_swapped_replies(spark):
    rows = [(0, 0, "user", "q0"), (0, 1, "assistant", "a0"), (1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "bye"),
            (2, 0, "user", "alone"), (2, 1, "assistant", "a2"), (None, 0, "user", "n")]
    got = P.format_pairs(P.swapped_replies(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    rows = {r.pair_id: r for r in got.collect()}
    assert rows[0].rejected == "<|im_start|>assistant\na1<|im_end|>\n" and rows[0].prompt_turns == 1
    assert rows[1].chosen_turns == rows[1].rejected_turns == 2
    assert rows[2].rejected == "" and rows[2].chosen_turns == 1
    assert rows[None].prompt_turns == 1


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert P.format_pairs(P.swapped_replies(empty)).count() == 0

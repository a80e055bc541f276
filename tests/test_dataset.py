"""Annotation parsing reads each long text once."""

from phonolake.operators import dataset as D


def rows(spark):
    return spark.createDataFrame(
        [(1, 1, " 0:01\t0:05  A  two  words \n"), (2, 1, "0:01 0:05 d"), (3, 1, "0:01 0:05"), (4, 1, "0:01 0:05 a kept\u2028"), (5, 1, "   ")],
        "song long, annotation_line int, raw string")


def test_text_is_all_behind_the_kind(spark):
    kept, counts = D.parse_annotations(rows(spark))
    assert {r.song: (r.kind, r.text) for r in kept.collect()} == {1: ("a", "two  words"), 2: ("d", ""), 4: ("a", "kept\u2028")}
    assert {r.reason: r.rows for r in counts.collect()} == {"positive": 2, "negative": 1, "malformed_excluded": 1}


def test_rules_do_not_match_the_text_again(spark):
    for frame in D.parse_annotations(rows(spark)):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract(raw") <= 1

"""Secret scans over an incremental blob ledger, with built-in functions only.

Every version of a text is a blob, named by the SHA-256 of its bytes. The ledger is a table of (blob, rule, version)
pairs already scanned and a table of what was found; a run scans only pairs the ledger lacks, so a text that occurs under
many ids, or came back unchanged, is read by the rules once, and a rule whose version rises is run again alone.
Findings are then joined back to every id that carries the blob.

Positions come from cutting the text at a rule's matches: with ``split`` giving what lies between the matches and
``regexp_extract_all`` the matches, running sums of their lengths are the offsets (code points, end exclusive).

Findings are written before the pairs are entered as scanned. A run that is lost in between, or two runs at once, scan a pair
twice and write the same spans twice; spans of a blob are read as a set, so nothing counts double and nothing is missed.

Edge cases: a null text is the empty blob; texts without a finding carry empty strings and zero counts; repeated rows
share their blob's findings; a very long text is one row to the regular expressions; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.session import scratch_path, stage


@dataclass(frozen=True)
class Rule:
    """A pattern, the length its match (or group ``group``) must have, and a cheap pattern every match contains."""

    kind: str
    version: int
    pattern: str
    least: int
    group: int = 0
    hint: str = ""


#: The three base rules, in the order that breaks ties, then the added ones. A run of one character class
#: is matched whole or not at all, so for "access" and "hex" the least length stands in the pattern itself; for "assign"
#: a match that is too short still uses up its text, and is dropped afterwards.
RULES = (
    Rule("assign", 1,
         r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2,
         r"""(?i:passw(?:or)?d|secret|token|api_?key)["']?\x20*[:=]"""),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 18, 0, "AKIA[A-Z0-9]{14}"),
    Rule("hex", 1, r"[0-9a-f]{16,}", 16, 0, "[0-9a-f]{16}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0, "PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30, 0, r"\.eyJ"),
)
BASE = ("assign", "access", "hex")

_SPANS = """
    filter(
      aggregate(
        zip_with(regexp_extract_all(t, p, 0), slice(split(t, p, -1), 1, size(regexp_extract_all(t, p, 0))),
                 (m, gap) -> struct(length(gap) AS gap, length(m) AS run, m AS m)),
        struct(0 AS at, CAST(array() AS ARRAY<STRUCT<start: INT, end: INT, size: INT>>) AS spans),
        (a, x) -> struct(a.at + x.gap + x.run AS at,
                         concat(a.spans, array(struct(a.at + x.gap AS start, a.at + x.gap + x.run AS end, {size} AS size))) AS spans)
      ).spans,
      s -> s.size >= {least})
"""


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def spans(text: str, rule: Rule):
    """Array of (kind, rank, start, end) of one rule in the column ``text``.

    ``regexp_extract_all`` and ``split`` walk the same leftmost, non-overlapping matches, so gap i ends where match i
    begins; a match too short stays in the walk and is dropped at the end.
    """
    size = f"length(regexp_extract(x.m, {_sql_text(rule.pattern)}, {rule.group}))" if rule.group else "x.run"
    found = _SPANS.format(size=size, least=rule.least).replace("(t,", f"({text},").replace(" p,", f" {_sql_text(rule.pattern)},")
    rank = [r.kind for r in RULES].index(rule.kind)
    kind = f"transform({found}, s -> struct(s.start AS start, {rank} AS rank, s.end AS end, '{rule.kind}' AS kind))"
    return F.expr(f"CASE WHEN {text} RLIKE {_sql_text(rule.hint or rule.pattern)} THEN {kind} END")


def pairs_of(rules) -> list[tuple[str, int]]:
    return [(r.kind, r.version) for r in rules]


@dataclass(frozen=True)
class Ledger:
    """Two tables in one folder: ``scanned(kind, version, blob)`` and ``found(kind, version, blob, start, rank, end)``."""

    spark: SparkSession
    path: str

    def read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as error:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        return self.read("scanned", "blob string, kind string, version int")

    def found(self) -> DataFrame:
        return self.read("found", "blob string, start int, rank int, `end` int, kind string, version int")


def blobs(docs: DataFrame) -> DataFrame:
    return docs.withColumn("t", F.coalesce(F.col("text"), F.lit(""))).withColumn("blob", F.sha2("t", 256))


def update(docs: DataFrame, paths: DataFrame, ledger: Ledger, rules=RULES) -> None:
    """Scan the blobs of docs(doc_id, text) that the ledger lacks. paths(doc_id, blob): the staged catalogue of docs."""
    spark = docs.sparkSession
    known = ledger.scanned().select("blob", "kind", "version")
    done = known.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("done"))  # at most one pair a rule
    # One id scans for all: the smallest. Ids of other copies are few and leave before any text moves.
    copies = stage(
        paths.groupBy("blob").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("reads")).filter("n > 1"), "copied-blobs")
    todo = blobs(docs.select("doc_id", "text")).alias("d").join(
        copies.alias("c"), (F.col("d.blob") == F.col("c.blob")) & ~F.col("d.doc_id").eqNullSafe(F.col("c.reads")), "left_anti")
    if not known.isEmpty():
        todo = todo.join(done, "blob", "left")
    else:
        todo = todo.withColumn("done", F.expr("CAST(NULL AS ARRAY<STRUCT<kind: STRING, version: INT>>)"))
    each = [
        F.when(F.coalesce(F.array_contains("done", F.expr(f"struct('{r.kind}' AS kind, {r.version} AS version)")), F.lit(False)), None)
        .otherwise(spans("t", r)) for r in rules
    ]
    empty = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, rank: INT, end: INT, kind: STRING>>)")
    hits = (
        todo.select("blob", F.flatten(F.array(*[F.coalesce(e, empty) for e in each])).alias("spans"))
        .filter(F.size("spans") > 0).dropDuplicates(["blob"])
        .select("blob", F.inline("spans"))
    )
    version = F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)])
    hits.withColumn("version", F.element_at(version, F.col("kind"))).select(
        "blob", "start", "rank", "end", "kind", "version").write.mode("append").parquet(f"{ledger.path}/found")
    wanted = F.array(*[F.expr(f"struct('{r.kind}' AS kind, {r.version} AS version)") for r in rules])
    fresh = paths.select("blob").distinct().select("blob", F.inline(wanted))
    fresh.join(known, ["blob", "kind", "version"], "left_anti").write.mode("append").parquet(f"{ledger.path}/scanned")


def scan(docs: DataFrame, ledger: Ledger | None = None, rules=RULES) -> DataFrame:
    """docs(doc_id, text) -> doc_id, blob, found (sorted spans of the current rule versions), one row per input row."""
    spark = docs.sparkSession
    ledger = ledger or Ledger(spark, scratch_path(spark, "secret-ledger"))
    paths = stage(blobs(docs.select("doc_id", "text")).select("doc_id", "blob"), "paths")
    update(docs, paths, ledger, rules)
    current = F.concat_ws(":", "kind", F.col("version").cast("string")).isin([f"{k}:{v}" for k, v in pairs_of(rules)])
    found = (
        ledger.found().filter(current).groupBy("blob")
        .agg(F.sort_array(F.collect_set(F.struct("start", "rank", "end", "kind"))).alias("found"))
    )
    return paths.join(found, "blob", "left")


def joined(kinds: str = "true") -> str:
    return (f"array_join(transform(filter(coalesce(found, array()), s -> {kinds}), "
            "s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def report(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans, per row of docs(doc_id, text)."""
    base = ", ".join(f"'{k}'" for k in BASE)
    count = lambda kind: F.expr(f"CAST(size(filter(coalesce(found, array()), s -> s.kind = '{kind}')) AS BIGINT)")
    return scan(docs, ledger).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.expr(joined(f"s.kind IN ({base})")), 256).alias("base_sha256"), F.expr(joined()).alias("spans"), "blob")

"""One query per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.llm import (
    collision_search,
    compression_classifier,
    exact_dedup,
    mixing,
    near_dup,
    ngram_trie,
    packing,
    preference,
    quality_trees,
    secrets,
    spelling,
    warc,
    whitening,
)
from phonolake.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_trees.quality_rules(docs, table(spark, sf_dir, "labels"))
    return out.select("row.doc_id", *[f"stats.{n}" for n in quality_trees.STAT_NAMES[:5]], "base_failed", "score", "kept")


def op2_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = near_dup.numbered(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return near_dup.near_groups(docs, width=4).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


def op4_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.swapped_replies(table(spark, sf_dir, "conversations")))


def op6_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_trie.train_and_score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.catalogue(spark, path)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = exact_dedup.exact_groups(docs)
    return out.select(
        "row.doc_id", "keep_id", "group_size", "kept",
        F.sha2(exact_dedup.normalised(F.col("row.text")), 256).alias("text_sha256"))


def op9_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("blob")


def op10_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return compression_classifier.train_and_score(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))


def op11_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision_search.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_quality_trees": op1_quality_trees,
    "op2_hamming_join": op2_hamming_join,
    "op3_entropy_mix": op3_entropy_mix,
    "op4_binary_packing": op4_binary_packing,
    "op5_preference": op5_preference,
    "op6_ngram_trie": op6_ngram_trie,
    "op7_warc": op7_warc,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_blob_ledger": op9_blob_ledger,
    "op10_compression": op10_compression,
    "op11_collision_search": op11_collision_search,
    "op12_whitening": op12_whitening,
    "op13_spelling": op13_spelling,
}


def _secrets_sql() -> str:
    """The spans by list functions: what lies before match i is the pieces up to i and the matches before it."""
    parts = []
    for rank, r in enumerate(secrets.RULES):
        p = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(f"""
SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i:
         {{'a': list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0),
           'run': length(m[i]), 'size': length(g[i])}})) AS s
FROM (SELECT doc_id, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {r.group}) AS g,
             string_split_regex(t, {p}) AS gaps FROM d) WHERE len(m) > 0""")
    least = " ".join(f"WHEN '{r.kind}' THEN {r.least}" for r in secrets.RULES)
    count = ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secrets.BASE)
    sums = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)
    base = ", ".join(f"'{k}'" for k in secrets.BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
k AS (SELECT doc_id, rank, kind, CAST(s.a AS BIGINT) AS a, CAST(s.a + s.run AS BIGINT) AS b FROM f WHERE s.size >= CASE kind {least} END),
j AS (SELECT doc_id, {sums},
        string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (kind IN ({base})) AS base,
        string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans FROM k GROUP BY doc_id)
SELECT d.doc_id, {count}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (doc_id)
"""


ORACLES = {
    "op8_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
""",
    "op9_blob_ledger": _secrets_sql(),
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 AND count(*) OVER w > 1 THEN max(page_id) OVER w END AS keep
      FROM q WINDOW w AS (PARTITION BY payload_digest, payload_bytes))
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keep IS NOT NULL AND page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM g
""",
    "op5_preference": """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS raw FROM conversations),
l AS (SELECT conv_id, max(turn) AS at, arg_max(text, turn) AS reply FROM t WHERE raw = 'assistant' GROUP BY conv_id),
b AS (SELECT t.*, own.at, other.reply, (raw = 'assistant' AND t.turn = own.at) IS TRUE AS swap
      FROM t LEFT JOIN l own ON own.conv_id = t.conv_id LEFT JOIN l other ON xor(other.conv_id, 1) = t.conv_id),
s AS (SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM b
      UNION ALL SELECT conv_id, 'rejected', turn, role, CASE WHEN swap THEN reply ELSE text END FROM b
      WHERE NOT swap OR reply IS NOT NULL),
p AS (SELECT pair_id, side, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS piece,
             length(role) + 13 AS head, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) AS place FROM s),
d AS (SELECT pair_id, min(place) FILTER (n < 2 OR a <> b) AS differ
      FROM (SELECT pair_id, place, count(*) AS n, min(piece) AS a, max(piece) AS b FROM p GROUP BY pair_id, place) GROUP BY pair_id),
c AS (SELECT p.*, CASE WHEN place >= differ THEN side WHEN side = 'chosen' THEN 'prompt' END AS part FROM p JOIN d USING (pair_id)),
m AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY pair_id, part ORDER BY place
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM c WHERE part IS NOT NULL)
SELECT pair_id, count(*) FILTER (part = 'prompt') AS prompt_turns,
       coalesce(string_agg(piece, '' ORDER BY place) FILTER (part = 'prompt'), '') AS prompt,
       coalesce(string_agg(piece, '' ORDER BY place) FILTER (part = 'chosen'), '') AS chosen,
       coalesce(string_agg(piece, '' ORDER BY place) FILTER (part = 'rejected'), '') AS rejected,
       coalesce(string_agg(CAST(CAST(begun + head AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(begun + length(piece) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY place)
                FILTER (part = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(CAST(CAST(begun + head AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(begun + length(piece) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY place)
                FILTER (part = 'rejected' AND role = 'assistant'), '') AS rejected_mask,
       count(*) FILTER (part = 'chosen') AS chosen_turns, count(*) FILTER (part = 'rejected') AS rejected_turns
FROM m GROUP BY pair_id
""",
}

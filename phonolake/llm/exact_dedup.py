"""Exact deduplication by deterministic block naming.

A normalised text is cut into blocks of ``block`` characters. All blocks are sorted and given integer names; then the
names of adjacent blocks are paired and the pairs named again, until one name is left per document. Names are given to
distinct values, never to hashes, so two documents share (number of blocks, last name) exactly when their texts are
equal. The largest id of a class stays.

A document that is alone with its length and first block already has an identity of its own and leaves before the
naming, so only texts that may have a copy are shuffled as blocks. That filter compares hashes of (length, first
block); a collision there only sends a document on to the naming.

Edge cases: a null text counts as empty and equals other empty texts; null ids rank below every number; of rows that
repeat both id and text one stays; an empty table gives an empty result. Only A-Z are folded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolake.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _named(values: DataFrame, label: str) -> DataFrame:
    """Distinct rows in sorted order with an integer each; written once, so a name never changes afterwards.

    The order is by hash, then by the values: its borders are sampled from eight bytes a row, not from whole blocks.
    """
    columns = values.columns
    ordered = values.distinct().withColumn("_at", F.xxhash64(*columns)).repartitionByRange("_at")
    ordered = ordered.sortWithinPartitions("_at", *columns).drop("_at")
    return stage(ordered.withColumn("name", F.monotonically_increasing_id()), label)


def name_documents(texts: DataFrame, block: int = 1024) -> DataFrame:
    """texts(rid, t) -> (rid, blocks, name): one collision-free identity per document.

    A name is unique within its level only; equal texts have equally many blocks and so end on the same level, which is
    why the identity is the pair (blocks, name).
    """
    cut = F.expr(f"CASE WHEN t = '' THEN array('') ELSE regexp_extract_all(t, '(?s).{{1,{block}}}', 0) END")
    cuts = texts.select("rid", cut.alias("cut"))
    pieces = cuts.select("rid", F.size("cut").cast("long").alias("blocks"), F.posexplode("cut").alias("pos", "piece"))
    names = _named(pieces.select("piece"), "block-names")
    level = stage(
        pieces.join(names, "piece").select("rid", "blocks", F.col("blocks").alias("width"), "pos", "name"), "block-level")
    widest = level.agg(F.max("width")).first()[0] or 0
    ready = [level.filter("width = 1")]
    while widest > 1:
        name = lambda side: F.max(F.when(F.col("pos") % 2 == side, F.col("name")))
        pairs = stage(
            level.filter("width > 1").groupBy("rid", "blocks", "width", F.shiftright("pos", 1).alias("at"))
            .agg(name(0).alias("a"), F.coalesce(name(1), F.lit(-1)).alias("b")),  # an odd last block pairs with nothing
            "block-pairs")
        names = _named(pairs.select("a", "b"), "pair-names")
        level = stage(
            pairs.join(names, ["a", "b"]).select(
                "rid", "blocks", F.ceil(F.col("width") / 2).alias("width"), F.col("at").alias("pos"), "name"),
            "block-level")
        ready.append(level.filter("width = 1"))
        widest = (widest + 1) // 2
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return out.select("rid", "blocks", "name")


def _first_name(text: Column, block: int) -> Column:
    return F.xxhash64(F.length(text), F.substring(text, 1, block))


def exact_groups(docs: DataFrame, block: int = 1024) -> DataFrame:
    """``row`` (input row as a struct), ``keep_id``, ``group_size`` and ``kept``, for every input row.

    Working columns bear names that no table has (``__``); the input's own are gathered into the struct at the end.
    """
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.withColumn("__key", _first_name(normalised(F.col("text")), 256))
    shared = stage(
        keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(F.col("__key").alias("__shared")), "shared-first-blocks")
    alone = keyed.join(shared, F.col("__key") == F.col("__shared"), "left_anti")
    maybe = keyed.join(shared, F.col("__key") == F.col("__shared"), "left_semi")
    maybe = stage(maybe.withColumn("__rid", F.monotonically_increasing_id()), "possible-copies")

    identity = name_documents(maybe.select(F.col("__rid").alias("rid"), normalised(F.col("text")).alias("t")), block)
    owned = stage(identity.join(maybe.select(F.col("__rid").alias("rid"), "doc_id"), "rid"), "identities")
    groups = stage(  # written, so that the join below shuffles both sides plainly and Spark can split a hot group
        owned.groupBy("blocks", "name").agg(
            F.max(F.struct("doc_id", "rid")).alias("keep"), F.count(F.lit(1)).alias("__size")), "groups")
    verdicts = owned.join(groups, ["blocks", "name"]).select(
        F.col("rid").alias("__rid"), F.col("keep.doc_id").alias("__keep"), "__size", (F.col("rid") == F.col("keep.rid")).alias("__kept"))
    copied = maybe.join(verdicts, "__rid").select(
        own, F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), F.col("__kept").alias("kept"))
    single = alone.select(
        own, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return single.unionByName(copied)

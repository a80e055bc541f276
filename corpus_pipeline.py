"""Corpus pipeline: quality rules, exact copies, near copies, mixing to targets, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns they were given; the last returns the packed pieces.

Edge cases are those of the operators: null and empty texts fail the quality rules; null ids are kept apart by row; columns
beyond those of documents pass through untouched; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.llm import exact_dedup, mixing, near_dup, packing, quality_trees
from phonolake.session import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that fail the base rule or score too low go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_trees.quality_rules(docs, labels).filter("kept").select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row of the largest id stays."""
    return exact_dedup.exact_groups(docs).filter("kept").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group, by shingles of five words, the document of the smallest id stays."""
    groups = near_dup.near_groups(near_dup.numbered(docs.select("doc_id", "text")), width=5)
    dropped = stage(groups.filter("rid <> first_rid").select("rid"), "near-copies")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("rid"))
    return rows.join(near_dup.if_small(dropped), "rid", "left_anti").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: rows taken twice appear twice, rows not taken go."""
    plan, chosen = mixing.solution(docs)
    taken = mixing.decided(docs, plan, chosen).filter("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of power-of-two length, one sequence each."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: The trees, the hashed draws and the tokenizer have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

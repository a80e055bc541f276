"""Queries against their SQL on tables that the small test tables do not resemble."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from phonolake.session import scratch_path

SF = "/root/testdata/sf0.001"


def against_sql(spark, name, **tables):
    """Rows of the query and of its SQL over sf0.001 with some tables replaced."""
    folder = scratch_path(spark, "tables").removeprefix("file:")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("lineitem", "pages", "conversations"):
        rows = tables.get(t, spark.read.parquet(f"{SF}/{t}.parquet"))
        rows.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = entry.queries()[name](spark, folder)
    want = con.execute(entry.oracle_sql()[name])
    order = [d[0] for d in want.description]
    return sorted(map(tuple, got.select(*order).collect())), sorted(want.fetchall())


def test_capital_views_keep_letters_without_a_capital(spark):
    talk = spark.read.parquet(f"{SF}/conversations.parquet")
    got, want = against_sql(spark, "set13_confirmed_proposals", conversations=talk.limit(0).unionByName(
        talk.limit(1).withColumn("text", F.lit("heitßkeit straße alright"))))
    assert got == want and len(got) == 1


def test_pages_that_share_their_url_keep_their_own_sidecar(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got, want = against_sql(spark, "src03_sidecars", pages=pages.withColumn("url", F.when(F.col("page_id") % 5 == 0, "http://a/b c").otherwise(F.col("url"))))
    assert got == want and len(want) > 10


def test_rolling_levels_classify_every_block(spark):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").filter("l_suppkey % 4 = 1")
    copies = int(130_000 / lines.count()) + 1
    many = lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(copies)))).withColumn(
        "l_orderkey", F.col("l_orderkey") + F.col("k") * 1_000_000).drop("k")
    got, want = against_sql(spark, "st06_rolling_levels", lineitem=many)
    assert got == want and sum(r[2] for r in want) > 1200

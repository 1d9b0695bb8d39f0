"""The driver tables seen as filings, facts, vectors and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.session import spread

FACT_YEARS = [f"FY{y}" for y in range(1992, 1999)]
FILING_YEARS = [f"FY{y}" for y in range(2021, 2026)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filed facts: nation = filer, priority = metric tag, order = one entry."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
            .select(F.col("n_name").alias("ticker"), F.lit("us-gaap").alias("taxonomy"),
                    F.col("o_orderpriority").alias("tag"), F.lit("USD").alias("unit"),
                    F.col("o_orderkey").alias("pos"), F.col("o_orderdate").cast("date").alias("end"),
                    F.col("o_totalprice").alias("val"),
                    F.when(F.col("o_orderstatus") == "F", "10-K").otherwise("10-Q").alias("form")))


FACTS_SQL = """facts AS (
  SELECT n_name AS ticker, o_orderpriority AS tag, 'FY' || CAST(year(o_orderdate) AS VARCHAR) AS fy,
         CAST(o_orderdate AS DATE) AS "end", o_orderkey AS pos, o_totalprice AS val,
         CASE WHEN o_orderstatus = 'F' THEN '10-K' ELSE '10-Q' END AS form
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

ANNUAL_SQL = FACTS_SQL + """, annual AS (
  SELECT ticker, tag, fy, coalesce(max(val) FILTER (form = '10-K'), max(val)) AS value
  FROM facts GROUP BY ALL)"""

YEARS_SQL = "years AS (SELECT unnest([" + ",".join(f"'{y}'" for y in FACT_YEARS) + "]) AS fy)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as yearly filings: source = filer, language = section anchor."""
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("source").alias("ticker"),
        F.concat(F.lit("FY"), (2021 + (F.col("doc_id") / 20).cast("bigint") % 5).cast("string")).alias("fiscal_year"),
        F.col("lang").alias("anchor"), "doc_id", "text", "n_chars")


DOCS_SQL = """docs AS (
  SELECT source AS ticker, 'FY' || CAST(2021 + (doc_id // 20) % 5 AS VARCHAR) AS fiscal_year,
         lang AS anchor, doc_id, text, n_chars FROM documents)"""

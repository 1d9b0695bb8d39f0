"""Reading the corpus, submission lists and metric facts from where a crawler landed them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline import schemas
from redline.functions.text import fiscal_year_label
from redline.operators.ranking import top_per_key

NAME = r"([^/_]+)_(FY\d{4})_10k"


def _named(df: DataFrame) -> DataFrame:
    name = F.col("_metadata.file_path")
    return df.withColumns({"ticker": F.regexp_extract(name, NAME, 1), "fiscal_year": F.regexp_extract(name, NAME, 2)})


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """``<TICKER>_<FY>_10k.html`` files joined with their ``_meta.json`` side files on (ticker, fiscal_year)."""
    pages = _named(spark.read.text(path, wholetext=True, pathGlobFilter="*_10k.html")).select(
        "ticker", "fiscal_year", F.col("value").alias("html"))
    meta = _named(spark.read.schema(schemas.FILING_META).json(path, multiLine=True, pathGlobFilter="*_10k_meta.json"))
    meta = meta.select("ticker", F.regexp_extract(F.col("_metadata.file_path"), NAME, 2).alias("fiscal_year"),
                       "period_end", "entity_name", "accession_no", "doc_filename", "url")
    return pages.join(meta, ["ticker", "fiscal_year"]).select(*[f.name for f in schemas.FILINGS.fields])


def read_facts(spark: SparkSession, path: str, tags: list[str] | None = None) -> DataFrame:
    """``<TICKER>_companyfacts.json`` flattened; tags are filtered before their units are exploded."""
    raw = spark.read.schema(schemas.FACTS_JSON).json(path, multiLine=True, pathGlobFilter="*_companyfacts.json")
    named = raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/_]+)_companyfacts", 1).alias("ticker"),
                       F.explode("facts").alias("taxonomy", "tags"))
    by_tag = named.select("ticker", "taxonomy", F.explode("tags").alias("tag", "t"))
    if tags is not None:
        by_tag = by_tag.filter(F.col("tag").isin(tags))
    units = by_tag.select("ticker", "taxonomy", "tag", F.explode("t.units").alias("unit", "entries"))
    rows = units.select("ticker", "taxonomy", "tag", "unit", F.posexplode("entries").alias("pos", "e"))
    return rows.select("ticker", "taxonomy", "tag", "unit", "pos", F.to_date("e.start").alias("start"),
                       F.to_date("e.end").alias("end"), "e.val", "e.form", "e.fp",
                       fiscal_year_label(F.col("e.end")).alias("fy"))


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SUBMISSIONS).json(path, multiLine=True)


def latest_n(submissions: DataFrame, n: int, form: str = "10-K", offset: int = 0) -> DataFrame:
    """The ``n`` most recent documents of a form per entity after skipping ``offset``; fewer if there are fewer."""
    r = "filings.recent."
    lists = F.arrays_zip(F.col(r + "form").alias("form"), F.col(r + "accessionNumber").alias("accession_no"),
                         F.col(r + "primaryDocument").alias("doc_filename"), F.col(r + "reportDate").alias("period_end"))
    flat = submissions.select("cik", F.col("name").alias("entity_name"), F.posexplode(lists).alias("recency", "d")).select(
        "cik", "entity_name", "recency", "d.*").filter(F.col("form") == form)
    return (top_per_key(flat, ["cik"], [F.col("recency")], n + offset).filter(F.col("rank") > offset)
            .select("cik", "entity_name", F.replace("accession_no", F.lit("-"), F.lit("")).alias("accession_no"),
                    "doc_filename", "period_end", fiscal_year_label(F.col("period_end")).alias("fiscal_year"),
                    (F.col("rank") - offset).alias("rank")))

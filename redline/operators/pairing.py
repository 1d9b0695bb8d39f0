"""Versions, sections and paragraphs: who is compared with whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from redline.functions.text import paragraphs
from redline.operators.ranking import prefix_sums

SECTION = ["ticker", "fiscal_year", "anchor"]
PAIR = ["ticker", "y_old", "y_new", "anchor"]


def year_pairs(docs: DataFrame) -> DataFrame:
    """Consecutive available years per ticker: (ticker, y_old, y_new)."""
    years = docs.select("ticker", "fiscal_year").distinct()
    return (years.withColumn("y_new", F.lead("fiscal_year").over(
                W.partitionBy("ticker").orderBy("fiscal_year")))
            .filter(F.col("y_new").isNotNull())
            .select("ticker", F.col("fiscal_year").alias("y_old"), "y_new"))


def with_known_anchor(df: DataFrame) -> DataFrame:
    return df.withColumn("anchor", F.coalesce("anchor", F.lit("unknown")))


def section_pairs(docs: DataFrame) -> DataFrame:
    """Sections of either year of a pair, with row counts per side and a status."""
    sections = with_known_anchor(docs).groupBy(*SECTION).agg(F.count(F.lit(1)).alias("n"))
    pairs = year_pairs(sections)
    old = pairs.join(sections, (sections.ticker == pairs.ticker) & (sections.fiscal_year == pairs.y_old)).select(
        pairs.ticker, "y_old", "y_new", "anchor", F.col("n").alias("n_old"))
    new = pairs.join(sections, (sections.ticker == pairs.ticker) & (sections.fiscal_year == pairs.y_new)).select(
        pairs.ticker, "y_old", "y_new", "anchor", F.col("n").alias("n_new"))
    both = old.join(new, PAIR, "full").na.fill(0, ["n_old", "n_new"])
    return both.withColumn("status", F.when(F.col("n_old") == 0, "added").when(F.col("n_new") == 0, "removed")
                           .otherwise("both"))


def paragraph_counts(docs: DataFrame, order: str = "chunk_no", sep: str = "\n\n") -> DataFrame:
    """(ticker, fiscal_year, anchor, order, chunk_key, n, copies): paragraphs per chunk, all that numbering needs to know.

    ``chunk_key`` tells chunks of one number apart (two filings of one year); ``copies`` counts equal ones.
    """
    return (with_known_anchor(docs).select(*SECTION, order, F.xxhash64("text").alias("chunk_key"),
                                           F.size(paragraphs(F.col("text"), sep)).cast("long").alias("n"))
            .groupBy(*SECTION, order, "chunk_key").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")))


def _numbered(docs: DataFrame, order: str, pieces, counts: DataFrame) -> DataFrame:
    """(section, order, idx, piece): ``pieces`` of every chunk, an array column, with their places in the section."""
    twice = F.raise_error(F.concat_ws(" ", F.lit("chunk stored twice:"), *SECTION, F.col(order).cast("string")))
    bases = prefix_sums(counts, SECTION, order, "n", ties=["chunk_key"]).select(
        *SECTION, order, "chunk_key", F.when(F.col("copies") > 1, twice).otherwise(F.col("base")).alias("base"))
    chunks = with_known_anchor(docs).select(*SECTION, order, pieces.alias("pieces"), F.xxhash64("text").alias("chunk_key"))
    return (chunks.join(bases, [*SECTION, order, "chunk_key"])
            .select(*SECTION, order, "base", F.posexplode("pieces").alias("pos", "piece"))
            .select(*SECTION, (F.col("base") + F.col("pos")).alias("idx"), order, "piece"))


def explode_paragraphs(docs: DataFrame, order: str = "chunk_no", sep: str = "\n\n",
                       counts: DataFrame | None = None) -> DataFrame:
    """Paragraphs of every section, numbered from 0 in section order.

    A section's text is its chunks in ``order``; since chunks are joined by blank lines, each chunk can be
    split on its own and only its paragraph *count* has to travel to number the section. Sections of any
    size stay spread over the cluster. Pass stored ``counts`` to save a pass over the texts. Chunks of one number are
    taken in the order of their text's hash; a chunk stored twice (same section, number and text) is an error.
    """
    counts = paragraph_counts(docs, order, sep) if counts is None else counts
    return _numbered(docs, order, paragraphs(F.col("text"), sep), counts).withColumnRenamed("piece", "text")


def paragraph_marks(docs: DataFrame, mark, order: str = "chunk_no", sep: str = "\n\n",
                    counts: DataFrame | None = None) -> DataFrame:
    """:func:`explode_paragraphs` with ``text_hash`` (``mark`` of the text) and ``chars`` in place of the text, which stays
    where it was read."""
    counts = paragraph_counts(docs, order, sep) if counts is None else counts
    marks = F.transform(paragraphs(F.col("text"), sep), lambda p: F.struct(mark(p).alias("text_hash"),
                                                                          F.length(p).alias("chars")))
    return _numbered(docs, order, marks, counts).select(*SECTION, "idx", order, "piece.*")


def pair_side_sizes(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ticker, y_old, y_new, anchor, n_old, n_new) from chunk-level counts."""
    sized = paired_sides(counts.groupBy(*SECTION).agg(F.sum("n").alias("n")), pairs)

    def n(side):
        return F.sum(F.when(F.col("side") == side, F.col("n")).otherwise(0)).alias(f"n_{side}")

    return sized.groupBy(*PAIR).agg(n("old"), n("new"))


def paired_sides(paras: DataFrame, pairs: DataFrame) -> DataFrame:
    """Paragraphs with every part they play: (ticker, y_old, y_new, side, ...), side = old or new.

    A middle year is the new side of one pair and the old side of the next; both rows come from one scan.
    """
    def role(year, side):
        return pairs.select("ticker", F.col(year).alias("fiscal_year"), "y_old", "y_new", F.lit(side).alias("side"))
    roles = role("y_old", "old").unionAll(role("y_new", "new"))
    return paras.join(roles, ["ticker", "fiscal_year"]).drop("fiscal_year")


def exact_matches(sides: DataFrame) -> DataFrame:
    """Distinct paragraph texts of a section pair that occur on both sides, with copies per side.

    Copies are counted map-side, so a text repeated a million times on either side stays one row.
    """
    def n(side):
        return F.count_if(F.col("side") == side).alias(f"n_{side}")

    def first(side):
        return F.min(F.when(F.col("side") == side, F.col("idx"))).alias(f"first_{side}_idx")

    return (sides.groupBy(*PAIR, "text").agg(n("old"), first("old"), n("new"), first("new"))
            .filter("n_old > 0 AND n_new > 0"))

"""Corpus pipeline: toxic documents out, repeated lines out (and documents that held nothing else), one document of each
near-duplicate group kept, sources mixed to target weights, the rest encoded.

``STAGES`` lists the stages; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.llm import line_dedup, mixing, near_dup, pieces, toxicity
from redline.llm.common import free_name, table
from redline.session import checkpoint_dir


#: Similarity, in hundredths, from which documents are near copies, and bands of minima that miss a pair exactly there with
#: probability (1 - 0.8^5)^38, 3 in ten million.
NEAR = 80
NEAR_BANDS, NEAR_ROWS = 38, 5


def has_word(text: str) -> Column:
    """Whether a text holds anything but blanks; false for null."""
    return F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def _with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the labels of the documents given."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line of at least 10 characters stays only in the first document that holds it; n_chars follows the text.

    A document that loses every line with a word goes: all it said stands elsewhere. Documents without words stay.
    """
    mark = free_name(docs, "_said")
    held = line_dedup.dedup_lines(docs.withColumn(mark, has_word("text")))
    emptied = F.col(mark) & ~has_word("text")
    return _with_length(held.filter(~emptied).select(*docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by word shingles of similarity 0.8 or more: the one of the smallest id."""
    return near_dup.keep_first(docs, NEAR, NEAR_BANDS, NEAR_ROWS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; small sources again, at most twice, in permuted blocks."""
    return mixing.mixed_rows(docs, mixing.Target(max_repeats=mixing.MAX_REPEATS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every reading of every document."""
    return pieces.token_digests(docs, pieces.read_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Toxicity rests on a trained model and tokens on a merge order, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}-{name}")
    return docs

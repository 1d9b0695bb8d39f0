"""Filings of many companies and years to change records, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline import dims
from redline.functions.text import paragraphs
from redline.operators import changes, matching
from redline.operators.pairing import (PAIR, SECTION, explode_paragraphs, pair_side_sizes, paired_sides, paragraph_counts,
                                       paragraph_marks, year_pairs)
from redline.operators.vector_store import VectorStore, text_hash
from redline.session import cut_lineage


def align_corpus(docs: DataFrame, order: str = "chunk_no", sep: str = "\n\n", model_key: str = "hashed",
                 floor: float = dims.SIMILARITY_FLOOR, pairs: DataFrame | None = None,
                 limits: dict | None = None, texts_out: bool = True, chars_out: bool = False,
                 alike: float | None = None) -> tuple[DataFrame, bool]:
    """Aligned paragraphs of every section pair, and whether every section fitted one task.

    They come with texts unless ``texts_out`` is off, with texts only where ``matching.align_sides`` says so by ``alike``,
    and with lengths if ``chars_out`` is on.

    The texts are read twice: once for paragraph counts, kept as a slim table that yields the year pairs,
    the size check and the numbering, and once for the alignment itself.
    """
    counts = cut_lineage(paragraph_counts(docs, order, sep))
    pairs = year_pairs(counts) if pairs is None else pairs
    large = matching.large_sections(pair_side_sizes(counts, pairs), **(limits or {}))
    paras = explode_paragraphs(docs, order, sep, counts)
    sides = paired_sides(paras.select("ticker", "fiscal_year", "anchor", "idx", "text"), pairs)
    return matching.align_sides(sides, floor, model_key=model_key, large=large, texts_out=texts_out, chars_out=chars_out,
                                alike=alike), large is None


def align_stored(docs: DataFrame, store: VectorStore, order: str = "chunk_no", sep: str = "\n\n",
                 floor: float = dims.SIMILARITY_FLOOR, pairs: DataFrame | None = None,
                 limits: dict | None = None) -> DataFrame:
    """Alignment rows with the lengths of both texts (``old_chars``, ``new_chars``; 0 for the absent side), without texts.

    The store is extended by the paragraphs it lacks; after that, paragraphs travel as hashes, lengths and vectors.
    """
    counts = cut_lineage(paragraph_counts(docs, order, sep))
    pairs = year_pairs(counts) if pairs is None else pairs
    large = matching.large_sections(pair_side_sizes(counts, pairs), **(limits or {}))
    store.extend(docs.select(F.explode(paragraphs(F.col("text"), sep)).alias("text")))
    marks = cut_lineage(paragraph_marks(docs, text_hash, order, sep, counts))
    sides = paired_sides(store.attach(marks).select(*SECTION, "idx", "vector"), pairs)
    aligned = matching.align_sides(sides, floor, large=large)
    chars = paired_sides(marks.select(*SECTION, "idx", "chars"), pairs)
    for side in ("old", "new"):
        own = chars.filter(F.col("side") == side).select(*PAIR, F.col("idx").alias(f"{side}_idx"),
                                                         F.col("chars").alias(f"{side}_chars"))
        aligned = aligned.join(own, [*PAIR, f"{side}_idx"], "left").na.fill(0, [f"{side}_chars"])
    return aligned


def diff_corpus(docs: DataFrame, order: str = "chunk_no", sep: str = "\n\n", model_key: str = "hashed",
                floor: float = dims.SIMILARITY_FLOOR, signal: DataFrame | None = None, pairs: DataFrame | None = None,
                with_words: bool = True, limits: dict | None = None, **thresholds) -> DataFrame:
    """Change records of every consecutive year pair of every ticker.

    ``docs`` is (ticker, fiscal_year, anchor, ``order``, text): section chunks or whole section texts.
    ``signal`` feeds the metric guard. ``pairs`` overrides which years are compared, ``limits`` what one
    task may hold (``max_cells``, ``max_side``).
    """
    if signal is None:
        aligned, bounded = align_corpus(docs, order, sep, model_key, floor, pairs, limits)
        if not bounded:
            aligned = cut_lineage(aligned)  # numbering very large sections reads the alignment twice
        return changes.diff_records(aligned, bounded_sections=bounded, with_words=with_words, **thresholds)
    # the metric guard reads its records twice, so the sections it looks at are aligned first and kept
    pairs = cut_lineage(year_pairs(docs)) if pairs is None else pairs
    guarded = F.coalesce(F.col("anchor").isin(dims.FINANCIAL_ANCHORS), F.lit(False))
    (financial, few), (others, bounded) = [
        align_corpus(docs.filter(part), order, sep, model_key, floor, pairs, limits) for part in (guarded, ~guarded)]
    records = changes.apply_metric_guard(cut_lineage(changes.classify(financial, **thresholds)), signal).unionByName(
        changes.classify(others if bounded else cut_lineage(others), **thresholds))
    records = changes.assign_change_ids(records, bounded_sections=bounded and few)
    return changes.word_delta(records) if with_words else records

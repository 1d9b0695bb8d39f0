"""From aligned paragraphs to classified, guarded, numbered change records."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline import dims
from redline.functions.numbers import extract_numbers, move_signal
from redline.operators.once import compute_once
from redline.operators.edit_script import common_parts
from redline.operators.pairing import PAIR
from redline.operators.ranking import BLOCK, rank_within

GUARD_TYPE = "struct<source:string,tag:string,old:double,new:double,pct:double>"
TOKEN = r"(?U)\w+|[^\w\s]+"


def classify_similarity(similarity: Column, unchanged: float = dims.UNCHANGED_AT, minor: float = dims.MINOR_AT,
                        major: float = dims.MAJOR_AT, below_major: str = "modified_minor") -> Column:
    """Class of a matched pair; what lies below ``major`` is ``below_major``."""
    return (F.when(similarity >= unchanged, "unchanged").when(similarity >= minor, "modified_minor")
            .when(similarity >= major, "modified_major").otherwise(below_major))


def guard_class(pct: Column) -> Column:
    """Class a material numeric move is raised to."""
    return F.when(pct >= dims.GUARD_MAJOR_PCT, "modified_major").otherwise("modified_minor")


def is_changed() -> Column:
    return F.col("classification") != "unchanged"


def classify(aligned: DataFrame, **thresholds) -> DataFrame:
    """``classification`` by similarity, then the text guard on pairs that look unchanged.

    The guard reads numbers only where the texts differ, and entirely inside the JVM.
    """
    by_similarity = F.when(F.col("kind") == "matched", classify_similarity(F.col("similarity"), **thresholds)).otherwise(
        F.col("kind"))
    suspect = (F.col("_class") == "unchanged") & (F.col("old_text") != F.col("new_text"))
    rows = aligned.withColumn("_class", by_similarity)
    rows = compute_once(rows, _old_numbers=F.when(suspect, extract_numbers(F.col("old_text"))),
                        _new_numbers=F.when(suspect, extract_numbers(F.col("new_text"))))
    rows = compute_once(rows, _move=move_signal(F.col("_old_numbers"), F.col("_new_numbers")))
    return (rows.withColumn("classification", F.when(F.col("_move").isNotNull(), guard_class(F.col("_move.pct")))
                            .otherwise(F.col("_class")))
            .withColumn("numeric_guard", F.when(F.col("_move").isNotNull(), F.struct(
                F.lit("text").alias("source"), F.lit(None).cast("string").alias("tag"), F.col("_move.old").alias("old"),
                F.col("_move.new").alias("new"), F.col("_move.pct").alias("pct"))).cast(GUARD_TYPE))
            .drop("_class", "_old_numbers", "_new_numbers", "_move"))


def apply_metric_guard(records: DataFrame, signal: DataFrame, keys: list[str] = PAIR,
                       anchors: list[str] | None = None) -> DataFrame:
    """Raise the most number-dense unchanged row of a financial section that shows no change at all.

    ``signal`` is (keys, tag, old, new, pct). One aggregated row per section decides; nothing is sorted.
    """
    anchors = dims.FINANCIAL_ANCHORS if anchors is None else anchors
    dense = F.min(F.struct((-F.size(extract_numbers(F.col("new_text")))).alias("neg_n"),
                           (-F.col("similarity")).alias("neg_s"), "old_idx", "new_idx"))
    quiet = (records.filter(F.col("anchor").isin(anchors)).groupBy(*keys)
             .agg(F.max(is_changed()).alias("any_change"), dense.alias("row"))
             .filter(~F.col("any_change") & (F.col("row.neg_n") < 0)))
    raised = quiet.join(signal, keys).select(
        *keys, "row.old_idx", "row.new_idx",
        F.struct(F.lit("xbrl").alias("source"), "tag", "old", "new", "pct").cast(GUARD_TYPE).alias("_guard"))
    return (records.join(raised, [*keys, "old_idx", "new_idx"], "left")
            .withColumn("classification", F.when(F.col("_guard").isNotNull(), guard_class(F.col("_guard.pct")))
                        .otherwise(F.col("classification")))
            .withColumn("numeric_guard", F.coalesce("_guard", "numeric_guard")).drop("_guard"))


def assign_change_ids(records: DataFrame, keys: list[str] = PAIR, bounded_sections: bool = False) -> DataFrame:
    """``change_seq`` over the changed rows of a section pair and the readable ``change_id``.

    Order: matched rows by similarity down, then added, then removed. ``bounded_sections`` says that the
    caller checked that every section fits one task; otherwise sections are numbered block by block.
    """
    kind = F.when(F.col("kind") == "matched", 0).when(F.col("kind") == "added", 1).otherwise(2)
    position = F.when(F.col("kind") == "added", F.col("new_idx")).otherwise(F.col("old_idx"))
    fall = F.when(F.col("kind") == "matched", -F.col("similarity")).otherwise(0.0)
    order = [kind, fall, position, F.col("new_idx")]
    levels = None if bounded_sections else [
        kind * 10_000 + F.floor(fall * 1000), fall, F.floor(position / BLOCK)]
    stem = F.concat_ws("-", "ticker", "anchor", "y_old", "y_new")
    # unchanged rows share one id and take no number: they are ranked apart and their rank is dropped,
    # which keeps the records in one pass
    ranked = rank_within(records.withColumn("_changed", is_changed()), [*keys, "_changed"], order, "change_seq", levels)
    seq = F.when(F.col("_changed"), F.col("change_seq"))
    return ranked.withColumn("change_seq", seq).withColumn("change_id", F.when(
        F.col("_changed"), F.concat(stem, F.lit("-"), _padded(F.col("change_seq")))).otherwise(stem)).drop("_changed")


def _padded(seq: Column) -> Column:
    """At least three digits, never truncated."""
    return F.format_string("%03d", seq)


def word_delta(records: DataFrame, out: str = "word_delta") -> DataFrame:
    """Append the tokens a change adds and removes: those outside one longest common subsequence, in text order.

    Tokens are cut, and one-sided and identical texts answered, by expressions; only modified pairs reach the token
    differ (``edit_script``, which also fixes the order of ties), all other rows pass it as nulls.
    """
    @F.pandas_udf("added array<string>, removed array<string>")
    def diff_tokens(old: pd.Series, new: pd.Series) -> pd.DataFrame:
        rows = []
        for o, n in zip(old, new):
            if o is None or n is None:
                rows.append((None, None))
                continue
            codes = pd.factorize(np.concatenate([o, n]))[0]
            keep_o, keep_n = common_parts(codes[:len(o)], codes[len(o):])
            rows.append((n[~keep_n], o[~keep_o]))
        return pd.DataFrame(rows, columns=["added", "removed"])

    empty = F.array().cast("array<string>")
    tokens = {c: F.regexp_extract_all(F.col(c), F.lit(TOKEN), F.lit(0)) for c in ("old_text", "new_text")}
    modified = (F.col("old_text") != "") & (F.col("new_text") != "") & (F.col("old_text") != F.col("new_text"))
    done = records.withColumn("_d", diff_tokens(*[F.when(modified, t) for t in tokens.values()]))
    same = F.col("old_text") == F.col("new_text")
    return done.withColumn(out, F.struct(
        F.when(modified, F.col("_d.added")).when(same, empty).otherwise(tokens["new_text"]).alias("added"),
        F.when(modified, F.col("_d.removed")).when(same, empty).otherwise(tokens["old_text"]).alias("removed"))).drop("_d")


def word_delta_multiset(pairs: DataFrame, keys: list[str], old: str = "old_text", new: str = "new_text",
                        token: str = TOKEN) -> DataFrame:
    """Order-free token difference: (keys, token, n_added, n_removed), only tokens whose count changed.

    ``keys`` identify a row; the difference is local to it, so nothing is shuffled. A null text has no tokens.
    """
    @F.pandas_udf("array<struct<token:string,net:bigint>>")
    def net_counts(old_tokens: pd.Series, new_tokens: pd.Series) -> pd.Series:
        empty = np.empty(0, object)
        sides = [[empty if t is None else t for t in side] for side in (old_tokens, new_tokens)]
        sizes = np.array([len(t) for side in sides for t in side])
        codes, names = pd.factorize(np.concatenate([*sides[0], *sides[1], empty]))
        row = np.repeat(np.tile(np.arange(len(old_tokens)), 2), sizes)
        sign = np.repeat([-1, 1], [sizes[:len(old_tokens)].sum(), sizes[len(old_tokens):].sum()])
        cell, at = np.unique(row * max(1, len(names)) + codes, return_inverse=True)
        net = np.bincount(at, weights=sign, minlength=len(cell)).astype(np.int64)
        out: list[list] = [[] for _ in range(len(old_tokens))]
        for c, n in zip(cell[net != 0].tolist(), net[net != 0].tolist()):
            out[c // len(names)].append({"token": names[c % len(names)], "net": n})
        return pd.Series(out)

    tokens = [F.regexp_extract_all(F.col(c), F.lit(token), F.lit(0)) for c in (old, new)]
    net = pairs.select(*keys, F.explode(net_counts(*tokens)).alias("t")).select(*keys, "t.token", "t.net")
    return net.select(*keys, "token", F.greatest("net", F.lit(0)).alias("n_added"),
                      F.greatest(-F.col("net"), F.lit(0)).alias("n_removed"))


def diff_records(aligned: DataFrame, signal: DataFrame | None = None, keys: list[str] = PAIR,
                 bounded_sections: bool = False, with_words: bool = True, **thresholds) -> DataFrame:
    """Full change records of aligned texts: class, guards, numbering and token changes."""
    records = classify(aligned, **thresholds)
    if signal is not None:
        records = apply_metric_guard(records, signal, keys)
    records = assign_change_ids(records, keys, bounded_sections)
    return word_delta(records) if with_words else records

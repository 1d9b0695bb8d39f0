"""Substring dedup by sliding sentence spans.

A text is cut into units: sentences (ended by ``.``, ``!`` or ``?`` before white space, by a line end, or before a
capitalised word behind a lower-case one, since a passage may be set into the middle of a sentence), and longer ones every
``UNIT_WORDS`` words. From each unit runs the shortest span of at least ``units`` units and ``min_words`` words, and to
each unit the shortest such span that ends with it, so that a repeated passage is covered to both its ends. All spans
are hashed (128 bits, over their words) and joined globally; the first is the one of the smallest document id and
position. Units covered by any span that is not the first of its hash are removed, with the white space behind them.

Rows of one id and one text are one row. Rows without id keep their text and hold no span. Null texts stay null and have
no units. Ids are compared as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.llm.common import bytes_of, column, free_name, map_batches, table
from redline.session import cut_lineage

UNITS = 3
MIN_WORDS = 24
UNIT_WORDS = 16
_WORDS = re.compile(r"\S+\s*")


def cut_units(text: str, longest: int = UNIT_WORDS) -> tuple[list[int], list[str], list[int]]:
    """Begin of every unit (and the end of the text), the words, and how many words lie before each unit."""
    starts, words, before = [], [], []
    open_unit, in_unit, last = True, 0, ""
    for m in _WORDS.finditer(text):
        piece = m.group()
        word = piece.rstrip()
        if not open_unit and (in_unit >= longest or (last.islower() and word[0].isupper() and last[-1].isalnum())):
            open_unit = True
        if open_unit:
            starts.append(m.start() if starts else 0)
            before.append(len(words))
            in_unit, open_unit = 0, False
        words.append(word)
        in_unit += 1
        last = word
        open_unit = word[-1] in ".!?" or "\n" in piece[len(word):]
    if not starts and text:
        starts, before = [0], [0]
    return [*starts, len(text)], words, [*before, len(words)]


def spans(before: list[int], units: int, min_words: int) -> set[tuple[int, int]]:
    """Unit ranges [i, j) that are shortest from i on or shortest up to j."""
    n, found = len(before) - 1, set()
    at = np.asarray(before)
    first = np.maximum(np.arange(n) + units, np.searchsorted(at, at[:-1] + min_words))
    found.update((i, int(j)) for i, j in enumerate(first) if j <= n)
    last = np.minimum(np.arange(1, n + 1) - units, np.searchsorted(at, at[1:] - min_words, "right") - 1)
    found.update((int(i), j + 1) for j, i in enumerate(last) if i >= 0)
    return found


def _occurrences(docs: DataFrame, units: int, min_words: int) -> DataFrame:
    """(_id, _mark, _hash, _from, _to) for every span; ``docs`` has _id, _mark and _text."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        own, hashes, begin, end = [], [], [], []
        for i, t in enumerate(bytes_of(column(b, "_text"))):
            _, words, before = cut_units(t.decode("utf-8", "replace"))
            raw = [w.encode("utf-8", "replace") for w in words]
            for x, y in sorted(spans(before, units, min_words)):
                own.append(i)
                hashes.append(xxhash.xxh3_128_digest(b" ".join(raw[before[x]:before[y]])))
                begin.append(x)
                end.append(y)
        at = pa.array(own, pa.int64())
        return pa.RecordBatch.from_arrays(
            [column(b, "_id").take(at), column(b, "_mark").take(at), pa.array(hashes, pa.binary()),
             pa.array(begin, pa.int32()), pa.array(end, pa.int32())], ["_id", "_mark", "_hash", "_from", "_to"])
    kind = dict(docs.dtypes)["_id"]
    return map_batches(docs, run, f"_id {kind}, _mark long, _hash binary, _from int, _to int")


def repeated_spans(docs: DataFrame, units: int = UNITS, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(_id, _mark, _spans): for every text with repeats, the unit ranges that are not the first of their kind."""
    text = F.col(text_col)
    slim = (docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_mark"), text.alias("_text"))
            .filter("_id is not null and _text is not null"))
    found = cut_lineage(_occurrences(slim, units, min_words))
    place = F.struct("_id", "_mark", "_from")
    repeats = cut_lineage(found.groupBy("_hash").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                          .filter("first <> last").select("_hash", "first"))
    return (found.join(repeats, "_hash").filter(place != F.col("first"))
            .groupBy("_id", "_mark").agg(F.collect_set(F.struct("_from", "_to")).alias("_spans")))


def dedup_spans(docs: DataFrame, units: int = UNITS, min_words: int = MIN_WORDS, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text rid of repeated spans, then n_sentences (before) and n_removed."""
    held = docs.drop("n_sentences", "n_removed")
    names = held.columns
    i, m, s = (free_name(held, c) for c in ("_id", "_mark", "_spans"))
    gone = repeated_spans(held, units, min_words, id_col, text_col)
    gone = gone.select(F.col("_id").alias(i), F.col("_mark").alias(m), F.col("_spans").alias(s))
    joined = held.join(gone, (held[id_col] == gone[i]) & (F.xxhash64(held[text_col]) == gone[m]), "left").drop(i, m)

    def strip(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, total, lost = [], [], []
        for t, ranges in zip(bytes_of(column(b, text_col)), column(b, s).to_pylist(), strict=True):
            text = None if t is None else t.decode("utf-8", "replace")
            starts, _, _ = cut_units(text or "")
            n, dropped = len(starts) - 1, 0
            if ranges:
                drop = np.zeros(n, bool)
                for r in ranges:
                    drop[r["_from"]:r["_to"]] = True
                dropped = int(drop.sum())
                text = "".join(text[starts[k]:starts[k + 1]] for k in range(n) if not drop[k])
            texts.append(text)
            total.append(n)
            lost.append(dropped)
        kind = column(b, text_col).type
        cols = [pa.array(texts, kind) if c == text_col else column(b, c) for c in names]
        return pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(lost, pa.int64())],
                                          [*names, "n_sentences", "n_removed"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields)
    return map_batches(joined, strip, f"{fields}, n_sentences long, n_removed long")


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text, its sentences and how many were removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_spans(docs).select("doc_id", "n_sentences", "n_removed", "text")

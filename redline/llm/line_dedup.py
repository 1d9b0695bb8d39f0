"""Line dedup with two Bloom filters, one of hashes seen once and one of hashes seen again.

1. Every task of a first pass feeds both filters with the keys of its documents' lines: a key already in the first goes
   into the second. Filters of different tasks meet segment by segment: what two tasks both hold has been seen again.
2. A second pass sends on only lines whose key the second filter knows (true repeats and few others), as a 128-bit hash
   and a document id. Grouping confirms which keys at least two documents hold, and finds the smallest such id.
3. Lines of confirmed keys leave every document but that one.

The filters have a fixed largest size (``max_filter_bytes`` each). With more keys than they hold, more lines are
suspected and shuffled as hashes; the result never changes. At most ``defaultParallelism`` pairs of filters are shuffled.

Rows of one doc_id are one document. A row without doc_id holds no key and keeps its lines. Null and empty texts are one
empty line. Keys are compared by 128-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.llm.common import bytes_of, column, free_name, map_batches, table
from redline.session import cut_lineage

MIN_CHARS = 10
SEGMENT = 1 << 13
BITS_PER_KEY = 16


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line stripped of ASCII white space and with A-Z lowered; None if shorter than ``min_chars`` code points."""
    k = line.strip().lower()
    if len(k) < min_chars or (len(k) < 4 * min_chars and len(k.decode("utf-8", "replace")) < min_chars):
        return None
    return k


def line_digests(text: bytes | None, min_chars: int) -> list[bytes | None]:
    """128-bit hash of the key of every line; None for lines without key."""
    return [None if k is None else xxhash.xxh3_128_digest(k)
            for k in (line_key(x, min_chars) for x in (text or b"").split(b"\n"))]


class TwoBlooms:
    """Blocked filters of 64-bit words, four bits a key, all in one word."""

    def __init__(self, words: int):
        self.words = words
        self.once, self.twice = np.zeros(words, np.uint64), np.zeros(words, np.uint64)

    def place(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.zeros(len(hashes), np.uint64)
        for shift in (0, 6, 12, 18):
            mask |= np.uint64(1) << ((hashes >> np.uint64(shift)) & np.uint64(63))
        return ((hashes >> np.uint64(24)) % np.uint64(self.words)).astype(np.int64), mask

    def add(self, hashes: np.ndarray) -> None:
        """Feed keys, each as often as documents hold it."""
        keys, times = np.unique(hashes, return_counts=True)
        at, mask = self.place(keys)
        again = (times > 1) | ((self.once[at] & mask) == mask)
        np.bitwise_or.at(self.twice, at[again], mask[again])
        np.bitwise_or.at(self.once, at, mask)

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        at, mask = self.place(hashes)
        return (self.twice[at] & mask) == mask


def _short(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint64)[::2]


def _build(docs: DataFrame, words: int, min_chars: int) -> np.ndarray:
    """The second filter over all documents; ``docs`` has _id and _text."""
    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = TwoBlooms(words)
        for b in batches:
            found: list[bytes] = []
            for t in bytes_of(column(b, "_text")):
                found.extend(set(line_digests(t, min_chars)) - {None})
                if len(found) > 100_000:
                    bloom.add(_short(found))
                    found = []
            if found:
                bloom.add(_short(found))
        for s in range(0, words, SEGMENT):
            once, twice = bloom.once[s:s + SEGMENT], bloom.twice[s:s + SEGMENT]
            if once.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int64()), pa.array([once.tobytes()], pa.binary()),
                     pa.array([twice.tobytes()], pa.binary())], ["segment", "once", "twice"])

    def meet(pieces: pa.Table) -> pa.Table:
        once = twice = None
        for o, t in zip(pieces["once"].to_pylist(), pieces["twice"].to_pylist(), strict=True):
            o, t = np.frombuffer(o, np.uint64), np.frombuffer(t, np.uint64)
            once, twice = (o, t) if once is None else (once | o, twice | t | (once & o))
        return pa.table({"segment": pieces["segment"][:1], "twice": pa.array([twice.tobytes()], pa.binary())})

    spark = docs.sparkSession
    parts = (docs.coalesce(spark.sparkContext.defaultParallelism)
             .mapInArrow(feed, "segment long, once binary, twice binary"))
    whole = np.zeros(words, np.uint64)
    for r in parts.groupBy("segment").applyInArrow(meet, "segment long, twice binary").toLocalIterator():
        piece = np.frombuffer(r["twice"], np.uint64)  # all pieces together are one filter of bounded size
        whole[r["segment"]:r["segment"] + len(piece)] = piece
    return whole


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text",
                   max_filter_bytes: int = 32 << 20) -> DataFrame:
    """(_id, _drop): for every document that loses lines, the hashes of the keys it loses. Not for null ids."""
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_id is not null")
    lines = slim.select(F.sum(F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1)).first()[0]
    bits = min(max(BITS_PER_KEY * int(lines or 0), 64 * SEGMENT), 8 * max_filter_bytes)
    words = 1 << max(0, (bits - 1) // 64).bit_length()
    twice = docs.sparkSession.sparkContext.broadcast(_build(slim, words, min_chars))

    def probe(b: pa.RecordBatch) -> pa.RecordBatch:
        bloom = TwoBlooms(words)
        bloom.twice = twice.value
        ids, owner, found = column(b, "_id"), [], []
        for i, t in enumerate(bytes_of(column(b, "_text"))):
            own = set(line_digests(t, min_chars)) - {None}
            owner.extend([i] * len(own))
            found.extend(own)
        hit = np.flatnonzero(bloom.suspects(_short(found))) if found else np.empty(0, int)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.array(owner, np.int64)[hit])),
                                           pa.array([found[i] for i in hit], pa.binary())], ["_id", "_key"])

    suspects = cut_lineage(map_batches(slim, probe, f"_id {dict(slim.dtypes)['_id']}, _key binary"))
    confirmed = cut_lineage(suspects.groupBy("_key").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last"))
                            .filter("_first < _last").select("_key", "_first"))
    return (suspects.join(confirmed, "_key").filter("_id <> _first")
            .groupBy("_id").agg(F.collect_set("_key").alias("_drop")))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text",
                max_filter_bytes: int = 32 << 20) -> DataFrame:
    """All columns of ``docs`` with the text rid of repeated lines, then n_lines (before) and n_dropped.

    A null text stays null and counts as one line. Columns of the same names are replaced.
    """
    held = docs.drop("n_lines", "n_dropped")
    id_name, drop_name = free_name(held, "_id"), free_name(held, "_drop")
    drops = (repeated_lines(held, min_chars, id_col, text_col, max_filter_bytes)
             .select(F.col("_id").alias(id_name), F.col("_drop").alias(drop_name)))
    joined = held.join(drops, held[id_col] == drops[id_name], "left").drop(id_name)
    names = held.columns

    def strip(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, total, gone = [], [], []
        for t, drop in zip(bytes_of(column(b, text_col)), column(b, drop_name).to_pylist(), strict=True):
            lines = (t or b"").split(b"\n")
            kept = lines
            if drop:
                lost = set(drop)
                kept = [x for x, k in zip(lines, line_digests(t, min_chars), strict=True) if k not in lost]
            texts.append(None if t is None else b"\n".join(kept).decode("utf-8", "replace"))
            total.append(len(lines))
            gone.append(len(lines) - len(kept))
        text_type = column(b, text_col).type
        cols = [pa.array(texts, text_type) if n == text_col else column(b, n) for n in names]
        return pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
                                          [*names, "n_lines", "n_dropped"])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields)
    return map_batches(joined, strip, f"{fields}, n_lines long, n_dropped long")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document before and after, and the hash of the text that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped",
                                    F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = r"""
with line as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos from documents),
keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from line),
repeats as (
  select k, min(doc_id) as first from keyed where length(k) >= 10 group by k having count(distinct doc_id) >= 2),
judged as (
  select keyed.*, first is not null and first <> doc_id as dropped from keyed left join repeats using (k))
select doc_id, cast(count(*) as bigint) as n_lines, cast(count(*) filter (where dropped) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from judged group by doc_id"""

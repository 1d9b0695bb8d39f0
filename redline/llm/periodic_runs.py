"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words with smallest period q, at least max(6, 4 q) words long, that no neighbouring word
extends with period q. Every word of a run stands in it four times at least. So a word that occurs less than four times
within its segment belongs to no run there and splits the segment; segments of fewer than six words go, the others are
counted anew, until nothing splits. What survives is scanned lag by lag: stretches where each word equals the word q places
on are the runs of period q. Lags above ``DENSE`` are scanned only where some window of suitable width, looked up at steps
of half its width, comes again at that distance, which holds inside every run; all others cannot give one.

Splitting and the small lags work on all documents of an Arrow batch at once. Nothing is shuffled and nothing spans
documents, so a lost task is simply run again. Time grows with the words (times their logarithm), and for long surviving
segments with the lags that the windows propose.

Null and empty texts have no words and no runs, and collapse to the empty text. Repeated rows and null ids are rows like
any other; no other column is read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.llm.common import bytes_of, column, map_batches, mix64, table

REPEATS = 4
MIN_WORDS = 6
DENSE = 16
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def surviving_segments(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, segment of each place) left when words too rare in their segment have split it, again and again.

    ``owner`` numbers the document of every place in ascending order; a segment lies in one document.
    """
    places, segment = np.arange(len(codes)), owner.astype(np.int64)
    width = int(codes.max()) + 1 if len(codes) else 1
    while len(places):
        _, back, times = np.unique(segment * width + codes[places], return_inverse=True, return_counts=True)
        keep = times[back] >= REPEATS
        kept, of = places[keep], segment[keep]
        if not len(kept):
            return kept, of
        breaks = (np.diff(kept) > 1) | (np.diff(of) != 0)
        of = np.concatenate([[0], np.cumsum(breaks)])
        long = np.bincount(of)[of] >= MIN_WORDS
        kept, of = kept[long], of[long]
        if len(kept) == len(places):
            return kept, of
        places, segment = kept, of
    return places, segment


def stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], equal.view(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def proposed_lags(x: np.ndarray) -> list[int]:
    """Every lag above ``DENSE`` at which a segment may hold a run, ascending.

    Let w be the power of two with w <= q < 2 w. A run of period q holds, for each place c in its first 4 q - q - 2 w + 1
    places (w and more), the window of 2 w words at c and again at c + q; one such c is a multiple of w.
    """
    n, out = len(x), []
    hashes, w = mix64(x.astype(np.uint64) + np.uint64(1)), 1
    while 4 * w <= n:
        hashes = mix64(hashes[:len(hashes) - w] * np.uint64(0x9E3779B97F4A7C15) + hashes[w:])  # windows of 2 w words
        if 2 * w > DENSE:
            lags = np.arange(max(w, DENSE + 1), min(2 * w - 1, n // REPEATS) + 1)
            seen = np.zeros(len(lags), bool)
            for c in range(0, len(hashes), w):
                ahead = hashes[c + lags[0]:c + lags[-1] + 1] if len(lags) else hashes[:0]
                seen[:len(ahead)] |= ahead == hashes[c]
            out += lags[seen].tolist()
        w *= 2
    return out


def is_primitive(x: np.ndarray, start: int, end: int, q: int) -> bool:
    """Whether the stretch of period ``q`` has no smaller period, which would divide q."""
    run = x[start:end]
    return not any(q % d == 0 and np.array_equal(run[d:2 * q], run[:2 * q - d]) for d in range(1, q // 2 + 1))


def find_in_codes(codes: np.ndarray, owner: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, in order of start, then period; starts count over all documents."""
    places, segment = surviving_segments(codes, owner)
    x, runs = codes[places], []

    def take(at: np.ndarray, base: int, q: int, starts: np.ndarray, lengths: np.ndarray) -> None:
        for s, n in zip(starts.tolist(), lengths.tolist(), strict=True):
            if n + q >= max(MIN_WORDS, REPEATS * q) and is_primitive(at, s, s + n + q, q):
                runs.append((int(places[base + s]), n + q, q))

    for q in range(1, min(DENSE, len(x) // REPEATS) + 1):
        take(x, 0, q, *stretches((x[q:] == x[:-q]) & (segment[q:] == segment[:-q])))
    sizes = np.bincount(segment) if len(segment) else np.empty(0, np.int64)
    ends = np.cumsum(sizes)
    for k in np.flatnonzero(sizes >= REPEATS * (DENSE + 1)).tolist():
        base = int(ends[k] - sizes[k])
        part = x[base:int(ends[k])]
        for q in proposed_lags(part):
            take(part, base, q, *stretches(part[q:] == part[:-q]))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def runs_of_texts(words: list[list[bytes]]) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """Per text, given as words: its runs, and the words outside all repetitions joined by one blank.

    A word is a repetition if a run contains it behind the run's first period.
    """
    ids = defaultdict(count().__next__)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.fromiter((ids[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
    first = np.concatenate([[0], np.cumsum(sizes)])
    per: list[list] = [[] for _ in words]
    for start, length, period in find_in_codes(codes, np.repeat(np.arange(len(words)), sizes)):
        d = int(np.searchsorted(first, start, "right")) - 1
        per[d].append((start - int(first[d]), length, period))
    out = []
    for ws, runs in zip(words, per, strict=True):
        if runs:
            keep = np.ones(len(ws), bool)
            for start, length, period in runs:
                keep[start + period:start + length] = False
            ws = [ws[i] for i in np.flatnonzero(keep).tolist()]
        out.append((runs, b" ".join(ws)))
    return out


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """_id, n_words, runs (start, length, period), collapsed (the text without repetitions) of every row.

    ``rewrite`` may change the words of a text, given its id, before the search.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        words = [(t or b"").split() for t in bytes_of(column(b, "_text"))]
        if rewrite is not None:
            words = [rewrite(i, ws) for i, ws in zip(column(b, "_id").to_pylist(), words, strict=True)]
        found = runs_of_texts(words)
        flat = [r for runs, _ in found for r in runs]
        offsets = np.concatenate([[0], np.cumsum([len(runs) for runs, _ in found])]).astype(np.int32)
        parts = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
        runs = pa.ListArray.from_arrays(pa.array(offsets),
                                        pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
        return pa.RecordBatch.from_arrays(
            [column(b, "_id"), pa.array([len(ws) for ws in words], pa.int64()), runs,
             pa.array([c for _, c in found], pa.binary()).cast(pa.string())],
            ["_id", "n_words", "runs", "collapsed"])
    return map_batches(slim, run, f"_id {dict(slim.dtypes)['_id']}, n_words long, runs {RUNS}, collapsed string")


def plant_repeats(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, chosen by a checksum of the id, repeat periodically from some place on."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, with repeats planted in a tenth of them: the longest run and digests of all."""
    found = find_runs(table(spark, sf_dir, "documents"), rewrite=plant_repeats)
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("minus"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (found.withColumn("_best", best).select(
        F.col("_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.back")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.minus")).alias("period"),
        F.expr("(1000 * _best.length) div (-_best.minus)").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words"))


OP11_SQL = r"""
with recursive crc as (
  select list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k:
    case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as t),
text as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id as varchar), ''),
           lambda ch: cast(ord(ch) as bigint))), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) as h
  from documents, crc),
plan as (
  select *, len(ws) as n, h // 10 as g, case when h % 10 = 0 and len(ws) > 0 then (h // 10) % len(ws) end as a from text),
word as (
  select doc_id, n, i, case when a is null or i < a then ws[i + 1]
         else ws[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] end as w
  from (select *, unnest(range(n)) as i from plan)),
pair as (
  select x.doc_id, x.i, y.i - x.i as q from word x join word y
  on x.doc_id = y.doc_id and x.w = y.w and y.i > x.i and 4 * (y.i - x.i) <= x.n),
island as (select doc_id, q, i, i - row_number() over (partition by doc_id, q order by i) as k from pair),
stretch as (
  select doc_id, q as period, min(i) as start, count(*) + q as length from island group by doc_id, q, k
  having count(*) + q >= greatest(6, 4 * q)),
run as (
  select * from stretch s where not exists (
    select 1 from stretch o where o.doc_id = s.doc_id and o.period < s.period and o.start <= s.start
      and o.start + o.length >= s.start + s.length)),
gone as (
  select distinct doc_id, unnest(range(start + period, start + length)) as i from run),
kept as (
  select doc_id, string_agg(w, ' ' order by i) as s from word anti join gone using (doc_id, i) group by doc_id),
listed as (
  select doc_id, count(*) as n_runs,
         string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as s
  from run group by doc_id),
best as (
  select * from run
  qualify row_number() over (partition by doc_id order by length desc, start, period) = 1)
select p.doc_id, cast(coalesce(n_runs, 0) as bigint) as n_runs, cast(b.start as bigint) as start,
       cast(b.length as bigint) as length, cast(b.period as bigint) as period,
       cast((1000 * b.length) // b.period as bigint) as exponent_milli, sha256(coalesce(listed.s, '')) as runs_sha256,
       sha256(coalesce(kept.s, '')) as collapsed_sha256, cast(p.n as bigint) as n_words
from plan p left join best b using (doc_id) left join listed using (doc_id) left join kept using (doc_id)"""

"""Ranked lexical search over blocks of posting lists that bound their documents by coordinatewise maxima.

Queries come in blocks of bounded size, each against all documents:

1. One read of the documents keeps, per document, its length and its counts of the block's query terms (a written table).
   From it come N, L and the document frequencies, hence the weight of each term.
2. The documents are searched in three waves, dealt by hash: a 64th, seven 64ths, the rest. A query's k-th best score so far
   is its floor: no document below it can be among the k best of all. It saves work and decides nothing.
3. Every task packs its documents into shards of ``SHARD`` documents. In a shard, the posting list of a term is cut into
   geometric blocks: its documents are dealt to centres taken from the list by the inner product of random projections of
   their weighted term vectors, and large clusters are cut. A block stores the greatest impact of each term in it.
   A query opens its lists in order of their greatest contribution. A document first met in the list of the j-th term scores
   at most what the j-th and later terms add up to, so the search of a shard ends where the lists' maxima, and skips
   a block where the block's own maxima, sum to less than the floor. Everything else is scored exactly, in 64-bit
   integers. The floor rises with the k best scores of the task.
4. The k best of each task (those that reach the floor) meet in one top-k per query.

Results are exact. Blocks are made of the lists that some query opens, and dropped with the shard, so memory is bounded
by the shard. Terms of the queries, never of the corpus, go to the driver and the tasks.

Null and empty texts have no terms: such documents count nowhere and are never found, such queries find nothing. Equal
(id, text) rows of the queries are one query; other rows of one id are answered side by side. Every row of the documents
is a document of its own, also with a repeated or null id; null ids come last among equal scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from redline.llm.common import bytes_of, column, map_batches, table
from redline.session import cut_lineage, spread

TOP = 50
QUERY_BLOCK = 1024
BLOCK_TERMS = 200_000
#: Ends of the waves, in 64ths of the documents.
WAVES = (1, 8, 64)
SHARD = 8192
SHARD_ENTRIES = 2_000_000
BLOCK = 64
SKETCH = 16
CACHE = 10_000_000
#: ASCII letters in lower case and digits, and every byte above ASCII; all else separates.
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case."""
    return text.translate(_FOLD).split() if text else []


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every slice, one slice after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


class Shard:
    """Term vectors of some documents, with posting lists whose geometric blocks are made on demand."""

    def __init__(self, sizes: np.ndarray, cols: np.ndarray, impact: np.ndarray, weight: np.ndarray):
        self.sizes, self.cols, self.weight, self.impact = sizes, cols, weight, impact.astype(np.int32)
        self.value = impact * weight[cols]
        self.first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(cols, kind="stable")
        self.posting = owner[order]
        counts = np.bincount(cols, minlength=len(weight))
        self.begin = np.concatenate([[0], np.cumsum(counts)])
        self.peak = np.zeros(len(weight), np.int64)
        full = np.flatnonzero(counts)
        if len(full):
            self.peak[full] = np.maximum.reduceat(self.value[order], self.begin[full])
        self.blocks: dict[int, tuple] = {}
        self.cells = self.scored = self.opened = self.skipped = 0
        self.sketch: np.ndarray | None = None

    def project(self) -> np.ndarray:
        """Random projections of the weighted vectors, of unit length."""
        if self.sketch is None:
            axes = np.random.default_rng(7).standard_normal((len(self.weight), SKETCH)).astype(np.float32)
            out = np.zeros((len(self.sizes), SKETCH), np.float32)
            some = np.flatnonzero(self.sizes)
            value = self.value.astype(np.float32)
            for d in range(SKETCH if len(some) else 0):
                out[some, d] = np.add.reduceat(axes[self.cols, d] * value, self.first[some])
            self.sketch = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        return self.sketch

    def list_of(self, term: int) -> np.ndarray:
        return self.posting[self.begin[term]:self.begin[term + 1]]

    def blocks_of(self, term: int) -> tuple:
        """(documents by block, block starts, summary as terms, blocks and greatest impacts, in order of terms)."""
        if term not in self.blocks:
            docs, place = self.list_of(term), self.project()
            n = -(-len(docs) // BLOCK)
            centres = place[docs[(np.arange(n) * len(docs)) // n]]
            near = np.argmax(place[docs] @ centres.T, axis=1)
            order = np.lexsort((docs, near))
            docs, near = docs[order], near[order]
            begins = np.flatnonzero(np.concatenate([[True], np.diff(near) != 0]))
            inside = np.arange(len(docs)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(docs)]])))
            cut = (inside % (2 * BLOCK)) == 0
            starts = np.flatnonzero(cut)
            block = np.cumsum(cut) - 1
            at = ragged(self.first[docs], self.sizes[docs])
            most = np.zeros(len(self.weight) * len(starts), np.int32)
            np.maximum.at(most, self.cols[at] * len(starts) + np.repeat(block, self.sizes[docs]), self.impact[at])
            cell = np.flatnonzero(most)
            top = most[cell]
            if self.cells > CACHE:
                self.blocks.clear()
                self.cells = 0
            self.cells += len(cell)
            col = cell // len(starts)
            self.blocks[term] = docs, starts, col.astype(np.int32), (cell - col * len(starts)).astype(np.int32), top
        return self.blocks[term]

    def may_reach(self, term: int, later: np.ndarray, floor: int) -> np.ndarray:
        """Documents of a term's list in blocks whose maxima over the ``later`` terms reach the floor."""
        docs, starts, col, block, top = self.blocks_of(term)
        left, right = np.searchsorted(col, later), np.searchsorted(col, later, "right")
        at = ragged(left, right - left)
        bound = np.zeros(len(starts), np.int64)
        np.add.at(bound, block[at], top[at] * self.weight[col[at]])
        good = bound >= floor
        self.opened += int(good.sum())
        self.skipped += int((~good).sum())
        return docs[np.repeat(good, np.diff(np.concatenate([starts, [len(docs)]])))]

    def scores(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Exact scores of documents (each with a query term) for the marked terms."""
        sizes = self.sizes[docs]
        at = ragged(self.first[docs], sizes)
        self.scored += len(docs)
        return np.add.reduceat(self.value[at] * wanted[self.cols[at]], np.cumsum(sizes) - sizes)

    def search(self, query: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that reach the floor, the k best and equal ones at least; the floor is 1 or more."""
        peaks = self.peak[query]
        order = np.argsort(-peaks, kind="stable")
        query, peaks = query[order], peaks[order]
        rest = np.cumsum(peaks[::-1])[::-1]
        wanted, seen = np.zeros(len(self.weight), bool), np.zeros(len(self.sizes), bool)
        wanted[query] = True
        found, best = np.empty(0, np.int64), np.empty(0, np.int64)
        for j, term in enumerate(query.tolist()):
            if rest[j] < floor:
                break
            docs = self.list_of(term)
            if len(docs) > BLOCK:
                docs = self.may_reach(term, np.sort(query[j:]), floor)
            docs = docs[~seen[docs]]
            if not len(docs):
                continue
            seen[docs] = True
            value = self.scores(docs, wanted)
            good = value >= floor
            found, best = np.concatenate([found, docs[good]]), np.concatenate([best, value[good]])
            if len(best) >= k:
                floor = max(floor, int(np.partition(best, len(best) - k)[len(best) - k]))
                found, best = found[best >= floor], best[best >= floor]
        return found, best


def _vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(_id, _n, _cols, _tf): number of terms, and counts of the vocabulary's terms, of every document with a term."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, n, cols, counts, sizes = [], [], [], [], []
        for i, t in enumerate(bytes_of(column(b, "_text"))):
            words = terms(t)
            if words:
                known = [c for c in map(vocabulary.get, words) if c is not None]
                at, times = np.unique(np.array(known, np.int32), return_counts=True)
                rows.append(i)
                n.append(len(words))
                cols.append(at)
                counts.append(times)
                sizes.append(len(at))
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))

        def lists(parts: list[np.ndarray]) -> pa.Array:
            flat = np.concatenate(parts) if parts else np.empty(0)
            return pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))
        return pa.RecordBatch.from_arrays(
            [column(b, "_id").take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), lists(cols), lists(counts)],
            ["_id", "_n", "_cols", "_tf"])
    return map_batches(docs, run, f"_id {dict(docs.dtypes)['_id']}, _n long, _cols array<int>, _tf array<int>")


def _best_of_tasks(vectors: DataFrame, queries: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int,
                   floors: np.ndarray, k: int) -> DataFrame:
    """(_q, _id, _score): the k best of every task, of those that reach the floors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in queries]
        floor = floors.copy()

        def order(hit: tuple) -> tuple:
            return -hit[0], hit[1] is None, hit[1] if hit[1] is not None else 0

        def close(parts: list[pa.RecordBatch]) -> None:
            ids = [i for p in parts for i in column(p, "_id").to_pylist()]
            n = np.concatenate([column(p, "_n").to_numpy() for p in parts])
            cols, tf = (np.concatenate([column(p, c).flatten().to_numpy() for p in parts]) for c in ("_cols", "_tf"))
            sizes = np.concatenate([column(p, "_cols").value_lengths().to_numpy() for p in parts]).astype(np.int64)
            m = 50 + (50 * n * n_docs) // n_terms
            shard = Shard(sizes, cols.astype(np.int64), impacts(tf.astype(np.int64), np.repeat(m, sizes)), weight)
            for q, query in enumerate(queries):
                docs, scores = shard.search(query, k, int(floor[q]))
                if len(docs):
                    hits = sorted(best[q] + [(s, ids[d]) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)],
                                  key=order)
                    best[q] = hits[:k]
                    if len(best[q]) == k:
                        floor[q] = max(int(floor[q]), best[q][-1][0])

        parts, rows, entries, kind = [], 0, 0, None
        for b in batches:
            kind = column(b, "_id").type
            for at in range(0, b.num_rows, SHARD):
                part = b.slice(at, SHARD)
                size = len(column(part, "_cols").flatten())
                if parts and (rows + part.num_rows > SHARD or entries + size > SHARD_ENTRIES):
                    close(parts)
                    parts, rows, entries = [], 0, 0
                parts.append(part)
                rows, entries = rows + part.num_rows, entries + size
        if parts:
            close(parts)
        if kind is not None:
            flat = [(q, i, s) for q, hits in enumerate(best) for s, i in hits]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], kind),
                 pa.array([f[2] for f in flat], pa.int64())], ["_q", "_id", "_score"])
    return vectors.select("_id", "_n", "_cols", "_tf").mapInArrow(
        run, f"_q int, _id {dict(vectors.dtypes)['_id']}, _score long")


def _top(hits: DataFrame, k: int) -> DataFrame:
    w = W.partitionBy("_q").orderBy(F.col("_score").desc(), F.col("_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _search_block(docs: DataFrame, block: list[tuple], k: int) -> DataFrame:
    """(_q, rank, _id, _score) of one block of (query id, terms)."""
    spark = docs.sparkSession
    words = sorted({t for _, ts in block for t in ts})
    vocabulary = {t: c for c, t in enumerate(words)}
    vectors = cut_lineage(_vectors(docs, vocabulary))
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    df = np.zeros(len(words), np.int64)
    for c, n in vectors.select(F.explode("_cols").alias("c")).groupBy("c").count().toLocalIterator():
        df[c] = n
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    queries = [np.array([c for c in sorted(vocabulary[t] for t in ts) if df[c] and weight[c] > 0], np.int64)
               for _, ts in block]
    floors, hits, begin = np.ones(len(block), np.int64), None, 0
    for end in WAVES:
        wave = vectors.filter(F.pmod(F.xxhash64("_id", "_n"), F.lit(WAVES[-1])).between(begin, end - 1))
        tasks = max(vectors.rdd.getNumPartitions() * (end - begin) // WAVES[-1], spark.sparkContext.defaultParallelism)
        found = _best_of_tasks(spread(wave.coalesce(tasks)), queries, weight, n_docs, max(n_terms, 1), floors, k)
        hits = _top(found if hits is None else found.unionByName(hits.drop("rank")), k)
        if end < WAVES[-1]:
            hits, begin = cut_lineage(hits), end
            for q, score in hits.filter(F.col("rank") == k).select("_q", "_score").toLocalIterator():
                floors[q] = score
    return hits


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """(query_id, rank, id, score): for each query the ``k`` documents of highest score above 0.

    Queries are read block by block (at most ``QUERY_BLOCK`` of them, and about ``BLOCK_TERMS`` terms).
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = dict(queries.dtypes)[query_id]
    spark, results, block, held = docs.sparkSession, [], [], 0

    def flush() -> None:
        names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], f"_q int, _query {kind}")
        results.append(_search_block(slim, block, k).join(F.broadcast(names), "_q"))

    for i, text in queries.select(query_id, query_text).filter(F.col(query_text).isNotNull()).distinct().toLocalIterator():
        own = set(terms(text.encode()))
        if block and (len(block) == QUERY_BLOCK or held + len(own) > BLOCK_TERMS):
            flush()
            block, held = [], 0
        block.append((i, own))
        held += len(own)
    if block or not results:
        flush()
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.select(F.col("_query").alias(query_id), "rank", F.col("_id").alias(id_col), F.col("_score").alias("score"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
with word as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from documents),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
size as (select doc_id, count(*) as n from word group by doc_id),
whole as (select count(*) as nd, cast(sum(n) as bigint) as nt from size),
posting as (select doc_id, t, count(*) as tf from word group by doc_id, t),
weight as (
  select t, cast(floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1))) as bigint) as w
  from posting, whole group by t),
score as (
  select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // nt)))) as bigint)
    as score
  from asked join posting using (t) join weight using (t) join size using (doc_id), whole group by item_id, doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score
from score where score > 0 qualify rank <= 50"""

"""Approximate nearest neighbours by multi-index hashing.

Largest inner products become smallest angles by one more component that lifts every vector to the largest norm. Rotations
learned on a sample (iterative quantisation, several starts) turn vectors into binary codes; a code is cut into substrings
of 16 bits and every shard of the corpus indexes its codes by each of them. Two codes within Hamming radius r = m * a + b
over m substrings agree within a in one of the first b + 1 substrings or within a - 1 in one of the others (pigeonhole), so
probing those buckets finds every code within r. Codes found are checked in full and reranked by exact double-precision
inner products. The radius is the smallest that meets the recall target on the sample by brute force.

Probing goes through the non-empty buckets of a shard wherever they are fewer than the bucket numbers within reach.
Queries that find fewer than k codes are run again with the radius of the whole code, that is, exactly.

Shards and blocks of queries meet as packed rows, so no pair of vectors is a row; each task holds one shard and one block.
Every vector is indexed; the sample (``fit_rows`` rows chosen by a hash of the id) only shapes rotations and radius.
Null ids and vectors that are null, zero, of another than the most frequent length (the smaller one at a tie), or that hold
nulls or non-finite components take no part. Rows of one id are one row; of several vectors left for an id, the smallest
in the order of their components stands. A single row finds nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redline.llm.common import column, table
from redline.session import cut_lineage

SHARD_ROWS = 8192
QUERY_ROWS = 1024
PART = 16
K = 20


@dataclass
class Coder:
    """Rotations of lifted vectors, the largest norm, and the search radius."""

    mean: np.ndarray
    rotation: np.ndarray
    norm: float
    radius: int

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def codes(self, x: np.ndarray, lift: bool) -> np.ndarray:
        """Packed codes, one row of 16-bit words per vector."""
        extra = np.sqrt(np.maximum(self.norm**2 - (x**2).sum(axis=1), 0)) if lift else np.zeros(len(x))
        full = np.column_stack([x, extra])
        full = full / np.maximum(np.linalg.norm(full, axis=1, keepdims=True), 1e-300)
        bits = (full - self.mean) @ self.rotation > 0
        return np.packbits(bits, axis=1).view(np.uint16)


def learn_rotation(x: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Iterative quantisation: the rotation under which signs lose least."""
    rng = np.random.default_rng(seed)
    r = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
    for _ in range(rounds):
        u, _, v = np.linalg.svd(x.T @ np.sign(x @ r))
        r = u @ v
    return r


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the same order for every row."""
    return (vectors * query).sum(axis=1)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def fit(vectors: np.ndarray, norm: float, k: int, starts: int = 2, rounds: int = 25, recall: float = 0.96,
        probes: int = 256) -> Coder:
    """Rotations and radius from a sample of vectors; ``norm`` is the largest norm of the whole corpus."""
    lifted = np.column_stack([vectors, np.sqrt(np.maximum(norm**2 - (vectors**2).sum(axis=1), 0))])
    lifted /= np.linalg.norm(lifted, axis=1, keepdims=True)
    mean = np.append(np.zeros(vectors.shape[1]), lifted[:, -1].mean())
    rotation = np.concatenate([learn_rotation(lifted - mean, rounds, s) for s in range(starts)], axis=1)
    rotation = rotation[:, :max(PART, rotation.shape[1] // PART * PART)]
    if rotation.shape[1] % PART:
        rotation = np.tile(rotation, (1, PART))[:, :PART]
    coder = Coder(mean, rotation, norm, rotation.shape[1])
    codes, away = coder.codes(vectors, True), []
    ids = np.arange(len(vectors))
    for q in range(0, len(vectors), max(1, len(vectors) // probes)):
        s = exact_scores(vectors, vectors[q])
        s[q] = -np.inf
        near = best(ids, s, min(k, len(vectors) - 1))
        mine = coder.codes(vectors[q:q + 1], False)
        away.extend(np.bitwise_count(codes[near] ^ mine).sum(axis=1).tolist())
    if away:
        coder.radius = int(np.quantile(away, recall, method="higher"))
    return coder


class Shard:
    """Codes of one shard, indexed by each substring."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables = codes, []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            values, start = np.unique(codes[order, j], return_index=True)
            self.tables.append((order, values, np.append(start, len(order))))
        reach = np.bitwise_count(np.arange(1 << PART, dtype=np.uint32))
        self.masks = [np.flatnonzero(reach <= r).astype(np.uint16) for r in range(PART + 1)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code is within the radius."""
        m = self.codes.shape[1]
        a, b = divmod(min(radius, m * PART), m)
        seen = np.zeros(len(self.codes), bool)
        for j, (order, values, start) in enumerate(self.tables):
            r = a if j <= b else a - 1
            if r < 0:
                continue
            if len(self.masks[min(r, PART)]) < len(values):
                at = np.searchsorted(values, probe := self.masks[r] ^ code[j])
                at = at[(at < len(values)) & (values[np.minimum(at, len(values) - 1)] == probe)]
            else:
                at = np.flatnonzero(np.bitwise_count(values ^ code[j]) <= r)
            size = start[at + 1] - start[at]
            total = int(size.sum())
            if total:
                skip = np.repeat(start[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
                seen[order[np.arange(total) + skip]] = True
        found = np.flatnonzero(seen)
        away = np.bitwise_count(self.codes[found] ^ code).sum(axis=1)
        return found[away <= radius]


def _pack(df: DataFrame, group: str, lift: bool, shared, kind: str) -> DataFrame:
    """One row per group: ids, vectors and codes as bytes. A group has about SHARD_ROWS rows at most."""
    def pack(t: pa.Table) -> pa.Table:
        x = np.array(t["_vec"].to_pylist(), np.float64)
        ids = t["_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order].astype(np.int64)
        codes = shared.value.codes(x, lift)
        one = lambda v: pa.array([v.tobytes()], pa.binary())
        return pa.table({group: t[group][:1], "ids": one(ids), "vecs": one(x), "codes": one(codes)})
    return df.groupBy(group).applyInArrow(pack, f"{group} long, ids binary, vecs binary, codes binary")


def search(corpus: DataFrame, is_query, k: int = K, fit_rows: int = 4096, id_col: str = "vec_id",
           vector_col: str = "embedding", recall: float = 0.96) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that is a query, its k nearest other rows."""
    vec = F.col(vector_col).cast("array<double>")
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = (corpus.select(F.col(id_col).cast("long").alias("_id"), vec.alias("_vec"), is_query.alias("_query"))
            .filter(F.col("_id").isNotNull() & (F.size(vec) > 0) & fine & F.exists(vec, lambda v: v != 0)))
    rows = cut_lineage(rows)
    schema = "query_id long, rank int, vec_id long, score double"
    spark = corpus.sparkSession
    lengths = rows.groupBy(F.size("_vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths["n"]
    rows = cut_lineage(rows.filter(F.size("_vec") == dim).groupBy("_id").agg(
        F.min("_vec").alias("_vec"), F.bool_or("_query").alias("_query")))
    sample = rows.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows).select("_vec").toArrow()["_vec"].to_pylist()
    if len(sample) < 2:
        return spark.createDataFrame([], schema)
    total, norm = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("_vec", F.lit(0.0), lambda a, v: a + v * v)))).first()
    coder = fit(np.array(sample), float(norm), k, recall=recall)
    shared = spark.sparkContext.broadcast(coder)
    n_queries = rows.filter("_query").count()
    shards, blocks = -(-total // SHARD_ROWS), max(1, -(-n_queries // QUERY_ROWS))
    spot = F.xxhash64("_id", F.lit("shard"))
    packed = cut_lineage(_pack(rows.select("_id", "_vec", F.pmod(spot, F.lit(shards)).alias("shard")), "shard", True,
                               shared, "long"))
    asked = cut_lineage(_pack(rows.filter("_query").select("_id", "_vec", F.pmod(spot, F.lit(blocks)).alias("block")),
                              "block", False, shared, "long"))

    def meet(queries: DataFrame, n_blocks: int, exact: bool) -> DataFrame:
        left = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).withColumn(
            "block", F.col("block").cast("long"))
        right = queries.select("block", F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"),
                               F.col("codes").alias("q_codes"))
        pairs = left.join(right, "block").repartition(
            max(1, min(shards * n_blocks, 8 * spark.sparkContext.defaultParallelism)), "shard", "block")

        def run(batches):
            width = shared.value.bits
            for b in batches:
                for r in b.to_pylist():
                    ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vecs"]).reshape(-1, dim)
                    shard = Shard(np.frombuffer(r["codes"], np.uint16).reshape(len(ids), -1))
                    q_ids, q = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_vecs"]).reshape(-1, dim)
                    q_codes = np.frombuffer(r["q_codes"], np.uint16).reshape(len(q_ids), -1)
                    out = ([], [], [], [])
                    for i in range(len(q_ids)):
                        at = shard.within(q_codes[i], width if exact else shared.value.radius)
                        at = at[ids[at] != q_ids[i]]
                        score = exact_scores(x[at], q[i])
                        top = best(ids[at], score, k)
                        for to, v in zip(out, (np.full(len(top), q_ids[i]), ids[at][top], score[top],
                                               np.full(len(top), len(at))), strict=True):
                            to.append(v)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out],
                                                     ["query_id", "vec_id", "score", "found"])
        near = pairs.mapInArrow(run, "query_id long, vec_id long, score double, found long")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return (near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
                .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))

    first = cut_lineage(meet(asked, blocks, False))
    enough = first.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min(k, total - 1))
    short = rows.filter("_query").join(enough, F.col("_id") == F.col("query_id"), "left_anti")
    short = cut_lineage(short.select("_id", "_vec"))
    n_short = short.count()
    if n_short == 0:
        return first
    more = -(-n_short // QUERY_ROWS)
    again = cut_lineage(_pack(short.withColumn("block", F.pmod(spot, F.lit(more))), "block", False, shared, "long"))
    done = first.join(short.select(F.col("_id").alias("query_id")), "query_id", "left_anti")
    return done.unionByName(meet(again, more, True))


def op4_hashed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose vec_id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)

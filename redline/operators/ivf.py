"""Approximate nearest neighbours by an inverted file: coarse centres, one list of rows per centre, probed lists only.

Centres are fitted on a bounded sample (chosen by a hash of the id); every row is stored, exactly, in the list of its nearest
centre. A query meets the rows of the lists nearest to it; how many is read off the sample by brute force, as the least
number that finds the wanted share of true neighbours. Scores are exact inner products, and a query whose lists hold
fewer than k rows is answered by the exact scan. Vectors are expected to have unit length.

Lists and probes are equi-joined on the list's number. Lists are stored in parts of about ``PART_ROWS`` rows, and the queries
that probe a list come in blocks of about that many, so neither a crowded list nor a popular one lands in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline import dims
from redline.operators.ranking import top_per_key
from redline.operators.vectors import as_matrix, partial_topk, unit_rows, vector_topk
from redline.session import checkpoint_dir, cut_lineage

FIT_ROWS = 16_384
MAX_CENTRE_BYTES = 256 << 20
PART_ROWS = 4096
PROBES_HELD = 1 << 15  # rows of (list, query, vector) that a task makes at a time


@dataclass
class InvertedFile:
    """Centres, number of lists to probe, and the stored rows: list, part, id, vector."""

    path: str
    centres: np.ndarray
    probes: int
    rows: DataFrame
    parts: DataFrame  # list, n_parts


def fit_centres(sample: np.ndarray, n_lists: int, rounds: int = 12) -> np.ndarray:
    """Unit centres by alternating assignment and averaging; an empty one moves to the row farthest from its centre."""
    centres = sample[(np.arange(n_lists) * len(sample)) // n_lists].copy()
    for _ in range(rounds):
        sims = sample @ centres.T
        own = sims.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        far = np.argsort(sims[np.arange(len(sample)), own], kind="stable")
        empty = np.flatnonzero(np.bincount(own, minlength=n_lists) == 0)
        sums[empty] = sample[far[:len(empty)]]
        centres = unit_rows(sums)
    return centres


def fit_probes(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, asked: int = 512) -> int:
    """The least number of nearest lists that holds the wanted share of the k nearest rows of sampled queries."""
    own = (sample @ centres.T).argmax(axis=1)
    ranks = []
    for q in range(0, len(sample), max(1, len(sample) // asked)):
        sims = sample @ sample[q]
        sims[q] = -np.inf
        near = np.argsort(-sims, kind="stable")[:min(k, len(sample) - 1)]
        place = np.empty(len(centres), np.int64)
        place[np.argsort(-(centres @ sample[q]), kind="stable")] = np.arange(len(centres))
        ranks.append(place[own[near]])
    all_ranks = np.sort(np.concatenate(ranks))
    if not len(all_ranks):
        return len(centres)
    return int(all_ranks[min(len(all_ranks) - 1, int(np.ceil(recall * len(all_ranks))) - 1)]) + 1


def _valid(df: DataFrame, id_col: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    return df.select(F.col(id_col).alias("id"), v.alias("vector")).filter(
        F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)))


def build_ivf(corpus: DataFrame, id_col: str = "chunk_id", vector: str = "vector", k: int = dims.TOP_K_RETRIEVE,
              recall: float = 0.95, n_lists: int | None = None, fit_rows: int = FIT_ROWS,
              path: str | None = None) -> InvertedFile | None:
    """Fit, assign and store; None for a corpus without a vector. Null ids and null or incomplete vectors are left out.

    ``n_lists`` is the square root of the number of rows unless given, at most what fits ``MAX_CENTRE_BYTES`` and the sample.
    """
    spark = corpus.sparkSession
    rows = _valid(corpus, id_col, vector)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(fit_rows).select("vector").toArrow()["vector"]
    if not len(sample):
        return None
    sample = as_matrix(sample)
    total = rows.count()
    n_lists = min(n_lists or int(np.ceil(np.sqrt(total))), len(sample), max(1, MAX_CENTRE_BYTES // (8 * sample.shape[1])))
    centres = fit_centres(sample, n_lists)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches):
        for b in batches:
            own = (as_matrix(b["vector"]) @ shared.value.T).argmax(axis=1) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b["id"], b["vector"]], ["list", "id", "vector"])
    kind = rows.schema["id"].dataType.simpleString()
    listed = cut_lineage(rows.mapInArrow(assign, f"list int, id {kind}, vector array<double>"))
    parts = cut_lineage(listed.groupBy("list").count().select(
        "list", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("n_parts")))
    stored = (listed.join(F.broadcast(parts), "list")  # one row per list, at most n_lists
              .select("list", F.pmod(F.xxhash64("id"), F.col("n_parts")).cast("int").alias("part"), "id", "vector")
              .repartition("list", "part").sortWithinPartitions("list", "part"))
    path = path or f"{checkpoint_dir(spark)}/ivf-{spark.sparkContext.applicationId}-{id(stored):x}"
    stored.write.parquet(f"{path}/rows")
    parts.write.parquet(f"{path}/parts")
    probes = fit_probes(sample, centres, k, recall)
    spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centres)],
                          "list int, centre array<double>, probes int").write.parquet(f"{path}/centres")
    return read_ivf(spark, path)


def read_ivf(spark: SparkSession, path: str) -> InvertedFile:
    """A stored inverted file."""
    centres = spark.read.parquet(f"{path}/centres").orderBy("list").toArrow()
    return InvertedFile(path, as_matrix(centres["centre"]), centres["probes"][0].as_py(),
                        spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/parts"))


def search_ivf(queries: DataFrame, index: InvertedFile, k: int = dims.TOP_K_RETRIEVE, query_id: str = "query_id",
               vector: str = "vector", corpus_id: str = "chunk_id", probes: int | None = None) -> DataFrame:
    """(query_id, corpus_id, similarity, distance, rank): about the k nearest rows of each query, with exact similarities.

    Every query gets k rows, or all if the corpus has fewer. Null ids and incomplete vectors ask nothing.
    """
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast((index.centres, probes or index.probes))
    asked = _valid(queries, query_id, vector)
    q_kind = asked.schema["id"].dataType.simpleString()
    c_kind = index.rows.schema["id"].dataType.simpleString()

    def nearest_lists(batches):
        centres, n = shared.value
        step = max(1, PROBES_HELD // n)  # every query is repeated with its vector for each list it probes
        for b in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            if b.num_rows:
                near = np.argsort(-(as_matrix(b["vector"]) @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)
                at = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), b["id"].take(at), b["vector"].take(at)],
                                                 ["list", "q", "v"])
    probing = cut_lineage(asked.mapInArrow(nearest_lists, f"list int, q {q_kind}, v array<double>"))
    crowd = probing.groupBy("list").count().select("list", F.ceil(F.col("count") / PART_ROWS).cast("int").alias("n_blocks"))
    shape = F.broadcast(index.parts.join(crowd, "list"))  # one row per list
    left = (probing.join(shape, "list")
            .select("list", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"),
                    F.pmod(F.xxhash64("q"), F.col("n_blocks")).cast("int").alias("block"), "q", "v"))
    right = (index.rows.join(shape, "list")
             .select("list", "part", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), "id", "vector"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, asks = right["id"].to_numpy(), left["q"]
        found = list(partial_topk(np.arange(left.num_rows), as_matrix(left["v"]), ids, as_matrix(right["vector"]), k)
                     ) if left.num_rows and right.num_rows else []
        rows, near, values = (np.concatenate([p[j] for p in found]) if found else np.zeros(0, np.int64) for j in range(3))
        return pa.table({"q": asks.take(pa.array(rows.astype(np.int64))), "c": pa.array(near, right["id"].type),
                         "similarity": pa.array(values.astype(np.float64))})
    keys = ["list", "part", "block"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        meet, f"q {q_kind}, c {c_kind}, similarity double")
    best = cut_lineage(top_per_key(met, ["q"], [F.col("similarity").desc(), F.col("c")], k))
    full = best.groupBy("q").count().filter(F.col("count") >= k)
    short = asked.join(full, F.col("id") == F.col("q"), "left_anti")
    exact = vector_topk(short.withColumnRenamed("id", "q"), index.rows, k, "q", "id").withColumnRenamed("id", "c")
    done = best.join(full.select("q"), "q", "left_semi")
    return (done.select("q", "c", "similarity", "rank").unionByName(exact.select("q", "c", "similarity", "rank"))
            .select(F.col("q").alias(query_id), F.col("c").alias(corpus_id), "similarity",
                    (1 - F.col("similarity")).alias("distance"), "rank"))

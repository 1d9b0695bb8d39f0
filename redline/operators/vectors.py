"""Text vectors and exact nearest neighbours (approximate ones: ``operators.ivf``)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redline import dims
from redline.functions.text import doc_prefix
from redline.operators.ranking import top_per_key

Embedder = Callable[[list[str]], np.ndarray]
DIGITS = 9  # similarities are compared after rounding, so results do not depend on summation order


_MD5_SINES = np.floor(np.abs(np.sin(np.arange(1, 65))) * 2.0 ** 32).astype(np.uint32)
_MD5_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_MD5_TAKES = [lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16]


def md5_heads(tokens) -> np.ndarray:
    """First eight bytes of the MD5 of every string of an Arrow large_string array, as rows of bytes.

    Tokens that fill one block (55 bytes) are hashed some thousands at a time; ``hashlib`` does the longer ones.
    """
    starts = np.frombuffer(tokens.buffers()[1], np.int64)[tokens.offset:tokens.offset + len(tokens) + 1]
    data = np.frombuffer(tokens.buffers()[2] or b"", np.uint8)
    sizes = np.diff(starts)
    heads = np.empty((len(tokens), 8), np.uint8)
    by_size = np.argsort(sizes, kind="stable")
    n_short = int(np.searchsorted(sizes[by_size], 56))
    for at in range(0, n_short, 8192):
        some = by_size[at:min(at + 8192, n_short)]
        n, own = sizes[some], starts[some]
        blocks = np.zeros((len(some), 64), np.uint8)
        for k in range(int(n[-1])):
            reach = int(np.searchsorted(n, k, side="right"))  # from here on tokens have a byte k
            blocks[reach:, k] = data[own[reach:] + k]
        blocks[np.arange(len(some)), n] = 0x80
        words = np.ascontiguousarray(blocks.view("<u4").T)
        words[14] = 8 * n
        filled = {*range(int(n[-1]) // 4 + 1), 14}
        first = a, b, c, d = [np.full(len(some), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
        for i in range(64):
            kind = i // 16
            mix = (d ^ (b & (c ^ d)) if kind == 0 else c ^ (d & (b ^ c)) if kind == 1
                   else b ^ c ^ d if kind == 2 else c ^ (b | ~d))
            mix += a
            mix += _MD5_SINES[i]
            take = _MD5_TAKES[kind](i)
            if take in filled:
                mix += words[take]
            turn = _MD5_TURNS[kind][i % 4]
            a, d, c, b = d, c, b, b + ((mix << np.uint32(turn)) | (mix >> np.uint32(32 - turn)))
        heads[some] = np.stack([first[0] + a, first[1] + b], axis=1).astype("<u4").view(np.uint8)
    for i in by_size[n_short:].tolist():
        heads[i] = np.frombuffer(hashlib.md5(data[starts[i]:starts[i + 1]].tobytes()).digest()[:8], np.uint8)
    return heads


def hashed_embedder(dim: int = 128) -> Embedder:
    """Deterministic bag of blank-separated tokens, each hashed to one of ``dim`` slots, unit length.

    Takes a list of texts or an Arrow string array. Splitting, counting and hashing are vectorised.
    """
    def embed_texts(texts) -> np.ndarray:
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        lists = pc.split_pattern(texts, " ")
        tokens = lists.flatten().dictionary_encode()
        heads = md5_heads(tokens.dictionary)
        by_code = ((heads[:, 0] if dim <= 256 else heads.view(">u8")[:, 0]) % np.uint64(dim)).astype(np.int64)
        by_code[pc.equal(tokens.dictionary, "").to_numpy(zero_copy_only=False)] = dim  # no token: a slot that is left out
        slots = by_code[tokens.indices.to_numpy()] if len(tokens) else np.zeros(0, np.int64)
        slots += np.repeat(np.arange(len(texts)) * (dim + 1), pc.list_value_length(lists).to_numpy())
        counts = np.bincount(slots, minlength=len(texts) * (dim + 1)).reshape(len(texts), dim + 1)[:, :dim]
        return unit_rows(counts.astype("float64"))

    embed_texts.takes_arrow = True
    return embed_texts


def unit_rows(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def text_vectors(model: Embedder, texts, prefix: str = "") -> np.ndarray:
    """Unit vectors of an Arrow string array (null: empty); models that take such arrays get it without a detour by lists."""
    texts = texts.fill_null("")
    if prefix:
        texts = pc.binary_join_element_wise(pa.scalar(prefix, texts.type), texts, pa.scalar("", texts.type))
    given = texts if getattr(model, "takes_arrow", False) else texts.to_pylist()
    return unit_rows(np.asarray(model(given), dtype="float64"))


_EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hashed": hashed_embedder}


def register_embedder(model_key: str, factory: Callable[[], Embedder]) -> None:
    """Make a model available under a key; the factory runs once per worker process."""
    _EMBEDDERS[model_key] = factory


def embedder_factory(model_key: str) -> Callable[[], Embedder]:
    if model_key not in _EMBEDDERS:
        raise ValueError(f"Unknown model key: {model_key}")
    return _EMBEDDERS[model_key]


def embed(df: DataFrame, text: str = "text", model_key: str = "hashed", role: str = "passage",
          out: str = "vector") -> DataFrame:
    """Append the unit vector of a text column, Arrow batch by Arrow batch."""
    factory = embedder_factory(model_key)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = factory()
        for texts in batches:
            m = text_vectors(model, texts)
            ends = np.arange(len(m) + 1, dtype=np.int32) * (m.shape[1] if m.ndim == 2 else 0)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(m.ravel()))

    return df.withColumn(out, run(F.concat(doc_prefix(F.lit(model_key), role), F.col(text))))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, JVM-side."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, v: acc + v)


def as_matrix(column) -> np.ndarray:
    """Rows of an Arrow list column as one float64 matrix, without a Python loop."""
    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(n, -1) if n else np.zeros((0, 0))


def build_collection(chunks: DataFrame, model_key: str = "hashed") -> DataFrame:
    """Chunks with vectors and retrieval metadata (a missing anchor becomes ``none``)."""
    return (embed(chunks, "text", model_key).withColumn("model_key", F.lit(model_key))
            .withColumn("anchor", F.coalesce("anchor", F.lit("none"))))


def config_matrix(spark, strategies=None, models=None) -> DataFrame:
    """Every (strategy, model, rerank) combination with its readable name and short hash."""
    axes = [(s, m, r) for s in (strategies or dims.CHUNK_STRATEGIES) for m in (models or dims.EMBEDDING_MODELS)
            for r in ("off", "on")]
    return with_config_id(spark.createDataFrame(axes, "strategy string, model_key string, rerank string"))


def with_config_id(df: DataFrame) -> DataFrame:
    return (df.withColumn("config", F.concat("strategy", F.lit("__"), "model_key", F.lit("__rerank="), "rerank"))
            .withColumn("config_hash", F.substring(F.sha1(F.concat_ws("|", "strategy", "model_key", "rerank")), 1, 10)))


# ---- top-k ------------------------------------------------------------------------------------------

MAX_SHARED_QUERIES = 8192
MAX_SHARED_BYTES = 64 << 20  # of the query matrix, per executor
STRIP_CELLS = 1 << 21        # similarities a task holds at once (16 MB)


def best_rows(sims: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of one query: similarity down, id up."""
    if len(sims) > k:
        kth = np.partition(sims, len(sims) - k)[len(sims) - k]
        keep = np.flatnonzero(sims >= kth)
    else:
        keep = np.arange(len(sims))
    return keep[np.lexsort((ids[keep], -sims[keep]))][:k]


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = dims.TOP_K_RETRIEVE, query_id: str = "query_id",
                corpus_id: str = "chunk_id", vector: str = "vector",
                max_shared_rows: int = MAX_SHARED_QUERIES) -> DataFrame:
    """Exact top-k corpus rows per query: (query_id, corpus_id, similarity, distance, rank).

    The corpus is scanned in place and never shuffled: each task multiplies its batches with the query
    matrix, keeps k rows per query and only those meet in the final ranking. The query matrix is shared
    with the executors while it is small (rows and bytes are checked); beyond that, slabs of queries meet slabs of the corpus,
    both as large as a task may hold, since a row is copied once for each slab of the other side.
    """
    spark = corpus.sparkSession
    q = queries.select(F.col(query_id).alias("q"), F.col(vector).alias("v"))
    head = q.limit(max_shared_rows + 1).toArrow()  # bounded look at the queries
    q_type = q.schema["q"].dataType.simpleString()
    c_type = corpus.schema[corpus_id].dataType.simpleString()
    c = corpus.select(F.col(corpus_id).alias("c"), F.col(vector).alias("v"))
    schema = f"q {q_type}, c {c_type}, similarity double"
    if head.num_rows <= max_shared_rows and head.nbytes <= MAX_SHARED_BYTES:
        shared = spark.sparkContext.broadcast((head["q"].to_numpy(), as_matrix(head["v"])))
        partial = c.mapInArrow(_scan_kernel(shared, k), schema)
    else:
        partial = _slab_join(q, c, k, len(head["v"][0]) if head.num_rows and head["v"][0].is_valid else 1, schema)
    best = top_per_key(partial, ["q"], [F.col("similarity").desc(), F.col("c")], k)
    return best.select(F.col("q").alias(query_id), F.col("c").alias(corpus_id), "similarity",
                       (1 - F.col("similarity")).alias("distance"), "rank")


def partial_topk(q_ids, qm, c_ids, cm, k):
    """Per query (its id repeated, ids, similarities) of its k best rows; ``STRIP_CELLS`` similarities exist at a time."""
    step = max(1, STRIP_CELLS // max(1, len(c_ids)))
    for at in range(0, len(q_ids), step):
        sims = np.round(qm[at:at + step] @ cm.T, DIGITS)
        for i in range(len(sims)):
            top = best_rows(sims[i], c_ids, k)
            yield np.repeat(q_ids[at + i:at + i + 1], len(top)), c_ids[top], sims[i][top]


def _scan_kernel(shared, k):
    def run(batches):
        q_ids, qm = shared.value
        best = None
        for batch in batches:
            if batch.num_rows == 0 or len(q_ids) == 0:
                continue
            parts = list(partial_topk(q_ids, qm, batch["c"].to_numpy(zero_copy_only=False),
                                       as_matrix(batch["v"]), k))
            if best is not None:  # merge with what earlier batches of the task kept
                parts = [tuple(np.concatenate([a, b]) for a, b in zip(old, new)) for old, new in zip(best, parts)]
                tops = [best_rows(p[2], p[1], k) for p in parts]
                parts = [tuple(a[t] for a in p) for p, t in zip(parts, tops)]
            best = parts
        if best is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([p[i] for p in best])) for i in range(3)], ["q", "c", "similarity"])

    return run


SLAB_ROWS = 4096             # rows of the corpus that are worth a task
SLAB_CELLS = 1 << 22         # numbers a slab holds (32 MB): 32,768 vectors of length 128


def slab_counts(nq: int, nc: int, width: int, tasks: int) -> tuple[int, int]:
    """How many slabs of queries and of the corpus: as few as fit a task, the corpus in ``tasks`` where it has the rows."""
    rows = max(1, SLAB_CELLS // max(1, width))
    return max(1, -(-nq // rows)), max(1, -(-nc // rows), min(tasks, -(-nc // SLAB_ROWS)))


def _slab_join(q: DataFrame, c: DataFrame, k: int, width: int, schema: str) -> DataFrame:
    """Bounded slabs of queries meet bounded slabs of the corpus; k rows per query leave each meeting."""
    n_q, n_c = slab_counts(q.count(), c.count(), width, c.sparkSession.sparkContext.defaultParallelism)

    def met(name, other):
        return (F.pmod(F.xxhash64(name), F.lit({"q": n_q, "c": n_c}[name])).cast("int").alias(f"{name}s"),
                F.explode(F.sequence(F.lit(0), F.lit({"q": n_q, "c": n_c}[other] - 1))).alias(f"{other}s"))

    keys = ["qs", "cs"]
    left, right = q.select(*met("q", "c"), "q", "v"), c.select(*met("c", "q"), "c", "v")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = [(left["q"].to_numpy()[:0], right["c"].to_numpy()[:0], np.zeros(0))]
        parts = none + list(partial_topk(left["q"].to_numpy(), as_matrix(left["v"]), right["c"].to_numpy(),
                                          as_matrix(right["v"]), k) if left.num_rows and right.num_rows else [])
        return pa.table([pa.array(np.concatenate([p[j] for p in parts])) for j in range(3)], ["q", "c", "similarity"])

    # one meeting of two slabs is one group: an Arrow batch of the joined slabs would hold many. The work is in the numbers,
    # so the few groups are dealt over more partitions than there are, which do not coalesce
    left, right = (side.repartition(2 * n_q * n_c, *keys) for side in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def rerank(hits: DataFrame, score: Column, k: int = dims.TOP_K_FINAL, query_id: str = "query_id") -> DataFrame:
    """Re-order each query's hits by a second score, keep ``k``; equal scores keep their earlier order."""
    return top_per_key(hits.withColumn("first_rank", F.col("rank")).drop("rank").withColumn("score", score),
                       [query_id], [F.col("score").desc(), F.col("first_rank")], k)


def token_overlap(question: Column, text: Column) -> Column:
    """Default rerank score: share of the question's distinct lower-case words found in the text."""
    def words(c):
        return F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\W+"), lambda w: w != ""))
    return F.coalesce(F.size(F.array_intersect(words(question), words(text)))
                      / F.nullif(F.size(words(question)), F.lit(0)), F.lit(0.0))


def assemble_context(hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """The ranked hits of a query as one prompt context (at most k rows per query by construction)."""
    block = F.concat(F.lit("[chunk_id="), F.col("chunk_id").cast("string"), F.lit(" ticker="),
                     F.coalesce("ticker", F.lit("?")), F.lit(" anchor="), F.coalesce("anchor", F.lit("?")),
                     F.lit("]\n"), F.col("text"))
    return hits.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs")).select(
        query_id, F.array_join(F.transform("bs", lambda x: x["b"]), "\n\n-----\n\n").alias("context"))

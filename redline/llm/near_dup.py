"""MinHash near-dedup: many universal hash minima, banding, signature check, exact check, connected components.

1. One pass over whole texts turns each into a set of word shingles, a fingerprint of the set and one hash for each of
   ``BANDS`` bands of ``ROWS`` minima of universal hash functions (a * x + b over 64 bits). Documents with equal sets
   become one class, named by its smallest doc_id. Classes that share a band bucket with another are read once more
   for their sets and for signatures of ``WIDE`` minima (the low byte of each).
2. In every band bucket, each class meets the bucket's smallest class. Pairs whose sizes or signatures show that they do
   not reach the threshold (five standard deviations) go; the others are compared on full sets.
3. Components of these links; then, in buckets that still hold several components, every class meets every class of
   another component. This runs block against block in numpy on the minima, so that only pairs that may reach the
   threshold leave a task; they are compared on full sets too. Pairs within one component need no comparison.
4. Components of all links.

A pair at the threshold 0.85 shares no bucket with probability (1 - 0.85^6)^32, 3 in ten million, and fewer above it.
Shingles are 64-bit hashes of five words; fingerprints have 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.llm.common import WordHashes, bytes_of, column, map_batches, mix64, table, window_hashes
from redline.llm.components import components
from redline.session import cut_lineage

SHINGLE = 5
THRESHOLD = 85
BANDS = 32
ROWS = 6
WIDE = 1024
SHORT = 192
BLOCK = 256


def shingle_set(text: bytes | None, words: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; one for a shorter text, none without words."""
    parts = (text or b"").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    h = words.of(parts)
    if len(parts) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), len(parts))], np.uint64)
    return np.unique(window_hashes(h, width))


def hash_family(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of ``count`` universal hash functions over 64 bits."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2)


def minima(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Upper 32 bits of every function's smallest value."""
    a, b = family
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for s in range(0, len(shingles), 256):
        np.minimum(least, (shingles[s:s + 256, None] * a + b).min(axis=0), out=least)
    return least >> np.uint64(32)


def band_hashes(least: np.ndarray, bands: int, rows: int) -> np.ndarray:
    total = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(rows):
        total = mix64(total ^ (least.reshape(bands, rows)[:, r] + np.uint64(r + 1)))
    return total


def least_agreement(threshold: int, count: int) -> int:
    """Fewest agreeing minima, of ``count``, that a pair at the threshold shows but for five standard deviations."""
    j = threshold / 100
    return max(1, int(count * j - 5 * (count * j * (1 - j)) ** 0.5))


def _features(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    kind = dict(docs.dtypes)["_id"]
    family = hash_family(bands * rows)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        words, size, mark, keys = WordHashes(), [], [], []
        for t in bytes_of(column(b, "_text")):
            s = shingle_set(t, words)
            size.append(len(s))
            mark.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            keys.append(band_hashes(minima(s, family), bands, rows).tobytes() if len(s) else None)
        return pa.RecordBatch.from_arrays(
            [column(b, "_id"), pa.array(size, pa.int64()), pa.array(mark, pa.binary()), pa.array(keys, pa.binary())],
            ["_id", "_n", "_mark", "_keys"])
    return map_batches(docs, run, f"_id {kind}, _n long, _mark binary, _keys binary")


def _bucket_rows(classes: DataFrame) -> DataFrame:
    """(key, id) for every band of every class."""
    kind = dict(classes.dtypes)["id"]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        raw = bytes_of(column(b, "keys"))
        per = [len(x) // 8 for x in raw]
        own = pa.array(np.repeat(np.arange(len(raw)), per))
        keys = np.frombuffer(b"".join(raw), np.int64) if raw else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), column(b, "id").take(own)], ["key", "id"])
    return map_batches(classes.select("id", "keys"), run, f"key long, id {kind}")


def _sets(members: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, keys, set, sig) of every class that shares a bucket: its band hashes, full set and signature."""
    ids = members.select("id").distinct().join(classes.select("id", "mark", "keys"), "id")
    kind = dict(docs.dtypes)["_id"]
    family = hash_family(WIDE, seed=11)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        words = WordHashes()
        keep, sets, sigs = [], [], []
        for i, (t, m) in enumerate(zip(bytes_of(column(b, "_text")), column(b, "mark").to_pylist(), strict=True)):
            s = shingle_set(t, words)
            if len(s) and xxhash.xxh3_128_digest(s.tobytes()) == m:  # the row that speaks for the document
                keep.append(i)
                sets.append(s.tobytes())
                sigs.append(minima(s, family).astype(np.uint8).tobytes())
        return pa.RecordBatch.from_arrays(
            [column(b, "id").take(at := pa.array(keep, pa.int64())), column(b, "keys").take(at),
             pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())], ["id", "keys", "set", "sig"])
    found = docs.join(ids, docs["_id"] == ids["id"]).select("id", "mark", "keys", "_text")
    return map_batches(found, run, f"id {kind}, keys binary, set binary, sig binary").dropDuplicates(["id"])


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of classes whose full sets reach the threshold, as (u, v)."""
    kind = dict(sets.dtypes)["id"]
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b"))

    def compare(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for i, (x, y) in enumerate(zip(column(b, "sa").to_pylist(), column(b, "sb").to_pylist(), strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= threshold * (len(x) + len(y) - common):
                keep.append(i)
        at = pa.array(keep, pa.int64())
        return pa.RecordBatch.from_arrays([column(b, "a").take(at), column(b, "b").take(at)], ["u", "v"])
    return map_batches(both, compare, f"u {kind}, v {kind}")


def may_reach(x: np.ndarray, ys: np.ndarray, nx: int, ns: np.ndarray, threshold: int) -> np.ndarray:
    """Places in ``ys`` (signatures, with set sizes ``ns``) that may reach the threshold with ``x``."""
    nx, ns = np.int64(nx), np.asarray(ns).astype(np.int64)  # sizes come as 32-bit byte counts
    at = np.flatnonzero(100 * np.minimum(nx, ns) >= threshold * np.maximum(nx, ns))
    for width in (SHORT, WIDE):
        at = at[(ys[at, :width] == x[:width]).sum(axis=1) >= least_agreement(threshold, width)]
    return at


def _star_pairs(members: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Pairs of every class with the smallest class of its buckets that may reach the threshold."""
    pairs = members.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    size = F.length("set")
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("sig").alias("sa"), size.alias("na")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("sig").alias("sb"), size.alias("nb")), "b"))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        na, nb = column(b, "na").to_pylist(), column(b, "nb").to_numpy()
        keep = [i for i, (x, y) in enumerate(zip(bytes_of(column(b, "sa")), bytes_of(column(b, "sb")), strict=True))
                if len(may_reach(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)[None], na[i], nb[i:i + 1],
                                 threshold))]
        at = pa.array(keep, pa.int64())
        return pa.RecordBatch.from_arrays([column(b, "a").take(at), column(b, "b").take(at)], ["a", "b"])
    kind = dict(sets.dtypes)["id"]
    return map_batches(both, run, f"a {kind}, b {kind}")


def _residual_pairs(members: DataFrame, sets: DataFrame, parts: DataFrame, threshold: int) -> DataFrame:
    """Pairs of classes of one bucket but different components that may reach the threshold.

    A bucket of n classes is dealt into ceil(n / BLOCK) blocks by hash, and every pair of blocks is one small task
    group; no pair is emitted before its signatures were compared, and each only in the first bucket that both share.
    """
    kind = dict(sets.dtypes)["id"]
    tagged = cut_lineage(members.join(parts, members["id"] == parts["node"], "left")
                         .select("key", "id", "n", F.coalesce("component", "id").alias("part")))
    mixed = cut_lineage(tagged.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
                        .filter("lo < hi").select("key"))
    rows = (tagged.join(mixed, "key").join(sets.select("id", "keys", "sig", F.length("set").alias("size")), "id")
            .withColumn("k", F.ceil(F.col("n") / BLOCK).cast("int"))
            .withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
            .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id",
                    "part", "keys", "sig", "size"))

    def meet(group: pa.Table) -> pa.Table:
        own = group["own"].to_numpy()
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        ids, part, size = group["id"].to_numpy(), group["part"].to_numpy(), group["size"].to_numpy()
        sig = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint8).reshape(len(ids), -1)
        keys = np.frombuffer(b"".join(group["keys"].to_pylist()), np.int64).reshape(len(ids), -1)
        band = int(np.flatnonzero(keys[0] == group["key"][0].as_py())[0])
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        a, b = [], []
        for x in left:
            y = right[(part[right] != part[x]) & ((ids[right] > ids[x]) if i == j else True)]
            y = y[may_reach(sig[x], sig[y], size[x], size[y], threshold)]
            y = y[(keys[y] == keys[x]).argmax(axis=1) == band]
            a.extend([ids[x]] * len(y))
            b.extend(ids[y])
        a, b = np.array(a, ids.dtype), np.array(b, ids.dtype)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})
    return rows.groupBy("key", "i", "j").applyInArrow(meet, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per document.

    Documents whose shingle sets have 100 * intersection >= threshold * union are linked; component_id is the smallest
    id reachable. Null and empty texts and texts of white space alone have no shingles and are linked with nothing. Rows
    of one id are one document, for which the largest set speaks. Rows without id come back one by one, with null
    component and kept. Ids are integers.
    """
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = cut_lineage(_features(source, bands, rows))
    named = found.filter("_id is not null")
    own = named.groupBy("_id").agg(F.max(F.struct("_n", F.coalesce("_mark", F.lit(b"")).alias("_mark"))).alias("s"))
    own = cut_lineage(own.select("_id", F.col("s._n").alias("n"), F.nullif("s._mark", F.lit(b"")).alias("mark")))
    heads = cut_lineage(own.filter("mark is not null").groupBy("mark").agg(F.min("_id").alias("id")))
    classes = cut_lineage(heads.join(named, (heads["mark"] == named["_mark"]) & (heads["id"] == named["_id"]))
                          .select("id", "mark", F.col("_keys").alias("keys"))
                          .dropDuplicates(["id"]))
    flat = _bucket_rows(classes)
    shared = cut_lineage(flat.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).filter("n > 1"))
    members = cut_lineage(flat.join(shared, "key"))
    sets = cut_lineage(_sets(members, classes, source.filter("_id is not null")))
    star = cut_lineage(_star_pairs(members, sets, threshold))
    links = cut_lineage(_confirm(star, sets, threshold))
    parts = cut_lineage(components(links))
    rest = cut_lineage(_residual_pairs(members, sets, parts, threshold))
    if not rest.isEmpty():
        more = _confirm(rest.join(star, ["a", "b"], "left_anti"), sets, threshold)
        parts = components(links.unionByName(more))
    labels = cut_lineage(heads.join(parts, heads["id"] == parts["node"], "left")
                         .select("mark", F.coalesce("component", "id").alias("component_id")))
    out = (own.join(labels, "mark", "left")
           .select(F.col("_id").alias("doc_id"), F.col("n").alias("n_shingles"),
                   F.coalesce("component_id", "_id").alias("component_id")))
    nameless = found.filter("_id is null").select(F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"),
                                                  F.col("_id").alias("component_id"))
    return out.unionByName(nameless).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, threshold: int = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of near duplicates, with all columns of ``docs``.

    Repeated rows of a kept id become one. Rows without id all stay.
    """
    kept = near_duplicates(docs, threshold, bands, rows, id_col, text_col).filter("kept and doc_id is not null")
    kept = cut_lineage(kept.select(F.col("doc_id").alias(id_col)))
    named = docs.filter(F.col(id_col).isNotNull()).join(kept, id_col, "left_semi").dropDuplicates([id_col])
    return named.unionByName(docs.filter(F.col(id_col).isNull()))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and verdict of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
with recursive word as (
  select doc_id, w, row_number() over (partition by doc_id order by i) as i from (
    select doc_id, unnest(ws) as w, unnest(range(len(ws))) as i from (
      select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents))),
shingle as (
  select distinct doc_id, s from (
    select doc_id, w || ' ' || lead(w, 1) over o || ' ' || lead(w, 2) over o || ' ' || lead(w, 3) over o || ' ' ||
           lead(w, 4) over o as s from word window o as (partition by doc_id order by i)) where s is not null
  union all
  select doc_id, string_agg(w, ' ' order by i) from word group by doc_id having count(*) < 5),
size as (select doc_id, count(*) as n from shingle group by doc_id),
link as (
  select a.doc_id as a, b.doc_id as b from shingle a join shingle b on a.s = b.s and a.doc_id <> b.doc_id
  join size x on x.doc_id = a.doc_id join size y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
reach as (
  select doc_id as node, doc_id as to_id from documents
  union select reach.node, link.b from reach join link on link.a = reach.to_id),
part as (select node, min(to_id) as component_id from reach group by node)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join size using (doc_id) join part on node = d.doc_id"""

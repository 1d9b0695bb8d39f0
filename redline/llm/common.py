"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, through Spark's reader."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column) -> Column:
    """True for the quarter of the documents that no label or language may be learned from (null id: false)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def bytes_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``fn`` on every Arrow batch; batches are independent, so a lost task is simply run again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield fn(b)
    return df.mapInArrow(run, schema)


def map_tasks(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Like ``map_batches`` with a function that each task makes for itself, and drops with all it holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            yield fn(b)
    return df.mapInArrow(run, schema)


class WordHashes(dict):
    """64-bit hash of each word seen by this task; emptied when it grows past ``limit`` entries."""

    def __init__(self, limit: int = 1_000_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    odd = np.random.default_rng(width).integers(1, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total += hashes[i:i + n] * odd[i]
    return mix64(total)


def append_columns(batch: pa.RecordBatch, keep: list[str], extra: dict[str, pa.Array]) -> pa.RecordBatch:
    """The named columns of a batch followed by new ones."""
    return pa.RecordBatch.from_arrays([column(batch, k) for k in keep] + list(extra.values()), [*keep, *extra])


def code_points(column: pa.Array) -> np.ndarray:
    """Length of each text in code points, null as 0."""
    return pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores in front until no column of ``df`` has that name (in any letter case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base

"""Positions inside groups that may be far too large for one task.

``row_number() OVER (PARTITION BY key)`` sorts a whole key in one task. These helpers split every key
into blocks along its own order, count rows per block (map-side combined), add up the blocks, and sort
only inside a block. They are lazy, exact and independent of how the input is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from redline.session import cut_lineage

BLOCK = 1 << 16


def prefix_sums(df: DataFrame, keys: list[str], order: str, value: str, out: str = "base",
                block_size: int = 4096, ties: list[str] | None = None) -> DataFrame:
    """``df`` plus ``out``: the sum of ``value`` over earlier rows of the key.

    Earlier means a smaller integer ``order``, then smaller ``ties``; rows that agree on all of them follow one another.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block_size))
    totals = blocked.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    before = totals.select(*keys, "_block", (
        F.sum("_sum").over(W.partitionBy(*keys).orderBy("_block")) - F.col("_sum")).alias("_before"))
    inside = blocked.withColumn("_inside", F.sum(value).over(
        W.partitionBy(*keys, "_block").orderBy(order, *(ties or [])).rowsBetween(W.unboundedPreceding, W.currentRow))
        - F.col(value))
    return (inside.join(before, [*keys, "_block"])
            .withColumn(out, F.col("_before") + F.col("_inside")).drop("_block", "_before", "_inside"))


def rank_within(df: DataFrame, keys: list[str], order: list[Column], out: str,
                levels: list[Column] | None = None) -> DataFrame:
    """``df`` plus ``out``: the 0-based position of the row in its key.

    Without ``levels`` this is a plain window, for keys known to be bounded. ``levels`` are
    expressions that refine the order step by step (each constant on runs of rows); only rows
    that agree on all of them meet in one window partition.
    """
    if not levels:
        return df.withColumn(out, (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    names = [f"_level{i}" for i in range(len(levels))]
    leveled = df.withColumns(dict(zip(names, levels)))
    counts = leveled.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_n"))
    # cascade: rows before me at level i, among rows equal to me on the levels above
    offsets = counts
    for i in range(len(names)):
        if i + 1 < len(names):
            upper = counts.groupBy(*keys, *names[:i + 1]).agg(F.sum("_n").alias("_m"))
        else:
            upper = counts.withColumnRenamed("_n", "_m")
        w = W.partitionBy(*keys, *names[:i]).orderBy(names[i])
        upper = upper.select(*keys, *names[:i + 1], (F.sum("_m").over(w) - F.col("_m")).alias(f"_off{i}"))
        offsets = offsets.join(upper.hint("merge"), [*keys, *names[:i + 1]])
    total = sum((F.col(f"_off{i}") for i in range(1, len(names))), F.col("_off0"))
    offsets = offsets.select(*keys, *names, total.alias("_off"))
    w = W.partitionBy(*keys, *names).orderBy(*order)
    return (leveled.withColumn("_in", F.row_number().over(w) - 1)
            .join(offsets.hint("merge"), [*keys, *names])  # both sides lie by these keys already
            .withColumn(out, (F.col("_off") + F.col("_in")).cast("long"))
            .drop("_off", "_in", *names))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """First ``k`` rows per key, ranked from 1. ``k`` is small, so Spark prunes before the shuffle."""
    return (df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
            .filter(F.col(out) <= k))


def ordered_positions(df: DataFrame, order: list[str | Column], out: str = "position") -> DataFrame:
    """``df`` plus ``out``: the 0-based position of every row in one global order.

    Rows are dealt out by ranges of the order and sorted inside each range; the driver adds up one count per range, a number
    of partitions, so no task holds more than a range. Rows that agree on the whole order follow one another in any order.
    """
    spark = df.sparkSession
    at = "_" * max([1, *(len(c) - len(c.lstrip("_")) + 1 for c in df.columns)]) + "at"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(ranged.withColumn(at, F.monotonically_increasing_id()))
    part = F.shiftrightunsigned(at, 33)
    before, base = 0, []
    for p, n in sorted(placed.groupBy(part.alias("p")).count().collect()):
        base.append((p, before))
        before += n
    offsets = spark.createDataFrame(base, f"{at}p long, {at}base long")
    return (placed.join(F.broadcast(offsets), part == F.col(f"{at}p"))
            .withColumn(out, F.col(f"{at}base") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
            .drop(at, f"{at}p", f"{at}base"))

"""Keep expensive expressions from being evaluated again by every later filter or projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df.withColumns(columns)`` whose values the optimizer will not inline.

    A filter on a computed column is normally pushed below the projection, taking a copy of the whole
    expression with it. Passing the values through a one-element explode stops that; every row stays one row.
    """
    values = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("_once")
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, values).select(*kept, *[F.col(f"_once.{name}").alias(name) for name in columns])

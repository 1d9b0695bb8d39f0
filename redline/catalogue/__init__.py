"""Registered queries over the driver tables, each next to its SQL counterpart."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from redline.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: add a query, and its SQL where one exists."""
    def wrap(fn):
        @functools.wraps(fn)
        def query(spark, sf_dir):
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def load_all() -> None:
    """Import every module that registers queries."""
    for m in ("metrics", "changes", "retrieval", "corpus", "answers", "tuning", "stores", "guards"):
        importlib.import_module("redline.catalogue." + m)

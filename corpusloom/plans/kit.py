"""Registration of queries, and what they share."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators.common import shared_folder
from corpusloom.operators.store import Store, open_or_build
from corpusloom.plans.sqlkit import Q3
from corpusloom.sources.tables import corpus


def registry() -> tuple[dict, dict, Callable]:
    """Queries, SQL, and a decorator that enters a function under its own name."""
    queries: dict[str, Callable] = {}
    twins: dict[str, str] = {}

    def query(sql: str | None = None, name: str | None = None):
        def enter(f):
            queries[name or f.__name__] = f
            if sql:
                twins[name or f.__name__] = sql
            return f

        return enter

    return queries, twins, query


def one_query(spark: SparkSession, text: str = Q3) -> DataFrame:
    return spark.createDataFrame([(1, text)], "query_id int, query string")


_OPEN: dict[tuple[str, str], Store] = {}


def indexed(spark: SparkSession, sf_dir: str) -> Store:
    """The index over ``documents``, built or checked by the first query of a session that asks for it.

    It lies in the shared folder under a name from the input's; its fingerprint
    tells whether it is of the records that are there.
    """
    key = spark.sparkContext.applicationId, sf_dir.rstrip("/")
    if key not in _OPEN:
        name = hashlib.sha256(key[1].encode()).hexdigest()[:16]
        _OPEN[key] = open_or_build(corpus(spark, sf_dir), shared_folder(spark, f"index-{name}"))
    return _OPEN[key]

"""All queries of the engine by name, and their SQL twins.

A query takes ``(spark, sf_dir)`` and runs over whole tables.  Doubles are
rounded on both sides; arrays are joined to strings.
"""

from __future__ import annotations

from collections.abc import Callable

from corpusloom.plans import answers, crawling, lookups, scoring, scalars, streams

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

for _module in (lookups, scalars, scoring, answers, crawling, streams):
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)

"""Query registry: name -> (spark, sf_dir) -> DataFrame, and the DuckDB
oracle SQL for each.  Queries are grouped by module under ``plans``."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all():
    # Import side effect: each module registers its queries.
    from inkwell.plans import (evaluation, textq, curation, pairing,  # noqa: F401
                               criteria, vectorq, models, io, stream)
    return QUERIES, ORACLES

"""Where queries register: a key, the frames it reads, a function of those frames, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattline.sources.fixtures import frame, with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, frames: str, sql: str | None = None):
    """Register function(*frames) under key; sql reads the same frames by name."""
    names = frames.split()

    def add(function):
        QUERIES[key] = lambda spark, sf_dir: function(*(frame(spark, sf_dir, n) for n in names))
        if sql:
            ORACLES[key] = (with_(*names) if any(n not in _BASE for n in names) else "") + sql
        return function

    return add


from wattline.sources.fixtures import BASE as _BASE  # noqa: E402

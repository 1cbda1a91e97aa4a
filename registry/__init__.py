"""Registered queries: a Spark callable per operator and, where SQL can say it, the equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mediashelf.plans.library_views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register fn(t, spark) under `key`; t(name) reads a driver or library table of the given folder, t.sf_dir."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            t = lambda name: view(spark, sf_dir, name)
            t.sf_dir = sf_dir
            return fn(t, spark)

        run.__name__ = key
        run.__doc__ = fn.__doc__
        if key in QUERIES:
            raise ValueError(f"registered twice: {key}")
        QUERIES[key] = run
        if sql:
            body = sql.strip()
            if views:
                head = with_views(*views)
                if body.startswith("with recursive "):
                    body = "with recursive " + head[5:].rstrip() + ",\n" + body[15:]
                else:
                    body = head.rstrip() + ",\n" + body[5:] if body.startswith("with ") else head + body
            ORACLES[key] = body
        return fn

    return wrap


def load() -> None:
    from . import documents, ingest, library, people, retrieval, scalars, streams, understanding  # noqa: F401

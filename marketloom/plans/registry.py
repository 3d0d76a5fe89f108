"""Named queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.session import prepare
from marketloom.views import with_twins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Instants leave as zone-less UTC stamps, as the given tables hold them."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
        if f.dataType.typeName() == "timestamp" else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def query(name: str, sql: str | None = None, twins: tuple[str, ...] = ()):
    """Register the decorated `fn(spark, sf_dir)` under `name`."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(fn(prepare(spark), sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_twins(sql, *twins)
        return fn

    return wrap

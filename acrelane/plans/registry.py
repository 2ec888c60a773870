"""All registered queries of the library and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from acrelane.plans.shapes import duck, shape

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The shapes of one data folder: tables('facility') is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return shape(self.spark, self.sf_dir, name)


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a function of Tables under a name, with the SQL (shapes in braces) that gives the same rows."""
    def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLE[name] = duck(oracle)
        return fn

    return register


from acrelane.plans import crop_queries, entity_queries, facility_queries, geo_queries, graph_queries, ingest_queries, source_queries  # noqa: E402, F401

"""Register named queries with the SQL that checks them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestry.plans.adapters import Tables, with_views
from attestry.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FRAGMENTS: dict[str, str] = {}  # check-side SQL shared by several queries


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(Tables(spark, folder))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, FRAGMENTS)
        return fn

    return add

"""Name of each registered query: its Spark function of (spark, folder), and SQL for the same rows if SQL can say it."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MODULES = ("metrics", "timeline", "alignment", "quality", "records", "review", "values", "vectors", "inventory")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers the function below it under its own name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def load() -> tuple[dict, dict[str, str]]:
    for module in MODULES:
        import_module(f"gridloom.plans.{module}")
    return QUERIES, ORACLES

"""Where the registered queries of the reference's operators meet: a name, a callable and its SQL (DuckDB), if SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A whole input table; only the named columns are scanned."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.selectExpr(*cols) if cols else df


def sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"

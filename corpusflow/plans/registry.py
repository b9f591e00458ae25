"""The registry of queries and of the DuckDB SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """A scan dealt out to all cores where its files have fewer splits than there are: the table is small then, by the size of a split."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def over(source: str, key: str, column: str, name: str, sql: str, **columns: Callable) -> None:
    """A projection of a table by its key."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(key, *[f(F.col(column)).alias(n) for n, f in columns.items()])

    QUERIES[name], ORACLE[name] = run, f"SELECT {key}, {sql} FROM {source}"


def over_documents(name: str, sql: str, **columns: Callable) -> None:
    over("documents", "doc_id", "text", name, sql, **columns)

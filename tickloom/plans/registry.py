"""Queries by name, each with the SQL that it must agree with (None where SQL cannot say it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flat(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers as long and doubles rounded, as the SQL side has them."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long").alias(f.name)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = lambda spark, sf_dir: flat(f(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add

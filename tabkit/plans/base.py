"""Registry of checked queries: a Spark function and, where possible, equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabkit.functions.columns import col
from tabkit.sources.tables import read_table


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name."""

    def add(fn):
        QUERIES[fn.__name__] = Query(fn, sql)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 7) -> DataFrame:
    """Doubles rounded for comparison between engines."""
    return df.withColumns({f.name: F.round(col(f.name), digits) + F.lit(0.0) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)})


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# Two datasets out of lineitem: a real half, and a half changed as a model might.
SPLIT_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
HALVES_SQL = """
SELECT CASE WHEN is_real THEN 'real' ELSE 'synthetic' END AS dataset,
       CASE WHEN is_real THEN l_quantity ELSE least(l_quantity + 1.0, 50.0) END AS l_quantity,
       CASE WHEN is_real THEN l_extendedprice ELSE l_extendedprice * 0.875 + 512.0 END AS l_extendedprice,
       l_discount, l_tax,
       CASE WHEN is_real OR l_linenumber > 1 THEN l_returnflag ELSE 'A' END AS l_returnflag,
       l_linestatus
FROM (SELECT *, md5(concat_ws(':', 'half', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR)) < '8' AS is_real FROM lineitem)
"""
HALVES_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
HALVES_CATEGORICAL = ["l_returnflag", "l_linestatus"]


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    real = F.md5(F.concat_ws(":", F.lit("half"), "l_orderkey", "l_linenumber", "l_partkey")) < "8"
    li = li.withColumn("is_real", real)
    pick = lambda a, b: F.when(F.col("is_real"), a).otherwise(b)
    return li.select(
        pick(F.lit("real"), F.lit("synthetic")).alias("dataset"),
        pick(F.col("l_quantity"), F.least(F.col("l_quantity") + 1.0, F.lit(50.0))).alias("l_quantity"),
        pick(F.col("l_extendedprice"), F.col("l_extendedprice") * 0.875 + 512.0).alias("l_extendedprice"),
        "l_discount",
        "l_tax",
        F.when(F.col("is_real") | (F.col("l_linenumber") > 1), F.col("l_returnflag")).otherwise("A").alias("l_returnflag"),
        "l_linestatus",
    )

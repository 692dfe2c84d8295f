"""Cubes derived from business tables, for the registered queries and tests."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridlark.cube import Cube


def _exact_mean(column: str):
    """A mean of cents that is the same in any order of rows."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))


def _month(column: str):
    return F.make_date(F.year(column), F.month(column), F.lit(1))


def month_cube(spark: SparkSession, sf_dir: str) -> Cube:
    """83 months on a grid of 5 latitudes and 6 longitudes; tas and pr, with extremes of tas."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    keys = [_month("l_shipdate").alias("t"), (F.col("l_suppkey") % 5 * 30 - 60).cast("double").alias("y"), (F.col("l_partkey") % 6 * 60).cast("double").alias("x")]
    df = rows.groupBy(*keys).agg(_exact_mean("l_extendedprice").alias("tas"), _exact_mean("l_quantity").alias("pr"), F.min("l_extendedprice").alias("tasmin"), F.max("l_extendedprice").alias("tasmax"))
    return Cube(df, ("t", "y", "x"), ("tas", "pr", "tasmin", "tasmax"))


def other_cube(spark: SparkSession, sf_dir: str, n: int = 0) -> Cube:
    """A second model of tas; with ``n`` rows and columns, on a coarser grid."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    y = (F.col("o_custkey") % (n or 5) * (60 if n else 30) - 60).cast("double")
    x = (F.col("o_orderkey") % (n or 6) * (120 if n else 60)).cast("double")
    df = rows.groupBy(_month("o_orderdate").alias("t"), y.alias("y"), x.alias("x")).agg(_exact_mean("o_totalprice").alias("tas"))
    return Cube(df, ("t", "y", "x"), ("tas",))


def event_cube(spark: SparkSession, sf_dir: str) -> Cube:
    """Values under a day: mean of events an hour, user group and type."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    x = sum(F.when(F.col("event_type") == name, float(k)).otherwise(0.0) for k, name in enumerate(["click", "error", "purchase", "signup", "view"]))
    t = F.col("ts").cast("timestamp_ntz")
    df = rows.select(t.alias("t"), (F.col("user_id") % 5).cast("double").alias("y"), x.alias("x"), F.col("value").cast("decimal(18,2)").alias("v"))
    df = df.groupBy(F.make_timestamp_ntz(F.year("t"), F.month("t"), F.dayofmonth("t"), F.hour("t"), F.lit(0), F.lit(0)).alias("t"), "y", "x").agg((F.sum("v").cast("double") / F.count(F.lit(1))).alias("v"))
    return Cube(df, ("t", "y", "x"), ("v",))

"""The driver's tables as labelled samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _millis(column: str) -> Column:
    """Milliseconds of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_*, t, v): one series per event type and user; some have no route."""
    user = F.col("user_id")
    route = F.when(user % 3 == 1, F.lit("/")).when(user % 3 == 2, F.concat(F.lit("/r"), (user % 7).cast("string")))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("l___name__"),
        F.concat(F.lit("user-"), user.cast("string")).alias("l_user"),
        F.when(user % 2 == 0, F.lit("prod")).otherwise(F.lit("beta")).alias("l_env"),
        route.alias("l_route"),
        _millis("ts").alias("t"),
        F.col("value").alias("v"),
    )


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by flag, status and supplier; several samples may share a time."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.lit("lineitem_quantity").alias("l___name__"),
        F.col("l_returnflag").alias("l_flag"),
        F.col("l_linestatus").alias("l_status"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("l_supp"),
        _millis("l_shipdate").alias("t"),
        F.col("l_quantity").alias("v"),
        "l_orderkey",
        "l_linenumber",
    ).withColumnsRenamed({"l_orderkey": "orderkey", "l_linenumber": "linenumber"})


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.lit("order_price").alias("l___name__"),
        F.col("o_orderstatus").alias("l_status"),
        F.col("o_orderpriority").alias("l_priority"),
        _millis("o_orderdate").alias("t"),
        F.col("o_totalprice").alias("v"),
        F.col("o_orderkey").alias("orderkey"),
    )

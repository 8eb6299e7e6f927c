"""Test tables, and versions of them with gaps; each has the same view in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gap_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with missing quantities, discounts and statuses."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "CASE WHEN l_linenumber = 5 THEN NULL ELSE l_quantity END AS quantity",
        "l_extendedprice AS price",
        "CASE WHEN l_returnflag = 'A' AND l_linenumber = 2 THEN NULL ELSE l_discount END AS discount",
        "l_tax AS tax",
        "l_returnflag AS flag",
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linestatus END AS status",
        "l_shipdate AS shipped",
    )


GAP_LINES = """
gap_lines AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_linenumber = 5 THEN NULL ELSE l_quantity END AS quantity,
         l_extendedprice AS price,
         CASE WHEN l_returnflag = 'A' AND l_linenumber = 2 THEN NULL ELSE l_discount END AS discount,
         l_tax AS tax, l_returnflag AS flag,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linestatus END AS status,
         l_shipdate AS shipped
  FROM lineitem)
"""


def narrow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few columns of ``gap_lines``, so that many rows are equal."""
    return gap_lines(spark, sf_dir).select("quantity", "discount", "flag", "status")


NARROW_LINES = GAP_LINES + ", narrow_lines AS (SELECT quantity, discount, flag, status FROM gap_lines)"


def gap_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with missing priorities and prices, and the date as text."""
    return read(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.expr("CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END").alias("priority"),
        F.expr("CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END").alias("total"),
        F.col("o_orderstatus").alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered"),
    )


GAP_ORDERS = """
gap_orders AS (
  SELECT o_orderkey, o_custkey,
         CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS priority,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS total,
         o_orderstatus AS status,
         strftime(o_orderdate, '%Y-%m-%d') AS ordered
  FROM orders)
"""


def gap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with missing values for two event types."""
    return read(spark, sf_dir, "events").selectExpr(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "CASE WHEN event_type IN ('view', 'error') THEN NULL ELSE value END AS value",
    )


GAP_EVENTS = """
gap_events AS (
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN event_type IN ('view', 'error') THEN NULL ELSE value END AS value
  FROM events)
"""


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Round the double columns, as the checks in SQL do."""
    return df.select(
        *[
            F.round(F.col(f"`{n}`"), places).alias(n) if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )

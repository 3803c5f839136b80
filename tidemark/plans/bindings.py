"""How the event-study roles map onto the input tables, in Spark and in SQL.

The operators know no table; these bindings give each role (focal events,
price bars, news, facts, peers ...) from the tables, and the ``*_SQL`` constants
say the same as common table expressions for the oracle.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.pit import quarter_name
from tidemark.operators.joins import never_broadcast
from tidemark.session import table


def focal(spark: SparkSession, d: str) -> DataFrame:
    """Labelled corporate events: one row per (event, ticker)."""
    o = table(spark, d, "orders")
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    at = F.col("o_orderdate").cast("timestamp")
    return o.select(
        k.alias("event_id"), F.col("o_custkey").alias("ticker"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "OTHER").otherwise("EARNINGS_RELEASE").alias("event_type"),
        at.alias("cutoff"), quarter_name(at).alias("quarter"),
        F.when(F.col("o_orderstatus") != "P", price / 700001.0 - 0.25).alias("car1"),
        F.when(F.col("o_orderpriority") != "5-LOW", (k % 401) / 200.0 - 1.0).alias("earnings_surprise"),
        F.when(k % 11 != 0, (k % 97) / 25.0).alias("reported_eps"),
        F.when(k % 13 != 0, (k % 89) / 25.0).alias("consensus_eps"),
        F.when(k % 7 != 0, price).alias("reported_revenue"),
        (price * (0.8 + (k % 41) / 100.0)).alias("consensus_revenue"),
        (0.2 + (F.col("o_custkey") % 100) / 200.0 + (k % 7) / 70.0).alias("score"),
    )


FOCAL_SQL = """focal AS (
  SELECT o_orderkey AS event_id, o_custkey AS ticker,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'OTHER' ELSE 'EARNINGS_RELEASE' END AS event_type,
    o_orderdate AS cutoff, CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS quarter,
    CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / CAST(700001 AS DOUBLE) - CAST(0.25 AS DOUBLE) END AS car1,
    CASE WHEN o_orderpriority <> '5-LOW' THEN (o_orderkey % 401) / CAST(200 AS DOUBLE) - 1 END AS earnings_surprise,
    CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 97) / CAST(25 AS DOUBLE) END AS reported_eps,
    CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 89) / CAST(25 AS DOUBLE) END AS consensus_eps,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS reported_revenue,
    o_totalprice * (CAST(0.8 AS DOUBLE) + (o_orderkey % 41) / CAST(100 AS DOUBLE)) AS consensus_revenue,
    CAST(0.2 AS DOUBLE) + (o_custkey % 100) / CAST(200 AS DOUBLE) + (o_orderkey % 7) / CAST(70 AS DOUBLE) AS score
  FROM orders)"""

LABELLED_SQL = FOCAL_SQL + """, labelled AS (
  SELECT *, CASE WHEN n = 1 THEN 0.5 ELSE ((lo - 1) + (ties - 1) / 2.0) / (n - 1) END AS realized
  FROM (SELECT *, rank() OVER (PARTITION BY quarter ORDER BY car1) AS lo,
          count(*) OVER (PARTITION BY quarter, car1) AS ties, count(*) OVER (PARTITION BY quarter) AS n
        FROM focal WHERE car1 IS NOT NULL))"""


def bars(spark: SparkSession, d: str) -> DataFrame:
    """Daily price bars per supplier (volume-weighted, net of a 7% charge)."""
    li = table(spark, d, "lineitem")
    day = F.col("l_shipdate").cast("timestamp")
    return (
        li.groupBy(F.col("l_suppkey").alias("stock"), day.alias("day"))
        .agg((F.sum("l_extendedprice") / (F.sum("l_quantity") * 1.07)).alias("close"), F.sum("l_quantity").alias("volume"))
        .select("stock", "day", (F.col("day") + F.expr("INTERVAL 21 HOURS")).alias("value_timestamp"),
                (F.col("day") + F.expr("INTERVAL 1 DAY")).alias("available_at"), "close", "volume")
    )


BARS_SQL = """bars AS (
  SELECT l_suppkey AS stock, l_shipdate AS day, l_shipdate + INTERVAL 21 HOUR AS value_timestamp,
    l_shipdate + INTERVAL 1 DAY AS available_at,
    sum(l_extendedprice) / (sum(l_quantity) * CAST(1.07 AS DOUBLE)) AS close, sum(l_quantity) AS volume
  FROM lineitem GROUP BY l_suppkey, l_shipdate)"""


def traded(spark: SparkSession, d: str) -> DataFrame:
    """Focal events with the stock they trade (smallest supplier of the order)."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("event_id")).agg(F.min("l_suppkey").alias("stock"))
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("event_id"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 16 HOURS")).alias("cutoff"),
    ).join(never_broadcast(li), "event_id")


TRADED_SQL = """traded AS (
  SELECT o_orderkey AS event_id, o_orderdate + INTERVAL 16 HOUR AS cutoff, s.stock
  FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS stock FROM lineitem GROUP BY l_orderkey) s
    ON s.l_orderkey = o_orderkey)"""

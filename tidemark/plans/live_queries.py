"""Registered queries: the streaming path over the event table.

Deliveries are files that Spark writes from the events, with repeats and stale
copies added; each query runs a stream to the end and reads its sink."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import asof
from tidemark.operators.models import LinearModel
from tidemark.plans.catalog import query
from tidemark.session import scratch_path, table, with_one_row
from tidemark.streaming import live

MODEL = LinearModel("live", {}, ("payload", "prior_value"), (50.0, 50.0), (31.0, 31.0), (0.07, -0.03), 0.5)


def deliveries(spark, d) -> str:
    """Every event once, a repeat of every fourth, a stale copy of every seventh."""
    at, k = F.col("ts").cast("timestamp"), F.col("event_id")
    asset = lambda v: F.struct(F.lit("TICKER").alias("identifier_type"), v.cast("string").alias("identifier_value"))
    one = table(spark, d, "events").select(
        F.concat(F.lit("d"), k.cast("string")).alias("id"), k.cast("string").alias("event_id"),
        F.when(F.col("event_type") == "signup", "TEST").otherwise("EARNINGS_RELEASE").alias("event_type"), at.alias("event_datetime"),
        at.alias("sent_at"), (at + F.make_dt_interval(secs=(k % 250).cast("decimal(18,6)"))).alias("arrived_at"),
        (at + F.make_dt_interval(secs=F.lit(200).cast("decimal(18,6)"))).alias("prediction_deadline"),
        F.when(k % 3 == 0, F.array(asset(F.col("user_id")), asset(F.col("user_id") + 1000))).otherwise(F.array(asset(F.col("user_id")))).alias("focal_assets"),
        F.col("value").alias("payload"))
    number = F.col("event_id").cast("bigint")
    again = one.where(number % 4 == 0).withColumn("arrived_at", F.col("arrived_at") + F.expr("INTERVAL 20 SECONDS"))
    stale = one.where(number % 7 == 0).withColumn("id", F.concat("id", F.lit("-stale"))).withColumn(
        "event_id", F.concat("event_id", F.lit("-stale"))).withColumn("arrived_at", F.col("sent_at") + F.expr("INTERVAL 301 SECONDS"))
    path = scratch_path(spark, "deliveries")
    one.unionByName(stale).write.json(path)
    again.write.mode("append").json(path)
    return path


def history(spark, d) -> DataFrame:
    """Static values per user, available one hour after they were recorded."""
    at = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("ticker"), F.col("value").alias("prior_value"),
                                            (at + F.expr("INTERVAL 1 HOUR")).alias("available_at"), F.col("event_id").alias("n"))


def prior_join(spark, d):
    def join(rows: DataFrame) -> DataFrame:
        hit = asof(rows, history(spark, d), ["ticker"], "event_datetime", "available_at", ["prior_value", "n"], "h", True, "n")
        return hit.withColumn("prior_value", F.col("h.prior_value")).drop("h")

    return join, {"prior_value": 50.0}


def broken_join():
    def join(rows: DataFrame) -> DataFrame:
        return rows.select("*", "column_the_provider_never_sent")

    return join, {"vendor_value": 0.0}


def run_live(spark, d, families) -> tuple[str, str]:
    sink, receipts = scratch_path(spark, "scores"), scratch_path(spark, "receipts")
    stream = live.fresh(live.read_events(spark, deliveries(spark, d)))
    live.run_to_end(stream, live.scoring_batch(MODEL, families, sink, receipts), scratch_path(spark, "progress"))
    return sink, receipts


ASSET_SQL = """ass AS (SELECT event_id, ts, value, CASE WHEN event_type = 'signup' THEN 'TEST' ELSE 'EARNINGS_RELEASE' END AS event_type,
  unnest(CASE WHEN event_id % 3 = 0 THEN [user_id, user_id + 1000] ELSE [user_id] END) AS asset FROM events)"""


@query("s01_stream_ingest", """SELECT event_type, CAST(sum(copies) AS BIGINT) AS deliveries FROM (SELECT CASE WHEN event_type = 'signup' THEN 'TEST' ELSE 'EARNINGS_RELEASE' END AS event_type,
  1 + CAST(event_id % 4 = 0 AS INT) + CAST(event_id % 7 = 0 AS INT) AS copies FROM events) GROUP BY event_type""")
def s01(spark, d):
    sink = scratch_path(spark, "ingested")
    live.run_to_end(live.read_events(spark, deliveries(spark, d)),
                    lambda b, i: b.select("id", "event_type").write.mode("append").parquet(sink), scratch_path(spark, "progress"))
    return spark.read.parquet(sink).groupBy("event_type").agg(F.count(F.lit(1)).alias("deliveries"))


@query("s02_idempotent_claim", f"""WITH {ASSET_SQL} SELECT CAST(event_id AS VARCHAR) AS event_key, count(*) AS stored FROM ass GROUP BY event_id""")
def s02(spark, d):
    """Repeats and stale copies (s03) leave exactly one stored row per asset."""
    sink, _ = run_live(spark, d, {"history": prior_join(spark, d)})
    return spark.read.parquet(sink).groupBy("event_key").agg(F.count(F.lit(1)).alias("stored"))


@query("s03_replay_tolerance", """SELECT CAST(count(*) + count(*) FILTER (WHERE event_id % 4 = 0 AND event_id % 250 <= 280) AS BIGINT) AS fresh, 0::BIGINT AS stale FROM events""")
def s03(spark, d):
    sink = scratch_path(spark, "fresh")
    live.run_to_end(live.fresh(live.read_events(spark, deliveries(spark, d))),
                    lambda b, i: b.select("id").write.mode("append").parquet(sink), scratch_path(spark, "progress"))
    return spark.read.parquet(sink).agg(F.count(F.lit(1)).alias("fresh"), F.count(F.when(F.col("id").endswith("-stale"), 1)).alias("stale"))


@query("s04_lateness_first_wins", """SELECT user_id, event_id AS first_event, CASE WHEN event_id % 250 > 200 THEN 'late' ELSE 'on_time' END AS timing FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def s04(spark, d):
    at, k = F.col("ts").cast("timestamp"), F.col("event_id")
    made = at + F.make_dt_interval(secs=(k % 250).cast("decimal(18,6)"))
    subs = table(spark, d, "events").select("user_id", at.alias("at"), "event_id", live.lateness(
        made, at + F.expr("INTERVAL 200 SECONDS")).alias("timing"))
    return live.first_submission(subs, "user_id", "at", "event_id").select("user_id", F.col("event_id").alias("first_event"), "timing")


@query("s05_test_short_circuit", f"WITH {ASSET_SQL} SELECT CAST(event_id AS VARCHAR) AS event_key, CAST(asset AS VARCHAR) AS ticker_key, 0.5::DOUBLE AS prediction FROM ass WHERE event_type = 'TEST'")
def s05(spark, d):
    sink, _ = run_live(spark, d, {"history": prior_join(spark, d)})
    return spark.read.parquet(sink).where("event_type = 'TEST'").select("event_key", "ticker_key", "prediction")


@query("s06_stream_scoring", f"""WITH {ASSET_SQL}, h AS (SELECT user_id AS asset, value AS prior_value, ts + INTERVAL 1 HOUR AS available_at FROM events),
j AS (SELECT a.*, coalesce(h.prior_value, 50.0) AS prior FROM (SELECT * FROM ass WHERE event_type <> 'TEST') a ASOF LEFT JOIN h ON a.asset = h.asset AND a.ts >= h.available_at)
SELECT CAST(event_id AS VARCHAR) AS event_key, CAST(asset AS VARCHAR) AS ticker_key, round(prior, 6) + 0.0 AS prior_value,
  round(greatest(0.05, least(0.95, 0.5 + 0.07 * (value - 50) / 31 - 0.03 * (prior - 50) / 31)), 6) + 0.0 AS prediction,
  CASE WHEN event_id % 250 > 200 THEN 'late' ELSE 'on_time' END AS timing FROM j""")
def s06(spark, d):
    """Stream to static as-of join, linear score, lateness tag."""
    sink, _ = run_live(spark, d, {"history": prior_join(spark, d)})
    return spark.read.parquet(sink).where("event_type <> 'TEST'").select("event_key", "ticker_key", "prior_value", "prediction", "timing")


@query("s07_failure_isolation", """SELECT family, status FROM (VALUES ('history', 'ok'), ('vendor', 'error')) v(family, status) WHERE (SELECT count(*) FROM events) > 0""")
def s07(spark, d):
    """A family that fails leaves defaults and a receipt; the scores are stored."""
    sink, receipts = run_live(spark, d, {"history": prior_join(spark, d), "vendor": broken_join()})
    done = spark.read.parquet(sink).agg(F.count(F.lit(1)).alias("n"))
    noted = spark.read.parquet(receipts).select("family", F.split_part("status", F.lit(":"), F.lit(1)).alias("status")).distinct()
    return with_one_row(noted, done).where("n > 0").drop("n")


@query("s08_write_once_sink", f"""WITH {ASSET_SQL} SELECT count(*) AS rows, count(DISTINCT CAST(event_id AS VARCHAR) || '|' || asset) AS keys FROM ass""")
def s08(spark, d):
    """The same deliveries streamed twice into one sink."""
    sink, path = scratch_path(spark, "scores"), deliveries(spark, d)
    for _ in range(2):
        stream = live.fresh(live.read_events(spark, path))
        live.run_to_end(stream, live.scoring_batch(MODEL, {"history": prior_join(spark, d)}, sink), scratch_path(spark, "progress"))
    return spark.read.parquet(sink).agg(F.count(F.lit(1)).alias("rows"),
                                        F.countDistinct(F.concat_ws("|", "event_key", "ticker_key")).alias("keys"))

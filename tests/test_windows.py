"""Figures of long windows against brute force, without frames that Spark adds up anew for every row."""
import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemark.operators import series as sr

SCHEMA = "stock long, at long, close double, volume double"


def some_bars():
    rng = np.random.default_rng(5)
    rows = [(s, i, float(rng.integers(50, 90)), None if rng.random() < 0.3 else float(rng.integers(1, 50))) for s, n in ((1, 700), (2, 61), (3, 2)) for i in range(n)]
    return rows + [(4, i, 100.0, 0.1e7) for i in range(130)]  # nothing moves: no spread from rounding


def built(spark):
    bars = spark.createDataFrame(some_bars(), SCHEMA).withColumn("value_timestamp", F.timestamp_seconds(F.col("at") * 86400))
    return sr.price_features(bars, ["stock"])


def brute(closes, volumes):
    steps = [b / a - 1 for a, b in zip(closes, closes[1:])]
    out = []
    for i, x in enumerate(closes):
        vol = [float(np.std(steps[max(0, i - n):i]) * np.sqrt(252)) if i >= 2 else 0.0 for n in (60, 252)]
        fall = []
        for n in (60, 252):
            c = np.array(closes[max(0, i - n + 1):i + 1])
            fall.append(float(min(0.0, (c / np.maximum.accumulate(c) - 1).min())))
        known = [v for v in volumes[max(0, i - 59):i + 1] if v is not None]
        z = (known[-1] - np.mean(known)) / np.std(known) if len(known) >= 10 and np.std(known) > 1e-12 else 0.0
        year = closes[max(0, i - 251):i + 1]
        out.append((*vol, *fall, float(z), x / max(year) - 1, x / min(year) - 1))
    return out


@pytest.mark.parametrize("rows_per_task", [None, "7"])
def test_long_windows_match_brute_force(spark, rows_per_task):
    names = ["realized_volatility_60d", "realized_volatility_252d", "max_drawdown_60d", "max_drawdown_252d", "volume_zscore", "distance_from_52w_high", "distance_from_52w_low"]
    if rows_per_task:
        spark.conf.set("spark.tidemark.rowsPerTask", rows_per_task)
    try:
        got = {(r["stock"], r["at"]): [r[n] for n in names] for r in built(spark).select("stock", "at", *names).collect()}
    finally:
        spark.conf.unset("spark.tidemark.rowsPerTask")
    rows = some_bars()
    assert len(got) == len(rows)
    for stock in (1, 2, 3, 4):
        own = [r for r in rows if r[0] == stock]
        for (_, at, *_), want in zip(own, brute([r[2] for r in own], [r[3] for r in own])):
            assert np.allclose(got[stock, at], want, atol=1e-9), (stock, at)


def test_no_frame_is_added_up_anew_over_a_long_window(spark):
    plan = built(spark)._jdf.queryExecution().executedPlan().toString()
    assert "currentrow$(), unboundedfollowing$()" not in plan
    assert not [n for n in (59, 251) if f"RowFrame, -{n}, currentrow$()" in plan]


def test_a_side_with_too_many_rows_is_not_broadcast(spark):
    from tidemark.operators.joins import broadcast_if_small

    left, right = spark.range(100), spark.range(0, 100, 3)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    try:
        for most, there in ((34, True), (33, False)):
            joined = left.join(broadcast_if_small(right, most), "id")
            assert sorted(r["id"] for r in joined.collect()) == list(range(0, 100, 3))
            assert ("BroadcastExchange" in joined._jdf.queryExecution().executedPlan().toString()) is there
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_no_side_of_a_news_window_is_broadcast(spark, tmp_path):
    """The queries make eight rows each, which no estimate counts: the driver would hold them all."""
    import datetime as dt

    from pyspark.sql import functions as F

    from tidemark.operators.joins import interval_join

    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 7200)
    spark.range(300).select("id", at.alias("cutoff"), F.concat(F.lit("S"), (F.col("id") % 3).cast("string")).alias("entity")).write.parquet(f"{tmp_path}/q")
    spark.range(200).select(F.col("id").alias("article_id"), at.alias("published_at"), (at + F.expr("INTERVAL 5 HOURS")).alias("available_at"),
                            F.concat(F.lit("S"), (F.col("id") % 4).cast("string")).alias("entity")).write.parquet(f"{tmp_path}/r")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    try:
        hits = interval_join(spark.read.parquet(f"{tmp_path}/q"), spark.read.parquet(f"{tmp_path}/r"), "entity", "cutoff", "published_at", "available_at", 7)
        got = sorted((r["id"], r["article_id"]) for r in hits.collect())
        plan = hits._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
    hour = lambda n: dt.timedelta(hours=2 * n)
    assert got == [(q, a) for q in range(300) for a in range(200)
                   if q % 3 == a % 4 and hour(q) - dt.timedelta(days=7) <= hour(a) <= hour(q) and hour(a) + dt.timedelta(hours=5) <= hour(q)]

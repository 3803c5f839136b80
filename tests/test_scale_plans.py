"""Both plans of the scans give the same rows, and the stream loses none."""
import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators.joins import asof
from tidemark.operators.models import LinearModel
from tidemark.operators.ranks import percentile_rank
from tidemark.operators.scan import Running, rank_stats, rolling, running
from tidemark.streaming import live

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def rows(spark):
    """A hot key, small keys, NULL keys; values with ties, NULL, NaN and infinity."""
    keys = ["hot"] * 40 + ["a", "b", "a", None] * 6
    values = [float(i % 9) for i in range(len(keys))]
    values[3] = values[44] = values[43] = None
    values[5] = values[6] = values[47] = math.nan
    values[7], values[8] = math.inf, -math.inf
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(zip(keys, values))], "i long, k string, v double").cache()


def both_plans(spark, build):
    """Sorted rows (as text, so that NaN equals NaN) under the plain and the split plan."""
    out = []
    for limit in ("2000000", "4"):
        spark.conf.set("spark.tidemark.rowsPerTask", limit)
        try:
            out.append(sorted(map(str, build().collect())))
        finally:
            spark.conf.unset("spark.tidemark.rowsPerTask")
    return out


@pytest.mark.parametrize("within", [["k"], []])
def test_rank_stats(spark, rows, within):
    plain, split = both_plans(spark, lambda: rank_stats(rows, "v", within))
    assert plain == split and len(plain) == rows.count()
    plain, split = both_plans(spark, lambda: percentile_rank(rows, "v", within, "p"))
    assert plain == split


@pytest.mark.parametrize("keys", [["k"], []])
def test_running(spark, rows, keys):
    aggs = [Running("sum", F.col("i"), "total"), Running("max", F.col("i"), "top"), Running("min", F.col("i"), "low"),
            Running("last", F.when(F.col("i") % 3 == 0, F.col("i")), "seen")]
    plain, split = both_plans(spark, lambda: running(rows, keys, ["v", "i"], aggs))
    assert plain == split and len(plain) == rows.count()


def test_rolling(spark, rows):
    from pyspark.sql import Window

    def build(df, parts):
        frame = Window.partitionBy(*parts).orderBy("v", "i").rowsBetween(-2, 0)
        return df.withColumn("three", F.sum("i").over(frame))

    plain, split = both_plans(spark, lambda: rolling(rows, ["k"], ["v", "i"], 2, build).select("i", "k", "v", "position", "three"))
    assert plain == split and len(plain) == rows.count()


def test_asof_null_keys_match_nothing(spark, rows):
    at = F.lit(DAY).cast("timestamp") + F.make_dt_interval(days=F.col("i").cast("int"))
    points = rows.where("i % 2 = 0").select("k", at.alias("seen_at"), F.col("i").alias("n")).withColumn(
        "seen_at", F.when(F.col("n") % 10 != 0, F.col("seen_at")))
    queries = rows.select("i", "k", at.alias("cutoff")).withColumn("cutoff", F.when(F.col("i") != 11, F.col("cutoff")))
    plain, split = both_plans(spark, lambda: asof(queries, points, ["k"], "cutoff", "seen_at", ["n"], "hit", True, "n").select(
        "i", "k", F.col("hit.n").alias("n")))
    known = {}
    for r in points.collect():
        if r["k"] is not None and r["seen_at"] is not None:
            known.setdefault(r["k"], []).append(r["n"])
    want = [(q["i"], q["k"], max((n for n in known.get(q["k"], []) if n <= q["i"]), default=None) if q["cutoff"] else None)
            for q in queries.collect()]
    assert plain == split == sorted(f"Row(i={i}, k={k!r}, n={n})" for i, k, n in want)


def test_stream_keeps_late_first_sightings(spark, tmp_path):
    """Hourly files out of time order, one a batch, with repeats in other files."""
    events = [(h, j, DAY + dt.timedelta(hours=h, minutes=2 * j)) for h in range(12) for j in range(5)]
    frame = spark.createDataFrame(events, "h int, j int, at timestamp").select(
        F.concat_ws("-", "h", "j").alias("id"), F.concat_ws("-", F.lit("e"), "h", "j").alias("event_id"), F.lit("EARNINGS_RELEASE").alias("event_type"),
        F.col("at").alias("event_datetime"), F.col("at").alias("sent_at"), F.col("at").alias("arrived_at"), F.col("at").alias("prediction_deadline"),
        F.array(F.struct(F.lit("TICKER").alias("identifier_type"), F.lit("T").alias("identifier_value"))).alias("focal_assets"),
        F.lit(50.0).alias("payload"), "h", "j").cache()
    path = str(tmp_path / "in")
    for n, hour in enumerate([11, 3, 7, 0, 10, 5, 1, 9, 2, 8, 4, 6]):
        part = frame.where((F.col("h") == hour) | ((F.col("h") == (hour + 1) % 12) & (F.col("j") == 0)))
        part.drop("h", "j").coalesce(1).write.mode("append").json(path)
    sink = str(tmp_path / "sink")
    model = LinearModel("live", {}, ("payload",), (50.0,), (31.0,), (0.07,), 0.5)
    live.run_to_end(live.fresh(live.read_events(spark, path, 1)), live.scoring_batch(model, {}, sink), str(tmp_path / "progress"))
    stored = [r["event_key"] for r in spark.read.parquet(sink).collect()]
    assert sorted(stored) == sorted(f"e-{h}-{j}" for h in range(12) for j in range(5))


def test_the_calibration_check_ranks_each_column_once(spark, monkeypatch):
    from tidemark.operators import metrics, scan
    from tidemark.plans import evaluation

    ranked = []
    counted = lambda df, value, *a, **k: (ranked.append((value, sorted(df.columns))), scan.rank_stats(df, value, *a, **k))[1]
    monkeypatch.setattr(evaluation, "rank_stats", counted)
    monkeypatch.setattr(metrics, "rank_stats", counted)
    # ties, values beyond both bounds, and unknown outcomes
    rows = [(i, float((i * 7) % 150), ((i * 37) % 301) / 301 if i % 11 else None) for i in range(300)]
    monkeypatch.setattr(evaluation, "labelled", lambda *_: spark.createDataFrame(rows, "event_id int, score double, realized double"))
    got = evaluation.k11(spark, "").first()
    assert sorted(v for v, _ in ranked) == ["cal", "realized", "score"] and not any("event_id" in c for _, c in ranked)
    known = [(s, r) for _, s, r in rows if r is not None]
    place = lambda v, all_: sum(x < v for x in all_) + (sum(x == v for x in all_) - 1) / 2
    scores, actual = [s for _, s, _ in rows], [r for _, _, r in rows if r is not None]
    cal = lambda v: max(0.01, min(0.99, (sum(x < v for x in scores) + sum(x == v for x in scores) / 2) / len(scores)))
    cals = [cal(s) for s in scores]
    import numpy as np

    corr = lambda f: np.corrcoef([f(s) for s, _ in known], [place(r, actual) for _, r in known])[0, 1]
    assert abs(got["raw_spearman"] - corr(lambda s: place(s, scores))) < 1e-9
    assert abs(got["calibrated_spearman"] - corr(lambda s: place(cal(s), cals))) < 1e-9 and got["monotonic"]

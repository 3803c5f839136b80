"""Peer features without pairs that carry records: sums of recent results against the arrays they stand for."""
import datetime as dt
import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import families as fam
from tidemark.plans import enrichment as en

FIELDS = "reported_eps double, consensus_eps double, reported_revenue double, consensus_revenue double, abnormal_return double"


def test_sums_say_what_the_records_say(spark):
    rng = random.Random(3)
    some = lambda: None if rng.random() < 0.3 else rng.uniform(-2, 2)
    rows = [(e, p, some(), some(), some(), some(), some()) for e in range(6) for p in range(3) for _ in range(e)]
    df = spark.createDataFrame(rows, "event_id int, peer int, " + FIELDS)
    names = [f.split()[0] for f in FIELDS.split(", ")]
    arrays = df.groupBy("event_id").agg(F.collect_list(F.struct(*names)).alias("records")).select("event_id", *[c.alias(n) for n, c in fam.peer_earnings_block(F.col("records")).items()])
    told = df.withColumns(fam.peer_result_values()).groupBy("event_id", "peer").agg(
        F.count(F.lit(1)).alias("records"), *[f(n).alias(f"{k}_{n}") for n in fam.PEER_RESULTS for k, f in (("n", F.count), ("s", F.sum))])
    sums = told.groupBy("event_id").agg(*[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in fam.peer_result_means().items()])
    shape = lambda out: sorted(tuple(round(float(x), 9) for x in r) for r in out.select(*arrays.columns).collect())
    assert shape(sums) == shape(arrays)


def tables(spark, folder, events):
    at = dt.datetime(1997, 5, 1)
    spark.createDataFrame([(i, 7, 100.0 * i) for i in range(1, 16)], "s_suppkey long, s_nationkey long, s_acctbal double").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(e, at) for e in events], "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame([(1, 8), (2, 1)], "l_orderkey long, l_suppkey long").write.parquet(f"{folder}/lineitem.parquet")


def test_repeated_events_share_their_ten_places(spark, tmp_path):
    tables(spark, str(tmp_path), [1, 2, 2, 2])
    got = {}
    for r in en.selected_peers(spark, str(tmp_path)).collect():
        got.setdefault(r["event_id"], []).append((r["peer_place"], r["peer_key"]))
    assert sorted(got[1]) == list(enumerate([7, 9, 6, 10, 5, 11, 4, 12, 3, 13], 1))
    assert sorted(got[2]) == list(enumerate([2, 2, 2, 3, 3, 3, 4, 4, 4, 5], 1))


def test_no_pair_carries_records(spark):
    plan = entry.queries()["d07_peer_sympathy"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "history" not in plan and "flatten" not in plan

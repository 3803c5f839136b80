"""The audit of an event's context against brute force, with unknown times, repeats and hot events."""
import datetime as dt
import random

from tidemark.operators import audit as au

T0 = dt.datetime(2024, 5, 1, 12)
RECORD = "event_id long, available_at timestamp, value_timestamp timestamp, published_at timestamp, extra string"
REASONED = "event_id long, source_id string, available_at timestamp, published_at timestamp"


def late(t, cutoff):
    return t is None or cutoff is None or t > cutoff


def test_audit_against_brute_force(spark):
    rng = random.Random(5)
    near = lambda: None if rng.random() < 0.05 else T0 + dt.timedelta(minutes=rng.randrange(-40, 5))
    cutoffs = {i: None if i == 7 else T0 + dt.timedelta(minutes=rng.randrange(-10, 10)) for i in range(12)}
    who = lambda: 0 if rng.random() < 0.4 else rng.randrange(14)  # noqa: E731  event 0 is hot, 12 and 13 are not audited
    families = {f: [(who(), near(), near(), near(), "x") for _ in range(60)] for f in ("earnings", "peer_news")}
    families["peer_news"] += families["peer_news"][:10]
    reasoned = [(who(), rng.choice(["", None, "a", "b", "c"]), near(), near()) for _ in range(60)]
    reasoning = [(i, cutoffs.get(i) if i % 3 else T0) for i in range(13)]
    cited = [(who(), rng.choice(["a", "b", "c", "d", None])) for _ in range(50)]
    want = {}

    def count(event, family, bad):
        if event in cutoffs:
            n, v = want.get((event, family), (0, 0))
            want[event, family] = n + 1, v + bool(bad)

    for family, rows in families.items():
        for e, *times, _ in rows:
            count(e, family, any(late(t, cutoffs.get(e)) for t in times))
    for e, _, *times in reasoned:
        count(e, "reasoned_company_news", any(late(t, cutoffs.get(e)) for t in times))
    for e, at in reasoning:
        count(e, "event_reasoning", late(at, cutoffs.get(e)) or at != cutoffs.get(e))
    selected = {(e, s) for e, s, *_ in reasoned if s}
    for e, s in {(e, s) for e, s in cited if s is not None}:
        count(e, "reasoning_sources", (e, s) not in selected)

    events = spark.createDataFrame(list(cutoffs.items()), "event_id long, cutoff timestamp")
    audit = au.context_audit(
        events, {f: spark.createDataFrame(rows, RECORD) for f, rows in families.items()},
        {"reasoned_company_news": spark.createDataFrame(reasoned, REASONED)},
        spark.createDataFrame(reasoning, "event_id long, reasoning_cutoff timestamp"), spark.createDataFrame(cited, "event_id long, source_id string")).collect()
    assert {(r["event_id"], r["family"]): (r["checked"], r["violations"]) for r in audit} == want
    assert len(audit) == len(want)


def test_audit_of_nothing(spark):
    events = spark.createDataFrame([(1, T0)], "event_id long, cutoff timestamp")
    none = spark.createDataFrame([], RECORD)
    cited = spark.createDataFrame([(1, "a")], "event_id long, source_id string")
    assert au.context_audit(events, {"earnings": none}).count() == 0
    rows = au.context_audit(events, {"earnings": none}, cited=cited).collect()  # cited, but nothing was selected
    assert [(r["family"], r["checked"], r["violations"]) for r in rows] == [("reasoning_sources", 1, 1)]


def test_leaked_rows_are_refused(spark):
    events = spark.createDataFrame([(1, T0), (2, T0)], "event_id long, cutoff timestamp")
    seen = spark.createDataFrame([(1, T0, T0, None, ""), (2, T0 + dt.timedelta(seconds=1), T0, None, "")], RECORD).drop("published_at")
    leaks = {r["event_id"]: r["leakage_violations"] for r in au.leakage_violations(au.context_audit(events, {"earnings": seen})).collect()}
    assert leaks == {1: 0, 2: 1}
    rows = au.leakage_violations(au.context_audit(events, {"earnings": seen})).selectExpr("event_id", "1L as ticker", "'2024Q2' as quarter", "0.5D as target_percentile", "leakage_violations", "0D as x")
    assert au.row_problems(rows, ["x"]).first()["leakage"] == 1


def test_records_judged_in_place_count_like_joined_ones(spark):
    rng = random.Random(8)
    near = lambda: None if rng.random() < 0.1 else T0 + dt.timedelta(minutes=rng.randrange(-5, 5))
    cutoffs = {i: None if i == 3 else T0 + dt.timedelta(minutes=rng.randrange(-3, 3)) for i in range(9)}
    seen = [(i % 9, [(near(), near()) for _ in range(rng.randrange(4))] or None, [(near(), near())]) for i in range(40)]
    item = "array<struct<available_at: timestamp, value_timestamp: timestamp>>"
    events = spark.createDataFrame(list(cutoffs.items()), "event_id long, cutoff timestamp")
    rows = spark.createDataFrame([(e, cutoffs[e], a, b) for e, a, b in seen], f"event_id long, event_cutoff timestamp, a {item}, b {item}")
    joined = au.context_audit(events, {f: rows.selectExpr("event_id", f"inline({f})") for f in ("a", "b")})
    got = sorted(tuple(r) for r in au.judged(rows, ["a", "b"]).select("event_id", "family", "checked", "violations").collect())
    assert got == sorted(tuple(r) for r in joined.select("event_id", "family", "checked", "violations").collect())
    assert got and au.judged(rows.limit(0), ["a", "b"]).count() == 0
    one = rows.limit(1)
    assert au.judged(one, ["a", "b"], alone=True).collect() == au.judged(one, ["a", "b"]).collect()


def test_the_audit_broadcasts_no_side_that_grows(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.plans import bindings

    at = F.timestamp_seconds(F.lit(1704067200) + F.col("event_id") * 60)
    spark.range(50).select(F.col("id").alias("event_id")).select("event_id", at.alias("cutoff")).write.parquet(f"{tmp_path}/events")
    rows = spark.range(200).select((F.col("id") % 60).alias("event_id"), F.col("id").cast("string").alias("source_id"))
    rows.select("event_id", "source_id", *[at.alias(n) for n in ("available_at", "value_timestamp", "published_at")]).write.parquet(f"{tmp_path}/news")
    spark.range(40).select(F.col("id").alias("o_orderkey"), F.lit("1995-01-01").cast("timestamp_ntz").alias("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(90).select((F.col("id") % 45).alias("l_orderkey"), (F.col("id") % 7).alias("l_suppkey")).write.parquet(f"{tmp_path}/lineitem.parquet")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    try:
        news = spark.read.parquet(f"{tmp_path}/news")
        audit = au.context_audit(spark.read.parquet(f"{tmp_path}/events"), {"news": news}, {"reasoned_news": news.where("event_id % 2 = 0")}, cited=news)
        found = {(r["event_id"], r["family"]): (r["checked"], r["violations"]) for r in audit.collect()}
        trades = bindings.traded(spark, str(tmp_path))
        traded = {(r["event_id"], r["stock"]) for r in trades.collect()}
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (audit, trades)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert not any("BroadcastExchange" in p for p in plans)
    own = {e: sum(i % 60 == e for i in range(200)) for e in range(50)}
    assert found == {(e, "news"): (n, 0) for e, n in own.items()} | {(e, "reasoned_news"): (n, 0) for e, n in own.items() if e % 2 == 0} | {
        (e, "reasoning_sources"): (n, 0 if e % 2 == 0 else n) for e, n in own.items()}
    assert traded == {(e, min(i % 7 for i in (e, e + 45))) for e in range(40)}

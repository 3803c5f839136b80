"""Hand-checked values of the financial lexicon and the numeric rules."""
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv
from tidemark.functions import pit
from tidemark.functions import text as tx
from tidemark.operators import audit, families as fam, gates, joins as jn, metrics as m, ranks as rk, reasoning as rs, series as sr
from tidemark.sources import archive as ar, vendors as vn
from tidemark.streaming import live

ts = datetime.fromisoformat


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def percentiles(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    out = rk.percentile_rank(df.withColumn("g", F.lit(1)), "v", ["g"], "p").orderBy("i").collect()
    return [r["p"] for r in out]


def test_feature_row_has_173_distinct_columns():
    assert len(fv.FEATURES) == len(set(fv.FEATURES)) == 173
    assert not set(fv.FEATURES) & set(fv.FORBIDDEN_FEATURES)


@pytest.mark.parametrize("values,want", [([42.0], [0.5]), ([30.0, 10.0, 20.0], [1, 0, 0.5]), ([1.0, 1.0, 2.0], [0.25, 0.25, 1])])
def test_percentile_rank(spark, values, want):
    assert percentiles(spark, values) == want


@pytest.mark.parametrize("values,want", [([30.0, 10.0, 20.0], [1, 0, 0.5]), ([1.0, 1.0, 2.0], [0.25, 0.25, 1])])
def test_percentile_rank_split(spark, tiny_tasks, values, want):
    spark.conf.set("spark.tidemark.rowsPerTask", "1")
    assert percentiles(spark, values) == want


def test_constant_prediction_has_no_correlation(spark):
    df = spark.createDataFrame([(0.5, 0.1), (0.5, 0.9)], "p double, y double")
    row = m.metric_set(df, "p", "y").first()
    assert row["pearson"] is None and row["spearman"] is None and row["n"] == 2


def test_forward_looking_words(spark):
    flag = lambda t: one(spark, t, lambda c: tx.statement_flags(c)["forward"])
    assert flag("We expect demand to improve.") and not flag("Revenue increased 8% last quarter.")


@pytest.mark.parametrize("text,want", [("$4.2 billion", True), ("28%", True), ("900M", True), ("August 14, 2026", False)])
def test_quantitative(spark, text, want):
    assert one(spark, text, lambda c: tx.statement_flags(c)["quantitative"]) is want


def test_forward_looking_block(spark):
    from tidemark.functions.python_text import direction_score

    facts = ["We expect EPS of $2.00 next year.", "We expect demand to improve.", "We will not raise prices.", "Revenue was flat."]
    df = spark.createDataFrame([(facts,)], "facts array<string>")
    row = fam.with_fls(df, "facts").first()
    assert (row["fls_count"], row["fls_ratio"], row["quant_earnings_fls_count"], row["other_fls_count"]) == (3, 0.75, 1, 2)
    assert (row["positive_forward_count"], row["negative_forward_count"]) == (1, 1)  # "not raise" turns negative
    tones = df.select(direction_score()(F.col("facts")).alias("t")).first()["t"]
    assert tones == [0, 1, -1, 0]


@pytest.mark.parametrize("text,want", [
    ("The company raised its full-year guidance.", 1.0), ("We lowered guidance for the year.", -1.0),
    ("We reaffirmed our guidance.", 0.0), ("Nothing to report.", 0.0)])
def test_guidance_direction(spark, text, want):
    def direction(c):
        g = tx.guidance_flags(c)
        return tx.guidance_direction(g["guidance_raised"], g["guidance_lowered"])

    assert one(spark, text, direction) == want


@pytest.mark.parametrize("text,label,want", [
    ("Revenue missed consensus by 8%.", fv.REVENUE_LABEL, (0.92, 1.0)), ("EPS missed consensus by 12%.", fv.EPS_LABEL, (0.88, 1.0)),
    ("EPS matched consensus.", fv.EPS_LABEL, (1.0, 1.0)), ("EPS of $2.20 vs. consensus $2.00", fv.EPS_LABEL, (2.2, 2.0)),
    ("Revenue of $4.4 billion versus consensus of $4.0 billion", fv.REVENUE_LABEL, (4.4e9, 4.0e9)),
    ("Revenue grew 8% year over year to $3 billion", fv.REVENUE_LABEL, None)])
def test_metric_pairs(spark, text, label, want):
    got = one(spark, text, lambda c: tx.metric_pair(tx.squeeze(c), label))
    assert (got is None) if want is None else (got["reported"], got["consensus"]) == pytest.approx(want)


def test_years_are_not_amounts(spark):
    assert one(spark, "In 2024 we sold 1,250 units for $2024", tx.amounts) == [1250.0, 2024.0]


def test_first_matching_fact_wins(spark):
    df = spark.createDataFrame([(["EPS beat consensus by 10%.", "EPS missed consensus by 5%.", "We raised guidance"],)], "f array<string>")
    got = df.select(tx.disclosure_results(F.col("f")).alias("r")).first()["r"]
    assert got["reported_eps"] == pytest.approx(1.10) and got["direction"] == "raised" and got["reported_revenue"] is None


def test_a_claim_is_read_once_and_as_a_disclosure_of_one_fact(spark):
    lines = ["EPS of $2.20 vs. consensus $2.00", "Revenue missed consensus by 8%.", "EPS and revenue matched estimates", "EPS of $1,250.5 and $2 expected", "sales of 3 million versus expectations of nothing",
             "We raised guidance, EPS of 5 compared with 4.5 estimated", "vs. consensus EPS 2", "EPS in 2024 vs 2023 consensus", "nothing", "", None]
    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumns(tx.line_labels(F.col("line")))
    df = df.withColumn("pair", tx.labelled_pair(F.col("line"), F.col("on_eps"), F.col("on_revenue"))).withColumn("guided", tx.result_guidance(F.col("line")))
    both = df.select("line", tx.line_results(F.col("pair"), F.col("on_eps"), F.col("on_revenue"), F.col("guided")).alias("a"), tx.disclosure_results(F.array("line")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in both) and sum(r["a"]["reported_eps"] is not None for r in both) >= 4
    orders = spark.createDataFrame([(1, 2)], "o_orderkey long, o_custkey long")
    from tidemark.plans import text_news

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(text_news, "table", lambda *_: orders)
        plan = text_news.h25(spark, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") <= 8


def test_amount_parts(spark):
    got = one(spark, "$ 1,250.5 million, -3x 4k €7, 12.5t 1999 2,3,", tx.amounts)
    assert got == [1250.5e6, 4000.0, 7.0, 12.5e12, 23.0]


def test_word_counts_overlap(spark):
    df = spark.createDataFrame([(["We raised it", "weak"],)], "f array<string>")
    row = df.select(*[c.alias(n) for n, c in fam.lexicon_block(F.col("f")).items()]).first()
    assert (row["positive_hits"], row["negative_hits"], row["n_facts"], row["text_length"]) == (2, 1, 2, 17)


def test_message_classes(spark):
    assert one(spark, "Not authorized: symbol not found", tx.classify_message) == "entitlement"
    assert one(spark, "may not be supported", tx.classify_message) == "unsupported_symbol"
    assert one(spark, "x?apikey=abc&y=1 Bearer t.o-k", tx.redact) == "x?apikey=<redacted>&y=1 Bearer=<redacted>"


def test_timestamps(spark):
    fmt = lambda c: F.date_format(pit.parse_instant(c), "yyyy-MM-dd HH:mm:ss")
    assert one(spark, "2026-01-29T21:00:00Z", fmt) == "2026-01-29 21:00:00"
    assert one(spark, "2026-01-29T23:00:00+02:00", fmt) == "2026-01-29 21:00:00"
    assert one(spark, "20260129T2100", fmt) == "2026-01-29 21:00:00"
    assert one(spark, "soon", fmt) is None


def test_calibration_knots(spark):
    knots = spark.createDataFrame([(i, k) for i, k in enumerate([0.1, 0.2, 0.2, 0.2, 0.5])], "knot_index int, knot double")
    asked = spark.createDataFrame([(0.2,), (0.05,), (0.6,)], "s double")
    got = {r["s"]: r["c"] for r in rk.calibrate(asked, "s", knots, "c", (0.05, 0.95)).collect()}
    assert got == {0.2: 0.5, 0.05: 0.05, 0.6: 0.95}
    scan = {r["s"]: r["c"] for r in rk.calibrate_by_scan(asked, "s", knots, "c", (0.05, 0.95)).collect()}
    assert scan == got


def test_knots_are_thinned_evenly(spark):
    values = spark.range(10000).select((F.col("id") / 10000).alias("v"))
    knots = [r["knot"] for r in rk.fit_knots(values, "v", 100).orderBy("knot_index").collect()]
    assert len(knots) == 100 and knots[0] == 0.0 and knots[-1] == 0.9999


def test_prices_only_before_cutoff(spark):
    bars = spark.createDataFrame([("A", ts("2026-01-28 21:00"), ts("2026-01-29"), 100.0, 1.0), ("A", ts("2026-01-29 21:00"), ts("2026-01-30"), 105.0, 1.0),
                                  ("A", ts("2026-02-02 21:00"), ts("2026-02-03"), 110.0, 1.0)],
                                 "k string, value_timestamp timestamp, available_at timestamp, close double, volume double")
    ev = spark.createDataFrame([("A", 1, ts("2026-01-29 21:00"))], "k string, event_id int, cutoff timestamp")
    assert jn.asof(ev, bars, ["k"], "cutoff", "available_at", ["close"]).first()["asof"]["close"] == 100.0


def test_late_revisions_take_the_exact_path(spark):
    rows = [("A", ts(f"2026-01-{d:02d} 21:00"), ts(f"2026-01-{d + 1:02d}"), 100.0 + d, 1.0) for d in range(1, 11)]
    rows[2] = ("A", rows[2][1], ts("2026-01-20"), 300.0, 1.0)  # revised much later
    bars = spark.createDataFrame(rows, "k string, value_timestamp timestamp, available_at timestamp, close double, volume double")
    ev = spark.createDataFrame([("A", 1, ts("2026-01-08 00:00")), ("A", 2, ts("2026-01-25 00:00"))], "k string, event_id int, cutoff timestamp")
    got = {r["event_id"]: r for r in sr.price_context(ev, bars, ["k"], "event_id", "cutoff").collect()}
    assert got[1]["return_1d_pre_event"] == pytest.approx(107 / 106 - 1) and got[1]["return_5d"] == pytest.approx(107 / 101 - 1)
    assert got[1]["max_drawdown_60d"] == 0.0 and got[2]["max_drawdown_60d"] == pytest.approx(104 / 300 - 1)


def test_results_beat_and_miss(spark):
    none = F.array().cast("array<struct<reported_eps:double,consensus_eps:double,reported_revenue:double,consensus_revenue:double>>")
    df = spark.createDataFrame([(-0.10, -0.20, 110.0, 100.0), (0.02, 0.0, 90.0, 100.0)],
                               "reported_eps double, consensus_eps double, reported_revenue double, consensus_revenue double")
    rows = df.select(*[c.alias(f"e_{n}") for n, c in fam.eps_block(none).items()], *[c.alias(f"r_{n}") for n, c in fam.revenue_block(none).items()]).collect()
    assert rows[0]["e_is_eps_beat"] == 1 and rows[0]["e_eps_surprise_percent"] > 0 and rows[0]["r_eps_beat_and_revenue_beat"] == 1
    assert abs(rows[1]["e_eps_surprise_percent"]) < 1 and rows[1]["r_is_revenue_miss"] == 1


def test_archive_drops_a_broken_file_whole(spark, tmp_path):
    good = ('{"event_id":"e1","event_type":"EARNINGS_RELEASE","event_datetime":"2025-08-01T20:00:00Z","focal_assets":[{"identifier_type":"TICKER","identifier_value":"AAA"},'
            '{"identifier_type":"TICKER","identifier_value":"BBB"}],"disclosure":{"items":[{"kind":"facts","content":["x","y"]}]},"event_returns":{"AAA":{"car1":0.05,"return_status":"ok"},'
            '"BBB":{"car1":-0.02,"return_status":"ok"}},"metrics":{"earnings_surprise":{"surprise":0.1,"surprise_status":"missing_eps"}}}')
    (tmp_path / "EARNINGS_RELEASE_2025Q3.jsonl").write_text(good + "\n\n")
    (tmp_path / "EARNINGS_RELEASE_2025Q4.jsonl").write_text(good.replace("e1", "e2") + "\n{broken\n")
    rows = {r["ticker"]: r for r in ar.read_archive(spark, str(tmp_path)).collect()}
    assert set(rows) == {"AAA", "BBB"} and rows["AAA"]["car1"] == 0.05 and rows["BBB"]["car1"] == -0.02
    assert rows["AAA"]["quarter"] == "2025Q3" and rows["AAA"]["earnings_surprise"] is None and rows["AAA"]["disclosure"] == ["x", "y"]
    assert ar.read_archive(spark, str(tmp_path / "absent")).count() == 0


def test_archive_lines_are_parsed_once_and_stay_where_they_are(spark, tmp_path):
    line = '{"event_id":%s,"event_type":null,"quarter":"","focal_assets":[{"identifier_type":"T","identifier_value":"A"},null,{"identifier_type":"T","identifier_value":""},{"identifier_type":"T","identifier_value":"B"}],"event_returns":{"A":{"car1":0.5}}}'
    bare = '{"event_id":"e9","focal_assets":null}'
    (tmp_path / "X_2025Q1.jsonl").write_text("\n".join([line % '"e1"', line % '""', line % "null", bare]) + "\n")
    (tmp_path / "X_2025Q2.jsonl").write_text(line % '"e2"' + "\nnot json\n")
    got = ar.read_archive(spark, str(tmp_path))
    rows = sorted(got.select("event_id", "ticker", "event_type", "disclosure", "car1", "quarter").collect())
    assert [tuple(r) for r in rows] == [("e1", "A", "UNKNOWN", [], 0.5, "2025Q1"), ("e1", "B", "UNKNOWN", [], None, "2025Q1")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    read = plan.split("BroadcastExchange")[0]  # the files left out are few
    assert "from_json" not in plan and "Exchange" not in read


def test_vendor_prices_prefer_adjusted_and_drop_bad(spark):
    p = spark.createDataFrame([("a", '[{"date":"2026-01-28T00:00:00.000Z","close":10,"adjClose":5,"volume":7},{"date":"bad","close":1}]')], "ticker string, payload string")
    row = vn.tiingo_prices(p).collect()
    assert len(row) == 1 and row[0]["close"] == 5.0 and str(row[0]["available_at"]) == "2026-01-29 00:00:00"
    q = spark.createDataFrame([("a", '{"values":[{"datetime":"2026-01-28","close":"0"},{"datetime":"2026-01-29","close":"3"}]}')], "ticker string, payload string")
    assert [r["close"] for r in vn.twelve_data_prices(q).collect()] == [3.0]


def test_training_rows_refuse_problems(spark, tmp_path):
    rows = spark.createDataFrame([("e", "t", "2025Q4", 1.5, None, 0, 1.0)],
                                 "event_id string, ticker string, quarter string, target_percentile double, surprise_percentile double, leakage_violations int, x double")
    with pytest.raises(ValueError, match="target_out_of_range"):
        ar.write_training_rows(rows, str(tmp_path / "a"), ["x"])
    with pytest.raises(ValueError, match="missing"):
        ar.write_training_rows(rows, str(tmp_path / "b"), ["x", "z"])


def test_leakage_guard(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "fls_ratio double, car1 double")
    with pytest.raises(ValueError, match="car1"):
        audit.assert_no_leakage(df)


def test_scenarios_raise_every_signal(spark):
    from tidemark.plans.modelling import scenario_rows

    rows = {r["label"]: r for r in scenario_rows(spark).collect()}
    assert rows["positive"]["reasoning_overall_event_signal"] > 0 > rows["negative"]["reasoning_overall_event_signal"]
    assert all(r["parsed"] and r["fls_nonzero"] == 0 for r in rows.values())
    checked = scenario_rows(spark).select(rs.out_of_range().alias("bad")).agg(F.sum("bad").alias("b")).first()["b"]
    assert checked == 0


def test_realism_gate_needs_order_and_spread(spark):
    rows = [("a", "negative", 0.4, 0.2, 0, True), ("a", "neutral", 0.5, 0.5, 0, True), ("a", "positive", 0.6, 0.8, 0, True),
            ("b", "negative", 0.6, 0.8, 0, True), ("b", "neutral", 0.5, 0.5, 0, True), ("b", "positive", 0.4, 0.2, 0, True)]
    df = spark.createDataFrame(rows, "c string, label string, raw double, submitted double, fls_nonzero int, parsed boolean")
    got = {r["c"]: r["passed"] for r in gates.realism_gate(df, "c", 100).collect()}
    assert got == {"a": True, "b": False}


def test_gate_fails_without_holdout(spark):
    ev = spark.createDataFrame([(0.05, None, False, 0.1, 0.2, True, *[True] * 6)],
                               "validation_gain double, holdout_regression double, holdout_available boolean, prediction_std double, near_half double, keeps_ranking boolean, "
                               + ", ".join(f"{n} boolean" for n in gates.EXTERNAL_CHECKS))
    row = gates.promoted(gates.promotion_checks(ev)).first()
    assert not row["promoted"] and row["failed"] == "holdout_available,holdout_regression_ok"


def test_late_and_first(spark):
    df = spark.createDataFrame([(1, ts("2026-01-01 00:05:01"), "b"), (1, ts("2026-01-01 00:01:00"), "a")], "e int, at timestamp, who string")
    tagged = df.withColumn("t", live.lateness(F.col("at"), F.lit("2026-01-01 00:05:00").cast("timestamp")))
    row = live.first_submission(tagged, "e", "at", "who").first()
    assert row["who"] == "a" and row["t"] == "on_time"

"""Registered queries: coverage, validation, audit, planning and data quality
(B11, B16-B19, D16-D23, D27, D29-D31)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv
from tidemark.functions import pit
from tidemark.operators import audit as au
from tidemark.operators import families as fam
from tidemark.operators import metrics as m
from tidemark.plans.bindings import BARS_SQL, FOCAL_SQL, TRADED_SQL, bars, focal, traded
from tidemark.plans.catalog import query, r6
from tidemark.plans.evaluation import LABELLED_SQL, labelled
from tidemark.plans.text_news import LOG_SQL, news_hits, provider_log
from tidemark.plans.text_news import NEWS_SQL
from tidemark.session import table, with_one_row

FLAGS = {"eps": "has_eps_surprise", "price": "has_5y_price_history", "company_news": "has_company_news", "reasoning": "has_reasoning",
         "history": "has_company_earnings_history"}


def flagged(spark, d) -> DataFrame:
    """Labelled events with availability flags derived from their columns."""
    k = F.col("event_id")
    return labelled(spark, d).withColumns({
        "has_eps_surprise": fam.flag(F.col("reported_eps").isNotNull() & F.col("consensus_eps").isNotNull()),
        "has_5y_price_history": fam.flag(k % 4 == 0), "has_company_news": fam.flag(k % 6 == 0),
        "has_reasoning": fam.flag(k % 3 == 0), "has_company_earnings_history": fam.flag(k % 2 == 0)})


FLAG_SQL = LABELLED_SQL + """, fl AS (SELECT *, CAST(reported_eps IS NOT NULL AND consensus_eps IS NOT NULL AS INT) AS f_eps, CAST(event_id % 4 = 0 AS INT) AS f_price,
  CAST(event_id % 6 = 0 AS INT) AS f_news, CAST(event_id % 3 = 0 AS INT) AS f_reason, CAST(event_id % 2 = 0 AS INT) AS f_hist FROM labelled)"""


EVENT_COLUMNS = ("event_id", "ticker", "event_type", "cutoff", "quarter", "car1", "earnings_surprise", "reported_eps",
                 "consensus_eps", "reported_revenue", "consensus_revenue", "score")


@query("b11_leakage_guard", f"WITH {FOCAL_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS name, count({c}) AS known, {str(c in ('car1', 'earnings_surprise')).lower()} AS forbidden FROM focal" for c in EVENT_COLUMNS))
def b11(spark, d):
    """Which columns of the event table a model must never see, and how many
    values would have leaked."""
    f = focal(spark, d)
    bad = set(au.forbidden_columns(f.columns, fv.FORBIDDEN_TEXT_FEATURES))
    counted = f.agg(*[F.count(c).alias(c) for c in f.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("known"), F.lit(c in bad).alias("forbidden")) for c in f.columns])
    return counted.select(F.explode(rows).alias("r")).select("r.*")


@query("b16_evidence_gate", f"WITH {FLAG_SQL} SELECT event_id, f_eps + f_price + f_news > 0 AS has_evidence FROM fl")
def b16(spark, d):
    return flagged(spark, d).select("event_id", pit.has_evidence(("has_eps_surprise", "has_5y_price_history", "has_company_news")).alias("has_evidence"))


@query("b18_drop_constant_columns", """SELECT 'l_quantity,l_extendedprice,l_discount,l_tax' AS kept, (SELECT count(*) FROM lineitem) AS rows""")
def b18(spark, d):
    li = table(spark, d, "lineitem").withColumns({"flat": F.lit(3.0), "nearly": F.lit(1.0)})
    names = ["l_quantity", "flat", "l_extendedprice", "l_discount", "nearly", "l_tax"]
    kept = au.varying(li, names)
    return li.select(*kept).agg(F.lit(",".join(kept)).alias("kept"), F.count(F.lit(1)).alias("rows"))


#: The flags as SQL names them, in the order of FLAGS.
VARYING_FLAGS = dict(zip(FLAGS, ("f_eps", "f_price", "f_news", "f_reason", "f_hist")))
VARYING_SQL = ", ".join(f"CASE WHEN stddev_pop({c}) > 1e-12 THEN '{n}' END" for n, c in VARYING_FLAGS.items())


@query("d16_training_data_report", f"""WITH {FLAG_SQL} SELECT coalesce(quarter, 'all') AS quarter, count(*) AS rows,
  {', '.join(f'round(avg({c}), 6) + 0.0 AS {n}' for n, c in (('eps', 'f_eps'), ('price', 'f_price'), ('company_news', 'f_news'), ('reasoning', 'f_reason'), ('history', 'f_hist')))},
  round(min(realized), 6) + 0.0 AS target_min, round(max(realized), 6) + 0.0 AS target_max, round(CASE WHEN count(*) >= 2 THEN stddev_pop(realized) END, 6) + 0.0 AS target_std,
  concat_ws(',', {VARYING_SQL}) AS varying, {' + '.join(f'CAST(stddev_pop({c}) > 1e-12 AS BIGINT)' for c in VARYING_FLAGS.values())} AS n_varying
FROM fl GROUP BY GROUPING SETS ((quarter), ())""")
def d16(spark, d):
    n = F.count(F.lit(1))
    aggs = [n.alias("rows"), *au.coverage(FLAGS), F.min("realized").alias("target_min"), F.max("realized").alias("target_max"),
            F.when(n >= 2, F.stddev_pop("realized")).alias("target_std"), au.varying_in_group(FLAGS).alias("varying")]
    report = flagged(spark, d).rollup("quarter").agg(*aggs).withColumn("quarter", F.coalesce("quarter", F.lit("all")))
    return report.withColumns({"n_varying": F.size("varying").cast("bigint"), "varying": F.array_join("varying", ",")})


@query("d17_coverage_gate", f"""WITH {FLAG_SQL}, c AS (SELECT avg(f_eps) AS eps, avg(f_news) AS company_news, avg(f_reason) AS reasoning, avg(f_price) AS price FROM fl)
SELECT family, round(coverage, 6) + 0.0 AS coverage, minimum, coverage >= minimum AS passed FROM (SELECT 'eps' AS family, eps AS coverage, 0.3::DOUBLE AS minimum FROM c
 UNION ALL SELECT 'company_news', company_news, 0.2 FROM c UNION ALL SELECT 'reasoning', reasoning, 0.2 FROM c UNION ALL SELECT 'price', price, 0.5 FROM c)""")
def d17(spark, d):
    return au.coverage_gate(flagged(spark, d).agg(*au.coverage(FLAGS)))


@query("d18_coverage_buckets", f"""WITH {FLAG_SQL} SELECT 'fls' || CASE WHEN f_hist > 0 THEN '+history' ELSE '' END || CASE WHEN f_price > 0 THEN '+price' ELSE '' END || CASE WHEN f_reason > 0 THEN '+reasoning' ELSE '' END AS bucket,
  count(*) AS n, CASE WHEN count(*) >= 30 THEN round(corr(score, realized), 6) + 0.0 END AS pearson,
  CASE WHEN count(*) >= 30 THEN round(avg(abs(score - realized)), 6) + 0.0 END AS mae FROM fl GROUP BY 1""")
def d18(spark, d):
    """Every bucket with its size; metrics only from 30 rows on."""
    rows = flagged(spark, d).withColumn("bucket", au.coverage_label())
    p, y = F.col("score"), F.col("realized")
    n = F.count(F.lit(1))
    return rows.groupBy("bucket").agg(n.alias("n"), F.when(n >= 30, m.safe_corr(p, y)).alias("pearson"), F.when(n >= 30, F.avg(F.abs(p - y))).alias("mae"))


@query("d19_row_validation", """SELECT (SELECT CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)) AS duplicate_keys,
  count(*) FILTER (WHERE l_returnflag = 'R') AS missing_quarter, count(*) FILTER (WHERE l_discount * 12 > 1) AS target_out_of_range,
  count(*) FILTER (WHERE l_partkey % 10 = 0) AS leakage, count(*) FILTER (WHERE l_quantity > 49) AS non_finite FROM lineitem""")
def d19(spark, d):
    rows = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("ticker"), F.when(F.col("l_returnflag") != "R", "q").alias("quarter"),
        (F.col("l_discount") * 12).alias("target_percentile"), F.when(F.col("l_partkey") % 10 == 0, 1).otherwise(0).alias("leakage_violations"),
        F.when(F.col("l_quantity") > 49, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("x"))
    return au.row_problems(rows, ["x"])


@query("d20_point_in_time_audit", f"""WITH {NEWS_SQL}, {TRADED_SQL}, {BARS_SQL}, p AS (SELECT t.cutoff, b.available_at, b.value_timestamp FROM traded t ASOF JOIN bars b ON t.stock = b.stock AND t.cutoff >= b.value_timestamp)
SELECT 'news' AS family, count(*) AS checked, count(*) FILTER (WHERE available_at > cutoff OR published_at > cutoff) AS violations FROM hit UNION ALL
SELECT 'prices', count(*), count(*) FILTER (WHERE available_at > cutoff OR value_timestamp > cutoff) FROM p""")
def d20(spark, d):
    """Prices are picked by session time on purpose, so late availability shows."""
    from tidemark.operators.joins import asof

    news = news_hits(spark, d, "source").withColumn("value_timestamp", F.col("published_at"))
    hit = asof(traded(spark, d), bars(spark, d), ["stock"], "cutoff", "value_timestamp", ["value_timestamp", "available_at"])
    prices = hit.where(F.col("asof").isNotNull()).select("cutoff", "asof.value_timestamp", "asof.available_at")
    return au.availability_violations({"news": news, "prices": prices})


def ticker_demand(spark, d) -> DataFrame:
    return focal(spark, d).groupBy(F.upper(F.concat(F.lit("t"), F.col("ticker").cast("string"))).alias("ticker")).agg(
        F.count(F.lit(1)).alias("row_count"), F.min("cutoff").alias("first_cutoff"), F.max("cutoff").alias("last_cutoff"))


@query("d21_ticker_demand", f"""WITH {FOCAL_SQL} SELECT 'T' || ticker AS ticker, count(*) AS row_count, strftime(min(cutoff), '%Y-%m-%d') AS first_cutoff, strftime(max(cutoff), '%Y-%m-%d') AS last_cutoff,
  strftime(min(cutoff) - INTERVAL 1875 DAY, '%Y-%m-%d') AS fetch_start FROM focal GROUP BY ticker""")
def d21(spark, d):
    t = ticker_demand(spark, d)
    day = lambda c, n: F.date_format(c, "yyyy-MM-dd").alias(n)
    return t.select("ticker", "row_count", day("first_cutoff", "first_cutoff"), day("last_cutoff", "last_cutoff"),
                    day(F.col("first_cutoff") - F.expr(f"INTERVAL {fv.PRICE_LOOKBACK_DAYS} DAYS"), "fetch_start"))


def stock_demand(spark, d) -> DataFrame:
    return traded(spark, d).groupBy("stock").agg(F.count(F.lit(1)).alias("row_count"), F.min("cutoff").alias("first_cutoff"))


def coverage_status(demand: DataFrame, series: DataFrame, key: str, needed: int) -> DataFrame:
    """Session counts per key, whether usable, and history at the first cutoff."""
    at_first = F.count(F.when(F.col("available_at") <= F.col("first_cutoff"), 1))
    joined = demand.select(key, "row_count", "first_cutoff").join(series.select(key, "available_at"), key, "left")
    return joined.groupBy(key, "row_count").agg(F.count("available_at").alias("sessions"), at_first.alias("__first")).select(
        key, "row_count", "sessions", (F.col("sessions") >= fv.MIN_USABLE_SESSIONS).alias("covered"),
        ((F.col("sessions") >= fv.MIN_USABLE_SESSIONS) & (F.col("__first") >= needed)).alias("long_history"))


PLAN_SQL = TRADED_SQL + ", " + BARS_SQL + """, dem AS (SELECT stock, count(*) AS row_count, min(cutoff) + INTERVAL 700 DAY AS first_cutoff FROM traded GROUP BY stock),
ser AS (SELECT * FROM bars WHERE NOT (stock % 3 = 0 AND day > TIMESTAMP '1995-03-01')),
st AS (SELECT d.stock, d.row_count, count(s.stock) AS sessions, count(s.stock) >= 30 AS covered, count(s.stock) >= 30 AND count(*) FILTER (WHERE s.available_at <= d.first_cutoff) >= 150 AS long_history
  FROM dem d LEFT JOIN ser s USING (stock) GROUP BY d.stock, d.row_count)"""


def planned(spark, d) -> DataFrame:
    dem = stock_demand(spark, d).withColumn("first_cutoff", F.col("first_cutoff") + F.expr("INTERVAL 700 DAYS"))
    ser = bars(spark, d).where("NOT (stock % 3 = 0 AND day > timestamp'1995-03-01')")
    return coverage_status(dem, ser, "stock", 150)


@query("d22_coverage_status", f"WITH {PLAN_SQL} SELECT * FROM st")
def d22(spark, d):
    return planned(spark, d)


@query("d23_backfill_plan", f"""WITH {PLAN_SQL}, x AS (SELECT *, CASE WHEN covered THEN 'covered' WHEN s_acctbal < 1000 THEN 'blocked' ELSE 'needed' END AS state FROM st JOIN supplier ON s_suppkey = stock)
SELECT state, count(*) AS tickers, CAST(sum(row_count) AS BIGINT) AS rows, count(*) FILTER (WHERE long_history) AS long_tickers FROM x GROUP BY state""")
def d23(spark, d):
    blocked = table(spark, d, "supplier").where("s_acctbal < 1000").select(F.col("s_suppkey").alias("stock"), F.lit(True).alias("unsupported"))
    st = planned(spark, d).join(blocked, "stock", "left")
    state = F.when(F.col("covered"), "covered").when(F.col("unsupported"), "blocked").otherwise("needed")
    return st.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("tickers"), F.sum("row_count").alias("rows"),
                                                F.count(F.when(F.col("long_history"), 1)).alias("long_tickers"))


@query("d27_standardisation", """SELECT name, round(avg(v), 6) + 0.0 AS mean, round(CASE WHEN stddev_pop(v) <= 1e-12 THEN 1 ELSE stddev_pop(v) END, 6) + 0.0 AS sd FROM (
  SELECT unnest(['quantity', 'price', 'discount', 'flat']) AS name, unnest([l_quantity, l_extendedprice, l_discount, 2.0]) AS v FROM lineitem) GROUP BY name""")
def d27(spark, d):
    from tidemark.operators.models import standardisation

    li = table(spark, d, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
                                            F.col("l_discount").alias("discount"), F.lit(2.0).alias("flat"))
    return standardisation(li, ["quantity", "price", "discount", "flat"])


@query("d29_enrichment_report", f"""WITH {FLAG_SQL} SELECT count(*) AS rows, CAST(sum(f_eps) AS BIGINT) AS eps_matches, CAST(sum(f_news) AS BIGINT) AS rows_with_company_news,
  CAST(sum(f_reason) AS BIGINT) AS rows_with_reasoning, CAST(sum(f_price) AS BIGINT) AS rows_with_prices, round(avg(f_hist), 6) + 0.0 AS history FROM fl""")
def d29(spark, d):
    on = lambda c: F.count(F.when(F.col(c) > 0, 1))
    return flagged(spark, d).agg(
        F.count(F.lit(1)).alias("rows"), on("has_eps_surprise").alias("eps_matches"), on("has_company_news").alias("rows_with_company_news"),
        on("has_reasoning").alias("rows_with_reasoning"), on("has_5y_price_history").alias("rows_with_prices"),
        m.share(F.col("has_company_earnings_history") > 0).alias("history"))


@query("d30_feed_diagnostics", """SELECT user_id, count(*) AS receipts, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type <> 'error') AS ok,
  count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM events GROUP BY user_id""")
def d30(spark, d):
    kind = lambda t: F.count(F.when(F.col("event_type") == t, 1))
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("receipts"), kind("error").alias("errors"), F.count(F.when(F.col("event_type") != "error", 1)).alias("ok"),
        kind("click").alias("clicks"), kind("purchase").alias("purchases"))


@query("d31_archive_quality", f"""WITH {FOCAL_SQL} SELECT count(*) - count(DISTINCT event_id) AS duplicate_ids,
  (SELECT count(*) FROM (SELECT ticker, cutoff FROM focal GROUP BY ALL HAVING count(*) > 1)) AS duplicate_times,
  (SELECT count(*) FROM (SELECT ts < lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS back FROM events) WHERE back) AS backward_steps,
  count(*) FILTER (WHERE earnings_surprise IS NULL AND car1 IS NOT NULL) AS status_without_value FROM focal""")
def d31(spark, d):
    f = focal(spark, d)
    ids = f.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_ids"))
    times = f.groupBy("ticker", "cutoff").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias("duplicate_times"))
    e = table(spark, d, "events")
    from tidemark.operators.scan import rolling

    steps = rolling(e.select("user_id", "event_id", F.timestamp_seconds("event_id").alias("o"), "ts"), ["user_id"], "o", 1,
                    lambda df, parts: df.withColumn("back", F.col("ts") < F.lag("ts").over(Window.partitionBy(*parts).orderBy("o"))))
    back = steps.agg(F.count(F.when(F.col("back"), 1)).alias("backward_steps"))
    status = f.agg(F.count(F.when(F.col("earnings_surprise").isNull() & F.col("car1").isNotNull(), 1)).alias("status_without_value"))
    return with_one_row(with_one_row(with_one_row(ids, times), back), status)

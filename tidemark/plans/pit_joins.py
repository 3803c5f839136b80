"""Registered queries: predicates, point-in-time joins, series and history
(B04-B10, B14-B16, C01-C17, E04-E10, E15-E16, D01-D07, H17, H23, H30)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv
from tidemark.functions import pit
from tidemark.operators import families as fam
from tidemark.operators import joins as jn
from tidemark.operators import series as sr
from tidemark.operators.ranks import top_in_group
from tidemark.operators.scan import largest_group
from tidemark.plans.bindings import BARS_SQL, FOCAL_SQL, TRADED_SQL, bars, focal, traded
from tidemark.plans.catalog import query, r6
from tidemark.plans.evaluation import SUR_SQL, labelled
from tidemark.plans.history import archive_history
from tidemark.session import table


def stamp(c, name):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)


# --------------------------------------------------------------------------
# predicates and row expressions
# --------------------------------------------------------------------------
@query("b04_status_gated_value", """SELECT o_orderkey AS event_id,
  CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice, 6) + 0.0 END AS surprise FROM orders""")
def b04(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("event_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).alias("surprise"))


@query("b05_labelled_rows", f"WITH {FOCAL_SQL} SELECT event_id, {r6('car1')} FROM focal WHERE car1 IS NOT NULL")
def b05(spark, d):
    return focal(spark, d).where(F.col("car1").isNotNull()).select("event_id", "car1")


@query("b06_event_type_allow_list", f"""WITH {FOCAL_SQL} SELECT event_id, event_type FROM focal
  WHERE event_type IN ('EARNINGS_RELEASE') AND cutoff IS NOT NULL AND car1 IS NOT NULL""")
def b06(spark, d):
    return focal(spark, d).where(
        F.col("event_type").isin("EARNINGS_RELEASE") & F.col("cutoff").isNotNull() & F.col("car1").isNotNull()
    ).select("event_id", "event_type")


@query("b07_timestamp_parse", """SELECT event_id,
  CASE WHEN event_id % 5 = 4 THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS parsed FROM events""")
def b07(spark, d):
    at, k = F.col("ts").cast("timestamp"), F.col("event_id") % 5
    raw = (F.when(k == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format(at, "yyyyMMdd'T'HHmmss"))
           .when(k == 2, F.date_format(at + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss'+02:00'"))
           .when(k == 3, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).otherwise(F.concat(F.lit("n/a "), F.col("event_type"))))
    return table(spark, d, "events").select("event_id", stamp(pit.parse_instant(raw), "parsed"))


@query("b08_availability_predicates", f"""WITH {TRADED_SQL}, {BARS_SQL}
SELECT b.stock, count(*) FILTER (WHERE b.available_at <= c.cutoff) AS inclusive, count(*) FILTER (WHERE b.available_at < c.cutoff) AS strict
FROM bars b JOIN (SELECT stock, date_trunc('day', min(cutoff)) + INTERVAL 500 DAY AS cutoff FROM traded GROUP BY stock) c USING (stock) GROUP BY b.stock""")
def b08(spark, d):
    first = traded(spark, d).groupBy("stock").agg(
        (F.date_trunc("day", F.min("cutoff")) + F.expr("INTERVAL 500 DAYS")).alias("cutoff"))
    both = bars(spark, d).join(first, "stock")
    on = [pit.available(F.col("available_at"), F.col("cutoff"), x).cast("int") for x in (True, False)]
    return both.groupBy("stock").agg(F.sum(on[0]).alias("inclusive"), F.sum(on[1]).alias("strict"))


@query("b09_eligible_prices", f"""WITH {BARS_SQL}, {TRADED_SQL}, stamped AS (SELECT * REPLACE (CASE WHEN stock % 3 = 0 THEN day + INTERVAL 15 HOUR ELSE available_at END AS available_at) FROM bars WHERE close > 1500)
SELECT event_id, count(*) FILTER (WHERE available_at <= cutoff) AS eligible, count(*) FILTER (WHERE available_at <= cutoff AND value_timestamp <= cutoff) AS eligible_strict
FROM traded LEFT JOIN stamped USING (stock) GROUP BY event_id""")
def b09(spark, d):
    """Bars seen by each event; strictly those whose session had ended too. A third of the stocks stamp bars before their session ends."""
    from tidemark.operators.scan import Running, running

    stamped = bars(spark, d).where("close > 1500").withColumn(
        "available_at", F.when(F.col("stock") % 3 == 0, F.col("day") + F.expr("INTERVAL 15 HOURS")).otherwise(F.col("available_at")))
    seen = lambda at, loose: stamped.select("stock", at.alias("at"), F.lit(loose).alias("loose"), F.lit(1 - loose).alias("strict"))
    points = seen(F.col("available_at"), 1).unionByName(seen(F.greatest("available_at", "value_timestamp"), 0))
    both = jn.timeline(points, traded(spark, d), ["stock"], F.col("at"), F.col("cutoff"), ["loose", "strict"])
    sums = [Running("sum", F.col(f"__point.{n}").cast("bigint"), out) for n, out in (("loose", "eligible"), ("strict", "eligible_strict"))]
    done = running(both, ["stock"], ["__t", "__tag"], sums).where(F.col("__tag") == 1)
    return done.select("__query.event_id", *[F.coalesce(n, F.lit(0)).cast("bigint").alias(n) for n in ("eligible", "eligible_strict")])


@query("b14_clip_to_bounds", f"WITH {FOCAL_SQL} SELECT event_id, round(greatest(-0.1, least(0.1, car1)), 6) + 0.0 AS clipped FROM focal WHERE car1 IS NOT NULL")
def b14(spark, d):
    return focal(spark, d).where(F.col("car1").isNotNull()).select("event_id", pit.clip(F.col("car1"), -0.1, 0.1).alias("clipped"))


@query("b15_test_event_short_circuit", """SELECT event_id, asset, CASE WHEN event_type = 'signup' THEN 0.5 END AS predicted_percentile
FROM (SELECT event_id, event_type, unnest([user_id, user_id + 1000]) AS asset FROM events)""")
def b15(spark, d):
    e = table(spark, d, "events").withColumn("asset", F.explode(F.array("user_id", F.col("user_id") + 1000)))
    return e.select("event_id", "asset", F.when(F.col("event_type") == "signup", F.lit(0.5)).alias("predicted_percentile"))


@query("h17_recency_decay", """SELECT event_id, round(exp(-greatest(0.0, (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / CAST(3600000000 AS DOUBLE)) / 72.0), 6) + 0.0 AS recency FROM events""")
def h17(spark, d):
    return table(spark, d, "events").select(
        "event_id", pit.recency(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp")).alias("recency"))


@query("h22_quarter_windows", f"""WITH {FOCAL_SQL}, q AS (SELECT DISTINCT quarter, make_date(CAST(quarter[1:4] AS INT), CAST(quarter[6:6] AS INT) * 3 - 2, 1) AS s FROM focal),
w AS (SELECT quarter, unnest(generate_series(CAST(s AS TIMESTAMP), CAST(s + INTERVAL 3 MONTH AS TIMESTAMP) - INTERVAL 1 SECOND, INTERVAL 14 DAY)) AS st, CAST(s + INTERVAL 3 MONTH AS TIMESTAMP) AS e FROM q)
SELECT quarter, strftime(st, '%Y-%m-%d %H:%M:%S') AS window_start,
  strftime(least(e, st + INTERVAL 14 DAY) - INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS window_end FROM w""")
def h22(spark, d):
    q = focal(spark, d).select("quarter").distinct()
    w = q.select("quarter", F.explode(pit.quarter_windows(F.col("quarter"), 14)).alias("w"))
    return w.select("quarter", stamp(F.col("w.start"), "window_start"), stamp(F.col("w.end"), "window_end"))


@query("h23_safe_ratios", f"""WITH {FOCAL_SQL} SELECT event_id,
  round((reported_eps - consensus_eps) / greatest(abs(consensus_eps), 0.05), 6) + 0.0 AS eps_ratio,
  round(coalesce((reported_eps + consensus_eps) / 2, reported_eps, consensus_eps), 6) + 0.0 AS mid FROM focal""")
def h23(spark, d):
    r, c = F.col("reported_eps"), F.col("consensus_eps")
    return focal(spark, d).select("event_id", pit.ratio(r, c, fv.EPS_FLOOR).alias("eps_ratio"), pit.middle(r, c).alias("mid"))


@query("h30_seconds_to_deadline", """SELECT event_id,
  round((epoch_us(date_trunc('hour', ts) + INTERVAL 5 MINUTE) - epoch_us(ts)) / CAST(1000000 AS DOUBLE), 6) + 0.0 AS seconds_left FROM events""")
def h30(spark, d):
    at = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select(
        "event_id", pit.seconds_left(F.date_trunc("hour", at) + F.expr("INTERVAL 5 MINUTES"), at).alias("seconds_left"))


@query("h28_confidence_label", f"""WITH {FOCAL_SQL} SELECT event_id, CASE WHEN event_id % 4 <= 1 OR abs(score - 0.5) < 0.05 THEN 'low'
  WHEN abs(score - 0.5) < 0.15 THEN 'medium' ELSE 'high' END AS confidence FROM focal""")
def h28(spark, d):
    return focal(spark, d).select("event_id", pit.confidence_label(
        F.col("score"), F.lit(None).cast("double"), F.col("event_id") % 4).alias("confidence"))


# --------------------------------------------------------------------------
# equi joins
# --------------------------------------------------------------------------
@query("c01_rows_to_events", f"""WITH {FOCAL_SQL} SELECT l_orderkey, l_linenumber, l_partkey, quarter, round(score, 6) + 0.0 AS score
FROM lineitem LEFT JOIN (SELECT * FROM focal WHERE event_type = 'EARNINGS_RELEASE') ON event_id = l_orderkey""")
def c01(spark, d):
    f = focal(spark, d).where("event_type = 'EARNINGS_RELEASE'").select("event_id", "quarter", "score")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return li.join(f, F.col("l_orderkey") == F.col("event_id"), "left").drop("event_id")


@query("c02_label_attach", f"""WITH {SUR_SQL}
SELECT event_id, {r6('realized', 'surprise_percentile')} FROM labelled LEFT JOIN sur USING (event_id)""")
def c02(spark, d):
    from tidemark.operators.ranks import percentile_rank

    return percentile_rank(labelled(spark, d), "earnings_surprise", ["quarter"], "surprise_percentile").select(
        "event_id", "realized", "surprise_percentile")


# --------------------------------------------------------------------------
# history joins and aggregates
# --------------------------------------------------------------------------
@query("c03_prior_company_history", f"""WITH {FOCAL_SQL}
SELECT e.event_id, count(p.event_id) AS prior_count, round(coalesce(avg(p.car1), 0), 6) + 0.0 AS prior_mean,
  round(CASE WHEN count(p.car1) >= 2 THEN stddev_pop(p.car1) ELSE 0 END, 6) + 0.0 AS prior_std,
  round(coalesce(avg(CASE WHEN p.car1 > 0 THEN 1.0 WHEN p.car1 IS NOT NULL THEN 0.0 END), 0), 6) + 0.0 AS positive_rate,
  round(coalesce(avg(CASE WHEN p.car1 < 0 THEN 1.0 WHEN p.car1 IS NOT NULL THEN 0.0 END), 0), 6) + 0.0 AS negative_rate
FROM focal e LEFT JOIN focal p ON p.ticker = e.ticker AND p.event_type = 'EARNINGS_RELEASE' AND p.car1 IS NOT NULL
  AND p.cutoff < e.cutoff AND p.cutoff + INTERVAL 2 DAY <= e.cutoff AND p.event_id <> e.event_id GROUP BY e.event_id""")
def c03(spark, d):
    return fam.prior_reactions(focal(spark, d), "ticker", "event_id", "cutoff", "car1",
                               F.col("event_type") == "EARNINGS_RELEASE").select(
        "event_id", "prior_count", "prior_mean", "prior_std", "positive_rate", "negative_rate")


def cached_history(spark, d, limit: int = 40) -> DataFrame:
    """Focal events with the last records of their ticker: figures visible a day
    after the event, reactions two days after, else masked; both strictly before the cutoff."""
    f = focal(spark, d)
    points = f.select("ticker", F.col("cutoff").alias("value_timestamp"), "reported_eps", "consensus_eps",
                      "reported_revenue", "consensus_revenue", F.col("car1").alias("abnormal_return"),
                      F.col("event_id").alias("record_id"))
    payload = ["reported_eps", "consensus_eps", "reported_revenue", "consensus_revenue", "abnormal_return", "record_id"]
    packed = jn.recent_history(f, points, ["ticker"], "cutoff", "value_timestamp",
                               F.col("value_timestamp") + F.expr("INTERVAL 1 DAY"), payload, limit, strict_available=True)
    reaction_at = lambda r: r["value_timestamp"] + F.expr("INTERVAL 2 DAYS")
    return packed.withColumn("history", F.transform("history", lambda r: r.withField(
        "abnormal_return", F.when(pit.reaction_available(r["abnormal_return"], reaction_at(r), F.col("cutoff")), r["abnormal_return"]))))


def history_sql(limit: int | None = None) -> str:
    """Visible earlier records of every event; ``limit`` keeps the last ones, as the live cache does."""
    last = f"QUALIFY back <= {limit}" if limit else ""
    return FOCAL_SQL + f""", hist AS (
  SELECT e.event_id, p.event_id AS record_id, p.cutoff AS value_timestamp, p.reported_eps AS h_re, p.consensus_eps AS h_ce,
    p.reported_revenue AS h_rr, p.consensus_revenue AS h_cr,
    CASE WHEN p.cutoff + INTERVAL 2 DAY < e.cutoff THEN p.car1 END AS y,
    (p.reported_eps - p.consensus_eps) / greatest(abs(p.consensus_eps), 0.05) AS hs_e,
    (p.reported_revenue - p.consensus_revenue) / greatest(abs(p.consensus_revenue), 1.0) AS hs_r,
    row_number() OVER (PARTITION BY e.event_id ORDER BY p.cutoff DESC, p.reported_eps DESC NULLS LAST, p.consensus_eps DESC NULLS LAST,
      p.reported_revenue DESC NULLS LAST, p.consensus_revenue DESC NULLS LAST) AS back
  FROM focal e JOIN focal p ON p.ticker = e.ticker AND p.cutoff + INTERVAL 1 DAY < e.cutoff
  {last}),
cur AS (SELECT *, (reported_eps - consensus_eps) / greatest(abs(consensus_eps), 0.05) AS ce,
   (reported_revenue - consensus_revenue) / greatest(abs(consensus_revenue), 1.0) AS cr FROM focal)"""


HIST_SQL = history_sql()


@query("c14_reaction_gating", f"""WITH {history_sql(40)}
SELECT event_id, count(*) AS records, count(y) AS usable_reactions, round(sum(y), 6) + 0.0 AS reaction_sum FROM hist GROUP BY event_id""")
def c14(spark, d):
    h = F.col("history")
    usable = fam.present(h, lambda r: r["abnormal_return"])
    return cached_history(spark, d).where(F.size(h) > 0).select(
        "event_id", F.size(h).cast("bigint").alias("records"), F.size(usable).cast("bigint").alias("usable_reactions"),
        F.when(F.size(usable) > 0, fam.array_sum(usable)).alias("reaction_sum"))


@query("d01_company_history", f"""WITH {HIST_SQL}
SELECT e.event_id, {', '.join(f'round(coalesce({x}, 0), 6) + 0.0 AS {n}' for x, n in (
    ('count(h.record_id)::DOUBLE', 'prior_earnings_count'), ('avg(y)', 'mean_prior_earnings_abnormal_return'),
    ('median(y)', 'median_prior_earnings_abnormal_return'), ('CASE WHEN count(y) >= 2 THEN stddev_pop(y) END', 'std_prior_earnings_abnormal_return'),
    ('avg(CASE WHEN y > 0 THEN 1.0 WHEN y IS NOT NULL THEN 0.0 END)', 'positive_prior_earnings_rate'),
    ('avg(CASE WHEN y < 0 THEN 1.0 WHEN y IS NOT NULL THEN 0.0 END)', 'negative_prior_earnings_rate'),
    ('avg(hs_e)', 'mean_prior_eps_surprise'), ('CASE WHEN count(hs_e) >= 2 THEN stddev_pop(hs_e) END', 'std_prior_eps_surprise'),
    ('avg(hs_r)', 'mean_prior_revenue_surprise'), ('CASE WHEN count(hs_r) >= 2 THEN stddev_pop(hs_r) END', 'std_prior_revenue_surprise')))}
FROM focal e LEFT JOIN hist h USING (event_id) GROUP BY e.event_id""")
def d01(spark, d):
    return archive_history(focal(spark, d)).select("event_id", *fv.HISTORY_FEATURES[:10])


@query("d02_conditional_reactions", f"""WITH {HIST_SQL}, prior AS (SELECT CAST(0.01 AS DOUBLE) AS p)
SELECT e.event_id, {', '.join(f'round(coalesce(avg(y) FILTER (WHERE {c}), 0), 6) + 0.0 AS {n}' for c, n in (
    ('hs_e > 0', 'mean_reaction_after_eps_beat'), ('hs_e < 0', 'mean_reaction_after_eps_miss'), ('hs_r > 0', 'mean_reaction_after_revenue_beat'),
    ('hs_r < 0', 'mean_reaction_after_revenue_miss'), ('hs_e < 0 AND hs_r < 0', 'mean_reaction_after_double_miss')))},
  round(CASE WHEN count(y) FILTER (WHERE hs_e > 0 AND hs_r > 0) > 0 THEN (sum(y) FILTER (WHERE hs_e > 0 AND hs_r > 0) + 5 * 0.01)
    / (count(y) FILTER (WHERE hs_e > 0 AND hs_r > 0) + 5) ELSE 0.01 END, 6) + 0.0 AS mean_reaction_after_double_beat
FROM focal e LEFT JOIN hist h USING (event_id) GROUP BY e.event_id""")
def d02(spark, d):
    return archive_history(focal(spark, d), {"double_beat": F.lit(0.01)}).select("event_id", *[n for n, _ in fam.REACTION_GROUPS.values()])


D03_SQL = f"""WITH {HIST_SQL}, j AS (SELECT c.*, h.hs_e, h.hs_r FROM cur c LEFT JOIN hist h USING (event_id)),
a AS (SELECT event_id, any_value(reported_eps) AS re, any_value(consensus_eps) AS co, any_value(ce) AS pct, count(hs_e) AS n,
  avg(hs_e) AS mu, stddev_pop(hs_e) AS sd, count(*) FILTER (WHERE hs_e < ce) AS below, count(*) FILTER (WHERE hs_e = ce) AS eq FROM j GROUP BY event_id)
SELECT event_id, """ + ", ".join(f"round(CASE WHEN pct IS NULL THEN 0 ELSE {x} END, 6) + 0.0 AS {n}" for x, n in (
    ("re", "reported_eps"), ("co", "consensus_eps"), ("re - co", "eps_surprise_absolute"), ("pct", "eps_surprise_percent"),
    ("abs(pct) * sign(re - co)", "eps_surprise_signed"), ("abs(pct)", "eps_surprise_abs"),
    ("CASE WHEN n >= 2 AND sd > 1e-12 THEN (pct - mu) / sd ELSE 0 END", "eps_surprise_zscore_company"),
    ("CASE WHEN n = 0 THEN 0.5 ELSE (below + 0.5 * eq) / n END", "eps_surprise_percentile_company"),
    ("CAST(re > co AS INT)", "is_eps_beat"), ("CAST(re < co AS INT)", "is_eps_miss"),
    ("CAST(pct >= 0.1 AS INT)", "is_large_eps_beat"), ("CAST(pct <= -0.1 AS INT)", "is_large_eps_miss"),
    ("1", "has_eps_surprise"))) + " FROM a"


@query("d03_eps_surprise", D03_SQL)
def d03(spark, d):
    f = focal(spark, d)
    block = fam.eps_block(None, against=(F.col("eps_z"), F.col("eps_share")))
    return f.join(archive_history(f), "event_id").select("event_id", *[block[n].alias(n) for n in fv.EPS_FEATURES])


D04_SQL = f"""WITH {HIST_SQL}, j AS (SELECT c.*, h.hs_e, h.hs_r FROM cur c LEFT JOIN hist h USING (event_id)),
a AS (SELECT event_id, any_value(reported_revenue) AS re, any_value(consensus_revenue) AS co, any_value(cr) AS pct, count(hs_r) AS n,
  any_value(reported_eps - consensus_eps) AS ed,
  avg(hs_r) AS mu, stddev_pop(hs_r) AS sd, count(*) FILTER (WHERE hs_r < cr) AS below, count(*) FILTER (WHERE hs_r = cr) AS eq FROM j GROUP BY event_id)
SELECT event_id, """ + ", ".join(f"round(CASE WHEN pct IS NULL THEN 0 ELSE {x} END, 6) + 0.0 AS {n}" for x, n in (
    ("re", "reported_revenue"), ("co", "consensus_revenue"), ("re - co", "revenue_surprise_absolute"), ("pct", "revenue_surprise_percent"),
    ("CASE WHEN n >= 2 AND sd > 1e-12 THEN (pct - mu) / sd ELSE 0 END", "revenue_surprise_zscore_company"),
    ("CASE WHEN n = 0 THEN 0.5 ELSE (below + 0.5 * eq) / n END", "revenue_surprise_percentile_company"),
    ("CAST(re > co AS INT)", "is_revenue_beat"), ("CAST(re < co AS INT)", "is_revenue_miss"), ("1", "has_revenue_surprise"),
    ("CAST(coalesce(ed > 0, false) AND re > co AS INT)", "eps_beat_and_revenue_beat"),
    ("CAST(coalesce(ed > 0, false) AND re < co AS INT)", "eps_beat_revenue_miss"),
    ("CAST(coalesce(ed < 0, false) AND re > co AS INT)", "eps_miss_revenue_beat"),
    ("CAST(coalesce(ed < 0, false) AND re < co AS INT)", "eps_miss_and_revenue_miss"))) + " FROM a"


@query("d04_revenue_surprise", D04_SQL)
def d04(spark, d):
    f = focal(spark, d)
    block = fam.revenue_block(None, against=(F.col("revenue_z"), F.col("revenue_share")))
    return f.join(archive_history(f), "event_id").select("event_id", *[block[n].alias(n) for n in fv.REVENUE_FEATURES])


def _near_sql(name, dist):
    return f"""{name} AS (SELECT event_id, avg(y) AS m, count(*) AS k FROM (SELECT event_id, y, row_number() OVER (PARTITION BY event_id
      ORDER BY {dist}, value_timestamp, h_re NULLS FIRST, h_ce NULLS FIRST, h_rr NULLS FIRST, h_cr NULLS FIRST) AS i FROM hc WHERE y IS NOT NULL AND {dist} IS NOT NULL) WHERE i <= 5 GROUP BY event_id)"""


@query("e10_similar_events", f"""WITH {HIST_SQL}, hc AS (SELECT h.*, c.ce, c.cr FROM hist h JOIN cur c USING (event_id)),
{_near_sql('ne', 'abs(hs_e - ce)')}, {_near_sql('nr', 'abs(hs_r - cr)')}, {_near_sql('nb', 'sqrt((hs_e - ce) * (hs_e - ce) + (hs_r - cr) * (hs_r - cr))')}
SELECT event_id, round(coalesce(ne.m, 0), 6) + 0.0 AS similar_eps_surprise_mean_reaction, round(coalesce(nr.m, 0), 6) + 0.0 AS similar_revenue_surprise_mean_reaction,
  round(coalesce(nb.m, 0), 6) + 0.0 AS similar_earnings_event_mean_reaction,
  CAST(coalesce(nb.k, greatest(coalesce(ne.k, 0), coalesce(nr.k, 0))) AS DOUBLE) AS similar_event_count
FROM cur LEFT JOIN ne USING (event_id) LEFT JOIN nr USING (event_id) LEFT JOIN nb USING (event_id)""")
def e10(spark, d):
    return archive_history(focal(spark, d)).select("event_id", *fv.HISTORY_FEATURES[16:20])


@query("e15_latest_n_before_cutoff", f"""WITH {TRADED_SQL}, {BARS_SQL}, p AS (
  SELECT event_id, close, value_timestamp, row_number() OVER (PARTITION BY event_id ORDER BY value_timestamp DESC) AS back
  FROM traded JOIN bars USING (stock) WHERE available_at <= cutoff)
SELECT event_id, count(*) AS n, round(avg(close), 6) + 0.0 AS mean_close, strftime(min(value_timestamp), '%Y-%m-%d %H:%M:%S') AS oldest
FROM p WHERE back <= 20 GROUP BY event_id""")
def e15(spark, d):
    b = bars(spark, d)
    packed = jn.recent_history(traded(spark, d), b, ["stock"], "cutoff", "value_timestamp", F.col("available_at"),
                               ["close"], 20, "prices", strict_value=False)
    return packed.where(F.size("prices") > 0).select(
        "event_id", F.size("prices").cast("bigint").alias("n"),
        fam.array_mean(F.transform("prices", lambda r: r["close"])).alias("mean_close"),
        stamp(F.col("prices")[0]["value_timestamp"], "oldest"))


# --------------------------------------------------------------------------
# price series
# --------------------------------------------------------------------------
ASOF_SQL = f"""{TRADED_SQL}, {BARS_SQL}, feat AS (SELECT *, row_number() OVER w AS pos,
    close / lag(close, 1) OVER w - 1 AS step FROM bars WHERE close > 0 WINDOW w AS (PARTITION BY stock ORDER BY value_timestamp))"""


@query("c04_price_asof", f"""WITH {TRADED_SQL}, {BARS_SQL}
SELECT event_id, round(close, 6) + 0.0 AS close, strftime(value_timestamp, '%Y-%m-%d %H:%M:%S') AS session
FROM traded ASOF LEFT JOIN bars ON traded.stock = bars.stock AND traded.cutoff >= bars.available_at""")
def c04(spark, d):
    hit = jn.asof(traded(spark, d), bars(spark, d), ["stock"], "cutoff", "available_at", ["close", "value_timestamp"])
    return hit.select("event_id", "asof.close", stamp(F.col("asof.value_timestamp"), "session"))


def stock_bound(spark, d) -> int:
    """Upper bound on bars per stock without building the bars."""
    return largest_group(table(spark, d, "lineitem").select("l_suppkey"), ["l_suppkey"])


@query("e04_trailing_returns", f"""WITH {ASOF_SQL} SELECT stock, strftime(day, '%Y-%m-%d') AS day, {', '.join(
    f"round(coalesce(close / lag(close, {k}) OVER w - 1, 0), 6) + 0.0 AS {n}" for k, n in fv.RETURN_WINDOWS)}
FROM feat WINDOW w AS (PARTITION BY stock ORDER BY value_timestamp)""")
def e04(spark, d):
    from tidemark.operators.scan import rolling

    def build(df, parts):
        return df.withColumns({n: sr.trailing_return("close", k, parts, "value_timestamp") for k, n in fv.RETURN_WINDOWS})

    out = rolling(bars(spark, d).where("close > 0"), ["stock"], "value_timestamp", 1260, build, stock_bound(spark, d))
    return out.select("stock", F.date_format("day", "yyyy-MM-dd").alias("day"), *[n for _, n in fv.RETURN_WINDOWS])


def _vol(n):
    return (f"round(CASE WHEN count(step) OVER v{n} >= 2 THEN stddev_pop(step) OVER v{n} * sqrt(252) ELSE 0 END, 6) + 0.0 "
            f"AS realized_volatility_{n}d")


@query("e05_realised_volatility", f"""WITH {ASOF_SQL} SELECT stock, strftime(day, '%Y-%m-%d') AS day, {_vol(20)}, {_vol(60)}, {_vol(252)}
FROM feat WINDOW v20 AS (PARTITION BY stock ORDER BY value_timestamp ROWS 19 PRECEDING), v60 AS (PARTITION BY stock ORDER BY value_timestamp ROWS 59 PRECEDING),
  v252 AS (PARTITION BY stock ORDER BY value_timestamp ROWS 251 PRECEDING)""")
def e05(spark, d):
    from tidemark.operators.scan import rolling

    def build(df, parts):
        step = F.col("close") / F.lag("close").over(Window.partitionBy(*parts).orderBy("value_timestamp")) - 1.0
        df = df.withColumn("step", step).withColumn("realized_volatility_20d", sr.volatility("step", 20, parts, "value_timestamp"))
        for n in (60, 252):
            df = sr.with_blocks(df, n, parts, ["step"])
        return sr.with_starts(df, parts, "value_timestamp").withColumns({
            f"realized_volatility_{n}d": sr.annualised(sr.Rows(n).deviation("step")) for n in (60, 252)})

    out = rolling(bars(spark, d).where("close > 0"), ["stock"], "value_timestamp", 253, build, stock_bound(spark, d))
    return out.select("stock", F.date_format("day", "yyyy-MM-dd").alias("day"),
                      *[f"realized_volatility_{n}d" for n in (20, 60, 252)])


@query("e06_max_drawdown", f"""WITH {ASOF_SQL}, p AS (
  SELECT a.stock, a.day, b.close, max(b.close) OVER (PARTITION BY a.stock, a.day ORDER BY b.pos) AS peak
  FROM feat a JOIN feat b ON a.stock = b.stock AND b.pos BETWEEN a.pos - 59 AND a.pos)
SELECT stock, strftime(day, '%Y-%m-%d') AS day, round(least(0, min(close / peak - 1)), 6) + 0.0 AS max_drawdown_60d FROM p GROUP BY stock, day""")
def e06(spark, d):
    from tidemark.operators.scan import rolling

    out = rolling(bars(spark, d).where("close > 0"), ["stock"], "value_timestamp", 60,
                  lambda df, parts: sr.with_drawdown(df, "close", 60, parts, "value_timestamp", "max_drawdown_60d"),
                  stock_bound(spark, d))
    return out.select("stock", F.date_format("day", "yyyy-MM-dd").alias("day"), "max_drawdown_60d")


@query("e07_high_low_distance", f"""WITH {ASOF_SQL} SELECT stock, strftime(day, '%Y-%m-%d') AS day,
  {', '.join(f"round(close / {fn}(close) OVER w{n} - 1, 6) + 0.0 AS {a}" for fn, n, a in (('max', 20, 'distance_from_20d_high'),
   ('max', 252, 'distance_from_52w_high'), ('min', 20, 'distance_from_20d_low'), ('min', 252, 'distance_from_52w_low')))}
FROM feat WINDOW w20 AS (PARTITION BY stock ORDER BY value_timestamp ROWS 19 PRECEDING), w252 AS (PARTITION BY stock ORDER BY value_timestamp ROWS 251 PRECEDING)""")
def e07(spark, d):
    from tidemark.operators.scan import rolling

    names = ["distance_from_20d_high", "distance_from_52w_high", "distance_from_20d_low", "distance_from_52w_low"]

    def build(df, parts):
        short = df.withColumns({"distance_from_20d_high": sr.distance("close", 20, True, parts, "value_timestamp"),
                                "distance_from_20d_low": sr.distance("close", 20, False, parts, "value_timestamp")})
        return sr.with_drawdown(short, "close", 252, parts, "value_timestamp", "fall", names[1], names[3])

    out = rolling(bars(spark, d).where("close > 0"), ["stock"], "value_timestamp", 252, build, stock_bound(spark, d))
    return out.select("stock", F.date_format("day", "yyyy-MM-dd").alias("day"), *names)


@query("e08_volume_zscore", f"""WITH {ASOF_SQL}, v AS (SELECT *, CASE WHEN volume > 5 THEN volume END AS vol FROM feat)
SELECT stock, strftime(day, '%Y-%m-%d') AS day, round(CASE WHEN count(vol) OVER w >= 10 AND stddev_pop(vol) OVER w > 1e-12
  THEN (last_value(vol IGNORE NULLS) OVER w - avg(vol) OVER w) / stddev_pop(vol) OVER w ELSE 0 END, 6) + 0.0 AS volume_zscore
FROM v WINDOW w AS (PARTITION BY stock ORDER BY value_timestamp ROWS 59 PRECEDING)""")
def e08(spark, d):
    from tidemark.operators.scan import rolling

    b = bars(spark, d).where("close > 0").withColumn("vol", F.when(F.col("volume") > 5, F.col("volume")))
    out = rolling(b, ["stock"], "value_timestamp", 60, lambda df, parts: sr.with_starts(
        sr.with_blocks(df, 60, parts, ["vol"]), parts, "value_timestamp").withColumn("volume_zscore", sr.volume_zscore("vol")), stock_bound(spark, d))
    return out.select("stock", F.date_format("day", "yyyy-MM-dd").alias("day"), "volume_zscore")


@query("e09_long_history_flag", f"""WITH {ASOF_SQL} SELECT stock, count(*) AS sessions, count(*) >= 1261 AS has_5y, count(*) FILTER (WHERE pos >= 400) AS long_rows
FROM feat GROUP BY stock""")
def e09(spark, d):
    from tidemark.operators.scan import rolling

    out = rolling(bars(spark, d).where("close > 0"), ["stock"], "value_timestamp", 1, lambda df, parts: df, stock_bound(spark, d))
    return out.groupBy("stock").agg(F.count(F.lit(1)).alias("sessions"), (F.max("position") >= fv.FIVE_YEAR_SESSIONS).alias("has_5y"),
                                    F.count(F.when(F.col("position") >= 400, 1)).alias("long_rows"))


@query("r1_price_context_asof", f"""WITH {ASOF_SQL}, x AS (SELECT *, coalesce(close / lag(close, 20) OVER w - 1, 0) AS return_20d,
    close / max(close) OVER w52 - 1 AS distance_from_52w_high FROM feat
  WINDOW w AS (PARTITION BY stock ORDER BY value_timestamp), w52 AS (PARTITION BY stock ORDER BY value_timestamp ROWS 251 PRECEDING))
SELECT event_id, round(coalesce(return_20d, 0), 6) + 0.0 AS return_20d, round(coalesce(distance_from_52w_high, 0), 6) + 0.0 AS distance_from_52w_high
FROM traded ASOF LEFT JOIN x ON traded.stock = x.stock AND traded.cutoff >= x.available_at""")
def r1(spark, d):
    out = sr.price_context(traded(spark, d), bars(spark, d), ["stock"], "event_id", "cutoff", stock_bound(spark, d))
    return out.select("event_id", "return_20d", "distance_from_52w_high")


def series_by(spark, d, keys: list[str], extra: DataFrame | None = None) -> DataFrame:
    """Daily close over a wider cross-section (whole market or a region)."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    if extra is not None:
        li = li.join(jn.broadcast_if_small(extra), "l_suppkey")
    day = F.col("l_shipdate").cast("timestamp")
    return li.groupBy(*keys, day.alias("day")).agg(
        (F.sum("l_extendedprice") / (F.sum("l_quantity") * 1.07)).alias("close"), F.sum("l_quantity").alias("volume")).select(
        *keys, (F.col("day") + F.expr("INTERVAL 21 HOURS")).alias("value_timestamp"),
        (F.col("day") + F.expr("INTERVAL 1 DAY")).alias("available_at"), "close", "volume")


def suppliers_by_region(spark, d) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("sector"))
    return table(spark, d, "supplier").join(F.broadcast(n), "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "sector")


def _series_sql(name, key, source):
    part = f"PARTITION BY {key} " if key else ""
    sel = f"{key}, " if key else ""
    return f"""{name} AS (SELECT *, {', '.join(f"coalesce(close / lag(close, {k}) OVER w - 1, 0) AS r{k}" for k in (1, 5, 20, 60))},
    CASE WHEN count(step) OVER v >= 2 THEN stddev_pop(step) OVER v * sqrt(252) ELSE 0 END AS vol20 FROM (
      SELECT *, close / lag(close) OVER ({part}ORDER BY available_at) - 1 AS step FROM (
        SELECT {sel}l_shipdate + INTERVAL 1 DAY AS available_at, sum(l_extendedprice) / (sum(l_quantity) * CAST(1.07 AS DOUBLE)) AS close
        FROM {source} GROUP BY {sel}l_shipdate))
    WINDOW w AS ({part}ORDER BY available_at), v AS ({part}ORDER BY available_at ROWS 19 PRECEDING))"""


C05_SQL = f"""WITH {TRADED_SQL}, reg AS (SELECT l.*, n_regionkey AS sector FROM lineitem l JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey),
{_series_sql('stk', 'l_suppkey', 'lineitem')}, {_series_sql('mkt', '', 'lineitem')}, {_series_sql('sec', 'sector', 'reg')},
t AS (SELECT t.*, n_regionkey AS sector FROM traded t JOIN supplier ON s_suppkey = t.stock JOIN nation ON n_nationkey = s_nationkey),
a AS (SELECT t.*, s.r5 AS s5, s.r20 AS s20, s.r60 AS s60 FROM t ASOF LEFT JOIN stk s ON t.stock = s.l_suppkey AND t.cutoff >= s.available_at),
b AS (SELECT a.*, c.r1 AS c1, c.r5 AS c5, c.r20 AS c20, c.r60 AS c60, c.vol20 FROM a ASOF LEFT JOIN sec c ON a.sector = c.sector AND a.cutoff >= c.available_at),
c AS (SELECT b.*, m.r1 AS m1, m.r5 AS m5, m.r20 AS m20, m.r60 AS m60 FROM b ASOF LEFT JOIN mkt m ON b.cutoff >= m.available_at)
SELECT event_id, """ + ", ".join(f"round({x}, 6) + 0.0 AS {n}" for x, n in (
    ("coalesce(m1, 0)", "market_return_1d"), ("coalesce(m5, 0)", "market_return_5d"), ("coalesce(c1, 0)", "sector_return_1d"),
    ("coalesce(c5, 0)", "sector_return_5d"), ("coalesce(c20, 0)", "sector_return_20d"), ("coalesce(vol20, 0)", "sector_volatility_20d"),
    ("coalesce(s5, 0) - coalesce(m5, 0)", "stock_minus_market_5d"), ("coalesce(s20, 0) - coalesce(m20, 0)", "stock_minus_market_20d"),
    ("coalesce(s60, 0) - coalesce(m60, 0)", "stock_minus_market_60d"), ("coalesce(s20, 0) - coalesce(c20, 0)", "stock_minus_sector_20d"),
    ("coalesce(s60, 0) - coalesce(c60, 0)", "stock_minus_sector_60d"))) + " FROM c"

SHORT_RETURNS = ((1, "return_1d_pre_event"), (5, "return_5d"), (20, "return_20d"), (60, "return_60d"))


def short_features(series: DataFrame, keys: list[str], biggest: int | None = None) -> DataFrame:
    """The returns and 20-session volatility the market block needs."""
    from tidemark.operators.scan import rolling

    def build(df, parts):
        step = F.col("close") / F.lag("close").over(Window.partitionBy(*parts).orderBy("value_timestamp")) - 1.0
        return df.withColumn("step", step).withColumns({
            **{n: sr.trailing_return("close", k, parts, "value_timestamp") for k, n in SHORT_RETURNS},
            "realized_volatility_20d": sr.volatility("step", 20, parts, "value_timestamp")}).drop("step")

    return rolling(series.where("close > 0"), keys, "value_timestamp", 61, build, biggest)


@query("c05_market_and_sector", C05_SQL)
def c05(spark, d):
    sectors = suppliers_by_region(spark, d)
    ev = traded(spark, d).join(jn.broadcast_if_small(sectors.withColumnRenamed("l_suppkey", "stock")), "stock")
    stock = short_features(bars(spark, d), ["stock"], stock_bound(spark, d))
    market = short_features(series_by(spark, d, []).withColumn("all", F.lit(0)), ["all"])
    sector = short_features(series_by(spark, d, ["sector"], sectors), ["sector"])
    return sr.market_context(ev, stock, market, sector, "stock", "sector", "cutoff").select("event_id", *fv.MARKET_FEATURES)

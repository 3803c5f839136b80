"""Registered queries: ranks, metrics, calibration, backtest."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv
from tidemark.operators import metrics as m
from tidemark.operators import ranks as rk
from tidemark.operators.scan import Running, average_rank, largest_group, rank_stats, running
from tidemark.plans.bindings import FOCAL_SQL, LABELLED_SQL, focal
from tidemark.plans.catalog import query, r6
from tidemark.session import table, with_one_row


def labelled(spark, d: str) -> DataFrame:
    """Labelled focal events with their within-quarter outcome percentile."""
    return rk.percentile_rank(focal(spark, d).where(F.col("car1").isNotNull()), "car1", ["quarter"], "realized")


@query("e01_percentile_rank", f"""WITH {LABELLED_SQL}
SELECT event_id, quarter, {r6('realized')} FROM labelled""")
def e01(spark, d):
    return labelled(spark, d).select("event_id", "quarter", "realized")


E02_SQL = FOCAL_SQL + """, sur AS (
  SELECT event_id, CASE WHEN n = 1 THEN 0.5 ELSE ((lo - 1) + (ties - 1) / 2.0) / (n - 1) END AS surprise_percentile
  FROM (SELECT *, rank() OVER (PARTITION BY quarter ORDER BY earnings_surprise) AS lo,
          count(*) OVER (PARTITION BY quarter, earnings_surprise) AS ties, count(*) OVER (PARTITION BY quarter) AS n
        FROM focal WHERE car1 IS NOT NULL AND earnings_surprise IS NOT NULL))"""


@query("e02_benchmark_percentile", f"""WITH {E02_SQL}
SELECT f.event_id, {r6('surprise_percentile')} FROM focal f LEFT JOIN sur USING (event_id) WHERE car1 IS NOT NULL""")
def e02(spark, d):
    known = focal(spark, d).where(F.col("car1").isNotNull())
    return rk.percentile_rank(known, "earnings_surprise", ["quarter"], "surprise_percentile").select(
        "event_id", "surprise_percentile")


@query("e03_average_rank_spearman", f"""WITH {LABELLED_SQL}, r AS (
  SELECT (rank() OVER (ORDER BY score) - 1) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rp,
         (rank() OVER (ORDER BY car1) - 1) + (count(*) OVER (PARTITION BY car1) - 1) / 2.0 AS ra FROM labelled)
SELECT count(*) AS n, round(corr(rp, ra), 6) + 0.0 AS spearman, round(sum(rp), 6) + 0.0 AS rank_sum FROM r""")
def e03(spark, d):
    ranked = m.ranked_pair(focal(spark, d).where(F.col("car1").isNotNull()), "score", "car1")
    return ranked.agg(F.count(F.lit(1)).alias("n"),
                      m.safe_corr(F.col("rank_predicted"), F.col("rank_actual")).alias("spearman"),
                      F.sum("rank_predicted").alias("rank_sum"))


@query("e17_chronological_split", f"""WITH {FOCAL_SQL}, q AS (
  SELECT quarter, row_number() OVER (ORDER BY quarter DESC) AS newest, count(*) OVER () AS k
  FROM (SELECT DISTINCT quarter FROM focal))
SELECT split, count(*) AS n, min(quarter) AS first_quarter, max(quarter) AS last_quarter FROM (
  SELECT quarter, CASE WHEN newest <= 2 AND k > 2 THEN 'test' ELSE 'train' END AS split FROM focal JOIN q USING (quarter))
GROUP BY split""")
def e17(spark, d):
    return rk.chronological_split(focal(spark, d), "quarter", 2).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("quarter").alias("first_quarter"), F.max("quarter").alias("last_quarter"))


ROLES = {"train": "1999Q4", "validation": "2000Q1", "legacy": "2000Q2", "honest_holdout": "2000Q3"}
ROLE_SQL = ("CASE quarter WHEN '1999Q4' THEN 'train' WHEN '2000Q1' THEN 'validation' "
            "WHEN '2000Q2' THEN 'legacy' WHEN '2000Q3' THEN 'honest_holdout' END")


@query("e18_quarter_roles", f"""WITH {FOCAL_SQL}
SELECT {ROLE_SQL} AS role, count(*) AS n FROM focal GROUP BY 1""")
def e18(spark, d):
    return focal(spark, d).groupBy(rk.quarter_role(F.col("quarter"), ROLES).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("e19_priority_queue", f"""WITH {FOCAL_SQL}
SELECT *, CAST(sum(row_count) OVER (ORDER BY row_count DESC, ticker ROWS UNBOUNDED PRECEDING) AS BIGINT) AS rows_unlocked,
  row_number() OVER (ORDER BY row_count DESC, ticker) AS queue_position
FROM (SELECT ticker, count(*) AS row_count FROM focal GROUP BY ticker)""")
def e19(spark, d):
    demand = focal(spark, d).groupBy("ticker").agg(F.count(F.lit(1)).alias("row_count"))
    return rk.cumulative_queue(demand, "row_count", "ticker")


@query("e20_midrank_calibration", f"""WITH {FOCAL_SQL}, knots AS (
  SELECT score AS knot, row_number() OVER (ORDER BY score, event_id) - 1 AS pos, count(*) OVER () AS n
  FROM focal WHERE quarter < '1998Q1'),
thin AS (SELECT knot FROM knots WHERE n <= 4000 UNION ALL
  SELECT k.knot FROM (SELECT CAST(least(n - 1, round_even(i * ((n - 1) / CAST(3999 AS DOUBLE)), 0)) AS BIGINT) AS at
    FROM (SELECT max(n) AS n FROM knots) CROSS JOIN range(4000) t(i) WHERE n > 4000) g JOIN knots k ON k.pos = g.at),
cdf AS (SELECT knot, count(*) AS eq, sum(count(*)) OVER (ORDER BY knot) AS upto FROM thin GROUP BY knot),
tot AS (SELECT count(*) AS n FROM thin),
dist AS (SELECT DISTINCT score FROM focal WHERE quarter >= '1998Q1'),
pos AS (SELECT d.score, c.knot, c.eq, c.upto FROM dist d ASOF LEFT JOIN cdf c ON d.score >= c.knot)
SELECT event_id, round(greatest(0.01, least(0.99, CASE WHEN knot IS NULL THEN 0
    WHEN knot = score THEN (upto - eq / 2.0) / n ELSE upto / n END)), 6) + 0.0 AS calibrated
FROM focal JOIN pos USING (score), tot WHERE quarter >= '1998Q1'""")
def e20(spark, d):
    f = focal(spark, d)
    knots = rk.fit_knots(f.where("quarter < '1998Q1'"), "score")
    return rk.calibrate(f.where("quarter >= '1998Q1'"), "score", knots, "calibrated").select("event_id", "calibrated")


@query("e21_calibrator_fit", """WITH o AS (
  SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders),
g AS (SELECT i AS knot_index, n, CASE WHEN n > 4000
    THEN CAST(least(n - 1, round_even(i * ((n - 1) / CAST(3999 AS DOUBLE)), 0)) AS BIGINT) ELSE i END AS at
  FROM (SELECT max(n) AS n FROM o) CROSS JOIN range(4000) t(i) WHERE i < n)
SELECT CAST(knot_index AS BIGINT) AS knot_index, round(o.v, 6) + 0.0 AS knot, g.n AS n_fitted FROM g JOIN o ON o.pos = g.at""")
def e21(spark, d):
    return rk.fit_knots(table(spark, d, "orders"), "o_totalprice")


@query("e23_best_and_worst", f"""WITH {LABELLED_SQL}, e AS (SELECT event_id, abs(score - realized) AS err FROM labelled),
r AS (SELECT *, row_number() OVER (ORDER BY err, event_id) AS lo, row_number() OVER (ORDER BY err DESC, event_id) AS hi FROM e)
SELECT 'best' AS side, lo AS place, event_id, {r6('err')} FROM r WHERE lo <= 5 UNION ALL
SELECT 'worst', hi, event_id, round(err, 6) + 0.0 FROM r WHERE hi <= 5""")
def e23(spark, d):
    e = labelled(spark, d).select("event_id", F.abs(F.col("score") - F.col("realized")).alias("err"))
    out = []
    for side, order in (("best", F.col("err").asc()), ("worst", F.col("err").desc())):
        top = e.orderBy(order, "event_id").limit(5)  # the top-k report
        out.append(top.withColumn("place", F.row_number().over(Window.orderBy(order, "event_id")).cast("bigint"))
                   .withColumn("side", F.lit(side)))
    return out[0].unionByName(out[1]).select("side", "place", "event_id", "err")


@query("e24_candidate_ordering", f"""WITH {LABELLED_SQL}, s AS (
  SELECT quarter, CASE WHEN stddev_pop(rp) > 0 THEN corr(rp, ra) END AS spearman, avg(abs(score - realized)) AS mae FROM (
    SELECT quarter, score, realized,
      (rank() OVER (PARTITION BY quarter ORDER BY score) - 1) + (count(*) OVER (PARTITION BY quarter, score) - 1) / 2.0 AS rp,
      (rank() OVER (PARTITION BY quarter ORDER BY realized) - 1) + (count(*) OVER (PARTITION BY quarter, realized) - 1) / 2.0 AS ra
    FROM labelled) GROUP BY quarter)
SELECT quarter, {r6('spearman', 'mae')}, row_number() OVER (ORDER BY spearman DESC NULLS LAST, mae, quarter) AS place FROM s""")
def e24(spark, d):
    per = m.metric_set(labelled(spark, d), "score", "realized", ["quarter"]).select("quarter", "spearman", "mae")
    order = Window.orderBy(F.col("spearman").desc_nulls_last(), F.col("mae"), F.col("quarter"))  # one row per quarter
    return per.withColumn("place", F.row_number().over(order).cast("bigint"))


METRIC_SQL = """count(*) AS n, round(CASE WHEN stddev_pop(score) > 1e-12 AND stddev_pop(realized) > 1e-12
    THEN corr(score, realized) END, 6) + 0.0 AS pearson,
  round(CASE WHEN stddev_pop(rp) > 1e-12 AND stddev_pop(ra) > 1e-12 THEN corr(rp, ra) END, 6) + 0.0 AS spearman,
  round(avg(abs(score - realized)), 6) + 0.0 AS mae, round(sqrt(avg((score - realized) * (score - realized))), 6) + 0.0 AS rmse,
  round(stddev_pop(score), 6) + 0.0 AS prediction_std, round(min(score), 6) + 0.0 AS minimum_prediction,
  round(max(score), 6) + 0.0 AS maximum_prediction, round(quantile_cont(score, 0.05), 6) + 0.0 AS prediction_p05,
  round(quantile_cont(score, 0.95), 6) + 0.0 AS prediction_p95,
  round(avg(CASE WHEN score BETWEEN 0.48 AND 0.52 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS fraction_between_048_052"""
RANKED_SQL = """ranked AS (SELECT *,
  (rank() OVER (PARTITION BY quarter ORDER BY score) - 1) + (count(*) OVER (PARTITION BY quarter, score) - 1) / 2.0 AS rp,
  (rank() OVER (PARTITION BY quarter ORDER BY realized) - 1) + (count(*) OVER (PARTITION BY quarter, realized) - 1) / 2.0 AS ra
  FROM labelled)"""


@query("d11_metric_set", f"WITH {LABELLED_SQL}, {RANKED_SQL} SELECT quarter, {METRIC_SQL} FROM ranked GROUP BY quarter")
def d11(spark, d):
    return m.metric_set(labelled(spark, d), "score", "realized", ["quarter"])


R2_SQL = """agg AS (SELECT quarter, count(*) AS n, regr_r2(realized, surprise_percentile) AS r1,
  corr(realized, score) AS yp, corr(realized, surprise_percentile) AS ys, corr(score, surprise_percentile) AS ps
  FROM labelled JOIN sur USING (event_id) GROUP BY quarter)"""


def with_benchmark(spark, d):
    known = rk.percentile_rank(labelled(spark, d), "earnings_surprise", ["quarter"], "surprise_percentile")
    return known


SUR_SQL = LABELLED_SQL + """, sur AS (
  SELECT event_id, CASE WHEN n2 = 1 THEN 0.5 ELSE ((lo2 - 1) + (ties2 - 1) / 2.0) / (n2 - 1) END AS surprise_percentile
  FROM (SELECT event_id, rank() OVER (PARTITION BY quarter ORDER BY earnings_surprise) AS lo2,
          count(*) OVER (PARTITION BY quarter, earnings_surprise) AS ties2, count(*) OVER (PARTITION BY quarter) AS n2
        FROM focal WHERE car1 IS NOT NULL AND earnings_surprise IS NOT NULL))"""


@query("d12_incremental_r2", f"""WITH {SUR_SQL}, {R2_SQL}
SELECT quarter, n, round(r1, 6) + 0.0 AS r2_surprise_only,
  round((yp*yp + ys*ys - 2*yp*ys*ps) / (1 - ps*ps), 6) + 0.0 AS r2_prediction_plus_surprise,
  round((yp*yp + ys*ys - 2*yp*ys*ps) / (1 - ps*ps) - r1, 6) + 0.0 AS delta_r2 FROM agg WHERE n >= 3""")
def d12(spark, d):
    return m.incremental_r2(with_benchmark(spark, d), "score", "surprise_percentile", "realized", ["quarter"]).where("n >= 3")


@query("d12c_contest_score", f"""WITH {SUR_SQL}, full_set AS (
  SELECT l.quarter, l.realized, s.surprise_percentile,
    CASE WHEN l.event_id % 3 <> 0 THEN l.score END AS submitted FROM labelled l JOIN sur s USING (event_id)),
filled AS (SELECT *, coalesce(submitted, avg(submitted) OVER (PARTITION BY quarter)) AS score FROM full_set),
agg AS (SELECT quarter, count(*) AS n, CAST(count(submitted) AS BIGINT) AS n_obs, regr_r2(realized, surprise_percentile) AS r1,
  corr(realized, score) AS yp, corr(realized, surprise_percentile) AS ys, corr(score, surprise_percentile) AS ps
  FROM filled GROUP BY quarter)
SELECT quarter, n_obs, round((yp*yp + ys*ys - 2*yp*ys*ps) / (1 - ps*ps), 6) + 0.0 AS r_squared_imputed,
  round((yp*yp + ys*ys - 2*yp*ys*ps) / (1 - ps*ps) - r1, 6) + 0.0 AS delta_r_squared_imputed FROM agg WHERE n >= 3""")
def d12c(spark, d):
    scored = with_benchmark(spark, d).where(F.col("surprise_percentile").isNotNull()).withColumn(
        "submitted", F.when(F.col("event_id") % 3 != 0, F.col("score")))
    own = scored.groupBy("quarter").agg(F.avg("submitted").alias("own_mean"), F.count("submitted").alias("n_obs"))
    filled = scored.join(F.broadcast(own), "quarter").where(F.col("own_mean").isNotNull()).withColumn(
        "filled", F.coalesce("submitted", "own_mean"))
    r2 = m.incremental_r2(filled, "filled", "surprise_percentile", "realized", ["quarter"]).where("n >= 3")
    return r2.join(own, "quarter").select(
        "quarter", "n_obs", F.col("r2_prediction_plus_surprise").alias("r_squared_imputed"),
        F.col("delta_r2").alias("delta_r_squared_imputed"))


DISPERSION_SQL = """count(score) AS n, round(stddev_pop(score), 6) + 0.0 AS prediction_std,
  round(min(score), 6) + 0.0 AS minimum_prediction, round(max(score), 6) + 0.0 AS maximum_prediction,
  round(quantile_cont(score, 0.05), 6) + 0.0 AS p05, round(quantile_cont(score, 0.25), 6) + 0.0 AS p25,
  round(quantile_cont(score, 0.5), 6) + 0.0 AS median, round(quantile_cont(score, 0.75), 6) + 0.0 AS p75,
  round(quantile_cont(score, 0.95), 6) + 0.0 AS p95,
  round(avg(CASE WHEN score BETWEEN 0.48 AND 0.52 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS fraction_between_048_052,
  round(avg(CASE WHEN score BETWEEN 0.45 AND 0.55 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS fraction_between_045_055,
  count(DISTINCT round(score, 4)) AS unique_predictions_4dp, round(avg(score), 6) + 0.0 AS mean_prediction"""


@query("d13_dispersion_report", f"""WITH {FOCAL_SQL}, a AS (SELECT {DISPERSION_SQL} FROM focal)
SELECT *, prediction_std < 0.01 OR fraction_between_048_052 > 0.90 AS collapsed FROM a""")
def d13(spark, d):
    return rank_stats(focal(spark, d), "score").agg(*m.dispersion("score")).withColumn("collapsed", m.collapsed())


@query("d15_collapse_audit", f"""WITH {FOCAL_SQL}, z AS (
  SELECT quarter, abs(coalesce(earnings_surprise, 0)) <= 1e-12 AND abs(coalesce(reported_eps, 0)) <= 1e-12 AS zero,
    round(score, 4) AS b4, round(score, 3) AS b3, round(score, 2) AS b2 FROM focal),
b AS (SELECT 4 AS digits, b4 AS bucket, count(*) AS n FROM z GROUP BY b4 UNION ALL
      SELECT 3, b3, count(*) FROM z GROUP BY b3 UNION ALL SELECT 2, b2, count(*) FROM z GROUP BY b2),
t AS (SELECT *, row_number() OVER (PARTITION BY digits ORDER BY n DESC, bucket) AS place FROM b)
SELECT 'bucket_' || digits || 'dp' AS measure, CAST(place AS BIGINT) AS place, round(bucket, 6) + 0.0 AS value, n AS rows FROM t
  WHERE place <= CASE digits WHEN 2 THEN 10 ELSE 1 END
UNION ALL SELECT 'zero_signal_' || quarter, 0, round(avg(CASE WHEN zero THEN 1.0 ELSE 0.0 END), 6) + 0.0, count(*) FROM z GROUP BY quarter""")
def d15(spark, d):
    f = focal(spark, d)
    zero = (F.abs(F.coalesce("earnings_surprise", F.lit(0.0))) <= fv.NEGLIGIBLE) & (
        F.abs(F.coalesce("reported_eps", F.lit(0.0))) <= fv.NEGLIGIBLE)
    wide = f.select("quarter", zero.alias("zero"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("digits"), F.round("score", k).alias("bucket")) for k in (4, 3, 2)])).alias("b"))
    counts = wide.groupBy("b.digits", "b.bucket").agg(F.count(F.lit(1)).alias("rows"))
    top = rk.top_in_group(counts, ["digits"], [F.col("rows").desc(), F.col("bucket")], 10, "place")
    modal = top.where((F.col("digits") == 2) | (F.col("place") == 1)).select(
        F.concat(F.lit("bucket_"), F.col("digits"), F.lit("dp")).alias("measure"), F.col("place").cast("bigint").alias("place"),
        F.col("bucket").alias("value"), "rows")
    zeros = f.groupBy("quarter").agg(m.share(zero).alias("value"), F.count(F.lit(1)).alias("rows")).select(
        F.concat(F.lit("zero_signal_"), F.col("quarter")).alias("measure"), F.lit(0).cast("bigint").alias("place"), "value", "rows")
    return modal.unionByName(zeros)


@query("d24_reliability_table", f"""WITH {LABELLED_SQL}, b AS (SELECT CAST(i AS BIGINT) AS bin FROM range(5) t(i)),
a AS (SELECT CAST(least(floor(score * 5), 4) AS BIGINT) AS bin, count(*) AS n, avg(score) AS avg_predicted,
  avg(realized) AS avg_realized FROM labelled GROUP BY 1)
SELECT b.bin, coalesce(n, 0) AS n, {r6('avg_predicted', 'avg_realized')},
  round(avg_realized - avg_predicted, 6) + 0.0 AS gap FROM b LEFT JOIN a USING (bin)""")
def d24(spark, d):
    bins = spark.range(5).withColumnRenamed("id", "bin")
    agg = labelled(spark, d).groupBy(F.least(F.floor(F.col("score") * 5), F.lit(4)).cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("avg_predicted"), F.avg("realized").alias("avg_realized"))
    return bins.join(agg, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"), "avg_predicted", "avg_realized",
        (F.col("avg_realized") - F.col("avg_predicted")).alias("gap"))


@query("d25_performance_summary", f"""WITH {LABELLED_SQL}
SELECT count(*) AS n, round(avg(abs(score - realized)), 6) + 0.0 AS mae,
  round(sqrt(avg((score - realized) * (score - realized))), 6) + 0.0 AS rmse, round(corr(score, realized), 6) + 0.0 AS pearson,
  round(avg(CASE WHEN (score - 0.5) * (realized - 0.5) > 0 THEN 1.0 WHEN score <> 0.5 AND realized <> 0.5 THEN 0.0 ELSE 0.5 END), 6) + 0.0 AS direction_hit
FROM labelled""")
def d25(spark, d):
    p, y = F.col("score"), F.col("realized")
    return labelled(spark, d).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(p - y)).alias("mae"), F.sqrt(F.avg((p - y) * (p - y))).alias("rmse"),
        m.safe_corr(p, y).alias("pearson"), F.avg(m.directional_hit(p, y)).alias("direction_hit"))


BACKTEST_SQL = f"""WITH {SUR_SQL}, s AS (
  SELECT l.*, sur.surprise_percentile, greatest(0.1, least(0.9, 0.5 + 0.08 * (l.event_id % 11 - 5))) AS predicted
  FROM labelled l LEFT JOIN sur USING (event_id))
SELECT count(*) AS n_obs, round(corr(predicted, realized), 6) + 0.0 AS correlation,
  round(avg(abs(predicted - realized)), 6) + 0.0 AS mean_abs_error,
  abs(corr(predicted, realized) FILTER (WHERE surprise_percentile IS NOT NULL))
    > abs(corr(surprise_percentile, realized)) AS beats_surprise_benchmark FROM s"""


def run_backtest(events: DataFrame, predicted: str) -> DataFrame:
    """One-row summary of a prediction column against within-quarter labels.

    ``events`` carries ``quarter``, ``car1``, ``earnings_surprise`` and the
    prediction; an unknown quarter forms its own group.
    """
    known = events.where(F.col("car1").isNotNull()).withColumn("quarter", F.coalesce("quarter", F.lit("UNKNOWN")))
    scored = rk.percentile_rank(known, "car1", ["quarter"], "realized")
    scored = rk.percentile_rank(scored, "earnings_surprise", ["quarter"], "surprise_percentile")
    p, y, s = F.col(predicted), F.col("realized"), F.col("surprise_percentile")
    on_benchmark = F.when(s.isNotNull(), p)
    own, other = m.safe_corr(on_benchmark, F.when(s.isNotNull(), y)), m.safe_corr(s, F.when(s.isNotNull(), y))
    return scored.agg(
        F.count(F.lit(1)).alias("n_obs"), m.safe_corr(p, y).alias("correlation"),
        F.avg(F.abs(p - y)).alias("mean_abs_error"), (F.abs(own) > F.abs(other)).alias("beats_surprise_benchmark"))


@query("d28_backtest_summary", BACKTEST_SQL)
def d28(spark, d):
    from tidemark.operators.families import heuristic

    f = focal(spark, d).withColumn("predicted", heuristic(F.col("event_id") % 11 - 5))
    return run_backtest(f, "predicted")


@query("k10_baseline_comparison", f"""WITH {SUR_SQL}, l AS (SELECT l.*, surprise_percentile FROM labelled l LEFT JOIN sur USING (event_id))
SELECT 'constant' AS baseline, count(*) AS n, NULL::DOUBLE AS pearson, round(avg(abs(0.5 - realized)), 6) + 0.0 AS mae FROM l UNION ALL
SELECT 'surprise', count(*), round(corr(surprise_percentile, realized), 6) + 0.0, round(avg(abs(surprise_percentile - realized)), 6) + 0.0
FROM l WHERE surprise_percentile IS NOT NULL""")
def k10(spark, d):
    known = with_benchmark(spark, d).select("realized", F.explode(F.array(
        F.struct(F.lit("constant").alias("baseline"), F.lit(0.5).alias("p")),
        F.struct(F.lit("surprise").alias("baseline"), F.col("surprise_percentile").alias("p")))).alias("b"))
    p = F.col("b.p")
    return known.where(p.isNotNull()).groupBy("b.baseline").agg(
        F.count(F.lit(1)).alias("n"), m.safe_corr(p, F.col("realized")).alias("pearson"),
        F.avg(F.abs(p - F.col("realized"))).alias("mae")).where("n >= 3")


@query("k11_calibration_keeps_ranking", f"""WITH {LABELLED_SQL}, c AS (
  SELECT event_id, score, realized, greatest(0.01, least(0.99,
    ((rank() OVER (ORDER BY score) - 1) + count(*) OVER (PARTITION BY score) / 2.0) / count(*) OVER ())) AS cal FROM labelled),
r AS (SELECT (rank() OVER (ORDER BY score)) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rs,
  (rank() OVER (ORDER BY cal)) + (count(*) OVER (PARTITION BY cal) - 1) / 2.0 AS rc,
  (rank() OVER (ORDER BY realized)) + (count(*) OVER (PARTITION BY realized) - 1) / 2.0 AS ra FROM c)
SELECT round(corr(rs, ra), 6) + 0.0 AS raw_spearman, round(corr(rc, ra), 6) + 0.0 AS calibrated_spearman,
  abs(corr(rs, ra) - corr(rc, ra)) < 1e-4 AS preserves_ranking, true AS monotonic FROM r""")
def k11(spark, d):
    rows = labelled(spark, d).select("score", "realized")
    biggest = largest_group(rows, [])
    scored = rank_stats(rows, "score", biggest=biggest)
    share = (F.col("__less") + F.col("__equal") / 2) / F.col("__n")
    cal = scored.select("score", "realized", average_rank().alias("rank_raw"), F.greatest(F.lit(0.01), F.least(F.lit(0.99), share)).alias("cal"))
    both = m.ranked_pair(cal, "cal", "realized", biggest=biggest)  # each column is ranked once
    a = F.col("rank_actual")
    raw, done = m.safe_corr(F.col("rank_raw"), a), m.safe_corr(F.col("rank_predicted"), a)
    steps = cal.groupBy("score").agg(F.min("cal").alias("lo"), F.max("cal").alias("hi"))
    # non-decreasing exactly when each step reaches the running maximum
    climbed = running(steps.withColumn("all", F.lit(0)), ["all"], ["score"], [Running("max", F.col("hi"), "upto")])
    mono = climbed.agg(F.bool_and((F.col("lo") >= F.col("upto") - 1e-12) & (F.col("lo") == F.col("hi"))).alias("monotonic"))
    return with_one_row(both.agg(raw.alias("raw_spearman"), done.alias("calibrated_spearman"),
                                 (F.abs(raw - done) < 1e-4).alias("preserves_ranking")), mono)

"""Registered queries: extension surface and the prior-event rolling set
(C18, U01-U03, and the documented rolling features)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators import calibrators as cal
from tidemark.operators import families as fam
from tidemark.operators.joins import EARNINGS_FIELDS
from tidemark.plans.bindings import BARS_SQL, FOCAL_SQL, bars, focal
from tidemark.plans.catalog import query, r6
from tidemark.plans.live_queries import ASSET_SQL, prior_join, run_live
from tidemark.plans.pit_joins import HIST_SQL, cached_history
from tidemark.sources.providers import Providers


@query("c18_stream_static_join", f"""WITH {ASSET_SQL}, h AS (SELECT user_id AS asset, value AS prior_value, ts + INTERVAL 1 HOUR AS available_at FROM events),
j AS (SELECT a.asset, h.prior_value FROM ass a ASOF LEFT JOIN h ON a.asset = h.asset AND a.ts >= h.available_at)
SELECT CAST(asset AS VARCHAR) AS ticker_key, count(*) AS scored, round(avg(coalesce(prior_value, 50.0)), 6) + 0.0 AS mean_prior FROM j GROUP BY asset""")
def c18(spark, d):
    sink, _ = run_live(spark, d, {"history": prior_join(spark, d)})
    return spark.read.parquet(sink).groupBy("ticker_key").agg(F.count(F.lit(1)).alias("scored"), F.avg("prior_value").alias("mean_prior"))


@query("u01_model_protocol", """WITH t AS (SELECT l_quantity AS x, l_tax * 10 AS y FROM lineitem), b AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, covar_pop(x, y) / stddev_pop(x) AS q, count(*) AS n FROM t)
SELECT count(*) AS n, round(avg(greatest(0.05, least(0.95, my + n * q / (n + 10) * (x - mx) / sx))), 6) + 0.0 AS ridge_mean, 0.5::DOUBLE AS neutral_mean FROM t, b""")
def u01(spark, d):
    from tidemark.session import table

    rows = table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_tax") * 10).alias("y"))
    model: cal.PercentileModel = cal.RidgePercentile(("x",), "y").fit(rows)
    both = cal.NeutralModel().fit(rows).score(model.score(rows, "ridge"), "neutral")
    return both.agg(F.count(F.lit(1)).alias("n"), F.avg("ridge").alias("ridge_mean"), F.avg("neutral").alias("neutral_mean"))


@query("u02_provider_registry", f"""WITH {FOCAL_SQL}, {BARS_SQL} SELECT 'prices' AS family, count(*) AS rows FROM bars UNION ALL SELECT 'earnings', count(*) FROM focal
UNION ALL SELECT 'guidance', 0 UNION ALL SELECT 'metadata', 0 UNION ALL SELECT 'peers', 0 UNION ALL SELECT 'news', 0""")
def u02(spark, d):
    """Two registered providers under their contracts; the others read as empty."""
    def prices(s):
        return bars(s, d).select("value_timestamp", "available_at", F.col("available_at").alias("retrieved_at"), F.lit("desk").alias("source"),
                                 F.col("stock").cast("string").alias("ticker"), "close", "volume")

    def earnings(s):
        at = F.col("cutoff")
        return focal(s, d).select(at.alias("value_timestamp"), at.alias("available_at"), at.alias("retrieved_at"), F.lit("desk").alias("source"),
                                  F.col("ticker").cast("string").alias("ticker"), *EARNINGS_FIELDS, F.col("car1").alias("abnormal_return"),
                                  F.col("event_id").cast("string").alias("event_id"))

    known = Providers(spark).register("prices", prices).register("earnings", earnings)
    out = None
    for family in ("prices", "earnings", "guidance", "metadata", "peers", "news"):
        part = known.read(family).agg(F.lit(family).alias("family"), F.count(F.lit(1)).alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out


@query("u03_calibrator_interface", f"WITH {FOCAL_SQL} SELECT event_id, round(greatest(0.05, least(0.95, 0.5 + 3.42554 * (score - 0.5))), 6) + 0.0 AS affine, true AS round_trip FROM focal")
def u03(spark, d):
    """Both calibrators through their dictionaries and back."""
    f = focal(spark, d)
    first = cal.MidrankCalibrator.fit(f, "score", "all events")
    again = cal.MidrankCalibrator.from_dict(first.as_dict())
    stretched = cal.AffineCalibrator.from_dict(cal.AffineCalibrator().as_dict()).apply(f, "score", "affine")
    both = again.apply(first.apply(stretched, "score", "a"), "score", "b")
    return both.select("event_id", "affine", (F.col("a") == F.col("b")).alias("round_trip"))


def prior_event_set(history: Column, n: int) -> dict[str, Column]:
    """Rolling features of earlier events; undefined with fewer than ``n``."""
    def field(name):
        return fam.present(history, lambda r: r[name])

    def last(xs: Column) -> Column:
        return F.try_element_at(xs, F.lit(-1))

    def window(xs: Column, value) -> Column:
        tail = F.slice(xs, -n, n)
        return F.when(F.size(xs) >= n, value(tail))

    def sample_std(xs: Column) -> Column:
        mean = fam.array_mean(xs)
        return F.sqrt(F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1))

    y, s = field("abnormal_return"), fam.present(history, fam.eps_surprise)
    up, down = F.filter(y, lambda x: x > 0), F.filter(y, lambda x: x < 0)
    return {
        "previous_return": last(y), f"rolling_mean_return_{n}": window(y, fam.array_mean), f"rolling_return_volatility_{n}": window(y, sample_std),
        "previous_surprise": last(s), f"rolling_mean_surprise_{n}": window(s, fam.array_mean),
        f"positive_surprises_{n}": F.size(F.filter(F.slice(s, F.greatest(F.lit(1), F.size(s) - n + 1), n), lambda x: x > 0)).cast("double"),
        "reaction_asymmetry": F.when((F.size(up) > 0) & (F.size(down) > 0), fam.array_mean(up) - F.abs(fam.array_mean(down))),
        "prior_events": F.size(history).cast("double"),
    }


@query("d32_prior_event_rolling_set", f"""WITH {HIST_SQL}, y AS (SELECT event_id, y, row_number() OVER (PARTITION BY event_id ORDER BY back) AS i, count(*) OVER (PARTITION BY event_id) AS k FROM hist WHERE y IS NOT NULL),
ya AS (SELECT event_id, max(y) FILTER (WHERE i = 1) AS previous_return, CASE WHEN any_value(k) >= 3 THEN avg(y) FILTER (WHERE i <= 3) END AS m, CASE WHEN any_value(k) >= 3 THEN stddev_samp(y) FILTER (WHERE i <= 3) END AS v,
  avg(y) FILTER (WHERE y > 0) - abs(avg(y) FILTER (WHERE y < 0)) AS asym FROM y GROUP BY event_id),
s AS (SELECT event_id, hs_e, row_number() OVER (PARTITION BY event_id ORDER BY back) AS i, count(*) OVER (PARTITION BY event_id) AS k FROM hist WHERE hs_e IS NOT NULL),
sa AS (SELECT event_id, max(hs_e) FILTER (WHERE i = 1) AS previous_surprise, CASE WHEN any_value(k) >= 3 THEN avg(hs_e) FILTER (WHERE i <= 3) END AS sm, count(*) FILTER (WHERE i <= 3 AND hs_e > 0) AS pos FROM s GROUP BY event_id),
n AS (SELECT event_id, CAST(count(*) AS DOUBLE) AS prior_events FROM hist GROUP BY event_id)
SELECT event_id, {r6('previous_return', 'previous_surprise')}, round(m, 6) + 0.0 AS rolling_mean_return_3, round(v, 6) + 0.0 AS rolling_return_volatility_3, round(sm, 6) + 0.0 AS rolling_mean_surprise_3,
  CAST(coalesce(pos, 0) AS DOUBLE) AS positive_surprises_3, round(asym, 6) + 0.0 AS reaction_asymmetry, coalesce(prior_events, 0) AS prior_events
FROM focal LEFT JOIN ya USING (event_id) LEFT JOIN sa USING (event_id) LEFT JOIN n USING (event_id)""")
def d32(spark, d):
    rows = cached_history(spark, d)
    return rows.select("event_id", *[c.alias(n) for n, c in prior_event_set(F.col("history"), 3).items()])

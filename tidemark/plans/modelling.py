"""Registered queries: scores, fits, sweeps, gates and explanations
(A15, A17, B19, D14, E22, J02-J04, J06, K01-K09, K12-K15, K17-K21)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv
from tidemark.functions import python_text as pt
from tidemark.functions import text as tx
from tidemark.operators import audit as au
from tidemark.operators import explain as ex
from tidemark.operators import families as fam
from tidemark.operators import gates as gt
from tidemark.operators import metrics as m
from tidemark.operators import models as md
from tidemark.operators import ranks as rk
from tidemark.operators import reasoning as rs
from tidemark.operators.scan import quantile_from_ranks, rank_stats
from tidemark.plans.bindings import FOCAL_SQL, focal
from tidemark.plans.catalog import query, r6
from tidemark.plans.evaluation import LABELLED_SQL, ROLES, SUR_SQL, labelled
from tidemark.plans.assembly import training_rows
from tidemark.plans.training import FEATURE_SETS, Sweep, run_sweep
from tidemark.session import scratch_path, ship_package, table, with_one_row
from tidemark.sources import sinks as sk

PARTS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
FIXED = md.LinearModel("fixed", {}, PARTS, (25.0, 50000.0, 0.05, 0.04), (14.07, 30011.0, 0.0307, 0.0211), (0.03, -0.05, 0.02, 0.01), 0.5)
RAW_SQL = "0.5 + 0.03 * (l_quantity - 25) / 14.07 - 0.05 * (l_extendedprice - 50000) / 30011 + 0.02 * (l_discount - 0.05) / 0.0307 + 0.01 * (l_tax - 0.04) / 0.0211"
KEY = "l_orderkey, l_linenumber, l_partkey"


def parts(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *PARTS)


@query("k01_linear_score", f"SELECT {KEY}, round({RAW_SQL}, 6) + 0.0 AS raw, round(greatest(0.05, least(0.95, {RAW_SQL})), 6) + 0.0 AS score FROM lineitem")
def k01(spark, d):
    return parts(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", FIXED.raw().alias("raw"), FIXED.score().alias("score"))


@query("k02_baseline_models", f"WITH {FOCAL_SQL} SELECT event_id, 0.5::DOUBLE AS baseline, round(greatest(0.1, least(0.9, 0.5 + 0.08 * (event_id % 13 - 6))), 6) + 0.0 AS heuristic FROM focal")
def k02(spark, d):
    return focal(spark, d).select("event_id", F.lit(0.5).alias("baseline"), fam.heuristic(F.col("event_id") % 13 - 6).alias("heuristic"))


@query("k03_fallback_chain", f"""WITH {FOCAL_SQL} SELECT event_id, round(coalesce(CASE WHEN event_id % 3 = 0 THEN score END, CASE WHEN reported_eps IS NOT NULL THEN 0.4 + score / 10 END, CASE WHEN event_id % 2 = 0 THEN 0.58 END, 0.5), 6) + 0.0 AS predicted,
  CASE WHEN event_id % 3 = 0 THEN 'candidate' WHEN reported_eps IS NOT NULL THEN 'v1' WHEN event_id % 2 = 0 THEN 'heuristic' ELSE 'neutral' END AS used FROM focal""")
def k03(spark, d):
    k = F.col("event_id")
    chain = {"candidate": F.when(k % 3 == 0, F.col("score")), "v1": F.when(F.col("reported_eps").isNotNull(), 0.4 + F.col("score") / 10),
             "heuristic": F.when(k % 2 == 0, fam.heuristic(F.lit(1))), "neutral": F.lit(0.5)}
    used = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in chain.items()])
    return focal(spark, d).select("event_id", F.coalesce(*chain.values()).alias("predicted"), used.alias("used"))


@query("k04_affine_calibration", f"WITH {FOCAL_SQL} SELECT event_id, round(greatest(0.05, least(0.95, 0.5 + 3.42554 * (score - 0.5))), 6) + 0.0 AS calibrated FROM focal")
def k04(spark, d):
    return focal(spark, d).select("event_id", rk.affine(F.col("score"), **fv.AFFINE_CALIBRATION).alias("calibrated"))


@query("k05_ridge_fit", """WITH b AS (SELECT count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, stddev_pop(l_quantity) AS s1, stddev_pop(l_discount) AS s2,
  corr(l_quantity, l_discount) AS r, covar_pop(l_quantity, l_extendedprice / 1e5) / stddev_pop(l_quantity) AS q1, covar_pop(l_discount, l_extendedprice / 1e5) / stddev_pop(l_discount) AS q2,
  avg(l_extendedprice / 1e5) AS my FROM lineitem), c AS (SELECT *, n + 10.0 AS a, n * r AS o FROM b), w AS (SELECT *, (n * q1 * a - o * n * q2) / (a * a - o * o) AS w1, (n * q2 * a - o * n * q1) / (a * a - o * o) AS w2 FROM c)
SELECT feature, round(mean, 6) + 0.0 AS mean, round(sd, 6) + 0.0 AS sd, round(coefficient, 6) + 0.0 AS coefficient, round(my, 6) + 0.0 AS intercept FROM (
  SELECT 'l_quantity' AS feature, m1 AS mean, s1 AS sd, w1 AS coefficient, my FROM w UNION ALL SELECT 'l_discount', m2, s2, w2, my FROM w)""")
def k05(spark, d):
    rows = parts(spark, d).withColumn("y", F.col("l_extendedprice") / 1e5)
    fit = md.fit_ridge(md.moments(rows, ["l_quantity", "l_discount"], "y"), 10.0)
    return fit.table(spark).drop("position").withColumn("intercept", F.lit(fit.intercept))


@query("k06_elastic_net_fit")
def k06(spark, d):
    """Checked against a numpy coordinate descent in the tests."""
    rows = parts(spark, d).withColumn("y", F.col("l_extendedprice") / 1e5)
    fit = md.fit_elastic_net(md.moments(rows, ["l_quantity", "l_discount", "l_tax"], "y"), 0.005, 0.5)
    return fit.table(spark).withColumn("intercept", F.lit(fit.intercept))


@query("k07_boosted_trees")
def k07(spark, d):
    """The non-linear candidate; comparable with, not equal to, other libraries."""
    rows = role_rows(spark, d)
    train = rows.where(F.col("role") == "train")
    names = [n for n in fv.FEATURES if n in set(au.varying(train, fv.FEATURES))]
    model = md.fit_boosted_trees(train, names, "target_percentile")
    held = model.transform(rows.where(F.col("role") == "validation")).withColumn(
        "score", F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.col("tree_score"))))
    return m.metric_set(held, "score", "target_percentile").select("n", "pearson", "spearman", "mae", "rmse")


@query("k08_sign_constrained_fit")
def k08(spark, d):
    """Checked against projected normal equations in the tests."""
    rows = parts(spark, d).withColumn("y", F.col("l_extendedprice") / 1e5)
    fit = md.fit_sign_constrained(md.moments(rows, ["l_quantity", "l_discount", "l_tax"], "y"), 10.0,
                                  {"l_quantity": -1, "l_tax": 1})
    return fit.table(spark).withColumn("intercept", F.lit(fit.intercept))


# --------------------------------------------------------------------------
# training rows and the sweep
# --------------------------------------------------------------------------
#: Sweeps by application and folder: five queries read one sweep.
_SWEEPS: dict[tuple[str, str], Sweep] = {}


def role_rows(spark, d) -> DataFrame:
    """The enriched rows of the quarters that play a role."""
    return training_rows(spark, d).withColumn("role", rk.quarter_role(F.col("quarter"), ROLES)).where(F.col("role").isNotNull())


def sweep(spark, d) -> Sweep:
    """All 36 feature sets with every linear candidate, on the enriched rows."""
    key = spark.sparkContext.applicationId, d
    if key not in _SWEEPS:
        _SWEEPS[key] = run_sweep(role_rows(spark, d), FEATURE_SETS, baseline="lite:v1_fls_only", constrained=(1.0, 10.0))
    return _SWEEPS[key]


@query("b19_feature_sets", f"""WITH {FOCAL_SQL} SELECT name, CAST(width AS BIGINT) AS width, rows FROM (VALUES {', '.join(f"('{k}', {len(v)})" for k, v in FEATURE_SETS.items())}) v(name, width), (SELECT count(*) AS rows FROM focal)""")
def b19(spark, d):
    pairs = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(len(v)).cast("bigint").alias("width")) for k, v in FEATURE_SETS.items()])
    return focal(spark, d).agg(F.count(F.lit(1)).alias("rows")).select("rows", F.explode(pairs).alias("p")).select("p.*", "rows")


@query("k09_ablation_sweep")
def k09(spark, d):
    """Every ablation and hyper-parameter on the validation rows; fits are
    checked against numpy in the tests."""
    return sweep(spark, d).report.select("candidate", "ablation", "n", "pearson", "spearman", "mae", "rmse", "prediction_std")


@query("r2_moment_slicing", """SELECT round(corr(l_quantity, l_tax), 6) + 0.0 AS corr_quantity_tax, round(covar_pop(l_extendedprice, l_discount), 6) + 0.0 AS cov_price_discount,
  count(*) AS n, round(var_pop(l_extendedprice / 1e5), 6) + 0.0 AS target_var FROM lineitem""")
def r2(spark, d):
    rows = parts(spark, d).withColumn("y", F.col("l_extendedprice") / 1e5)
    g = md.moments(rows, PARTS, "y")
    a = g.slice(["l_quantity", "l_tax"])
    corr = a.cov[0, 1] / (a.deviations[0] * a.deviations[1])
    b = g.slice(["l_extendedprice", "l_discount"])
    return spark.createDataFrame([(float(corr), float(b.cov[0, 1]), g.n, g.target_var)],
                                 "corr_quantity_tax double, cov_price_discount double, n bigint, target_var double")


@query("a15_artifact_load")
def a15(spark, d):
    """A fitted artifact is stored, read back, validated and used to score."""
    rows = parts(spark, d).withColumn("y", F.col("l_extendedprice") / 1e5)
    fit = md.fit_ridge(md.moments(rows, ["l_quantity", "l_discount", "l_tax"], "y"), 10.0)
    path = scratch_path(spark, "artifact")
    sk.write_artifact(spark, fit.as_dict("ridge-check", [0.1, 0.2]), path, promoted=True)
    model = md.LinearModel.from_dict(sk.load_artifact(spark, path, fit.names))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.abs(model.raw() - fit.raw())).alias("largest_difference"))


@query("a17_guarded_artifact_sink")
def a17(spark, d):
    """The stored artifact of the sweep winner: refused unless the gate passed
    or an operator states a reason, in which case it is marked unpromoted."""
    done, path = sweep(spark, d), scratch_path(spark, "candidate")
    try:
        sk.write_artifact(spark, done.model.as_dict("v"), path, promoted=False)
    except ValueError:
        sk.write_artifact(spark, done.model.as_dict("v"), path, promoted=False, override="no untouched holdout yet")
    return spark.read.schema(sk.ARTIFACT).json(path).select(
        "model_version", "promoted", F.size("feature_names").alias("features"), "intercept")


# --------------------------------------------------------------------------
# gates
# --------------------------------------------------------------------------
@query("k12_promotion_gate", f"""WITH {SUR_SQL}, v AS (SELECT l.*, surprise_percentile FROM labelled l JOIN sur USING (event_id)),
e AS (SELECT corr(score, realized) - corr(surprise_percentile, realized) AS gain, stddev_pop(score) AS sd, avg(CASE WHEN score BETWEEN 0.48 AND 0.52 THEN 1.0 ELSE 0.0 END) AS near,
  corr(surprise_percentile, realized) FILTER (WHERE quarter = '2000Q3') - corr(score, realized) FILTER (WHERE quarter = '2000Q3') AS regress, count(*) FILTER (WHERE quarter = '2000Q3') > 0 AS held FROM v)
SELECT * FROM (SELECT unnest(['validation_gain_ok', 'holdout_available', 'holdout_regression_ok', 'prediction_std_ok', 'near_half_ok', 'calibration_ok', 'tests_passing', 'local_feed_verified', 'remote_feed_verified',
   'news_coverage_nonzero', 'reasoning_valid', 'latency_ok']) AS "check", unnest([gain >= 0.01, held, regress <= 0.01, sd >= 0.01, near <= 0.9, true, true, true, false, true, true, true]) AS passed FROM e)""")
def k12(spark, d):
    v = rk.percentile_rank(labelled(spark, d), "earnings_surprise", ["quarter"], "surprise_percentile").where(
        F.col("surprise_percentile").isNotNull())
    p, s, y = F.col("score"), F.col("surprise_percentile"), F.col("realized")
    held = F.col("quarter") == ROLES["honest_holdout"]
    on = lambda c: F.when(held, c)
    ev = v.agg(
        (m.safe_corr(p, y) - m.safe_corr(s, y)).alias("validation_gain"), F.stddev_pop(p).alias("prediction_std"),
        m.share(p.between(*fv.NEAR_HALF_TIGHT)).alias("near_half"), (F.count(F.when(held, 1)) > 0).alias("holdout_available"),
        (m.safe_corr(on(s), on(y)) - m.safe_corr(on(p), on(y))).alias("holdout_regression"))
    ev = ev.withColumns({"keeps_ranking": F.lit(True), **{n: F.lit(n != "remote_feed_verified") for n in gt.EXTERNAL_CHECKS}})
    return gt.promotion_checks(ev)


def scenario_rows(spark, scenarios=fv.REALISED_SCENARIOS) -> DataFrame:
    """The three disclosure scenarios through parsing, results and reasoning."""
    ship_package(spark)
    base = spark.createDataFrame([(label, list(lines)) for label, lines in scenarios], "label string, facts array<string>")
    parsed = base.withColumn("p", tx.disclosure_results(F.col("facts"))).select("label", "facts", "p.*")
    none = F.array().cast("array<struct<reported_eps:double,consensus_eps:double,reported_revenue:double,consensus_revenue:double,abnormal_return:double>>")
    built = fam.with_fls(parsed, "facts")
    null = F.lit(None).cast("double")
    guide = built.withColumns({n: null for n in ("revenue_low", "revenue_high", "eps_low", "eps_high", "ebitda", "margin",
                                                 "revenue_consensus", "eps_consensus")}).withColumns(fam.guidance_block())
    eps, rev = fam.eps_block(none), fam.revenue_block(none)
    guide = guide.withColumns({f"__{n}": c for n, c in {**eps, **rev}.items()})
    for n in (*fv.EPS_FEATURES, *fv.REVENUE_FEATURES):
        guide = guide.withColumn(n, F.col(f"__{n}")).drop(f"__{n}")
    zero = [n for n in fv.FEATURES if n not in guide.columns and n not in fv.REASONING_FEATURES and n not in fv.INTERACTION_FEATURES]
    guide = guide.withColumns({n: F.lit(0.0) for n in zero}).withColumns(fam.interaction_block())
    guide = guide.withColumns({f"{r}_{w}": F.lit(0.0) for r in ("company", "peer", "sector") for w in ("signal", "articles", "confidence")})
    wide = rs.with_reasoning(guide)
    return wide.withColumn("fls_nonzero", sum([(F.abs(F.col(n)) > fv.NEGLIGIBLE).cast("int") for n in fv.FLS_FEATURES], F.lit(0))).withColumn(
        "parsed", (F.col("has_eps_surprise") == 1.0) & (F.col("has_revenue_surprise") == 1.0))


@query("k13_live_realism_gate")
def k13(spark, d):
    """The sweep winner on the three scenarios, calibrated on its validation scores."""
    done = sweep(spark, d)
    scored = rk.calibrate(scenario_rows(spark).withColumn("raw", done.model.score()), "raw", done.knots, "submitted")
    return gt.realism_gate(scored.withColumn("candidate", F.lit(done.chosen)), "candidate", done.n_validation)


@query("k14_candidate_builder")
def k14(spark, d):
    """Candidates that beat the text-only baseline, best first, with their gate."""
    done = sweep(spark, d)
    return done.builder(scenario_rows(spark))


@query("k18_scenario_report")
def k18(spark, d):
    """A text-only ridge on the production scenarios, affinely calibrated."""
    rows = role_rows(spark, d).where(F.col("role") == "train")
    seen = md.moments(rows, fv.FLS_FEATURES, "target_percentile")
    fit = md.fit_ridge(seen.slice([n for n in fv.FLS_FEATURES if n in set(seen.varying())]), 10.0)
    s = scenario_rows(spark, fv.PRODUCTION_SCENARIOS).withColumn("raw", fit.score()).withColumn(
        "final", rk.affine(F.col("raw"), **fv.AFFINE_CALIBRATION))
    return s.select("label", "raw", "final", F.array_join(F.transform(
        F.slice(ex.key_drivers(ex.contribution_array(fit)), 1, 3), lambda c: c["feature"]), ",").alias("top_drivers"))


@query("k19_candidate_verification")
def k19(spark, d):
    """Weights of the winner by family, reasoning weights first."""
    done = sweep(spark, d)
    w = done.model.table(spark).where(F.col("coefficient") != 0)
    return w.select("feature", "coefficient", tx.feature_family(F.col("feature")).alias("family"),
                    F.col("feature").startswith("reasoning_").alias("reasoning")).orderBy(F.abs("coefficient").desc(), "feature")


# --------------------------------------------------------------------------
# explanations
# --------------------------------------------------------------------------
CONTRIB_SQL = """con AS (SELECT l_orderkey, l_linenumber, l_partkey, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature,
  unnest([0.03 * ((l_quantity - 25) / 14.07), -0.05 * ((l_extendedprice - 50000) / 30011), 0.02 * ((l_discount - 0.05) / 0.0307), 0.01 * ((l_tax - 0.04) / 0.0211)]) AS contribution FROM lineitem)"""


@query("k15_feature_contributions", f"""WITH {CONTRIB_SQL} SELECT {KEY}, feature, round(contribution, 6) + 0.0 AS contribution FROM con""")
def k15(spark, d):
    return ex.contributions(parts(spark, d), FIXED, ["l_orderkey", "l_linenumber", "l_partkey"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "feature", "contribution")


@query("k15_score_reconstruction", f"SELECT {KEY}, round({RAW_SQL}, 6) + 0.0 AS rebuilt, true AS agrees FROM lineitem")
def k15b(spark, d):
    rebuilt = ex.reconstructed(ex.contribution_array(FIXED), FIXED.intercept)
    return parts(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", rebuilt.alias("rebuilt"),
                                  (F.abs(rebuilt - FIXED.raw()) < 1e-9).alias("agrees"))


@query("e22_key_drivers", """WITH li AS (SELECT *, row_number() OVER () AS rid FROM lineitem), con AS (SELECT rid, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature,
  unnest([0.03 * ((l_quantity - 25) / 14.07), -0.05 * ((l_extendedprice - 50000) / 30011), 0.02 * ((l_discount - 0.05) / 0.0307), 0.01 * ((l_tax - 0.04) / 0.0211)]) AS c FROM li),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY abs(c) DESC, feature) AS i FROM con),
d AS (SELECT rid, string_agg(feature, ',' ORDER BY i) AS drivers FROM r WHERE i <= 2 AND abs(c) >= 1e-6 GROUP BY rid)
SELECT drivers, count(*) AS rows FROM d GROUP BY drivers""")
def e22(spark, d):
    top = ex.key_drivers(ex.contribution_array(FIXED), 2)
    return parts(spark, d).where(F.size(top) > 0).groupBy(
        F.array_join(F.transform(top, lambda c: c["feature"]), ",").alias("drivers")).agg(F.count(F.lit(1)).alias("rows"))


@query("k20_explanation_text", f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS v, (l_quantity - 25) / 14 AS z FROM lineitem), k AS (SELECT *, 0.03 * z AS t FROM c)
SELECT {KEY}, '[' || l_orderkey || '] Key drivers (by absolute contribution):' || chr(10) || '  l_quantity: value=' || printf('%.4f', v) || ' std=' || printf('%+.3f', z) || ' coef=' || printf('%+.5f', 0.03)
  || ' contribution=' || printf('%+.5f', t) || ' (' || CASE WHEN t > 0 THEN 'positive' ELSE 'negative' END || ')' AS explanation FROM k WHERE abs(t) >= 1e-6""")
def k20(spark, d):
    one = md.LinearModel("fixed", {}, ("l_quantity",), (25.0,), (14.0,), (0.03,), 0.5)
    drivers = ex.key_drivers(ex.contribution_array(one))
    return parts(spark, d).where(F.size(drivers) > 0).select(
        "l_orderkey", "l_linenumber", "l_partkey", ex.driver_text(F.col("l_orderkey").cast("string"), drivers).alias("explanation"))


@query("d14_collapse_diagnosis", f"""WITH s AS (SELECT l_quantity, l_tax, greatest(0.05, least(0.95, {RAW_SQL})) AS score, sqrt(l_quantity * l_quantity + l_extendedprice * l_extendedprice + l_discount * l_discount + l_tax * l_tax) AS raw_norm,
  sqrt(pow((l_quantity - 25) / 14.07, 2) + pow((l_extendedprice - 50000) / 30011, 2) + pow((l_discount - 0.05) / 0.0307, 2) + pow((l_tax - 0.04) / 0.0211, 2)) AS z_norm,
  abs(0.03 * (l_quantity - 25) / 14.07) + abs(0.05 * (l_extendedprice - 50000) / 30011) + abs(0.02 * (l_discount - 0.05) / 0.0307) + abs(0.01 * (l_tax - 0.04) / 0.0211) AS c_sum,
  CAST(l_quantity <> 0 AS INT) + CAST(l_extendedprice <> 0 AS INT) + CAST(l_discount <> 0 AS INT) + CAST(l_tax <> 0 AS INT) AS nz FROM lineitem)
SELECT count(*) AS n, round(avg(nz), 6) + 0.0 AS mean_nonzero_features, round(avg(raw_norm), 4) + 0.0 AS mean_raw_norm, round(avg(z_norm), 6) + 0.0 AS mean_standardized_norm, round(avg(c_sum), 6) + 0.0 AS mean_contribution_sum,
  count(*) FILTER (WHERE abs(score - 0.05) < 1e-9) AS clip_lower_hits, count(*) FILTER (WHERE abs(score - 0.95) < 1e-9) AS clip_upper_hits, round(stddev_pop(score), 6) + 0.0 AS prediction_std,
  'not_collapsed' AS primary_cause FROM s""")
def d14(spark, d):
    from tidemark.plans.training import collapse_diagnosis

    out = collapse_diagnosis(parts(spark, d), FIXED, F.lit(False))
    return out.withColumn("mean_raw_norm", F.round("mean_raw_norm", 4)).select(
        "n", "mean_nonzero_features", "mean_raw_norm", "mean_standardized_norm", "mean_contribution_sum", "clip_lower_hits",
        "clip_upper_hits", "prediction_std", "primary_cause")


@query("k17_diagnostic_summary", f"""WITH s AS (SELECT {RAW_SQL} AS raw FROM lineitem), q AS (SELECT quantile_cont(raw, 0.5) AS med, stddev_pop(raw) AS sd FROM s)
SELECT count(*) AS n, round(avg(abs(raw - med) / sd), 6) + 0.0 AS mean_signal_z, round(avg(least(1.0, 2 * abs(greatest(0.05, least(0.95, 0.5 + 3.42554 * (raw - 0.5))) - 0.5))), 6) + 0.0 AS mean_extremeness FROM s, q""")
def k17(spark, d):
    s = parts(spark, d).select(FIXED.raw().alias("raw"))
    q = rank_stats(s, "raw").agg(quantile_from_ranks("raw", 0.5).alias("med"), F.stddev_pop("raw").alias("sd"))
    z = F.when(F.col("sd") <= fv.NEGLIGIBLE, 0.0).otherwise(F.abs(F.col("raw") - F.col("med")) / F.col("sd"))
    submitted = rk.affine(F.col("raw"), **fv.AFFINE_CALIBRATION)
    return with_one_row(s, q).agg(
        F.count(F.lit(1)).alias("n"), F.avg(z).alias("mean_signal_z"),
        F.avg(F.least(F.lit(1.0), 2.0 * F.abs(submitted - 0.5))).alias("mean_extremeness"))


#: Words of the claims beside those of the documents, as this query's lexicon.
PAIR_UP, PAIR_DOWN, PAIR_GUIDANCE = ("beat", "raised", "grew"), ("missed", "lowered", "headwinds"), "outlook"


def _pair_sql() -> str:
    """SQL twin of ``claims`` and of the text counters."""
    hits = lambda words: " + ".join(f"(length(low) - length(replace(low, '{w}', ''))) // {len(w)}" for w in words)
    return f"""t AS (SELECT o_orderkey AS event_id, o_orderkey % 97 + 1 AS a, o_orderkey % 89 + 1 AS b, text FROM orders LEFT JOIN documents ON doc_id = o_orderkey),
u AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'EPS of $' || a || '.25 vs. consensus $' || b || '.50' WHEN 1 THEN 'Revenue beat  consensus by ' || a || '%.'
  WHEN 2 THEN 'Revenue missed analyst estimates by ' || a || '.5% in the period' WHEN 3 THEN 'EPS was in line with consensus.'
  WHEN 4 THEN 'We raised our full-year outlook to ' || a || ' million units and expect growth.' WHEN 5 THEN 'The company lowered its guidance amid headwinds we expect to persist.'
  WHEN 6 THEN 'Net sales of $' || a || ' million versus expectations of $' || b || ' million' ELSE 'Revenue grew ' || a || '% year over year in 2024' END || coalesce(chr(10) || text, '') AS text FROM t),
v AS (SELECT event_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_facts, CAST(length(text) AS BIGINT) AS text_length, lower(replace(text, chr(10), ' ')) AS low FROM u),
w AS (SELECT *, CAST({hits(PAIR_UP)} AS BIGINT) AS positive_hits, CAST({hits(PAIR_DOWN)} AS BIGINT) AS negative_hits FROM v)"""


@query("k21_training_pairs", f"""WITH {LABELLED_SQL}, {_pair_sql()}
SELECT event_id, ticker, event_type, n_facts, text_length, positive_hits, negative_hits, positive_hits - negative_hits AS net_sentiment, contains(low, '{PAIR_GUIDANCE}') AS has_guidance_mention,
  round(realized, 6) + 0.0 AS realized FROM labelled JOIN w USING (event_id)""")
def k21(spark, d):
    """Eight text features and the within-quarter label of every labelled event; the document of the same number, where there is one, follows the claim."""
    from tidemark.plans.text_news import claims, facts

    more = facts(spark, d).select(F.col("doc_id").alias("event_id"), F.col("facts").alias("more"))
    told = claims(spark, d).select("event_id", F.array("claim").alias("claim")).join(more, "event_id", "left")
    told = told.select("event_id", F.when(F.col("more").isNull(), F.col("claim")).otherwise(F.concat("claim", "more")).alias("facts"))
    lex = fam.lexicon_block(F.col("facts"), PAIR_UP, PAIR_DOWN, PAIR_GUIDANCE)
    return labelled(spark, d).join(told, "event_id").select("event_id", "ticker", "event_type", *[c.alias(n) for n, c in lex.items()], "realized")


# --------------------------------------------------------------------------
# reasoning
# --------------------------------------------------------------------------
def reasoning_inputs(spark, d) -> DataFrame:
    """Feature columns the event scores read, derived from order keys."""
    k, x = F.col("o_orderkey"), lambda c: F.col("o_orderkey") % c
    cols = {
        "has_eps_surprise": (x(3) != 0).cast("double"), "has_revenue_surprise": (x(4) != 0).cast("double"), "has_numeric_guidance": (x(5) == 0).cast("double"),
        "guidance_direction": (x(7) % 3 - 1).cast("double"), "eps_surprise_percent": (x(41) - 20) / 150.0, "revenue_surprise_percent": (x(31) - 15) / 170.0,
        "guidance_surprise_percent": (x(23) - 11) / 130.0, "numeric_guidance_raised": (x(6) == 0).cast("double"), "guidance_raised": (x(7) % 3 == 2).cast("double"),
        "numeric_guidance_lowered": (x(6) == 1).cast("double"), "guidance_lowered": (x(7) % 3 == 0).cast("double"), "return_20d": (x(51) - 25) / 140.0,
        "stock_minus_sector_20d": (x(19) - 9) / 110.0, "peer_abnormal_return_1d": (x(17) - 8) / 130.0, "recent_peer_eps_surprise_mean": (x(13) - 6) / 37.0,
        "recent_peer_revenue_surprise_mean": (x(11) - 5) / 43.0, "sector_return_5d": (x(9) - 4) / 41.0, "similar_earnings_event_mean_reaction": (x(15) - 7) / 130.0,
        "has_company_earnings_history": (x(2) == 0).cast("double"), "company_signal": (x(21) - 10) / 11.0, "company_articles": x(4).cast("double"),
        "company_confidence": x(4) * 0.7, "peer_signal": (x(27) - 13) / 15.0, "peer_articles": x(3).cast("double"), "peer_confidence": x(3) * 0.6,
        "sector_signal": (x(33) - 16) / 17.0, "sector_articles": (x(5) % 2).cast("double"), "sector_confidence": (x(5) % 2) * 0.8,
    }
    return table(spark, d, "orders").select(k.alias("event_id"), *[c.alias(n) for n, c in cols.items()])


def _c(x, lo="-1", hi="1"):
    return f"greatest({lo}, least({hi}, {x}))"


REASON_SQL = """i AS (SELECT o_orderkey AS event_id, o_orderkey % 3 <> 0 AS he, o_orderkey % 4 <> 0 AS hr, o_orderkey % 5 = 0 OR o_orderkey % 7 % 3 <> 1 AS hg,
  (o_orderkey % 41 - 20) / 150.0::DOUBLE AS ep, (o_orderkey % 31 - 15) / 170.0::DOUBLE AS rp, (o_orderkey % 23 - 11) / 130.0::DOUBLE AS gp,
  o_orderkey % 6 = 0 OR o_orderkey % 7 % 3 = 2 AS up, o_orderkey % 6 = 1 OR o_orderkey % 7 % 3 = 0 AS down, o_orderkey % 2 = 0 AS hh,
  (o_orderkey % 51 - 25) / 140.0::DOUBLE AS run, (o_orderkey % 19 - 9) / 110.0::DOUBLE AS rel, (o_orderkey % 17 - 8) / 130.0::DOUBLE AS pa, (o_orderkey % 13 - 6) / 37.0::DOUBLE AS pe,
  (o_orderkey % 11 - 5) / 43.0::DOUBLE AS pr, (o_orderkey % 9 - 4) / 41.0::DOUBLE AS s5, (o_orderkey % 15 - 7) / 130.0::DOUBLE AS sim, (o_orderkey % 21 - 10) / 11.0::DOUBLE AS cs,
  (o_orderkey % 27 - 13) / 15.0::DOUBLE AS ps, (o_orderkey % 33 - 16) / 17.0::DOUBLE AS ss, o_orderkey % 4 AS ca, o_orderkey % 3 AS pn, o_orderkey % 5 % 2 AS sa FROM orders),
a AS (SELECT *, CASE WHEN he THEN """ + _c("ep * 8") + " ELSE 0 END AS e, CASE WHEN hr THEN " + _c("rp * 10") + " ELSE 0 END AS r, CASE WHEN up THEN " + _c(_c("gp * 8") + " + 0.35") + " ELSE " + _c("gp * 8") + """ END AS g0 FROM i),
b AS (SELECT *, CASE WHEN hg THEN CASE WHEN down THEN """ + _c("g0 - 0.35") + " ELSE g0 END ELSE 0 END AS g, " + _c("-2.2 * run - 1.4 * rel") + " AS priced, " + _c(f"0.55 * {_c('2.5 * pa + 1.5 * pe + pr')} + 0.45 * ps") + " AS peer, " + _c(f"0.35 * {_c('3 * s5')} + 0.65 * ss") + " AS sec, " + _c("sim / 0.08") + """ AS hist FROM a),
c AS (SELECT *, CASE WHEN he AND hr THEN (e + r) / 2 ELSE e + r END AS h, """ + _c("0.45 * e + 0.25 * r + 0.30 * g") + """ AS gap FROM b),
reas AS (SELECT event_id, e AS reasoning_earnings_quality, r AS reasoning_revenue_quality, g AS reasoning_guidance_quality, gap AS reasoning_expectations_gap, priced AS reasoning_priced_in_score, cs AS reasoning_company_news_signal,
  peer AS reasoning_peer_signal, sec AS reasoning_sector_signal, hist AS reasoning_historical_analogy_signal,
  CASE WHEN hg AND (he OR hr) THEN CASE WHEN h * g < 0 THEN least(1.0, abs(h - g) / 1.6) ELSE least(0.35, abs(h - g) / 3.0) END ELSE 0 END AS reasoning_contradiction_score,
  """ + _c("0.20 * e + 0.13 * r + 0.24 * g + 0.10 * cs + 0.09 * peer + 0.05 * sec + 0.07 * hist + 0.07 * gap + 0.05 * priced") + """ AS reasoning_overall_event_signal,
  greatest(abs(e), abs(r), abs(g), abs(cs), abs(peer), abs(sec), abs(hist)) AS reasoning_materiality,
  """ + _c("0.20 + 0.08 * (CAST(he AS INT) + CAST(hr AS INT) + CAST(hg AS INT) + CAST(ca > 0 AS INT) + CAST(pn > 0 AS INT) + CAST(sa > 0 AS INT) + CAST(hh AS INT)) + 0.20 * CASE WHEN ca + pn + sa > 0 THEN (ca * 0.7 + pn * 0.6 + sa * 0.8) / (ca + pn + sa) ELSE 0 END", "0.15", "0.95") + """ AS reasoning_confidence,
  he OR hr OR o_ok AS gate FROM (SELECT *, event_id % 5 = 0 OR hh AS o_ok FROM c))"""


@query("j02_event_scores", f"WITH {REASON_SQL} SELECT event_id, {r6(*fv.REASONING_FEATURES[:-1])} FROM reas")
def j02(spark, d):
    return rs.with_reasoning(reasoning_inputs(spark, d)).select("event_id", *fv.REASONING_FEATURES[:-1])


@query("j03_gated_reasoning", f"""WITH {REASON_SQL} SELECT event_id, {', '.join(f'round(CASE WHEN gate THEN {n} ELSE 0 END, 6) + 0.0 AS {n}' for n in fv.REASONING_FEATURES[:-1])}, CASE WHEN gate THEN 1.0 ELSE 0.0 END::DOUBLE AS has_reasoning FROM reas""")
def j03(spark, d):
    from tidemark.functions.pit import has_evidence

    gate = has_evidence(("has_eps_surprise", "has_revenue_surprise", "has_numeric_guidance", "has_company_earnings_history"))
    return rs.with_reasoning(reasoning_inputs(spark, d), gate).select("event_id", *fv.REASONING_FEATURES)


@query("j04_range_validation", f"""WITH {REASON_SQL}, w AS (SELECT {', '.join(f'{n} * 1.5 AS {n}' for n in fv.REASONING_FEATURES[:-1])} FROM reas)
SELECT count(*) AS rows, CAST(sum({' + '.join(f"CAST(NOT ({n} BETWEEN {'0' if n in rs.UNSIGNED else '-1'} AND 1) AS INT)" for n in fv.REASONING_FEATURES[:-1])}) AS BIGINT) AS violations FROM w""")
def j04(spark, d):
    """Scores stretched by half again, so that violations exist to be counted."""
    s = rs.with_reasoning(reasoning_inputs(spark, d))
    stretched = s.select(*[(F.col(n) * 1.5).alias(n) for n in fv.REASONING_FEATURES[:-1]])
    return stretched.agg(F.count(F.lit(1)).alias("rows"), F.sum(rs.out_of_range()).alias("violations"))


@query("j06_family_availability", """SELECT o_orderkey AS event_id, CAST(o_orderkey % 3 <> 0 AS INT)::DOUBLE AS eps, CAST(o_orderkey % 4 <> 0 AS INT)::DOUBLE AS revenue, CAST(o_orderkey % 5 = 0 AS INT)::DOUBLE AS guidance,
  CAST(o_orderkey % 2 = 0 AS INT)::DOUBLE AS company_history FROM orders""")
def j06(spark, d):
    names = ("eps", "revenue", "guidance", "company_history")
    return reasoning_inputs(spark, d).select("event_id", *fam.availability_row(names))

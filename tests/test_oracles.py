"""Every query with SQL must equal DuckDB on the smallest tables."""
import pytest

import __spark_entry__ as entry
import oracle

FOLDER = "/root/testdata/sf0.001"
SLOW = {"k07_boosted_trees", "k09_ablation_sweep", "k13_live_realism_gate", "k14_candidate_builder", "k19_candidate_verification",
        "a17_guarded_artifact_sink", "k23_enriched_training_rows"}


@pytest.fixture(scope="module")
def con():
    return oracle.duck(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, name):
    verdict = oracle.compare(name, entry.queries()[name], entry.oracle_sql()[name], spark, FOLDER, con)
    assert verdict.startswith(("OK", "EMPTY")), verdict
    assert "KINDS" not in verdict, verdict


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql()) - SLOW))
def test_runs(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["e01_percentile_rank", "e03_average_rank_spearman", "c03_prior_company_history", "c04_price_asof",
                                  "d01_company_history", "e04_trailing_returns", "e05_realised_volatility", "e06_max_drawdown",
                                  "e08_volume_zscore", "e15_latest_n_before_cutoff", "e19_priority_queue", "e20_midrank_calibration",
                                  "e21_calibrator_fit", "c05_market_and_sector", "c09_backward_lag_match"])
def test_split_plans_match_sql(spark, con, name):
    spark.conf.set("spark.tidemark.rowsPerTask", "100")
    try:
        verdict = oracle.compare(name, entry.queries()[name], entry.oracle_sql()[name], spark, FOLDER, con)
    finally:
        spark.conf.unset("spark.tidemark.rowsPerTask")
    assert verdict.startswith("OK"), verdict

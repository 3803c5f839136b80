"""Every cause of collapsed scores, and live scores in both forms."""
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models as md
from tidemark.plans.training import collapse_diagnosis
from tidemark.sources import vendors as vn

WIDE, FLAT, NEAR, FAR = [i / 10 - 2 for i in range(40)], [3.0] * 40, [0.1] * 40, [3.0, -3.0] * 20
CASES = {
    "not_collapsed": (WIDE, 0.1, False),
    "input_starvation_empty_disclosure": (FLAT, 0.1, True),
    "input_starvation_features_at_training_mean": (NEAR, 0.1, False),
    "model_shrinkage_coefficients_too_small": (FAR, 0.0001, False),
    "collapsed_cause_undetermined": (FLAT, 0.1, False),
}


@pytest.mark.parametrize("cause", CASES)
def test_cause(spark, cause):
    values, weight, empty = CASES[cause]
    model = md.LinearModel("fixed", {}, ("x",), (0.0,), (1.0,), (weight,), 0.5)
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    assert collapse_diagnosis(rows, model, F.lit(empty)).first()["primary_cause"] == cause


def test_live_scores_by_form(spark, tmp_path):
    rows = spark.createDataFrame([("abc", 0.5, 0.25, 0.1), (None, 0.5, 0.75, None), ("lost", None, 0.5, 0.1)],
                                 "ticker string, predicted_percentile double, realized_percentile double, car1 double")
    rows.write.option("header", True).csv(str(tmp_path / "scores"))
    rows.write.json(str(tmp_path / "csv-named"))
    want = [("?", 0.5, 0.75, None), ("ABC", 0.5, 0.25, 0.1)]
    for name, form in (("scores", "csv"), ("csv-named", "json")):
        got = vn.read_live_scores(spark, str(tmp_path / name), form).collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    with pytest.raises(ValueError):
        vn.read_live_scores(spark, str(tmp_path / "scores"), "xml")

"""Fits from distributed moments against direct numpy solutions."""
import numpy as np
import pytest

from tidemark.operators import explain as ex
from tidemark.operators import models as md
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4)) * [1, 50, 0.1, 1] + [0, 1e4, 0, 0]
    x[:, 3] = 2.0
    y = 0.5 + 0.1 * x[:, 0] - 0.002 * (x[:, 1] - 1e4) + 0.05 * rng.normal(size=400)
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, flat double, y double")
    return df.repartition(3), x, y


def z_of(x):
    sd = x.std(axis=0)
    sd[sd <= 1e-12] = 1.0
    return (x - x.mean(axis=0)) / sd


def test_moments_and_constant_columns(data):
    df, x, y = data
    m = md.moments(df, ["a", "b", "c", "flat"], "y")
    assert m.n == 400 and m.varying() == ["a", "b", "c"]
    assert np.allclose(m.cov, np.cov(x.T, bias=True), atol=1e-7) and np.isclose(m.target_mean, y.mean())


@pytest.mark.parametrize("alpha", [1.0, 100.0])
def test_ridge(data, alpha):
    df, x, y = data
    z = z_of(x[:, :3])
    want = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y - y.mean()))
    got = md.fit_ridge(md.moments(df, ["a", "b", "c"], "y"), alpha)
    assert np.allclose(got.coefficients, want, atol=1e-9) and np.isclose(got.intercept, y.mean())


def test_elastic_net_meets_its_optimality_conditions(data):
    df, x, y = data
    z, alpha, ratio = z_of(x[:, :3]), 0.02, 0.5
    w = np.array(md.fit_elastic_net(md.moments(df, ["a", "b", "c"], "y"), alpha, ratio).coefficients)
    grad = z.T @ (y - y.mean() - z @ w) / len(y) - alpha * (1 - ratio) * w
    on = w != 0
    assert np.allclose(grad[on], alpha * ratio * np.sign(w[on]), atol=1e-8) and np.all(np.abs(grad[~on]) <= alpha * ratio + 1e-8)


def test_sign_constraint_binds(data):
    df, x, y = data
    w = md.fit_sign_constrained(md.moments(df, ["a", "b", "c"], "y"), 1.0, {"a": -1, "b": 1}).coefficients
    assert w[0] == 0.0 and w[1] == 0.0
    free = md.fit_sign_constrained(md.moments(df, ["a", "b", "c"], "y"), 1.0, {})
    assert np.allclose(free.coefficients, md.fit_ridge(md.moments(df, ["a", "b", "c"], "y"), 1.0).coefficients, atol=1e-9)


def test_scores_agree_in_all_forms(data):
    df, _, _ = data
    model = md.fit_ridge(md.moments(df, ["a", "b", "c"], "y"), 1.0)
    wide = df.select("y", model.score().alias("s"), model.raw().alias("raw"), ex.reconstructed(ex.contribution_array(model), model.intercept).alias("r"))
    row = wide.agg(F.max(F.abs(F.col("raw") - F.col("r"))).alias("d"), F.sum("s").alias("s")).first()
    long = md.score_all(df, {"m": model, "n": model}, ["y"]).groupBy("candidate").agg(F.sum("score").alias("s")).collect()
    assert row["d"] < 1e-9 and len(long) == 2 and all(abs(r["s"] - row["s"]) < 1e-6 for r in long)
    assert md.LinearModel.from_dict(model.as_dict("v")).coefficients == model.coefficients

"""Linear models as distributed moment passes plus small driver-side solves.

All candidates of a sweep share their training rows, so one pass that sums the
products of centred columns covers every ridge, elastic-net and sign-constrained
fit; what reaches the driver is a (k+1) x (k+1) matrix, independent of the rows.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv


def standardisation(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(name, mean, sd) with population deviation; a flat column gets sd 1."""
    sums = df.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"m_{n}").alias("mean"),
                              F.when(F.col(f"s_{n}") <= fv.NEGLIGIBLE, 1.0).otherwise(F.col(f"s_{n}")).alias("sd")) for n in names])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


@dataclass(frozen=True)
class Moments:
    """Row count, means, and centred second moments of features and target."""

    names: tuple[str, ...]
    n: int
    means: np.ndarray
    target_mean: float
    cov: np.ndarray        # features x features, divided by n
    cross: np.ndarray      # features x target, divided by n
    target_var: float
    low: np.ndarray = field(repr=False, default=None)
    high: np.ndarray = field(repr=False, default=None)

    @property
    def deviations(self) -> np.ndarray:
        sd = np.sqrt(np.maximum(np.diag(self.cov), 0.0))
        return np.where(sd <= fv.NEGLIGIBLE, 1.0, sd)

    def slice(self, names: Sequence[str]) -> "Moments":
        """The moments of a subset of the features."""
        at = [self.names.index(n) for n in names]
        return Moments(tuple(names), self.n, self.means[at], self.target_mean, self.cov[np.ix_(at, at)],
                       self.cross[at], self.target_var, self.low[at], self.high[at])

    def varying(self) -> list[str]:
        return [n for n, a, b in zip(self.names, self.low, self.high) if b - a > fv.NEGLIGIBLE]


def moments(df: DataFrame, names: Sequence[str], target: str) -> Moments:
    """Two passes: means and ranges, then summed products of centred columns.

    The products are accumulated per Arrow batch as small matrices inside the
    tasks and summed cell by cell; nothing row-sized leaves the executors.
    """
    names = tuple(names)
    cols = [*names, target]
    first = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                   *[F.min(c).alias(f"a{i}") for i, c in enumerate(cols)], *[F.max(c).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    n, k = int(first["n"]), len(cols)
    if n == 0:
        raise ValueError("no training rows")
    center = np.array([first[f"m{i}"] for i in range(k)], dtype=float)

    def gram(batches):
        import pandas as pd

        total = np.zeros((k, k))
        for batch in batches:
            z = batch.to_numpy(dtype=float) - center
            total += z.T @ z
        i, j = np.triu_indices(k)
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "v": total[i, j]})

    cells = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInPandas(
        gram, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # k(k+1)/2 cells
    g = np.zeros((k, k))
    for c in cells:
        g[c["i"], c["j"]] = g[c["j"], c["i"]] = c["v"]
    g /= n
    low = np.array([first[f"a{i}"] for i in range(k - 1)], dtype=float)
    high = np.array([first[f"b{i}"] for i in range(k - 1)], dtype=float)
    return Moments(names, n, center[:-1], float(center[-1]), g[:-1, :-1], g[:-1, -1], float(g[-1, -1]), low, high)


@dataclass(frozen=True)
class LinearModel:
    """A scored linear form over standardised features."""

    kind: str
    params: dict
    names: tuple[str, ...]
    means: tuple[float, ...]
    sds: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float
    bounds: tuple[float, float] = fv.SCORE_BOUNDS

    def raw(self) -> Column:
        """Unclipped score as one folded column expression."""
        flat = self.intercept - sum(c * m / s for c, m, s in zip(self.coefficients, self.means, self.sds))
        out = F.lit(float(flat))
        for name, c, s in zip(self.names, self.coefficients, self.sds):
            if c:
                out = out + F.col(name) * F.lit(float(c / s))
        return out

    def score(self) -> Column:
        low, high = self.bounds
        return F.greatest(F.lit(low), F.least(F.lit(high), self.raw()))

    def table(self, spark) -> DataFrame:
        """(position, feature, mean, sd, coefficient) rows."""
        rows = [(i, n, float(m), float(s), float(c)) for i, (n, m, s, c) in enumerate(
            zip(self.names, self.means, self.sds, self.coefficients))]
        return spark.createDataFrame(rows, "position int, feature string, mean double, sd double, coefficient double")

    def as_dict(self, version: str, knots: Sequence[float] = ()) -> dict:
        return {"model_version": version, "feature_names": list(self.names), "means": list(self.means),
                "standard_deviations": list(self.sds), "coefficients": list(self.coefficients), "intercept": self.intercept,
                "clip_bounds": list(self.bounds), "knots": list(knots)}

    @classmethod
    def from_dict(cls, raw: dict) -> "LinearModel":
        return cls("artifact", {}, tuple(raw["feature_names"]), tuple(raw["means"]), tuple(raw["standard_deviations"]),
                   tuple(raw["coefficients"]), float(raw["intercept"]), tuple(raw["clip_bounds"]))


def _standard(m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sd = m.deviations
    return m.cov / np.outer(sd, sd), m.cross / sd, sd


def _model(kind: str, params: dict, m: Moments, coef: np.ndarray, sd: np.ndarray) -> LinearModel:
    plain = [tuple(float(x) for x in v) for v in (m.means, sd, coef)]
    return LinearModel(kind, params, m.names, *plain, m.target_mean)


def fit_ridge(m: Moments, alpha: float) -> LinearModel:
    """Ridge on standardised columns: (Z'Z + alpha I) w = Z'y."""
    r, q, sd = _standard(m)
    coef = np.linalg.solve(r * m.n + alpha * np.eye(len(q)), q * m.n)
    return _model("ridge", {"alpha": alpha}, m, coef, sd)


def _descend(r: np.ndarray, q: np.ndarray, l1: float, l2: float, low: np.ndarray, high: np.ndarray,
             rounds: int = 3000, tolerance: float = 1e-13) -> np.ndarray:
    """Accelerated proximal descent on a small quadratic with soft threshold and bounds.

    Whole-vector steps, as a sweep solves hundreds of these; the momentum starts
    anew where it points uphill. With more columns than rows the last digits of
    flat directions would take far longer: it ends after ``rounds``."""
    step = 1.0 / (np.linalg.eigvalsh(r)[-1] + l2) if len(q) else 1.0
    w = ahead = np.zeros(len(q))
    pace = 1.0
    for _ in range(rounds):
        new = ahead - step * (r @ ahead + l2 * ahead - q)
        new = np.clip(np.sign(new) * np.maximum(np.abs(new) - step * l1, 0.0), low, high)
        move = new - w
        pace = 1.0 if (ahead - new) @ move > 0 else pace
        faster = (1.0 + (1.0 + 4.0 * pace * pace) ** 0.5) / 2.0
        ahead, w, pace = new + (pace - 1.0) / faster * move, new, faster
        if np.abs(move).max(initial=0.0) < tolerance:
            break
    return w


def fit_elastic_net(m: Moments, alpha: float, l1_ratio: float) -> LinearModel:
    """Elastic net on standardised columns, objective scaled by 1/(2n)."""
    r, q, sd = _standard(m)
    free = np.full(len(q), np.inf)
    coef = _descend(r, q, alpha * l1_ratio, alpha * (1 - l1_ratio), -free, free)
    return _model("elastic_net", {"alpha": alpha, "l1_ratio": l1_ratio}, m, coef, sd)


def fit_sign_constrained(m: Moments, alpha: float, signs: dict[str, int] = fv.SIGN_CONSTRAINTS) -> LinearModel:
    """Ridge whose listed coefficients keep their sign; intercept is the mean."""
    r, q, sd = _standard(m)
    low = np.array([0.0 if signs.get(n, 0) > 0 else -np.inf for n in m.names])
    high = np.array([0.0 if signs.get(n, 0) < 0 else np.inf for n in m.names])
    coef = _descend(r, q, 0.0, alpha / m.n, low, high)
    return _model("constrained_ridge", {"alpha": alpha}, m, coef, sd)


def candidates(m: Moments, ridge=fv.RIDGE_ALPHAS, elastic=fv.ELASTIC_ALPHAS, ratios=fv.ELASTIC_L1_RATIOS,
               constrained: Sequence[float] = ()) -> list[LinearModel]:
    """Every linear candidate of a sweep from one set of moments."""
    return ([fit_ridge(m, a) for a in ridge] + [fit_elastic_net(m, a, q) for a in elastic for q in ratios]
            + [fit_sign_constrained(m, a) for a in constrained])


def fit_boosted_trees(train: DataFrame, names: Sequence[str], target: str):
    """The non-linear candidate: 200 boosting rounds, shallow trees, seed 7."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    gbt = GBTRegressor(featuresCol="__x", labelCol=target, predictionCol="tree_score", maxIter=200, maxDepth=4, stepSize=0.05, seed=7)
    return Pipeline(stages=[VectorAssembler(inputCols=list(names), outputCol="__x"), gbt]).fit(train)


def score_all(df: DataFrame, models: dict[str, LinearModel], keep: Sequence[str]) -> DataFrame:
    """Clipped scores of many models in long form (candidate, score).

    One matrix product per Arrow batch: with hundreds of candidates over 173
    columns a column expression would have tens of thousands of terms.
    """
    labels = list(models)
    names = list(dict.fromkeys(n for m in models.values() for n in m.names))
    weight, flat = np.zeros((len(names), len(labels))), np.zeros(len(labels))
    low, high = np.zeros(len(labels)), np.zeros(len(labels))
    for j, m in enumerate(models.values()):
        for n, mean, sd, c in zip(m.names, m.means, m.sds, m.coefficients):
            weight[names.index(n), j] += c / sd
            flat[j] -= c * mean / sd
        flat[j] += m.intercept
        low[j], high[j] = m.bounds
    keep = list(keep)

    def product(batches):
        import pandas as pd

        for batch in batches:
            x = batch[[f"__f{i}" for i in range(len(names))]].to_numpy(dtype=float)
            scores = np.clip(x @ weight + flat, low, high)
            out = batch[keep].loc[batch.index.repeat(len(labels))].reset_index(drop=True)
            out["candidate"] = labels * len(batch)
            out["score"] = scores.reshape(-1)
            yield out

    picked = df.select(*keep, *[F.col(n).cast("double").alias(f"__f{i}") for i, n in enumerate(names)])
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields if f.name in keep]
    return picked.mapInPandas(product, ", ".join([*kinds, "candidate string", "score double"]))

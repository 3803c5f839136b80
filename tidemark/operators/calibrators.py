"""Extension surface for models and calibrators.

A model offers ``fit(rows) -> model`` and ``score(rows) -> rows``; a calibrator
offers ``apply(rows)``, ``as_dict()`` and ``from_dict()``."""
from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv
from tidemark.operators import models as md
from tidemark.operators import ranks as rk


@runtime_checkable
class PercentileModel(Protocol):
    def fit(self, rows: DataFrame) -> "PercentileModel": ...

    def score(self, rows: DataFrame, out: str = "score") -> DataFrame: ...


@dataclass
class RidgePercentile:
    """Ridge over named feature columns."""

    names: tuple[str, ...]
    target: str = "target_percentile"
    alpha: float = 10.0
    model: md.LinearModel | None = None

    def fit(self, rows: DataFrame) -> "RidgePercentile":
        return RidgePercentile(self.names, self.target, self.alpha, md.fit_ridge(md.moments(rows, self.names, self.target), self.alpha))

    def score(self, rows: DataFrame, out: str = "score") -> DataFrame:
        if self.model is None:
            raise ValueError("fit the model first")
        return rows.withColumn(out, self.model.score())


@dataclass(frozen=True)
class NeutralModel:
    """0.5 for every row."""

    def fit(self, rows: DataFrame) -> "NeutralModel":
        return self

    def score(self, rows: DataFrame, out: str = "score") -> DataFrame:
        return rows.withColumn(out, F.lit(0.5))


@dataclass(frozen=True)
class MidrankCalibrator:
    """Share of past out-of-sample scores below a score, clamped."""

    knots: tuple[float, ...]
    source: str
    n_fitted: int
    bounds: tuple[float, float] = fv.CALIBRATION_BOUNDS

    @classmethod
    def fit(cls, scores: DataFrame, score: str, source: str, bounds=fv.CALIBRATION_BOUNDS, max_knots: int = fv.CALIBRATION_KNOTS):
        rows = rk.fit_knots(scores, score, max_knots).orderBy("knot_index").collect()  # at most max_knots rows
        if not rows:
            raise ValueError("calibration needs at least one score")
        return cls(tuple(float(r["knot"]) for r in rows), source, int(rows[0]["n_fitted"]), tuple(bounds))

    def apply(self, rows: DataFrame, score: str, out: str = "calibrated") -> DataFrame:
        table = rows.sparkSession.createDataFrame([(i, k) for i, k in enumerate(self.knots)], "knot_index int, knot double")
        return rk.calibrate(rows, score, table, out, self.bounds)

    def as_dict(self) -> dict:
        return {"method": "empirical_oos_midrank_cdf", "version": "calibration_v1", "source": self.source, "n_fitted": self.n_fitted,
                "n_knots": len(self.knots), "bounds": list(self.bounds), "knots": list(self.knots)}

    @classmethod
    def from_dict(cls, raw: dict) -> "MidrankCalibrator":
        knots = tuple(float(k) for k in raw["knots"])
        return cls(knots, str(raw.get("source") or "unspecified"), int(raw.get("n_fitted") or len(knots)),
                   tuple(raw.get("bounds") or fv.CALIBRATION_BOUNDS))


@dataclass(frozen=True)
class AffineCalibrator:
    """Linear stretch around a centre, clamped."""

    center_raw: float = 0.5
    center_target: float = 0.5
    scale: float = 3.42554
    low: float = 0.05
    high: float = 0.95

    def __post_init__(self):
        if self.scale <= 0 or not 0.0 <= self.low < self.high <= 1.0:
            raise ValueError("invalid affine calibration")

    def apply(self, rows: DataFrame, score: str, out: str = "calibrated") -> DataFrame:
        return rows.withColumn(out, rk.affine(F.col(score), **self.as_dict()))

    def as_dict(self) -> dict:
        return {"center_raw": self.center_raw, "center_target": self.center_target, "scale": self.scale, "low": self.low, "high": self.high}

    @classmethod
    def from_dict(cls, raw: dict) -> "AffineCalibrator":
        return cls(**raw)

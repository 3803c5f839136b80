"""Evaluation aggregates: correlation, error, dispersion and incremental R²."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv
from tidemark.operators.scan import average_rank, largest_group, quantile_from_ranks, rank_stats


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation of the rows where both are known; NULL when either
    side is (nearly) constant."""
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > fv.NEGLIGIBLE) & (sy > fv.NEGLIGIBLE), F.try_divide(F.covar_pop(x, y), sx * sy))


def share(condition: Column) -> Column:
    """Fraction of rows meeting a condition."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def ranked_pair(df: DataFrame, predicted: str, actual: str, within: Sequence[str] = (), biggest: int | None = None) -> DataFrame:
    """Attach the average-tie ranks of both columns (for Spearman)."""
    if biggest is None:
        biggest = largest_group(df.select(*within), within)
    df = rank_stats(df, predicted, within, "__p", biggest)
    df = rank_stats(df, actual, within, "__a", biggest)
    return df.withColumn("rank_predicted", average_rank("__p")).withColumn("rank_actual", average_rank("__a")).drop(
        "__aless", "__aequal", "__an")


def error_aggregates(predicted: str, actual: str) -> list[Column]:
    """Counts, correlations, errors and spread of one prediction column over
    rows prepared by :func:`ranked_pair`."""
    p, y = F.col(predicted), F.col(actual)
    return [
        F.count(F.lit(1)).alias("n"),
        safe_corr(p, y).alias("pearson"),
        safe_corr(F.col("rank_predicted"), F.col("rank_actual")).alias("spearman"),
        F.avg(F.abs(p - y)).alias("mae"),
        F.sqrt(F.avg((p - y) * (p - y))).alias("rmse"),
        F.stddev_pop(p).alias("prediction_std"),
        F.min(p).alias("minimum_prediction"),
        F.max(p).alias("maximum_prediction"),
        quantile_from_ranks(predicted, 0.05, "__p").alias("prediction_p05"),
        quantile_from_ranks(predicted, 0.95, "__p").alias("prediction_p95"),
        share(p.between(*fv.NEAR_HALF_TIGHT)).alias("fraction_between_048_052"),
    ]


def metric_set(df: DataFrame, predicted: str, actual: str, by: Sequence[str] = (), biggest: int | None = None) -> DataFrame:
    """The full metric row, overall or per group; predictions are ranked once.
    ``biggest`` spares the group count when the largest group is known."""
    ranked = ranked_pair(df, predicted, actual, by, biggest)
    aggs = error_aggregates(predicted, actual)
    return ranked.groupBy(*by).agg(*aggs) if by else ranked.agg(*aggs)


def dispersion(predicted: str) -> list[Column]:
    """Distribution statistics of a score column over rows that carry its rank
    statistics (``rank_stats(df, predicted)``); quantiles are exact."""
    p = F.col(predicted)
    cuts = {"p05": 0.05, "p25": 0.25, "median": 0.50, "p75": 0.75, "p95": 0.95}
    return [
        F.count(p).alias("n"),
        F.when(F.count(p) >= 2, F.stddev_pop(p)).otherwise(F.lit(0.0)).alias("prediction_std"),
        F.min(p).alias("minimum_prediction"),
        F.max(p).alias("maximum_prediction"),
        *[quantile_from_ranks(predicted, q).alias(name) for name, q in cuts.items()],
        share(p.between(*fv.NEAR_HALF_TIGHT)).alias("fraction_between_048_052"),
        share(p.between(*fv.NEAR_HALF_WIDE)).alias("fraction_between_045_055"),
        F.countDistinct(F.round(p, 4)).alias("unique_predictions_4dp"),
        F.avg(p).alias("mean_prediction"),
    ]


def collapsed(std: str = "prediction_std", near_half: str = "fraction_between_048_052") -> Column:
    """Whether a score distribution is effectively constant."""
    return (F.col(std) < 0.01) | (F.col(near_half) > 0.90)


def incremental_r2(df: DataFrame, predicted: str, benchmark: str, actual: str, by: Sequence[str] = ()) -> DataFrame:
    """R² of the benchmark alone, of benchmark plus prediction, and their gap.

    Closed form from the three pairwise correlations: no matrix is built, and
    one aggregate serves any number of groups.
    """
    known = df.where(F.col(benchmark).isNotNull() & F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    p, s, y = F.col(predicted), F.col(benchmark), F.col(actual)
    moments = known.groupBy(*by) if by else known.groupBy()
    m = moments.agg(
        F.count(F.lit(1)).alias("n"),
        F.stddev_pop(y).alias("__sy"),
        safe_corr(y, p).alias("__yp"), safe_corr(y, s).alias("__ys"), safe_corr(p, s).alias("__ps"),
        F.stddev_pop(p).alias("__sp"), F.stddev_pop(s).alias("__ss"),
    )
    yp, ys = F.coalesce(F.col("__yp"), F.lit(0.0)), F.coalesce(F.col("__ys"), F.lit(0.0))
    ps = F.coalesce(F.col("__ps"), F.lit(0.0))
    usable = (F.col("n") >= 3) & (F.col("__sy") * F.col("__sy") * F.col("n") > fv.NEGLIGIBLE)
    collinear = F.abs(ps) > 1 - 1e-12
    both = F.when(collinear, F.greatest(yp * yp, ys * ys)).otherwise(
        (yp * yp + ys * ys - 2 * yp * ys * ps) / (1 - ps * ps))
    return m.select(
        *by, "n",
        F.when(usable, ys * ys).alias("r2_surprise_only"),
        F.when(usable, both).alias("r2_prediction_plus_surprise"),
        F.when(usable, both - ys * ys).alias("delta_r2"),
    )


def directional_hit(predicted: Column, actual: Column) -> Column:
    """1 for the same side of 0.5, 0 for opposite sides, ½ when on the line."""
    side = (predicted - 0.5) * (actual - 0.5)
    return F.when(side > 0, 1.0).when((predicted != 0.5) & (actual != 0.5), 0.0).otherwise(0.5)

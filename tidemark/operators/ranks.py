"""Cross-sectional ranks, chronological splits, calibration and top-k."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv
from tidemark.session import with_one_row
from tidemark.operators.scan import (
    Running, average_rank, bucket_of, largest_group, rank_stats, rows_per_task, running, spread_percentile,
)


def percentile_rank(df: DataFrame, value: str, within: Sequence[str], out: str) -> DataFrame:
    """Average-tie percentile in [0, 1] inside each group; NULL stays NULL."""
    return rank_stats(df, value, within).withColumn(out, spread_percentile()).drop("__less", "__equal", "__n")


def tie_rank(df: DataFrame, value: str, within: Sequence[str], out: str) -> DataFrame:
    """Zero-based average-tie rank inside each group."""
    return rank_stats(df, value, within).withColumn(out, average_rank()).drop("__less", "__equal", "__n")


def chronological_split(df: DataFrame, quarter: str, holdout: int, out: str = "split") -> DataFrame:
    """Tag rows ``train``/``test``; the last ``holdout`` quarters are the test.

    The distinct quarters are a tiny aggregate (one row per calendar quarter),
    ranked on its own and broadcast: the big table is not shuffled.
    """
    quarters = df.where(F.col(quarter).isNotNull() & (F.col(quarter) != "")).select(quarter).distinct()
    newest = Window.orderBy(F.col(quarter).desc())
    count = F.count(F.lit(1)).over(Window.partitionBy())
    held = (F.row_number().over(newest) <= holdout) & (count > holdout)
    tagged = quarters.select(quarter, F.when(held, "test").otherwise("train").alias(out))
    return df.join(F.broadcast(tagged), quarter)


def quarter_role(quarter: Column, roles: dict[str, str] | None = None) -> Column:
    """Name of the evaluation role a quarter plays, else NULL."""
    out = F.lit(None).cast("string")
    for role, name in (roles or fv.ROLE_QUARTERS).items():
        out = F.when(quarter == name, F.lit(role)).otherwise(out)
    return out


# --------------------------------------------------------------------------
# calibration against a reference sample
# --------------------------------------------------------------------------
def fit_knots(scores: DataFrame, score: str, max_knots: int = fv.CALIBRATION_KNOTS) -> DataFrame:
    """Ascending knots ``(knot_index, knot)``, thinned to an even position grid.

    Positions come from tie counts per distinct score, so picking knot ``i``
    means finding the distinct score whose run of positions covers it.
    """
    values = scores.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("knot")).agg(
        F.count(F.lit(1)).alias("__times"))
    values = values.withColumn("__all", F.lit(0)).withColumn("__t", F.col("knot").cast("double"))
    placed = running(values, ["__all"], ["__t"], [Running("sum", F.col("__times"), "__upto")])
    total = scores.where(F.col(score).isNotNull()).agg(F.count(F.lit(1)).alias("n_fitted"))
    sized = with_one_row(placed, total)
    size = F.least(F.col("n_fitted"), F.lit(max_knots))
    step = (F.col("n_fitted") - 1) / F.greatest(size - 1, F.lit(1))
    first = F.col("__upto") - F.col("__times")
    thin = F.col("n_fitted") > max_knots
    # candidate grid indices around this run, then an exact test on the position
    low = F.when(thin, F.floor((first - 1) / step)).otherwise(first)
    high = F.when(thin, F.ceil((F.col("__upto") + 1) / step)).otherwise(F.col("__upto") - 1)
    spread = sized.withColumn(
        "knot_index", F.explode(F.sequence(F.greatest(low, F.lit(0)).cast("bigint"),
                                           F.least(high, size - 1).cast("bigint"))))
    at = F.least(F.col("n_fitted") - 1,
                 F.when(thin, F.bround(F.col("knot_index") * step)).otherwise(F.col("knot_index")).cast("bigint"))
    return spread.where((at >= first) & (at < F.col("__upto"))).select("knot_index", "knot", "n_fitted")


def calibrate(
    df: DataFrame, score: str, knots: DataFrame, out: str, bounds: tuple[float, float] = fv.CALIBRATION_BOUNDS
) -> DataFrame:
    """Mid-rank share of the knots below each score, clamped.

    Knots are bounded by the fit (at most ``CALIBRATION_KNOTS`` rows, checked),
    so each score finds its step by binary search and a broadcast step table;
    the scores are not shuffled.
    """
    if largest_group(knots, []) > fv.CALIBRATION_KNOTS:
        return calibrate_by_scan(df, score, knots, out, bounds)
    runs = knots.groupBy("knot").agg(F.count(F.lit(1)).alias("k")).orderBy("knot").collect()  # <= CALIBRATION_KNOTS
    low, high = bounds
    total = sum(r["k"] for r in runs)
    lookup, below = [(0.0, None, 0.0, 0.0)], 0
    for slot, r in enumerate(runs, 1):
        on, past = (below + r["k"] / 2) / total, (below + r["k"]) / total
        lookup.append((float(slot), float(r["knot"]), on, past))
        below += r["k"]
    steps = df.sparkSession.createDataFrame(lookup, "__bucket double, __knot double, __on double, __past double")
    placed = bucket_of(df, F.col(score), [float(r["knot"]) for r in runs])
    share = F.when(F.col(score) == F.col("__knot"), F.col("__on")).otherwise(F.col("__past"))
    return (
        placed.join(F.broadcast(steps), "__bucket", "left")
        .withColumn(out, F.when(F.col(score).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), share))))
        .drop("__bucket", "__knot", "__on", "__past")
    )


def calibrate_by_scan(df: DataFrame, score: str, knots: DataFrame, out: str,
                      bounds: tuple[float, float] = fv.CALIBRATION_BOUNDS) -> DataFrame:
    """The same map without a bound on the sample: one ordered scan."""
    sample = knots.groupBy(F.col("knot").cast("double").alias("__v")).agg(F.count(F.lit(1)).alias("__k"))
    asked = df.select(F.col(score).cast("double").alias("__v")).where(F.col("__v").isNotNull()).distinct()
    merged = sample.join(asked.withColumn("__asked", F.lit(True)), "__v", "full").withColumn("__all", F.lit(0))
    scanned = running(merged, ["__all"], ["__v"], [Running("sum", F.coalesce("__k", F.lit(0)), "__upto")])
    total = knots.agg(F.count(F.lit(1)).alias("__total"))
    low, high = bounds
    share = (F.col("__upto") - F.coalesce(F.col("__k"), F.lit(0)) / 2) / F.col("__total")
    lookup = with_one_row(scanned.where("__asked"), total).select(
        "__v", F.greatest(F.lit(low), F.least(F.lit(high), share)).alias(out))
    return df.withColumn("__v", F.col(score).cast("double")).join(lookup, "__v", "left").drop("__v")


def affine(score: Column, center_raw: float = 0.5, center_target: float = 0.5, scale: float = 3.42554,
           low: float = 0.05, high: float = 0.95) -> Column:
    """Linear stretch around a centre, clamped."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.lit(center_target) + F.lit(scale) * (score - F.lit(center_raw))))


# --------------------------------------------------------------------------
# top-k
# --------------------------------------------------------------------------
def top_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "place") -> DataFrame:
    """First ``k`` rows of each group.

    Spark trims each map task to ``k`` rows per group before the shuffle
    (window group limit), so a hot group never travels whole.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def cumulative_queue(df: DataFrame, weight: str, key: str) -> DataFrame:
    """Priority order (weight down, key up) with the running weight unlocked."""
    if largest_group(df, []) <= rows_per_task(df):
        ahead = Window.orderBy(F.col(weight).desc(), F.col(key)).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn("queue_position", F.row_number().over(
            Window.orderBy(F.col(weight).desc(), F.col(key))).cast("bigint")
        ).withColumn("rows_unlocked", F.sum(weight).over(ahead))
    base = df.withColumn("__all", F.lit(0)).withColumn("__w", -F.col(weight).cast("double"))
    return running(base, ["__all"], ["__w", key], [
        Running("sum", F.lit(1).cast("bigint"), "queue_position"),
        Running("sum", F.col(weight), "rows_unlocked")]).drop("__all", "__w")

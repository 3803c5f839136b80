"""Ordered scans over keyed timelines that hold up when one key is huge.

A window such as ``partitionBy(key).orderBy(ts)`` puts a whole key into one
task.  That is the best plan while every key is small, and unusable when one
key owns a third of the table.  The helpers here measure the largest key first
and choose between two exact plans:

* *plain*: an ordinary window, one shuffle on the key;
* *split*: the order column is cut at global quantiles, each ``(key, bucket)``
  is scanned on its own, and bucket totals (a few rows per key) carry the state
  of all earlier buckets.

Both give the same rows. A NULL key is a key like any other, NULL order values
come first and NaN last, as in a window.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_TASK = "spark.tidemark.rowsPerTask"
DEFAULT_ROWS_PER_TASK = 2_000_000
MAX_BUCKETS = 8192


def rows_per_task(df: DataFrame) -> int:
    """How many rows of one key a single task may hold."""
    return int(df.sparkSession.conf.get(ROWS_PER_TASK, str(DEFAULT_ROWS_PER_TASK)))


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest key (map-side combined, one small shuffle)."""
    counted = df.groupBy(*keys).count() if keys else df.agg(F.count(F.lit(1)).alias("count"))
    return int(counted.agg(F.max("count")).first()[0] or 0)


def split_points(df: DataFrame, order: Column, biggest: int) -> list[float]:
    """Ascending finite cut points that keep each slice of the biggest key small.

    Beyond ``MAX_BUCKETS`` slices, and for equal order values, a slice grows; it
    is then sorted with spilling, not held in memory."""
    total_slices = min(MAX_BUCKETS, max(2, 4 * math.ceil(biggest / rows_per_task(df))))
    shares = [i / total_slices for i in range(1, total_slices)]
    value = order.cast("double")
    row = df.agg(F.percentile_approx(F.when(~F.isnan(value), value), F.array(*map(F.lit, shares)), F.lit(20000))).first()
    return sorted({float(x) for x in (row[0] or []) if math.isfinite(x)})


def key_struct(keys: Sequence[str]) -> Column:
    """All keys as one value that is never NULL, so that joins on it keep NULL keys."""
    return F.struct(*keys) if keys else F.lit(0)


def bucket_of(df: DataFrame, order: Column, cuts: list[float], out: str = "__bucket") -> DataFrame:
    """Tag each row with its slice (JVM-side binary search over the cuts); NULL
    lies in slice -1 and NaN in one after the last."""
    if not cuts:
        return df.withColumn(out, F.lit(0.0))
    from pyspark.ml.feature import Bucketizer

    value = order.cast("double")
    tagged = df.withColumn("__order", F.when(F.isnan(value), F.lit(0.0)).otherwise(F.coalesce(value, F.lit(0.0))))
    splits = [-math.inf, *cuts, math.inf]
    placed = Bucketizer(splits=splits, inputCol="__order", outputCol=out).transform(tagged).drop("__order")
    return placed.withColumn(out, F.when(value.isNull(), F.lit(-1.0)).when(F.isnan(value), F.lit(len(cuts) + 1.0)).otherwise(F.col(out)))


def epoch(ts: Column) -> Column:
    """Seconds since the epoch as a double (microseconds survive)."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def axis(df: DataFrame, column: str) -> Column:
    """A numeric axis for an order column: timestamps in epoch seconds."""
    kind = df.schema[column].dataType.simpleString()
    return epoch(F.col(column)) if kind.startswith(("timestamp", "date")) else F.col(column).cast("double")


# --------------------------------------------------------------------------
# rank statistics
# --------------------------------------------------------------------------
def rank_stats(
    df: DataFrame, value: str, within: Sequence[str] = (), prefix: str = "__", biggest: int | None = None
) -> DataFrame:
    """Add ``less``, ``equal`` and ``n``: how many values of the same group lie
    below, tie with, and exist beside each row.  NULL values get NULLs.

    Every tie-aware rank of the library (average rank, mid-rank share, spread
    percentile) is arithmetic on these three counts.
    """
    less, equal, n = f"{prefix}less", f"{prefix}equal", f"{prefix}n"
    known = F.col(value).isNotNull()
    if biggest is None:
        biggest = largest_group(df.select(*within), within)  # counts NULLs too: an upper bound, read from the keys alone
    if biggest <= rows_per_task(df):
        groups = [F.col(c) for c in within] + [known]
        ordered = Window.partitionBy(*groups).orderBy(value)
        peers = ordered.rangeBetween(Window.currentRow, Window.currentRow)
        return (
            df.withColumn(less, F.when(known, F.rank().over(ordered) - 1).cast("bigint"))
            .withColumn(equal, F.when(known, F.count(F.lit(1)).over(peers)))
            .withColumn(n, F.when(known, F.count(F.lit(1)).over(Window.partitionBy(*groups))))
        )
    base = df.withColumn("__key", key_struct(within))
    cells = base.where(known).groupBy("__key", value).agg(F.count(F.lit(1)).alias(equal))
    cells = bucket_of(cells, F.col(value), split_points(base.where(known), F.col(value), biggest))
    totals = cells.groupBy("__key", "__bucket").agg(F.sum(equal).alias("__size"))
    earlier = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "__key", "__bucket",
        F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__base"),
        F.sum("__size").over(Window.partitionBy("__key")).alias(n),
    )
    inside = Window.partitionBy("__key", "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        cells.withColumn("__run", F.coalesce(F.sum(equal).over(inside), F.lit(0)))
        .join(totals, ["__key", "__bucket"])
        .select("__key", value, (F.col("__base") + F.col("__run")).alias(less), equal, n)
    )
    return base.join(ranked, ["__key", value], "left").select(*df.columns, less, equal, n)


def quantile_from_ranks(value: str, q: float, prefix: str = "__") -> Column:
    """Exact linear-interpolation quantile as a plain aggregate over rows that
    carry rank statistics: the value that covers position ``q (n - 1)``.  Nothing
    is gathered, unlike an exact percentile buffer."""
    at = F.lit(float(q)) * (F.col(f"{prefix}n") - 1)
    low, high = F.floor(at), F.ceil(at)
    first, last = F.col(f"{prefix}less"), F.col(f"{prefix}less") + F.col(f"{prefix}equal") - 1

    def covering(place: Column) -> Column:
        return F.max(F.when(place.between(first, last), F.col(value)))

    share = F.max(at - low)
    return covering(low) * (1 - share) + covering(high) * share


def average_rank(prefix: str = "__") -> Column:
    """Zero-based rank in which ties share the mean position."""
    return F.col(f"{prefix}less") + (F.col(f"{prefix}equal") - 1) / 2


def spread_percentile(prefix: str = "__") -> Column:
    """Average rank stretched to [0, 1]; a lone value sits at 0.5."""
    n = F.col(f"{prefix}n")
    return F.when(n == 1, F.lit(0.5)).when(n > 1, average_rank(prefix) / (n - 1))


# --------------------------------------------------------------------------
# running aggregates
# --------------------------------------------------------------------------
@dataclass(frozen=True)
class Running:
    """One running aggregate: ``sum``, ``max``, ``min`` or ``last`` (non-null)."""

    kind: str
    expr: Column
    name: str


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggs: Sequence[Running],
    biggest: int | None = None,
) -> DataFrame:
    """Add each aggregate over all rows of the key up to and including this row.

    ``order[0]`` must be numeric (see :func:`epoch`); the rest break ties.
    """
    if biggest is None:
        biggest = largest_group(df.select(*keys), keys)
    window_fn = {
        "sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True),
    }
    if biggest <= rows_per_task(df):
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumns({a.name: window_fn[a.kind](a.expr).over(upto) for a in aggs})
    sliced = bucket_of(df, F.col(order[0]), split_points(df, F.col(order[0]), biggest))
    sliced = sliced.withColumns({"__key": key_struct(keys)} | {f"__in_{a.name}": a.expr for a in aggs})

    def partial(a: Running) -> Column:
        c = F.col(f"__in_{a.name}")
        if a.kind == "last":
            return F.max_by(c, F.when(c.isNotNull(), F.struct(*order))).alias(f"__part_{a.name}")
        return window_fn[a.kind](c).alias(f"__part_{a.name}")

    earlier = Window.partitionBy("__key").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        sliced.groupBy("__key", "__bucket").agg(*[partial(a) for a in aggs])
        .select("__key", "__bucket",
                *[window_fn[a.kind](F.col(f"__part_{a.name}")).over(earlier).alias(f"__carry_{a.name}") for a in aggs])
    )
    inside = (
        Window.partitionBy("__key", "__bucket").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    scanned = sliced.withColumns(
        {f"__here_{a.name}": window_fn[a.kind](F.col(f"__in_{a.name}")).over(inside) for a in aggs}
    ).join(carried, ["__key", "__bucket"])

    def merged(a: Running) -> Column:
        here, carry = F.col(f"__here_{a.name}"), F.col(f"__carry_{a.name}")
        if a.kind == "sum":
            return F.when(here.isNull() & carry.isNull(), F.lit(None)).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0)))
        if a.kind == "last":
            return F.coalesce(here, carry)
        return (F.greatest if a.kind == "max" else F.least)(here, carry)

    out = scanned.withColumns({a.name: merged(a) for a in aggs})
    return out.select(*df.columns, *[a.name for a in aggs if a.name not in df.columns])


# --------------------------------------------------------------------------
# bounded-frame windows
# --------------------------------------------------------------------------
def rolling(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    halo: int,
    build: Callable[[DataFrame, list[str]], DataFrame],
    biggest: int | None = None,
) -> DataFrame:
    """Apply ``build(df, parts)`` where ``build`` only uses windows partitioned by
    ``parts`` (or finer) whose frames reach at most ``halo`` rows back.  ``df`` gains ``position`` (1-based row number in the key).

    A key too large for one task is cut into segments by position; each segment
    is handed the last ``halo`` rows of the one before it, so frames are whole.
    """
    order = [order] if isinstance(order, str) else list(order)
    if biggest is None:
        biggest = largest_group(df.select(*keys), keys)
    if biggest <= rows_per_task(df):
        whole = Window.partitionBy(*keys).orderBy(*order)
        return build(df.withColumn("position", F.row_number().over(whole).cast("bigint")), list(keys))
    size = max(rows_per_task(df), halo + 1)
    placed = (
        running(df.withColumn("__t", axis(df, order[0])), keys, ["__t", *order[1:]],
                [Running("sum", F.lit(1).cast("bigint"), "position")], biggest)
        .drop("__t")
    )
    segment = F.floor((F.col("position") - 1) / F.lit(size))
    offset = (F.col("position") - 1) % F.lit(size)
    both = F.when(offset >= size - halo, F.array(segment, segment + 1)).otherwise(F.array(segment))
    spread = placed.withColumn("__home", segment).withColumn("__segment", F.explode(both))
    built = build(spread, [*keys, "__segment"])
    return built.where(F.col("__segment") == F.col("__home")).drop("__segment", "__home")

"""Rolling price and volume features per session, then an as-of pick per event.

Features are computed once per (key, session) and looked up at the cutoff.
That equals recomputing them from the eligible set of each event whenever
availability follows value order (checked by ``late_revisions``); keys that
break the order go through :func:`price_features_exact`.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv
from tidemark.operators.joins import asof, late_revisions
from tidemark.operators.scan import rolling


def frame(parts: Sequence[str], order: str, rows: int):
    """The last ``rows`` rows up to and including this one."""
    return Window.partitionBy(*parts).orderBy(order).rowsBetween(1 - rows, 0)


def trailing_return(close: str, sessions: int, parts: Sequence[str], order: str) -> Column:
    """Close over the close ``sessions`` rows ago minus one; 0 when too short."""
    back = F.lag(close, sessions).over(Window.partitionBy(*parts).orderBy(order))
    return F.coalesce(F.col(close) / back - 1.0, F.lit(0.0))


def volatility(step: str, sessions: int, parts: Sequence[str], order: str) -> Column:
    """Annualised population deviation of the last ``sessions`` daily returns, for short windows (Spark adds up each of its rows anew).
    Two returns exist from the third session (``position``) on."""
    return annualised(F.stddev_pop(step).over(frame(parts, order, sessions)))


def annualised(spread: Column) -> Column:
    return F.when(F.col("position") >= 3, spread * F.sqrt(F.lit(fv.TRADING_DAYS))).otherwise(0.0)


def distance(close: str, sessions: int, high: bool, parts: Sequence[str], order: str) -> Column:
    """Close relative to the highest (lowest) close of the last rows."""
    pick = F.max if high else F.min
    return F.col(close) / pick(close).over(frame(parts, order, sessions)) - 1.0


#: Means that differ by less, relative to their size, differ by rounding.
SAME_MEAN = 1e-13


def with_blocks(df: DataFrame, sessions: int, parts: Sequence[str], samples: Sequence[str] = (), close: str | None = None) -> DataFrame:
    """Running figures within blocks of ``sessions`` consecutive positions, from the block's start up to the row (head) and
    from the row to the block's end (tail): count, mean, variance and last known value of each of ``samples``; high, low and
    worst fall of ``close``.

    The window of any row is the tail of one block (:func:`with_starts`) plus the head of the next. A tail is a running figure in
    descending order: a frame with an open end, like a sliding one, is added up anew by Spark for every row.
    """
    block = f"__b{sessions}"
    df = df.withColumn(block, F.floor((F.col("position") - 1) / F.lit(sessions)))
    for side, by, latest in (("head", F.col("position").asc(), F.last), ("tail", F.col("position").desc(), F.first)):
        upto = Window.partitionBy(*parts, block).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
        name = f"{block}_{side}_"
        told = {f"{name}{f}_{c}": x.over(upto) for c in samples for f, x in (
            ("n", F.count(c)), ("mean", F.avg(c)), ("var", F.var_pop(c)), ("last", latest(c, ignorenulls=True)))}
        if close:
            told |= {f"{name}high": F.max(close).over(upto), f"{name}low": F.min(close).over(upto)}
        df = df.withColumns(told)
        if close:
            x = F.col(close)
            fall = x / F.col(f"{name}high") if side == "head" else F.col(f"{name}low") / x
            df = df.withColumn(f"{name}fall", F.min(fall - 1.0).over(upto))
    return df


def with_starts(df: DataFrame, parts: Sequence[str], order: str) -> DataFrame:
    """The tails of :func:`with_blocks` where each row's window starts, in place of its own; NULL where the head is the whole window."""
    whole, found = Window.partitionBy(*parts).orderBy(order), {}
    tails = [c for c in df.columns if c.startswith("__b") and "_tail_" in c]
    for c in tails:
        sessions = int(c.split("_")[2][1:])
        aligned = F.col("position") % F.lit(sessions) == 0
        found[c.replace("_tail_", "_start_", 1)] = F.when(~aligned, F.lag(c, sessions - 1).over(whole))
    return df.withColumns(found).drop(*tails)


class Rows:
    """The last ``sessions`` rows, from the columns of :func:`with_starts`; a window not yet full is the head of the first block."""

    def __init__(self, sessions: int) -> None:
        self.start = lambda c: F.col(f"__b{sessions}_start_{c}")
        self.head = lambda c: F.col(f"__b{sessions}_head_{c}")

    def count(self, c: str) -> Column:
        return self.head(f"n_{c}") + F.coalesce(self.start(f"n_{c}"), F.lit(0))

    def last(self, c: str) -> Column:
        return F.coalesce(self.head(f"last_{c}"), self.start(f"last_{c}"))

    def apart(self, c: str) -> Column:
        """Mean of the older part less that of the newer; NULL unless both have values."""
        here = self.head(f"mean_{c}")
        gap = self.start(f"mean_{c}") - here
        return F.when(F.abs(gap) <= F.abs(here) * SAME_MEAN, F.lit(0.0)).otherwise(gap)

    def mean(self, c: str) -> Column:
        merged = self.head(f"mean_{c}") + self.apart(c) * self.start(f"n_{c}") / self.count(c)
        return F.when(self.apart(c).isNotNull(), merged).otherwise(F.coalesce(self.head(f"mean_{c}"), self.start(f"mean_{c}")))

    def deviation(self, c: str) -> Column:
        """Population deviation: both parts' own spread and that between their means."""
        older, newer = self.start(f"n_{c}") / self.count(c), self.head(f"n_{c}") / self.count(c)
        merged = older * self.start(f"var_{c}") + newer * self.head(f"var_{c}") + older * newer * self.apart(c) * self.apart(c)
        return F.sqrt(F.when(self.apart(c).isNotNull(), merged).otherwise(F.coalesce(self.head(f"var_{c}"), self.start(f"var_{c}"))))

    def high(self) -> Column:
        return F.greatest(self.head("high"), self.start("high"))

    def low(self) -> Column:
        return F.least(self.head("low"), self.start("low"))

    def fall(self) -> Column:
        """Worst fall from a running peak, at most 0."""
        return F.least(F.lit(0.0), self.head("fall"), self.start("fall"), self.head("low") / self.start("high") - 1.0)


def volume_zscore(volume: str) -> Column:
    """Last known volume against the last 60 rows (:class:`Rows`); needs ten known volumes."""
    rows = Rows(60)
    sd = rows.deviation(volume)
    z = (rows.last(volume) - rows.mean(volume)) / sd
    return F.when((rows.count(volume) >= 10) & (sd > fv.NEGLIGIBLE), z).otherwise(0.0)


def with_drawdown(df: DataFrame, close: str, sessions: int, parts: Sequence[str], order: str, out: str,
                  from_high: str | None = None, from_low: str | None = None) -> DataFrame:
    """Worst fall from a running peak inside the last ``sessions`` rows, and
    optionally the distance of the close from the window's high and low.

    No per-row array of prices is built and the cost per row is constant.
    """
    df = with_starts(with_blocks(df, sessions, parts, close=close), parts, order)
    rows, x = Rows(sessions), F.col(close)
    added = {out: rows.fall()}
    if from_high:
        added[from_high] = x / rows.high() - 1.0
    if from_low:
        added[from_low] = x / rows.low() - 1.0
    return without_blocks(df.withColumns(added))


def without_blocks(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__b")])


def price_features(bars: DataFrame, keys: Sequence[str], order: str = "value_timestamp", close: str = "close",
                   volume: str = "volume", biggest: int | None = None,
                   returns=fv.RETURN_WINDOWS) -> DataFrame:
    """All 19 price-context features at every session of every key."""
    halo = max([k for k, _ in returns] + [253])

    def build(df: DataFrame, parts: list[str]) -> DataFrame:
        df = df.withColumn("__step", F.col(close) / F.lag(close).over(Window.partitionBy(*parts).orderBy(order)) - 1.0)
        # a sliding frame copies each row, so it comes while rows are narrow
        df = df.withColumns({
            **{name: trailing_return(close, k, parts, order) for k, name in returns},
            "realized_volatility_20d": volatility("__step", 20, parts, order),
            "distance_from_20d_high": distance(close, 20, True, parts, order),
            "distance_from_20d_low": distance(close, 20, False, parts, order),
            "has_5y_price_history": (F.col("position") >= fv.FIVE_YEAR_SESSIONS).cast("double"),
        })
        df = with_blocks(with_blocks(df, 60, parts, ["__step", volume], close), 252, parts, ["__step"], close)
        df, quarter, year, x = with_starts(df, parts, order), Rows(60), Rows(252), F.col(close)
        return without_blocks(df.withColumns({
            "realized_volatility_60d": annualised(quarter.deviation("__step")),
            "realized_volatility_252d": annualised(year.deviation("__step")),
            "volume_zscore": volume_zscore(volume),
            "max_drawdown_60d": quarter.fall(),
            "max_drawdown_252d": year.fall(),
            "distance_from_52w_high": x / year.high() - 1.0,
            "distance_from_52w_low": x / year.low() - 1.0,
        }))

    positive = bars.where(F.col(close) > 0)
    return rolling(positive, keys, order, halo, build, biggest).drop("__step")


def features_at(events: DataFrame, featured: DataFrame, keys: Sequence[str], cutoff: str, names: Sequence[str],
                available: str = "available_at") -> DataFrame:
    """Each event with the features of the last session available at its cutoff."""
    hit = asof(events, featured, keys, cutoff, available, names, "__f", True, "position")
    return hit.select(*events.columns, *[F.coalesce(F.col(f"__f.{n}"), F.lit(0.0)).alias(n) for n in names])


def price_features_exact(events: DataFrame, bars: DataFrame, keys: Sequence[str], event_id: str, cutoff: str) -> DataFrame:
    """Per-event recomputation for keys with late revisions: each event sees
    its own eligible set, so its own windows are built."""
    pairs = events.select(*keys, event_id, cutoff).join(bars, list(keys)).where(F.col("available_at") <= F.col(cutoff))
    featured = price_features(pairs, [event_id])
    last = featured.groupBy(event_id).agg(F.max_by(F.struct(*fv.PRICE_FEATURES), "position").alias("__f"))
    return events.join(last, event_id, "left").select(
        *events.columns, *[F.coalesce(F.col(f"__f.{n}"), F.lit(0.0)).alias(n) for n in fv.PRICE_FEATURES])


def price_context(events: DataFrame, bars: DataFrame, keys: Sequence[str], event_id: str, cutoff: str,
                  biggest: int | None = None) -> DataFrame:
    """Price features per event: the shared rolling path for orderly keys, the
    per-event path for keys with late revisions."""
    late = late_revisions(bars, keys, "value_timestamp", "available_at", biggest).where("late_revisions > 0").select(*keys)
    if late.isEmpty():
        return features_at(events, price_features(bars, keys, biggest=biggest), keys, cutoff, fv.PRICE_FEATURES)
    on = list(keys)
    shared = features_at(events.join(late, on, "left_anti"),
                         price_features(bars.join(late, on, "left_anti"), keys), keys, cutoff, fv.PRICE_FEATURES)
    own = price_features_exact(events.join(late, on, "left_semi"), bars.join(late, on, "left_semi"),
                               keys, event_id, cutoff)
    return shared.unionByName(own)


def market_context(events: DataFrame, stock: DataFrame, market: DataFrame, sector: DataFrame, key: str,
                   sector_key: str, cutoff: str) -> DataFrame:
    """Eleven market and sector features.

    Stock, sector and market are as-of picks.  The market is a single key that
    holds every event; the scan measures that and cuts it into time slices.
    """
    s = features_at(events, stock, [key], cutoff, ["return_5d", "return_20d", "return_60d"])
    s = s.withColumnsRenamed({"return_5d": "__s5", "return_20d": "__s20", "return_60d": "__s60"})
    c_names = ["return_1d_pre_event", "return_5d", "return_20d", "return_60d", "realized_volatility_20d"]
    c = features_at(s, sector, [sector_key], cutoff, c_names).withColumnsRenamed(
        {n: f"__c_{n}" for n in c_names})
    m_names = ["return_1d_pre_event", "return_5d", "return_20d", "return_60d"]
    joined = features_at(c.withColumn("__market", F.lit(0)), market.withColumn("__market", F.lit(0)), ["__market"],
                         cutoff, m_names)
    m = {n: F.col(n) for n in m_names}
    return joined.select(
        *events.columns,
        m["return_1d_pre_event"].alias("market_return_1d"), m["return_5d"].alias("market_return_5d"),
        F.col("__c_return_1d_pre_event").alias("sector_return_1d"), F.col("__c_return_5d").alias("sector_return_5d"),
        F.col("__c_return_20d").alias("sector_return_20d"),
        F.col("__c_realized_volatility_20d").alias("sector_volatility_20d"),
        (F.col("__s5") - m["return_5d"]).alias("stock_minus_market_5d"),
        (F.col("__s20") - m["return_20d"]).alias("stock_minus_market_20d"),
        (F.col("__s60") - m["return_60d"]).alias("stock_minus_market_60d"),
        (F.col("__s20") - F.col("__c_return_20d")).alias("stock_minus_sector_20d"),
        (F.col("__s60") - F.col("__c_return_60d")).alias("stock_minus_sector_60d"),
    )

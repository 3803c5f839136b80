"""Point-in-time predicates, timestamps and small numeric expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv


def available(available_at: Column, cutoff: Column, inclusive: bool = True) -> Column:
    """May a record be used at this cutoff?  Inclusive (feature records) or
    strict (cached history); an unknown availability is never usable."""
    return F.coalesce(available_at <= cutoff if inclusive else available_at < cutoff, F.lit(False))


def reaction_available(reaction: Column, reaction_at: Column, cutoff: Column) -> Column:
    """A past reaction counts only when its own availability is known and past."""
    return reaction.isNotNull() & available(reaction_at, cutoff, inclusive=False)


def parse_instant(text: Column) -> Column:
    """ISO or compact timestamp to UTC; offsets honoured, garbage is NULL."""
    t = F.trim(text)
    return F.coalesce(
        F.try_to_timestamp(t),
        F.try_to_timestamp(t, F.lit("yyyyMMdd'T'HHmmss")),
        F.try_to_timestamp(t, F.lit("yyyyMMdd'T'HHmm")),
    )


def clip(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ratio(reported: Column, consensus: Column, floor: float) -> Column:
    """Surprise relative to consensus, with a floor under the denominator."""
    return (reported - consensus) / F.greatest(F.abs(consensus), F.lit(floor))


def middle(low: Column, high: Column) -> Column:
    """Centre of an optional range; one present end stands alone."""
    return F.coalesce((low + high) / 2, low, high)


def recency(published: Column, cutoff: Column) -> Column:
    """exp(-age / 72 h)."""
    hours = (F.unix_micros(cutoff.cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / F.lit(3.6e9)
    return F.exp(-F.greatest(F.lit(0.0), hours) / 72.0)


def seconds_left(deadline: Column, now: Column) -> Column:
    """Seconds until a deadline (negative when past)."""
    return (F.unix_micros(deadline.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / F.lit(1e6)


def quarter_name(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("Q"), F.quarter(ts).cast("string"))


def quarter_start(quarter: Column) -> Column:
    year, q = F.substring(quarter, 1, 4).cast("int"), F.substring(quarter, -1, 1).cast("int")
    return F.make_date(year, q * 3 - 2, F.lit(1)).cast("timestamp")


def quarter_windows(quarter: Column, days: int) -> Column:
    """Array of (start, end) request windows that tile a quarter; each window
    ends one minute before the next starts."""
    start = quarter_start(quarter)
    end = F.add_months(start, 3).cast("timestamp")
    step = F.expr(f"INTERVAL {max(1, days)} DAYS")
    starts = F.sequence(start, end - F.expr("INTERVAL 1 SECOND"), step)
    return F.transform(starts, lambda s: F.struct(
        s.alias("start"), (F.least(end, s + step) - F.expr("INTERVAL 1 MINUTE")).alias("end")))


def confidence_label(raw: Column, calibrated: Column, families: Column) -> Column:
    """Coarse label from distance to 0.5 and number of available families."""
    away = F.abs(F.coalesce(calibrated, raw) - 0.5)
    return F.when((families <= 1) | (away < 0.05), "low").when(away < 0.15, "medium").otherwise("high")


def has_evidence(flags=fv.REASONING_EVIDENCE) -> Column:
    """Any of the availability flags set."""
    return F.greatest(*[F.coalesce(F.col(f), F.lit(0.0)) for f in flags]) > 0

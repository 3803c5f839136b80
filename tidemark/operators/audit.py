"""Leakage guards, validation counts, coverage and data-quality aggregates."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv
from tidemark.operators import joins
from tidemark.operators.metrics import share
from tidemark.session import with_one_row


def forbidden_columns(names: Sequence[str], forbidden=fv.FORBIDDEN_FEATURES) -> list[str]:
    """Realised or future fields among the column names (no data is read)."""
    return [n for n in names if n in set(forbidden)]


def assert_no_leakage(df: DataFrame, forbidden=fv.FORBIDDEN_FEATURES) -> DataFrame:
    leaked = forbidden_columns(df.columns, forbidden)
    if leaked:
        raise ValueError(f"leaked realised columns: {leaked}")
    return df


def finite(names: Sequence[str]) -> Column:
    """All listed columns are known, finite numbers."""
    bad = [F.col(n).isNull() | F.isnan(n) | (F.abs(F.col(n)) == float("inf")) for n in names]
    out = F.lit(False)
    for b in bad:
        out = out | b
    return ~out


def row_problems(rows: DataFrame, names: Sequence[str], keys: Sequence[str] = ("event_id", "ticker")) -> DataFrame:
    """One row of violation counts over the training rows."""
    dup = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(
        F.coalesce(F.sum(F.when(F.col("__n") > 1, F.col("__n") - 1)), F.lit(0)).cast("bigint").alias("duplicate_keys"))
    target = F.col("target_percentile")
    other = rows.agg(
        F.count(F.when(F.coalesce("quarter", F.lit("")) == "", 1)).alias("missing_quarter"),
        F.count(F.when(target.isNull() | ~target.between(0.0, 1.0) | F.isnan(target), 1)).alias("target_out_of_range"),
        F.count(F.when(F.col("leakage_violations") != 0, 1)).alias("leakage"),
        F.count(F.when(~finite(names), 1)).alias("non_finite"))
    return with_one_row(dup, other)


def require_valid_rows(rows: DataFrame, names: Sequence[str]) -> None:
    """Raise when the training rows break any rule."""
    absent = [n for n in names if n not in rows.columns]
    if absent:
        raise ValueError(f"feature schema mismatch, missing {absent}")
    broken = {k: v for k, v in row_problems(rows, names).first().asDict().items() if v}
    if broken:
        raise ValueError(f"invalid training rows: {broken}")


def availability_violations(records: dict[str, DataFrame], cutoff: str = "cutoff") -> DataFrame:
    """Records checked and records newer than their cutoff, per family.  Every
    frame carries ``cutoff``, ``available_at`` and ``value_timestamp``; news also
    ``published_at``."""
    parts = []
    for family, df in records.items():
        late = (F.col("available_at") > F.col(cutoff)) | (F.col("value_timestamp") > F.col(cutoff))
        if "published_at" in df.columns:
            late = late | (F.col("published_at") > F.col(cutoff))
        parts.append(df.agg(F.lit(family).alias("family"), F.count(F.lit(1)).alias("checked"),
                            F.count(F.when(late, 1)).alias("violations")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def context_audit(events: DataFrame, records: dict[str, DataFrame], reasoned: dict[str, DataFrame] | None = None,
                  reasoning: DataFrame | None = None, cited: DataFrame | None = None) -> DataFrame:
    """(event_id, family, checked, violations) for every record of every event.

    ``events`` has one row (event_id, cutoff) each. ``records`` have (event_id,
    available_at, value_timestamp) and, if published, published_at: each time must be
    known and not after the cutoff of the event, not of the record. ``reasoned`` news
    have (event_id, source_id, available_at, published_at). ``reasoning`` has (event_id,
    reasoning_cutoff), which must be the event's cutoff; ``cited`` has (event_id,
    source_id), each of which must be a reasoned article of that event (family
    ``reasoning_sources``). Repeated rows of records count as often as they occur, a
    repeated citation once; rows of events that are not audited are left out, an event
    without a cutoff breaks every rule. All families go through one join on the event.
    """
    parts = []

    def add(family: str, df: DataFrame, at: Sequence[str]) -> None:
        parts.append(df.select("event_id", F.lit(family).alias("family"), F.array(*at).alias("times"), F.lit(None).cast("timestamp").alias("same")))

    for family, df in records.items():
        add(family, df, [c for c in ("available_at", "value_timestamp", "published_at") if c in df.columns])
    for family, df in (reasoned or {}).items():
        add(family, df, ["available_at", "published_at"])
    if reasoning is not None:
        parts.append(reasoning.select("event_id", F.lit("event_reasoning").alias("family"), F.array("reasoning_cutoff").alias("times"), F.col("reasoning_cutoff").alias("same")))
    cutoff = F.col("__cutoff")
    late = F.exists("times", lambda t: F.coalesce(t > cutoff, F.lit(True)))
    moved = F.col("same").isNotNull() & ~F.col("same").eqNullSafe(cutoff)
    at = joins.never_broadcast(events.select("event_id", F.col("cutoff").alias("__cutoff")))
    out = _stacked(parts).join(at, "event_id").groupBy("event_id", "family").agg(
        F.count(F.lit(1)).alias("checked"), F.count(F.when(late | moved, 1)).alias("violations"))
    if cited is None:
        return out
    known = _stacked([df.select("event_id", "source_id") for df in (reasoned or {}).values()] or [cited.select("event_id", "source_id").limit(0)])
    known = joins.never_broadcast(known.where(F.col("source_id") != "").distinct().withColumn("__known", F.lit(True)))
    used = cited.select("event_id", "source_id").dropna().distinct().join(known, ["event_id", "source_id"], "left")
    sources = used.join(at, "event_id", "left_semi").groupBy("event_id").agg(
        F.lit("reasoning_sources").alias("family"), F.count(F.lit(1)).alias("checked"), F.count(F.when(F.col("__known").isNull(), 1)).alias("violations"))
    return out.unionByName(sources)


def judged(records: DataFrame, families: Sequence[str], alone: bool = False) -> DataFrame:
    """What :func:`context_audit` says of records that carry the cutoff of their event: no event is joined and only counts move.

    ``records`` have event_id, ``event_cutoff`` (from the audited events, each of which
    must occur once there) and per family an array of (available_at, value_timestamp).
    ``alone``: no event has more than one row of ``records``.
    """
    cutoff = F.col("event_cutoff")
    after = lambda t: F.coalesce(t > cutoff, F.lit(True))
    late = lambda r: after(r["available_at"]) | after(r["value_timestamp"])
    known = lambda f: F.coalesce(F.col(f), F.array().cast(records.schema[f].dataType))
    counts = {f"{kind}_{f}": F.size(x).cast("bigint") for f in families for kind, x in (("n", known(f)), ("v", F.filter(known(f), late)))}
    wide = records.select("event_id", *[c.alias(n) for n, c in counts.items()])
    if not alone:
        wide = wide.groupBy("event_id").agg(*[F.sum(n).alias(n) for n in counts])
    each = F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"n_{f}").alias("checked"), F.col(f"v_{f}").alias("violations")) for f in families])
    return wide.select("event_id", F.explode(F.filter(each, lambda r: r["checked"] > 0)).alias("r")).select("event_id", "r.*")


def _stacked(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leakage_violations(audit: DataFrame) -> DataFrame:
    """(event_id, leakage_violations): what :func:`row_problems` reads."""
    return audit.groupBy("event_id").agg(F.sum("violations").alias("leakage_violations"))


def coverage(flags: dict[str, str] = fv.AVAILABILITY_FLAGS) -> list[Column]:
    """Share of rows in which each family is available."""
    return [share(F.coalesce(F.col(c), F.lit(0.0)) > 0).alias(n) for n, c in flags.items()]


def coverage_gate(covered: DataFrame, minima: dict[str, float] = fv.COVERAGE_MINIMA) -> DataFrame:
    """(family, coverage, minimum, passed) rows from a one-row coverage frame."""
    pairs = F.array(*[F.struct(F.lit(n).alias("family"), F.col(n).alias("coverage"), F.lit(float(m)).alias("minimum"))
                      for n, m in minima.items()])
    return covered.select(F.explode(pairs).alias("g")).select("g.*").withColumn("passed", F.col("coverage") >= F.col("minimum"))


def varying(df: DataFrame, names: Sequence[str], tolerance: float = fv.NEGLIGIBLE) -> list[str]:
    """Columns that are not constant, in the given order; one aggregate pass."""
    spread = df.agg(*[(F.max(n) - F.min(n)).alias(n) for n in names]).first()
    return [n for n in names if spread[n] is not None and spread[n] > tolerance]


def varying_in_group(names: dict[str, str], tolerance: float = fv.NEGLIGIBLE) -> Column:
    """Aggregate: the names (in the given order) whose column is not constant within the group."""
    return F.array_compact(F.array(*[F.when(F.stddev_pop(c) > tolerance, F.lit(n)) for n, c in names.items()]))


def coverage_label() -> Column:
    """Which optional families a row has, as one label."""
    parts = [("history", "has_company_earnings_history"), ("price", "has_5y_price_history"), ("reasoning", "has_reasoning")]
    return F.concat_ws("+", F.lit("fls"), *[F.when(F.col(c) > 0, F.lit(n)) for n, c in parts])

"""Point-in-time joins: as-of, interval, nearest, fallback and merge."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scan import Running, epoch, largest_group, rolling, running
from tidemark.session import cut_lineage

POINT_FIRST, QUERY, POINT_AFTER = 0, 1, 2


def timeline(points: DataFrame, queries: DataFrame, keys: Sequence[str], point_at: Column, query_at: Column,
             payload: Sequence[str], point_tag: Column | None = None, tie: Column | None = None) -> DataFrame:
    """Points and queries of each key on one axis.

    Columns: the keys, ``__t`` (epoch seconds), ``__tag`` (points that a query
    at the same instant may see sort before it, others after), ``__tie``,
    ``__point`` (struct of the payload) and ``__query`` (struct of the query).
    """
    tie = F.lit(0).cast("bigint") if tie is None else tie.cast("bigint")
    tag = F.lit(POINT_FIRST) if point_tag is None else point_tag
    left = points.select(
        *keys, epoch(point_at).alias("__t"), tag.cast("int").alias("__tag"), tie.alias("__tie"),
        F.struct(*payload).alias("__point"))
    rest = [c for c in queries.columns if c not in keys]
    right = queries.select(
        *keys, epoch(query_at).alias("__t"), F.lit(QUERY).alias("__tag"), F.lit(0).cast("bigint").alias("__tie"),
        F.struct(*rest).alias("__query"))
    return left.unionByName(right, allowMissingColumns=True)


def asof(queries: DataFrame, points: DataFrame, keys: Sequence[str], query_at: str, point_at: str,
         payload: Sequence[str], out: str = "asof", inclusive: bool = True, tie: str | None = None) -> DataFrame:
    """Each query row with the latest visible point of its key (struct or NULL).

    One ordered scan over the union: no pair of rows is ever formed, and every
    query survives whether or not a point precedes it.  A NULL key or a NULL
    time matches nothing on either side.
    """
    points = points.dropna(subset=[*keys, point_at])
    tag = F.lit(POINT_FIRST if inclusive else POINT_AFTER)
    both = timeline(points, queries, keys, F.col(point_at), F.col(query_at), payload, tag,
                    F.col(tie) if tie else None)
    done = running(both, keys, ["__t", "__tag", "__tie"], [Running("last", F.col("__point"), out)])
    return done.where(F.col("__tag") == QUERY).select(*keys, "__query.*", out)


def never_broadcast(df: DataFrame) -> DataFrame:
    """The join of this side is a sort-merge join, whatever the planner takes its size to be.

    Sizes are estimated from compressed files, and rows made by ``explode`` are not
    counted, so a side that grows with the input can pass for a small one and fill
    the driver.
    """
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """Broadcast hint behind a row count; larger sides are not broadcast, however small their files are."""
    return F.broadcast(df) if largest_group(df, []) <= limit else never_broadcast(df)


def recent_history(queries: DataFrame, points: DataFrame, keys: Sequence[str], query_at: str, value_at: str,
                   visible_at: Column, payload: Sequence[str], limit: int, out: str = "history",
                   strict_value: bool = True, strict_available: bool = False) -> DataFrame:
    """Each query with an array (oldest first) of the last ``limit`` records of
    its key that were visible.

    A record shows up once it is available (with ``strict_available`` only
    strictly after that) and, with ``strict_value``, only strictly after the
    instant it describes.  Windows carry the last ``limit``
    records along each key, so an array never outgrows the limit.  A record
    with a NULL key, value time or availability is never visible.
    """
    tagged = points.withColumn("__visible", visible_at).dropna(subset=[*keys, value_at, "__visible"]).withColumn(
        "__when", F.greatest(F.col("__visible"), F.col(value_at)) if strict_value else F.col("__visible"))
    late = F.lit(POINT_FIRST)
    if strict_value:
        late = F.when(F.col(value_at) >= F.col("__visible"), POINT_AFTER).otherwise(POINT_FIRST)
    if strict_available:
        late = F.lit(POINT_AFTER)
    tagged = tagged.withColumn("__late", late)

    order = ["__when", "__late", value_at, *[c for c in payload if c != value_at]]

    def gather(df: DataFrame, parts: list[str]) -> DataFrame:
        frame = Window.partitionBy(*parts).orderBy(*order).rowsBetween(1 - limit, 0)
        return df.withColumn(out, F.collect_list(F.struct(value_at, *[p for p in payload if p != value_at])).over(frame))

    packed = rolling(tagged, keys, order, limit, gather)
    both = timeline(packed, queries, keys, F.col("__when"), F.col(query_at), [out], F.col("__late"),
                    F.col("position"))
    done = running(both, keys, ["__t", "__tag", "__tie"], [Running("last", F.col("__point"), "__seen")])
    none = F.array().cast(packed.schema[out].dataType)
    return done.where(F.col("__tag") == QUERY).select(
        *keys, "__query.*", F.array_sort(F.coalesce(F.col(f"__seen.{out}"), none)).alias(out))


def late_revisions(points: DataFrame, keys: Sequence[str], value_at: str, visible_at: str,
                   biggest: int | None = None) -> DataFrame:
    """Keys whose availability order differs from their value order; for these
    the visible set at a cutoff is not a prefix of the value timeline."""

    def mark(df: DataFrame, parts: list[str]) -> DataFrame:
        order = Window.partitionBy(*parts).orderBy(value_at, visible_at)
        return df.withColumn("__back", F.lag(visible_at).over(order) > F.col(visible_at))

    marked = rolling(points.select(*keys, value_at, visible_at), keys, [value_at, visible_at], 1, mark, biggest)
    return marked.groupBy(*keys).agg(F.count(F.when(F.col("__back"), 1)).alias("late_revisions"))


def interval_join(queries: DataFrame, records: DataFrame, key: str, query_at: str, record_at: str,
                  visible_at: str, days: int) -> DataFrame:
    """Records of the same key inside ``[cutoff - days, cutoff]`` and available.

    Both sides are tagged with the day; a query meets ``days + 1`` day slots, so
    the join is an equi-join on ``(key, day)`` that also spreads one hot key
    over its days. Neither side is broadcast: the slots of the queries are rows
    that no estimate counts.
    """
    q = queries.withColumn("__day", F.explode(F.sequence(
        F.to_date(F.col(query_at)) - days, F.to_date(F.col(query_at)))))
    r = records.withColumn("__day", F.to_date(F.col(record_at)))
    floor = F.col(query_at) - F.expr(f"INTERVAL {days} DAYS")
    return never_broadcast(q).join(r, [key, "__day"]).where(
        F.col(record_at).between(floor, F.col(query_at)) & (F.col(visible_at) <= F.col(query_at))).drop("__day")


def shared_windows(queries: DataFrame, records: DataFrame, key: str, query_id: str, query_at: str, record_at: str,
                   visible_at: str, days: int) -> tuple[DataFrame, DataFrame]:
    """Queries of :func:`interval_join` that see the same records, asked once.

    What a query sees changes only where a record of its key becomes visible or
    leaves the window, so queries between two changes have one answer. Returns the
    queries to ask, marked ``shared`` where they stand for others, and (the columns
    of ``queries``, ``owner``): for each query the id of the one asked in its place.
    An id that occurs more than once, or is NULL, is asked as it is, with one row of
    owners. A query before the first change sees nothing and is left out.
    """
    rest = [c for c in queries.columns if c != query_id]
    entered = F.when(F.col(record_at).isNotNull() & F.col(visible_at).isNotNull(), F.greatest(record_at, visible_at))
    left = F.col(record_at) + F.expr(f"INTERVAL {days} DAYS") + F.expr("INTERVAL 1 MICROSECOND")
    changes = records.select(key, F.explode(F.array(entered, left)).alias("__change"))
    ids = queries.groupBy(query_id).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*rest)).alias("__q"))
    alone = (F.col("__n") == 1) & F.col(query_id).isNotNull()
    placed = asof(ids.where(alone).select(query_id, "__q.*"), changes, [key], query_at, "__change", ["__change"], "__state")
    placed = placed.where(F.col("__state").isNotNull()).withColumn("__state", F.col("__state.__change"))
    placed = cut_lineage(placed, "placed")
    first = placed.groupBy(key, "__state").agg(F.min_by(F.struct(*queries.columns), query_id).alias("__first"))
    owners = placed.join(broadcast_if_small(first, 100_000), [key, "__state"]).select(*queries.columns, F.col(f"__first.{query_id}").alias("owner"))
    again = ids.where(~alone).select(F.col(query_id).alias("__again"), "__q")
    as_is = queries.join(again, F.col(query_id).eqNullSafe(F.col("__again")), "left_semi")
    asked = first.select("__first.*").withColumn("shared", F.lit(True)).unionByName(as_is.withColumn("shared", F.lit(False)))
    kept = again.select(F.col("__again").alias(query_id), "__q.*", F.col("__again").alias("owner"))
    return asked, owners.unionByName(kept)


def of_owner(owners: DataFrame, found: DataFrame, query_id: str) -> DataFrame:
    """What was found for each owner, for each of its queries."""
    found = found.withColumnRenamed(query_id, "__owner")
    return owners.join(found, F.col("owner").eqNullSafe(F.col("__owner"))).drop("owner", "__owner")


def nearest_within(queries: DataFrame, records: DataFrame, key: str, query_id: str, query_at: str, record_at: str,
                   ordinal: str, days: int) -> DataFrame:
    """The record closest in calendar days, within ``days`` either way; equal
    distances keep payload order.

    The closest record is the last one before or the first one after, so two
    as-of scans (forwards and on the mirrored axis) find it without pairing.
    """
    payload = [c for c in records.columns if c != key]
    number = lambda c: F.datediff(F.col(c), F.lit("1970-01-01"))
    at = lambda n: F.timestamp_seconds(n * 86400)
    r = records.withColumns({"__on": at(number(record_at)), "__mirror": at(-number(record_at)), "__tie": -F.col(ordinal)})
    q = queries.withColumns({"__at": at(number(query_at)), "__back": at(-number(query_at))})
    past = asof(q, r, [key], "__at", "__on", payload, "__past", True, "__tie")
    both = asof(past, r, [key], "__back", "__mirror", payload, "__next", True, "__tie")

    def candidate(side: str) -> Column:
        away = F.abs(F.datediff(F.col(f"{side}.{record_at}"), F.col(query_at)))
        return F.when(away <= days, F.struct(away.alias("day_distance"), F.col(f"{side}.{ordinal}").alias("__o"), F.col(side).alias("__r")))

    best = F.array_min(F.array_compact(F.array(candidate("__past"), candidate("__next"))))
    return both.withColumn("__best", best).where(F.col("__best").isNotNull()).select(
        *queries.columns, *[F.col(f"__best.__r.{c}").alias(c) for c in payload], F.col("__best.day_distance").alias("day_distance"))


def latest_in_lag(queries: DataFrame, records: DataFrame, key: str, query_id: str, query_at: str, record_at: str,
                  low: int, high: int, order_by: Sequence[str] = ()) -> DataFrame:
    """The most recent record that lies ``low``..``high`` days back.

    Records are reduced to a per-day as-of scan at ``cutoff - low`` days, then
    the upper bound is a filter: nothing is paired.
    """
    shifted = queries.withColumn("__at", F.date_sub(F.to_date(F.col(query_at)), low).cast("timestamp"))
    dated = records.withColumn("__on", F.to_date(F.col(record_at)).cast("timestamp"))
    payload = [c for c in records.columns if c != key]
    tie = F.lit(0) if not order_by else -F.col(order_by[0])
    found = asof(shifted, dated.withColumn("__tie", tie), [key], "__at", "__on", payload, "__hit", True, "__tie")
    lag = F.datediff(F.col(query_at), F.col(f"__hit.{record_at}"))
    return found.withColumn("lag_days", F.when(lag <= high, lag)).select(
        *[c for c in queries.columns],
        *[F.when(F.col("lag_days").isNotNull(), F.col(f"__hit.{c}")).alias(c) for c in payload], "lag_days")


def first_source(series: DataFrame, key: str, priority: str) -> DataFrame:
    """Keep the rows of the best-ranked source that has any row for the key."""
    best = series.groupBy(key).agg(F.min(priority).alias(priority))
    return series.join(best, [key, priority], "left_semi")


def longest_source(series: DataFrame, key: str, source: str, priority: str) -> DataFrame:
    """Keep the rows of the longest series per key; ties go to better priority."""
    sizes = series.groupBy(key, source, priority).agg(F.count(F.lit(1)).alias("__n"))
    best = sizes.groupBy(key).agg(
        F.max_by(F.col(source), F.struct(F.col("__n"), -F.col(priority))).alias(source))
    return series.join(best, [key, source], "left_semi")


def latest_per_key(rows: DataFrame, key: Sequence[str], sequence: Sequence[Column]) -> DataFrame:
    """Upsert semantics: the last written row of each key wins.

    ``max_by`` combines map-side, so a key rewritten a billion times sends one
    row per task.
    """
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*sequence)).alias("__row")).select(
        *key, "__row.*")


EARNINGS_FIELDS = ("reported_eps", "consensus_eps", "reported_revenue", "consensus_revenue")


def merge_results(provider: DataFrame, disclosure: DataFrame, keys: Sequence[str], parser: str) -> DataFrame:
    """Field-group precedence: a complete provider pair wins, otherwise a
    complete disclosure pair fills in; stamps take the later of the two."""
    p = provider.select(*keys, F.struct(*[c for c in provider.columns if c not in keys]).alias("p"))
    d = disclosure.select(*keys, F.struct(*[c for c in disclosure.columns if c not in keys]).alias("d"))
    both = p.join(d, list(keys), "full")

    def pick(reported: str, consensus: str, field: str) -> Column:
        p_ok = F.col(f"p.{reported}").isNotNull() & F.col(f"p.{consensus}").isNotNull()
        d_ok = F.col(f"d.{reported}").isNotNull() & F.col(f"d.{consensus}").isNotNull()
        from_p = F.col("p").isNotNull() & (p_ok | ~d_ok)
        return F.when(F.col("d").isNull() | from_p, F.col(f"p.{field}")).otherwise(F.col(f"d.{field}")).alias(field)

    both_present = F.col("p").isNotNull() & F.col("d").isNotNull()
    return both.select(
        *keys,
        F.greatest("p.available_at", "d.available_at").alias("available_at"),
        F.when(both_present, F.concat(F.col("p.source"), F.lit("+" + parser)))
        .otherwise(F.coalesce("p.source", "d.source")).alias("source"),
        pick("reported_eps", "consensus_eps", "reported_eps"), pick("reported_eps", "consensus_eps", "consensus_eps"),
        pick("reported_revenue", "consensus_revenue", "reported_revenue"),
        pick("reported_revenue", "consensus_revenue", "consensus_revenue"),
    )


def merge_guidance(provider: DataFrame, disclosure: DataFrame, keys: Sequence[str], parser: str) -> DataFrame:
    """Provider guidance, completed by the disclosure when it has no direction."""
    numbers = [c for c in provider.columns if c not in (*keys, "available_at", "source", "direction")]
    p = provider.select(*keys, F.struct(*[c for c in provider.columns if c not in keys]).alias("p"))
    d = disclosure.select(*keys, F.struct("available_at", "source", "direction").alias("d"))
    directed = F.coalesce(F.col("p.direction"), F.lit("")) != ""
    blended = F.col("p").isNotNull() & F.col("d").isNotNull() & ~directed
    return p.join(d, list(keys), "full").select(
        *keys,
        F.when(blended, F.greatest("p.available_at", "d.available_at"))
        .otherwise(F.coalesce("p.available_at", "d.available_at")).alias("available_at"),
        F.when(blended, F.concat(F.col("p.source"), F.lit("+" + parser)))
        .otherwise(F.coalesce("p.source", "d.source")).alias("source"),
        *[F.col(f"p.{c}").alias(c) for c in numbers],
        F.when(directed, F.col("p.direction")).otherwise(F.coalesce(F.col("d.direction"), F.col("p.direction")))
        .alias("direction"),
    )

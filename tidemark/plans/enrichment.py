"""Registered queries: provider matching and merging, peers and guidance
(C06, C08-C13, C15-C17, D05-D07, E16, F01-F05)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv
from tidemark.operators import families as fam
from tidemark.operators import joins as jn
from tidemark.operators.scan import Running, rolling, running
from tidemark.plans.bindings import BARS_SQL, FOCAL_SQL, TRADED_SQL, bars, focal, traded
from tidemark.plans.catalog import query, r6
from tidemark.plans.pit_joins import HIST_SQL, _series_sql, cached_history, short_features, stock_bound
from tidemark.session import table

PARSER = fv.RESULTS_PARSER_VERSION


# --------------------------------------------------------------------------
# matching provider payloads to events
# --------------------------------------------------------------------------
@query("c08_nearest_earnings_match", f"""WITH {FOCAL_SQL}, rec AS (SELECT o_custkey AS ticker, o_orderkey AS ord,
  CAST(o_orderdate AS DATE) + CAST(o_orderkey % 15 - 7 AS INT) AS reported, (o_orderkey % 89) / CAST(25 AS DOUBLE) AS eps FROM orders)
SELECT event_id, ord, CAST(dist AS BIGINT) AS day_distance, round(eps, 6) + 0.0 AS eps FROM (
  SELECT event_id, ord, eps, abs(date_diff('day', CAST(cutoff AS DATE), reported)) AS dist,
    row_number() OVER (PARTITION BY event_id ORDER BY abs(date_diff('day', CAST(cutoff AS DATE), reported)), ord) AS i
  FROM focal JOIN rec USING (ticker) WHERE abs(date_diff('day', CAST(cutoff AS DATE), reported)) <= 7) WHERE i = 1""")
def c08(spark, d):
    k = F.col("o_orderkey")
    rec = table(spark, d, "orders").select(
        F.col("o_custkey").alias("ticker"), k.alias("ord"),
        F.date_add(F.to_date("o_orderdate"), (k % 15 - 7).cast("int")).alias("reported"), ((k % 89) / 25.0).alias("eps"))
    hit = jn.nearest_within(focal(spark, d).select("ticker", "event_id", "cutoff"), rec, "ticker", "event_id", "cutoff",
                            "reported", "ord", 7)
    return hit.select("event_id", "ord", F.col("day_distance").cast("bigint").alias("day_distance"), "eps")


@query("c09_backward_lag_match", f"""WITH {FOCAL_SQL}, rec AS (SELECT o_custkey AS ticker, o_orderkey AS ord,
  CAST(o_orderdate AS DATE) - CAST(20 + o_orderkey % 100 AS INT) AS period, o_orderkey % 89 AS actual FROM orders WHERE o_orderkey % 6 <> 0)
SELECT event_id, ord, CAST(lag_days AS BIGINT) AS lag_days FROM (
  SELECT event_id, ord, date_diff('day', period, CAST(cutoff AS DATE)) AS lag_days,
    row_number() OVER (PARTITION BY event_id ORDER BY date_diff('day', period, CAST(cutoff AS DATE)), ord) AS i
  FROM focal JOIN rec USING (ticker) WHERE date_diff('day', period, CAST(cutoff AS DATE)) BETWEEN 7 AND 150) WHERE i = 1""")
def c09(spark, d):
    k = F.col("o_orderkey")
    rec = table(spark, d, "orders").where(k % 6 != 0).select(
        F.col("o_custkey").alias("ticker"), k.alias("ord"),
        F.date_sub(F.to_date("o_orderdate"), (20 + k % 100).cast("int")).alias("period"), (k % 89).alias("actual"))
    hit = jn.latest_in_lag(focal(spark, d).select("ticker", "event_id", "cutoff"), rec, "ticker", "event_id", "cutoff",
                           "period", 7, 150, ["ord"])
    return hit.where(F.col("lag_days").isNotNull()).select("event_id", "ord", F.col("lag_days").cast("bigint").alias("lag_days"))


VENDOR_SQL = """ven AS (SELECT l_suppkey AS stock, l_returnflag AS vendor, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS prio,
  l_shipdate, l_quantity FROM lineitem WHERE NOT (l_returnflag = 'A' AND l_suppkey % 3 <> 0) AND NOT (l_returnflag = 'N' AND l_suppkey % 3 = 2))"""


def vendor_rows(spark, d) -> DataFrame:
    """Raw price rows of three vendors that cover different stocks."""
    flag, k = F.col("l_returnflag"), F.col("l_suppkey")
    return table(spark, d, "lineitem").where(
        ~((flag == "A") & (k % 3 != 0)) & ~((flag == "N") & (k % 3 == 2))).select(
        k.alias("stock"), flag.alias("vendor"),
        F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("prio"), "l_shipdate", "l_quantity")


@query("c10_provider_fallback", f"""WITH {VENDOR_SQL}, b AS (SELECT stock, min(prio) AS prio FROM ven GROUP BY stock)
SELECT stock, vendor, count(*) AS n, round(sum(l_quantity), 6) + 0.0 AS qty FROM ven JOIN b USING (stock, prio) GROUP BY stock, vendor""")
def c10(spark, d):
    return jn.first_source(vendor_rows(spark, d), "stock", "prio").groupBy("stock", "vendor").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("c11_longest_series", f"""WITH {VENDOR_SQL}, s AS (SELECT stock, vendor, prio, count(*) AS n, round(sum(l_quantity), 6) + 0.0 AS qty FROM ven GROUP BY ALL)
SELECT stock, vendor, n, qty FROM s QUALIFY row_number() OVER (PARTITION BY stock ORDER BY n DESC, prio) = 1""")
def c11(spark, d):
    return jn.longest_source(vendor_rows(spark, d), "stock", "vendor", "prio").groupBy("stock", "vendor").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


MERGE_SQL = FOCAL_SQL + f""", p AS (SELECT event_id, cutoff AS available_at, 'vendor' AS source, reported_eps AS re, consensus_eps AS ce,
  reported_revenue AS rr, consensus_revenue AS cr FROM focal WHERE event_id % 3 <> 0),
d AS (SELECT event_id, cutoff + INTERVAL 1 HOUR AS available_at, '{PARSER}' AS source, score AS re, CASE WHEN event_id % 5 <> 0 THEN score * 2 END AS ce,
  CAST(NULL AS DOUBLE) AS rr, CAST(NULL AS DOUBLE) AS cr FROM focal WHERE event_id % 4 <> 0)"""


@query("c12_merge_results", f"""WITH {MERGE_SQL}, j AS (SELECT coalesce(p.event_id, d.event_id) AS event_id, p.event_id AS pid, d.event_id AS did,
    p.re AS pre, p.ce AS pce, p.rr AS prr, p.cr AS pcr, d.re AS dre, d.ce AS dce, d.rr AS drr, d.cr AS dcr,
    d.event_id IS NULL OR (p.event_id IS NOT NULL AND (p.re IS NOT NULL AND p.ce IS NOT NULL OR NOT (d.re IS NOT NULL AND d.ce IS NOT NULL))) AS eps_p,
    d.event_id IS NULL OR (p.event_id IS NOT NULL AND (p.rr IS NOT NULL AND p.cr IS NOT NULL OR NOT (d.rr IS NOT NULL AND d.cr IS NOT NULL))) AS rev_p,
    greatest(p.available_at, d.available_at) AS at_ FROM p FULL JOIN d ON p.event_id = d.event_id)
SELECT event_id, CASE WHEN pid IS NULL THEN '{PARSER}' WHEN did IS NULL THEN 'vendor' ELSE 'vendor+{PARSER}' END AS source,
  strftime(at_, '%Y-%m-%d %H:%M:%S') AS available_at,
  round(CASE WHEN eps_p THEN pre ELSE dre END, 6) + 0.0 AS reported_eps, round(CASE WHEN eps_p THEN pce ELSE dce END, 6) + 0.0 AS consensus_eps,
  round(CASE WHEN rev_p THEN prr ELSE drr END, 6) + 0.0 AS reported_revenue, round(CASE WHEN rev_p THEN pcr ELSE dcr END, 6) + 0.0 AS consensus_revenue FROM j""")
def c12(spark, d):
    f = focal(spark, d)
    p = f.where("event_id % 3 <> 0").select("event_id", F.col("cutoff").alias("available_at"), F.lit("vendor").alias("source"),
                                           *jn.EARNINGS_FIELDS)
    null = F.lit(None).cast("double")
    q = f.where("event_id % 4 <> 0").select(
        "event_id", (F.col("cutoff") + F.expr("INTERVAL 1 HOUR")).alias("available_at"), F.lit(PARSER).alias("source"),
        F.col("score").alias("reported_eps"), F.when(F.col("event_id") % 5 != 0, F.col("score") * 2).alias("consensus_eps"),
        null.alias("reported_revenue"), null.alias("consensus_revenue"))
    out = jn.merge_results(p, q, ["event_id"], PARSER)
    return out.withColumn("available_at", F.date_format("available_at", "yyyy-MM-dd HH:mm:ss"))


@query("c13_merge_guidance", f"""WITH {FOCAL_SQL}, p AS (SELECT event_id, cutoff AS at_, CASE event_id % 5 WHEN 0 THEN 'raised' WHEN 1 THEN '' END AS direction, score AS eps_low FROM focal WHERE event_id % 3 <> 0),
d AS (SELECT event_id, cutoff + INTERVAL 1 HOUR AS at_, CASE WHEN event_id % 2 = 0 THEN 'lowered' ELSE 'reaffirmed' END AS direction FROM focal WHERE event_id % 4 <> 0)
SELECT coalesce(p.event_id, d.event_id) AS event_id,
  CASE WHEN p.event_id IS NULL THEN '{PARSER}' WHEN d.event_id IS NULL OR coalesce(p.direction, '') <> '' THEN 'vendor' ELSE 'vendor+{PARSER}' END AS source,
  CASE WHEN coalesce(p.direction, '') <> '' THEN p.direction ELSE coalesce(d.direction, p.direction) END AS direction, round(p.eps_low, 6) + 0.0 AS eps_low
FROM p FULL JOIN d ON p.event_id = d.event_id""")
def c13(spark, d):
    f, k = focal(spark, d), F.col("event_id")
    p = f.where("event_id % 3 <> 0").select(
        "event_id", F.col("cutoff").alias("available_at"), F.lit("vendor").alias("source"),
        F.when(k % 5 == 0, "raised").when(k % 5 == 1, "").alias("direction"), F.col("score").alias("eps_low"))
    q = f.where("event_id % 4 <> 0").select(
        "event_id", (F.col("cutoff") + F.expr("INTERVAL 1 HOUR")).alias("available_at"), F.lit(PARSER).alias("source"),
        F.when(k % 2 == 0, "lowered").otherwise("reaffirmed").alias("direction"))
    return jn.merge_guidance(p, q, ["event_id"], PARSER).drop("available_at")


@query("c15_skip_unsupported", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def c15(spark, d):
    skip = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(skip, "o_custkey", "left_anti")


@query("c16_selected_peer_results", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000)""")
def c16(spark, d):
    chosen = table(spark, d, "customer").where("c_mktsegment = 'BUILDING' AND c_acctbal > 5000").select(
        F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(chosen, "o_custkey", "left_semi")


@query("c17_metadata_fallback", """SELECT event_id, coalesce(c_mktsegment, 'sector_' || regexp_extract(props, '(\\d+)', 1)) AS sector,
  CASE WHEN c_mktsegment IS NULL THEN 'event_payload' ELSE 'provider' END AS source, peer_ticker, round(greatest(0.1, 1.0 - 0.05 * i), 6) + 0.0 AS score
FROM events LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON c_custkey = user_id
CROSS JOIN (SELECT CAST(i AS BIGINT) AS i FROM range(10) t(i)) CROSS JOIN LATERAL (SELECT user_id - 3 + i AS peer_ticker) WHERE peer_ticker <> user_id""")
def c17(spark, d):
    e = table(spark, d, "events")
    provider = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    listed = F.sequence(F.col("user_id") - 3, F.col("user_id") + 8)  # twelve named peers in the payload
    joined = e.join(provider, "user_id", "left").select(
        "event_id", "user_id",
        F.coalesce("c_mktsegment", F.concat(F.lit("sector_"), F.get_json_object("props", "$.k"))).alias("sector"),
        F.when(F.col("c_mktsegment").isNull(), "event_payload").otherwise("provider").alias("source"),
        F.posexplode(F.slice(listed, 1, 10)).alias("i", "peer_ticker"))
    return joined.where("peer_ticker <> user_id").select(
        "event_id", "sector", "source", "peer_ticker", F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(0.05) * F.col("i")).alias("score"))


# --------------------------------------------------------------------------
# peers
# --------------------------------------------------------------------------
def peer_edges(spark, d) -> DataFrame:
    """Edge list: the six neighbours either side in balance order, per nation."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")

    def neighbours(df: DataFrame, parts: list[str]) -> DataFrame:
        order = Window.partitionBy(*parts).orderBy("s_acctbal", "s_suppkey")
        return df.withColumn("near", F.array(*[F.struct(
            F.lag("s_suppkey", i).over(order).alias("k"), F.lag("s_acctbal", i).over(order).alias("b")) for i in range(1, 7)]))

    near = rolling(s, ["s_nationkey"], ["s_acctbal", "s_suppkey"], 6, neighbours)
    down = near.select("s_suppkey", "s_acctbal", F.explode("near").alias("p")).where("p.k IS NOT NULL").select(
        F.col("s_suppkey").alias("stock"), F.col("p.k").alias("peer_key"),
        (1.0 / (1.0 + F.abs(F.col("s_acctbal") - F.col("p.b")) / 1000.0)).alias("score"))
    up = down.select(F.col("peer_key").alias("stock"), F.col("stock").alias("peer_key"), "score")
    return down.unionByName(up)


PEER_SQL = """o AS (SELECT s_suppkey, s_nationkey, s_acctbal, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS i FROM supplier),
edge AS (SELECT a.s_suppkey AS stock, b.s_suppkey AS peer_key, 1.0 / (1.0 + abs(a.s_acctbal - b.s_acctbal) / CAST(1000 AS DOUBLE)) AS score
  FROM o a JOIN o b ON a.s_nationkey = b.s_nationkey AND abs(a.i - b.i) BETWEEN 1 AND 6)"""
SELECTED_SQL = TRADED_SQL + ", " + PEER_SQL + """, sel AS (SELECT event_id, cutoff, peer_key, score,
  row_number() OVER (PARTITION BY event_id ORDER BY score DESC, peer_key) AS peer_place FROM traded JOIN edge USING (stock) QUALIFY peer_place <= 10)"""


def selected_peers(spark, d) -> DataFrame:
    """(event_id, cutoff, stock, peer_key, score, peer_place): the ten best peers of each event.

    Events of a stock share its peers, so they are chosen once per stock and an event
    takes the list. An event id that occurs n times takes every peer n times: place
    p of the stock becomes places n (p - 1) + 1 to n p of the event.
    """
    best = fam.select_peers(peer_edges(spark, d), "stock")
    lists = best.groupBy("stock").agg(F.array_sort(F.collect_list(F.struct("peer_place", "peer_key", "score"))).alias("best"))  # <= 10 peers
    same = Window.partitionBy("event_id")
    asked = traded(spark, d).withColumns({"copies": F.count(F.lit(1)).over(same), "copy": F.row_number().over(same.orderBy("cutoff"))})
    listed = asked.join(jn.broadcast_if_small(lists, 100_000), "stock").select("event_id", "cutoff", "stock", "copies", "copy", F.explode("best").alias("p"))
    placed = listed.withColumn("peer_place", ((F.col("p.peer_place") - 1) * F.col("copies") + F.col("copy")).cast("int"))
    return placed.where("peer_place <= 10").select("event_id", "cutoff", "stock", "p.peer_key", "p.score", "peer_place")


@query("e16_select_peers", f"WITH {SELECTED_SQL} SELECT event_id, peer_key, CAST(peer_place AS BIGINT) AS peer_place, {r6('score')} FROM sel")
def e16(spark, d):
    return selected_peers(spark, d).select("event_id", "peer_key", F.col("peer_place").cast("bigint").alias("peer_place"), "score")


def peer_bound(spark, d) -> int:
    """Upper bound on the bars, results and asking events of one peer, without forming the pairs."""
    events = traded(spark, d).groupBy("stock").count()
    asking = fam.select_peers(peer_edges(spark, d), "stock").join(events, "stock").select(F.col("peer_key").alias("stock"), "count")
    priced = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("stock")).count()
    return int(asking.unionByName(events).unionByName(priced).groupBy("stock").agg(F.sum("count").alias("n")).agg(F.max("n")).first()[0] or 0)


RETURNS = ("return_1d", "return_5d", "return_20d")


def peer_prices(spark, d) -> DataFrame:
    """Sessions of each peer with the trailing returns, as one struct, from the time they are known."""
    feats = short_features(bars(spark, d).withColumnRenamed("stock", "peer_key"), ["peer_key"], stock_bound(spark, d))
    return feats.select("peer_key", F.col("available_at").alias("at"), "position",
                        F.struct(*[F.col(f"{n}_pre_event" if n == "return_1d" else n).alias(n) for n in RETURNS]).alias("price"))


def peer_timeline(spark, d, points: DataFrame, payload: list[str]) -> DataFrame:
    """One row per (event, selected peer) with the last known value of each ``payload`` struct: one scan for all of them."""
    asked = selected_peers(spark, d).select("event_id", "cutoff", "peer_key")
    both = jn.timeline(points.dropna(subset=["peer_key", "at"]), asked, ["peer_key"], F.col("at"), F.col("cutoff"), payload, tie=F.col("position"))
    both = both.withColumn("__query", F.when(F.col("__tag") == jn.QUERY, F.struct("__query.event_id")))
    done = running(both, ["peer_key"], ["__t", "__tag", "__tie"], [Running("last", F.col(f"__point.{c}"), c) for c in payload], peer_bound(spark, d))
    return done.where(F.col("__tag") == jn.QUERY).select("__query.event_id", "peer_key", *payload)


def peer_returns(spark, d) -> DataFrame:
    """One row per (event, selected peer) with the peer's trailing returns."""
    found = peer_timeline(spark, d, peer_prices(spark, d), ["price"])
    return found.select("event_id", "peer_key", *[F.coalesce(f"price.{n}", F.lit(0.0)).alias(n) for n in RETURNS])


PEER_RET_SQL = SELECTED_SQL + f""", {_series_sql('stk', 'l_suppkey', 'lineitem')},
pr AS (SELECT sel.event_id, sel.peer_key, sel.cutoff, coalesce(r1, 0) AS return_1d, coalesce(r5, 0) AS return_5d, coalesce(r20, 0) AS return_20d
  FROM sel ASOF LEFT JOIN stk ON sel.peer_key = stk.l_suppkey AND sel.cutoff >= stk.available_at)"""


@query("c06_peer_expansion", f"WITH {PEER_RET_SQL} SELECT event_id, peer_key, {r6('return_1d', 'return_5d', 'return_20d')} FROM pr")
def c06(spark, d):
    return peer_returns(spark, d).select("event_id", "peer_key", "return_1d", "return_5d", "return_20d")


def stock_results(spark, d) -> DataFrame:
    """Earnings records per stock: the figures of the events trading it."""
    t = traded(spark, d).select("event_id", "stock")
    f = focal(spark, d).drop("ticker")
    return f.join(jn.never_broadcast(t), "event_id").select(
        F.col("stock").alias("peer_key"), F.col("cutoff").alias("value_timestamp"), *jn.EARNINGS_FIELDS,
        F.col("car1").alias("abnormal_return"), F.col("event_id").alias("record_id"))


def peer_results(spark, d) -> DataFrame:
    """Counts and sums over the last eight results of each peer, as one struct, from three days after the last of them."""
    order = ["value_timestamp", "record_id", *jn.EARNINGS_FIELDS]

    def sums(df: DataFrame, parts: list[str]) -> DataFrame:
        last = Window.partitionBy(*parts).orderBy(*order).rowsBetween(-7, 0)
        return df.withColumn("told", F.struct(F.count(F.lit(1)).over(last).alias("records"), *[
            f(n).over(last).alias(f"{k}_{n}") for n in fam.PEER_RESULTS for k, f in (("n", F.count), ("s", F.sum))]))

    points = stock_results(spark, d).dropna(subset=["peer_key", "value_timestamp"]).withColumns(fam.peer_result_values())
    summed = rolling(points, ["peer_key"], order, 8, sums)
    return summed.select("peer_key", (F.col("value_timestamp") + F.expr("INTERVAL 3 DAYS")).alias("at"), "position", "told")


def peer_features(spark, d, events: DataFrame, market_1d) -> DataFrame:
    """The peer family of ``events``: prices and results of all peers in one scan, added up per event."""
    points = peer_prices(spark, d).unionByName(peer_results(spark, d), allowMissingColumns=True)
    found = peer_timeline(spark, d, points, ["price", "told"])
    flat = found.select("event_id", *[F.coalesce(f"price.{n}", F.lit(0.0)).alias(n) for n in RETURNS], "told.*")
    # plain rows are smaller than the states of their aggregates
    return fam.peer_block(events, flat.repartition("event_id"), "event_id", market_1d, fam.peer_result_means()).select("event_id", *fv.PEER_FEATURES)


@query("d07_peer_sympathy", f"""WITH {PEER_RET_SQL}, {FOCAL_SQL}, res AS (SELECT stock AS peer_key, f.* FROM focal f JOIN (SELECT event_id, stock FROM traded) USING (event_id)),
last8 AS (SELECT sel.event_id, r.*EXCLUDE (event_id, peer_key) , row_number() OVER (PARTITION BY sel.event_id, sel.peer_key ORDER BY r.cutoff DESC, r.event_id DESC) AS back
  FROM sel JOIN res r ON r.peer_key = sel.peer_key AND r.cutoff + INTERVAL 3 DAY <= sel.cutoff QUALIFY back <= 8),
e AS (SELECT event_id, CAST(count(*) AS DOUBLE) AS n, avg((reported_eps - consensus_eps) / greatest(abs(consensus_eps), 0.05)) AS se,
  avg((reported_revenue - consensus_revenue) / greatest(abs(consensus_revenue), 1.0)) AS sv, avg(car1) AS y FROM last8 GROUP BY event_id),
a AS (SELECT event_id, avg(return_1d) AS m1, avg(return_5d) AS m5, avg(return_20d) AS m20, stddev_pop(return_1d) AS d1, stddev_pop(return_5d) AS d5 FROM pr GROUP BY event_id)
SELECT event_id, """ + ", ".join(f"round(coalesce({x}, 0), 6) + 0.0 AS {n}" for x, n in (
    ("m1", "peer_mean_return_1d"), ("m5", "peer_mean_return_5d"), ("m20", "peer_mean_return_20d"), ("m1", "peer_abnormal_return_1d"),
    ("d1", "peer_dispersion_1d"), ("d5", "peer_dispersion_5d"), ("e.n", "recent_peer_earnings_count"), ("se", "recent_peer_eps_surprise_mean"),
    ("sv", "recent_peer_revenue_surprise_mean"), ("y", "recent_peer_post_earnings_abnormal_return_mean"))) + """,
  CAST(0 AS DOUBLE) AS recent_peer_guidance_signal_mean, CASE WHEN m1 IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS has_peer_data
FROM (SELECT event_id FROM traded) LEFT JOIN a USING (event_id) LEFT JOIN e USING (event_id)""")
def d07(spark, d):
    return peer_features(spark, d, traded(spark, d).select("event_id"), F.lit(0.0))


# --------------------------------------------------------------------------
# guidance
# --------------------------------------------------------------------------
def guidance_records(spark, d) -> DataFrame:
    f, k = focal(spark, d), F.col("event_id")
    eps, rev = F.col("reported_eps"), F.col("reported_revenue")
    return f.withColumns({
        "revenue_low": F.when(k % 3 == 0, rev * 0.9), "revenue_high": F.when(k % 4 != 1, rev * 1.1),
        "eps_low": F.when(k % 5 == 0, eps * 0.9), "eps_high": F.when(k % 5 <= 1, eps * 1.05),
        "ebitda": F.when(k % 17 == 0, F.col("score") * 10), "margin": F.lit(None).cast("double"),
        "revenue_consensus": F.when(k % 6 != 0, F.col("consensus_revenue")), "eps_consensus": F.col("consensus_eps"),
        "direction": F.when(k % 7 == 0, " Raised ").when(k % 7 == 1, "cut").when(k % 7 == 2, "maintained").when(k % 7 == 3, "lowered"),
    })


GUIDE_SQL = FOCAL_SQL + """, g AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN reported_revenue * 0.9 END AS rl, CASE WHEN event_id % 4 <> 1 THEN reported_revenue * 1.1 END AS rh,
  CASE WHEN event_id % 5 = 0 THEN reported_eps * 0.9 END AS el, CASE WHEN event_id % 5 <= 1 THEN reported_eps * 1.05 END AS eh,
  CASE WHEN event_id % 17 = 0 THEN score * 10 END AS ebitda, CASE WHEN event_id % 6 <> 0 THEN consensus_revenue END AS rc,
  CASE event_id % 7 WHEN 0 THEN 'raised' WHEN 1 THEN 'cut' WHEN 2 THEN 'maintained' WHEN 3 THEN 'lowered' ELSE '' END AS dir FROM focal),
g2 AS (SELECT *, coalesce((rl + rh) / 2, rl, rh) AS rm, coalesce((el + eh) / 2, el, eh) AS em FROM g),
g3 AS (SELECT *, (rm - rc) / greatest(abs(rc), 1e-6) AS rv, (em - consensus_eps) / greatest(abs(consensus_eps), 1e-6) AS ev FROM g2),
g4 AS (SELECT *, coalesce((rv + ev) / 2, rv, ev) AS comb FROM g3)"""
GUIDE_COLS = ", ".join(f"round(coalesce(CAST({x} AS DOUBLE), 0), 6) + 0.0 AS {n}" for x, n in (
    ("rl", "revenue_guidance_low"), ("rh", "revenue_guidance_high"), ("rm", "revenue_guidance_mid"), ("el", "eps_guidance_low"),
    ("eh", "eps_guidance_high"), ("em", "eps_guidance_mid"), ("ebitda", "ebitda_guidance"), ("NULL", "margin_guidance"),
    ("rv", "revenue_guidance_vs_consensus"), ("ev", "eps_guidance_vs_consensus"), ("comb", "guidance_surprise_percent"),
    ("CAST(comb > 0.0025 AS INT)", "guidance_above_consensus"), ("CAST(comb < -0.0025 AS INT)", "guidance_below_consensus"),
    ("CAST(abs(comb) <= 0.0025 AS INT)", "guidance_inline"), ("CAST(dir = 'raised' AS INT)", "numeric_guidance_raised"),
    ("CAST(dir IN ('lowered', 'cut') AS INT)", "numeric_guidance_lowered"), ("CAST(dir IN ('reaffirmed', 'maintained') AS INT)", "guidance_reaffirmed"),
    ("CAST(coalesce(rm, em, ebitda) IS NOT NULL AS INT)", "has_numeric_guidance"), ("CAST(comb IS NOT NULL AS INT)", "has_guidance_consensus")))


@query("d05_guidance_expectations", f"WITH {GUIDE_SQL} SELECT event_id, {GUIDE_COLS} FROM g4")
def d05(spark, d):
    return guidance_records(spark, d).withColumns(fam.guidance_block()).select("event_id", *fv.GUIDANCE_FEATURES)


@query("d06_guidance_interactions", f"""WITH {GUIDE_SQL}, f AS (SELECT event_id, dir = 'raised' OR event_id % 9 = 0 AS up, dir IN ('lowered', 'cut') OR event_id % 10 = 0 AS down,
  coalesce(reported_eps > consensus_eps, false) AS eb, coalesce(reported_eps < consensus_eps, false) AS em_,
  coalesce(reported_revenue > consensus_revenue, false) AS rb, coalesce(reported_revenue < consensus_revenue, false) AS rm_, coalesce(comb > 0.0025, false) AS above FROM g4)
SELECT event_id, CAST(eb AND down AS INT)::DOUBLE AS eps_beat_but_guidance_cut, CAST(em_ AND up AS INT)::DOUBLE AS eps_miss_but_guidance_raised,
  CAST(rb AND above AS INT)::DOUBLE AS revenue_beat_and_guidance_above, CAST(eb AND rb AND up AS INT)::DOUBLE AS double_beat_and_raise,
  CAST(em_ AND rm_ AND down AS INT)::DOUBLE AS double_miss_and_cut FROM f""")
def d06(spark, d):
    none = F.array().cast("array<struct<reported_eps:double,consensus_eps:double,reported_revenue:double,consensus_revenue:double>>")
    g = guidance_records(spark, d)
    eps, rev = fam.eps_block(none), fam.revenue_block(none)
    built = g.withColumns({**fam.guidance_block(), **{n: eps[n] for n in ("is_eps_beat", "is_eps_miss")},
                           **{n: rev[n] for n in ("is_revenue_beat", "eps_beat_and_revenue_beat", "eps_miss_and_revenue_miss")},
                           "guidance_raised": fam.flag(F.col("event_id") % 9 == 0),
                           "guidance_lowered": fam.flag(F.col("event_id") % 10 == 0)})
    return built.withColumns(fam.interaction_block()).select("event_id", *fv.INTERACTION_FEATURES)


# --------------------------------------------------------------------------
# set operations
# --------------------------------------------------------------------------
@query("f01_union_of_sources", """SELECT source, count(*) AS n, min(at_) AS first_at FROM (SELECT 'orders' AS source, strftime(o_orderdate, '%Y-%m-%d') AS at_ FROM orders
  UNION ALL SELECT 'shipments', strftime(l_shipdate, '%Y-%m-%d') FROM lineitem UNION ALL SELECT 'events', strftime(ts, '%Y-%m-%d') FROM events) GROUP BY source""")
def f01(spark, d):
    def day(name, source, at):
        return table(spark, d, name).select(F.lit(source).alias("source"), F.date_format(at, "yyyy-MM-dd").alias("at"))

    union = day("orders", "orders", "o_orderdate").unionByName(day("lineitem", "shipments", "l_shipdate")).unionByName(
        day("events", "events", "ts"))
    return union.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_at"))


@query("f02_ordered_distinct", """SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first_id) AS place
FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL)""")
def f02(spark, d):
    first = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    w = Window.partitionBy("user_id").orderBy("first_id")  # one row per event type
    return first.select("user_id", "event_type", F.row_number().over(w).cast("bigint").alias("place"))


@query("f03_set_difference", """SELECT c_custkey AS custkey FROM customer EXCEPT ALL SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000""")
def f03(spark, d):
    rich = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("custkey")).distinct()
    return table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")).exceptAll(rich)


@query("f04_intersection", """SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000""")
def f04(spark, d):
    o = table(spark, d, "orders")
    a = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("custkey"))
    return a.intersect(o.where("o_orderstatus = 'P' AND o_totalprice > 400000").select(F.col("o_custkey").alias("custkey")))


@query("f05_development_union", f"""WITH {FOCAL_SQL} SELECT quarter, count(*) AS n FROM focal WHERE quarter IN ('1999Q4', '2000Q1', '2000Q2') GROUP BY quarter""")
def f05(spark, d):
    return focal(spark, d).where(F.col("quarter").isin("1999Q4", "2000Q1", "2000Q2")).groupBy("quarter").agg(F.count(F.lit(1)).alias("n"))

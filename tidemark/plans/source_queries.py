"""Registered queries: sources and sinks (A01-A18, B01-B03).  Inputs are files
that Spark writes from the tables into the shared folder first."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv
from tidemark.operators import joins as jn
from tidemark.plans.bindings import BARS_SQL, FOCAL_SQL, bars, focal
from tidemark.plans.catalog import query, r6
from tidemark.plans.text_news import NEWS_SQL, articles
from tidemark.session import scratch_path, table
from tidemark.sources import archive as ar
from tidemark.sources import sinks as sk
from tidemark.sources import vendors as vn


def stamp(c, name):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)


def archive_lines(spark, d) -> DataFrame:
    """Focal events as raw nested archive records (JSON text)."""
    k = F.col("event_id")
    t = F.col("ticker").cast("string")
    other = F.concat(F.lit("X"), t)
    asset = lambda v: F.struct(F.lit("TICKER").alias("identifier_type"), v.alias("identifier_value"))
    leg = lambda c: F.struct(c.alias("car1"), F.lit("ok").alias("return_status"))
    item = lambda kind, content: F.struct(F.lit(kind).alias("kind"), content.alias("content"))
    facts = F.transform(F.sequence(F.lit(1), (k % 4 + 1).cast("int")), lambda i: F.concat(F.lit("fact "), i.cast("string")))
    record = F.struct(
        k.cast("string").alias("event_id"), "event_type", F.date_format("cutoff", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("event_datetime"),
        F.when(k % 10 == 0, F.col("quarter")).alias("quarter"),
        F.when(k % 3 == 0, F.array(asset(t), asset(other))).otherwise(F.array(asset(t))).alias("focal_assets"),
        F.struct(F.array(item("note", F.array(F.lit("n"))), item("facts", facts), item("facts", F.array(F.lit("later")))).alias("items")).alias("disclosure"),
        F.map_from_arrays(F.array(t, other), F.array(leg(F.col("car1")), leg(F.col("car1") / 3))).alias("event_returns"),
        F.struct(F.struct(F.col("earnings_surprise").alias("surprise"), F.when(k % 7 == 0, "missing_eps").otherwise("ok").alias("surprise_status"))
                 .alias("earnings_surprise")).alias("metrics"))
    return focal(spark, d).select(F.to_json(record).alias("value"))


def archive_events(spark, d) -> DataFrame:
    path = scratch_path(spark, "archive")
    archive_lines(spark, d).write.option("compression", "gzip").text(path)
    return ar.read_archive(spark, path, "*.gz")


ARCHIVE_SQL = FOCAL_SQL + """, arc AS (SELECT CAST(event_id AS VARCHAR) AS event_id, tk AS ticker, event_type, CAST(event_id % 4 + 1 AS BIGINT) AS facts,
  CASE WHEN tk[1:1] = 'X' THEN car1 / 3 ELSE car1 END AS car1, CASE WHEN event_id % 7 <> 0 THEN earnings_surprise END AS surprise
  FROM (SELECT *, unnest(CASE WHEN event_id % 3 = 0 THEN [CAST(ticker AS VARCHAR), 'X' || ticker] ELSE [CAST(ticker AS VARCHAR)] END) AS tk FROM focal))"""


@query("a01_archive_scan", f"WITH {ARCHIVE_SQL} SELECT event_id, ticker, event_type, {r6('car1', 'surprise')} FROM arc")
def a01(spark, d):
    return archive_events(spark, d).select("event_id", "ticker", "event_type", "car1", F.col("earnings_surprise").alias("surprise"))


@query("a02_quarter_from_file_name", f"""WITH {FOCAL_SQL} SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'tagged' ELSE quarter END AS quarter FROM focal""")
def a02(spark, d):
    name = F.concat(F.lit("EARNINGS_RELEASE_"), "quarter", F.when(F.col("event_id") % 2 == 0, ".jsonl.gz").otherwise(".jsonl"))
    own = F.when(F.col("event_id") % 10 == 0, "tagged")
    return focal(spark, d).select("event_id", F.coalesce(own, ar.quarter_from_name(name)).alias("quarter"))


@query("b01_focal_assets", f"WITH {ARCHIVE_SQL} SELECT ticker, count(*) AS events FROM arc GROUP BY ticker")
def b01(spark, d):
    return archive_events(spark, d).groupBy("ticker").agg(F.count(F.lit(1)).alias("events"))


@query("b02_first_facts_item", f"WITH {ARCHIVE_SQL} SELECT event_id, ticker, facts, array_to_string(list_transform(range(1, facts + 1), lambda i: 'fact ' || i), '|') AS content FROM arc")
def b02(spark, d):
    """The first item of facts, between a note and a later item of facts."""
    return archive_events(spark, d).select("event_id", "ticker", F.size("disclosure").cast("bigint").alias("facts"), F.array_join("disclosure", "|").alias("content"))


@query("b03_outcome_by_ticker", f"WITH {ARCHIVE_SQL} SELECT event_id, ticker, {r6('car1')} FROM arc WHERE car1 IS NOT NULL")
def b03(spark, d):
    return archive_events(spark, d).where(F.col("car1").isNotNull()).select("event_id", "ticker", "car1")


ROW_NAMES = ("reported_eps", "consensus_eps", "reported_revenue", "consensus_revenue", "score")


@query("a03_training_row_round_trip", f"""WITH {FOCAL_SQL} SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(ticker AS VARCHAR) AS ticker, quarter, round(score, 6) + 0.0 AS target_percentile,
  {', '.join(f'round(coalesce({n}, 0), 6) + 0.0 AS {n}' for n in ROW_NAMES)} FROM focal""")
def a03(spark, d):
    f = focal(spark, d)
    rows = f.select("event_id", "ticker", "quarter", F.col("score").alias("target_percentile"),
                    F.lit(None).cast("double").alias("surprise_percentile"), F.lit(0).alias("leakage_violations"),
                    *[F.coalesce(n, F.lit(0.0)).alias(n) for n in ROW_NAMES])
    path = scratch_path(spark, "training-rows")
    ar.write_training_rows(rows, path, ROW_NAMES)
    return ar.load_training_rows(spark, path, ROW_NAMES).drop("surprise_percentile", "leakage_violations")


@query("a04_price_csv", f"""WITH {BARS_SQL} SELECT 'T' || stock AS ticker, strftime(value_timestamp, '%Y-%m-%d %H:%M:%S') AS value_timestamp,
  strftime(CASE WHEN stock % 2 = 0 THEN available_at ELSE value_timestamp END, '%Y-%m-%d %H:%M:%S') AS available_at,
  CASE WHEN stock % 3 = 0 THEN 'desk' ELSE 'local_adjusted_daily_csv' END AS source, {r6('close')}, round(CASE WHEN stock % 5 <> 0 THEN volume END, 6) + 0.0 AS volume FROM bars""")
def a04(spark, d):
    k = F.col("stock")
    rows = bars(spark, d).select(
        F.concat(F.lit(" t"), k.cast("string")).alias("ticker"), F.date_format("day", "yyyy-MM-dd").alias("date"), "close",
        F.when(k % 5 != 0, F.col("volume")).alias("volume"),
        F.when(k % 2 == 0, F.date_format("available_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("available_at"),
        F.when(k % 3 == 0, "desk").alias("source"))
    path = scratch_path(spark, "prices-csv")
    rows.write.option("header", True).csv(path)
    return vn.read_price_csv(spark, path).withColumns({
        c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("value_timestamp", "available_at")})


@query("a05_payload_landing", """SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS key_hash, round(o_totalprice, 6) + 0.0 AS total FROM orders WHERE o_orderstatus = 'F'""")
def a05(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("k"), "o_orderstatus",
                                         F.to_json(F.struct(F.col("o_totalprice").alias("total"))).alias("payload"))
    path = scratch_path(spark, "landing")
    for namespace in ("F", "O"):
        vn.land(vn.landing_rows(o.where(F.col("o_orderstatus") == namespace), namespace, "k", "payload"), path)
    got = vn.landed(spark, path, "F")
    return got.select("key_hash", F.from_json("payload", "total double")["total"].alias("total"))


@query("a06_history_upsert", """SELECT l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS day, l_returnflag, l_orderkey, round(l_extendedprice, 6) + 0.0 AS price FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate, l_returnflag ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) = 1""")
def a06(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_shipdate", "l_returnflag", "l_orderkey", "l_linenumber", "l_partkey",
                                            F.col("l_extendedprice").alias("price"))
    last = jn.latest_per_key(li, ["l_suppkey", "l_shipdate", "l_returnflag"],
                             [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "price")])
    return last.select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"), "l_returnflag", "l_orderkey", "price")


def price_payloads(spark, d) -> DataFrame:
    """Bars as vendor JSON, one payload per stock and month, four shapes."""
    b = bars(spark, d).withColumn("month", F.date_trunc("month", "day"))
    day, text = F.date_format("day", "yyyy-MM-dd"), lambda c: F.col(c).cast("string")
    iso = F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    adj = F.when(F.col("volume") > 20, text("close"))
    g = b.groupBy("stock", "month").agg(  # at most one bar per day of the month
        F.collect_list(F.struct(iso.alias("date"), text("close").alias("close"),
                                adj.alias("adjClose"), text("volume").alias("volume"))).alias("tiingo"),
        F.collect_list(F.struct(day.alias("datetime"), text("close").alias("close"), text("volume").alias("volume"))).alias("twelve"),
        F.collect_list(F.struct(day.alias("date"), text("close").alias("close"), text("volume").alias("volume"))).alias("fmp"),
        F.map_from_entries(F.collect_list(F.struct(day, F.create_map(
            F.lit("5. adjusted close"), text("close"), F.lit("6. volume"), text("volume"))))).alias("alpha"))
    payload = (F.when(F.col("stock") % 4 == 0, F.to_json("tiingo"))
               .when(F.col("stock") % 4 == 1, F.to_json(F.struct(F.col("twelve").alias("values"))))
               .when(F.col("stock") % 4 == 2, F.to_json("fmp"))
               .otherwise(F.to_json(F.struct(F.col("alpha").alias("Time Series (Daily)")))))
    return g.select("stock", F.concat(F.lit("s"), text("stock")).alias("ticker"), payload.alias("payload"))


@query("a07_vendor_price_normalisers", f"""WITH {BARS_SQL} SELECT 'S' || stock AS ticker, strftime(value_timestamp, '%Y-%m-%d %H:%M:%S') AS value_timestamp,
  strftime(CASE WHEN stock % 4 = 3 THEN value_timestamp ELSE available_at END, '%Y-%m-%d %H:%M:%S') AS available_at,
  ['tiingo_eod_adjusted', 'twelve_data_eod_adjust_all', 'fmp_eod', 'alpha_vantage_daily_adjusted'][stock % 4 + 1] AS source, {r6('close', 'volume')} FROM bars""")
def a07(spark, d):
    p = price_payloads(spark, d)
    readers = (vn.tiingo_prices, vn.twelve_data_prices, vn.fmp_prices, vn.alpha_prices)
    out = None
    for shape, read in enumerate(readers):
        part = read(p.where(F.col("stock") % 4 == shape))
        out = part if out is None else out.unionByName(part)
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("value_timestamp", "available_at")})


@query("a08_vendor_news_plain", f"""WITH {NEWS_SQL} SELECT CAST(article_id AS VARCHAR) AS source_id, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at,
  'SRC' || (article_id % 20) || CASE WHEN upper(source) <> 'SRC' || (article_id % 20) THEN ',' || upper(source) ELSE '' END AS entities FROM art
  WHERE (SELECT trim(split_part(text, chr(10), 1)) FROM documents WHERE doc_id = article_id) <> ''""")
def a08(spark, d):
    a = articles(spark, d)
    item = F.struct(F.unix_timestamp("published_at").alias("datetime"), "headline", F.concat(F.lit(" "), "source", F.lit(",,")).alias("related"),
                    F.col("article_id").alias("id"), "source", "url", "summary")
    p = a.select(F.concat(F.lit("src"), (F.col("article_id") % 20).cast("string")).alias("ticker"), F.to_json(F.array(item)).alias("payload"))
    return vn.finnhub_news(p).select("source_id", stamp(F.col("published_at"), "published_at"), F.array_join("entities", ",").alias("entities"))


@query("a09_vendor_news_scored", f"""WITH {NEWS_SQL} SELECT article_id, strftime(published_at, '%Y-%m-%d %H:%M:%S') AS published_at,
  round(CASE WHEN article_id % 4 <> 0 THEN sentiment ELSE ((article_id % 9) / CAST(10 AS DOUBLE) + 0.2) / 2 END, 6) + 0.0 AS sentiment,
  CASE WHEN article_id % 2 = 0 THEN 'tech' ELSE 'energy' END AS topic, round(greatest((article_id % 6) / CAST(10 AS DOUBLE), 0.3), 6) + 0.0 AS vendor_relevance,
  (SELECT contains(lower(trim(split_part(text, chr(10), 1)) || ' ' || trim(text)), 'worthless') OR contains(lower(text), 'keit') FROM documents WHERE doc_id = article_id) AS material
FROM art WHERE published_at <= TIMESTAMP '2024-01-20 00:00:00' AND (SELECT trim(split_part(text, chr(10), 1)) FROM documents WHERE doc_id = article_id) <> ''""")
def a09(spark, d):
    a, k = articles(spark, d), F.col("article_id")
    sent = lambda t, s, r: F.struct(t.alias("ticker"), s.alias("ticker_sentiment_score"), r.alias("relevance_score"))
    topic = lambda t, r: F.struct(F.lit(t).alias("topic"), r.alias("relevance_score"))
    item = F.struct(
        F.col("headline").alias("title"), F.date_format("published_at", "yyyyMMdd'T'HHmmss").alias("time_published"), "source", "url", "summary",
        F.col("sentiment").cast("string").alias("overall_sentiment_score"),
        F.array(sent(F.upper("source"), ((k % 9) / 10.0).cast("string"), ((k % 6) / 10.0).cast("string")),
                sent(F.lit("x"), F.lit("0.2"), F.lit("0.3"))).alias("ticker_sentiment"),
        F.array(topic("energy", F.when(k % 2 == 0, "0.1").otherwise("0.9")), topic("tech", F.lit("0.9"))).alias("topics"))
    p = a.select("article_id", F.to_json(F.struct(F.array(item).alias("feed"))).alias("payload"))
    out = vn.alpha_news(p, F.lit("2024-01-20 00:00:00").cast("timestamp"), ("worthless", "keit"))
    return out.select("article_id", stamp(F.col("published_at"), "published_at"), "sentiment", "topic", "vendor_relevance", "material")


@query("a10_disclosure_payload_shapes", """WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS f, text FROM documents)
SELECT doc_id, CAST(CASE WHEN doc_id % 6 IN (3, 4) THEN 1 ELSE len(f) END AS BIGINT) AS n,
  CAST(CASE WHEN doc_id % 6 IN (3, 4) THEN length(text) ELSE length(array_to_string(f, '')) END AS BIGINT) AS chars FROM l""")
def a10(spark, d):
    doc = table(spark, d, "documents").select("doc_id", "text", F.split("text", "\n").alias("f"))
    item = F.array(F.struct(F.lit("note").alias("kind"), F.array(F.lit("n")).alias("content")), F.struct(F.lit("facts").alias("kind"), F.col("f").alias("content")))
    k = F.col("doc_id") % 6
    j = lambda c, name: F.to_json(F.struct(c.alias(name)))
    payload = (F.when(k == 0, j(item, "items")).when(k == 1, j(F.struct(item.alias("items")), "disclosure")).when(k == 2, j(F.col("f"), "facts"))
               .when(k == 3, j(F.col("text"), "facts")).when(k == 4, j(F.col("text"), "summary")).otherwise(j(F.col("f"), "summary")))
    got = doc.select("doc_id", vn.disclosure_facts(payload).alias("x"))
    return got.select("doc_id", F.size("x").cast("bigint").alias("n"), F.length(F.array_join("x", "")).cast("bigint").alias("chars"))


WANTED_Q, WANTED_T = ("1996Q1", "1997Q2", "2003Q1"), ("EARNINGS_RELEASE", "OTHER")


def manifest(spark, d) -> DataFrame:
    n = F.count(F.lit(1))
    return focal(spark, d).groupBy("quarter", "event_type").agg(n.alias("events"), F.when(n % 5 == 0, n % 2 == 0).alias("sealed"))


MANIFEST_SQL = FOCAL_SQL + """, man AS (SELECT quarter, event_type, count(*) AS events, CASE WHEN count(*) % 5 = 0 THEN count(*) % 2 = 0 END AS sealed FROM focal GROUP BY ALL),
want AS (SELECT q.quarter, t.event_type FROM (VALUES ('1996Q1'), ('1997Q2'), ('2003Q1')) q(quarter) CROSS JOIN (VALUES ('EARNINGS_RELEASE'), ('OTHER')) t(event_type)),
got AS (SELECT man.* FROM man JOIN want USING (quarter, event_type) WHERE coalesce(sealed, true))"""


@query("a11_manifest_selection", f"""WITH {MANIFEST_SQL} SELECT quarter, event_type, events, 'selected' AS state FROM got UNION ALL
SELECT quarter, event_type, 0, 'missing' FROM want WHERE NOT EXISTS (SELECT 1 FROM got WHERE got.quarter = want.quarter AND got.event_type = want.event_type)""")
def a11(spark, d):
    chosen = ar.select_manifest(manifest(spark, d), WANTED_Q, WANTED_T)
    absent = ar.missing_from_manifest(spark, chosen, WANTED_Q, WANTED_T)
    return chosen.select("quarter", "event_type", "events", F.lit("selected").alias("state")).unionByName(
        absent.withColumns({"events": F.lit(0).cast("bigint"), "state": F.lit("missing")}))


@query("a12_live_score_loader", f"""WITH {FOCAL_SQL} SELECT CASE WHEN event_id % 6 = 0 THEN '?' ELSE 'T' || ticker END AS ticker, round(score, 6) + 0.0 AS predicted_percentile,
  round(score / 2, 6) + 0.0 AS realized_percentile, {r6('car1')} FROM focal WHERE event_id % 5 <> 0""")
def a12(spark, d):
    k = F.col("event_id")
    rows = focal(spark, d).select(
        F.when((k % 6 != 0) & (k % 2 == 0), F.concat(F.lit("t"), F.col("ticker").cast("string"))).alias("ticker"),
        F.when((k % 6 != 0) & (k % 2 == 1), F.concat(F.lit("t"), F.col("ticker").cast("string"))).alias("identifier_value"),
        F.when(k % 5 != 0, F.col("score")).alias("predicted_percentile"), (F.col("score") / 2).alias("realized_percentile"), "car1")
    path = scratch_path(spark, "live-scores")
    rows.write.option("header", True).csv(path)
    return vn.read_live_scores(spark, path, "csv")


@query("a13_evidence_bundles", f"""WITH {FOCAL_SQL} SELECT CAST(event_id AS VARCHAR) AS event_key, CAST(ticker AS VARCHAR) AS ticker_key, {r6('score')} FROM focal""")
def a13(spark, d):
    """Two writes of the same keys: the second, with other scores, changes nothing."""
    f, path = focal(spark, d), scratch_path(spark, "evidence")
    groups = {"results": ["reported_eps", "consensus_eps"], "labels": ["quarter"]}
    sk.write_once(sk.evidence(f, "event_id", "ticker", groups, "score", "v1"), path)
    sk.write_once(sk.evidence(f.withColumn("score", F.col("score") + 1), "event_id", "ticker", groups, "score", "v1"), path)
    back = spark.read.parquet(path)
    return back.select("event_key", "ticker_key", F.get_json_object("bundle", "$.prediction").cast("double").alias("score"))


@query("a14_explanation_records", f"""WITH {FOCAL_SQL} SELECT CAST(event_id AS VARCHAR) AS event_key, 'TICK.' || ticker AS ticker_key, {r6('score')} FROM focal""")
def a14(spark, d):
    f, path = focal(spark, d), scratch_path(spark, "explanations")
    named = f.withColumn("ticker", F.concat(F.lit("tick.#"), F.col("ticker").cast("string")))
    body = F.to_json(F.struct("event_id", "ticker", F.date_format("cutoff", "yyyy-MM-dd").alias("cutoff"), F.col("score").alias("submitted_percentile")))
    record = sk.with_safe_keys(named, "event_id", "ticker").select(*sk.KEYS, body.alias("explanation"))
    sk.write_once(record, path)
    sk.write_once(record.withColumn("explanation", F.lit("{}")), path)
    return spark.read.parquet(path).select(
        "event_key", "ticker_key", F.get_json_object("explanation", "$.submitted_percentile").cast("double").alias("score"))


@query("a16_report_sink", f"""WITH {FOCAL_SQL} SELECT count(*) AS rows, count(car1) AS labelled, round(avg(score), 6) + 0.0 AS mean_score FROM focal""")
def a16(spark, d):
    path = scratch_path(spark, "report")
    sk.write_report(focal(spark, d).agg(F.count(F.lit(1)).alias("rows"), F.count("car1").alias("labelled"), F.avg("score").alias("mean_score")), path)
    return spark.read.schema("rows bigint, labelled bigint, mean_score double").json(path)


@query("a18_submission_frame", """SELECT event_id, n, string_agg(a || '=' || printf('%.4f', p), ',' ORDER BY a) AS submission FROM (
  SELECT event_id, unnest([user_id, user_id + 1000]) AS a, unnest([0.25, 0.75]) AS p, 2::BIGINT AS n FROM events) GROUP BY event_id, n""")
def a18(spark, d):
    e = table(spark, d, "events").select("event_id", F.explode(F.array(
        F.struct(F.col("user_id").alias("a"), F.lit(0.25).alias("p")), F.struct((F.col("user_id") + 1000).alias("a"), F.lit(0.75).alias("p")))).alias("x"))
    s = sk.submissions(e.select("event_id", "x.a", "x.p"), "event_id", "a", "p")
    return s.select("event_id", F.size("predictions").cast("bigint").alias("n"), F.array_join(F.transform(
        "predictions", lambda p: F.format_string("%d=%.4f", p["identifier_value"], p["predicted_percentile"])), ",").alias("submission"))

"""Vendor payloads: raw landing, price and news normalisers, CSV inputs and
disclosure payload shapes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fv
from tidemark.functions import text as tx
from tidemark.functions.pit import parse_instant
from tidemark.operators.joins import latest_per_key

CLOSE_HOUR = "INTERVAL 21 HOURS"


# --------------------------------------------------------------------------
# landing
# --------------------------------------------------------------------------
def landing_rows(payloads: DataFrame, namespace: str, key: str, payload: str) -> DataFrame:
    """Shape raw payloads for the landing table."""
    return payloads.select(F.lit(namespace).alias("namespace"), F.sha2(F.col(key), 256).alias("key_hash"),
                           F.col(payload).alias("payload"), F.current_timestamp().alias("landed_at"))


def land(rows: DataFrame, path: str) -> None:
    """Append to the landing table, one folder per namespace."""
    rows.write.mode("append").partitionBy("namespace").parquet(path)


def landed(spark: SparkSession, path: str, namespace: str) -> DataFrame:
    """Newest payload per key of one namespace (other folders are not read)."""
    rows = spark.read.parquet(path).where(F.col("namespace") == namespace)
    return latest_per_key(rows.select("key_hash", "payload", "landed_at"), ["key_hash"], [F.col("landed_at")])


# --------------------------------------------------------------------------
# prices
# --------------------------------------------------------------------------
def _bar(df: DataFrame, day: Column, close: Column, volume: Column, source: str, next_day: bool, positive: bool) -> DataFrame:
    start = F.date_trunc("day", day)
    value = start + F.expr(CLOSE_HOUR)
    out = df.select(
        F.upper("ticker").alias("ticker"), value.alias("value_timestamp"),
        (start + F.expr("INTERVAL 1 DAY") if next_day else value).alias("available_at"), F.lit(source).alias("source"),
        close.try_cast("double").alias("close"), F.nullif(volume, F.lit("")).try_cast("double").alias("volume"))
    out = out.where(F.col("value_timestamp").isNotNull() & F.col("close").isNotNull())
    return out.where("close > 0") if positive else out


def _items(df: DataFrame, schema: str, path: str | None = None) -> DataFrame:
    raw = F.get_json_object("payload", path) if path else F.col("payload")
    return df.select("ticker", F.explode(F.from_json(raw, f"array<struct<{schema}>>")).alias("i"))


def tiingo_prices(payloads: DataFrame) -> DataFrame:
    """Array of bars; adjusted figures preferred; usable from the next midnight."""
    rows = _items(payloads, "date:string,close:string,adjClose:string,volume:string,adjVolume:string")
    return _bar(rows, parse_instant(F.col("i.date")), F.coalesce("i.adjClose", "i.close"),
                F.coalesce("i.adjVolume", "i.volume"), "tiingo_eod_adjusted", True, False)


def twelve_data_prices(payloads: DataFrame) -> DataFrame:
    """Bars under ``values``; non-positive closes are dropped."""
    rows = _items(payloads, "datetime:string,close:string,volume:string", "$.values")
    return _bar(rows, parse_instant(F.col("i.datetime")), F.col("i.close"), F.col("i.volume"),
                "twelve_data_eod_adjust_all", True, True)


def fmp_prices(payloads: DataFrame) -> DataFrame:
    """Array of bars; non-positive closes are dropped."""
    rows = _items(payloads, "date:string,close:string,volume:string")
    return _bar(rows, parse_instant(F.col("i.date")), F.col("i.close"), F.col("i.volume"), "fmp_eod", True, True)


def alpha_prices(payloads: DataFrame) -> DataFrame:
    """Bars keyed by date; usable from the session close itself."""
    series = F.from_json(F.get_json_object("payload", "$['Time Series (Daily)']"), "map<string,map<string,string>>")
    rows = payloads.select("ticker", F.explode(series).alias("day", "f"))
    volume = F.coalesce(F.nullif(F.try_element_at("f", F.lit("6. volume")), F.lit("")),
                        F.try_element_at("f", F.lit("5. volume")))
    return _bar(rows, parse_instant(F.col("day")), F.try_element_at("f", F.lit("5. adjusted close")), volume,
                "alpha_vantage_daily_adjusted", False, False)


def read_price_csv(spark: SparkSession, path: str) -> DataFrame:
    """Daily CSV: ticker, date and close required; volume, available_at and
    source optional; the close stamp is 21:00 UTC."""
    raw = spark.read.option("header", True).csv(path)
    absent = {"ticker", "date", "close"} - set(raw.columns)
    if absent:
        raise ValueError(f"price CSV lacks columns {sorted(absent)}")

    def column(name: str) -> Column:
        return F.col(name) if name in raw.columns else F.lit(None).cast("string")

    value = F.date_trunc("day", parse_instant(F.col("date"))) + F.expr(CLOSE_HOUR)
    return raw.select(
        F.upper(F.trim("ticker")).alias("ticker"), value.alias("value_timestamp"),
        F.coalesce(parse_instant(column("available_at")), value).alias("available_at"),
        F.coalesce(F.nullif(column("source"), F.lit("")), F.lit("local_adjusted_daily_csv")).alias("source"),
        F.col("close").cast("double").alias("close"), F.nullif(column("volume"), F.lit("")).cast("double").alias("volume"),
    ).where(F.coalesce("ticker", F.lit("")) != "")


# --------------------------------------------------------------------------
# news
# --------------------------------------------------------------------------
def finnhub_news(payloads: DataFrame) -> DataFrame:
    """Epoch-stamped articles; entities are the ticker and the related list."""
    rows = _items(payloads, "datetime:string,headline:string,related:string,id:string,source:string,url:string,summary:string")
    at = F.timestamp_seconds(F.col("i.datetime").try_cast("bigint"))
    related = F.filter(F.transform(F.split(F.coalesce("i.related", F.lit("")), ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    return rows.select(
        at.alias("published_at"), at.alias("available_at"), F.coalesce(F.nullif("i.source", F.lit("")), F.lit("finnhub")).alias("source"),
        F.trim("i.headline").alias("headline"), F.array_distinct(F.concat(F.array(F.upper("ticker")), related)).alias("entities"),
        F.col("i.url").alias("url"), F.col("i.id").alias("source_id"), F.col("i.summary").alias("summary"),
        F.lit(1.0).alias("vendor_relevance")).where(F.col("published_at").isNotNull() & (F.coalesce("headline", F.lit("")) != ""))


ALPHA_ITEM = ("title:string,time_published:string,source:string,url:string,summary:string,overall_sentiment_score:string,"
              "ticker_sentiment:array<struct<ticker:string,ticker_sentiment_score:string,relevance_score:string>>,"
              "topics:array<struct<topic:string,relevance_score:string>>")


def alpha_news(payloads: DataFrame, cutoff: Column, material_words=fv.VENDOR_MATERIAL_WORDS) -> DataFrame:
    """Feed articles published by the cutoff: sentiment is the overall score or
    the mean of the ticker scores; topic is the most relevant one (first of
    equals); vendor relevance is the best ticker relevance."""
    rows = payloads.select("*", F.explode(F.from_json(F.get_json_object("payload", "$.feed"), f"array<struct<{ALPHA_ITEM}>>")).alias("i"))
    at = F.coalesce(F.try_to_timestamp("i.time_published", F.lit("yyyyMMdd'T'HHmmss")),
                    F.try_to_timestamp("i.time_published", F.lit("yyyyMMdd'T'HHmm")))

    def numbers(field: str) -> Column:
        return F.filter(F.transform(F.col("i.ticker_sentiment"), lambda t: t[field].try_cast("double")), lambda x: x.isNotNull())

    scores, relevance = numbers("ticker_sentiment_score"), numbers("relevance_score")
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    ranked = F.transform(F.col("i.topics"), lambda t, p: F.struct(
        (-F.coalesce(t["relevance_score"].try_cast("double"), F.lit(0.0))).alias("s"), p.alias("p"),
        F.nullif(F.trim(t["topic"]), F.lit("")).alias("topic")))
    title, summary = F.trim(F.coalesce("i.title", F.lit(""))), F.nullif(F.trim(F.coalesce("i.summary", F.lit(""))), F.lit(""))
    out = rows.select(
        *payloads.columns, at.alias("published_at"), at.alias("available_at"),
        F.coalesce(F.nullif("i.source", F.lit("")), F.lit("Alpha Vantage")).alias("source"),
        tx.source_id(F.col("i.url"), F.col("i.time_published"), F.col("i.title")).alias("source_id"), title.alias("headline"),
        F.nullif(F.trim(F.coalesce("i.url", F.lit(""))), F.lit("")).alias("url"),
        F.array_distinct(F.filter(F.transform(F.coalesce("i.ticker_sentiment", F.array().cast(
            "array<struct<ticker:string,ticker_sentiment_score:string,relevance_score:string>>")),
            lambda t: F.upper(F.trim(F.coalesce(t["ticker"], F.lit(""))))), lambda x: x != "")).alias("entities"),
        F.coalesce(F.col("i.overall_sentiment_score").try_cast("double"), F.when(F.size(scores) > 0, mean)).alias("sentiment"),
        tx.any_contains(F.lower(F.concat_ws(" ", title, F.coalesce(summary, F.lit("")))), material_words).alias("material"),
        F.try_element_at(F.array_sort(ranked), F.lit(1))["topic"].alias("topic"), summary.alias("summary"),
        F.array_max(relevance).alias("vendor_relevance"))
    return out.where(F.col("published_at").isNotNull() & (F.col("published_at") <= cutoff) & (F.col("headline") != ""))


# --------------------------------------------------------------------------
# disclosure payloads
# --------------------------------------------------------------------------
def _texts(raw: Column) -> Column:
    """A JSON list or a plain string as an array of non-blank texts."""
    listed = F.from_json(raw, "array<string>")
    many = F.when(raw.startswith("["), listed).otherwise(F.array(raw))
    return F.filter(many, lambda x: x.isNotNull() & (F.trim(x) != ""))


def _facts_item(raw: Column) -> Column:
    items = F.from_json(raw, "array<struct<kind:string,content:string>>")
    return _texts(F.try_element_at(F.filter(items, lambda i: i["kind"] == "facts"), F.lit(1))["content"])


def disclosure_facts(payload: Column) -> Column:
    """Facts of a disclosure payload: items, nested items, facts, summary."""
    shapes = [
        _facts_item(F.get_json_object(payload, "$.items")), _facts_item(F.get_json_object(payload, "$.disclosure.items")),
        _texts(F.get_json_object(payload, "$.facts")), _texts(F.get_json_object(payload, "$.summary")),
    ]
    return F.coalesce(*[F.when(F.size(s) > 0, s) for s in shapes], F.array().cast("array<string>"))


def read_live_scores(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Live evaluation rows from CSV or JSON lines (``form``); rows lacking a prediction or an
    outcome are dropped, an unknown ticker becomes ``?``."""
    if form not in ("csv", "json"):
        raise ValueError(f"live scores are csv or json, not {form}")
    raw = spark.read.option("header", True).csv(path) if form == "csv" else spark.read.option("primitivesAsString", True).json(path)

    def column(name: str) -> Column:
        return F.nullif(F.col(name), F.lit("")) if name in raw.columns else F.lit(None).cast("string")

    return raw.select(
        F.upper(F.coalesce(column("ticker"), column("identifier_value"), F.lit("?"))).alias("ticker"),
        column("predicted_percentile").cast("double").alias("predicted_percentile"),
        column("realized_percentile").cast("double").alias("realized_percentile"), column("car1").cast("double").alias("car1"),
    ).dropna(subset=["predicted_percentile", "realized_percentile"])

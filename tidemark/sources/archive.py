"""Event archive, training rows and manifests as file-based tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import fixed_values as fv
from tidemark.operators.joins import broadcast_if_small
from tidemark.session import cut_lineage

ARCHIVE_SCHEMA = """
  event_id STRING, event_type STRING, event_datetime STRING, quarter STRING,
  focal_assets ARRAY<STRUCT<identifier_type: STRING, identifier_value: STRING>>,
  disclosure STRUCT<items: ARRAY<STRUCT<kind: STRING, content: ARRAY<STRING>>>>,
  event_returns MAP<STRING, STRUCT<car1: DOUBLE, return_status: STRING>>,
  metrics STRUCT<earnings_surprise: STRUCT<surprise: DOUBLE, surprise_status: STRING>>,
  _broken STRING
""".replace("\n", " ")
EVENT_COLUMNS = "event_id STRING, ticker STRING, event_type STRING, event_datetime STRING, disclosure ARRAY<STRING>, car1 DOUBLE, earnings_surprise DOUBLE, quarter STRING"


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def quarter_from_name(name: Column) -> Column:
    """Quarter tag at the end of an archive file name."""
    stem = F.regexp_replace(F.regexp_replace(name, r"\.jsonl\.gz$", ""), r"\.jsonl$", "")
    return F.nullif(F.regexp_extract(stem, r"([^_]*)$", 1), F.lit(""))


def facts_of(items: Column) -> Column:
    """Content of the first ``facts`` item, an empty list without one."""
    first = F.try_element_at(F.filter(items, lambda i: i["kind"] == "facts"), F.lit(1))
    return F.coalesce(first["content"], F.array().cast("array<string>"))


def read_archive(spark: SparkSession, path: str, glob: str = "*.jsonl*") -> DataFrame:
    """Archive files to one row per (event, ticker).

    Blank lines are skipped; a file with any malformed line is left out whole;
    a missing folder gives an empty table.
    """
    if not path_exists(spark, path):
        return spark.createDataFrame([], EVENT_COLUMNS)
    lines = (
        spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("name"))
        .where(F.trim("value") != "")
    )
    surprise = F.col("r.metrics.earnings_surprise")
    leg = lambda a: F.struct(a["identifier_value"].alias("ticker"), F.try_element_at("r.event_returns", a["identifier_value"])["car1"].alias("car1"))
    # every line is parsed once: a filter on what is parsed would run the parser again
    parsed = cut_lineage(lines.withColumn("r", F.from_json("value", ARCHIVE_SCHEMA, {"columnNameOfCorruptRecord": "_broken"})).select(
        "file", (F.col("r").isNull() | F.col("r._broken").isNotNull()).alias("broken"), "r.event_id", F.transform("r.focal_assets", leg).alias("legs"),
        F.coalesce("r.event_type", F.lit("UNKNOWN")).alias("event_type"), "r.event_datetime", facts_of(F.col("r.disclosure.items")).alias("disclosure"),
        F.when(surprise["surprise_status"] == "ok", surprise["surprise"]).alias("earnings_surprise"),
        F.coalesce(F.nullif("r.quarter", F.lit("")), quarter_from_name(F.col("name"))).alias("quarter")), "archive-lines")
    bad = broadcast_if_small(parsed.where("broken").select("file").distinct())  # the rows of a file are never brought together
    good = parsed.join(bad, "file", "left_anti").where(F.coalesce("event_id", F.lit("")) != "")
    return good.withColumn("leg", F.explode("legs")).where(F.coalesce("leg.ticker", F.lit("")) != "").select(
        "event_id", "leg.ticker", "event_type", "event_datetime", "disclosure", "leg.car1", "earnings_surprise", "quarter")


def training_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([
        T.StructField("event_id", T.StringType()), T.StructField("ticker", T.StringType()),
        T.StructField("quarter", T.StringType()), T.StructField("target_percentile", T.DoubleType()),
        T.StructField("values", T.StructType([T.StructField(n, T.DoubleType()) for n in names])),
        T.StructField("surprise_percentile", T.DoubleType()), T.StructField("leakage_violations", T.IntegerType()),
    ])


def write_training_rows(rows: DataFrame, path: str, names: Sequence[str] = fv.FEATURES) -> None:
    """Validated gzip JSON lines, features nested in frozen order."""
    from tidemark.operators.audit import require_valid_rows

    require_valid_rows(rows, names)
    shaped = rows.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("ticker").cast("string").alias("ticker"), "quarter",
        "target_percentile", F.struct(*[F.col(n).cast("double").alias(n) for n in names]).alias("values"),
        "surprise_percentile", F.col("leakage_violations").cast("int").alias("leakage_violations"))
    shaped.write.mode("errorifexists").option("compression", "gzip").json(path)


def load_training_rows(spark: SparkSession, path: str, names: Sequence[str] = fv.FEATURES) -> DataFrame:
    """Strict read back: malformed lines and absent features are errors."""
    read = spark.read.schema(training_schema(names)).option("mode", "FAILFAST").json(path)
    absent = F.array_compact(F.array(*[F.when(F.col(f"values.{n}").isNull(), F.lit(n)) for n in names]))
    checked = read.withColumn("leakage_violations", F.when(F.size(absent) > 0, F.raise_error(
        F.concat(F.lit("missing features: "), F.concat_ws(",", absent))).cast("int")).otherwise(
        F.coalesce("leakage_violations", F.lit(0))))
    return checked.select("event_id", "ticker", "quarter", "target_percentile", "surprise_percentile",
                          "leakage_violations", *[F.col(f"values.{n}").alias(n) for n in names])


def select_manifest(manifest: DataFrame, quarters: Sequence[str], types: Sequence[str]) -> DataFrame:
    """Sealed manifest entries that are wanted (unknown seal counts as sealed)."""
    return manifest.where(F.col("quarter").isin(*quarters) & F.col("event_type").isin(*types)
                          & F.coalesce("sealed", F.lit(True)))


def missing_from_manifest(spark: SparkSession, chosen: DataFrame, quarters: Sequence[str], types: Sequence[str]) -> DataFrame:
    """Wanted (quarter, type) pairs without an entry."""
    wanted = spark.createDataFrame([(q, t) for q in quarters for t in types], "quarter string, event_type string")
    return wanted.join(chosen.select("quarter", "event_type").distinct(), ["quarter", "event_type"], "left_anti")


def require_manifest(spark: SparkSession, manifest: DataFrame, quarters: Sequence[str], types: Sequence[str]) -> DataFrame:
    """The wanted entries, or an error naming what is absent."""
    chosen = select_manifest(manifest, quarters, types)
    absent = [tuple(r) for r in missing_from_manifest(spark, chosen, quarters, types).collect()]  # <= wanted pairs
    if absent:
        raise ValueError(f"manifest lacks {absent}")
    return chosen

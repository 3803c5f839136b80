"""The live path: events in, de-duplicated, enriched, scored, stored once."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.models import LinearModel
from tidemark.sources.archive import path_exists
from tidemark.sources.sinks import write_once

REPLAY_SECONDS = 300
DEADLINE_SECONDS = 300

EVENT = (
    "id STRING, event_id STRING, event_type STRING, event_datetime TIMESTAMP, sent_at TIMESTAMP, arrived_at TIMESTAMP, "
    "prediction_deadline TIMESTAMP, focal_assets ARRAY<STRUCT<identifier_type: STRING, identifier_value: STRING>>, payload DOUBLE")


def read_events(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """JSON deliveries dropped into a folder (any source with this schema works)."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).json(path)


def fresh(events: DataFrame, seconds: int = REPLAY_SECONDS) -> DataFrame:
    """Drop deliveries whose arrival is too far from their sending time."""
    apart = F.abs(F.unix_micros("arrived_at") - F.unix_micros("sent_at")) / F.lit(1e6)
    return events.where(F.coalesce(apart <= seconds, F.lit(False)))


def claimed(batch: DataFrame) -> DataFrame:
    """First delivery of each id inside a micro-batch, however late it comes.
    Repeats in later batches are caught by the key check of the sink, which never
    forgets; a watermark would discard first sightings that arrive out of order."""
    rest = [c for c in batch.columns if c != "id"]
    first = F.min_by(F.struct(*rest), F.struct("arrived_at", "sent_at", "event_id"))
    return batch.groupBy("id").agg(first.alias("__first")).select("id", "__first.*")


def per_asset(events: DataFrame) -> DataFrame:
    """One row per (event, asset); synthetic test events get a neutral 0.5."""
    rows = events.withColumn("asset", F.explode("focal_assets")).withColumn("ticker", F.col("asset.identifier_value")).drop("asset", "focal_assets")
    return rows.withColumn("neutral", F.when(F.col("event_type") == "TEST", F.lit(0.5)))


def lateness(at: Column, deadline: Column) -> Column:
    """Predictions after the deadline are tagged, not rejected."""
    return F.when(at > deadline, "late").otherwise("on_time")


def first_submission(submissions: DataFrame, event: str, at: str, order: str) -> DataFrame:
    """The earliest submission per event counts; combined map-side."""
    rest = [c for c in submissions.columns if c != event]
    return submissions.groupBy(event).agg(F.min_by(F.struct(*rest), F.struct(at, order)).alias("__s")).select(event, "__s.*")


def enrich(rows: DataFrame, families: dict[str, tuple[Callable[[DataFrame], DataFrame], dict[str, float]]]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Apply each family's join; a family that cannot be planned leaves its
    columns at their defaults and a receipt, and does not fail the others.

    A family maps to (join function, default of each column it adds).
    """
    receipts = []
    for name, (join, defaults) in families.items():
        try:
            rows = join(rows)
            rows = rows.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
            receipts.append((name, "ok"))
        except Exception as problem:  # noqa: BLE001 - isolation is the point
            rows = rows.withColumns({c: F.lit(v) for c, v in defaults.items()})
            receipts.append((name, f"error:{type(problem).__name__}"))
    return rows, receipts


def scoring_batch(model: LinearModel, families: dict, sink: str, receipts_sink: str | None = None) -> Callable[[DataFrame, int], None]:
    """The micro-batch body: enrich, score, tag, store once.

    Replaying a batch after a failure appends nothing that is already stored.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # several actions below; lost blocks are rebuilt from the source offsets
        try:
            store(batch, batch_id)
        finally:
            batch.unpersist()

    def store(batch: DataFrame, batch_id: int) -> None:
        rows, receipts = enrich(per_asset(claimed(batch)), families)
        scored = rows.withColumn("prediction", F.coalesce("neutral", model.score())).withColumn(
            "timing", lateness(F.col("arrived_at"), F.col("prediction_deadline")))
        record = scored.select(F.col("event_id").alias("event_key"), F.col("ticker").alias("ticker_key"), "event_type", "prediction",
                               "timing", "arrived_at", F.to_date("event_datetime").alias("event_day"),
                               *[c for _, d in families.values() for c in d])
        write_once(record, sink, partition="event_day")
        if receipts_sink:
            spark = batch.sparkSession
            noted = spark.createDataFrame([(int(batch_id), n, s) for n, s in receipts], "batch_id bigint, family string, status string")
            write_once(noted, receipts_sink, ["batch_id", "family"])

    return run


def run_to_end(events: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything available, in order, then stop."""
    query = (events.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if path_exists(spark, path) else None

"""The flows and checks under Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tallyward.functions import digests, parsing
from tallyward.model import FRESHNESS_SECONDS, RAW_EVENT
from tallyward.operators.checks import annotate, curated, lenient
from tallyward.operators.ordering import dense_position
from tallyward.plans import proposed
from tallyward.sources.sinks import write_curated

SLICE_ROWS = 20
# Parts a hot key is split into before the final deduplication.
DEDUPE_SALTS = 16


def read_events(
    spark: SparkSession, path: str, files_per_trigger: int | None = None, fmt: str = "parquet", **options: object
) -> DataFrame:
    """Raw events arriving as files."""
    reader = spark.readStream.schema(RAW_EVENT).format(fmt).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


# --- Micro-batches through the flows ----------------------------------------


def checked_stream(
    events: DataFrame, sink: str, metrics_path: str, checkpoint: str, as_of: str
) -> DataStreamWriter:
    """Each micro-batch goes through the checked flow.

    Rows and metrics land in a folder per batch id that is overwritten as a whole, so a
    batch that is replayed after a failure replaces its own output and adds nothing. A batch is kept while its sink
    and its metrics are computed, and released after.
    """

    def process(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            write_curated(curated(annotate(batch, as_of)), f"{sink}/batch_id={batch_id}")
            proposed.metrics(batch, as_of).write.mode("overwrite").option(
                "partitionOverwriteMode", "static"
            ).parquet(f"{metrics_path}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return events.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)


def minimal_stream(events: DataFrame, sink: str, checkpoint: str) -> DataStreamWriter:
    """The minimal flow has nothing that depends on other rows, so it streams as it is."""
    return (
        lenient(events)
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )


def batch_metrics(spark: SparkSession, metrics_path: str) -> DataFrame:
    return spark.read.parquet(metrics_path)


def totals(per_batch: DataFrame) -> DataFrame:
    """Micro-batch metrics put together into one row.

    Counts are summed. The order rate is total mismatches over total source rows, and
    reconciliation holds if it held in every batch. The plain sums of these two, as
    published, are ``out_of_order_sum`` and ``reconciliation_sum``.
    """
    skipped = {"batch_id", "slice", "downstream_reconciliation", "out_of_order"}
    counts = [c for c in per_batch.columns if c not in skipped]
    summed = per_batch.agg(
        F.count("*").alias("batches"),
        *[F.sum(c).alias(c) for c in counts],
        F.min("downstream_reconciliation").alias("downstream_reconciliation"),
        F.count_if("downstream_reconciliation").alias("reconciliation_sum"),
        F.round(F.sum(F.col("out_of_order").cast("decimal(30,12)")), 6).cast("double").alias("out_of_order_sum"),
    )
    rate = F.col("order_mismatches").cast("double") / F.greatest(
        F.lit(1), F.col("compared_source_rows")
    ).cast("double")
    return summed.withColumn("out_of_order", rate)


def sliced_metrics(events: DataFrame, as_of: str, rows: int = SLICE_ROWS, by: Sequence[str] = ()) -> DataFrame:
    """Batch twin: the metrics of each run of ``rows`` rows in arrival order."""
    placed = dense_position(events, "_position", by=by)
    sliced = placed.withColumn("slice", F.floor(F.col("_position") / rows).cast("bigint")).drop("_position")
    return proposed.metrics(sliced, as_of, by=[*by, "slice"], small_groups=True)


# --- Stateful checks --------------------------------------------------------


def with_event_ts(events: DataFrame) -> DataFrame:
    """Event time as a timestamp with zone, which watermarks require."""
    return events.withColumn("event_ts", parsing.to_event_ts(F.col("event_time")).cast("timestamp"))


def deduplicated_stream(events: DataFrame, horizon: str) -> DataFrame:
    """First arrival of each event id within the horizon, across micro-batches.

    Ids are deduplicated per hash part first, which spreads a hot id over several state
    partitions; what is left of it after that is at most one row per part.
    """
    salted = (
        with_event_ts(events)
        .withWatermark("event_ts", horizon)
        .withColumn("_salt", digests.bucket("salt", F.col("seq"), DEDUPE_SALTS))
    )
    return (
        salted.dropDuplicatesWithinWatermark(["event_id", "_salt"])
        .dropDuplicatesWithinWatermark(["event_id"])
        .drop("_salt")
    )


def duplicate_counts_stream(events: DataFrame, horizon: str, window: str = "1 day") -> DataFrame:
    """Copies per event id and event-time window; copies keep the event time they had.

    Aggregated per task before the shuffle, so a hot id costs one row per task.
    """
    return (
        with_event_ts(events)
        .withWatermark("event_ts", horizon)
        .groupBy(F.window("event_ts", window), "event_id")
        .agg(F.count("*").alias("copies"))
    )


def reconciled_stream(source: DataFrame, received: DataFrame, horizon: str) -> DataFrame:
    """(event_id, event_ts, status): ids that only one side has, across micro-batches.

    An id counts as ``missing`` (sent, not received) or ``unexpected`` (received, not sent) once the watermarks of both
    streams have passed its event time by the horizon, so a row that arrives late but within it is no difference. Event
    times do not change on the way. Copies are dropped first, as :func:`deduplicated_stream` does, so a hot id is one row.
    """

    def ids(events: DataFrame, side: str) -> DataFrame:
        return deduplicated_stream(events, horizon).select(
            F.col("event_id").alias(f"{side}_id"), F.col("event_ts").alias(f"{side}_ts")
        )

    sent, got = ids(source, "sent"), ids(received, "got")
    paired = sent.join(got, (sent.sent_id == got.got_id) & (sent.sent_ts == got.got_ts), "full_outer")
    alone = paired.where("sent_id is null or got_id is null")
    return alone.select(
        F.coalesce("sent_id", "got_id").alias("event_id"),
        F.coalesce("sent_ts", "got_ts").alias("event_ts"),
        F.when(F.col("got_id").isNull(), "missing").otherwise("unexpected").alias("status"),
    )


def stale_stream(events: DataFrame, as_of: str, horizon: str, window: str = "1 day") -> DataFrame:
    """Rows and stale rows per event-time window."""
    age = F.timestamp_diff("SECOND", F.col("event_ts"), F.lit(as_of).cast("timestamp"))
    return (
        with_event_ts(events)
        .withWatermark("event_ts", horizon)
        .groupBy(F.window("event_ts", window))
        .agg(F.count("*").alias("rows"), F.count_if(age > FRESHNESS_SECONDS).alias("stale_rows"))
        .select(F.col("window.start").alias("window_start"), "rows", "stale_rows")
    )


def stale_by_day(rows: DataFrame, ts: str, as_of: str) -> DataFrame:
    """Batch twin of :func:`stale_stream` over a timestamp column."""
    age = F.timestamp_diff("SECOND", F.col(ts), F.lit(as_of).cast("timestamp_ntz"))
    return rows.groupBy(F.date_trunc("DAY", ts).cast("timestamp_ntz").alias("day")).agg(
        F.count("*").alias("rows"), F.count_if(age > FRESHNESS_SECONDS).alias("stale_rows")
    )

"""Schemas and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------

# Fields every order event must carry.
REQUIRED_FIELDS = (
    "event_id",
    "event_time",
    "customer_id",
    "source_system",
    "amount",
    "status",
    "version",
    "checksum",
)

ORDER_STATUSES = ("created", "paid", "shipped")

STAGES = ("Ingestion", "Preprocessing", "Transformation", "Storage", "Output")

# (stage, checks, issue types) of the checked flow.
PROPOSED_FLOW = (
    ("Ingestion", ("schema_validation", "null_check"), ("schema_drift", "null_values")),
    ("Preprocessing", ("duplicate_detection", "checksum_validate"), ("duplication", "schema_drift")),
    ("Transformation", ("assertion_check", "type_validation"), ("incorrect_transformation",)),
    ("Storage", ("row_count_check", "checksum_reconcile"), ("data_loss", "inconsistency")),
    ("Output", ("downstream_validation", "consistency_check"), ("inconsistency", "corruption")),
)

# (stage, checks, issue types) of the minimal flow.
BASELINE_FLOW = (
    ("Ingestion", ("basic_schema_read",), ()),
    ("Preprocessing", ("optional_type_conversion",), ()),
    ("Transformation", ("basic_math",), ()),
    ("Storage", ("file_write",), ()),
    ("Output", ("manual_review",), ()),
)

# Categories used both for ground-truth labels and for findings.
LOSS = "loss"
DUPLICATION = "duplication"
CORRUPTION = "corruption"
SCHEMA_DRIFT = "schema_drift"
INCONSISTENCY = "inconsistency"
CATEGORIES = (LOSS, DUPLICATION, CORRUPTION, SCHEMA_DRIFT, INCONSISTENCY)

# Outcomes of a rejected row, in the order the stages test for them.
INVALID_SCHEMA = "invalid_schema"
NULLS = "nulls"
MALFORMED = "malformed"
TYPE_MISMATCHES = "type_mismatches"
TRANSFORMATION_FAILURES = "transformation_failures"
REJECT_REASONS = (INVALID_SCHEMA, NULLS, MALFORMED, TYPE_MISMATCHES, TRANSFORMATION_FAILURES)

# A row older than this many seconds at the as-of time is stale.
FRESHNESS_SECONDS = 86_400

# --- Schemas ----------------------------------------------------------------

# Raw layer: amount and version stay text, the only type that can hold drifted
# values. ``seq`` is the arrival order; ``faults`` holds ground-truth labels.
RAW_EVENT = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("event_time", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("source_system", T.StringType()),
        T.StructField("amount", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("checksum", T.StringType()),
        T.StructField("faults", T.ArrayType(T.StringType())),
    ]
)

CURATED_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_time", T.StringType()),
        T.StructField("customer_id", T.StringType()),
        T.StructField("source_system", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("status", T.StringType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("checksum", T.StringType()),
        T.StructField("total_tax", T.DoubleType()),
    ]
)

AB_RECORD = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("a", T.LongType()),
        T.StructField("b", T.LongType()),
        T.StructField("total", T.LongType()),
    ]
)

DATASETS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("uploaded_at", T.TimestampType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("schema_json", T.StringType()),
        T.StructField("file_path", T.StringType()),
    ]
)

EXPERIMENT_RUNS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("dataset_id", T.LongType()),
        T.StructField("scenario_name", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("error_message", T.StringType()),
    ]
)

PIPELINE_RESULTS = T.StructType(
    [
        T.StructField("experiment_run_id", T.LongType()),
        T.StructField("pipeline_type", T.StringType()),
        T.StructField("detection_accuracy", T.DoubleType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("false_positives", T.LongType()),
        T.StructField("false_negatives", T.LongType()),
        T.StructField("detected_loss", T.LongType()),
        T.StructField("detected_duplicates", T.LongType()),
        T.StructField("detected_corruption", T.LongType()),
        T.StructField("detected_inconsistency", T.LongType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("overhead_ms", T.DoubleType()),
        T.StructField("summary_json", T.StringType()),
    ]
)

STAGE_CHECKS = T.StructType(
    [
        T.StructField("experiment_run_id", T.LongType()),
        T.StructField("pipeline_type", T.StringType()),
        T.StructField("stage_name", T.StringType()),
        T.StructField("check_name", T.StringType()),
        T.StructField("issue_type", T.StringType()),
        T.StructField("passed", T.BooleanType()),
        T.StructField("findings_count", T.LongType()),
        T.StructField("notes", T.StringType()),
    ]
)

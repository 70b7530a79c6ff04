"""Reporting queries over stored results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.scalars import stable_avg
from tallyward.plans.combine import combine


def _only(pipeline_type: str, value: str) -> Column:
    return F.when(F.col("pipeline_type") == pipeline_type, F.col(value))


def kpi_stats(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Run count, average accuracy and false negatives per flow, average overhead.

    Averages over nothing are zero; average false negatives are cut to whole numbers.
    """
    averages = results.agg(
        stable_avg(_only("baseline", "detection_accuracy")).alias("baseline_detection_rate"),
        stable_avg(_only("proposed", "detection_accuracy")).alias("proposed_detection_rate"),
        stable_avg(_only("baseline", "false_negatives")).alias("baseline_false_negatives"),
        stable_avg(_only("proposed", "false_negatives")).alias("proposed_false_negatives"),
        stable_avg(_only("proposed", "overhead_ms")).alias("average_overhead_ms"),
    )
    row = combine([runs.agg(F.count("*").alias("total_experiments")), averages], ())
    zero = F.lit(0.0)
    return row.select(
        "total_experiments",
        F.coalesce("baseline_detection_rate", zero).alias("baseline_detection_rate"),
        F.coalesce("proposed_detection_rate", zero).alias("proposed_detection_rate"),
        F.coalesce("baseline_false_negatives", zero).cast("bigint").alias("baseline_false_negatives"),
        F.coalesce("proposed_false_negatives", zero).cast("bigint").alias("proposed_false_negatives"),
        F.coalesce("average_overhead_ms", zero).alias("average_overhead_ms"),
    )


def _side_by_side(results: DataFrame, values: list[str]) -> DataFrame:
    """One row per run; a struct per flow, null where the run lacks that flow."""
    packed = results.select("experiment_run_id", "pipeline_type", F.struct(*values).alias("_r"))
    return (
        packed.groupBy("experiment_run_id")
        .pivot("pipeline_type", ["baseline", "proposed"])
        .agg(F.first("_r", ignorenulls=True))
    )


def experiment_list(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs, newest first, with the accuracy of both flows (0 where a flow did not run)."""
    sides = _side_by_side(results, ["detection_accuracy"])
    joined = runs.join(sides, runs["id"] == sides["experiment_run_id"], "left")
    return joined.select(
        "id",
        "dataset_id",
        F.col("scenario_name").alias("scenario"),
        F.coalesce("baseline.detection_accuracy", F.lit(0.0)).alias("baseline_accuracy"),
        F.coalesce("proposed.detection_accuracy", F.lit(0.0)).alias("proposed_accuracy"),
        F.col("started_at").alias("timestamp"),
    ).orderBy(F.desc("id"))


def experiment_detail(runs: DataFrame, results: DataFrame, run_id: int) -> DataFrame:
    """One run with a struct per flow; a flow that did not run is null."""
    metrics = [
        F.col("detection_accuracy").alias("accuracy"),
        F.col("precision"),
        F.col("recall"),
        F.col("false_positives"),
        F.col("false_negatives"),
        F.col("latency_ms").alias("latency"),
        F.col("overhead_ms").alias("overhead"),
    ]
    one = results.filter(F.col("experiment_run_id") == run_id).select(
        "experiment_run_id", "pipeline_type", *metrics
    )
    values = ["accuracy", "precision", "recall", "false_positives", "false_negatives", "latency", "overhead"]
    sides = _side_by_side(one, values)
    joined = runs.filter(F.col("id") == run_id).join(sides, F.col("id") == F.col("experiment_run_id"), "left")
    return joined.select(
        "id", "dataset_id", F.col("scenario_name").alias("scenario"), "mode", "status",
        F.when(F.col("baseline").isNotNull(), F.col("baseline").dropFields("overhead")).alias("baseline"),
        "proposed",
    )


def stage_checks_for_run(checks: DataFrame, run_id: int) -> DataFrame:
    """The checks of one run, flat, told apart by flow."""
    return checks.filter(F.col("experiment_run_id") == run_id).select(
        "pipeline_type",
        F.col("stage_name").alias("stage"),
        F.col("check_name").alias("check"),
        "issue_type",
        "passed",
        F.col("findings_count").alias("findings"),
    )


def improvement(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Per run with both flows: accuracy gained, false negatives avoided, time added."""
    sides = _side_by_side(results, ["detection_accuracy", "false_negatives", "overhead_ms"])
    joined = runs.join(sides, runs["id"] == sides["experiment_run_id"])
    return joined.filter(F.col("baseline").isNotNull() & F.col("proposed").isNotNull()).select(
        "id",
        F.col("scenario_name").alias("scenario"),
        (F.col("proposed.detection_accuracy") - F.col("baseline.detection_accuracy")).alias("accuracy_gain"),
        (F.col("baseline.false_negatives") - F.col("proposed.false_negatives")).alias("fn_reduction"),
        F.col("proposed.overhead_ms").alias("overhead_ms"),
    )


def stage_pass_rate(checks: DataFrame) -> DataFrame:
    return checks.groupBy("stage_name", "pipeline_type").agg(
        stable_avg(F.col("passed").cast("int")).alias("pass_rate"), F.sum("findings_count").alias("findings")
    )


SCORES = ("precision", "recall", "false_positives", "false_negatives")
SERIES = ("baseline_latency", "proposed_latency", *SCORES)


def scenario_series(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Chart input in long form: (scenario, metric, value), averaged over runs.

    Latencies are per flow, scores are the checked flow's.
    """
    named = results.select("experiment_run_id", "pipeline_type", "latency_ms", *SCORES).join(
        runs.select(F.col("id").alias("experiment_run_id"), F.col("scenario_name").alias("scenario")),
        "experiment_run_id",
    )
    wide = named.groupBy("scenario").agg(
        stable_avg(_only("baseline", "latency_ms")).alias("baseline_latency"),
        stable_avg(_only("proposed", "latency_ms")).alias("proposed_latency"),
        *[
            stable_avg(_only("proposed", c).cast("double")).alias(c)
            for c in SCORES
        ],
    )
    return wide.unpivot(["scenario"], list(SERIES), "metric", "value")

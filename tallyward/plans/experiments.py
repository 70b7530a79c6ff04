"""Experiments: fault scenarios through both flows, all groups in one plan."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.scalars import ratio_or
from tallyward.model import (
    BASELINE_FLOW,
    CATEGORIES,
    CORRUPTION,
    DUPLICATION,
    INCONSISTENCY,
    INVALID_SCHEMA,
    LOSS,
    MALFORMED,
    NULLS,
    PROPOSED_FLOW,
    SCHEMA_DRIFT,
    TRANSFORMATION_FAILURES,
    TYPE_MISMATCHES,
)
from tallyward.operators import checks
from tallyward.operators.checks import STORED, annotate, facts
from tallyward.operators.reconcile import reconcile_keys
from tallyward.plans import baseline, deltas, proposed, scenarios, scoring
from tallyward.plans.combine import combine
from tallyward.sources.results import Results

MODES = ("baseline", "proposed", "compare")
DEFAULT_AS_OF = "2024-01-02T00:00:00"


def _in_one_frame(
    events: DataFrame,
    names: Sequence[str] | None,
    mixed: Callable[[dict[str, scenarios.FaultMix]], DataFrame],
    custom: Callable[[list[str]], DataFrame],
) -> DataFrame:
    """The fault mixes among the scenarios evaluated together, all others as whole copies of the rows."""
    mixes, others = scenarios.split(list(names or scenarios.SCENARIOS))
    parts = ([mixed(mixes)] if mixes else []) + ([custom(list(others))] if others else [])
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _received(events: DataFrame, as_of: str, names: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Checked rows of scenarios that are no fault mixes."""
    return facts(annotate(scenarios.injected(events, names), as_of), keys)


def _checked(
    events: DataFrame, mixes: dict[str, scenarios.FaultMix], as_of: str, by: Sequence[str], rows: DataFrame | None
) -> DataFrame:
    """The checked forms of all rows: ``rows``, if they are stored, or computed anew in each branch that needs them.

    Stored rows must be :func:`deltas.contents` of the same events, time and fault mixes, in the same order.
    """
    return deltas.contents(events, mixes, as_of, by) if rows is None else rows


def _detected(row: DataFrame) -> DataFrame:
    """Add the number of issues the checked flow reports."""
    reasons = (INVALID_SCHEMA, NULLS, TYPE_MISMATCHES, TRANSFORMATION_FAILURES)
    total = (F.col("checksum_mismatch_rows") > 0).cast("bigint")
    for reason in reasons:
        total = total + F.col(reason)
    return row.withColumn("proposed_detected_issues", total)


def detected_issues(
    events: DataFrame, as_of: str, names: Sequence[str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Issues the checked flow reports, and duplicate rows, per scenario."""
    keys = ["scenario", *by]

    def mixed(mixes: dict[str, scenarios.FaultMix]) -> DataFrame:
        rows = deltas.contents(events, mixes, as_of, by)
        row = combine([deltas.totals(rows, mixes, by), deltas.ids(rows, mixes, by)], keys)
        return _detected(row).select(
            *keys, "proposed_detected_issues", (F.col("kept") - F.col("kept_keys")).alias("duplicate_rows")
        )

    def custom(others: list[str]) -> DataFrame:
        return proposed.metrics_of(_received(events, as_of, others, keys), by=keys).select(
            *keys, "proposed_detected_issues", "duplicate_rows"
        )

    return _in_one_frame(events, names, mixed, custom)


def scenario_results(
    events: DataFrame, as_of: str, names: Sequence[str] | None = None, by: Sequence[str] = (), rows: DataFrame | None = None
) -> DataFrame:
    """One row per scenario with the published metrics, without latencies. ``rows``: see :func:`_checked`."""
    keys = ["scenario", *by]

    def mixed(mixes: dict[str, scenarios.FaultMix]) -> DataFrame:
        checked = _checked(events, mixes, as_of, by, rows)
        parts = [
            deltas.totals(checked, mixes, by),
            deltas.ids(checked, mixes, by),
            deltas.order_mismatches(deltas.arrivals(checked, events, mixes), mixes, by),
            deltas.stored_by_minimal(events, mixes, by),
        ]
        row = _detected(combine(parts, keys))
        rate = F.coalesce("order_mismatches", F.lit(0)).cast("double") / F.greatest(F.lit(1), "received").cast("double")
        return row.select(
            *keys,
            F.coalesce("record_count", F.lit(0)).alias("baseline_record_count"),
            F.col("received").alias("proposed_source_count"),
            F.col("kept").alias("proposed_stored_rows"),
            "proposed_detected_issues",
            F.when(F.col("received") > 0, F.col("rejected_keys") == 0).alias("proposed_reconciliation"),
            rate.alias("proposed_out_of_order_rate"),
            "source_rows",
        )

    def custom(others: list[str]) -> DataFrame:
        received = _received(events, as_of, others, keys)
        sizes = events.groupBy(*by).agg(F.count("*").alias("source_rows"))
        minimal = baseline.metrics(baseline.transform(scenarios.injected(events, others), *keys), keys)
        parts = [
            proposed.metrics_of(received, by=keys).select(
                *keys,
                F.col("source_count").alias("proposed_source_count"),
                F.col("stored_rows").alias("proposed_stored_rows"),
                "proposed_detected_issues",
                F.col("downstream_reconciliation").alias("proposed_reconciliation"),
                F.col("out_of_order").alias("proposed_out_of_order_rate"),
            ),
            minimal.select(*keys, F.col("record_count").alias("baseline_record_count")),
            scenarios.source_per_scenario(sizes, others),
        ]
        # A scenario that leaves no row at all still reports zeros.
        return combine(parts, keys).fillna(
            0,
            ["baseline_record_count", "proposed_source_count", "proposed_stored_rows",
             "proposed_detected_issues", "proposed_out_of_order_rate"],
        )

    row = _in_one_frame(events, names, mixed, custom)
    scored = scoring.published_scores(
        row, F.col("source_rows"), F.col("proposed_detected_issues"), F.col("proposed_stored_rows")
    )
    return scored.drop("source_rows")


def _evaluated(
    events: DataFrame, mixes: dict[str, scenarios.FaultMix], as_of: str, by: Sequence[str], rows: DataFrame | None = None
) -> DataFrame:
    """One row per scenario and group with all that findings and truth are counted from."""
    moved = deltas.arrivals(_checked(events, mixes, as_of, by, rows), events, mixes)
    parts = [
        deltas.totals(moved, mixes, by),
        deltas.displaced(deltas.first_arrivals(moved, mixes, by), mixes, by),
    ]
    return combine(parts, ["scenario", *by])


def true_matches(
    events: DataFrame, as_of: str, names: Sequence[str] | None = None, by: Sequence[str] = (), rows: DataFrame | None = None
) -> DataFrame:
    """True and false positives and false negatives per scenario, group and category. ``rows``: see :func:`_checked`."""
    keys = ["scenario", *by]

    def mixed(mixes: dict[str, scenarios.FaultMix]) -> DataFrame:
        c = F.col
        copies_found = c("copies") - c("first_copies")
        moved_found = c("moved_failed") + c("displaced_moved")
        # Surplus rows are all but the first arrival of an id; a lost id stands for its first row.
        counts = {
            CORRUPTION: [c(f"corrupt_{k}") for k in ("tp", "fp", "fn")],
            SCHEMA_DRIFT: [c(f"drift_{k}") for k in ("tp", "fp", "fn")],
            DUPLICATION: [copies_found, c("placed") - c("arrived_ids") - copies_found, c("first_copies")],
            LOSS: [c("lost_ids"), F.lit(0), c("dropped") - c("lost_ids") + c("labelled_lost")],
            INCONSISTENCY: [
                moved_found,
                c(TRANSFORMATION_FAILURES) - c("moved_failed") + c("displaced_unmoved"),
                c("moved") - moved_found,
            ],
        }
        sums = ("true_positives", "false_positives", "false_negatives")
        entries = [
            F.struct(F.lit(category).alias("category"), *[n.cast("bigint").alias(s) for s, n in zip(sums, ns)])
            for category, ns in counts.items()
        ]
        counted = _evaluated(events, mixes, as_of, by, rows).select(*keys, F.inline(F.array(*entries)))
        return counted.filter(" OR ".join(f"{s} > 0" for s in sums))

    def custom(others: list[str]) -> DataFrame:
        received = _received(events, as_of, others, keys)
        sources = scenarios.source_per_scenario(events.select(*by, "event_id", "seq"), others)
        found = scoring.findings_of(received, sources, keys)
        injected = scoring.truth(received, scenarios.lost_rows(events, others, by), keys)
        return scoring.matches(found, injected, keys)

    return _in_one_frame(events, names, mixed, custom)


def found_by_category(
    events: DataFrame, as_of: str, names: Sequence[str] | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Findings per scenario and category, one column each."""
    keys = ["scenario", *by]

    def mixed(mixes: dict[str, scenarios.FaultMix]) -> DataFrame:
        c = F.col
        found = {
            CORRUPTION: c("corrupt_tp") + c("corrupt_fp"),
            SCHEMA_DRIFT: c("drift_tp") + c("drift_fp"),
            DUPLICATION: c("placed") - c("arrived_ids"),
            LOSS: c("lost_ids"),
            INCONSISTENCY: c(TRANSFORMATION_FAILURES) + c("displaced_ids"),
        }
        total = sum(found.values(), F.lit(0))
        return (
            _evaluated(events, mixes, as_of, by)
            .where(total > 0)
            .select(*keys, *[found[name].cast("bigint").alias(name) for name in CATEGORIES])
        )

    def custom(others: list[str]) -> DataFrame:
        source = scenarios.source_per_scenario(events.select(*by, "event_id", "seq"), others)
        return scoring.by_category(scoring.findings_of(_received(events, as_of, others, keys), source, keys), keys)

    return _in_one_frame(events, names, mixed, custom)


def true_scores(
    events: DataFrame, as_of: str, names: Sequence[str] | None = None, by: Sequence[str] = (), rows: DataFrame | None = None
) -> DataFrame:
    """Checked-flow scores against ground truth, one row per scenario and group. ``rows``: see :func:`_checked`."""
    names = list(names or scenarios.SCENARIOS)
    keys = ["scenario", *by]
    counts = true_matches(events, as_of, names, by, rows)
    groups = scenarios.source_per_scenario(events.select(*by).distinct() if by else _one(events), names).select(*keys)
    return scoring.scores(scoring.detected_counts(counts, groups, keys))


def _one(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("_n"))


def stage_checks(
    events: DataFrame, as_of: str, names: Sequence[str] | None = None, by: Sequence[str] = (), rows: DataFrame | None = None
) -> DataFrame:
    """Findings per check of the checked flow: five stages, ten checks, real counts.

    ``assertion_check`` counts stored rows whose tax is not that of the amount before the faults,
    ``downstream_validation`` ids missing, unexpected or of another rank than in the source, and ``consistency_check``
    customers of the source without a stored event and the reverse. Scenarios that are no fault mixes cannot tell the
    amount before, so there the first counts transformation failures. ``rows``: see :func:`_checked`.
    """
    keys = ["scenario", *by]

    def mixed(mixes: dict[str, scenarios.FaultMix]) -> DataFrame:
        checked = _checked(events, mixes, as_of, by, rows)
        moved = deltas.arrivals(checked, events, mixes)
        customers = deltas.ids(checked, mixes, by, "customer_id").select(
            *keys, (F.col("missing_keys") + F.col("unexpected_keys")).alias("consistency_check")
        )
        parts = [
            deltas.totals(checked, mixes, by, prints=True),
            deltas.ids(checked, mixes, by),
            customers,
            deltas.displaced(deltas.first_arrivals(moved, mixes, by, stored_only=True), mixes, by, stored_only=True),
        ]
        return combine(parts, keys).select(
            *keys,
            F.col(INVALID_SCHEMA).alias("schema_validation"),
            F.col(NULLS).alias("null_check"),
            (F.col("kept") - F.col("kept_keys")).alias("duplicate_detection"),
            F.col("checksum_mismatch_rows").alias("checksum_validate"),
            F.col("wrong_tax").alias("assertion_check"),
            (F.col(TYPE_MISMATCHES) + F.col(MALFORMED)).alias("type_validation"),
            F.abs(F.col("source_rows") - F.col("kept")).alias("row_count_check"),
            (~F.col("stored_print").eqNullSafe(F.col("source_print"))).cast("bigint").alias("checksum_reconcile"),
            (F.col("missing_keys") + F.col("unexpected_keys") + F.col("displaced_ids")).alias("downstream_validation"),
            "consistency_check",
        )

    def custom(others: list[str]) -> DataFrame:
        received = facts(annotate(scenarios.injected(events, others), as_of), [*keys, "customer_id"])
        kept = received.filter(F.col("outcome") == STORED)
        source = events.select(*by, "event_id", "seq", "event_time", "customer_id", checks.payload_word().alias("payload_word"))
        sources = scenarios.source_per_scenario(source, others)
        moved = scoring.displaced(scoring.key_facts(kept, sources, keys), keys)
        parts = [
            proposed.metrics_of(received, sources, keys),
            _fingerprint(kept, keys, "stored_fingerprint"),
            scenarios.source_per_scenario(_fingerprint(source, by, "source_fingerprint"), others),
            moved.groupBy(*keys).agg(F.count("*").alias("displaced_ids")),
            reconcile_keys(sources, kept, ["customer_id"], keys).select(
                *keys, (F.col("missing") + F.col("unexpected")).alias("customers")
            ),
        ]
        number = lambda name: F.coalesce(name, F.lit(0))
        return combine(parts, keys).select(
            *keys,
            number("invalid_schema").alias("schema_validation"),
            number("nulls").alias("null_check"),
            number("duplicate_rows").alias("duplicate_detection"),
            number("checksum_mismatch_rows").alias("checksum_validate"),
            number("transformation_failures").alias("assertion_check"),
            (number("type_mismatches") + number("malformed")).alias("type_validation"),
            F.abs(number("compared_source_rows") - number("stored")).alias("row_count_check"),
            (~F.col("stored_fingerprint").eqNullSafe(F.col("source_fingerprint"))).cast("bigint").alias("checksum_reconcile"),
            (number("missing_ids") + number("unexpected_ids") + number("displaced_ids")).alias("downstream_validation"),
            number("customers").alias("consistency_check"),
        )

    row = _in_one_frame(events, names, mixed, custom)
    entries = [
        F.struct(
            F.lit(stage).alias("stage_name"),
            F.lit(check).alias("check_name"),
            F.lit(",".join(issues)).alias("issue_type"),
            F.coalesce(F.col(check), F.lit(0)).cast("bigint").alias("findings_count"),
        )
        for stage, stage_checks_, issues in PROPOSED_FLOW
        for check in stage_checks_
    ]
    return row.select(*keys, F.inline(F.array(*entries))).withColumn("passed", F.col("findings_count") == 0)


def _fingerprint(rows: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum(F.col("payload_word").cast("decimal(20,0)")).cast("string").alias(name))


def baseline_stage_checks(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The minimal flow checks nothing, so each of its steps passes with no findings."""
    entries = [
        F.struct(
            F.lit(stage).alias("stage_name"),
            F.lit(check).alias("check_name"),
            F.lit(",".join(issues)).alias("issue_type"),
            F.lit(0).cast("bigint").alias("findings_count"),
        )
        for stage, stage_checks_, issues in BASELINE_FLOW
        for check in stage_checks_
    ]
    return groups.select(*keys, F.inline(F.array(*entries))).withColumn("passed", F.lit(True))


def pipeline_results(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Result rows of both flows from the checked flow's scores.

    The minimal flow flags nothing: it misses whatever was injected.
    """
    injected = F.col("true_positives") + F.col("false_negatives")
    none = F.lit(0).cast("bigint")
    detected = ["detected_loss", "detected_duplicates", "detected_corruption", "detected_inconsistency"]
    missed_all = ratio_or(none, injected, 1.0)
    minimal = F.struct(
        F.lit("baseline").alias("pipeline_type"),
        missed_all.alias("detection_accuracy"),
        F.lit(1.0).alias("precision"),
        missed_all.alias("recall"),
        none.alias("false_positives"),
        injected.alias("false_negatives"),
        *[none.alias(n) for n in detected],
        F.lit("{}").alias("summary_json"),
    )
    summary = F.to_json(F.struct("true_positives", "false_positives", "false_negatives", *detected))
    checked = F.struct(
        F.lit("proposed").alias("pipeline_type"),
        "detection_accuracy",
        "precision",
        "recall",
        "false_positives",
        "false_negatives",
        *detected,
        summary.alias("summary_json"),
    )
    return scored.select(*keys, F.inline(F.array(minimal, checked)))


# --- Runs that are recorded ---------------------------------------------------


def _timed(action: Callable[[], object]) -> float:
    start = time.perf_counter()
    action()
    return (time.perf_counter() - start) * 1000.0


def _drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def latencies(events: DataFrame, scenario: str, as_of: str) -> tuple[float, float]:
    """Milliseconds of the minimal and of the checked flow. Each hands its rows to the same sink, then its metrics."""
    faulted = scenarios.inject(events, scenario)
    plain = baseline.transform(faulted)
    minimal = _timed(lambda: (_drain(plain), _drain(baseline.metrics(plain))))
    kept = checks.curated(annotate(faulted, as_of))
    checked = _timed(lambda: (_drain(kept), _drain(proposed.metrics(faulted, as_of))))
    return minimal, checked


def timed_scenario_results(events: DataFrame, as_of: str, names: Sequence[str] | None = None) -> DataFrame:
    """:func:`scenario_results` with measured latencies in seconds and the overhead."""
    names = list(names or scenarios.SCENARIOS)
    measured = [(n, *[ms / 1000.0 for ms in latencies(events, n, as_of)]) for n in names]
    timing = events.sparkSession.createDataFrame(
        measured, "scenario string, baseline_latency double, proposed_latency double"
    ).withColumn("latency_overhead", F.col("proposed_latency") - F.col("baseline_latency"))
    return combine([timing, scenario_results(events, as_of, names)], ["scenario"])


def run_experiment(
    results: Results,
    events: DataFrame,
    scenario: str,
    mode: str = "compare",
    as_of: str = DEFAULT_AS_OF,
    dataset_id: int | None = None,
    now: datetime | None = None,
) -> int:
    """Run one scenario, append its run, results and stage checks, return the run id.

    A run that fails is recorded as failed, with the message, and the error is raised.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; known: {', '.join(MODES)}")
    scenarios.scenario(scenario)
    started = now or datetime.now(timezone.utc)
    run_id = results.next_id("experiment_runs")
    head = (run_id, dataset_id, scenario, mode)
    try:
        _record_results(results, events, scenario, mode, as_of, run_id)
    except Exception as error:
        failed = (*head, "failed", started, datetime.now(timezone.utc), str(error))
        results.append_rows("experiment_runs", [failed])
        raise
    results.append_rows("experiment_runs", [(*head, "completed", started, now or datetime.now(timezone.utc), None)])
    return run_id


def _record_results(
    results: Results, events: DataFrame, scenario: str, mode: str, as_of: str, run_id: int
) -> None:
    wanted = ["baseline", "proposed"] if mode == "compare" else [mode]
    minimal, checked = latencies(events, scenario, as_of)
    overhead = checked - minimal if mode == "compare" else None
    run = F.lit(run_id).cast("bigint").alias("experiment_run_id")
    is_checked = F.col("pipeline_type") == "proposed"
    scored = (
        pipeline_results(true_scores(events, as_of, [scenario]), ["scenario"])
        .filter(F.col("pipeline_type").isin(wanted))
        .select(
            run,
            "*",
            F.when(is_checked, F.lit(checked)).otherwise(F.lit(minimal)).alias("latency_ms"),
            F.when(is_checked, F.lit(overhead).cast("double")).otherwise(F.lit(0.0)).alias("overhead_ms"),
        )
    )
    checked_stages = stage_checks(events, as_of, [scenario]).withColumn("pipeline_type", F.lit("proposed"))
    plain = baseline_stage_checks(
        scenarios.source_per_scenario(_one(events), [scenario]), ["scenario"]
    ).withColumn("pipeline_type", F.lit("baseline"))
    all_checks = (
        plain.unionByName(checked_stages)
        .filter(F.col("pipeline_type").isin(wanted))
        .select(run, "*", F.lit(None).cast("string").alias("notes"))
    )
    results.append("pipeline_results", scored)
    results.append("stage_checks", all_checks)

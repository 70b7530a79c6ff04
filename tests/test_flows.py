"""Both flows, published facts of each scenario, scores and AB records."""

import pytest
from pyspark.sql import functions as F

from tallyward.operators import faults, generate
from tallyward.plans import ab, baseline, experiments, proposed, scenarios, scoring
from tallyward.sources.sinks import read_curated

AS_OF = "2024-01-01T12:00:00"


def test_minimal_flow_on_clean_rows(spark, tmp_path):
    orders = generate.generate_orders(spark, 10, seed=1)
    assert baseline.run_batch(orders, str(tmp_path / "out")).first().record_count == 10


def test_minimal_flow_stores_drift_as_zero(spark, orders100, tmp_path):
    path = str(tmp_path / "out")
    drifted = faults.inject_schema_drift(orders100, 0.2)
    assert baseline.run_batch(drifted, path).first().record_count == 100
    assert read_curated(spark, path).filter("amount = 0.0").count() == drifted.filter("amount = 'N/A'").count()


def test_checked_flow_on_corrupt_rows(spark):
    orders = generate.generate_orders(spark, 10, seed=2)
    row = proposed.metrics(faults.inject_corruption(orders, 0.5), AS_OF).first()
    assert row.proposed_detected_issues is not None
    assert row.proposed_stored_rows <= row.source_count


def test_checked_flow_end_to_end(spark, tmp_path):
    orders = generate.generate_orders(spark, 20, seed=5)
    path = str(tmp_path / "out")
    row = proposed.run_batch(orders, path, AS_OF).first()
    assert row.downstream_reconciliation is True
    assert row.row_count_mismatch == 0 and row.stored_rows == 20
    assert read_curated(spark, path).columns[-1] == "total_tax"


@pytest.fixture(scope="module")
def published(orders100):
    rows = experiments.scenario_results(orders100, AS_OF).collect()
    return {r.scenario: r for r in rows}


def test_all_scenarios_are_reported(published):
    assert set(published) == set(scenarios.SCENARIOS)


def test_published_facts(published, orders100):
    clean, dup, drop = published["clean"], published["duplicated"], published["dropped"]
    assert (clean.proposed_stored_rows, clean.proposed_detected_issues, clean.precision) == (100, 0, 0.0)
    assert dup.proposed_stored_rows == dup.baseline_record_count > 100
    assert dup.proposed_detected_issues == 0 and dup.proposed_reconciliation
    assert drop.proposed_stored_rows + drop.false_negatives == 100
    assert drop.proposed_reconciliation and drop.proposed_detected_issues == 0
    corrupt = published["corrupted"]
    assert (corrupt.proposed_detected_issues, corrupt.precision, corrupt.recall) == (1, 1.0, 0.01)
    drift = published["schema_drift"]
    assert drift.proposed_detected_issues == 100 - drift.proposed_stored_rows == drift.false_negatives > 0
    assert not drift.proposed_reconciliation and drift.proposed_out_of_order_rate > 0
    moved = published["out_of_order"]
    assert (moved.proposed_out_of_order_rate, moved.proposed_detected_issues) == (0.0, 0)
    assert published["mixed"].proposed_detected_issues == 1
    for name in ("clean", "duplicated", "dropped", "corrupted", "out_of_order", "mixed"):
        assert published[name].proposed_out_of_order_rate == 0.0 and published[name].proposed_reconciliation


def test_comparing_with_the_original_sees_loss(orders100):
    row = proposed.metrics(faults.inject_missing(orders100, 0.2), AS_OF, source=orders100).first()
    assert row.missing_ids == 100 - row.stored > 0
    assert not row.downstream_reconciliation


def test_empty_input(orders100):
    row = proposed.metrics(orders100.filter("false"), AS_OF).first()
    assert (row.ingested, row.stored, row.out_of_order, row.downstream_reconciliation) == (0, 0, 0.0, True)


def test_true_scores(orders100):
    got = {r.scenario: r for r in experiments.true_scores(orders100, AS_OF).collect()}
    for name in ("clean", "duplicated", "dropped", "corrupted", "schema_drift", "out_of_order"):
        r = got[name]
        assert (r.false_positives, r.false_negatives, r.precision, r.recall, r.f1) == (0, 0, 1.0, 1.0, 1.0), name
    assert got["clean"].true_positives == 0 < got["duplicated"].detected_duplicates
    assert got["dropped"].detected_loss > 0 and got["schema_drift"].detected_corruption > 0
    assert got["mixed"].recall > 0.7


def test_nothing_found_nothing_injected(spark):
    counts = spark.createDataFrame([(0, 0, 0), (0, 0, 4), (0, 3, 0)],
                                   "true_positives long, false_positives long, false_negatives long")
    got = [(r.precision, r.recall, r.f1, r.detection_accuracy) for r in scoring.scores(counts).collect()]
    assert got == [(1.0, 1.0, 1.0, 1.0), (1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 1.0)]


def test_stage_checks_cover_the_catalogue(orders100):
    rows = experiments.stage_checks(orders100, AS_OF, ["clean", "dropped"]).collect()
    assert len(rows) == 20
    clean = [r for r in rows if r.scenario == "clean"]
    assert all(r.passed and r.findings_count == 0 for r in clean)
    failed = {r.check_name for r in rows if r.scenario == "dropped" and not r.passed}
    # Some customers have lost all their events.
    assert failed == {"row_count_check", "checksum_reconcile", "downstream_validation", "consistency_check"}


def test_ab_detections(spark):
    records = generate.generate_ab(spark, 100)
    expected = F.lit(100).cast("long")

    def total(df):
        return ab.detections(df, expected).first().detections

    assert total(records) == 0
    assert total(faults.inject_exact_duplicates(records)) == 10
    assert total(faults.inject_exact_corruption(records, fields=["a", "b"])) == 0
    assert total(faults.inject_tail_loss(records)) == 10
    assert total(faults.inject_negative_id(records)) == 29

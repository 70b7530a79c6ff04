"""Scenarios evaluated together must equal each scenario evaluated on a whole copy of the rows."""

import re

import pytest
from pyspark.sql import functions as F

from tallyward.operators import faults, generate
from tallyward.plans import deltas, experiments, scenarios
from tallyward.plans.scenarios import CustomScenario, FaultMix
from tallyward.plans.views import order_events, table

AS_OF = "2024-01-02T00:00:00"
MIXES = {
    "plain": FaultMix(),
    "copies": FaultMix(duplicates=0.3),
    "fewer": FaultMix(missing=0.3),
    "broken": FaultMix(corruption=0.2, schema_drift=0.3),
    "swaps": FaultMix(out_of_order=0.3),
    "all": FaultMix(missing=0.2, duplicates=0.2, corruption=0.2, schema_drift=0.1, out_of_order=0.2),
}


def _messy(spark):
    """Repeated ids, nulls, times that are none, amounts without tax, two groups."""
    seq = F.col("seq")
    return generate.generate_orders(spark, 400).select(
        (seq % 2).alias("part"),
        *[c for c in generate.generate_orders(spark, 1).columns if c not in ("event_id", "event_time", "amount", "customer_id")],
        F.when(seq % 37 == 0, "again").otherwise(F.col("event_id")).alias("event_id"),
        F.when(seq % 23 == 0, "no time").otherwise(F.col("event_time")).alias("event_time"),
        F.when(seq % 41 == 0, "1e25").when(seq % 43 == 0, "x").otherwise(F.col("amount")).alias("amount"),
        F.when(seq % 29 != 0, F.col("customer_id")).alias("customer_id"),
    )


@pytest.fixture(scope="module")
def messy(spark):
    return _messy(spark).cache()


@pytest.fixture
def registered(monkeypatch):
    def one(mix):
        rates = {f: getattr(mix, f) for f in ("missing", "duplicates", "corruption", "schema_drift", "out_of_order")}
        rates = {f: r for f, r in rates.items() if r > 0}
        return CustomScenario(
            lambda df: scenarios._apply(df, rates, df), lambda df: faults.missing_rows(df, rates.get("missing", 0.0))
        )

    known = MIXES | {f"own_{n}": one(m) for n, m in MIXES.items()}
    monkeypatch.setattr(scenarios, "SCENARIOS", known)
    return known


def rows_of(df):
    return {tuple(str(v).removeprefix("own_") for _, v in sorted(r.asDict().items())) for r in df.collect()}


def both(build, events, by):
    own = [f"own_{n}" for n in MIXES]
    return rows_of(build(events, AS_OF, list(MIXES), by)), rows_of(build(events, AS_OF, own, by))


@pytest.mark.parametrize("build", [
    experiments.scenario_results, experiments.detected_issues, experiments.true_matches, experiments.found_by_category,
])
def test_together_equals_one_by_one(messy, registered, build):
    mixed, own = both(build, messy, ("part",))
    assert mixed == own and len(mixed) >= len(MIXES)


def test_stage_checks_together_equal_one_by_one(messy, registered):
    by = ()
    mixed, own = both(experiments.stage_checks, messy, by)
    known = {r for r in mixed if "assertion_check" not in r}
    assert known == {r for r in own if "assertion_check" not in r} and len(known) == 9 * len(MIXES) * (1 + len(by))


def test_wrong_tax_counts_stored_rows_with_changed_amounts(spark, orders100):
    mixes = {"corrupted": FaultMix(corruption=0.3), "drift": FaultMix(schema_drift=0.3)}
    rows = deltas.contents(orders100, mixes, AS_OF)
    got = {r.scenario: r.wrong_tax for r in deltas.totals(rows, mixes, prints=True).collect()}
    hit = faults.inject_corruption(orders100, 0.3).filter("checksum = 'invalid'").count()
    assert got == {"corrupted": hit, "drift": 0} and hit > 0


def test_rows_without_arrival_number_pass_every_injector(spark, orders100):
    events = orders100.withColumn("seq", F.when(F.col("seq") % 10 != 0, F.col("seq")))
    nulls = lambda df: df.filter("seq IS NULL")
    for inject in (
        faults.inject_missing, faults.inject_duplicates, faults.inject_corruption, faults.inject_schema_drift,
        faults.inject_out_of_order,
    ):
        got = nulls(inject(events, 0.5))
        assert sorted(got.drop("seq").collect()) == sorted(nulls(events).drop("seq").collect()), inject
    gone, left = faults.missing_rows(events, 0.5).count(), faults.inject_missing(events, 0.5).count()
    assert gone + left == 100 and 0 < gone < 90
    mixes = {"all": FaultMix(missing=0.3, duplicates=0.3, corruption=0.3, schema_drift=0.3, out_of_order=0.3)}
    rows = deltas.arrivals(deltas.contents(events, mixes, AS_OF), events, mixes)
    assert rows.filter("slot IS NULL AND mask = 1 AND NOT is_moved AND outcome = 'stored'").count() == 10


def test_no_scenario_copies_the_rows(spark, orders100):
    mixes, _ = scenarios.split(list(scenarios.SCENARIOS))
    rows = deltas.contents(orders100, mixes, AS_OF)
    assert rows.count() < 2 * 100 < len(mixes) * 100


def test_few_evaluations(spark):
    df = experiments.true_scores(order_events(table(spark, "/root/testdata/sf0.001", "orders")), AS_OF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Wide scans are evaluations of the rows; the first unused arrival number comes from scans of one column.
    read = re.findall(r"FileScan parquet \[(.*?)\]", final)
    assert 0 < sum(r.count("#") > 1 for r in read) <= 8, read


def test_too_many_mixes(spark, orders100):
    with pytest.raises(ValueError):
        deltas.formed(orders100, {str(i): FaultMix() for i in range(61)})
    with pytest.raises(ValueError):
        deltas.formed(orders100, {"x": FaultMix(out_of_order=0.6)})


def test_stored_rows_serve_instead_of_the_events(spark, messy, registered, tmp_path):
    names = ["broken", "swaps"]
    deltas.contents(messy, {n: MIXES[n] for n in names}, AS_OF, ["part"]).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    anew = experiments.true_scores(messy, AS_OF, names, ["part"])
    stored = experiments.true_scores(messy, AS_OF, names, ["part"], rows=rows)
    assert rows_of(stored) == rows_of(anew)

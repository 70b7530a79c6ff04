"""The query catalogue: each entry is a function of a session and a data folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.functions import digests
from tallyward.operators import checks, digest_tree, faults, generate, group_rules, integrity, json_profile, key_sketch, reconcile
from tallyward.operators.checks import STORED, annotate
from tallyward.plans import ab, baseline, deltas, experiments, proposed, reports, scenarios
from tallyward.plans.combine import combine
from tallyward.plans.views import ab_view, order_events, spread, table
from tallyward.session import checkpoint_root
from tallyward.sources import readers, results, sinks
from tallyward.streaming import flows

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2001-08-02T00:00:00"
EVENTS_AS_OF = "2024-01-20T00:00:00"
NAMES = list(scenarios.SCENARIOS)

_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return order_events(spread(_orders(spark, sf)))


def _by_dataset(spark: SparkSession, sf: str) -> DataFrame:
    """Order events split into datasets by the number of the order priority."""
    priority = F.regexp_extract("o_orderpriority", "^[0-9]+", 0).cast("bigint")
    return order_events(spread(_orders(spark, sf)).withColumn("dataset", priority), "dataset")


def _ab(spark: SparkSession, sf: str) -> DataFrame:
    return ab_view(_orders(spark, sf))


def _shown(events: DataFrame) -> DataFrame:
    return events.withColumn("faults", F.array_join("faults", ","))


def _with_nulls(events: DataFrame) -> DataFrame:
    """Orders in which some customer ids and statuses are null."""
    seq = F.col("seq")
    return events.withColumns(
        {
            "customer_id": F.when(~digests.sampled("nullcust", seq, 0.03), F.col("customer_id")),
            "status": F.when(~digests.sampled("nullstat", seq, 0.02), F.col("status")),
        }
    )


# --- Sources and sinks ----------------------------------------------------------


@query
def schema_profile(spark, sf):
    return checks.column_profile(_orders(spark, sf)).select(
        F.col("ordinal").cast("bigint").alias("ordinal"), "column", "type", "rows", "non_null"
    )


@query
def null_profile(spark, sf):
    events = _with_nulls(_events(spark, sf)).drop("seq", "faults")
    return checks.null_profile(events)


@query
def read_accounting(spark, sf):
    return readers.read_dataset(spark, f"{sf}/lineitem.parquet").accounting


@query
def ndjson_bad_lines(spark, sf):
    lines = table(spark, sf, "events").select(
        F.when(digests.sampled("badjson", F.col("event_id"), 0.01), "{bad")
        .when(digests.sampled("blank", F.col("event_id"), 0.005), "  ")
        .otherwise(F.col("props"))
        .alias("value")
    )
    return readers.ndjson_counts(lines, T.StructType([T.StructField("k", T.LongType())]))


@query
def preview_sanitized(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, float("nan"))
        .when(F.col("event_id") % 3 == 1, float("inf"))
        .otherwise(F.col("value"))
        .alias("value"),
    )
    return readers.preview(rows, order="event_id")


@query
def stored_row_count(spark, sf):
    """Write the rows that pass, then compare what is on storage with what was offered."""
    events = faults.inject_schema_drift(_events(spark, sf), 0.2)
    path = f"{checkpoint_root(spark)}/tallyward-curated-{uuid.uuid4().hex}"
    sinks.write_curated(checks.curated(annotate(events, AS_OF)), path)
    offered = annotate(events, AS_OF).agg(F.count_if(F.col("outcome") == STORED).alias("offered_rows"))
    row = combine([sinks.stored_count(spark, path), offered], ())
    return row.withColumn("row_count_mismatch", F.col("stored_rows") != F.col("offered_rows"))


@query
def parsed_formats(spark, sf):
    """Customers written as CSV with line breaks in quotes, TSV, JSON arrays and NDJSON with bad lines, and read again."""
    note = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(' says "hi",\nthen\n\nleaves'))).otherwise(F.col("c_name"))
    rows = table(spark, sf, "customer").select("c_custkey", note.alias("note"), F.col("c_acctbal").cast("decimal(12,2)").alias("balance"))
    root = f"{checkpoint_root(spark)}/tallyward-formats-{uuid.uuid4().hex}"
    quoted = {"header": True, "escape": '"', "quoteAll": True}
    rows.write.options(**quoted).csv(f"{root}/csv")
    flat = rows.withColumn("note", F.replace("note", F.lit("\n"), F.lit(" ")))
    flat.write.options(**quoted, sep="\t").csv(f"{root}/tsv")
    arrays = rows.groupBy(F.shiftright("c_custkey", 10)).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(f"{root}/json")
    bad = F.when(F.col("c_custkey") % 7 == 0, F.array(F.lit('{"c_custkey": '), F.lit(" "))).otherwise(F.array().cast("array<string>"))
    lines = rows.select(F.explode(F.concat(F.array(F.to_json(F.struct("*"))), bad)).alias("value"))
    lines.write.text(f"{root}/ndjson")
    out = None
    for fmt in ("csv", "tsv", "json", "ndjson"):
        options = {"quotedLineBreaks": True} if fmt == "csv" else {}
        got = readers.read_dataset(spark, f"{root}/{fmt}", fmt, **options)
        read = got.df.agg(
            F.lit(fmt).alias("format"),
            F.count("*").alias("rows"),
            F.sum("c_custkey").alias("keys"),
            F.sum(F.length("note")).alias("characters"),
            F.count_if(F.col("note").contains('"hi",')).alias("quoted"),
            F.sum(F.col("balance").cast("decimal(12,2)")).cast("double").alias("balance"),
        )
        one = combine([read, got.accounting.select(F.lit(fmt).alias("format"), "total_rows", "malformed_lines")], ["format"])
        out = one if out is None else out.unionByName(one)
    return out


# --- Generation and faults ------------------------------------------------------


@query
def generate_orders(spark, sf):
    return generate.order_events(_orders(spark, sf).select(F.col("o_orderkey").alias("seq"))).drop("faults")


@query
def generate_ab(spark, sf):
    return generate.ab_records(_orders(spark, sf).select(F.col("o_orderkey").alias("id")))


@query
def fault_missing(spark, sf):
    return _shown(faults.inject_missing(_events(spark, sf), 0.1))


@query
def fault_duplicates(spark, sf):
    return _shown(faults.inject_duplicates(_events(spark, sf), 0.1))


@query
def fault_corruption(spark, sf):
    return _shown(faults.inject_corruption(_events(spark, sf), 0.1))


@query
def fault_schema_drift(spark, sf):
    return _shown(faults.inject_schema_drift(_events(spark, sf), 0.1))


@query
def fault_out_of_order(spark, sf):
    return _shown(faults.inject_out_of_order(_events(spark, sf), 0.1))


@query
def fault_tail_loss(spark, sf):
    return faults.inject_tail_loss(_ab(spark, sf), 0.1)


@query
def fault_exact_dup(spark, sf):
    return faults.inject_exact_duplicates(_ab(spark, sf), 0.1)


@query
def fault_exact_corrupt(spark, sf):
    return faults.inject_exact_corruption(_ab(spark, sf), 0.1, ["a", "b"])


@query
def fault_negative_id(spark, sf):
    return faults.inject_negative_id(_ab(spark, sf), 0.1)


@query
def scenario_mixed(spark, sf):
    return _shown(scenarios.inject(_events(spark, sf), "mixed"))


# --- Row checks -----------------------------------------------------------------


def _json_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Event properties where some lack the key and some hold null for it."""
    part = digests.bucket("keys", F.col("event_id"))
    return table(spark, sf, "events").select(
        F.when(part < 500, "{}").when(part < 1000, '{"k": null}').otherwise(F.col("props")).alias("document")
    )


@query
def schema_validation(spark, sf):
    document = F.col("document")
    absent = F.size(checks.json_missing_fields(document, ["k"])) > 0
    null = ~absent & F.get_json_object(document, "$.k").isNull()
    return _json_rows(spark, sf).agg(
        F.count("*").alias("rows"), F.count_if(absent).alias("invalid_schema"), F.count_if(null).alias("nulls")
    )


@query
def null_check(spark, sf):
    events = _with_nulls(_events(spark, sf))
    return events.agg(
        F.count("*").alias("rows"), F.count_if(~checks.no_nulls(events)).alias("rows_with_nulls")
    )


@query
def freshness(spark, sf):
    annotated = annotate(_events(spark, sf), AS_OF)
    return annotated.agg(F.count("*").alias("rows"), F.count_if("stale").alias("freshness_issues"))


@query
def enforce_types(spark, sf):
    typed = checks.enforced(faults.inject_schema_drift(_events(spark, sf), 0.2))
    return typed.filter("type_ok").select(
        "event_id", F.col("amount_num").alias("amount"), F.col("version_num").alias("version")
    )


@query
def type_rejects(spark, sf):
    typed = checks.enforced(faults.inject_schema_drift(_events(spark, sf), 0.2))
    return typed.filter(~F.col("type_ok")).select("seq", "event_id", "amount", "version")


@query
def validate_data_types(spark, sf):
    events = faults.inject_schema_drift(_with_nulls(_events(spark, sf)), 0.2)
    declared = {
        "event_id": T.StringType(),
        "customer_id": T.StringType(),
        "amount": T.DoubleType(),
        "version": T.IntegerType(),
        "not_there": T.StringType(),
    }
    return checks.type_violations(events, declared)


@query
def json_value_types(spark, sf):
    """Properties of events; some are text, null, no JSON or another key."""
    key = F.col("event_id") % 10
    props = (
        F.when(F.col("event_type") == "error", F.format_string('{"k": "%d"}', "user_id"))
        .when(key == 3, '{"k": null}')
        .when(key == 7, '{"k": 1')
        .when(key == 8, '{"other": 1}')
        .otherwise(F.col("props"))
    )
    events = table(spark, sf, "events").select(props.alias("props"))
    return checks.json_type_violations(events, "props", {"k": T.LongType()})


@query
def exact_amounts(spark, sf):
    """Amounts with a third decimal, or with a zero at the end, under checksums made before."""
    amount = F.when(F.col("seq") % 7 == 0, F.concat("amount", F.lit("5"))).when(
        F.col("seq") % 7 == 1, F.concat("amount", F.lit("0"))
    )
    events = _events(spark, sf).withColumn("amount", F.coalesce(amount, "amount"))
    return annotate(events, AS_OF).select("event_id", "total_tax", "checksum_ok")


@query
def redelivered_rows(spark, sf):
    """Line items per order, priced by line; some arrive twice, some have no arrival number."""
    line = F.col("l_linenumber")
    seq = F.when(line != 4, F.col("l_orderkey") * 8 + line)
    once = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", seq.alias("seq"))
    rows = once.unionByName(once.filter(line < 3))
    return integrity.duplicate_rows(rows, ["l_orderkey"], prefer=F.when(line % 3 != 0, line % 3))


@query
def ingestion_metrics(spark, sf):
    annotated = annotate(_with_nulls(_events(spark, sf)), AS_OF)
    return annotated.agg(
        F.count("*").alias("ingested"),
        F.count_if(F.col("outcome") == "invalid_schema").alias("invalid_schema"),
        F.count_if(F.col("outcome") == "nulls").alias("nulls"),
        F.count_if("stale").alias("freshness_issues"),
    )


@query
def malformed_event_time(spark, sf):
    late = digests.bucket("badtime", F.col("seq"))
    events = _events(spark, sf).withColumn(
        "event_time",
        F.when(late < 100, "not a time")
        .when(late < 200, "1999-02-30T00:00:00")
        .when(late < 300, F.substring("event_time", 1, 10))
        .otherwise(F.col("event_time")),
    )
    annotated = annotate(events, AS_OF)
    return annotated.agg(
        F.count("*").alias("rows"), F.count_if(F.col("outcome") == "malformed").alias("malformed")
    )


@query
def transform_tax(spark, sf):
    return checks.curated(annotate(_events(spark, sf), AS_OF)).select("event_id", "amount", "total_tax")


@query
def baseline_transform(spark, sf):
    return baseline.transform(faults.inject_schema_drift(_events(spark, sf), 0.2))


@query
def transform_sum(spark, sf):
    return baseline.run_ab(_ab(spark, sf))


# --- Integrity ------------------------------------------------------------------


@query
def event_checksum(spark, sf):
    return _events(spark, sf).select("event_id", "checksum")


@query
def row_checksum(spark, sf):
    return integrity.row_checksums(
        table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    )


@query
def checksum_mismatch(spark, sf):
    return integrity.checksum_report(annotate(faults.inject_corruption(_events(spark, sf), 0.2), AS_OF)).select(
        "rows", "mismatch_rows", F.col("checksum_mismatch").cast("bigint").alias("checksum_mismatch")
    )


@query
def table_fingerprint(spark, sf):
    columns = ["event_id", "customer_id", "amount", "event_time"]
    events = _events(spark, sf)
    dup, corrupt = faults.inject_duplicates(events, 0.2), faults.inject_corruption(events, 0.2)
    parts = [
        integrity.fingerprint(df, columns).select(F.lit(name).alias("side"), "row_count", "fingerprint")
        for name, df in (("source", events), ("duplicated", dup), ("corrupted", corrupt))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def duplicate_flag(spark, sf):
    return integrity.duplicate_summary(faults.inject_duplicates(_events(spark, sf), 0.2), ["event_id"]).select(
        "unique"
    )


@query
def duplicate_count(spark, sf):
    return integrity.duplicate_summary(faults.inject_duplicates(_events(spark, sf), 0.2), ["event_id"]).select(
        "surplus_rows", "repeated_keys"
    )


@query
def duplicate_rows(spark, sf):
    events = scenarios.inject(_events(spark, sf), "mixed")
    return integrity.duplicate_rows(events, ["event_id"], prefer=F.col("version").cast("int")).select(
        "seq", "event_id"
    )


@query
def dedupe_keep_first(spark, sf):
    events = scenarios.inject(_events(spark, sf), "mixed")
    return _shown(integrity.dedupe_keep_first(events, ["event_id"], prefer=F.col("version").cast("int")))


@query
def real_world_lineitem_keys(spark, sf):
    return integrity.duplicate_summary(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def real_world_doc_text(spark, sf):
    keys = table(spark, sf, "documents").select(*integrity.content_key(F.col("text")))
    return integrity.duplicate_summary(keys, ["digest", "length"])


def _tampered(records: DataFrame) -> DataFrame:
    """Totals of which some are off by one."""
    wrong = digests.sampled("wrongtotal", F.col("id"), 0.05)
    return integrity.with_total(records).withColumn("total", F.col("total") + F.when(wrong, 1).otherwise(0))


@query
def transform_correctness(spark, sf):
    records = _ab(spark, sf)
    return integrity.transform_errors(records, _tampered(records), integrity.with_total, "id")


@query
def sum_integrity(spark, sf):
    return _tampered(_ab(spark, sf)).agg(
        F.count("*").alias("rows"), F.count_if(integrity.sum_broken()).alias("integrity_errors")
    )


@query
def negative_id(spark, sf):
    return faults.inject_negative_id(_ab(spark, sf), 0.1).agg(
        F.count("*").alias("rows"), F.count_if(integrity.negative_id()).alias("negative_ids")
    )


@query
def rule_violations(spark, sf):
    rows = _tampered(_ab(spark, sf))
    rules = [
        integrity.Rule("broken_sum", integrity.sum_broken()),
        integrity.Rule("a_above_90", "a > 90"),
        integrity.Rule("equal_terms", F.col("a") == F.col("b")),
        ("repeated_pair", lambda df: df.groupBy("a", "b").count().filter("count > 1")),
    ]
    return integrity.rule_violations(rows, rules)


# --- Reconciliation -------------------------------------------------------------


@query
def reconcile_ids(spark, sf):
    events = _events(spark, sf)
    received = scenarios.inject(events, "mixed")
    return reconcile.reconcile_keys(events, received, ["event_id"])


@query
def missing_ids(spark, sf):
    records = _ab(spark, sf)
    left = records.filter(~digests.sampled("drop", F.col("id"), 0.2))
    return reconcile.missing_ids(left, records.agg(F.count("*")).scalar())


@query
def missing_intervals(spark, sf):
    """Order keys up to the highest that no order has, after some are lost."""
    keys = _orders(spark, sf).select(F.col("o_orderkey").alias("id"))
    left = keys.filter(~digests.sampled("drop", F.col("id"), 0.2))
    return reconcile.missing_intervals(left, keys.agg(F.max("id") + 5).scalar())


def _tampered_events(events: DataFrame) -> DataFrame:
    """A few amounts changed, a few rows lost, sent twice or under another id."""
    seq = F.col("seq")
    twice = F.when(digests.sampled("again", seq, 0.001), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return (
        events.filter(~digests.sampled("gone", seq, 0.002))
        .withColumn("_copy", F.explode(twice))
        .withColumns(
            {
                "amount": F.when(digests.sampled("changed", seq, 0.002), F.lit("1.00")).otherwise(F.col("amount")),
                "event_id": F.when(digests.sampled("renamed", seq, 0.001), F.concat("event_id", F.lit("x"))).otherwise(
                    F.col("event_id")
                ),
            }
        )
        .drop("_copy")
    )


@query
def digest_differences(spark, sf):
    """Keys that differ between the events and a copy in which a few were tampered with."""
    events = _events(spark, sf)
    columns = ["customer_id", "amount", "event_time", "status"]
    return digest_tree.differing_keys(events, _tampered_events(events), ["event_id"], columns)


@query
def sketch_differences(spark, sf):
    """Order keys that only the orders or only the received ones have, from sketches of both."""
    orders = _orders(spark, sf).select(F.col("o_orderkey").alias("id"))
    moved = F.when(digests.sampled("renamed", F.col("id"), 0.001), -F.col("id") - 1).otherwise(F.col("id"))
    received = orders.filter(~digests.sampled("gone", F.col("id"), 0.002)).select(moved.alias("id"))
    again = received.filter(digests.sampled("again", F.col("id"), 0.002))
    return key_sketch.differing_ids(orders, received.unionByName(again), "id")


@query
def arrival_inversions(spark, sf):
    """Inverted pairs of events per customer after swaps."""
    events = faults.inject_out_of_order(_events(spark, sf), 0.2)
    timed = events.withColumn("second", F.unix_seconds(F.to_timestamp("event_time")))
    return reconcile.inversions(timed, "second", by=["customer_id"])


LINE_RULES = (
    group_rules.GroupRule("line_is_key", ("l_orderkey", "l_linenumber")),
    group_rules.GroupRule("part_once_an_order", ("l_orderkey", "l_partkey")),
    group_rules.GroupRule("line_decides_part_and_price", ("l_orderkey", "l_linenumber"), ("l_partkey", "l_extendedprice")),
    group_rules.GroupRule("part_decides_supplier", ("l_partkey",), ("l_suppkey",)),
    group_rules.GroupRule("order_decides_shipdate", ("l_orderkey",), ("l_shipdate",)),
    group_rules.GroupRule("status_decides_flag", ("l_linestatus",), ("l_returnflag",)),
)


@query
def group_rule_violations(spark, sf):
    """Keys and functional dependencies of order lines."""
    return group_rules.group_rule_violations(spread(table(spark, sf, "lineitem")), LINE_RULES)


@query
def mixed_json_profile(spark, sf):
    """Paths and types of event properties, some of which were sent in another form."""
    part = F.pmod("event_id", F.lit(50))
    document = (
        F.when(part == 0, F.format_string('{"k": "%s", "o": {"a": 1.5, "b": [1, "{t[", null]}}', F.col("event_type")))
        .when(part == 1, F.format_string('[%s, {"k": true}]', F.col("props")))
        .when(part == 2, F.lit('{"k": '))
        .when(part == 3, F.lit(None))
        .otherwise(F.col("props"))
    )
    events = table(spark, sf, "events").select(document.alias("document"))
    return json_profile.json_profile(spread(events), "document")


@query
def accounted_write(spark, sf):
    """Rows that the write of the curated events counted, and those that are stored."""
    path = f"{checkpoint_root(spark)}/tallyward-accounted-{uuid.uuid4().hex}"
    return sinks.write_accounted(proposed.kept_rows(faults.inject_schema_drift(_events(spark, sf), 0.2), AS_OF), path)


@query
def row_count_reconcile(spark, sf):
    events = _events(spark, sf)
    stored = proposed.kept_rows(faults.inject_schema_drift(events, 0.2), AS_OF)
    return reconcile.row_count_reconcile(events, stored, ["status"])


@query
def positional_mismatch_rate(spark, sf):
    events = _events(spark, sf)
    stored = proposed.kept_rows(faults.inject_schema_drift(events, 0.2), AS_OF)
    return reconcile.positional_mismatch_rate(events, stored)


@query
def arrival_disorder(spark, sf):
    events = faults.inject_out_of_order(_events(spark, sf), 0.2)
    return reconcile.arrival_disorder(events, key=["customer_id"])


@query
def arrival_disorder_overall(spark, sf):
    events = faults.inject_out_of_order(generate_orders(spark, sf).withColumn("faults", generate.no_faults()), 0.2)
    return reconcile.arrival_disorder(events)


@query
def downstream_validation(spark, sf):
    events = _events(spark, sf)
    stored = proposed.kept_rows(scenarios.inject(events, "mixed"), AS_OF)
    keys = reconcile.reconcile_keys(events, stored, ["event_id"])
    order = reconcile.positional_mismatch_rate(events, stored)
    return combine([keys, order], ()).select(
        "reconciled", "missing", "unexpected", "mismatches", F.col("mismatch_rate").alias("out_of_order")
    )


@query
def consistency_orders_lineitem(spark, sf):
    return reconcile.referential_check(
        _orders(spark, sf), table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey"
    )


# --- Flows ----------------------------------------------------------------------


@query
def baseline_batch(spark, sf):
    return baseline.metrics(baseline.transform(scenarios.inject(_events(spark, sf), "mixed")))


def _proposed(name: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return proposed.metrics(scenarios.inject(_events(spark, sf), name), AS_OF)

    return run


for _name in NAMES:
    _QUERIES[f"proposed_{_name}"] = _proposed(_name)


@query
def proposed_against_source(spark, sf):
    """The mixed scenario compared with the rows before the faults."""
    events = _events(spark, sf)
    return proposed.metrics(scenarios.inject(events, "mixed"), AS_OF, source=events)


@query
def detected_issues(spark, sf):
    return experiments.detected_issues(_events(spark, sf), AS_OF)


@query
def ab_detections(spark, sf):
    records = _ab(spark, sf)
    expected = records.agg(F.count("*")).scalar()
    parts = []
    for name, faulted in (
        ("duplication", faults.inject_exact_duplicates(records)),
        ("corruption", faults.inject_exact_corruption(records, fields=["a", "b"])),
        ("data_loss", faults.inject_tail_loss(records)),
        ("inconsistency", faults.inject_negative_id(records)),
    ):
        parts.append(ab.detections(faulted, expected).select(F.lit(name).alias("fault_type"), "*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def stage_check_report(spark, sf):
    return experiments.stage_checks(_events(spark, sf), AS_OF)


@query
def stage_check_explode(spark, sf):
    """Each finding fanned out over the issue types of its stage."""
    found = experiments.stage_checks(_events(spark, sf), AS_OF, ["mixed"])
    return found.select(
        "stage_name", "check_name", F.explode(F.split("issue_type", ",")).alias("issue"), "findings_count", "passed"
    )


@query
def microbatch_metrics(spark, sf):
    events = scenarios.inject(_events(spark, sf), "mixed")
    return flows.totals(flows.sliced_metrics(events, AS_OF))


@query
def stale_by_day(spark, sf):
    return flows.stale_by_day(table(spark, sf, "events"), "ts", EVENTS_AS_OF)


# --- Evaluation -----------------------------------------------------------------


@query
def scenario_result(spark, sf):
    return experiments.scenario_results(_events(spark, sf), AS_OF, ["mixed"])


@query
def scenario_results(spark, sf):
    return experiments.scenario_results(_events(spark, sf), AS_OF, rows=_checked(spark, sf))


@query
def scores_reference(spark, sf):
    return experiments.scenario_results(_events(spark, sf), AS_OF, rows=_checked(spark, sf)).select(
        "scenario", "precision", "recall", "false_positives", "false_negatives"
    )


@query
def scores_true(spark, sf):
    return experiments.true_scores(_events(spark, sf), AS_OF)


@query
def matches_by_category(spark, sf):
    return experiments.true_matches(_events(spark, sf), AS_OF)


@query
def detected_by_category(spark, sf):
    return experiments.found_by_category(_events(spark, sf), AS_OF)


# --- Results analytics ----------------------------------------------------------


def _run_id() -> Column:
    place = F.array_position(F.array(*[F.lit(n) for n in NAMES]), F.col("scenario"))
    return ((place - 1) * 5 + F.col("dataset")).cast("bigint")


def _stored(build: Query) -> Query:
    """Results as a run leaves them: written once for a session and the files of the orders, and read from then on.

    They lie under ``spark.checkpoint.dir``, to be emptied when the application has ended. Files that are replaced have
    another time or size, so their results are computed anew.
    """

    def read(spark: SparkSession, sf: str) -> DataFrame:
        about = F.concat_ws("|", "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        files = _orders(spark, sf).select(about.alias("file")).distinct()
        read_from = files.agg(F.md5(F.array_join(F.sort_array(F.collect_list("file")), ","))).first()[0]
        folder = uuid.uuid5(uuid.NAMESPACE_URL, f"{sf}|{read_from}").hex
        app = spark.sparkContext.applicationId
        path = f"{checkpoint_root(spark)}/tallyward-results/{app}/{build.__name__}-{folder}"
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            build(spark, sf).write.mode("overwrite").parquet(path)
            return spark.read.parquet(path)

    return read


@_stored
def _checked(spark: SparkSession, sf: str) -> DataFrame:
    """The checked forms of all events, which results and stage checks are counted from."""
    mixes, _ = scenarios.split(NAMES)
    return deltas.contents(_by_dataset(spark, sf), mixes, AS_OF, ["dataset"])


@_stored
def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """One run per scenario and dataset; run n starts n hours into 2024."""
    datasets = _by_dataset(spark, sf).select("dataset").distinct()
    groups = scenarios.source_per_scenario(datasets, NAMES)
    started = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(hours=F.col("id").cast("int"))
    return groups.select(
        _run_id().alias("id"),
        F.col("dataset").alias("dataset_id"),
        F.col("scenario").alias("scenario_name"),
        F.lit("compare").alias("mode"),
        F.lit("completed").alias("status"),
    ).withColumn("started_at", started)


@_stored
def _results(spark: SparkSession, sf: str) -> DataFrame:
    scored = experiments.true_scores(_by_dataset(spark, sf), AS_OF, by=["dataset"], rows=_checked(spark, sf))
    rows = experiments.pipeline_results(scored, ["scenario", "dataset"])
    return rows.select(
        _run_id().alias("experiment_run_id"),
        "*",
        F.lit(None).cast("double").alias("latency_ms"),
        F.lit(None).cast("double").alias("overhead_ms"),
    )


@_stored
def _checks(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["scenario", "dataset"]
    events = _by_dataset(spark, sf)
    groups = scenarios.source_per_scenario(events.select("dataset").distinct(), NAMES)
    plain = experiments.baseline_stage_checks(groups, keys).withColumn("pipeline_type", F.lit("baseline"))
    checked = experiments.stage_checks(events, AS_OF, by=["dataset"], rows=_checked(spark, sf)).withColumn("pipeline_type", F.lit("proposed"))
    return plain.unionByName(checked).select(_run_id().alias("experiment_run_id"), "*")


@query
def kpi_stats(spark, sf):
    return reports.kpi_stats(_runs(spark, sf), _results(spark, sf))


@query
def experiment_list(spark, sf):
    return reports.experiment_list(_runs(spark, sf), _results(spark, sf))


@query
def experiment_detail(spark, sf):
    one = reports.experiment_detail(_runs(spark, sf), _results(spark, sf), run_id=33)
    metrics = ("accuracy", "precision", "recall", "false_positives", "false_negatives")
    return one.select(
        "id", "dataset_id", "scenario", "mode", "status",
        *[F.col(f"{side}.{m}").alias(f"{side}_{m}") for side in ("baseline", "proposed") for m in metrics],
    )


@query
def stage_checks_for_run(spark, sf):
    return reports.stage_checks_for_run(_checks(spark, sf), run_id=33)


@query
def improvement(spark, sf):
    return reports.improvement(_runs(spark, sf), _results(spark, sf)).drop("overhead_ms")


@query
def stage_pass_rate(spark, sf):
    return reports.stage_pass_rate(_checks(spark, sf))


@query
def scenario_series(spark, sf):
    return reports.scenario_series(_runs(spark, sf), _results(spark, sf))


@query
def table_counts(spark, sf):
    return results.table_counts(
        {
            "datasets": _orders(spark, sf).select("o_orderpriority").distinct(),
            "experiment_runs": _runs(spark, sf),
            "pipeline_results": _results(spark, sf),
            "stage_checks": _checks(spark, sf),
        }
    )


@query
def delete_cascade(spark, sf):
    """Rows left in each table once the runs of the mixed scenario are deleted."""
    runs = _runs(spark, sf)
    gone = runs.filter(F.col("scenario_name") == "mixed").select("id")
    return results.table_counts(
        {
            "experiment_runs": results.without_runs(runs, gone, "id"),
            "pipeline_results": results.without_runs(_results(spark, sf), gone, "experiment_run_id"),
            "stage_checks": results.without_runs(_checks(spark, sf), gone, "experiment_run_id"),
        }
    )


@query
def deleted_by_log(spark, sf):
    """:func:`delete_cascade` in stored tables, by one append to the log of deletions."""
    house = results.Results(spark, f"{checkpoint_root(spark)}/tallyward-log-{uuid.uuid4().hex}")
    runs = _runs(spark, sf)
    for name, rows in (("experiment_runs", runs), ("pipeline_results", _results(spark, sf)), ("stage_checks", _checks(spark, sf))):
        house.append(name, rows)
    house.delete_runs(runs.filter(F.col("scenario_name") == "mixed").select("id"))
    return house.table_counts().filter(F.col("table") != "datasets")


@query
def report_export_rows(spark, sf):
    return sinks.report_rows(reports.experiment_list(_runs(spark, sf), _results(spark, sf)))

"""Row checks, types and rules on literal rows."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.functions import digests, parsing
from tallyward.operators import checks, integrity, reconcile

AS_OF = "2024-01-03T00:00:00"


def test_duplicate_count(spark):
    rows = spark.createDataFrame([(1, 10), (2, 20), (1, 30)], "id int, value int")
    assert integrity.duplicate_summary(rows, ["id"]).first().surplus_rows == 1


def test_null_is_a_key(spark):
    rows = spark.createDataFrame([(None,), (None,), (1,)], "id int")
    got = integrity.duplicate_summary(rows, ["id"]).first()
    assert (got.surplus_rows, got.repeated_keys, got.unique) == (1, 1, False)


def test_type_violations(spark):
    rows = spark.createDataFrame([("1", "Alice"), ("x2", "Bob"), (None, "Eve")], "id string, name string")
    declared = {"id": T.IntegerType(), "name": T.StringType(), "absent": T.StringType()}
    got = checks.type_violations(rows, declared).first()
    assert (got.id_violations, got.name_violations, got.violations) == (2, 0, 2)


def test_strict_types(spark):
    rows = spark.createDataFrame([("1", "Alice"), ("2", "Bob")], "id string, name string")
    declared = {"id": T.IntegerType(), "name": T.StringType()}
    assert checks.type_violations(rows, declared).first().violations == 0
    assert checks.type_violations(rows, declared, strict=True).first().id_violations == 2


def test_json_types(spark):
    """A number in quotes is no number."""
    declared = {"id": T.IntegerType(), "name": T.StringType()}
    rows = spark.createDataFrame([('{"id": 1, "name": "Alice"}',), ('{"id": "2", "name": "Bob"}',)], "d string")
    got = checks.json_type_violations(rows, "d", declared).first()
    assert (got.id_violations, got.name_violations, got.violations) == (1, 0, 1)
    odd = spark.createDataFrame([("{}",), ('{"id": null}',), ("{bad",), (None,), ('{"id": 1.5}',)], "d string")
    got = checks.json_type_violations(odd, "d", declared).first()
    assert (got.id_violations, got.name_violations) == (4, 2)


def test_row_checksum_is_md5(spark):
    row = integrity.row_checksums(spark.createDataFrame([(1, "Alice")], "id int, name string")).first()
    assert len(row.row_checksum) == 32


def test_row_checksum_ignores_column_order(spark):
    one = integrity.row_checksums(spark.createDataFrame([(1, None)], "a int, b string")).first()
    two = integrity.row_checksums(spark.createDataFrame([(None, 1)], "b string, a int")).first()
    assert one.row_checksum == two.row_checksum


def test_transform_correctness(spark):
    rows = spark.createDataFrame([(0, 1, 2), (1, 3, 4)], "id int, a int, b int")
    right = spark.createDataFrame([(0, 1, 2, 3), (1, 3, 4, 7)], "id int, a int, b int, total int")
    wrong = spark.createDataFrame([(0, 1, 2, 4)], "id int, a int, b int, total int")
    assert integrity.transform_errors(rows, right, integrity.with_total, "id").first().errors == 0
    got = integrity.transform_errors(rows, wrong, integrity.with_total, "id").first()
    assert (got.compared, got.errors) == (1, 1)


@pytest.mark.parametrize(
    "text, double, integer",
    [
        ("N/A", None, None),
        ("", None, None),
        (" 1.5 ", 1.5, None),
        ("1_000", None, None),
        ("nan", None, None),
        ("inf", None, None),
        ("1.5d", None, None),
        ("1.0", 1.0, None),
        ("-7", -7.0, -7),
        ("1e3", 1000.0, None),
        (".5", 0.5, None),
        ("99999999999", 99999999999.0, None),
        (None, None, None),
    ],
)
def test_number_text(spark, text, double, integer):
    row = spark.createDataFrame([(text,)], "t string").select(
        parsing.to_double(F.col("t")).alias("d"), parsing.to_int(F.col("t")).alias("i")
    ).first()
    assert (row.d, row.i) == (double, integer)


def _event(**changes):
    base = {
        "seq": 0, "event_id": "order-1", "event_time": "2024-01-02T12:00:00", "customer_id": "c",
        "source_system": "web", "amount": "10.00", "status": "paid", "version": "1", "checksum": "x",
    }
    return base | changes


SCHEMA = (
    "seq long, event_id string, event_time string, customer_id string, source_system string, amount string, "
    "status string, version string, checksum string"
)


@pytest.mark.parametrize(
    "changes, outcome, stale",
    [
        ({}, "stored", False),
        ({"event_time": "2024-01-01T00:00:00"}, "stored", True),
        ({"event_time": "2024-01-02T00:00:00"}, "stored", False),
        ({"event_time": "yesterday"}, "malformed", False),
        ({"event_time": "2024-02-30T00:00:00"}, "malformed", False),
        ({"event_time": "2024-01-02T12:00:00+01:00"}, "malformed", False),
        ({"status": None}, "nulls", False),
        ({"amount": "N/A"}, "type_mismatches", False),
        ({"version": "1.0"}, "type_mismatches", False),
        ({"amount": None, "version": "x"}, "nulls", False),
    ],
)
def test_outcomes(spark, changes, outcome, stale):
    row = checks.annotate(spark.createDataFrame([_event(**changes)], SCHEMA), AS_OF).first()
    assert (row.outcome, row.stale) == (outcome, stale)


def test_absent_column_is_invalid_schema(spark):
    frame = spark.createDataFrame([_event()], SCHEMA).drop("status")
    assert checks.missing_fields(frame) == ["status"]
    assert checks.annotate(frame, AS_OF).first().outcome == "invalid_schema"


def test_json_absent_is_not_null(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ('{"a": null}',), ("{}",), ("{bad",), (None,)], "d string")
    got = [r[0] for r in rows.select(checks.json_missing_fields(F.col("d"), ["a"])).collect()]
    assert got == [[], [], ["a"], ["a"], ["a"]]


def test_lenient_keeps_everything(spark):
    rows = [_event(amount="N/A"), _event(amount=None), _event(amount="20"), _event(version=None)]
    got = checks.lenient(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.amount, r.total_tax, r.version) for r in got] == [
        (0.0, 0.0, 1), (0.0, 0.0, 1), (20.0, 2.0, 1), (10.0, 1.0, 1),
    ]


def test_tax_rounds_half_up(spark):
    rows = [_event(amount=a) for a in ("0.05", "0.15", "123.45")]
    got = [r.total_tax for r in checks.curated(checks.annotate(spark.createDataFrame(rows, SCHEMA), AS_OF)).collect()]
    assert got == [0.01, 0.02, 12.35]


def test_tax_is_rounded_once(spark):
    rows = [_event(amount=a) for a in ("12.345", "12.349", "12.350")]
    got = checks.annotate(spark.createDataFrame(rows, SCHEMA), AS_OF).collect()
    assert [r.total_tax for r in got] == [1.23, 1.23, 1.24]


@pytest.mark.parametrize(
    "amount, right",
    [("12.35", True), ("12.350", True), (" 12.35", True), ("12.349", False), ("12.345", False), ("1235e-2", False)],
)
def test_checksums_lose_no_digit(spark, amount, right):
    digest = digests.event_checksum(F.col("event_id"), F.col("customer_id"), F.lit("12.35"), F.col("event_time"))
    rows = spark.createDataFrame([_event(amount=amount)], SCHEMA).withColumn("checksum", digest)
    assert checks.annotate(rows, AS_OF).first().checksum_ok is right


def test_huge_amount_has_no_tax(spark):
    got = checks.annotate(spark.createDataFrame([_event(amount="1e25")], SCHEMA), AS_OF).first()
    assert (got.outcome, got.total_tax) == ("transformation_failures", None)


def test_row_digest_tells_rows_apart(spark):
    rows = [("1|b=2", "3"), ("1", "2|b=3"), (None, "3"), ("\\N", "3"), ("1", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(digests.row_digest(df.columns)).distinct().count() == len(rows)


def test_repeated_and_missing_arrival_numbers(spark):
    rows = [("k", 1, 5), ("k", 1, 5), ("k", 1, None), ("k", 1, None), ("m", 1, None), (None, 1, 2), (None, 1, 3)]
    df = spark.createDataFrame(rows, "k string, version int, seq long")
    for prefer in (None, F.col("version")):
        kept = integrity.dedupe_keep_first(df, ["k"], prefer=prefer).collect()
        assert {(r.k, r.seq) for r in kept} == {("k", 5), ("m", None), (None, 2)} and len(kept) == 3
        rest = [(r.k, r.seq) for r in integrity.duplicate_rows(df, ["k"], prefer=prefer).collect()]
        assert sorted(rest, key=str) == sorted([("k", 5), ("k", None), ("k", None), (None, 3)], key=str)


def test_small_rates(spark):
    hits = spark.range(3_000_000).filter(digests.sampled("s", F.col("id"), 0.00001)).count()
    assert 10 <= hits <= 60


def test_rules(spark):
    rows = spark.createDataFrame([(1, 1, 2, 3), (-1, 1, 2, 4), (-1, 5, 5, 10)], "id long, a long, b long, total long")
    rules = [
        integrity.Rule("sum", integrity.sum_broken()),
        integrity.Rule("sign", "id < 0"),
        ("repeats", lambda df: df.groupBy("id").count().filter("count > 1")),
    ]
    got = {r.rule: r.violations for r in integrity.rule_violations(rows, rules).collect()}
    assert got == {"sum": 1, "sign": 2, "repeats": 1}


def test_sum_treats_absent_as_zero(spark):
    rows = spark.createDataFrame([(None, 2, 2), (None, None, None), (1, None, None)], "a long, b long, total long")
    assert rows.filter(integrity.sum_broken()).count() == 1


def test_fingerprint_sees_copies(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    same, twice = one.orderBy(F.desc("i")), one.unionByName(one.limit(1)).unionByName(one.limit(1))
    first = integrity.fingerprint(one).first()
    assert integrity.fingerprint(same).first() == first
    assert integrity.fingerprint(twice).first().fingerprint != first.fingerprint


def test_missing_ids(spark):
    rows = spark.createDataFrame([(0,), (2,), (2,), (-1,), (9,)], "id long")
    assert sorted(r.id for r in reconcile.missing_ids(rows, F.lit(4)).collect()) == [1, 3]
    assert reconcile.missing_id_count(rows, F.lit(4)).first().missing == 2


def test_reconcile_ignores_copies(spark):
    left = spark.createDataFrame([("a",), ("b",)], "k string")
    right = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    assert reconcile.reconcile_keys(left, right, ["k"]).first().reconciled
    other = spark.createDataFrame([("a",), ("c",)], "k string")
    got = reconcile.reconcile_keys(left, other, ["k"]).first()
    assert (got.missing, got.unexpected, got.reconciled) == (1, 1, False)


def test_empty_inputs_give_zeros(spark):
    empty = spark.createDataFrame([], SCHEMA)
    got = reconcile.positional_mismatch_rate(empty, empty).first()
    assert (got.mismatches, got.source_rows, got.mismatch_rate) == (0, 0, 0.0)
    assert integrity.duplicate_summary(empty, ["event_id"]).first().surplus_rows == 0


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, `a.b` string")
    assert {r.field: r.nulls for r in checks.null_profile(df).collect()} == {"id": 0, "a.b": 1}
    assert {r.column: r.non_null for r in checks.column_profile(df).collect()} == {"id": 2, "a.b": 1}
    assert df.select(digests.row_digest(df.columns)).distinct().count() == 2


def test_missing_preference_and_no_rules(spark):
    df = spark.createDataFrame([("k", None, 0), ("k", 2, 1), ("k", 1, 2)], "k string, version int, seq long")
    assert [r.seq for r in integrity.dedupe_keep_first(df, ["k"], prefer=F.col("version")).collect()] == [1]
    assert integrity.rule_violations(df, []).collect() == []

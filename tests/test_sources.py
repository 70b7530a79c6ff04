"""Readers, accounting, registry, results tables and exports."""

import dataclasses
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.operators import generate
from tallyward.plans import experiments, reports
from tallyward.sources import delimited, readers, sinks
from tallyward.sources.results import Results

CSV = "order_id,customer_id,amount,date\n1,c1,10.5,2024-01-01\n2,c2,20.0,2024-01-02\n3,c1,,2024-01-03\n"


def _write(path, text):
    path.write_text(text)
    return str(path)


def _account(result):
    return result.accounting.first().asDict()


@pytest.mark.parametrize(
    "name, fmt",
    [("a.csv", "csv"), ("X.CSV", "csv"), ("b.tsv", "tsv"), ("c.json", "json"), ("d.ndjson", "ndjson"),
     ("e.parquet", "parquet"), ("f.xlsx", None), ("noext", None)],
)
def test_format_by_extension(name, fmt):
    assert readers.detect_format(name) == fmt


def test_unknown_format_is_an_error(spark):
    with pytest.raises(ValueError):
        readers.read_dataset(spark, "data.bin")


def test_csv_and_tsv(spark, tmp_path):
    for name, text in (("A.CSV", CSV), ("a.tsv", CSV.replace(",", "\t"))):
        got = readers.read_dataset(spark, _write(tmp_path / name, text))
        assert got.df.count() == 3
        assert got.schema == {"order_id": "int", "customer_id": "string", "amount": "double", "date": "date"}
        assert got.df.filter("amount is null").count() == 1
        assert _account(got)["processing_mode"] == "full"


def test_csv_line_break_in_quotes(spark, tmp_path):
    path = _write(tmp_path / "q.csv", 'id,note\n1,"two\nlines"\n2,plain\n')
    got = readers.read_dataset(spark, path, multiLine=True)
    assert got.df.count() == 2 and _account(got)["total_rows"] == 2


def _quoted_file(n, crlf=False):
    lines = ["id,note,x"]
    for i in range(n):
        note = {0: "plain", 1: '"two\nlines"', 2: '"a ""b"",\n\n\nc"', 3: '"' + "long\n" * 40 + '"', 4: ""}[i % 5]
        lines.append(f"{i},{note},{i / 2}")
    return "\n".join(lines) + "\n"


def test_quoted_line_breaks_in_many_tasks(spark, tmp_path, monkeypatch):
    folder = tmp_path / "q"
    folder.mkdir()
    for k, n in enumerate((700, 3, 250)):
        (folder / f"{k}.csv").write_text(_quoted_file(n))
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c in old:
            spark.conf.set(c, "1500")
        got = readers.read_dataset(spark, str(folder), "csv", quotedLineBreaks=True)
        assert delimited.record_texts(spark, str(folder)).select("_split").distinct().count() > 10
        want = readers.read_dataset(spark, str(folder), "csv", multiLine=True)
        key = lambda r: (r.id, str(r.note))
        assert sorted(got.df.collect(), key=key) == sorted(want.df.collect(), key=key)
        assert got.schema == want.schema == {"id": "int", "note": "string", "x": "double"}
        assert _account(got)["total_rows"] == 953 and _account(got)["malformed_lines"] == 0
        assert got.df.filter("note = 'a \"b\",\n\n\nc'").count() > 100
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_quoted_line_breaks_odd_files(spark, tmp_path):
    read = lambda text, **o: readers.read_dataset(spark, _write(tmp_path / f"f{abs(hash(text))}.csv", text), quotedLineBreaks=True, **o)
    bad = read('id,b\n1,"x\ny"\n2,3,4\n5\n"6",z\n')
    assert _account(bad)["malformed_lines"] == 2 and sorted(r.id for r in bad.df.collect()) == [1, 2, 5, 6]
    assert [tuple(r) for r in read('a;"b;c"\n1;"p\nq"\n', sep=";").df.collect()] == [(1, "p\nq")]
    assert read('a;"b;c"\n1;2\n', sep=";").df.columns == ["a", "b;c"]
    assert read("a,b\n").df.count() == 0 and read("").df.columns == []
    typed = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType())])
    assert [tuple(r) for r in read('a,b\n1,"2"\n', schema=typed).df.collect()] == [("1", 2)]
    assert read('1,"x\ny"\n2,z\n', header=False).df.columns == ["_c0", "_c1"]


def test_json_documents_that_are_none_are_counted(spark, tmp_path):
    folder = tmp_path / "j"
    folder.mkdir()
    for name, text in (("a", '[{"id": 1}, {"id": 2}]'), ("b", '{"id": 3}'), ("c", '{"id": '), ("d", '[{"id": 4}]')):
        (folder / f"{name}.json").write_text(text)
    got = readers.read_dataset(spark, str(folder), "json")
    assert sorted(r.id for r in got.df.collect()) == [1, 2, 3, 4] and got.df.columns == ["id"]
    assert _account(got)["malformed_lines"] == 1 and _account(got)["total_rows"] == 4


def test_blank_lines_of_delimited_files_are_counted(spark, tmp_path):
    got = readers.read_dataset(spark, _write(tmp_path / "b.csv", "a,b\n1,2\n\n  \n3,4\n"))
    assert _account(got)["blank_lines"] == 2 and got.df.count() == 2


def test_json_shapes(spark, tmp_path):
    array = _write(tmp_path / "a.json", json.dumps([{"id": 1}, {"id": 2}]))
    single = _write(tmp_path / "b.json", json.dumps({"id": 1, "x": None}))
    assert readers.read_dataset(spark, array).df.count() == 2
    assert readers.read_dataset(spark, single).df.count() == 1
    with pytest.raises(ValueError):
        readers.read_dataset(spark, _write(tmp_path / "c.json", "42"))


def test_ndjson_lines(spark, tmp_path):
    got = readers.read_dataset(
        spark, _write(tmp_path / "a.ndjson", '{"id": 1, "v": 2.5}\n\n{bad\n{"id": 2, "v": 3.5}\n{"id": 3, "v": 1.0}\n')
    )
    assert sorted(r.id for r in got.df.collect()) == [1, 2, 3]
    assert _account(got) == {
        "total_rows": 3, "rows_processed": 3, "processing_mode": "full", "truncated": False,
        "blank_lines": 1, "malformed_lines": 1,
    }
    with pytest.raises(ValueError):
        readers.read_dataset(spark, _write(tmp_path / "b.ndjson", "{bad\n{worse\n"))


def test_ndjson_rows_can_be_counted(spark, tmp_path):
    got = readers.read_dataset(spark, _write(tmp_path / "c.ndjson", '{"a": 1, "b": "x"}\n\n{bad\n{"a": 2}\n'))
    assert got.df.count() == 2 and got.df.columns == ["a", "b"]
    assert sorted(tuple(r) for r in got.df.collect()) == [(1, "x"), (2, None)]


def test_doubled_quotes_and_line_breaks(spark, tmp_path):
    quoted = _write(tmp_path / "q.csv", 'id,t\n1,"say ""hi"", ok"\n2,plain\n')
    assert [tuple(r) for r in readers.read_dataset(spark, quoted).df.orderBy("id").collect()] == [(1, 'say "hi", ok'), (2, "plain")]
    broken = _write(tmp_path / "m.csv", 'id,t\n1,"two\nlines"\n')
    assert [tuple(r) for r in readers.read_dataset(spark, broken, multiLine=True).df.collect()] == [(1, "two\nlines")]


def test_lines_of_another_length_are_counted(spark, tmp_path):
    for name, sep in (("a.csv", ","), ("a.tsv", "\t")):
        lines = ["id,b", "1,x", "3,4,5", "6", '7,"y, z"'] if sep == "," else ["id\tb", "1\tx", "3\t4\t5", "6", "7\ty"]
        got = readers.read_dataset(spark, _write(tmp_path / name, "\n".join(lines) + "\n"))
        assert got.df.count() == 4 and sorted(r.id for r in got.df.collect()) == [1, 3, 6, 7]
        assert _account(got)["malformed_lines"] == 2 and _account(got)["total_rows"] == 4
    broken = _write(tmp_path / "m.csv", 'id,t\n1,"two\nlines"\n2,b\n')
    assert _account(readers.read_dataset(spark, broken))["malformed_lines"] > 0
    assert _account(readers.read_dataset(spark, broken, multiLine=True))["malformed_lines"] == 0


def test_preview_hides_non_numbers(spark):
    inf = float("inf")
    rows = [(1, float("nan"), [1.0, inf]), (2, -inf, [2.0]), (3, None, None), (4, 1.5, []), (5, 2.5, [0.0]), (6, 0.0, [])]
    df = spark.createDataFrame(rows, "id int, x double, xs array<double>")
    got = readers.preview(df, order="id").collect()
    assert [r.x for r in got] == [None, None, None, 1.5, 2.5]
    assert got[0].xs == [1.0, None]


def test_parquet_round_trip(spark, tmp_path):
    path = str(tmp_path / "p.parquet")
    spark.range(7).write.parquet(path)
    assert _account(readers.read_dataset(spark, path))["total_rows"] == 7


def test_registry(spark, tmp_path):
    house = Results(spark, str(tmp_path / "house"))
    path = _write(tmp_path / "a.csv", CSV)
    scanned = readers.read_dataset(spark, path)
    outdated = scanned.accounting.withColumn("rows_processed", F.lit(1).cast("bigint"))
    scanned = dataclasses.replace(scanned, accounting=outdated)
    now = datetime(2024, 1, 1)
    first = house.register_dataset("a.csv", "csv", path, scanned, now)
    second = house.register_dataset("b.csv", "csv", path, scanned, now)
    assert (first, second) == (1, 2)
    assert [r.row_count for r in house.datasets().collect()] == [1, 1]
    house.rescan_dataset(2)
    assert {r.id: r.row_count for r in house.datasets().collect()} == {1: 1, 2: 3}
    info = json.loads(house.read("datasets").filter("id = 2").first().schema_json)
    assert info["columns"]["amount"] == "double" and info["processing_info"]["total_rows"] == 3
    with pytest.raises(LookupError):
        house.rescan_dataset(99)


def test_a_dataset_is_read_again_in_the_same_way(spark, tmp_path):
    house = Results(spark, str(tmp_path / "house"))
    path = _write(tmp_path / "s.csv", "id;b\n1;x\n")
    declared = T.StructType([T.StructField("id", T.StringType()), T.StructField("b", T.StringType())])
    first = readers.read_dataset(spark, path, schema=declared, sep=";")
    house.register_dataset("s.csv", "csv", path, first, datetime(2024, 1, 1))
    _write(tmp_path / "s.csv", "id;b\n1;x\n2;y\n")
    again = house.rescan_dataset(1)
    assert again.schema == first.schema == {"id": "string", "b": "string"} and again.options == {"sep": ";"}
    assert [r.row_count for r in house.datasets().collect()] == [2]


def test_one_log_entry_deletes_from_all_tables(spark, tmp_path):
    house = Results(spark, str(tmp_path / "house"))
    for run in (1, 2, 3):
        house.append("experiment_runs", spark.createDataFrame([(run,)], "id long"))
        for table in ("pipeline_results", "stage_checks"):
            house.append(table, spark.createDataFrame([(run,), (run,)], "experiment_run_id long"))
    house.delete_runs(spark.createDataFrame([(1,), (3,)], "id long"))
    house.delete_run(3)
    house.delete_run(99)
    left = {r.table: r.rows for r in house.table_counts().collect()}
    assert left == {"datasets": 0, "experiment_runs": 1, "pipeline_results": 2, "stage_checks": 2}
    assert house.next_id("experiment_runs") == 4
    assert sorted(p.name for p in (tmp_path / "house").iterdir()) == [
        "datasets", "deleted_runs", "experiment_runs", "pipeline_results", "stage_checks",
    ]


def test_experiments_are_recorded_and_deleted(spark, tmp_path):
    house = Results(spark, str(tmp_path / "house"))
    orders = generate.generate_orders(spark, 60)
    one = experiments.run_experiment(house, orders, "duplicated", "compare", dataset_id=1)
    two = experiments.run_experiment(house, orders, "clean", "proposed", dataset_id=1)
    counts = {r.table: r.rows for r in house.table_counts().collect()}
    assert counts == {"datasets": 0, "experiment_runs": 2, "pipeline_results": 3, "stage_checks": 25}
    runs, results = house.read("experiment_runs"), house.read("pipeline_results")
    listed = reports.experiment_list(runs, results).collect()
    assert [r.id for r in listed] == [two, one]
    assert (listed[0].baseline_accuracy, listed[0].proposed_accuracy) == (0.0, 1.0)
    assert (listed[1].baseline_accuracy, listed[1].proposed_accuracy) == (0.0, 1.0)
    detail = reports.experiment_detail(runs, results, two).first()
    assert detail.baseline is None and detail.proposed.accuracy == 1.0
    assert reports.improvement(runs, results).first().accuracy_gain == 1.0
    assert reports.stage_checks_for_run(house.read("stage_checks"), one).count() == 15
    saved = runs.filter(F.col("id") == one).first()
    assert saved.status == "completed" and saved.finished_at is not None
    house.delete_run(one)
    counts = {r.table: r.rows for r in house.table_counts().collect()}
    assert counts == {"datasets": 0, "experiment_runs": 1, "pipeline_results": 1, "stage_checks": 10}


def test_failed_run_is_recorded(spark, tmp_path):
    house = Results(spark, str(tmp_path / "house"))
    with pytest.raises(ValueError):
        experiments.run_experiment(house, spark.range(1), "no_such_scenario")
    with pytest.raises(Exception):
        experiments.run_experiment(house, spark.range(3), "clean")
    row = house.read("experiment_runs").first()
    assert row.status == "failed" and row.error_message


def test_kpis_of_nothing_are_zero(spark, tmp_path):
    house = Results(spark, str(tmp_path / "house"))
    row = reports.kpi_stats(house.read("experiment_runs"), house.read("pipeline_results")).first()
    assert tuple(row) == (0, 0.0, 0.0, 0, 0, 0.0)


def test_exports(spark, tmp_path):
    experiments_df = spark.createDataFrame([(1, "clean", 0.0, 0.1952)],
                                           "id long, scenario string, baseline_accuracy double, proposed_accuracy double")
    row = sinks.report_rows(experiments_df).first()
    assert (row.baseline_accuracy, row.proposed_accuracy, row.improvement) == ("0.0%", "19.5%", "19.5%")
    sinks.export_csv(sinks.report_rows(experiments_df), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().proposed_accuracy == "19.5%"
    summary = spark.createDataFrame([(1,)], "total_experiments long")
    sinks.export_json(summary, experiments_df, str(tmp_path / "json"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert {"summary": {"total_experiments": 1}} in lines and len(lines) == 2


def test_curated_schema(spark, tmp_path):
    path = str(tmp_path / "c")
    rows = spark.createDataFrame([("e", "t", "c", "web", 1, "paid", 1, "x", 0.1)],
                                 "event_id string, event_time string, customer_id string, source_system string, "
                                 "amount int, status string, version int, checksum string, total_tax double")
    sinks.write_curated(rows, path)
    sinks.write_curated(rows, path)
    stored = sinks.read_curated(spark, path)
    assert stored.count() == 1 and isinstance(stored.schema["amount"].dataType, T.DoubleType)

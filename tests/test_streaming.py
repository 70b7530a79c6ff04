"""Streams against their batch twins, replays and restarts."""

import shutil

import pytest
from pyspark.sql import functions as F

from tallyward.operators import faults, generate
from tallyward.plans import proposed
from tallyward.streaming import flows

AS_OF = "2024-01-01T12:00:00"


@pytest.fixture()
def feed(spark, tmp_path):
    """Writes a frame as one more file of the input folder."""
    folder = tmp_path / "in"
    folder.mkdir()
    made = []

    def add(df):
        part = tmp_path / f"part-{len(made)}"
        df.coalesce(1).write.parquet(str(part))
        file = next(part.glob("*.parquet"))
        shutil.copy(file, folder / f"f{len(made):03d}.parquet")
        made.append(file)
        return str(folder)

    return add


def _run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def _slices(df, rows=20):
    total = df.count()
    return [df.filter((F.col("seq") >= i) & (F.col("seq") < i + rows)) for i in range(0, total, rows)]


def test_micro_batches_equal_the_batch_twin(spark, feed, tmp_path):
    orders = faults.inject_schema_drift(faults.inject_corruption(generate.generate_orders(spark, 60), 0.2), 0.2)
    for part in _slices(orders):
        folder = feed(part)
    out, met, chk = (str(tmp_path / n) for n in ("out", "met", "chk"))

    def start():
        _run(flows.checked_stream(flows.read_events(spark, folder, 1), out, met, chk, AS_OF))

    start()
    streamed = flows.totals(flows.batch_metrics(spark, met)).first().asDict()
    twin = flows.totals(flows.sliced_metrics(orders, AS_OF)).first().asDict()
    assert streamed == twin and streamed["batches"] == 3
    assert spark.read.parquet(out).count() == twin["stored"]
    # Restarted from its checkpoint the stream does nothing twice, and goes on with new files.
    start()
    assert flows.totals(flows.batch_metrics(spark, met)).first().batches == 3
    feed(generate.generate_orders(spark, 10).withColumn("seq", F.col("seq") + 100))
    start()
    after = flows.totals(flows.batch_metrics(spark, met)).first()
    assert (after.batches, after.ingested) == (4, 70)


def test_replayed_batch_replaces_its_output(spark, tmp_path):
    orders = generate.generate_orders(spark, 20)
    out, met = str(tmp_path / "out"), str(tmp_path / "met")
    for _ in range(2):
        flows.write_curated(flows.curated(flows.annotate(orders, AS_OF)), f"{out}/batch_id=0")
        proposed.metrics(orders, AS_OF).write.mode("overwrite").parquet(f"{met}/batch_id=0")
    assert spark.read.parquet(out).count() == 20 and spark.read.parquet(met).count() == 1


def test_minimal_stream(spark, feed, tmp_path):
    orders = faults.inject_schema_drift(generate.generate_orders(spark, 30), 0.3)
    folder = feed(orders)
    out = str(tmp_path / "out")
    _run(flows.minimal_stream(flows.read_events(spark, folder), out, str(tmp_path / "chk")))
    assert spark.read.parquet(out).filter("amount = 0.0").count() == orders.filter("amount = 'N/A'").count()


def test_duplicates_across_micro_batches(spark, feed, tmp_path):
    orders = generate.generate_orders(spark, 40)
    hot = spark.range(200).select((F.col("id") + 1000).alias("seq")).crossJoin(orders.filter("seq = 7").drop("seq"))
    feed(orders)
    folder = feed(orders.filter("seq < 10").withColumn("seq", F.col("seq") + 40).unionByName(hot))
    out, chk = str(tmp_path / "out"), str(tmp_path / "chk")
    stream = flows.deduplicated_stream(flows.read_events(spark, folder, 1), "1 hour")
    _run(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", chk))
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [f"order-{i:06d}" for i in range(40)]
    counts = flows.duplicate_counts_stream(flows.read_events(spark, folder, 1), "1 hour")
    query = counts.writeStream.format("memory").queryName("copies").outputMode("complete")
    _run(query.option("checkpointLocation", str(tmp_path / "chk2")))
    assert spark.table("copies").agg(F.sum(F.col("copies") - 1)).first()[0] == 210


def test_stale_rows_per_day(spark, feed, tmp_path):
    orders = generate.generate_orders(spark, 120).withColumn(
        "event_time", F.date_format(F.expr("timestamp '2024-01-01' + make_interval(0,0,0,0,cast(seq as int))"),
                                    "yyyy-MM-dd'T'HH:mm:ss"))
    folder = feed(orders)
    stream = flows.stale_stream(flows.read_events(spark, folder), "2024-01-04T12:00:00", "1 hour")
    _run(stream.writeStream.format("memory").queryName("stale").outputMode("complete")
         .option("checkpointLocation", str(tmp_path / "chk")))
    got = {str(r.window_start)[:10]: (r.rows, r.stale_rows) for r in spark.table("stale").collect()}
    twin = flows.stale_by_day(orders.withColumn("ts", F.col("event_time").cast("timestamp_ntz")), "ts",
                              "2024-01-04T12:00:00")
    assert got == {str(r.day)[:10]: (r.rows, r.stale_rows) for r in twin.collect()}


def test_late_rows_are_left_out(spark, feed, tmp_path):
    early = generate.generate_orders(spark, 5)
    late = generate.generate_orders(spark, 5, start="2024-01-10T00:00:00")
    # A row counts as late against the watermark of the micro-batch before.
    for part in (early, late, late):
        feed(part)
    folder = feed(early)
    stream = flows.stale_stream(flows.read_events(spark, folder, 1), "2024-01-11T00:00:00", "1 hour")
    out = str(tmp_path / "out")
    _run(stream.writeStream.format("parquet").option("path", out).outputMode("append")
         .option("checkpointLocation", str(tmp_path / "chk")))
    first = spark.read.parquet(out).orderBy("window_start").first()
    assert first.rows == 5


def test_reconciled_across_batches(spark, tmp_path):
    def feed(name, parts):
        folder = tmp_path / name
        for i, part in enumerate(parts):
            made = tmp_path / f"{name}-{i}"
            part.coalesce(1).write.parquet(str(made))
            folder.mkdir(exist_ok=True)
            shutil.copy(next(made.glob("*.parquet")), folder / f"f{i:03d}.parquet")
        return flows.read_events(spark, str(folder), files_per_trigger=1)

    events = generate.generate_orders(spark, 300)
    raw = events.select(*flows.RAW_EVENT.names)
    # The last row of each side only moves the watermark on.
    last = raw.where("seq = 0").withColumns({"event_id": F.lit("end"), "event_time": F.lit("2031-01-01T00:00:00")})
    renamed = F.when(F.col("seq") % 50 == 0, F.concat("event_id", F.lit("?"))).otherwise(F.col("event_id"))
    got = raw.where("seq % 7 <> 3").withColumn("event_id", renamed)
    early, late = got.where("seq % 2 = 0"), got.where("seq % 2 = 1")
    source = feed("sent", [raw.where("seq < 150"), raw.where("seq >= 150"), last, last])
    received = feed("got", [early, late.unionByName(early.where("seq < 40")), last, last])
    alone = flows.reconciled_stream(source, received, "1 day")
    _run(alone.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")))
    found = {(r.event_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    sent, there = ({r.event_id for r in df.collect()} for df in (raw, got))
    assert found == {(i, "missing") for i in sent - there} | {(i, "unexpected") for i in there - sent}
    assert len(spark.read.parquet(str(tmp_path / "out")).collect()) == len(found)

"""Results tables that only grow: plain Parquet folders, and a log of deleted runs.

Nothing is ever rewritten. Rows are appended; one row in the log takes a run out of all its tables at once, as readers leave
out what the log names; a later entry of a dataset replaces the earlier ones. A job that dies halfway has appended nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.model import DATASETS, EXPERIMENT_RUNS, PIPELINE_RESULTS, STAGE_CHECKS
from tallyward.sources.readers import ReadResult, read_dataset

TABLES: dict[str, T.StructType] = {
    "datasets": DATASETS,
    "experiment_runs": EXPERIMENT_RUNS,
    "pipeline_results": PIPELINE_RESULTS,
    "stage_checks": STAGE_CHECKS,
}
DELETED = T.StructType([T.StructField("run_id", T.LongType()), T.StructField("deleted_at", T.TimestampType())])
# Tables of a run and the column that names it.
RUN_TABLES = {
    "experiment_runs": "id",
    "pipeline_results": "experiment_run_id",
    "stage_checks": "experiment_run_id",
}
# Which entry of a dataset holds.
_REVISION = T.StructField("revision", T.LongType())


def _stored_schema(table: str) -> T.StructType:
    if table == "deleted_runs":
        return DELETED
    schema = TABLES[table]
    return T.StructType([*schema.fields, _REVISION]) if table == "datasets" else schema


class Results:
    """The results under one root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _all(self, table: str) -> DataFrame:
        """Every row ever appended."""
        schema, path = _stored_schema(table), f"{self.root}/{table}"
        # Makes the folder where there is none, and does nothing else.
        self.spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def deleted(self) -> DataFrame:
        return self._all("deleted_runs")

    def read(self, table: str) -> DataFrame:
        """The rows that hold: those of runs that are not deleted, and the last entry of each dataset."""
        rows = self._all(table)
        if table in RUN_TABLES:
            return without_runs(rows, self.deleted().select(F.col("run_id").alias("id")), RUN_TABLES[table])
        if table == "datasets":
            last = F.max_by(F.struct(*[f.name for f in DATASETS.fields if f.name != "id"]), "revision").alias("entry")
            rows = rows.groupBy("id").agg(last).select("id", "entry.*")
        return rows.select(*[f.name for f in TABLES[table].fields])

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows; missing columns become null and all are cast to the table's schema."""
        out = df.select(
            *[
                (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                for f in _stored_schema(table).fields
            ]
        )
        out.write.mode("append").parquet(f"{self.root}/{table}")

    def append_rows(self, table: str, rows: Iterable[tuple]) -> None:
        self.append(table, self.spark.createDataFrame(list(rows), TABLES[table]))

    def next_id(self, table: str) -> int:
        """One above the highest id ever given, deleted ones included. Runs are recorded by one driver at a time."""
        return (self._all(table).agg(F.max("id")).first()[0] or 0) + 1

    def delete_run(self, run_id: int) -> None:
        """Take a run out of all its tables."""
        self.delete_runs(self.spark.createDataFrame([(run_id,)], "id bigint"))

    def delete_runs(self, runs: DataFrame) -> None:
        """Take all runs named in column ``id`` out of all tables, by one append to the log."""
        now = F.lit(datetime.now(timezone.utc))
        self.append("deleted_runs", runs.select(F.col("id").alias("run_id"), now.alias("deleted_at")))

    # --- Dataset registry ---

    def register_dataset(self, name: str, fmt: str, path: str, result: ReadResult, now) -> int:
        """Record a dataset that was read; its row count comes from the accounting, and how it was read is kept."""
        dataset_id = self.next_id("datasets")
        self._enter(dataset_id, 1, name, fmt, path, result, now)
        return dataset_id

    def _enter(self, dataset_id: int, revision: int, name: str, fmt: str, path: str, result: ReadResult, now) -> None:
        how = {"options": result.options, "schema": result.declared.jsonValue() if result.declared else None}
        entry = result.accounting.select(
            F.lit(dataset_id).alias("id"),
            F.lit(name).alias("name"),
            F.lit(fmt).alias("type"),
            F.lit(now).alias("uploaded_at"),
            F.col("rows_processed").alias("row_count"),
            F.to_json(
                F.struct(
                    F.struct(*[F.lit(t).alias(c) for c, t in result.schema.items()]).alias("columns"),
                    F.struct("*").alias("processing_info"),
                    F.lit(json.dumps(how)).alias("read_as"),
                )
            ).alias("schema_json"),
            F.lit(path).alias("file_path"),
            F.lit(revision).alias("revision"),
        )
        self.append("datasets", entry)

    def datasets(self) -> DataFrame:
        return self.read("datasets").select("id", "name", "type", "row_count", "uploaded_at")

    def rescan_dataset(self, dataset_id: int) -> ReadResult:
        """Read a registered file again, in the way it was read, and enter its present row count and schema."""
        found = self._all("datasets").filter(F.col("id") == dataset_id).orderBy(F.desc("revision")).take(1)
        if not found:
            raise LookupError(f"no dataset with id {dataset_id}")
        entry = found[0]
        how = json.loads(json.loads(entry.schema_json)["read_as"])
        schema = T.StructType.fromJson(how["schema"]) if how["schema"] else None
        result = read_dataset(self.spark, entry.file_path, entry.type, schema, **how["options"])
        self._enter(dataset_id, entry.revision + 1, entry.name, entry.type, entry.file_path, result, entry.uploaded_at)
        return result

    def table_counts(self) -> DataFrame:
        return table_counts({name: self.read(name) for name in TABLES})


def without_runs(rows: DataFrame, deleted: DataFrame, column: str) -> DataFrame:
    """Rows whose run is not among the deleted ids."""
    return rows.join(deleted.select(F.col("id").alias(column)), column, "left_anti").select(*rows.columns)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) for each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.lit(name).alias("table"), F.count("*").alias("rows"))
        out = one if out is None else out.unionByName(one)
    return out

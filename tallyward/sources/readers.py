"""Reading data files, with accounting of what was and was not read.

Reading stays lazy; accounting is one aggregate. There is no size limit and no row cap
unless the caller asks for one.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.functions.scalars import sanitize
from tallyward.sources.delimited import read_quoted

# File extensions and the formats they stand for.
FORMATS = ("csv", "tsv", "json", "ndjson", "parquet")
PREVIEW_ROWS = 5
BAD_LINE = "_corrupt_record"


@dataclass(frozen=True)
class ReadResult:
    df: DataFrame
    schema: dict[str, str]
    accounting: DataFrame
    options: dict[str, object] = field(default_factory=dict)
    declared: T.StructType | None = None


def detect_format(name: str) -> str | None:
    """Format by lower-cased extension, None if unknown."""
    ext = PurePosixPath(name).suffix.lower().lstrip(".")
    return ext if ext in FORMATS else None


def read_dataset(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType | None = None,
    **options: object,
) -> ReadResult:
    """Read a file or folder. Options go to Spark's reader; all rows are read.

    CSV and TSV files are split across tasks. For files with line breaks inside quotes pass ``quotedLineBreaks=True``,
    which keeps them split, or ``multiLine=True``, which makes Spark read each file in one task. Lines with too many or too
    few fields, or with values that do not fit the schema, stay in the rows as far as they can be read, and are counted as
    malformed. A JSON document that is no array of objects or object is counted as malformed and gives no row.
    """
    fmt = (fmt or detect_format(path) or "").lower()
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format for {path!r}; supported: {', '.join(FORMATS)}")
    if fmt in ("csv", "tsv"):
        rows, counts = _read_delimited(spark, path, "," if fmt == "csv" else "\t", schema, options)
    elif fmt == "json":
        rows, counts = _read_json(spark, path, schema, options)
    elif fmt == "ndjson":
        rows, counts = _read_ndjson(spark, path, schema, options)
    else:
        reader = spark.read.options(**options)
        rows = (reader.schema(schema) if schema else reader).parquet(path)
        counts = _counts(rows)
    return ReadResult(rows, dict(rows.dtypes), account(counts), options, schema)


def _counts(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("valid_rows"),
        F.lit(0).cast("bigint").alias("blank_lines"),
        F.lit(0).cast("bigint").alias("malformed_lines"),
    )


def account(counts: DataFrame) -> DataFrame:
    """One row: total, processed, mode and truncated; blank and malformed lines are reported by themselves.

    There is no cap, so all valid rows are processed and nothing is truncated.
    """
    return counts.select(
        F.col("valid_rows").alias("total_rows"),
        F.col("valid_rows").alias("rows_processed"),
        F.lit("full").alias("processing_mode"),
        F.lit(False).alias("truncated"),
        "blank_lines",
        "malformed_lines",
    )


def _read_delimited(spark, path, sep, schema, options):
    # A quote inside a quoted field is written twice.
    opts = {"header": True, "sep": sep, "escape": '"'} | options
    if str(opts.pop("quotedLineBreaks", False)).lower() == "true":
        rows, malformed, parsed = read_quoted(spark, path, opts, schema, BAD_LINE)
        bad = F.count_if(malformed).alias("malformed_lines")
        return rows, parsed.agg(F.count("*").alias("valid_rows"), F.lit(0).cast("bigint").alias("blank_lines"), bad)
    blank = F.lit(0).cast("bigint")
    if str(opts.get("multiLine", False)).lower() != "true":
        # Blank lines are skipped by the parser, so they are counted in the text.
        blank = spark.read.text(path).agg(F.count_if(F.trim("value") == "")).scalar()
    reader = spark.read.options(**opts)
    rows = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if not rows.columns:
        return rows, _counts(rows)
    checked = T.StructType([*rows.schema.fields, T.StructField(BAD_LINE, T.StringType())])
    strict = opts | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE, "columnPruning": False}
    lines = spark.read.options(**strict).schema(checked).csv(path)
    # The text of a bad line cannot be read without a data column beside it.
    beside = F.coalesce(F.length(F.col(f"`{rows.columns[0]}`").cast("string")), F.lit(0)) >= 0
    return rows, lines.agg(
        F.count("*").alias("valid_rows"),
        F.first(blank).alias("blank_lines"),
        F.count_if(F.col(BAD_LINE).isNotNull() & beside).alias("malformed_lines"),
    )


def _read_json(spark, path, schema, options):
    """Files that each hold an array of objects or a single object; a file that holds neither is malformed."""
    opts = {"multiLine": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE} | options
    found = schema or spark.read.options(**opts).json(path).schema
    fields = [f for f in found.fields if f.name != BAD_LINE]
    if not fields:
        raise ValueError(f"{path!r} must hold an array of objects or a single object")
    full = T.StructType([*fields, T.StructField(BAD_LINE, T.StringType())])
    lines = spark.read.options(**opts).schema(full).json(path)
    # The text of a bad document cannot be read without a data column beside it.
    beside = F.coalesce(F.length(F.to_json(F.struct(f"`{fields[0].name}`"))), F.lit(0)) >= 0
    bad = F.col(BAD_LINE).isNotNull() & beside
    return lines.filter(~bad).select(*[f"`{f.name}`" for f in fields]), lines.agg(
        F.count_if(~bad).alias("valid_rows"), F.lit(0).cast("bigint").alias("blank_lines"), F.count_if(bad).alias("malformed_lines")
    )


def _read_ndjson(spark, path, schema, options):
    """One object per line; blank lines are ignored, malformed lines skipped and counted."""
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE} | options
    if schema is None:
        schema = spark.read.options(**opts).json(path).schema
    fields = [f for f in schema.fields if f.name != BAD_LINE]
    if not fields:
        raise ValueError(f"{path!r} is empty or holds no valid line")
    full = T.StructType([*fields, T.StructField(BAD_LINE, T.StringType())])
    lines = spark.read.text(path)
    row = F.from_json("value", full, {k: str(v) for k, v in opts.items()}).alias("row")
    parsed = lines.filter(F.trim("value") != "").select(row)
    parsed = parsed.filter(F.col("row").isNotNull() & F.col("row").getField(BAD_LINE).isNull())
    rows = parsed.select(*[F.col("row").getField(f.name).alias(f.name) for f in fields])
    return rows, ndjson_counts(lines, full)


def ndjson_counts(lines: DataFrame, schema: T.StructType, text: str = "value") -> DataFrame:
    """Valid, blank and malformed lines of a text frame, from one pass."""
    line = F.col(text)
    blank = F.trim(line) == ""
    bad = bad_json(line, schema)
    return lines.agg(
        F.count_if(~blank & ~bad).alias("valid_rows"),
        F.count_if(blank).alias("blank_lines"),
        F.count_if(~blank & bad).alias("malformed_lines"),
    )


def bad_json(line, schema: T.StructType):
    """True where the text is not a JSON object Spark can parse with the schema."""
    names = [f for f in schema.fields if f.name != BAD_LINE]
    probe = T.StructType([*names, T.StructField(BAD_LINE, T.StringType())])
    parsed = F.from_json(line, probe, {"columnNameOfCorruptRecord": BAD_LINE})
    return parsed.isNull() | parsed.getField(BAD_LINE).isNotNull()


def preview(df: DataFrame, rows: int = PREVIEW_ROWS, order: str | None = None) -> DataFrame:
    """First rows with NaN and infinities as null; with ``order``, the first in that order."""
    clean = sanitize(df)
    return clean.orderBy(order).limit(rows) if order else clean.limit(rows)

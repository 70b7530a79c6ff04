"""Delimited files with line breaks inside quotes, read by many tasks.

A line starts a record if the quotes before it in its file are even in number. So each split of a file counts its quotes,
prefix sums over the splits of a file tell each split how it starts, and a window inside a split tells each line. Only the
lines of records that span several are brought together, across the seams of splits where need be. Spark's parser then
reads the records. Files of another record separator than a line break, or with quotes that are escaped otherwise than by
doubling, need Spark's ``multiLine`` reader.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FILE, _SPLIT = "_file", "_split"


def record_texts(spark: SparkSession, path: str, quote: str = '"') -> DataFrame:
    """(file, split, line, value): one row per record, with its line breaks, named by its first line's place."""
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias(_FILE),
        F.col("_metadata.file_block_start").alias(_SPLIT),
        F.monotonically_increasing_id().alias("_line"),
        "value",
        (F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))).alias("_quotes"),
    )
    # One row per split; a file's splits are its bytes over the split size.
    splits = lines.groupBy(_FILE, _SPLIT).agg(F.sum("_quotes").alias("_n"))
    over_file = Window.partitionBy(_FILE).orderBy(_SPLIT).rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select(_FILE, _SPLIT, F.coalesce(F.sum("_n").over(over_file), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(_FILE, _SPLIT).orderBy("_line")
    counted = lines.withColumn(
        "_upto", F.coalesce(F.sum("_quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).join(splits, [_FILE, _SPLIT])
    starts = (F.col("_before") + F.col("_upto")) % 2 == 0
    place = F.struct(F.col(_SPLIT).alias("split"), F.col("_line").alias("line"))
    upto_here = inside.rowsBetween(Window.unboundedPreceding, 0)
    marked = counted.withColumn("_starts", starts).withColumn(
        "_record", F.last(F.when(F.col("_starts"), place), ignorenulls=True).over(upto_here)
    )
    whole = marked.filter(F.col("_starts") & (F.col("_quotes") % 2 == 0))
    parts = marked.filter(~F.col("_starts") | (F.col("_quotes") % 2 != 0))
    # Lines at the head of a split belong to the last record that starts before it.
    last = parts.groupBy(_FILE, _SPLIT).agg(F.max("_record").alias("_last"))
    earlier = last.select(_FILE, _SPLIT, F.last("_last", ignorenulls=True).over(over_file).alias("_earlier"))
    stitched = (
        parts.join(earlier, [_FILE, _SPLIT], "left")
        .groupBy(_FILE, F.coalesce("_record", "_earlier").alias("_record"))
        .agg(F.array_sort(F.collect_list(F.struct(_SPLIT, "_line", "value"))).alias("_lines"))
        .select(
            _FILE, F.col("_record.split").alias(_SPLIT), F.col("_record.line").alias("_line"),
            F.array_join("_lines.value", "\n").alias("value"),
        )
    )
    return whole.select(_FILE, _SPLIT, "_line", "value").unionByName(stitched).filter(F.trim("value") != "")


def _unquoted(names: str, sep: str, quote: str) -> list[str]:
    """Column names of a header record."""
    out, field, inside = [], "", False
    for i, c in enumerate(names):
        if c == quote:
            inside = not inside
            field += c if inside and i and names[i - 1] == quote else ""
        elif c == sep and not inside:
            out.append(field)
            field = ""
        else:
            field += c
    return [*out, field]


# Types a column may have, in the order they are tried.
_TYPES = (T.IntegerType(), T.LongType(), T.DoubleType(), T.DateType(), T.TimestampType(), T.BooleanType())


def _inferred(texts: DataFrame, names: list[str]) -> T.StructType:
    """The first type all values of a column have, from one aggregate; text where there is none or no value."""
    tests = []
    for i in range(len(names)):
        value = F.col(f"c{i}")
        tests.append(F.count(value).alias(f"n{i}"))
        tests += [F.count(value.try_cast(t)).alias(f"n{i}_{k}") for k, t in enumerate(_TYPES)]
    row = texts.agg(*tests).first()
    fields = []
    for i, name in enumerate(names):
        fits = [t for k, t in enumerate(_TYPES) if row[f"n{i}"] and row[f"n{i}_{k}"] == row[f"n{i}"]]
        fields.append(T.StructField(name, fits[0] if fits else T.StringType()))
    return T.StructType(fields)


def read_quoted(
    spark: SparkSession, path: str, options: Mapping[str, object], schema: T.StructType | None, bad: str
) -> tuple[DataFrame, Column, DataFrame]:
    """(rows, predicate of malformed rows, all parsed rows) of delimited files with line breaks inside quotes."""
    sep, quote = str(options.get("sep", ",")), str(options.get("quote", '"'))
    header = str(options.get("header", True)).lower() == "true"
    records = record_texts(spark, path, quote)
    if header or schema is None:
        head = records.orderBy(_FILE, _SPLIT, "_line").limit(1).first()
        found = _unquoted(head.value, sep, quote) if head else []
        names = found if header else [f"_c{i}" for i in range(len(found))]
    else:
        names = schema.fieldNames()
    if header:
        # The first record of each file; only the first lines of files are compared.
        tops = records.groupBy(_FILE).agg(F.min(F.struct(_SPLIT, "_line")).alias("_top"))
        records = (
            records.join(tops, _FILE).filter(F.struct(_SPLIT, "_line") != F.col("_top")).drop("_top")
        )
    parse = {"sep": sep, "quote": quote, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    parse |= {k: str(v) for k, v in options.items() if k in ("nullValue", "dateFormat", "timestampFormat")}

    def parsed(as_type: T.StructType) -> DataFrame:
        full = T.StructType([*as_type.fields, T.StructField(bad, T.StringType())])
        return records.select(F.from_csv("value", _ddl(full), parse).alias("_row"))

    if schema is None:
        texts = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        schema = _inferred(parsed(texts).select("_row.*"), names) if names else T.StructType([])
    rows = parsed(schema)
    good = rows.select(*[F.col("_row").getField(f.name).alias(f.name) for f in schema.fields])
    return good, F.col("_row").getField(bad).isNotNull(), rows


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)

"""Row checks. They annotate rows with columns, so any number of them costs one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.functions import digests, parsing, scalars
from tallyward.model import (
    FRESHNESS_SECONDS,
    INVALID_SCHEMA,
    MALFORMED,
    NULLS,
    REQUIRED_FIELDS,
    TRANSFORMATION_FAILURES,
    TYPE_MISMATCHES,
)

STORED = "stored"


# --- Required fields and nulls ----------------------------------------------


def missing_fields(df: DataFrame, required: Sequence[str] = REQUIRED_FIELDS) -> list[str]:
    """Required columns the frame does not have at all."""
    return [name for name in required if name not in df.columns]


def json_missing_fields(document: Column, required: Sequence[str]) -> Column:
    """Required keys absent from a JSON object; a key holding null is present."""
    parsed = F.from_json(document, "map<string,string>")
    absent = [
        F.when(~F.coalesce(F.map_contains_key(parsed, F.lit(name)), F.lit(False)), F.lit(name))
        for name in required
    ]
    return F.array_compact(F.array(*absent))


def all_present(df: DataFrame, required: Sequence[str] = REQUIRED_FIELDS) -> Column:
    """False for every row if a required column is absent."""
    return F.lit(not missing_fields(df, required))


def no_nulls(df: DataFrame, required: Sequence[str] = REQUIRED_FIELDS) -> Column:
    """True where every required field is there and not null."""
    checks = [F.col(f"`{n}`").isNotNull() if n in df.columns else F.lit(False) for n in required]
    out = checks[0]
    for check in checks[1:]:
        out = out & check
    return out


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(field, nulls) for each column, from a single aggregate."""
    names = list(columns or df.columns)
    counted = df.agg(*[F.count_if(F.col(f"`{n}`").isNull()).alias(f"n{i}") for i, n in enumerate(names)])
    entries = [F.struct(F.lit(n).alias("field"), F.col(f"n{i}").alias("nulls")) for i, n in enumerate(names)]
    return counted.select(F.inline(F.array(*entries)))


def column_profile(df: DataFrame) -> DataFrame:
    """(ordinal, column, type, rows, non_null) for each column, from a single aggregate."""
    counted = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(f"`{n}`")).alias(f"n{i}") for i, n in enumerate(df.columns)])
    entries = [
        F.struct(
            F.lit(i).alias("ordinal"),
            F.lit(name).alias("column"),
            F.lit(dtype).alias("type"),
            F.col("_rows").alias("rows"),
            F.col(f"n{i}").alias("non_null"),
        )
        for i, (name, dtype) in enumerate(df.dtypes)
    ]
    return counted.select(F.inline(F.array(*entries)))


# --- Types ------------------------------------------------------------------


def type_violations(df: DataFrame, schema: Mapping[str, T.DataType], strict: bool = False) -> DataFrame:
    """One row: violations per declared field and their sum. Absent fields are skipped.

    Text that reads as a number is accepted as one, unless ``strict``.
    """
    present = {n: t for n, t in schema.items() if n in df.columns}
    return _violations(
        df, {n: ~parsing.has_type(F.col(f"`{n}`"), df.schema[n].dataType, t, strict) for n, t in present.items()}
    )


# Types that JSON values have as variants.
_JSON_TYPES = {
    "int": ("BIGINT",),
    "bigint": ("BIGINT",),
    "double": ("DOUBLE", "DECIMAL"),
    "float": ("DOUBLE", "DECIMAL"),
    "string": ("STRING",),
    "boolean": ("BOOLEAN",),
}


def json_type_violations(df: DataFrame, document: str, schema: Mapping[str, T.DataType]) -> DataFrame:
    """One row as :func:`type_violations`, over JSON objects in a text column: ``2`` is an integer, ``"2"`` is not.

    An absent key is skipped; a null, or a document that is no JSON, violates every field.
    """
    parsed = F.try_parse_json(F.col(f"`{document}`"))
    wrong = {}
    for name, expected in schema.items():
        value = F.try_variant_get(parsed, f"$['{name}']", "variant")
        kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
        fine = kind.isin(*_JSON_TYPES[expected.simpleString()])
        wrong[name] = parsed.isNull() | (value.isNotNull() & ~F.coalesce(fine, F.lit(False)))
    return _violations(df, wrong)


def _violations(df: DataFrame, wrong: Mapping[str, Column]) -> DataFrame:
    counts = {n: F.count_if(c) for n, c in wrong.items()}
    total = F.lit(0).cast("bigint")
    for count in counts.values():
        total = total + count
    return df.agg(*[c.alias(f"{n}_violations") for n, c in counts.items()], total.alias("violations"))


def enforced(events: DataFrame) -> DataFrame:
    """Add ``amount_num``, ``amount_dec``, ``version_num`` and ``type_ok``."""
    text = {"event_id", "event_time", "customer_id"}
    types = {f.name: f.dataType for f in events.schema.fields}
    strings_ok = F.lit(all(isinstance(types.get(n), T.StringType) for n in text))
    amount = F.col("amount").cast("string") if "amount" in types else F.lit(None).cast("string")
    version = F.col("version").cast("string") if "version" in types else F.lit(None).cast("string")
    out = events.withColumns(
        {
            "amount_num": parsing.to_double(amount),
            "amount_dec": parsing.to_decimal(amount),
            "version_num": parsing.to_int(version),
        }
    )
    return out.withColumn(
        "type_ok", strings_ok & F.col("amount_num").isNotNull() & F.col("version_num").isNotNull()
    )


# --- The annotated projection -----------------------------------------------


def annotate(events: DataFrame, as_of: str) -> DataFrame:
    """Everything the stages need to know about a row, in one projection.

    ``outcome`` names the first check that rejects the row, in stage order, or
    ``stored``; an amount of 1e20 or more has no exact tax. ``stale`` and ``checksum_ok`` are facts, not rejections.
    """
    frame = events
    for name in missing_fields(events):
        frame = frame.withColumn(name, F.lit(None).cast("string"))
    schema_ok, nulls_ok = all_present(events), no_nulls(events)
    typed = enforced(frame).withColumn("event_ts", parsing.to_event_ts(F.col("event_time")))
    age = F.timestamp_diff("SECOND", F.col("event_ts"), F.lit(as_of).cast("timestamp_ntz"))
    total_tax = scalars.tax(F.col("amount_dec"))
    canonical = parsing.canonical_amount(F.col("amount").cast("string"))
    expected = digests.event_checksum(F.col("event_id"), F.col("customer_id"), canonical, F.col("event_time"))
    outcome = (
        F.when(~schema_ok, INVALID_SCHEMA)
        .when(~nulls_ok, NULLS)
        .when(F.col("event_ts").isNull(), MALFORMED)
        .when(~F.col("type_ok"), TYPE_MISMATCHES)
        .when(F.col("total_tax").isNull(), TRANSFORMATION_FAILURES)
        .otherwise(STORED)
    )
    return typed.withColumns(
        {
            "total_tax": total_tax,
            "stale": F.coalesce(schema_ok & nulls_ok & (age > FRESHNESS_SECONDS), F.lit(False)),
            "checksum_ok": F.coalesce(F.col("checksum") == expected, F.lit(False)),
        }
    ).withColumn("outcome", outcome)


def facts(annotated: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What stage metrics and findings need of annotated rows, and nothing wider.

    ``payload_word`` is the row's share of the content fingerprint.
    """
    return annotated.select(
        *by,
        "event_id",
        "seq",
        "event_time",
        "outcome",
        "stale",
        "checksum_ok",
        "faults",
        payload_word().alias("payload_word"),
    )


def payload_word() -> Column:
    """32-bit digest of the fields a checksum covers."""
    return digests.word32(digests.row_digest(["event_id", "customer_id", "amount", "event_time"]))


def curated(annotated: DataFrame) -> DataFrame:
    """The stored columns of the rows that pass."""
    return annotated.filter(F.col("outcome") == STORED).select(
        "event_id",
        "event_time",
        "customer_id",
        "source_system",
        F.col("amount_num").alias("amount"),
        "status",
        F.col("version_num").alias("version"),
        "checksum",
        "total_tax",
    )


def lenient(events: DataFrame, *extra: str) -> DataFrame:
    """The minimal flow's transform: whatever is not a number counts as 0.0 and is stored.

    The tax is null for an amount of 1e20 or more. ``extra`` columns are carried along in front.
    """
    typed = enforced(events)
    amount = F.coalesce(F.col("amount_num"), F.lit(0.0))
    total_tax = F.when(F.col("amount_num").isNull(), F.lit(0.0)).otherwise(scalars.tax(F.col("amount_dec")))
    version = F.when(F.col("version").isNull(), F.lit(1)).otherwise(F.col("version_num"))
    return typed.select(
        *extra,
        "event_id",
        "event_time",
        "customer_id",
        "source_system",
        amount.alias("amount"),
        "status",
        version.alias("version"),
        "checksum",
        total_tax.alias("total_tax"),
    )

"""Text-to-value rules shared by every check.

Spark, Python and DuckDB disagree on which texts are numbers (``'1.5d'``, ``'1_000'``,
``'1.0'`` as an integer). A pattern decides first; the cast then cannot be surprised.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOAT_TEXT = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
CENTS_TEXT = r"^\s*[+-]?(\d+(\.\d{0,2}0*)?|\.\d{1,2}0*)\s*$"
INT_TEXT = r"^\s*[+-]?\d+\s*$"
ISO_TEXT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?)?$"

_TYPE_TEXT = {
    "double": FLOAT_TEXT,
    "float": FLOAT_TEXT,
    "int": INT_TEXT,
    "bigint": INT_TEXT,
}


def _guarded(col: Column, pattern: str, target: str) -> Column:
    return F.when(col.rlike(pattern), F.trim(col).try_cast(target))


def to_double(col: Column) -> Column:
    return _guarded(col, FLOAT_TEXT, "double")


def to_decimal(col: Column) -> Column:
    """Exact to ten decimals; null from 1e20 on."""
    return _guarded(col, FLOAT_TEXT, "decimal(30,10)")


def canonical_amount(text: Column) -> Column:
    """The text a checksum covers: two decimals where no digit is lost by that, else the text as received."""
    short = F.when(text.rlike(CENTS_TEXT), F.trim(text).try_cast("decimal(38,2)").cast("string"))
    return F.coalesce(short, text)


def to_int(col: Column) -> Column:
    return _guarded(col, INT_TEXT, "int")


def to_event_ts(col: Column) -> Column:
    """ISO-8601 text to a zone-less timestamp; anything else gives null."""
    return F.when(col.rlike(ISO_TEXT), col.try_cast("timestamp_ntz"))


def has_type(col: Column, actual: T.DataType, expected: T.DataType, strict: bool = False) -> Column:
    """True where a value of column type ``actual`` is acceptable as ``expected``.

    Typed columns are decided when the plan is built; text columns row by row, unless ``strict``: then text is not a
    number, whatever it reads. Null is never acceptable.
    """
    if isinstance(expected, T.StringType):
        return col.isNotNull() & F.lit(isinstance(actual, T.StringType))
    if isinstance(actual, T.StringType) and not strict:
        pattern = _TYPE_TEXT.get(expected.simpleString())
        if pattern is None:
            return F.coalesce(col.try_cast(expected).isNotNull(), F.lit(False))
        return F.coalesce(col.rlike(pattern) & F.trim(col).try_cast(expected).isNotNull(), F.lit(False))
    same_kind = (
        (isinstance(expected, T.IntegralType) and isinstance(actual, (T.IntegralType, T.BooleanType)))
        or (isinstance(expected, T.FractionalType) and isinstance(actual, T.FractionalType))
        or actual == expected
    )
    return col.isNotNull() & F.lit(same_kind)

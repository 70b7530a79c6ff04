"""Small expressions used by several reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def tax(amount: Column) -> Column:
    """Ten percent of a decimal amount, rounded once, half-up on two decimals."""
    return F.round(amount * F.lit(0.10).cast("decimal(3,2)"), 2).cast("double")


def padded(prefix: str, number: Column, width: int) -> Column:
    """``prefix`` and the number with leading zeros; longer numbers are kept whole."""
    text = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0")))


def finite_or_null(col: Column) -> Column:
    return F.when(F.isnan(col) | (F.abs(col) == F.lit(float("inf"))), None).otherwise(col)


def sanitize(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating-point column, nested ones included."""
    return df.select([_sanitize(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _sanitize(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return finite_or_null(col)
    if isinstance(dtype, T.ArrayType) and _holds_floats(dtype.elementType):
        return F.transform(col, lambda item: _sanitize(item, dtype.elementType))
    if isinstance(dtype, T.StructType) and _holds_floats(dtype):
        fields = [_sanitize(col.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    return col


def _holds_floats(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _holds_floats(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_holds_floats(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def ratio_or(numerator: Column, denominator: Column, default: float) -> Column:
    """Quotient, or the given convention where there is nothing to divide by."""
    return F.when(denominator == 0, F.lit(default)).otherwise(
        F.try_divide(numerator.cast("double"), denominator.cast("double"))
    )


def stable_avg(col: Column) -> Column:
    """Average that does not depend on the order rows are added in."""
    return F.try_divide(F.sum(col.cast("decimal(30,12)")).cast("double"), F.count(col).cast("double"))


def percent_text(share: Column) -> Column:
    """``0.195`` as ``19.5%``; the value is rounded half-up on its decimal text first."""
    return F.concat(F.round(share.cast("decimal(20,10)") * 100, 1).cast("decimal(20,1)").cast("string"), F.lit("%"))

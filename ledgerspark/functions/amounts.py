"""Amount expressions.  A missing amount is null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerspark import constants as K


def number(column: str = "amount") -> Column:
    """The column as a double; text that is no decimal number, and NaN, become null.

    A cast alone would also take literals of the JVM, such as ``1d`` or ``0x1p3``.  For a column that is no text the
    guard folds away when the query is planned.
    """
    value = F.col(column)
    plain = (F.typeof(value) != "string") | value.cast("string").rlike(K.DECIMAL_NUMBER)
    return F.nanvl(F.when(plain, value.try_cast("double")), F.lit(None).cast("double"))


def rounded(value: Column, digits: int) -> Column:
    """Round halves to even on the scaled binary value, as numeric array libraries do."""
    scale = 10.0**digits
    return F.rint(value * scale) / scale


def is_round(amount: Column) -> Column:
    return F.coalesce(F.pmod(amount, F.lit(1.0)) == 0, F.lit(True)).cast("int")


def decimal_digits(amount: Column) -> Column:
    """Digits left after rounding to ten places and dropping trailing zeros.

    Only the fraction is looked at: it is exact in binary, so large amounts round like small ones.  Fractions
    near a rounding boundary of the tenth place are formatted as text; all others take integer arithmetic.
    """
    size = F.abs(amount)
    fraction = size - F.floor(size).cast("double")
    scaled = fraction * F.lit(1e10)
    units = F.rint(scaled).cast("long")
    counted = F.when(units % F.lit(10**10) == 0, 0)
    for digits in range(1, 10):
        counted = counted.when(units % F.lit(10 ** (10 - digits)) == 0, digits)
    text = F.format_string("%.10f", fraction)
    printed = F.length(F.regexp_extract(text, r"\.(\d*?)0*$", 1))
    clear = F.abs(scaled - F.rint(scaled)) < 0.4
    return F.when(amount.isNull(), 0).when(clear, counted.otherwise(10)).otherwise(printed)


def log_amount(amount: Column) -> Column:
    return F.when(amount.isNotNull(), F.log1p(F.greatest(amount, F.lit(0.0))))


def amount_bins(amount: Column) -> Column:
    return (
        F.when(amount.isNull(), "unknown").when(amount <= 25, "small").when(amount <= 100, "medium").otherwise("large")
    )


def pair_amount(amount: Column) -> Column:
    """The amount as used to recognise repeats of the same charge."""
    return rounded(amount, 8)


def amount_columns(amount: Column) -> dict[str, Column]:
    return {
        "is_round_amount": is_round(amount),
        "decimal_digits": decimal_digits(amount),
        "log_amount": log_amount(amount),
        "amount_bins": amount_bins(amount),
    }


def extended_columns(amount: Column) -> dict[str, Column]:
    return {
        "amount_roundness": F.coalesce(F.abs(F.pmod(amount, F.lit(1.0))), F.lit(0.0)),
        "is_common_subscription_amount": F.coalesce(amount.isin(K.SUBSCRIPTION_AMOUNTS), F.lit(False)).cast("int"),
        "is_high_value": F.coalesce(amount >= 100, F.lit(False)).cast("int"),
        "is_low_value": F.coalesce(amount < 10, F.lit(False)).cast("int"),
    }

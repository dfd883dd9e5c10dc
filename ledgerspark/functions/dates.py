"""Date and time expressions.  Dates are timestamps without time zone; null means missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DateType, StringType, TimestampNTZType

from ledgerspark import constants as K


#: A date, then a time of day with or without seconds and half of the day.
DATE_AND_TIME = r"^\s*(.*?\S)[ T]+(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?))?\s*([AaPp])?\.?(?:[Mm]\.?)?\s*$"


def _date_of(text: Column) -> Column:
    """Text without a time as a date, by the fixed formats in order, then by those with month names."""
    named = F.initcap(F.lower(F.trim(text)))
    fixed = [F.try_to_date(text, f) for f in K.DATE_FORMATS if f != "mixed"]
    return F.coalesce(*fixed, *[F.try_to_date(named, f) for f in K.MIXED_DATE_FORMATS])


def _date_and_time(text: Column) -> Column:
    def part(i: int) -> Column:
        return F.regexp_extract(text, DATE_AND_TIME, i)

    hour, half = part(2).try_cast("int"), F.lower(part(5))
    hour = F.when((half == "p") & (hour < 12), hour + 12).when((half == "a") & (hour == 12), 0).otherwise(hour)
    minute, second = part(3).try_cast("int"), F.coalesce(part(4).try_cast("decimal(8,6)"), F.lit(0).cast("decimal(8,6)"))
    valid = (hour < 24) & (minute < 60) & (second < 60)
    return F.when(valid, _date_of(part(1)).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, minute, second))


def parse_with(column: Column, fmt: str) -> Column:
    """Parse text with one format of ``DATE_FORMATS``; null where it does not fit.

    ``mixed`` takes ISO timestamps, the fixed formats in order and dates with month names, each with or without a
    time of day, which is kept.
    """
    if fmt == "mixed":
        return F.coalesce(column.try_cast("timestamp_ntz"), _date_of(column).cast("timestamp_ntz"), _date_and_time(column))
    return F.try_to_date(column, fmt).cast("timestamp_ntz")


def timestamp(df: DataFrame, column: str = "date") -> Column:
    """The date column as a timestamp; unparseable text becomes null."""
    kind = df.schema[column].dataType
    if isinstance(kind, TimestampNTZType):
        return F.col(column)
    if isinstance(kind, StringType):
        return parse_with(F.col(column), "mixed")
    if isinstance(kind, DateType):
        return F.col(column).cast("timestamp_ntz")
    return F.col(column).try_cast("timestamp_ntz")


def month_key(date: Column) -> Column:
    return (F.year(date) * 12 + F.month(date)).cast("int")


def month_period(date: Column) -> Column:
    day = F.dayofmonth(date)
    return F.when(day.isNull(), "unknown").when(day <= 10, "start").when(day <= 20, "mid").otherwise("end")


def calendar_columns(date: Column) -> dict[str, Column]:
    zero = F.lit(0)
    return {
        "day_of_year": F.coalesce(F.dayofyear(date), zero),
        "week_of_year": F.coalesce(F.weekofyear(date), zero),
        "month_period": month_period(date),
        "days_to_weekend": F.when(date.isNull(), zero).otherwise(F.greatest(zero, F.lit(5) - F.weekday(date))),
        "is_weekend": F.coalesce(F.weekday(date) >= 5, F.lit(False)).cast("int"),
        "month": F.coalesce(F.month(date), zero),
        "quarter": F.coalesce(F.quarter(date), zero),
        "day_of_month": F.coalesce(F.dayofmonth(date), zero),
    }


def time_columns(date: Column, has_time: bool) -> dict[str, Column]:
    """Time-of-day flags, or fixed midday defaults when no row of the table carries a time."""
    if not has_time:
        return {
            "hour": F.lit(12),
            "is_lunch_hour": F.lit(0),
            "is_dinner_hour": F.lit(0),
            "is_business_hours": F.lit(1),
        }
    hour = F.hour(date)

    def within(low: int, high: int) -> Column:
        return F.coalesce(hour.between(low, high), F.lit(False)).cast("int")

    return {
        "hour": F.coalesce(hour, F.lit(0)),
        "is_lunch_hour": within(11, 14),
        "is_dinner_hour": within(18, 21),
        "is_business_hours": within(9, 17),
    }


def any_time_of_day(df: DataFrame, date: Column) -> bool:
    midnight = F.to_date(date).cast("timestamp_ntz")
    return bool(df.agg(F.bool_or(date != midnight)).first()[0])


def weekday_name(date: Column) -> Column:
    return F.get(F.array(*[F.lit(d) for d in K.WEEKDAYS]), F.weekday(date))


def with_day_of_week(df: DataFrame) -> DataFrame:
    """Add the ``day_of_week`` input column where a file lacks it."""
    return df.withColumn("day_of_week", weekday_name(timestamp(df)))

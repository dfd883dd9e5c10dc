"""Profiles of a loaded table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerspark.functions import amounts, dates
from ledgerspark.operators.quantiles import scalar_quantiles


def profile_amount(df: DataFrame) -> DataFrame:
    """Mean, exact median, sample deviation, range and bias-corrected skew of the amount."""
    value = amounts.number()
    median = scalar_quantiles(df, value, {"median": 0.5})["median"]
    n = F.count("v")
    adjusted = F.when(n > 2, F.skewness("v") * F.sqrt(n * (n - 1.0)) / (n - 2.0))
    return df.select(value.alias("v")).agg(
        F.avg("v").alias("mean"),
        F.lit(median).cast("double").alias("median"),
        F.when(n > 1, F.stddev_samp("v")).alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        adjusted.alias("skewness"),
    )


def profile_date_range(df: DataFrame) -> DataFrame:
    """First and last date and the whole days between them."""
    bounds = df.select(dates.timestamp(df).alias("d")).agg(F.min("d").alias("start"), F.max("d").alias("end"))
    return bounds.withColumn("days_span", F.extract(F.lit("DAY"), F.col("end") - F.col("start")))


def describe_amount(df: DataFrame) -> DataFrame:
    """count, mean, std, min, quartiles and max of the amount, rounded to cents, as one row."""
    value = amounts.number()
    marks = scalar_quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    stats = df.select(value.alias("v")).agg(
        F.count("v").alias("n"),
        amounts.rounded(F.avg("v"), 2).alias("mean"),
        amounts.rounded(F.when(F.count("v") > 1, F.stddev_samp("v")), 2).alias("std"),
        amounts.rounded(F.min("v"), 2).alias("min"),
        amounts.rounded(F.max("v"), 2).alias("max"),
    )
    return stats.withColumns({k: amounts.rounded(F.lit(v).cast("double"), 2) for k, v in marks.items()})



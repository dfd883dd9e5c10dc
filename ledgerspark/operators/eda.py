"""Tables of the exploratory report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ledgerspark import constants as K
from ledgerspark.functions import amounts, dates, text
from ledgerspark.operators.quantiles import quantiles, scalar_quantiles
from ledgerspark.storage import lookup, materialize


def top_words(df: DataFrame, n: int = 50, column: str = "description") -> DataFrame:
    """The ``n`` most frequent tokens without stop words; ties by token."""
    words = df.select(F.explode(text.tokens(text.description(column))).alias("term"))
    counts = words.where(~F.col("term").isin(K.STOP_WORDS)).groupBy("term").agg(F.count(F.lit(1)).alias("n_uses"))
    return counts.orderBy(F.desc("n_uses"), "term").limit(n)


def description_length_by_category(df: DataFrame, target: str = K.TARGET) -> DataFrame:
    return (
        df.where(F.col(target).isNotNull())
        .groupBy(target)
        .agg(amounts.rounded(F.avg(F.length(text.description())), 2).alias("mean_length"))
    )


def description_length(df: DataFrame) -> DataFrame:
    """Mean and exact median length of all descriptions, as one row."""
    length = F.length(text.description()).cast("double")
    median = scalar_quantiles(df, length, {"median": 0.5})["median"]
    return df.agg(F.avg(length).alias("mean_length")).withColumn("median_length", F.lit(median).cast("double"))


def amount_by_category(df: DataFrame, target: str = K.TARGET) -> DataFrame:
    value = amounts.number()
    labelled = df.where(F.col(target).isNotNull())
    stats = labelled.select(target, value.alias("v")).groupBy(target).agg(
        F.count("v").alias("n"),
        amounts.rounded(F.avg("v"), 2).alias("mean"),
        amounts.rounded(F.when(F.count("v") > 1, F.stddev_samp("v")), 2).alias("std"),
        amounts.rounded(F.min("v"), 2).alias("min"),
        amounts.rounded(F.max("v"), 2).alias("max"),
    )
    medians = quantiles(labelled, value, {"median": 0.5}, {target: F.col(target)})
    return stats.join(medians.select(target, amounts.rounded(F.col("median"), 2).alias("median")), target, "left")


def iqr_outliers(df: DataFrame) -> DataFrame:
    """Quartiles, bounds at 1.5 times their distance, and the rows outside; a missing amount is inside."""
    value = amounts.number()
    marks = scalar_quantiles(df, value, {"q1": 0.25, "q3": 0.75})
    q1, q3 = (F.lit(marks[k]).cast("double") for k in ("q1", "q3"))
    lower, upper = q1 - F.lit(1.5) * (q3 - q1), q3 + F.lit(1.5) * (q3 - q1)
    outside = F.coalesce((value < lower) | (value > upper), F.lit(False))
    return df.agg(
        F.count_if(outside).alias("outlier_count"),
        (F.avg(outside.cast("double")) * 100).alias("outlier_percentage"),
    ).withColumns({"q1": q1, "q3": q3, "iqr": q3 - q1, "lower_bound": lower, "upper_bound": upper})


def _by_period(df: DataFrame, label: Column) -> DataFrame:
    periods = df.select(label.alias("period")).where("period is not null")
    return periods.groupBy("period").agg(F.count(F.lit(1)).alias("n_rows")).orderBy("period")


def by_month(df: DataFrame) -> DataFrame:
    date = dates.timestamp(df)
    return _by_period(df, F.when(date.isNotNull(), F.format_string("%04d-%02d", F.year(date), F.month(date))))


def by_quarter(df: DataFrame) -> DataFrame:
    date = dates.timestamp(df)
    return _by_period(df, F.concat(F.year(date), F.lit("Q"), F.quarter(date)))


def by_weekday(df: DataFrame) -> DataFrame:
    """Counts of the seven weekday names of the input column, zero where absent, Monday first."""
    days = [F.struct(F.lit(i).alias("position"), F.lit(d).alias("day_of_week")) for i, d in enumerate(K.WEEKDAYS)]
    week = df.sparkSession.range(1).select(F.inline(F.array(*days)))
    counts = df.where(F.col("day_of_week").isin(K.WEEKDAYS)).groupBy("day_of_week").agg(F.count(F.lit(1)).alias("n"))
    return (
        week.join(counts, "day_of_week", "left")
        .select("position", "day_of_week", F.coalesce("n", F.lit(0)).alias("n_rows"))
        .orderBy("position")
    )


def candidate_features(df: DataFrame) -> DataFrame:
    """The ten candidate columns with missing values kept."""
    amount, date = amounts.number(), dates.timestamp(df)
    columns = {
        **text.text_stats(text.description()),
        "month": F.month(date),
        "quarter": F.quarter(date),
        "is_weekend": F.coalesce(F.weekday(date) >= 5, F.lit(False)).cast("int"),
        "day_of_month": F.dayofmonth(date),
        "log_amount": F.when(amount == -1, F.lit(float("-inf"))).otherwise(F.log1p(amount)),
        "amount_bins": F.when(amount <= 25, "small").when(amount <= 100, "medium").when(amount > 100, "large"),
    }
    return df.select(K.ID, *[columns[c].alias(c) for c in K.CANDIDATE_COLUMNS])


def sequential_id(df: DataFrame, column: str = K.ID) -> DataFrame:
    """Whether the ids are present, distinct and without holes.

    Being distinct is checked by counting repeated ids, not by collecting a distinct set.
    """
    totals = df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(column).alias("n_ids"), (F.max(column) - F.min(column) + 1).alias("width")
    ).first()
    full = totals["n_rows"] == totals["n_ids"] == (totals["width"] or 0)
    repeated = not full or df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() > 0
    return df.sparkSession.range(1).select(
        F.lit(totals["n_rows"]).alias("n_rows"),
        F.lit(int(full and not repeated)).alias("is_sequential"),
    )


def histogram(df: DataFrame, bins: int = 40) -> DataFrame:
    """Equal-width bins of the amount between its extremes, empty bins included."""
    value = amounts.number()
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n_rows bigint")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    at = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = df.select(at.alias("bin"), value.alias("v")).where("v is not null").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * F.lit(width)).alias("lower"),
        (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("n_rows"),
    )


def box_stats(df: DataFrame, target: str = K.TARGET) -> DataFrame:
    """Quartiles, whiskers (extreme values that are no outliers) and outlier count of the amount per class."""
    value = amounts.number()
    labelled = df.where(F.col(target).isNotNull()).select(target, value.alias("amount"))
    marks = quantiles(labelled, F.col("amount"), {"q1": 0.25, "median": 0.5, "q3": 0.75}, {target: F.col(target)})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("amount").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        lookup(labelled.where("amount is not null"), materialize(marks, "box"), [target], ["q1", "median", "q3"])
        .groupBy(target, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("amount"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("amount"))).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )

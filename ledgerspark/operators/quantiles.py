"""Exact order statistics of a column that may have any number of distinct values.

Equal values are merged first, so a popular value is one row.  Running totals over the merged values come
from range offsets, never from one task or one in-memory value map.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerspark.operators.ordering import RANGE, ROWS_PER_RANGE, range_offsets, with_ranges
from ledgerspark.storage import Sized, lookup, materialize, sized


def value_counts(df: DataFrame, value: Column, by: dict[str, Column] | None = None) -> DataFrame:
    """Written table of ``(by…, value, n)`` without null values."""
    by = by or {}
    columns = df.select(*[c.alias(k) for k, c in by.items()], value.alias("value"))
    return materialize(
        columns.where(F.col("value").isNotNull()).groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n")), "values"
    )


def running_counts(counts: DataFrame, by: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add ``below`` (rows with a smaller value) and ``total`` (rows) within each group."""
    ranged, n = with_ranges(counts, "value", counts.count(), rows_per_range)
    within = Window.partitionBy(RANGE, *by)
    before = within.orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
    if n == 1:
        placed = placed.withColumn("total", F.sum("n").over(within))
    else:
        placed = lookup(placed, range_offsets(ranged, by, F.col("n")), [*by, RANGE], ["__before", "__total"])
        placed = placed.withColumn("below", F.col("below") + F.col("__before")).withColumnRenamed("__total", "total")
    return placed.select(*by, "value", "n", "below", "total")


def quantiles(
    df: DataFrame,
    value: Column,
    shares: dict[str, float],
    by: dict[str, Column] | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """One row per group with linearly interpolated quantiles, named as the keys of ``shares``."""
    by = by or {}
    placed = running_counts(value_counts(df, value, by), list(by), rows_per_range)
    aggs, names = [], []
    for name, share in shares.items():
        position = F.lit(share) * (F.col("total") - 1)
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            here = (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
            aggs.append(F.max(F.when(here, F.col("value"))).alias(f"__{name}_{side}"))
        aggs.append(F.max(position - F.floor(position)).alias(f"__{name}_part"))
        low, high = F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        names.append((low + (high - low) * F.col(f"__{name}_part")).alias(name))
    return placed.groupBy(*by).agg(*aggs).select(*by, *names)


def scalar_quantiles(df: DataFrame, value: Column, shares: dict[str, float]) -> dict[str, float | None]:
    """Quantiles of the whole column as numbers; None when it holds no value."""
    row = quantiles(df, value, shares).first()
    return {name: (None if row is None or row[name] is None or math.isnan(row[name]) else row[name]) for name in shares}


def average_rank_shares(
    df: DataFrame, value: Column, group: Column, out: str, rows_per_range: int = ROWS_PER_RANGE
) -> Sized:
    """Per group and value: the average-tie rank divided by the group's non-null values, as ``out``.

    Neither ``percent_rank`` nor ``cume_dist``; a null group is a group.
    """
    placed = running_counts(value_counts(df, value, {"__group": group}), ["__group"], rows_per_range)
    share = (F.col("below") + (F.col("n") + 1) / 2) / F.col("total")
    table = placed.select("__group", F.col("value").alias("__value"), "n", share.alias(out))
    return sized(materialize(table, "shares"), "n")


def with_rank_share(df: DataFrame, shares: Sized, value: Column, group: Column, out: str, id_column: str) -> DataFrame:
    """Look the shares up; a null value gets null."""
    keyed = df.withColumns({"__group": group, "__value": value})
    found = lookup(keyed, shares, ["__group", "__value"], [out], spread_by=id_column, weight="n")
    return found.drop("__group", "__value")

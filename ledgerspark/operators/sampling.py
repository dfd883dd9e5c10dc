"""Seeded samples without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerspark import constants as K
from ledgerspark.operators.ordering import RANGE, range_offsets, with_ranges
from ledgerspark.storage import lookup


def hashed_order(seed: int = K.SEED) -> Column:
    return F.xxhash64(F.col(K.ID), F.lit(seed))


def first_in_order(df: DataFrame, order: Column, by: list[str], quota: Column) -> DataFrame:
    """The first ``quota`` rows of each group in ``order`` (ties by id).

    ``quota`` may use ``__total``, the rows of the group.  Ranges of the order that lie wholly beyond a
    group's quota are dropped before anything is shuffled.
    """
    keyed = df.withColumn("__order", order)
    ranged, _ = with_ranges(keyed, "__order", df.count())
    table = range_offsets(ranged, by).withColumn("__quota", quota).where("__before < __quota")
    placed = lookup(ranged, table, [*by, RANGE], ["__before", "__quota"]).where("__quota is not null")
    within = Window.partitionBy(RANGE, *by).orderBy("__order", K.ID)
    numbered = placed.withColumn("__at", F.row_number().over(within) + F.col("__before"))
    return numbered.where("__at <= __quota").select(df.columns)


def sample_random(df: DataFrame, n: int, order: Column | None = None) -> DataFrame:
    return first_in_order(df, hashed_order() if order is None else order, [], F.lit(n))


def sample_stratified(df: DataFrame, n: int, by: str = K.TARGET, order: Column | None = None) -> DataFrame:
    """Proportional sample with at least one row per label, at most ``n`` rows in all."""
    order = hashed_order() if order is None else order
    labelled = df.where(F.col(by).isNotNull())
    rows = df.count()
    size = min(n, rows)
    share = F.greatest(F.lit(1), F.floor(F.col("__total") * F.lit(size) / F.lit(max(rows, 1))))
    sample = first_in_order(labelled, order, [by], share)
    if sample.count() <= n:
        return sample
    return sample_random(sample, n, order)

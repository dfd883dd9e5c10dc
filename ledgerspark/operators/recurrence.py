"""Merchant frequency and repeated-charge flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerspark import constants as K
from ledgerspark.functions import amounts
from ledgerspark.functions.merchants import with_merchant
from ledgerspark.storage import Sized, lookup, materialize, sized


def merchant_rollup(df: DataFrame) -> DataFrame:
    """Rows, amount and first/last date per merchant."""
    return (
        with_merchant(df)
        .select("store_name", amounts.number().alias("amount"), "date")
        .groupBy("store_name")
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum("amount").alias("total_amount"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        )
    )


def with_store_frequency(df: DataFrame) -> DataFrame:
    """Add how many rows (with an id) the merchant has."""
    rows = with_merchant(df)
    table = materialize(
        rows.groupBy("store_name").agg(F.count(K.ID).alias("store_frequency"), F.count(F.lit(1)).alias("n")), "stores"
    )
    return lookup(rows, table, ["store_name"], ["store_frequency"], spread_by=K.ID, weight="n")


def with_recurring(df: DataFrame) -> DataFrame:
    """Add 1 where the same merchant charged the same amount more than once; missing amounts are equal."""
    rows = with_merchant(df)
    pair = amounts.pair_amount(amounts.number()).alias("__pair_amount")
    pairs = rows.select("store_name", pair).groupBy("store_name", "__pair_amount").agg(F.count(F.lit(1)).alias("n"))
    return join_recurring(rows, repeated_pairs(pairs))


def repeated_pairs(pairs: DataFrame) -> Sized:
    """Only the pairs that repeat, out of ``(store_name, __pair_amount, n)``."""
    return sized(materialize(pairs.where("n > 1").withColumn("is_recurring", F.lit(1)), "pairs"), "n")


def join_recurring(rows: DataFrame, repeated: Sized) -> DataFrame:
    keyed = rows.withColumn("__pair_amount", amounts.pair_amount(amounts.number()))
    joined = lookup(keyed, repeated, ["store_name", "__pair_amount"], ["is_recurring"], spread_by=K.ID, weight="n")
    return joined.withColumn("is_recurring", F.coalesce("is_recurring", F.lit(0))).drop("__pair_amount")

"""Merchant extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerspark import constants as K
from ledgerspark.functions import text


def with_merchant(df: DataFrame, out: str = "store_name") -> DataFrame:
    """Add the merchant name found in ``description``.

    A processor or marketplace prefix wins over a known brand, which wins over the first token.
    Matches are computed once in their own projections and then shared.
    """
    if out in df.columns:
        return df
    matches = df.withColumn("__text", text.strip(F.upper(text.description()))).withColumns(
        {
            "__prefix": F.regexp_extract("__text", K.MERCHANT_PREFIX, 1),
            "__first": F.regexp_extract("__text", K.MERCHANT_FIRST_TOKEN, 0),
        }
    )
    named = matches.withColumn(
        "__named",
        F.when(F.col("__prefix") != "", F.col("__prefix")).otherwise(
            F.regexp_extract("__text", K.MERCHANT_BRAND, 0)
        ),
    )
    tidy = F.trim(F.regexp_replace("__named", rf"[{K.SPACE}]+", " "), F.lit(K.MERCHANT_TRIM_CHARS))
    store = F.when(F.col("__named") != "", tidy).otherwise(F.col("__first"))
    return (
        named.withColumn("__store", F.left(store, F.lit(K.MERCHANT_MAX_LENGTH)))
        .withColumn(out, F.when(F.col("__store") != "", F.col("__store")).otherwise(F.lit(K.UNKNOWN_MERCHANT)))
        .drop("__text", "__prefix", "__first", "__named", "__store")
    )

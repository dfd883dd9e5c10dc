"""Expanding time folds over rows in id order.

A fold is a range of ids, so it takes only the ids at five positions of the order to assign every row:
the rows themselves are neither sorted nor shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ledgerspark import constants as K
from ledgerspark.operators.ordering import ROWS_PER_RANGE, values_at_ranks


def fold_cuts(
    df: DataFrame, n_folds: int = K.N_FOLDS, key: str = K.ID, rows_per_range: int = ROWS_PER_RANGE
) -> list[int]:
    """The first id of each validation fold.  Fold k trains on all ids before its cut."""
    rows = df.count()
    size = rows // (n_folds + 1)
    if size == 0:
        raise ValueError(f"{n_folds} folds need at least {n_folds + 1} rows, got {rows}")
    ranks = [rows - (n_folds - k) * size for k in range(n_folds)]
    found = values_at_ranks(df, key, ranks, rows, rows_per_range)
    return [found[r] for r in ranks]


def fold_of(cuts: list[int], key: str = K.ID) -> Column:
    """1-based validation fold; null for the first rows, which are only ever trained on."""
    passed = reduce(lambda a, b: a + b, [(F.col(key) >= c).cast("int") for c in cuts])
    return F.when(passed > 0, passed)


def in_fold(cuts: list[int], k: int, key: str = K.ID) -> Column:
    """Rows that fold ``k`` validates, as a range of the key that reaches the scan."""
    lower = F.col(key) >= cuts[k - 1]
    return lower if k == len(cuts) else lower & (F.col(key) < cuts[k])


def validated(df: DataFrame, cuts: list[int], key: str = K.ID) -> DataFrame:
    """All rows that some fold validates, with their ``fold``."""
    return df.where(F.col(key) >= cuts[0]).withColumn("fold", fold_of(cuts, key))


def with_folds(df: DataFrame, n_folds: int = K.N_FOLDS, key: str = K.ID) -> DataFrame:
    return df.withColumn("fold", fold_of(fold_cuts(df, n_folds, key), key))


def fold_sizes(df: DataFrame, cuts: list[int], key: str = K.ID) -> DataFrame:
    """Training and validation rows per fold, in one pass."""
    counted = df.agg(
        *[F.count_if(F.col(key) < c).alias(f"t{i}") for i, c in enumerate(cuts)],
        *[F.count_if(fold_of(cuts, key) == i + 1).alias(f"v{i}") for i in range(len(cuts))],
    )
    entries = [
        F.struct(F.lit(i + 1).alias("fold"), F.col(f"t{i}").alias("train_rows"), F.col(f"v{i}").alias("valid_rows"))
        for i in range(len(cuts))
    ]
    return counted.select(F.inline(F.array(*entries)))

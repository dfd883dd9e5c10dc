"""Global order without a single task: row numbers, previous values, values at given ranks.

Rows are cut into ranges of the numeric order key.  Counts per range are a small table from which each
range's offset follows, so a window only ever runs inside one range.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerspark.storage import lookup, materialize

ROWS_PER_RANGE = 100_000
SMALL_RANGE = 10_000
#: Cut points that the driver holds; from 2e10 rows on, ranges grow instead (10^12 rows: 5 million rows each).
MAX_RANGES = 200_000
CUT_SAMPLE = 200  # sampled keys per range
RANGE = "__range"


def range_count(df: DataFrame, rows: int, rows_per_range: int = ROWS_PER_RANGE) -> int:
    cores = df.sparkSession.sparkContext.defaultParallelism
    spread = min(4 * cores, rows // SMALL_RANGE)
    return max(1, min(MAX_RANGES, max(spread, math.ceil(rows / rows_per_range))))


def with_ranges(
    df: DataFrame, key: str, rows: int, rows_per_range: int = ROWS_PER_RANGE
) -> tuple[DataFrame, int]:
    """Add ``__range``, non-decreasing in ``key``, with roughly equal rows; also return how many there are.

    The cut points only balance the work; results do not depend on them, so a sample of the keys is enough
    to place them.  Keys that repeat share a range.
    """
    n = range_count(df, rows, rows_per_range)
    if n == 1:
        return df.withColumn(RANGE, F.lit(0)), 1
    shares = [i / n for i in range(1, n)]
    keys = df.select(F.col(key).cast("double").alias(key))
    fraction = CUT_SAMPLE * n / rows
    if fraction < 0.5:
        keys = keys.sample(fraction, seed=1)
    cuts = sorted(set(keys.approxQuantile(key, shares, 1 / (4 * n))))
    splits = [-math.inf, *cuts, math.inf]
    bucketizer = Bucketizer(splits=splits, inputCol="__key", outputCol=RANGE, handleInvalid="keep")
    with_key = df.withColumn("__key", F.col(key).cast("double"))
    return bucketizer.transform(with_key).drop("__key").withColumn(RANGE, F.col(RANGE).cast("int")), n


def range_offsets(ranged: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Rows (or summed ``weight``) per group and range, with the total before the range and of the group."""
    counted = ranged.groupBy(*by, RANGE).agg((F.sum(weight) if weight is not None else F.count(F.lit(1))).alias("__n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    table = counted.withColumns(
        {
            "__before": F.coalesce(F.sum("__n").over(before), F.lit(0)),
            "__total": F.sum("__n").over(group),
        }
    )
    return materialize(table, "ranges")


def with_row_number(
    df: DataFrame,
    key: str,
    out: str,
    by: list[str] | None = None,
    tiebreak: list[str] | None = None,
    rows: int | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
    ranges: int | None = None,
) -> DataFrame:
    """Add the 1-based position in ``key`` order, overall or within each group of ``by``.

    ``ranges`` tells that ``df`` already carries that many ranges from ``with_ranges``.
    """
    by = by or []
    ranged, n = (df, ranges) if ranges else with_ranges(df, key, df.count() if rows is None else rows, rows_per_range)
    within = Window.partitionBy(RANGE, *by).orderBy(key, *(tiebreak or []))
    placed = ranged.withColumn(out, F.row_number().over(within))
    if n > 1:
        placed = lookup(placed, range_offsets(ranged, by), [*by, RANGE], ["__before"])
        placed = placed.withColumn(out, F.col(out) + F.col("__before")).drop("__before")
    return placed if ranges else placed.drop(RANGE)


def with_gap(
    df: DataFrame,
    key: str,
    out: str,
    rows: int | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``key`` minus the previous key in order; 0 for the first row."""
    ranged, n = (df, ranges) if ranges else with_ranges(df, key, df.count() if rows is None else rows, rows_per_range)
    placed = ranged.withColumn("__previous", F.lag(key).over(Window.partitionBy(RANGE).orderBy(key)))
    if n > 1:
        ends = ranged.groupBy(RANGE).agg(F.max(key).alias("__last"))
        by_range = Window.partitionBy(F.lit(0)).orderBy(RANGE)
        carry = ends.select(RANGE, F.lag("__last").over(by_range).alias("__carry"))
        placed = lookup(placed, materialize(carry, "carry"), [RANGE], ["__carry"])
        placed = placed.withColumn("__previous", F.coalesce("__previous", "__carry")).drop("__carry")
    placed = placed.withColumn(out, F.coalesce(F.col(key) - F.col("__previous"), F.lit(0))).drop("__previous")
    return placed if ranges else placed.drop(RANGE)


def values_at_ranks(
    df: DataFrame, key: str, ranks: list[int], rows: int | None = None, rows_per_range: int = ROWS_PER_RANGE
) -> dict[int, int]:
    """The keys at 0-based ``ranks`` of the order.  Only ranges that hold a rank are sorted."""
    rows = df.count() if rows is None else rows
    ranged, _ = with_ranges(df.select(key), key, rows, rows_per_range)
    table = range_offsets(ranged, []).orderBy(RANGE).collect()
    wanted = {}
    for rank in ranks:
        for r in table:
            if r["__before"] <= rank < r["__before"] + r["__n"]:
                wanted[rank] = (r[RANGE], rank - r["__before"] + 1)
    spots = set(wanted.values())
    if not spots:
        return {}
    touched = ranged.where(F.col(RANGE).isin(sorted({s[0] for s in spots})))
    numbered = touched.withColumn("__row", F.row_number().over(Window.partitionBy(RANGE).orderBy(key)))
    hit = None
    for bucket, row in sorted(spots):
        term = (F.col(RANGE) == bucket) & (F.col("__row") == row)
        hit = term if hit is None else hit | term
    found = {(r[RANGE], r["__row"]): r[key] for r in numbered.where(hit).collect()}
    return {rank: found[spot] for rank, spot in wanted.items()}


def with_label_rank(df: DataFrame, columns: list[str], out: str = "rank") -> DataFrame:
    """Distinct values of ``columns`` with their 0-based rank in sorted order.

    Works for text of any cardinality: the distinct values are range-sorted and written once with their
    partition and their position in it; offsets per partition turn these into ranks.
    """
    ordered = (
        df.select(*columns)
        .distinct()
        .orderBy(*columns)
        .select(*columns, F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().alias("__at"))
    )
    written = materialize(ordered, "ranks")
    parts = written.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__min"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(
        parts.select("__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__min")).alias("__shift")),
        "ranks",
    )
    ranked = lookup(written, offsets, ["__part"], ["__shift"])
    return ranked.select(*columns, (F.col("__at") + F.col("__shift")).alias(out))

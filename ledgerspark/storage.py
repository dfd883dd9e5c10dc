"""Written intermediate tables and size-checked lookups.

Two things every operator with a "group statistic back onto the rows" shape needs:

* ``materialize`` writes a small-to-medium aggregate once, to the folder that all executors share,
  so that it is not recomputed for every use and survives lost executors.
* ``lookup`` joins such an aggregate back.  It is broadcast only when its counted rows and its bytes are within
  bounds.  Beyond the bound, keys that own a large share of the rows (few, by definition) are broadcast
  and everything else goes through one shuffle join in which no key is hot.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BROADCAST_ROWS_CONF = "spark.ledger.broadcastRows"
BROADCAST_ROWS = 500_000
BROADCAST_BYTES_CONF = "spark.ledger.broadcastBytes"
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_KEYS = 2_000
SALTS = 256

#: Folders of local sessions without ``spark.checkpoint.dir``, by application.
_LOCAL_FOLDERS: dict[str, str] = {}
#: Lists that note the scratch paths being handed out.
_RECORDS: list[list[str]] = []


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_ROWS_CONF, str(BROADCAST_ROWS)))


def fits_broadcast(table: DataFrame, rows: int) -> bool:
    """Whether a written table is small in rows and in bytes on disk."""
    spark = table.sparkSession
    if rows > broadcast_limit(spark):
        return False
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= int(spark.conf.get(BROADCAST_BYTES_CONF, str(BROADCAST_BYTES)))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local one only for a local session without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    # The setting is fixed once a session has started, so the folder is kept here for the application's life.
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[application] = tempfile.mkdtemp(prefix="ledgerspark-")
    return _LOCAL_FOLDERS[application]


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/ledgerspark/{label}-{uuid.uuid4().hex}"
    for made in _RECORDS:
        made.append(path)
    return path


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The scratch paths handed out inside, for ``release`` once nothing reads them any more."""
    made: list[str] = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        _RECORDS[:] = [r for r in _RECORDS if r is not made]


def release(spark: SparkSession, paths: list[str], still_read: DataFrame | None = None) -> None:
    """Delete scratch tables, but for those that the plan of ``still_read`` reads."""
    files = still_read.inputFiles() if still_read is not None else []
    names = {part for f in files for part in f.split("/")}
    for path in paths:
        if path.rsplit("/", 1)[-1] not in names:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(table: DataFrame) -> None:
    """Delete a written table that nothing reads any more."""
    release(table.sparkSession, sorted({f.rsplit("/", 1)[0] for f in table.inputFiles()}))


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs, which it does when the driver's garbage is collected."""
    spark._jvm.System.gc()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(column: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


class Sized(NamedTuple):
    """A written table with its counted rows and the rows of the fact table that its keys stand for."""

    table: DataFrame
    rows: int
    weight: int | None


def sized(table: DataFrame, weight: str | None = None) -> Sized:
    if weight is None:
        return Sized(table, table.count(), None)
    rows, total = table.agg(F.count(F.lit(1)), F.sum(weight)).first()
    return Sized(table, rows, total)


def lookup(
    rows: DataFrame,
    table: DataFrame | Sized,
    keys: list[str],
    values: list[str],
    spread_by: str | None = None,
    weight: str | None = None,
    count_keys: bool = False,
) -> DataFrame:
    """Left join ``values`` of a written ``table`` with unique, possibly null ``keys`` onto ``rows``.

    ``weight`` names the column of ``table`` that says how many rows carry the key; with it and a
    ``spread_by`` column of ``rows``, hot keys are split off when the table is too large to broadcast.
    With ``count_keys`` hot keys are counted on ``rows`` instead, for tables fitted on other rows, where a key may be
    new and frequent.  Without either the caller vouches that no key can be hot.
    """
    known = table if isinstance(table, Sized) else sized(table, weight)
    names = {k: f"__key_{i}" for i, k in enumerate(keys)}
    keep = values + ([weight] if weight and weight not in values else [])
    side = known.table.select(*[F.col(k).alias(n) for k, n in names.items()], *keep)
    columns = rows.columns

    def matches(left: DataFrame, suffix: str = "") -> Column:
        return reduce(and_, [left[k].eqNullSafe(F.col(n + suffix)) for k, n in names.items()])

    if fits_broadcast(known.table, known.rows):
        return rows.join(F.broadcast(side), matches(rows), "left").select(*columns, *values)
    if weight is None or spread_by is None:
        return rows.join(side, matches(rows), "left").select(*columns, *values)

    if count_keys:
        counted = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")), "key-counts")
        total = counted.agg(F.sum("__rows")).first()[0] or 0
        frequent = counted.where(F.col("__rows") * F.lit(HOT_KEYS) > F.lit(total))
        on = reduce(and_, [F.col(n).eqNullSafe(F.col(k)) for k, n in names.items()])
        # Frequent keys without an entry are hot as well; their weight stands for the rows being joined.
        present = side.drop(weight).join(F.broadcast(frequent), on, "left").drop(*keys)
        absent = frequent.join(side.drop(weight), on, "left_anti").select(
            *[F.col(k).alias(n) for k, n in names.items()], *[F.lit(None).cast(side.schema[v].dataType).alias(v) for v in values], "__rows"
        )
        side = present.unionByName(absent).withColumn(weight, F.coalesce("__rows", F.lit(0))).drop("__rows")
        side, known = materialize(side, "keys"), Sized(known.table, known.rows, total)

    # At most HOT_KEYS keys can each own more than 1/HOT_KEYS of all rows.
    is_hot = F.col(weight) * F.lit(HOT_KEYS) > F.lit(known.weight)
    hot = side.where(is_hot).select(
        *names.values(), *[F.col(v).alias(f"__hot_{v}") for v in values], F.lit(True).alias("__hot")
    )
    cold = side.where(~is_hot).select(
        *[F.col(n).alias(f"{n}_cold") for n in names.values()], *values, F.lit(0).alias("__salt_cold")
    )
    tagged = rows.join(F.broadcast(hot), matches(rows), "left").withColumn(
        "__salt", F.when(F.col("__hot"), F.lit(1) + spread(spread_by)).otherwise(F.lit(0))
    )
    joined = tagged.join(cold, (F.col("__salt") == F.col("__salt_cold")) & matches(tagged, "_cold"), "left")
    return joined.select(
        *[tagged[c] for c in columns],
        *[F.when(F.col("__hot"), F.col(f"__hot_{v}")).otherwise(F.col(v)).alias(v) for v in values],
    )

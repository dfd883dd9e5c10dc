"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from ledgerspark.session import bound_batches
from ledgerspark.storage import materialize

#: Words are maximal runs of anything but these six bytes.
SPACE_BYTES = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Rows per Arrow batch: rows hold whole texts, so batches of Spark's default size are too large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def slices(batch: pa.RecordBatch, column: int, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about ``limit`` bytes; one longer text stands alone."""
    texts = batch.column(column)
    start = size = 0
    for i, length in enumerate(pa.compute.binary_length(texts).to_pylist()):
        if i > start and size + (length or 0) > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += length or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast(StringType()), F.lit(""))


__all__ = ["SPACE_BYTES", "arrow_rows", "bound_batches", "materialize", "partitions", "slices", "table", "text_or_empty"]

"""Transaction files: CSV (plain and compressed), Parquet, and the choice of text encoding.

CSV columns are read as text; missing-value texts become null and types are applied afterwards without
ever failing on a bad value.
"""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerspark import constants as K
from ledgerspark.functions import amounts
from ledgerspark.storage import materialize

CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "enforceSchema": False}
ARCHIVE_SUFFIXES = (".zip", ".xz")
COMPRESSED_SUFFIXES = (".gz", ".bz2", *ARCHIVE_SUFFIXES)
CHUNK_ROWS = 50_000
#: Files from this size on are streamed by path instead of being one value of a row.
STREAM_BYTES = 512 * 1024 * 1024


def missing_to_null(df: DataFrame) -> DataFrame:
    """Turn the usual missing-value texts of CSV files into null."""
    absent = [F.lit(t) for t in K.NA_TEXTS]
    columns = {
        f.name: F.when(~F.col(f.name).isin(absent), F.col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, StringType)
    }
    return df.withColumns(columns) if columns else df


def typed(df: DataFrame) -> DataFrame:
    """Id as bigint and amount as double where present; a value that does not fit becomes null."""
    columns = {}
    if K.ID in df.columns:
        columns[K.ID] = F.col(K.ID).try_cast("bigint")
    if "amount" in df.columns:
        columns["amount"] = amounts.number()
    return df.withColumns(columns) if columns else df


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    nrows: int | None = None,
    encoding: str = "UTF-8",
    multiline: bool = False,
) -> DataFrame:
    """CSV with a header.  gz and bz2 files are decompressed by suffix.

    ``multiline`` allows line breaks inside quotes at the price of files that cannot be split.
    """
    reader = spark.read.options(**CSV_OPTIONS, multiLine=multiline)
    if encoding.upper() not in ("UTF-8", "UTF8"):
        reader = reader.option("encoding", encoding)
    df = missing_to_null(reader.csv(path))
    return df if nrows is None else df.limit(nrows)


def open_by_path(path: str):
    """A file of any store that pyarrow knows, as a stream that can seek; for files too large for one value."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    store, inside = pa_fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def whole_or_by_path(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``path, content`` of files; ``content`` is null from ``limit`` bytes on, where tasks stream the file by its path.

    Smaller files are read by Spark, so they may lie in any store that Spark knows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    limit = STREAM_BYTES if limit is None else limit
    large = files.where(F.col("length") >= limit).select("path", F.lit(None).cast("binary").alias("content"))
    return files.where(F.col("length") < limit).select("path", "content").unionByName(large)


def _members(path: str, stream) -> Iterator:
    """Every text file inside a packed file."""
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(stream) as archive:
            for member in archive.infolist():
                if not member.is_dir():
                    with archive.open(member) as inside:
                        yield inside
    else:
        openers = {".xz": lzma.open, ".gz": gzip.open, ".bz2": bz2.open}
        with openers[path[path.rindex(".") :].lower()](stream) as inside:
            yield inside


def parse_archives(packed: DataFrame, columns: list[str]) -> DataFrame:
    """The CSV rows inside zip or xz files given as ``path, content``; a null content is streamed by its path.

    All members of a zip file are read, each with a header of its own.
    """
    schema = StructType([StructField(c, StringType()) for c in columns])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                stream = io.BytesIO(content) if content is not None else open_by_path(name)
                for member in _members(name, stream):
                    try:
                        chunks = pd.read_csv(member, dtype=str, encoding="utf-8", chunksize=CHUNK_ROWS, keep_default_na=False)
                    except pd.errors.EmptyDataError:
                        continue
                    for chunk in chunks:
                        yield chunk.reindex(columns=columns)

    return missing_to_null(packed.mapInPandas(parse, schema))


def read_archived_csv(spark: SparkSession, path: str, columns: list[str], nrows: int | None = None) -> DataFrame:
    """CSV inside zip or xz files, which Spark has no codec for: one task per file, streamed in chunks.

    Neither format can be split, so the number of files bounds the parallelism.
    """
    df = parse_archives(whole_or_by_path(spark, path), columns)
    return df if nrows is None else df.limit(nrows)


def probe_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per file: ``encoding`` (UTF-8 if every line is valid UTF-8, ISO-8859-1 otherwise), ``n_lines``, and
    ``multiline``, whether a quote opened on a line is closed on another one.

    Files are scanned as splittable text, so their size does not matter.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.groupBy("file").agg(
        F.when(F.bool_and(F.is_valid_utf8("value")), "UTF-8").otherwise("ISO-8859-1").alias("encoding"),
        F.count(F.lit(1)).alias("n_lines"),
        F.bool_or(quotes % 2 == 1).alias("multiline"),
    )


def probe_encodings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return probe_files(spark, path).select("file", "encoding", "n_lines")


def read_csv_any_encoding(
    spark: SparkSession, path: str | list[str], nrows: int | None = None, encoding: str | None = None
) -> DataFrame:
    """CSV whose files may differ in encoding (unless one is given) and may hold line breaks inside quotes.

    Usually all files are alike and the path is read as it is.  Only a mixed folder needs its file names, which the
    driver lists for any read; only the files with such line breaks are read unsplit.
    """
    probed = probe_files(spark, path).select("file", F.lit(encoding).alias("encoding") if encoding else "encoding", "multiline")
    probed = materialize(probed, "encodings")
    kinds = sorted(tuple(r) for r in probed.select("encoding", "multiline").distinct().collect())
    if len(kinds) < 2:
        found, multiline = kinds[0] if kinds else ("UTF-8", False)
        return read_csv(spark, path, nrows, found, multiline)
    parts = []
    for found, multiline in kinds:
        same = probed.where((F.col("encoding") == found) & (F.col("multiline") == multiline))
        parts.append(read_csv(spark, [r["file"] for r in same.select("file").collect()], None, found, multiline))
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return df if nrows is None else df.limit(nrows)


def read_parquet(spark: SparkSession, path: str, nrows: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if nrows is None else df.limit(nrows)


def read_transactions(
    spark: SparkSession, path: str, nrows: int | None = None, columns: list[str] | None = None
) -> DataFrame:
    """Read a transaction file or folder by its suffix; every compressed file counts as UTF-8 CSV."""
    suffix = path.rstrip("/").lower()
    if suffix.endswith((".parquet", ".pq")):
        return read_parquet(spark, path, nrows)
    if suffix.endswith(ARCHIVE_SUFFIXES):
        return typed(read_archived_csv(spark, path, columns or K.REQUIRED_TRAIN_COLUMNS, nrows))
    if suffix.endswith(COMPRESSED_SUFFIXES):
        return typed(read_csv_any_encoding(spark, path, nrows, encoding="UTF-8"))
    return typed(read_csv_any_encoding(spark, path, nrows))

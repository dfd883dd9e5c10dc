"""Parquet cache of a processed table and metadata of a load."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerspark.operators.quality import null_counts
from ledgerspark.sources.files import open_by_path, whole_or_by_path

#: What a cache holds, as a file that readers of the table skip.
IDENTITY = "_IDENTITY"


def file_times(spark: SparkSession, path: str) -> tuple[object, object] | None:
    """Oldest and newest modification time of the files under ``path``; None if there are none.

    Only the listing is read, never the content.
    """
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        row = files.agg(F.min("modificationTime"), F.max("modificationTime")).first()
    except AnalysisException:
        return None
    return None if row[0] is None else (row[0], row[1])


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    store, place = _hadoop(spark, path)
    return store.exists(place)


def _stored_identity(spark: SparkSession, cache: str) -> str | None:
    if not _exists(spark, f"{cache}/{IDENTITY}"):
        return None
    store, place = _hadoop(spark, f"{cache}/{IDENTITY}")
    stream = store.open(place)
    try:
        return stream.readUTF()
    finally:
        stream.close()


def is_cache_valid(spark: SparkSession, cache: str, source: str, identity: str | None = None) -> bool:
    """True if both exist, the cache was written to its end for this identity (if one is given), and no cache file is
    older than the newest source file."""
    cache = cache.rstrip("/")
    if not _exists(spark, f"{cache}/_SUCCESS"):
        return False
    if identity is not None and _stored_identity(spark, cache) != identity:
        return False
    cached, original = file_times(spark, cache), file_times(spark, source)
    return cached is not None and original is not None and cached[0] >= original[1]


def cached_table(
    spark: SparkSession,
    source: str,
    cache: str,
    build: Callable[[], DataFrame],
    force_reload: bool = False,
    identity: str | None = None,
) -> DataFrame:
    """Read the processed table from ``cache`` if fresh, otherwise build and write it (snappy Parquet).

    ``identity`` says what was built from the source; a cache of another identity is not used.  The new table is written
    beside the old one, which goes only when the new one is complete.
    """
    cache = cache.rstrip("/")
    if force_reload or not is_cache_valid(spark, cache, source, identity):
        fresh = f"{cache}.writing-{uuid.uuid4().hex}"
        build().write.option("compression", "snappy").parquet(fresh)
        if identity is not None:
            store, place = _hadoop(spark, f"{fresh}/{IDENTITY}")
            stream = store.create(place)
            stream.writeUTF(identity)
            stream.close()
        store, old = _hadoop(spark, cache)
        store.delete(old, True)
        if not store.rename(_hadoop(spark, fresh)[1], old):
            raise OSError(f"cannot move {fresh} to {cache}")
    return spark.read.parquet(cache)


def file_hashes(spark: SparkSession, source: str) -> DataFrame:
    """Size, time and MD5 of every file; large files are streamed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)

    def hashed(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                digest = hashlib.md5(b"" if content is None else content)
                if content is None:
                    with open_by_path(path) as stream:
                        while piece := stream.read(1 << 24):
                            digest.update(piece)
                out.append(digest.hexdigest())
            yield pd.DataFrame({"path": batch["path"], "md5": out})

    hashes = whole_or_by_path(spark, source).mapInPandas(hashed, "path string, md5 string")
    return files.select("path", "length", "modificationTime").join(hashes, "path")


def load_metadata(spark: SparkSession, df: DataFrame, source: str) -> dict[str, DataFrame]:
    """Sections describing a load: the load itself, its columns, its files.  Meant for ``write_report``."""
    load = df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(source).alias("source"),
        F.current_timestamp().alias("loaded_at"),
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
    )
    return {"load": load, "columns": null_counts(df), "files": file_hashes(spark, source)}

"""Load jobs: read, validate, repair, parse, clean, and keep the result as Parquet."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from ledgerspark import constants as K
from ledgerspark.operators import quality, sampling
from ledgerspark.sources.cache import cached_table
from ledgerspark.sources.files import read_transactions
from ledgerspark.storage import materialize


def repair(df: DataFrame, is_train: bool = True, compat: bool = False) -> DataFrame:
    """Validation and repair of a raw table, in the order a file goes through them."""
    valid = quality.coerce_amount(quality.require_valid(df, is_train))
    return quality.clean_text(quality.parse_dates(quality.fill_missing(valid)), compat)


def load_transactions(
    spark: SparkSession,
    path: str,
    is_train: bool = True,
    cache: str | None = None,
    force_reload: bool = False,
    nrows: int | None = None,
) -> DataFrame:
    """A repaired transaction table from a file or folder, cached next to it if asked.

    Text files are read once: their typed rows are written, and validation and repair work on these.  The cache always
    holds the whole table; ``nrows`` cuts what is returned.
    """
    columns = K.REQUIRED_TRAIN_COLUMNS if is_train else K.REQUIRED_COLUMNS

    def build(limit: int | None = None) -> DataFrame:
        raw = read_transactions(spark, path, limit, columns)
        if not path.rstrip("/").lower().endswith((".parquet", ".pq")):
            raw = materialize(raw, "typed")
        return repair(quality.require_unique_ids(raw), is_train)

    if cache is None:
        return build(nrows)
    identity = json.dumps({"is_train": is_train, "columns": columns})
    table = cached_table(spark, path, cache, build, force_reload, identity)
    return table if nrows is None else table.limit(nrows)


def load_report(raw: DataFrame, is_train: bool = True) -> dict[str, DataFrame]:
    """What the repair of a raw table finds: failed amounts, fills, date formats, unknown labels."""
    sections = {
        "amounts": quality.amount_coercion_report(raw),
        "filled": quality.fill_report(raw),
        "columns": quality.null_counts(raw),
    }
    if dict(raw.dtypes)["date"] == "string":
        sections["date_formats"] = quality.date_format_report(raw)
    if is_train:
        sections["unexpected_categories"] = quality.unexpected_categories(raw)
        sections["summary"] = quality.load_summary(raw)
    return sections


def load_sample(spark: SparkSession, path: str, n: int = 1000, stratified: bool = True, cache: str | None = None) -> DataFrame:
    df = load_transactions(spark, path, cache=cache)
    if stratified and K.TARGET in df.columns:
        return sampling.sample_stratified(df, n)
    return sampling.sample_random(df, n)

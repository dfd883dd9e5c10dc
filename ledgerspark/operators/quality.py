"""Validation and repair of transaction tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from ledgerspark import constants as K
from ledgerspark.functions import amounts, dates, text
from ledgerspark.operators.quantiles import scalar_quantiles


def require_columns(df: DataFrame, required: list[str]) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def require_valid(df: DataFrame, is_train: bool = True) -> DataFrame:
    """Raise on missing columns or an empty table; otherwise pass the table on."""
    require_columns(df, K.REQUIRED_TRAIN_COLUMNS if is_train else K.REQUIRED_COLUMNS)
    if df.isEmpty():
        raise ValueError("table is empty")
    return df


def require_unique_ids(df: DataFrame) -> DataFrame:
    """Raise when an id is missing or stands on several rows; otherwise pass the table on."""
    if K.ID in df.columns:
        bad = df.groupBy(K.ID).agg(F.count(F.lit(1)).alias("n")).where(F.col(K.ID).isNull() | (F.col("n") > 1)).first()
        if bad is not None:
            raise ValueError(f"{K.ID} {bad[K.ID]} stands on {bad['n']} rows; ids must be present and unique")
    return df


def coerce_amount(df: DataFrame, column: str = "amount") -> DataFrame:
    return df.withColumn(column, amounts.number(column))


def amount_coercion_report(df: DataFrame, column: str = "amount") -> DataFrame:
    """Rows, values that are missing, and values that are present but no number."""
    value = amounts.number(column)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(column).isNull()).alias("n_missing"),
        F.count_if(F.col(column).isNotNull() & value.isNull()).alias("n_failed"),
        F.sum(value).alias("total_amount"),
    )


def unexpected_categories(df: DataFrame, target: str = K.TARGET) -> DataFrame:
    """Labels outside the known list, with their rows."""
    known = [F.lit(c) for c in K.CATEGORIES]
    return df.where(F.col(target).isNotNull() & ~F.col(target).isin(known)).groupBy(target).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


def fill_missing(df: DataFrame) -> DataFrame:
    """Missing amounts become the exact median of the present ones, missing descriptions the empty text."""
    value = amounts.number()
    median = scalar_quantiles(df, value, {"median": 0.5})["median"]
    filled = value if median is None else F.coalesce(value, F.lit(median))
    return df.withColumns({"amount": filled, "description": text.description()})


def fill_report(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_if(amounts.number().isNull()).alias("amounts_filled"),
        F.count_if(F.col("description").isNull()).alias("descriptions_filled"),
    )


def date_format_report(df: DataFrame, column: str = "date") -> DataFrame:
    """Share of rows that each format leaves null, missing rows included, in the order of trial."""
    rates = df.agg(
        *[F.avg(dates.parse_with(F.col(column), f).isNull().cast("double")).alias(f"f{i}") for i, f in enumerate(K.DATE_FORMATS)]
    )
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(f).alias("format"), F.col(f"f{i}").alias("null_ratio"))
        for i, f in enumerate(K.DATE_FORMATS)
    ]
    return rates.select(F.inline(F.array(*entries)))


def choose_date_format(df: DataFrame, column: str = "date") -> str | None:
    """The first format that fails on less than 5 % of the rows; one pass over the column."""
    for row in sorted(date_format_report(df, column).collect(), key=lambda r: r["position"]):
        ratio = row["null_ratio"]
        if ratio is not None and ratio < K.DATE_MAX_FAILURE_RATIO:
            return row["format"]
    return None


def parse_dates(df: DataFrame, column: str = "date") -> DataFrame:
    """Parse a text date column with one format for the whole column; leave it alone if none fits."""
    if column not in df.columns or not isinstance(df.schema[column].dataType, StringType):
        return df
    chosen = choose_date_format(df, column)
    return df if chosen is None else df.withColumn(column, dates.parse_with(F.col(column), chosen))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def clean_text(df: DataFrame, compat: bool = False, target: str = K.TARGET) -> DataFrame:
    """Strip every text column and turn null into empty text.

    A missing target stays null, so that it is no class of its own; ``compat`` empties it like the rest.
    """
    cleaned = {c: F.coalesce(text.strip(F.col(c)), F.lit("")) for c in text_columns(df)}
    if target in cleaned and not compat:
        cleaned[target] = text.strip(F.col(target))
    return df.withColumns(cleaned) if cleaned else df


def narrow_types(df: DataFrame) -> DataFrame:
    """Optional narrowing: amount to float, the id to the smallest integer type that holds it."""
    columns: dict[str, Column] = {}
    if "amount" in df.columns:
        columns["amount"] = amounts.number().cast("float")
    if K.ID in df.columns:
        value = F.col(K.ID).try_cast("bigint")
        low, high = df.agg(F.min(value), F.max(value)).first()
        if low is not None:
            bits = max(int(high).bit_length(), int(-low - 1).bit_length() if low < 0 else 0)
            kind = "byte" if bits < 8 else "short" if bits < 16 else "int" if bits < 32 else "long"
            columns[K.ID] = value.cast(kind)
    return df.withColumns(columns) if columns else df


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column: missing values and their percentage, in one pass."""
    counted = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(c).alias("column_name"),
            F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
            F.col(f"c{i}").alias("n_missing"),
            F.when(F.col("n") > 0, F.col(f"c{i}") * 100.0 / F.col("n")).alias("pct_missing"),
        )
        for i, c in enumerate(df.columns)
    ]
    return counted.select(F.inline(F.array(*entries)))


def class_counts(df: DataFrame, target: str = K.TARGET) -> DataFrame:
    return df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n_rows"))


def imbalance(df: DataFrame, target: str = K.TARGET) -> DataFrame:
    """Largest over smallest class, 1.0 for a single class, and whether it exceeds ten."""
    ratio = F.when(F.count(F.lit(1)) > 1, F.max("n_rows") / F.min("n_rows")).otherwise(F.lit(1.0))
    return (
        class_counts(df, target)
        .agg(F.count(F.lit(1)).alias("n_classes"), ratio.alias("imbalance_ratio"))
        .withColumn("is_imbalanced", (F.col("imbalance_ratio") > 10).cast("int"))
    )


def load_summary(df: DataFrame, target: str = K.TARGET) -> DataFrame:
    """Rows, total missing values and class balance of a loaded table, as one row."""
    missing = reduce(lambda a, b: a + b, [F.col(c).isNull().cast("long") for c in df.columns])
    total = df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(missing).alias("n_missing"))
    if target not in df.columns:
        return total
    balance = imbalance(df, target).first()
    return total.withColumns(
        {
            "n_classes": F.lit(balance["n_classes"]),
            "imbalance_ratio": F.lit(balance["imbalance_ratio"]),
            "is_imbalanced": F.lit(balance["is_imbalanced"]),
        }
    )


def align_columns(train: DataFrame, test: DataFrame, target: str = K.TARGET) -> tuple[DataFrame, DataFrame]:
    """Keep the columns both tables have, in the order of the first, plus the target of the first."""
    common = [c for c in train.columns if c in test.columns]
    kept = common + ([target] if target in train.columns and target not in common else [])
    return train.select(kept), test.select(common)


def model_frame(df: DataFrame) -> DataFrame:
    """Model inputs: everything but id, date and target; text and categorical columns without nulls."""
    kept = [c for c in df.columns if c not in K.NON_FEATURES]
    filled = {}
    for c in kept:
        if c == "description":
            filled[c] = text.description()
        elif c in K.CATEGORICAL_FEATURES:
            filled[c] = F.coalesce(F.col(c).cast("string"), F.lit("unknown"))
    return df.select(*[filled.get(c, F.col(c)).alias(c) for c in kept])

"""Class codes, label codes and merchant target encoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerspark import constants as K
from ledgerspark.functions.merchants import with_merchant
from ledgerspark.operators.ordering import with_label_rank
from ledgerspark.storage import Sized, broadcast_limit, lookup, materialize, sized

MAX_CLASSES = 1_000


def class_labels(df: DataFrame, *columns: str) -> list[str]:
    """Sorted distinct labels found in ``columns``, as the classes of a classifier.

    A classifier has a probability per class and row, so a column with more labels is an error here; ``with_class_codes``
    has no such bound.
    """
    found = df.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("label"))
    labels = [r[0] for r in found.where("label is not null").distinct().limit(MAX_CLASSES + 1).collect()]
    if len(labels) > MAX_CLASSES:
        raise ValueError(f"{', '.join(columns)} has more than {MAX_CLASSES} labels; it is no class column")
    return sorted(labels)


def code_of(column: Column, labels: list[str]) -> Column:
    """0-based position of a label in ``labels``; -1 for null and unknown labels."""
    if not labels:
        return F.lit(-1)
    known = F.array(*[F.lit(x) for x in labels])
    return F.coalesce(F.array_position(known, column) - 1, F.lit(-1)).cast("int")


def label_at(index: Column, labels: list[str]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in labels]), index.cast("int"))


def with_class_codes(df: DataFrame, target: str = K.TARGET, out: str = "category_code") -> DataFrame:
    """Add the rank of the label among the sorted labels; -1 for null.  Labels may be any number."""
    present = df.where(F.col(target).isNotNull())
    sizes = materialize(present.groupBy(target).agg(F.count(F.lit(1)).alias("__n")), "labels")
    ranked = with_label_rank(sizes, [target], "__code").join(sizes, target)
    joined = lookup(df, materialize(ranked, "codes"), [target], ["__code"], spread_by=K.ID, weight="__n")
    return joined.withColumn(out, F.coalesce("__code", F.lit(-1)).cast("int")).drop("__code")


def label_text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("unknown"))


def fit_label_codes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Written table ``(column_name, label, code, n)``: per column the rank of the label in sorted order.

    Null counts as "unknown".  All columns are counted in one pass.  Labels may be as many as there are
    merchants; beyond the broadcast bound they are ranked by a distributed sort.
    """
    columns = columns or [c for c in K.CATEGORICAL_FEATURES if c in df.columns]
    entries = [F.struct(F.lit(c).alias("column_name"), label_text(c).alias("label")) for c in columns]
    counted = df.select(F.inline(F.array(*entries))).groupBy("column_name", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialize(counted, "labels")
    if sizes.count() <= broadcast_limit(df.sparkSession):
        rank = F.row_number().over(Window.partitionBy("column_name").orderBy("label")) - 1
        return materialize(sizes.withColumn("code", rank.cast("long")), "codes")
    ranked = with_label_rank(sizes, ["column_name", "label"], "rank")
    first = ranked.groupBy("column_name").agg(F.min("rank").alias("first"))
    placed = ranked.join(F.broadcast(first), "column_name").withColumn("code", F.col("rank") - F.col("first"))
    codes = placed.select("column_name", "label", "code")
    return materialize(codes.join(sizes, ["column_name", "label"]), "codes")


def apply_label_codes(
    df: DataFrame, codes: DataFrame, columns: list[str] | None = None, prefix: str = ""
) -> DataFrame:
    """Codes of the labels, in columns named with ``prefix`` or in place; -1 for labels not in the table."""
    rows = df
    for column in columns or [c for c in K.CATEGORICAL_FEATURES if c in df.columns]:
        rows = rows.withColumn("__label", label_text(column))
        table = codes.where(F.col("column_name") == column).select(F.col("label").alias("__label"), "code", "n")
        rows = lookup(rows, table, ["__label"], ["code"], spread_by=K.ID, weight="n", count_keys=True)
        rows = rows.withColumn(prefix + column, F.coalesce(F.col("code"), F.lit(-1)).cast("double"))
        rows = rows.drop("code", "__label")
    return rows


def encode_categoricals(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return apply_label_codes(df, fit_label_codes(df, columns), columns)


@dataclass
class EncodingStats:
    """Merchant means of the class code, as a written table ``(store_name, mean, n)``, and the overall mean."""

    stores: DataFrame
    global_mean: float


def default_fold(folds: int = K.N_FOLDS) -> Column:
    return F.pmod(F.xxhash64(F.col(K.ID), F.lit(K.SEED)), F.lit(folds)).cast("int")


def fold_assignment(df: DataFrame, fold: Column | None = None, folds: int = K.N_FOLDS) -> Column:
    """The given folds, or hashed ones; a table of at most ``folds`` rows gets one fold per row."""
    if fold is not None:
        return fold
    return default_fold(folds) if df.limit(folds + 1).count() > folds else F.col(K.ID)


def coded_stores(df: DataFrame, target: str = K.TARGET) -> DataFrame:
    if target not in df.columns:
        raise ValueError(f"target column is required to fit the encoding: {target}")
    code = code_of(F.col(target), class_labels(df, target))
    return with_merchant(df).withColumn("__code", code.cast("double"))


def fit_target_encoding(df: DataFrame, target: str = K.TARGET) -> EncodingStats:
    """Plain merchant means (missing labels count as -1) and the mean over present labels."""
    table = materialize(
        coded_stores(df, target)
        .groupBy("store_name")
        .agg(
            F.avg("__code").alias("mean"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(F.col("__code") >= 0, F.col("__code"))).alias("known_sum"),
            F.count(F.when(F.col("__code") >= 0, 1)).alias("known"),
        ),
        "encoding",
    )
    total, known = table.agg(F.sum("known_sum"), F.sum("known")).first()
    return EncodingStats(table.select("store_name", "mean", "n"), total / known if known else 0.0)


def apply_target_encoding(df: DataFrame, stats: EncodingStats | None, out: str = "store_name_target_enc") -> DataFrame:
    """Look merchants up in fitted means; unseen ones get the overall mean, no statistics give 0."""
    rows = with_merchant(df)
    if stats is None:
        return rows.withColumn(out, F.lit(0.0))
    joined = lookup(rows, stats.stores, ["store_name"], ["mean"], spread_by=K.ID, weight="n", count_keys=True)
    return joined.withColumn(out, F.coalesce("mean", F.lit(stats.global_mean))).drop("mean")


def out_of_fold_table(
    parts: DataFrame, smoothing: float = K.TARGET_ENCODING_SMOOTHING, out: str = "store_name_target_enc"
) -> Sized:
    """Encoding per ``(store_name, __fold)`` from written partial sums (see ``fold_parts``).

    A fold's value uses every other fold: the merchant's totals minus the fold's own part.  The table also
    holds the merchant's frequency, so one lookup serves both.
    """
    rows, known, known_sum = parts.agg(F.sum("n"), F.sum("known"), F.sum("known_sum")).first()
    mean = F.lit(known_sum / known if known else 0.0)
    cells = parts.groupBy("store_name", "__fold").agg(*[F.sum(c).alias(c) for c in ("n", "code_sum")])
    stores = parts.groupBy("store_name").agg(
        F.sum("n").alias("all_n"), F.sum("code_sum").alias("all_sum"), F.sum("n_ids").alias("store_frequency")
    )
    others = F.col("all_n") - F.col("n")
    encoded = (F.col("all_sum") - F.col("code_sum") + F.lit(smoothing) * mean) / (others + F.lit(smoothing))
    if (rows or 0) < 2:
        encoded = mean
    table = cells.join(stores, "store_name").select("store_name", "__fold", "n", "store_frequency", encoded.alias(out))
    return sized(materialize(table, "encoding"), "n")


def fold_parts(rows: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Partial sums per merchant, fold and ``extra`` columns from rows with ``__code`` and ``__fold``."""
    known = F.col("__code") >= 0
    return rows.groupBy("store_name", *(extra or []), "__fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(K.ID).alias("n_ids"),
        F.sum("__code").alias("code_sum"),
        F.count(F.when(known, 1)).alias("known"),
        F.sum(F.when(known, F.col("__code"))).alias("known_sum"),
    )


def target_encode_out_of_fold(
    df: DataFrame,
    target: str = K.TARGET,
    folds: int = K.N_FOLDS,
    smoothing: float = K.TARGET_ENCODING_SMOOTHING,
    fold: Column | None = None,
    out: str = "store_name_target_enc",
) -> DataFrame:
    """Add the smoothed out-of-fold merchant encoding in one pass instead of one per fold."""
    rows = coded_stores(df, target).withColumn("__fold", fold_assignment(df, fold, folds))
    table = out_of_fold_table(materialize(fold_parts(rows), "parts"), smoothing, out)
    joined = lookup(rows, table, ["store_name", "__fold"], [out], spread_by=K.ID, weight="n")
    return joined.drop("__code", "__fold")

"""Confusion counts and the scores that follow from them.

Predictions are counted once per (actual, predicted); everything after that works on a table of at most
classes × classes rows, so no score needs a second pass over the predictions.  All functions take predictions, or such
counts in a column ``COUNTED``, as reports write them once for all their sections (``tally``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerspark.operators.encoding import class_labels

ACTUAL, PREDICTED = "actual", "predicted"
#: Rows that a row of a counted table stands for.
COUNTED = "__rows"


def size(df: DataFrame, condition: Column | None = None) -> Column:
    """Aggregate: rows, or rows that meet a condition."""
    if COUNTED not in df.columns:
        return F.count(F.lit(1)) if condition is None else F.count_if(condition)
    rows = F.col(COUNTED) if condition is None else F.when(condition, F.col(COUNTED)).otherwise(0)
    return F.coalesce(F.sum(rows), F.lit(0))


def confusion_counts(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or []), ACTUAL, PREDICTED).agg(size(df).alias("n"))


def confusion_matrix(df: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """Dense counts over all label pairs and the share within the actual label (0 for an empty row)."""
    labels = labels or class_labels(df, ACTUAL, PREDICTED)
    known = F.array(*[F.lit(x) for x in labels])
    rows = df.sparkSession.range(1).select(F.explode(known).alias(ACTUAL))
    grid = rows.select(ACTUAL, F.explode(known).alias(PREDICTED))
    cells = grid.join(confusion_counts(df), [ACTUAL, PREDICTED], "left").select(
        ACTUAL, PREDICTED, F.coalesce("n", F.lit(0)).alias("n")
    )
    total = F.sum("n").over(Window.partitionBy(ACTUAL))
    return cells.withColumn("rate", F.when(total > 0, F.col("n") / total).otherwise(F.lit(0.0)))


def class_metrics(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per label: support, errors, precision, recall, F1 and both error rates, from confusion counts.

    Labels that occur only as predictions are included; 0/0 counts as 0.
    """
    by = by or []
    hit = F.col(ACTUAL) == F.col(PREDICTED)
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            F.col(ACTUAL).alias("label"),
            F.col("n").alias("support"),
            F.when(hit, F.col("n")).otherwise(zero).alias("hits"),
            F.when(hit, zero).otherwise(F.col("n")).alias("false_negatives"),
            zero.alias("false_positives"),
        ),
        F.struct(
            F.col(PREDICTED).alias("label"),
            zero.alias("support"),
            zero.alias("hits"),
            zero.alias("false_negatives"),
            F.when(hit, zero).otherwise(F.col("n")).alias("false_positives"),
        ),
    )
    sums = (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(*[F.sum(c).alias(c) for c in ("support", "hits", "false_negatives", "false_positives")])
    )
    errors = F.col("false_negatives") + F.col("false_positives")

    def ratio(part, whole):
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    return sums.select(
        *by,
        "label",
        "support",
        "false_negatives",
        "false_positives",
        ratio(F.col("hits"), F.col("hits") + F.col("false_positives")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(F.col("hits") * 2, F.col("hits") * 2 + errors).alias("f1"),
        (errors / F.greatest(F.lit(1), F.col("support"))).alias("error_rate"),
        ratio(errors, F.col("support") + errors).alias("error_share"),
    )


def per_class_metrics(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return class_metrics(confusion_counts(df, by), by)


def macro_f1_of(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean F1 over the labels that occur, and the rows counted."""
    metrics = class_metrics(counts, by)
    return metrics.groupBy(*(by or [])).agg(F.avg("f1").alias("macro_f1"), F.sum("support").alias("n_rows"))


def macro_f1(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return macro_f1_of(confusion_counts(df, by), by)


def macro_f1_score(df: DataFrame) -> float:
    return macro_f1(df).first()["macro_f1"] or 0.0


def fold_summary(df: DataFrame, fold: str = "fold") -> DataFrame:
    """Mean and population deviation of the fold scores, and all validated rows."""
    return macro_f1(df, [fold]).agg(
        F.avg("macro_f1").alias("mean_f1"), F.stddev_pop("macro_f1").alias("f1_std"), F.sum("n_rows").alias("n_rows")
    )


def lowest_f1_classes(df: DataFrame, n: int = 3) -> DataFrame:
    return per_class_metrics(df).orderBy("f1", "label").limit(n)


def error_rate_chart(df: DataFrame) -> DataFrame:
    """Errors over support plus errors per label, highest first."""
    return per_class_metrics(df).select("label", "error_share", "f1").orderBy(F.desc("error_share"), "label")


def top_misclassifications(df: DataFrame, n: int = 10) -> DataFrame:
    wrong = confusion_counts(df).where(F.col(ACTUAL) != F.col(PREDICTED))
    named = wrong.select(F.concat_ws(" → ", ACTUAL, PREDICTED).alias("pattern"), "n")
    return named.orderBy(F.desc("n"), "pattern").limit(n)


def confused_pairs(df: DataFrame, n: int = 5) -> DataFrame:
    wrong = confusion_counts(df).where(F.col(ACTUAL) != F.col(PREDICTED))
    pair = F.concat_ws(" ↔ ", F.least(ACTUAL, PREDICTED), F.greatest(ACTUAL, PREDICTED))
    return wrong.groupBy(pair.alias("pair")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pair").limit(n)

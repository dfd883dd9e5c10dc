"""Report jobs: every section is an independent table; ``write_report`` turns them into JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ledgerspark import constants as K
from ledgerspark.operators import eda, errors, evaluation, profile, quality
from ledgerspark.operators.recurrence import with_store_frequency
from ledgerspark.plans.training import TrainedModel, weights_table


def eda_report(df: DataFrame, target: str = K.TARGET) -> dict[str, DataFrame]:
    """Exploratory sections of a loaded table."""
    quality.require_columns(df, K.REQUIRED_TRAIN_COLUMNS)
    return {
        "overview": quality.load_summary(df, target),
        "columns": quality.null_counts(df),
        "target_distribution": quality.class_counts(df, target),
        "top_words": eda.top_words(df),
        "description_length": eda.description_length(df),
        "description_length_by_category": eda.description_length_by_category(df, target),
        "amount": profile.describe_amount(df),
        "amount_by_category": eda.amount_by_category(df, target),
        "amount_outliers": eda.iqr_outliers(df),
        "by_month": eda.by_month(df),
        "by_weekday": eda.by_weekday(df),
        "by_quarter": eda.by_quarter(df),
        "date_range": profile.profile_date_range(df),
        "sequential_id": eda.sequential_id(df),
        "chart_histogram": eda.histogram(df),
        "chart_box_stats": eda.box_stats(df, target),
        "chart_top_terms": eda.top_words(df, 20),
        "feature_preview": eda.candidate_features(df).orderBy(K.ID).limit(3),
    }


def error_report(oof: DataFrame) -> dict[str, DataFrame]:
    """Error sections of an out-of-fold table; features it lacks are added.

    The table is read twice, whatever the number of sections: once for all counts, once for the examples.
    """
    rows = oof if "store_frequency" in oof.columns else with_store_frequency(oof)
    counts = errors.tally(rows)
    confusion, slices = counts["confusion"], counts["slices"]
    return {
        "folds": evaluation.macro_f1(confusion, ["fold"]),
        "overall": evaluation.fold_summary(confusion),
        "confusion_matrix": evaluation.confusion_matrix(confusion),
        "per_class_metrics": evaluation.per_class_metrics(confusion),
        "lowest_f1_classes": evaluation.lowest_f1_classes(confusion),
        "error_rates": evaluation.error_rate_chart(confusion),
        "top_misclassifications": evaluation.top_misclassifications(confusion),
        "confused_pairs": evaluation.confused_pairs(confusion),
        "examples": errors.misclassified_examples(rows),
        "keywords": errors.errors_by_keyword(slices),
        "keyword_distribution": errors.keyword_distribution(slices),
        "amounts": errors.errors_by_amount(slices),
        "times": errors.errors_by_time(slices),
        "stores": errors.errors_by_store(counts["stores"]),
        "profile": errors.misclassified_profile(counts["facets"]),
        "suggested_rules": errors.suggest_rules(slices),
    }


def training_summary(trained: TrainedModel) -> dict[str, DataFrame]:
    """Fold scores, class weights and the score before and after weight tuning."""
    spark = trained.oof.sparkSession
    return {
        "folds": evaluation.macro_f1(trained.oof, ["fold"]),
        "class_weights": weights_table(spark, trained.matrix.labels, trained.weights),
        "scores": spark.range(1).select(
            F.lit(trained.raw_f1).alias("raw_macro_f1"), F.lit(trained.tuned_f1).alias("tuned_macro_f1")
        ),
    }

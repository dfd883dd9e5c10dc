"""Exploratory report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark import constants as K
from ledgerspark.catalogue.base import query
from ledgerspark.catalogue.ingest import SQL_DATES, SQL_MISSING
from ledgerspark.fixtures import duck, txn
from ledgerspark.operators import eda, profile, quality

_stop = "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in K.STOP_WORDS) + ")"


def _top_sql(n: int) -> str:
    return duck(
        rf"""SELECT term, count(*) AS n_uses FROM (
        SELECT unnest(regexp_extract_all(lower(coalesce(description, '')), '\w\w+')) AS term FROM txn)
        WHERE term NOT IN {_stop} GROUP BY term ORDER BY n_uses DESC, term LIMIT {n}"""
    )


@query(
    "eda_overview",
    duck(
        f"""SELECT category, count(*) AS n_rows, (SELECT count(*) FROM txn) AS total_rows,
        (SELECT {SQL_MISSING} FROM txn) AS total_missing FROM txn GROUP BY category"""
    ),
)
def _eda_overview(spark, sf_dir):
    rows = txn(spark, sf_dir).select(K.REQUIRED_TRAIN_COLUMNS)
    total = quality.load_summary(rows).first()
    return quality.class_counts(rows).withColumns(
        {"total_rows": F.lit(total["n_rows"]), "total_missing": F.lit(total["n_missing"])}
    )


@query("eda_top_words", _top_sql(50))
def _eda_top_words(spark, sf_dir):
    return eda.top_words(txn(spark, sf_dir))


@query("chart_top_terms", _top_sql(20))
def _chart_top_terms(spark, sf_dir):
    return eda.top_words(txn(spark, sf_dir), 20)


@query(
    "eda_top_words_documents",
    rf"""SELECT term, count(*) AS n_uses FROM (
    SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}')) AS term FROM documents)
    WHERE term NOT IN {_stop} GROUP BY term ORDER BY n_uses DESC, term LIMIT 50""",
)
def _eda_top_words_documents(spark, sf_dir):
    return eda.top_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), column="text")


@query(
    "eda_desc_length",
    duck(
        """SELECT category, round_even(avg(length(coalesce(description, ''))), 2) AS mean_length,
        (SELECT round(avg(length(coalesce(description, ''))), 6) FROM txn) AS overall_mean,
        (SELECT CAST(median(length(coalesce(description, ''))) AS DOUBLE) FROM txn) AS overall_median
        FROM txn GROUP BY category"""
    ),
)
def _eda_desc_length(spark, sf_dir):
    rows = txn(spark, sf_dir)
    overall = eda.description_length(rows).first()
    return eda.description_length_by_category(rows).withColumns(
        {"overall_mean": F.lit(overall["mean_length"]), "overall_median": F.lit(overall["median_length"])}
    )


@query(
    "eda_amount_overall",
    duck(
        """SELECT count(amount) AS n, round_even(avg(amount), 2) AS mean, round_even(stddev_samp(amount), 2) AS std,
        round_even(min(amount), 2) AS min, round_even(max(amount), 2) AS max, round_even(quantile_cont(amount, 0.25), 2) AS q1,
        round_even(quantile_cont(amount, 0.5), 2) AS median, round_even(quantile_cont(amount, 0.75), 2) AS q3 FROM txn"""
    ),
)
def _eda_amount_overall(spark, sf_dir):
    return profile.describe_amount(txn(spark, sf_dir))


@query(
    "eda_amount_by_category",
    duck(
        """SELECT category, count(amount) AS n, round_even(avg(amount), 2) AS mean, round_even(median(amount), 2) AS median,
        round_even(stddev_samp(amount), 2) AS std, round_even(min(amount), 2) AS min, round_even(max(amount), 2) AS max
        FROM txn GROUP BY category"""
    ),
)
def _eda_amount_by_category(spark, sf_dir):
    return eda.amount_by_category(txn(spark, sf_dir))


@query(
    "eda_iqr_outliers",
    duck(
        """WITH q AS (SELECT quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM txn)
        SELECT round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3, round(any_value(q3 - q1), 6) AS iqr,
        round(any_value(q1 - 1.5e0 * (q3 - q1)), 6) AS lower_bound, round(any_value(q3 + 1.5e0 * (q3 - q1)), 6) AS upper_bound,
        count(*) FILTER (WHERE amount < q1 - 1.5e0 * (q3 - q1) OR amount > q3 + 1.5e0 * (q3 - q1)) AS outlier_count,
        round(count(*) FILTER (WHERE amount < q1 - 1.5e0 * (q3 - q1) OR amount > q3 + 1.5e0 * (q3 - q1)) * 100e0 / count(*), 6)
        AS outlier_percentage FROM txn CROSS JOIN q"""
    ),
)
def _eda_iqr_outliers(spark, sf_dir):
    return eda.iqr_outliers(txn(spark, sf_dir))


@query("eda_by_month", duck("SELECT strftime(date, '%Y-%m') AS period, count(*) AS n_rows FROM txn GROUP BY 1"))
def _eda_by_month(spark, sf_dir):
    return eda.by_month(txn(spark, sf_dir))


@query(
    "eda_by_quarter",
    duck("SELECT concat(year(date), 'Q', quarter(date)) AS period, count(*) AS n_rows FROM txn GROUP BY 1"),
)
def _eda_by_quarter(spark, sf_dir):
    return eda.by_quarter(txn(spark, sf_dir))


@query(
    "eda_by_weekday",
    duck(
        """SELECT CAST(d.position AS BIGINT) AS position, d.day_of_week, count(t.transaction_id) AS n_rows
        FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'), (5, 'Saturday'),
        (6, 'Sunday')) AS d(position, day_of_week) LEFT JOIN txn t USING (day_of_week) GROUP BY 1, 2"""
    ),
)
def _eda_by_weekday(spark, sf_dir):
    return eda.by_weekday(txn(spark, sf_dir))


@query("eda_date_range", duck(SQL_DATES))
def _eda_date_range(spark, sf_dir):
    return profile.profile_date_range(txn(spark, sf_dir))


@query(
    "eda_candidate_features",
    duck(
        r"""WITH t AS (SELECT *, coalesce(description, '') AS d FROM txn)
        SELECT transaction_id, CAST(len(regexp_extract_all(d, '\S+')) AS BIGINT) AS description_word_count,
        CAST(length(d) AS BIGINT) AS description_char_count,
        CAST(len(regexp_extract_all(d, '\d')) AS BIGINT) AS description_digit_count,
        CAST(len(regexp_extract_all(d, '[^\w\s]')) AS BIGINT) AS description_special_char_count,
        CAST(month(date) AS BIGINT) AS month, CAST(quarter(date) AS BIGINT) AS quarter,
        CAST(isodow(date) >= 6 AS BIGINT) AS is_weekend, CAST(day(date) AS BIGINT) AS day_of_month,
        CASE WHEN amount > -1 THEN round(ln(1 + amount), 6) END AS log_amount,
        CASE WHEN amount <= 25 THEN 'small' WHEN amount <= 100 THEN 'medium' WHEN amount > 100 THEN 'large' END AS amount_bins
        FROM t"""
    ),
)
def _eda_candidate_features(spark, sf_dir):
    return eda.candidate_features(txn(spark, sf_dir))


@query(
    "eda_sequential_id",
    duck(
        """SELECT count(*) AS n_rows, CAST(count(transaction_id) = count(*) AND count(DISTINCT transaction_id) = count(*)
        AND max(transaction_id) - min(transaction_id) + 1 = count(*) AS BIGINT) AS is_sequential FROM txn"""
    ),
)
def _eda_sequential_id(spark, sf_dir):
    return eda.sequential_id(txn(spark, sf_dir))


@query(
    "chart_histogram",
    duck(
        """WITH m AS (SELECT min(amount) AS lo, (max(amount) - min(amount)) / 40 AS width FROM txn),
        b AS (SELECT least(floor((amount - lo) / width), 39) AS bin FROM txn CROSS JOIN m WHERE amount IS NOT NULL)
        SELECT CAST(g.bin AS BIGINT) AS bin, round(any_value(lo + g.bin * width), 6) AS lower,
        round(any_value(lo + (g.bin + 1) * width), 6) AS upper, count(b.bin) AS n_rows
        FROM (SELECT unnest(range(40)) AS bin) g CROSS JOIN m LEFT JOIN b ON b.bin = g.bin GROUP BY g.bin"""
    ),
)
def _chart_histogram(spark, sf_dir):
    return eda.histogram(txn(spark, sf_dir))


@query(
    "chart_box_stats",
    duck(
        """WITH q AS (SELECT category, quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS median,
        quantile_cont(amount, 0.75) AS q3 FROM txn GROUP BY category),
        t AS (SELECT *, amount BETWEEN q1 - (q3 - q1) * 1.5e0 AND q3 + (q3 - q1) * 1.5e0 AS inside
              FROM txn JOIN q USING (category) WHERE amount IS NOT NULL)
        SELECT category, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
        round(any_value(q3), 6) AS q3, round(min(amount) FILTER (WHERE inside), 6) AS whisker_low,
        round(max(amount) FILTER (WHERE inside), 6) AS whisker_high, count(*) FILTER (WHERE NOT inside) AS n_outliers
        FROM t GROUP BY category"""
    ),
)
def _chart_box_stats(spark, sf_dir):
    return eda.box_stats(txn(spark, sf_dir))

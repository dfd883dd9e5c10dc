"""Feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark import constants as K
from ledgerspark.catalogue.base import query
from ledgerspark.fixtures import duck, txn
from ledgerspark.functions import amounts, dates, text
from ledgerspark.functions.merchants import with_merchant
from ledgerspark.operators import encoding, recurrence
from ledgerspark.plans import feature_table as ft

# ---- DuckDB building blocks, written independently of the Spark expressions -------------------------------
SQL_STORE = r"""
stores AS (
  SELECT t.*, upper(coalesce(description, '')) AS up, coalesce(description, '') AS d,
         regexp_replace(upper(coalesce(description, '')), '^\s+|\s+$', '', 'g') AS u FROM txn t),
store1 AS (
  SELECT *, regexp_extract(u, '\b(?:SQ\s*\*|SQUARE\s*\*|AMZN\s*MKTP\s*\*?|AMAZON\s*\*?|WMT\s*#?)\s*([A-Z0-9][A-Z0-9 &.''-]{1,30})', 1) AS m1,
         regexp_extract(u, '\b(?:UBER|LYFT|SPOTIFY|NETFLIX|WHOLE\s+FOODS|TARGET|WALMART|COSTCO|CVS|SHELL|CHEVRON)\b') AS m2,
         regexp_extract(u, '^[^\s*#]*') AS m3 FROM stores),
s AS (
  SELECT *, coalesce(nullif(left(CASE WHEN m1 <> '' THEN trim(regexp_replace(m1, '\s+', ' ', 'g'), ' *#.-')
                                      WHEN m2 <> '' THEN trim(regexp_replace(m2, '\s+', ' ', 'g'), ' *#.-')
                                      ELSE m3 END, 40), ''), 'UNKNOWN') AS store_name FROM store1)
"""

SQL_COLUMNS = {
    "store_frequency": "count(transaction_id) OVER (PARTITION BY store_name)",
    "is_recurring": "CAST(count(*) OVER (PARTITION BY store_name, round(amount, 8)) > 1 AS BIGINT)",
    "is_round_amount": "CAST(coalesce(amount % 1 = 0, true) AS BIGINT)",
    "decimal_digits": "CASE WHEN amount IS NULL THEN CAST(0 AS BIGINT) ELSE CAST(length(rtrim(split_part(printf('%.10f', amount), '.', 2), '0')) AS BIGINT) END",
    "amount_percentile": """CASE WHEN amount IS NOT NULL THEN round(
        (rank() OVER (PARTITION BY date_trunc('month', date) ORDER BY amount NULLS LAST)
         + (count(*) OVER (PARTITION BY date_trunc('month', date), amount) - 1) / 2.0)
        / count(amount) OVER (PARTITION BY date_trunc('month', date)), 6) END""",
    "day_of_year": "CAST(coalesce(dayofyear(date), 0) AS BIGINT)",
    "week_of_year": "CAST(coalesce(weekofyear(date), 0) AS BIGINT)",
    "month_period": "CASE WHEN date IS NULL THEN 'unknown' WHEN day(date) <= 10 THEN 'start' WHEN day(date) <= 20 THEN 'mid' ELSE 'end' END",
    "days_to_weekend": "CAST(CASE WHEN date IS NULL OR isodow(date) >= 6 THEN 0 ELSE 6 - isodow(date) END AS BIGINT)",
    "is_weekend": "CAST(coalesce(isodow(date) >= 6, false) AS BIGINT)",
    "month": "CAST(coalesce(month(date), 0) AS BIGINT)",
    "quarter": "CAST(coalesce(quarter(date), 0) AS BIGINT)",
    "day_of_month": "CAST(coalesce(day(date), 0) AS BIGINT)",
    "has_state_code": f"CAST(regexp_matches(up, '(^|[^A-Z])(?:{K.STATE_CODES})([^A-Z]|$)') AS BIGINT)",
    "time_since_last_transaction": "coalesce(transaction_id - lag(transaction_id) OVER (ORDER BY transaction_id), 0)",
    "transaction_count_per_day": "row_number() OVER (PARTITION BY CAST(date AS DATE) ORDER BY transaction_id)",
    "transaction_gap": "coalesce(transaction_id - lag(transaction_id) OVER (ORDER BY transaction_id), 0)",
    "transaction_number_in_day": "row_number() OVER (PARTITION BY CAST(date AS DATE) ORDER BY transaction_id)",
    "description_word_count": r"CAST(len(regexp_extract_all(d, '\S+')) AS BIGINT)",
    "description_char_count": "CAST(length(d) AS BIGINT)",
    "description_digit_count": r"CAST(len(regexp_extract_all(d, '\d')) AS BIGINT)",
    "description_special_char_count": r"CAST(len(regexp_extract_all(d, '[^\w\s]')) AS BIGINT)",
    "log_amount": "CASE WHEN amount IS NOT NULL THEN round(ln(1 + CASE WHEN amount < 0 THEN 0 ELSE amount END), 6) END",
    "amount_bins": "CASE WHEN amount IS NULL THEN 'unknown' WHEN amount <= 25 THEN 'small' WHEN amount <= 100 THEN 'medium' ELSE 'large' END",
    "has_grocery_keyword": r"CAST(regexp_matches(d, '(?i)grocery|groceries|whole\s+foods|walmart|safeway|kroger|aldi|trader\s+joe|supercenter|market') AS BIGINT)",
    "has_food_keyword": "CAST(regexp_matches(d, '(?i)restaurant|food|cafe|coffee|starbucks|chipotle|mcdonald|pizza|doordash|grubhub') AS BIGINT)",
    "has_transport_keyword": "CAST(regexp_matches(d, '(?i)uber|lyft|taxi|shell|chevron|exxon|fuel|gas|parking|toll|transit|train') AS BIGINT)",
    "has_transfer_keyword": "CAST(regexp_matches(d, '(?i)transfer|payment|paypal|venmo|zelle|wire|withdrawal|deposit') AS BIGINT)",
    "has_travel_keyword": "CAST(regexp_matches(d, '(?i)air|airline|hotel|motel|flight|booking|travel|airport|expedia|airbnb') AS BIGINT)",
}
SQL_EXTENDED = {
    "is_subscription_keyword": "CAST(regexp_matches(up, 'NETFLIX|SPOTIFY|AMAZON PRIME|HULU|DISNEY|HBOMAX|SUBSCRIPTION|MONTHLY|RECURRING|RENEWAL|AUTO-PAY|MEMBERSHIP') AS BIGINT)",
    "entertainment_keyword_count": "CAST(len(list_filter(['CINEMA','MOVIE','CONCERT','THEATER','BOWLING','AMUSEMENT','ARCADE','PARK','ZOO','MUSEUM','GALLERY','FESTIVAL','EVENT','SHOW'], lambda w: contains(up, w))) AS BIGINT)",
    "is_entertainment_merchant": "CAST(regexp_matches(up, 'CINEMA|MOVIE|THEATER|BOWLING|AMUSEMENT|ARCADE') AS BIGINT)",
    "amount_roundness": "round(coalesce(abs(amount % 1), 0), 6)",
    "is_common_subscription_amount": "CAST(coalesce(amount IN (9.99e0, 12.99e0, 14.99e0, 19.99e0), false) AS BIGINT)",
    "is_high_value": "CAST(coalesce(amount >= 100, false) AS BIGINT)",
    "is_low_value": "CAST(coalesce(amount < 10, false) AS BIGINT)",
    "hour": "CAST(CASE WHEN timed THEN coalesce(hour(date), 0) ELSE 12 END AS BIGINT)",
    "is_lunch_hour": "CAST(timed AND coalesce(hour(date) BETWEEN 11 AND 14, false) AS BIGINT)",
    "is_dinner_hour": "CAST(timed AND coalesce(hour(date) BETWEEN 18 AND 21, false) AS BIGINT)",
    "is_business_hours": "CAST(NOT timed OR coalesce(hour(date) BETWEEN 9 AND 17, false) AS BIGINT)",
}
SQL_CODED = SQL_STORE + """,
coded AS (SELECT *, (SELECT count(DISTINCT x.category) FROM txn x WHERE x.category < s.category) AS code,
                 transaction_id % 5 AS fold FROM s)
"""
SQL_OOF = SQL_CODED + """,
means AS (SELECT f.fold, c.store_name, count(*) AS n, avg(c.code) AS mean
          FROM coded c JOIN (VALUES (0), (1), (2), (3), (4)) AS f(fold) ON c.fold <> f.fold GROUP BY 1, 2),
overall AS (SELECT avg(code) AS g FROM coded),
enc AS (SELECT c.*, round(coalesce((m.n * m.mean + 10 * o.g) / (m.n + 10), o.g), 6) AS store_name_target_enc
        FROM coded c CROSS JOIN overall o LEFT JOIN means m ON m.fold = c.fold AND m.store_name = c.store_name)
"""


def feature_sql(*columns: str) -> str:
    picked = ", ".join(f"{(SQL_COLUMNS | SQL_EXTENDED)[c]} AS {c}" for c in columns)
    return duck(f"WITH {SQL_STORE} SELECT transaction_id, {picked} FROM s")


@query("merchant_name", duck(f"WITH {SQL_STORE} SELECT transaction_id, store_name FROM s"))
def _merchant_name(spark, sf_dir):
    return with_merchant(txn(spark, sf_dir)).select(K.ID, "store_name")


@query(
    "merchant_rollup",
    duck(
        f"""WITH {SQL_STORE} SELECT store_name, count(*) AS n_rows, round(sum(amount), 6) AS total_amount,
        strftime(min(date), '%Y-%m-%d %H:%M:%S') AS first_date, strftime(max(date), '%Y-%m-%d %H:%M:%S') AS last_date
        FROM s GROUP BY store_name"""
    ),
)
def _merchant_rollup(spark, sf_dir):
    return recurrence.merchant_rollup(txn(spark, sf_dir))


@query("store_frequency", feature_sql("store_frequency"))
def _store_frequency(spark, sf_dir):
    return recurrence.with_store_frequency(txn(spark, sf_dir)).select(K.ID, "store_frequency")


@query("is_recurring", feature_sql("is_recurring"))
def _is_recurring(spark, sf_dir):
    return recurrence.with_recurring(txn(spark, sf_dir)).select(K.ID, "is_recurring")


def _stateless(name, columns, build):
    @query(name, feature_sql(*columns))
    def run(spark, sf_dir):
        rows = txn(spark, sf_dir)
        built = build(rows)
        return rows.select(K.ID, *[built[c].alias(c) for c in columns])


_stateless("is_round_amount", ["is_round_amount"], lambda t: amounts.amount_columns(amounts.number()))
_stateless("decimal_digits", ["decimal_digits"], lambda t: amounts.amount_columns(amounts.number()))
_stateless("log_amount", ["log_amount"], lambda t: amounts.amount_columns(amounts.number()))
_stateless("amount_bins", ["amount_bins"], lambda t: amounts.amount_columns(amounts.number()))
_stateless(
    "calendar_features",
    ["day_of_year", "week_of_year", "month", "quarter", "day_of_month"],
    lambda t: dates.calendar_columns(dates.timestamp(t)),
)
_stateless("month_period", ["month_period"], lambda t: dates.calendar_columns(dates.timestamp(t)))
_stateless("weekend_features", ["days_to_weekend", "is_weekend"], lambda t: dates.calendar_columns(dates.timestamp(t)))
_stateless("has_state_code", ["has_state_code"], lambda t: {"has_state_code": text.has_state_code(text.description())})
_stateless(
    "text_stats",
    [c for c in SQL_COLUMNS if c.startswith("description_")],
    lambda t: text.text_stats(text.description()),
)
_stateless("keyword_flags", list(K.KEYWORD_PATTERNS), lambda t: text.keyword_flags(text.description()))
_stateless(
    "subscription_and_entertainment",
    ["is_subscription_keyword", "entertainment_keyword_count", "is_entertainment_merchant"],
    lambda t: text.extended_flags(text.description()),
)
_stateless(
    "amount_flags",
    ["amount_roundness", "is_common_subscription_amount", "is_high_value", "is_low_value"],
    lambda t: amounts.extended_columns(amounts.number()),
)


@query(
    "keyword_flags_literal_case",
    duck(
        "SELECT transaction_id, "
        + ", ".join(
            SQL_COLUMNS[c].replace("(?i)", "").replace("regexp_matches(d,", "regexp_matches(upper(coalesce(description, '')),")
            + f" AS {c}"
            for c in K.KEYWORD_PATTERNS
        )
        + " FROM txn"
    ),
)
def _keyword_flags_literal(spark, sf_dir):
    flags = text.keyword_flags(text.description(), literal_case=True)
    return txn(spark, sf_dir).select(K.ID, *[c.alias(n) for n, c in flags.items()])


@query(
    "time_of_day",
    duck(
        f"""WITH timed AS (SELECT bool_or(CAST(date AS TIME) <> TIME '00:00:00') AS timed FROM txn)
        SELECT transaction_id, {", ".join(f"{SQL_EXTENDED[c]} AS {c}" for c in ("hour", "is_lunch_hour", "is_dinner_hour", "is_business_hours"))}
        FROM txn CROSS JOIN timed"""
    ),
)
def _time_of_day(spark, sf_dir):
    rows = txn(spark, sf_dir)
    date = dates.timestamp(rows)
    columns = dates.time_columns(date, dates.any_time_of_day(rows, date))
    return rows.select(K.ID, *[c.alias(n) for n, c in columns.items()])


@query(
    "text_stats_documents",
    r"""SELECT doc_id,
      CAST(len(regexp_extract_all(text, '[^\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) AS BIGINT) AS description_word_count,
      CAST(length(text) AS BIGINT) AS description_char_count,
      CAST(len(regexp_extract_all(text, '\p{Nd}')) AS BIGINT) AS description_digit_count,
      CAST(len(regexp_extract_all(text, '[^\p{L}\p{N}_\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')) AS BIGINT) AS description_special_char_count
      FROM documents""",
)
def _text_stats_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stats = text.text_stats(text.description("text"))
    return docs.select("doc_id", *[c.alias(n) for n, c in stats.items()])


@query("amount_percentile", feature_sql("amount_percentile"))
def _amount_percentile(spark, sf_dir):
    rows = txn(spark, sf_dir)
    return ft.amount_percentile(rows)(rows).select(K.ID, "amount_percentile")


@query("id_gap", feature_sql("time_since_last_transaction", "transaction_gap"))
def _id_gap(spark, sf_dir):
    rows = ft.with_sequence_columns(txn(spark, sf_dir))
    return rows.select(K.ID, "time_since_last_transaction", "transaction_gap")


@query("txn_number_in_day", feature_sql("transaction_count_per_day", "transaction_number_in_day"))
def _txn_number_in_day(spark, sf_dir):
    rows = ft.with_sequence_columns(txn(spark, sf_dir))
    return rows.select(K.ID, "transaction_count_per_day", "transaction_number_in_day")


@query("category_codes", duck(f"WITH {SQL_CODED} SELECT transaction_id, code AS category_code FROM coded"))
def _category_codes(spark, sf_dir):
    return encoding.with_class_codes(txn(spark, sf_dir)).select(K.ID, "category_code")


@query("target_encode_kfold", duck(f"WITH {SQL_OOF} SELECT transaction_id, store_name_target_enc FROM enc"))
def _target_encode_kfold(spark, sf_dir):
    rows = encoding.target_encode_out_of_fold(txn(spark, sf_dir), fold=F.col(K.ID) % 5)
    return rows.select(K.ID, "store_name_target_enc")


@query(
    "target_encode_fit",
    duck(
        f"""WITH {SQL_CODED} SELECT store_name, round(avg(code), 6) AS mean, count(*) AS n,
        round((SELECT avg(code) FROM coded), 6) AS global_mean FROM coded GROUP BY store_name"""
    ),
)
def _target_encode_fit(spark, sf_dir):
    stats = encoding.fit_target_encoding(txn(spark, sf_dir))
    return stats.stores.withColumn("global_mean", F.lit(stats.global_mean))


# Fitted without some merchants and one label, so that scoring meets unseen merchants.
@query(
    "target_encode_apply",
    duck(
        f"""WITH {SQL_CODED}, fit AS (SELECT * FROM coded WHERE category <> 'Travel' AND store_name < 'N')
        SELECT c.transaction_id, round(coalesce(m.mean, (SELECT avg(code) FROM fit)), 6) AS store_name_target_enc
        FROM coded c LEFT JOIN (SELECT store_name, avg(code) AS mean FROM fit GROUP BY 1) m USING (store_name)"""
    ),
)
def _target_encode_apply(spark, sf_dir):
    rows = txn(spark, sf_dir)
    train = with_merchant(rows).where((F.col(K.TARGET) != "Travel") & (F.col("store_name") < "N"))
    scored = encoding.apply_target_encoding(rows.drop(K.TARGET), encoding.fit_target_encoding(train))
    return scored.select(K.ID, "store_name_target_enc")


_inputs_sql = "transaction_id, description, round(amount, 6) AS amount, day_of_week, category, store_name, store_name_target_enc"


@query(
    "feature_table",
    duck(f"WITH {SQL_OOF} SELECT {_inputs_sql}, " + ", ".join(f"{e} AS {c}" for c, e in SQL_COLUMNS.items()) + " FROM enc"),
)
def _feature_table(spark, sf_dir):
    rows = txn(spark, sf_dir).select(*K.REQUIRED_TRAIN_COLUMNS)
    return ft.feature_table(rows, fold=F.col(K.ID) % 5).drop("date")


@query(
    "feature_table_extended",
    duck(
        f"""WITH {SQL_OOF}, timed AS (SELECT bool_or(CAST(date AS TIME) <> TIME '00:00:00') AS timed FROM txn)
        SELECT {_inputs_sql}, """
        + ", ".join(f"{e} AS {c}" for c, e in (SQL_COLUMNS | SQL_EXTENDED).items())
        + " FROM enc CROSS JOIN timed"
    ),
)
def _feature_table_extended(spark, sf_dir):
    rows = txn(spark, sf_dir).select(*K.REQUIRED_TRAIN_COLUMNS)
    return ft.feature_table(rows, fold=F.col(K.ID) % 5, extended=True).drop("date")


# Scoring path: no target in the input, encoding looked up from statistics fitted elsewhere.
@query(
    "feature_table_scoring",
    duck(
        f"""WITH {SQL_CODED}, m AS (SELECT store_name, avg(code) AS mean FROM coded GROUP BY 1)
        SELECT transaction_id, store_name, round(mean, 6) AS store_name_target_enc,
        {SQL_COLUMNS['store_frequency']} AS store_frequency, {SQL_COLUMNS['is_recurring']} AS is_recurring
        FROM coded JOIN m USING (store_name)"""
    ),
)
def _feature_table_scoring(spark, sf_dir):
    rows = txn(spark, sf_dir).select(*K.REQUIRED_TRAIN_COLUMNS)
    table = ft.feature_table(rows.drop(K.TARGET), stats=encoding.fit_target_encoding(rows))
    return table.select(K.ID, "store_name", "store_name_target_enc", "store_frequency", "is_recurring")

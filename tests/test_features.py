import math

import pytest
from pyspark.sql import functions as F

from ledgerspark import constants as K
from ledgerspark.functions import amounts, dates, text
from ledgerspark.functions.merchants import with_merchant
from ledgerspark.operators import encoding
from ledgerspark.plans.feature_table import feature_table

LIVE_COLUMNS = [
    "store_name", "store_name_target_enc", "store_frequency", "is_recurring", "is_round_amount", "decimal_digits",
    "amount_percentile", "day_of_year", "week_of_year", "month_period", "days_to_weekend", "is_weekend", "month",
    "quarter", "day_of_month", "has_state_code", "time_since_last_transaction", "transaction_count_per_day",
    "transaction_gap", "transaction_number_in_day", "description_word_count", "description_char_count",
    "description_digit_count", "description_special_char_count", "log_amount", "amount_bins", *K.KEYWORD_PATTERNS,
]


def rows_by_id(df):
    return {r["transaction_id"]: r for r in df.collect()}


def test_basic_table(make):
    df = make([
        (1, "2023-01-01", "AMAZON MARKETPLACE", 25.50, "Sunday"),
        (2, "2023-01-02", "WHOLE FOODS STORE", 42.75, "Monday"),
        (3, "2023-01-03", "UBER TRIP", 15.20, "Tuesday"),
    ])
    table = feature_table(df)
    assert set(df.columns) | set(LIVE_COLUMNS) == set(table.columns)
    rows = rows_by_id(table)
    assert [rows[i]["store_name"] for i in (1, 2, 3)] == ["MARKETPLACE", "WHOLE FOODS", "UBER"]
    assert [rows[i]["is_round_amount"] for i in (1, 2, 3)] == [0, 0, 0]
    assert [rows[i]["decimal_digits"] for i in (1, 2, 3)] == [1, 2, 1]
    assert [rows[i]["description_word_count"] for i in (1, 2, 3)] == [2, 3, 2]
    assert [rows[i]["amount_bins"] for i in (1, 2, 3)] == ["medium", "medium", "small"]
    assert rows[3]["amount_percentile"] == pytest.approx(1 / 3)
    assert rows[1]["week_of_year"] == 52 and rows[1]["is_weekend"] == 1 and rows[1]["days_to_weekend"] == 0
    assert [rows[i]["transaction_gap"] for i in (1, 2, 3)] == [0, 1, 1]
    assert rows[1]["store_name_target_enc"] == 0.0
    assert rows[3]["has_transport_keyword"] == 1 and rows[2]["has_grocery_keyword"] == 1


def test_missing_values(make):
    df = make([(1, "2023-01-01", None, None, "Monday"), (2, None, "VALID DESCRIPTION", 10.0, None)])
    rows = rows_by_id(feature_table(df, extended=True))
    assert rows[1]["store_name"] == "UNKNOWN" and rows[1]["description_word_count"] == 0
    assert rows[1]["is_round_amount"] == 1 and rows[1]["decimal_digits"] == 0 and rows[1]["amount_bins"] == "unknown"
    assert rows[1]["amount_percentile"] is None and rows[1]["log_amount"] is None
    assert rows[1]["is_high_value"] == 0 and rows[1]["is_low_value"] == 0
    assert rows[2]["store_name"] == "VALID" and rows[2]["amount_percentile"] == 1.0
    assert rows[2]["month"] == 0 and rows[2]["month_period"] == "unknown" and rows[2]["week_of_year"] == 0
    assert rows[2]["transaction_count_per_day"] == 1
    assert rows[1]["hour"] == 12 and rows[1]["is_business_hours"] == 1


def test_empty_and_missing_columns(spark, make):
    empty = make([(1, "2023-01-01", "A", 1.0, "Monday")]).where("transaction_id < 0")
    assert feature_table(empty).count() == 0
    with pytest.raises(ValueError, match="amount"):
        feature_table(empty.select("transaction_id", "date"))


@pytest.mark.parametrize("description, store", [
    ("SQ *WHOLE FOODS STORE", "WHOLE FOODS STORE"),
    ("SQ *WHOLE FOODS MARKET", "WHOLE FOODS MARKET"),
    ("AMAZON MKTP US*1234567", "MKTP US"),
    ("AMAZON MARKETPLACE", "MARKETPLACE"),
    ("AMAZON", "AMAZON"),
    ("AMAZON A", "AMAZON"),
    ("WHOLE FOODS STORE", "WHOLE FOODS"),
    ("UBER TRIP 123456", "UBER"),
    ("LYFT RIDE FARE", "LYFT"),
    ("REGULAR STORE NAME", "REGULAR"),
    ("WALMART SUPERCENTER", "WALMART"),
    ("CVS PHARMACY #1234", "CVS"),
    ("WMT #22 SUPERCENTER", "22 SUPERCENTER"),
    ("*** IRS TAX PAYMENT", "UNKNOWN"),
    ("", "UNKNOWN"),
    (None, "UNKNOWN"),
    ("   padded\tname", "PADDED"),
    ("whole   foods", "WHOLE FOODS"),
    ("ÉUBER TRIP", "ÉUBER"),
    ("X" * 60, "X" * 40),
])
def test_merchants(make, description, store):
    assert with_merchant(make([(1, "2023-01-01", description, 1.0, "Sunday")])).first()["store_name"] == store


def test_text_counts_on_other_scripts(spark):
    import re

    samples = ["Café №5 – 東京 １２３", "عدد ٤٥ نص", "naïve space wide", "x​y a_b-c", "", "tab\tline\nend"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, description string")
    stats = text.text_stats(text.description())
    got = {r["i"]: r for r in df.select("i", *[c.alias(n) for n, c in stats.items()]).collect()}
    for i, s in enumerate(samples):
        assert got[i]["description_word_count"] == len(s.split()), s
        assert got[i]["description_char_count"] == len(s), s
        assert got[i]["description_digit_count"] == len(re.findall(r"\d", s)), s
        assert got[i]["description_special_char_count"] == len(re.findall(r"[^\w\s]", s)), s


def test_decimal_digits_match_formatted_text(spark):
    values = [15.2, 25.0, 0.1 + 0.2, 123456.78, 1234567.89, 99999999.99, -3.25, 0.0, 1e-11, 4194304.1, None]
    df = spark.createDataFrame([(v,) for v in values], "amount double")
    got = [r[0] for r in df.select(amounts.decimal_digits(F.col("amount"))).collect()]
    want = [0 if v is None else len(f"{v:.10f}".rstrip("0").split(".")[1]) for v in values]
    assert got == want


def test_amount_edges(make):
    df = make([(i, "2023-01-01", "A", v, "Sunday") for i, v in enumerate([25.0, 25.01, 100.0, 100.01, -5.0, float("nan")])])
    rows = rows_by_id(feature_table(df))
    assert [rows[i]["amount_bins"] for i in range(6)] == ["small", "medium", "medium", "large", "small", "unknown"]
    assert rows[4]["log_amount"] == 0.0 and rows[5]["is_round_amount"] == 1
    assert rows[0]["log_amount"] == pytest.approx(math.log1p(25))


def test_percentile_ties_and_null_month(make):
    df = make([
        (1, "2023-01-05", "A", 10.0, "Thursday"), (2, "2023-01-06", "A", 10.0, "Friday"),
        (3, "2023-01-07", "A", 30.0, "Saturday"), (4, "2023-02-07", "A", 5.0, "Tuesday"),
        (5, None, "A", 7.0, None), (6, None, "A", 8.0, None), (7, "2023-01-09", "A", None, "Monday"),
    ])
    got = {i: r["amount_percentile"] for i, r in rows_by_id(feature_table(df)).items()}
    assert got == pytest.approx({1: 0.5, 2: 0.5, 3: 1.0, 4: 1.0, 5: 0.5, 6: 1.0, 7: None})


def test_recurring_counts_missing_amounts_together(make):
    df = make([
        (1, "2023-01-01", "SHOP A", None, "Sunday"), (2, "2023-01-01", "SHOP B", None, "Sunday"),
        (3, "2023-01-01", "SHOP", 5.0, "Sunday"), (4, "2023-01-01", "OTHER", 5.0, "Sunday"),
    ])
    rows = rows_by_id(feature_table(df))
    assert [rows[i]["is_recurring"] for i in (1, 2, 3, 4)] == [1, 1, 0, 0]
    assert [rows[i]["store_frequency"] for i in (1, 2, 3, 4)] == [3, 3, 3, 1]


def test_text_dates_are_coerced(spark):
    df = spark.createDataFrame(
        [(1, "nonsense", "A", 1.0, "Monday"), (2, "2024-03-01", "B", 2.0, "Friday")],
        "transaction_id long, date string, description string, amount double, day_of_week string",
    )
    rows = rows_by_id(feature_table(df))
    assert rows[1]["month"] == 0 and rows[2]["month"] == 3


def test_keywords_match_inside_words_and_literal_case_never_does(make):
    df = make([(1, "2023-01-01", "Shoe Repair", 1.0, "Sunday")])
    assert feature_table(df).first()["has_travel_keyword"] == 1
    assert feature_table(df, literal_case=True).first()["has_travel_keyword"] == 0


def test_day_of_week_helper(make):
    df = make([(1, "2024-02-29", "A", 1.0, None), (2, None, "A", 1.0, None)]).drop("day_of_week")
    assert [r["day_of_week"] for r in dates.with_day_of_week(df).orderBy("transaction_id").collect()] == ["Thursday", None]


# ---- target encoding ------------------------------------------------------------------------------------
def labelled(make):
    stores = ["ALPHA", "ALPHA", "BETA", "ALPHA", "BETA", "GAMMA", "ALPHA", "DELTA", "ALPHA", "BETA", "GAMMA", "ALPHA"]
    kinds = ["Travel", "Groceries", "Travel", None, "Shopping", "Shopping", "Groceries", "Travel", "Travel", None, "Shopping", "Groceries"]
    return make([(i, "2023-01-01", s, float(i), "Sunday", c) for i, (s, c) in enumerate(zip(stores, kinds))])


def test_out_of_fold_encoding_against_the_fold_by_fold_definition(make):
    df = labelled(make)
    got = rows_by_id(encoding.target_encode_out_of_fold(df, fold=F.col("transaction_id") % 5))
    rows = [(r["transaction_id"], r["description"], r["category"]) for r in df.collect()]
    order = sorted({c for _, _, c in rows if c})
    code = {i: order.index(c) if c else -1 for i, _, c in rows}
    present = [v for v in code.values() if v >= 0]
    overall = sum(present) / len(present)
    for i, store, _ in rows:
        others = [code[j] for j, s, _ in rows if s == store and j % 5 != i % 5]
        want = (sum(others) + 10 * overall) / (len(others) + 10)
        assert got[i]["store_name_target_enc"] == pytest.approx(want)


def test_tiny_tables_leave_one_out(make):
    df = make([(i, "2023-01-01", "SHOP", 1.0, "Sunday", c) for i, c in enumerate(["A", "B", "C"])])
    got = rows_by_id(encoding.target_encode_out_of_fold(df))
    assert [got[i]["store_name_target_enc"] for i in range(3)] == pytest.approx([13 / 12, 12 / 12, 11 / 12])
    single = encoding.target_encode_out_of_fold(df.where("transaction_id = 2")).first()
    assert single["store_name_target_enc"] == 0.0


def test_fit_and_apply_encoding(make):
    df = labelled(make)
    stats = encoding.fit_target_encoding(df)
    new = make([(100, "2023-01-01", "GAMMA", 1.0, "Sunday"), (101, "2023-01-01", "NEVER SEEN", 1.0, "Sunday")])
    rows = rows_by_id(encoding.apply_target_encoding(new, stats))
    assert rows[100]["store_name_target_enc"] == pytest.approx(1.0)
    assert rows[101]["store_name_target_enc"] == pytest.approx(stats.global_mean)
    assert encoding.apply_target_encoding(new, None).first()["store_name_target_enc"] == 0.0
    with pytest.raises(ValueError):
        encoding.fit_target_encoding(df.drop("category"))


def test_fit_on_a_training_subset(make):
    df = labelled(make)
    table = feature_table(df, fit_on=df.where("transaction_id < 6"))
    rows = rows_by_id(table)
    assert rows[0]["store_frequency"] == 3 and rows[7]["store_frequency"] == 0
    stats = encoding.fit_target_encoding(df.where("transaction_id < 6"))
    assert rows[7]["store_name_target_enc"] == pytest.approx(stats.global_mean)


def test_label_codes_sorted_null_unknown_and_unseen(make):
    df = with_merchant(make([(i, "2023-01-01", s, 1.0, d) for i, (s, d) in enumerate([("B", "Monday"), ("A", None), ("C", "Friday")])]))
    codes = encoding.fit_label_codes(df, ["store_name", "day_of_week"])
    rows = rows_by_id(encoding.apply_label_codes(df, codes, ["store_name", "day_of_week"]))
    assert [rows[i]["store_name"] for i in range(3)] == [1.0, 0.0, 2.0]
    assert [rows[i]["day_of_week"] for i in range(3)] == [1.0, 2.0, 0.0]
    unseen = with_merchant(make([(9, "2023-01-01", "ZZZ", 1.0, "Monday")]))
    assert encoding.apply_label_codes(unseen, codes, ["store_name"]).first()["store_name"] == -1.0


def test_class_column_with_too_many_labels_is_refused(spark, monkeypatch):
    monkeypatch.setattr(encoding, "MAX_CLASSES", 3)
    df = spark.range(10).select(F.col("id").cast("string").alias("category"))
    with pytest.raises(ValueError, match="labels"):
        encoding.class_labels(df, "category")


def test_stop_words_are_those_of_spark():
    from pyspark.ml.feature import StopWordsRemover

    from ledgerspark import constants

    assert sorted(constants.STOP_WORDS) == sorted(StopWordsRemover.loadDefaultStopWords("english"))

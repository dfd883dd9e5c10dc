"""Where predictions go wrong: slices, examples and rules, over a table with actual and predicted labels."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerspark import constants as K
from ledgerspark.functions import amounts, dates, text
from ledgerspark.operators.evaluation import ACTUAL, COUNTED, PREDICTED, size
from ledgerspark.storage import materialize


def is_error() -> Column:
    return ~F.col(ACTUAL).eqNullSafe(F.col(PREDICTED))


def slice_rates(df: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """Rows, errors and error rate of each named condition, in one pass; rate 0 for an empty slice."""
    counted = df.agg(
        *[size(df, c).alias(f"n{i}") for i, c in enumerate(slices.values())],
        *[size(df, c & is_error()).alias(f"e{i}") for i, c in enumerate(slices.values())],
    )
    entries = [
        F.struct(
            F.lit(name).alias("slice"),
            F.col(f"n{i}").alias("n_rows"),
            F.col(f"e{i}").alias("n_errors"),
            F.coalesce(F.try_divide(F.col(f"e{i}"), F.col(f"n{i}")), F.lit(0.0)).alias("error_rate"),
        )
        for i, name in enumerate(slices)
    ]
    return counted.select(F.inline(F.array(*entries)))


#: Named conditions of a row, as bits of one number in counted tables.
MASK = "__slices"


def _terms(df: DataFrame) -> dict[str, Column]:
    words = text.description()
    return {name: text.has_term(words, terms) for name, terms in K.AMBIGUOUS_TERMS.items()}


def _amounts(df: DataFrame) -> dict[str, Column]:
    amount = amounts.number()
    whole = F.coalesce(F.pmod(amount, F.lit(1.0)) == 0, F.lit(False))
    return {"round_amount_over_500": whole & F.coalesce(amount > 500, F.lit(False)), "decimal_amount": ~whole}


def _times(df: DataFrame) -> dict[str, Column]:
    date = dates.timestamp(df)
    slices = {
        "month_start": F.dayofmonth(date) <= 10,
        "month_end": F.dayofmonth(date) >= 21,
        "weekend": F.weekday(date) >= 5,
    }
    return {k: F.coalesce(c, F.lit(False)) for k, c in slices.items()}


_SLICES = (_terms, _amounts, _times)
_NAMES = [*K.AMBIGUOUS_TERMS, "round_amount_over_500", "decimal_amount", "month_start", "month_end", "weekend"]


def _slices(df: DataFrame, make) -> dict[str, Column]:
    """Conditions from the row itself, or from the bits of a counted table."""
    if MASK not in df.columns:
        return make(df)
    names = {_terms: _NAMES[:-5], _amounts: _NAMES[-5:-3], _times: _NAMES[-3:]}[make]
    return {name: F.col(MASK).bitwiseAND(F.lit(1 << _NAMES.index(name))) != 0 for name in names}


def slice_mask(df: DataFrame) -> Column:
    """All named conditions of a row as bits of one number."""
    conditions = {name: c for make in _SLICES for name, c in make(df).items()}
    return reduce(add, [F.when(conditions[name], F.lit(1 << i)).otherwise(0) for i, name in enumerate(_NAMES)])


def errors_by_keyword(df: DataFrame) -> DataFrame:
    return slice_rates(df, _slices(df, _terms))


def keyword_distribution(df: DataFrame) -> DataFrame:
    """Actual labels of the rows that mention each ambiguous term."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in _slices(df, _terms).items()]))
    rows = [COUNTED] if COUNTED in df.columns else []
    each = df.select(F.explode(found).alias("slice"), ACTUAL, *rows)
    return each.groupBy("slice", ACTUAL).agg(size(each).alias("n_rows"))


def errors_by_amount(df: DataFrame) -> DataFrame:
    """Whole amounts over 500, and amounts with decimals; a missing amount counts as decimal."""
    return slice_rates(df, _slices(df, _amounts))


def errors_by_time(df: DataFrame) -> DataFrame:
    return slice_rates(df, _slices(df, _times))


def errors_by_store(df: DataFrame, n: int = 30, min_rows: int = 5) -> DataFrame:
    """Merchants with the highest error rates; ties by name."""
    stores = df.groupBy("store_name").agg(size(df).alias("n_rows"), size(df, is_error()).alias("n_errors"))
    rated = stores.where(F.col("n_rows") >= min_rows).withColumn("error_rate", F.col("n_errors") / F.col("n_rows"))
    return rated.orderBy(F.desc("error_rate"), "store_name").limit(n)


def misclassified_examples(df: DataFrame, n: int = 10, fold: str = "fold") -> DataFrame:
    """The first ``n`` wrong rows of every label, as missed or as wrongly assigned, by fold and id."""
    wrong = df.where(is_error()).withColumn("label", F.explode(F.array(ACTUAL, PREDICTED)))
    order = Window.partitionBy("label").orderBy(fold, K.ID)
    placed = wrong.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
    return placed.select("label", "position", K.ID, "description", ACTUAL, PREDICTED, "amount", fold)


def facets(df: DataFrame) -> dict[str, Column]:
    """What wrong rows are told apart by: amount bucket, weekday, one-off or repeat merchant."""
    amount = amounts.number()
    return {
        "amount": F.when(amount < 25, "low").when(amount < 100, "medium").when(amount >= 100, "high"),
        "day_of_week": F.col("day_of_week").cast("string"),
        "store_frequency": F.when(F.col("store_frequency") == 1, "single").when(F.col("store_frequency") > 1, "repeat"),
    }


def misclassified_profile(df: DataFrame) -> DataFrame:
    """Wrong rows by amount bucket (below 25, below 100, above), weekday, and one-off or repeat merchant."""
    is_counted = COUNTED in df.columns
    values = {name: F.col(f"__{name}") for name in ("amount", "day_of_week", "store_frequency")} if is_counted else facets(df)
    entries = F.array(*[F.struct(F.lit(name).alias("facet"), value.alias("value")) for name, value in values.items()])
    rows = df.where(is_error()).select(F.inline(entries), *([COUNTED] if is_counted else [])).where("value is not null")
    return rows.groupBy("facet", "value").agg(size(rows).alias("n_rows"))


# ---- all counts of a report ------------------------------------------------------------------------------------
#: The groupings that the sections of an error report need.
GROUPINGS = {
    "confusion": ["fold", ACTUAL, PREDICTED],
    "slices": [MASK, ACTUAL, PREDICTED],
    "stores": ["store_name", "__wrong"],
    "facets": ["__amount", "__day_of_week", "__store_frequency", "__wrong"],
}


def tally(oof: DataFrame) -> dict[str, DataFrame]:
    """Every count of an error report from one pass over the predictions: one aggregate over several groupings, written
    once.  Each part is a counted table that the functions of this module and of ``evaluation`` take for the rows."""
    rows = oof.select(
        "fold", ACTUAL, PREDICTED, "store_name", is_error().alias("__wrong"), slice_mask(oof).alias(MASK),
        *[F.when(is_error(), value).alias(f"__{name}") for name, value in facets(oof).items()],
    )
    keys = list(dict.fromkeys(k for part in GROUPINGS.values() for k in part))
    sets = [[F.col(k) for k in part] for part in GROUPINGS.values()]
    part = F.grouping_id(*[F.col(k) for k in keys]).alias("__part")
    counted = materialize(rows.groupingSets(sets, *[F.col(k) for k in keys]).agg(part, F.count(F.lit(1)).alias(COUNTED)), "tally")

    def of(name: str) -> DataFrame:
        number = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in GROUPINGS[name])
        found = counted.where(F.col("__part") == number).select(*GROUPINGS[name], COUNTED)
        if "__wrong" in GROUPINGS[name]:  # labels that say no more than whether they differ
            found = found.withColumns({ACTUAL: F.lit("1"), PREDICTED: F.when(F.col("__wrong"), "0").otherwise("1")}).drop("__wrong")
        return found

    return {name: of(name) for name in GROUPINGS}


def suggest_rules(df: DataFrame) -> DataFrame:
    """Two fixed rules, and one per mapped keyword whose rows are wrong more than one time in ten."""
    fixed = [
        F.struct(F.lit(i).alias("position"), *[F.lit(v).alias(c) for c, v in zip(("rule", "suggested_category", "reason"), rule)])
        for i, rule in enumerate(K.FIXED_RULES)
    ]
    always = df.sparkSession.range(1).select(F.inline(F.array(*fixed)))
    names = list(K.KEYWORD_RULES)
    category = F.create_map(*[F.lit(x) for pair in K.KEYWORD_RULES.items() for x in pair])
    actionable = errors_by_keyword(df).where(
        F.col("slice").isin(names) & (F.col("n_rows") > 0) & (F.col("error_rate") > K.KEYWORD_RULE_MIN_ERROR_RATE)
    )
    learned = actionable.select(
        (F.array_position(F.array(*[F.lit(x) for x in names]), F.col("slice")) + (len(fixed) - 1)).cast("int").alias("position"),
        F.concat(F.upper("slice"), F.lit(K.KEYWORD_RULE_SUFFIX)).alias("rule"),
        category[F.col("slice")].alias("suggested_category"),
        F.concat(
            F.lit(K.KEYWORD_RULE_REASON[0]),
            F.format_string("%.2f%%", F.col("error_rate") * 100),
            F.lit(K.KEYWORD_RULE_REASON[1]),
        ).alias("reason"),
    )
    return always.unionByName(learned)


def rule_category(rules: list[tuple[list[str], str]]) -> Column:
    """Category of the first rule one of whose terms occurs as a whole word; null if none does."""
    words = text.description()
    chosen = F.lit(None).cast("string")
    for terms, category in reversed(rules):
        chosen = F.when(text.has_term(words, terms), F.lit(category)).otherwise(chosen)
    return chosen


DEFAULT_RULES = [(["irs", "tax"], "Bills & Utilities"), (["uber", "lyft"], "Transportation")] + [
    (K.AMBIGUOUS_TERMS[name], category) for name, category in K.KEYWORD_RULES.items()
]


def apply_rules(df: DataFrame, rules: list[tuple[list[str], str]] | None = None, out: str = PREDICTED) -> DataFrame:
    """Overrule predictions where a rule matches."""
    return df.withColumn(out, F.coalesce(rule_category(rules or DEFAULT_RULES), F.col(PREDICTED)))

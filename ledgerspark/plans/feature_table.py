"""The feature table: one row per transaction, inputs first, then every engineered column.

Columns that depend on other rows come in two steps.  First their statistics are computed from the input
table and written; these jobs are independent and run at the same time.  Then the statistics are looked up,
all in one plan, whose only shuffle of whole rows is the one that establishes the id order.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, functions as F

from ledgerspark import constants as K
from ledgerspark.functions import amounts, dates, text
from ledgerspark.functions.merchants import with_merchant
from ledgerspark.operators import encoding
from ledgerspark.operators.ordering import with_gap, with_ranges, with_row_number
from ledgerspark.operators.quantiles import average_rank_shares, with_rank_share
from ledgerspark.operators.quality import require_columns
from ledgerspark.operators.recurrence import join_recurring, repeated_pairs
from ledgerspark.storage import lookup, materialize, sized

Step = Callable[[DataFrame], DataFrame]


def with_sequence_columns(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Add the id gap and the running number per calendar day, both in id order, from one shuffle."""
    rows = df.count() if rows is None else rows
    dated = df.withColumn("__day", F.to_date(dates.timestamp(df)))
    ranged, n = with_ranges(dated, K.ID, rows)
    placed = with_gap(ranged, K.ID, "time_since_last_transaction", ranges=n)
    placed = with_row_number(placed, K.ID, "transaction_count_per_day", by=["__day"], ranges=n)
    return placed.drop("__range", "__day").withColumns(
        {
            "transaction_gap": F.col("time_since_last_transaction"),
            "transaction_number_in_day": F.col("transaction_count_per_day"),
        }
    )


def amount_percentile(df: DataFrame) -> Step:
    """Prepare the rank of the amount among all amounts of its calendar month."""
    out, value, month = "amount_percentile", amounts.number(), dates.month_key(dates.timestamp(df))
    shares = average_rank_shares(df, value, month, out)
    return lambda rows: with_rank_share(rows, shares, value, month, out, K.ID)


def store_columns(
    df: DataFrame,
    target: str = K.TARGET,
    stats: encoding.EncodingStats | None = None,
    fold: Column | None = None,
    fit_on: DataFrame | None = None,
) -> Step:
    """Prepare merchant, frequency, recurrence and target encoding.

    One aggregate over (merchant, amount, fold) feeds all three; ``fit_on`` restricts what it sees to a
    training subset.
    """
    encode = target in df.columns
    seen = df if fit_on is None else fit_on
    labels = encoding.class_labels(seen, target) if encode else []
    assigned = encoding.fold_assignment(df, fold) if encode else F.lit(0)
    code = encoding.code_of(F.col(target), labels).cast("double") if encode else F.lit(0.0)
    keyed = with_merchant(seen).select(
        K.ID,
        "store_name",
        amounts.pair_amount(amounts.number()).alias("__pair_amount"),
        assigned.alias("__fold"),
        code.alias("__code"),
    )
    parts = materialize(encoding.fold_parts(keyed, ["__pair_amount"]), "parts")
    repeated = repeated_pairs(parts.groupBy("store_name", "__pair_amount").agg(F.sum("n").alias("n")))
    if encode and fit_on is None:
        table, keys = encoding.out_of_fold_table(parts), ["store_name", "__fold"]
        values = ["store_frequency", "store_name_target_enc"]
    else:
        totals = parts.groupBy("store_name").agg(F.sum("n_ids").alias("store_frequency"), F.sum("n").alias("n"))
        table, keys, values = sized(materialize(totals, "stores"), "n"), ["store_name"], ["store_frequency"]
        if encode:
            stats = encoding.fit_target_encoding(fit_on, target)

    def attach(rows: DataFrame) -> DataFrame:
        named = with_merchant(rows).withColumn("__fold", assigned)
        named = lookup(named, table, keys, values, spread_by=K.ID, weight="n").drop("__fold")
        if len(values) == 1:
            named = encoding.apply_target_encoding(named, stats)
        named = join_recurring(named, repeated)
        return named.withColumn("store_frequency", F.coalesce("store_frequency", F.lit(0)))

    return attach


def stateless_columns(
    df: DataFrame, extended: bool = False, literal_case: bool = False, has_time: bool | None = None
) -> dict[str, Column]:
    """Every column that needs only its own row."""
    words, amount, date = text.description(), amounts.number(), dates.timestamp(df)
    columns = {
        **amounts.amount_columns(amount),
        **dates.calendar_columns(date),
        "has_state_code": text.has_state_code(words),
        **text.text_stats(words),
        **text.keyword_flags(words, literal_case),
    }
    if extended:
        timed = dates.any_time_of_day(df, date) if has_time is None else has_time
        columns |= {
            **text.extended_flags(words),
            **amounts.extended_columns(amount),
            **dates.time_columns(date, timed),
        }
    return columns


def feature_table(
    df: DataFrame,
    target: str = K.TARGET,
    stats: encoding.EncodingStats | None = None,
    extended: bool = False,
    literal_case: bool = False,
    fold: Column | None = None,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """All engineered columns.  Ids must be unique and non-null; they define the row order.

    With the target present, merchants are encoded out of fold (``fold`` overrides the hashed assignment);
    without it, fitted ``stats`` are looked up.
    """
    require_columns(df, K.REQUIRED_COLUMNS)
    with ThreadPoolExecutor(max_workers=3) as pool:
        sequence = pool.submit(with_sequence_columns, df)
        stores = pool.submit(store_columns, df, target, stats, fold, fit_on)
        percentile = pool.submit(amount_percentile, df)
        rows = percentile.result()(stores.result()(sequence.result()))
    return rows.withColumns(stateless_columns(df, extended, literal_case))

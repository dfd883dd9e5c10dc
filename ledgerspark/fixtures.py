"""Transaction-shaped views over the ``events`` table, written once as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerspark import constants as K
from ledgerspark.storage import materialize

_LABELS = """CASE {0} WHEN 0 THEN 'Food & Dining' WHEN 1 THEN 'Groceries' WHEN 2 THEN 'Transportation'
               WHEN 3 THEN 'Entertainment' WHEN 4 THEN 'Shopping' WHEN 5 THEN 'Bills & Utilities'
               WHEN 6 THEN 'Health & Fitness' WHEN 7 THEN 'Miscellaneous' WHEN 8 THEN 'Subscriptions'
               ELSE 'Travel' END"""

TXN = f"""
SELECT transaction_id, date, description, amount, day_of_week,
       {_LABELS.format('ci')} AS category, {_LABELS.format('pi')} AS predicted, ci, pi
FROM (SELECT *, CASE WHEN transaction_id % 9 = 0 THEN (ci + 1) % 10
                     WHEN transaction_id % 14 = 0 THEN (ci + 4) % 10 ELSE ci END AS pi
      FROM (SELECT event_id AS transaction_id, ts AS date,
                   CASE WHEN event_id % 89 = 5 THEN NULL
                        WHEN event_id % 11 = 0 THEN round(value, 0)
                        WHEN event_id % 13 = 0 THEN 9.99e0 ELSE value END AS amount,
                   CASE __DOW__ WHEN 0 THEN 'Monday' WHEN 1 THEN 'Tuesday' WHEN 2 THEN 'Wednesday'
                              WHEN 3 THEN 'Thursday' WHEN 4 THEN 'Friday' WHEN 5 THEN 'Saturday'
                              ELSE 'Sunday' END AS day_of_week,
                   CASE WHEN (event_id * 31) % 17 = 0 THEN CAST((event_id + 3) % 10 AS INT)
                        ELSE CAST(event_id % 10 AS INT) END AS ci,
                   CASE WHEN event_id % 97 = 3 THEN NULL ELSE
                   CASE CAST((event_id * 7) % 16 AS INT)
                     WHEN 0 THEN 'SQ *WHOLE FOODS MARKET'
                     WHEN 1 THEN concat('AMAZON MKTP US*', CAST(1000000 + event_id AS STRING))
                     WHEN 2 THEN concat('Uber Trip ', CAST(user_id AS STRING))
                     WHEN 3 THEN 'Lyft ride fare'
                     WHEN 4 THEN 'CVS PHARMACY #1234, TX'
                     WHEN 5 THEN 'paypal transfer'
                     WHEN 6 THEN 'WMT #22 SUPERCENTER'
                     WHEN 7 THEN 'Delta airline booking'
                     WHEN 8 THEN 'NETFLIX.COM monthly subscription'
                     WHEN 9 THEN '  Corner cafe   (IN)  '
                     WHEN 10 THEN 'AMC MOVIE THEATER SHOW'
                     WHEN 11 THEN 'SQUARE *Joe''s Pizza & Co. - NY'
                     WHEN 12 THEN 'AMAZON'
                     WHEN 13 THEN '*** IRS TAX PAYMENT'
                     WHEN 14 THEN 'SHELL OIL 5744'
                     ELSE 'Target #0042' END END AS description
            FROM events) a) b
"""

_MONTH = (
    "CASE month(date) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' WHEN 4 THEN 'April' WHEN 5 THEN 'May' "
    "WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August' WHEN 9 THEN 'September' WHEN 10 THEN 'October' "
    "WHEN 11 THEN 'November' ELSE 'December' END"
)

# Text columns as a raw file would hold them: mixed date formats, bad values, blanks, an unknown label.
TXN_RAW = """
SELECT transaction_id,
       CASE WHEN transaction_id % 211 = 0 THEN 'not a date'
            WHEN transaction_id % 307 = 1 THEN NULL
            WHEN transaction_id % 37 = 5
              THEN concat(substr(__MONTH__, 1, 3), ' ', CAST(day(date) AS STRING), ', ', CAST(year(date) AS STRING))
            WHEN transaction_id % 41 = 6 THEN concat(CAST(day(date) AS STRING), ' ', __MONTH__, ' ', CAST(year(date) AS STRING))
            WHEN transaction_id % 43 = 7
              THEN concat(lpad(CAST(month(date) AS STRING), 2, '0'), '/', lpad(CAST(day(date) AS STRING), 2, '0'), '/',
                          CAST(year(date) AS STRING), ' ', lpad(CAST(hour(date) AS STRING), 2, '0'), ':',
                          lpad(CAST(minute(date) AS STRING), 2, '0'))
            WHEN transaction_id % 47 = 8
              THEN concat(CAST(year(date) AS STRING), '-', lpad(CAST(month(date) AS STRING), 2, '0'), '-',
                          lpad(CAST(day(date) AS STRING), 2, '0'), ' ', lpad(CAST(hour(date) AS STRING), 2, '0'), ':00:07')
            WHEN transaction_id % 3 = 0
              THEN concat(CAST(year(date) AS STRING), '-', lpad(CAST(month(date) AS STRING), 2, '0'), '-',
                          lpad(CAST(day(date) AS STRING), 2, '0'))
            WHEN transaction_id % 3 = 1
              THEN concat(lpad(CAST(month(date) AS STRING), 2, '0'), '/', lpad(CAST(day(date) AS STRING), 2, '0'),
                          '/', CAST(year(date) AS STRING))
            ELSE concat(CAST(year(date) AS STRING), '/', lpad(CAST(month(date) AS STRING), 2, '0'), '/',
                        lpad(CAST(day(date) AS STRING), 2, '0')) END AS date,
       CASE WHEN transaction_id % 19 = 4 AND description IS NOT NULL THEN concat('  ', description, ' ') ELSE description END AS description,
       CASE WHEN transaction_id % 53 = 0 THEN 'n/a' WHEN transaction_id % 59 = 3 THEN '12f'
            WHEN transaction_id % 61 = 5 THEN '0x1p3' WHEN transaction_id % 67 = 2 THEN '1d'
            WHEN transaction_id % 71 = 4 THEN '12.5.1' ELSE CAST(amount AS STRING) END AS amount,
       day_of_week,
       CASE WHEN transaction_id % 101 = 7 THEN 'Crypto' WHEN transaction_id % 103 = 9 THEN NULL
            ELSE category END AS category
FROM txn
""".replace("__MONTH__", _MONTH)

_PROBS = """
SELECT transaction_id, k, w * 1e0 / sum(w) OVER (PARTITION BY transaction_id) AS p
FROM (SELECT t.transaction_id, k.k,
             (1 + (t.transaction_id * (k.k + 3) * {0}) % 23 + CASE WHEN k.k = t.pi THEN 25 ELSE 0 END) AS w
      FROM txn t CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) AS k(k)) q
"""
PROBS_FACTOR, PROBS_B_FACTOR = 37, 41


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(TXN.replace("__DOW__", "weekday(ts)").replace("FROM events", "FROM {events}"), events=events)


def txn_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TXN_RAW.replace("FROM txn", "FROM {txn}"), txn=txn(spark, sf_dir))


def probs(spark: SparkSession, sf_dir: str, factor: int = PROBS_FACTOR) -> DataFrame:
    """``txn`` ids with labels and an array of class probabilities in the order of ``CATEGORIES``.

    Written as a table, as the output of a model would be.
    """

    def weight(k: int) -> Column:
        noise = (F.col(K.ID) * F.lit((k + 3) * factor)) % 23
        return F.lit(1) + noise + F.when(F.col("pi") == k, 25).otherwise(0)

    weights = [weight(k) for k in range(len(K.CATEGORIES))]
    rows = txn(spark, sf_dir).withColumn("total", reduce(add, weights).cast("double"))
    shares = F.array(*[w.cast("double") / F.col("total") for w in weights])
    return materialize(rows.select(K.ID, K.TARGET, "ci", "pi", shares.alias("probabilities")), "probs")


def duck(query: str, *tables: str) -> str:
    """Prefix a DuckDB query with the views it needs."""
    views = {
        "txn": TXN.replace("__DOW__", "(isodow(ts)-1)"),
        "txn_raw": TXN_RAW,
        "probs": _PROBS.format(PROBS_FACTOR),
        "probs_b": _PROBS.format(PROBS_B_FACTOR),
    }
    ctes = [f"{name} AS ({views[name]})" for name in dict.fromkeys(("txn", *tables))]
    body = query.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {', '.join(ctes)}, {body[5:]}"
    return f"WITH {', '.join(ctes)} {body}"

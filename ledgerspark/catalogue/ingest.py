"""Source, sink, quality, sampling and profile queries."""

from __future__ import annotations

import io
import lzma
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ledgerspark import constants as K
from ledgerspark.catalogue.base import query
from ledgerspark.fixtures import duck, txn, txn_raw
from ledgerspark.functions import dates
from ledgerspark.operators import profile, quality, sampling
from ledgerspark.plans import ingest
from ledgerspark.sources import cache, files, sinks
from ledgerspark.storage import scratch_path

WRITE = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
RAW_SQL = """SELECT transaction_id, date, description, round(TRY_CAST(amount AS DOUBLE), 6) AS amount, day_of_week, category
FROM txn_raw"""


def written_csv(spark, sf_dir, **options) -> str:
    path = scratch_path(spark, "csv")
    txn_raw(spark, sf_dir).write.options(**WRITE, **options).csv(path)
    return path


@query("src_csv", duck(RAW_SQL, "txn_raw"))
def _src_csv(spark, sf_dir):
    return files.typed(files.read_csv(spark, written_csv(spark, sf_dir)))


@query("src_csv_compressed", duck(f"{RAW_SQL} UNION ALL {RAW_SQL}", "txn_raw"))
def _src_csv_compressed(spark, sf_dir):
    parts = [files.read_csv(spark, written_csv(spark, sf_dir, compression=c)) for c in ("gzip", "bzip2")]
    return files.typed(parts[0].unionByName(parts[1]))


def packed_csv(spark, sf_dir):
    """Raw rows as files that tasks have packed, ``path, content``: zip files with two members, and xz files."""
    quoted = [F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')) for c in K.REQUIRED_TRAIN_COLUMNS]
    line = F.concat(F.lit('"'), F.concat_ws('","', *quoted), F.lit('"'))
    rows = txn_raw(spark, sf_dir).select(line.alias("line"), (F.col(K.ID) % 3).alias("part"))
    header = ",".join(K.REQUIRED_TRAIN_COLUMNS)

    def pack(frames):
        for frame in frames:
            texts = ["\n".join([header, *frame["line"][frame["part"] == i], ""]) for i in range(3)]
            packed = io.BytesIO()
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("inside/", "")
                archive.writestr("inside/one.csv", texts[0])
                archive.writestr("two.csv", texts[1])
            yield pd.DataFrame({"path": ["a.csv.zip", "b.csv.xz"], "content": [packed.getvalue(), lzma.compress(texts[2].encode())]})

    return rows.mapInPandas(pack, "path string, content binary")


@query("src_csv_archived", duck(RAW_SQL, "txn_raw"))
def _src_csv_archived(spark, sf_dir):
    return files.typed(files.parse_archives(packed_csv(spark, sf_dir), K.REQUIRED_TRAIN_COLUMNS))


@query(
    "src_csv_quoted_newlines",
    duck(
        f"""SELECT transaction_id, replace(description, 'a', concat('a', chr(10))) AS description, amount
        FROM ({RAW_SQL}) WHERE description IS NOT NULL""",
        "txn_raw",
    ),
)
def _src_csv_quoted_newlines(spark, sf_dir):
    path = scratch_path(spark, "csv-breaks")
    broken = F.replace("description", F.lit("a"), F.lit("a\n"))
    rows = txn_raw(spark, sf_dir).where("description is not null").withColumn("description", broken)
    rows.write.options(**WRITE, quoteAll=True).csv(path)
    return files.read_transactions(spark, path).select(K.ID, "description", "amount")


@query("cache_after_partial_load", duck("SELECT count(*) AS n_rows, 3::BIGINT AS n_partial, sum(transaction_id)::BIGINT AS id_sum FROM txn_raw", "txn_raw"))
def _cache_after_partial_load(spark, sf_dir):
    source, cached = written_csv(spark, sf_dir), scratch_path(spark, "cache")
    partial = ingest.load_transactions(spark, source, cache=cached, nrows=3).count()
    whole = ingest.load_transactions(spark, source, cache=cached)
    return whole.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(partial).alias("n_partial"), F.sum(K.ID).alias("id_sum"))


@query("src_parquet", "SELECT event_id, user_id, event_type, round(value, 6) AS value FROM events")
def _src_parquet(spark, sf_dir):
    return files.read_transactions(spark, f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "value")


def written_in_two_encodings(spark, sf_dir) -> list[str]:
    rows = txn(spark, sf_dir).select(K.ID, F.concat(F.lit("Café · "), "day_of_week").alias("description"))
    folder = scratch_path(spark, "encodings")
    rows.where(F.col(K.ID) % 2 == 0).write.options(**WRITE).csv(f"{folder}/a")
    rows.where(F.col(K.ID) % 2 == 1).write.options(**WRITE, encoding="ISO-8859-1").csv(f"{folder}/b")
    return [f"{folder}/a", f"{folder}/b"]


@query("src_encoding_read", duck("SELECT transaction_id, concat('Café · ', day_of_week) AS description FROM txn"))
def _src_encoding_read(spark, sf_dir):
    return files.typed(files.read_csv_any_encoding(spark, written_in_two_encodings(spark, sf_dir)))


@query(
    "src_encoding_probe",
    duck(
        """SELECT CASE WHEN transaction_id % 2 = 0 THEN 'UTF-8' ELSE 'ISO-8859-1' END AS encoding, count(*) AS n_rows
        FROM txn GROUP BY 1"""
    ),
)
def _src_encoding_probe(spark, sf_dir):
    probed = files.probe_encodings(spark, written_in_two_encodings(spark, sf_dir))
    return probed.groupBy("encoding").agg(F.sum(F.col("n_lines") - 1).alias("n_rows"))


@query(
    "cache_parquet",
    duck(
        """SELECT transaction_id, coalesce(trim(description), '') AS description, category FROM txn_raw""",
        "txn_raw",
    ),
)
def _cache_parquet(spark, sf_dir):
    source, cached = scratch_path(spark, "raw"), scratch_path(spark, "cache")
    txn_raw(spark, sf_dir).write.parquet(source)

    def build():
        return quality.clean_text(spark.read.parquet(source))

    cache.cached_table(spark, source, cached, build)
    if not cache.is_cache_valid(spark, cached, source):
        raise ValueError("a fresh cache must be valid")
    return cache.cached_table(spark, source, cached, build).select(K.ID, "description", K.TARGET)


@query(
    "load_metadata",
    duck(
        """SELECT column_name, n_missing, n_rows, 6::BIGINT AS n_columns FROM (SELECT count(*) AS n_rows,
        count(*) - count(transaction_id) AS transaction_id, count(*) - count(date) AS date,
        count(*) - count(description) AS description, count(*) - count(amount) AS amount,
        count(*) - count(day_of_week) AS day_of_week, count(*) - count(category) AS category FROM txn)
        UNPIVOT (n_missing FOR column_name IN (transaction_id, date, description, amount, day_of_week, category))"""
    ),
)
def _load_metadata(spark, sf_dir):
    source = scratch_path(spark, "source")
    txn(spark, sf_dir).select(K.REQUIRED_TRAIN_COLUMNS).write.parquet(source)
    table = files.read_transactions(spark, source + "/*.parquet")
    sections = cache.load_metadata(spark, table, source)
    if sections["files"].where("length(md5) = 32").isEmpty():
        raise ValueError("files must be hashed")
    load = sections["load"].first()
    return sections["columns"].select(
        "column_name", "n_missing", F.lit(load["n_rows"]).alias("n_rows"), F.lit(load["n_columns"]).alias("n_columns")
    )


@query("sink_predictions_csv", duck("SELECT transaction_id, predicted AS category FROM txn"))
def _sink_predictions_csv(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    sinks.write_predictions(txn(spark, sf_dir), path, "predicted")
    return files.typed(files.read_csv(spark, path))


@query(
    "prediction_distribution",
    duck("SELECT predicted, count(*) AS n_rows FROM txn GROUP BY predicted"),
)
def _prediction_distribution(spark, sf_dir):
    return sinks.prediction_distribution(txn(spark, sf_dir), "predicted")


@query(
    "sink_report_json",
    duck(
        """SELECT category, count(*) AS n_rows, round(sum(amount), 6) AS total,
        strftime(min(date), '%Y-%m-%d %H:%M:%S') AS first_date FROM txn GROUP BY category"""
    ),
)
def _sink_report_json(spark, sf_dir):
    path = scratch_path(spark, "report")
    section = txn(spark, sf_dir).groupBy(K.TARGET).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("amount").alias("total"), F.min("date").alias("first_date")
    )
    sinks.write_report({"by_category": section, "missing": quality.null_counts(txn(spark, sf_dir))}, path)
    return spark.read.schema(section.schema).json(f"{path}/by_category")


@query(
    "dq_required_columns",
    duck("SELECT count(*) AS n_rows, 'category' AS missing_from_test FROM txn"),
)
def _dq_required_columns(spark, sf_dir):
    train = quality.require_valid(txn(spark, sf_dir))
    missing = sorted(set(K.REQUIRED_TRAIN_COLUMNS) - set(train.drop(K.TARGET).columns))
    return train.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("missing_from_test", F.lit(",".join(missing)))


@query(
    "dq_amount_coerce",
    duck(
        """SELECT count(*) AS n_rows, count(*) FILTER (WHERE amount IS NULL) AS n_missing,
        count(*) FILTER (WHERE amount IS NOT NULL AND TRY_CAST(amount AS DOUBLE) IS NULL) AS n_failed,
        round(sum(TRY_CAST(amount AS DOUBLE)), 6) AS total_amount FROM txn_raw""",
        "txn_raw",
    ),
)
def _dq_amount_coerce(spark, sf_dir):
    return quality.amount_coercion_report(txn_raw(spark, sf_dir))


@query(
    "dq_unexpected_categories",
    duck(
        """SELECT category, count(*) AS n_rows FROM txn_raw WHERE category NOT IN ('Food & Dining', 'Groceries',
        'Transportation', 'Entertainment', 'Shopping', 'Bills & Utilities', 'Health & Fitness', 'Miscellaneous',
        'Subscriptions', 'Travel') GROUP BY category""",
        "txn_raw",
    ),
)
def _dq_unexpected_categories(spark, sf_dir):
    return quality.unexpected_categories(txn_raw(spark, sf_dir))


@query(
    "dq_fill_missing",
    duck(
        """SELECT transaction_id, coalesce(description, '') AS description,
        round(coalesce(amount, (SELECT median(amount) FROM txn)), 6) AS amount FROM txn"""
    ),
)
def _dq_fill_missing(spark, sf_dir):
    return quality.fill_missing(txn(spark, sf_dir)).select(K.ID, "description", "amount")


@query(
    "dq_fill_report",
    duck(
        """SELECT count(*) - count(amount) AS amounts_filled, count(*) - count(description) AS descriptions_filled
        FROM txn"""
    ),
)
def _dq_fill_report(spark, sf_dir):
    return quality.fill_report(txn(spark, sf_dir))


SQL_PARSED = """parsed AS (SELECT transaction_id, coalesce(
  try_strptime(date, '%Y-%m-%d'), try_strptime(date, '%m/%d/%Y'), try_strptime(date, '%d/%m/%Y'),
  try_strptime(date, '%Y/%m/%d'), try_strptime(date, '%b %d, %Y'), try_strptime(date, '%d %B %Y'),
  try_strptime(date, '%m/%d/%Y %H:%M'), try_strptime(date, '%Y-%m-%d %H:%M:%S')) AS mixed, try_strptime(date, '%Y-%m-%d') AS f1, try_strptime(date, '%m/%d/%Y') AS f2,
  try_strptime(date, '%d/%m/%Y') AS f3, try_strptime(date, '%Y/%m/%d') AS f4 FROM txn_raw)"""


@query(
    "dq_parse_dates",
    duck(f"WITH {SQL_PARSED} SELECT transaction_id, strftime(mixed, '%Y-%m-%d %H:%M:%S') AS date FROM parsed", "txn_raw"),
)
def _dq_parse_dates(spark, sf_dir):
    return quality.parse_dates(txn_raw(spark, sf_dir)).select(K.ID, "date")


@query(
    "dq_date_formats",
    duck(
        f"""WITH {SQL_PARSED}, r AS (SELECT avg(CASE WHEN mixed IS NULL THEN 1.0 ELSE 0 END) AS f0,
        avg(CASE WHEN f1 IS NULL THEN 1.0 ELSE 0 END) AS f1, avg(CASE WHEN f2 IS NULL THEN 1.0 ELSE 0 END) AS f2,
        avg(CASE WHEN f3 IS NULL THEN 1.0 ELSE 0 END) AS f3, avg(CASE WHEN f4 IS NULL THEN 1.0 ELSE 0 END) AS f4
        FROM parsed)
        SELECT CAST(0 AS BIGINT) AS position, 'mixed' AS format, round(f0, 6) AS null_ratio FROM r
        UNION ALL SELECT 1, 'yyyy-M-d', round(f1, 6) FROM r UNION ALL SELECT 2, 'M/d/yyyy', round(f2, 6) FROM r
        UNION ALL SELECT 3, 'd/M/yyyy', round(f3, 6) FROM r UNION ALL SELECT 4, 'yyyy/M/d', round(f4, 6) FROM r""",
        "txn_raw",
    ),
)
def _dq_date_formats(spark, sf_dir):
    return quality.date_format_report(txn_raw(spark, sf_dir))


@query(
    "dq_clean_text",
    duck(
        r"""SELECT transaction_id, regexp_replace(coalesce(description, ''), '^\s+|\s+$', '', 'g') AS description,
        coalesce(trim(date), '') AS date, coalesce(trim(amount), '') AS amount, trim(category) AS category
        FROM txn_raw""",
        "txn_raw",
    ),
)
def _dq_clean_text(spark, sf_dir):
    return quality.clean_text(txn_raw(spark, sf_dir)).select(K.ID, "description", "date", "amount", K.TARGET)


@query(
    "narrow_types",
    duck("SELECT transaction_id, round(CAST(CAST(amount AS FLOAT) AS DOUBLE), 6) AS amount FROM txn"),
)
def _narrow_types(spark, sf_dir):
    return quality.narrow_types(txn(spark, sf_dir)).select(K.ID, "amount")


SQL_MISSING = "CAST(" + " + ".join(
    f"(count(*) - count({c}))" for c in K.REQUIRED_TRAIN_COLUMNS
) + " AS BIGINT)"
SQL_BALANCE = "(SELECT count(*) AS k, round(max(n) * 1.0 / min(n), 6) AS ratio FROM (SELECT count(*) AS n FROM txn GROUP BY category))"


@query(
    "dq_load_summary",
    duck(
        f"""WITH b AS {SQL_BALANCE} SELECT count(*) AS n_rows, {SQL_MISSING} AS n_missing, any_value(k) AS n_classes,
        any_value(ratio) AS imbalance_ratio, CAST(any_value(ratio) > 10 AS BIGINT) AS is_imbalanced
        FROM txn CROSS JOIN b"""
    ),
)
def _dq_load_summary(spark, sf_dir):
    return quality.load_summary(txn(spark, sf_dir).select(K.REQUIRED_TRAIN_COLUMNS))


@query(
    "profile_basic",
    duck(
        f"""WITH c AS (SELECT count(*) AS n, count(transaction_id) AS transaction_id, count(date) AS date,
        count(description) AS description, count(amount) AS amount, count(day_of_week) AS day_of_week,
        count(category) AS category FROM txn)
        SELECT column_name, n - present AS n_missing, round((n - present) * 100.0 / n, 6) AS pct_missing,
        (SELECT ratio FROM {SQL_BALANCE}) AS imbalance_ratio
        FROM c UNPIVOT (present FOR column_name IN (transaction_id, date, description, amount, day_of_week, category))"""
    ),
)
def _profile_basic(spark, sf_dir):
    rows = txn(spark, sf_dir).select(K.REQUIRED_TRAIN_COLUMNS)
    ratio = quality.imbalance(rows).first()["imbalance_ratio"]
    return quality.null_counts(rows).select(
        "column_name", "n_missing", "pct_missing", F.lit(ratio).alias("imbalance_ratio")
    )


def _scattered():
    """An order that both engines can compute."""
    return (F.col(K.ID) * 7919) % 10007


SQL_ORDER = "(transaction_id * 7919) % 10007, transaction_id"


@query(
    "sample_stratified",
    duck(
        f"""WITH n AS (SELECT count(*) AS total FROM txn), r AS (
        SELECT transaction_id, category, row_number() OVER (PARTITION BY category ORDER BY {SQL_ORDER}) AS pos,
               count(*) OVER (PARTITION BY category) AS c FROM txn)
        SELECT transaction_id, category FROM r CROSS JOIN n
        WHERE pos <= greatest(1, floor(c * least(500, total) * 1.0 / total))"""
    ),
)
def _sample_stratified(spark, sf_dir):
    return sampling.sample_stratified(txn(spark, sf_dir), 500, order=_scattered()).select(K.ID, K.TARGET)


@query("sample_random", duck(f"SELECT transaction_id, category FROM txn ORDER BY {SQL_ORDER} LIMIT 500"))
def _sample_random(spark, sf_dir):
    return sampling.sample_random(txn(spark, sf_dir), 500, order=_scattered()).select(K.ID, K.TARGET)


@query(
    "profile_amount",
    duck(
        """SELECT round(avg(amount), 6) AS mean, round(median(amount), 6) AS median, round(stddev_samp(amount), 6) AS std,
        round(min(amount), 6) AS min, round(max(amount), 6) AS max, round(skewness(amount), 6) AS skewness FROM txn"""
    ),
)
def _profile_amount(spark, sf_dir):
    return profile.profile_amount(txn(spark, sf_dir))


SQL_DATES = """SELECT strftime(min(date), '%Y-%m-%d %H:%M:%S') AS "start", strftime(max(date), '%Y-%m-%d %H:%M:%S') AS "end",
        CAST(floor((epoch(max(date)) - epoch(min(date))) / 86400) AS BIGINT) AS days_span FROM txn"""


@query("profile_date_range", duck(SQL_DATES))
def _profile_date_range(spark, sf_dir):
    return profile.profile_date_range(txn(spark, sf_dir))


@query(
    "align_columns",
    duck(
        """SELECT transaction_id, description, round(amount, 6) AS amount, category, 1::BIGINT AS in_train FROM txn
        UNION ALL SELECT transaction_id, description, round(amount, 6), NULL, 0 FROM txn"""
    ),
)
def _align_columns(spark, sf_dir):
    rows = txn(spark, sf_dir)
    train, test = quality.align_columns(
        rows.select(K.ID, "description", "amount", "day_of_week", K.TARGET),
        rows.select("amount", "description", "ci", K.ID),
    )
    return train.withColumn("in_train", F.lit(1)).unionByName(test.withColumn("in_train", F.lit(0)), allowMissingColumns=True)


@query(
    "model_frame",
    duck(
        """SELECT transaction_id AS row_id, coalesce(description, '') AS description, round(amount, 6) AS amount,
        coalesce(day_of_week, 'unknown') AS day_of_week, CAST(month(date) AS VARCHAR) AS month FROM txn"""
    ),
)
def _model_frame(spark, sf_dir):
    rows = txn(spark, sf_dir).select(*K.REQUIRED_TRAIN_COLUMNS)
    rows = rows.withColumns({"month": F.month("date"), "row_id": F.col(K.ID)})
    return quality.model_frame(rows)


@query(
    "with_day_of_week",
    duck("SELECT transaction_id, dayname(date) AS day_of_week FROM txn"),
)
def _with_day_of_week(spark, sf_dir):
    return dates.with_day_of_week(txn(spark, sf_dir).drop("day_of_week")).select(K.ID, "day_of_week")


# The whole load job on a raw CSV file: amounts repaired, dates parsed, text cleaned.
@query(
    "load_transactions",
    duck(
        rf"""WITH {SQL_PARSED}, r AS (SELECT *, TRY_CAST(amount AS DOUBLE) AS a FROM txn_raw)
        SELECT r.transaction_id, strftime(p.mixed, '%Y-%m-%d %H:%M:%S') AS date,
        regexp_replace(coalesce(r.description, ''), '^\s+|\s+$', '', 'g') AS description,
        round(coalesce(a, (SELECT median(a) FROM r)), 6) AS amount, r.day_of_week, r.category
        FROM r JOIN parsed p USING (transaction_id)""",
        "txn_raw",
    ),
)
def _load_transactions(spark, sf_dir):
    return ingest.load_transactions(spark, written_csv(spark, sf_dir))


"""Evaluation, error-report, fold and probability queries.  The predictions are a column of the fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerspark import constants as K
from ledgerspark.catalogue.base import query
from ledgerspark.catalogue.features import SQL_STORE
from ledgerspark.fixtures import PROBS_B_FACTOR, duck, probs, txn
from ledgerspark.functions.merchants import with_merchant
from ledgerspark.operators import errors, evaluation, folds, probabilities as prob, recurrence, thresholds
from ledgerspark.operators.encoding import code_of, label_at
from ledgerspark.storage import materialize


def predictions(spark, sf_dir):
    return txn(spark, sf_dir).withColumn("actual", F.col(K.TARGET))


CLASSES = sorted(K.CATEGORIES)
SQL_P = "p AS (SELECT *, category AS actual FROM txn)"
SQL_LABELS = "labels AS (SELECT DISTINCT category AS label FROM txn UNION SELECT DISTINCT predicted FROM txn)"
SQL_METRICS = f"""{SQL_P}, {SQL_LABELS}, m AS (
  SELECT label, (SELECT count(*) FROM p WHERE actual = label) AS support,
         (SELECT count(*) FROM p WHERE predicted = label) AS claimed,
         (SELECT count(*) FROM p WHERE actual = label AND predicted = label) AS tp FROM labels),
metrics AS (SELECT label, support, support - tp AS false_negatives, claimed - tp AS false_positives,
  CASE WHEN claimed = 0 THEN 0e0 ELSE tp * 1e0 / claimed END AS "precision",
  CASE WHEN support = 0 THEN 0e0 ELSE tp * 1e0 / support END AS recall,
  CASE WHEN support + claimed = 0 THEN 0e0 ELSE 2e0 * tp / (support + claimed) END AS f1,
  (support + claimed - 2 * tp) * 1e0 / greatest(1, support) AS error_rate,
  CASE WHEN support + (support + claimed - 2 * tp) = 0 THEN 0e0
       ELSE (support + claimed - 2 * tp) * 1e0 / (support + (support + claimed - 2 * tp)) END AS error_share FROM m)"""
SQL_METRIC_COLUMNS = """label, support, false_negatives, false_positives, round("precision", 6) AS "precision",
  round(recall, 6) AS recall, round(f1, 6) AS f1, round(error_rate, 6) AS error_rate, round(error_share, 6) AS error_share"""
SQL_FOLDS = f"""{SQL_P}, o AS (SELECT *, row_number() OVER (ORDER BY transaction_id) - 1 AS idx, count(*) OVER () AS n FROM p),
f AS (SELECT *, CASE WHEN idx >= n - 5 * (n // 6) THEN (idx - (n - 5 * (n // 6))) // (n // 6) + 1 END AS fold FROM o)"""
SQL_FOLD_F1 = f"""{SQL_FOLDS}, v AS (SELECT * FROM f WHERE fold IS NOT NULL),
fl AS (SELECT DISTINCT fold, actual AS label FROM v UNION SELECT DISTINCT fold, predicted FROM v),
ft AS (SELECT fl.fold, fl.label, count(*) FILTER (WHERE v.actual = fl.label) AS support,
       count(*) FILTER (WHERE v.predicted = fl.label) AS claimed,
       count(*) FILTER (WHERE v.actual = fl.label AND v.predicted = fl.label) AS tp
       FROM fl JOIN v ON v.fold = fl.fold GROUP BY fl.fold, fl.label),
ff AS (SELECT fold, avg(2e0 * tp / (support + claimed)) AS macro_f1, CAST(sum(support) AS BIGINT) AS n_rows FROM ft GROUP BY fold)"""


@query(
    "confusion_raw",
    duck(
        f"""WITH {SQL_P}, {SQL_LABELS} SELECT a.label AS actual, b.label AS predicted, count(p.transaction_id) AS n
        FROM labels a CROSS JOIN labels b LEFT JOIN p ON p.actual = a.label AND p.predicted = b.label GROUP BY 1, 2"""
    ),
)
def _confusion_raw(spark, sf_dir):
    return evaluation.confusion_matrix(predictions(spark, sf_dir)).drop("rate")


@query(
    "confusion_normalized",
    duck(
        f"""WITH {SQL_P}, {SQL_LABELS}, c AS (SELECT a.label AS actual, b.label AS predicted, count(p.transaction_id) AS n
        FROM labels a CROSS JOIN labels b LEFT JOIN p ON p.actual = a.label AND p.predicted = b.label GROUP BY 1, 2)
        SELECT actual, predicted, round(CASE WHEN sum(n) OVER (PARTITION BY actual) = 0 THEN 0e0
        ELSE n * 1e0 / sum(n) OVER (PARTITION BY actual) END, 6) AS rate FROM c"""
    ),
)
def _confusion_normalized(spark, sf_dir):
    return evaluation.confusion_matrix(predictions(spark, sf_dir)).drop("n")


@query("per_class_metrics", duck(f"WITH {SQL_METRICS} SELECT {SQL_METRIC_COLUMNS} FROM metrics"))
def _per_class_metrics(spark, sf_dir):
    return evaluation.per_class_metrics(predictions(spark, sf_dir))


@query(
    "macro_f1",
    duck(f"WITH {SQL_METRICS} SELECT round(avg(f1), 6) AS macro_f1, CAST(sum(support) AS BIGINT) AS n_rows FROM metrics"),
)
def _macro_f1(spark, sf_dir):
    return evaluation.macro_f1(predictions(spark, sf_dir))


@query("lowest_f1_classes", duck(f"WITH {SQL_METRICS} SELECT {SQL_METRIC_COLUMNS} FROM metrics ORDER BY metrics.f1, label LIMIT 3"))
def _lowest_f1_classes(spark, sf_dir):
    return evaluation.lowest_f1_classes(predictions(spark, sf_dir))


@query(
    "error_rate_chart",
    duck(f"WITH {SQL_METRICS} SELECT label, round(error_share, 6) AS error_share, round(f1, 6) AS f1 FROM metrics"),
)
def _error_rate_chart(spark, sf_dir):
    return evaluation.error_rate_chart(predictions(spark, sf_dir))


@query("time_series_folds", duck(f"WITH {SQL_FOLDS} SELECT transaction_id, fold FROM f WHERE fold IS NOT NULL"))
def _time_series_folds(spark, sf_dir):
    rows = txn(spark, sf_dir)
    return folds.validated(rows, folds.fold_cuts(rows)).select(K.ID, "fold")


@query(
    "fold_sizes",
    duck(
        f"""WITH {SQL_FOLDS} SELECT g.fold, count(*) FILTER (WHERE f.idx < g.start) AS train_rows,
        count(*) FILTER (WHERE f.fold = g.fold) AS valid_rows
        FROM (SELECT fold, min(idx) AS start FROM f WHERE fold IS NOT NULL GROUP BY fold) g CROSS JOIN f GROUP BY g.fold"""
    ),
)
def _fold_sizes(spark, sf_dir):
    rows = txn(spark, sf_dir)
    return folds.fold_sizes(rows, folds.fold_cuts(rows))


def _validated(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return folds.validated(rows, folds.fold_cuts(rows))


@query("fold_macro_f1", duck(f"WITH {SQL_FOLD_F1} SELECT fold, round(macro_f1, 6) AS macro_f1, n_rows FROM ff"))
def _fold_macro_f1(spark, sf_dir):
    return evaluation.macro_f1(_validated(spark, sf_dir), ["fold"])


@query(
    "fold_summary",
    duck(
        f"""WITH {SQL_FOLD_F1} SELECT round(avg(macro_f1), 6) AS mean_f1, round(stddev_pop(macro_f1), 6) AS f1_std,
        CAST(sum(n_rows) AS BIGINT) AS n_rows FROM ff"""
    ),
)
def _fold_summary(spark, sf_dir):
    return evaluation.fold_summary(_validated(spark, sf_dir))


@query(
    "misclassified_examples",
    duck(
        f"""WITH {SQL_FOLDS}, w AS (SELECT actual AS label, * FROM f WHERE fold IS NOT NULL AND actual <> predicted
        UNION ALL SELECT predicted AS label, * FROM f WHERE fold IS NOT NULL AND actual <> predicted),
        r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY fold, transaction_id) AS position FROM w)
        SELECT label, position, transaction_id, description, actual, predicted, round(amount, 6) AS amount, fold
        FROM r WHERE position <= 10"""
    ),
)
def _misclassified_examples(spark, sf_dir):
    return errors.misclassified_examples(_validated(spark, sf_dir))


def _slices_sql(slices: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS slice, count(*) AS n_rows, count(*) FILTER (WHERE actual <> predicted) AS n_errors,
        round(coalesce(count(*) FILTER (WHERE actual <> predicted) * 1e0 / nullif(count(*), 0), 0), 6) AS error_rate
        FROM p WHERE {condition}"""
        for name, condition in slices.items()
    )


SQL_TERMS = {
    name: rf"regexp_matches(description, '(?i)\b({'|'.join(terms)})\b')" for name, terms in K.AMBIGUOUS_TERMS.items()
}


@query("errors_by_keyword", duck(f"WITH {SQL_P} {_slices_sql(SQL_TERMS)}"))
def _errors_by_keyword(spark, sf_dir):
    return errors.errors_by_keyword(predictions(spark, sf_dir))


@query(
    "keyword_distribution",
    duck(
        f"WITH {SQL_P} "
        + " UNION ALL ".join(
            f"SELECT '{name}' AS slice, actual, count(*) AS n_rows FROM p WHERE {c} GROUP BY actual"
            for name, c in SQL_TERMS.items()
        )
    ),
)
def _keyword_distribution(spark, sf_dir):
    return errors.keyword_distribution(predictions(spark, sf_dir))


@query(
    "errors_by_amount",
    duck(
        f"WITH {SQL_P} "
        + _slices_sql(
            {"round_amount_over_500": "amount % 1 = 0 AND amount > 500", "decimal_amount": "amount IS NULL OR amount % 1 <> 0"}
        )
    ),
)
def _errors_by_amount(spark, sf_dir):
    return errors.errors_by_amount(predictions(spark, sf_dir))


@query(
    "errors_by_time",
    duck(
        f"WITH {SQL_P} "
        + _slices_sql({"month_start": "day(date) <= 10", "month_end": "day(date) >= 21", "weekend": "isodow(date) >= 6"})
    ),
)
def _errors_by_time(spark, sf_dir):
    return errors.errors_by_time(predictions(spark, sf_dir))


@query(
    "errors_by_store",
    duck(
        f"""WITH {SQL_STORE} SELECT store_name, count(*) AS n_rows, count(*) FILTER (WHERE category <> predicted) AS n_errors,
        round(count(*) FILTER (WHERE category <> predicted) * 1e0 / count(*), 6) AS error_rate FROM s GROUP BY store_name
        HAVING count(*) >= 5
        ORDER BY count(*) FILTER (WHERE category <> predicted) * 1e0 / count(*) DESC, store_name LIMIT 30"""
    ),
)
def _errors_by_store(spark, sf_dir):
    return errors.errors_by_store(with_merchant(predictions(spark, sf_dir)))


@query(
    "suggest_rules",
    duck(
        f"""WITH {SQL_P}, k AS ({_slices_sql({n: SQL_TERMS[n] for n in K.KEYWORD_RULES})})
        SELECT 0::BIGINT AS position, 'IRS or TAX in description' AS rule, 'Bills & Utilities' AS suggested_category,
               'Tax-related payments are usually utilities or bills.' AS reason
        UNION ALL SELECT 1, 'UBER or LYFT in description', 'Transportation', 'Ride-share merchants are transport transactions.'
        UNION ALL SELECT CASE slice WHEN 'amazon' THEN 2 WHEN 'cvs' THEN 3 ELSE 4 END, concat(upper(slice), ' in description'),
          CASE slice WHEN 'amazon' THEN 'Shopping' WHEN 'cvs' THEN 'Health & Fitness' ELSE 'Travel' END,
          concat('Observed error rate is ', printf('%.2f', n_errors * 100e0 / n_rows), '%; merchant keyword is actionable.')
        FROM k WHERE n_rows > 0 AND n_errors * 1e0 / n_rows > 0.10"""
    ),
)
def _suggest_rules(spark, sf_dir):
    return errors.suggest_rules(predictions(spark, sf_dir))


@query(
    "apply_rules",
    duck(
        r"""SELECT transaction_id, CASE WHEN regexp_matches(description, '(?i)\b(irs|tax)\b') THEN 'Bills & Utilities'
        WHEN regexp_matches(description, '(?i)\b(uber|lyft)\b') THEN 'Transportation'
        WHEN regexp_matches(description, '(?i)\b(amazon|amzn)\b') THEN 'Shopping'
        WHEN regexp_matches(description, '(?i)\bcvs\b') THEN 'Health & Fitness'
        WHEN regexp_matches(description, '(?i)\bbooking\b') THEN 'Travel' ELSE predicted END AS predicted FROM txn"""
    ),
)
def _apply_rules(spark, sf_dir):
    return errors.apply_rules(predictions(spark, sf_dir)).select(K.ID, "predicted")


@query(
    "top_misclassifications",
    duck(
        """SELECT concat(category, ' → ', predicted) AS pattern, count(*) AS n FROM txn WHERE category <> predicted
        GROUP BY 1 ORDER BY n DESC, pattern LIMIT 10"""
    ),
)
def _top_misclassifications(spark, sf_dir):
    return evaluation.top_misclassifications(predictions(spark, sf_dir))


@query(
    "confused_pairs",
    duck(
        """SELECT concat(least(category, predicted), ' ↔ ', greatest(category, predicted)) AS pair, count(*) AS n
        FROM txn WHERE category <> predicted GROUP BY 1 ORDER BY n DESC, pair LIMIT 5"""
    ),
)
def _confused_pairs(spark, sf_dir):
    return evaluation.confused_pairs(predictions(spark, sf_dir))


@query(
    "misclassified_profile",
    duck(
        f"""WITH {SQL_STORE}, w AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY store_name) AS freq FROM s)
        WHERE category <> predicted)
        SELECT 'amount' AS facet, CASE WHEN amount < 25 THEN 'low' WHEN amount < 100 THEN 'medium' ELSE 'high' END AS value,
        count(*) AS n_rows FROM w WHERE amount IS NOT NULL GROUP BY 2
        UNION ALL SELECT 'day_of_week', day_of_week, count(*) FROM w GROUP BY 2
        UNION ALL SELECT 'store_frequency', CASE WHEN freq = 1 THEN 'single' ELSE 'repeat' END, count(*) FROM w GROUP BY 2"""
    ),
)
def _misclassified_profile(spark, sf_dir):
    return errors.misclassified_profile(recurrence.with_store_frequency(predictions(spark, sf_dir)))


# ---- probabilities --------------------------------------------------------------------------------------
SQL_ARGMAX = """a AS (SELECT transaction_id, arg_max(k, p) AS k0, max(p) AS p FROM probs GROUP BY 1),
best AS (SELECT a.transaction_id, min(q.k) AS k, any_value(a.p) AS p FROM a JOIN probs q
         ON q.transaction_id = a.transaction_id AND q.p = a.p GROUP BY 1)"""
WEIGHTS = {"Groceries": 0.5, "Entertainment": 2.0, "Travel": 1.5}
SQL_WEIGHT = "(CASE k WHEN 1 THEN 0.5e0 WHEN 3 THEN 2e0 WHEN 9 THEN 1.5e0 ELSE 1e0 END)"


@query(
    "predict_argmax",
    duck(f"WITH {SQL_ARGMAX} SELECT transaction_id, CAST(k AS BIGINT) AS k, round(p, 6) AS max_probability FROM best", "probs"),
)
def _predict_argmax(spark, sf_dir):
    p = F.col("probabilities")
    return probs(spark, sf_dir).select(K.ID, prob.argmax(p).alias("k"), F.array_max(p).alias("max_probability"))


# The model order is the listing of the categories without the last one; the shared order is alphabetical.
@query(
    "align_probabilities",
    duck(
        """SELECT t.transaction_id, CAST(g.k AS BIGINT) AS k, round(coalesce(q.p, 0), 6) AS p FROM txn t CROSS JOIN
        (SELECT category, ci, row_number() OVER (ORDER BY category) - 1 AS k FROM (SELECT DISTINCT category, ci FROM txn)) g
        LEFT JOIN probs q ON q.transaction_id = t.transaction_id AND q.k = g.ci AND g.ci < 9""",
        "probs",
    ),
)
def _align_probabilities(spark, sf_dir):
    rows = probs(spark, sf_dir)
    model = F.slice("probabilities", 1, len(K.CATEGORIES) - 1)
    aligned = rows.withColumn("probabilities", prob.align(model, K.CATEGORIES[:-1], CLASSES))
    return prob.to_long(aligned)


def _weighted_sql(op: str) -> str:
    return duck(
        f"""WITH s AS (SELECT transaction_id, k, p {op} {SQL_WEIGHT} AS v FROM probs),
        m AS (SELECT transaction_id, max(v) AS v FROM s GROUP BY 1)
        SELECT transaction_id, CAST(min(k) AS BIGINT) AS k FROM s JOIN m USING (transaction_id, v) GROUP BY 1""",
        "probs",
    )


def _apply_weights(op):
    def run(spark, sf_dir):
        weights = prob.class_weights_list(WEIGHTS, K.CATEGORIES)
        return probs(spark, sf_dir).select(K.ID, prob.argmax(prob.weighted(F.col("probabilities"), weights, op)).alias("k"))

    return run


query("apply_thresholds", _weighted_sql("*"))(_apply_weights("multiply"))
query("apply_thresholds_divide", _weighted_sql("/"))(_apply_weights("divide"))

SQL_ENSEMBLE = """e AS (SELECT a.transaction_id, a.k, 0.5e0 * a.p + 0.5e0 * b.p AS p FROM probs a
JOIN probs_b b ON a.transaction_id = b.transaction_id AND a.k = b.k)"""


def _ensemble(spark, sf_dir):
    return prob.ensemble(probs(spark, sf_dir), probs(spark, sf_dir, PROBS_B_FACTOR))


@query(
    "ensemble_average",
    duck(f"WITH {SQL_ENSEMBLE} SELECT transaction_id, CAST(k AS BIGINT) AS k, round(p, 6) AS p FROM e", "probs", "probs_b"),
)
def _ensemble_average(spark, sf_dir):
    return prob.to_long(_ensemble(spark, sf_dir))


# Macro F1 of both models and their mean, by fold, and what the mean gains over the first.
@query(
    "ensemble_fold_scores",
    duck(
        f"""WITH {SQL_FOLDS}, {SQL_ENSEMBLE}, every AS (SELECT 'first' AS model, * FROM probs UNION ALL
        SELECT 'second', * FROM probs_b UNION ALL SELECT 'ensemble', * FROM e),
        top AS (SELECT model, transaction_id, max(p) AS p FROM every GROUP BY 1, 2),
        pick AS (SELECT model, transaction_id, min(k) AS k FROM every JOIN top USING (model, transaction_id, p) GROUP BY 1, 2),
        v AS (SELECT model, fold, ci AS actual, k AS predicted FROM pick JOIN f USING (transaction_id) WHERE fold IS NOT NULL),
        l AS (SELECT DISTINCT model, fold, actual AS label FROM v UNION SELECT DISTINCT model, fold, predicted FROM v),
        c AS (SELECT l.model, l.fold, l.label, count(*) FILTER (WHERE actual = label) AS s, count(*) FILTER (WHERE predicted = label) AS q,
              count(*) FILTER (WHERE actual = label AND predicted = label) AS tp FROM l JOIN v USING (model, fold) GROUP BY 1, 2, 3),
        f1 AS (SELECT model, fold, avg(2e0 * tp / (s + q)) AS f FROM c GROUP BY 1, 2)
        SELECT fold, round(max(f) FILTER (WHERE model = 'first'), 6) AS first_f1,
        round(max(f) FILTER (WHERE model = 'second'), 6) AS second_f1,
        round(max(f) FILTER (WHERE model = 'ensemble'), 6) AS ensemble_f1,
        round(max(f) FILTER (WHERE model = 'ensemble') - max(f) FILTER (WHERE model = 'first'), 6) AS improvement
        FROM f1 GROUP BY fold""",
        "probs",
        "probs_b",
    ),
)
def _ensemble_fold_scores(spark, sf_dir):
    cuts = folds.fold_cuts(txn(spark, sf_dir))
    models = {
        "first": probs(spark, sf_dir),
        "second": probs(spark, sf_dir, PROBS_B_FACTOR),
        "ensemble": _ensemble(spark, sf_dir),
    }
    scored = None
    for name, df in models.items():
        labelled = folds.validated(df, cuts).select(
            F.lit(name).alias("model"),
            "fold",
            F.col(K.TARGET).alias("actual"),
            label_at(prob.argmax(F.col("probabilities")), K.CATEGORIES).alias("predicted"),
        )
        scored = labelled if scored is None else scored.unionByName(labelled)
    by_fold = evaluation.macro_f1(scored, ["model", "fold"]).groupBy("fold").pivot("model", list(models)).agg(F.first("macro_f1"))
    return by_fold.select(
        "fold",
        *[F.col(m).alias(f"{m}_f1") for m in models],
        (F.col("ensemble") - F.col("first")).alias("improvement"),
    )


GRID = [0.1, 0.25, 0.5, 0.8, 1.0, 1.25, 2.0, 4.0, 10.0]


def _indexed(spark, sf_dir):
    return probs(spark, sf_dir).select(code_of(F.col(K.TARGET), K.CATEGORIES).alias("actual_index"), "probabilities")


@query(
    "tune_thresholds_grid",
    duck(
        f"""WITH wide AS (SELECT transaction_id, list(p ORDER BY k) AS ps FROM probs GROUP BY 1),
        t AS (SELECT txn.ci AS actual, g.c, m.m, list_transform(ps, lambda p, i: CASE WHEN i - 1 = g.c THEN p * m.m ELSE p END) AS v
              FROM wide JOIN txn USING (transaction_id) CROSS JOIN (SELECT unnest(range(10)) AS c) g
              CROSS JOIN (SELECT unnest([{', '.join(f'{m}e0' for m in GRID)}]) AS m) m),
        n AS (SELECT c, m, actual, list_position(v, list_max(v)) - 1 AS predicted, count(*) AS n FROM t GROUP BY ALL),
        l AS (SELECT DISTINCT c, m, actual AS label FROM n UNION SELECT DISTINCT c, m, predicted FROM n),
        f AS (SELECT c, m, label, coalesce(sum(n) FILTER (WHERE actual = label), 0) AS s,
              coalesce(sum(n) FILTER (WHERE predicted = label), 0) AS q,
              coalesce(sum(n) FILTER (WHERE actual = label AND predicted = label), 0) AS tp FROM l JOIN n USING (c, m) GROUP BY 1, 2, 3)
        SELECT CAST(c AS BIGINT) AS class_index, m AS multiplier, round(avg(2e0 * tp / (s + q)), 6) AS macro_f1 FROM f GROUP BY c, m""",
        "probs",
    ),
)
def _tune_thresholds_grid(spark, sf_dir):
    return thresholds.grid_scores(_indexed(spark, sf_dir), [1.0] * len(K.CATEGORIES), GRID)


#: Steps of the ascent that the SQL spells out; once no change helps, a step changes nothing.
SQL_STEPS = 24


def _sql_step(step: int) -> str:
    """The best single change of one weight in state ``w{step - 1}``, as state ``w{step}``."""
    n = len(K.CATEGORIES)
    w, low, high = f"w{step - 1}", *(f"{b}e0" for b in K.MULTIPLIER_BOUNDS)
    f1 = " + ".join(f"f{k}" for k in range(n))
    seen = " + ".join(f"CAST(f{k} IS NOT NULL AS INT)" for k in range(n))
    moved = ", ".join(
        f"""p.q{k} + s.s{k} + CASE WHEN e.c = {k} THEN gone ELSE -out{k} END AS size{k}, p.h{k} + CASE WHEN e.c = {k} THEN won ELSE -lost{k} END AS hit{k}"""
        for k in range(n)
    )
    sums = ", ".join(
        f"""coalesce(sum(sum(n) FILTER (WHERE rival = {k})) OVER o, 0) AS out{k}, coalesce(sum(sum(n) FILTER (WHERE rival = {k} AND actual = {k})) OVER o, 0) AS lost{k}"""
        for k in range(n)
    )
    base = ", ".join(
        f"""coalesce(sum(n) FILTER (WHERE CASE WHEN ratio = 0 THEN c ELSE rival END = {k}), 0) AS q{k},
            coalesce(sum(n) FILTER (WHERE CASE WHEN ratio = 0 THEN c ELSE rival END = {k} AND actual = {k}), 0) AS h{k}"""
        for k in range(n)
    )
    return f"""
    r{step} AS MATERIALIZED (SELECT transaction_id, actual, k AS c, p AS own,
        max(v) OVER (PARTITION BY transaction_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS rival_score,
        arg_max({{'v': v, 'k': -k}}, {{'v': v, 'k': -k}}) OVER (PARTITION BY transaction_id ORDER BY k
            ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS top
        FROM (SELECT long.*, p * weights[k + 1] AS v FROM long, {w})),
    e{step} AS MATERIALIZED (SELECT c, CAST(-top.k AS INT) AS rival, actual, CASE WHEN own <= 0 THEN NULL WHEN rival_score / own <= {low} THEN 0
        WHEN rival_score / own < {high} THEN rival_score / own END AS ratio, count(*) AS n FROM r{step} GROUP BY ALL),
    p{step} AS MATERIALIZED (SELECT c, {base} FROM e{step} GROUP BY c),
    x{step} AS MATERIALIZED (SELECT c, ratio, {sums}, coalesce(sum(sum(n)) OVER o, 0) AS gone, coalesce(sum(sum(n) FILTER (WHERE actual = c)) OVER o, 0) AS won,
        lead(ratio) OVER (PARTITION BY c ORDER BY ratio) AS following
        FROM (SELECT * FROM e{step} WHERE ratio > 0 UNION ALL SELECT unnest(range({n})), -1, -1, {low}, 0) GROUP BY c, ratio
        WINDOW o AS (PARTITION BY c ORDER BY ratio)),
    m{step} AS MATERIALIZED (SELECT c, ratio, following, {moved} FROM x{step} e JOIN p{step} p USING (c), support s),
    f{step} AS (SELECT c, ratio, following, {', '.join(f'CASE WHEN size{k} > 0 THEN 2e0 * hit{k} / size{k} END AS f{k}' for k in range(n))} FROM m{step}),
    g{step} AS MATERIALIZED (SELECT c, ratio, following, round(({' + '.join(f'coalesce(f{k}, 0)' for k in range(n))}) / ({seen}), 12) AS f1 FROM f{step}),
    b{step} AS MATERIALIZED (SELECT c, f1, (ratio + coalesce(following, {high})) / 2 AS multiplier FROM g{step} ORDER BY f1 DESC, c, ratio LIMIT 1),
    w{step} AS MATERIALIZED (SELECT CASE WHEN b.f1 > w.f1 + 1e-9 THEN list_transform(weights, lambda x, i: CASE WHEN i = b.c + 1 THEN multiplier ELSE x END)
        ELSE weights END AS weights, CASE WHEN b.f1 > w.f1 + 1e-9 THEN b.f1 ELSE w.f1 END AS f1,
        w.steps + CASE WHEN b.f1 > w.f1 + 1e-9 THEN 1 ELSE 0 END AS steps FROM {w} w, b{step} b)"""


def _sql_tuning(steps: int) -> str:
    n = len(K.CATEGORIES)
    named = ", ".join("'" + c.replace("'", "''") + "'" for c in K.CATEGORIES)
    sizes = ", ".join(f"count(*) FILTER (WHERE actual = {k}) AS s{k}" for k in range(n))
    return f"""WITH long AS MATERIALIZED (SELECT transaction_id, CAST(txn.ci AS INT) AS actual, CAST(k AS INT) AS k, p FROM probs JOIN txn USING (transaction_id)),
        support AS MATERIALIZED (SELECT {sizes} FROM long WHERE k = 0),
        plain AS (SELECT transaction_id, actual, -max({{'v': p, 'k': -k}}).k AS predicted FROM long GROUP BY ALL),
        label AS (SELECT label, 2e0 * count(*) FILTER (WHERE actual = label AND predicted = label)
                    / (count(*) FILTER (WHERE actual = label) + count(*) FILTER (WHERE predicted = label)) AS f
                  FROM plain, (SELECT unnest(range({n})) AS label) GROUP BY label
                  HAVING count(*) FILTER (WHERE actual = label) + count(*) FILTER (WHERE predicted = label) > 0),
        w0 AS MATERIALIZED (SELECT list_transform(range({n}), lambda i: 1e0) AS weights, avg(f) AS f1, 0 AS steps FROM label),
        {', '.join(_sql_step(i) for i in range(1, steps + 1))}
        SELECT unnest([{named}]) AS label, round(unnest(w{steps}.weights), 6) AS multiplier, round(w0.f1, 6) AS raw_f1,
               round(w{steps}.f1, 6) AS tuned_f1, CAST(w{steps}.steps AS BIGINT) AS n_steps FROM w0, w{steps}"""


@query("tune_thresholds", duck(_sql_tuning(SQL_STEPS), "probs"))
def _tune_thresholds(spark, sf_dir):
    indexed = materialize(_indexed(spark, sf_dir), "indexed")
    weights, steps = thresholds.tune_weights(indexed, len(K.CATEGORIES))
    rows = [
        F.struct(F.lit(label).alias("label"), F.lit(w).alias("multiplier")) for label, w in zip(K.CATEGORIES, weights)
    ]
    return spark.range(1).select(F.inline(F.array(*rows))).withColumns(
        {"raw_f1": F.lit(steps[0]["macro_f1"]), "tuned_f1": F.lit(steps[-1]["macro_f1"]), "n_steps": F.lit(len(steps) - 1)}
    )

import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import errors, evaluation, probabilities as prob, thresholds


def scores(pairs):
    labels = sorted({x for p in pairs for x in p})
    out = {}
    for label in labels:
        tp = sum(a == p == label for a, p in pairs)
        support, claimed = sum(a == label for a, _ in pairs), sum(p == label for _, p in pairs)
        out[label] = 2 * tp / (support + claimed) if support + claimed else 0.0
    return out


@pytest.fixture
def pairs():
    rng = random.Random(1)
    return [(rng.choice("ABC"), rng.choice("ABCD")) for _ in range(200)]


@pytest.fixture
def table(spark, pairs):
    return spark.createDataFrame([(i, a, p, i % 3) for i, (a, p) in enumerate(pairs)], "transaction_id long, actual string, predicted string, fold int")


def test_scores_include_labels_only_predicted(table, pairs):
    want = scores(pairs)
    rows = {r["label"]: r for r in evaluation.per_class_metrics(table).collect()}
    assert {k: r["f1"] for k, r in rows.items()} == pytest.approx(want)
    assert rows["D"]["support"] == 0 and rows["D"]["recall"] == 0.0 and rows["D"]["f1"] == 0.0
    assert rows["D"]["error_rate"] == rows["D"]["false_positives"] and rows["D"]["error_share"] == 1.0
    assert evaluation.macro_f1_score(table) == pytest.approx(sum(want.values()) / 4)


def test_confusion_is_dense(table):
    cells = {(r["actual"], r["predicted"]): r for r in evaluation.confusion_matrix(table, ["A", "B", "C", "D", "E"]).collect()}
    assert len(cells) == 25 and cells["E", "A"]["n"] == 0 and cells["E", "A"]["rate"] == 0.0
    assert sum(r["rate"] for (a, _), r in cells.items() if a == "A") == pytest.approx(1.0)


def test_fold_summary_uses_population_deviation(table, pairs):
    by_fold = []
    for k in range(3):
        s = scores([p for i, p in enumerate(pairs) if i % 3 == k])
        by_fold.append(sum(s.values()) / len(s))
    mean = sum(by_fold) / 3
    row = evaluation.fold_summary(table).first()
    assert row["mean_f1"] == pytest.approx(mean) and row["n_rows"] == 200
    assert row["f1_std"] == pytest.approx((sum((x - mean) ** 2 for x in by_fold) / 3) ** 0.5)


def test_slices_without_rows_have_rate_zero(spark, make):
    df = make([(1, "2023-01-15", "plain", 10.5, "Sunday", "A")]).withColumns({"actual": F.lit("A"), "predicted": F.lit("B")})
    got = {r["slice"]: (r["n_rows"], r["error_rate"]) for r in errors.errors_by_keyword(df).collect()}
    assert got["cvs"] == (0, 0.0) and len(got) == 6
    assert [r["position"] for r in errors.suggest_rules(df).collect()] == [0, 1]
    missing = df.withColumn("amount", F.lit(None).cast("double"))
    assert {r["slice"]: r["n_rows"] for r in errors.errors_by_amount(missing).collect()} == {"round_amount_over_500": 0, "decimal_amount": 1}


def test_terms_are_whole_words(spark, make):
    words = ["SUPERMARKET", "farmers market!", "marketé", "market_1", "Market"]
    df = make([(i, "2023-01-01", w, 1.0, "Sunday", "A") for i, w in enumerate(words)])
    df = df.withColumns({"actual": F.lit("A"), "predicted": F.lit("A")})
    assert {r["slice"]: r["n_rows"] for r in errors.errors_by_keyword(df).collect()}["market"] == 2


def test_rules_first_match_wins(make):
    df = make([(1, "2023-01-01", "UBER tax refund", 1.0, "Sunday", "A"), (2, "2023-01-01", "taxi", 1.0, "Sunday", "A")])
    rows = errors.apply_rules(df.withColumn("predicted", F.lit("X"))).orderBy("transaction_id").collect()
    assert [r["predicted"] for r in rows] == ["Bills & Utilities", "X"]


def test_argmax_ties_align_and_padding(spark):
    df = spark.createDataFrame([([0.4, 0.4, 0.2],)], "p array<double>")
    row = df.select(
        prob.argmax(F.col("p")).alias("k"),
        prob.align(F.col("p"), ["x", "z", "y"], ["w", "x", "y", "z"]).alias("a"),
        prob.padded(F.col("p"), 5).alias("b"),
    ).first()
    assert (row["k"], row["a"], row["b"]) == (0, [0.0, 0.4, 0.2, 0.4], [0.4, 0.4, 0.2, 0.0, 0.0])
    with pytest.raises(ValueError):
        prob.weighted(F.col("p"), [1.0], "add")


def test_grid_equals_scoring_each_candidate_and_tuning_helps(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(300):
        p = [round(rng.random(), 1) for _ in range(4)]
        rows.append((rng.choices(range(4), weights=[1, 1, 1, 6])[0], p))
    df = spark.createDataFrame(rows, "actual_index int, probabilities array<double>").persist()
    weights, grid = [1.0, 2.0, 0.5, 1.0], [0.1, 0.5, 1.0, 3.0, 10.0]
    got = {(r["class_index"], r["multiplier"]): r["macro_f1"] for r in thresholds.grid_scores(df, weights, grid).collect()}
    assert len(got) == 20
    for (c, m), f1 in got.items():
        w = list(weights)
        w[c] = m
        picks = []
        for a, p in rows:
            s = [x * y for x, y in zip(p, w)]
            picks.append((a, s.index(max(s))))
        want = scores(picks)
        assert f1 == pytest.approx(sum(want.values()) / len(want))
    tuned, steps = thresholds.tune_weights(df, 4, grid)
    assert steps[-1]["macro_f1"] >= steps[0]["macro_f1"]
    assert thresholds.score_weights(df, tuned) == pytest.approx(steps[-1]["macro_f1"])
    assert 1.0 in thresholds.default_candidates()


def brute_sweep(rows, weights, c):
    """Best macro F1 of class ``c`` over every stretch between switching points, and the middle of the first such stretch."""
    low, high = 0.1, 10.0
    points = {low}
    for p, _ in rows:
        others = [q * w for j, (q, w) in enumerate(zip(p, weights)) if j != c]
        if p[c] > 0 and low < max(others) / p[c] < high:
            points.add(max(others) / p[c])
    ordered = [*sorted(points), high]
    best = (-1.0, 0.0)
    for left, right in zip(ordered, ordered[1:]):
        tried = [*weights]
        tried[c] = (left + right) / 2
        pairs = []
        for p, actual in rows:
            scaled = [q * w for q, w in zip(p, tried)]
            pairs.append((actual, scaled.index(max(scaled))))
        found = scores(pairs)
        best = max(best, (round(sum(found.values()) / len(found), 12), -tried[c]))
    return best[0], -best[1]


@pytest.fixture
def shares(spark):
    rng = random.Random(3)
    rows = []
    for i in range(150):
        p = [rng.choice([0.0, 0.1, 0.2, 0.3, 0.5]) + rng.random() * (i % 3 > 0) for _ in range(4)]
        p = p if sum(p) else [1.0, 0.0, 0.0, 0.0]
        rows.append(([x / sum(p) for x in p], rng.choice([0, 0, 1, 1, 1, 2])))  # class 3 is never right
    return rows, spark.createDataFrame(rows, "probabilities array<double>, actual_index int")


@pytest.mark.parametrize("weights, rows_per_range", [([1.0] * 4, 100_000), ([1.0, 0.3, 2.5, 0.7], 20)])
def test_sweep_equals_brute_force_over_all_switching_points(shares, weights, rows_per_range, monkeypatch):
    rows, df = shares
    if rows_per_range < 100:
        monkeypatch.setattr("ledgerspark.operators.ordering.SMALL_RANGE", 20)
    got = {r["class_index"]: (r["macro_f1"], r["multiplier"]) for r in thresholds.sweep(df, weights, rows_per_range).collect()}
    assert got == {c: pytest.approx(brute_sweep(rows, weights, c)) for c in range(4)}


def test_exact_weights_are_at_least_as_good_as_the_grid(shares):
    rows, df = shares
    exact, steps = thresholds.tune_weights(df, 4)
    _, on_grid = thresholds.tune_weights(df, 4, thresholds.default_candidates())
    assert steps[1]["macro_f1"] >= on_grid[1]["macro_f1"] - 1e-12
    assert thresholds.score_weights(df, exact) == pytest.approx(steps[-1]["macro_f1"])
    assert all(a["macro_f1"] < b["macro_f1"] for a, b in zip(steps, steps[1:]))
    assert all(0.1 <= w <= 10 for w in exact)
    # No single change helps any more.
    assert max(brute_sweep(rows, exact, c)[0] for c in range(4)) <= steps[-1]["macro_f1"] + 1e-9

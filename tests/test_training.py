import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from ledgerspark import constants as K
from ledgerspark.fixtures import txn
from ledgerspark.operators import evaluation, models, textvec
from ledgerspark.plans import scoring, training
from ledgerspark.storage import recorded

LEAFWISE = {"iterations": 5, "leaves": 8, "min_leaf": 2}


@pytest.fixture(scope="module")
def rows(spark):
    return txn(spark, SMALL).select(K.REQUIRED_TRAIN_COLUMNS)


@pytest.fixture(scope="module")
def matrix(rows):
    return training.build_matrix(rows)


def brute_grams(word, low=3, high=5):
    padded, grams = f" {word} ", []
    for n in range(low, high + 1):
        grams += [padded[i : i + n] for i in range(max(1, len(padded) - n + 1))]
        if n >= len(padded):
            break
    return grams


@pytest.mark.parametrize("word", ["a", "ab", "abc", "cvs", "pharmacy", "café東京"])
def test_char_grams(spark, word):
    got = spark.createDataFrame([(word,)], "w string").select(textvec.char_grams(textvec.padded_word(F.col("w"))).alias("g")).first()["g"]
    assert sorted(got) == sorted(brute_grams(word))


def test_tfidf_against_brute_force(spark):
    texts = ["CVS pharmacy a", "cvs CVS", "", None, "zoo"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "transaction_id long, description string")
    vocabulary = textvec.fit_vocabulary(df, "char", max_terms=20)
    long = textvec.tfidf_long(df, vocabulary, "char").join(vocabulary, "index")
    got = {(r["transaction_id"], r["term"]): r["weight"] for r in long.collect()}
    counts = [{} for _ in texts]
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            for g in brute_grams(w):
                counts[i][g] = counts[i].get(g, 0) + 1
    total, df_of = {}, {}
    for c in counts:
        for g, n in c.items():
            total[g] = total.get(g, 0) + n
            df_of[g] = df_of.get(g, 0) + 1
    kept = sorted(total, key=lambda g: (-total[g], g))[:20]
    want = {}
    for i, c in enumerate(counts):
        w = {g: (1 + np.log(n)) * (np.log(6 / (1 + df_of[g])) + 1) for g, n in c.items() if g in kept}
        norm = np.sqrt(sum(x * x for x in w.values()))
        want |= {(i, g): x / norm for g, x in w.items()}
    assert got == pytest.approx(want)
    assert [r["index"] for r in vocabulary.orderBy("term").collect()] == list(range(20))


@pytest.mark.parametrize("kind", ["char", "word"])
def test_terms_of_a_text_are_counted_without_a_shuffle(spark, kind, monkeypatch):
    monkeypatch.setattr(textvec, "TASK_CHARS", 20)
    texts = ["red apple pie", "green apple tart", "red apple pie", None, "red red tart"]
    df = spark.createDataFrame([(i, texts[i % 5]) for i in range(20)], "transaction_id long, description string")
    _, found = textvec.distinct_texts(df, "transaction_id", "description")
    per_text = textvec.term_uses(textvec.dealt(found), kind).groupBy("number", "n_rows", "term").agg(F.sum("n"))
    assert per_text._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # of whole texts
    vocabulary = textvec.fit_vocabulary(df, kind)
    long = textvec.tfidf_long(df, vocabulary, kind)
    norms = long.groupBy("transaction_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("x")).collect()
    assert {r["transaction_id"]: round(r["x"], 9) for r in norms} == {i: 1.0 for i in range(20) if texts[i % 5]}


def test_weights_of_rare_texts_are_not_written(spark, monkeypatch):
    monkeypatch.setattr(textvec, "HOT_KEYS", 10)
    rows = [(i, f"text number {i + 10}") for i in range(50)] + [(50 + i, "one popular text") for i in range(50)]
    df = spark.createDataFrame(rows, "transaction_id long, description string")
    vocabulary, written, materialize = textvec.fit_vocabulary(df, "word"), {}, textvec.materialize

    def counted(table, label):
        out = materialize(table, label)
        written[label] = out.count()
        return out

    monkeypatch.setattr(textvec, "materialize", counted)
    per_row = textvec.tfidf_long(df, vocabulary, "word").groupBy("transaction_id").count().collect()
    assert {r["transaction_id"]: r["count"] for r in per_row} == {i: 5 for i in range(100)}
    assert written["weights"] == 1


def test_word_grams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    assert [r[0] for r in df.select(textvec.word_grams(F.col("w"))).collect()] == [["a", "b", "c", "a b", "b c"], ["a"], []]


def dense_vectors(vectors, n_terms):
    dense = np.zeros((vectors.count(), n_terms))
    for i, r in enumerate(vectors.orderBy("transaction_id").collect()):
        dense[i, r["indices"]] = r["weights"]
    return dense


def loadings(basis):
    rows = basis.table.orderBy("block").collect()
    return np.vstack([np.frombuffer(bytes(r["values"])).reshape(-1, basis.rank) for r in rows])


def test_svd_matches_a_dense_one(spark, rows, monkeypatch):
    vocabularies = {k: textvec.fit_vocabulary(rows, k, max_terms=60) for k in ("char", "word")}
    vectors, n_terms = textvec.text_vectors(rows, vocabularies)
    dense = dense_vectors(vectors, n_terms)
    _, singular, vt = np.linalg.svd(dense, full_matrices=False)
    quick = textvec.fit_svd(vectors, n_terms, 3)
    assert np.linalg.norm(dense @ loadings(quick), axis=0) == pytest.approx(singular[:3], rel=1e-3)
    # Small blocks, groups and chunks, so that all sums run over several parts; enough rounds to converge.
    for name, value in {"BLOCK_TERMS": 16, "GROUP_ROWS": 100, "CHUNK_TILES": 3}.items():
        monkeypatch.setattr(textvec, name, value)
    basis = textvec.fit_svd(vectors, n_terms, 3, iterations=8)
    v = loadings(basis)
    assert v.shape == (n_terms, 3) and v.T @ v == pytest.approx(np.eye(3), abs=1e-9)
    assert np.linalg.norm(dense @ v, axis=0) == pytest.approx(singular[:3], rel=1e-6)
    top = np.abs(v).argmax(axis=0)
    assert (v[top, range(3)] > 0).all()
    assert np.abs((v * vt[:3].T).sum(axis=0)) == pytest.approx(np.ones(3), abs=1e-4)  # the same axes up to sign
    projected = textvec.project(vectors, basis).orderBy("transaction_id").collect()
    assert np.array([r["text_svd"] for r in projected]) == pytest.approx(dense @ v, abs=1e-9)
    assert textvec.gram_of(textvec.tiles_of(vectors), basis) == pytest.approx((dense @ v).T @ (dense @ v), abs=1e-7)


def test_svd_of_low_rank_and_of_nothing(spark):
    texts = [(i, t) for i, t in enumerate(["ab cd", "ab cd", "ef", "ef gh", None, ""] * 3)]
    df = spark.createDataFrame(texts, "transaction_id long, description string")
    vocabularies = {"word": textvec.fit_vocabulary(df, "word")}
    vectors, n_terms = textvec.text_vectors(df, vocabularies)
    basis = textvec.fit_svd(vectors, n_terms, 50)
    assert basis.rank == np.linalg.matrix_rank(dense_vectors(vectors, n_terms)) == 3
    none = spark.createDataFrame([(1, None)], "transaction_id long, description string")
    vectors, n_terms = textvec.text_vectors(none, {"word": textvec.fit_vocabulary(none, "word")})
    empty = textvec.fit_svd(vectors, n_terms, 5)
    assert n_terms == 0 and empty.rank == 0 and textvec.project(vectors, empty).count() == 0


def test_svd_works_on_distinct_texts_and_leaves_no_old_bases(spark):
    texts = ["red apple pie", "green apple tart", "red cherry tart", None, "blue plum jam"]
    rows = [(i, texts[i % 5]) for i in range(400)]
    df = spark.createDataFrame(rows, "transaction_id long, description string")
    vectors, n_terms = textvec.text_vectors(df, {"word": textvec.fit_vocabulary(df, "word")})
    tiles = textvec.tiles_of(vectors)
    assert sum(len(r.ids) for r in tiles.where(F.col("block") == textvec.IDS).collect()) == 4  # null has no terms
    with recorded() as made:
        basis = textvec.fit_svd(vectors, n_terms, 3)
    assert [p for p in made if "svd-" in p and os.path.exists(p.removeprefix("file://").removeprefix("file:"))] == [
        p for p in made if p.rsplit("/", 1)[-1] in basis.table.inputFiles()[0]
    ]
    dense = np.zeros((400, n_terms))
    for r in vectors.collect():
        dense[r.transaction_id, r.indices] = r.weights
    values = np.linalg.svd(dense, compute_uv=False)[:3]
    at = {r.transaction_id: r.text_svd for r in textvec.project(vectors, basis).collect()}
    assert sorted(at) == [i for i, t in rows if t]
    y = np.array([at[i] for i in sorted(at)])
    assert y.T @ y == pytest.approx(np.diag(values**2), abs=1e-8)
    assert textvec.gram_of(tiles, basis) == pytest.approx(np.diag(values**2), abs=1e-8)


def test_class_weights_balance(rows):
    weights = models.class_weights(rows).collect()
    assert sum(r["weight"] * r["n_rows"] for r in weights) == pytest.approx(1000)


@pytest.mark.parametrize("kind, settings", [
    ("leafwise", LEAFWISE), ("logistic", {"iterations": 5}), ("boosted", {"iterations": 2, "depth": 2}),
])
def test_models_give_distributions(matrix, kind, settings):
    unseen_class = matrix.labels[-1]
    train = models.with_labels(matrix.rows.where(F.col(K.TARGET) != unseen_class), matrix.labels, training.weights_of(matrix.rows))
    model = models.MODEL_KINDS[kind](train, matrix.columns, matrix.labels, settings)
    scored = models.score(model, matrix.rows, matrix.labels)
    bad = scored.where(
        (F.size("probabilities") != len(matrix.labels))
        | (F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p) - 1) > 1e-6)
        | (F.get("probabilities", F.lit(len(matrix.labels) - 1)) > 0)
    )
    assert scored.count() == 1000 and bad.count() == 0


def test_cross_validation_covers_the_last_five_sixths(matrix):
    oof, fitted = training.cross_validate(matrix, "leafwise", LEAFWISE, final=True)
    assert {r["fold"]: r["n"] for r in oof.groupBy("fold").agg(F.count("*").alias("n")).collect()} == {k: 166 for k in range(1, 6)}
    assert oof.select(K.ID).distinct().count() == 830
    assert oof.where("max_probability > array_max(probabilities) or actual <> category").count() == 0
    assert oof.where(F.col("predicted").isin(matrix.labels) & F.col("max_probability").between(0.1 - 1e-9, 1 + 1e-9)).count() == 830
    both = training.ensemble_summary(oof, oof, matrix.labels).collect()
    assert len(both) == 6 and all(r["improvement"] == pytest.approx(0) for r in both)
    assert evaluation.macro_f1_score(oof) > 0
    # Each fold keeps its best round, the final model their mean; history and table agree.
    assert len(fitted) == 6 and len(fitted[-1].trees) == max(1, round(sum(len(m.trees) for m in fitted[:5]) / 5))
    history = training.round_history(matrix.rows.sparkSession, fitted[:5])
    chosen = {r["fold"]: r for r in history.where("is_chosen").collect()}
    by_fold = {r["fold"]: r["macro_f1"] for r in evaluation.macro_f1(oof, ["fold"]).collect()}
    assert {k: r["macro_f1"] for k, r in chosen.items()} == pytest.approx(by_fold)


def test_trained_model_survives_saving_and_scores_unseen_merchants(spark, rows, tmp_path):
    trained = training.train(rows, "leafwise", LEAFWISE, n_folds=2, text_rank=2, max_terms=50)
    assert trained.tuned_f1 >= trained.raw_f1
    training.save_trained(trained, str(tmp_path), "m")
    scorer = scoring.load_scorer(spark, str(tmp_path), "m")
    assert scorer.weights == trained.weights and scorer.matrix.labels == trained.matrix.labels
    new = rows.drop(K.TARGET).withColumn("description", F.concat(F.lit("ZZQ "), F.coalesce("description", F.lit(""))))
    scored = scoring.score_transactions(scorer, new)
    assert scored.count() == 1000 and scored.where(f"{K.TARGET} is null or max_probability is null").count() == 0


@pytest.mark.parametrize("kind, settings", [("boosted", {"iterations": 3, "depth": 3}), ("logistic", {"iterations": 5})])
def test_scoring_training_rows_equals_the_in_memory_model(spark, rows, tmp_path, kind, settings):
    trained = training.train(rows, kind, settings, n_folds=2)
    training.save_trained(trained, str(tmp_path), "m")
    loaded = scoring.run_scoring(spark, rows.drop(K.TARGET), str(tmp_path), "m", str(tmp_path / "out"))
    direct = models.score(trained.model, training.matrix_for(rows, trained.matrix), trained.matrix.labels)
    joined = loaded.join(direct.select(K.ID, F.col("probabilities").alias("q")), K.ID)
    assert joined.where("probabilities <> q").count() == 0 and joined.count() == 1000


def sequential_pruning(scores, startup, warmup):
    """Trials one after another, as the rule is usually stated."""
    seen, stopped = [], {}
    for number in sorted(scores):
        means = []
        for k, _ in enumerate(scores[number], start=1):
            means.append(np.mean(scores[number][:k]))
            earlier = [m[k - 1] for m in seen if len(m) >= k]
            if number >= startup and k > warmup and earlier and means[-1] < np.median(earlier):
                stopped[number] = k
                break
        seen.append(means)
    return stopped


def test_pruning_side_by_side_equals_one_after_another():
    rng = np.random.default_rng(1)
    for _ in range(50):
        scores = {n: [float(x) for x in rng.random(4)] for n in range(12)}
        assert training.pruned_at(scores, 3, 1) == sequential_pruning(scores, 3, 1)
        # Scores that a pruned trial never got make no difference.
        cut = {n: s[: training.pruned_at(scores, 3, 1).get(n, 4)] for n, s in scores.items()}
        assert training.pruned_at(cut, 3, 1) == training.pruned_at(scores, 3, 1)


def test_search_reports_prunes_and_goes_on_where_it_stopped(spark, matrix, tmp_path, monkeypatch):
    import random

    space = {"boosted_iterations": ("int", 1, 2), "boosted_depth": ("int", 2, 2), "leafwise_iterations": ("int", 1, 2), "leafwise_leaves": ("int", 4, 4)}
    options = {"n_trials": 3, "space": space, "n_folds": 2, "startup": 1, "warmup": 0, "path": str(tmp_path), "bins": 8}
    trials, best = training.search(matrix, **options)
    rows = {r["number"]: r for r in trials.collect()}
    scores = {n: r["fold_scores"] for n, r in rows.items()}
    stopped = sequential_pruning(scores, 1, 0)
    assert {n for n, r in rows.items() if r["state"] == "PRUNED"} == set(stopped)
    assert all(len(scores[n]) == stopped.get(n, 2) for n in rows) and rows[best["number"]]["is_best"]

    def no_fit(*_, **__):
        raise AssertionError("fitted again")

    monkeypatch.setattr("ledgerspark.operators.boosting.fit_ensembles", no_fit)
    again, _ = training.search(matrix, **options)
    assert {r["number"]: r["fold_scores"] for r in again.collect()} == scores
    values = training.suggest(random.Random(1), K.SEARCH_SPACE)
    assert all(lo <= values[k] <= hi for k, (_, lo, hi) in K.SEARCH_SPACE.items())


def test_jobs_from_file_to_submission(spark, rows, tmp_path, monkeypatch):
    from ledgerspark import __main__ as jobs

    monkeypatch.setattr(training, "train", _small_train(training.train))
    source = str(tmp_path / "train")
    rows.write.option("header", True).csv(source)
    rows.drop(K.TARGET).write.option("header", True).csv(str(tmp_path / "test"))

    def job(*args):
        jobs.run(spark, jobs.parser().parse_args(list(args)))

    cached = ["--train", source, "--cache", str(tmp_path / "cache")]
    job("load", *cached, "--out", str(tmp_path / "load"))
    job("eda", *cached, "--out", str(tmp_path / "eda"))
    job("features", *cached, "--out", str(tmp_path / "features"), "--extended")
    job("train", *cached, "--out", str(tmp_path / "model"), "--model", "leafwise", "--text-rank", "2")
    job("errors", "--oof", str(tmp_path / "model" / "oof"), "--out", str(tmp_path / "errors"))
    job("score", "--test", str(tmp_path / "test"), "--model", "leafwise", "--model-dir", str(tmp_path / "model"),
        "--out", str(tmp_path / "submission"))
    assert len(list((tmp_path / "eda").iterdir())) == 18 and len(list((tmp_path / "errors").iterdir())) == 16
    assert spark.read.parquet(str(tmp_path / "features")).count() == 1000
    assert spark.read.json(str(tmp_path / "load" / "report" / "filled")).first()["amounts_filled"] == 12  # ids 5, 94, …, 984
    assert spark.read.json(str(tmp_path / "load" / "metadata" / "load")).first()["n_rows"] == 1000
    submission = spark.read.option("header", True).csv(str(tmp_path / "submission"))
    assert submission.columns == [K.ID, K.TARGET] and submission.count() == 1000
    assert spark.read.json(str(tmp_path / "errors" / "overall")).first()["n_rows"] == 830


def _small_train(train):
    def run(df, kind, **options):
        return train(df, kind, LEAFWISE, max_terms=50, **options)

    return run


def test_text_columns_are_made_once_per_text(spark):
    texts = ["red apple pie", "green apple tart", "red cherry tart", None, "blue plum jam"]
    ids = [*range(400), 7, None]  # one id twice, with a text and without, and one missing
    df = spark.createDataFrame([(i, texts[at % 4]) for at, i in enumerate(ids)], "transaction_id long, description string")
    vocabularies = {k: textvec.fit_vocabulary(df, k) for k in ("char", "word")}
    units, vectors, n_terms = textvec.unit_vectors(df, vocabularies)
    assert units.count() == 401 and len(texts) - 2 == 3
    found = {tuple(r.unit): r for r in vectors.collect()}
    assert sorted(r.n for r in found.values()) == [1, 100, 100, 101] and max(map(len, found)) == 2  # 7 has both its texts
    both = next(r for key, r in found.items() if len(key) == 2)
    assert (both.indices, both.weights) in [(r.indices, r.weights) for key, r in found.items() if len(key) == 1]
    basis = textvec.fit_svd(vectors, n_terms, 2)
    with recorded() as made:
        rows = training.with_text_columns(df, vocabularies, basis)
    written = [p for p in made if p.rsplit("/", 1)[-1].startswith("vectors-")]
    assert [spark.read.parquet(p).count() for p in written] == [4]
    got = [(r.transaction_id, r.description, r.text_0, r.text_1) for r in rows.collect()]
    assert len(got) == len(ids)
    assert len({(round(x, 9), round(y, 9)) for i, t, x, y in got if t == "red apple pie" and i != 7 and i is not None}) == 1
    assert all(x == y == 0 for i, t, x, y in got if i is None or (t is None and i != 7))


@pytest.mark.parametrize("part_bytes", [300, 1 << 20])
def test_parts_of_a_key_are_added_up_as_they_arrive(spark, monkeypatch, part_bytes):
    """Many parts of one key, in batches of two rows: whole sums, and no step that collects the parts of a key."""
    monkeypatch.setattr(textvec, "PART_BYTES", part_bytes)
    rng, want, rows = np.random.default_rng(3), {}, []
    for i in range(200):
        key = 7 if i % 4 else i % 5
        at = np.sort(rng.choice(9, 4, replace=False)).astype("<i4")
        values = rng.integers(-9, 9, (4, 2)).astype("<f8")
        np.add.at(want.setdefault(key, np.zeros((9, 2))), at, values)
        rows.append((key, bytearray(at.tobytes()), bytearray(values.tobytes())))
    parts = spark.createDataFrame(rows, textvec.PART).repartition(6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        summed = textvec._summed(parts, 2)
        assert "FlatMapGroups" not in summed._jdf.queryExecution().executedPlan().toString()
        found = summed.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(r["key"] for r in found) == sorted(want)
    for r in found:
        got = np.zeros((9, 2))
        got[np.frombuffer(r["rows"], "<i4")] = np.frombuffer(r["values"]).reshape(-1, 2)
        assert (got == want[r["key"]]).all()


@pytest.mark.parametrize("kind", ["char", "word"])
def test_weights_by_term_need_no_join_back(spark, no_broadcast, kind):
    import os

    texts = ["red apple pie", "green apple tart", "red apple pie", None, "red red tart"]
    df = spark.createDataFrame([(i, texts[i % 5]) for i in range(20)], "transaction_id long, description string")
    with recorded() as made:
        vocabulary = textvec.fit_vocabulary(df, kind)
    gone = [p for p in made if p.rsplit("/", 1)[-1].rsplit("-", 1)[0] in ("texts", "terms")]
    assert len(gone) == 2 and not any(os.path.exists(p.removeprefix("file:")) for p in gone)
    by_term = textvec.tfidf_long(df, vocabulary, kind, label="term")
    by_index = textvec.tfidf_long(df, vocabulary, kind).join(vocabulary, "index")
    got, want = ({(r.transaction_id, r.term): r.weight for r in t.collect()} for t in (by_term, by_index))
    assert got == pytest.approx(want) and len(got) == by_term.count() > 50

"""The paths that only large tables take, forced on small ones and checked against plain windows."""

import pytest
from pyspark.sql import Window as W, functions as F

import ledgerspark.operators.ordering as ordering
import ledgerspark.storage as storage
from conftest import SMALL
from ledgerspark.fixtures import txn
from ledgerspark.operators import encoding, eda, quantiles, sampling
from ledgerspark.operators.folds import fold_cuts, fold_of, fold_sizes
from ledgerspark.plans.feature_table import feature_table


@pytest.fixture
def holes(spark):
    """Ids with holes, in no particular order."""
    return spark.range(0, 3000).where("id % 7 <> 3").select(
        (F.col("id") * 3).alias("k"), (F.col("id") % 5).alias("g"), F.when(F.col("id") % 3 == 0, 9.99).otherwise(F.col("id") % 101 / 4).alias("v")
    ).orderBy(F.xxhash64("id"))


def test_row_numbers_gaps_over_many_ranges(holes):
    df = ordering.with_row_number(holes, "k", "i", rows_per_range=200)
    df = ordering.with_row_number(df, "k", "gi", by=["g"], rows_per_range=300)
    df = ordering.with_gap(df, "k", "gap", rows_per_range=250)
    everything = W.orderBy("k")
    check = df.select(
        F.col("i") == F.row_number().over(everything),
        F.col("gi") == F.row_number().over(W.partitionBy("g").orderBy("k")),
        F.col("gap") == F.coalesce(F.col("k") - F.lag("k").over(everything), F.lit(0)),
    )
    rows = check.collect()
    assert len(rows) == holes.count() and all(all(r) for r in rows)


def test_row_numbers_without_broadcast(holes, no_broadcast):
    df = ordering.with_row_number(holes, "k", "i", by=["g"], rows_per_range=200)
    wrong = df.withColumn("w", F.row_number().over(W.partitionBy("g").orderBy("k"))).where("i <> w")
    assert wrong.count() == 0


def test_values_at_ranks(holes):
    ids = sorted(r["k"] for r in holes.collect())
    wanted = [0, 1, 199, 200, 1500, len(ids) - 1]
    assert ordering.values_at_ranks(holes, "k", wanted, rows_per_range=100) == {r: ids[r] for r in wanted}


def test_quantiles_equal_exact_percentiles(holes):
    shares = {"a": 0.25, "b": 0.5, "c": 0.9}
    got = quantiles.quantiles(holes, F.col("v"), shares, {"g": F.col("g")}, rows_per_range=20).orderBy("g").collect()
    want = holes.groupBy("g").agg(*[F.percentile("v", s).alias(n) for n, s in shares.items()]).orderBy("g").collect()
    for g, w in zip(got, want):
        assert [g[n] for n in shares] == pytest.approx([w[n] for n in shares])
    assert quantiles.scalar_quantiles(holes.where("k < 0"), F.col("v"), {"m": 0.5}) == {"m": None}


@pytest.mark.parametrize("hot_keys", [2, 50])
def test_hot_keys_are_split_and_rows_stay_whole(holes, no_broadcast, monkeypatch, hot_keys):
    monkeypatch.setattr(storage, "HOT_KEYS", hot_keys)
    value, group = F.col("v"), F.when(F.col("g") > 0, F.col("g"))
    shares = quantiles.average_rank_shares(holes, value, group, "p", rows_per_range=20)
    got = quantiles.with_rank_share(holes, shares, value, group, "p", "k")
    month = W.partitionBy(group)
    plain = got.withColumn(
        "q",
        (F.rank().over(month.orderBy("v")) + (F.count("*").over(W.partitionBy(group, "v")) - 1) / 2) / F.count("v").over(month),
    )
    assert got.count() == holes.count()
    assert plain.where("p is null or abs(p - q) > 1e-12").count() == 0


def test_feature_table_is_the_same_without_broadcast(spark, no_broadcast, monkeypatch):
    rows = txn(spark, SMALL).select("transaction_id", "date", "description", "amount", "day_of_week", "category")
    large = {r["transaction_id"]: r for r in feature_table(rows).collect()}
    spark.conf.unset("spark.ledger.broadcastRows")
    small = {r["transaction_id"]: r for r in feature_table(rows).collect()}
    assert large == small and len(large) == 1000


def test_label_ranks_by_distributed_sort(spark, no_broadcast):
    df = spark.range(5000).select(F.col("id").alias("transaction_id"), F.concat(F.lit("m"), F.col("id") % 997).alias("store_name"))
    rows = encoding.encode_categoricals(df, ["store_name"]).collect()
    names = sorted(f"m{i}" for i in range(997))
    assert all(r["store_name"] == names.index(f"m{r['transaction_id'] % 997}") for r in rows[::37])
    assert len(rows) == 5000


def test_samples(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SMALL_RANGE", 200)
    rows = txn(spark, SMALL)
    sample = sampling.sample_stratified(rows, 100)
    counts = {r["category"]: r["n"] for r in sample.groupBy("category").agg(F.count("*").alias("n")).collect()}
    totals = {r["category"]: r["n"] for r in rows.groupBy("category").agg(F.count("*").alias("n")).collect()}
    assert counts == {c: max(1, n * 100 // 1000) for c, n in totals.items()}
    assert sample.select("transaction_id").distinct().count() == sample.count()
    first, second = (sorted(r["transaction_id"] for r in sampling.sample_random(rows, 50).collect()) for _ in range(2))
    assert first == second and len(first) == 50
    assert sampling.sample_stratified(rows, 3).count() == 3
    assert sampling.sample_random(rows, 5000).count() == 1000


def test_folds_are_disjoint_and_ordered(spark, monkeypatch):
    monkeypatch.setattr(ordering, "SMALL_RANGE", 100)
    df = spark.range(0, 1003).select((F.col("id") * 2).alias("transaction_id"))
    cuts = fold_cuts(df)
    sizes = {r["fold"]: (r["train_rows"], r["valid_rows"]) for r in fold_sizes(df, cuts).collect()}
    step = 1003 // 6
    assert sizes == {k: (1003 - (6 - k) * step, step) for k in range(1, 6)}
    assert df.where(fold_of(cuts).isNull()).count() == 1003 - 5 * step
    with pytest.raises(ValueError, match="folds"):
        fold_cuts(df.limit(5))


def test_sequential_ids(spark):
    ids = spark.range(10).withColumnRenamed("id", "transaction_id")
    assert eda.sequential_id(ids).first()["is_sequential"] == 1
    assert eda.sequential_id(ids.where("transaction_id <> 4")).first()["is_sequential"] == 0
    doubled = ids.where("transaction_id <> 4").union(ids.where("transaction_id = 5"))
    assert eda.sequential_id(doubled).first()["is_sequential"] == 0


def test_released_tables_are_gone_but_for_those_still_read(spark):
    import os

    from ledgerspark.storage import materialize, recorded, release

    with recorded() as made:
        kept, gone = materialize(spark.range(3), "kept"), materialize(spark.range(4), "gone")
    assert len(made) == 2 and gone.count() == 4
    release(spark, made, kept.where("id > 0"))
    assert [os.path.isdir(p.removeprefix("file:")) for p in made] == [True, False]
    assert kept.count() == 3
    with recorded() as other:
        pass
    assert other == [] and len(made) == 2

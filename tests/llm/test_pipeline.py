"""The pipeline, and the queries with SQL equivalents, on the smallest tables."""

import pytest
from conftest import SMALL
from oracle import compare, duck_connection

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from ledgerspark.llm import mcd, queries as named


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SMALL)


@pytest.mark.parametrize("name", sorted(named.ORACLES))
def test_matches_sql(spark, duck, name):
    assert name in oracle_sql() and compare(spark, duck, name, SMALL) is None


def test_all_ten_and_the_pipeline_are_registered():
    names = set(queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    given = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    kept = {r.doc_id for r in mcd.judge(docs).where("kept").collect()}
    one = stages["quality"](spark, docs, SMALL)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == kept
    two = stages["lines"](spark, one, SMALL)
    rows = two.collect()
    assert two.columns == docs.columns and {r.doc_id for r in rows} == kept
    assert all(r.n_chars == len(r.text) and set(r.text.split("\n")) <= set(given[r.doc_id].text.split("\n")) | {""} for r in rows)
    three = stages["near_duplicates"](spark, two, SMALL)
    left = [r.doc_id for r in three.collect()]
    assert three.columns == docs.columns and len(left) == len(set(left)) and set(left) <= kept
    four = stages["mix"](spark, three, SMALL)
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} <= set(left)
    assert stages["bpe"](spark, four, SMALL).count() == four.count() > 0


def test_stages_take_odd_rows_and_no_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "w " * 60, "en", "src1", 120)], schema)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, odd, SMALL).collect()
        assert stage(spark, odd.limit(0), SMALL).collect() == [], name


def test_lines_stage_removes_whole_passages(spark):
    text = lambda own: "\n".join([f"own line {own} before", "first line of a passage that stands twice", "and its second line", f"own line {own} after"])
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, text(i), "en", "src1", 0) for i in range(5)], schema)
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["lines"](spark, docs, SMALL).collect()}
    assert got == {0: text(0), **{i: f"own line {i} before\nown line {i} after" for i in range(1, 5)}}


def test_near_duplicates_keep_rows_with_missing_or_repeated_ids(spark):
    text = lambda k, end="": " ".join(f"w{k}x{j}" for j in range(100)) + end
    rows = [(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (9, text(5)), (5, text(5, " more")), (None, text(5)), (8, text(6)), (8, text(6)), (None, None), (None, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, "en", "src1", 0) for r in rows], schema).repartition(3)
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SMALL).collect()
    want = [(None, text(1)), (None, text(2)), (7, text(3)), (7, text(4)), (5, text(5, " more")), (8, text(6)), (None, None), (None, "")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(map(str, want))

"""The corpus pipeline: quality rules, line deduplication, near duplicates, mixing, tokens.

Each stage is a function of (spark, docs, sf_dir) and is written as Parquet before the next one reads it.  All but the
last return the columns of ``documents``.  When a stage begins, the one before it has been written, so the scratch tables of
that one go, but for those that the stage's own input still reads.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerspark.llm import bottomk, line_chunks, mcd, queries
from ledgerspark.llm.base import arrow_rows, materialize, table
from ledgerspark.storage import recorded, release

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Of the tokens that reach the mix; at most two epochs of a source make up for the weights.
MIX_SHARE = 0.9

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Scratch tables of the stage before, by application.
_BEFORE: dict[str, list[str]] = {}


def releasing(stage: Stage) -> Stage:
    """The stage, which first deletes the scratch tables of the stage before it."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        release(spark, _BEFORE.pop(application, []), docs)
        with recorded() as made:
            out = stage(spark, docs, sf_dir)
        _BEFORE[application] = made
        return out

    return run_stage


def documents(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


@releasing
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base limits and near the robust centre of their language and source."""
    return documents(mcd.judge(docs).where("kept"))


@releasing
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the content-defined chunks that stand elsewhere before, and without the rest of repeated runs of lines."""
    return documents(line_chunks.dedup_passages(docs))


@releasing
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the one with the smallest id, of
    rows with equal ids an arbitrary one, and one without an id only where none has any.  Rows are compared and removed
    by a number of their own, so that ids may be missing or repeated."""
    arrow_rows(spark, 1000)
    numbered = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "pipeline-numbered")
    found = materialize(bottomk.near_duplicates(numbered, id_col="__row").select("__row", "component_id"), "pipeline-components")
    # Rows of groups of two and more: each has a member that is not the group's smallest number.
    groups = found.where("__row != component_id").select("component_id").distinct()
    members = found.join(groups, "component_id", "left_semi").join(numbered.select("__row", "doc_id"), "__row")
    members = materialize(members.withColumn("at", F.struct(F.col("doc_id").isNull(), "doc_id", "__row")), "pipeline-members")
    keepers = members.groupBy("component_id").agg(F.min("at").alias("keeper"))
    gone = materialize(members.join(keepers, "component_id").where("at != keeper").select("__row"), "pipeline-duplicates")
    return documents(numbered.join(gone, "__row", "left_anti"))


@releasing
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document taken in two epochs stands twice."""
    taken = queries.mixed(docs, MIX_SHARE)
    copies = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return documents(copies)


@releasing
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts that are left."""
    return queries.bpe_digests(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("bpe", tokens),
]

#: The first stage's robust covariance has no plain SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        planned = stage(spark, docs, sf_dir)
        with recorded() as written:
            docs = materialize(planned, f"pipeline-{name}")
        release(spark, before)
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)

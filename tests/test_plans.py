"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

import ledgerspark.operators.ordering as ordering
from conftest import SMALL
from ledgerspark import constants as K
from ledgerspark.fixtures import txn
from ledgerspark.operators import errors, evaluation
from ledgerspark.operators.folds import fold_cuts, fold_of, in_fold
from ledgerspark.plans.feature_table import feature_table


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def many_ranges(monkeypatch):
    monkeypatch.setattr(ordering, "SMALL_RANGE", 100)


@pytest.fixture
def rows(spark):
    return txn(spark, SMALL).select(K.REQUIRED_TRAIN_COLUMNS)


def test_feature_table_shuffles_rows_once_and_stays_in_the_jvm(rows, many_ranges):
    plan = plan_of(feature_table(rows, extended=True))
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) == 1
    assert "SinglePartition" not in plan and "Python" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_feature_table_without_broadcast_has_no_single_task(rows, many_ranges, no_broadcast):
    plan = plan_of(feature_table(rows))
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_folds_do_not_shuffle_rows(rows, many_ranges):
    cuts = fold_cuts(rows)
    plan = plan_of(rows.where(in_fold(cuts, 3)).withColumn("fold", fold_of(cuts)))
    assert "Exchange" not in plan and "Window" not in plan
    assert f"GreaterThanOrEqual(event_id,{cuts[2]}), LessThan(event_id,{cuts[3]})" in plan


def test_scans_read_only_needed_columns_and_filters_reach_them(spark):
    table = txn(spark, SMALL).where("transaction_id < 100").select(K.ID, "amount")
    plan = plan_of(table)
    assert "PushedFilters: [IsNotNull(event_id), LessThan(event_id,100)]" in plan
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan


def test_top_rows_per_class_are_limited_before_the_shuffle(rows):
    df = rows.withColumns({"actual": F.col(K.TARGET), "predicted": F.lit("Travel"), "fold": F.lit(1)})
    assert plan_of(errors.misclassified_examples(df)).count("WindowGroupLimit") == 2


def test_scores_aggregate_before_the_shuffle(rows):
    df = rows.withColumns({"actual": F.col(K.TARGET), "predicted": F.lit("Travel")})
    plan = plan_of(evaluation.per_class_metrics(df))
    assert "partial_count" in plan and "Join" not in plan


def test_an_error_report_reads_its_table_twice_and_counts_the_same(spark, rows, tmp_path):
    from ledgerspark.operators.recurrence import with_store_frequency
    from ledgerspark.plans import reports

    labels = F.when(F.col(K.ID) % 7 == 0, "Travel").otherwise(F.col(K.TARGET))
    oof = with_store_frequency(rows).withColumns({"actual": F.col(K.TARGET), "predicted": labels, "fold": (F.col(K.ID) % 5).cast("int")})
    path = str(tmp_path / "oof")
    oof.write.parquet(path)
    oof = spark.read.parquet(path)
    before = {s.id() for s in _executions(spark)}
    report = reports.error_report(oof)
    counting = [s for s in _executions(spark) if s.id() not in before and path in s.plan()]
    assert len(counting) == 1  # the tally
    direct = {
        "folds": evaluation.macro_f1(oof, ["fold"]), "overall": evaluation.fold_summary(oof), "confusion_matrix": evaluation.confusion_matrix(oof),
        "per_class_metrics": evaluation.per_class_metrics(oof), "top_misclassifications": evaluation.top_misclassifications(oof),
        "keywords": errors.errors_by_keyword(oof), "keyword_distribution": errors.keyword_distribution(oof),
        "amounts": errors.errors_by_amount(oof), "times": errors.errors_by_time(oof), "stores": errors.errors_by_store(oof),
        "profile": errors.misclassified_profile(oof), "suggested_rules": errors.suggest_rules(oof),
    }
    for name, want in direct.items():
        assert sorted(map(str, report[name].collect())) == sorted(map(str, want.select(report[name].columns).collect())), name
    scanning = [name for name, df in report.items() if path in plan_of(df)]
    assert scanning == ["examples"]


class _Execution:
    def __init__(self, data):
        self.data = data

    def id(self):
        return self.data.executionId()

    def plan(self):
        return self.data.physicalPlanDescription()


def _executions(spark):
    found = spark._jsparkSession.sharedState().statusStore().executionsList()
    return [_Execution(found.apply(i)) for i in range(found.size())]

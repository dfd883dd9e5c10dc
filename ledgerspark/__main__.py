"""Jobs for spark-submit: ``python -m ledgerspark <job> …`` or ``spark-submit … -m``-style wrappers.

    load      --train PATH --out DIR              repaired table as Parquet, load metadata and report as JSON
    eda       --train PATH --out DIR              exploratory report as JSON
    features  --train PATH --out DIR              feature table as Parquet
    train     --train PATH --out DIR [--model K]  model, class weights, out-of-fold table and summary
    ensemble  --train PATH --out DIR              two models with tuned weights, fold scores of both and their mean
    tune      --train PATH --out DIR [--trials N] trials of the parameter search
    errors    --oof DIR    --out DIR              error report over an out-of-fold table
    score     --test PATH  --model-dir DIR --out DIR
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ledgerspark import constants as K
from ledgerspark.operators.models import MODEL_KINDS
from ledgerspark.plans import reports, scoring, training
from ledgerspark.plans.feature_table import feature_table
from ledgerspark.plans.ingest import load_report, load_transactions
from ledgerspark.sources.cache import load_metadata
from ledgerspark.sources.files import read_transactions
from ledgerspark.session import tune
from ledgerspark.sources.sinks import write_report


ENSEMBLE = "ensemble"


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.job == "errors":
        write_report(reports.error_report(spark.read.option("basePath", args.oof).parquet(args.oof)), args.out)
        return
    if args.job == "score":
        test = load_transactions(spark, args.test, is_train=False)
        job = scoring.run_ensemble_scoring if args.model == ENSEMBLE else scoring.run_scoring
        job(spark, test, args.model_dir, args.model, args.out)
        return
    train = load_transactions(spark, args.train, cache=args.cache)
    if args.job == "load":
        raw = read_transactions(spark, args.train, columns=K.REQUIRED_TRAIN_COLUMNS)
        train.write.mode("overwrite").parquet(f"{args.out}/table")
        write_report(load_report(raw), f"{args.out}/report")
        write_report(load_metadata(spark, train, args.train), f"{args.out}/metadata")
    elif args.job == "eda":
        write_report(reports.eda_report(train), args.out)
    elif args.job == "features":
        feature_table(train, extended=args.extended).write.mode("overwrite").parquet(args.out)
    elif args.job == "train":
        trained = training.train(train, args.model, text_rank=args.text_rank)
        training.save_trained(trained, args.out, args.model)
        trained.oof.write.mode("overwrite").partitionBy("fold").parquet(f"{args.out}/oof")
        write_report(reports.training_summary(trained), f"{args.out}/summary")
    elif args.job == "ensemble":
        trained = training.train_ensemble(train, text_rank=args.text_rank)
        training.save_ensemble(trained, args.out, ENSEMBLE)
        write_report({"folds": trained.summary}, args.out)
    elif args.job == "tune":
        matrix = training.build_matrix(train, text_rank=args.text_rank)
        trials, _ = training.search(matrix, n_trials=args.trials)
        write_report({"trials": trials}, args.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ledgerspark", description="Expense categorisation jobs")
    jobs = top.add_subparsers(dest="job", required=True)
    for name in ("load", "eda", "features", "train", "ensemble", "tune", "errors", "score"):
        job = jobs.add_parser(name)
        job.add_argument("--out", required=True)
        if name not in ("errors", "score"):
            job.add_argument("--train", required=True)
            job.add_argument("--cache", help="folder for the repaired table")
        if name in ("train", "ensemble", "tune"):
            job.add_argument("--text-rank", type=int, default=50)
        if name in ("train", "score"):
            kinds = sorted([*MODEL_KINDS, ENSEMBLE] if name == "score" else MODEL_KINDS)
            job.add_argument("--model", choices=kinds, default="boosted")
    jobs.choices["features"].add_argument("--extended", action="store_true")
    jobs.choices["tune"].add_argument("--trials", type=int, default=K.SEARCH_TRIALS)
    jobs.choices["errors"].add_argument("--oof", required=True)
    jobs.choices["score"].add_argument("--test", required=True)
    jobs.choices["score"].add_argument("--model-dir", required=True)
    return top


if __name__ == "__main__":
    run(tune(SparkSession.builder.appName("ledgerspark").getOrCreate()), parser().parse_args())

"""Command line: ``python -m demandspark benchmark|train|score`` or the same through spark-submit."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from demandspark.operators.boosting import BoostingSettings
from demandspark.plans import jobs
from demandspark.schemas import FOLD_COUNT, TRACKS


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="demandspark", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("benchmark", "train"):
        c = commands.add_parser(name)
        c.add_argument("--data-dir", required=True, help="folder of the CSV source files")
        c.add_argument("--work-dir", required=True, help="shared folder for track and feature tables")
        c.add_argument("--track", default="fresh_weekly", choices=list(TRACKS))
        c.add_argument("--stores", nargs="*", help="only these stores")
        c.add_argument("--sample", type=int, help="only this many series, drawn with a fixed seed")
        c.add_argument("--rounds", type=int, default=BoostingSettings.rounds)
    bench = commands.choices["benchmark"]
    bench.add_argument("--out-dir", required=True)
    bench.add_argument("--folds", type=int, default=FOLD_COUNT)
    bench.add_argument("--smoothing", action="store_true", help="include exponential smoothing")
    train = commands.choices["train"]
    train.add_argument("--models-dir", required=True)
    train.add_argument("--models", nargs="*", default=list(jobs.MODELS))
    score = commands.add_parser("score")
    score.add_argument("--models-dir", required=True)
    score.add_argument("--requests", required=True, help="Parquet table of id, horizon, model_name")
    score.add_argument("--out-dir", required=True)
    return parser


def main(argv: list[str] | None = None) -> None:
    args = arguments().parse_args(argv)
    spark = SparkSession.builder.appName(f"demandspark {args.command}").getOrCreate()
    if args.command == "score":
        answers = jobs.score(spark, args.models_dir, spark.read.parquet(args.requests))
        answers.write.mode("overwrite").parquet(args.out_dir)
        return
    inputs = jobs.prepare(spark, args.data_dir, args.work_dir, args.track, args.stores, args.sample)
    settings = BoostingSettings(rounds=args.rounds)
    if args.command == "benchmark":
        tables = jobs.benchmark(inputs, args.out_dir, args.folds, args.smoothing, settings)
        tables["audit"].show()
        tables["summary"].show(truncate=False)
        jobs.top_features(tables["importance"]).show(truncate=False)
    else:
        for path in jobs.train_and_publish(inputs, args.models_dir, args.models, settings):
            print(path)


if __name__ == "__main__":
    main()

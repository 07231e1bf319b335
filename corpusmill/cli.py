"""Command line: generate, filter, rag-qa, templated."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusmill.config import LanguageConfig, TaskSpec, load_config
from corpusmill.operators.filters import FilterPipeline
from corpusmill.operators.reports import class_distribution, language_summary
from corpusmill.plans.builder import DatasetBuilder
from corpusmill.plans.strategies import STRATEGIES, Run, questions, restyled
from corpusmill.sources.files import filtered_path, load_chunks, load_samples, read_csv, save_csv, stamped_path, write_json

#: A task for the commands that need none of their own.
PLAIN_TASK = TaskSpec("text generation", {0: "other", 1: "text"}, "Generate text.")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusmill", description="Build and curate labelled text datasets with Spark.")
    sub = top.add_subparsers(dest="command")

    def command(name: str, **options) -> argparse.ArgumentParser:
        p = sub.add_parser(name, **options)
        p.add_argument("--output", "-o")
        p.add_argument("--provider", default="openai")
        p.add_argument("--model", "-m")
        return p

    p = command("generate", help="make samples")
    p.add_argument("--config", "-c", required=True)
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("--language", "-l")
    which.add_argument("--all", "-a", action="store_true")
    p.add_argument("--num-samples", "-n", type=int, default=1000)
    p.add_argument("--strategies", nargs="+", default=["direct"], choices=list(STRATEGIES))
    p.add_argument("--weights", nargs="+", type=float)
    p.add_argument("--data-dir")
    p.add_argument("--label-column", default="label")
    p.add_argument("--output-dir", dest="output")
    p.add_argument("--no-filter", action="store_true")

    p = command("filter", help="filter samples in a file")
    p.add_argument("--input", "-i", required=True)
    p.add_argument("--config", "-c", required=True)
    p.add_argument("--original-data")
    p.add_argument("--language", "-l", default="en")
    p.add_argument("--no-embeddings", action="store_true")

    for name, text in (("rag-qa", "questions and answers from text files"), ("templated", "new texts in the style of text files")):
        p = command(name, help=text)
        p.add_argument("--input", "-i", required=True)
        p.add_argument("--num-samples", "-n", type=int, default=5 if name == "rag-qa" else 1)
        p.add_argument("--language", "-l", default="English")
        if name == "templated":
            for option in ("--source-topic", "--target-topic", "--style"):
                p.add_argument(option, required=True)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, provider=None, translator=None) -> int:
    args = parser().parse_args(argv)
    if args.command is None:
        parser().print_help()
        return 1
    spark = spark or SparkSession.builder.appName("corpusmill").getOrCreate()
    now = datetime.now(UTC)
    task, languages = load_config(args.config) if "config" in args else (PLAIN_TASK, None)
    run = Run(spark, task, provider or args.provider, translator, languages or LanguageConfig.single(), run_id=now.isoformat(), run_at=now.isoformat(), model=args.model)
    if args.command == "generate":
        builder, folder = DatasetBuilder(run), args.output or "synthetic_data"
        if args.all:
            df, errors = builder.generate_all(args.num_samples, args.strategies, args.weights, args.data_dir, args.label_column, not args.no_filter, f"{folder}/{now:%Y%m%d_%H%M%S}")
            language_summary(df, run.languages.all_language_codes()).orderBy("language").show(truncate=False)
            for code, error in errors.items():
                print(f"{code}: {error}", file=sys.stderr)
        else:
            original = load_samples(spark, f"{args.data_dir}/{args.language}.csv", args.label_column) if args.data_dir else None
            path = stamped_path(folder, args.language)
            df = builder.generate(args.language, args.num_samples, args.strategies, args.weights, original, not args.no_filter, save_path=path)
            class_distribution(df).orderBy(F.col("n").desc()).show()
            print(path)
    elif args.command == "filter":
        def ordered(path: str):
            return read_csv(spark, path).withColumn("label", F.expr("try_cast(try_cast(label AS double) AS int)")).withColumn("ord", F.monotonically_increasing_id())

        original = ordered(args.original_data) if args.original_data else None
        filters = FilterPipeline.default(task, language=args.language, use_embeddings=not args.no_embeddings, original=original)
        print(save_csv(filters.run(ordered(args.input)).drop("ord"), args.output or filtered_path(args.input)))
    else:
        texts = load_chunks(spark, args.input)
        if texts.isEmpty():
            raise ValueError("the input needs a non-empty text")
        df = questions(run, texts, args.num_samples, args.language) if args.command == "rag-qa" else restyled(run, texts, args.source_topic, args.target_topic, args.style, args.num_samples, args.language)
        if args.output:
            print(save_csv(df, args.output))
        else:
            write_json(df, sys.stdout)
            print()
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Command line: python -m cellgrove.plans.cli FOLDER INPUT... [--step data ...] [--no-search]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from ..sources.transactions import read_transactions, resolve
from .pipeline import Pipeline


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("folder", help="where the tables go")
    parser.add_argument("inputs", nargs="*", help="CSV files or Parquet folders of transactions; the configured path if there is none")
    parser.add_argument("--step", action="append", choices=Pipeline.STEPS, help="run this stage only; may be repeated")
    parser.add_argument("--no-search", action="store_true", help="fit with the default parameters")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("cellgrove").getOrCreate()
    pipeline = Pipeline(spark, args.folder)
    for step in args.step or Pipeline.STEPS:
        if step == "data":
            pipeline.data(read_transactions(spark, *([resolve(p, p) for p in args.inputs] or [resolve(None, pipeline.config.transactions)])))
        elif step == "train":
            pipeline.train(not args.no_search)
        else:
            getattr(pipeline, step)()
    if not args.step and (wrong := pipeline.validate()):
        raise SystemExit("\n".join(wrong))


if __name__ == "__main__":
    main()

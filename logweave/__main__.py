"""``python -m logweave ROOT``: mine the labelled datasets below a folder, and print a result line for each and the average."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.metrics import parse_results, result_line, with_average
from .plans.pipeline import evaluate_dataset
from .sources.config import DATASETS, MODES, dataset_paths


def main(args: list[str] | None = None) -> list[str]:
    parser = argparse.ArgumentParser(prog="logweave", description="Mine and score labelled logs.")
    parser.add_argument("root", help="folder of the collections; any that Spark can read")
    parser.add_argument("--mode", type=str.upper, choices=MODES, default="2K", help="size of the datasets")
    parser.add_argument("--labels", type=str.lower, choices=("corrected", "raw"), default="corrected")
    parser.add_argument("--dataset", action="append", choices=DATASETS, help="one of several; all if not given")
    parser.add_argument("--chunk", type=int, help="lines mined at a time; all at once if not given")
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("logweave").getOrCreate()
    out = []
    for name in given.dataset or DATASETS:
        row = evaluate_dataset(spark, name, dataset_paths(given.root, name, given.mode, given.labels), chunk_size=given.chunk)
        out.append(result_line(row))
        print(out[-1], flush=True)
    runs = parse_results(spark.createDataFrame([(x,) for x in out], "value string"))
    with_average(runs).show(len(out) + 1, truncate=False)
    return out


if __name__ == "__main__":
    main()

"""Command lines of the whole jobs: `python -m siftloom.cli cluster|filter|clean ...`."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from siftloom.plans import resolve

MODEL = "./model_store/entity_verifier"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siftloom", description="Name clustering and trade-code filters on Spark.")
    jobs = top.add_subparsers(dest="job", required=True)
    cluster = jobs.add_parser("cluster", help="cluster the names of one column of each CSV file")
    cluster.add_argument("--input-dir", required=True)
    cluster.add_argument("--output-dir", required=True)
    cluster.add_argument("--columns", nargs="+", required=True, help="candidate columns, the first that a file has is used")
    cluster.add_argument("--feedback", help="reviewed clusters: a CSV file with cluster and label")
    cluster.add_argument("--emit-review", type=int, default=0, help="clusters to export for review")
    cluster.add_argument("--review-dir", help="where they go; the output folder by default")
    cluster.add_argument("--model-dir", default=MODEL)
    cluster.add_argument("--constraints-dir", help="a JSON file, or a folder for constraints.json; the model's folder by default")
    code_filter = jobs.add_parser("filter", help="keep rows with wanted codes in comma lists, for all CSV files below a folder")
    code_filter.add_argument("--input", "--input-dir", dest="input", required=True)
    code_filter.add_argument("--output", "--output-dir", dest="output", required=True)
    clean = jobs.add_parser("clean", help="keep rows with wanted codes in semicolon lists, for given CSV files")
    clean.add_argument("files", nargs="+")
    clean.add_argument("--output", default=".", help="folder of the results")
    return top


def constraints_file(given: str | None, model: str) -> str:
    place = given or model
    return place if place.endswith(".json") else f"{place.rstrip('/')}/constraints.json"


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one job; 0 if some file gave a result."""
    given = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName(f"siftloom-{given.job}").getOrCreate()
    if given.job == "cluster":
        model = given.model_dir.rstrip("/")
        done = resolve.cluster_folder(
            spark, given.input_dir, given.output_dir, given.columns, reviewed=given.feedback, emit_review=given.emit_review,
            review_target=given.review_dir, model_path=f"{model}/model", constraints_path=constraints_file(given.constraints_dir, model),
        )
        print(f"{done} files clustered")
        return int(not done)
    if given.job == "filter":
        results = resolve.filter_folder(spark, given.input, given.output)
        for path, kept, total in results:
            print(f"{path}: {kept} of {total} rows kept")
        return int(not results)
    stems = resolve.filter_files(spark, given.files, given.output)
    print(f"{len(stems)} of {len(given.files)} files filtered")
    return int(not stems)


if __name__ == "__main__":
    raise SystemExit(main())

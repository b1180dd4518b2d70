"""spark-submit entry points: run (documents to artifacts), db (index counts) and validate (completeness)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans.artifacts import LISTS, artifacts
from .sources.writers import write_json


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidewatch")
    parser.add_argument("command", choices=("run", "db", "validate"))
    parser.add_argument("--input", required=True, help="Parquet of documents (doc_id, text, source)")
    parser.add_argument("--output", help="folder for the artifacts' JSON")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    rows = artifacts(spark.read.parquet(args.input))
    if args.command == "run":
        if not args.output:
            parser.error("run needs --output")
        write_json(rows, args.output)
    elif args.command == "db":
        rows.agg(F.count("*").alias("documents"), *(F.sum(F.size(c)).alias(c) for c in LISTS)).show(truncate=False)
    else:
        rows.groupBy("completeness").agg(F.count("*").alias("documents")).orderBy("completeness").show()


if __name__ == "__main__":
    main()

"""Command line: python -m strandmill.cli STEP ...; each step reads tables, runs one operator and writes its result."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from strandmill.functions import args as parse
from strandmill.session import get_spark


def _query(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from strandmill.plans.catalog import QUERIES

    if a.name not in QUERIES:
        raise SystemExit(f"unknown query {a.name!r}")
    return QUERIES[a.name](spark, a.data)


def _tokenize(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from strandmill.operators.registry import tokenize

    more = {"codebook": spark.read.parquet(a.codebook)} if a.codebook else {}
    return tokenize(a.tokenizer, spark.read.parquet(a.rows), **more)


def _fit(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from strandmill.operators.quantize import kmeans_fit

    return kmeans_fit(spark.read.parquet(a.rows), a.codes, a.rounds, a.seed)


def _eta(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from functools import reduce

    from pyspark.sql import functions as F

    from strandmill.operators.stats import eta_squared

    parts = [eta_squared(spark.read.parquet(path), a.value, a.group, a.min_count).withColumn("tag", F.lit(tag)) for tag, path in map(parse.named, a.tables)]
    return reduce(DataFrame.unionByName, parts)


def _rmsf(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from strandmill.operators.geometry import rmsf

    return rmsf(spark.read.parquet(a.rows), a.rounds)


def _jobs(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    from strandmill.operators.labels import round_robin

    i, n = parse.shard(a.shard)
    return round_robin(spark.read.parquet(a.rows), n, i, a.order)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandmill", description=__doc__)
    p.add_argument("--out", help="folder of the Parquet result; shown if left out")
    p.add_argument("--cores", default="*")
    step = p.add_subparsers(dest="step", required=True)

    def add(name: str, run, *options: tuple[str, dict]) -> None:
        s = step.add_parser(name)
        for option, how in options:
            s.add_argument(option, **how)
        s.set_defaults(run=run)

    rows = ("rows", {})
    add("query", _query, ("name", {}), ("data", {}))
    add("tokenize", _tokenize, ("tokenizer", {}), rows, ("--codebook", {}))
    add("fit", _fit, rows, ("--codes", {"type": int, "default": 2048}), ("--rounds", {"type": int, "default": 20}), ("--seed", {"type": int, "default": 0}))
    add("eta", _eta, ("tables", {"nargs": "+", "metavar": "NAME=PATH"}), ("--value", {"default": "rmsf"}), ("--group", {"default": "token"}), ("--min-count", {"type": int, "default": 80}))
    add("rmsf", _rmsf, rows, ("--rounds", {"type": int, "default": 3}))
    add("jobs", _jobs, rows, ("--shard", {"default": "0/1"}), ("--order", {"default": "job"}))
    return p


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    out = a.run(get_spark(a.cores), a)
    if a.out:
        out.write.mode("overwrite").parquet(a.out)
    else:
        out.show(truncate=False)


if __name__ == "__main__":
    main()

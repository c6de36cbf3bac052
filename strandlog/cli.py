"""Compress text files to block tables and back: python -m strandlog.cli compress IN OUT, ... decompress IN OUT.

IN of compress is a path of text files for Spark's reader, OUT a folder of blocks (Parquet); decompress writes one text
file for each stream. What was done is printed as one JSON line: lines, blocks, bytes, ratio, seconds of each phase.
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandlog.functions import codecs
from strandlog.functions.distances import NAMES
from strandlog.operators import blocks
from strandlog.sources.lines import text_lines, write_lines


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandlog", description=__doc__.splitlines()[0])
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compress")
    c.add_argument("--codec", choices=codecs.NAMES, default="none")
    c.add_argument("--window", type=int, default=8)
    c.add_argument("--threshold", type=float, default=0.06)
    c.add_argument("--block-size", type=int, default=blocks.BLOCK)
    c.add_argument("--distance", choices=NAMES, default="minhash")
    c.add_argument("--exact", action="store_true", help="least-cost scripts, for short lines")
    c.add_argument("--q", type=int, default=3)
    c.add_argument("--anchor", choices=("segment", "stream"), default="segment")
    c.add_argument("--mode", choices=("errorifexists", "overwrite", "append"), default="errorifexists")
    for s in (c, sub.add_parser("decompress")):
        s.add_argument("source")
        s.add_argument("target")
    return p


def run(spark: SparkSession, argv: list[str]) -> dict:
    """Do what argv says; returns the report."""
    a = parser().parse_args(argv)
    began = time.perf_counter()
    if a.command == "compress":
        lines = text_lines(spark, a.source)
        made = blocks.compress(lines, codec=a.codec, window=a.window, threshold=a.threshold, block_size=a.block_size, distance=a.distance, approx=not a.exact, q=a.q, anchor=a.anchor)
        blocks.write(made, a.target, a.mode)
        done = time.perf_counter()
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("n_lines", "lines"), ("n_delta", "delta"), ("raw_bytes", "raw_bytes"), (F.length("payload"), "payload_bytes"))]
        report = spark.read.parquet(a.target).agg(F.count("*").alias("blocks"), *sums).first().asDict()
        report["ratio"] = report["raw_bytes"] / report["payload_bytes"] if report["payload_bytes"] else 0.0
    else:
        write_lines(blocks.decompress(spark.read.parquet(a.source)), a.target)
        done, report = time.perf_counter(), {}
    return report | {"command": a.command, "seconds": round(done - began, 3), "total_seconds": round(time.perf_counter() - began, 3)}


def main() -> None:
    import sys

    spark = SparkSession.builder.appName("strandlog").getOrCreate()
    print(json.dumps(run(spark, sys.argv[1:])))
    spark.stop()


if __name__ == "__main__":
    main()

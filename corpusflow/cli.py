"""Command line: lines of text through the pipeline of a profile."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from corpusflow import __version__
from corpusflow.plans.profile import load_profile
from corpusflow.plans.stats import Statistics, legacy_report
from corpusflow.sources.storage import written
from corpusflow.sources.lines import ordered_texts, read_lines, spooled_stdin, write_lines, write_ordered


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusflow", description="Run a profile's pipeline over lines of text.")
    p.add_argument("-p", "--profile", required=True, help="Python file with a Pipeline as FILTER, or a function as FACTORY")
    p.add_argument("--args", nargs="+", default=[], help="arguments of FACTORY")
    p.add_argument("-i", "--input", help="file or folder to read; standard input by default")
    p.add_argument("-o", "--output", help="file to write, in the order of the input; standard output by default")
    p.add_argument("--output-dir", help="folder to write in parallel instead, without an order")
    p.add_argument("--dump-stats", metavar="FILE", help="append the statistics to a file, as a line of JSON")
    p.add_argument("--exit-on-error", action="store_true", help="fail on the first document in which a stage fails; else it is rejected")
    p.add_argument("--all", action="store_true", help="write rejected documents, too")
    p.add_argument("-j", "--jobs", type=int, help="local threads; all cores by default")
    p.add_argument("-v", "--version", action="version", version=__version__)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    pipeline = load_profile(args.profile, *args.args)
    pipeline._on_error = "raise" if args.exit_on_error else "reject"
    builder = SparkSession.builder.appName("corpusflow").config("spark.ui.showConsoleProgress", "false")
    if "MASTER" not in os.environ and not os.environ.get("SPARK_MASTER_URL"):
        builder = builder.master(f"local[{args.jobs or '*'}]")
    spark = builder.getOrCreate()
    spooled = None if args.input else spooled_stdin()
    try:
        docs, seen = pipeline.observed(read_lines(spark, args.input or spooled))
        if args.output_dir:
            write_lines(docs, args.output_dir, args.all)
        else:  # stored first: sorting reads its input twice, and the counters are those of one complete pass
            texts = ordered_texts(written(docs.select("doc_id", "text", "is_rejected"), "lines"), args.all)
            if args.output:
                with open(args.output, "w", encoding="utf-8") as f:
                    write_ordered(texts, f)
            elif not write_ordered(texts):
                return 1
        values = pipeline.observed_statistics(seen.get)
    finally:
        if spooled:
            os.unlink(spooled)
    report = legacy_report(values)
    print(json.dumps(report, ensure_ascii=False, indent=2), file=sys.stderr)
    if args.dump_stats:
        with open(args.dump_stats, "a", encoding="utf-8") as f:
            f.write(json.dumps(report, ensure_ascii=False) + "\n")
    return 0


__all__ = ["Statistics", "main", "parser"]

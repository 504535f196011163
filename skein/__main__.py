"""Command line: ``python -m skein demux ...`` and ``python -m skein subsample ...``."""

from __future__ import annotations

import argparse
import logging
import os

from pyspark.sql import SparkSession

from skein.operators.sampling import GENERATORS
from skein.plans.demux import Demux
from skein.plans.subsample import Subsample


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="skein")
    sub = top.add_subparsers(dest="command", required=True)
    d = sub.add_parser("demux", help="reads to files for each sample")
    d.add_argument("-i", "--inputs", nargs="+", required=True)
    d.add_argument("-r", "--read-structures", nargs="+", required=True)
    d.add_argument("-b", "--output-types", default="T")
    d.add_argument("-s", "--sample-metadata", required=True)
    d.add_argument("-o", "--output", required=True)
    d.add_argument("-u", "--unmatched-prefix", default="unmatched")
    d.add_argument("--max-mismatches", type=int, default=1)
    d.add_argument("-d", "--min-mismatch-delta", type=int, default=2)
    d.add_argument("-t", "--threads", type=int, default=8)
    d.add_argument("-c", "--compression-level", type=int, default=5)
    d.add_argument("-S", "--skip-reasons", nargs="*", default=[])
    s = sub.add_parser("subsample", help="the same random records of every file")
    s.add_argument("-i", "--inputs", nargs="+", required=True)
    s.add_argument("-o", "--output", required=True)
    s.add_argument("-f", "--fraction", type=float, required=True)
    s.add_argument("-t", "--threads", type=int, default=8)
    s.add_argument("-c", "--compression-level", type=int, default=5)
    s.add_argument("-s", "--seed", type=int)
    s.add_argument("--disable-read-name-checking", action="store_true")
    s.add_argument("--generator", default="md5", choices=sorted(GENERATORS))
    return top


def main(argv: list[str] | None = None) -> None:
    logging.basicConfig(level=os.environ.get("SKEIN_LOG", "INFO").upper())
    options = vars(parser().parse_args(argv))
    kind = {"demux": Demux, "subsample": Subsample}[options.pop("command")]
    spark = SparkSession.builder.appName("skein").getOrCreate()
    result = kind(**options).execute(spark)
    if isinstance(result, tuple):
        logging.info("read %s records, kept %s (%.2f%%)", f"{result[0]:,}", f"{result[1]:,}", result[2])
    else:
        result.show(truncate=False)


if __name__ == "__main__":
    main()

"""Command line: python -m lattica analyze [ROOT | --project NAME] [--out DIR] | visualize [ROOT | --project NAME] --out FILE.

Without --config the nearest configuration file of the working folder, its folder src and the folders above is taken; defaults if there is none.
"""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    """0: done; 1: an input or configuration is wrong; 2: the run failed."""
    p = argparse.ArgumentParser(prog="lattica", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, what in (("analyze", "scan, cluster and report"), ("visualize", "scan and export the graph")):
        s = sub.add_parser(name, help=what)
        s.add_argument("root", nargs="?")
        s.add_argument("--project")
        s.add_argument("--out", required=name == "visualize")
        s.add_argument("--config")
        if name == "visualize":
            s.add_argument("--format", choices=["json", "graphml"], default="json")
    args = p.parse_args(argv)
    from pyspark.sql import SparkSession

    from .config import Config, find, load, source_and_output
    from .plans.analysis import Analyzer, run

    try:
        path = args.config or find()
        config = load(path) if path else Config()
        root, out = map(str, source_and_output(config.root, args.root, args.project, args.out))
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("lattica").getOrCreate()
    try:
        if args.command == "analyze":
            print(run(spark, root, out, config))
        else:
            Analyzer(spark, root, config).analyze().export(out, args.format)
    except Exception as e:
        print(f"failed: {e}", file=sys.stderr)
        return 2
    return 0

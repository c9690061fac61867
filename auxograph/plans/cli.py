"""Command line: run a plan, list plans, draw diagrams.

    python -m auxograph.plans.cli run plan.yaml name -o out -i raw_data=plate.csv
    python -m auxograph.plans.cli list plan.yaml
    python -m auxograph.plans.cli draw plan.yaml --format graphviz --output plan.dot
"""

from __future__ import annotations

import argparse
import logging
import os
import sys

from auxograph.plans import diagrams
from auxograph.plans.yaml_plans import PlanError, build


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="auxograph", description="Run and draw plans.")
    commands = p.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="run a plan and write its outputs")
    run.add_argument("yaml_file")
    run.add_argument("pipeline_name")
    run.add_argument("-o", "--output-dir")
    run.add_argument("-i", "--input", action="append", default=[], metavar="NAME=PATH")
    run.add_argument("-v", "--verbose", action="store_true")
    names = commands.add_parser("list", help="list the plans of a file")
    names.add_argument("yaml_file")
    draw = commands.add_parser("draw", help="draw the plans of a file")
    draw.add_argument("yaml_file")
    draw.add_argument("--pipeline")
    draw.add_argument("--format", choices=sorted(diagrams.FORMATS), default="mermaid")
    draw.add_argument("--output")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    try:
        with open(args.yaml_file, encoding="utf-8") as f:
            text = f.read()
        if args.command == "list":
            print("\n".join(diagrams.plan_names(text)))
            return 0
        if args.command == "draw":
            drawn = diagrams.diagram(text, args.format, args.pipeline)
            if args.output:
                with open(args.output, "w", encoding="utf-8") as f:
                    f.write(drawn)
            else:
                print(drawn)
            return 0
        logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
        if odd := [x for x in args.input if "=" not in x]:
            raise PlanError(f"not NAME=PATH: {', '.join(odd)}")
        sources = dict(x.split("=", 1) for x in args.input)
        if args.output_dir:
            os.makedirs(args.output_dir, exist_ok=True)
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("auxograph").getOrCreate()
        results = build(text, args.pipeline_name, args.output_dir, sources).run(spark)
        for name, value in results.items():
            print(f"{name}: {type(value).__name__}")
        return 0
    except (OSError, ValueError, TypeError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

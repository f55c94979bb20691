"""Command line: python -m goldlink --input-dir DIR --config FILE [--output-dir DIR] [--format files|lines|table] [-v]."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from goldlink.plans.policy import ProjectionConfig


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="goldlink", description="Merge candidate records from many sources into golden records.")
    parser.add_argument("--input-dir", required=True)
    parser.add_argument("--config", required=True)
    parser.add_argument("--output-dir", default="output")
    parser.add_argument("--format", choices=("files", "lines", "table"), default="files")
    parser.add_argument("--enable-notes", action="store_true", help="read .txt notes too")
    parser.add_argument("--strict", action="store_true", help="count warnings as invalid")
    parser.add_argument("--verbose", "-v", action="store_true")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.WARNING, format="%(levelname)s %(name)s: %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    if not os.path.isdir(args.input_dir) and "://" not in args.input_dir:
        parser.error(f"no such folder: {args.input_dir}")
    if not os.path.isfile(args.config):
        parser.error(f"no such file: {args.config}")
    try:
        config = ProjectionConfig.load(args.config)
    except ValueError as e:
        print(f"Invalid config: {e}", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from goldlink.plans import pipeline
    from goldlink.plans.scratch import sweep
    from goldlink.sources import sink

    spark = SparkSession.builder.appName("goldlink").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    folder = args.input_dir if "://" in args.input_dir else "file://" + os.path.abspath(args.input_dir)
    if not pipeline.registry.discover(spark, folder):
        print("No sources found.", file=sys.stderr)
        return 1
    made = pipeline.run(spark, folder, config, enable_notes=args.enable_notes, strict=args.strict)
    if made.records.isEmpty():
        print("No records extracted.", file=sys.stderr)
        return 1
    if args.format == "files":
        print(f"{sink.write_files(made.validated, args.output_dir)} profiles written to {args.output_dir}")
    elif args.format == "lines":
        sink.write_lines(made.validated, args.output_dir)
    else:
        sink.write_table(made.validated, args.output_dir)
    for row in made.rejects.toLocalIterator():
        print(f"rejected {row['profile_id'][:8]}: {row['message']}", file=sys.stderr)
    for path in made.sources_failed:
        print(f"failed: {path}", file=sys.stderr)
    sweep()
    return 0


if __name__ == "__main__":
    sys.exit(main())

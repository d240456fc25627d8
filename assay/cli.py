"""spark-submit cli.py scan PATH... | detect PATH..."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from assay.functions.detect import detect
from assay.functions.durable import durable, forget_all
from assay.functions.ship import ship
from assay.functions.values import SEVERITIES
from assay.plans.guard import scan
from assay.plans.http import observed, to_json, to_text
from assay.plans.policy import Policy
from assay.sources.folder_sink import write_sanitized_files
from assay.sources.payloads import from_files, write_sanitized_file


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="assay")
    out.add_argument("--version", action="version", version="assay 0.1")
    commands = out.add_subparsers(dest="command", required=True)
    s = commands.add_parser("scan", help="the whole policy over files")
    s.add_argument("files", nargs="+")
    s.add_argument("--allow", action="append", metavar="RULE")
    s.add_argument("--block", action="append", metavar="RULE")
    s.add_argument("--max-size", type=int, metavar="BYTES")
    s.add_argument("--threshold", choices=list(SEVERITIES.values()), default="MEDIUM")
    s.add_argument("--no-sanitize", action="store_true")
    s.add_argument("--lenient-extension", action="store_true")
    s.add_argument("--json", action="store_true")
    s.add_argument("--write-sanitized", metavar="PATH", help="the file that was put right; of several, a folder")
    d = commands.add_parser("detect", help="the types of files")
    d.add_argument("files", nargs="+")
    d.add_argument("--json", action="store_true")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("assay").getOrCreate()
    ship(spark)
    try:
        payloads = from_files(spark, args.files, getattr(args, "max_size", None))
    except AnalysisException as e:  # a path that cannot be listed
        print(str(e).splitlines()[0], file=sys.stderr)
        return 2
    if args.command == "detect":
        found = detect(payloads).select("payload_id", "detected")
        lines = found.select(F.to_json(F.struct(F.col("payload_id").alias("file"), "detected.*")) if args.json else F.format_string("%s: %s (%s)", "payload_id", "detected.mime", "detected.description"))
        for (line,) in lines.toLocalIterator():
            print(line)
        return 0
    policy = Policy(allowed=args.allow, max_size=args.max_size, reject_threshold={v: k for k, v in SEVERITIES.items()}[args.threshold], sanitize_svg=not args.no_sanitize, strict_extension=not args.lenient_extension)
    if args.block is not None:
        policy = policy.with_(blocked=tuple(args.block))
    found, seen = observed(scan(payloads, policy))
    results = durable(found)  # and counted on the way
    for row in (to_json(results) if args.json else to_text(results)).toLocalIterator():
        print(row[1])
    if args.write_sanitized and len(args.files) == 1 and not os.path.isdir(args.files[0]):
        write_sanitized_file(results, args.write_sanitized)
    elif args.write_sanitized:
        write_sanitized_files(results, args.write_sanitized if "://" in args.write_sanitized else f"file://{os.path.abspath(args.write_sanitized)}")
    told = seen.get
    print(f"{told['payloads']} payloads, {told['rejected']} rejected, {told['findings']} findings: {', '.join(told['codes']) or 'none'}", file=sys.stderr)
    forget_all(spark)
    return told["exit_code"]


if __name__ == "__main__":
    sys.exit(main())

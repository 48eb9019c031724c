"""Command line: cmp TEXT, met GRAMMAR, acc GRAMMAR STR:START-END..., mrg A B."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gramloom import __version__
from gramloom.plans.compress import Options, compress_file, merge_files, query_file
from gramloom.sources import storage


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="gramloom")
    top.add_argument("-v", "--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("cmp", help="build a grammar from a text file, one string a line")
    c.add_argument("text")
    c.add_argument("-o", "--output-file")
    c.add_argument("-q", "--skip-simp", action="store_true")
    c.add_argument("-e", "--skip-rl", action="store_true")
    c.add_argument("-r", "--random-support", action="store_true")
    c.add_argument("-g", "--check-gram", action="store_true")
    c.add_argument("-t", "--threads", type=int)
    c.add_argument("-c", "--chunk-size", type=int)
    m = sub.add_parser("met", help="print a grammar's metadata")
    m.add_argument("grammar")
    a = sub.add_parser("acc", help="print substrings")
    a.add_argument("grammar")
    a.add_argument("coordinates", nargs="+")
    j = sub.add_parser("mrg", help="merge stored grammars")
    j.add_argument("grammars", nargs="+")
    j.add_argument("-o", "--output-file", required=True)
    args = top.parse_args(argv)
    builder = SparkSession.builder.appName("gramloom")
    if getattr(args, "threads", None):
        builder = builder.master(f"local[{args.threads}]")
    spark = builder.getOrCreate()
    if args.command == "cmp":
        options = Options(run_length=not args.skip_rl, simplify=not args.skip_simp, random_access=args.random_support, verify=args.check_gram, split_bytes=args.chunk_size)
        compress_file(spark, args.text, args.output_file or f"{args.text}.grammar", options)
    elif args.command == "met":
        for name, value in storage.metadata(spark, args.grammar).first().asDict().items():
            print(f"{name}: {value}")
    elif args.command == "acc":
        for row in query_file(spark, args.grammar, args.coordinates).select("query", F.unhex("hex").alias("bytes")).collect():
            print(f"{row['query']}\n{bytes(row['bytes']).decode('utf-8', 'replace')}")
    else:
        merge_files(spark, args.grammars, args.output_file)


if __name__ == "__main__":
    main()

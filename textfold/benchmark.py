"""Command line of the comparison of styles and formats: ``python -m textfold.benchmark -i PATH [--tokenizer NAME] [--json-out FILE]``."""

from __future__ import annotations

import argparse
import os
import sys

COLUMNS = (
    ("config", "configuration", "<30", ""),
    ("orig_tokens", "input", ">9", "d"),
    ("comp_tokens", "body", ">9", "d"),
    ("map_tokens", "map", ">8", "d"),
    ("proto_tokens", "proto", ">6", "d"),
    ("net_tokens", "net saved", ">9", "d"),
    ("net_pct", "net %", ">7", ".2f"),
    ("time_ms", "ms", ">9", ".1f"),
    ("status", "status", ">6", ""),
)


def render(rows: list[dict], tokenizer: str) -> str:
    """The rows of an ablation as a table."""
    told = [{**r, "status": "PASS" if r["roundtrip_ok"] else "FAIL"} for r in rows]
    lines = [" | ".join(format(title, width) for _, title, width, _ in COLUMNS)]
    lines += [" | ".join(format(r[key], width + kind) for key, _, width, kind in COLUMNS) for r in told]
    rule = "-" * len(lines[0])
    return "\n".join([f"token economy by placeholder style and map format (tokenizer: {tokenizer})", rule, lines[0], rule, *lines[1:], rule])


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="textfold.benchmark")
    parser.add_argument("-i", "--input", required=True, help="file or folder")
    parser.add_argument("--tokenizer", default="heuristic", help="heuristic, cl100k_base, o200k_base, ranks:FILE or hf:FILE")
    parser.add_argument("--json-out", help="also write the rows as JSON to this file")
    args = parser.parse_args(argv)
    if not os.path.exists(args.input):
        print(f"{args.input} does not exist", file=sys.stderr)
        return 1

    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .functions.tokens import get_counter
    from .plans import compress
    from .runtime import reachable
    from .sources import files, sinks

    spark = reachable(SparkSession.builder.appName("textfold-benchmark").getOrCreate())
    counter = get_counter(args.tokenizer)
    docs = sinks.settle(files.load_texts(files.scan(spark, os.path.abspath(args.input), with_content=True)), "docs")
    sizes = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    print(f"{args.input}: {sizes['n']} files, {sizes['chars']} characters")
    rows = compress.ablation(docs, counter)
    print(render(rows, counter.name))
    if args.json_out:
        sinks.write_json(args.json_out, rows)
    return 0 if all(r["roundtrip_ok"] for r in rows) else 2


if __name__ == "__main__":
    sys.exit(main())

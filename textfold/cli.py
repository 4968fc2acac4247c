"""Command line: compact a folder, a file, or standard input."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from . import __version__


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textfold", description="Compact texts for language models, with an exact way back.")
    p.add_argument("--input", "-i", required=True, help="folder, file, or - for standard input")
    p.add_argument("--input-list", action="store_true", help="the input is a file that names one file on each line")
    p.add_argument("--stdin-ext", default="txt", help="type of standard input")
    p.add_argument("--output", "-o", default=None)
    p.add_argument("--stdout", action="store_true")
    p.add_argument("--envelope", "-e", action="store_true")
    p.add_argument("--include-pointless", action="store_true")
    p.add_argument("--mode", choices=["lossless", "semantic", "aggressive"], default="lossless")
    p.add_argument("--preset", choices=["conservative", "code-max", "text-balanced", "aggressive"])
    p.add_argument("--tokenizer", default="heuristic", help="heuristic, ranks:FILE or hf:FILE")
    p.add_argument("--placeholder-style", default="auto")
    p.add_argument("--mapping-format", default="auto")
    flags = {
        "--strip-comments": "comments",
        "--strip-docstrings": "docstrings",
        "--strip-types": "types",
        "--strip-license": "license",
        "--compact-errors": "errors",
        "--prune-imports": "imports",
        "--prune-asserts": "asserts",
        "--strip-ansi": "ansi",
        "--strip-badges": "badges",
        "--compact-tables": "tables",
        "--python-rename-locals": "rename_locals",
        "--python-rename-private": "rename_private",
        "--strip-argparse-text": "argparse_text",
        "--normalize-indent": "tabs",
    }
    for name, dest in flags.items():
        p.add_argument(name, dest=dest, action="store_true", default=None)
    p.add_argument("--semantic-minify", action="store_true", help="all canonical forms")
    p.add_argument("--keep-empty-lines", action="store_true")
    for name, dest in (("--L_min", "l_min"), ("--L_max", "l_max"), ("--N_min", "n_min"), ("--B_min_lines", "b_min"), ("--B_max_lines", "b_max"), ("--min_total_saving", "min_saving")):
        p.add_argument(name, dest=dest, type=int)
    p.add_argument("--chunk-output", action="store_true")
    p.add_argument("--chunk-size", type=int, default=16_000)
    p.add_argument("--verify-roundtrip", action="store_true")
    p.add_argument("--export-manifest", action="store_true")
    p.add_argument("--no-export-mapping", nargs="?", const="", default=None, help="alone: export no codebook; with names: leave these files out of it")
    p.add_argument("--version", action="version", version=__version__)
    return p


def main(argv: list[str] | None = None) -> int:
    """0 if all went well, 1 on errors, 2 if the round trip failed."""
    from pyspark.errors import PySparkException

    args = parser().parse_args(argv)
    try:
        return run(args)
    except (OSError, ValueError, PySparkException) as e:
        print(f"textfold: {e}", file=sys.stderr)
        return 1


def run(args: argparse.Namespace) -> int:
    from pyspark.sql import SparkSession

    from .config import MODES, resolve
    from .functions.tokens import get_counter
    from .operators import chunks, codec, report
    from .plans import compress
    from .runtime import reachable
    from .sources import files, sinks

    spark = reachable(SparkSession.builder.appName("textfold").getOrCreate())
    counter = get_counter(args.tokenizer)
    names = ["comments", "docstrings", "types", "license", "errors", "imports", "asserts", "ansi", "badges", "tables", "rename_locals", "rename_private", "argparse_text", "tabs"]
    overrides = {n: getattr(args, n) for n in [*names, "l_min", "l_max", "n_min", "b_min", "b_max", "min_saving"]}
    if args.semantic_minify:
        overrides |= {n: True for n in vars(MODES["aggressive"][0]) if n != "tabs"}
    if args.keep_empty_lines:
        overrides["blank_lines"] = False
    canon, tuning = resolve(args.mode, args.preset, **overrides)

    stdin = args.input == "-"
    to_stdout = args.stdout or (stdin or args.envelope) and args.output is None
    out = args.output or "textfold_out"
    root = None
    if stdin:
        docs, metas = files.single_text(spark, sys.stdin.read(), f"stdin.{args.stdin_ext}"), None
    else:
        skip = None if args.include_pointless else os.path.abspath(out)
        where = os.path.abspath(args.input)
        if args.input_list:
            metas = files.scan_list(spark, where, exclude_pointless=not args.include_pointless, with_content=True)
        else:
            root = where if os.path.isdir(where) else os.path.dirname(where)
            metas = files.scan(spark, where, not args.include_pointless, skip, with_content=True)
        docs = sinks.settle(files.load_texts(metas), "docs")
        if docs.isEmpty():
            raise ValueError(f"no text files in {args.input}")

    export_for = None
    if args.no_export_mapping:
        left_out = {n.strip() for n in args.no_export_mapping.split(",")}
        base = F.regexp_extract("path", "[^/]*$", 0)
        export_for = docs.select("path").where(~F.col("path").isin(*left_out) & ~base.isin(*left_out))
    started = time.perf_counter()
    result = compress.compact(docs, canon, tuning, args.placeholder_style, args.mapping_format, counter, export_for)
    took = time.perf_counter() - started
    payload, header = ("", "") if args.no_export_mapping == "" else (result.payload, result.header)

    shown = result.encoded.withColumn("path", sinks.relative_path(result.encoded["path"], root))
    single = docs.count() == 1
    if to_stdout:
        body = sinks.bundle(shown, single=single).first()["bundle"]
        sys.stdout.write(sinks.envelope(header, payload, body) if args.envelope else "\n".join([p for p in (header, payload) if p] + [body]))
    else:
        sinks.write_texts(shown, out)
        entries = [r.asDict(recursive=True) for r in codec.with_occurrences(result.book, result.places).collect()]
        sinks.write_json(
            f"{out}/reverse_map.json",
            {"placeholders": {e["token"]: {**e, "type": e["ctype"]} for e in entries}, "ph_meta": result.protocol, "metadata": {"tool": "textfold", "version": __version__}},
        )
        if args.no_export_mapping != "":
            if args.mapping_format == "json":
                sinks.write_atomic(f"{out}/mapping_subset.json", payload)
            else:
                sinks.write_atomic(f"{out}/mapping_subset.txt", payload)
                sinks.write_atomic(f"{out}/protocol_header.txt", header)
        if args.export_manifest and metas is not None:
            listed = docs.select("path", "file_ord").join(metas.select("path", "sha256"), "path")
            sinks.write_json(f"{out}/manifest.json", report.manifest_document(report.manifest(listed, result.places, root), result.book))
        if args.chunk_output:
            cut = sinks.settle(chunks.chunk(shown, list(result.mapping), args.chunk_size), "chunks")
            sinks.write_texts(cut.select(cut["name"].alias("path"), "text"), f"{out}/chunks")
            told = {r["path"]: {k: r[k] for k in ("chunks", "sha256_full", "chunk_size", "total_len")} for r in chunks.chunk_manifest(shown, cut, args.chunk_size).collect()}
            sinks.write_json(f"{out}/chunks/manifest.json", {"files": told, "chunks_dir": "chunks", "v": 1})
    if args.verify_roundtrip:
        mapping = {r["token"]: r["content"] for r in result.book.select("token", "content").collect()}
        ok, lines = codec.roundtrip(result.target, result.encoded, mapping)
        if not ok:
            if not to_stdout:
                sinks.write_json(f"{out}/roundtrip_failures.json", lines)
            print("\n".join(lines), file=sys.stderr)
            return 2
    for r in compress.summary(result, counter).collect():
        print(json.dumps(r.asDict()), file=sys.stderr)
    print(json.dumps(compress.throughput(result, took)), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""Corpora from files, lists of paths, single texts, and tables.

A corpus is a DataFrame ``path, file_ord, text``; ``file_ord`` carries the order of paths.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Suffixes of files that hold no text worth compacting.
POINTLESS_SUFFIXES = (
    "png jpg jpeg gif pdf ico ttf woff woff2 zip tar gz exe dll so bin class o a jar mp3 mp4 mov avi webm ogg wav 7z rar iso db sqlite bak swp tmp lock pyc pyo"
).split()
#: Folders that hold no sources.
POINTLESS_FOLDERS = ".git .hg .svn __pycache__ node_modules .venv venv .pytest_cache .mypy_cache .tox .eggs build dist".split()

#: Most bytes of files that the driver reads itself.
DRIVER_LIMIT = 64 << 20


def suffix_of(path: Column) -> Column:
    """The last suffix of a file name in small letters, without its dot."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def hidden(relative: Column) -> Column:
    """Whether any part of a relative path is hidden or a folder without sources."""
    return F.exists(F.split(relative, "/"), lambda p: p.startswith(".") | p.isin(POINTLESS_FOLDERS))


def local_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def scan(
    spark: SparkSession, paths: str | list[str], exclude_pointless: bool = True, output_dir: str | None = None, with_content: bool = False
) -> DataFrame:
    """Metadata of files: ``path, size, sha256, is_single_file``, and ``content`` if asked for.

    ``paths`` is a folder (read recursively), a file, or a list of files. Spark's readers pass over names that begin with a dot or an underscore; those of
    local folders are read on the driver, within a limit.
    """
    listed = isinstance(paths, list)
    roots = paths if listed else [paths]
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([r for r in roots if not _passed_over(os.path.basename(r))] or roots)
    rows = rows.select(local_path(F.col("path")).alias("path"), "length", "content")
    rest = list(_passed_over_files(roots, exclude_pointless))
    if rest:
        rows = rows.unionByName(spark.createDataFrame(rest, "path string, length long, content binary"))
    root = None if listed else roots[0].removeprefix("file://").rstrip("/")
    single = F.lit(False) if listed else F.col("path") == F.lit(root)
    relative = F.col("path") if listed else F.expr(f"substring(path, {len(root) + 2})")
    if exclude_pointless:
        rows = rows.where(~suffix_of(F.col("path")).isin(POINTLESS_SUFFIXES))
        if not listed:
            rows = rows.where(single | ~hidden(relative))
    if output_dir:
        out = output_dir.removeprefix("file://").rstrip("/")
        rows = rows.where(~(F.col("path").startswith(out + "/") | (F.col("path") == out)))
    columns = ["path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), single.alias("is_single_file")]
    return rows.select(*columns, *(["content"] if with_content else []))


def _passed_over(name: str) -> bool:
    return name.startswith(("_", "."))


def _passed_over_files(roots: list[str], exclude_pointless: bool):
    """``path, length, content`` of local files that Spark's readers pass over."""
    room = DRIVER_LIMIT

    def found():
        for root in roots:
            root = root.removeprefix("file://")
            if os.path.isfile(root):
                yield root, False
            for folder, folders, names in os.walk(root):
                if exclude_pointless:
                    folders[:] = [f for f in folders if not f.startswith(".") and f not in POINTLESS_FOLDERS]
                below = any(map(_passed_over, os.path.relpath(folder, root).split(os.sep))) and folder != root
                yield from ((os.path.join(folder, n), below) for n in names)

    for path, below in found():
        if below or _passed_over(os.path.basename(path)):
            with open(path, "rb") as f:
                data = f.read()
            room -= len(data)
            if room < 0:
                raise ValueError(f"files whose names begin with a dot or an underscore hold more than {DRIVER_LIMIT} bytes")
            yield path, len(data), bytearray(data)


def scan_list(spark: SparkSession, list_file: str, **options) -> DataFrame:
    """Metadata of the files that a text file names, one on a line."""
    paths = [r["value"].strip() for r in spark.read.text(list_file).collect() if r["value"].strip()]
    return scan(spark, paths, **options)


def universal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def load_texts(files: DataFrame, keep_newlines: bool = False) -> DataFrame:
    """``path, file_ord, text`` of scanned files; contents that are not UTF-8 are left out."""
    text = F.decode("content", "UTF-8")
    valid = files.where(F.expr("is_valid_utf8(cast(content as string))"))
    return ordered(valid.select("path", (text if keep_newlines else universal_newlines(text)).alias("text")))


def ordered(docs: DataFrame) -> DataFrame:
    """Number documents in order of path.

    Paths are dealt into ranges, counted in each, and offsets added, so no single task sorts all of them.
    """
    sized = docs.select("path", "text")
    n = max(1, docs.sparkSession.sparkContext.defaultParallelism)
    marks = [r["path"] for r in sized.select("path").distinct().orderBy(F.xxhash64("path")).limit(n - 1).collect()]
    marks.sort()
    part = F.lit(0)
    for mark in marks:
        part = part + F.when(F.col("path") >= mark, 1).otherwise(0)
    dealt = sized.withColumn("part", part)
    counts = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect()}
    offset, offsets = 0, []
    for p in range(len(marks) + 1):
        offsets.append(offset)
        offset += counts.get(p, 0)
    number = F.row_number().over(Window.partitionBy("part").orderBy("path", F.xxhash64("text")))
    return dealt.select("path", (number + F.get(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("part")) - 1).cast("long").alias("file_ord"), "text")


def single_text(spark: SparkSession, text: str, name: str = "stdin.txt") -> DataFrame:
    """A corpus of one text; ``name`` decides its type."""
    return spark.createDataFrame([(name, 0, text)], "path string, file_ord long, text string")


def document_path() -> Column:
    """The path of a document, from its source, language and id."""
    return F.format_string("%s/%s/%08d.txt", "source", "lang", "doc_id")


def from_documents(documents: DataFrame) -> DataFrame:
    """A table of documents as a corpus: paths from source, language and id; the id is the order. Rows without a text are no files and are left out."""
    return documents.where(F.col("text").isNotNull()).select(document_path().alias("path"), F.col("doc_id").alias("file_ord"), "text")

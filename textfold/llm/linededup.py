"""Operator 4: removal of repeated passages by overlapping windows of lines.

Every three consecutive lines form a window, known by the MD5 of its text. A window that occurs
more than once in the corpus has a first occurrence, by document id and then by line (then by a hash
of the text, where several texts have one id or none); every later
occurrence covers its three lines. The covered lines of a document are merged and removed, the
others are joined again. A line is removed only where an aligned copy of it stands earlier, so
each text stays at least once.

Windows are counted with partial aggregation before the shuffle, and only windows that repeat go
on; a window that a third of the documents share is one row there, and the join that finds its
later occurrences may be split by adaptive execution on the side of the occurrences.

Defined results: a null text stays null, with 0 lines; a text of fewer lines than a window is
unchanged; windows of blank lines only are no windows; a text whose lines all go becomes empty,
its row stays; repeated rows (same id and text) stand at the same place and are treated alike;
null ids sort first; an empty table gives an empty table; other columns, whatever their names,
are kept (but those that have the names of the counts).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import unused

WINDOW = 3


def _windows(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    lines = F.split(F.col(text_col), "\n", -1)
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), lines.alias("lines"))
    rows = rows.where(F.size("lines") >= size)
    starts = F.sequence(F.lit(0), F.size("lines") - size)
    key = F.transform(starts, lambda i: F.concat_ws("\n", F.slice(F.col("lines"), i + 1, size)))
    keys = F.transform(key, lambda k: F.when(k.rlike(r"[^\s]"), F.unhex(F.md5(k))))
    return rows.select("id", "version", F.posexplode(keys).alias("pos", "key")).where(F.col("key").isNotNull())


def later_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``id, version, pos`` of every window that occurred before; ``version`` is a hash of the text."""
    windows = _windows(df, id_col, text_col, size)
    repeated = (
        windows.groupBy("key")
        .agg(F.count("*").alias("n"), F.min(F.struct("id", "pos", "version")).alias("first"))
        .where(F.col("n") > 1)
        .select("key", "first")
    )
    return windows.join(repeated, "key").where(F.struct("id", "pos", "version") > F.col("first")).select("id", "version", "pos")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, counts: tuple[str, str] | None = ("n_lines", "n_removed")) -> DataFrame:
    """``df`` with its texts rewritten, and two counts added under the names ``counts`` (columns of these names are replaced; None adds nothing)."""
    later = later_windows(df, id_col, text_col, size)
    id_name, version_name, cover_name = unused(df.columns, "covered_id", "covered_version", "covered")
    covered = (
        later.groupBy("id", "version")
        .agg(F.collect_set("pos").alias("starts"))
        .select(
            F.col("id").alias(id_name),
            F.col("version").alias(version_name),
            F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (size - 1))))).alias(cover_name),
        )
    )
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(cover_name))
    rest = F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    joined = df.join(covered, F.col(id_col).eqNullSafe(F.col(id_name)) & (F.xxhash64(text_col) == F.col(version_name)), "left")
    text = F.when(F.col(cover_name).isNull(), F.col(text_col)).otherwise(rest)
    replaced = {c.lower() for c in counts or ()}
    columns = [text.alias(c) if c == text_col else F.col(c) for c in df.columns if c.lower() not in replaced]
    if counts:
        columns.append(F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long").alias(counts[0]))
        columns.append(F.coalesce(F.size(cover_name), F.lit(0)).cast("long").alias(counts[1]))
    return joined.select(*columns)


SQL = """
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
wins AS (
  SELECT doc_id, i AS pos, array_to_string(ls[i + 1 : i + 3], chr(10)) AS k
  FROM (SELECT doc_id, ls, unnest(range(len(ls) - 2)) AS i FROM split WHERE len(ls) >= 3)
),
later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS nth
    FROM wins WHERE regexp_matches(k, '[^ \\t\\n\\x0B\\f\\r]')) WHERE nth > 1
),
cov AS (SELECT DISTINCT doc_id, pos + d AS pos FROM later, (SELECT unnest([0, 1, 2]) AS d)),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM split),
kept AS (
  SELECT lines.doc_id, string_agg(line, chr(10) ORDER BY lines.pos) FILTER (WHERE cov.pos IS NULL) AS text,
         count(*) AS n_lines, count(cov.pos) AS n_removed
  FROM lines LEFT JOIN cov ON lines.doc_id = cov.doc_id AND lines.pos = cov.pos GROUP BY lines.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       CAST(coalesce(k.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

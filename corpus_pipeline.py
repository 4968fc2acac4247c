"""The corpus pipeline: language, lines, near copies, benchmark passages, tokens.

Each stage reads all that the one before it kept, written as Parquet, and returns the columns of
``documents`` (the last one returns tokens). Rows are only dropped where a stage's decision says so.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textfold.llm import bpe, decontam, langid, linededup, ngramjoin
from textfold.llm.common import Scratch, bucket_of, settle, table, unused

#: A document whose best language gets less belief than this is rejected.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without letters (null texts too) or of no clear language; give those without a language the predicted one.

    Rows are judged by their text alone, so repeated rows and ids are treated alike; where no language can be learned, all go.
    """
    model = langid.learn(docs.where(F.coalesce(bucket_of("doc_id", 4) != 2, F.lit(True))))
    lang, score = unused(docs.columns, "lang_pred", "score")
    told = langid.annotate(docs, model, names=(lang, score))
    kept = told.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE))
    return kept.select(*[F.coalesce("lang", lang).alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove later occurrences of repeated three-line windows. Every document stays, shorter where it repeats, with ``n_chars`` of what is left.

    Null texts stay null; repeated rows are one place, so they stay alike; other columns are not touched.
    """
    clean = linededup.dedup_lines(docs, counts=None)
    return clean.select(*[F.coalesce(F.length("text").cast("long"), "n_chars").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, keep the one with the smallest id (null first).

    Rows are known by a hash (64 bit) of id and text, so rows with null or repeated ids only go where their texts are linked or equal.
    Texts without words, null ones too, are linked with nothing; rows with the same id and text are one document.
    What goes is a small table next to the documents, which Spark may send to them if its size allows.
    """
    (key,) = unused(docs.columns, "key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = ngramjoin.jaccard_components(keyed.select(key, "text"), key, links=False)
    rows = keyed.groupBy(F.col(key).alias("id")).agg(F.min("doc_id").alias("doc"), F.count("*").alias("times"))
    groups = settle(rows.join(found.select(F.col(key).alias("id"), "component_id").distinct(), "id"), "near-groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct("doc", "id")).alias("first")).select(F.col("first.id").alias("id"))
    others = groups.join(first, "id", "left_anti").select("id")
    again = groups.where("times > 1").join(first, "id", "left_semi").select("id")  # firsts of which there are several rows
    going = settle(others.withColumn("whole", F.lit(True)).union(again.withColumn("whole", F.lit(False))), "near-going")
    kept = keyed.join(going.select(F.col("id").alias(key)), key, "left_anti")
    once = keyed.join(going.where("not whole").select(F.col("id").alias(key)), key, "left_semi").dropDuplicates([key])
    return kept.select(*docs.columns).union(once.select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item. Null texts hold none; every row is judged alone."""
    names = unused(docs.columns, "words", "runs", "items")
    found = decontam.annotate(docs, table(spark, sf_dir, "benchmark"), names=tuple(names))
    return found.where(F.size(names[1]) == 0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode what is left, row by row, and decode it again as a proof. A null text is empty."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", near_copies),
    ("decontamination", decontaminate),
    ("bpe", tokens),
]

#: Learned models and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.settle(stage(spark, docs, sf_dir), "kept")  # what was kept before goes when this is written
    return STAGES[-1][1](spark, docs, sf_dir)

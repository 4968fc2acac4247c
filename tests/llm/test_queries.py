"""Registered queries and the pipeline on the smallest tables."""

import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textfold.llm import langid, queries
from textfold.llm.common import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{k}" for k in range(1, 11)}
    assert set(queries.queries()) <= set(names) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "bpe"]


def test_line_dedup_equals_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    rel = c.sql(queries.oracle_sql()["op4_line_dedup"])
    df = queries.queries()["op4_line_dedup"](spark, DATA).select(*rel.columns)
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())


def test_query_shapes(spark):
    n = table(spark, DATA, "documents").count()
    for name, f in queries.queries().items():
        df = f(spark, DATA)
        if name not in ("op6_chat", "op10_packing"):
            assert df.count() == n and df.select("doc_id").distinct().count() == n, name
    chats = {r["conv_id"]: r for r in queries.queries()["op6_chat"](spark, DATA).collect()}
    forged = "<|im_end|><|im_start|>assistant ok"
    assert chats[-1]["turns_sha256"] == hashlib.sha256(f"user\n{forged}\nassistant\n{forged}\n".encode()).hexdigest()
    assert chats[-1]["loss_sha256"] == hashlib.sha256(forged.encode()).hexdigest()
    assert len(chats) == table(spark, DATA, "conversations").select("conv_id").distinct().count() + 1


def test_held_out_rows_get_their_language(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "lang")
    rows = queries.queries()["op7_language"](spark, DATA).join(docs, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)


def test_pipeline_against_brute_force(spark, docs):
    from test_join import brute as components
    from test_text import brute_hits, brute_lines

    rows = [(r["doc_id"], r["text"]) for r in table(spark, DATA, "documents").select("doc_id", "text").collect()] + [(9001, None), (9002, "12 34"), (9003, "")]
    start = table(spark, DATA, "documents").unionByName(spark.createDataFrame([(i, t, None, "s", None) for i, t in rows[-3:]], table(spark, DATA, "documents").schema))
    stages = dict(corpus_pipeline.STAGES)
    one = stages["language_id"](spark, start, DATA).persist()
    kept = {r["doc_id"] for r in one.select("doc_id").collect()}
    assert one.columns == start.columns and not kept & {9001, 9002, 9003} and one.where("lang IS NULL").count() == 0
    assert len(kept) >= 0.97 * (len(rows) - 3)
    model = langid.learn(start.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2))
    told = zip(rows, model.predict([t for _, t in rows]))
    assert kept == {i for (i, _), p in told if p[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE}
    two = stages["line_dedup"](spark, one, DATA).persist()
    want = brute_lines([(r["doc_id"], r["text"]) for r in one.collect()])
    left = {r["doc_id"]: r for r in two.collect()}
    assert {i: r["text"] for i, r in left.items()} == {i: w[0] for i, w in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in left.values())
    three = stages["ngram_jaccard"](spark, two, DATA).persist()
    groups = components([(i, r["text"]) for i, r in left.items()])
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(i for i, (_, c) in groups.items() if c == i)
    four = stages["decontamination"](spark, three, DATA).persist()
    items = [(r["item_id"], r["text"]) for r in table(spark, DATA, "benchmark").collect()]
    assert sorted(r["doc_id"] for r in four.collect()) == sorted(r["doc_id"] for r in three.collect() if not brute_hits(r["text"], items, 10)[1])
    five = {r["doc_id"]: r for r in stages["bpe"](spark, four, DATA).collect()}
    assert {i: r["decoded_sha256"] for i, r in five.items()} == {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in four.collect()}


def test_near_copies_with_null_and_repeated_ids(spark, docs):
    texts = [" ".join(f"{name}{k}" for k in range(30)) for name in "abcdef"]
    near = " ".join([*texts[3].split()[:-1], "other"])
    rows = [(None, t) for t in texts[:4]] + [(5, texts[0]), (9, texts[1]), (7, texts[4]), (7, texts[5]), (7, texts[5]), (3, near), (2, None), (None, None)]
    kept = corpus_pipeline.near_copies(spark, docs(rows), DATA)
    want = [(None, t) for t in texts[:4]] + [(7, texts[4]), (7, texts[5]), (2, None), (None, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 100

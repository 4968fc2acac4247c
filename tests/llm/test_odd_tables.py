"""Tables that every operator and stage must take: foreign columns with names like its own, other id types, repeated ids, no rows."""

import public_tokenizers
import pytest
from llm_odd import ODD
from pyspark.sql import functions as F

import corpus_pipeline
from textfold.llm import bpe, chat, decontam, fingerprint, langid, linededup, ngramjoin, packing, quality, tokencount
from textfold.llm.common import unused

DATA = "/root/testdata/sf0.001"
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
CLASH = ["id", "n", "node", "key", "part", "comp", "words", "runs", "items", "words_", "lang_pred", "score", "covered", "covered_id", "covered_version", "n_lines", "n_removed", "first", "whole", "ids", "block", "tail", "label_id", "held_out"]


@pytest.fixture
def odd(docs, spark):
    """Odd texts, plain ones, repeated rows, and one id with two texts, beside columns with clashing names."""
    plain = [" ".join(f"{c}{k}" for k in range(40)) for c in "abc"]
    rows = [(k, t) for k, t in enumerate([*ODD, *plain, plain[0] + "\nend"])] + [(3, "another text"), (3, "another text"), (None, plain[1])]
    return docs(rows).withColumns({c: F.lit(7) for c in CLASH})


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_stages(spark, odd, stage, kind):
    if kind == "string" and stage == "bpe":
        odd = odd.where("doc_id IS NOT NULL")
    table = odd.withColumn("doc_id", F.col("doc_id").cast(kind))
    out = dict(corpus_pipeline.STAGES)[stage](spark, table, DATA)
    if stage != "bpe":
        assert out.columns == table.columns
        assert all(r[c] == 7 for r in out.collect() for c in CLASH)
    else:
        assert out.count() == table.count()
    assert dict(corpus_pipeline.STAGES)[stage](spark, table.limit(0), DATA).count() == 0


def test_operators(spark, odd):
    n = odd.count()
    items = spark.createDataFrame([(1, "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10 a11")], "item_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(10)], "doc_id long, quality int")
    vectors = quality.learn_vectors(odd)
    made = {
        "bpe": bpe.round_trip(odd, BYTES),
        "fingerprint": fingerprint.fingerprint_edits(odd),
        "quality": quality.score(odd, quality.fit(odd, labels, vectors), vectors),
        "lines": linededup.dedup_lines(odd),
        "decontam": decontam.contamination(odd, items),
        "language": langid.identify(odd, langid.learn(odd)),
        "join": ngramjoin.jaccard_components(odd),
        "count": tokencount.count(odd, PIECES),
    }
    assert {k: df.count() for k, df in made.items()} == dict.fromkeys(made, n)
    assert packing.pack_documents(odd, BYTES, length=64).count() > 0
    lines = made["lines"]
    assert set(lines.columns) == set(odd.columns) and all(r["covered"] == 7 and r["n_lines"] != 7 for r in lines.where("text = 'a'").collect())
    with pytest.raises(ValueError):
        langid.annotate(odd, langid.learn(odd))


@pytest.mark.parametrize("kind", ["int", "short", "long", "string", "decimal(12,0)", "date"])
def test_conversations_of_other_id_types(spark, kind):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "ok"), (2, 0, "assistant", None)]
    ids = "date_add(date'2020-01-01', conv_id)" if kind == "date" else f"cast(conv_id as {kind})"
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").withColumn("conv_id", F.expr(ids)).withColumn("window", F.lit(5))
    windows = chat.format_windows(turns, BYTES)
    assert windows.schema["conv_id"].dataType == turns.schema["conv_id"].dataType
    told = {r["loss_chars"]: r["n_turns"] for r in chat.read_back(windows, in_order=True).collect()}
    assert told == {2: 2, 0: 1}


def test_unused_names():
    assert unused(["A", "b"], "a", "c", "c") == ["a_", "c", "c_"]

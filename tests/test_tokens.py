"""Token counts, hashes and calibration."""

import pytest
from pyspark.sql import functions as F

from textfold.functions import tokens
from textfold.operators import report

EDGES = [
    "", " ", "一二三", " hello", "camelCase", "MAX_VALUE = 3", "HTTPServer", "don't we'll", "\n", "a\r\n  b", "123456", "internationalization", "abcdefghijklm", "\t\t x",
    "____", "éà ß", "a\u2028b", "😀 ok", "x  =  y", "§1§ «2»", "ABCd", "A1 B_",
]


def test_column_equals_function(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(EDGES)], "k int, text string")
    got = {r["k"]: r["tokens"] for r in rows.select("k", tokens.heuristic_tokens("text").alias("tokens")).collect()}
    assert got == {k: tokens.heuristic_count(t) for k, t in enumerate(EDGES)}


@pytest.mark.parametrize("text,count", [("一二三", 3), (" hello", 1), ("", 0), ("internationalization", 4), ("MAX_VALUE = 3", 6), ("éà", 1)])
def test_known_counts(text, count):
    assert tokens.heuristic_count(text) == count


def test_null_is_null(spark):
    row = spark.createDataFrame([(None,)], "text string").select(tokens.heuristic_tokens("text").alias("t")).first()
    assert row["t"] is None


def test_line_hash(spark):
    import hashlib

    row = spark.createDataFrame([("añb",)], "x string").select(tokens.line_hash60(F.col("x")).alias("h")).first()
    assert row["h"] == int(hashlib.md5("añb".encode()).hexdigest()[:15], 16)


def test_calibration_against_itself(spark):
    rows = spark.createDataFrame([("one two",), ("three",), ("a b c d",)], "text string")
    r = report.calibration(rows, tokens.heuristic_tokens(F.col("text")), tokens.heuristic_tokens(F.col("text"))).first()
    assert (r["samples"], r["mean_sample_error_pct"], r["mean_ratio"], r["ci_low"], r["ci_high"]) == (3, 0.0, 1.0, 0.0, 0.0)


def test_unknown_tokenizer_is_heuristic():
    assert tokens.get_counter("p50k_base").name == "heuristic"
    assert tokens.get_counter("auto").count("hello world") == 2


def test_rank_files_and_their_patterns(tmp_path):
    import base64

    path = tmp_path / "ranks"
    parts = [bytes([b]) for b in range(256)] + [b"ab", b"12", b"123", b"1234"]
    path.write_text("".join(f"{base64.b64encode(p).decode()} {k}\n" for k, p in enumerate(parts)))
    assert tokens.get_counter(f"ranks:{path}").count("ab 1234") == 3  # ab, blank, 1234
    assert tokens.get_counter(f"ranks+cl100k:{path}").count("ab1234") == 3  # ab, 123, 4
    with pytest.raises(ValueError):
        tokens.get_counter(f"ranks+other:{path}")
    assert tokens.get_counter("auto").name == "heuristic"


def test_benchmark_table(spark, tmp_path, capsys):
    import json

    from textfold import benchmark

    (tmp_path / "a.py").write_text("some_long_identifier_name = other_long_identifier_name\n" * 12)
    out = tmp_path / "rows.json"
    assert benchmark.main(["-i", str(tmp_path / "none")]) == 1
    assert benchmark.main(["-i", str(tmp_path / "a.py"), "--json-out", str(out)]) == 0
    rows = json.loads(out.read_text())
    shown = capsys.readouterr().out
    assert len(rows) == 7 and all(r["roundtrip_ok"] for r in rows) and shown.count("PASS") == 7 and "single_token+positional" in shown

"""Files in, files out, streams, the command line, and the catalogue."""

import hashlib
import json
import os

import pytest
from helpers import corpus

from textfold import cli
from textfold.config import MODES
from textfold.sources import files, sinks
from textfold.streaming import encode


@pytest.fixture
def tree(tmp_path):
    made = {
        "a.py": b"x = 1\r\ny = 2\r",
        "sub/b.sh": b"echo\n",
        "sub/c.md": "é\n".encode(),
        "pic.PNG": b"\x89",
        ".git/config": b"x",
        "node_modules/m.js": b"x",
        ".hidden.py": b"x",
        "bad.txt": b"\xff\xfe",
        "out/done.txt": b"x",
        "sub/__init__.py": b"init = 1\n",
    }
    for name, data in made.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return tmp_path


def test_scan(spark, tree):
    rows = {os.path.relpath(r["path"], tree): r for r in files.scan(spark, str(tree), output_dir=str(tree / "out")).collect()}
    assert set(rows) == {"a.py", "sub/b.sh", "sub/c.md", "bad.txt", "sub/__init__.py"}
    assert rows["a.py"]["sha256"] == hashlib.sha256(b"x = 1\r\ny = 2\r").hexdigest() and not rows["a.py"]["is_single_file"]
    assert files.scan(spark, str(tree), exclude_pointless=False).count() == 10
    one = files.scan(spark, str(tree / "a.py")).collect()
    assert len(one) == 1 and one[0]["is_single_file"]


def test_load(spark, tree):
    docs = files.load_texts(files.scan(spark, str(tree), output_dir=str(tree / "out"), with_content=True))
    rows = sorted((r["file_ord"], os.path.basename(r["path"]), r["text"]) for r in docs.collect())
    assert rows == [(0, "a.py", "x = 1\ny = 2\n"), (1, "__init__.py", "init = 1\n"), (2, "b.sh", "echo\n"), (3, "c.md", "é\n")]
    listing = tree / "list.txt"
    listing.write_text(f"{tree / 'a.py'}\n\n{tree / 'sub/b.sh'}\n")
    assert files.scan_list(spark, str(listing)).count() == 2


def test_sinks(spark, tmp_path):
    docs = corpus(spark, {"x/a.txt": "one", "b.txt": ""})
    assert sinks.write_texts(docs, str(tmp_path / "o")) == 2
    assert (tmp_path / "o/x/a.txt").read_text() == "one"
    with pytest.raises(ValueError):
        sinks.write_texts(corpus(spark, {"../evil": "x"}), str(tmp_path / "o"))
    assert sinks.bundle(docs).first()["bundle"] == "--- FILE: b.txt ---\n--- FILE: x/a.txt ---\none\n"
    assert "<textfold>" in sinks.envelope("h", "p", "body\n")
    sinks.write_json(str(tmp_path / "j.json"), {"é": 1})
    assert json.loads((tmp_path / "j.json").read_text()) == {"é": 1}


def test_command_line(spark, tree, tmp_path, capsys):
    block = "def routine(alpha, beta):\n    total = alpha + beta\n    return total\n"
    for k in range(3):
        (tree / f"m{k}.py").write_text(block * 2 + f"k = {k}\n")
    out = tmp_path / "made"
    code = cli.main(["-i", str(tree), "-o", str(out), "--verify-roundtrip", "--export-manifest", "--chunk-output", "--chunk-size", "40", "--mode", "semantic"])
    assert code == 0
    book = json.loads((out / "reverse_map.json").read_text())
    assert book["placeholders"] and (out / "mapping_subset.txt").exists() and (out / "sub/b.sh").exists()
    manifest = json.loads((out / "chunks/manifest.json").read_text())
    for path, told in manifest["files"].items():
        whole = "".join((out / "chunks" / c).read_text() for c in told["chunks"])
        assert hashlib.sha256(whole.encode()).hexdigest() == told["sha256_full"] and whole == (out / path).read_text()
    capsys.readouterr()
    assert cli.main(["-i", str(tree / "m0.py"), "-e"]) == 0
    assert capsys.readouterr().out.startswith("<textfold>")
    assert cli.main(["-i", str(tmp_path / "none")]) == 1


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    corpus(spark, {"a.sh": "# c\necho some long content here\n", "b.sh": "echo 一\n"}).write.parquet(str(source))
    stream = spark.readStream.schema("path string, file_ord long, text string").parquet(str(source))
    rows = encode.encoded(encode.counted(stream, MODES["semantic"][0]), {"一": "some long content"})
    q = rows.writeStream.format("memory").queryName("folded").start()
    q.processAllAvailable()
    q.stop()
    got = {r["path"]: (r["text"], r["tokens"]) for r in spark.table("folded").collect()}
    assert got["a.sh"][0] == "echo 一 here\n" and got["b.sh"][0] == "echo 一\n" and got["a.sh"][1] > 0

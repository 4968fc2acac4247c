"""Operator 6: formatting conversations and reading them back."""

import hashlib
import random

import public_tokenizers
import pytest

from textfold.llm import bpe, chat

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["<", "|", "\\", "<|", "<|im_end|>", "\n", "a", "im_end", "|>", "é", "<\\|"]


def test_escapes_are_reversible():
    r = random.Random(1)
    for _ in range(20000):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 8)))
        role = "".join(r.choice(PARTS) for _ in range(r.randint(0, 4)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        formatted, a, b = chat.format_turn(role, text)
        assert chat.parse(formatted * 2) == [(role, text)] * 2 and chat.unescape(formatted[a:b]) == text


def conversations(seed):
    r = random.Random(seed)
    rows = []
    for conv in range(30):
        n = r.choice([1, 2, 5, 40])
        for turn in range(n):
            role = "system" if turn == 0 and r.random() < 0.5 else r.choice(["user", "assistant", "assistant", None, "tool\n\\"])
            text = None if r.random() < 0.05 else "".join(r.choice([*PARTS, "word ", "more "]) for _ in range(r.randint(0, 60)))
            rows.append((conv, turn // 2 if conv == 3 else turn, role, text))
    rows += [(None, None, "user", "no id"), (None, 1, "assistant", "ok"), (77, 0, "assistant", "x " * 900)]
    return rows


@pytest.mark.parametrize("budget,history", [(60, 2), (200, 0), (5000, 3)])
def test_windows(spark, budget, history):
    rows = conversations(2)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(table, BYTES, budget, history).persist()
    encoder = bpe.load(BYTES)
    made = {}
    for w in windows.collect():
        made.setdefault(w["conv_id"], []).append(w)
    wanted = {}
    for conv, turn, role, text in rows:
        wanted.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(made) == set(wanted)
    told = {x["conv_id"]: x for x in chat.read_back(windows).collect()}
    for conv, turns in wanted.items():
        turns = [t[2:] for t in sorted(turns)]
        own = sorted(made[conv], key=lambda w: w["window"])
        read = []
        for k, w in enumerate(own):
            parsed = chat.parse(w["text"])
            assert len(parsed) == w["n_turns"] and w["n_context"] < len(parsed)
            assert w["n_tokens"] == sum(len(encoder.encode(chat.format_turn(*t)[0].encode())) // 4 for t in parsed)
            assert w["over_budget"] == (w["n_tokens"] > budget)
            system = turns[0][0] == "system"
            if k:
                assert not system or parsed[0] == turns[0]
                repeated = parsed[1 if system else 0 : w["n_context"]]
                before = read[1:] if system else read
                assert len(repeated) <= history and repeated == before[len(before) - len(repeated) :]
                if w["over_budget"]:
                    assert len(parsed) - w["n_context"] == 1
            else:
                assert w["n_context"] == 0
            targets = [chat.unescape(w["text"][a:b]) for a, b in zip(w["loss"][::2], w["loss"][1::2])]
            assert targets == [t for role, t in parsed[w["n_context"] :] if role == "assistant" and t]
            read += parsed[w["n_context"] :]
        assert read == turns
        x = told[conv]
        said = "".join(t for role, t in turns if role == "assistant")
        assert x["n_turns"] == len(turns) and x["formatted_chars"] == sum(len(w["text"]) for w in own)
        assert x["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (x["loss_chars"], x["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    windows.unpersist()


def test_reading_in_order_and_nothing(spark):
    table = spark.createDataFrame(conversations(3), "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(table, BYTES, 100)
    assert sorted(map(str, chat.read_back(windows, in_order=True).collect())) == sorted(map(str, chat.read_back(windows).collect()))
    assert chat.read_back(chat.format_windows(table.limit(0), BYTES)).count() == 0

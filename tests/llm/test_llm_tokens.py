"""Operators 1, 9 and 10: BPE, token counts, packing."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from llm_odd import ODD

from textfold.llm import bpe, packing, tokencount

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = [*"abcTHe  \n\t'srevlmd0123.,!?éçñ ü—…’“🙂中文　 \u0085 $#<|>\x1c\x00²½ßÀ▁", "<|endoftext|>", "'ll", "'re", "\r\n", "<s>", "   ", "ing", "tion"]


def random_texts(seed, n, size=14):
    r = random.Random(seed)
    return ["".join(r.choice(LETTERS) for _ in range(r.randint(0, size))) for _ in range(n)]


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    own, real = bpe.load(BYTES), Tokenizer.from_file(BYTES)
    for text in [t for t in ODD if t] + random_texts(1, 5000):
        ids = real.encode(text, add_special_tokens=False).ids
        made = own.encode(text.encode())
        assert np.frombuffer(made, "<u4").tolist() == ids, text[:80]
        assert own.decode(made).decode() == real.decode(ids, skip_special_tokens=False)


def test_cuts_are_where_no_token_crosses():
    own = bpe.load(BYTES)
    for text in random_texts(2, 500, 40):
        data = text.encode()
        for at in own.cuts(data)[1:-1]:
            assert not own.pairs.joined[data[at - 1] * 257 + data[at]]


def test_ids_that_form_no_text():
    own = bpe.load(BYTES)
    part = own.encode("é".encode())
    lone = np.array([own.id_of[b"\xc3"]], "<u4").tobytes()
    assert own.decode(part).decode() == "é" and own.decode(lone).decode() == "�"


def test_bpe_table(docs):
    from tokenizers import Tokenizer

    real = Tokenizer.from_file(BYTES)
    rows = {r["doc_id"]: r for r in bpe.round_trip(docs(ODD), BYTES, keep_ids=True).collect()}
    for k, text in enumerate(ODD):
        ids = real.encode(text or "", add_special_tokens=False).ids
        assert rows[k]["n_tokens"] == len(ids)
        assert rows[k]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[k]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs(ODD), BYTES), BYTES).collect()}
    assert back == {k: t or "" for k, t in enumerate(ODD)}
    assert bpe.round_trip(docs([]), BYTES).count() == 0


def test_every_prefix_count_equals_the_library():
    import sentencepiece

    own, real = tokencount.load(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in random_texts(3, 800):
        assert own.counts(text).tolist() == [len(real.encode(text[:i])) for i in range(len(text) + 1)], text
    for text in ODD:
        assert own.counts(text or "")[-1] == len(real.encode(text or ""))


def test_prefixes_answer_budgets():
    own = tokencount.load(PIECES)
    text = "The quick brown fox jumps over the lazy dog. " * 20
    counts = own.counts(text)
    for budget in (0, 1, 7, 50, 10**6):
        at = tokencount.longest_prefix(counts, budget)
        assert counts[at] <= budget and (counts[at + 1 :] > budget).all()
    cuts = tokencount.cut_points(counts, 30)
    assert cuts[-1] == len(text) and cuts == sorted(set(cuts))


def test_count_table(docs):
    rows = {r["doc_id"]: r for r in tokencount.count(docs([*ODD, "word " * 9000]), PIECES).collect()}
    assert (rows[1]["n_bytes"], rows[1]["n_tokens"], rows[1]["over_limit"]) == (0, 0, False)
    long = rows[len(ODD)]
    assert long["over_limit"] and long["n_bytes"] == 45000 and long["fit_chars"] < 45000
    assert tokencount.count(docs([]), PIECES).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_best_fit_decreasing_against_brute_force(seed):
    r = random.Random(seed)
    for _ in range(100):
        room = r.choice([8, 10, 33])
        sizes = [r.randint(1, room) for _ in range(r.randint(0, 40))]
        bins: list[list[int]] = []
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            left = [(room - sum(sizes[j] for j in b), b) for b in bins if room - sum(sizes[j] for j in b) >= sizes[k]]
            if left:
                min(left, key=lambda x: x[0])[1].append(k)
            else:
                bins.append([k])
        rows = packing.pack(sizes, room)
        assert len(rows) == len(bins) and sorted(k for b in rows for k in b) == list(range(len(sizes)))
        assert all(sum(sizes[k] for k in b) <= room for b in rows)
        assert sorted(sum(sizes[k] for k in b) for b in rows) == sorted(sum(sizes[k] for k in b) for b in bins)


def test_packing_loses_nothing(docs, tmp_path):
    table = docs(ODD)
    packed = packing.pack_documents(table, BYTES, length=64, pad=7, run_tokens=500)
    rows = packed.collect()
    assert len({r["pack_id"] for r in rows}) == len(rows)
    for r in rows:
        ids, positions, edges = np.frombuffer(r["ids"], "<u4"), np.frombuffer(r["positions"], "<u4"), r["cu_seqlens"]
        assert len(ids) == len(positions) == 64 and edges[0] == 0 and edges[-1] == r["n_tokens"] and len(edges) == r["n_segments"] + 1
        for a, b in zip(edges, edges[1:]):
            assert b > a and positions[a:b].tolist() == list(range(b - a))
        assert (ids[edges[-1] :] == 7).all()
    back = {r["doc_id"]: r["text"] for r in packing.unpack(packed, BYTES).collect()}
    assert back == {k: t for k, t in enumerate(ODD) if t}
    packing.write_matrix(packed, str(tmp_path / "t"))
    assert packing.export_matrix(packed, str(tmp_path / "m")) == len(rows)
    assert packing.export_parts(packed, str(tmp_path / "p")) == len(rows)
    for name in packing.FILES:
        parts = sorted((tmp_path / "p").glob(f"part-*.{name}"))
        assert sum(len(p.read_bytes()) for p in parts) == len((tmp_path / "m" / name).read_bytes())
    assert not list((tmp_path / "p").glob("*.tmp"))
    assert np.fromfile(tmp_path / "m/ids.bin", "<u4").size == 64 * len(rows)
    assert packing.pack_documents(docs([]), BYTES).count() == 0

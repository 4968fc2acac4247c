"""Operators 2, 3, 4, 5 and 7: fingerprints, quality, lines, benchmark passages, languages."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_odd import ODD
from pyspark.sql import functions as F

from textfold.llm import decontam, fingerprint, langid, linededup, quality
from textfold.llm.common import bucket_of


def spell(r, letters, n):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 6))) for _ in range(n))


# ---- 2


def test_gear_hash_sees_32_bytes():
    r = np.random.default_rng(1)
    a = r.integers(0, 256, 300).astype(np.uint8)
    b = a.copy()
    b[:200] = r.integers(0, 256, 200)
    g = np.array([fingerprint._GEAR[x] for x in a], np.uint64)
    want = [sum(int(g[i - k]) << k for k in range(min(32, i + 1))) & 0xFFFFFFFF for i in range(300)]
    assert fingerprint.gear(a).tolist() == want
    assert (fingerprint.gear(a)[231:] == fingerprint.gear(b)[231:]).all()


def test_chunks_keep_their_bounds():
    data = spell(random.Random(2), "abcdefgh", 3000).encode()
    ends = fingerprint.chunk_ends(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= fingerprint.MOST and sizes[:-1].min() >= fingerprint.LEAST
    assert fingerprint.chunk_ends(b"") == []


def test_edits_against_brute_force(docs):
    r = random.Random(3)
    texts = [*ODD, *[spell(r, "abcdé", r.randint(1, 200)) for _ in range(40)]]
    table = docs([(k * 7 % 101, t) for k, t in enumerate(texts)])
    rows = {x["doc_id"]: x for x in fingerprint.fingerprint_edits(table).collect()}
    order = sorted(((k * 7 % 101, t or "") for k, t in enumerate(texts)))
    assert len(rows) == len(texts)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        a, b, c = (fingerprint.fingerprint(x.encode()) for x in (t, edited, n))
        x = rows[i]
        assert x["n_chars"] == len(t) and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (x["fingerprint"], x["edited_fingerprint"]) == (fingerprint.to_text(a), fingerprint.to_text(b))
        assert x["near_edited"] == fingerprint.likeness(a, b) and x["near_next"] == fingerprint.likeness(a, c)
        assert fingerprint.from_text(x["fingerprint"]).tobytes() == a.tobytes()
        if len(t) > 400:
            assert 0.35 < x["near_edited"]


def test_many_ranges_and_ties(docs, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_RANGE", 3)
    table = docs([(k // 2, f"{k} is the number of this text") for k in range(20)] + [(None, "no id")])
    rows = fingerprint.fingerprint_edits(table).collect()
    order = [(x["doc_id"], x["text"]) for x in table.withColumn("h", F.xxhash64("text")).orderBy(F.col("doc_id").asc_nulls_first(), "h").collect()]
    want = [(i, hashlib.sha256(fingerprint.edited(t, n).encode()).hexdigest()) for (i, t), (_, n) in zip(order, order[1:] + order[:1])]
    assert sorted(((x["doc_id"], x["edited_sha256"]) for x in rows), key=str) == sorted(want, key=str)
    assert fingerprint.fingerprint_edits(docs([])).count() == 0
    one = fingerprint.fingerprint_edits(docs(["abcdef"])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcabc").hexdigest() and one["near_next"] == 1.0


def test_likeness_ends():
    empty, some = fingerprint.fingerprint(b""), fingerprint.fingerprint(b"some words of text")
    assert fingerprint.likeness(empty, empty) == 1 and fingerprint.likeness(empty, some) == 0 and fingerprint.likeness(some, some) == 1


# ---- 3


def test_quality_learns_held_out_rows(spark, docs):
    r = random.Random(4)
    texts, labels = [], []
    for k in range(600):
        good = r.random() < 0.7
        words = spell(r, "abcdefghij", r.randint(5, 60))
        texts.append(words if good else r.choice([words.upper() + "!!", " ".join(w + "$$$" for w in words.split()), " ".join(w for w in words.split() for _ in range(4))]))
        labels.append((k, int(good), 0))
    table = docs(texts + ["", None])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    vectors = quality.learn_vectors(table)
    network = quality.fit(table, marks.where(bucket_of("doc_id", 5) != 0), vectors)
    rows = {x["doc_id"]: x for x in quality.score(table, network, vectors).collect()}
    held = [k for k, *_ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(rows) == 602 and len(held) > 80
    assert np.mean([rows[k]["predicted"] == labels[k][1] for k in held]) > 0.95
    assert all(0 <= x["score"] <= 1 and x["predicted"] == (x["score"] >= 0.3) for x in rows.values())


def test_quality_without_labels(spark, docs):
    table = docs(ODD)
    vectors = quality.learn_vectors(table)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {x["score"] for x in quality.score(table, quality.fit(table, none, vectors), vectors).collect()} == {0.5}
    ones = spark.createDataFrame([(0, 1), (3, 1), (3, None), (99, 1)], "doc_id long, quality int")
    assert quality.score(table, quality.fit(table, ones, vectors), vectors).where("predicted = 1").count() == len(ODD)
    assert quality.learn_vectors(docs([])).shape == (quality.BUCKETS, quality.WIDTH)


def test_temperature_calibrates():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 8))
    y = (rng.random(4000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    scores = quality.train(x, y).scores(x)
    for low in (0.1, 0.4, 0.7):
        some = (scores >= low) & (scores < low + 0.2)
        assert abs(scores[some].mean() - y[some].mean()) < 0.08


def test_shapes():
    assert [quality.shape_of(w) for w in ("THE", "The", "the", "a$$$", "!!", "a-1")] == ["X", "T", "x", "x$$", "!!", "x-0"]


# ---- 4


def brute_lines(rows, size=3):
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda x: x[0]):
        if text is None:
            out[i] = (None, 0, 0)
            continue
        lines = text.split("\n")
        gone = set()
        for p in range(len(lines) - size + 1):
            w = "\n".join(lines[p : p + size])
            if not w.strip(" \t\n\x0b\x0c\r"):
                continue
            if w in seen:
                gone |= set(range(p, p + size))
            seen.add(w)
        out[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_line_dedup_against_brute_force(docs, seed):
    r = random.Random(seed)
    texts = ["\n".join(r.choice("abc ") for _ in range(r.randint(0, 12))) for _ in range(25)] + [None, "", "a\nb", "\n\n\n\n", "x\nx\nx\nx\nx"]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {x["doc_id"]: (x["text"], x["n_lines"], x["n_removed"]) for x in linededup.dedup_lines(docs(rows)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_keeps_columns(spark, docs):
    table = docs(["a\nb\nc", "a\nb\nc", None]).withColumnRenamed("source", "key").withColumnRenamed("lang", "pos")
    out = linededup.dedup_lines(table)
    assert out.columns == [*table.columns, "n_lines", "n_removed"]
    assert {x["doc_id"]: x["text"] for x in out.collect()} == {0: "a\nb\nc", 1: "", 2: None}
    same = linededup.dedup_lines(docs([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc")]))
    assert sorted(((x["doc_id"], x["text"]) for x in same.collect()), key=str) == [(1, ""), (1, ""), (None, "a\nb\nc")]
    assert linededup.dedup_lines(docs([])).count() == 0


def test_one_of_several_texts_with_one_id_keeps_its_lines(docs):
    for i in (None, 4):
        out = [x["text"] for x in linededup.dedup_lines(docs([(i, "a\nb\nc\nd"), (i, "a\nb\nc\ne"), (i, "a\nb\nc\nf")])).collect()]
        assert sum(t.startswith("a\nb\nc\n") for t in out) == 1 and sorted(t[-1] for t in out) == ["d", "e", "f"]


# ---- 5

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute_hits(doc, items, size):
    w = WORD.findall(low(doc or ""))
    hit, found = [0] * len(w), set()
    for i, t in items:
        x = WORD.findall(low(t or ""))
        n = min(size, len(x))
        for s in range(len(x) - n + 1) if x else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[s : s + n]:
                    found.add(str(i))
                    hit[p : p + n] = [1] * n
    return len(w), sum(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_contamination_against_brute_force(spark, docs, block_bytes):
    r = random.Random(6)
    words = ["a", "b", "c", "É", "d1", "X", "a-b", "z"]
    items = [(k % 9, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 2, 3, 5, 8])))) for k in range(10)] + [(10, None)]
    texts = [*ODD, *[" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(60)]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = {x["doc_id"]: x for x in decontam.contamination(docs(texts), bench, 4, block_bytes=block_bytes).collect()}
    for k, text in enumerate(texts):
        n, hit, found = brute_hits(text, items, 4)
        x = rows[k]
        assert (x["n_words"], x["n_hit"], x["n_items"], x["contaminated"]) == (n, hit, len(found), hit > 0)
        assert x["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()


def test_contamination_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contamination(docs(ODD), none).where("contaminated").count() == 0
    some = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontam.contamination(docs([]), some).count() == 0
    kept = decontam.annotate(docs(["one two three"]), some)
    assert kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and kept.first()["runs"] == [0, 2]


# ---- 7


def test_languages(spark, docs):
    r = random.Random(7)
    kinds = {"aa": "abcdeilno", "bb": "kmprstuvw", "cc": "éèàabdeil"}
    rows = []
    for k in range(400):
        lang = r.choice(list(kinds))
        rows.append((k, spell(r, kinds[lang], r.randint(4, 50)), lang))
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(table.where(bucket_of("doc_id", 4) != 2))
    got = {x["doc_id"]: x for x in langid.identify(table, model).collect()}
    held = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert len(held) > 60 and all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in held)
    odd = {x["doc_id"]: x for x in langid.identify(docs(ODD), model).collect()}
    for k, text in enumerate(ODD):
        assert (odd[k]["lang_pred"] == "und") == (text is None or not any(c.isalpha() for c in text))
    assert langid.identify(docs([]), model).count() == 0


def test_every_word_of_the_sample_is_known(docs):
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = [a + b + c + d for a in letters for b in letters for c in letters for d in "zy"]
    model = langid.learn(docs([" ".join(many)]))
    assert len(model.words) == len(many) and (model.words.find(many) >= 0).all()
    assert model.words.find(["abcdefg"])[0] == -1


def test_backoff_and_nothing_learned(docs, spark):
    of = langid.Scores.of
    model = langid.LanguageModel(["x", "y"], of({"known": (-1.0, -5.0)}, 2), of({"zq": (-4.0, -1.0), "z": (-3.0, -2.0)}, 2))
    assert model.scores_of(["known", "azqb", "zzz", "ww"]).tolist() == [[-1.0, -5.0], [-4.0, -1.0], [-3.0, -2.0], [0.0, 0.0]]
    assert model.predict(["known", "ww", None, "1"]) == [("x", model.predict(["known"])[0][1]), ("x", 0.5), ("und", 0.0), ("und", 0.0)]
    nothing = langid.learn(docs(["text"], lang=None))
    assert nothing.langs == [] and nothing.predict(["text"]) == [("und", 0.0)]


def plain_language(rows):
    """Learning and scoring by their definition, with dictionaries. Gives a function of a text."""
    langs = sorted({lang for _, lang in rows})

    def parts(word, order):
        padded = f" {word} "
        return [padded[i : i + order] for i in range(len(padded) - order + 1)]

    def words(text):
        return "".join(c if unicodedata.category(c).startswith("L") else " " for c in text.lower()).split()

    def table(count):
        totals = {lang: sum(count[lang].values()) + 1 for lang in langs}
        keys = {k for c in count.values() for k in c}
        return {k: [math.log(count[lang][k] / totals[lang]) if count[lang][k] else math.log(0.5 / totals[lang]) for lang in langs] for k in keys}

    by_word = {lang: Counter(w for t, x in rows if x == lang for w in words(t)) for lang in langs}
    by_gram = {lang: Counter() for lang in langs}
    for lang, count in by_word.items():
        for w, n in count.items():
            for order in (1, 2, 3, 4, 5):
                for g in parts(w, order):
                    by_gram[lang][g] += n
    known, grams = table(by_word), table(by_gram)

    def score(word):
        if word in known:
            return known[word]
        for order in (5, 4, 3, 2, 1):
            found = [grams[g] for g in parts(word, order) if g in grams]
            if found:
                return [sum(x) / len(found) for x in zip(*found)]
        return [0.0] * len(langs)

    def predict(text):
        all_words = words(text)
        if not all_words:
            return "und", 0.0
        sums = [sum(x) for x in zip(*map(score, all_words))]
        top = max(sums)
        return langs[sums.index(top)], 1 / sum(math.exp((x - top) / math.sqrt(len(all_words))) for x in sums)

    return predict


def test_language_against_its_definition(docs, spark):
    r = random.Random(21)
    alphabets = {"aa": "abcdeé", "bb": "cdefgß", "cc": "efghijя"}
    rows = [(spell(r, alphabets[lang], r.randint(1, 30)), lang) for lang in alphabets for _ in range(40)]
    table = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model, want = langid.learn(table), plain_language(rows)
    asked = [spell(r, "abcdefghijkéßя", r.randint(0, 12)) for _ in range(300)] + ["qq", "q a", "1 2", ""]
    for text, (lang, score) in zip(asked, model.predict(asked, langid.Memo(model, 50))):
        if max(score, want(text)[1]) > 1 / 3 + 1e-6:
            assert lang == want(text)[0], text
        assert score == pytest.approx(want(text)[1], abs=1e-4)


def test_vectors_pool_and_network_against_their_definition(docs):
    texts = ["One two, THREE 3 two.", "two one", "", None, "alone", "a b c d e f g a b"]
    sums = np.zeros((quality.BUCKETS, quality.WIDTH))
    for text in texts:
        words = [int(c) >> 10 for c in quality.codes_of(text)]
        for i, w in enumerate(words):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(words):
                    sums[w] += quality.INDEX[words[j]]
    norms = [np.sqrt((row**2).sum()) for row in sums]
    want = np.array([row / n if n > 1e-9 else row for row, n in zip(sums, norms)])
    got = quality.learn_vectors(docs(texts))
    assert np.allclose(got, want, atol=1e-6)
    codes = [int(c) for c in quality.codes_of(texts[0])]
    rows = [quality.INDEX[c >> 10] for c in codes]
    parts = [rows, [got[c >> 10] for c in codes], [quality.SHAPE[c & 1023] for c in codes], [a * b for a, b in zip(rows, rows[1:])]]
    assert np.allclose(quality.pool(texts[0], got), np.concatenate([sum(p) / len(p) for p in parts]), atol=1e-6)
    assert not quality.pool(None, got).any()
    r = np.random.default_rng(5)
    net = quality.Network(r.normal(size=6), r.random(6) + 0.5, r.normal(size=(6, 3)), r.normal(size=3), r.normal(size=3), 0.3, 1.7)
    for x in r.normal(size=(20, 6)):
        hidden = [max(0.0, sum((x[i] - net.centre[i]) / net.scale[i] * net.w1[i, j] for i in range(6)) + net.b1[j]) for j in range(3)]
        logit = sum(h * w for h, w in zip(hidden, net.w2)) + net.b2
        assert net.scores(x[None])[0] == pytest.approx(1 / (1 + math.exp(-logit / 1.7)))

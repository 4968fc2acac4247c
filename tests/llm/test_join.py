"""Operator 8, the near-copy join, against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_odd import ODD

from textfold.llm import ngramjoin
from textfold.llm import wordsets
from textfold.llm.common import Scratch
from textfold.llm.graph import components
from textfold.llm.ngramjoin import Rule, boundary, keys_of, shingles


def plain_set(text, words=5):
    """The set by its definition: A-Z fold to a-z, words end at ASCII white space."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        folded = folded.replace(c, " ")
    w = [x for x in folded.split(" ") if x]
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, similarity=80):
    """Components over exact sets of word tuples."""
    sets = {i: plain_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = {}
    for i, s in sets.items():
        for w in s:
            lists.setdefault(w, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for w in s for j in lists[w] if j > i).items():
            if 100 * n >= similarity * (len(s) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: (len(sets[i]), top(i)) for i in sets}


def near_copies(seed, n):
    r = random.Random(seed)
    words, rows = [f"w{k}" for k in range(2000)], []
    while len(rows) < n:
        base = [r.choice(words) for _ in range(r.choice([0, 1, 3, 4, 5, 6, 7, 8, 9, 10, 12, 14, 18, 25, 40, 80, 200]))]
        for _ in range(r.choice([1, 1, 2, 5, 30])):
            x = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 12))):
                if x and r.random() < 0.8:
                    k = r.choice([0, len(x) - 1, r.randrange(len(x))])
                    op = r.random()
                    if op < 0.4:
                        x[k] = r.choice(words)
                    elif op < 0.7:
                        del x[k]
                    else:
                        x.insert(k, r.choice(words))
            rows.append((len(rows) * 3 + 1, " ".join(x)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(docs, seed):
    rows = near_copies(seed, 500) + [(2 + 3 * k, t) for k, t in enumerate(ODD)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_components(docs(rows)).collect()}
    assert got == brute(rows)


def test_a_large_group_and_a_common_passage(docs):
    r = random.Random(8)
    passage = [f"p{k}" for k in range(30)]
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(120):
        x = list(base)
        x[r.randrange(60)] = f"n{k}"
        rows.append((k, " ".join(x)))
    rows += [(200 + k, " ".join(passage + [f"u{k}x{j}" for j in range(40)])) for k in range(100)]
    rows += [(400 + k, " ".join(base)) for k in range(50)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_components(docs(rows)).collect()}
    assert got == brute(rows)


def test_nulls_repeated_rows_and_empty_tables(docs):
    text = "one two three four five six"
    rows = [(7, text), (7, text), (None, text.upper()), (3, None), (4, "")]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngramjoin.jaccard_components(docs(rows)).collect()), key=str)
    assert got == [(3, 0, 3), (4, 0, 4), (7, 2, None), (7, 2, None), (None, 2, None)]
    assert ngramjoin.jaccard_components(docs([])).count() == 0


def test_sets_follow_their_definition():
    r = random.Random(9)
    for _ in range(300):
        text = "".join(r.choice(["a", "B", "É", " ", "\t", " ", "\x1c", "\n", "bc"]) for _ in range(r.randint(0, 30)))
        assert len(shingles(text.encode())) == len(plain_set(text))


@pytest.mark.parametrize("similarity", [50, 80, 95])
def test_linked_sets_share_enough_keys(similarity):
    rule = Rule(similarity)
    rng = np.random.default_rng(10)
    ranks = rng.integers(0, 4, 1 << 8).astype(np.uint8)
    for light in (0, 12, 30):
        for _ in range(1500):
            a = int(rng.integers(2, 60))
            shared = int(rng.integers(1, a + 1))
            b = shared + int(rng.integers(0, 15))
            members = rng.integers(0, 1 << 63, a + b, dtype=np.uint64)
            x, y = np.unique(members[:a]), np.unique(np.concatenate((members[:shared], members[a : a + b - shared])))
            both = len(np.intersect1d(x, y))
            if 100 * both < similarity * (len(x) + len(y) - both) or len(x) == len(y) == both:
                continue
            assert both >= rule.overlap(len(x), len(y))
            kx, ky = ({side: set(k.tolist()) for side, k in keys_of(s, ranks, light, rule).items()} for s in (x, y))
            found = {side: len(kx[side] & ky[side]) for side in kx.keys() & ky.keys()}
            assert found.get(0, 0) >= 1 or found.get(1, 0) >= rule.lacking(len(x), len(y)), (len(x), len(y), both, light, found)
            if len(x) > light:
                assert found[1] >= max(1, len(x) // ngramjoin.MARGIN if similarity == 80 else 1)


def test_boundary_follows_the_cost():
    rule = Rule(80)
    sizes = {n: 10 for n in range(1, 65)}
    small, large = boundary(sizes, 1.0, rule), boundary(sizes, 200.0, rule)
    assert 0 < small < large <= 64


def test_components_of_links(spark):
    pairs = [(k, k + 1) for k in range(0, 40)] + [(100, 90), (90, 95), (100, 90)]
    pairs += [(1000 + k, 1500) for k in range(300)]  # a hub
    pairs += [(5000 + a, 5000 + b) for a in range(12) for b in range(a)]  # all linked
    r = random.Random(12)
    path = r.sample(range(2000, 3000), 200)
    pairs += list(zip(path, path[1:]))
    scratch = Scratch(spark, "test-components")
    found = components(spark.createDataFrame(pairs, "x long, y long").repartition(3), scratch).collect()
    got = {r["id"]: r["comp"] for r in found}
    assert len(got) == len(found)
    hub = {1000 + k: 1000 for k in range(300)} | {1500: 1000}
    assert got == {**{k: 0 for k in range(41)}, 90: 90, 95: 90, 100: 90, **hub, **{5000 + k: 5000 for k in range(12)}, **{k: min(path) for k in path}}
    assert components(spark.createDataFrame([], "x long, y long"), scratch).count() == 0


@pytest.mark.parametrize("segment", [1 << 20, 64])
def test_sets_in_bulk(monkeypatch, segment):
    monkeypatch.setattr(wordsets, "SEGMENT", segment)
    r = random.Random(13)
    texts = ["".join(r.choice(["a", "B", "É", " ", "\t", " ", "\x1c", "\n", "bc"]) for _ in range(r.randint(0, 90))) for _ in range(800)]
    texts += [None, "", ("x" * 3000 + " ") * 7, "y" * 700 + " Z", *ODD]
    array = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    sets = list(wordsets.shingle_sets(array, 5))
    by_plain = {}
    for text, s in zip(texts, sets):
        assert len(s) == len(plain_set(text))
        by_plain.setdefault(frozenset(plain_set(text)), set()).add(s.tobytes())
    assert all(len(v) == 1 for v in by_plain.values()) and len({x for v in by_plain.values() for x in v}) == len(by_plain)
    assert all(np.array_equal(a, b) for a, b in zip(wordsets.shingle_sets(array.slice(100, 50), 5), sets[100:150]))


@pytest.mark.parametrize("part", [ngramjoin.PART, 8])
def test_parts_and_scanned_lists(docs, monkeypatch, part):
    """Long lists in parts, with neighbours that find nothing, so that all comes from scanning."""
    monkeypatch.setattr(ngramjoin, "PART", part)
    if part == 8:
        found = ngramjoin._neighbours
        monkeypatch.setattr(ngramjoin, "_neighbours", lambda rows, rule: found(rows, rule).where("x % 3 = 0"))
    r = random.Random(14)
    base = [f"b{k}" for k in range(80)]
    rows = near_copies(5, 200)
    for k in range(150):
        x = list(base)
        x[r.randrange(80)] = f"n{k}"
        rows.append((5000 + k, " ".join(x)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngramjoin.jaccard_components(docs(rows), links=False).collect()}
    assert got == brute(rows)


def brute_links(rows, similarity=80):
    """Linked pairs over exact sets of word tuples, copies too."""
    sets = {i: plain_set(t) for i, t in rows}
    ids = sorted(i for i, s in sets.items() if s)
    return {
        (i, j)
        for k, i in enumerate(ids)
        for j in ids[k + 1 :]
        if 100 * (n := len(sets[i] & sets[j])) >= similarity * (len(sets[i]) + len(sets[j]) - n)
    }


@pytest.mark.parametrize("group", [ngramjoin.GROUP, 4])
def test_every_link_is_counted_and_given(docs, monkeypatch, group):
    monkeypatch.setattr(ngramjoin, "GROUP", group)
    r = random.Random(11)
    base = [f"b{k}" for k in range(60)]
    rows = near_copies(3, 250)
    for k in range(40):  # one component, in which not all are linked
        x = list(base)
        for _ in range(1 + k % 2):
            x[r.randrange(60)] = f"n{k}x{r.random()}"
        rows.append((5000 + k, " ".join(x)))
    rows += [(6000 + k, rows[-1 - k % 3][1]) for k in range(9)]
    want = brute_links(rows)
    found = ngramjoin.jaccard_components(docs(rows)).collect()
    times = Counter(i for pair in want for i in pair)
    assert {x["doc_id"]: x["n_links"] for x in found} == {i: times[i] for i, _ in rows}
    classes = {x["doc_id"]: x["class_id"] for x in found}
    pairs = [(x["x"], x["y"]) for x in ngramjoin.jaccard_links(docs(rows)).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {tuple(sorted((classes[i], classes[j]))) for i, j in want if classes[i] != classes[j]}

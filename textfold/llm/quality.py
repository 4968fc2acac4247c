"""Operator 3: quality classification from random-indexing word vectors.

Words fall into a fixed number of buckets by hash, as do word shapes (runs of upper case, lower case,
digits, and the symbols themselves). Each bucket has an index vector of a few random signs. A word
vector sums the index vectors of the words that stand within two places of the bucket's words in
all documents. A text pools, as means over its words: index vectors, word vectors, shape vectors, and
products of the index vectors of neighbouring words. A network of two layers, trained in numpy on
the driver, scores the pooled vector; its probabilities are calibrated by a temperature fitted on
rows that training did not see.

Word vectors come from all documents (tables of a fixed size, folded task by task). The network is
trained on at most about ``max_rows`` labelled rows, chosen by hash. Neither ids, sources, languages
nor labels are inputs.

Defined results: a null text counts as empty, and an empty text has the pooled vector 0; with labels of
one kind only or none, every score is that kind's share (one half, if none); several labels of a
document count as their largest; labels without a document teach nothing; repeated rows are scored
each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_rows, fold_batches, map_arrow, reduce_blocks
from .forced import FragmentMemo

BUCKETS, SHAPES, WIDTH, SIGNS = 1 << 14, 1 << 10, 32, 4
REACH = 2
MAX_ROWS = 8000
THRESHOLD = 0.3


def _index_vectors(rows: int, seed: int) -> np.ndarray:
    """A few random signs in each row."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, WIDTH), np.float32)
    places = rng.random((rows, WIDTH)).argsort(axis=1)[:, :SIGNS]
    np.put_along_axis(out, places, rng.choice(np.array([-1, 1], np.float32), (rows, SIGNS)), axis=1)
    return out


INDEX = _index_vectors(BUCKETS, 11)
SHAPE = _index_vectors(SHAPES, 12)
_PLACES = np.abs(INDEX).argsort(axis=1, kind="stable")[:, -SIGNS:]
_VALUES = np.take_along_axis(INDEX, _PLACES, axis=1)
_KINDS = ((re.compile(r"[^\W\d_]*[A-ZÀ-ÖØ-Þ][^\W\d_]*[A-ZÀ-ÖØ-Þ][^\W\d_]*"), "X"), (re.compile(r"[A-ZÀ-ÖØ-Þ][^\W\d_]*"), "T"), (re.compile(r"[^\W\d_]+"), "x"), (re.compile(r"\d+"), "0"))


def shape_of(word: str) -> str:
    """Classes of a word's characters: capitals X, a title T, small letters x, digits 0, symbols themselves up to two."""
    out, at = [], 0
    while at < len(word) and len(out) < 8:
        for pattern, kind in _KINDS:
            m = pattern.match(word, at)
            if m:
                out.append(kind)
                at = m.end()
                break
        else:
            end = at + 1
            while end < len(word) and word[end] == word[at]:
                end += 1
            out.append(word[at] * min(2, end - at))
            at = end
    return "".join(out)


def _code(word: str) -> int:
    core = word.lower().strip("!?.,;:$%&*#|\"'()[]")
    return (xxhash.xxh32_intdigest(core.encode("utf-8", "replace"), 1) & (BUCKETS - 1)) << 10 | xxhash.xxh32_intdigest(shape_of(word).encode("utf-8", "replace"), 2) & (SHAPES - 1)


_memo = FragmentMemo(_code, 500_000, 48)


def codes_of(text: str | None) -> np.ndarray:
    """Bucket and shape of every word."""
    words = text.split() if text else []
    return np.fromiter(map(_memo.__getitem__, words), np.int64, len(words))


def learn_vectors(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Word vectors of all buckets, of length 1 (0 for a bucket without neighbours)."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(BUCKETS * WIDTH, np.int64)
        gap = np.full(REACH, -1, np.int64)
        pending: list[np.ndarray] = []
        size = 0

        def add():
            words = np.concatenate(pending)
            for d in range(1, REACH + 1):
                a, b = words[:-d], words[d:]
                both = (a >= 0) & (b >= 0)
                a, b = a[both], b[both]
                for here, there in ((a, b), (b, a)):
                    for k in range(SIGNS):
                        flat = here * WIDTH + _PLACES[there, k]
                        total[:] += np.rint(np.bincount(flat, _VALUES[there, k], BUCKETS * WIDTH)).astype(np.int64)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = codes_of(text) >> 10
                pending += [words, gap]
                size += len(words)
                if size > 2_000_000:
                    add()
                    pending, size = [], 0
        if pending:
            add()
        yield pa.RecordBatch.from_arrays([*block_rows(total)], names=["block", "cells"])

    blocks = map_arrow(df.select(text_col), run, "block int, cells binary")
    sums = reduce_blocks(blocks, np.add, "i8", BUCKETS * WIDTH * 8).reshape(BUCKETS, WIDTH).astype(np.float64)
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    return (sums / np.maximum(length, 1e-9)).astype(np.float32)


def pool(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """The pooled vector of a text."""
    codes = codes_of(text)
    if not len(codes):
        return np.zeros(4 * WIDTH, np.float32)
    words = codes >> 10
    own = INDEX[words]
    pairs = own[1:] * own[:-1] if len(words) > 1 else np.zeros((1, WIDTH), np.float32)
    return np.concatenate([own.mean(0), vectors[words].mean(0), SHAPE[codes & (SHAPES - 1)].mean(0), pairs.mean(0)])


@dataclass
class Network:
    """Two layers over standardised inputs; ``temperature`` divides the logit."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def constant(share: float) -> Network:
    """A network that always gives ``share``."""
    n = 4 * WIDTH
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Network(np.zeros(n), np.ones(n), np.zeros((n, 1)), np.zeros(1), np.zeros(1), math.log(share / (1 - share)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 3) -> Network:
    """Adam on nine tenths of the rows; the temperature on the rest."""
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    aside = order[: len(y) // 10]
    rows = order[len(y) // 10 :]
    n = x.shape[1]
    net = Network(x[rows].mean(0), x[rows].std(0) + 1e-3, rng.normal(0, math.sqrt(2 / n), (n, hidden)), np.zeros(hidden), rng.normal(0, math.sqrt(1 / hidden), hidden), 0.0)
    data = ((x - net.centre) / net.scale).astype(np.float64)
    params = {"w1": net.w1, "b1": net.b1, "w2": net.w2, "b2": np.zeros(1)}
    m = {k: np.zeros_like(v) for k, v in params.items()}
    v2 = {k: np.zeros_like(v) for k, v in params.items()}
    step = 0
    for _ in range(epochs):
        shuffled = rng.permutation(rows)
        for start in range(0, len(shuffled), 256):
            some = shuffled[start : start + 256]
            a = data[some]
            pre = a @ params["w1"] + params["b1"]
            h = np.maximum(pre, 0)
            z = h @ params["w2"] + params["b2"][0]
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[some]) / len(some)
            back = np.outer(error, params["w2"]) * (pre > 0)
            grads = {"w1": a.T @ back + 1e-4 * params["w1"], "b1": back.sum(0), "w2": h.T @ error + 1e-4 * params["w2"], "b2": np.array([error.sum()])}
            step += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v2[k] = 0.999 * v2[k] + 0.001 * g * g
                params[k] -= 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params["w1"], params["b1"], params["w2"], float(params["b2"][0])
    if len(aside):
        z, t = net.logits(x[aside]), y[aside]

        def loss(temperature: float) -> float:
            s = np.clip(z / temperature, -40, 40)
            return float(np.mean(np.logaddexp(0, s) - t * s))

        net.temperature = min((10 ** (k / 20) for k in range(-10, 31)), key=lambda c: (loss(c), c))
    return net


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Network:
    """Train on the labelled rows, or evenly chosen ``max_rows`` of them."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("int").alias("label"))
    n = known.count()
    share = min(1.0, max_rows / n) if n else 1.0
    sample = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "label_id")
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(columns: list[list]) -> list[list]:
        return [columns[0], columns[2], [pool(t, sent.value).tobytes() for t in columns[1]]]

    kind = docs.schema[id_col].dataType.simpleString()
    pooled = fold_batches(rows.select("label_id", "text", "label"), run, f"label_id {kind}, label int, pooled binary")
    found = sorted(((r["label_id"], r["label"], bytes(r["pooled"])) for r in pooled.collect()), key=lambda r: (r[0], r[2]))  # about max_rows
    x = np.array([np.frombuffer(p, np.float32) for _, _, p in found], np.float64).reshape(len(found), 4 * WIDTH)
    return train(x, np.array([label for _, label, _ in found], np.float64))


def score(docs: DataFrame, network: Network, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, score, predicted`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast((network, vectors))

    def run(columns: list[list]) -> list[list]:
        net, table = sent.value
        scores = net.scores(np.array([pool(t, table) for t in columns[1]], np.float64)).tolist()
        return [columns[0], scores, [int(s >= threshold) for s in scores]]

    kind = docs.schema[id_col].dataType.simpleString()
    return fold_batches(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, score double, predicted int")

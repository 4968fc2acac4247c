"""Operator 7: language identification, words first, with back-off to characters.

A word that some language's list knows is scored by its log frequency in every language. A word
of no list is scored by its character n-grams (with a blank at either end): the longest order of
which any gram is known, then shorter ones. A text gets the language with the largest sum.

The lists are learned from labelled rows. As a bound, at most about ``max_docs`` rows of each
language are read for it (chosen by hash, evenly); every word and n-gram of these rows is kept. The
lists are sorted hashes with one row of numbers each (24 bytes for four languages), so what is
broadcast grows with the words of that sample and not with the table. Every row is scored, over its
whole text; the words of a batch that are new are looked up together.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is every text
when nothing could be learned; equal sums go to the first language by name; repeated rows give
repeated rows; an empty table an empty table; null languages teach nothing; other columns are
ignored.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, append_batches, map_arrow

LETTERS = regex.compile(r"\p{L}+")
ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return LETTERS.findall(text.lower())


def grams_of(word: str, order: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def hash_of(key: str) -> int:
    """What Spark's ``xxhash64`` gives for a string, as an unsigned number."""
    return xxhash.xxh64_intdigest(key.encode("utf-8", "replace"), 42)


class Scores:
    """Rows of numbers by string, held as sorted hashes (64 bit) and one array."""

    def __init__(self, hashes: np.ndarray, rows: np.ndarray):
        self.hashes, self.rows = hashes, rows

    @classmethod
    def of(cls, rows: dict[str, tuple[float, ...]], width: int) -> Scores:
        hashes = np.array([hash_of(k) for k in rows], np.uint64)
        order = np.argsort(hashes)
        return cls(hashes[order], np.array(list(rows.values()), np.float32).reshape(-1, width)[order])

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, keys: list[str]) -> np.ndarray:
        """The row of each key, -1 for unknown ones."""
        wanted = np.fromiter(map(hash_of, keys), np.uint64, len(keys))
        if not len(self.hashes):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        return np.where(self.hashes[at] == wanted, at, -1)


@dataclass
class LanguageModel:
    """Log frequencies by language, aligned with ``langs``."""

    langs: list[str]
    words: Scores | None = None
    grams: Scores | None = None

    def scores_of(self, words: list[str]) -> np.ndarray:
        """A row for each word: its own, else the mean of its grams of the longest order of which any is known, else 0."""
        out = np.zeros((len(words), len(self.langs)), np.float64)
        at = self.words.find(words)
        out[at >= 0] = self.words.rows[at[at >= 0]]
        left = np.flatnonzero(at < 0)
        for order in ORDERS:
            if not len(left):
                break
            grams = [grams_of(words[k], order) for k in left]
            owner = np.repeat(np.arange(len(left)), [*map(len, grams)])
            at = self.grams.find(list(itertools.chain.from_iterable(grams)))
            owner, at = owner[at >= 0], at[at >= 0]
            found = np.bincount(owner, minlength=len(left))
            for k in range(len(self.langs)):
                out[left, k] = np.bincount(owner, self.grams.rows[at, k], len(left)) / np.maximum(found, 1)
            left = left[found == 0]
        return out

    def predict(self, texts: list[str | None], memo: Memo | None = None) -> list[tuple[str, float]]:
        """Language of each text, and the share of belief it gets."""
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        memo, out, some, size = memo or Memo(self), [], [], 0
        for text in texts:  # by runs, so that few words are held beside the texts
            some.append(text)
            size += len(text or "")
            if size > 500_000:
                out += self._predict(some, memo)
                some, size = [], 0
        return out + self._predict(some, memo)

    def _predict(self, texts: list[str | None], memo: Memo) -> list[tuple[str, float]]:
        words = [words_of(t) if t else [] for t in texts]
        memo.learn(words)
        out = []
        for own in words:
            if not own:
                out.append((UNKNOWN, 0.0))
                continue
            sums = memo.rows[np.fromiter(map(memo.places.__getitem__, own), np.int64, len(own))].sum(axis=0)
            best = int(np.argmax(np.round(sums, 9)))  # of equal sums the first
            out.append((self.langs[best], float(1 / np.exp((sums - sums[best]) / math.sqrt(len(own))).sum())))
        return out


class Memo:
    """Scores of words met lately. Emptied when it holds ``most`` of them."""

    def __init__(self, model: LanguageModel, most: int = 120_000):
        self.model, self.most = model, most
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.langs)))

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.places) > self.most:
            self._clear()
        new = list({w for words in texts for w in words if w not in self.places})
        for start in range(0, len(new), 20_000):
            some = new[start : start + 20_000]
            self.places.update(zip(some, range(len(self.places), len(self.places) + len(some))))
            self.rows = np.concatenate((self.rows, self.model.scores_of(some)))


def learn(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    order_by: Column | None = None,
    max_docs: int = 3000,
) -> LanguageModel:
    """Learn from all rows of ``df`` that have a text and a language, within the bound."""
    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(order_by if order_by is not None else F.xxhash64(text_col), F.lit(1 << 20)).alias("deal"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel([])
    langs = sorted(sizes)
    share = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1 << 20, math.ceil((1 << 20) * max_docs / sizes[lang])))])
    sample = rows.where(F.col("deal") < share[F.col("lang")]).select("lang", "text")

    def count(batches):
        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                seen.update((lang, w) for w in words_of(text))
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(seen.values()), pa.int64())],
                names=["lang", "gram", "n"],
            )

    def spread(batches):
        for batch in batches:
            seen: Counter = Counter()
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for order in ORDERS:
                    for g in grams_of(word, order):
                        seen[lang, g] += n
            keys = list(seen)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(seen.values()), pa.int64())],
                names=["lang", "gram", "n"],
            )

    schema = "lang string, gram string, n long"
    scratch = Scratch(df.sparkSession, "language")
    words = scratch.settle(map_arrow(sample, count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "words")
    grams = map_arrow(words, spread, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    number = F.create_map(*[F.lit(x) for k, lang in enumerate(langs) for x in (lang, k)])

    def listed(counts: DataFrame) -> Scores:
        """All of a list, which is of the bounded sample."""
        found = counts.select(F.xxhash64("gram"), number[F.col("lang")], "n").toArrow()
        hashes, lang, n = (found.column(k).to_numpy() for k in range(3))
        hashes, at = np.unique(hashes.view(np.uint64), return_inverse=True)
        totals = np.bincount(lang, n, len(langs)) + 1
        rows = np.tile(np.log(0.5 / totals), (len(hashes), 1))
        rows[at, lang] = np.log(n) - np.log(totals[lang])
        return Scores(hashes, rows.astype(np.float32))

    model = LanguageModel(langs, listed(words), listed(grams))
    scratch.drop("words")
    return model


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` of every row."""
    return annotate(df.select(id_col, text_col), model, text_col).select(id_col, "lang_pred", "score")


def annotate(df: DataFrame, model: LanguageModel, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``df`` with the prediction and its score added under ``names``."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make(columns: list[list]) -> list[list]:
        own = sent.value
        if not hasattr(own, "memo"):
            own.memo = Memo(own)
        found = own.predict(columns[0], own.memo)
        return [[f[0] for f in found], [f[1] for f in found]]

    return append_batches(df, [text_col], make, f"`{names[0]}` string, `{names[1]}` double")

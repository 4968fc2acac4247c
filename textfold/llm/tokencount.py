"""Operator 9: exact token counts at every prefix, by dynamic programming.

For a BPE vocabulary the last token of every prefix is unique: it is the one token ending
there that stays apart from the last token of the prefix before it, which two tokens do when
encoding their joined text gives the two again. So one pass from left to right finds, for every
prefix, its last token and its count (the count of the prefix before that token, plus one).
The stored counts answer how many tokens a text has, how many characters fit a budget, and
where a text must be cut, without encoding anything again.

Vocabularies are ``sentencepiece`` BPE models with byte fallback. Fragments between pairs that
no piece joins (see :mod:`forced`) are independent, so the counts of a fragment's prefixes are
kept in a bounded memo and put together with running offsets.

Defined results: a null text counts as empty (0 bytes, 0 tokens); whole texts are counted,
however long; repeated rows give repeated rows; an empty table an empty table; other columns
are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_batches
from .forced import FragmentMemo, PairTable

#: Pairs are told apart below this code point; characters above pair with everything.
WIDTH = 0x250


class PrefixCounter:
    """Counts of one model."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.longest = max(map(len, self.score))
        self.ends: dict[str, tuple[int, ...]] = {}
        by_end: dict[str, set[int]] = {}
        for piece in self.score:
            by_end.setdefault(piece[-1], set()).add(len(piece))
        self.ends = {c: tuple(sorted(s, reverse=True)) for c, s in by_end.items()}
        self.pairs = PairTable((map(ord, p) for p in self.score), WIDTH)
        # U+2581 stands for a blank: give it the blank's place, below WIDTH
        w = WIDTH + 1
        mark = 0x20
        for piece in self.score:
            for a, b in zip(piece, piece[1:]):
                if "▁" in (a, b):
                    x, y = (mark if c == "▁" else min(ord(c), WIDTH) for c in (a, b))
                    self.pairs.joined[x * w + y] = True
        self.apart_memo: dict[tuple[str, str], bool] = {}
        self.memo = FragmentMemo(self._fragment)

    def split(self, text: str) -> list[str]:
        """Greedy merging of one short text: always the highest score, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def apart(self, left: str, right: str) -> bool:
        """Whether two neighbouring tokens stay as they are."""
        key = (left, right)
        known = self.apart_memo.get(key)
        if known is None:
            if len(self.apart_memo) >= 1_000_000:
                self.apart_memo.clear()
            known = self.apart_memo[key] = self.split(left + right) == [left, right]
        return known

    def prefix_counts(self, text: str) -> list[int]:
        """Token counts of all prefixes of a text in the model's own alphabet, the empty one first."""
        score, apart, longest = self.score, self.apart, self.longest
        last: list[str] = [""]
        counts = [0]
        for i in range(1, len(text) + 1):
            c = text[i - 1]
            found = None
            for size in self.ends.get(c, ()):
                if size > i:
                    continue
                token = text[i - size : i]
                if token not in score:
                    continue
                before = last[i - size]
                if apart(before, token) if before else self.whole(token):
                    found = token
                    break
            if found is None:  # a character of no piece: its bytes, and nothing merges with it
                last.append(c)
                counts.append(counts[i - 1] + len(c.encode("utf-8", "surrogatepass")))
            else:
                last.append(found)
                counts.append(counts[i - len(found)] + 1)
        return counts

    def whole(self, token: str) -> bool:
        """Whether a token alone is its own encoding."""
        key = ("", token)
        known = self.apart_memo.get(key)
        if known is None:
            known = self.apart_memo[key] = self.split(token) == [token]
        return known

    def _fragment(self, fragment: str) -> bytes | np.ndarray:
        counts = self.prefix_counts(fragment)[1:]
        return bytes(counts) if counts[-1] < 256 and max(counts) < 256 else np.array(counts, np.int64)

    def fragments(self, text: str) -> list[str]:
        """The fragments of a text as the model sees it: a blank in front, blanks marked."""
        marked = " " + text.replace("▁", " ")
        cp = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4")
        places = [0, *(np.flatnonzero(self.pairs.open(cp)) + 1).tolist(), len(cp)]
        seen = marked.replace(" ", "▁")
        return [seen[i:j] for i, j in zip(places, places[1:])]

    def counts(self, text: str) -> np.ndarray:
        """Token counts of all prefixes of a text, in characters, the empty one first."""
        if not text:
            return np.zeros(1, np.int64)
        known = list(map(self.memo.__getitem__, self.fragments(text)))
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        ends = np.fromiter([k[-1] for k in known], np.int64, len(known))
        if all(type(k) is bytes for k in known):
            inner = np.frombuffer(b"".join(known), np.uint8).astype(np.int64)
        else:
            inner = np.concatenate([np.frombuffer(k, np.uint8).astype(np.int64) if type(k) is bytes else k for k in known])
        out = inner + np.repeat(np.cumsum(ends) - ends, sizes)
        out[0] = 0  # the blank in front alone stands for the empty text
        return out


@functools.cache
def load(path: str) -> PrefixCounter:
    """The counter of a model, one for each worker process. ``files:NAME`` is a file sent with ``SparkContext.addFile``."""
    return PrefixCounter(SparkFiles.get(path[6:]) if path.startswith("files:") else path)


def count(df: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` and ``fit_chars``: the longest prefix, in characters, of at most ``limit`` tokens."""

    def make(columns: list[list]) -> list[list]:
        counter = load(model)
        n_bytes, n_tokens, fit = [], [], []
        for text in columns[1]:
            counts = counter.counts(text or "")
            n_bytes.append(len((text or "").encode("utf-8", "surrogatepass")))
            n_tokens.append(int(counts[-1]))
            fit.append(longest_prefix(counts, limit))
        return [columns[0], n_bytes, n_tokens, [n > limit for n in n_tokens], fit]

    kind = df.schema[id_col].dataType.simpleString()
    return fold_batches(df.select(id_col, F.col(text_col)), make, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix within a budget. Counts may fall as a prefix grows, so all are looked at."""
    return int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0


def cut_points(counts: np.ndarray, budget: int) -> list[int]:
    """Places that cut a text into spans whose counts differ by at most ``budget`` along the text; always forward."""
    out, at = [], 0
    while at < len(counts) - 1:
        within = np.flatnonzero(counts[at + 1 :] <= counts[at] + budget)
        at += int(within[-1]) + 1 if len(within) else 1
        out.append(at)
    return out

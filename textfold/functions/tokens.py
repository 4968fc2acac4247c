"""Token counts.

The heuristic count is one built-in expression: pieces by a pattern, one token each, but
words of more than twelve letters one for every six. Other tokenizers are Arrow functions with one
encoder for each worker.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The kinds of pieces, in the order they are tried.
_KINDS = (
    r"'(?i:[stmd]|ll|ve|re)",
    r"[一-鿿]",
    r"\r?\n[ \t]*",
    r" ?[A-Z]+(?![a-z0-9_])",
    r" ?[A-Z][a-z]+",
    r" ?[a-z]+",
    r" ?[0-9]{1,3}",
    r" {1,4}",
    r"\t+",
    r"_+",
)
#: Letters and numbers of Unicode 14 and 15, which the classes of an older Java do not know; in a pattern behind a check of their bounds.
_NEWER = (
    "870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7d0-a7d1 a7d3 a7d5-a7d9 a7f2-a7f4 10570-1057a "
    "1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 10780-10785 10787-107b0 107b2-107ba "
    "10f70-10f81 11071-11072 11075 1123f-11240 11740-11746 11ab0-11abf 11f02 11f04-11f10 11f12-11f33 11f50-11f59 12f90-12ff0 1342f "
    "13441-13446 16a70-16abe 16ac0-16ac9 1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 1b155 1d2c0-1d2d3 1df00-1df1e "
    "1df25-1df2a 1e030-1e06d 1e290-1e2ad 1e4d0-1e4eb 1e4f0-1e4f9 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df "
    "2b735-2b739 31350-323af"
)
_NEWER_CLASS = "".join("-".join(f"\\x{{{x}}}" for x in r.split("-")) for r in _NEWER.split(" "))
LETTERS = rf"\p{{L}}\p{{N}}[\x{{870}}-\x{{323af}}&&[{_NEWER_CLASS}]]"
_BLANK = r"\s\x1c-\x1f\x85\p{Z}"
JAVA_PATTERN = "|".join([*_KINDS, rf" ?[^_{_BLANK}{LETTERS}]+", rf"[{_BLANK}]+"])
PYTHON_PATTERN = re.compile("|".join([*_KINDS, r" ?[^\s\w]+", r"\s+"]))


def heuristic_tokens(text: Column | str) -> Column:
    """Heuristic count as BIGINT: 0 for an empty text, null for null, else at least 1."""
    col = F.col(text) if isinstance(text, str) else text
    pieces = F.regexp_extract_all(col, F.lit(JAVA_PATTERN), F.lit(0))
    cost = lambda p: F.when(p.rlike("^ ?[A-Za-z]{13,}$"), F.ceil(F.length(F.ltrim(p)) / 6)).otherwise(F.lit(1)).cast("long")
    total = F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: a + cost(p))
    some = F.greatest(F.lit(1).cast("long"), total)
    return F.when(col.isNull(), F.lit(None).cast("long")).when(F.length(col) == 0, F.lit(0).cast("long")).otherwise(some)


def heuristic_count(text: str) -> int:
    """The same count for one text on the driver or in a worker."""
    if not text:
        return 0
    total = 0
    for piece in PYTHON_PATTERN.findall(text):
        word = piece.lstrip(" ")
        total += math.ceil(len(word) / 6) if len(word) > 12 and word.isascii() and word.isalpha() else 1
    return max(1, total)


#: The piece patterns of rank files, and the encodings that tiktoken knows by name.
PIECES = {
    "gpt2": r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
    "cl100k": r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s""",
}
NAMED = ("cl100k_base", "o200k_base")


@functools.cache
def _ranks(path: str, pieces: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PIECES[pieces], mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _named(name: str):
    import tiktoken

    return tiktoken.get_encoding(name)


@functools.cache
def _hub(path: str):
    import os

    from tokenizers import Tokenizer

    return Tokenizer.from_file(path) if os.path.exists(path) else Tokenizer.from_pretrained(path)


class TokenCounter:
    """A tokenizer as a column expression (``column``) and as a function of one text (``count``)."""

    def __init__(self, name: str, column: Callable[[Column], Column], count: Callable[[str], int]):
        self.name, self.column, self.count = name, column, count


def _worker(name: str, count: Callable[[str], int]) -> TokenCounter:
    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else count(t)).astype("Int64")

    return TokenCounter(name, counted, count)


def get_counter(target: str = "heuristic") -> TokenCounter:
    """A tokenizer by name: ``heuristic`` (also for ``auto`` and unknown names), an encoding tiktoken has by name,
    ``ranks:FILE`` (tiktoken ranks; ``ranks+cl100k:FILE`` with the newer piece pattern) or ``hf:FILE`` (tokenizers JSON, or the name of one).

    Files need no network; names do, unless their files are in the library's cache. No remote code is run.
    """
    kind, _, path = (target or "").partition(":")
    if target in NAMED:
        return _worker(f"tiktoken:{target}", lambda t: len(_named(target).encode(t, disallowed_special=())))
    if kind.split("+")[0] == "ranks" and path:
        pieces = kind.partition("+")[2] or "gpt2"
        if pieces not in PIECES:
            raise ValueError(f"no piece pattern {pieces}; there are {sorted(PIECES)}")
        return _worker(target, lambda t: len(_ranks(path, pieces).encode_ordinary(t)))
    if kind == "hf" and path:
        return _worker(target, lambda t: len(_hub(path).encode(t, add_special_tokens=False).ids))
    return TokenCounter("heuristic", heuristic_tokens, heuristic_count)


def line_hash60(line: Column) -> Column:
    """The first 15 hex digits of a line's MD5 as an integer."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")

"""Operator 1: BPE encoding and decoding by forced-boundary splitting.

Byte pairs that occur inside no token of the vocabulary mark cuts that are certain. A text
is cut there, each fragment is encoded on its own (fragments repeat, so their ids are kept in
a bounded memo), and the ids are concatenated. The vocabulary is a byte-level BPE given as a
``tokenizers`` JSON file; results equal that library's ``encode(..., add_special_tokens=False)``
and ``decode(..., skip_special_tokens=False)``.

A cut must also leave the pre-tokenizer's pieces as they are. They are, unless the cut follows
white space (whose last blank belongs to the next word) or comes before an apostrophe (which
may begin a contraction only where no run of symbols is under way); no cut is made there.

Defined results: a null text counts as empty and has no ids; very long texts are encoded whole;
repeated rows give repeated rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json

import numpy as np
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_batches
from .forced import FragmentMemo, PairTable

#: Fixed value: the pattern by which byte-level BPE vocabularies of this family split a text.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class ForcedBPE:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_of_char()
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in added}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.special = {c.encode(): np.array([i], "<u4").tobytes() for c, i in added.items()}
        self.special_split = regex.compile(b"(" + b"|".join(regex.escape(c) for c in sorted(self.special, key=len, reverse=True)) + b")") if added else None
        self.pairs = PairTable(self.bytes_of.values(), 256)
        self.bytes_of |= {i: c.encode() for c, i in added.items()}
        # merges in order: the rank of a merged token is the place of its merge
        order = {bytes([b]): k for k, b in enumerate(sorted(range(256), key=lambda b: self.id_of[bytes([b])]))}
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            order.setdefault(bytes(byte_of[c] for c in left + right), len(order))
        self.by_rank = np.array([self.id_of[b] for b in order], "<u4")
        self.core = tiktoken.Encoding("forced", pat_str=PIECES, mergeable_ranks=order, special_tokens={})._core_bpe
        self.pieces = regex.compile(PIECES)
        self.memo = FragmentMemo(self._fragment, 250_000)
        blank = np.zeros(256, bool)
        blank[[9, 10, 11, 12, 13, 32]] = True
        self.blank = blank

    def _fragment(self, fragment: bytes) -> bytes:
        """Ids of one fragment as little-endian 32-bit integers."""
        ranks: list[int] = []
        for piece in self.pieces.findall(fragment.decode("utf-8")):
            ranks += self.core.encode_single_piece(piece.encode("utf-8"))
        return self.by_rank[ranks].tobytes()

    def cuts(self, data: bytes) -> list[int]:
        """Places of the certain cuts, with both ends."""
        b = np.frombuffer(data, np.uint8)
        if len(b) < 2:
            return [0, len(b)]
        at = self.pairs.open(b)
        at &= (b[1:] & 0xC0) != 0x80  # a character stays whole
        at &= b[1:] != 0x27
        at &= ~self.blank[b[:-1]]
        # the last byte of a blank outside ASCII: U+0085, U+00A0, or (taken widely) a three-byte character
        at[1:] &= (b[1:-1] < 0x80) | ((b[:-2] >= 0xC3) & (b[:-2] < 0xE0))
        if b[0] >= 0x80:
            at[0] = False
        return [0, *(np.flatnonzero(at) + 1).tolist(), len(b)]

    def _plain(self, data: bytes) -> bytes:
        places = self.cuts(data)
        return b"".join(map(self.memo.__getitem__, [data[i:j] for i, j in zip(places, places[1:])]))

    def encode(self, data: bytes) -> bytes:
        """Ids of a UTF-8 text as little-endian 32-bit integers."""
        if not data:
            return b""
        if not any(c in data for c in self.special):
            return self._plain(data)
        return b"".join(self.special[p] if p in self.special else self._plain(p) for p in self.special_split.split(data) if p)

    def decode(self, ids: bytes) -> bytes:
        """The UTF-8 text of ids; bytes that form no character become U+FFFD."""
        data = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return data.decode("utf-8", "replace").encode("utf-8")


@functools.cache
def load(path: str) -> ForcedBPE:
    """The encoder of a file, one for each worker process. ``files:NAME`` is a file sent with ``SparkContext.addFile``."""
    return ForcedBPE(SparkFiles.get(path[6:]) if path.startswith("files:") else path)


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (little-endian unsigned 32-bit integers as binary) of every text."""

    def make(columns: list[list]) -> list[list]:
        bpe = load(vocabulary)
        return [columns[0], [bpe.encode(t or b"") for t in columns[1]]]

    kind = df.schema[id_col].dataType.simpleString()
    return fold_batches(df.select(F.col(id_col), F.col(text_col).cast("binary")), make, f"`{id_col}` {kind}, ids binary")


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``text`` of every row of ids."""

    def make(columns: list[list]) -> list[list]:
        bpe = load(vocabulary)
        return [columns[0], [bpe.decode(i or b"").decode("utf-8") for i in columns[1]]]

    kind = df.schema[id_col].dataType.simpleString()
    return fold_batches(df.select(id_col, ids_col), make, f"`{id_col}` {kind}, text string")


def digest(ids: list[bytes], bpe: ForcedBPE) -> list[list]:
    """Token counts, digests of the ids and digests of the decoded texts."""
    return [
        [len(i) // 4 for i in ids],
        [hashlib.sha256(i).hexdigest() for i in ids],
        [hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids],
    ]


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode every text: ``id_col, n_tokens, ids_sha256, decoded_sha256``, and ``ids`` if asked for."""

    def make(columns: list[list]) -> list[list]:
        bpe = load(vocabulary)
        ids = [bpe.encode(t or b"") for t in columns[1]]
        return [columns[0], *digest(ids, bpe), *([ids] if keep_ids else [])]

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return fold_batches(df.select(F.col(id_col), F.col(text_col).cast("binary")), make, schema)

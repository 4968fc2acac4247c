"""Operator 5: benchmark decontamination by a prefix-filtered join and exact windows.

An item is the set of its windows: ten consecutive words, or all of its words where it has
fewer. A document holds a window when the ten words stand in it one after the other, that is
when it contains the window's shingles (two words) in place. For full containment the necessary
prefix of a window is one shingle, so each window is joined by its rarest one, by a count sketch of all
shingles of all documents. A document's shingle that matches gives the only start the window can
have; starts that fall outside the text are dropped (length and position), and the others are
verified word by word. Words are held as hashes of 64 bits.

Items are taken in blocks of a bounded size; one block's windows are broadcast, as arrays of about six
times its text, and all documents are read against it, once for each block and once for the sketch.
Documents are never shuffled.

Defined results: a null text has no words and no hits; items without words have no windows; items
with one id are one item; repeated documents give repeated rows; an empty table of documents gives
an empty table, one of items no hits; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .common import Scratch, block_rows, map_arrow, reduce_blocks, runs_of, unused
from .wordsets import mixed, word_codes

WINDOW = 10
#: Most bytes of item texts that are held in memory and broadcast at once.
BLOCK_BYTES = 8 << 20
#: Cells of the count sketch. They decide only which shingle a window is joined by.
CELLS = 1 << 20
#: Pairs of a place and a window that are looked at together.
PAIRS = 1 << 20

#: Bytes that part words: of the ASCII characters only digits and letters do not.
_APART = np.array([not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in range(256)])
_FIRST, _SECOND, _LONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def shingles_of(codes: np.ndarray) -> np.ndarray:
    """The shingle that begins at each word but the last."""
    return mixed(codes[:-1] * _FIRST + codes[1:] * _SECOND)


def lone_of(codes: np.ndarray) -> np.ndarray:
    """Words as the only ones of their window."""
    return mixed(codes * _LONE)


def _binary(texts: pa.Array) -> pa.Array:
    return texts if pa.types.is_binary(texts.type) else texts.cast(pa.binary())


class ItemBlock:
    """Windows of some items, each once, with the items that hold it; sorted by the shingle they are joined by."""

    def __init__(self, rows: list[tuple[str, bytes | None]], size: int, counts: np.ndarray):
        self.names = sorted({item for item, _ in rows})
        place_of = {name: k for k, name in enumerate(self.names)}
        texts = list(word_codes(pa.array([text for _, text in rows], pa.binary()), _APART))
        self.codes = np.concatenate([*texts, np.zeros(size, np.uint64)])
        begin = np.cumsum([0, *map(len, texts)])
        starts, lengths, items = [], [], []
        for (item, _), codes, low in zip(rows, texts, begin):
            if len(codes):
                n = max(1, len(codes) - size + 1)
                starts.append(np.arange(low, low + n))
                lengths.append(np.full(n, min(size, len(codes))))
                items.append(np.full(n, place_of[item]))
        if not starts:
            self.keys = np.zeros(0, np.uint64)
            return
        start, length, item = (np.concatenate(c) for c in (starts, lengths, items))
        digest, factors = np.zeros(len(start), np.uint64), mixed(np.arange(1, 2 * size + 1, 2, dtype=np.uint64) * _FIRST)
        for j in range(size):
            digest += np.where(j < length, self.codes[np.minimum(start + j, len(self.codes) - 1)] * factors[j], np.uint64(0))
        digest = mixed(digest + length.astype(np.uint64))
        order = np.lexsort((item, digest))
        digest, item = digest[order], item[order]
        fresh = np.append(True, digest[1:] != digest[:-1])
        again = np.append(False, (digest[1:] == digest[:-1]) & (item[1:] == item[:-1]))
        window = (np.cumsum(fresh) - 1)[~again]
        held = np.flatnonzero(fresh)
        start, length = start[order][held], length[order][held]
        key, place = self._prefixes(start, length, counts)
        by_key = np.argsort(key, kind="stable")
        rank = np.empty(len(by_key), np.int64)
        rank[by_key] = np.arange(len(by_key))
        self.keys, self.place = key[by_key], place[by_key].astype(np.int8 if size < 128 else np.int32)
        self.start, self.length = start[by_key].astype(np.int32), length[by_key].astype(np.int32)
        self.lone = bool((length == 1).any())
        owner = rank[window]
        listed = np.argsort(owner, kind="stable")
        self.items = item[~again][listed].astype(np.int32)
        self.item_ends = np.cumsum(np.bincount(owner, minlength=len(self.keys))).astype(np.int64)

    def _prefixes(self, start: np.ndarray, length: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The necessary prefix of each window: its rarest shingle, and where in the window it stands."""
        all_shingles = shingles_of(self.codes)
        key, place = lone_of(self.codes[start]), np.zeros(len(start), np.int64)
        for low in range(0, len(start), 100_000):
            some = slice(low, low + 100_000)
            best = None
            for j in range(int(length[some].max()) - 1):
                shingle = all_shingles[np.minimum(start[some] + j, len(all_shingles) - 1)]
                times = counts[(shingle & np.uint64(len(counts) - 1)).astype(np.int64)]
                fits = j + 1 < length[some]
                better = fits if best is None else fits & ((times < best) | ((times == best) & (shingle < key[some])))
                best = times if best is None else np.where(better, times, best)
                key[some] = np.where(better, shingle, key[some])
                place[some] = np.where(better, j, place[some])
        return key, place

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words of a document are hit, and the items (places in ``names``)."""
        hit, found = np.zeros(len(codes) + 1, np.int64), []
        if len(self.keys) and len(codes):
            for mine in (shingles_of(codes), lone_of(codes)) if self.lone else (shingles_of(codes),):
                low = np.searchsorted(self.keys, mine)
                at = np.flatnonzero(self.keys[np.minimum(low, len(self.keys) - 1)] == mine)
                low = low[at]
                many = np.searchsorted(self.keys, mine[at], "right") - low
                ends = np.cumsum(many)
                first = 0
                while first < len(at):
                    last = max(first + 1, int(np.searchsorted(ends, ends[first] - many[first] + PAIRS, "right")))
                    owner = np.repeat(np.arange(first, last), many[first:last])
                    step = np.arange(len(owner)) - np.repeat(ends[first:last] - many[first:last], many[first:last]) + (ends[first] - many[first])
                    window = low[owner] + step
                    self._verify(codes, at[owner] - self.place[window], window, hit, found)
                    first = last
        items = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return np.cumsum(hit[:-1]) > 0, items

    def _verify(self, codes, start, window, hit, found) -> None:
        length = self.length[window]
        good = (start >= 0) & (start + length <= len(codes))
        start, window, length = start[good], window[good], length[good]
        for j in range(int(length.max(initial=0))):
            same = (j >= length) | (codes[np.minimum(start + j, len(codes) - 1)] == self.codes[self.start[window] + j])
            start, window, length = start[same], window[same], length[same]
        np.add.at(hit, start, 1)
        np.add.at(hit, start + length, -1)
        for w in np.unique(window).tolist():
            found.append(self.items[self.item_ends[w - 1] if w else 0 : self.item_ends[w]])


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int):
    """Rows of items, block after block, each with whether it is the last."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else rows
        yield [(r["item"], bytes(r["text"]) if r["text"] is not None else None) for r in part.collect()], k == n - 1


def _sketch(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts of the shingles of all documents, in cells."""

    def run(batches):
        cells = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for codes in word_codes(batch.column(0), _APART):
                if len(codes) > 1:
                    np.add.at(cells, (shingles_of(codes) & np.uint64(CELLS - 1)).astype(np.int64), np.uint32(1))
        yield pa.RecordBatch.from_arrays([*block_rows(cells)], names=["block", "cells"])

    return reduce_blocks(map_arrow(docs.select(F.col(text_col).cast("binary")), run, "block int, cells binary"), np.add, "u4", 4 * CELLS)


def annotate(
    docs: DataFrame,
    items: DataFrame,
    size: int = WINDOW,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    names: tuple[str, str, str] = ("words", "runs", "items"),
) -> DataFrame:
    """``docs`` with the number of words, the first word and end of each run of hit words, and the ids of the items found added, under ``names`` (which ``docs`` doesn't have)."""
    if clash := {c.lower() for c in docs.columns} & {c.lower() for c in names}:
        raise ValueError(f"columns {sorted(clash)} are there already; give other names")
    scratch, state, counts = Scratch(docs.sparkSession, "decontam"), docs, _sketch(docs, text_col)
    n = len(docs.columns)
    place = docs.columns.index(text_col)
    added = _parse_datatype_string("words long, runs array<int>, items array<string>").fields
    schema = StructType([*docs.schema.fields, *[type(f)(name, f.dataType) for f, name in zip(added, names)]])
    for rows, last in _blocks(items, item_col, item_text_col, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(ItemBlock(rows, size, counts))

        def look(batches, sent=sent):
            block = sent.value
            for batch in batches:
                for part in runs_of(batch):
                    old = [part.column(k).to_pylist() for k in (n + 1, n + 2)] if part.num_columns > n else None
                    words, runs, found = [], [], []
                    for k, codes in enumerate(word_codes(_binary(part.column(place)), _APART)):
                        hit, own = block.hits(codes)
                        listed = [block.names[i] for i in own.tolist()]
                        if old is not None:
                            for a, b in zip(old[0][k][::2], old[0][k][1::2]):
                                hit[a:b] = True
                            listed = sorted({*listed, *old[1][k]})
                        words.append(len(codes))
                        runs.append(np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist())
                        found.append(listed)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:n], pa.array(words, pa.int64()), pa.array(runs, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))],
                        names=[*part.schema.names[:n], *names],
                    )

        state = map_arrow(state, look, schema)
        if not last:
            state = scratch.settle(state, "read")
    return state


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id_col, n_words, n_hit, n_items, items_sha256, contaminated`` and ``hit_runs`` of every document; options as of :func:`annotate`."""
    names = words, runs, items_found = unused([id_col, text_col], "words", "runs", "items")
    found = annotate(docs.select(id_col, text_col), items, size, text_col, names=tuple(names), **options)

    ends = F.transform(F.col(runs), lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return found.select(
        id_col,
        F.col(words).alias("n_words"),
        F.aggregate(ends, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_hit"),
        F.size(items_found).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_found, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size(runs) > 0).alias("contaminated"),
        F.col(runs).alias("hit_runs"),
    )

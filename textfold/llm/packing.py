"""Operator 10: packing of token ids into rows of one length, with best fit decreasing.

Documents are encoded and packed where they are read: a task packs runs of at most ``run_tokens``
tokens, so nothing is shuffled and memory is bounded. Documents longer than a row are split into
pieces that lose nothing. The pieces of a run are taken from the longest to the shortest; each goes
to the row with the least room that still holds it, found in a segment tree over the room left, and
opens a row where there is none.

A row holds ``ids`` and ``positions`` (``length`` little-endian unsigned 32-bit integers each; positions
start at 0 in every segment; what is left is filled with ``pad`` and 0), ``cu_seqlens`` (running
segment lengths from 0), and for every segment the document and the place of its first token.

Which rows there are depends on how the table is split into tasks, as each packs its own documents; what is
lost to fill is at most the last few rows of a run (see the README for figures by size of split).

Defined results: a document without tokens (null or empty text) has no segment; repeated rows are
packed each; very long texts become many segments; an empty table gives no rows; null ids are
carried; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import map_arrow

LENGTH = 2048
RUN_TOKENS = 4 << 20


class RoomTree:
    """Open rows by the room they have left; finds the least room that suffices."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def _change(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += by
            at >>= 1

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, room: int) -> int:
        """Remove and give a row with exactly this room."""
        self._change(room, -1)
        return self.rows[room].pop()

    def least(self, size: int) -> int | None:
        """The least room of at least ``size`` that some row has."""
        at = self.leaves + size
        count = self.count
        if count[at]:
            return size
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                break
            at >>= 1
        else:
            return None
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        return at - self.leaves


def pack(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers for pieces of at most ``length``; equal sizes in order."""
    tree, rows = RoomTree(length), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        room = tree.least(sizes[k])
        if room is None:
            row, room = len(rows), length
            rows.append([])
        else:
            row = tree.take(room)
        rows[row].append(k)
        if room > sizes[k]:
            tree.put(room - sizes[k], row)
    return rows


def _rows(run: list[tuple], length: int, pad: int) -> Iterator[tuple]:
    pieces = [(doc, ids[at : at + length], at) for doc, ids in run for at in range(0, len(ids), length)]
    for row in pack([len(p[1]) for p in pieces], length):
        own = [pieces[k] for k in row]
        sizes = [len(p[1]) for p in own]
        used = sum(sizes)
        ids = np.full(length, pad, "<u4")
        ids[:used] = np.concatenate([p[1] for p in own])
        positions = np.zeros(length, "<u4")
        positions[:used] = np.concatenate([np.arange(s) for s in sizes])
        yield used, len(own), ids.tobytes(), positions.tobytes(), [0, *np.cumsum(sizes).tolist()], [p[0] for p in own], [p[2] for p in own]


def pack_documents(
    df: DataFrame, vocabulary: str, length: int = LENGTH, pad: int = 0, run_tokens: int = RUN_TOKENS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Packed rows: ``pack_id, n_tokens, n_segments, ids, positions, cu_seqlens, doc_ids, doc_starts``."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"pack_id long, n_tokens int, n_segments int, ids binary, positions binary, cu_seqlens array<int>, doc_ids array<{kind}>, doc_starts array<long>"

    def pieces(batches):
        encoder = bpe.load(vocabulary)
        task, number = TaskContext.get().partitionId(), 0

        def flush(run):
            nonlocal number
            held = []
            for row in _rows(run, length, pad):
                held.append(((task << 33) + number, *row))
                number += 1
                if len(held) == 512:
                    yield batch_of(held)
                    held = []
            if held:
                yield batch_of(held)

        run, tokens = [], 0
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(encoder.encode(text or b""), "<u4")
                if not len(ids):
                    continue
                if run and tokens + len(ids) > run_tokens:
                    yield from flush(run)
                    run, tokens = [], 0
                run.append((doc, ids))
                tokens += len(ids)
        yield from flush(run)

    id_type = df.select(id_col).limit(0).toArrow().schema.field(0).type
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(id_type), pa.list_(pa.int64())]
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return map_arrow(df.select(F.col(id_col), F.col(text_col).cast("binary")), pieces, schema)


def unpack(packed: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text`` of every packed document, from its segments. For ids that are unique."""
    kind = packed.schema["doc_ids"].dataType.elementType.simpleString()
    parts = packed.select(
        F.posexplode(F.arrays_zip("doc_ids", "doc_starts")).alias("k", "seg"), "ids", "cu_seqlens"
    ).select(
        F.col("seg.doc_ids").alias("doc_id"),
        F.col("seg.doc_starts").alias("start"),
        F.expr("substring(ids, cu_seqlens[k] * 4 + 1, (cu_seqlens[k + 1] - cu_seqlens[k]) * 4)").alias("part"),
    )
    whole = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "part"))).alias("parts"))
    ids = whole.select(F.col("doc_id").cast(kind), F.expr("aggregate(parts, cast('' as binary), (a, p) -> a || p.part)").alias("ids"))
    return bpe.decode(ids, vocabulary)


def write_matrix(packed: DataFrame, folder: str) -> None:
    """Write packed rows as a table of fixed-width binary rows, through Spark's committed writer."""
    packed.write.mode("overwrite").parquet(folder)


def _row_bytes(ids, positions, lens) -> tuple[bytes, bytes, bytes]:
    return ids, positions, np.array([len(lens), *lens], "<u4").tobytes()


FILES = ("ids.bin", "positions.bin", "cu_seqlens.bin")


def export_matrix(packed: DataFrame, folder: str) -> int:
    """Stream packed rows, in order of ``pack_id``, into ``ids.bin``, ``positions.bin`` and ``cu_seqlens.bin`` of a folder that the driver can write.

    The first two are matrices of 32-bit integers; the third has, for every row, the number of its
    entries and the entries. Returns the number of rows; one partition is in memory at a time. For one small
    file of each kind; :func:`export_parts` writes many at once.
    """
    os.makedirs(folder, exist_ok=True)
    n = 0
    with ExitStack() as stack:
        files = [stack.enter_context(open(f"{folder}/{name}", "wb")) for name in FILES]
        for row in packed.select("pack_id", "ids", "positions", "cu_seqlens").orderBy("pack_id").toLocalIterator():
            for f, data in zip(files, _row_bytes(row["ids"], row["positions"], row["cu_seqlens"])):
                f.write(data)
            n += 1
    return n


def export_parts(packed: DataFrame, folder: str) -> int:
    """The same three files for every task, ``part-00000.ids.bin`` and so on, written by the tasks into a folder that all of them share.

    A task writes aside and moves its files into place when they are whole, so a task that is run again leaves the same files once.
    """
    os.makedirs(folder, exist_ok=True)

    def run(batches):
        task = TaskContext.get()
        final = [f"{folder}/part-{task.partitionId():05d}.{name}" for name in FILES]
        aside = [f"{name}.{task.taskAttemptId()}.tmp" for name in final]
        n = 0
        with ExitStack() as stack:
            files = [stack.enter_context(open(name, "wb")) for name in aside]
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns)):
                    for f, data in zip(files, _row_bytes(*row)):
                        f.write(data)
                    n += 1
        for old, new in zip(aside, final):
            os.replace(old, new)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    counts = map_arrow(packed.select("ids", "positions", "cu_seqlens"), run, "n long")
    return counts.agg(F.sum("n")).first()[0] or 0

"""Operator 2: document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes of a text; its value depends on the last 32 bytes only.
Chunk ends are normalised: up to the normal size an end needs five zero bits, beyond it two, and no
chunk is shorter than the least or longer than the most, so sizes stay near the normal one. An edit
moves the ends near it and leaves the others where they are in the text.

A fingerprint is the set of (digest, length) of a text's distinct chunks, in order of digest, in
base64. The likeness of two is the length of the chunks they share over the length of the smaller
set: how far one text is contained in the other.

``fingerprint_edits`` needs each document's next one in order of id. Ids are cut into ranges at
approximate quantiles; each range also gets the first document of the next one, so a task sees all it
needs in one sorted pass over its ranges, with two documents in memory.

Defined results: a null text counts as empty; an empty text has an empty fingerprint, like an empty one
(1) and no other (0); texts are read whole; equal ids are ordered by a hash of their texts, null ids
come first; a single document is its own next; an empty table gives an empty table; other columns are
ignored. Ids are integers.
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_batches, map_arrow

LEAST, NORMAL, MOST = 6, 14, 64
STRICT, LOOSE = 1 << 27, 1 << 30
ROWS_PER_RANGE = 5000
MOST_RANGES = 50_000
_GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) for b in range(256)], np.uint32)
_ENTRY = np.dtype([("digest", ">u4"), ("length", ">u2")])


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash at every byte, by doubling the window."""
    h = _GEAR[data]
    for s in (1, 2, 4, 8, 16):
        if len(h) > s:
            h = h + np.concatenate((np.zeros(s, np.uint32), h[:-s] << np.uint32(s)))
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks."""
    n = len(data)
    h = gear(np.frombuffer(data, np.uint8))
    loose = np.flatnonzero(h < LOOSE)
    strict = loose[h[loose] < STRICT].tolist()
    loose = loose.tolist()
    strict += [n + MOST]
    loose += [n + MOST]
    ends, at = [], 0
    while n - at > LEAST:
        end = strict[bisect_left(strict, at + LEAST - 1)] + 1
        if end > at + NORMAL:
            end = min(loose[bisect_left(loose, at + NORMAL)] + 1, at + MOST)
        if end >= n:
            break
        ends.append(end)
        at = end
    if n:
        ends.append(n)
    return ends


def fingerprint(data: bytes) -> np.ndarray:
    """Digests and lengths of the distinct chunks, by digest."""
    ends = chunk_ends(data)
    starts = [0, *ends[:-1]]
    out = np.empty(len(ends), _ENTRY)
    digest = xxhash.xxh3_64_intdigest
    out["digest"] = np.array([digest(data[a:b]) & 0xFFFFFFFF for a, b in zip(starts, ends)], np.int64)
    out["length"] = np.diff([0, *ends])
    _, first = np.unique(out["digest"], return_index=True)
    return out[first]


def to_text(fp: np.ndarray) -> str:
    return base64.b64encode(fp.tobytes()).decode("ascii")


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), _ENTRY)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment by length, from 0 to 1."""
    least = min(int(a["length"].sum()), int(b["length"].sum()))
    if not least:
        return 1.0 if not len(a) and not len(b) else 0.0
    _, at, other = np.intersect1d(a["digest"].astype(np.int64), b["digest"].astype(np.int64), assume_unique=True, return_indices=True)
    return min(1.0, int(np.minimum(a["length"][at], b["length"][other]).sum()) / least)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many of the first characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fingerprint`` of every text."""
    kind = df.schema[id_col].dataType.simpleString()
    return fold_batches(
        df.select(F.col(id_col), F.col(text_col).cast("binary")),
        lambda columns: [columns[0], [to_text(fingerprint(t or b"")) for t in columns[1]]],
        f"`{id_col}` {kind}, fingerprint string",
    )


def _with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``part, tail, id, text`` such that in order of (part, tail, place) each row is followed by its next document."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumns({"place": F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("h")), "key": F.coalesce("id", F.lit(-(1 << 63))).cast("double")})
    ranges = max(1, min(MOST_RANGES, math.ceil(df.count() / ROWS_PER_RANGE)))
    bounds = sorted(set(rows.approxQuantile("key", [k / ranges for k in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    splits = [-math.inf, *bounds, math.inf] if bounds else [-math.inf, 0.0, math.inf]
    rows = Bucketizer(splits=splits, inputCol="key", outputCol="part").transform(rows).withColumn("part", F.col("part").cast("int"))
    firsts = rows.groupBy("part").agg(F.min("place").alias("place")).orderBy("part").collect()  # one row a range
    before = [(firsts[k - 1]["part"], f["place"]["id"], f["place"]["h"]) for k, f in enumerate(firsts)]
    spark = df.sparkSession
    tails = spark.createDataFrame(before, "to int, i long, h long")
    joined = rows.join(F.broadcast(tails), (F.col("place.id") == tails["i"]) & (F.col("place.h") == tails["h"]), "left")
    own = F.struct(F.col("part"), F.lit(0).alias("tail"))
    also = F.struct(F.col("to").alias("part"), F.lit(1).alias("tail"))
    places = F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, also))
    return joined.select(F.explode(places).alias("at"), "id", "text", "place").select("at.part", "at.tail", "place", "id", "text")


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every document."""
    rows = _with_next(df, id_col, text_col).repartition("part").sortWithinPartitions("part", "tail", "place").select("part", "tail", "id", "text")
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        past, held, size = None, [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)

        for batch in batches:
            for part, tail, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                data = text.encode("utf-8")
                now = (part, tail, doc, text, fingerprint(data))
                if past is not None and past[0] == part and not past[1]:
                    _, _, own, old, fp = past
                    new = edited(old, text).encode("utf-8")
                    new_fp = fingerprint(new)
                    row = (own, len(old), hashlib.sha256(new).hexdigest(), to_text(fp), to_text(new_fp), likeness(fp, new_fp), likeness(fp, now[4]))
                    held.append(row)
                    size += len(row[3]) + len(row[4])
                    if size > 8 << 20:
                        yield flush()
                        held, size = [], 0
                past = now
        if held:
            yield flush()

    return map_arrow(rows, run, f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")

"""Chunks of encoded texts that split no placeholder, with checksums to put them together again."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codec import TokenFinder

CHUNK_SIZE = 16_000


def cuts(text: str, size: int, spans: list[tuple[int, int]]) -> list[int]:
    """Ends of the chunks of a text.

    A chunk ends at ``size`` characters, before a token that would be split, and, if it holds a newline outside
    tokens, after its last one. A token longer than a chunk makes a longer chunk.
    """
    starts = [s for s, _ in spans]

    def token_at(place: int) -> tuple[int, int] | None:
        """The token that has ``place`` inside or at its start."""
        k = bisect_right(starts, place) - 1
        return spans[k] if k >= 0 and spans[k][1] > place else None

    ends, at = [], 0
    while at < len(text):
        goal = at + size
        if goal >= len(text):
            end = len(text)
        else:
            end = goal
            split = token_at(goal)
            if split and split[0] < goal:
                end = split[0]
            newline = text.rfind("\n", at, end)
            if newline >= 0 and not token_at(newline):
                end = newline + 1
            if end <= at:
                held = token_at(at)
                end = max(at + 1, min(held[1] if held else goal, len(text)))
        ends.append(end)
        at = end
    return ends or [0]


def chunk(encoded: DataFrame, tokens: list[str], size: int = CHUNK_SIZE) -> DataFrame:
    """``path, chunk_no, name, text``: names are four digits or more below the path; an empty text has one empty chunk."""

    def run(batches: Iterator[pa.RecordBatch]):
        finder = TokenFinder(set(tokens))
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                ends = cuts(text, size, finder.spans(text))
                parts = [text[a:b] for a, b in zip([0, *ends[:-1]], ends)]
                numbers = range(1, len(parts) + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(parts), pa.string()),
                        pa.array(numbers, pa.int32()),
                        pa.array([f"{path}/{k:04d}.txt" for k in numbers], pa.string()),
                        pa.array(parts, pa.string()),
                    ],
                    names=["path", "chunk_no", "name", "text"],
                )

    return encoded.select("path", "text").mapInArrow(run, "path string, chunk_no int, name string, text string")


def chunk_manifest(encoded: DataFrame, chunks: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    """``path, chunks, sha256_full, chunk_size, total_len`` of every text."""
    names = chunks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "name"))).alias("c"))
    return encoded.join(names, "path").select(
        "path", F.transform("c", lambda x: x["name"]).alias("chunks"), F.sha2("text", 256).alias("sha256_full"), F.lit(size).alias("chunk_size"), F.length("text").alias("total_len")
    )


def reassemble(chunks: DataFrame) -> DataFrame:
    """``path, text`` from chunks."""
    parts = chunks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "text"))).alias("c"))
    return parts.select("path", F.array_join(F.transform("c", lambda x: x["text"]), "").alias("text"))

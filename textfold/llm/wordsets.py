"""Sets of word shingles of many texts at once, in numpy over their bytes.

A word is hashed by a polynomial over its bytes (64 bit, A-Z as a-z), taken for all words of a run of
texts from one running sum; words of more than ``LONG_WORD`` bytes are hashed one by one. A shingle
mixes the hashes of its words in their order. Texts are taken in runs of about ``SEGMENT`` bytes, a
longer text in segments cut at white space, so what is held beside the texts stays small.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SEGMENT = 1 << 20
LONG_WORD = 512

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_BASE = 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


_BYTES = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _FACTORS[0])
_BYTES[65:91] = _BYTES[97:123]
_NONE = np.zeros(0, np.uint64)


@functools.cache
def _powers(base: int, size: int) -> np.ndarray:
    """The first powers of an odd number, modulo 2^64."""
    steps = np.full(size, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


def _codes(data: np.ndarray, cuts: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of at most ``SEGMENT`` bytes; no word goes over one of ``cuts``. ``space`` tells which bytes part words."""
    up, down = _powers(_BASE, SEGMENT), _powers(pow(_BASE, -1, 1 << 64), SEGMENT)
    word = ~space[data]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    begin[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    codes = (sums[ends] - sums[starts]) * down[starts]
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        codes[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes().lower())
    return codes, starts


def _long_codes(data: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Hashes of the words of one text of any length."""
    out, at = [], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        if end < len(data):
            spaces = np.flatnonzero(space[data[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:  # one word goes over the whole segment
                while end < len(data) and not space[data[end : end + SEGMENT]].any():
                    end += SEGMENT
                end = min(len(data), end)
                if end < len(data):
                    end += int(np.argmax(space[data[end : end + SEGMENT]]))
                out.append(np.array([xxhash.xxh3_64_intdigest(data[at:end].tobytes().lower())], np.uint64))
                at = end
                continue
        out.append(_codes(data[at:end], np.zeros(0, np.int64), space)[0])
        at = end
    return np.concatenate(out) if out else _NONE


def _shingled(codes: np.ndarray, k: int) -> np.ndarray:
    out = np.full(max(0, len(codes) - k + 1), k, np.uint64)
    for j in range(k):
        out += codes[j : j + len(out)] * (_FACTORS[j % 5] + np.uint64(2 * (j // 5)))
    return mixed(out)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    if len(values) > 1:
        values = values[np.append(True, values[1:] != values[:-1])]
    return values


def _runs(texts: pa.Array, space: np.ndarray) -> Iterator[tuple[np.ndarray, list[tuple[int, int]]]]:
    """Word hashes of runs of texts (binary, UTF-8), and where those of each text begin and end. Nulls have none."""
    n = len(texts)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if n and buffers[2] is not None else np.zeros(0, np.uint8)
    null = texts.is_null().to_numpy(zero_copy_only=False) if texts.null_count else np.zeros(n, bool)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SEGMENT, "right")) - 1)
        part = data[offsets[first] : offsets[last]]
        if len(part) > SEGMENT:  # one long text
            codes = _long_codes(part, space)
            places = np.array([0, len(codes)])
        else:
            cuts = offsets[first : last + 1] - offsets[first]
            codes, starts = _codes(part, cuts, space)
            places = np.searchsorted(starts, cuts)
        ends = np.where(null[first:last], places[:-1], places[1:])
        yield codes, list(zip(places[:-1].tolist(), ends.tolist()))
        first = last


def word_codes(texts: pa.Array, space: np.ndarray) -> Iterator[np.ndarray]:
    """For each text the hashes of its words, in their order."""
    for codes, places in _runs(texts, space):
        for low, high in places:
            yield codes[low:high]


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text (binary, UTF-8) its sorted distinct shingles; none for a null or a text without words, one for fewer words than a shingle has."""
    for codes, places in _runs(texts, _SPACE):
        whole = _shingled(codes, words)
        for low, high in places:
            if high == low:
                yield _NONE
            elif high - low < words:
                yield _shingled(codes[low:high], high - low)
            else:
                yield _distinct(whole[low : high - words + 1])

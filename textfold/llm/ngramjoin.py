"""Operator 8: Jaccard join on word n-grams, light sets by subsets, heavy sets by inverted lists.

A document's set holds the hashes (64 bit) of its distinct five-word shingles. Two sets are linked
when ``100 * |A and B| >= 80 * |A or B|``. A set of n members shares at least ``m = ceil(0.8 n)`` with
any linked partner, so with all sets in one global order the first ``n - m + k`` members of two linked
sets have at least k in common.

* *Light* sets (up to a boundary size) enumerate all subsets of k = 2 members of that prefix; linked
  light sets share one.
* *Heavy* sets take part with the single members of their prefix (k = 1 + n // 20) in inverted
  lists; light sets large enough to be linked with a heavy one are guests there. The members two
  sets share in lists must reach the number that the overlap still lacks, which prunes sets and pairs.
* The boundary is the size with the least cost: subsets to enumerate against list entries to scan,
  from the histogram of sizes and the skew of a count sketch.

The global order puts rare members first, by a count sketch over all documents whose size grows with
their words (to 4 MB of ranks at most; what a task sends of it is packed); the order decides only how much work there is, never the result.

Equal sets are one node, known by a hash (64 bit) of the set; a task sends a node once, copies from
different tasks meet under their keys and become one row. Lists of more than ``PART`` entries, by the
sketch, are dealt into parts (by node and key, so that the parts of two keys differ). Most links
are found first among neighbours in the lists, which is linear in their length; connected components
then leave only pairs across components, which are scanned exhaustively, list by list and part by
part, so no link that could join two components is lost.

Linked sets are in one component, so all links are then found inside components: the nodes of a
component are dealt into blocks, and each pair of blocks is one group of rows, in which every pair of
sets is compared by its whole sets. The work is the square of a component's different sets; what is
shipped is its sets times its blocks. ``jaccard_components`` counts the links of each document (unless
``links=False``), ``jaccard_links`` gives the pairs. The one pair of a component of two nodes is a link
that was verified before.

Defined results: a null text, or one without words, has an empty set, is linked with nothing and is
its own component; fewer than five words are one shingle; very long texts are one set each; every row
is a document, so repeated rows are copies of each other; a null id sorts before all others; an empty
table gives an empty table; other columns are ignored. Ids are integers.
"""

from __future__ import annotations

import logging
import math
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, block_rows, map_arrow, reduce_blocks
from .graph import components
from .wordsets import mixed, shingle_sets

log = logging.getLogger(__name__)

WORDS = 5
SIMILARITY = 80  # of 100
#: Cells of the count sketch: one for so many bytes of text, within these powers of two.
CELL_BYTES, LEAST_CELLS, MOST_CELLS = 256, 16, 22
#: Bits of the filter of wanted documents: so many for each row, within these powers of two.
ROW_BITS, LEAST_BITS, MOST_BITS = 4, 19, 28
#: Entries of a list, by the sketch, from which it is dealt into parts.
PART = 1 << 20
#: In neighbours, each entry also meets the head of its run of so many.
RUN = 64
#: Prefixes of heavy sets are longer by one member in so many, so that linked sets share at least ``n // MARGIN`` members in lists.
MARGIN = 20
NO_ID = -(1 << 63)
#: Nodes and members in a block of a component, about.
GROUP, GROUP_MEMBERS = 1024, 1 << 20
#: Nodes that a task remembers as sent.
SEEN = 50_000

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The set of a UTF-8 text: sorted distinct 64-bit hashes. A-Z count as a-z; words end at ASCII white space."""
    return next(shingle_sets(pa.array([text], pa.binary()), words))


def node_of(members: np.ndarray) -> int:
    """The node of a set that is not empty."""
    return xxhash.xxh3_64_intdigest(members) - (1 << 63)


class Rule:
    """Integer arithmetic of one similarity."""

    def __init__(self, similarity: int):
        self.s = similarity

    def least(self, n):
        """Members that any linked partner shares with a set of n."""
        return -(-self.s * n // 100)

    def overlap(self, a, b):
        """Members that linked sets of a and b share."""
        return -(-self.s * (a + b) // (100 + self.s))

    def rest(self, n):
        """Members of a set of n that are not in its lists: those behind its prefix."""
        return self.least(n) - 1 - n // MARGIN

    def lacking(self, a, b):
        """Members that linked sets share within their prefixes at least: behind the end of the prefix that ends first, they share no more than the rest of that set."""
        return np.maximum(1, self.overlap(a, b) - np.maximum(self.rest(a), self.rest(b)))

    def alike(self, a, b):
        """Whether sizes (as 64-bit integers) allow a link."""
        return np.minimum(a, b) * 100 >= self.s * np.maximum(a, b)


def boundary(sizes: dict[int, int], skew: float, rule: Rule, most: int = 64) -> int:
    """The largest light size, by cost. ``sizes``: number of sets by size, up to ``most``."""

    def subsets(n: int) -> float:
        return math.comb(max(0, n - rule.least(n) + 2), 2)

    def lists(n: int) -> float:
        return (n - rule.rest(n)) * (1 + skew)

    def cost(x: int) -> float:
        guests = [n for n in sizes if n <= x and n >= rule.least(x + 1)]
        return sum(c * (subsets(n) if n <= x else lists(n)) for n, c in sizes.items()) + sum(sizes[n] * (n - rule.rest(n)) for n in guests)

    return min(range(most + 1), key=lambda x: (cost(x), x))


def ranks_of(cells: np.ndarray) -> np.ndarray:
    """Counts as bytes: four steps for each power of two."""
    return np.floor(4 * np.log2(1.0 + cells)).astype(np.uint8)


def order_of(members: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of members, and their places in the global order."""
    rank = ranks[(members & np.uint64(len(ranks) - 1)).astype(np.int64)]
    return rank, (rank.astype(np.uint64) << np.uint64(56)) | (members >> np.uint64(8))


def prefixes_of(order: np.ndarray, light: int, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Of a set, given by the order of its members: the members whose pairs are its keys, and those that are its keys in inverted lists."""
    n = len(order)
    none = np.zeros(0, np.int64)
    if n < 2:  # a set of one is linked with equal sets only
        return none, none

    def first(k):
        return np.argpartition(order, min(n, k) - 1)[:k]

    return first(n - rule.least(n) + 2) if n <= light else none, first(n - rule.rest(n)) if n > light or n >= rule.least(light + 1) else none


def pair_keys(members: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all pairs of members, with the lesser rank of each."""
    a, b = np.triu_indices(len(members), 1)
    low, high = np.minimum(members[a], members[b]), np.maximum(members[a], members[b])
    return mixed(low * _FACTOR + mixed(high)), np.minimum(rank[a], rank[b])


def keys_of(members: np.ndarray, ranks: np.ndarray, light: int, rule: Rule) -> dict[int, np.ndarray]:
    """The keys of a set, by side."""
    rank, order = order_of(members, ranks)
    pairs, lists = prefixes_of(order, light, rule)
    return {side: keys for side, keys in ((0, pair_keys(members[pairs], rank[pairs])[0]), (1, members[lists])) if len(keys)}


def _describe(docs: DataFrame, words: int, cells_log2: int) -> DataFrame:
    """A row for each document (id, size, node) and the blocks of the tasks' sketches."""
    names = ["id", "n", "node", "block", "cells"]

    def run(batches):
        cells = np.zeros(1 << cells_log2, np.uint32)
        mask = np.uint64(len(cells) - 1)
        for batch in batches:
            sizes, nodes, places = [], [], []
            for s in shingle_sets(batch.column(1), words):
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                places.append((s & mask).astype(np.int64))
            if places:
                np.add.at(cells, np.concatenate(places), np.uint32(1))
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), pa.array(nodes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        blocks, packed = block_rows(cells)
        n = len(blocks)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), blocks, packed], names=names)

    return map_arrow(docs, run, "id long, n int, node long, block int, cells binary")


class _Rows:
    """Arrays gathered until they are worth a batch."""

    def __init__(self, names: list[str], least: int = 200_000):
        self.names, self.least, self.held, self.size = names, least, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.held.append(columns)
        self.size += len(columns[0])

    def flush(self, force: bool = False):
        if self.size and (force or self.size >= self.least):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*self.held)], names=self.names)
            self.held, self.size = [], 0


#: Rows of sets under their keys. ``part``: -1, or the number of parts of the list and (in the low 16 bits) the row's part.
_KEYED = "key long, part int, node long, n int, id long"
_NAMES = [c.split()[0] for c in _KEYED.split(", ")]


def _parts(keys: np.ndarray, ranks: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The part of each row, from the sketch's counts."""
    parts = np.full(len(keys), -1, np.int32)
    long = np.flatnonzero(ranks > 4 * math.log2(1 + PART))
    if len(long):
        ways = np.minimum(np.ceil(np.exp2((ranks[long].astype(float) + 1) / 4) / PART), 30_000).astype(np.uint64)
        own = mixed(keys[long] ^ nodes[long].view(np.uint64)) % ways
        parts[long] = ((ways << np.uint64(16)) | own).astype(np.int32)
    return parts


def _emit(docs: DataFrame, words: int, sent, light: int, rule: Rule) -> DataFrame:
    """A row for every key of every set. The low bit of a key tells its side. Copies that one task meets again (of the last many) are left out."""

    def rows_of(ids, nodes, sets):
        sizes = np.array([*map(len, sets)], np.int64)
        members = np.concatenate(sets)
        rank, order = order_of(members, sent.value)
        ends = np.cumsum(sizes)
        places, owners = [], []  # of keys in lists
        keys, ranks, keyed = [], [], []  # of pairs
        for k, (low, high) in enumerate(zip((ends - sizes).tolist(), ends.tolist())):
            pairs, lists = prefixes_of(order[low:high], light, rule)
            if len(lists):
                places.append(lists + low)
                owners.append((k, len(lists)))
            if len(pairs):
                key, least = pair_keys(members[low:high][pairs], rank[low:high][pairs])
                keys.append(key & ~_ONE)
                ranks.append(least)
                keyed.append((k, len(key)))
        if places:
            at = np.concatenate(places)
            keys.append(members[at] | _ONE)
            ranks.append(rank[at])
        if not keys:
            return
        owner = np.repeat(*np.array([*keyed, *owners], np.int64).T)
        key, rank = np.concatenate(keys), np.concatenate(ranks)
        node = np.array(nodes, np.int64)[owner]
        columns = [key.view(np.int64), _parts(key, rank, node), node, sizes[owner].astype(np.int32), np.array(ids, np.int64)[owner]]
        for start in range(0, len(key), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[start : start + 200_000]) for c in columns], names=_NAMES)

    def run(batches):
        seen: OrderedDict = OrderedDict()
        ids, nodes, sets, size = [], [], [], 0
        for batch in batches:
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), words)):
                if len(s) < 2:
                    continue
                node = node_of(s)
                if node in seen:
                    continue
                seen[node] = None
                if len(seen) > SEEN:
                    seen.popitem(last=False)
                ids.append(doc)
                nodes.append(node)
                sets.append(s)
                size += len(s)
                if size > 500_000:
                    yield from rows_of(ids, nodes, sets)
                    ids, nodes, sets, size = [], [], [], 0
        if sets:
            yield from rows_of(ids, nodes, sets)

    return map_arrow(docs, run, _KEYED)


def _columns(batch) -> list[np.ndarray]:
    return [c.to_numpy() for c in batch.columns]


def _groups(batches, place: int):
    """Columns of sorted batches, cut so that no value of the column at ``place`` goes over two of them."""
    held: list = []  # rows of the last value so far
    for batch in batches:
        if not batch.num_rows:
            continue
        data = _columns(batch)
        if held and data[place][-1] == held[0][place][0]:
            held.append(data)
            continue
        data = [np.concatenate(c) for c in zip(*held, data)]
        start = int(np.searchsorted(data[place], data[place][-1]))
        held = [[c[start:] for c in data]]
        if start:
            yield [c[:start] for c in data]
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def _by_key(rows: DataFrame) -> DataFrame:
    """One row for each node under a key, and none where no other node has the key, from one pass over sorted partitions. In a list of parts all stay."""

    def shared(key, part):
        same = (key[1:] == key[:-1]) & (part[1:] == part[:-1])
        out = part >= 0
        out[1:] |= same
        out[:-1] |= same
        return out

    def run(batches):
        for data in _groups(batches, 0):
            same = data[0][1:] == data[0][:-1]
            some = data[1] >= 0
            some[1:] |= same
            some[:-1] |= same
            key, part, node, _, ids = data = [c[some] for c in data]  # few have a key in common
            if not len(key):
                continue
            order = np.lexsort((ids, node, part, key))
            key, part, node = data[0][order], data[1][order], data[2][order]
            fresh = np.append(True, (node[1:] != node[:-1]) | (key[1:] != key[:-1]) | (part[1:] != part[:-1]))
            order = order[fresh][shared(key[fresh], part[fresh])]
            yield pa.RecordBatch.from_arrays([pa.array(c[order]) for c in data], names=_NAMES)

    return map_arrow(rows.repartition("key", "part").sortWithinPartitions("key"), run, _KEYED)


def _by_node(rows: DataFrame) -> DataFrame:
    """Rows of nodes that share enough to be linked with anything."""

    def enough(data: list[np.ndarray]):
        key, _, node, n, _ = data
        side = (key & 1).astype(np.int64)
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        held = np.repeat(np.add.reduceat(side, first), np.diff(np.append(first, len(node))))
        keep = (side == 0) | (held >= np.maximum(1, n // MARGIN))
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in data], names=_NAMES)

    def run(batches):
        yield from map(enough, _groups(batches, 2))

    return map_arrow(rows.repartition("node").sortWithinPartitions("node"), run, _KEYED)


def _sets(docs: DataFrame, rows: DataFrame, words: int, bits_log2: int) -> DataFrame:
    """``node, members`` of the nodes of ``rows`` (and of a few documents more), found by a filter of their ids."""
    mask = (1 << bits_log2) - 1

    def place(values: np.ndarray) -> np.ndarray:
        return (mixed(values.view(np.uint64) * _FACTOR) & np.uint64(mask)).astype(np.int64)

    def mark(batches):
        bits = np.zeros(1 << (bits_log2 - 3), np.uint8)
        for batch in batches:
            at = place(np.unique(batch.column(0).to_numpy()))
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([*block_rows(bits)], names=["block", "cells"])

    bits = reduce_blocks(map_arrow(rows.select("id"), mark, "block int, cells binary"), np.bitwise_or, "u1", 1 << (bits_log2 - 3))
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        seen: OrderedDict = OrderedDict()
        for batch in batches:
            at = place(batch.column(0).to_numpy())
            wanted = np.flatnonzero(sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            for start in range(0, len(wanted), 500):
                texts = batch.column(1).take(pa.array(wanted[start : start + 500]))
                nodes, sets = [], []
                for s in shingle_sets(texts, words):
                    if len(s) and (node := node_of(s)) not in seen:
                        seen[node] = None
                        if len(seen) > SEEN:
                            seen.popitem(last=False)
                        nodes.append(node)
                        sets.append(s.view(np.int64))
                if nodes:
                    ends = np.cumsum([0, *map(len, sets)])
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), lists], names=["node", "members"])

    return map_arrow(docs, run, "node long, members array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (each once) whose sets are linked."""
    left = sets.select(F.col("node").alias("x"), F.col("members").alias("mx"))
    right = sets.select(F.col("node").alias("y"), F.col("members").alias("my"))
    both = F.size(F.array_intersect("mx", "my")).cast("long")
    joined = pairs.select("x", "y").join(left, "x").join(right, "y")
    return joined.where(100 * both >= rule.s * (F.size("mx") + F.size("my") - both)).select("x", "y").distinct()


def _neighbours(rows: DataFrame, rule: Rule) -> DataFrame:
    """Candidates that are neighbours in some list, each once: next to each other by size or by node, or behind the head of a run.

    Reads the sorted rows as they were written; where a list is cut between two tasks, a few neighbours are left to scanning.
    """

    def pairs(data):
        key, part, node, n = data

        def of(order, heads):
            k, p, i, m = key[order], part[order], node[order], n[order].astype(np.int64)
            places = np.arange(len(k))
            fresh = np.append(True, (k[1:] != k[:-1]) | (p[1:] != p[:-1]))
            start = np.maximum.accumulate(np.where(fresh, places, 0))
            others = [places - 1] + ([start + (places - start) // RUN * RUN] if heads else [])
            for other in others:
                at = np.flatnonzero(~fresh & (other < places))
                to = other[at]
                good = rule.alike(m[at], m[to])
                a, b = i[at[good]], i[to[good]]
                yield np.stack([np.minimum(a, b), np.maximum(a, b)], 1)

        found = [*of(np.lexsort((node, n, part, key)), True), *of(np.lexsort((node, part, key)), False)]
        return np.unique(np.concatenate(found), axis=0)

    def run(batches):
        tail, held, size = None, [], 0

        def flush():
            all_pairs = np.unique(np.concatenate(held), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(all_pairs[:, k])) for k in range(2)], names=["x", "y"])

        for batch in batches:
            if not batch.num_rows:
                continue
            data = _columns(batch)
            if tail is not None:
                data = [np.concatenate(x) for x in zip(tail, data)]
            start = int(np.searchsorted(data[0], data[0][-1]))  # the last list may go on
            if len(data[0]) - start > 50_000:
                start = len(data[0]) - 1
            tail = [c[start:] for c in data]
            if start:
                held.append(pairs([c[: start + 1 if data[0][start - 1] == data[0][start] else start] for c in data]))
                size += len(held[-1])
            if size > 500_000:
                yield flush()
                held, size = [], 0
        if tail is not None:
            held.append(pairs(tail))
            yield flush()

    return map_arrow(rows.select("key", "part", "node", "n"), run, "x long, y long").distinct()


def _scanned(rows: DataFrame, stars: DataFrame, split: bool, rule: Rule) -> DataFrame:
    """Candidates across components that share enough in their lists, by scanning whole lists for every set of a lesser component."""
    sizes = stars.groupBy("comp").agg(F.count("*").alias("weight"))
    known = stars.join(sizes, "comp").select(F.col("id").alias("node"), "comp", "weight")
    rows = rows.select("key", "part", "node", "n").join(known, "node", "left")
    rows = rows.select("key", "part", "node", "n", F.coalesce("comp", "node").alias("comp"), F.coalesce("weight", F.lit(1)).alias("weight"))
    whole = rows.select("key", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("own"), "node", "n", "comp", "weight")
    if split:  # the parts of a list that several components are in meet two by two
        whole = whole.where("part < 0")
        dealt = rows.where("part >= 0").withColumn("own", F.col("part").bitwiseAND(0xFFFF)).withColumn("ways", F.shiftright("part", 16))
        mixed_keys = dealt.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
        dealt = dealt.join(mixed_keys, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)))
        whole = whole.union(dealt.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "node", "n", "comp", "weight"))
    names = ["node", "side", "n", "entries", "sizes"]

    def scan(data):
        """Probes of whole lists, each with its entries."""
        key, a, b = data[:3]
        fresh = np.append(True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        starts = np.flatnonzero(fresh)
        number = np.cumsum(fresh) - 1
        open_lists = np.minimum.reduceat(data[6], starts) != np.maximum.reduceat(data[6], starts)
        data = [c[open_lists[number]] for c in data]
        number = number[open_lists[number]]
        if not len(number):
            return
        order = np.lexsort((data[6], data[7], number))
        key, a, b, own, node, n, comp, _ = (c[order] for c in data)
        number, n = number[order], n.astype(np.int64)
        lists = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        ends = np.append(lists[1:], len(key))[np.searchsorted(lists, np.arange(len(key)), "right") - 1]
        groups = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (comp[1:] != comp[:-1])))
        beyond = np.append(groups[1:], len(key))[np.searchsorted(groups, np.arange(len(key)), "right") - 1]
        sizes = ends - beyond  # entries of greater components
        probes = np.flatnonzero(sizes)
        total = np.cumsum(sizes[probes])
        low = 0
        while low < len(probes):
            high = max(low + 1, int(np.searchsorted(total, total[low] + 500_000)))
            some = probes[low:high]
            owner = np.repeat(np.arange(len(some)), sizes[some])
            step = np.arange(len(owner)) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])
            entry = beyond[some][owner] + step
            probe = some[owner]
            good = rule.alike(n[entry], n[probe]) & ((a[probe] == b[probe]) | (own[entry] != own[probe]))
            owner, entry = owner[good], entry[good]
            met, counts = np.unique(owner, return_counts=True)
            if len(met):
                some = some[met]
                cuts = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(node[some]),
                        pa.array((key[some] & 1).astype(np.int32)),
                        pa.array(n[some]),
                        pa.ListArray.from_arrays(cuts, pa.array(node[entry])),
                        pa.ListArray.from_arrays(cuts, pa.array(n[entry])),
                    ],
                    names=names,
                )
            low = high

    def lists(batches):
        for data in _groups(batches, 0):
            if len(data[0]) > 1:
                if (data[1] != data[2]).any():
                    order = np.lexsort((data[2], data[1], data[0]))
                    data = [c[order] for c in data]
                yield from scan(data)

    met = map_arrow(whole.repartition("key", "a", "b").sortWithinPartitions("key"), lists, "node long, side int, n long, entries array<long>, sizes array<long>")

    def count(batches):
        now, held, size = None, [], 0  # the set, and what it met: nodes, sizes, times
        out = _Rows(["x", "y"], 100_000)

        def merge():
            ids, n, times = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(ids, kind="stable")
            ids, n, times = ids[order], n[order], times[order]
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            return ids[first], n[first], np.add.reduceat(times, first)

        def finish():
            if held:
                ids, n, times = merge()
                found = ids[times >= (rule.lacking(now[2], n) if now[1] else 1)]
                out.add(np.minimum(found, now[0]), np.maximum(found, now[0]))

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(3)]
            offsets = batch.column(3).offsets.to_numpy()
            ids, n = (batch.column(k).values.to_numpy() for k in (3, 4))
            for k, probe in enumerate(zip(*columns)):
                if probe != now:
                    finish()
                    yield from out.flush()
                    now, held, size = probe, [], 0
                low, high = offsets[k], offsets[k + 1]
                held.append((ids[low:high], n[low:high], np.ones(high - low, np.int64)))
                size += high - low
                if size > 1 << 20 and len(held) > 1:
                    held = [merge()]
                    size = len(held[0][0]) // 2  # distinct ones stay, so wait until as many again have come
        finish()
        yield from out.flush(True)

    return map_arrow(met.repartition("node", "side").sortWithinPartitions("node", "side"), count, "x long, y long").distinct()


def _linked(members: np.ndarray, sizes: np.ndarray, rule: Rule) -> np.ndarray:
    """Which of the sets (members one after the other) are linked, as a matrix."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, place, times = np.unique(members, return_inverse=True, return_counts=True)
    held = times[place] > 1
    owner, place = owner[held], (np.cumsum(times > 1) - 1)[place[held]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both = np.zeros((len(sizes), len(sizes)), np.float32)  # counts below 1 << 24 are exact
    width = max(64, (1 << 22) // len(sizes))
    for start in range(0, int((times > 1).sum()), width):
        low, high = np.searchsorted(place, (start, start + width))
        part = np.zeros((len(sizes), width), np.float32)
        part[owner[low:high], place[low:high] - start] = 1
        both += part @ part.T
    both = both.astype(np.int64)
    n = sizes.astype(np.int64)
    return 100 * both >= rule.s * (n[:, None] + n[None, :] - both)


def _within(info: DataFrame, sets: DataFrame, rule: Rule, pairs: bool) -> DataFrame:
    """All links inside components of three nodes and more: pairs ``x, y`` of first ids, or ``node, c``, the documents of nodes linked with one (to be summed)."""
    ways = F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("n") / GROUP_MEMBERS)).cast("int").alias("ways")
    sized = info.where("comp IS NOT NULL")
    sized = sized.join(sized.groupBy("comp").agg(ways, F.count("*").alias("nodes")).where("nodes > 2"), "comp")
    part = F.pmod(F.xxhash64("node"), F.col("ways")).cast("int").alias("part")
    dealt = sized.select("node", "comp", "docs", "first", part, F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("other"))
    dealt = dealt.select("node", "comp", "docs", "first", "part", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"))
    names = ["x", "y"] if pairs else ["node", "c"]

    def finish(key, held):
        nodes, docs, firsts, parts = (np.concatenate([h[k] for h in held]) for k in range(4))
        sizes = np.concatenate([h[4] for h in held])
        linked = _linked(np.concatenate([h[5] for h in held]), sizes, rule)
        if key[1] != key[2]:  # pairs within a block have their own group
            linked &= parts[:, None] != parts[None, :]
        own, first, at = np.unique(nodes, return_index=True, return_inverse=True)
        x, y = np.nonzero(linked)
        found = np.zeros((len(own), len(own)), bool)
        found[at[x], at[y]] = True
        np.fill_diagonal(found, False)
        if pairs:
            x, y = np.nonzero(np.triu(found))
            a, b = firsts[first][x], firsts[first][y]
            for start in range(0, len(x), 100_000):
                some = slice(start, start + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[some], b[some])), pa.array(np.maximum(a[some], b[some]))], names=names)
        else:
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(found @ docs[first])], names=names)

    def run(batches):
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            comp, a, b, nodes, docs, firsts, parts = (batch.column(k).to_numpy() for k in range(7))
            values = batch.column(7)
            offsets = values.offsets.to_numpy()
            flat = values.values.to_numpy()
            cuts = np.flatnonzero((comp[1:] != comp[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            for low, high in zip([0, *cuts], [*cuts, len(comp)]):
                key = (comp[low], a[low], b[low])
                if now != key:
                    if held:
                        yield from finish(now, held)
                    now, held = key, []
                some = slice(low, high)
                held.append((nodes[some], docs[some], firsts[some], parts[some], np.diff(offsets[low : high + 1]), flat[offsets[low] : offsets[high]]))
        if held:
            yield from finish(now, held)

    whole = dealt.join(sets, "node").select("comp", "a", "b", "node", "docs", "first", "part", "members")
    return map_arrow(whole.repartition("comp", "a", "b").sortWithinPartitions("comp", "a", "b"), run, ", ".join(f"{c} long" for c in names))


def _power(count: float, least: int, most: int) -> int:
    return min(most, max(least, math.ceil(math.log2(max(1.0, count)))))


def _join(df: DataFrame, id_col: str, text_col: str, words: int, similarity: int, cells_log2: int | None, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, Rule]:
    """Documents (``id, n, node``), nodes (``node, first, docs, n, comp``; comp is null where nothing is linked), their sets, and the rule."""
    rule = Rule(similarity)
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("binary").alias("text"))
    if cells_log2 is None:
        cells_log2 = _power((docs.agg(F.sum(F.length("text"))).first()[0] or 0) / CELL_BYTES, LEAST_CELLS, MOST_CELLS)

    told = scratch.settle(_describe(docs, words, cells_log2), "told")
    cells = reduce_blocks(told.where("block IS NOT NULL"), np.add, "u4", 4 << cells_log2)
    told = told.where("block IS NULL").select("id", "n", "node")
    sizes = {r["n"]: r["c"] for r in told.where("n BETWEEN 1 AND 128").groupBy("n").agg(F.count("*").alias("c")).collect()}
    total = float(cells.sum())
    skew = float((cells.astype(np.float64) ** 2).sum()) * len(cells) / total**2 if total else 1.0
    light = boundary(sizes, skew, rule)
    ranks = ranks_of(cells)
    split = bool((ranks > 4 * math.log2(1 + PART)).any())
    sent = spark.sparkContext.broadcast(ranks)
    rows = scratch.settle(_by_key(_by_node(_by_key(_emit(docs, words, sent, light, rule)))), "rows")
    sent.destroy()
    bits = _power(ROW_BITS * rows.count(), LEAST_BITS, MOST_BITS)
    sets = scratch.settle(_sets(docs, rows, words, bits), "sets")

    links = scratch.settle(_verified(_neighbours(rows, rule), sets, rule), "links")
    stars = components(links, scratch)
    rest = scratch.settle(_verified(_scanned(rows, stars, split, rule), sets, rule), "rest")
    scratch.drop("rows")
    if log.isEnabledFor(logging.INFO):
        log.info("boundary %d at skew %.2f; %d links of neighbours, %d of scanned lists", light, skew, links.count(), rest.count())
    if not rest.isEmpty():
        stars = components(stars.where("id <> comp").toDF("x", "y").union(rest), scratch)
    nodes = told.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("docs"), F.max("n").alias("n"))
    info = scratch.settle(nodes.join(stars.toDF("node", "comp"), "node", "left"), "nodes")
    scratch.drop("links", "rest", "stars")
    return told, info, sets, rule


def jaccard_components(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    similarity: int = SIMILARITY,
    cells_log2: int | None = None,
    links: bool = True,
) -> DataFrame:
    """``id_col, n_shingles, component_id`` of every document, ``class_id``: the smallest id with an equal set, and ``n_links``: the other documents it is linked with."""
    scratch = Scratch(df.sparkSession, "ngram-join")
    told, info, sets, rule = _join(df, id_col, text_col, words, similarity, cells_log2, scratch)
    least = info.where("comp IS NOT NULL").groupBy("comp").agg(F.min("first").alias("least"), F.sum("docs").alias("all"), F.count("*").alias("nodes"))
    shown = info.join(scratch.settle(least, "components"), "comp", "left")
    found = F.coalesce("least", "first").alias("component")
    if links:
        counts = _within(info, sets, rule, pairs=False).groupBy("node").agg(F.sum("c").alias("c"))
        # of two nodes, each is linked with the other
        others = F.when(F.col("nodes") == 2, F.col("all") - F.col("docs")).otherwise(F.coalesce("c", F.lit(0)))
        shown = shown.join(counts, "node", "left").select("node", "first", found, (F.col("docs") - 1 + others).alias("links"))
    else:
        shown = shown.select("node", "first", found)
    shown = scratch.settle(shown, "shown")
    scratch.drop("sets", "nodes", "components")

    def as_id(c):
        return F.when(c != NO_ID, c)

    joined = told.where("node IS NOT NULL").join(shown, "node").drop("node")
    alone = told.where("node IS NULL").select("id", "n", F.col("id").alias("first"), F.col("id").alias("component"), *[F.lit(0).cast("long").alias("links") for _ in range(links)])
    return joined.union(alone).select(
        as_id(F.col("id")).alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        as_id(F.col("component")).alias("component_id"),
        as_id(F.col("first")).alias("class_id"),
        *[F.col("links").alias("n_links") for _ in range(links)],
    )


def jaccard_links(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: int = SIMILARITY, cells_log2: int | None = None
) -> DataFrame:
    """``x, y`` of every two linked classes (by ``class_id``, x before y), each once. The members of a class are in the table of components."""
    scratch = Scratch(df.sparkSession, "ngram-links")
    _, info, sets, rule = _join(df, id_col, text_col, words, similarity, cells_log2, scratch)
    two = info.where("comp IS NOT NULL").groupBy("comp").agg(F.min("first").alias("x"), F.max("first").alias("y"), F.count("*").alias("nodes")).where("nodes = 2")
    found = two.select("x", "y").union(_within(info, sets, rule, pairs=True))
    return found.select(F.when(F.col("x") != NO_ID, F.col("x")).alias("x"), "y")

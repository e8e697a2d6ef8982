"""N-gram Jaccard join with a count-vector R-tree, and its connected components.

Two sets link when 100 * |intersection| >= 75 * |union|. Equal sets are one set from the start. For
the rest, linked sets of sizes n and m share at least 3/7 * (n + m) shingles, hence at least 3/4 of
either. Four exact steps narrow the search; none drops a link:

1. Shingles are ordered by hash, those frequent in a bounded sample of documents last. The first
   3/8 of a set are its filter prefix. Linked sets share a known share of their prefixes, so a set
   with fewer prefix shingles that any other document has too is alone. Prefixes travel as packed
   blocks of many documents, each shingle once per block. The sample only shapes the order: any
   order that all documents share is exact.
2. Of the sets left, those that share one of the first quarter of their shingles meet in a block.
   Blocks of one leader, the smallest set in them, are worked on together, so that a pair in many
   of them is found once.
3. An R-tree over count vectors (shingles hashed into groups, counted by group) is joined with
   itself: the overlap of two points is at most the sum of their coordinate-wise minima, that of two
   nodes the sum over their upper corners. Of the pairs found, those stay that share a prefix
   shingle with enough members behind it in both sets.
4. Every pair of different sets that is left is verified on the whole sets in the tile where it was
   found. Of the tiles in which a pair meets, it counts in one: that of its smallest common shingle.
   A tile gives numbers of links and the edges of a spanning forest, no row for a pair, so that a
   group of many near copies gives as many rows as it has sets. Components come from the forests.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (
    SLICE_ROWS, doc_key, drop_stages, fingerprint, forest, stage, text_bytes, text_slices, tidy,
)
from .substrings import SpanHasher
from .words import WORDS_BYTES, Words

WORDS = 5
#: Similarity 75 / 100: of sizes n and m, 7 * overlap >= 3 * (n + m).
NEAR, ALL = 75, 100
GROUPS = 256
#: Documents sampled for frequent shingles, and the sampled documents that make one frequent.
SAMPLE, FREQUENT = 4096, 3
#: Documents and words that one packed block holds at most.
BLOCK_DOCS, BLOCK_WORDS = 1024, 300_000
#: Input bytes for one partition of packed blocks.
PART_BYTES = 24 << 20
#: Points of an R-tree leaf, children of a node, and points of one tile of a large block.
LEAF, FAN, TILE = 16, 8, 1024
#: Groups of so few points are compared without a tree.
PLAIN = 24
#: Shingles of one side of a tile, and shingles counted at once by a product of matrices.
TILE_SHINGLES, MATRIX = 2_000_000, 4096
_TOKEN_MASK = np.uint64((1 << 48) - 1)


def shingle_sets(texts: pa.Array, size: int = WORDS) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct hashes of all shingles of each text, and its number of words; fewer words
    than ``size`` are one shingle."""
    words = Words(texts, lower=True)
    span, counts = SpanHasher(words.hashes()), words.counts
    last = np.cumsum(counts)
    full, sets = span.every(size) ^ np.uint64(size), []
    for begin, end in zip((last - counts).tolist(), last.tolist(), strict=True):
        n = end - begin
        if n >= size:
            sets.append(np.unique(full[begin:end - size + 1]))
        else:
            own = np.arange(begin, begin + (n > 0))
            sets.append(span(own, own + n) ^ np.uint64(n))
    return sets, counts


def planes(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of 64-bit numbers, byte by byte: zero bytes then compress away."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def from_planes(raw: bytes, width: int) -> np.ndarray:
    own = np.frombuffer(raw, np.uint8).reshape(width, -1)
    wide = np.zeros((own.shape[1], 8), np.uint8)
    wide[:, :width] = own.T
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def in_order(members: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Shingles as numbers in the common order: frequent ones behind all others."""
    late = np.zeros(len(members), bool)
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, members), len(frequent) - 1)] == members
    return np.sort((members >> np.uint64(1)) | (late.astype(np.uint64) << np.uint64(63)))


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles of at least FREQUENT of SAMPLE documents, chosen by hash."""
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 0, SLICE_ROWS, WORDS_BYTES):
                for own in shingle_sets(part.column(0))[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], ["token"])

    some = docs.orderBy(F.xxhash64("doc_id", "fp"), "doc_id", "fp").limit(SAMPLE).select("text")
    found = some.mapInArrow(tidy(run), "token long").groupBy("token").count().where(
        F.col("count") >= FREQUENT).select("token").toArrow()
    return np.sort(found.column("token").to_numpy().view(np.uint64))


def prefix_size(n: np.ndarray | int, extra: np.ndarray | int = 1):
    """Members of a prefix such that linked sets share ``extra`` of theirs."""
    return n - -(-NEAR * n // ALL) + extra


def _slack(n):
    """Shared prefix members asked for, by set size."""
    return np.maximum(1, n // 8)


def _pack(docs: DataFrame, parts: int, frequent: np.ndarray) -> DataFrame:
    """One row per block of documents: their keys, set sizes, set identities, and the prefix
    shingles of the block by part, each with the number of its documents and their places."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        task, serial = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        words = 0

        def block():
            nonlocal held, words, serial
            slot = np.repeat(np.arange(len(held)), [len(h[4]) for h in held])
            token = np.concatenate([h[4] for h in held] or [np.zeros(0, np.uint64)])
            order = np.argsort(token, kind="stable")
            token, slot = token[order], slot[order].astype(np.uint16)
            first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else order
            own, uses = token[first], np.diff(np.r_[first, len(token)]).astype(np.uint16)
            part = (own % np.uint64(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            ends = np.cumsum(np.bincount(part, minlength=parts))
            packed = []
            for p in range(parts):
                mine = by[(ends[p - 1] if p else 0):ends[p]]
                if len(mine):
                    n = uses[mine].astype(np.int64)
                    at = np.repeat(first[mine], n) + np.arange(n.sum()) - np.repeat(
                        np.cumsum(n) - n, n)
                    packed.append({"part": p, "tokens": planes(np.diff(
                        own[mine], prepend=np.uint64(0)), 6),
                                   "uses": uses[mine].tobytes(), "slots": slot[at].tobytes()})
            row = {"block": (task << 40) + serial, "doc_ids": [h[0] for h in held],
                   "fps": [h[1] for h in held], "sizes": [h[2] for h in held],
                   "sets": [h[3] for h in held], "packed": packed}
            held, words, serial = [], 0, serial + 1
            return row

        for part in (p for b in batches for p in text_slices(b, 2, SLICE_ROWS, WORDS_BYTES)):
            sets, counts = shingle_sets(part.column(2))
            for at, (own, size) in enumerate(zip(sets, counts.tolist(), strict=True)):
                if held and (len(held) >= BLOCK_DOCS or words + size > BLOCK_WORDS):
                    yield from pa.Table.from_pylist([block()], schema=schema).to_batches()
                members = in_order(own, frequent)
                n = len(members)
                identity = xxhash.xxh3_128_hexdigest(members.tobytes()) if n else None
                keep = min(n, int(prefix_size(n, _slack(n)))) if n else 0
                held.append((part.column(0)[at].as_py(), part.column(1)[at].as_py(), n, identity,
                             np.unique(members[:keep] & _TOKEN_MASK)))
                words += size
        if held:
            yield from pa.Table.from_pylist([block()], schema=schema).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    text = (f"block long, doc_ids array<{kind}>, fps array<long>, sizes array<long>, "
            "sets array<string>, packed array<struct<part int, tokens binary, uses binary, "
            "slots binary>>")
    schema = to_arrow_schema(_parse_datatype_string(text))
    return docs.mapInArrow(tidy(run), text)


def _count_shared(batches):
    """Of the packed blocks of one partition: how many of each document's prefix shingles occur in
    any other document, as one row per block with a number per document. A shingle comes once per
    block, however many documents there hold it. Blocks stay packed: they are opened one by one, to
    find the shingles of several blocks and to count.
    """
    def opened(raw) -> np.ndarray:
        return np.cumsum(from_planes(raw.as_buffer(), 6), dtype=np.uint64)

    batches = [batch for batch in batches if batch.num_rows]
    sizes = [len(raw.as_buffer()) // 6 for batch in batches for raw in batch.column(1)]
    every, at = np.empty(sum(sizes), np.uint64), 0
    for batch in batches:
        for raw in batch.column(1):
            own = opened(raw)
            every[at:at + len(own)] = own
            at += len(own)
    every.sort()
    several = np.unique(every[1:][every[1:] == every[:-1]])
    del every
    for batch in batches:
        for block, raw, use, slot in zip(*batch.columns, strict=True):
            own, n = opened(raw), np.frombuffer(use.as_buffer(), np.uint16)
            shared = n > 1
            if len(several):
                near = np.minimum(np.searchsorted(several, own), len(several) - 1)
                shared |= several[near] == own
            counts = np.bincount(
                np.frombuffer(slot.as_buffer(), np.uint16)[np.repeat(shared, n)])
            if len(counts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.as_py()]),
                     pa.array([counts.astype("<i4").tobytes()], pa.binary())], ["block", "shared"])


def _sum_shared(key, table):
    """The numbers of one block, over all partitions of its shingles."""
    total = np.zeros(BLOCK_DOCS, np.int64)
    for raw in table.column("shared"):
        own = np.frombuffer(raw.as_py(), "<i4")
        total[:len(own)] += own
    return pa.table({"block": pa.array([key[0].as_py()], pa.int64()),
                     "shared": pa.array([total], pa.list_(pa.int64()))})


def _describe(batches, frequent: np.ndarray):
    """(set, copies, n, members, prefix, counts) of each wanted set from its text."""
    for batch in batches:
        for part in text_slices(batch, 1, SLICE_ROWS, WORDS_BYTES):
            sets = [in_order(s, frequent) for s in shingle_sets(part.column(1))[0]]
            counts = [np.bincount((s >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS)
                      for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([s.tobytes() for s in sets], pa.binary()),
                 pa.array([s[:int(prefix_size(len(s)))].view(np.int64) for s in sets],
                          pa.list_(pa.int64())),
                 pa.array([planes(c, 4) for c in counts], pa.binary())],
                ["set", "copies", "n", "members", "prefix", "counts"])


def components(links: DataFrame, name: str) -> DataFrame:
    """(id, component) of all ends of ``links`` (a, b): the smallest id reachable.

    Every round replaces an id's label by the smallest label of its neighbours and then by that
    label's own label, so that chains halve; each round is written to the shared folder.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), name)
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select(
        "id", F.least("id", "low").alias("component")), name)
    while True:
        seen = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(
            F.col("a").alias("id")).agg(F.min("component").alias("low"))
        lower = labels.join(seen, "id").select(
            "id", "component", F.least("component", "low").alias("low"))
        jump = lower.select(F.col("id").alias("low"), F.col("low").alias("next"))
        stepped = stage(lower.join(jump, "low", "left").select(
            "id", F.least("low", F.coalesce("next", "low")).alias("component"),
            (F.least("low", F.coalesce("next", "low")) < F.col("component")).alias("moved")), name)
        labels = stepped.select("id", "component")
        if stepped.where("moved").isEmpty():
            return labels


class _Tree:
    """Packed R-tree over count vectors: levels of (upper corners, least sizes, first, last)."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, owners: np.ndarray):
        self.levels = [(counts, sizes, owners, owners)]
        width = LEAF
        while len(self.levels[-1][1]) > 1:
            high, low, small, large = self.levels[-1]
            cut = np.arange(0, len(low), width)
            self.levels.append((np.maximum.reduceat(high, cut), np.minimum.reduceat(low, cut),
                                np.minimum.reduceat(small, cut), np.maximum.reduceat(large, cut)))
            width = FAN

    def pairs(self, other: _Tree):
        """Index pairs of points with different owners whose overlap bound reaches the need."""
        level = max(len(self.levels), len(other.levels)) - 1
        a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
        while True:
            mine = self.levels[min(level, len(self.levels) - 1)]
            their = other.levels[min(level, len(other.levels) - 1)]
            keep = []
            for at in range(0, len(a), 4096):
                i, j = a[at:at + 4096], b[at:at + 4096]
                bound = np.minimum(mine[0][i], their[0][j]).sum(axis=1, dtype=np.int64)
                near = 7 * bound >= 3 * (mine[1][i] + their[1][j])
                one = (mine[2][i] == mine[3][i]) & (their[2][j] == their[3][j]) & (
                    mine[2][i] == their[2][j])
                keep.append(near & ~one)
            kept = np.concatenate(keep) if keep else np.zeros(0, bool)
            a, b = a[kept], b[kept]
            if level == 0 or not len(a):
                return a, b
            level -= 1
            a, b = self._open(a, b, other, level)

    def _open(self, a, b, other, level):
        def children(tree, nodes):
            if level >= len(tree.levels) - 1:  # the shorter tree waits at its root
                return nodes, nodes + 1
            width = LEAF if level == 0 else FAN
            start = nodes * width
            return start, np.minimum(start + width, len(tree.levels[level][1]))

        a0, a1 = children(self, a)
        b0, b1 = children(other, b)
        n, m = a1 - a0, b1 - b0
        each = n * m
        pos = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        wide = np.repeat(m, each)
        i, j = np.repeat(a0, each) + pos // wide, np.repeat(b0, each) + pos % wide
        if self is other:
            half = i <= j
            i, j = i[half], j[half]
        return i, j


def _near_in_group(owner, sizes, counts, chunk):
    """Index pairs of different owners, of two chunks or of one with itself, that may link."""
    n = len(owner)
    if n <= PLAIN:
        a, b = np.triu_indices(n, 1)
        if chunk[0] != chunk[-1]:
            cross = chunk[a] != chunk[b]
            a, b = a[cross], b[cross]
        bound = np.minimum(counts[a], counts[b]).sum(axis=1, dtype=np.int64)
        near = (7 * bound >= 3 * (sizes[a] + sizes[b])) & (owner[a] != owner[b])
        return a[near], b[near]
    trees, rows = [], []
    for own in (chunk[0], chunk[-1]) if chunk[0] != chunk[-1] else (chunk[0],):
        at = np.flatnonzero(chunk == own)
        at = at[np.lexsort((owner[at], sizes[at]))]
        trees.append(_Tree(counts[at], sizes[at], owner[at]))
        rows.append(at)
    a, b = trees[0].pairs(trees[-1])
    a, b = rows[0][a], rows[-1][b]
    differ = owner[a] != owner[b]
    return a[differ], b[differ]


def _sharing(a, b, sizes, tokens, places):
    """Of index pairs, those with a common token behind which either set has members enough. The
    smallest common shingle of linked sets is such a token."""
    if len(a) <= 2 * len(sizes):
        keep = np.zeros(len(a), bool)
        for at, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            _, x, y = np.intersect1d(tokens[i], tokens[j], True, return_indices=True)
            rest = np.minimum(sizes[i] - places[i][x], sizes[j] - places[j][y])
            keep[at] = (7 * rest >= 3 * (sizes[i] + sizes[j])).any()
        return keep
    share = np.zeros((len(sizes), len(sizes)), bool)
    every, place = np.concatenate(tokens), np.concatenate(places)
    slot = np.repeat(np.arange(len(sizes)), [len(t) for t in tokens])
    order = np.argsort(every, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(every[order])) + 1):
        if len(run) > 1:
            own = slot[run]
            n, rest = sizes[own], sizes[own] - place[run]
            share[np.ix_(own, own)] |= (
                7 * np.minimum(rest[:, None], rest) >= 3 * (n[:, None] + n))
    return share[a, b]


def _overlaps(lists: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common entries of the pairs (a, b) of sorted lists: pair by pair, or by products of a matrix
    of lists by entries, whichever is less work."""
    sizes = np.array([len(x) for x in lists], np.int64)
    every = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    known, entry, uses = np.unique(every, return_inverse=True, return_counts=True)
    shared = uses > 1
    wide = int(shared.sum())
    if 30 * int((sizes[a] + sizes[b]).sum()) + 20_000 * len(a) < len(lists) ** 2 * wide // 8:
        out = np.zeros(len(a), np.int64)
        for at, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            both = np.concatenate([lists[i], lists[j]])
            both.sort()
            out[at] = np.count_nonzero(both[1:] == both[:-1])
        return out
    slot = np.repeat(np.arange(len(lists)), sizes)
    number = np.cumsum(shared) - 1
    keep = shared[entry]
    slot, column = slot[keep], number[entry[keep]]
    order = np.argsort(column, kind="stable")
    slot, column = slot[order], column[order]
    total = np.zeros((len(lists), len(lists)), np.float32)
    for start in range(0, wide, MATRIX):
        part = slice(*np.searchsorted(column, (start, start + MATRIX)))
        table = np.zeros((len(lists), min(MATRIX, wide - start)), np.float32)
        table[slot[part], column[part] - start] = 1
        total += table @ table.T
    return total[a, b].astype(np.int64)


def _at_home(prefixes: list[np.ndarray], own: list[np.ndarray], a: np.ndarray, b: np.ndarray):
    """Whether the smallest common entry of the prefixes of each pair is one of this tile's tokens
    (``own``, a sorted part of each prefix)."""
    n, home = len(prefixes), np.zeros(len(a), bool)
    waiting = np.arange(len(a))
    if len(a) > 4 * n:  # decide many pairs at once, by ascending entries
        every = np.concatenate(prefixes)
        slot = np.repeat(np.arange(n), [len(p) for p in prefixes])
        order = np.argsort(every, kind="stable")
        every, slot = every[order], slot[order]
        tile = np.unique(np.concatenate(own))
        begin = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        end = np.r_[begin[1:], len(every)]
        open_pairs, inside = np.ones((n, n), bool), np.isin(every[begin], tile)
        verdict = np.zeros((n, n), bool)
        for turn, at in enumerate(np.flatnonzero(end - begin > 1)):
            group = np.ix_(slot[begin[at]:end[at]], slot[begin[at]:end[at]])
            if inside[at]:
                verdict[group] |= open_pairs[group]
            open_pairs[group] = False
            if turn % 16 == 15 and open_pairs[a, b].sum() <= n:
                break
        decided = ~open_pairs[a, b]
        home[decided] = verdict[a, b][decided]
        waiting = np.flatnonzero(~decided)
    for at in waiting.tolist():
        common = np.intersect1d(prefixes[a[at]], prefixes[b[at]], True)
        home[at] = len(common) > 0 and common[0] in own[a[at]]
    return home


def _tile_links(sizes, counts, chunk, members: list[np.ndarray], own: list[np.ndarray]):
    """Index pairs of the links that count in this tile."""
    a, b = _near_in_group(np.arange(len(sizes)), sizes, counts, chunk)
    if not len(a):
        return a, b
    places = [np.searchsorted(m, t) for m, t in zip(members, own, strict=True)]
    near = _sharing(a, b, sizes, own, places)
    a, b = a[near], b[near]
    if len(a):
        prefixes = [m[:int(prefix_size(len(m)))] for m in members]
        home = _at_home(prefixes, own, a, b)
        a, b = a[home], b[home]
    if len(a):
        linked = 7 * _overlaps(members, a, b) >= 3 * (sizes[a] + sizes[b])
        a, b = a[linked], b[linked]
    return a, b


def _links_by_tile(batches, every: bool):
    """Links of the tiles (leader, one, two) that follow each other in sorted rows: (id, links) for
    each linked set, with copies counted, and (id, other) for the edges of a forest; with ``every``
    (id, other) for all links instead."""
    held: list[tuple] = []

    def close() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, numbers of links (-1 in edges) and other ends (-1 in numbers)."""
        chunk, ids, sizes, copies, counts = (
            np.concatenate([h[i] for h in held]) for i in range(5))
        members, own = ([x for h in held for x in h[i]] for i in (5, 6))
        held.clear()
        a, b = _tile_links(sizes, counts, chunk, members, own)
        if every:
            low, high = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
            return low, np.full(len(a), -1), high
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        some, edges = np.flatnonzero(links), forest(len(ids), a, b)
        none = np.full(len(edges), -1)
        return (np.r_[ids[some], ids[edges[:, 0]]], np.r_[links[some], none],
                np.r_[np.full(len(some), -1), ids[edges[:, 1]]])

    def packed(found: list[tuple]) -> pa.RecordBatch:
        ids, links, others = (np.concatenate([f[i] for f in found]) for i in range(3))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(links, pa.int64(), mask=links < 0),
             pa.array(others, pa.int64(), mask=others < 0)], ["id", "links", "other"])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        columns = [batch.column(i).to_numpy() for i in (3, 4, 5, 6)]
        counts = np.stack([from_planes(c.as_py(), 4).astype(np.int32) for c in batch.column(7)])
        members = [np.frombuffer(m.as_py(), np.uint64) for m in batch.column(8)]
        own = [x.values.to_numpy().view(np.uint64) for x in batch.column(9)]
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        found = []
        for begin, end in zip(cut, np.r_[cut[1:], len(key)], strict=True):
            if held and tuple(key[begin]) != last:
                found.append(close())
            last = tuple(key[begin])
            part = slice(begin, end)
            held.append((*(c[part] for c in columns), counts[part], members[part],
                         [np.sort(x) for x in own[part]]))
        if found:
            yield packed(found)
    if held:
        yield packed([close()])


def _tiles(sets: DataFrame, group: str) -> DataFrame:
    """Sets that share a block, dealt to tiles (leader, one, two).

    A leader with more than TILE sets, or TILE_SHINGLES shingles, in its blocks has them cut into
    chunks by hash, and every pair of its chunks is a tile of its own.
    """
    holders = sets.select("id", "n", F.explode("prefix").alias("token"))
    blocks = stage(holders.groupBy("token").agg(
        F.min("id").alias("leader"), F.count(F.lit(1)).alias("uses")).where("uses > 1").select(
        "token", "leader"), f"{group}/leaders")
    met = stage(holders.join(blocks, "token").groupBy("leader", "id").agg(
        F.first("n").alias("n"), F.collect_list("token").alias("tokens")), f"{group}/held")
    chunks = met.groupBy("leader").agg(F.count(F.lit(1)).alias("sets"), F.greatest(
        F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("n") / TILE_SHINGLES)).cast("int").alias(
        "chunks")).where("sets > 1").drop("sets")
    tiled = met.join(chunks, "leader").withColumn(
        "chunk", F.pmod(F.xxhash64("id"), F.col("chunks"))).withColumn(
        "with", F.explode(F.sequence(
            F.lit(0).cast("long"), (F.col("chunks") - 1).cast("long")))).select(
        "leader", F.least("chunk", "with").alias("one"), F.greatest("chunk", "with").alias("two"),
        "chunk", "id", "tokens")
    return tiled.join(sets.select("id", "n", "copies", "counts", "members"), "id").repartition(
        "leader", "one", "two").sortWithinPartitions("leader", "one", "two", "chunk").select(
        "leader", "one", "two", "chunk", "id", "n", "copies", "counts", "members", "tokens")


def _found(sets: DataFrame, every: bool, group: str) -> DataFrame:
    """Numbers of links and forest edges, or with ``every`` all links, as (id, links, other)."""
    return stage(_tiles(sets, group).mapInArrow(
        tidy(lambda batches: _links_by_tile(batches, every)), "id long, links long, other long"),
        f"{group}/found")


def described_sets(docs: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """All rows of ``docs`` as (doc_id, fp, n, set), where rows of equal sets have equal ``set`` and
    rows without shingles none; and the sets that may have links, each once, described: id, set,
    copies (its rows), n, members, prefix and counts. All but the rows is staged under ``group``."""
    spark = docs.sparkSession
    own = docs.select("doc_id", fingerprint("text", "source").alias("fp"), "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                text_bytes(own) // PART_BYTES)
    frequent = frequent_shingles(own)
    packed = stage(_pack(own, parts, frequent), f"{group}/blocks")
    counts = packed.select("block", F.explode("packed").alias("p")).select(
        "block", "p.tokens", "p.uses", "p.slots", "p.part").repartition(parts, "part").select(
        "block", "tokens", "uses", "slots").mapInArrow(
        tidy(_count_shared), "block long, shared binary").groupBy("block").applyInArrow(
        _sum_shared, "block long, shared array<long>")
    blocks = packed.select("block", "doc_ids", "fps", "sizes", "sets").join(counts, "block", "left")
    rows = blocks.select("shared", F.posexplode(F.arrays_zip(
        "doc_ids", "fps", "sizes", "sets")).alias("slot", "d")).select(
        F.get("shared", "slot").alias("shared"), F.col("d.doc_ids").alias("doc_id"),
        F.col("d.fps").alias("fp"), F.col("d.sizes").alias("n"), F.col("d.sets").alias("set"))
    least = F.col("n") - F.floor(F.col("n") / 4)
    rows = stage(rows.withColumn(
        "open", F.coalesce("shared", F.lit(0)) >= F.greatest(F.lit(1), F.floor(least / 8))
    ).select("doc_id", "fp", "n", "set", "open"), "jaccard-rows")
    wanted = rows.where("open").groupBy("set").agg(F.min(F.struct(
        doc_key().alias("k"), F.col("fp").alias("f"))).alias("at"),
        F.count(F.lit(1)).alias("copies")).select(
        "set", "copies", F.col("at.k").alias("__id"), F.col("at.f").alias("fp"))
    texts = own.withColumn("__id", doc_key()).join(wanted, ["__id", "fp"]).select(
        "set", "text", "copies").dropDuplicates(["set"])
    sets = stage(texts.mapInArrow(
        tidy(lambda batches: _describe(batches, frequent)),
        "set string, copies long, n long, members binary, prefix array<long>, counts binary"
    ).withColumn(
        "id", F.monotonically_increasing_id()), f"{group}/sets")
    return rows.select("doc_id", "fp", "n", "set"), sets


def pairs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, fp, n_shingles, set) of every row, and all links (set_a, set_b) between
    different sets, each once: together every link of the join, copies not multiplied out."""
    group = f"jaccard-{uuid.uuid4().hex}"
    rows, sets = described_sets(docs, group)
    names = sets.select("id", "set")
    links = _found(sets, True, group).select(F.col("id").alias("a"), F.col("other").alias("b"))
    named = links.join(names.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a").join(
        names.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
    return rows.withColumnRenamed("n", "n_shingles"), named.select("set_a", "set_b")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, fp, n_shingles, component_id and n_links of every row of ``docs``.

    A set holds the distinct 5-word shingles of the text in lower case (A-Z); with fewer words the
    whole sequence is one shingle. Null, empty and blank texts have no shingles and link with
    nothing. ``component_id`` is the smallest doc_id reachable by links, ``n_links`` the number of
    other rows that a row links with; rows of equal sets are linked, repeated rows too. A null
    doc_id counts as larger than any. An empty table gives no rows. Only doc_id, text and source
    are read.
    """
    group = f"jaccard-{uuid.uuid4().hex}"
    rows, sets = described_sets(docs, group)
    found = _found(sets, False, group)
    smallest = stage(rows.where("set IS NOT NULL").groupBy("set").agg(
        F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")).join(
        sets.select("id", "set"), "set", "left"), f"{group}/copies")
    partners = found.where("links IS NOT NULL").groupBy("id").agg(F.sum("links").alias("others"))
    edges = found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b"))
    grouped = components(edges, f"{group}/labels").join(partners, "id")
    labels = stage(smallest.join(grouped, "id", "left"), f"{group}/final")
    lowest = labels.where("component IS NOT NULL").groupBy("component").agg(
        F.min("low").alias("lowest"))
    ids = stage(labels.join(lowest, "component", "left").select(
        "set", F.coalesce("lowest", "low").alias("component_id"),
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")), "jaccard-ids")
    drop_stages(docs.sparkSession, group)  # the rows and their ids are written; the rest is used up
    return rows.join(ids, "set", "left").select(
        "doc_id", "fp", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias(
            "component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each group of linked documents, with all columns: that of the
    smallest doc_id. Documents without words are alone and stay."""
    joined = join(docs)
    ones = joined.where("n_shingles = 0").select(doc_key().alias("__id"), "fp").distinct()
    firsts = joined.where("n_shingles > 0").groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "fp")).alias("at")).select(
        F.coalesce(F.concat(F.lit("="), F.col("at.doc_id").cast("string")), F.lit("")).alias(
            "__id"), F.col("at.fp").alias("fp"))
    kept = firsts.withColumn("one", F.lit(True)).unionByName(ones.withColumn("one", F.lit(False)))
    rows = docs.select(F.struct(*docs.columns).alias("row"), doc_key().alias("id"),
                       fingerprint("text", "source").alias("fp"))
    nth = F.row_number().over(Window.partitionBy("id", "fp").orderBy("fp"))
    return rows.join(kept.withColumnRenamed("__id", "id"), ["id", "fp"]).withColumn(
        "nth", nth).where("NOT one OR nth = 1").select("row.*")

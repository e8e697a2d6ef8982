"""Byte-level BPE by merge ranks: encoding with a hierarchical-bitmap rank queue, and decoding.

A pre-token is a linked list of its parts. Every adjacent pair whose joined bytes have a rank is
queued: the bucket of the rank holds the positions, a bit per non-empty bucket sits in a leaf word,
and a bit per non-empty leaf word in the summary word. Find-first-set on summary and leaf gives the
lowest rank, so a merge costs a few word operations whatever the length of the pre-token. Entries
whose pair has changed meanwhile are stale and skipped when they come up.

Short pre-tokens share one queue: their lists lie behind each other in arrays, and what a bucket
holds is merged at once in all of them.
"""

from __future__ import annotations

import base64
from array import array
from functools import cached_property, lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import ENCODED_BYTES, ENCODED_ROWS, ChunkEncoder
from .common import SLICE_ROWS, text_slices, tidy

#: Pre-tokens remembered from texts that are encoded whole.
PIECES = 50_000
#: Pre-tokens up to SHORT bytes share a queue, with at most SHARED bytes in all, where there are at
#: least SOME of them.
SHORT, SHARED, SOME = 64, 1 << 20, 5000


class PairTable:
    """Ranks by the ids of two neighbours, in an open hash table of arrays.

    Every cut of a token into two tokens, or bytes, is a pair; a byte that is no token itself has
    the id ``bytes_from`` + byte.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_from = max(ranks.values()) + 1
        self.outside = self.bytes_from + 256  # the id between two pre-tokens
        ids = {bytes([b]): self.bytes_from + b for b in range(256)} | ranks
        self.of_byte = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        cuts = [(left, right, rank) for token, rank in ranks.items()
                for at in range(1, len(token))
                if (left := ids.get(token[:at])) is not None
                and (right := ids.get(token[at:])) is not None]
        left, right, rank = np.array(cuts, np.int64).reshape(-1, 3).T
        bits = max(10, (4 * len(cuts)).bit_length())
        self.last, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        keys = self._key(left, right)
        slots = self._slot(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]
            mine = self.keys[slots] == keys
            self.values[slots[mine]] = rank[mine]
            keys, rank, slots = keys[~mine], rank[~mine], (slots[~mine] + 1) & self.last

    def _key(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ keys >> 29).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> self.shift).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the joined bytes of each pair, -1 where they have none."""
        keys = self._key(left, right)
        slots = self._slot(keys)
        there, out = self.keys[slots], self.values[slots]
        other = there != keys
        out[other] = -1
        lost = (other & (there >= 0)).nonzero()[0]
        while len(lost):
            slots[lost] = (slots[lost] + 1) & self.last
            there = self.keys[slots[lost]]
            hit = there == keys[lost]
            out[lost[hit]] = self.values[slots[lost[hit]]]
            lost = lost[~hit & (there >= 0)]
        return out


class ByteBpe:
    """Vocabulary of byte strings with merge ranks; a rank is the id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        top = max(ranks.values()) + 1
        strings: list[bytes | None] = [None] * top
        for token, rank in ranks.items():
            strings[rank] = token
        self.strings = pa.array(strings, pa.large_binary())  # by rank
        self.shift = max(6, (top.bit_length() + 1) // 2)
        self.leaves = [0] * ((top >> self.shift) + 1)  # all zero between two pre-tokens

    @cached_property
    def pairs(self) -> PairTable:
        return PairTable(self.ranks)  # workers that only decode do without

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: lowest rank first, leftmost first among equal ranks.

        A bucket is the position itself while it has one, else a heap of positions.
        """
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        shift, leaves = self.shift, self.leaves
        low = (1 << shift) - 1
        summary, buckets = 0, {}
        after = list(range(1, n + 2))  # start of the next part
        before = list(range(-1, n))
        pair = [-1] * (n + 1)  # rank of the pair that starts here
        fresh = [(rank, i) for i in range(n - 1)
                 if (rank := get(piece[i:i + 2])) is not None]
        for rank, i in fresh:
            pair[i] = rank
        while True:
            for rank, i in fresh:
                if rank in buckets:
                    bucket = buckets[rank]
                    if isinstance(bucket, int):
                        buckets[rank] = [bucket, i] if bucket < i else [i, bucket]
                    else:
                        heappush(bucket, i)
                else:
                    buckets[rank] = i
                    leaf = rank >> shift
                    leaves[leaf] |= 1 << (rank & low)
                    summary |= 1 << leaf
            if not summary:
                break
            leaf = (summary & -summary).bit_length() - 1
            word = leaves[leaf]
            rank = (leaf << shift) + (word & -word).bit_length() - 1
            bucket = buckets[rank]
            if isinstance(bucket, int):
                i, bucket = bucket, None
            else:
                i = heappop(bucket)
            if not bucket:
                del buckets[rank]
                word &= word - 1
                leaves[leaf] = word
                if not word:
                    summary &= summary - 1
            fresh = []
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            k = after[i] = after[j]
            pair[i] = pair[j] = -1
            if k < n:
                before[k] = i
                joined = get(piece[i:after[k]])
                if joined is not None:
                    pair[i] = joined
                    fresh.append((joined, i))
            h = before[i]
            if h >= 0:
                joined = get(piece[h:k])
                if joined is None:
                    pair[h] = -1
                elif pair[h] != joined:
                    pair[h] = joined
                    fresh.append((joined, h))
        out, i = [], 0
        while i < n:
            j = after[i]
            out.append(self.ranks[piece[i:j]])
            i = j
        return out

    def encode_shared(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens as bytes of 32-bit integers, by one queue for all of them.

        An entry is a rank and a place in the arrays; the bucket of a rank holds arrays of places.
        Within a pre-token the order is that of ``encode_piece`` as long as a merge makes no pair
        of lower rank than its own; pre-tokens where one does are given to ``encode_piece``.
        """
        find, shift, leaves = self.pairs.find, self.shift, self.leaves
        low = (1 << shift) - 1
        summary, buckets = 0, {}
        raw = np.frombuffer(b"\0" + b"\0".join(pieces) + b"\0", np.uint8)
        ends = np.cumsum([0, *(len(piece) + 1 for piece in pieces)])  # places between pre-tokens
        part = self.pairs.of_byte[raw]
        part[ends] = self.pairs.outside
        alive = np.ones(len(raw), bool)
        alive[ends] = False
        after = np.arange(1, len(raw) + 1, dtype=np.int32)
        before = np.arange(-1, len(raw) - 1, dtype=np.int32)
        pair = np.append(find(part[:-1], part[1:]), np.int32(-1))
        places = np.flatnonzero(pair >= 0).astype(np.int32)
        ranks = pair[places]
        odd = []  # places in pre-tokens to be encoded alone
        while True:
            if len(ranks):
                order = np.argsort(ranks, kind="stable")
                ranks, places = ranks[order], places[order]
                cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
                starts = [0, *cuts.tolist(), len(ranks)]
                for rank, a, b in zip(ranks[starts[:-1]].tolist(), starts, starts[1:]):
                    bucket = buckets.get(rank)
                    if bucket is None:
                        buckets[rank] = [places[a:b]]
                        leaf = rank >> shift
                        leaves[leaf] |= 1 << (rank & low)
                        summary |= 1 << leaf
                    else:
                        bucket.append(places[a:b])
            if not summary:
                break
            leaf = (summary & -summary).bit_length() - 1
            word = leaves[leaf]
            rank = (leaf << shift) + (word & -word).bit_length() - 1
            word &= word - 1
            leaves[leaf] = word
            if not word:
                summary &= summary - 1
            bucket = buckets.pop(rank)
            at = bucket[0] if len(bucket) == 1 else np.concatenate(bucket)
            at = at[pair[at] == rank]  # others are stale
            if not len(at):
                ranks = at
                continue
            if len(at) > 1:
                at.sort()
                if (twice := at[1:] == at[:-1]).any():
                    at = at[np.append(True, ~twice)]
            second = after[at]
            touching = second[:-1] == at[1:]
            if touching.any():  # from the left, every other one of a run of touching pairs
                head = np.append(True, ~touching)
                since = np.arange(len(at)) - np.flatnonzero(head)[np.cumsum(head) - 1]
                at = at[since % 2 == 0]
                second = after[at]
            behind = after[second]
            old = part[behind]
            after[at] = behind
            before[behind] = at
            alive[second] = False
            pair[second] = -1
            part[at] = rank
            new = part[behind]
            places = np.concatenate((at, before[at]))
            ranks = find(part[places], np.concatenate((new, part[at])))
            pair[places] = ranks
            good = ranks >= 0
            ranks, places = ranks[good], places[good]
            if (lower := ranks < rank).any():
                odd += places[lower].tolist()
            if (moved := new != old).any():  # the pair before the next one was merged too
                passing = find(part[at[moved]], old[moved])
                odd += at[moved][(passing >= 0) & (passing < rank)].tolist()
        ids = part[alive]
        edges = np.append(0, np.cumsum(alive))[ends] * 4
        flat, edges = ids.tobytes(), edges.tolist()
        out = [flat[a:b] for a, b in zip(edges, edges[1:])]
        if len(ids) and ids.max() >= self.pairs.bytes_from:
            raise KeyError("a byte without a rank")
        for i in set((np.searchsorted(ends, odd, side="right") - 1).tolist()):
            out[i] = array("i", self.encode_piece(pieces[i])).tobytes()
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens as bytes of 32-bit integers."""
        get = self.ranks.get
        out: list[bytes | None] = []
        hard: list[int] = []
        for at, piece in enumerate(pieces):
            whole = get(piece)
            out.append(None if whole is None else whole.to_bytes(4, "little"))
            if whole is None:
                hard.append(at)
        short = [at for at in hard if len(pieces[at]) <= SHORT]
        if len(short) >= SOME:
            turn = np.cumsum([len(pieces[at]) + 1 for at in short]) // SHARED
            for some in np.split(short, np.flatnonzero(np.diff(turn)) + 1):
                some = some.tolist()
                made = self.encode_shared([pieces[at] for at in some])
                for at, ids in zip(some, made, strict=True):
                    out[at] = ids
        for at in hard:
            if out[at] is None:
                out[at] = array("i", self.encode_piece(pieces[at])).tobytes()
        return out

    def encode_text(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pattern.findall(text):
            out += self.encode_piece(piece.encode("utf-8", "surrogatepass"))
        return out

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of every list of ids; null for a null."""
        edges = ids.offsets.to_numpy().astype(np.int64)
        tokens = self.strings.take(ids.values.slice(edges[0], edges[-1] - edges[0]))
        if tokens.null_count:
            raise KeyError("an id without a token")
        places = np.frombuffer(tokens.buffers()[1], np.int64)[edges - edges[0]] if len(
            tokens) else np.zeros(len(edges), np.int64)
        texts = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(ids), [None, pa.py_buffer(places), tokens.buffers()[2]])
        if ids.null_count:
            texts = pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.large_binary()))
        return texts.cast(pa.binary())


@lru_cache(maxsize=2)
def load_ranks(path: str, pattern: str) -> ByteBpe:
    """Read a rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return ByteBpe({base64.b64decode(a): int(b) for a, b in pairs}, pattern)


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> ChunkEncoder:
    bpe = load_ranks(path, pattern)
    recent: dict[str, bytes] = {}

    def many(chunks: list[str]) -> list[bytes]:
        if len(recent) > PIECES:
            recent.clear()
        found = [bpe.pattern.findall(chunk) for chunk in chunks]
        new = list({piece for pieces in found for piece in pieces if piece not in recent})
        known = dict(zip(new, bpe.encode_pieces(
            [piece.encode("utf-8", "surrogatepass") for piece in new]), strict=True))
        out = []
        for pieces in found:
            ids = []
            for piece in pieces:
                held = known.get(piece)
                ids.append(recent[piece] if held is None else held)
            out.append(b"".join(ids))
        recent.update((piece, ids) for piece, ids in known.items() if len(piece) < SHORT)
        return out

    return ChunkEncoder(many, many)


def _encoded(batches, path: str, pattern: str):
    """doc_id and ids of batches of (doc_id, text)."""
    encoder = _encoder(path, pattern)
    for batch in batches:
        for part in text_slices(batch, 1, ENCODED_ROWS, ENCODED_BYTES):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), encoder.encode_all(part.column(1))], ["doc_id", "ids"])
    encoder.forget()


def _decoded(batches, path: str, pattern: str):
    """doc_id, ids and decoded of batches of (doc_id, ids)."""
    bpe = load_ranks(path, pattern)
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), bpe.decode(part.column(1))],
                ["doc_id", "ids", "decoded"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of every whole text (``ids``, without special tokens).

    Only doc_id and text are read. Null and empty texts have no ids; repeated rows are encoded each
    for itself; an empty table gives no rows. Nothing is shuffled; chunks seen before in a Python
    worker are looked up in a memory of bounded size.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        tidy(lambda batches: _encoded(batches, path, pattern)), f"doc_id {kind}, ids array<int>")


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """The bytes of every row's ``ids``, as ``decoded``; null ids give null bytes."""
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(
        tidy(lambda batches: _decoded(batches, path, pattern)),
        f"doc_id {kind}, ids array<int>, decoded binary")


def encode_and_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``decode`` of ``encode`` in one Python worker: two passes in a row would hold two workers a
    core, each with its own tables, for as long as the executor lives."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        tidy(lambda batches: _decoded(_encoded(batches, path, pattern), path, pattern)),
        f"doc_id {kind}, ids array<int>, decoded binary")


def ids_digest(ids: str) -> Column:
    """SHA-256 in lower-case hex of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode, decode, and digest both: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode_and_decode(docs, path, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest("ids").alias(
            "ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

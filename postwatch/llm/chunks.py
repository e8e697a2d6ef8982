"""Cuts texts into chunks that byte-level BPE vocabularies encode independently, and keeps the ids
of chunks that come again.

The split pattern of these vocabularies (contractions, ` ?letters`, ` ?numbers`, ` ?others`, white
space) always ends a match before a single space that a visible character follows, and around a
line feed between visible characters. A match that holds a letter ends before the next mark. Such
places cut a text without changing its ids; so a word is one chunk whatever mark follows it. Texts
with other white space are encoded whole.

Chunks are cut, told apart and replaced by their ids on Arrow arrays, a slice of texts at a time;
Python sees each different chunk of a slice once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Estimated bytes of the chunks remembered since the last change of generations; the generation
#: before is kept too, so that frequent chunks outlive a change.
CACHE_BYTES = 40_000_000
_ENTRY_BYTES = 190
#: Rows, and bytes of text, that are encoded at a time.
ENCODED_ROWS, ENCODED_BYTES = 4096, 4 << 20
_SPACE, _FEED = 0x20, 0x0A
_BYTES = [chr(b) for b in range(128)] + [""] * 128
_LETTER = np.array([b.isalpha() for b in _BYTES])
_MARK = np.array([b > " " and b != "\x7f" and not b.isalnum() for b in _BYTES])
#: UTF-8 of U+00C0 to U+00FF begins with this byte; all are letters but those that end as below.
_LATIN, _NO_LETTERS = 0xC3, (0x97, 0xB7)


def separable(chunk: str) -> bool:
    """Whether the ends of ``chunk`` are safe cuts."""
    if chunk == "\n":
        return True
    body = chunk[1:] if chunk[:1] == " " else chunk
    return bool(body) and not body[0].isspace() and not body[-1].isspace()


class _Cuts:
    """The chunks of a slice of texts: each begins at a space, at or behind a line feed, at a mark
    behind a letter (of ASCII or Latin-1), or where its text begins."""

    def __init__(self, texts: pa.Array, unsplit: tuple[str, ...]):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n, (_, places, data) = len(texts), texts.buffers()
        places = np.frombuffer(places, np.int64)[texts.offset:texts.offset + n + 1]
        raw = np.frombuffer(data or b"", np.uint8)[places[0]:places[-1]]
        edges = places - places[0]
        first = np.zeros(len(raw) + 1, bool)
        first[edges[:-1]] = True
        feed = raw == _FEED
        begins = first[:-1] | feed | (raw == _SPACE)
        mark, before = _MARK[raw], raw[:-1]
        begins[1:] |= feed[:-1] | (_LETTER[before] & mark[1:])
        begins[2:] |= (raw[:-2] == _LATIN) & ~np.isin(before[1:], _NO_LETTERS) & mark[2:]
        at = np.flatnonzero(begins)
        # a line feed before more white space of its text is no safe cut
        tight = np.flatnonzero(feed[:-1] & ((raw[1:] == _SPACE) | feed[1:]) & ~first[1:-1])
        self.texts = texts
        self.whole = np.zeros(n, bool)  # texts to be encoded whole
        self.whole[np.searchsorted(edges, tight, side="right") - 1] = True
        for held in unsplit:
            self.whole |= pc.match_substring(texts, held).to_numpy(zero_copy_only=False)
        counts = np.diff(np.searchsorted(at, edges))
        chunks = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(
            np.append(at, len(raw)) + places[0]), data) if len(at) else texts[:0]
        if self.whole.any():
            chunks = chunks.filter(pa.array(np.repeat(~self.whole, counts)))
            counts[self.whole] = 0
        #: Chunks before each text, and behind the last.
        self.edges = np.append(0, np.cumsum(counts))
        self.coded = chunks.dictionary_encode()


class ChunkEncoder:
    """Ids of whole texts as 32-bit integers.

    ``encode_whole(texts)`` gives the ids of any texts, ``encode_many(chunks)`` those of separable
    chunks, both as bytes of 32-bit integers; they must agree with the vocabulary's own tokenizer.
    A text that holds one of the strings ``unsplit`` is encoded whole.
    """

    def __init__(
        self, encode_whole: Callable[[list[str]], list[bytes]],
        encode_many: Callable[[list[str]], list[bytes]], cache_bytes: int = CACHE_BYTES,
        unsplit: tuple[str, ...] = (),
    ):
        self.unsplit = unsplit
        self.encode_whole, self.encode_many, self.limit = encode_whole, encode_many, cache_bytes
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        """The ids of ``chunks``, all different; none for one that is not separable."""
        if self.held > self.limit:
            self.known, self.older, self.held = {}, self.known, 0
        known, older, size = self.known, self.older, 0
        found = list(map(known.get, chunks))
        new, places = [], []
        for at, ids in enumerate(found):
            if ids is None:
                chunk = chunks[at]
                ids = older.get(chunk)
                if ids is None:
                    body = chunk[1:] if chunk[0] == " " else chunk
                    if body.isalpha() or separable(chunk):
                        new.append(chunk)
                        places.append(at)
                        continue
                    ids = b""
                known[chunk] = found[at] = ids
                size += len(chunk) + len(ids) + _ENTRY_BYTES
        for at, chunk, ids in zip(places, new, self.encode_many(new), strict=True):
            known[chunk] = found[at] = ids
            size += len(chunk) + len(ids) + _ENTRY_BYTES
        self.held += size
        return found

    def forget(self) -> None:
        """Give the memory back: Python workers live on between tasks."""
        self.known, self.older, self.held = {}, {}, 0

    def encode_all(self, texts: pa.Array, end_id: int | None = None) -> pa.ListArray:
        """The ids of every text, with ``end_id`` behind each if given; a null text is empty."""
        cuts = _Cuts(texts, self.unsplit)
        found = pa.array(self._look_up(
            cuts.coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        packed = found.take(cuts.coded.indices)
        loose = np.flatnonzero(pc.binary_length(packed).to_numpy() == 0)
        cuts.whole[np.searchsorted(cuts.edges, loose, side="right") - 1] = True
        _, places, data = packed.buffers()
        places = np.frombuffer(places, np.int64)[:len(packed) + 1] if len(packed) else np.zeros(
            1, np.int64)
        ids = np.frombuffer(data or b"", np.int32, count=places[-1] // 4)
        edges = places[cuts.edges] // 4
        if cuts.whole.any():
            rows = np.flatnonzero(cuts.whole)
            made = self.encode_whole(cuts.texts.take(pa.array(rows)).to_pylist())
            parts, sizes, last = [], np.diff(edges), 0
            for row, whole in zip(rows.tolist(), made, strict=True):
                parts += [ids[edges[last]:edges[row]], np.frombuffer(whole, np.int32)]
                sizes[row], last = len(whole) // 4, row + 1
            ids = np.concatenate([*parts, ids[edges[last]:]])
            edges = np.append(0, np.cumsum(sizes))
        if end_id is not None:
            ids = np.insert(ids, edges[1:], end_id)
            edges = edges + np.arange(len(edges))
        return pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids))

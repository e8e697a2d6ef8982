"""Words of whole columns of text on Arrow's bytes: no Python object for a word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose words are held at a time (one text at least).
WORDS_BYTES = 1 << 20
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SIZES = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The words (common.WORD_PATTERN) of all texts of an Arrow array; a null has none.

    ``raw`` are the bytes of all texts in a row and ``edges`` where each begins and ends there,
    ``starts`` and ``ends`` those of each word, ``counts`` the words of each text. With ``lower``
    A-Z are in lower case.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        n, (_, places, data) = len(texts), texts.buffers()
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        places = np.frombuffer(places or bytes(8), kind)[texts.offset:texts.offset + n + 1].astype(
            np.int64)
        raw = np.frombuffer(data or b"", np.uint8)[places[0]:places[-1]]
        if lower:
            raw = raw + ((raw - np.uint8(65)) < 26).astype(np.uint8) * np.uint8(32)
        self.raw, self.edges = raw, places - places[0]
        self.inside = (raw != 32) & ((raw - np.uint8(9)) > 4)
        first = self.edges[:-1][self.edges[:-1] < len(raw)]
        start, end = self.inside.copy(), np.zeros(len(raw) + 1, bool)
        start[1:] &= ~self.inside[:-1]
        start[first] = self.inside[first]
        end[1:] = self.inside
        end[:-1] &= ~self.inside
        last = self.edges[1:][self.edges[1:] > 0]
        end[last] = self.inside[last - 1]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end)
        self.counts = np.diff(np.searchsorted(self.starts, self.edges))

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the words, eight bytes at a time."""
        padded = np.concatenate([self.raw, np.zeros(8, np.uint8)])
        wide = np.ndarray(len(self.raw) + 1, "<u8", padded, strides=(1,))
        size = self.ends - self.starts
        out = size.astype(np.uint64) * _SIZES
        live, at, left = slice(None), self.starts, size
        while len(at):
            spare = (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
            x = out[live] ^ ((wide[at] << spare) >> spare)
            x = (x ^ (x >> np.uint64(30))) * _C1
            x = (x ^ (x >> np.uint64(27))) * _C2
            out[live] = x ^ (x >> np.uint64(31))
            more = left > 8
            live = np.flatnonzero(more) if isinstance(live, slice) else live[more]
            at, left = at[more] + 8, left[more] - 8
        return out

    def joined(self, gone: np.ndarray, whole: np.ndarray) -> pa.Array:
        """Each text's words but those ``gone``, joined by single spaces; texts that are ``whole``
        stay as they are."""
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        cut = ~whole[owner]
        keep = self.inside.copy()
        if gone.any():
            turn = np.zeros(len(self.raw) + 1, np.int8)
            turn[self.starts[gone]] += 1
            turn[self.ends[gone]] -= 1  # words that touch belong to two texts
            keep &= np.cumsum(turn[:-1], dtype=np.int8) == 0
        left = np.flatnonzero(~gone)
        before = left[:-1][owner[left[1:]] == owner[left[:-1]]]  # another word of the text follows
        gaps = self.ends[before[cut[before]]]
        keep[gaps] = True
        raw = self.raw.copy()
        raw[gaps] = 32
        if whole.any():
            keep |= np.repeat(whole, np.diff(self.edges))
        places = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])[self.edges]
        return pa.Array.from_buffers(pa.binary(), len(self.counts), [
            None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(raw[keep])])

"""Words on Arrow's bytes, and the memory of passes over them."""

import tracemalloc
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from postwatch.llm import byte_bpe, common, jaccard
from postwatch.llm.words import Words

TEXTS = ["", None, "one", " two\tthree \n", "x" * 7 + " " + "x" * 8 + " " + "x" * 9, None, "é漢   ß",
         "a\x0b\x0c\r b", "ONE One one", "y" * 40 + " " + "y" * 41, " \t", "end", "begin"]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("part", [slice(0, None), slice(1, 6), slice(3, 5), slice(0, 2), slice(0, 0)])
def test_words_equal_the_plain_split(kind, part):
    texts, own = pa.array(TEXTS, kind), TEXTS[part]
    texts = texts.slice(*part.indices(len(TEXTS))[:1], len(own))
    for lower, plain in ((False, brute.words), (True, brute.lowered)):
        words, expected = Words(texts, lower), [plain(t) for t in own]
        found = [words.raw[a:b].tobytes().decode()
                 for a, b in zip(words.starts, words.ends, strict=True)]
        assert found == [w for ws in expected for w in ws]
        assert words.counts.tolist() == [len(ws) for ws in expected]
        assert len(set(zip(found, words.hashes().tolist()))) == len(set(found))
        assert len(set(words.hashes().tolist())) == len(set(found))


def test_hashes_tell_lengths_and_places_apart():
    some = ["a" * n for n in range(1, 40)] + ["a\0" + "\0" * n for n in range(20)] + [
        "abcdefgh" + "ijklmnop" * n for n in range(5)] + ["ijklmnopabcdefgh"]
    once = Words(pa.array([" ".join(some)])).hashes()
    assert len(set(once.tolist())) == len(set(some))
    apart = Words(pa.array([*some, " ".join(some)])).hashes()
    assert apart.tolist() == [*once.tolist(), *once.tolist()]


@pytest.mark.parametrize("join", [False, True])
def test_kept_words_are_joined(join):
    words = Words(pa.array(TEXTS))
    gone = np.arange(len(words.starts)) % 3 == 1
    gone[:2] = False
    ends = np.cumsum(words.counts)
    lost = np.array([gone[e - n:e].any() for e, n in zip(ends, words.counts, strict=True)])
    found = words.joined(gone, ~lost & (not join)).to_pylist()
    for text, cut, end, n, raw in zip(TEXTS, lost, ends, words.counts, found, strict=True):
        own = [w for w, g in zip(brute.words(text), gone[end - n:end], strict=True) if not g]
        assert raw.decode() == (" ".join(own) if cut or join else text or "")


def test_blocks_stay_packed_while_shared_shingles_are_counted():
    draw, rows, uses_of, held = np.random.default_rng(3), [], Counter(), []
    for block in range(40):
        own = np.unique(draw.integers(0, 1 << 24, 20_000).astype(np.uint64))
        uses = draw.choice([1, 1, 1, 1, 1, 2], len(own)).astype(np.uint16)
        slots = np.concatenate([draw.choice(8, n, False) for n in uses]).astype(np.uint16)
        rows.append((block, jaccard.planes(np.diff(own, prepend=np.uint64(0)), 6),
                     uses.tobytes(), slots.tobytes()))
        uses_of.update(dict(zip(own.tolist(), uses.tolist(), strict=True)))
        held.append((np.repeat(own, uses).tolist(), slots.tolist()))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 3), strict=True)],
        ["block", "tokens", "uses", "slots"])
    n = sum(len(r[1]) // 6 for r in rows)
    tracemalloc.start()
    found = list(jaccard._count_shared(iter([batch.slice(0, 25), batch.slice(0, 0), batch.slice(25)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * 8 * n  # before: about eight numbers of 64 bits for a shingle
    assert [f.column(0)[0].as_py() for f in found] == list(range(40))
    for f, (tokens, slots) in zip(found, held, strict=True):
        expected = np.bincount([s for t, s in zip(tokens, slots, strict=True) if uses_of[t] > 1])
        assert np.frombuffer(f.column(1)[0].as_py(), "<i4").tolist() == expected.tolist()


def test_encoder_and_decoder_share_a_worker(docs):
    made = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                               public_tokenizers.PATTERN)
    assert made._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_memory_goes_back_after_a_task(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release_memory", lambda: calls.append("released"))
    steps = common.tidy(lambda batches: (calls.append(b) or b for b in batches))
    assert list(steps(iter([1, 2]))) == [1, 2]
    assert calls == ["released", 1, 2, "released"]

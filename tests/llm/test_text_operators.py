"""Operators on documents against plain versions, over a table with all the awkward cases."""

import random
import zlib
from array import array
from collections import Counter
from math import log10

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from postwatch.llm import (
    byte_bpe, chunks, class_lm, curriculum, jaccard, lang_ecoc, line_quality, substrings,
    token_store,
)

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_quality_rules(docs, rows, nothing):
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
               "base_failed", "kept", "removed_words")
    expected = brute.quality(rows)
    assert table(line_quality.judge(docs), *columns) == Counter(
        tuple(r[c] for c in columns) for r in expected)
    assert any(r["removed_words"] for r in expected)
    assert line_quality.judge(nothing).count() == 0


def test_cleaned_documents(docs, rows, nothing):
    cleaned = line_quality.clean(docs)
    assert cleaned.columns == docs.columns
    assert table(cleaned, "doc_id", "text", "n_chars") == Counter(
        (r["doc_id"], r["cleaned"], len(r["cleaned"])) for r in brute.quality(rows) if r["kept"])
    assert line_quality.clean(nothing).count() == 0


def test_jaccard_components(docs, rows, nothing):
    expected = Counter((r["doc_id"], *found) for r, found in zip(rows, brute.components(rows))
                       if r["text"] and r["text"].strip())
    got = table(jaccard.join(docs).where("n_shingles > 0"), "doc_id", "n_shingles", "component_id")
    assert got == expected
    alone = jaccard.join(docs).where("n_shingles = 0").collect()
    assert alone and all(r.component_id == r.doc_id for r in alone)
    assert jaccard.join(nothing).count() == 0


def test_one_of_each_group_stays(docs, rows, nothing):
    found = brute.components(rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert table(kept.where("trim(text) <> ''"), "doc_id").keys() >= {(4,), (10,)}
    assert table(kept, "doc_id") == Counter(
        (r["doc_id"],) for r, (n, _) in zip(rows, found) if not n) + Counter(
        {(c,): 1 for n, c in found if n})
    assert jaccard.keep_one(nothing).count() == 0


def test_jaccard_at_the_limit(spark):
    """12 of 16 shingles is exactly 75 %, 11 of 16 is below; small sets and many partners."""
    base = [f"w{i}" for i in range(16)]  # 12 shingles
    texts = [" ".join(base), " ".join(base + list("wxyz")), " ".join(base[1:] + list("vwxyz")),
             *(" ".join(base[:i] + ["z"] + base[i:]) for i in range(1, 16))]
    rows = [dict(doc_id=i, text=t, source="a") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(r["doc_id"], r["text"], "a") for r in rows],
                                 "doc_id long, text string, source string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs).collect()} == (
        dict(enumerate(brute.components(rows))))


def test_jaccard_gives_every_link(spark, docs, rows, tmp_path):
    base = [f"w{i}" for i in range(60)]
    many = [" ".join(base[:i] + ["z"] + base[i + 1:]) for i in range(0, 60, 2)]
    texts = [r["text"] for r in rows] + many + many[:3]
    near = docs.select("doc_id", "text", "source").unionByName(spark.createDataFrame(
        [(1000 + i, t, "a") for i, t in enumerate(many + many[:3])],
        "doc_id long, text string, source string"))
    near.write.parquet(str(tmp_path / "near"))
    near = spark.read.parquet(str(tmp_path / "near"))
    sets = [brute.shingles(t) for t in texts]
    links = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets)
             if i != j and 100 * len(a & b) >= 75 * len(a | b) > 0]
    count = Counter(i for i, _ in links)
    ids = [r["doc_id"] for r in rows] + [1000 + i for i in range(33)]
    assert table(jaccard.join(near), "doc_id", "n_links") == Counter(
        (ids[i], count[i]) for i in range(len(ids)))
    members, pairs = jaccard.pairs(near)
    by_id = {r.doc_id: r.set for r in members.collect()}
    got = Counter(frozenset((r.set_a, r.set_b)) for r in pairs.collect())
    assert got == Counter({frozenset((by_id[ids[i]], by_id[ids[j]])) for i, j in links
                           if sets[i] != sets[j] and None not in (ids[i], ids[j])})
    assert len(got) > 100


def test_tree_join_equals_all_pairs():
    draw = np.random.default_rng(3)
    near = draw.integers(0, 9, (6, 32))
    counts = np.concatenate([near[draw.integers(0, 6, 150)] + draw.integers(0, 2, (150, 32)),
                             draw.integers(0, 40, (80, 32))]).astype(np.int64)
    sizes, owner = counts.sum(axis=1), draw.integers(0, 60, 230)
    a, b = jaccard._near_in_group(owner, sizes, counts, np.zeros(230, np.int64))
    bound = np.minimum(counts[:, None], counts[None]).sum(axis=2)
    want = {(i, j) for i in range(230) for j in range(i) if owner[i] != owner[j]
            and 7 * bound[i, j] >= 3 * (sizes[i] + sizes[j])}
    assert {(max(x), min(x)) for x in zip(a.tolist(), b.tolist())} == want and want


@pytest.mark.parametrize("many", [False, True])
def test_overlaps_and_homes_of_pairs(many):
    """By pairs or by matrix, for few and for many pairs of near and of unlike lists."""
    draw = np.random.default_rng(12)
    base = np.sort(draw.choice(10_000, 60, replace=False)).astype(np.uint64)
    lists = [np.unique(np.concatenate([draw.choice(base, 50, replace=False), draw.choice(
        20_000, 5).astype(np.uint64)])) for _ in range(60 if many else 7)]
    lists += [np.sort(draw.choice(10_000, 40, replace=False)).astype(np.uint64) for _ in range(5)]
    a, b = np.triu_indices(len(lists), 1)
    if not many:
        a, b = a[::5], b[::5]
    common = [np.intersect1d(lists[i], lists[j]) for i, j in zip(a, b)]
    assert jaccard._overlaps(lists, a, b).tolist() == [len(c) for c in common]
    tile = set(draw.choice(base, 25, replace=False).tolist())
    own = [np.array([x for x in one if x in tile], np.uint64) for one in lists]
    assert jaccard._at_home(lists, own, a, b).tolist() == [
        len(c) > 0 and int(c[0]) in tile for c in common]


def test_jaccard_in_many_tiles(spark, monkeypatch):
    """A group of near copies that is cut into many tiles keeps every link, each counted once."""
    for name, value in (("TILE", 7), ("TILE_SHINGLES", 500), ("PLAIN", 4)):
        monkeypatch.setattr(jaccard, name, value)
    draw = np.random.default_rng(4)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for i in range(60):
        own = list(base)
        for at in draw.choice(90, int(draw.integers(0, 4)), replace=False):
            own[at] = f"x{i}_{at}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)],
                                 "doc_id long, text string, source string")
    sets = [brute.shingles(t) for t in texts]
    links = Counter(i for i, a in enumerate(sets) for j, b in enumerate(sets)
                    if i != j and 100 * len(a & b) >= 75 * len(a | b))
    rows = [dict(doc_id=i, text=t, source="a") for i, t in enumerate(texts)]
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links)
            for r in jaccard.join(docs).collect()} == {
        i: (n, c, links[i]) for i, (n, c) in enumerate(brute.components(rows))}


def test_repeated_spans(docs, rows, nothing):
    expected = Counter((r["doc_id"], *found[:2], found[2].encode()) for r, found in zip(
        rows, brute.cut_repeats(rows)))
    got = Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept_text))
                  for r in substrings.remove_repeats(docs).collect())
    assert got == expected
    assert substrings.remove_repeats(nothing).count() == 0
    cut = substrings.deduplicate(docs)
    assert cut.columns == docs.columns
    assert {t for _, t in table(cut, "doc_id", "text")} == {
        found[2] if found[1] else r["text"] for r, found in zip(rows, brute.cut_repeats(rows))
        if not found[1] or found[2]}


@pytest.mark.parametrize("window,anchor", [(4, 1), (6, 6), (5, 3)])
def test_repeated_spans_of_short_windows(spark, window, anchor):
    draw = np.random.default_rng(window)
    rows = [dict(doc_id=i, text=" ".join(draw.choice(list("abc"), draw.integers(0, 30))),
                 source=None) for i in range(30)]
    docs = spark.createDataFrame([(r["doc_id"], r["text"], None) for r in rows],
                                 "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text.decode())
           for r in substrings.remove_repeats(docs, window, anchor).collect()}
    assert got == dict(enumerate(brute.cut_repeats(rows, window)))


def test_mix(docs, rows, nothing):
    expected = brute.mix(rows)
    mixed = curriculum.mix(docs)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.size, r.source_size, r.taken)
                 for r in mixed.collect())
    assert [g[:4] for g in got] == sorted(
        (r["doc_id"] is None, r["doc_id"] or 0, *e[:2]) for r, e in zip(rows, expected))
    assert sum(g[4] for g in got) == sum(e[3] for e in expected)
    by_source = mixed.groupBy("source_size", "target").sum("taken").collect()
    longest = max(e[0] for e in expected)
    assert all(2 * abs(r["sum(taken)"] - r.target) <= longest + 2 for r in by_source)
    assert all(g[4] <= 3 * g[2] and (g[2] == 0 or g[4] % g[2] == 0) for g in got)
    again = sorted((r.doc_id is None, r.doc_id or 0, r.size, r.source_size, r.taken)
                   for r in curriculum.mix(docs.repartition(5)).collect())
    assert got == again
    assert curriculum.mix(nothing).count() == 0


def test_sources_without_words(spark):
    """A source of null, empty and blank texts takes nothing; so do tables of nothing else."""
    schema = "doc_id long, text string, source string, __id string, __copy string, row string"
    empty = [(1, None, "z", "mine", "c", "r"), (2, "", "z", "mine", "c", "r"),
             (3, " \n", None, "mine", "c", "r")]
    full = [(i, "word " * i, "a", "mine", "c", "r") for i in range(4, 9)]
    for rows in (empty, empty + full, full + [(9, "", "b", "mine", "c", "r")]):
        df = spark.createDataFrame(rows, schema)
        expected = brute.mix([dict(doc_id=r[0], text=r[1], source=r[2]) for r in rows])
        got = {r.doc_id: (r.size, r.source_size, r.target, r.taken)
               for r in curriculum.mix(df).collect()}
        assert got == {r[0]: e for r, e in zip(rows, expected)}
        ordered = curriculum.in_training_order(curriculum.mix(df))
        assert ordered.count() == len(rows)
        stream = curriculum.training_stream(df).collect()
        assert all((r["__id"], r["__copy"], r["row"]) == ("mine", "c", "r") for r in stream)
        texts = {r[0]: r[1] for r in rows}
        assert all(r.text == texts[r.doc_id] for r in stream)
        assert sum(len(brute.words(r.text)) for r in stream) == sum(e[3] for e in expected)


def test_joined_input_makes_few_partitions(spark, docs):
    """Sizes come from the texts, not from the optimizer, which knows nothing of joined tables."""
    joined = docs.join(docs.select("doc_id").distinct(), "doc_id")
    assert jaccard.join(joined).rdd.getNumPartitions() < 1000
    assert substrings.remove_repeats(joined).count() == joined.count()


def test_slices_are_bounded_by_bytes():
    import pyarrow as pa
    from postwatch.llm import common
    texts = ["x" * 10] * 600 + ["y" * (3 << 20)] * 3 + [None] * 5 + ["z" * (1 << 20)] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])
    parts = list(common.text_slices(batch, 1))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(len(texts)))
    sizes = [sum(len(t or "") for t in p.column(1).to_pylist()) for p in parts]
    assert all(s <= common.SLICE_BYTES or p.num_rows == 1 for s, p in zip(sizes, parts))
    assert max(p.num_rows for p in parts) <= common.SLICE_ROWS


def test_training_order(docs, rows):
    stream = curriculum.training_stream(docs)
    assert stream.columns == docs.columns
    taken = sum(len(brute.words(r.text)) for r in stream.collect())
    assert taken == sum(e[3] for e in brute.mix(rows))
    positions = [r.position for r in curriculum.in_training_order(curriculum.mix(docs)).collect()]
    shown = [p for p in positions if p is not None]
    assert shown == sorted(shown) and positions[:len(positions) - len(shown)].count(None) == (
        len(positions) - len(shown))


@pytest.mark.parametrize("schedule", [*curriculum.SCHEDULES, ((0, 1), (0.3, 0), (0.6, 0), (1, 2))])
def test_due_time_inverts_the_integral(spark, schedule):
    times = np.linspace(0, 1, 101)
    fine = np.linspace(0, 1, 100_001)
    t, w = zip(*schedule)
    level = np.interp(fine, t, w)
    area = np.r_[0, np.cumsum((level[1:] + level[:-1]) / 2 * np.diff(fine))]
    shares = np.interp(times, fine, area / area[-1])
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(float(u),) for u in shares], "u double")
    found = [r[0] for r in df.select(curriculum.due_time(F.col("u"), schedule)).collect()]
    assert np.interp(found, fine, area / area[-1]) == pytest.approx(shares, abs=1e-4)
    assert area[-1] == pytest.approx(curriculum.integral(schedule), abs=1e-4)


def test_byte_bpe_equals_the_library(docs, rows, nothing):
    bpe = byte_bpe.load_ranks(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN,
                                mergeable_ranks=bpe.ranks, special_tokens={})
    ids = [library.encode_ordinary(r["text"] or "") for r in rows]
    got = table(byte_bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN), "doc_id", "n_tokens",
                "ids_sha256", "decoded_sha256")
    assert got == Counter((r["doc_id"], len(i), brute.sha256(",".join(map(str, i))),
                           brute.sha256(r["text"] or "")) for r, i in zip(rows, ids))
    assert byte_bpe.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    for text in ("ab" * 30_000, "aaaaaaab" * 2000, "漢" * 5000, " \n\n x\t\t y  z'll 's \0 b"):
        assert bpe.encode_text(text) == library.encode_ordinary(text)


def test_shared_queue_equals_the_queue_of_each():
    """A finding on CPU time: short pre-tokens go through one queue on arrays, in the same order."""
    draw = random.Random(5)
    bpe = byte_bpe.load_ranks(RANKS, public_tokenizers.PATTERN)
    pieces = [bytes(draw.choice(some) for _ in range(draw.randrange(1, 60)))
              for some in (b"ab", b"a", "漢".encode(), bytes(range(256)), b"thein \xc3\xa9", b"-=")
              for _ in range(1200)]
    pieces = [p for p in pieces if p not in bpe.ranks]
    assert len(pieces) > byte_bpe.SOME
    expected = [array("i", bpe.encode_piece(p)).tobytes() for p in pieces]
    assert bpe.encode_shared(pieces) == expected
    alone = []
    bpe = byte_bpe.ByteBpe(bpe.ranks, public_tokenizers.PATTERN)
    bpe.encode_piece = alone.append
    assert bpe.encode_pieces(pieces) == expected and not alone
    for _ in range(20):  # merges that make a pair of lower rank
        tokens = {bytes([b]) for b in range(256)}
        while len(tokens) < 300:
            tokens.add(bytes(draw.choice(b"abc") for _ in range(draw.randrange(2, 7))))
        tokens = draw.sample(sorted(tokens), len(tokens))
        bpe = byte_bpe.ByteBpe({t: i for i, t in enumerate(tokens)}, public_tokenizers.PATTERN)
        pieces = [bytes(draw.choice(b"abc") for _ in range(draw.randrange(1, 40)))
                  for _ in range(200)]
        pieces = [p for p in pieces if p not in bpe.ranks]
        assert bpe.encode_shared(pieces) == [
            array("i", bpe.encode_piece(p)).tobytes() for p in pieces]


def test_decode_of_null_and_empty_ids(spark):
    bpe = byte_bpe.load_ranks(RANKS, public_tokenizers.PATTERN)
    texts = ["one, two", None, "", "漢 é"]
    tokens = spark.createDataFrame(
        [(i, None if t is None else bpe.encode_text(t)) for i, t in enumerate(texts)],
        "doc_id long, ids array<int>").coalesce(1)
    got = byte_bpe.decode(tokens, RANKS, public_tokenizers.PATTERN).orderBy("doc_id").collect()
    assert [None if r.decoded is None else bytes(r.decoded).decode() for r in got] == texts


def test_chunks_equal_the_library():
    """A finding on CPU time: a word is encoded once, whatever mark follows it."""
    import pyarrow as pa
    tokenizer = Tokenizer.from_file(VOCABULARY)
    encoder = token_store._encoder(VOCABULARY)
    texts = [None, "", " ", "\n", "\n\n", "a\n", "\na", "a\n\nb", "a \nb", "a\n b", "a  b", " a", "a ",
             "\ta\n\tb", "a\0b c", "x\r\ny z", "a\u00a0b\u2003c", "'s don't 'll\nI've", "a" * 3000,
             "1 2\n3,4. 5", "é. à, ×. ÷, a. b's c''s d'll e'. (f)g [h]_i é's", "don't.\nI've!? x1.2y3,z",
             "ʼn. ʼa, ǆ. ɑ.b 漢. 漢,a.漢", "á. b́,c e‍.f", " . ,a .b", "a<|endoftext|>b", "a", "b\n"]
    full = pa.array(texts)
    for part in (full, full.slice(3, 20), full[:0]):
        expected = [tokenizer.encode(t or "", add_special_tokens=False).ids
                    for t in part.to_pylist()]
        assert encoder.encode_all(part).to_pylist() == expected
        assert encoder.encode_all(part, 0).to_pylist() == [ids + [0] for ids in expected]
    seen = []
    inner = encoder.encode_many
    counting = chunks.ChunkEncoder(
        encoder.encode_whole, lambda new: (seen.extend(new), inner(new))[1])
    counting.encode_all(pa.array(["x word, word. word! word; word", "a word: word; cité. cité"]))
    assert seen.count(" word") == 1 and seen.count(" cité") == 1
    assert not [c for c in seen if "word" in c and c not in (" word", "word")]


def test_token_files(spark, docs, rows, nothing, tmp_path):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    place = {}
    for r in rows:
        raw = np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        place.setdefault(r["doc_id"], []).append((len(raw), zlib.crc32(raw.tobytes())))
    got = token_store.store_and_locate(docs, VOCABULARY).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(
        (k, *v) for k, many in place.items() for v in many)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert token_store.store_and_locate(nothing, VOCABULARY).count() == 0
    path = str(tmp_path / "tokens")
    token_store.write_orc(token_store.encode_ordered(docs, VOCABULARY), path)
    one = token_store.read_orc(spark, path).where("doc_id = 7")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in (
        one._jdf.queryExecution().toString())
    assert one.count() == 1


def test_added_tokens_are_encoded_as_the_library_does(spark):
    texts = ["a<|endoftext|>b", "one two <|endoftext|> three.\n<|endoftext|>", "<|endoftext|>",
             "a <|endoftext |> b", "plain text, twice. plain text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    tokenizer = Tokenizer.from_file(VOCABULARY)
    got = {r.doc_id: r.ids for r in token_store.encode_ordered(docs, VOCABULARY, 0).collect()}
    assert got == {i: tokenizer.encode(t, add_special_tokens=False).ids + [0]
                   for i, t in enumerate(texts)}
    assert 50256 in got[0]


def test_class_model(docs, rows, nothing):
    held = [brute.crc(r["doc_id"]) % 7 == 2 for r in rows]
    tokens = [[*brute.lowered(r["text"]), None] for r in rows]
    counts = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(
        (r["doc_id"] or -1, h, len(t), sum(counts[w] > 0 for w in t), n,
         pytest.approx(sum(log10((counts[w] + 1) / (n + v + 1)) for w in t)))
        for r, h, t in zip(rows, held, tokens) if r["doc_id"] != 0)
    got = class_lm.score(docs)
    assert expected == sorted(
        (r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score)
        for r in got.collect() if r.doc_id != 0)
    assert class_lm.score(nothing).count() == 0
    untrained = class_lm.score(docs.where("doc_id = 3 or doc_id = 10").where(
        class_lm.held_out_by_id())).collect()
    assert all(r.base_score == 0 and r.train_tokens == 0 for r in untrained)


def test_class_probabilities_sum_to_one():
    pairs = np.random.default_rng(0).integers(0, 5, (class_lm.TOTAL, class_lm.TOTAL))
    assert (10 ** class_lm.log_transitions(pairs)).sum(axis=1) == pytest.approx(1)


def test_exchange_groups_words_by_neighbours():
    """Words of two kinds that strictly alternate end up in separate classes."""
    left = np.zeros((20, class_lm.TOTAL), np.int64)
    classes = class_lm.first_classes(20)
    for w in range(20):
        for other in range(20):
            if (w + other) % 2:
                left[w, classes[other]] += 10
    pairs = np.zeros((class_lm.TOTAL, class_lm.TOTAL), np.int64)
    for w in range(20):
        pairs[:, classes[w]] += left[w]
    after = class_lm.exchange(classes, left, left, pairs)
    assert not set(after[:20:2]) & set(after[1:20:2])


def test_words_moved_at_once_take_the_class_of_the_exchange():
    """Alone, each word goes where the exchange of one word puts it, from any class."""
    draw = np.random.default_rng(3)
    pairs = draw.integers(0, 60, (class_lm.TOTAL, class_lm.TOTAL))
    left, right = draw.poisson(0.1, (2, 200, class_lm.TOTAL))
    left[:, 5] += 1
    right[:, class_lm.END] += 1
    old = draw.integers(0, class_lm.END, 200)
    for word in range(200):  # bigrams count the words themselves
        pairs[old[word]] += right[word]
        pairs[:, old[word]] += left[word]
    alone = [class_lm.exchange(old[w:w + 1], left[w:w + 1], right[w:w + 1], pairs)[0]
             for w in range(200)]
    assert class_lm.exchange_at_once(old, left, right, pairs).tolist() == alone
    assert (old != alone).any()


def test_every_training_word_is_clustered(spark, monkeypatch):
    """Words without a number, too, leave the rare class for one that fits their neighbours, and
    the scores are those of the classes all words have then."""
    n_words = class_lm.NUMBERED + 15_000
    phrases = [f"in a{i} the" if i % 2 else f"of b{i} by" for i in range(n_words)]
    texts = [" ".join(phrases[i::100]) for i in range(100)] + ["in new the", None, "in a1 the"]
    held = [brute.crc(i) % 7 == 2 for i in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tables, stage = {}, class_lm.stage
    monkeypatch.setattr(class_lm, "stage", lambda df, name: tables.setdefault(
        name, stage(df, name)))
    got = {r.doc_id: r.score for r in class_lm.score(docs).collect()}

    counts = Counter(w for t, h in zip(texts, held) if t and not h for w in t.split())
    moved = {r["word"]: r for r in tables["lm-moved"].collect()}
    own = list(counts)
    keys = class_lm.WordHasher()([w.encode() for w in own]).view(np.int64).tolist()
    unnumbered = 0
    by_kind = {"a": Counter(), "b": Counter()}
    for word, key in zip(own, keys):
        if key in moved:
            assert moved[key]["n"] == counts[word]
            if moved[key]["code"] == class_lm.NUMBERED:
                unnumbered += 1
                by_kind[word[0]][moved[key]["class"]] += 1
    assert len(moved) == len(counts) - class_lm.CLUSTERED
    assert unnumbered == len(counts) - class_lm.NUMBERED
    assert class_lm.RARE not in by_kind["a"] + by_kind["b"]
    assert not set(by_kind["a"]) & set(by_kind["b"])

    paths = {r.doc_id: list(r.path) for r in tables["lm-paths"].collect()}
    in_class, pairs = Counter({class_lm.RARE: 1}), np.zeros((class_lm.TOTAL,) * 2, int)
    class_of = {}
    for i, text in enumerate(texts):
        words = (text or "").split()
        assert len(words) == len(paths[i])
        for word, c in zip(words, paths[i]):
            assert class_of.setdefault(word, c) == c
        if not held[i]:
            path = [class_lm.END, *paths[i], class_lm.END]
            np.add.at(pairs, (path[:-1], path[1:]), 1)
    seen = {w: n + (class_of[w] == class_lm.RARE) for w, n in counts.items()}
    for word, n in seen.items():
        in_class[class_of[word]] += n
    steps = class_lm.log_transitions(pairs)
    for i, text in enumerate(texts):
        path = [class_lm.END, *paths[i], class_lm.END]
        assert got[i] == pytest.approx(steps[path[:-1], path[1:]].sum() + sum(
            log10(seen.get(w, 1) / in_class[class_of[w]]) for w in (text or "").split()))


def test_language_codes_and_predictions(spark, nothing):
    for k in range(2, 9):
        code = lang_ecoc.codewords(k)
        assert len({tuple(c) for c in code}) == k
        assert all(abs(bit.sum()) < k for bit in code.T)
    draw = np.random.default_rng(1)
    sounds = {"xa": ["ba", "du", "ko"], "xb": ["sch", "ung", "ei"], "xc": ["ção", "nh", "lh"]}
    rows = []
    for i in range(300):
        lang = sorted(sounds)[i % 3]
        rows.append((i, " ".join("".join(draw.choice(sounds[lang], 3)) for _ in range(12)),
                     lang if i % 4 else None, "s", "clash"))
    rows += [(None, "badu kodu", None, None, None), (900, None, "xa", None, None),
             (901, "", "xa", None, None), (902, " 12 ²!", "xb", None, None)]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, score string")
    got = {r.doc_id: r for r in lang_ecoc.predict(docs).collect()}
    assert all(got[i].held_out == (brute.crc(i) % 5 == 0) for i in got)
    truth = {i: sorted(sounds)[i % 3] for i in range(300)}
    held = [i for i in truth if got[i].held_out]
    assert len(held) > 30 and all(got[i].lang_pred == truth[i] for i in held)
    assert {(got[i].lang_pred, got[i].score) for i in (900, 901, 902)} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert lang_ecoc.predict(nothing).count() == 0
    unlabelled = lang_ecoc.predict(docs.where("lang IS NULL")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}

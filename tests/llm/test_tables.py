"""Operators on pages and embeddings, and the pipeline."""

import base64
import hashlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from postwatch.llm import byte_bpe, cover_search, warc
from postwatch.llm.queries import ORACLES, QUERIES


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_transactions(spark, tmp_path):
    pages = [(1, "http://a/x?q=1", "<p>é漢</p>", "k"), (2, None, "<p>é漢</p>", "k"),
             (3, "http://b/\r\ninjected", None, "k"), (4, "bad [url", "", "k"),
             (5, "http://c/", "a\r\n\r\nWARC/1.1\r\n\r\n", "k"), (6, "http://c/", "long " * 50_000, "k"),
             (7, "http://d/", "long " * 50_000, "k"), (None, "http://e/", "<p>é漢</p>", "k"),
             (None, None, "only", "k"), (5, "http://c/", "a\r\n\r\nWARC/1.1\r\n\r\n", "k")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, value string")
    first = {}
    for page, _, html, _ in pages:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    expected = Counter()
    for page, _, html, _ in pages:
        raw = (html or "").encode()
        to = first.get(html or "")
        to = to if to != page else None
        expected[page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(),
                 "response" if to is None else "revisit", to] += 1
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    got = Counter(tuple(r[c] for c in columns) for r in warc.archive_and_assemble(df).collect())
    assert got == expected
    large = warc.archive_and_assemble(df, min_revisit_bytes=1000).collect()
    assert [r.page_id for r in large if r.record_type == "revisit"] == [7]
    assert warc.archive_and_assemble(df.where("page_id > 99")).count() == 0
    path = str(tmp_path / "warc")
    warc.write_archives(df, path)
    nested = warc.transactions(warc.read_archives(spark, path))
    assert nested.count() == len(pages)
    payloads = {bytes(r.response.payload).decode() for r in nested.where(
        "response.record_type = 'response'").collect()}
    assert payloads == {html or "" for _, _, html, _ in pages}


def brute_top_k(rows, every, k):
    vectors = {i: np.floor(256 * np.array(v, np.float64)).astype(np.int64) for i, v in rows
               if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in vectors:
        if q % every == 0:
            scores = sorted((-int(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:k]
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)}
    return out


def test_search_equals_brute_force(spark, monkeypatch):
    draw = np.random.default_rng(5)
    centers = draw.normal(size=(8, 6))
    rows = [(i, (centers[i % 8] + 0.1 * draw.normal(size=6)).astype(np.float32).tolist())
            for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(120)]  # ties
    rows += [(1000, None), (1050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1100, [float("nan")] * 6),
             (1150, [float("inf")] + [0.0] * 5), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x", "x") for i, v in rows],
                               "vec_id long, embedding array<float>, cell string, rank string")
    for name, value in (("BLOCK", 50), ("QUERY_BLOCK", 4), ("TOGETHER", 2), ("LEAF", 8),
                        ("SMALL", 3)):
        monkeypatch.setattr(cover_search, name, value)
    got = {tuple(r) for r in cover_search.top_k(df, 10, 5).collect()}
    assert got == brute_top_k(rows, 10, 5)
    few = df.where("vec_id in (0, 50, 3)")
    assert {tuple(r) for r in cover_search.top_k(few).collect()} == brute_top_k(
        [r for r in rows if r[0] in (0, 50, 3)], 50, 5)
    assert cover_search.top_k(df.where("vec_id > 5000")).count() == 0


def test_tree_covers_its_points():
    vectors = np.random.default_rng(2).normal(size=(600, 3))

    def check(node):
        away = np.linalg.norm(vectors[node.points] - node.center, axis=1)
        assert away.max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
        for child in node.children:
            check(child)

    check(cover_search.cover_tree(vectors, leaf=10))


def test_pipeline_equals_brute_force(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = [dict(r, text=q["cleaned"]) for r, q in zip(rows, brute.quality(rows)) if q["kept"]]
    chosen, seen = [], set()
    for r, (n, component) in sorted(zip(kept, brute.components(kept)),
                                    key=lambda x: (x[0]["doc_id"] is None, x[0]["doc_id"] or 0)):
        if n == 0 or (component not in seen and r["doc_id"] == component):
            chosen.append(r)
            seen.add(component)
    cut = [dict(r, text=c[2] if c[1] else r["text"]) for r, c in zip(
        chosen, brute.cut_repeats(chosen)) if not c[1] or c[2]]
    expected = Counter()
    library = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=(
        byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                            public_tokenizers.PATTERN).ranks), special_tokens={})
    for r, (size, _, _, taken) in zip(cut, brute.mix(cut)):
        for text in [r["text"]] * (taken // size if size else 0):
            ids = library.encode_ordinary(text)
            expected[r["doc_id"], len(ids), brute.sha256(",".join(map(str, ids))),
                     brute.sha256(text)] += 1
    assert len(cut) > 20 and sum(expected.values()) > 20
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)
                  for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == expected


def test_pipeline_of_an_empty_table(spark, nothing, tmp_path):
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

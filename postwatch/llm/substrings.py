"""Removal of long repeated spans by compaction of a de Bruijn graph over tokens.

Every window of ``WINDOW`` words is an edge of the graph. The edges of a document fall into paths:
maximal runs of windows that share their minimizer, the smallest hash among the ``ANCHOR``-word
anchors inside a window. Equal windows have equal minimizers, so equal edges meet under one anchor.

1. Anchors that occur once are dropped by a count; nothing repeats there.
2. A path whose whole content occurs twice is a repeated path without branches: all its windows
   repeat, found by one join on (anchor, content) and never window by window.
3. A path that occurs once, under an anchor that occurs again, runs off a branch somewhere. Its
   windows are compared with those of the distinct paths under that anchor.
4. Repeated windows go back to their source coordinates, where touching ones merge into spans.

Contents are compared by 64-bit hashes among texts that share a second, independent 64-bit anchor
hash, which is as selective as 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    SLICE_ROWS, doc_key, fingerprint, new_path, stage, text_bytes, text_slices, tidy,
)
from .words import WORDS_BYTES, Words

WINDOW = 35
ANCHOR = 8
#: Stored bytes of text that one bucket of the working table is meant to hold.
BUCKET_BYTES = 64 << 20

_BASE = 0x9E3779B97F4A7C15

#: Words that a hasher remembers.
WORDS_KNOWN = 120_000


class WordHasher:
    """64-bit hashes of words; those seen lately are remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > WORDS_KNOWN:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for word in set(words):
                if word not in known:
                    known[word] = xxhash.xxh64_intdigest(word)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


class SpanHasher:
    """Hash of any span of a word sequence in constant time, by prefix sums of a polynomial."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        with np.errstate(over="ignore"):
            power = np.full(n + 1, _BASE, np.uint64)
            power[0] = 1
            power = np.cumprod(power, dtype=np.uint64)
            self.inverse = np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
            self.inverse[0] = 1
            self.inverse = np.cumprod(self.inverse, dtype=np.uint64)
            self.prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(hashes * power[:-1], out=self.prefix[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _mixed((self.prefix[ends] - self.prefix[starts]) * self.inverse[starts])

    def every(self, width: int) -> np.ndarray:
        """The hashes of all spans of ``width`` words."""
        n = max(0, len(self.prefix) - width)
        with np.errstate(over="ignore"):
            return _mixed((self.prefix[width:] - self.prefix[:n]) * self.inverse[:n])


def paths(lengths: np.ndarray, hashes: np.ndarray, window: int, anchor: int):
    """(document, anchor hash, content hash, start, end) of every path, starts within documents.

    ``lengths`` are the words of each document, ``hashes`` those of all documents in a row.
    """
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    n = len(hashes)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    span = SpanHasher(hashes)
    anchors = span.every(anchor)
    low = (anchors & np.uint64(0xFFFFFFFF00000000)) | np.arange(
        len(anchors), dtype=np.uint64)  # leftmost among ties
    width, held = window - anchor + 1, 1
    least = low
    while 2 * held <= width:
        least = np.minimum(least[:-held], least[held:])
        held *= 2
    if held < width:
        least = np.minimum(least[:held - width], least[width - held:])
    first = np.arange(n - window + 1)
    valid = first + window <= ends[owner[:n - window + 1]]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (least[1:] != least[:-1])
    start, end = np.flatnonzero(new), np.flatnonzero(last) + window
    key = anchors[(least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    content = span(start, end)
    doc = owner[start]
    base = (ends - lengths)[doc]
    return doc, key.view(np.int64), content.view(np.int64), start - base, end - base


def _lists(counts: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


_PATHS = ("doc_id {kind}, fp long, text string, n_words long, anchors array<long>, "
          "contents array<long>, starts array<int>, ends array<int>")


def _with_paths(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 2, SLICE_ROWS, WORDS_BYTES):
                words = Words(part.column(2))
                doc, key, content, start, stop = paths(
                    words.counts, words.hashes(), window, anchor)
                counts = np.bincount(doc, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2),
                     pa.array(words.counts, pa.int64()),
                     _lists(counts, key, pa.int64()), _lists(counts, content, pa.int64()),
                     _lists(counts, start, pa.int32()), _lists(counts, stop, pa.int32())],
                    ["doc_id", "fp", "text", "n_words", "anchors", "contents", "starts", "ends"])

    return docs.mapInArrow(tidy(run), _PATHS.format(kind=kind))


def _bucketed(df: DataFrame, size: int, name: str) -> DataFrame:
    """Write ``df`` with a row number, in buckets by it, so that joins on ``row`` move only the
    other side. The number of buckets follows ``size``, the bytes of the texts."""
    spark = df.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES)
    path = new_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.withColumn("row", F.monotonically_increasing_id()).write.bucketBy(count, "row").option(
        "path", path).option("compression", "zstd").saveAsTable(table)
    return spark.table(table)


def _windows(kept: DataFrame, window: int) -> DataFrame:
    """(anchor, hash, row, start, single) of every window in the wanted paths of each document."""
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 1, SLICE_ROWS, WORDS_BYTES):
                words, lists = Words(part.column(1)), part.column(2)
                wanted = lists.flatten()
                key, uses, start, end = (wanted.field(n).to_numpy() for n in (
                    "anchor", "n", "start", "end"))
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                counts = end.astype(np.int64) - start - window + 1
                begin = np.repeat(start - (np.cumsum(counts) - counts), counts) + np.arange(
                    counts.sum())
                base = np.repeat((np.cumsum(words.counts) - words.counts)[owner], counts)
                found = SpanHasher(words.hashes())(base + begin, base + begin + window)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(key, counts)), pa.array(found.view(np.int64)),
                    pa.array(np.repeat(part.column(0).to_numpy()[owner], counts)),
                    pa.array(begin, pa.int32()), pa.array(np.repeat(uses == 1, counts))],
                    ["anchor", "hash", "row", "start", "single"])

    return kept.select("row", "text", "wanted").mapInArrow(
        tidy(run), "anchor long, hash long, row long, start int, single boolean")


def repeated_spans(table: DataFrame, window: int) -> DataFrame:
    """(row, spans array of (start, end)) of the rows of ``table`` that hold repeated windows."""
    found = table.select("row", F.explode(F.arrays_zip(
        "anchors", "contents", "starts", "ends")).alias("p")).select(
        "row", F.col("p.anchors").alias("anchor"), F.col("p.contents").alias("content"),
        F.col("p.starts").alias("start"), F.col("p.ends").alias("end"))
    # counts are written first: a join with plain tables on both sides can be split where it is hot
    again = stage(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("uses")).where(
        "uses > 1").select("anchor"), "span-anchors")
    hits = stage(found.join(again, "anchor"), "span-hits")
    pieces = stage(hits.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "start", "end")).alias("at")),
        "span-paths")
    whole = hits.join(pieces.where("n > 1").select("anchor", "content"), ["anchor", "content"])
    branching = pieces.where("n = 1").select("anchor").distinct()
    wanted = pieces.join(branching, "anchor", "left_semi").groupBy(
        F.col("at.row").alias("row")).agg(F.collect_list(F.struct(
            "anchor", "n", F.col("at.start").alias("start"), F.col("at.end").alias("end"))).alias(
            "wanted"))  # paths of one document
    windows = stage(_windows(table.select("row", "text").join(wanted, "row"), window),
                    "span-windows")
    twice = stage(windows.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("uses")).where(
        "uses > 1").select("anchor", "hash"), "span-repeats")
    single = windows.where("single").join(twice, ["anchor", "hash"]).select(
        "row", "start", (F.col("start") + window).alias("end"))
    return whole.select("row", "start", "end").unionByName(single).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def _cut(table: DataFrame, join: bool) -> DataFrame:
    kind = table.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, 2, SLICE_ROWS, WORDS_BYTES):
                words, lists = Words(part.column(2)), part.column(4)
                spans = lists.flatten()
                held = pc.fill_null(lists.value_lengths(), 0).to_numpy()
                base = np.repeat(np.cumsum(words.counts) - words.counts, held)
                turn = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(turn, base + spans.field("start").to_numpy(), 1)
                np.add.at(turn, base + spans.field("end").to_numpy(), -1)
                gone = np.cumsum(turn[:-1]) > 0
                removed = np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(gone)])[
                    np.concatenate([np.zeros(1, np.int64), np.cumsum(words.counts)])])
                whole = (removed == 0) & (not join)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3),
                     pa.array(removed, pa.int64()), words.joined(gone, whole)],
                    ["doc_id", "fp", "n_words", "n_removed", "kept_text"])

    return table.select("doc_id", "fp", "text", "n_words", "spans").mapInArrow(
        tidy(run), f"doc_id {kind}, fp long, n_words long, n_removed long, kept_text binary")


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, join_words: bool = True
) -> DataFrame:
    """doc_id, fp, n_words, n_removed and kept_text (UTF-8) of every row of ``docs``.

    Every word that a window of ``window`` words covers is removed if the window's word sequence
    starts at any other place of the table too, in the same row or another; repeated rows are other
    places. Windows are judged on the input. Kept words are joined by single spaces; with
    ``join_words`` false a text that loses nothing stays as it is. Null, empty and short texts lose
    nothing; an empty table gives no rows. Only doc_id, text and source are read.
    """
    if not 1 <= anchor <= window:
        raise ValueError("an anchor has 1 to window words")
    own = docs.select("doc_id", fingerprint("text", "source").alias("fp"), "text")
    table = _bucketed(_with_paths(own, window, anchor), text_bytes(own), "span-table")
    return _cut(table.join(repeated_spans(table, window), "row", "left"), join_words)


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated spans cut out of the text; rows with nothing left go.

    Other columns stay; ``n_chars``, where there is such a column, follows the text.
    """
    cut = remove_repeats(docs, window, join_words=False).where("n_removed > 0").groupBy(
        doc_key().alias("__id"), F.col("fp").alias("__fp")).agg(
        F.first("kept_text").cast("string").alias("__text"))
    out = docs.withColumns({"__id": doc_key(), "__fp": fingerprint("text", "source")}).join(
        cut, ["__id", "__fp"], "left").where("__text IS NULL OR __text <> ''").withColumn(
        "text", F.coalesce("__text", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__text").isNull(), F.col("n_chars")).otherwise(
            F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
           FROM documents),
w AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM
      (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 35)) AS p FROM rep)),
words AS (SELECT r, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n
         FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

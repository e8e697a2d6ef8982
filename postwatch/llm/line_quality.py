"""Quality rules with cross-document line frequency.

Lines are normalised (words joined by one space, A-Z in lower case) and hashed. For each host the
number of its documents that hold a line is counted; a line above the host's limit is removed, and
a document that loses too much of itself is rejected.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_key, fingerprint, identified, map_slices, split_words, stage

SYMBOLS = b"#*$%&|<>"
#: A line is removed in a host when more documents than both of these hold it.
MIN_LINE_DOCS = 20
MAX_LINE_SHARE = 0.02
#: A document is depleted when fewer words are left, or more than this share is gone.
MIN_WORDS = 50
MAX_REMOVED_SHARE = 0.5

_MEASURES = (
    "doc_id long, fp long, host string, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, line_hashes array<long>, line_words array<long>"
)


def line_hash(line: bytes) -> tuple[int, int]:
    """Signed 64-bit hash of the normalised line, and its number of words (0: no line)."""
    words = line.lower().split()
    value = xxhash.xxh64_intdigest(b" ".join(words))
    return value - (1 << 64) if value >> 63 else value, len(words)


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three words that occur at least twice in the list."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    key = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F)
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0x165667B19E3779F9) + h[2:]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    if len(counts) == len(key):
        return 0
    again = counts[inverse] > 1
    covered = np.zeros(n, dtype=bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def _measure(columns: dict[str, list]) -> dict[str, list]:
    out: dict[str, list] = {k: [] for k in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_hashes",
        "line_words")}
    for text in columns["text"]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        lines = [line for line in raw.split(b"\n") if line.strip()]
        found: dict[int, int] = {}
        for line in lines:
            key, n = line_hash(line)
            found[key] = found.get(key, 0) + n
        out["n_words"].append(len(words))
        out["word_chars"].append(len(text or "") - (len(raw) - sum(map(len, words))))
        out["n_symbols"].append(len(raw) - len(raw.translate(None, SYMBOLS)))
        out["n_dup_lines"].append(len(lines) - len(set(lines)))
        out["n_repeat_words"].append(repeated_words(words))
        out["line_hashes"].append(list(found))
        out["line_words"].append(list(found.values()))
    return out | {k: columns[k] for k in ("doc_id", "fp", "host")}


def _host() -> Column:
    """The host of a document is its source; null is a host of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("host")


def judge(
    docs: DataFrame, min_line_docs: int = MIN_LINE_DOCS, max_line_share: float = MAX_LINE_SHARE,
    min_words: int = MIN_WORDS, max_removed_share: float = MAX_REMOVED_SHARE,
) -> DataFrame:
    """One verdict per row of ``docs`` (doc_id, text, source; other columns are not looked at).

    Returns doc_id, fp, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    removed_words, removed_lines (hashes) and kept. Every row counts as a document, repeated rows
    too. Null and empty texts have no words and fail the base rules; null sources are one host;
    an empty table gives no rows.

    Hot hosts and hot lines are summed before the shuffle; the join back against the frequent
    lines is split by adaptive execution where a line is hot. The text is read once.
    """
    measured = stage(
        map_slices(identified(docs).select("doc_id", "fp", "text", _host()), _measure, _MEASURES)
        .withColumn("row", F.monotonically_increasing_id()),
        "line-measures",
    )
    lines = measured.select("row", "host", F.explode(
        F.arrays_zip("line_hashes", "line_words")).alias("line")).select(
        "row", "host", F.col("line.line_hashes").alias("hash"),
        F.col("line.line_words").alias("words"))
    limits = measured.groupBy("host").agg(F.greatest(
        F.lit(float(min_line_docs)), F.count(F.lit(1)) * max_line_share).alias("limit"))
    frequent = stage(  # plain tables on both sides of the join let a hot line be split
        lines.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("docs"))
        .where(F.col("docs") > min_line_docs)
        .join(limits, "host").where("docs > limit").select("host", "hash"),
        "frequent-lines")
    removed = lines.join(frequent, ["host", "hash"]).groupBy("row").agg(
        F.sum("words").alias("removed_words"),
        F.array_sort(F.collect_list("hash")).alias("removed_lines"))  # lines of one document
    base_failed = (F.col("n_words") < 50) | (
        100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (left < min_words) | (
        F.col("removed_words") > F.col("n_words") * max_removed_share)
    return (
        measured.drop("line_hashes", "line_words", "host").join(removed, "row", "left")
        .withColumns({
            "removed_words": F.coalesce("removed_words", F.lit(0)),
            "removed_lines": F.coalesce("removed_lines", F.array().cast("array<long>")),
            "base_failed": base_failed,
        })
        .withColumn("kept", ~F.col("base_failed") & ~depleted).drop("row")
    )


def _without_lines(columns: dict[str, list]) -> dict[str, list]:
    texts = []
    for text, gone in zip(columns["text"], columns["__gone"], strict=True):
        if gone:
            drop = set(gone)
            text = "\n".join(
                line for line in text.split("\n")
                if line_hash(line.encode("utf-8", "surrogatepass"))[0] not in drop
                or not split_words(line))
        texts.append(text)
    return {"text": texts} | {k: v for k, v in columns.items() if k not in ("text", "__gone")}


def clean(docs: DataFrame, **limits: float) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns, frequent lines cut out of the text.

    ``n_chars``, where there is such a column, follows the text.
    """
    verdicts = judge(docs, **limits).where("kept").groupBy(
        doc_key().alias("__id"), F.col("fp").alias("__fp")).agg(
        F.first("removed_lines").alias("__gone"))
    joined = docs.withColumns({"__id": doc_key(), "__fp": fingerprint("text", "source")}).join(
        verdicts, ["__id", "__fp"]).select(*docs.columns, "__gone")
    out = map_slices(joined, _without_lines, docs.schema.simpleString()[7:-1])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if (
        "n_chars" in docs.columns) else out


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host,
         coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 3)),
g2 AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g)
       WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM
        (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g2) GROUP BY r),
l0 AS (SELECT r, host, unnest(string_split(t, chr(10))) AS line FROM d),
l1 AS (SELECT r, host, line, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM l0),
l2 AS (SELECT * FROM l1 WHERE len(ws) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l2 GROUP BY r),
l3 AS (SELECT r, host, array_to_string(ws, ' ') AS norm, sum(len(ws)) AS words
       FROM l2 GROUP BY r, host, norm),
hosts AS (SELECT host, greatest(20.0, count(*) * 0.02) AS lim FROM d GROUP BY host),
freq AS (SELECT l3.host, norm FROM l3 JOIN hosts USING (host)
         GROUP BY l3.host, norm, lim HAVING count(*) > lim),
gone AS (SELECT r, sum(words) AS n FROM l3 JOIN freq USING (host, norm) GROUP BY r),
m AS (SELECT d.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT)
               AS n_symbols,
             CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
      FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)
           LEFT JOIN gone USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words - removed_words >= 50 AND removed_words <= n_words * 0.5 AS kept,
       removed_words
FROM b
"""

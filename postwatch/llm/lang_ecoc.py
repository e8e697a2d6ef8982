"""Language identification with error-correcting output codes.

Each language has a codeword. One binary classifier per bit, over hashed byte n-grams, tells the
languages whose bit is set from the others; its margin is the mean log ratio of the n-grams. A
language's loss is the sum over bits of the logistic loss of margin and codeword, weighted by how
often that bit is right for that language in training. The language of least loss is nearest; two
that come close make the document ambiguous.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, stage

UNKNOWN = "und"
#: Hash buckets of n-grams, their lengths, and bytes of text taken at a time.
BUCKETS, ORDERS, CHUNK = 1 << 16, (2, 3, 4), 1 << 20
#: Up to so many languages get exhaustive codes; more get the best of some seeded random codes.
EXHAUSTIVE, RANDOM_TRIES = 6, 32
#: Margins are scaled so that their mean size in training is this.
MEAN_MARGIN = 3.0
#: Ambiguous: the second language's share of the score is within this of the first's.
AMBIGUOUS = 0.2

_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def codewords(languages: int) -> np.ndarray:
    """(languages, bits) of -1 and 1. Exhaustive codes hold every split of the languages once."""
    if languages < 2:
        return np.ones((languages, 1), np.int8)
    if languages <= EXHAUSTIVE:
        columns = [[1 if i == 0 or i in others else -1 for i in range(languages)]
                   for n in range(languages - 1) for others in combinations(range(1, languages), n)]
        return np.array(columns, np.int8).T
    bits = int(np.ceil(15 * np.log2(languages)))
    draw = np.random.default_rng(0)
    best, apart = None, -1
    for _ in range(RANDOM_TRIES):
        code = draw.choice(np.array([-1, 1], np.int8), (languages, bits))
        code = code[:, np.abs(code.sum(axis=0)) < languages]  # no constant bit
        product = code.astype(int) @ code.T
        np.fill_diagonal(product, -bits)
        least = (code.shape[1] - product.max()) // 2
        if least > apart:
            best, apart = code, least
    return best


def grams(text: str):
    """Bucket numbers of the n-grams of ``text``, in pieces. Letters count in lower case, runs of
    other ASCII characters as they are spaced."""
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS)
                        + b" ", np.uint8)
    for start in range(0, len(raw), CHUNK):
        part = raw[start:start + CHUNK + max(ORDERS) - 1].astype(np.uint32)
        for order in ORDERS:
            value = part[:len(part) - order + 1].copy()
            for k in range(1, order):
                value *= np.uint32(0x01000193)
                value ^= part[k:len(part) - order + 1 + k]
            value *= np.uint32(0x9E3779B1)
            yield (value[:CHUNK] >> np.uint32(16)) & np.uint32(BUCKETS - 1)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _gram_counts(batches):
    """(lang, bucket, n) summed over a partition."""
    tables: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, text = lang.as_py(), text.as_py()
            if not has_letter(text):
                continue
            table = tables.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for part in grams(text):
                if len(part) > BUCKETS // 8:
                    table += np.bincount(part, minlength=BUCKETS)
                else:
                    bucket, n = np.unique(part, return_counts=True)
                    table[bucket] += n
    for lang, table in tables.items():
        hit = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(hit), pa.string()), pa.array(hit), pa.array(table[hit])],
            ["lang", "bucket", "n"])


def bit_weights(counts: np.ndarray, code: np.ndarray) -> np.ndarray:
    """(buckets, bits): log ratio of the n-gram's mean share among the languages of either side.

    Languages weigh the same whatever their share of the corpus."""
    share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])
    out = np.zeros((counts.shape[1], code.shape[1]), np.float32)
    for bit in range(code.shape[1]):
        yes, no = code[:, bit] > 0, code[:, bit] < 0
        if yes.any() and no.any():
            out[:, bit] = np.log(share[yes].mean(axis=0)) - np.log(share[no].mean(axis=0))
    return out


def margins(text: str, weights: np.ndarray) -> np.ndarray:
    """Mean weight of the text's n-grams, by bit."""
    total, n = np.zeros(weights.shape[1]), 0
    for part in grams(text):
        total += weights[part].sum(axis=0, dtype=np.float64)
        n += len(part)
    return total / max(1, n)


def _bit_quality(batches, languages: list[str], code: np.ndarray, weights: np.ndarray):
    """(lang, bit, n, right, size): how often a bit is right, and the sum of margin sizes."""
    place = {lang: i for i, lang in enumerate(languages)}
    n = np.zeros(len(languages), np.int64)
    right = np.zeros(code.shape, np.int64)
    size = np.zeros(code.shape)
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, text = lang.as_py(), text.as_py()
            if has_letter(text):
                i, found = place[lang], margins(text, weights)
                n[i] += 1
                right[i] += found * code[i] > 0
                size[i] += np.abs(found)
    at, bit = (x.ravel() for x in np.indices(code.shape))
    yield pa.RecordBatch.from_arrays(
        [pa.array(at), pa.array(bit), pa.array(n[at]), pa.array(right.ravel()),
         pa.array(size.ravel())], ["lang", "bit", "n", "right", "size"])


def decode(found: np.ndarray, code: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """Shares of the languages (they sum to 1) by loss-weighted decoding of scaled margins."""
    loss = (trust * np.logaddexp(0, -code * found)).sum(axis=1)
    share = np.exp(-(loss - loss.min()))
    return share / share.sum()


def _predict(batches, languages, code, weights, scale, trust):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            out = ([], [], [], [])
            for text in part.column(2).to_pylist():
                if not languages or not has_letter(text):
                    row = (UNKNOWN, 0.0, None, True)
                else:
                    share = decode(margins(text, weights) / scale, code, trust)
                    order = np.argsort(-share, kind="stable")
                    second = float(share[order[1]]) if len(order) > 1 else 0.0
                    first = float(share[order[0]])
                    row = (languages[order[0]], first,
                           languages[order[1]] if len(order) > 1 else None,
                           first - second < AMBIGUOUS)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(out[0], pa.string()),
                 pa.array(out[1], pa.float64()), pa.array(out[2], pa.string()),
                 pa.array(out[3], pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "runner_up", "ambiguous"])


def predict(docs: DataFrame, modulus: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score, runner_up and ambiguous of every row of ``docs``.

    Learned from all rows with text, lang and a letter whose crc32 of doc_id (as text, null: empty)
    is not divisible by ``modulus``; the others are held out. The text is the only input of a
    prediction. Texts that are null or have no letter are ``und`` with score 0, so is everything
    where nothing could be learned. Repeated rows count and are predicted each for itself; an empty
    table gives no rows. To the driver come one table of BUCKETS counts per language and the
    quality of each bit.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == 0
    own = docs.select("doc_id", out.alias("held_out"), "text", "lang")
    train = own.where("NOT held_out AND text IS NOT NULL AND lang IS NOT NULL").select(
        "lang", "text")
    table = stage(train.mapInArrow(_gram_counts, "lang string, bucket long, n long").groupBy(
        "lang", "bucket").agg(F.sum("n").alias("n")), "language-grams").toArrow()
    names = table.column("lang").to_pylist()
    languages = sorted(set(names))
    place = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS))
    counts[[place[x] for x in names], table.column("bucket").to_numpy()] = table.column("n")
    code = codewords(len(languages))
    weights = bit_weights(counts, code) if languages else None
    scale = trust = None
    if languages:
        seen = train.mapInArrow(
            lambda batches: _bit_quality(batches, languages, code, weights),
            "lang long, bit long, n long, right long, size double").groupBy("lang", "bit").agg(
            F.sum("n").alias("n"), F.sum("right").alias("right"), F.sum("size").alias("size")
        ).toArrow()
        at = (seen.column("lang").to_numpy(), seen.column("bit").to_numpy())
        n, right, size = (np.zeros(code.shape) for _ in range(3))
        for into, name in ((n, "n"), (right, "right"), (size, "size")):
            into[at] = seen.column(name).to_numpy()
        scale = np.maximum((size / np.maximum(n, 1)).mean(axis=0) / MEAN_MARGIN, 1e-9)
        trust = (right + 1) / (n + 2)
        trust = trust / trust.sum(axis=1, keepdims=True) * code.shape[1]
    return own.select("doc_id", "held_out", "text").mapInArrow(
        lambda batches: _predict(batches, languages, code, weights, scale, trust),
        f"doc_id {kind}, held_out boolean, lang_pred string, score double, runner_up string, "
        "ambiguous boolean")

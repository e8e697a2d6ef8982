"""Class-based n-gram language model: exchange clustering, class transitions, word emissions.

All counts cover all training documents. A bounded list of the most frequent words is numbered;
documents are stored as these numbers, so that each round of clustering reads two bytes per token,
and as the hashes of their other words.
Every training word is clustered by exchange: it moves to the class that raises the likelihood of
the class bigrams most. At first the most frequent words are dealt to classes in turn, the other
numbered words to bands of frequency, the words that are not numbered to the rare class; the end of
a text is a class of its own. A round counts, for each of the most frequent words, the classes on
its left and right, and moves these words one by one with the counts of the round. Behind the last
round all other words are moved at once, each against the class bigrams without itself: their
neighbours are dealt by word, so that a word's new class is found in one task, and classes and
counts of words without a number never leave Spark: they reach documents by a join. Words that do
not occur in training are in the rare class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, stage
from .substrings import WordHasher

#: Numbered words (two bytes each; the last number is "rare"), words that are moved one by one, first
#: classes of theirs, bands of the other numbered words, and rounds of exchange.
NUMBERED, CLUSTERED, CLASSES, BANDS, ROUNDS = 65_535, 8192, 40, 6, 2
#: Tokens counted before partial counts are passed on.
BATCH_TOKENS = 4_000_000
#: Occurrences of words that are moved at once in one step of numpy.
SWEEP_ROWS = 32_768
RARE, END = CLASSES + BANDS, CLASSES + BANDS + 1
TOTAL = END + 1


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _counts(batches):
    """(word, n) partial counts of training texts; the hash stands for the word."""
    hasher, held, size = WordHasher(), [], 0

    def flush():
        word, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            words = _words(text.as_py())
            if words:
                held.append(hasher(words))
                size += len(words)
            if size >= BATCH_TOKENS:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _number(batches, ranked: np.ndarray):
    """Texts as numbers of words, and the hashes of their other words in order."""
    order = np.argsort(ranked)
    known = ranked[order]
    hasher = WordHasher()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            codes, rare = [], []
            for text in part.column(2).to_pylist():
                words = _words(text)
                own = hasher(words) if words else np.zeros(0, np.uint64)
                code = np.full(len(own), NUMBERED, np.int64)
                if len(known) and len(own):
                    place = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    code = np.where(known[place] == own, order[place], NUMBERED)
                codes.append(code.astype("<u2").tobytes())
                rare.append(own[code == NUMBERED].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(codes, pa.binary()),
                 pa.array(rare, pa.list_(pa.int64()))], ["doc_id", "held_out", "codes", "rare"])


def _joined(codes: pa.Array, classes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Codes of texts behind each other with their ends, and the class there, before and after."""
    own = [np.frombuffer(c.as_py(), "<u2").astype(np.int64) for c in codes]
    ends = np.cumsum([len(c) + 1 for c in own]) - 1
    code = np.full(ends[-1] + 1, NUMBERED + 1)  # the end of a text
    code[np.delete(np.arange(len(code)), ends)] = np.concatenate(own)
    now = classes[code]
    after = np.r_[now[1:], END]
    after[ends] = END
    return code, now, np.r_[END, now[:-1]], after


def _neighbours(batches, classes: np.ndarray, words: int):
    """(kind, row, class, n): left (0) and right (1) classes of clustered words, and class bigrams
    (2), summed over all texts of a partition."""
    left, right = (np.zeros(words * TOTAL, np.int64) for _ in range(2))
    pairs = np.zeros(TOTAL * TOTAL, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            code, now, before, after = _joined(batch.column(0).slice(at, SLICE_ROWS), classes)
            pairs += np.bincount(before * TOTAL + now, minlength=len(pairs))
            mine = code < words
            left += np.bincount(code[mine] * TOTAL + before[mine], minlength=len(left))
            right += np.bincount(code[mine] * TOTAL + after[mine], minlength=len(right))
    for kind, table in enumerate((left, right, pairs)):
        hit = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(hit), kind, np.int32)), pa.array(hit), pa.array(table[hit])],
            ["kind", "cell", "n"])


def _occurrences(batches, classes: np.ndarray, words: int, ranked: np.ndarray):
    """(word, cell) of every occurrence of the words beyond the first ``words``; the cell holds the
    class of the word and the classes before and behind it."""
    hashes = np.r_[ranked.view(np.int64), np.zeros(NUMBERED + 2 - len(ranked), np.int64)]
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            code, now, before, after = _joined(part.column(0), classes)
            word = hashes[code]
            word[code == NUMBERED] = part.column(1).flatten().to_numpy()
            far = (code >= words) & (code <= NUMBERED)
            yield pa.RecordBatch.from_arrays(
                [pa.array(word[far]),
                 pa.array(((now * TOTAL + before) * TOTAL + after)[far].astype(np.int32))],
                ["word", "cell"])


def _n_log_n(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(
    classes: np.ndarray, left: np.ndarray, right: np.ndarray, pairs: np.ndarray
) -> np.ndarray:
    """One sweep over the clustered words, most frequent first.

    ``left[w, c]`` and ``right[w, c]`` count the classes next to word w, ``pairs`` the class
    bigrams. Each word moves to the class that raises sum(n log n) of the bigrams less that of the
    class counts on both sides; ties stay with the lower class, no gain keeps the class.
    """
    classes, table = classes.copy(), pairs.astype(np.float64)
    for word in range(len(left)):
        old, l_w, r_w = classes[word], left[word].astype(float), right[word].astype(float)
        if not l_w.any():
            continue
        table[old, :] -= r_w
        table[:, old] -= l_w
        base = table[:END]
        cols = table[:, :END]
        row_gain = (_n_log_n(base + r_w) - _n_log_n(base)).sum(axis=1)
        col_gain = (_n_log_n(cols + l_w[:, None]) - _n_log_n(cols)).sum(axis=0)
        rows, columns = base.sum(axis=1), cols.sum(axis=0)
        gain = row_gain + col_gain - (
            _n_log_n(rows + r_w.sum()) - _n_log_n(rows)) - (
            _n_log_n(columns + l_w.sum()) - _n_log_n(columns))
        best = int(np.argmax(gain))
        new = best if gain[best] > gain[old] + 1e-9 else old
        table[new, :] += r_w
        table[:, new] += l_w
        classes[word] = new
    return classes


def exchange_at_once(
    old: np.ndarray, left: np.ndarray, right: np.ndarray, pairs: np.ndarray
) -> np.ndarray:
    """New classes of words with the classes ``old``, by the gain of ``exchange`` over all classes
    of words, each word as if it were the only one that moves; only cells that are not 0 are
    looked at."""
    table, every = pairs.astype(np.float64), np.arange(len(old))
    gain = np.zeros((len(old), END))
    for own, other, cells in ((right, left, table), (left, right, table.T)):
        # cells[c, j]: bigrams of a word in class c with class j on the side of ``own``
        word, near = np.nonzero(own)
        n = own[word, near].astype(float)
        base = cells.T[near, :END]
        base[np.arange(len(n)), old[word]] -= n
        same = np.flatnonzero(near == old[word])
        base[same] -= other[word[same], :END]
        change = _n_log_n(base + n[:, None]) - _n_log_n(base)
        begin = np.searchsorted(word, every)
        some = np.diff(np.r_[begin, len(word)]) > 0
        gain[some] += np.add.reduceat(change, begin[some], axis=0)
        size = own.sum(axis=1).astype(float)
        sums = cells.sum(axis=1)[:END] - other[:, :END]
        sums[every, old] -= size
        gain -= _n_log_n(sums + size[:, None]) - _n_log_n(sums)
    best = np.argmax(gain, axis=1)
    return np.where(gain[every, best] > gain[every, old] + 1e-9, best, old)


def _sweep(batches, pairs: np.ndarray, ranked: np.ndarray):
    """(word, code, class, n) of all words of a partition, whose occurrences come sorted by word."""
    order = np.argsort(ranked)
    known = ranked[order]

    def moved(word: np.ndarray, cell: np.ndarray):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        n = np.diff(np.r_[first, len(word)])
        at = np.repeat(np.arange(len(first)), n) * TOTAL
        size = len(first) * TOTAL
        left = np.bincount(at + cell // TOTAL % TOTAL, minlength=size).reshape(-1, TOTAL)
        right = np.bincount(at + cell % TOTAL, minlength=size).reshape(-1, TOTAL)
        own = word[first].view(np.uint64)
        code = np.full(len(own), NUMBERED)
        if len(known):
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            code = np.where(known[place] == own, order[place], NUMBERED)
        new = exchange_at_once(cell[first] // TOTAL ** 2, left, right, pairs)
        return pa.RecordBatch.from_arrays(
            [pa.array(own.view(np.int64)), pa.array(code.astype(np.int32)),
             pa.array(new.astype(np.int32)), pa.array(n)], ["word", "code", "class", "n"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)))
        size += batch.num_rows
        if size < SWEEP_ROWS:
            continue
        word, cell = (np.concatenate(x) for x in zip(*held))
        last = int(np.searchsorted(word, word[-1]))  # the last word may go on
        if last:
            yield moved(word[:last], cell[:last])
        held, size = [(word[last:], cell[last:])], 0
    if held:
        yield moved(*(np.concatenate(x) for x in zip(*held)))


def first_classes(numbered: int) -> np.ndarray:
    """Classes before the first round: clustered words in turn by rank, bands by rank."""
    classes = np.full(NUMBERED + 2, RARE, np.int64)
    rank = np.arange(numbered)
    classes[:numbered] = rank % CLASSES
    if numbered > CLUSTERED:
        spread = np.log2((rank[CLUSTERED:] + 1) / CLUSTERED) / np.log2((NUMBERED + 1) / CLUSTERED)
        classes[CLUSTERED:numbered] = CLASSES + np.minimum(
            BANDS - 1, (spread * BANDS).astype(np.int64))
    classes[NUMBERED + 1] = END
    return classes


def log_transitions(pairs: np.ndarray) -> np.ndarray:
    """log10 P(class | class before): relative frequencies mixed with add-one class frequencies,
    the more the fewer times the class before was seen (by its number of followers)."""
    pairs = pairs.astype(float)
    single = (pairs.sum(axis=0) + 1) / (pairs.sum() + TOTAL)
    seen, kinds = pairs.sum(axis=1, keepdims=True), (pairs > 0).sum(axis=1, keepdims=True)
    return np.log10((pairs + np.maximum(kinds, 1) * single) / (seen + np.maximum(kinds, 1)))


def _paths(batches, classes, emission, base, unknown: tuple[float, float]):
    """Texts as classes (a byte per word), with the sums of what their words add to the scores.
    Of words without a number those of training come with pos, class and sums from the join."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            out: dict[str, list] = {k: [] for k in ("path", "n_known", "base", "words")}
            codes, found, base_more, words_more = (part.column(i).to_pylist() for i in (2, 3, 4, 5))
            for own, moved, more, gain in zip(codes, found, base_more, words_more, strict=True):
                code = np.frombuffer(own, "<u2").astype(np.int64)
                path = classes[code]
                rare = np.flatnonzero(code == NUMBERED)
                new = len(rare)
                if moved:
                    place, to = np.divmod(np.array(moved, np.int64), TOTAL)
                    path[rare[place]] = to
                    new -= len(moved)
                known = code[code < NUMBERED]
                out["path"].append(path.astype(np.uint8).tobytes())
                out["n_known"].append(len(code) - new)
                out["base"].append(float(base[known].sum()) + len(rare) * unknown[0] + (more or 0))
                out["words"].append(
                    float(emission[known].sum()) + new * unknown[1] + (gain or 0))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(out["path"], pa.binary()),
                 pa.array(out["n_known"], pa.int64()), pa.array(out["base"], pa.float64()),
                 pa.array(out["words"], pa.float64())], ["doc_id", "held_out", *out])


def _path(classes: bytes) -> np.ndarray:
    return np.r_[END, np.frombuffer(classes, np.uint8).astype(np.int64), END]


def _bigrams(batches):
    """(cell, n): class bigrams of all texts of a partition."""
    pairs = np.zeros(TOTAL * TOTAL, np.int64)
    for batch in batches:
        for classes in batch.column(0):
            path = _path(classes.as_py())
            pairs += np.bincount(path[:-1] * TOTAL + path[1:], minlength=len(pairs))
    hit = np.flatnonzero(pairs)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(pairs[hit])], ["cell", "n"])


def _score(batches, transition):
    for batch in batches:
        tokens, steps = [], []
        for classes in batch.column(2):
            path = _path(classes.as_py())
            tokens.append(len(path) - 1)
            steps.append(float(transition[path[:-1], path[1:]].sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), batch.column(3),
             batch.column(4), pa.array(steps, pa.float64()), batch.column(5)],
            ["doc_id", "held_out", "n_tokens", "n_known", "base", "steps", "words"])


def held_out_by_id(modulus: int = 7, remainder: int = 2):
    """crc32 of doc_id as text (null: the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus == remainder


def score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Train on the rows that are not held out and score every row of ``docs``.

    Returns doc_id, held_out, n_tokens (with the end), n_known, train_tokens, base_score (add-one
    unigrams), score (log10 probability of the class model) and perplexity. A token is known if it
    occurs in training; the end is known if there is any training row. Null and empty texts are an
    end only; repeated rows count and are scored each for itself; without training rows every
    token has base probability 1. An empty table gives no rows. Only doc_id and text are read.

    To the driver come the hashes, counts and classes of NUMBERED words, and tables of CLUSTERED
    words by class: bounded whatever the corpus. No word is left out of the clustering for it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    own = docs.select("doc_id", held_out_by_id().alias("held_out"), "text")
    counts = stage(own.where("NOT held_out").select("text").mapInArrow(
        _counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    n_docs = own.where("NOT held_out").count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                       F.count(F.lit(1)).alias("v")).first()
    tokens, kinds = total.n + n_docs, total.v + (n_docs > 0)
    top = counts.orderBy(F.col("n").desc(), "word").limit(NUMBERED).toArrow()
    word = top.column("word").to_numpy().view(np.uint64)
    uses = top.column("n").to_numpy().astype(float)
    rank = np.lexsort((word.view(np.int64), -uses))
    ranked, uses = word[rank], uses[rank]

    numbered = stage(own.mapInArrow(
        lambda batches: _number(batches, ranked),
        f"doc_id {kind}, held_out boolean, codes binary, rare array<long>"
    ).withColumn("row", F.monotonically_increasing_id()), "lm-numbered")
    train = numbered.where("NOT held_out").select("codes")
    clustered = min(CLUSTERED, len(ranked))

    def tables(classes: np.ndarray, words: int):
        rows = train.mapInArrow(
            lambda batches: _neighbours(batches, classes, words),
            "kind int, cell long, n long").groupBy("kind", "cell").agg(
            F.sum("n").alias("n")).toArrow()
        out = [np.zeros(words * TOTAL, np.int64), np.zeros(words * TOTAL, np.int64),
               np.zeros(TOTAL * TOTAL, np.int64)]
        which, cell, n = (rows.column(c).to_numpy() for c in ("kind", "cell", "n"))
        for k, table in enumerate(out):
            table[cell[which == k]] = n[which == k]
        return [t.reshape(-1, TOTAL) for t in out]

    classes = first_classes(len(ranked))
    for _ in range(rounds):
        classes = exchange(classes, *tables(classes, clustered))
    pairs = tables(classes, 0)[2]
    # all other words
    moved = stage(
        numbered.where("NOT held_out").select("codes", "rare").mapInArrow(
            lambda batches: _occurrences(batches, classes, clustered, ranked),
            "word long, cell int",
        ).repartition("word").sortWithinPartitions("word").mapInArrow(
            lambda batches: _sweep(batches, pairs, ranked),
            "word long, code int, class int, n long"), "lm-moved")
    middle = moved.where(F.col("code") < NUMBERED).select("code", "class").toArrow()
    settled = classes.copy()
    settled[middle.column("code").to_numpy()] = middle.column("class").to_numpy()
    rare_words = moved.where(F.col("code") == NUMBERED)

    # the rare class has room for one more word, any that is not in training; its words count as
    # seen once more
    more = np.zeros(TOTAL)
    more[RARE] = 1
    in_class = np.bincount(
        settled[:len(ranked)], weights=uses + more[settled[:len(ranked)]], minlength=TOTAL) + more
    for r in rare_words.groupBy("class").agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        in_class[r["class"]] += r["n"] + r["v"] * more[r["class"]]
    log_class = np.log10(np.maximum(in_class, 1))
    emission = np.log10(uses + more[settled[:len(ranked)]]) - log_class[settled[:len(ranked)]]
    base = np.log10((uses + 1) / (tokens + kinds + 1))
    none = (-np.log10(tokens + kinds + 1.0), -log_class[RARE])
    end = float(np.log10((n_docs + 1) / (tokens + kinds + 1)))

    own_class = F.col("class")
    costs = rare_words.select(
        "word", "class", F.log10(F.col("n") + 1).alias("base"),
        (F.log10(F.col("n") + F.when(own_class == RARE, 1).otherwise(0)) - F.element_at(
            F.array(*[F.lit(float(x)) for x in log_class]), own_class + 1)).alias("gain"))
    found = numbered.select("row", F.posexplode("rare").alias("pos", "word")).join(
        costs, "word").groupBy("row").agg(
        F.collect_list(F.col("pos").cast("long") * TOTAL + own_class).alias("moved"),
        F.sum("base").alias("more"), F.sum("gain").alias("gain"))
    paths = stage(
        numbered.select("row", "doc_id", "held_out", "codes").join(found, "row", "left").select(
            "doc_id", "held_out", "codes", "moved", "more", "gain"
        ).mapInArrow(
            lambda batches: _paths(batches, settled, emission, base, none),
            f"doc_id {kind}, held_out boolean, path binary, n_known long, base double, "
            "words double"), "lm-paths")
    bigrams = paths.where("NOT held_out").select("path").mapInArrow(
        _bigrams, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    follow = np.zeros(TOTAL * TOTAL, np.int64)
    follow[bigrams.column("cell").to_numpy()] = bigrams.column("n").to_numpy()
    transition = log_transitions(follow.reshape(-1, TOTAL))
    return paths.mapInArrow(
        lambda batches: _score(batches, transition),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, "
        "steps double, words double"
    ).select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + int(n_docs > 0)).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + end).alias("base_score"),
        (F.col("steps") + F.col("words")).alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))

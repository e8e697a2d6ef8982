"""Plain versions of the operators for small tables: rows are dicts of documents."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return [w.translate(UPPER) for w in words(text)]


def quality(rows, min_docs=20, share=0.02):
    hosts = Counter(r["source"] for r in rows)
    lines = defaultdict(int)
    for r in rows:
        for line in {" ".join(lowered(x)) for x in (r["text"] or "").split("\n")} - {""}:
            lines[r["source"], line] += 1
    out = []
    for r in rows:
        own = words(r["text"])
        grams = Counter(zip(own, own[1:], own[2:]))
        hit = set()
        for i, g in enumerate(zip(own, own[1:], own[2:])):
            if grams[g] > 1:
                hit |= {i, i + 1, i + 2}
        kept_lines, gone = [], 0
        for x in (r["text"] or "").split("\n"):
            norm = " ".join(lowered(x))
            if norm and lines[r["source"], norm] > max(min_docs, share * hosts[r["source"]]):
                gone += len(words(x))
            else:
                kept_lines.append(x)
        full = [x for x in (r["text"] or "").split("\n") if words(x)]
        failed = len(own) < 50 or 100 * len(hit) > 50 * len(own)
        kept = not failed and len(own) - gone >= 50 and gone <= 0.5 * len(own)
        out.append(dict(
            doc_id=r["doc_id"], n_words=len(own), word_chars=sum(map(len, own)),
            n_symbols=sum(c in "#*$%&|<>" for c in r["text"] or ""),
            n_dup_lines=len(full) - len(set(full)), n_repeat_words=len(hit), base_failed=failed,
            kept=kept, removed_words=gone, cleaned="\n".join(kept_lines) if gone else r["text"]))
    return out


def shingles(text):
    own = lowered(text)
    return {tuple(own[i:i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def components(rows):
    """component of each row, by position; the smallest doc_id, nulls last."""
    sets = [shingles(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r["doc_id"])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return [(len(sets[i]), low[find(i)]) for i in range(len(rows))]


def cut_repeats(rows, window=35):
    own = [words(r["text"]) for r in rows]
    starts = Counter(tuple(w[i:i + window]) for w in own for i in range(len(w) - window + 1))
    out = []
    for w in own:
        gone = set()
        for i in range(len(w) - window + 1):
            if starts[tuple(w[i:i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def mix(rows, weights=(5.0, 2.0, 1.0), cap=3):
    """(size, source_size, target, taken) by position of the row."""
    size = [len(words(r["text"])) for r in rows]
    total = defaultdict(int)
    for r, n in zip(rows, size):
        total[r["source"]] += n
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        left = sum(total.values()) - sum(target.values())
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > cap * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: float(cap * total[s]) for s in full}
        open_ -= full
    key = [hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()
           for r in rows]
    taken, before = [0] * len(rows), defaultdict(int)
    for i in sorted(range(len(rows)), key=lambda i: (key[i], size[i])):
        s = rows[i]["source"]
        goal = round(target[s])
        if total[s]:
            last = size[i] if 2 * (goal % total[s] - before[s]) >= size[i] else 0
            taken[i] = goal // total[s] * size[i] + last
        before[s] += size[i]
    return [(size[i], total[r["source"]], target[r["source"]], taken[i])
            for i, r in enumerate(rows)]


def crc(value):
    return zlib.crc32(("" if value is None else str(value)).encode())


def sha256(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()

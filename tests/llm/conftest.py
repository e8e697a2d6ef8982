import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, row long, fp long, "
          "n_words string, size string, ids string, start string, kept string, component string")


def prose(seed, n, vocabulary=4000):
    draw = random.Random(seed)
    return [f"{draw.choice('abcdeß')}{draw.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty, blank and long texts, copies, near copies, shared passages,
    frequent lines, ties and repeated rows."""
    passage, boiler = prose("passage", 60), " ".join(prose("line", 12))
    texts = [None, "", " \t\n ", "one", "one two three four five", "ONE two three FOUR five",
             "a " * 400, " ".join(prose("long", 20_000)), "#$% && <b>|</b>\n\n" * 30, "12 34\n12 34"]
    for i in range(40):
        base = prose(i, 90 + i)
        texts.append("\n".join([" ".join(base[:40]), boiler, " ".join(base[40:])]))
        near = base[:]
        near[7] = "changed"
        texts.append("\n".join([" ".join(near[:40]), boiler, " ".join(near[40:])]))
    for i in range(12):
        texts.append(" ".join(prose(f"p{i}", 50) + passage + prose(f"q{i}", 40)))
    texts += [texts[10]] * 6 + ["é漢 \U0001f600  tail x " + " ".join(prose("u", 60))]
    out = [dict(doc_id=i, text=t, lang=None if i % 9 == 0 else "en", n_chars=len(t or ""),
                source=[None, "a", "b", "b", "b", "c"][i % 6]) for i, t in enumerate(texts)]
    out += [out[12], out[12], out[0], dict(out[20], doc_id=None), dict(out[0], doc_id=None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """The rows with further columns whose names operators use themselves, over some files."""
    path = str(tmp_path_factory.mktemp("docs"))
    full = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"],
             7, 7, "x", "x", "x", "x", "x", "x") for r in rows]
    spark.createDataFrame(full, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.where("doc_id > 1000000")

"""Token ids in ORC: written in document order, read back stripe by stripe.

ORC keeps the ids of a stripe in run-length encoded integer streams; row indexes and Bloom filters
on doc_id let a reader skip stripes and row groups. Files follow each other in document order, so
the place of a document in the whole id sequence is the sum of what lies before it.
"""

from __future__ import annotations

import os
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .chunks import ENCODED_BYTES, ENCODED_ROWS, ChunkEncoder
from .common import new_path, stage, text_slices

#: Rows per entry of the row index, and bytes of a stripe before compression.
INDEX_ROWS = 1000
STRIPE_BYTES = 64 << 20


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def _encoder(path: str) -> ChunkEncoder:
    """The tokenizers library behind a memory of chunks. A chunk of Latin letters goes straight to
    the library's merge model. A text that holds an added token of the vocabulary goes to the
    library whole, which gives that token its own id."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread for each Spark task
    tokenizer = Tokenizer.from_file(path)
    added = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
    tokenize, letters = tokenizer.model.tokenize, _byte_letters()
    space = letters[0x20]

    def whole(texts: list[str]) -> list[bytes]:
        return [array("i", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
                for text in texts]

    def many(chunks: list[str]) -> list[bytes]:
        out: list[bytes | None] = []
        hard: list[int] = []
        for at, chunk in enumerate(chunks):
            body = chunk[1:] if chunk[0] == " " else chunk
            if body.isalpha() and (body.isascii() or max(body) < "ɐ"):
                if body.isascii():
                    shown = chunk if body is chunk else f"{space}{body}"
                else:
                    shown = chunk.encode().decode("latin-1").translate(letters)
                out.append(array("i", [t.id for t in tokenize(shown)]).tobytes())
            else:
                hard.append(at)
                out.append(None)
        made = tokenizer.encode_batch([chunks[at] for at in hard], add_special_tokens=False)
        for at, encoding in zip(hard, made, strict=True):
            out[at] = array("i", encoding.ids).tobytes()
        return out

    return ChunkEncoder(whole, many, unsplit=added)


def encode_ordered(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """doc_id, ids (with ``end_id`` behind each document), part and pos, in ascending doc_id order.

    Documents are range-partitioned by doc_id (nulls first), equal ids by a hash of their text, so
    that one id may hold any share of the rows; the text is encoded after that shuffle. Null and
    empty texts have the end id only. Columns other than doc_id and text are not looked at.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder, part, pos = _encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in text_slices(batch, 1, ENCODED_ROWS, ENCODED_BYTES):
                n = piece.num_rows
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), encoder.encode_all(piece.column(1), end_id),
                     pa.array([part] * n, pa.int32()), pa.array(np.arange(pos, pos + n))],
                    ["doc_id", "ids", "part", "pos"])
                pos += n

    ordered = (
        docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
        .repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    return ordered.mapInArrow(run, f"doc_id {kind}, ids array<int>, part int, pos long")


def write_orc(tokens: DataFrame, path: str) -> None:
    """Write in the order given: one file per partition, indexed and Bloom-filtered by doc_id."""
    (
        tokens.write.option("orc.create.index", "true")
        .option("orc.row.index.stride", str(INDEX_ROWS))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.compress", "LZ4").orc(path)
    )


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    """Read in splits of stripes; a filter on doc_id skips stripes and row groups by metadata."""
    return spark.read.orc(path)


def _sums(batches):
    for batch in batches:
        lists = batch.column(3)
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")
        ends = lists.offsets.to_numpy()
        raw = memoryview(values).cast("B")
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends), pa.int64()),
             pa.array([zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(ends, ends[1:])], pa.int64())],
            ["doc_id", "part", "pos", "n_tokens", "ids_crc32"])


def positions(tokens: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of stored tokens.

    Running sums are taken within a part; one row per part carries the sum of the parts before.
    """
    kind = tokens.schema["doc_id"].dataType.simpleString()
    sums = stage(
        tokens.select("doc_id", "part", "pos", "ids").mapInArrow(
            _sums, f"doc_id {kind}, part int, pos long, n_tokens long, ids_crc32 long"),
        "token-sums")
    parts = sums.groupBy("part").agg(F.sum("n_tokens").alias("ids_in_part")).select(
        "part", (F.sum("ids_in_part").over(Window.orderBy("part")) - F.col("ids_in_part")).alias(
            "before"))
    own = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("pos")) - F.col("n_tokens")
    return sums.withColumn("own", own).join(parts, "part").select(
        "doc_id", (F.col("before") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def store_and_locate(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` as ORC token files in the shared folder, read them back, and locate every
    document. An empty table gives no rows; repeated rows are stored each for itself."""
    spark = docs.sparkSession
    path = new_path(spark, "token-ids")
    write_orc(encode_ordered(docs, tokenizer_path, end_id), path)
    return positions(read_orc(spark, path))

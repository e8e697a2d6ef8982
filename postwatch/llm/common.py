"""What the operators of this package share: staged tables, row identity, words, Arrow passes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the space and U+0009 to U+000D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows, and bytes of text, that one Python step holds at a time.
SLICE_ROWS, SLICE_BYTES = 256, 2 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    A temporary folder stands in where it is unset, on a local master only.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="postwatch-llm-")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it: cuts the lineage, outlives lost
    executors, and fixes what was drawn per row (row numbers of a partition)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession, group: str) -> None:
    """Remove the tables that were staged under names ``group/...``, once what is made of them has
    been written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{group}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fingerprint(*columns: str) -> Column:
    """Tells rows of one doc_id apart; rows that agree in it are copies with equal results."""
    return F.xxhash64(*(F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in columns))


def doc_key() -> Column:
    """doc_id as a value that plain equality joins on; null is a key of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and source of ``docs`` only, so that other columns cannot clash; with ``fp``."""
    return docs.select("doc_id", "text", "source", fingerprint("text", "source").alias("fp"))


def split_words(text: str | None) -> list[bytes]:
    """The words in UTF-8: ``bytes.split`` cuts at exactly U+0020 and U+0009 to U+000D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts; partition counts follow it, whatever ``docs`` is made of."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def text_slices(
    batch: pa.RecordBatch, column: int, rows: int = SLICE_ROWS, size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``rows`` rows and about ``size`` bytes of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(
        zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        room = (ends[start - 1] if start else 0) + size
        stop = int(np.searchsorted(ends, room, side="right"))
        stop = max(start + 1, min(stop, start + rows, batch.num_rows))
        yield batch.slice(start, stop - start)
        start = stop


def release_memory() -> None:
    """Give back to the system what this process holds and does not use: idle Python workers stay
    beside the busy ones."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task; then its memory goes back to the system."""
    def whole(batches: Iterator) -> Iterator:
        release_memory()
        yield from run(batches)
        release_memory()

    return whole


def map_slices(
    df: DataFrame, step: Callable[..., dict[str, list]], schema: str, *setup: object
) -> DataFrame:
    """Pass ``df`` in slices of at most SLICE_ROWS rows, as lists by column, to ``step``.

    ``step(columns, *setup)`` returns lists by the columns of ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                columns = {n: part.column(i).to_pylist() for i, n in enumerate(names)}
                made = step(columns, *setup)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(made[f.name], type=f.type) for f in target], schema=target
                )

    return df.mapInArrow(tidy(run), schema)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges (rows of two) of a spanning forest of the graph with the edges (a, b)."""
    both, edges = np.argsort(np.r_[a, b], kind="stable"), []
    tip, ends = np.r_[a, b][both], np.r_[b, a][both]
    begin = np.searchsorted(tip, np.arange(n + 1))
    seen = np.zeros(n, bool)
    for root in np.unique(tip):
        if seen[root]:
            continue
        seen[root], waiting = True, [root]
        while waiting:
            at = waiting.pop()
            near = ends[begin[at]:begin[at + 1]]
            near = np.unique(near[~seen[near]])
            seen[near] = True
            edges += [(int(at), int(x)) for x in near]
            waiting += near.tolist()
    return np.array(edges, np.int64).reshape(-1, 2)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplekit.sources.shared import shared_folder

TRIMMED = 4  # slices after which memory is given back
#: A-Z to a-z; all other bytes stay.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: this cuts its lineage and survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shipped(path: str) -> str:
    """Where a file that the driver sent with addFile lies on this machine; the path itself where it wasn't sent."""
    own = SparkFiles.get(os.path.basename(path))
    return own if os.path.exists(own) else path


def id_and_bytes(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only what an operator reads, under its own names, so that further columns can't clash; a null text is empty."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"),
        *[F.col(c) for c in more],
    )


def keyed_rows(docs: DataFrame) -> DataFrame:
    """row, the whole row of docs as a struct, so that no name of a helper's can clash with one of its columns, and r1, r2, 128 bits of all columns: rows alike in all of them are one, others are not."""
    columns = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in docs.columns]
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(*columns).alias("r1"), F.xxhash64(F.lit(1), *columns).alias("r2"))


_libc = ctypes.CDLL(None)


def give_back() -> None:
    """Hands memory that this worker no longer uses back to the system: Arrow's, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


#: What operators remember in a Python worker from one task to the next.
_remembered: list[dict] = []


def remembered() -> dict:
    """A cache of one operator in each Python worker."""
    _remembered.append({})
    return _remembered[-1]


def keep_only(own: dict | None) -> None:
    """Empties what other operators have remembered in this worker: workers outlive the stage that they began with."""
    others = [c for c in _remembered if c and c is not own]
    for cache in others:
        cache.clear()
    if others:
        give_back()


def slices(batches: Iterable[pa.RecordBatch], column: str = "body", limit: int = 8 << 20, own: dict | None = None) -> Iterator[pa.RecordBatch]:
    """Batches cut so that one holds about limit bytes of text, however long its documents are. Every TRIMMED of them, and after the last one, the worker gives back what it no longer needs;
    what operators have remembered goes at the start, but for own."""
    keep_only(own)
    done = 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        low = 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(low, high - low)
            low, done = high, done + 1
            if done % TRIMMED == 0:
                give_back()
    give_back()


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Exclusive prefix sums, one more than lengths has."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs [start, start + length), one after the other."""
    offsets = starts_of(lengths)
    return np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)

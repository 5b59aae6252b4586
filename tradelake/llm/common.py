"""Shared pieces of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A word is a maximal run of characters other than space, tab, line feed, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


SEPARATOR = re.compile(rb"[\x20\x09-\x0D]")


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes that end where a word ends."""
    at = 0
    while at < len(data):
        border = SEPARATOR.search(data, at + size)
        end = border.start() if border else len(data)
        yield data[at:end]
        at = end


def lean(task: Callable) -> Callable:
    """``task`` (batches to batches), giving its memory back to the system when it ends: Python
    workers live on beside the executor's heap and would keep it for later stages."""

    def run(batches):
        try:
            yield from task(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return run


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder of ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def pinned(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps reread the files when an
    executor is lost, and a plan used twice is computed once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32(doc_id as text) mod 5 is 0 are never learned from.  A null doc_id
    counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))

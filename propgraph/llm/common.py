"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import cut, lookup, shared_folder

__all__ = ["SPACES", "WORD", "cut", "held_out", "lookup", "lean", "n_words", "read", "shared_folder", "tidy", "words"]

#: Words are runs of characters other than these: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACES}]+"
#: Bytes of a batch that a kernel is given at once, unless one row has more.
PIECE = 4 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of ``text``; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), f"[{SPACES}]+")
    return F.filter(parts, lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's decimal digits leaves ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


@functools.cache
def _trim() -> Callable[[int], int] | None:
    """The C library's call that returns free memory to the system, where it has one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):
        return None


def tidy() -> None:
    """Return to the system what Python's libraries hold free; workers and the driver live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def pieces(batch: pa.RecordBatch, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """All rows of ``batch`` in order, in parts of ``most`` bytes or of one row."""
    half = batch.num_rows // 2
    if not half or batch.nbytes <= most:
        yield batch
    else:
        yield from pieces(batch.slice(0, half), most)
        yield from pieces(batch.slice(half), most)


def lean(kernel: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]) -> Callable:
    """``kernel`` for ``mapInArrow`` over small parts of each batch; what it frees goes back after every part's rows and at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for out in kernel(part for batch in batches for part in pieces(batch)):
                yield out
                del out
                tidy()
        finally:
            tidy()

    return run

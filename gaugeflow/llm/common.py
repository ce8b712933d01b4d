"""Helpers that the corpus operators share: staged tables, text buffers, table readers."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import table  # noqa: F401  the operators' queries read their tables with it
from ..sources.staging import Staged, staged  # noqa: F401  and write their stages

#: White space as the corpus contracts define it.
SPACE = " \t\n\x0b\f\r"


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished phases: it does so once the driver has
    collected the objects that stand for them, which a small driver otherwise rarely does."""
    gc.collect()
    spark._jvm.System.gc()


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches, limit: int = 8 << 20):
    """Record batches cut so that one holds about `limit` bytes at most (or a single row)."""
    for batch in batches:
        step = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def in_split(key, modulus: int, remainder: int):
    """crc32 of the id's text, modulo `modulus`, equals `remainder`; a null id counts as ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def uint64(values) -> np.ndarray:
    return np.asarray(values, dtype=np.uint64)

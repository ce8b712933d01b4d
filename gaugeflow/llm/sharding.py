"""Sharding by jump consistent hashing: stable keys to shards without a ring table."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

#: Fixed values of the jump hash: its multiplier and the span of its draw.
STEP, SPAN = 2862933555777941757, float(1 << 31)


def jump_hash(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each key, and its shard when one more is appended."""
    with np.errstate(over="ignore"):
        key = keys.astype(np.uint64)
        last, ahead = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
        live = np.arange(len(key))
        while live.size:
            last[live] = ahead[live]
            key[live] = key[live] * np.uint64(STEP) + np.uint64(1)
            draw = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
            ahead[live] = ((last[live] + 1) * (SPAN / draw)).astype(np.int64)
            live = live[ahead[live] < shards]
    # The next jump lands on the appended shard or passes it.
    return last, np.where(ahead == shards, shards, last)


def _placer(shards: int):
    @F.pandas_udf("shard int, grown int, mix long")
    def place(key: pd.Series) -> pd.DataFrame:
        keys = key.to_numpy(np.int64).view(np.uint64)
        shard, grown = jump_hash(keys, shards)
        with np.errstate(over="ignore"):
            mix = keys * np.uint64(STEP) + np.uint64(1)
            mix = (mix * np.uint64(STEP) + np.uint64(1)) >> np.uint64(1)
        return pd.DataFrame({"shard": shard.astype(np.int32), "grown": grown.astype(np.int32), "mix": mix.view(np.int64)})

    return place


def shard_rows(df: DataFrame, key: str, shards: int, ties: list[str], chunk_rows: int = 20_000) -> DataFrame:
    """`df` with shard, grown_shard and slot.

    An integral key is hashed as it is, any other by XXH64; a null key counts as 0. Rows with
    equal keys share a shard. slot numbers a shard's rows from 0 without gaps, in the order of a
    second mix of the key, then the key and `ties`; rows equal in all of these take slots in any
    order. The order is cut at high bits of the mix into chunks of about `chunk_rows`, numbered
    apart and offset by the counts of earlier chunks, so that no shard passes through one task.
    An empty table gives no rows; columns named shard, grown_shard or slot are replaced.
    """
    df = df.drop("shard", "grown_shard", "slot")
    kind = dict(df.dtypes)[key]
    number = F.col(key).cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(key)
    number = F.when(F.col(key).isNull(), F.lit(0)).otherwise(number)
    rows = staged(df.withColumn("_at", _placer(shards)(number)), "shards")
    bits = max(0, math.ceil(math.log2(max(1, rows.count() / (shards * chunk_rows)))))
    rows = rows.withColumn("_chunk", F.shiftright("_at.mix", 63 - bits) if bits else F.lit(0).cast("long"))
    sizes = rows.groupBy(F.col("_at.shard").alias("shard"), "_chunk").count()
    before = Window.partitionBy("shard").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("shard").alias("_shard"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_at.shard", "_chunk").orderBy("_at.mix", key, *ties)
    local = rows.withColumn("_row", F.row_number().over(inside))
    joined = local.join(starts, (F.col("_at.shard") == F.col("_shard")) & (F.col("_chunk") == F.col("_c")))
    return joined.select(
        *df.columns,
        F.col("_at.shard").alias("shard"),
        (F.col("_start") + F.col("_row") - 1).cast("long").alias("slot"),
        F.col("_at.grown").alias("grown_shard"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Places documents by doc_id; only id, size and checksum leave the scan."""
    text = F.coalesce("text", F.lit(""))
    small = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return shard_rows(small, "doc_id", shards, ["text_crc32", "size"])

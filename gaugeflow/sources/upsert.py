"""Keyed tables that batches are merged into: rewritten by bucket, once per batch."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import exists, hadoop_path


class Upsert:
    """A table at `path` with one row per key, which `apply` merges batches into.

    `last` columns take the value written last (nulls count), `first` columns keep the one of the
    row that created the key, and of `maps` columns each entry is the one written last. What a
    batch writes comes after all earlier batches; inside a batch `order` decides, which should
    tell rows of a key apart.

    Rows lie in `buckets` folders by a hash of the key, and a batch rewrites the folders that it
    touches, no others. It does so by Spark's dynamic partition overwrite, which reads the old rows of these folders,
    writes the merged ones aside and swaps them in when the job commits. Then the batch's number is
    recorded. A batch that is recorded changes nothing when it comes again; one that wasn't, as the
    writer ended before, is merged again with the same result, since its values are what they are and
    the first row's columns are there already. One writer at a time. Rows with a null in their key
    have no key and are left out.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], last: list[str] = (), first: list[str] = (), maps: list[str] = (), buckets: int = 64):
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), keys, order
        self.last, self.first, self.maps, self.buckets = list(last), list(first), list(maps), buckets
        self._check_shape()

    def _check_shape(self) -> None:
        """The shape of the table is fixed by its first writer; another one is an error."""
        shape = json.dumps({"keys": self.keys, "last": self.last, "first": self.first, "maps": self.maps, "buckets": self.buckets})
        at = f"{self.path}/_shape"
        if exists(self.spark, at):
            found = self.spark.read.text(at).first()[0]
            if found != shape:
                raise ValueError(f"the table at {self.path} is {found}, not {shape}")
        else:
            self.spark.createDataFrame([(shape,)], "value string").coalesce(1).write.text(at)

    def _data(self) -> str:
        return f"{self.path}/rows"

    def read(self) -> DataFrame:
        """The table as it stands; not there before the first batch."""
        return self.spark.read.parquet(self._data()).drop("_bucket")

    def applied(self, batch: int) -> bool:
        return exists(self.spark, f"{self.path}/_batches/{batch}")

    def _record(self, batch: int) -> None:
        at, fs = hadoop_path(self.spark, f"{self.path}/_batches/{batch}")
        fs.create(at, True).close()

    def merged(self, rows: DataFrame) -> DataFrame:
        """One row per key of `rows` (with `_new`, which says whether a row is of the batch)."""
        when = F.struct("_new", *self.order)
        aggregates = [F.max_by(c, when).alias(c) for c in self.last] + [F.min_by(c, when).alias(c) for c in self.first]
        kept = [F.max(when).alias("_at")]
        out = rows.groupBy(*self.keys).agg(*aggregates, *kept)

        def entries(name: str) -> DataFrame:
            # Entry by entry, so that a key with very many rows is pre-aggregated as any other.
            each = rows.select(*self.keys, when.alias("_when"), F.explode(name).alias("_k", "_v"))
            each = each.groupBy(*self.keys, "_k").agg(F.max_by("_v", "_when").alias("_v"))
            return each.groupBy(*self.keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(name))

        def with_map(df: DataFrame, name: str) -> DataFrame:
            none = F.create_map().cast(rows.schema[name].dataType)
            return df.join(entries(name), self.keys, "left").withColumn(name, F.coalesce(name, none))

        out = reduce(with_map, self.maps, out)
        return out.select(*self.keys, *self.last, *self.first, *self.maps, *(F.col("_at")[o].alias(o) for o in self.order if o not in self.keys + self.last + self.first))

    def apply(self, rows: DataFrame, batch: int) -> bool:
        """Merges a batch; false if it had been before."""
        if self.applied(batch):
            return False
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        names = list(dict.fromkeys([*self.keys, *self.order, *self.last, *self.first, *self.maps]))
        new = rows.dropna(subset=self.keys).select(*names).withColumn("_bucket", bucket).withColumn("_new", F.lit(1))
        touched = sorted(r[0] for r in new.select("_bucket").distinct().collect())  # `buckets` at most
        if touched:
            if exists(self.spark, self._data()):
                old = self.spark.read.parquet(self._data()).filter(F.col("_bucket").isin(touched)).withColumn("_new", F.lit(0))
                new = new.unionByName(old.select(new.columns))
            out = self.merged(new.drop("_bucket")).withColumn("_bucket", bucket)
            out.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self._data())
        self._record(batch)
        return True

    def stream(self, rows: DataFrame, checkpoint: str):
        """Starts a stream into the table; a query that begins again at its checkpoint repeats its last batch
        under the same number."""
        return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, batch: self.apply(df, batch) and None)


def state_table(spark: SparkSession, path: str, order: list[str], buckets: int = 64) -> Upsert:
    """Key/value state: the value written last, with the time of it."""
    return Upsert(spark, path, ["key"], order, last=["value"], buckets=buckets)


def session_table(spark: SparkSession, path: str, order: list[str], buckets: int = 64) -> Upsert:
    """Sessions, one per date and kind: the first row gives id, time and device; answers are merged, later ones winning."""
    return Upsert(spark, path, ["session_date", "kind"], order, first=["id", "captured_at", "device"], maps=["covariates"], buckets=buckets)


def lock_rows(angle: Column, day: Column) -> Column:
    """The three entries of state that locking an angle writes, as (key, value) structs."""
    pairs = (("angle_locked", F.lit("1")), ("locked_angle_deg", angle.cast("string")), ("angle_locked_at", F.date_format(day, "yyyy-MM-dd")))
    return F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs))

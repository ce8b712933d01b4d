"""Tables written once to the shared folder, where lineage ends."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def hadoop_path(spark: SparkSession, path: str):
    """A path of any store that Spark reaches, and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = hadoop_path(spark, path)
    return fs.exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    at, fs = hadoop_path(spark, path)
    fs.delete(at, True)


def stage_root(spark: SparkSession) -> str:
    """The application's folder for staged tables, in spark.checkpoint.dir where that is set, else
    in the warehouse (on a cluster) or in a folder of this machine (local master only). It is
    deleted when the driver's Python ends; `drop_stages` does so before."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if shared:
            base = shared.rstrip("/")
        elif not (spark.sparkContext.master or "").startswith("local["):
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
        else:
            base = tempfile.mkdtemp(prefix="spark-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        _ROOTS[app] = f"{base}/stages-{app}"
        atexit.register(_drop_quietly, spark, _ROOTS[app])
    return _ROOTS[app]


def _drop_quietly(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may have ended before
        _delete(spark, path)


def drop_stages(spark: SparkSession) -> None:
    """Deletes all staged tables of the application. Call it when the results that rest on them are
    written: DataFrames of operators read staged tables until then."""
    _delete(spark, stage_root(spark))


class Staged:
    """A table written once to the shared folder; a lost executor costs only the tasks that read it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = f"{stage_root(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files; call it only when no DataFrame that reads them will run again."""
        _delete(self.spark, self.path)


def staged(df: DataFrame, name: str) -> DataFrame:
    return Staged(df, name).df


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by key over spark.sql.shuffle.partitions tasks, which adaptive execution leaves as many as they
    are: for groups whose work is heavy against their bytes, which it would put together in few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)

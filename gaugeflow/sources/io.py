"""Readers of the JSON and binary inputs and write-once sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exif import exif
from .schemas import CONTROL_POINTS, EXPORT, IMAGES, SESSIONS
from .staging import Staged


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """One row per image of a workspace export; its bytes decoded strictly (else null), its scale as a number, and in
    `scale_kind` what it was (a truth value or text is no scale)."""
    doc = spark.read.schema(EXPORT).option("multiLine", True).json(path)
    image = doc.select("schema", F.col("profile_id").alias("owner"), F.explode("images").alias("i")).select("schema", "owner", "i.*")
    kind, scale = F.schema_of_variant("px_per_mm"), F.try_variant_get("px_per_mm", "$", "double")
    image = image.withColumn("scale_kind", F.when(F.col("px_per_mm").isNotNull(), kind)).withColumn("px_per_mm", scale)
    return image.withColumn("content", F.try_to_binary("bytes", F.lit("base64"))).drop("bytes")


def export_faults(spark: SparkSession, path: str) -> DataFrame:
    """(path, reasons) of the exports at a path that can't be taken at all: of another version, without a
    profile, without images, or no JSON of this kind."""
    doc = spark.read.schema(EXPORT).option("multiLine", True).json(path)
    rules = {"schema": F.col("schema") == 1, "profile": F.length("profile_id") > 0, "images": F.size("images") > 0}
    why = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return doc.select(F.col("_metadata.file_path").alias("path"), why.alias("reasons")).filter(F.size("reasons") > 0)


def write_export(images: DataFrame, path: str) -> None:
    """One JSON document per profile (owner), as `read_export` reads it; once. A profile is held to 200 MB when photos
    are added, so its document fits a task."""
    fields = [f for f in ("id", "profile_id", "date", "pose", "kind", "width", "height", "sha256")]
    image = F.struct(*fields, F.base64("content").alias("bytes"), "px_per_mm", "reviewed", "labels")
    docs = images.groupBy(F.col("owner").alias("profile_id")).agg(F.array_sort(F.collect_list(F.struct("id", image.alias("i")))).alias("t"))
    docs.select(F.lit(1).alias("schema"), "profile_id", F.transform("t", lambda t: t["i"]).alias("images")).write.mode("errorifexists").option("maxRecordsPerFile", 1).json(path)


def write_report(rows: DataFrame, path: str) -> None:
    """A JSON document per row, once, numbers without a value left out; NaN isn't written."""
    nans = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in rows.dtypes]
    rows.select(*nans).write.mode("errorifexists").json(path)


def first_by_id(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of an id, one at most."""
    return rows.filter(F.col(key) == value).limit(1)


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The tables of a new store, typed, as views of the session: sessions and images."""
    out = {"sessions": spark.createDataFrame([], SESSIONS), "images": spark.createDataFrame([], IMAGES)}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def read_model(spark: SparkSession, path: str, architecture: str):
    """The card of a model folder, a row, if it is of the architecture and its weights have the stated SHA-256; else an error."""
    card = spark.read.schema("architecture STRING, profile_id STRING, pose STRING, dataset_hash STRING, weights_hash STRING, threshold DOUBLE, splits MAP<STRING, ARRAY<STRING>>, status STRING").option("multiLine", True).json(f"{path}/model.json").first()
    found = spark.read.format("binaryFile").option("pathGlobFilter", "weights*").load(path).select(F.sha2("content", 256).alias("sha")).first()
    if card is None or card.architecture != architecture or found is None or found.sha != card.weights_hash:
        raise ValueError(f"no model of {architecture} with its own weights at {path}")
    return card


def read_control_points(spark: SparkSession, path: str) -> DataFrame:
    """(image, id, x, y); a file that isn't JSON of this kind gives no rows, nor does a path that
    doesn't exist."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at):
        return spark.createDataFrame([], "image string, id int, x double, y double")
    doc = spark.read.schema(CONTROL_POINTS).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return doc.select("image", F.explode("points").alias("p")).select("image", "p.id", F.col("p.x_px").alias("x"), F.col("p.y_px").alias("y"))


def read_images(spark: SparkSession, path: str, glob: str = "*.{jpg,jpeg,png,webp,heic,tif}") -> DataFrame:
    """Content, length and identity (SHA-256) of image files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def write_control_points(points: DataFrame, path: str) -> None:
    """One JSON document per image, in a file of its own, ids sorted, coordinates to two places."""
    point = F.struct("id", F.bround("x", 2).alias("x_px"), F.bround("y", 2).alias("y_px"))
    points.groupBy("image").agg(F.array_sort(F.collect_list(point)).alias("points")).write.mode("errorifexists").option("maxRecordsPerFile", 1).json(path)


def write_once(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def control_point_roster(spark: SparkSession, path: str) -> DataFrame:
    """All ids that any control-point file under the path names."""
    return read_control_points(spark, path).select("id").distinct()


def image_facts(files: DataFrame) -> DataFrame:
    """`read_images` with the tags of each file and its orientation (1 where there is none)."""
    tagged = files.withColumn("exif", exif("content"))
    return tagged.withColumn("orientation", F.coalesce(F.try_element_at("exif", F.lit("Orientation")).cast("int"), F.lit(1)))


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """One JSON document per split, once (see `sessions.split_manifest`)."""
    manifest.write.mode("errorifexists").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(split, day) of a written manifest."""
    doc = spark.read.schema("split STRING, dates ARRAY<DATE>, n_dates BIGINT").json(path)
    return doc.select("split", F.explode("dates").alias("day"))


class Rejected(ValueError):
    pass


def write_if_valid(judged: DataFrame, path: str) -> None:
    """Writes rows (with their `reasons`) once, and only if none has a reason: all or nothing. They are judged
    once, into a stage, from which both the check and the write read."""
    stage = Staged(judged, "judged")
    why = stage.df.filter(F.size("reasons") > 0).groupBy("reasons").count().collect()  # combinations of the rules' names
    if why:
        counts: dict[str, int] = {}
        for r in why:
            for name in r["reasons"]:
                counts[name] = counts.get(name, 0) + r["count"]
        stage.drop()
        raise Rejected(f"{sum(r['count'] for r in why)} rows rejected: " + ", ".join(f"{k} {n}" for k, n in sorted(counts.items())))
    stage.df.drop("reasons", "verdict").write.mode("errorifexists").parquet(path)
    stage.drop()

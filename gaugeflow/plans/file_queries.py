"""Registered queries that go through files and image kernels, with their DuckDB equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import registration, robust, sessions, splits, validation
from ..sources import io
from ..sources.io import table
from ..sources.staging import stage_root
from .queries import RATIO, day, query


def _folder(spark, name: str) -> str:
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT c_nationkey::VARCHAR AS image, c_custkey::INTEGER AS id, round_even(c_acctbal / 7, 2) AS x, round_even(c_custkey / 3.0::DOUBLE, 2) AS y FROM customer""")
def control_point_files(spark, d):
    """Control points written as a JSON document per image, to two places, and read again."""
    path = _folder(spark, "points")
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("image"), F.col("c_custkey").cast("int").alias("id"), (F.col("c_acctbal") / 7).alias("x"), (F.col("c_custkey") / 3).alias("y"))
    io.write_control_points(c, path)
    return io.read_control_points(spark, path)


@query(f"WITH {RATIO} SELECT split, d AS day FROM plan")
def manifest_files(spark, d):
    """A split's manifest, one document per part, written once and read again."""
    path = _folder(spark, "manifest")
    plan = splits.ratio_split(table(spark, d, "orders").select(day("o_orderdate").alias("d")), "d", (0.7, 0.15, 0.15), 3)
    io.write_manifest(sessions.split_manifest(plan, "d"), path)
    return io.read_manifest(spark, path)


@query("""WITH p AS (SELECT p_partkey, p_partkey // 20 AS profile, CASE WHEN p_partkey % 6 = 0 THEN 'own ' || p_partkey WHEN p_partkey % 5 = 0 THEN 'same' ELSE 'bytes ' || p_partkey END AS content, p_size FROM part),
t AS (SELECT *, count(*) OVER (PARTITION BY profile, content) AS twins FROM p)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN twins > 1 THEN 'unique_bytes' END, CASE WHEN p_partkey % 7 = 0 THEN 'date' END, CASE WHEN p_partkey % 6 = 0 THEN 'bytes' END, CASE WHEN p_partkey % 8 = 0 THEN 'scale' END, CASE WHEN p_size > 45 THEN 'labels' END, 'oriented_size'], lambda x: x IS NOT NULL), ',') AS reasons FROM t""")
def export_files(spark, d):
    """Exports of twenty photos a profile, written as JSON with their bytes, read again and judged; the bytes aren't images."""
    k = F.col("p_partkey")
    content = F.when(k % 5 == 0, "same").otherwise(F.concat(F.lit("bytes "), k.cast("string"))).cast("binary")
    sha = F.when(k % 6 == 0, F.concat(F.lit("wrong "), k.cast("string"))).otherwise(F.sha2(content, 256))
    label = F.struct((F.col("p_size") + 4.0).alias("x"), F.lit(2.0).alias("y"), F.lit(1.0).alias("radius"))
    owner = F.floor(k / 20).cast("string")
    images = table(spark, d, "part").select(
        owner.alias("owner"), k.cast("string").alias("id"), owner.alias("profile_id"), F.when(k % 7 == 0, "2026-02-30").otherwise("2026-02-03").alias("date"), F.lit("frontal").alias("pose"), F.lit("session").alias("kind"),
        F.lit(50).alias("width"), F.lit(40).alias("height"), sha.alias("sha256"), content.alias("content"), F.when(k % 8 == 0, -1.0).otherwise(4.0).alias("px_per_mm"), F.lit(True).alias("reviewed"), F.array(label).alias("labels"),
    )
    path = _folder(spark, "export")
    io.write_export(images, path)
    read = io.read_export(spark, path)
    return validation.export_reasons(read, F.col("schema")).select(F.col("id").cast("long").alias("p_partkey"), F.array_join("reasons", ",").alias("reasons"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 5 AS x0, p_partkey % 4 AS y0, 1 + p_size % 4 AS w, 1 + p_size % 3 AS h FROM part)
SELECT p_partkey, 2 * (w * h >= 2)::INT + 1 AS n, CASE WHEN w * h >= 2 THEN round(x0 + (w - 1) / 2.0::DOUBLE, 6) ELSE 13.5 END AS first_x, CASE WHEN w * h >= 2 THEN round(y0 + (h - 1) / 2.0::DOUBLE, 6) ELSE 14.0 END AS first_y FROM p""")
def mask_centroids(spark, d):
    """Masks of 16 x 16 pixels with two blocks of a size, which may be too small, and a bar: how many regions there are, and the first one's middle."""
    k, s = F.col("p_partkey"), F.col("p_size")
    x0, y0, w, h = k % 5, k % 4, 1 + s % 4, 1 + s % 3
    i, j = lambda p: p % 16, lambda p: F.floor(p / 16)
    block = lambda p, x, y: (i(p) >= x) & (i(p) < x + w) & (j(p) >= y) & (j(p) < y + h)
    on = lambda p: block(p, x0, y0) | block(p, x0 + 1, y0 + 8) | ((j(p) == 14) & (i(p) >= 13) & (i(p) <= 14))
    pixels = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda p: F.when(on(p), 0.9).otherwise(0.1))
    m = table(spark, d, "part").select("p_partkey", kernels.mask_centers(pixels, F.lit(16), F.lit(0.5)).alias("c"))
    return m.select("p_partkey", F.size("c").cast("long").alias("n"), F.round(F.col("c")[0]["x"], 6).alias("first_x"), F.round(F.col("c")[0]["y"], 6).alias("first_y"))


@query("""WITH c AS (SELECT c_custkey, (c_custkey % 11 - 5) / 5.0::DOUBLE AS a FROM customer), r AS (SELECT unnest(['front', 'back']) AS region, unnest([1, -1]) AS side)
SELECT c_custkey, region, 20 AS n, side * round(1 / sqrt(1 + a * a), 6) AS least, side * round(1 / sqrt(1 + a * a), 6) AS most, CASE WHEN side = 1 THEN 'visible' ELSE 'occluded' END AS status FROM c, r""")
def surface_facing(spark, d):
    """Every customer is a slab, tilted by its key: its front of 20 landmarks faces the viewer by the cosine of the tilt, its back turns away as far."""
    a, id = (F.col("c_custkey") % 11 - 5) / 5, F.col("id")
    back = id >= 20
    n = id % 20
    x, y = (n % 5).cast("double"), F.floor(n / 5).cast("double")
    marks = table(spark, d, "customer").withColumn("id", F.explode(F.sequence(F.lit(0), F.lit(39)))).select(F.col("c_custkey").alias("image"), "id", x.alias("x"), y.alias("y"), (a * x + F.when(back, 60.0).otherwise(0.0)).alias("z"))
    turned = robust.facing(marks, "image")
    regions = spark.range(40).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") >= 20, "back").otherwise("front").alias("region"))
    ends = F.round(F.min("facing"), 6).alias("least"), F.round(F.max("facing"), 6).alias("most")
    shares = robust.visible_shares(turned, regions, "image", *ends)
    return shares.select(F.col("image").alias("c_custkey"), "region", "n", "least", "most", registration.visibility(F.col("share")).alias("status"))

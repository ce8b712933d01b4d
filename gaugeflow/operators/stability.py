"""How steady landmarks are over frames of one scene, once each frame's own pose is taken out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import mapped
from ..sources.staging import by_key, staged
from .registration import landmark_spread
from .robust import least_median_of

#: Landmarks of the rigid middle of the face that poses are taken out by, and the anchors of the regions,
#: by side of the image.
STABLE = [133, 362, 168, 6, 197, 195]
ANCHORS = {
    "forehead": [10, 67, 297, 109, 338, 151],
    "chin_perioral": [152, 175, 18, 200, 199, 164],
    "cheek": {"left": [234, 227, 116, 123, 50, 205], "right": [454, 447, 345, 352, 280, 425]},
    "temple_sideburn": {"left": [127, 162, 21, 54, 103], "right": [356, 389, 251, 284, 332]},
}


def region_anchors(spark: SparkSession, right_is_image_left: bool = True) -> DataFrame:
    """(id, region): the landmarks of each region; the sides are the subject's own, which an unmirrored image shows
    the other way round."""
    sides = {"left": "r", "right": "l"} if right_is_image_left else {"left": "l", "right": "r"}
    rows = [(i, f"{name}_{sides[side]}") for name, both in ANCHORS.items() if isinstance(both, dict) for side, ids in both.items() for i in ids]
    rows += [(i, name) for name, ids in ANCHORS.items() if isinstance(ids, list) for i in ids]
    return spark.createDataFrame(rows, "id int, region string")


#: Subjects whose first frames are broadcast; with more of them frames are shuffled to theirs.
MOST_SUBJECTS = 20_000


def _fitted(frames: DataFrame, subject: str, image: str, stable: list[int]) -> DataFrame:
    """(subject, image, points, transform): a row for each frame with the similarity onto its subject's first one. The points
    of a frame stay together, and what frames are joined with is staged and counted: sizes that Spark
    guesses before rows are exploded let it gather all frames on the driver for a broadcast."""
    points = frames.dropna(subset=[subject, image, "x", "y"]).select(subject, image, "id", F.col("x").cast("double"), F.col("y").cast("double"))
    rows = lambda df: df.count() <= MOST_SUBJECTS
    firsts = staged(points.groupBy(subject).agg(F.min(image).alias(image)), "firsts")
    joined = lambda left, right, on: left.join(F.broadcast(right) if rows(right) else right.hint("merge"), on)
    own = joined(points.filter(F.col("id").isin(stable)), firsts, [subject, image]).groupBy(subject).agg(F.collect_list(F.struct("id", "x", "y")).alias("first"))  # as many as `stable`
    framed = points.groupBy(subject, image).agg(F.collect_list(F.struct("id", "x", "y")).alias("points"))  # of one frame
    both = joined(framed, staged(own, "reference"), subject)
    same = lambda p: F.transform(F.filter("first", lambda q: q["id"] == p["id"]), lambda q: F.struct(p["x"].alias("x"), p["y"].alias("y"), q["x"].alias("u"), q["y"].alias("v")))
    matches = F.array_sort(F.flatten(F.transform(F.filter("points", lambda p: p["id"].isin(stable)), same)))
    fits = by_key(both.select(subject, image, "points", matches.alias("_p")), subject, image)
    fit = least_median_of.asNondeterministic()("_p")  # so that the filter isn't pushed below the join, with the fit in it
    return fits.select(subject, image, "points", fit.alias("transform")).filter("transform IS NOT NULL")


def aligned(frames: DataFrame, subject: str, image: str, stable: list[int]) -> DataFrame:
    """(subject, image, id, x, y) in the first frame's coordinates. Frames (subject, image, id, x, y) are moved onto the
    subject's first one by the similarity of the `stable` landmarks with the least median of errors;
    frames without one (fewer than two stable landmarks shared) are left out."""
    x, y = mapped(F.col("p.x"), F.col("p.y"), F.col("transform"))
    points = _fitted(frames, subject, image, stable).select(subject, image, "transform", F.explode("points").alias("p"))
    return points.select(subject, image, F.col("p.id").alias("id"), x.alias("x"), y.alias("y"))


def stability(frames: DataFrame, subject: str, image: str, stable: list[int]) -> DataFrame:
    """(subject, id, n, spread): the population deviation of each landmark over the aligned frames, the mean of
    those of x and y; subjects with fewer than two frames have none."""
    x, y = mapped(F.col("p.x"), F.col("p.y"), F.col("transform"))
    # A row more for each frame counts the frames.
    points = F.concat(F.array(F.lit(None)), F.col("points"))
    rows = _fitted(frames, subject, image, stable).select(subject, "transform", F.posexplode(points).alias("_k", "p"))
    moved = rows.select(subject, F.col("p.id").alias("id"), (F.col("_k") == 0).alias("_frame"), x.alias("x"), y.alias("y"))
    spread = landmark_spread(moved, [subject, "id", "_frame"], ["x", "y"])
    framed = F.max(F.when(F.col("_frame"), F.col("n"))).over(Window.partitionBy(subject))  # over a row a landmark
    return spread.withColumn("_frames", framed).filter("_frames >= 2 AND NOT _frame").select(subject, "id", "n", "spread")


def stability_summary(spread: DataFrame, subject: str, regions: DataFrame, scales: DataFrame) -> DataFrame:
    """(subject, region, n, mean_px, median_px, p95_px, max_px and the same in mm): of all landmarks in a row whose region
    is null, and of each region's. `regions` (id, region) may name a landmark twice or not at all;
    `scales` (subject, px_per_mm) has one row per frame, and the mean of what is there counts."""
    scale = scales.groupBy(subject).agg(F.avg("px_per_mm").alias("px_per_mm"))
    every = spread.select(subject, F.lit(None).cast("string").alias("region"), "spread")
    rows = every.unionByName(spread.join(F.broadcast(regions), "id").select(subject, "region", "spread"))
    q = F.percentile("spread", F.array(F.lit(0.5), F.lit(0.95)))
    s = rows.groupBy(subject, "region").agg(F.count("*").alias("n"), F.avg("spread").alias("mean"), q.alias("q"), F.max("spread").alias("max"))
    s = s.select(subject, "region", "n", "mean", F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"), "max").join(scale, subject, "left")
    names = ("mean", "median", "p95", "max")
    return s.select(subject, "region", "n", *(F.col(c).alias(f"{c}_px") for c in names), *(F.try_divide(F.col(c), F.col("px_per_mm")).alias(f"{c}_mm") for c in names))


def worst_of(summary: DataFrame, regions: list[str]) -> Column:
    """The worst landmark (mm) of the regions that a verdict rests on (see `landmark_verdict`)."""
    return F.max(F.when(F.col("region").isin(regions), F.col("max_mm")))

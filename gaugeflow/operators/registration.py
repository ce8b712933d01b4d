"""Registration and stability statistics over control points and landmarks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import homography, spline_kernel
from ..sources.staging import by_key


def residuals(target: DataFrame, reference: DataFrame, pair: str, transform: list[float], px_per_mm: float, least: int = 3) -> DataFrame:
    """(pair, id, mm): how far mapped control points are from those of the same id; pairs with
    fewer than `least` shared points give none."""
    t = target.select(pair, "id", F.col("x").alias("tx"), F.col("y").alias("ty"))
    j = t.join(reference.select(pair, "id", "x", "y"), [pair, "id"])
    enough = j.groupBy(pair).count().filter(F.col("count") >= least).select(pair)
    mx, my = homography(F.col("tx"), F.col("ty"), transform)
    return j.join(enough, pair, "left_semi").select(pair, "id", (F.hypot(mx - F.col("x"), my - F.col("y")) / px_per_mm).alias("mm"))


def landmark_spread(landmarks: DataFrame, by: list[str], coordinates: list[str]) -> DataFrame:
    """Population deviation of each landmark, averaged over its coordinates."""
    spread = sum((F.stddev_pop(c) for c in coordinates), F.lit(0.0)) / len(coordinates)
    return landmarks.groupBy(*by).agg(F.count("*").alias("n"), spread.alias("spread"))


def visibility(share: Column) -> Column:
    return F.when(share >= 0.6, "visible").when(share >= 0.3, "partial").otherwise("occluded")


def landmark_verdict(detected: Column, total: Column, worst_mm: Column) -> Column:
    holds = (detected == total) & F.coalesce(~F.isnan(worst_mm) & (worst_mm < 3.0), F.lit(False))
    return F.when(holds, "hold").when(detected != total, "step down").otherwise("marginal")


def fit_splines(points: DataFrame, pair: str, smooth: float = 1e-3, scale: str | None = None) -> DataFrame:
    """Thin-plate splines of (pair, x, y, u, v): node and weight rows per pair, with the affine
    part as nodes of kind 'affine'. A group is one pair's control points. Sources are divided by
    the diagonal of their bounding box, or by the column `scale` of the points (such as the diagonal of the
    image), so that the smoothing means the same at any size.
    Points on one line, or fewer than three, are an error."""
    kind = dict(points.dtypes)[pair]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        src, dst = rows[["x", "y"]].to_numpy(float), rows[["u", "v"]].to_numpy(float)
        n, unit = len(src), float(rows[scale].iloc[0] if scale else np.hypot(*np.ptp(src, axis=0))) or 1.0
        src = src / unit
        r2 = ((src[:, None] - src[None]) ** 2).sum(-1)
        kernel = np.where(r2 > 1e-12, r2 * np.log(np.maximum(r2, 1e-300)), 0.0)
        system = np.zeros((n + 3, n + 3))
        system[:n, :n] = kernel + smooth * np.eye(n)
        system[:n, n:] = np.hstack([np.ones((n, 1)), src])
        system[n:, :n] = system[:n, n:].T
        if n < 3 or np.linalg.matrix_rank(system[:n, n:]) < 3:
            raise ValueError(f"no spline through the points of pair {rows[pair].iloc[0]}")
        w = np.linalg.solve(system, np.vstack([dst, np.zeros((3, 2))]))
        xy = np.vstack([src, np.full((3, 2), np.nan)])
        return pd.DataFrame({pair: rows[pair].iloc[0], "part": ["node"] * n + ["affine"] * 3, "k": list(range(n)) + [0, 1, 2], "x": xy[:, 0], "y": xy[:, 1], "wu": w[:, 0], "wv": w[:, 1], "scale": unit})

    return by_key(points, pair).groupBy(pair).applyInPandas(fit, f"{pair} {kind}, part string, k int, x double, y double, wu double, wv double, scale double")


def map_points(points: DataFrame, splines: DataFrame, pair: str) -> DataFrame:
    """(pair, id, u, v): points (pair, id, x, y) under their pair's spline, a join with its nodes."""
    j = points.select(pair, "id", F.col("x").alias("px"), F.col("y").alias("py")).join(splines, pair)
    x, y = F.col("px") / F.col("scale"), F.col("py") / F.col("scale")
    r2 = (x - F.col("x")) * (x - F.col("x")) + (y - F.col("y")) * (y - F.col("y"))
    affine = F.when(F.col("k") == 0, F.lit(1.0)).when(F.col("k") == 1, x).otherwise(y)
    base = F.when(F.col("part") == "node", spline_kernel(r2)).otherwise(affine)
    return j.groupBy(pair, "id").agg(F.sum(base * F.col("wu")).alias("u"), F.sum(base * F.col("wv")).alias("v"))


def region_stats(spread: DataFrame, region: Column, px_per_mm: float) -> DataFrame:
    """Of landmark spreads (in px) per region: landmarks, mean and largest, median and p95, in mm."""
    q = F.percentile("mm", F.array(F.lit(0.5), F.lit(0.95)))
    r = spread.select(region.alias("region"), (F.col("spread") / px_per_mm).alias("mm")).groupBy("region")
    r = r.agg(F.count("*").alias("n"), F.avg("mm").alias("mean"), F.max("mm").alias("worst"), q.alias("q"))
    return r.select("region", "n", "mean", "worst", F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"))


def owned_counts(rows: DataFrame, owners: DataFrame, region: str, pose: str) -> DataFrame:
    """Rows per region, counting only the pose that owns it (a small fixed table, broadcast)."""
    j = rows.join(F.broadcast(owners.select(region, F.col(pose).alias("_owner"))), region, "left")
    return j.groupBy(region).agg(F.count_if(F.col(pose) == F.col("_owner")).alias("n_owned"), F.count("*").alias("n"))


def similarity(points: DataFrame, pair: str) -> DataFrame:
    """Least-squares scale, rotation and shift of (x, y) onto (u, v) in closed form from sums."""
    s = points.groupBy(pair).agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("u").alias("mu"), F.avg("v").alias("mv"),
        (F.covar_pop("x", "u") + F.covar_pop("y", "v")).alias("a"), (F.covar_pop("x", "v") - F.covar_pop("y", "u")).alias("b"),
        (F.var_pop("x") + F.var_pop("y")).alias("s"),
    )
    c, d = F.try_divide(F.col("a"), F.col("s")), F.try_divide(F.col("b"), F.col("s"))
    return s.select(pair, F.hypot(c, d).alias("scale"), F.degrees(F.atan2(d, c)).alias("degrees"), (F.col("mu") - c * F.col("mx") + d * F.col("my")).alias("tx"), (F.col("mv") - d * F.col("mx") - c * F.col("my")).alias("ty"))

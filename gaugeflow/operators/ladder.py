"""The ladder of registration methods over tables of matches, scored at control points that no fit sees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import inverse, mapped, product
from ..sources.staging import staged
from .registration import fit_splines, map_points
from .robust import robust_fits
from .scoring import correlation_p

#: Numbers and names of the methods, which of them follow the coarse one, limits of the fits (px),
#: matches that a spline takes at most, the gate (mm), and medians that are the same but for the fits' rounding (mm).
METHODS = {0: "landmark similarity", 1: "coarse + SIFT", 2: "coarse + ORB", 3: "coarse + DISK and LightGlue", 4: "LoFTR", 5: "best + spline"}
AFTER_COARSE = (1, 2, 3)
COARSE_PX, MATCH_PX, ROUGH_PX, SPLINE_POINTS = 8.0, 4.0, 6.0, 500
MEDIAN_MM, P95_MM, SAME_MM = 1.5, 3.0, 1e-9
IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def _fits(matches: DataFrame, kind: str, limit: float) -> DataFrame:
    """Consensus fits of (pair, method): (pair, method, n_matches, n_inliers, h)."""
    fits = robust_fits(matches.select("pair", "method", "x", "y", "u", "v").dropna(), ["pair", "method"], kind, limit)
    return fits.select("pair", "method", F.col("n").alias("n_matches"), F.col("n_agree").alias("n_inliers"), F.col("transform").alias("h"))


def _scores(mapped_points: DataFrame) -> DataFrame:
    """Residual statistics of (pair, method) from control points with where they were mapped to (mx, my)."""
    mm = F.hypot(F.col("mx") - F.col("u"), F.col("my") - F.col("v")) / F.col("px_per_mm")
    radius = F.hypot(F.col("u") - F.col("w") / 2.0, F.col("v") - F.col("h") / 2.0)
    q = F.percentile("mm", F.array(*(F.lit(p) for p in (0.5, 0.9, 0.95))))
    s = mapped_points.select("pair", "method", mm.alias("mm"), radius.alias("radius")).groupBy("pair", "method")
    s = s.agg(F.count("*").alias("n_points"), q.alias("q"), F.max("mm").alias("max_mm"), F.corr("radius", "mm").alias("r"), (F.max("radius") > F.min("radius")).alias("spread"))
    r = F.when(F.col("spread") & ~F.isnan("r"), F.col("r"))
    out = s.select("pair", "method", "n_points", *(F.col("q")[k].alias(c) for k, c in enumerate(("median_mm", "p90_mm", "p95_mm"))), "max_mm", r.alias("radial_r"))
    return out.withColumn("radial_p", correlation_p("radial_r", "n_points"))


class Ladder:
    """What `run` gives: `results`, one row per pair and method; `splines` and `inverse_splines` of method 5."""

    def __init__(self, results: DataFrame, splines: DataFrame, inverse_splines: DataFrame):
        self.results, self.splines, self.inverse_splines = results, splines, inverse_splines


def run(pairs: DataFrame, landmarks: DataFrame, matches: DataFrame, control: DataFrame, least: int = 3, smooth: float = 1e-3) -> Ladder:
    """All methods for `pairs` (pair, px_per_mm, w, h: scale and size of the reference).

    Method 0 is a similarity that most landmarks (pair, x, y, u, v) agree on. The matches (pair, method, id,
    x, y, u, v) of methods 1 to 3 lie in the target as method 0 has moved it, or in the target itself where
    there is no such fit; those of method 4 always in the target. Each gives a homography that most of
    them agree on. Method 5 takes the matches of the best of 1 to 4 (least median, lowest number on ties),
    moved back to the target, keeps what agrees with a rough homography, thins that evenly and fits a
    spline. Control points (pair, id, x, y, u, v) only score, by the distance in the reference in
    mm; fewer than `least` score nothing. So methods are chosen by control points but never fitted to them.

    A row says whether the method is ok, and if not, why. A task holds the matches of one method of one pair.
    """
    every = pairs.withColumn("method", F.explode(F.array(*(F.lit(m) for m in METHODS))))
    coarse = _fits(landmarks.select("pair", F.lit(0).alias("method"), "x", "y", "u", "v"), "similarity", COARSE_PX)
    direct = _fits(matches.filter(F.col("method").between(1, 4)), "homography", MATCH_PX)
    fits = staged(coarse.unionByName(direct), "fits")
    before = fits.filter("method = 0").select("pair", F.col("h").alias("pre"))
    identity = F.array(*map(F.lit, IDENTITY))
    moved = fits.join(before, "pair", "left").withColumn("pre", F.when(F.col("method").isin(*AFTER_COARSE), F.coalesce("pre", identity)).otherwise(identity))
    whole = staged(moved.withColumn("whole", product(F.col("h"), F.col("pre"))), "transforms")

    points = control.dropna(subset=["x", "y", "u", "v"]).join(pairs, "pair")
    enough = points.groupBy("pair").count()
    on = points.join(whole.filter("whole IS NOT NULL").select("pair", "method", "whole"), "pair")
    mx, my = mapped(F.col("x"), F.col("y"), F.col("whole"))
    scored = staged(_scores(on.withColumn("mx", mx).withColumn("my", my)).filter(F.col("n_points") >= least), "scores")

    fine = scored.filter(F.col("method").between(1, 4)).groupBy("pair").agg(F.min("median_mm").alias("least"), F.collect_list(F.struct("method", "median_mm")).alias("m"))  # up to four
    base = fine.select("pair", F.array_min(F.filter("m", lambda m: m["median_mm"] <= F.col("least") + SAME_MM)["method"]).alias("base"))
    chosen = matches.join(base, "pair").filter(F.col("method") == F.col("base")).join(whole.select("pair", F.col("method").alias("base"), "pre"), ["pair", "base"])
    back = mapped(F.col("x"), F.col("y"), inverse(F.col("pre")))
    raw = staged(chosen.select("pair", F.lit(5).alias("method"), "id", back[0].alias("x"), back[1].alias("y"), "u", "v"), "raw")
    rough = _fits(raw, "homography", ROUGH_PX).select("pair", F.col("h").alias("rough"))
    at = mapped(F.col("x"), F.col("y"), F.col("rough"))
    near = raw.join(rough, "pair").filter(F.col("rough").isNull() | (F.hypot(at[0] - F.col("u"), at[1] - F.col("v")) <= ROUGH_PX))
    kept = staged(thinned(near.join(pairs, "pair")), "kept")
    diagonal = F.hypot("w", "h").alias("diagonal")
    splines = staged(fit_splines(spread(kept).select("pair", "x", "y", "u", "v", diagonal), "pair", smooth, "diagonal"), "splines")
    twins = fit_splines(spread(kept).select("pair", F.col("u").alias("x"), F.col("v").alias("y"), F.col("x").alias("u"), F.col("y").alias("v"), diagonal), "pair", smooth, "diagonal")
    through = map_points(points, splines, "pair").select("pair", "id", F.col("u").alias("mx"), F.col("v").alias("my")).join(points, ["pair", "id"]).withColumn("method", F.lit(5))
    last = _scores(through).filter(F.col("n_points") >= least)
    sizes = raw.groupBy("pair").count().withColumnRenamed("count", "n_matches").join(kept.groupBy("pair").count().withColumnRenamed("count", "n_inliers"), "pair", "left")
    used = whole.select("pair", "method", "n_matches", "n_inliers").unionByName(sizes.select("pair", F.lit(5).alias("method"), "n_matches", "n_inliers"))

    out = every.join(used, ["pair", "method"], "left").join(scored.unionByName(last), ["pair", "method"], "left").join(base, "pair", "left").join(enough, "pair", "left")
    few = F.coalesce("count", F.lit(0)) < least
    fitted = out.join(whole.select("pair", "method", F.col("whole").isNotNull().alias("fitted")), ["pair", "method"], "left")
    note = (
        F.when(F.col("n_points").isNotNull(), F.lit(None))
        .when((F.col("method") == 5) & F.col("base").isNull(), "no method to build on")
        .when(F.col("method") == 5, "too few matches for a spline")
        .when(F.col("n_matches").isNull(), "no matches")
        .when(~F.coalesce("fitted", F.lit(False)), F.format_string("no fit from %d matches", "n_matches"))
        .when(few, F.format_string("%d shared control points", F.coalesce("count", F.lit(0))))
    )
    kind = F.when(F.col("method") == 0, "similarity").when(F.col("method") == 5, "spline").otherwise("homography")
    name = F.create_map(*(F.lit(x) for item in METHODS.items() for x in item))[F.col("method")]
    results = fitted.select(
        "pair", "method", name.alias("name"), kind.alias("kind"), F.col("n_points").isNotNull().alias("ok"),
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce("n_inliers", F.lit(0)).alias("n_inliers"),
        "n_points", "median_mm", "p90_mm", "p95_mm", "max_mm", "radial_r", "radial_p",
        F.when(F.col("method") == 5, F.col("base")).alias("base"), note.alias("note"),
    )
    return Ladder(results, splines, twins)


def thinned(matches: DataFrame, target: int = SPLINE_POINTS) -> DataFrame:
    """At most `target` matches of each pair, evenly over a grid of the reference (w, h): pairs with more
    keep the first ones, by id, of each cell that has any, an equal share of each."""
    side = int(target**0.5)
    cell = F.struct(F.floor(F.col("v") / F.col("h") * side).alias("row"), F.floor(F.col("u") / F.col("w") * side).alias("column"))
    pair, own = Window.partitionBy("pair"), Window.partitionBy("pair", "_cell").orderBy("id")
    counted = matches.withColumn("_cell", cell)
    sizes = counted.groupBy("pair").agg(F.count("*").alias("_n"), F.countDistinct("_cell").alias("_cells"))
    ranked = counted.join(sizes, "pair").withColumn("_k", F.row_number().over(own))
    share = F.greatest(F.lit(1), F.floor(F.lit(target) / F.col("_cells")))
    some = ranked.filter((F.col("_n") <= target) | (F.col("_k") <= share))
    return some.withColumn("_k", F.row_number().over(pair.orderBy("id"))).filter(F.col("_k") <= target).drop("_cell", "_n", "_cells", "_k")


def spread(matches: DataFrame) -> DataFrame:
    """Matches of pairs that a spline goes through: three or more that aren't on one line, either side."""
    def flat(x: str, y: str):
        return F.var_pop(x) * F.var_pop(y) - F.pow(F.covar_pop(x, y), 2) <= 1e-9 * F.pow(F.var_pop(x) + F.var_pop(y), 2)

    good = matches.groupBy("pair").agg(F.count("*").alias("n"), flat("x", "y").alias("a"), flat("u", "v").alias("b")).filter("n >= 3 AND NOT a AND NOT b")
    return matches.join(good.select("pair"), "pair", "left_semi")


def verdict(results: DataFrame, pairs: int | None = None) -> DataFrame:
    """Per method number: pairs it is ok for and their share, medians of the pairs' median and p95, its rank
    by these, and GO for the best one if both are under the gate."""
    share = F.avg(F.col("ok").cast("int"))
    m = results.groupBy("method", "name").agg(F.count_if("ok").alias("n_ok"), share.alias("coverage"), F.median("median_mm").alias("median"), F.median("p95_mm").alias("p95"))
    rank = F.row_number().over(Window.orderBy(F.col("median").isNull(), "median", "p95", "method"))
    go = (F.col("median") < MEDIAN_MM) & (F.col("p95") < P95_MM)
    ranked = m.withColumn("rank", rank)
    return ranked.withColumn("verdict", F.when(F.col("rank") == 1, F.when(go, "GO").otherwise("NO-GO")))

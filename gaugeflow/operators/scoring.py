"""Detection and registration scores."""

from __future__ import annotations

import math
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.geometry import ratio
from ..sources.staging import by_key
from .graph import components


def _matched(left: list[int], right: list[int]) -> int:
    """Size of a maximum matching by augmenting paths."""
    edges: dict[int, list[int]] = {}
    for a, b in zip(left, right):
        edges.setdefault(a, []).append(b)
    owner: dict[int, int] = {}
    mate: dict[int, int] = {}
    for a in edges:
        reached, waiting, free = {}, [a], None
        while waiting and free is None:
            node = waiting.pop()
            for b in edges[node]:
                if b not in reached:
                    reached[b] = node
                    if b not in owner:
                        free = b
                        break
                    waiting.append(owner[b])
        while free is not None:  # flip the path back to a
            node = reached[free]
            owner[free], mate[node], free = node, free, mate.get(node)
    return len(owner)


def match_counts(truth: DataFrame, found: DataFrame, group: str, tolerance: float) -> DataFrame:
    """(group, tp, fp, fn) by one-to-one matching of points (id, x, y) within the tolerance.

    Points fall into cells as wide as the tolerance, and cells into clusters that no candidate pair leaves: two
    cells are linked where the boxes of points of either side come within the tolerance, and where an id has points
    in both. The clusters are found on Spark; a matching is the union of theirs, so a task matches one
    cluster at a time, and pairs are never listed, as they grow with the square of the density.
    Points of one id are one to match. Groups with one side alone keep their counts, a null group has
    a row of its own; null groups, ids and places match nothing.
    """
    kind, number = dict(truth.dtypes)[group], lambda c: F.col(c).cast("double").alias(c)
    sided = lambda df, side: df.select(group, "id", number("x"), number("y"), F.lit(side).alias("side"))
    rows = sided(truth, 0).unionByName(sided(found, 1)).dropna()  # NaN too
    # Nodes are hashes of cells: should two meet, clusters merge, which changes no matching.
    node = lambda x, y: F.xxhash64(group, x, y)
    cx, cy = F.floor(F.col("x") / tolerance).cast("long"), F.floor(F.col("y") / tolerance).cast("long")
    points = rows.withColumn("cx", cx).withColumn("cy", cy).withColumn("node", node("cx", "cy"))

    ends = [f(F.when(F.col("side") == side, F.col(c))).alias(f"{name}{c}{side}") for side in (0, 1) for c in ("x", "y") for f, name in ((F.min, "low_"), (F.max, "high_"))]
    cells = points.groupBy(group, "cx", "cy", "node").agg(*ends)
    steps = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))))
    beside = cells.withColumn("step", F.explode(steps)).withColumn("other", node(F.col("cx") + F.col("step.i"), F.col("cy") + F.col("step.j"))).alias("p")

    def near(side: int):
        def apart(c: str):
            return F.greatest(F.lit(0.0), F.col(f"p.low_{c}{side}") - F.col(f"q.high_{c}{1 - side}"), F.col(f"q.low_{c}{1 - side}") - F.col(f"p.high_{c}{side}"))

        return F.col(f"p.low_x{side}").isNotNull() & F.col(f"q.low_x{1 - side}").isNotNull() & (F.pow(apart("x"), 2) + F.pow(apart("y"), 2) <= tolerance * tolerance)

    linked = beside.join(cells.alias("q"), F.col("p.other") == F.col("q.node")).filter(near(0) | near(1)).select(F.col("p.node").alias("a"), F.col("q.node").alias("b"))
    # An id's first cell is linked to its last one, and to what lies between where it has more than two points.
    named = points.select(F.xxhash64(group, "side", "id").alias("name"), "node")
    several = named.groupBy("name").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n")).filter("a <> b")
    between = named.join(several.filter("n > 2").select("name", "a"), "name").filter("node <> a").select("a", F.col("node").alias("b"))
    links = linked.unionByName(several.select("a", "b")).unionByName(between)
    roots = components(links).select("node", "root")
    apart = points.join(roots, "node", "left").select(group, F.coalesce("root", "node").alias("root"), "side", "id", "x", "y")
    tp = by_key(apart, "root").sortWithinPartitions("root", group).mapInPandas(_matched_counts(tolerance), f"{group} {kind}, tp long")
    one = lambda df, *counts: df.select(group, *(F.lit(n).cast("long").alias(c) for n, c in zip(counts, ("n_truth", "n_found", "tp"))))
    sums = one(truth, 1, 0, 0).unionByName(one(found, 0, 1, 0)).unionByName(tp.select(group, F.lit(0).alias("n_truth"), F.lit(0).alias("n_found"), "tp"))
    sizes = sums.groupBy(group).agg(*(F.sum(c).alias(c) for c in ("n_truth", "n_found", "tp")))
    return sizes.select(group, "tp", (F.col("n_found") - F.col("tp")).alias("fp"), (F.col("n_truth") - F.col("tp")).alias("fn"))


#: Pairs of a cluster that are looked at one by one; larger ones are searched by places.
FEW = 4096


def _matched_counts(tolerance: float):
    """Matched points of each cluster; rows come sorted by root and group, and a cluster may span batches."""

    def counts(batches):
        held, last = [], None
        for rows in batches:
            if not len(rows):
                continue
            root, group = rows["root"].to_numpy(), rows.iloc[:, 0].to_numpy()
            at = [0, *((root[1:] != root[:-1]) | (group[1:] != group[:-1])).nonzero()[0] + 1, len(rows)]
            side, id, x, y = (rows[c].to_numpy() for c in ("side", "id", "x", "y"))
            out = []
            for start, end in zip(at, at[1:]):
                key = root[start], group[start]
                if held and key != last:
                    out.append((last[1], _cluster_matched(held, tolerance)))
                    held = []
                held.append(tuple(c[start:end] for c in (side, id, x, y)))
                last = key
            yield _counted(rows, out)
        if held:
            yield _counted(rows, [(last[1], _cluster_matched(held, tolerance))])

    return counts


def _counted(rows: pd.DataFrame, out: list) -> pd.DataFrame:
    out = [r for r in out if r[1]]
    return pd.DataFrame({rows.columns[0]: pd.Series([g for g, _ in out], dtype=rows.dtypes.iloc[0]), "tp": pd.Series([n for _, n in out], dtype="int64")})


def _cluster_matched(pieces: list[tuple], tolerance: float) -> int:
    side, id, x, y = (np.concatenate(c) if len(pieces) > 1 else c[0] for c in zip(*pieces))
    t = side == 0
    n = int(t.sum())
    if n in (0, len(t)):
        return 0
    if n * (len(t) - n) <= FEW:
        i, j = np.nonzero((x[t][:, None] - x[~t]) ** 2 + (y[t][:, None] - y[~t]) ** 2 <= tolerance * tolerance)
        return _matched(id[t][i].tolist(), id[~t][j].tolist()) if len(i) > 1 else len(i)
    a, b = ((pd.factorize(id[s])[0], x[s], y[s]) for s in (t, ~t))
    return _matched_places(*(a, b) if a[0].max() <= b[0].max() else (b, a), tolerance)


def _slices(left: tuple, right: tuple, tolerance: float) -> tuple:
    """The order of `right` by rows of cells and x, and where in it the points lie that each of `left` may reach: slices of
    up to three rows of cells, by node of `left`."""
    reach = tolerance * (1 + 1e-9)
    (node, x, y), (_, rx, ry) = left, right
    rows, row = np.unique(np.floor(ry / tolerance), return_inverse=True)
    order = np.lexsort((rx, row))
    every, size = np.sort(rx), len(rx) + 1
    places = row[order] * size + np.searchsorted(every, rx[order])
    low, high = np.searchsorted(every, x - reach), np.searchsorted(every, x + reach, side="right")
    found = []
    for step in (-1.0, 0.0, 1.0):
        at = np.searchsorted(rows, wanted := np.floor(y / tolerance) + step)
        there = at < len(rows)
        there[there] = rows[at[there]] == wanted[there]
        start, stop = np.searchsorted(places, at * size + low), np.searchsorted(places, at * size + high)
        k = np.flatnonzero(there & (start < stop))
        found.append((node[k], start[k], stop[k], x[k], y[k]))
    found = [np.concatenate(c) for c in zip(*found)]
    by = np.argsort(found[0], kind="stable")
    node, *rest = (c[by] for c in found)
    return order, np.searchsorted(node, np.arange(left[0].max() + 2)), rest


def _matched_places(left: tuple, right: tuple, tolerance: float) -> int:
    """Size of a maximum matching of nodes with points (node, x, y), `left` the side with fewer nodes, without a list of
    pairs: augmenting paths, free nodes first, in rounds that reach each point of `right` once. A point
    that has been reached, or whose node isn't free any more, is passed over by a link to the next one."""
    order, first, (low, high, px, py) = _slices(left, right, tolerance)
    flat = lambda a, kind: array(kind, np.ascontiguousarray(a, {"q": np.int64, "d": float}[kind]).tobytes())
    node, rx, ry = (flat(c[order], k) for c, k in zip(right, "qdd"))
    first, low, high, px, py = (flat(c, k) for c, k in zip((first, low, high, px, py), "qqqdd"))
    n, m, limit = len(first) - 1, len(node), tolerance * tolerance
    owner, mate = array("q", [-1]) * (int(right[0].max()) + 1), array("q", [-1]) * n
    links = np.arange(m + 1)
    free = flat(links, "q")

    def at(link, k: int) -> int:
        """The first place from k on that is still there."""
        while (up := link[k]) != k:
            link[k] = k = link[up]
        return k

    def open_place(a: int) -> int:
        for s in range(first[a], first[a + 1]):
            k, end, x, y = low[s], high[s], px[s], py[s]
            while (k := at(free, k)) < end:
                if owner[node[k]] >= 0:
                    free[k] = k + 1
                elif (rx[k] - x) ** 2 + (ry[k] - y) ** 2 <= limit:
                    return node[k]
                else:
                    k += 1
        return -1

    matched, waiting = 0, []
    seen, places = np.unique(left[0], return_index=True)
    for a in seen[np.lexsort((left[1][places], np.floor(left[2][places] / tolerance)))].tolist():
        if (b := open_place(a)) >= 0:
            owner[b], mate[a], matched = a, b, matched + 1
        else:
            waiting.append(a)
    while waiting:
        there, reached = flat(links, "q"), array("q", [-1]) * len(owner)
        still, before = [], matched
        for root in waiting:
            stack, b = [root], -1
            while stack:
                a = stack.pop()
                if (b := open_place(a)) >= 0:
                    break
                for s in range(first[a], first[a + 1]):
                    k, end, x, y = low[s], high[s], px[s], py[s]
                    while (k := at(there, k)) < end:
                        if reached[node[k]] >= 0:
                            there[k] = k + 1
                        elif (rx[k] - x) ** 2 + (ry[k] - y) ** 2 <= limit:
                            reached[node[k]] = a
                            there[k] = k + 1
                            stack.append(owner[node[k]])
                        else:
                            k += 1
            if b < 0:
                still.append(root)
                continue
            matched += 1
            while b >= 0:  # flip the path back to its root
                owner[b], mate[a], b = a, b, mate[a]
                a = reached[b]
        waiting = still
        if matched == before:
            break
    return matched


def metrics(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1; undefined ones are null, except that f1 is then 0."""
    f1 = F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    return [ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1.alias("f1")]


def gate(days: Column, labelled: Column, precision: Column, recall: Column) -> Column:
    enough = (days >= 5) & (labelled >= 20)
    good = F.coalesce((precision > 0.8) & (recall > 0.7), F.lit(False))
    return F.when(~enough, "insufficient_evidence").when(good, "pass").otherwise("fail")


def best_threshold(scored: DataFrame, score: str, truth: Column, thresholds: list[float]) -> DataFrame:
    """One row per threshold with its f1, and whether it is the best (the lowest one on ties)."""
    t = scored.withColumn("threshold", F.explode(F.array(*(F.lit(x) for x in thresholds))))
    hit = F.col(score) >= F.col("threshold")
    c = t.groupBy("threshold").agg(F.count_if(hit & truth).alias("tp"), F.count_if(hit & ~truth).alias("fp"), F.count_if(~hit & truth).alias("fn"))
    c = c.select("threshold", "tp", "fp", "fn", *metrics(F.col("tp"), F.col("fp"), F.col("fn")))
    best = F.max_by("threshold", F.struct("f1", -F.col("threshold"))).over(Window.partitionBy())
    return c.withColumn("best", F.col("threshold") == best)


def residual_stats(residuals: DataFrame, by: str, value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    r = residuals.groupBy(by).agg(F.count(value).alias("n"), q.alias("q"), F.max(value).alias("worst"))
    return r.select(by, "n", F.col("q")[0].alias("median"), F.col("q")[1].alias("p90"), F.col("q")[2].alias("p95"), "worst")


def ranked_methods(stats: DataFrame, method: str, median_below: float, p95_below: float) -> DataFrame:
    """Rank by (median, p95, name) and GO where both limits are met."""
    rank = F.row_number().over(Window.orderBy("median", "p95", method))
    return stats.withColumn("rank", rank).withColumn("verdict", F.when((F.col("median") < median_below) & (F.col("p95") < p95_below), "GO").otherwise("NO-GO"))


#: Bytes of query vectors that are broadcast at once; more take further scans of the rows.
BLOCK_BYTES = 64 << 20


def _two_least(distance, q: np.ndarray, names: np.ndarray, key: str, vector: str):
    """Per task the two least distances of every query, with their ids; the smaller id on ties."""

    def of(batches):
        best = np.full((2, len(q)), np.inf)
        ids = np.full((2, len(q)), None, dtype=object)
        for rows in batches:
            rows = rows.dropna(subset=[vector]).sort_values(key, kind="stable")
            step = max(1, (4 << 20) // max(1, q.size))
            for k in range(0, len(rows), step):
                part = rows.iloc[k : k + step]
                name = part[key].to_numpy()
                d = distance(q, np.stack(part[vector].to_numpy()))
                d[name[None] == names[:, None]] = np.inf
                for _ in range(2):
                    at = d.argmin(axis=1)
                    least, own = d[np.arange(len(q)), at], name[at]
                    d[np.arange(len(q)), at] = np.inf
                    for slot in (0, 1):  # put into its place, what it moves goes on
                        with_id = np.array([o is None or (not pd.isna(o) and n < o) for n, o in zip(own, ids[slot])])
                        wins = (least < best[slot]) | ((least == best[slot]) & np.isfinite(least) & with_id)
                        best[slot][wins], least[wins] = least[wins], best[slot][wins].copy()
                        ids[slot][wins], own = own[wins], np.where(wins, ids[slot].copy(), own)
        for slot in (0, 1):
            there = np.isfinite(best[slot])
            yield pd.DataFrame({"query": names[there], "d": best[slot][there], "id": pd.array(ids[slot][there].tolist(), dtype=pd.Series(names).dtype)})

    return of


def _two_nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, distance, threshold: float) -> DataFrame:
    """The queries are a stated set: as many as BLOCK_BYTES holds are broadcast and met by one scan of the rows, each task of
    which gives two candidates a query; the two least of these are the answer."""
    slim = queries.select(F.col(key).alias("query"), F.col(vector).alias("q")).dropna()
    n, width = slim.agg(F.count("*"), F.max(F.size("q") if slim.schema["q"].dataType.typeName() == "array" else F.lit(1))).first()
    blocks = max(1, -(-n * (width or 1) * 8 // BLOCK_BYTES))
    kind = dict(rows.dtypes)[key]
    near = None
    for k in range(blocks):
        block = slim.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k).toPandas()
        if len(block):
            found = _two_least(distance, np.stack(block["q"].to_numpy()), block["query"].to_numpy(), key, vector)
            least = rows.select(key, vector).mapInPandas(found, f"query {kind}, d double, id {kind}")
            near = least if near is None else near.unionByName(least)
    if near is None:
        near = slim.limit(0).select("query", F.lit(0.0).alias("d"), F.col("query").alias("id"))
    two = near.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("d", "id"))).alias("n")).filter(F.size("n") > 1)  # two rows a task
    a, b = F.col("n")[0], F.col("n")[1]
    return two.select("query", a["id"].alias("nearest"), a["d"].alias("d1"), b["d"].alias("d2")).withColumn("accepted", F.col("d1") < threshold * F.col("d2"))


def nearest_two(queries: DataFrame, rows: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """Two nearest rows of every query vector and whether the first is clearly nearer."""

    def apart(q, v):
        return np.sqrt(((q[:, None].astype(v.dtype) - v[None]).astype(float) ** 2).sum(axis=2))

    return _two_nearest(queries, rows, key, vector, apart, threshold)


def nearest_two_bits(queries: DataFrame, rows: DataFrame, key: str, bits: str, threshold: float) -> DataFrame:
    """As nearest_two, for binary descriptors by the number of differing bits."""
    found = _two_nearest(queries, rows, key, bits, lambda q, v: np.bitwise_count((q[:, None] ^ v[None]).view(np.uint64)).astype(float), threshold)
    return found.withColumn("d1", F.col("d1").cast("long")).withColumn("d2", F.col("d2").cast("long"))


def best_base(stats: DataFrame, pair: str, method: str) -> DataFrame:
    """Per pair the method of the least median, by name on ties."""
    return stats.groupBy(pair).agg(F.min(F.struct("median", method)).alias("b")).select(pair, F.col(f"b.{method}").alias(method), F.col("b.median").alias("median"))


def picked(stats: DataFrame, pair: str, method: str, wanted: str) -> DataFrame:
    """Per pair the first method whose name contains `wanted`, else the one of the least median."""
    asked = ~F.contains(F.col(method), F.lit(wanted))
    return stats.groupBy(pair).agg(F.min(F.struct(asked.alias("other"), F.when(asked, F.col("median")).alias("median"), method)).alias("b")).select(pair, F.col(f"b.{method}").alias(method))


def nearest_within(points: DataFrame, by: str, x: float, y: float, radius: float) -> DataFrame:
    """Per group the point nearest to (x, y), if one is within the radius."""
    d = F.hypot(F.col("x") - x, F.col("y") - y)
    return points.withColumn("d", d).filter(F.col("d") <= radius).groupBy(by).agg(F.min(F.struct("d", "id")).alias("b")).select(by, F.col("b.id").alias("id"), F.col("b.d").alias("d"))


def pooled(counts: DataFrame, by: str) -> DataFrame:
    """Scores of each group, and of all together in a row whose group is null."""
    c = counts.groupBy(by).agg(*(F.sum(k).alias(k) for k in ("tp", "fp", "fn")))
    every = counts.agg(*(F.sum(k).alias(k) for k in ("tp", "fp", "fn"))).select(F.lit(None).cast(dict(c.dtypes)[by]).alias(by), "tp", "fp", "fn")
    return c.unionByName(every).select(by, "tp", "fp", "fn", *metrics(F.col("tp"), F.col("fp"), F.col("fn")))


def _upper_t(t: float, freedom: float) -> float:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    x, a, b = freedom / (freedom + t * t), freedom / 2, 0.5
    if x >= 1:
        return 1.0
    if x <= 0:
        return 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        x, a, b = 1 - x, b, a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    value = d
    for m in range(1, 500):
        for factor in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + factor * d or 1e-300)
            c = 1 + factor / c or 1e-300
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    tail = front * value / a
    return 1 - tail if flip else tail


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation r over n pairs; null under three pairs or without r."""
    def one(r, n):
        if pd.isna(r) or n < 3:
            return None
        return 0.0 if abs(r) >= 1 else _upper_t(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)

    return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="float64")


def correlation(rows: DataFrame, x: str, y: str, by: str | None = None, digits: int = 9) -> DataFrame:
    """Pearson's r, the t value that belongs to it, and n; null under three pairs."""
    n, r = F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull()), F.corr(x, y)
    c = (rows.groupBy(by) if by else rows).agg(n.alias("n"), r.alias("r")).withColumn("r", F.when((F.col("n") >= 3) & ~F.isnan("r"), F.col("r")))
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2.0, 1 - F.col("r") * F.col("r")))
    return c.withColumn("t", t)


def confident(confidence: Column, least: float = 0.5) -> Column:
    return F.coalesce(confidence >= least, F.lit(False))


def median_of_medians(rows: DataFrame, pair: str, method: str, value: str) -> DataFrame:
    """Per method the median over pairs of each pair's median, and how many pairs it covers."""
    per_pair = rows.groupBy(pair, method).agg(F.median(value).alias("m"))
    return per_pair.groupBy(method).agg(F.median("m").alias("median"), F.count("*").alias("n_pairs"))


def detail_bin(spectrum: DataFrame, bin: str, energy: str, share: float) -> DataFrame:
    """The first bin up to which `share` of the energy lies; a spectrum has a few bins."""
    so_far = F.sum(energy).over(Window.orderBy(bin)) / F.sum(energy).over(Window.partitionBy())
    return spectrum.withColumn("_share", so_far).filter(F.col("_share") >= share).agg(F.min(bin).alias("detail_bin"))

"""Fits that bear wrong matches, and normals of landmark clouds; a group is one pair or image."""

from __future__ import annotations

import json
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import by_key


def _centred(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points moved to their mean and scaled to a mean distance of sqrt 2, and the matrix of it."""
    middle = p.mean(axis=0)
    scale = np.sqrt(2) / max(np.hypot(*(p - middle).T).mean(), 1e-12)
    return (p - middle) * scale, np.array([[scale, 0, -scale * middle[0]], [0, scale, -scale * middle[1]], [0, 0, 1]])


#: Matches whose equations are held at once.
BLOCK = 50_000


def homography_of(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """The homography that maps src to dst best, by the direct linear transform. Of many equations only the
    triangle of their QR decomposition is kept, block by block, which has the same null direction."""
    (a, ta), (b, tb) = _centred(src), _centred(dst)
    system = np.zeros((0, 9))
    for at in range(0, len(a), BLOCK):
        (x, y), (u, v) = a[at : at + BLOCK].T, b[at : at + BLOCK].T
        zero, one = np.zeros(len(x)), np.ones(len(x))
        rows = np.stack([x, y, one, zero, zero, zero, -x * u, -y * u, -u], axis=1), np.stack([zero, zero, zero, x, y, one, -x * v, -y * v, -v], axis=1)
        system = np.vstack([system, *rows])
        if len(system) > 9:
            system = np.linalg.qr(system, mode="r")
    h = np.linalg.inv(tb) @ np.linalg.svd(system)[2][-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def similarity_of(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    """Scale, rotation and shift in the form of a homography, least squares over complex numbers."""
    a, b = src @ [1, 1j], dst @ [1, 1j]
    spread = a - a.mean()
    if not np.abs(spread).sum() > 1e-12:
        return None
    turn = (np.conj(spread) @ (b - b.mean())) / (np.conj(spread) @ spread)
    shift = b.mean() - turn * a.mean()
    return np.array([[turn.real, -turn.imag, shift.real], [turn.imag, turn.real, shift.imag], [0, 0, 1.0]])


def _errors(h: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    p = np.column_stack([src, np.ones(len(src))]) @ h.T
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.hypot(*(p[:, :2] / p[:, 2:] - dst).T), nan=np.inf)


KINDS = {"homography": (homography_of, 4), "similarity": (similarity_of, 2)}


def consensus(src: np.ndarray, dst: np.ndarray, kind: str, limit: float, rounds: int, seed: int, sure: float = 0.9999) -> tuple[np.ndarray | None, np.ndarray]:
    """The transform that most matches agree with, refitted to them, and which they are. Sampling ends after
    `rounds`, or once a sample without a wrong match has been met so surely, given how many agree."""
    fit, least = KINDS[kind]
    draw, best = np.random.default_rng(seed), np.zeros(len(src), bool)
    if len(src) < least:
        return None, best
    for done in range(rounds):
        if done and done * -np.log1p(-min(best.mean() ** least, 1 - 1e-12)) >= -np.log(1 - sure):
            break
        some = draw.choice(len(src), least, replace=False)
        h = fit(src[some], dst[some])
        if h is None or not np.isfinite(h).all():
            continue
        near = _errors(h, src, dst) <= limit
        if near.sum() > best.sum():
            best = near
    return (fit(src[best], dst[best]) if best.sum() >= least else None), best


def robust_fits(matches: DataFrame, pair: str | list[str], kind: str = "homography", limit: float = 4.0, rounds: int = 2000) -> DataFrame:
    """(pair, n, n_agree, transform): of matches (pair, x, y, u, v), by random sampling with a seed that
    the pair gives, so that a task that runs again draws alike. No transform where too few agree. A pair
    may have several columns; a task holds the numbers of its matches."""
    by = [pair] if isinstance(pair, str) else pair
    keys = ", ".join(f"{c} {dict(matches.dtypes)[c]}" for c in by)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["x", "y", "u", "v"])
        value = rows[by].astype(object).iloc[0].tolist() if len(rows) else [None] * len(by)
        name = str(value[0]) if len(by) == 1 else json.dumps(dict(zip(by, value)), separators=(",", ":"), default=str)
        p = rows[["x", "y", "u", "v"]].to_numpy(float)
        p = p[np.lexsort(p.T[::-1])]
        h, agree = consensus(p[:, :2], p[:, 2:], kind, limit, rounds, zlib.crc32(name.encode()))
        return pd.DataFrame({c: [v] for c, v in zip(by, value)} | {"n": [len(rows)], "n_agree": [int(agree.sum())], "transform": [None if h is None else h.ravel().tolist()]})

    return by_key(matches, *by).groupBy(*by).applyInPandas(fit, f"{keys}, n long, n_agree long, transform array<double>")


#: Pairs of points that `least_median` tries at most, and errors or distances that are held at once.
MOST_PAIRS, MOST_ERRORS = 2000, 1 << 19


def least_median(src: np.ndarray, dst: np.ndarray, most: int = MOST_PAIRS, seed: int = 0) -> tuple[np.ndarray | None, np.ndarray]:
    """The similarity with the least median of squared errors, refitted to the points near it, and which
    they are; up to half of the points may be anywhere. All pairs of points are tried, or `most` drawn
    ones. Near are those within 2.5 deviations as the median tells them, at least a thousandth of a pixel."""
    n, best = len(src), np.zeros(len(src), bool)
    if n < 2:
        return None, best
    i, j = np.triu_indices(n, 1)
    if len(i) > most:
        some = np.random.default_rng(seed).choice(len(i), most, replace=False)
        i, j = i[some], j[some]
    a, b = src @ [1, 1j], dst @ [1, 1j]
    apart = a[j] - a[i]
    i, j, apart = i[apart != 0], j[apart != 0], apart[apart != 0]
    if not len(i):
        return None, best
    turn = (b[j] - b[i]) / apart
    errors = np.abs(turn[:, None] * a + (b[i] - turn * a[i])[:, None] - b) ** 2
    medians = np.median(errors, axis=1)
    k = int(np.argmin(medians))
    limit = max(2.5 * 1.4826 * (1 + 5 / max(n - 2, 1)) * np.sqrt(medians[k]), 1e-3)
    best = errors[k] <= limit**2
    return similarity_of(src[best], dst[best]), best


def least_median_fits(matches: DataFrame, pair: str) -> DataFrame:
    """`robust_fits` for similarities by the least median, with no limit to choose."""
    kind = dict(matches.dtypes)[pair]

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        value = rows[pair].iloc[0]
        rows = rows.dropna(subset=["x", "y", "u", "v"]).sort_values(["x", "y", "u", "v"])
        h, near = least_median(rows[["x", "y"]].to_numpy(float), rows[["u", "v"]].to_numpy(float), seed=zlib.crc32(str(value).encode()))
        return pd.DataFrame({pair: [value], "n": [len(rows)], "n_agree": [int(near.sum())], "transform": [None if h is None else h.ravel().tolist()]})

    return by_key(matches, pair).groupBy(pair).applyInPandas(fit, f"{pair} {kind}, n long, n_agree long, transform array<double>")


def _least_medians(p: np.ndarray) -> list:
    """The transforms of `least_median` for groups of equally many points: (group, point, x y u v)."""
    n = p.shape[1]
    i, j = np.triu_indices(n, 1)
    a, b = p[..., 0] + 1j * p[..., 1], p[..., 2] + 1j * p[..., 3]
    apart = a[:, j] - a[:, i]
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = (b[:, j] - b[:, i]) / apart
        errors = np.abs(turn[..., None] * a[:, None] + (b[:, i] - turn * a[:, i])[..., None] - b[:, None]) ** 2
    medians = np.where(apart != 0, np.median(errors, axis=2), np.inf)
    k = np.argmin(medians, axis=1)
    own = np.arange(len(p))
    limit = np.maximum(2.5 * 1.4826 * (1 + 5 / max(n - 2, 1)) * np.sqrt(medians[own, k]), 1e-3)
    near = (errors[own, k] <= limit[:, None] ** 2) & np.isfinite(limit)[:, None]
    count = np.maximum(near.sum(axis=1), 1)
    ma, mb = ((c * near).sum(axis=1) / count for c in (a, b))
    da, db = (a - ma[:, None]) * near, (b - mb[:, None]) * near
    there = np.abs(da).sum(axis=1) > 1e-12
    turn = (np.conj(da) * db).sum(axis=1) / np.where(there, (np.conj(da) * da).sum(axis=1), 1)
    shift = mb - turn * ma
    zero, one = np.zeros(len(p)), np.ones(len(p))
    fits = np.stack([turn.real, -turn.imag, shift.real, turn.imag, turn.real, shift.imag, zero, zero, one], axis=1).tolist()
    return [h if yes else None for h, yes in zip(fits, there)]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def least_median_of(points: pd.Series) -> pd.Series:
    """The transform of `least_median` for each row's own few matches, an array of (x, y, u, v); null without one. Rows with
    as many matches are fitted together, those with more pairs than `least_median` tries by themselves."""
    out = pd.Series([None] * len(points), dtype=object)
    sizes = points.map(len)
    for n, rows in points.groupby(sizes).groups.items():
        step = max(1, MOST_ERRORS // max(1, n**3))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            p = np.array([[[r["x"], r["y"], r["u"], r["v"]] for r in points[k]] for k in some], float).reshape(len(some), n, 4)
            if n < 2:
                continue
            fits = _least_medians(p) if n * (n - 1) // 2 <= MOST_PAIRS else [None if (h := least_median(q[:, :2], q[:, 2:])[0]) is None else h.ravel().tolist() for q in p]
            for k, h in zip(some, fits):
                out[k] = h
    return out


def _facing(p: np.ndarray, neighbours: int) -> np.ndarray:
    """How far the surface at each point of images (image, point, x y z) turns to the viewer; see `facing`."""
    n, k = p.shape[1], min(neighbours, p.shape[1])
    apart = sum((p[:, :, None, c] - p[:, None, :, c]) ** 2 for c in range(3))
    last = np.partition(apart, k - 1, axis=2)[..., k - 1 : k]
    near, ties = apart < last, apart == last
    if (many := ties.sum(axis=2) + near.sum(axis=2) > k).any():  # of equal distances the first ones
        ties[many] &= np.cumsum(ties[many], axis=1) <= k - near[many].sum(axis=1)[:, None]
    at = np.nonzero(near | ties)[2].reshape(len(p), n, k)
    cloud = p[np.arange(len(p))[:, None, None], at]
    cloud = cloud - cloud.mean(axis=2, keepdims=True)
    normal = flat_direction(cloud.reshape(-1, k, 3)).reshape(p.shape)
    normal *= np.where((normal * (p - p.mean(axis=1, keepdims=True))).sum(axis=2) < 0, -1, 1)[..., None]
    return -normal[..., 2]


def flat_direction(cloud: np.ndarray) -> np.ndarray:
    """The unit vector along which each centred cloud (cloud, point, x y z) is least wide: of its moments' least eigenvalue in
    closed form; clouds that hardly are a surface (close to a line, or nearly as wide in that direction) by SVD."""
    m = np.matmul(cloud.transpose(0, 2, 1), cloud)
    size = np.trace(m, axis1=1, axis2=2)
    m = m / np.where(size > 0, size, 1)[:, None, None]
    a, b, c, d, e, f = m[:, 0, 0], m[:, 1, 1], m[:, 2, 2], m[:, 0, 1], m[:, 0, 2], m[:, 1, 2]
    mean = (a + b + c) / 3
    wide = np.sqrt(((a - mean) ** 2 + (b - mean) ** 2 + (c - mean) ** 2 + 2 * (d * d + e * e + f * f)) / 6)
    x, y, z = a - mean, b - mean, c - mean
    det = x * (y * z - f * f) - d * (d * z - f * e) + e * (d * f - y * e)
    turn = np.arccos(np.clip(det / (2 * np.where(wide > 0, wide, 1) ** 3), -1, 1)) / 3
    least, middle = mean + 2 * wide * np.cos(turn + 2 * np.pi / 3), mean + 2 * wide * np.cos(turn - 2 * np.pi / 3)
    x, y, z = a - least, b - least, c - least
    # Products of two rows of the moments less the eigenvalue; the longest one is the most exact.
    r = np.stack([np.stack([d * f - e * y, e * d - x * f, x * y - d * d], 1), np.stack([d * z - e * f, e * e - x * z, x * f - d * e], 1), np.stack([y * z - f * f, f * e - d * z, d * f - y * e], 1)], 1)
    length = (r * r).sum(axis=2)
    best = np.argmax(length, axis=1)
    own = np.arange(len(m))
    with np.errstate(divide="ignore", invalid="ignore"):
        out = r[own, best] / np.sqrt(length[own, best])[:, None]
    if (doubtful := ~(middle - least > 1e-3)).any():
        out[doubtful] = np.linalg.svd(cloud[doubtful])[2][:, -1]
    return out


def facing(landmarks: DataFrame, image: str, neighbours: int = 12) -> DataFrame:
    """(image, id, facing): how far the surface at each landmark (image, id, x, y, z) turns to the viewer,
    from 1 (towards -z) to -1: the normal of the plane through its nearest neighbours, pointing away
    from the middle of all. Images come one after the other and are worked on many at once."""
    kinds = dict(landmarks.dtypes)

    def normals(batches):
        held = []
        for rows in batches:
            key = rows[image].to_numpy()
            # A null image is one like others; its key differs from itself as NaN.
            cuts = np.flatnonzero((key[1:] != key[:-1]) & ~(pd.isna(key[1:]) & pd.isna(key[:-1]))) + 1
            first = key[:1].tolist()
            if held and len(rows) and not (held[-1][image].iloc[-1:].tolist() == first or pd.isna(first[0]) and pd.isna(held[-1][image].iloc[-1])):
                yield from whole(held)
                held = []
            if len(cuts):
                yield from whole([*held, rows.iloc[: cuts[-1]]])
                held = [rows.iloc[cuts[-1] :]]
            elif len(rows):
                held.append(rows)
        if held:
            yield from whole(held)

    def whole(pieces):
        """Rows of whole images, in the order of their landmarks."""
        rows = pd.concat(pieces) if len(pieces) > 1 else pieces[0]
        key = rows[image].to_numpy()
        number = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) & ~(pd.isna(key[1:]) & pd.isna(key[:-1])))])
        rows = rows.iloc[np.lexsort((rows["id"].to_numpy(), number))]
        size = np.bincount(number)
        p, start, out = rows[["x", "y", "z"]].to_numpy(float), np.cumsum(size) - size, np.empty(len(rows))
        for n in np.unique(size).tolist():
            alike = start[size == n]
            step = max(1, MOST_ERRORS // (n * n))
            for at in range(0, len(alike), step):
                places = alike[at : at + step, None] + np.arange(n)
                out[places] = _facing(p[places], neighbours)
        yield pd.DataFrame({image: rows[image], "id": rows["id"], "facing": out})

    dealt = by_key(landmarks.select(image, "id", "x", "y", "z"), image).sortWithinPartitions(image)
    return dealt.mapInPandas(normals, f"{image} {kinds[image]}, id {kinds['id']}, facing double")


def visible_shares(turned: DataFrame, regions: DataFrame, image: str, *more: Column, least: float = 0.0) -> DataFrame:
    """Share of each region's landmarks that face the viewer, and what `more` aggregates of `facing` ask for; regions
    (id, region) are a small table."""
    j = turned.join(F.broadcast(regions), "id")
    return j.groupBy(image, "region").agg(F.count("*").alias("n"), F.avg((F.col("facing") > least).cast("int")).alias("share"), *more)

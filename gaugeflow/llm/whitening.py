"""Embedding whitening: an incremental eigendecomposition by rank-one updates, refined on all rows."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

#: Entries are whole numbers of 1/64 above one million below zero.
SCALE, SHIFT = 64, 1_000_000
#: Scaled entries end here, so that a double holds each exactly.
FAR = 1 << 52
#: Components whose share of the first one's variance isn't above this count as without variance.
NOTHING = 1e-12
SPECTRUM = "id long, m long, sums array<decimal(38,0)>, mean array<double>, values array<double>, vectors array<double>"
EPS = np.finfo(float).eps


def secular_roots(values: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z^2 / (values - x), one above each of the ascending, distinct `values`: as distances
    from the nearer pole, and all poles as seen from there, one row a root.

    Each step fits the sum below and above a root by a pole each and takes the root of that; where it
    leaves the bracket, the middle of the bracket.
    """
    n, w = len(values), z * z
    k = np.arange(n)
    width = np.append(np.diff(values), w.sum())
    middle = 1 + (w / (values - (values + width / 2)[:, None])).sum(axis=1)
    right = (middle < 0) & (k < n - 1)
    poles = values - values[k + right][:, None]
    below = k[:, None] >= k
    at = k + 1 < n
    left_pole, right_pole = poles[k, k], np.where(at, poles[k, np.minimum(k + 1, n - 1)], np.inf)
    low, high = left_pole.copy(), left_pole + width
    low[right], high[at & ~right] = low[right] / 2, high[at & ~right] / 2
    x = (low + high) / 2
    with np.errstate(all="ignore"):
        for _ in range(80):
            gap = poles - x[:, None]
            t = w / gap
            slopes = t / gap
            psi, phi = (t * below).sum(axis=1), (t * ~below).sum(axis=1)
            f = 1 + psi + phi
            low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
            small = np.abs(f) <= EPS * n * (1 + np.abs(psi) + phi)
            if (small | (high - low <= 2 * EPS * np.abs(x))).all():
                break
            u, v = left_pole - x, right_pole - x
            dpsi, dphi = (slopes * below).sum(axis=1), (slopes * ~below).sum(axis=1)
            a, b = u * u * dpsi, np.where(at, v * v * dphi, 0)
            c = 1 + psi - u * dpsi + np.where(at, phi - v * dphi, 0)
            half, rest = (c * (u + v) + a + b) / 2, c * u * v + a * v + b * u
            root = np.sqrt(half * half - c * rest)
            step = np.where(half > 0, rest / (half + root), (half - root) / c)
            other = np.where(half > 0, (half + root) / c, rest / (half - root))
            alone = u + a / c
            following = x + np.where(at, step, alone)
            second = x + other
            inside = (following > low) & (following < high)
            following = np.where(inside | ~at, following, second)
            inside = (following > low) & (following < high)
            x = np.where(small, x, np.where(inside, following, (low + high) / 2))
    return x, poles


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and vectors of Q diag(values) Q' + v v'.

    Deflation: within a run of equal values the vectors are turned so that one of them takes all of v;
    what v doesn't touch stays as it is. The rest has its values from the secular equation, and
    vectors from the z for which these values are exact, so that they stay orthogonal.
    """
    z = v @ vectors
    size = float(np.sqrt(z @ z))
    if not size:
        return values, vectors
    tight = 8 * EPS * max(values[-1], size * size)
    cuts = np.flatnonzero(np.diff(values) > tight) + 1
    if len(cuts) + 1 < len(values):
        vectors = vectors.copy()
        for part in np.split(np.arange(len(values)), cuts):
            if len(part) > 1 and (length := np.sqrt(z[part] @ z[part])):
                mirror = z[part].copy()
                mirror[-1] += np.copysign(length, mirror[-1])
                vectors[:, part] -= np.outer(vectors[:, part] @ mirror, mirror) * (2 / (mirror @ mirror))
                end = -np.copysign(length, z[part[-1]])
                z[part], z[part[-1]] = 0, end
    live = np.flatnonzero(np.abs(z) * size > tight)
    if not live.size:
        return values, vectors
    lam = values[live]
    x, poles = secular_roots(lam, z[live])
    gap = poles - x[:, None]
    apart = np.abs(lam - lam[:, None])
    np.fill_diagonal(apart, 1)
    exact = np.exp((np.log(np.abs(gap)).sum(axis=0) - np.log(apart).sum(axis=0)) / 2)
    turn = np.copysign(exact, z[live]) / gap
    turn /= np.sqrt((turn * turn).sum(axis=1))[:, None]
    origin = lam - np.diagonal(poles)
    values, vectors = values.copy(), vectors.copy()
    values[live] = origin + x
    vectors[:, live] = vectors[:, live] @ turn.T
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, exact sums, mean and eigendecomposition of the scatter of the vectors added so far."""

    def __init__(self, width: int):
        self.m, self.sums, self.mean = 0, [0] * width, np.zeros(width)
        self.values, self.vectors = np.zeros(width), np.eye(width)

    def add(self, x: np.ndarray) -> None:
        off = x - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, off * np.sqrt(self.m / (self.m + 1)))
        self.m += 1
        self.mean = self.mean + off / self.m

    def merge(self, m: int, sums: list, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> None:
        """Adds another spectrum: its components one by one, then the way between the means."""
        for value, vector in zip(values, vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector * np.sqrt(value))
        off = mean - self.mean
        self.values, self.vectors = rank_one(self.values, self.vectors, off * np.sqrt(self.m * m / (self.m + m)))
        self.m += m
        self.mean = self.mean + off * (m / self.m)
        self.sums = [a + int(b) for a, b in zip(self.sums, sums)]

    def row(self, id: int) -> pd.DataFrame:
        return pd.DataFrame({"id": [id], "m": [self.m], "sums": [[Decimal(s) for s in self.sums]], "mean": [self.mean], "values": [self.values], "vectors": [self.vectors.ravel()]})


def _spectra(batches):
    """The spectrum of a task's rows, if it has any."""
    mine = None
    for rows in batches:
        if len(rows):
            x = np.stack(rows["x"].to_numpy())
            mine = mine or Spectrum(x.shape[1])
            for k in range(0, len(x), 1024):
                mine.sums = [a + int(b) for a, b in zip(mine.sums, x[k : k + 1024].sum(axis=0))]
            for row in (x - SHIFT).astype(float):
                mine.add(row)
            part = int(rows["part"].iloc[0])
    if mine:
        yield mine.row(part)


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    width = len(rows["mean"].iloc[0])
    out = Spectrum(width)
    for r in rows.sort_values("id").itertuples():
        out.merge(r.m, r.sums, np.asarray(r.mean), np.asarray(r.values), np.reshape(r.vectors, (width, width)))
    return out.row(int(rows["up"].iloc[0]))


def spectrum(fit: DataFrame, fan: int = 8) -> Spectrum | None:
    """The spectrum of all rows of `fit` (x): one per task, then of eight at a time until one is left, whose
    size is that of the dimensions squared. None for an empty table."""
    now = staged(fit.withColumn("part", F.spark_partition_id().cast("long")).mapInPandas(_spectra, SPECTRUM), "spectra")
    while (state := now.agg(F.count("*"), F.max("id")).first())[0] > 1:
        now = staged(now.withColumn("up", F.floor(F.col("id") / fan)).groupBy("up").applyInPandas(_merged, SPECTRUM), "spectra")
    if not state[0]:
        return None
    r, out = now.first(), Spectrum(0)
    out.m, out.sums, out.mean, out.values = r.m, [int(s) for s in r.sums], np.array(r.mean), np.array(r["values"])
    out.vectors = np.reshape(r.vectors, (len(r.mean),) * 2)
    return out


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, from whole numbers where 64 bits hold them."""
    if np.abs(x).max(initial=0) < (1 << 62) / n and np.abs(sums.astype(float)).max(initial=0) < 1 << 62:
        return (n * x - sums.astype(np.int64)) / n
    return ((n * x.astype(object) - sums) / n).astype(float)


def projected_covariance(fit: DataFrame, n: int, sums: list, basis: np.ndarray) -> np.ndarray:
    """The covariance (divisor n, centred) of all rows in `basis`: a partial sum per task, added up by entry."""
    exact = np.array(sums, dtype=object)
    i, j = np.triu_indices(basis.shape[1])

    def partial(batches):
        total = np.zeros((basis.shape[1],) * 2)
        for rows in batches:
            if len(rows):
                y = _centred(np.stack(rows["x"].to_numpy()), n, exact) @ basis
                total += y.T @ y
        yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    cells = fit.mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((basis.shape[1],) * 2)
    out[cells["i"], cells["j"]] = out[cells["j"], cells["i"]] = cells["v"] / n
    return out


class Components:
    """Count, sums, unit eigenvectors (columns) and variances, falling, of the covariance, and its trace."""

    def __init__(self, n: int, sums: list, basis: np.ndarray, variances: np.ndarray, trace: float):
        self.n, self.sums, self.basis, self.variances, self.trace = n, sums, basis, variances, trace


def components(fit: DataFrame, most: int, passes: int = 2) -> Components | None:
    """Up to `most` components of the rows of `fit` (x), those without variance left out.

    The spectrum's vectors, made orthonormal, are the basis of a Rayleigh-Ritz step over all rows; a
    second pass starts from its result. The basis is whole, so the step's vectors are those of the
    covariance itself, and the spectrum's rounding errors don't last.
    """
    found = spectrum(fit)
    if found is None or not len(found.mean):
        return None
    basis = np.linalg.qr(found.vectors[:, ::-1])[0]
    for _ in range(passes):
        inner = projected_covariance(fit, found.m, found.sums, basis)
        variances, turn = np.linalg.eigh(inner)
        basis, variances = np.linalg.qr(basis @ turn[:, ::-1])[0], variances[::-1]
    keep = min(most, int((variances > NOTHING * max(variances[0], 0)).sum()))
    return Components(found.m, found.sums, basis[:, :keep], variances[:keep], float(np.trace(inner)))


def scaled(rows: DataFrame, vector: str) -> DataFrame:
    """`rows` with x, whole numbers of the vector's entries; without vectors that are null or have null
    or non-finite entries. Entries beyond 2^52 of these units end there."""
    c = F.col(vector).cast("array<double>")
    whole = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    x = F.transform(c, lambda e: F.floor(F.greatest(F.lit(-float(FAR)), F.least(F.lit(float(FAR)), e * SCALE))).cast("long") + SHIFT)
    return rows.filter(F.col(vector).isNotNull() & ~whole).withColumn("x", x)


def _whitener(found: Components):
    exact, shrink = np.array(found.sums, dtype=object), np.sqrt(found.variances)

    @F.pandas_udf("deviation long, whitened array<double>")
    def whiten(x: pd.Series) -> pd.DataFrame:
        rows = np.stack(x.to_numpy())
        white = _centred(rows, found.n, exact) @ found.basis / shrink
        off = found.n * rows.astype(object) - exact
        if np.square(off.astype(float)).sum(axis=1).max() < 1 << 62:
            far = np.square(off.astype(np.int64)).sum(axis=1).tolist()
        else:
            far = [d if (d := sum(int(e) ** 2 for e in row)) < 1 << 63 else None for row in off]
        return pd.DataFrame({"deviation": pd.array(far, dtype="Int64"), "whitened": list(white)})

    return whiten


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 16) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) per row and component.

    Vectors that are null or hold null or non-finite entries are dropped, and those shorter than the
    longest, which aren't of its space. The fit takes each distinct vector once, whatever its key. A
    null or repeated key is kept as it is. Directions without variance (up to 1e-12 of the first
    one's) have no component: one distinct vector alone, or an empty table, gives no rows.
    deviation is null where a long doesn't hold it. Other columns are ignored.
    """
    rows = scaled(rows.select(F.col(key).alias(key), F.col(vector).alias("_v")), "_v").select(key, "x")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    rows = rows.filter(F.size("x") == width) if width else rows.filter(F.lit(False))
    fit = staged(rows.select("x").distinct(), "fit")
    found = components(fit, most)
    if found is None or not len(found.variances):
        return rows.limit(0).select(key, *(F.lit(0).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))))
    white = projected_covariance(fit, found.n, found.sums, found.basis / np.sqrt(found.variances))
    error = float(np.abs(white - np.eye(len(white))).max())
    shares = F.array(*(F.lit(float(e / found.trace)) for e in found.variances))
    out = rows.withColumn("_w", _whitener(found)("x")).select(key, "_w.deviation", F.posexplode("_w.whitened").alias("_k", "whitened"))
    return out.select(
        key,
        (F.col("_k") + 1).alias("component"),
        F.lit(found.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        shares[F.col("_k")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))

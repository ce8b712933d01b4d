"""Head pose from six landmarks and a rigid model, for batches of images at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geometry import euler_degrees

#: The landmarks (tip of the nose, chin, outer eyes and corners of the mouth, the subject's right first) and
#: their places in mm on a generic head.
POSE_LANDMARKS = [1, 152, 33, 263, 61, 291]
MODEL_MM = np.array([[0, 0, 0], [0, -63.6, -12.5], [-43.3, 32.7, -26], [43.3, 32.7, -26], [-28.9, -28.9, -24.1], [28.9, -28.9, -24.1]])


def rotations(w: np.ndarray) -> np.ndarray:
    """Rotation matrices of (n, 3) rotation vectors."""
    angle = np.linalg.norm(w, axis=1)[:, None, None]
    k = np.zeros((len(w), 3, 3))
    k[:, 2, 1], k[:, 0, 2], k[:, 1, 0] = w.T
    k -= k.transpose(0, 2, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = np.where(angle > 1e-9, np.sin(angle) / angle, 1.0), np.where(angle > 1e-6, (1 - np.cos(angle)) / angle**2, 0.5)
    return np.eye(3) + a * k + b * (k @ k)


def starts(model: np.ndarray, rays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations and shifts of (n, points, 2) rays as seen from far away: a scaled projection, made orthonormal."""
    flat = model - model.mean(axis=0)
    onto = np.linalg.pinv(flat) @ (rays - rays.mean(axis=1, keepdims=True))
    i, j = onto[:, :, 0], onto[:, :, 1]
    size = np.sqrt(np.linalg.norm(i, axis=1) * np.linalg.norm(j, axis=1))
    rows = np.stack([i, j, np.cross(i, j)], axis=1)
    rows[:, 2] /= np.maximum(size, 1e-300)[:, None]
    u, _, v = np.linalg.svd(rows)
    r = u @ v
    r[np.linalg.det(r) < 0] *= [[1], [1], [-1]]
    z = 1 / np.maximum(size, 1e-12)
    t = np.column_stack([rays.mean(axis=1) * z[:, None], z]) - np.einsum("nij,j->ni", r, model.mean(axis=0))
    return r, t


def solved(model: np.ndarray, rays: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotations and shifts that put the model onto (n, points, 2) rays (image points from the middle, over the
    focal length) with the least sum of squares, and which of them ended well. Gauss-Newton steps
    over a small rotation and the shift, damped until each lowers the error."""
    good = np.isfinite(rays).all(axis=(1, 2)) & (np.ptp(np.nan_to_num(rays), axis=1).max(axis=1) > 1e-9)
    rays = np.where(good[:, None, None], rays, np.arange(2 * len(model)).reshape(-1, 2) / 10)
    r, t = starts(model, rays)
    n, damp = len(rays), np.full(len(rays), 1e-3)

    def off(r, t):
        p = np.einsum("nij,kj->nki", r, model)
        q = p + t[:, None]
        z = np.where(q[:, :, 2] > 1e-9, q[:, :, 2], np.nan)
        return p, q[:, :, :2] / z[..., None], z, ((q[:, :, :2] / z[..., None] - rays) ** 2).sum(axis=(1, 2))

    p, seen, z, error = off(r, t)
    for _ in range(rounds):
        jac = np.zeros((n, len(model), 2, 6))
        cross = np.zeros((n, len(model), 3, 3))  # how a point moves with a small rotation: minus its cross matrix
        cross[..., 0, 1], cross[..., 1, 2], cross[..., 2, 0] = p[..., 2], p[..., 0], p[..., 1]
        cross -= cross.swapaxes(2, 3)
        move = np.concatenate([cross, np.broadcast_to(np.eye(3), cross.shape)], axis=3)
        for c in (0, 1):
            jac[:, :, c] = (move[:, :, c] - seen[..., c, None] * move[:, :, 2]) / z[..., None]
        jac, rest = np.nan_to_num(jac).reshape(n, -1, 6), np.nan_to_num(seen - rays).reshape(n, -1)
        normal = jac.swapaxes(1, 2) @ jac
        normal += (damp[:, None] * np.einsum("nii->ni", normal) + 1e-15)[:, :, None] * np.eye(6)
        step = -np.linalg.solve(normal, np.einsum("nki,nk->ni", jac, rest)[..., None])[..., 0]
        r2, t2 = rotations(step[:, :3]) @ r, t + step[:, 3:]
        p2, seen2, z2, error2 = off(r2, t2)
        better = error2 < error
        r, t, p, seen, z = (np.where(better.reshape(-1, *[1] * (a.ndim - 1)), b, a) for a, b in ((r, r2), (t, t2), (p, p2), (seen, seen2), (z, z2)))
        small = np.abs(step).max(axis=1) < 1e-12 * (1 + np.abs(t).max(axis=1))
        damp = np.where(better, damp / 10, np.minimum(damp * 10, 1e6))
        error = np.where(better, error2, error)
        if (small | (damp >= 1e6)).all():
            break
    return r, t, good & np.isfinite(error)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def rotation_of(x: pd.Series, y: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Nine numbers of the rotation that shows the generic head at six landmarks (arrays of x and y, in the order of
    POSE_LANDMARKS), with a focal length of the image's width; null where there is none."""
    out = pd.Series([None] * len(x), dtype=object)
    whole = [k for k, (a, b, w, h) in enumerate(zip(x, y, width, height)) if a is not None and b is not None and len(a) == len(b) == 6 and w and h and w > 0]
    if whole:
        rays = np.array([[(np.asarray(x[k], float) - width[k] / 2) / width[k], (np.asarray(y[k], float) - height[k] / 2) / width[k]] for k in whole]).swapaxes(1, 2)
        r, _, good = solved(MODEL_MM, rays)
        for k, m, ok in zip(whole, r, good):
            out[k] = m.ravel().tolist() if ok else None
    return out


def head_pose(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Struct of yaw, pitch and roll (degrees) by `rotation_of`; null without a rotation."""
    r = rotation_of(x, y, width, height)
    about_x, about_y, about_z = euler_degrees([[r[3 * i + j] for j in range(3)] for i in range(3)])
    return F.when(r.isNotNull(), F.struct(about_y.alias("yaw"), about_x.alias("pitch"), about_z.alias("roll")))

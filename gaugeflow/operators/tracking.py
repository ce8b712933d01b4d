"""Identity over sessions: detections matched to the last positions of things that are still there."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import by_key

#: How far a thing may be from where it was last (mm), in how many of the latest
#: sessions it must be seen to be born, and after how many absences on end it is resolved.
GATE_MM, BORN_IN, BORN_OF, ABSENT = 4.0, 2, 3, 3
EVENTS = "track long, event string, session long, id long, x double, y double"


def assigned(cost: np.ndarray, gate: float) -> list[tuple[int, int]]:
    """One-to-one pairs (row, column) within the gate: as many as there can be, of least total cost. Rows
    are placed one by one along shortest paths; a place of their own, dearer than all others, is
    what they take when they stay without a partner."""
    n, m = cost.shape
    if not n or not m:
        return []
    alone = (gate + 1) * (min(n, m) + 1)
    wide = np.full((n, m + n), 4.0 * alone)
    wide[:, :m] = np.where(cost <= gate, cost, 4 * alone)
    wide[np.arange(n), m + np.arange(n)] = alone
    u, v, owner = np.zeros(n), np.zeros(m + n), np.full(m + n, -1)
    for row in range(n):
        far, back, done = np.full(m + n, np.inf), np.full(m + n, -1), np.zeros(m + n, bool)
        now, reached, at = row, 0.0, -1
        while True:
            step = reached + wide[now] - u[now] - v
            better = ~done & (step < far)
            far[better], back[better] = step[better], at
            at = int(np.argmin(np.where(done, np.inf, far)))
            reached, done[at] = far[at], True
            if owner[at] < 0:
                break
            now = owner[at]
        others = done & (owner >= 0)
        u[row] += reached
        u[owner[others]] += reached - far[others]
        v[done] -= reached - far[done]
        while at >= 0:
            owner[at] = owner[back[at]] if back[at] >= 0 else row
            at = back[at]
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0 and cost[owner[j], j] <= gate)


def step(state: dict, session: int, points: list[tuple], gate: float, born_in: int, of: int, absent: int) -> list[tuple]:
    """Takes one session's points (id, x, y) into `state` (next, tracks) and returns what happened to which
    track, as rows of EVENTS. A session without points is one in which nothing was seen."""
    tracks, out = state["tracks"], []
    points = sorted(points, key=lambda p: (p[0] is None, p[0] or 0, p[1], p[2]))
    at = np.array([[t["x"], t["y"]] for t in tracks]).reshape(-1, 2)
    seen = np.array([p[1:] for p in points], float).reshape(-1, 2)
    of_point = {j: tracks[i] for i, j in assigned(np.hypot(*(at[:, None] - seen[None]).transpose(2, 0, 1)), gate)}
    for j, (id, x, y) in enumerate(points):
        track = of_point.get(j)
        if track is None:
            track = {"track": state["next"], "recent": [], "born": None}
            state["next"] += 1
            tracks.append(track)
        track |= {"x": float(x), "y": float(y), "last": session, "recent": [s for s in track["recent"] if s > session - of] + [session]}
        out.append((track["track"], "seen", session, id, x, y))
        if track["born"] is None and len(track["recent"]) >= born_in:
            track["born"] = session
            out.append((track["track"], "born", session, id, x, y))
    for track in tracks:
        if session - track["last"] >= absent:
            out.append((track["track"], "resolved", track["last"] + 1, None, track["x"], track["y"]))
    state["tracks"] = [t for t in tracks if session - t["last"] < absent]
    return out


def fold(state: dict | None, rows: pd.DataFrame, gate: float = GATE_MM, born_in: int = BORN_IN, of: int = BORN_OF, absent: int = ABSENT) -> tuple[dict, pd.DataFrame]:
    """`step` over rows (session, id, x, y) in the order of sessions, from a state on; null places are no
    points, so that a row of nulls tells of a session. Sessions before the state's last are left out."""
    state = state or {"next": 0, "tracks": [], "done": None}
    out = []
    for session, part in rows.dropna(subset=["session"]).sort_values("session").groupby("session"):
        if state["done"] is not None and session <= state["done"]:
            continue
        part = part.dropna(subset=["x", "y"])
        ids = [None if pd.isna(i) else int(i) for i in part["id"]]
        out += step(state, int(session), list(zip(ids, part["x"], part["y"])), gate, born_in, of, absent)
        state["done"] = int(session)
    table = pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])
    return state, table.astype({"track": "int64", "session": "int64", "id": "Int64"})


def track(detections: DataFrame, region: str, **rules: float) -> DataFrame:
    """What happened to which track of each region, from all detections (region, session, id, x, y) at
    once: seen, born and resolved (dated back to the first absence). A task holds one region's history,
    as each session needs the positions that the one before left."""
    kind = dict(detections.dtypes)[region]

    def all_sessions(rows: pd.DataFrame) -> pd.DataFrame:
        _, out = fold(None, rows, **rules)
        out.insert(0, region, rows[region].iloc[0])
        return out

    slim = detections.select(region, "session", "id", "x", "y")
    return by_key(slim, region).groupBy(region).applyInPandas(all_sessions, f"{region} {kind}, {EVENTS}")


def durations(events: DataFrame, region: str) -> DataFrame:
    """(region, track, first, born, last, sessions): of tracks that were born, from the first sighting to the last; sessions
    counts both ends, and is null while the track isn't resolved."""
    at = lambda event, f: f(F.when(F.col("event") == event, F.col("session")))
    t = events.groupBy(region, "track").agg(at("seen", F.min).alias("first"), at("born", F.min).alias("born"), at("seen", F.max).alias("last"), at("resolved", F.max).alias("resolved"))
    return t.filter("born IS NOT NULL").select(region, "track", "first", "born", "last", F.when(F.col("resolved").isNotNull(), F.col("last") - F.col("first") + 1).alias("sessions"))


def density(points: DataFrame, region: str, cell: float, width: float, reach: float = 3.0) -> DataFrame:
    """(region, cx, cy, density): a Gaussian of `width` around the points (region, x, y), per unit of area, at the
    middles of the cells within `reach` widths of any. Points are counted by cell first, so each counts at the
    middle of its own; the kernel is a table of offsets, as small as the reach in cells, and a
    cell's density the sum of what its neighbours give. What lies further away gives nothing."""
    far = int(reach * width // cell) + 1
    steps = F.sequence(F.lit(-far), F.lit(far))
    counted = points.dropna(subset=["x", "y"]).groupBy(region, F.floor(F.col("x") / cell).alias("i"), F.floor(F.col("y") / cell).alias("j")).agg(F.count("*").alias("n"))
    spark = points.sparkSession
    d2 = (F.col("di") * F.col("di") + F.col("dj") * F.col("dj")) * (cell * cell)
    offsets = spark.range(1).select(F.explode(steps).alias("di")).select("di", F.explode(steps).alias("dj")).filter(d2 <= (reach * width) ** 2)
    kernel = offsets.groupBy().agg(F.array_sort(F.collect_list(F.struct("di", "dj", (F.exp(d2 / (-2 * width * width)) / (2 * math.pi * width * width)).alias("w")))).alias("kernel"))
    each = counted.join(F.broadcast(kernel)).select(region, "i", "j", "n", F.explode("kernel").alias("k"))
    return each.groupBy(region, (F.col("i") + F.col("k.di")).alias("cx"), (F.col("j") + F.col("k.dj")).alias("cy")).agg(F.sum(F.col("n") * F.col("k.w")).alias("density"))

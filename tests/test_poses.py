import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import pose, tables
from gaugeflow.operators import capture, robust, stability, tiling, tracking


def turned(pitch, yaw, roll):
    x, y, z = np.radians([pitch, yaw, roll])
    rx = np.array([[1, 0, 0], [0, math.cos(x), -math.sin(x)], [0, math.sin(x), math.cos(x)]])
    ry = np.array([[math.cos(y), 0, math.sin(y)], [0, 1, 0], [-math.sin(y), 0, math.cos(y)]])
    rz = np.array([[math.cos(z), -math.sin(z), 0], [math.sin(z), math.cos(z), 0], [0, 0, 1]])
    return rz @ ry @ rx


def projected(r, t, w, h):
    p = pose.MODEL_MM @ r.T + t
    return p[:, :2] / p[:, 2:] * w + [w / 2, h / 2]


def test_facing_of_many_images_at_once(spark):
    """Images of several sizes, in batches that cut them, as each by itself; flat, straight and tied ones, too."""
    draw, rows, want = np.random.default_rng(9), [], {}
    for k in range(60):
        n = [40, 41, 25, 13][k % 4]
        p = np.round(draw.normal(size=(n, 3)) * [1, 1, 0.3], 1 if k % 3 else 9)
        if k % 5 == 0:
            p = np.column_stack([np.arange(n) % 5, np.arange(n) // 5, 0.4 * (np.arange(n) % 5) + 60 * (np.arange(n) >= 20)])
        near = np.argsort(((p[:, None] - p[None]) ** 2).sum(-1), axis=1, kind="stable")[:, :12]
        cloud = p[near] - p[near].mean(axis=1, keepdims=True)
        want |= {(k, i): abs(v) for i, v in enumerate(np.linalg.svd(cloud)[2][:, -1, 2])}
        rows += [(k, i, *map(float, q)) for i, q in enumerate(p)]
    turned = robust.facing(spark.createDataFrame(rows, "image int, id int, x double, y double, z double"), "image")
    assert "FlatMapGroups" not in turned._jdf.queryExecution().toString()  # a task's images one by one
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = {(r.image, r.id): abs(r.facing) for r in turned.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
    line = np.arange(12)[:, None] * np.array([1.0, 2.0, 3.0])
    flat = robust.flat_direction(np.stack([line - line.mean(axis=0), np.zeros((12, 3))]))
    assert np.isfinite(flat).all() and abs(flat[0] @ [1, 2, 3]) < 1e-9


def test_planted_poses_come_back(spark):
    draw, rows, want = np.random.default_rng(4), [], {}
    for k in range(200):
        angles = 180 + draw.uniform(-35, 35), draw.uniform(-70, 70), draw.uniform(-40, 40)
        p = projected(turned(*angles), np.array([*draw.uniform(-60, 60, 2), draw.uniform(350, 900)]), 1200, 1600)
        rows.append((k, p[:, 0].tolist(), p[:, 1].tolist(), 1200, 1600))
        want[k] = angles
    rows += [(900, [5.0] * 6, [5.0] * 6, 1200, 1600), (901, None, None, 1200, 1600), (902, [1.0, 2.0], [1.0, 2.0], 1200, 1600), (903, [float("nan")] * 6, [1.0] * 6, 1200, 1600)]
    df = spark.createDataFrame(rows, "k int, x array<double>, y array<double>, w int, h int")
    got = {r.k: r.p for r in df.select("k", pose.head_pose(F.col("x"), F.col("y"), F.col("w"), F.col("h")).alias("p")).collect()}
    assert all(got[k] is None for k in (900, 901, 902, 903))
    for k, (pitch, yaw, roll) in want.items():
        same = turned(got[k].pitch, got[k].yaw, got[k].roll) @ turned(pitch, yaw, roll).T
        assert np.degrees(np.arccos(min(1.0, (np.trace(same) - 1) / 2))) < 0.1


def test_noise_moves_a_pose_a_little():
    draw = np.random.default_rng(1)
    r, t = turned(185, 30, 5), np.array([10.0, -20.0, 600.0])
    p = (projected(r, t, 1000, 1000) - 500) / 1000 + draw.normal(0, 2e-4, (50, 6, 2))
    found, shift, good = pose.solved(pose.MODEL_MM, p)
    apart = np.degrees(np.arccos(np.clip((np.einsum("nij,ij->n", found, r) - 1) / 2, -1, 1)))
    assert good.all() and np.median(apart) < 1 and np.allclose(np.median(shift, axis=0), t, rtol=0.02, atol=1)


def test_table_functions_equal_the_data_frame_forms(spark):
    tables.register_tables(spark)
    sizes = spark.createDataFrame([("a", 4032, 3024), ("b", 300, 200), ("c", 1281, 1280), ("d", None, 5)], "image string, w int, h int")
    sizes.createOrReplaceTempView("sizes")
    columns = ["image", "tile_id", "row", "col", "x0", "y0", "x1", "y1"]
    got = spark.sql("SELECT * FROM tile_grid(TABLE(sizes), 1280, 1024)").select(*columns)
    want = tiling.grid(sizes.filter("w IS NOT NULL"), "image", "w", "h", 1280, 1024).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    draw = np.random.default_rng(2)
    rows = [(f"2026-01-{1 + int(draw.integers(0, 9)):02d}", ["main", "2x", "none"][int(draw.integers(0, 3))], k) for k in range(90)]
    shots = spark.createDataFrame(rows, "day string, lens string, at int").withColumn("day", F.to_date("day"))
    shots.createOrReplaceTempView("shots")
    got = spark.sql("SELECT * FROM sittings(TABLE(SELECT day, lens, at FROM shots) PARTITION BY (day) ORDER BY (at), 'main', '2x')").collect()
    want = capture.slots(capture.pairs_per_day(shots, "day", "lens", "main", "2x"), "day").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 20


def test_density_equals_a_plain_sum(spark):
    draw = np.random.default_rng(3)
    rows = [(int(g), float(x), float(y)) for g, x, y in zip(draw.integers(0, 2, 80), draw.uniform(-20, 40, 80), draw.uniform(0, 30, 80))]
    out = tracking.density(spark.createDataFrame([*rows, (1, None, 2.0)], "g int, x double, y double"), "g", 1.5, 2.5).collect()
    seen = {(r.g, r.cx, r.cy): r.density for r in out}
    want = {}
    for g, x, y in rows:
        i, j = math.floor(x / 1.5), math.floor(y / 1.5)
        for di in range(-9, 10):
            for dj in range(-9, 10):
                d2 = (di * di + dj * dj) * 2.25
                if d2 <= 7.5**2:
                    want[g, i + di, j + dj] = want.get((g, i + di, j + dj), 0) + math.exp(-d2 / 12.5) / (2 * math.pi * 6.25)
    assert seen.keys() == want.keys() and all(seen[k] == pytest.approx(want[k]) for k in want)
    assert sum(seen.values()) * 2.25 == pytest.approx(80, rel=0.03)


def test_durations_and_anchors(spark):
    events = spark.createDataFrame([(0, 0, "seen", 1), (0, 0, "seen", 2), (0, 0, "born", 2), (0, 0, "resolved", 3), (0, 1, "seen", 5), (0, 1, "seen", 6), (0, 1, "born", 6), (0, 2, "seen", 9)], "region int, track int, event string, session long")
    assert sorted(tuple(r)[1:] for r in tracking.durations(events, "region").collect()) == [(0, 1, 2, 2, 2), (1, 5, 6, 6, None)]
    own, mirrored = ({r.id: r.region for r in stability.region_anchors(spark, m).collect()} for m in (True, False))
    assert len(own) == 34 and own[234] == "cheek_r" and mirrored[234] == "cheek_l" and own[10] == mirrored[10] == "forehead" and own[389] == "temple_sideburn_l"

import datetime as dt
import math
from itertools import permutations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import kernels
from gaugeflow.operators import capture, decisions, registration, scoring, splits, tiling, validation, workspace
from gaugeflow.plans import decision_queries, file_queries, measure_queries, object_queries, point_queries, record_queries  # noqa: F401  register their queries
from gaugeflow.plans.queries import QUERIES, SQL
from gaugeflow.sources import io
from gaugeflow.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or v != v:
        return None
    if isinstance(v, str):
        return v
    if "bool" in str(type(v)):
        return str(bool(v))
    try:
        return float(v)
    except Exception:
        return str(pd.Timestamp(v))


@pytest.mark.parametrize("name", list(SQL))
def test_queries_match_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = [sorted((tuple(cell(v) for v in r) for r in x[cols].itertuples(index=False)), key=str) for x in (got, want)]
    assert rows[0] == rows[1]


def days(spark, n, skip=()):
    first = dt.date(2026, 1, 1)
    return spark.createDataFrame([(first + dt.timedelta(days=i),) for i in range(n) if i not in skip], "d date")


@pytest.mark.parametrize("n,gap", [(12, 0), (40, 3), (60, 5), (100, 2)])
def test_ratio_split_keeps_its_gap(spark, n, gap):
    plan = splits.ratio_split(days(spark, n, skip=(4, 5)), "d", (0.7, 0.15, 0.15), gap)
    rows = {s: [r.d for r in plan.filter(F.col("split") == s).collect()] for s in ("train", "val", "test")}
    assert plan.count() == n - 2 == plan.select("d").distinct().count()
    assert rows["train"] and (min(rows["val"]) - max(rows["train"])).days > gap and (min(rows["test"]) - max(rows["val"])).days > gap


def test_trailing_split_sizes(spark):
    plan = splits.trailing_split(days(spark, 40), "d", 14, 14, 3)
    assert dict(map(tuple, plan.groupBy("split").count().collect())) == {"train": 6, "val": 14, "test": 14, "gap": 6}


def test_too_few_dates(spark):
    with pytest.raises(splits.TooFewDates):
        splits.check_enough(splits.ratio_split(days(spark, 4), "d", (0.7, 0.15, 0.15), 5))


@pytest.mark.parametrize("w,h", [(4032, 3024), (300, 300), (1281, 1280), (2304, 5000)])
def test_tiles_cover_and_own(spark, w, h):
    draw = np.random.default_rng(w)
    points = spark.createDataFrame([(i, 1, float(draw.integers(0, w)), float(draw.integers(0, h)), w, h) for i in range(200)], "id int, image int, x double, y double, w int, h int")
    grid = tiling.grid(points.select("image", "w", "h").distinct(), "image", "w", "h", 1280, 1024)
    inside = tiling.tiles_of(points, grid, "image", "x", "y", "w", "h", 1280, 1024)
    tiles = grid.toPandas()
    assert (tiles.x1 <= w).all() and (tiles.y1 <= h).all()
    want = sum(((tiles.x0 <= r.x) & (r.x < tiles.x1) & (tiles.y0 <= r.y) & (r.y < tiles.y1)).sum() for r in points.collect())
    assert inside.count() == want
    assert tiling.owners(inside, "id", "x", "y").count() == 200


def test_stride_domain():
    assert tiling.stride(1280, 0.2) == 1024
    with pytest.raises(ValueError):
        tiling.stride(10, 1.0)


def test_matching_is_maximal(spark):
    assert scoring._matched([0, 0, 1], [0, 1, 0]) == 2
    draw = np.random.default_rng(3)
    for _ in range(200):
        edges = [(int(a), int(b)) for a, b in draw.integers(0, 4, (6, 2))]
        best = max(sum((i, p[i]) in edges for i in range(4)) for p in permutations(range(4)))
        assert scoring._matched(*zip(*edges)) == best
    truth = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 2.0, 0.0), (2, 2, 0.0, 0.0)], "g int, id int, x double, y double")
    found = spark.createDataFrame([(1, 0, 1.0, 0.0), (1, 1, -1.0, 0.0), (3, 2, 0.0, 0.0)], "g int, id int, x double, y double")
    rows = {r.g: (r.tp, r.fp, r.fn) for r in scoring.match_counts(truth, found, "g", 2.0).collect()}
    assert rows == {1: (2, 0, 0), 2: (0, 0, 1), 3: (0, 1, 0)}


def test_undefined_metrics_are_null(spark):
    r = spark.range(1).select(*scoring.metrics(F.lit(0), F.lit(0), F.lit(0))).first()
    assert (r.precision, r.recall, r.f1) == (None, None, 0.0)


def test_reasons_keep_all(spark):
    r = spark.range(1).select(validation.reasons(a=F.lit(False), b=F.lit(True), c=F.lit(None).cast("boolean")).alias("w")).first()
    assert r.w == ["a", "c"]


def test_service_urls(spark):
    rows = spark.createDataFrame([("https://a.example",), ("http://a.example/x?q=1#f",)], "u string")
    assert [r[0] for r in rows.select(validation.service_url(F.col("u"))).collect()] == [[], ["https", "no_query", "no_fragment", "no_path"]]


def test_export_reader_and_rules(spark, tmp_path):
    import base64, hashlib, json

    content = b"bytes"
    image = {"id": "1", "profile_id": "p", "date": "2026-01-02", "pose": "frontal", "kind": "session", "width": 10, "height": 10, "sha256": hashlib.sha256(content).hexdigest(), "bytes": base64.b64encode(content).decode(), "px_per_mm": 2.0, "reviewed": True, "labels": [{"x": 1, "y": 2, "radius": 3}]}
    bad = {**image, "id": "2", "profile_id": "q", "date": "2026-02-30", "bytes": "@@", "labels": [{"x": 11, "y": 2, "radius": 3}]}
    (tmp_path / "e.json").write_text(json.dumps({"schema": 1, "profile_id": "p", "images": [image, bad]}))
    rows = {r.id: r.reasons for r in validation.images(io.read_export(spark, str(tmp_path / "e.json"))).collect()}
    assert rows == {"1": ["unique_bytes"], "2": ["profile", "unique_bytes", "date", "bytes", "labels"]}


def test_control_points_round_trip(spark, tmp_path):
    points = spark.createDataFrame([("a", 2, 1.005, 2.0), ("a", 1, 3.0, 4.126)], "image string, id int, x double, y double")
    io.write_control_points(points, str(tmp_path / "cp"))
    assert sorted(map(tuple, io.read_control_points(spark, str(tmp_path / "cp")).collect())) == [("a", 1, 3.0, 4.13), ("a", 2, 1.0, 2.0)]
    with pytest.raises(Exception):
        io.write_control_points(points, str(tmp_path / "cp"))


def test_similarity_and_splines(spark):
    draw, angle = np.random.default_rng(1), math.radians(30)
    xy = draw.random((12, 2)) * 100
    uv = 2 * xy @ np.array([[math.cos(angle), math.sin(angle)], [-math.sin(angle), math.cos(angle)]]) + [5, -3]
    points = spark.createDataFrame([("p", *map(float, r)) for r in np.hstack([xy, uv])], "pair string, x double, y double, u double, v double")
    s = registration.similarity(points, "pair").first()
    assert np.allclose([s.scale, s.degrees, s.tx, s.ty], [2, 30, 5, -3])
    fit = registration.fit_splines(points, "pair").toPandas()
    assert np.allclose(fit[fit.part == "node"][["wu", "wv"]], 0, atol=1e-6)


def test_kernels(spark):
    flat = np.full((8, 8), 255.0)
    assert kernels.laplacian_variance(flat) == 0
    assert kernels.centers(np.array([[1, 1, 0], [0, 0, 0], [0, 0, 1]]) > 0) == [(0.5, 0.0)]
    fine, coarse = (np.sin(np.arange(64) * f)[None].repeat(64, 0) for f in (2.5, 0.3))
    assert kernels.radial_detail(fine) > kernels.radial_detail(coarse)
    df = spark.createDataFrame([(flat.ravel().tolist(), 8), (None, None)], "p array<double>, w int")
    rows = df.select(kernels.image_quality("p", "w").alias("q")).collect()
    assert rows[0].q.high == 1.0 and rows[1].q.blur is None


def test_stream_counts_requests_once(spark, tmp_path):
    t = dt.datetime(2026, 1, 1)
    rows = [(t + dt.timedelta(seconds=i), "k", str(i % 5)) for i in range(10)]
    spark.createDataFrame(rows, "ts timestamp, who string, sha string").write.parquet(str(tmp_path / "in"))
    stream = ingest.unique_arrivals(ingest.arrivals(spark, str(tmp_path / "in"), "ts timestamp, who string, sha string", 10), "sha")
    q = ingest.request_rate(stream, "ts", "who", "60 seconds", 4).writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.limited) for r in spark.table("rates").collect()] == [(5, True)]


def test_upsert_and_changes(spark):
    log = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "9", 1)], "k string, v string, t int")
    assert {tuple(r) for r in capture.last_state(log, "k", "v", "t").collect()} == {("a", "2"), ("b", "9")}
    a, b = log.filter("t = 1").select("k", "v"), log.filter("t = 2").select("k", "v")
    assert {(r.k, r.change) for r in capture.key_changes(a, b, "k", "v").collect()} == {("a", "changed"), ("b", "lost")}


def test_history_drops_oldest_pairs(spark):
    def kept(sizes, budget):
        turns = spark.createDataFrame([("c", i, "x" * n) for i, n in enumerate(sizes)], "conv string, turn int, text string")
        return sorted(r.turn for r in workspace.recent_turns(turns, "conv", "turn", "text", 8, budget).collect())

    for sizes, budget in (([1] * 11, 100), ([5, 5, 5, 5, 1], 11), ([5, 5, 5, 5, 1], 10), ([9], 1), ([3] * 10 + [2], 17)):
        recent = list(range(len(sizes) - 1))[-8:]
        while recent and sum(sizes[i] for i in recent) + sizes[-1] > budget:
            recent = recent[2:]
        assert kept(sizes, budget) == recent


def test_square_metrics_and_verdicts(spark):
    corners = lambda *p: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p))
    r = spark.range(1).select(decisions.square_metrics(corners((0, 0), (10, 0), (10, 10), (0, 10))).alias("m"), decisions.square_metrics(corners(*[(1, 1)] * 4)).alias("z")).first()
    assert tuple(r.m) == (10, 0, 1, 1) and tuple(r.z) == (0, 0, 0, 0)
    w = [decisions.winner(F.lit(a), F.lit(b)) for a, b in ((100.0, 103.0), (100.0, 104.0), (104.0, 100.0), (None, 1.0))]
    assert list(spark.range(1).select(*w).first()) == ["tie", "other", "main", None]
    f = [decisions.upload_fidelity(F.lit(a), F.lit(b), F.lit(c), F.lit(0)) for a, b, c in ((True, False, 3), (False, True, 0), (False, True, 1), (False, False, 0))]
    assert list(spark.range(1).select(*f).first()) == ["PASS", "MARGINAL", "FAIL", "FAIL"]


def test_cyclic_neighbours(spark):
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("a", 7), ("a", 7), ("a", None), ("b", 5)], "g string, k int")
    got = sorted(map(tuple, workspace.cyclic_neighbours(rows, "g", "k").collect()))
    assert got == [("a", 1, 3, 7), ("a", 3, 7, 1), ("a", 7, 1, 3), ("b", 5, 5, 5)]
    assert workspace.cyclic_neighbours(rows.limit(0), "g", "k").count() == 0


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_points_without_a_tile_fail_or_have_none(spark):
    at = lambda x, y: tiling.owner_of(F.lit(x), F.lit(y), F.lit(4000), F.lit(1000), 1280, 1024)
    found = one(spark, at(0.0, 0.0).alias("a"), at(3999.5, 999.0).alias("b"), at(4000.0, 5.0).alias("c"), at(-0.1, 5.0).alias("d"), at(1152.0, 10.0).alias("tie"))
    assert found.a.tile_id == "r0c0" and found.b.tile_id == "r0c3" and (found.b.x0, found.b.tile_x) == (2720, 1279.5)
    assert found.c is None and found.d is None and found.tie.tile_id == "r0c0"
    with pytest.raises(Exception, match="no tile holds 7"):
        spark.range(1).select(tiling.owned_or_fail(at(-1.0, 0.0), F.lit(7))).collect()
    assert one(spark, *tiling.to_image(*tiling.to_tile(F.lit(7.5), F.lit(9), F.lit(3), F.lit(4)), F.lit(3), F.lit(4)))[:] == (7.5, 9)


@pytest.mark.parametrize("ratios,gap", [((0.5, 0.5, 0.5), 3), ((1.0, 0.0, 0.0), 3), ((0.7, 0.15, 0.15), -1), ((0.7, 0.15, 0.15), 1.5)])
def test_split_arguments_are_checked(spark, ratios, gap):
    with pytest.raises(ValueError):
        splits.ratio_split(days(spark, 30), "d", ratios, gap)


def test_p_of_a_correlation(spark):
    rows = [(0.5, 12), (0.9, 3), (1.0, 10), (0.0, 10), (None, 9), (0.4, 2), (0.01, 1_000_000)]
    got = [r.p for r in spark.createDataFrame(rows, "r double, n long").select(scoring.correlation_p("r", "n").alias("p")).collect()]
    # Student's t in closed form for 1 degree of freedom; for 10 by numeric integration.
    t = 0.5 * math.sqrt(10 / 0.75)
    x = np.linspace(t, 2000, 4_000_001)
    density = math.gamma(5.5) / (math.sqrt(10 * math.pi) * math.gamma(5)) * (1 + x * x / 10) ** -5.5
    assert got[0] == pytest.approx(2 * np.trapezoid(density, x), rel=1e-5)
    assert got[1] == pytest.approx(1 - 2 / math.pi * math.atan(0.9 / math.sqrt(1 - 0.81)), rel=1e-9)
    assert got[2] == 0 and got[3] == pytest.approx(1) and got[4] is None and got[5] is None and 0 < got[6] < 1e-20


def test_splines_map_their_points_at_any_size(spark):
    draw = np.random.default_rng(2)
    src = draw.uniform(0, 1, (12, 2))
    dst = src @ np.array([[1.1, 0.1], [-0.2, 0.9]]) + 3 + 0.01 * draw.normal(size=(12, 2))
    rows = [(pair, i, *(src[i] * size).tolist(), *(dst[i] * size).tolist()) for pair, size in ((1, 1.0), (2, 3000.0)) for i in range(12)]
    points = spark.createDataFrame(rows, "pair int, id int, x double, y double, u double, v double")
    got = registration.map_points(points, registration.fit_splines(points, "pair"), "pair").orderBy("pair", "id").toPandas()
    small, large = got[got.pair == 1][["u", "v"]].to_numpy(), got[got.pair == 2][["u", "v"]].to_numpy()
    assert np.allclose(small * 3000, large, rtol=1e-6) and np.abs(small - dst).max() < 0.02
    line = spark.createDataFrame([(1, i, float(i), float(i), 0.0, 0.0) for i in range(5)], "pair int, id int, x double, y double, u double, v double")
    with pytest.raises(Exception, match="no spline"):
        registration.fit_splines(line, "pair").collect()


@pytest.mark.parametrize("block", [64 << 20, 20])
def test_two_nearest_in_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_BYTES", block)
    v = np.random.default_rng(5).normal(size=(60, 4)).round(1)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = {r.query: (r.nearest, r.d1, r.d2) for r in scoring.nearest_two(rows.filter("id % 6 = 0"), rows, "id", "v", 0.9).collect()}
    assert len(got) == 10
    for q, (nearest, d1, d2) in got.items():
        d = sorted((float(np.linalg.norm(v[q] - v[i])), i) for i in range(60) if i != q)
        assert (nearest, d1, d2) == (d[0][1], pytest.approx(d[0][0]), pytest.approx(d[1][0]))


def test_rules_of_records(spark):
    r = one(
        spark,
        *(validation.exact_keys(F.lit(j), ["role", "content"]).alias(f"k{i}") for i, j in enumerate(['{"content":"a","role":"b"}', '{"content":"a"}', '{"content":"a","role":"b","x":1}', "[1]", "no"])),
        validation.usable_date(F.lit("2026-02-30"), F.lit("2027-01-01").cast("date")).alias("d0"),
        validation.usable_date(F.lit("2026-1-5"), F.lit("2027-01-01").cast("date")).alias("d1"),
        validation.usable_date(F.lit("2027-01-02"), F.lit("2027-01-01").cast("date")).alias("d2"),
        validation.usable_date(F.lit("2026-12-31"), F.lit("2027-01-01").cast("date")).alias("d3"),
        validation.same_origin(F.lit("HTTPS://A.example/x"), F.lit("https://a.example")).alias("o0"),
        validation.same_origin(F.lit("https://a.example:8443/"), F.lit("https://a.example")).alias("o1"),
        validation.same_origin(F.lit(None).cast("string"), F.lit("https://a.example")).alias("o2"),
        validation.body_fits(F.lit("é" * 16_000)).alias("b0"), validation.body_fits(F.lit("é" * 16_000 + "x")).alias("b1"),
        *(c.alias(n) for c, n in zip(validation.upright(F.lit(6), F.lit(4), F.lit(6)), ("w", "h"))),
        *(c.alias(n) for c, n in zip(validation.upright(F.lit(6), F.lit(4), F.lit(None).cast("int")), ("w2", "h2"))),
    )
    assert [r[f"k{i}"] for i in range(5)] == [True, False, False, False, False]
    assert (r.d0, r.d1, r.d2, r.d3) == (None, None, None, dt.date(2026, 12, 31))
    assert (r.o0, r.o1, r.o2, r.b0, r.b1) == (True, False, False, True, False) and (r.w, r.h, r.w2, r.h2) == (4, 6, 6, 4)


def test_angles_at_the_poles(spark):
    r = [[F.lit(x) for x in row] for row in ([0.0, 0.0, 1.0], [0.0, 1.0, 0.0], [-1.0, 0.0, 0.0])]
    from gaugeflow.functions import geometry

    assert one(spark, *(c.alias(n) for c, n in zip(geometry.euler_degrees(r), "xyz")))[:] == (pytest.approx(0), pytest.approx(90), 0.0)


def test_decisions_without_data(spark):
    none = F.lit(None).cast("double")
    r = one(spark, decisions.lens_loss(F.lit(0.0), F.lit(0.0)).alias("a"), decisions.lock_choice(F.lit(55)).alias("b"), decisions.probe_state(none).alias("c"), decisions.readiness_state(F.lit(3), F.lit(0), F.lit(False)).alias("d"), scoring.confident(none).alias("e"))
    assert r[:] == (None, "rejected", "drop", "calibrate", False)


def test_images_and_write_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jpg").write_bytes(b"abc")
    (tmp_path / "in" / "b.txt").write_bytes(b"no")
    got = io.read_images(spark, str(tmp_path / "in")).collect()
    assert [(r.path.rsplit("/", 1)[1], r.length, r.sha256[:8]) for r in got] == [("a.jpg", 3, "ba7816bf")]
    io.write_once(spark.range(2), str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        io.write_once(spark.range(2), str(tmp_path / "out"))


def test_point_match_counts_of_all_lines(spark):
    """The query's matching, component by component, against one of each image as a whole."""
    li = spark.read.parquet(f"{SF}/lineitem.parquet").toPandas()
    got = {r.image: (r.tp, r.fp, r.fn) for r in QUERIES["point_match_counts"](spark, SF).collect()}
    assert len(got) == 50
    for image, g in li.groupby(li.l_orderkey % 50):
        x, y = g.l_extendedprice.astype(float).to_numpy() % 500, g.l_quantity.astype(float).to_numpy() * 10
        ids = (g.l_orderkey * 10 + g.l_linenumber).to_numpy()
        odd = (g.l_linenumber % 2 == 1).to_numpy()
        near = (x[odd][:, None] - x[~odd][None]) ** 2 + (y[odd][:, None] - y[~odd][None]) ** 2 <= 16
        i, j = np.nonzero(near)
        tp = scoring._matched(ids[odd][i].tolist(), ids[~odd][j].tolist())
        assert got[image] == (tp, (~odd).sum() - tp, odd.sum() - tp)


def test_staged_tables_go(spark):
    from pathlib import Path

    from gaugeflow.sources import staging

    kept = staging.Staged(spark.range(5), "five")
    root = Path(staging.stage_root(spark).removeprefix("file:"))
    assert kept.df.count() == 5 and len(list(root.glob("five-*"))) == 1
    kept.drop()
    assert not list(root.glob("five-*"))
    staging.staged(spark.range(3), "three")
    staging.drop_stages(spark)
    assert not root.exists()


def tiff(order, entries, extra=b""):
    import struct

    body = struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", *e[:3]) + e[3] for e in entries) + b"\0" * 4
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + body + extra


@pytest.mark.parametrize("order", ["<", ">"])
def test_tags_of_images(spark, tmp_path, order):
    import struct

    u = lambda n: struct.pack(order + "I", n)
    h = lambda n: struct.pack(order + "HH", n, 0)
    extra_at = 8 + 2 + 12 * 4 + 4
    maker = b"Maker of cameras\0"
    second = struct.pack(order + "H", 2) + struct.pack(order + "HHI", 0x829A, 5, 1) + u(extra_at + len(maker) + 30) + struct.pack(order + "HHI", 0x927C, 7, 4) + b"abcd" + b"\0" * 4
    block = tiff(order, [(0x010F, 2, len(maker), u(extra_at)), (0x0112, 3, 1, h(6)), (0x8769, 4, 1, u(extra_at + len(maker))), (0x0110, 2, 900, u(extra_at))], maker + second + struct.pack(order + "II", 1, 50))
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xe1" + (len(block) + 8).to_bytes(2, "big") + b"Exif\0\0" + block + b"\xff\xda"
    want = {"Make": "Maker of cameras", "Orientation": "6", "ExposureTime": "0.02", "MakerNote": "<4 bytes>"}
    from gaugeflow.functions import exif

    assert exif.tags(block) == exif.tags(jpeg) == want
    assert [exif.tags(x) for x in (None, b"", b"\xff\xd8", b"\xff\xd8\xff\xe1\x00\x00", jpeg[:40])] == [{}] * 5
    (tmp_path / "a.jpg").write_bytes(jpeg)
    (tmp_path / "b.png").write_bytes(b"png")
    got = {r.path.rsplit("/", 1)[1]: (r.exif, r.orientation) for r in io.image_facts(io.read_images(spark, str(tmp_path))).collect()}
    assert got == {"a.jpg": (want, 6), "b.png": ({}, 1)}


def test_manifests_and_missing_files(spark, tmp_path):
    from gaugeflow.operators import sessions

    plan = splits.ratio_split(days(spark, 30), "d", (0.7, 0.15, 0.15), 2)
    io.write_manifest(sessions.split_manifest(plan, "d"), str(tmp_path / "plan"))
    read = sorted((r.day, r.split) for r in io.read_manifest(spark, str(tmp_path / "plan")).collect())
    assert read == sorted((r.d, r.split) for r in plan.collect())
    with pytest.raises(Exception, match="(?i)exist"):
        io.write_manifest(sessions.split_manifest(plan, "d"), str(tmp_path / "plan"))
    assert io.read_control_points(spark, str(tmp_path / "none")).count() == 0
    io.append_rows(spark.range(2), str(tmp_path / "log"))
    io.append_rows(spark.range(3), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 5


def test_centers_of_many_shapes():
    draw = np.random.default_rng(8)
    for k in range(40):
        mask = draw.random((draw.integers(1, 14), draw.integers(1, 14))) < 0.45
        label, want = np.zeros(mask.shape, int), []
        for y0, x0 in zip(*np.nonzero(mask)):
            if label[y0, x0]:
                continue
            stack, pixels = [(y0, x0)], []
            label[y0, x0] = 1
            while stack:
                y, x = stack.pop()
                pixels.append((x, y))
                for q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                    if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not label[q]:
                        label[q] = 1
                        stack.append(q)
            if len(pixels) >= 2:
                want.append(tuple(np.mean(pixels, axis=0)))
        assert np.allclose(sorted(kernels.centers(mask)), sorted(want)) if want else kernels.centers(mask) == []


def test_masks_to_centers_and_detail_in_spark(spark):
    mask = [0.0, 0.9, 0.9, 0.0] * 3 + [0.0] * 4
    df = spark.createDataFrame([(mask, 4, 0.5), (None, 4, 0.5)], "pixels array<double>, width int, threshold double")
    got = df.filter("pixels IS NOT NULL").select(kernels.mask_centers("pixels", "width", "threshold").alias("c")).first().c
    assert [(p.x, p.y) for p in got] == [(1.5, 1.0)]
    detail = [r.d for r in df.select(kernels.spectral_detail("pixels", "width").alias("d")).collect()]
    assert 0 < detail[0] <= 0.5 and detail[1] is None


def test_restore_is_all_or_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(1, []), (2, ["size"])], "id int, reasons array<string>")
    with pytest.raises(io.Rejected, match="1 rows rejected: size 1"):
        io.write_if_valid(rows, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()
    io.write_if_valid(rows.filter("id = 1"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["id"]


@pytest.mark.parametrize("kind", ["homography", "similarity"])
def test_robust_fits_bear_wrong_matches(spark, kind):
    from gaugeflow.operators import robust

    draw = np.random.default_rng(4)
    h = np.array([[1.1, 0.1, 5], [-0.1, 1.1, 7], [1e-4 if kind == "homography" else 0, 0, 1]])
    src = draw.uniform(0, 500, (60, 2))
    p = np.column_stack([src, np.ones(60)]) @ h.T
    dst = p[:, :2] / p[:, 2:]
    dst[:20] = draw.uniform(0, 500, (20, 2))
    rows = [(1, *map(float, (*a, *b))) for a, b in zip(src, dst)] + [(2, 1.0, 2.0, 3.0, 4.0), (3, None, 0.0, 0.0, 0.0)]
    got = {r[0]: r for r in robust.robust_fits(spark.createDataFrame(rows, "pair int, x double, y double, u double, v double"), "pair", kind).collect()}
    assert got[1].n == 60 and 40 <= got[1].n_agree <= 43
    assert np.abs(robust._errors(np.array(got[1].transform).reshape(3, 3), src[20:], dst[20:])).max() < 1.5
    assert got[2].transform is None


def test_facing_of_a_sphere(spark):
    from gaugeflow.operators import robust

    k = np.arange(400)
    z = 1 - 2 * (k + 0.5) / 400
    turn = k * np.pi * (3 - 5**0.5)
    p = np.column_stack([np.sqrt(1 - z * z) * np.cos(turn), np.sqrt(1 - z * z) * np.sin(turn), z])
    df = spark.createDataFrame([(1, i, *map(float, x)) for i, x in enumerate(p)], "image int, id int, x double, y double, z double")
    turned = robust.facing(df, "image")
    got = {r.id: r.facing for r in turned.collect()}
    assert max(abs(got[i] + p[i, 2]) for i in got) < 0.08
    regions = spark.createDataFrame([(i, "back" if z[i] > 0.2 else "front" if z[i] < -0.2 else "rim") for i in range(400)], "id int, region string")
    shares = {r.region: r.share for r in robust.visible_shares(turned, regions, "image").collect()}
    assert shares["back"] == 0 and shares["front"] == 1 and 0.3 < shares["rim"] < 0.7


def test_null_groups_have_counts_of_their_own(spark):
    schema = "g int, id int, x double, y double"
    truth = spark.createDataFrame([(0, 0, 0.0, 0.0), (None, 1, 0.0, 0.0)], schema)
    found = spark.createDataFrame([(None, 0, 0.0, 0.0), (None, 1, 9.0, 0.0), (1, 0, 0.0, 0.0)], schema)
    assert {r.g: (r.tp, r.fp, r.fn) for r in scoring.match_counts(truth, found, "g", 1.0).collect()} == {0: (0, 0, 1), None: (0, 2, 1), 1: (0, 1, 0)}


def test_matching_of_many_groups_equals_a_search(spark):
    draw = np.random.default_rng(6)
    rows = [[(int(draw.integers(0, 9)), k, float(draw.random() * 12), float(draw.random() * 12)) for k in range(220)] for _ in range(2)]
    schema = "g int, id int, x double, y double"
    got = {r.g: r.tp for r in scoring.match_counts(*(spark.createDataFrame(r, schema) for r in rows), "g", 1.5).collect()}
    for g in range(9):
        t, f = ([r for r in side if r[0] == g] for side in rows)
        edges = [(a[1], b[1]) for a in t for b in f if math.hypot(a[2] - b[2], a[3] - b[3]) <= 1.5]
        assert got[g] == (scoring._matched(*zip(*edges)) if edges else 0)


def test_matching_by_places_equals_one_by_pairs(spark):
    """Clusters too large for a list of pairs, points of one id at several places, a dense group in which most of the larger side stays."""
    draw = np.random.default_rng(12)
    for k in range(60):
        n, m, wide = *draw.integers(80, 120, 2), [6, 15, 40][k % 3]
        side, ids = np.repeat([0, 1], [n, m]), np.concatenate([draw.integers(0, n, n), draw.integers(0, m, m)])
        x, y = np.round(draw.random((2, n + m)) * wide, 1)
        y = y if k % 2 else np.floor(y / 5) * 10
        i, j = np.nonzero((x[:n, None] - x[n:]) ** 2 + (y[:n, None] - y[n:]) ** 2 <= 1.5**2)
        assert n * m > scoring.FEW and scoring._cluster_matched([(side, ids, x, y)], 1.5) == scoring._matched(ids[:n][i].tolist(), ids[n:][j].tolist())
    # 4 million pairs, which took a search of all of them for each point that stays
    rows = [spark.range(size).select(F.lit(1).alias("g"), "id", (F.col("id") * 7919 % 50_000 / 1000).alias("x"), (F.col("id") % 2 * 1.0).alias("y")) for size in (9000, 6000)]
    counts = scoring.match_counts(*rows, "g", 2.0)
    assert counts.first()[:] == (1, 6000, 0, 3000)


def test_ids_at_several_places_are_one_point(spark):
    """An id at three places links what lies there, and is matched once."""
    truth = spark.createDataFrame([(1, 7, 0.0, 0.0), (1, 7, 50.0, 0.0), (1, 7, 100.0, 0.0)], "g int, id int, x double, y double")
    found = spark.createDataFrame([(1, 1, 0.5, 0.0), (1, 2, 50.0, 0.5), (1, 3, 100.0, 0.0), (1, 4, float("nan"), 0.0)], "g int, id int, x double, y double")
    assert scoring.match_counts(truth, found, "g", 1.0).first()[:] == (1, 1, 3, 2)


def test_keys_with_null_values_are_there(spark):
    a = spark.createDataFrame([("a", None), ("b", 1), ("c", None), ("d", 2)], "k string, v int")
    b = spark.createDataFrame([("a", None), ("b", None), ("c", 3), ("e", None)], "k string, v int")
    assert {r.k: r.change for r in capture.key_changes(a, b, "k", "v").collect()} == {"a": "same", "b": "changed", "c": "changed", "d": "lost", "e": "gained"}


def test_a_scale_must_show_a_lesion(spark):
    one = lambda scale: spark.range(1).select(validation.quality_reasons(F.lit(200.0), F.lit(0.0), F.lit(0.0), F.lit(scale).cast("double"), F.lit(True), True)).first()[0]
    assert one(3.9) == ["scale"] and one(4.0) == [] and one(3.97) == [] and one(None) == [] and one(float("nan")) == ["scale"]


def test_the_near_side_is_that_of_the_mean(spark):
    side = lambda left, right: spark.range(1).select(decisions.near_side(F.array(*map(F.lit, left)), F.array(*map(F.lit, right)), F.lit(50.0))).first()[0]
    assert side([10.0, 49.0], [80.0, 75.0]) == "right" and side([10.0, 40.0], [75.0]) == "left" and side([25.0], [75.0]) == "left"


@pytest.mark.parametrize("length,tile,step", [(4000, 1280, 1024), (1000, 1280, 1024), (2560, 1280, 1280), (701, 100, 99), (700, 100, 100)])
def test_axis_owner_equals_a_search(spark, length, tile, step):
    starts = [0] if length <= tile else sorted({*range(0, length - tile, step), length - tile})
    tiles = [(k, a, min(a + tile, length)) for k, a in enumerate(starts)]
    places = sorted({-0.5, length, length + 1, *(float(v) for _, a, b in tiles for v in (a, b, (a + b) / 2, a + (tile + step) / 2, b - 0.25))})
    rows = spark.createDataFrame([(float(x),) for x in places], "x double").select("x", tiling.axis_owner(F.col("x"), F.lit(length), tile, step).alias("o")).collect()
    for r in rows:
        inside = [(abs(r.x - (a + b) / 2), k, a, b) for k, a, b in tiles if a <= r.x < b]
        assert (tuple(r.o) if r.o else None) == (min(inside)[1:] if inside else None)


@pytest.mark.parametrize("block", [64 << 20, 4000])
def test_two_nearest_equal_a_search(spark, block, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_BYTES", block)
    draw = np.random.default_rng(2)
    v = np.round(draw.random((150, 8)) * 4) / 4  # ties and equal vectors
    rows = spark.createDataFrame([(k, [float(e) for e in x]) for k, x in enumerate(v)] + [(500, None)], "id long, v array<double>").repartition(6)
    got = {r.query: (r.nearest, r.d1, r.d2, r.accepted) for r in scoring.nearest_two(rows.filter("id % 10 = 0"), rows, "id", "v", 0.9).collect()}
    assert sorted(got) == list(range(0, 150, 10))
    for q, (nearest, d1, d2, accepted) in got.items():
        d = sorted((float(np.sqrt(((v[q] - x) ** 2).sum())), k) for k, x in enumerate(v) if k != q)
        assert (nearest, d1, d2, accepted) == (d[0][1], d[0][0], d[1][0], d[0][0] < 0.9 * d[1][0])


def test_chat_bodies(spark):
    import json

    ok = {"role": "user", "content": "hi"}
    cases = {
        "ok": {"messages": [ok]}, "shape": {"messages": [ok], "model": "x"}, "count": {"messages": []}, "role_order": {"messages": [ok, ok]}, "last_role": {"messages": [ok, {"role": "assistant", "content": "yes"}]},
        "length": {"messages": [{"role": "user", "content": " \n\t"}]}, "payload": {"messages": [{"role": "user", "content": "see DATA:x"}]},
        "total": {"messages": [{"role": ("user", "assistant")[k % 2], "content": "a" * 1500 + " "} for k in range(7)]},
    }
    wrong = [{"messages": [{**ok, "image": "x"}]}, {"messages": [{"role": "user", "content": 5}]}, {"messages": "hi"}, {"messages": [{"content": "hi"}]}, ["messages"], {}]
    rows = [(k, json.dumps(v)) for k, v in cases.items()] + [(f"shape{k}", json.dumps(v)) for k, v in enumerate(wrong)] + [("shape-none", None), ("shape-text", "{no json"), ("body", json.dumps({"messages": [{"role": "user", "content": "x" * 33_000}]}))]
    got = {r.id: r.verdict for r in validation.chat_bodies(spark.createDataFrame(rows, "id string, body string"), "id", "body").collect()}
    assert {k: v.split("-")[0].rstrip("0123456789") for k, v in got.items()} == {k: k.split("-")[0].rstrip("0123456789") for k in got} and len(got) == len(rows)


def test_lengths_of_texts(spark):
    turns = spark.createDataFrame([(1, 1, "user", "😀" * 1001), (2, 1, "user", " " * 1500 + "x" * 600)], "c int, t int, role string, text string")
    assert {r.c: r.verdict for r in validation.chats(turns, "c", "t", "role", "text").collect()} == {1: "ok", 2: "ok"}
    assert {r.c: r.verdict for r in validation.chats(turns, "c", "t", "role", "text", raw_length=True).collect()} == {1: "length", 2: "length"}


def test_answers_with_any_characters(spark):
    from gaugeflow.operators import sessions

    rows = spark.createDataFrame([("d", 1, "a", "x,b=y", 1), ("d", 2, "b", None, 2)], "day string, id int, k string, v string, at int")
    out = sessions.get_or_create(rows, ["day"], "id", F.col("k"), F.col("v"), "at").first()
    assert out.session_id == 1 and out.covariates == '{"a":"x,b=y","b":null}'

import base64
import json
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import images
from gaugeflow.functions.exif import size_of
from gaugeflow.operators import capture, validation, workspace
from gaugeflow.sources import io


def record(id, orientation=1, **changes):
    stored = np.random.default_rng(int(id)).integers(0, 256, (40, 60)).astype(np.uint8)
    content = images.png(stored, orientation)
    w, h = (40, 60) if orientation > 4 else (60, 40)
    return {"id": id, "profile_id": "p", "date": "2026-01-02", "pose": "frontal", "kind": "session", "width": w, "height": h, "sha256": sha256(content).hexdigest(), "bytes": base64.b64encode(content).decode(), "px_per_mm": 4.5, "reviewed": True, "labels": [{"x": 1, "y": 2, "radius": 3}]} | changes


def test_exports_are_judged_whole(spark, tmp_path):
    rows = [
        record("1"), record("2", orientation=6), record("3", orientation=6, width=60, height=40), record("4", px_per_mm=True), record("5", px_per_mm="4"), record("6", px_per_mm=None), record("7", px_per_mm=4),
        record("8", labels=[{"x": 1, "y": 2, "radius": 61}]), record("9", px_per_mm=-1.0), record("10", bytes=base64.b64encode(b"no image").decode(), sha256=sha256(b"no image").hexdigest()),
    ]
    (tmp_path / "e.json").write_text(json.dumps({"schema": 1, "profile_id": "p", "images": rows}))
    read = io.read_export(spark, str(tmp_path / "e.json"))
    got = {r.id: r.reasons for r in validation.export_reasons(read, F.col("schema")).collect()}
    assert got == {"1": [], "2": [], "3": ["oriented_size"], "4": ["scale_number"], "5": ["scale_number"], "6": [], "7": [], "8": ["labels"], "9": ["scale"], "10": ["oriented_size"]}
    assert io.export_faults(spark, str(tmp_path / "e.json")).collect() == []


def test_exports_that_cannot_be_taken(spark, tmp_path):
    for name, doc in {"a": {"schema": 2, "profile_id": "p", "images": [record("1")]}, "b": {"schema": 1, "profile_id": "", "images": []}, "c": {"schema": 1, "images": [record("1")]}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "d.json").write_text("no json")
    assert {r.path[-6:-5]: r.reasons for r in io.export_faults(spark, str(tmp_path)).collect()} == {"a": ["schema"], "b": ["profile", "images"], "c": ["profile"], "d": ["schema", "profile", "images"]}


def test_an_export_comes_back(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"schema": 1, "profile_id": "p", "images": [record("1"), record("2", px_per_mm=None)]}))
    read = io.read_export(spark, str(tmp_path / "e.json"))
    io.write_export(read, str(tmp_path / "out"))
    again = io.read_export(spark, str(tmp_path / "out"))
    columns = ["schema", "owner", "id", "date", "width", "sha256", "px_per_mm", "reviewed", "labels", "content"]
    assert sorted(map(str, read.select(columns).collect())) == sorted(map(str, again.select(columns).collect()))
    assert all(r.reasons == [] for r in validation.export_reasons(again, F.col("schema")).collect())
    with pytest.raises(Exception):
        io.write_export(read, str(tmp_path / "out"))


def test_sizes_from_headers():
    assert size_of(images.png(np.zeros((3, 7), np.uint8))) == (7, 3)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04\x00\x00\xff\xc2\x00\x0b\x08\x00\x05\x00\x09\x03" + b"\0" * 9
    assert size_of(jpeg) == (9, 5) and size_of(b"") == size_of(None) == size_of(b"\xff\xd8\xff") == (None, None)


def test_uploads_in_order(spark):
    stored = spark.createDataFrame([("p", 50, "old")], "profile string, bytes long, sha string")
    rows = [("p", 1, 20, "a", "image/png", "2026-01-01"), ("p", 2, 20, "a", "image/png", "2026-01-01"), ("p", 3, 5, "old", "image/png", "2026-01-01"), ("p", 4, 25, "b", "image/jpeg", "2026-01-01"), ("p", 5, 10, "c", "image/gif", "2026-01-01"), ("p", 6, 10, "d", "image/png", "2026-01-03"), ("p", 7, 10, "e", "image/png", "2026-01-02"), ("q", 1, 99, "a", "image/png", "2026-01-01")]
    incoming = spark.createDataFrame(rows, "profile string, n int, bytes long, sha string, type string, day string").withColumn("day", F.to_date("day"))
    rules = workspace.photo_rules(F.col("type"), F.col("day"), F.lit("2026-01-02").cast("date"))
    out = workspace.upload_in_order(incoming, stored, "profile", "bytes", "sha", "n", 90, 100, **rules)
    assert {(r.profile, r.n): r.reasons for r in out.collect()} == {("p", 1): [], ("p", 2): ["new_bytes"], ("p", 3): ["new_bytes"], ("p", 4): [], ("p", 5): ["room", "type"], ("p", 6): ["date", "room"], ("p", 7): ["room"], ("q", 1): ["size"]}


def test_next_pending_ids(spark):
    of = lambda roster, placed: workspace.next_pending(*(spark.createDataFrame([(i,) for i in x], "id int") for x in (roster, placed)), "id").first()[0]
    assert of([1, 2, 5], [1]) == 2 and of([1, 2], [1, 2, 9]) == 10 and of([], []) == 0 and of([], [3]) == 4


def test_gate_and_override(spark):
    rows = spark.createDataFrame([("session", False, "shooting"), ("session", True, "shooting"), ("session", False, "open"), ("calib", False, "shooting"), (None, False, None)], "kind string, override boolean, gate string")
    assert [r[0] for r in rows.select(capture.may_capture(F.col("kind"), F.col("override"), F.col("gate"))).collect()] == [False, True, True, True, False]


def test_tables_models_and_reports(spark, tmp_path):
    made = io.empty_tables(spark)
    assert spark.sql("SELECT count(*) FROM sessions LEFT JOIN images ON images.session_id = sessions.id").first()[0] == 0 and "covariates" in made["sessions"].columns
    assert io.first_by_id(spark.range(9), "id", 4).first()[0] == 4 and io.first_by_id(spark.range(9), "id", 40).first() is None
    (tmp_path / "weights.bin").write_bytes(b"weights")
    card = {"architecture": "mask", "weights_hash": sha256(b"weights").hexdigest(), "threshold": 0.5, "splits": {"train": ["1"]}}
    (tmp_path / "model.json").write_text(json.dumps(card))
    assert io.read_model(spark, str(tmp_path), "mask").splits == {"train": ["1"]}
    for wrong in ({**card, "weights_hash": "x"}, {**card, "architecture": "other"}):
        (tmp_path / "model.json").write_text(json.dumps(wrong))
        with pytest.raises(ValueError):
            io.read_model(spark, str(tmp_path), "mask")
    io.write_report(spark.createDataFrame([("a", float("nan"), 1.5)], "name string, x double, y double"), str(tmp_path / "report"))
    assert [json.loads(line) for f in (tmp_path / "report").glob("*.json") for line in f.read_text().splitlines()] == [{"name": "a", "y": 1.5}]

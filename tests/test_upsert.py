import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugeflow.sources.upsert import Upsert, lock_rows, session_table, state_table

SCHEMA = "session_date date, kind string, id long, captured_at timestamp, device string, covariates map<string,string>, seq long"
DAY = dt.date(2026, 1, 1)


def row(day, kind, id, seq, **answers):
    return (DAY + dt.timedelta(days=day), kind, id, dt.datetime(2026, 1, 1, 0, 0, seq), f"phone {id}", answers or None, seq)


def content(table):
    return {(r.session_date.day, r.kind): (r.id, r.device, r.covariates) for r in table.read().collect()}


BATCHES = [
    [row(0, "session", 1, 1, sleep="good"), row(0, "session", 2, 3, sleep="bad", diet="a,b=c"), row(1, "session", 3, 2)],
    [row(0, "session", 4, 5, diet="x"), row(0, "calib", 5, 6, stress="low")],
]
WANT = {(1, "session"): (1, "phone 1", {"sleep": "bad", "diet": "x"}), (2, "session"): (3, "phone 3", {}), (1, "calib"): (5, "phone 5", {"stress": "low"})}


def test_sessions_are_created_once_and_merged(spark, tmp_path):
    table = session_table(spark, str(tmp_path / "t"), ["seq"], buckets=8)
    for n, rows in enumerate(BATCHES):
        assert table.apply(spark.createDataFrame(rows, SCHEMA), n)
    assert content(table) == WANT
    assert not table.apply(spark.createDataFrame(BATCHES[0], SCHEMA), 0) and content(table) == WANT


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = state_table(spark, str(tmp_path / "t"), ["seq"], buckets=16)
    table.apply(spark.createDataFrame([(f"k{i}", str(i), 0) for i in range(200)], "key string, value string, seq long"), 0)
    files = lambda: {str(f) for f in (tmp_path / "t" / "rows").rglob("part-*.parquet")}
    before = files()
    table.apply(spark.createDataFrame([("k7", None, 1), (None, "no key", 2)], "key string, value string, seq long"), 1)
    assert len(before - files()) == 1 and len(before) == 16
    rows = {r.key: r.value for r in table.read().collect()}
    assert len(rows) == 200 and rows["k7"] is None and rows["k8"] == "8"


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    for n, rows in enumerate([*BATCHES, [row(0, "session", 9, 9, sleep="late")]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "src" / str(n)))
        for f in (tmp_path / "src" / str(n)).glob("*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            f.rename(tmp_path / "in" / f"{n}.parquet")

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = session_table(spark, str(tmp_path / "t"), ["seq"], buckets=4).stream(stream, str(tmp_path / "log")).trigger(availableNow=True).start()
        query.awaitTermination(180)

    record, crashed = Upsert._record, []

    def fails_once(self, batch):
        if batch == 1 and not crashed:
            crashed.append(batch)
            raise OSError("the writer ends between the write and its record")
        record(self, batch)

    monkeypatch.setattr(Upsert, "_record", fails_once)
    with pytest.raises(Exception, match="the writer ends"):
        run()
    table = session_table(spark, str(tmp_path / "t"), ["seq"], buckets=4)
    assert content(table) == WANT and not table.applied(1)
    run()
    assert table.applied(1) and table.applied(2)
    assert content(table) == {**WANT, (1, "session"): (1, "phone 1", {"sleep": "late", "diet": "x"})} and table.read().count() == 3


def test_another_shape_is_an_error(spark, tmp_path):
    state_table(spark, str(tmp_path / "t"), ["seq"], buckets=4)
    with pytest.raises(ValueError):
        state_table(spark, str(tmp_path / "t"), ["seq"], buckets=8)


def test_an_empty_batch_and_locks(spark, tmp_path):
    table = state_table(spark, str(tmp_path / "t"), ["seq"], buckets=4)
    empty = spark.createDataFrame([], "key string, value string, seq long")
    assert table.apply(empty, 0) and table.applied(0)
    lock = spark.range(1).select(F.explode(lock_rows(F.lit(50), F.lit("2026-02-03").cast("date"))).alias("s")).select("s.*", F.lit(1).cast("long").alias("seq"))
    table.apply(lock, 1)
    table.apply(spark.createDataFrame([("angle_locked", "0", 2)], "key string, value string, seq long"), 2)
    assert {r.key: r.value for r in table.read().collect()} == {"angle_locked": "0", "locked_angle_deg": "50", "angle_locked_at": "2026-02-03"}

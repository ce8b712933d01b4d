import datetime as dt
from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeflow.operators import sessions, tracking
from gaugeflow.streaming import ordered

START = dt.datetime(2026, 1, 1, 12)


@pytest.fixture(scope="module")
def stateful(spark):
    for k, v in ordered.STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in ordered.STORE:
        spark.conf.unset(k)


def test_assignment_is_optimal():
    draw = np.random.default_rng(5)
    for _ in range(300):
        n, m = draw.integers(1, 5, 2)
        cost = draw.random((n, m)) * 8
        pairs = tracking.assigned(cost, 4.0)
        assert len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs}) and all(cost[p] <= 4 for p in pairs)
        size = max(n, m)
        wide = np.full((size, size), np.inf)
        wide[:n, :m] = np.where(cost <= 4, cost, np.inf)
        best = min(((-sum(np.isfinite(c)), sum(c[np.isfinite(c)])) for p in permutations(range(size)) for c in [wide[range(size), list(p)]]))
        assert (-len(pairs), pytest.approx(sum(cost[p] for p in pairs))) == best


def history(seed, n=30):
    """Detections of three regions over n sessions: things that come, wander under the gate, pause and go."""
    draw, rows, id = np.random.default_rng(seed), [], 0
    for region in range(3):
        things = [(draw.random(2) * 100, *sorted(draw.integers(0, n, 2))) for _ in range(6)]
        for s in range(n):
            at = START + dt.timedelta(days=s)
            rows.append((region, s, None, None, None, at))
            for k, (place, a, b) in enumerate(things):
                if a <= s <= b and draw.random() < 0.7:
                    place = place + draw.normal(0, 0.5, 2)
                    things[k] = (place, a, b)
                    rows.append((region, s, id, float(place[0]), float(place[1]), at))
                    id += 1
    return rows


SCHEMA = "region int, session long, id long, x double, y double, at timestamp"


def as_set(rows):
    return sorted((r.region, r.track, r.event, r.session, r.id) for r in rows if r.session < 1000) if rows else []


def as_text(df):
    return sorted(map(str, [(r.region, r.track, r.event, r.session, r.id) for r in df.collect()]))


def test_tracks_follow_the_rules(spark):
    def seen(*sessions_at):
        rows = [(0, s, i, x, 0.0, START) for i, (s, x) in enumerate(sessions_at)] + [(0, s, None, None, None, START) for s in range(12)]
        return [(r.track, r.event, r.session) for r in tracking.track(spark.createDataFrame(rows, SCHEMA), "region").orderBy("session", "track", "event").collect()]

    assert seen((0, 0.0), (2, 3.9), (3, 7.8)) == [(0, "seen", 0), (0, "born", 2), (0, "seen", 2), (0, "seen", 3), (0, "resolved", 4)]
    assert seen((0, 0.0), (1, 4.1)) == [(0, "seen", 0), (0, "resolved", 1), (1, "seen", 1), (1, "resolved", 2)]
    # Two absences are bridged, after three it is another thing.
    assert [e for e in seen((0, 0.0), (3, 0.0), (7, 0.0)) if e[1] == "seen"] == [(0, "seen", 0), (0, "seen", 3), (1, "seen", 7)]


def test_tracks_have_the_lifecycles_of_the_batch(spark):
    df = spark.createDataFrame(history(1), SCHEMA)
    events = tracking.track(df, "region")
    seen = events.filter("event = 'seen'").select(F.concat_ws(":", "region", "track").alias("what"), "session")
    want = {r.what: (r.born, r.resolved) for r in sessions.lifecycles(seen, "what", "session", F.lit(29)).collect()}
    got = {}
    for r in events.filter("event <> 'seen'").collect():
        got.setdefault(f"{r.region}:{r.track}", {})[r.event] = r.session
    assert want == {k: (got.get(k, {}).get("born"), got.get(k, {}).get("resolved")) for k in want} and len(want) > 15


def streamed(spark, tmp_path, batches, schema, make):
    """Writes batches as files that a stream reads one by one, and returns what it gave."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k:03d}"))
        for f in (tmp_path / "in" / f"{k:03d}").glob("*.parquet"):
            f.rename(tmp_path / "in" / f"{k:03d}.parquet")
    for f in (tmp_path / "in").iterdir():
        if f.is_dir():
            f.rename(tmp_path / f"old-{f.name}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    query = make(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(240)
        return spark.read.parquet(str(tmp_path / "out")), query.recentProgress
    finally:
        query.stop()


@pytest.mark.parametrize("seed", [2, 3])
def test_any_order_within_the_watermark_gives_the_batch(stateful, tmp_path, seed):
    spark, rows = stateful, history(seed, 14)
    want = as_text(tracking.track(spark.createDataFrame(rows, SCHEMA), "region"))
    draw = np.random.default_rng(seed)
    # Rows come up to four days late; the watermark waits five.
    rows.sort(key=lambda r: r[1] + draw.random() * 4)
    batches = [rows[k : k + 40] for k in range(0, len(rows), 40)] + [[(9, 1000, None, None, None, START + dt.timedelta(days=400))]] * 2
    out, _ = streamed(spark, tmp_path, batches, SCHEMA, lambda s: ordered.track_stream(s, "region", "at", "5 days"))
    assert as_text(out.filter("region <> 9")) == want


def test_sliding_rate_is_exact_and_its_state_ends(stateful, tmp_path):
    spark, draw = stateful, np.random.default_rng(7)
    rows = [(int(draw.integers(0, 3)), k, START + dt.timedelta(seconds=float(t))) for k, t in enumerate(np.round(np.cumsum(draw.exponential(4, 240)), 3))]
    want = {(u, k): sum(1 for v, _, t in rows if v == u and at - dt.timedelta(seconds=60) < t and (t, _) <= (at, k)) for u, k, at in rows}
    late = sorted(rows, key=lambda r: (r[2] - START).total_seconds() + draw.random() * 20)
    end = [(u, 10_000 + u, START + dt.timedelta(days=1)) for u in (7, 8)]
    batches = [late[k : k + 60] for k in range(0, len(late), 60)] + [[end[0]], [(7, 20_000, START + dt.timedelta(days=2))], [(7, 20_001, START + dt.timedelta(days=3))]]
    out, progress = streamed(spark, tmp_path, batches, "user long, id long, at timestamp", lambda s: ordered.sliding_rate(s, "user", "id", "at", "30 seconds", 60, 8))
    got = {(r.user, r.id): r.n for r in out.filter("user < 3").collect()}
    assert got == want and {r.limited for r in out.filter("n > 8").collect()} == {True} and out.filter("n <= 8 AND limited").count() == 0
    rows_kept = [p["stateOperators"][0]["customMetrics"] for p in progress if p["stateOperators"]]
    assert rows_kept
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] < max(p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"])


def test_no_detections(spark):
    assert tracking.track(spark.createDataFrame([], SCHEMA), "region").collect() == []
    state, out = tracking.fold(None, pd.DataFrame({"session": [1], "id": [None], "x": [None], "y": [None]}))
    assert state == {"next": 0, "tracks": [], "done": 1} and not len(out)

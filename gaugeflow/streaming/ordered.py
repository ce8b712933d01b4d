"""Stateful streams whose result doesn't depend on the order of arrival within the watermark."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import tracking

#: The state store that named state and timers need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class InOrder(StatefulProcessor):
    """Keeps the rows of a key until the watermark has passed them, then gives them to
    `fold(state, rows, now)` in the order of event time. It returns the state that follows (None ends it),
    when to call again if nothing comes (milliseconds, or None), and rows of output.

    `columns` are the (name, type) of the input beside the key; one of them is `at`, in milliseconds.
    """

    def __init__(self, fold: Callable, columns: list[tuple[str, str]], key: str):
        self.fold, self.columns, self.key = fold, columns, key

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{n} {t}" for n, t in self.columns))
        self.kept = handle.getValueState("kept", "state string")

    def handleInputRows(self, key, rows, timerValues):
        names = [n for n, _ in self.columns]
        times = set()
        for part in rows:
            part = part[names].astype(object)
            part = part.where(part.notna(), None)
            new = [tuple(int(v) if t == "long" and v is not None else v for v, (_, t) in zip(r, self.columns)) for r in part.itertuples(index=False)]
            if new:
                self.waiting.appendList(new)
                times |= {int(t) for t in part["at"]}
        for t in times:
            self.handle.registerTimer(t)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # The first timer that fires takes all that is due, so that timers may fire in any order.
        now = timerValues.getCurrentWatermarkInMs()
        names = [n for n, _ in self.columns]
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        at = names.index("at")
        due, later = [r for r in rows if r[at] <= now], [r for r in rows if r[at] > now]
        state = json.loads(self.kept.get()[0]) if self.kept.exists() else None
        if not due and state is None:
            return
        if due:
            self.waiting.put(later) if later else self.waiting.clear()
        state, again, out = self.fold(state, pd.DataFrame(due, columns=names).sort_values("at", kind="stable"), now)
        self.kept.update((json.dumps(state),)) if state is not None else self.kept.clear()
        if again is not None and again > now:
            self.handle.registerTimer(int(again))
        if len(out):
            out.insert(0, self.key, key[0])
            yield out

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, key: str, at: str, delay: str, columns: list[tuple[str, str]], fold: Callable, output: str) -> DataFrame:
    """`fold` (see `InOrder`) over a stream by key; rows later than `delay` are dropped, as they came when
    their turn was over. The session needs the settings STORE."""
    kind = dict(stream.dtypes)[key]
    timed = stream.filter(F.col(at).isNotNull()).withWatermark(at, delay)
    slim = timed.select(key, at, *(n for n, _ in columns if n != at)).withColumn("at", F.unix_millis(F.col(at).cast("timestamp")))
    slim = slim if at == "at" else slim.drop(at)
    return slim.groupBy(key).transformWithStateInPandas(statefulProcessor=InOrder(fold, [("at", "long"), *columns], key), outputStructType=f"{key} {kind}, {output}", outputMode="Append", timeMode="EventTime")


def _track(state, rows, now, **rules):
    state, out = tracking.fold(state, rows, **rules)
    return state, None, out


def track_stream(detections: DataFrame, region: str, at: str, delay: str, **rules: float) -> DataFrame:
    """`tracking.track` over arriving detections (region, session, id, x, y, at). All rows of a session have
    the time of the session, so that a session is taken in as a whole once the watermark has passed
    it; the state is the tracks that are still there and the sessions not yet passed."""
    columns = [("session", "long"), ("id", "long"), ("x", "double"), ("y", "double")]
    return in_order(detections, region, at, delay, columns, partial(_track, **rules), tracking.EVENTS)


def _rate(state, rows, now, width: int, most: int):
    recent, out = state or [], []
    for r in rows.sort_values(["at", "id"]).itertuples():
        recent = [t for t in recent if t > r.at - width] + [int(r.at)]
        out.append((r.id, pd.Timestamp(r.at, unit="ms", tz="UTC"), len(recent), len(recent) > most))
    recent = [t for t in recent if t > now - width]
    return recent or None, recent[-1] + width if recent else None, pd.DataFrame(out, columns=["id", "at", "n", "limited"])


def sliding_rate(requests: DataFrame, key: str, id: str, at: str, delay: str, seconds: int = 60, most: int = 8) -> DataFrame:
    """Every request of a stream with how many its key has made within the last seconds, itself included,
    and whether that is over the limit; all count, valid or not. The state of a key are the times of
    that span, and ends with it."""
    named = requests.select(key, F.col(id).cast("long").alias("id"), at)
    return in_order(named, key, at, delay, [("id", "long")], partial(_rate, width=1000 * seconds, most=most), "id long, at timestamp, n int, limited boolean")

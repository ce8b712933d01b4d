"""Queries over a log of dated sessions and their captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recent_sessions(sessions: DataFrame, captures: DataFrame, on: str, passed: Column, order: list[Column], n: int) -> DataFrame:
    """The n latest sessions with their captures counted; sessions without any are kept."""
    counts = captures.groupBy(on).agg(F.count("*").alias("n_captures"), F.sum(F.when(passed, 1).otherwise(0)).alias("n_pass"))
    joined = sessions.join(counts, on, "left").fillna(0, ["n_captures", "n_pass"])
    return joined.orderBy(*order).limit(n)


def pairs_per_day(shots: DataFrame, day: str, lens: str, main: str, other: str) -> DataFrame:
    """Per day: shots of each lens, complete pairs and slots (sittings)."""
    d = shots.groupBy(day).agg(F.count_if(F.col(lens) == main).alias("n_main"), F.count_if(F.col(lens) == other).alias("n_other"))
    return d.select(day, "n_main", "n_other", F.least("n_main", "n_other").alias("pairs"), F.greatest("n_main", "n_other").alias("slots"))


def progress(days: DataFrame, repeats: int, least_days: int) -> DataFrame:
    """One row: what is complete, what remains (never below 0), and the state of a calibration."""
    total = days.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.count("*").alias("n_days"), F.coalesce(F.sum(F.abs(F.col("n_main") - F.col("n_other"))), F.lit(0)).alias("missing"))
    left, days_left = F.greatest(F.lit(0), repeats - F.col("pairs")), F.greatest(F.lit(0), least_days - F.col("n_days"))
    state = F.when((left == 0) & (days_left == 0), "complete").when(left == 0, "spread").otherwise("in_progress")
    return total.select("pairs", "n_days", "missing", left.alias("remaining"), days_left.alias("days_remaining"), state.alias("status"))


def slots(days: DataFrame, day: str) -> DataFrame:
    """One row per sitting, numbered within its day; which lens it has."""
    s = days.filter("slots > 0").select(day, "n_main", "n_other", F.explode(F.sequence(F.lit(1), F.col("slots").cast("int"))).alias("slot"))
    return s.select(day, "slot", (F.col("slot") <= F.col("n_main")).alias("has_main"), (F.col("slot") <= F.col("n_other")).alias("has_other"))


def unpaired_days(days: DataFrame, day: str, main: str, other: str) -> DataFrame:
    short = F.when(F.col("n_main") < F.col("n_other"), main).otherwise(other)
    return days.filter("n_main <> n_other").select(day, short.alias("short_of"), F.abs(F.col("n_main") - F.col("n_other")).alias("missing"))


def last_state(log: DataFrame, key: str, value: str, *order: str) -> DataFrame:
    """Upsert semantics: the value written last for each key."""
    return log.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def merged_maps(log: DataFrame, key: str, map_key: Column, map_value: Column, *order: str) -> DataFrame:
    """(key, name, value): maps of a key merged in order, later entries winning."""
    return log.select(key, map_key.alias("name"), map_value.alias("v"), *order).groupBy(key, "name").agg(F.max_by("v", F.struct(*order)).alias("value"))


def new_content(incoming: DataFrame, stored: DataFrame, content: str) -> DataFrame:
    """Rows whose bytes are not stored yet."""
    return incoming.join(stored.select(content).distinct(), content, "left_anti")


def first_of_content(df: DataFrame, content: str, order: str) -> DataFrame:
    """The first row of each content, with how many there are."""
    return df.groupBy(content).agg(F.min(order).alias(order), F.count("*").alias("n"))


def capture_gate(progress_row: DataFrame, locked: Column) -> DataFrame:
    gate = F.when(locked, "open").when(F.col("status") == "complete", "analysis").otherwise("shooting")
    return progress_row.withColumn("gate", gate)


def may_capture(kind: Column, override: Column, gate: Column) -> Column:
    """Whether an upload is taken in: calibration always, sessions once the gate is open, or against it by request."""
    return F.coalesce((kind != "session") | override | (gate == "open"), F.lit(False))


def key_changes(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Keys lost, gained, changed or same between two key/value tables; a key may have a null value."""
    x = a.select(key, F.col(value).alias("before"), F.lit(True).alias("_a"))
    y = b.select(key, F.col(value).alias("after"), F.lit(True).alias("_b"))
    kind = F.when(F.col("_b").isNull(), "lost").when(F.col("_a").isNull(), "gained").when(~F.col("before").eqNullSafe(F.col("after")), "changed").otherwise("same")
    return x.join(y, key, "full").withColumn("change", kind).drop("_a", "_b")


def rolling_mean(days: DataFrame, day: str, value: str, width: int, by: list[str]) -> DataFrame:
    """Mean over the calendar days up to width before; missing days don't count."""
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    return days.withColumn("mean", F.avg(value).over(Window.partitionBy(*by).orderBy(number).rangeBetween(-(width - 1), 0)))


def canonical_digest(**fields: Column) -> Column:
    """SHA-256 of a JSON object with sorted keys and no white space."""
    return F.sha2(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))).cast("binary"), 256)


def roster(*tables: DataFrame) -> DataFrame:
    """All distinct ids of several tables of one column."""
    out = tables[0]
    for more in tables[1:]:
        out = out.union(more)
    return out.distinct()


def stamp(time: Column) -> Column:
    """ISO text to the second."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")


def local_day(time: Column, minutes_east: int) -> Column:
    """The calendar day where clocks are so many minutes ahead."""
    return F.date_format(time + F.expr(f"INTERVAL {minutes_east} MINUTE"), "yyyy-MM-dd")

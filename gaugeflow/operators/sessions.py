"""Sessions and what follows from their order: creation, padding, progress, lifecycles, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .capture import merged_maps


def get_or_create(log: DataFrame, by: list[str], row: str, map_key: Column, map_value: Column, *order: str) -> DataFrame:
    """One row per session (a combination of `by`): its id, the least `row`, and its covariates, merged
    in order with later ones winning, as JSON with sorted names."""
    session = F.struct(*by).alias("session")
    ids = log.groupBy(session).agg(F.min(row).alias("session_id"))
    merged = merged_maps(log.select(session, map_key.alias("_k"), map_value.alias("_v"), *order), "session", F.col("_k"), F.col("_v"), *order)
    pairs = merged.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("name", F.col("value").cast("string").alias("value")))).alias("p"))
    text = F.to_json(F.map_from_entries("p"), {"ignoreNullFields": "false"})
    return ids.join(pairs, "session").select("session.*", "session_id", text.alias("covariates"))


def value_or_default(keys: DataFrame, state: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """The state's value of every key, the default where it has none."""
    return keys.select(key).join(state.select(key, value), key, "left").select(key, F.coalesce(value, default).alias(value))


def counts_over(rows: DataFrame, domain: DataFrame, by: str) -> DataFrame:
    """Rows per value of a domain; values without rows count 0."""
    return domain.select(by).distinct().join(rows.groupBy(by).agg(F.count("*").alias("n")), by, "left").fillna(0, ["n"])


def padded_slots(days: DataFrame, day: str, least: int) -> DataFrame:
    """The sittings of all days with a number over all of them from 1, and empty ones (without a
    day) up to `least`. Numbers come from a running sum over days, a table as small as the
    calendar; slots are made after that."""
    whole = Window.orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    offset = days.select(day, "n_main", "n_other", "slots", F.coalesce(F.sum("slots").over(whole), F.lit(0)).alias("before"))
    rows = offset.filter("slots > 0").select(day, "n_main", "n_other", "before", F.explode(F.sequence(F.lit(1), F.col("slots").cast("int"))).alias("slot"))
    rows = rows.select((F.col("before") + F.col("slot")).alias("number"), day, "slot", (F.col("slot") <= F.col("n_main")).alias("has_main"), (F.col("slot") <= F.col("n_other")).alias("has_other"))
    total = days.agg(F.coalesce(F.sum("slots"), F.lit(0)).cast("int").alias("total"))
    pads = total.filter(F.col("total") < least).select(F.explode(F.sequence((F.col("total") + 1).cast("long"), F.lit(least).cast("long"))).alias("number"))
    kind = dict(days.dtypes)[day]
    return rows.unionByName(pads.select("number", F.lit(None).cast(kind).alias(day), F.lit(None).cast("int").alias("slot"), F.lit(False).alias("has_main"), F.lit(False).alias("has_other")))


def progress_record(days: DataFrame, day: str, repeats: int, least_days: int, passed: str = "n_pass", failed: str = "n_fail") -> DataFrame:
    """The whole state of a calibration in one row: counts of shots, pairs, slots and days, what
    passed and failed (which doesn't decide), what is missing and left, first and last day."""
    t = days.agg(
        F.coalesce(F.sum("n_main"), F.lit(0)).alias("n_main"), F.coalesce(F.sum("n_other"), F.lit(0)).alias("n_other"),
        F.coalesce(F.sum(passed), F.lit(0)).alias("n_pass"), F.coalesce(F.sum(failed), F.lit(0)).alias("n_fail"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("complete"), F.coalesce(F.sum("slots"), F.lit(0)).alias("n_slots"),
        F.count("*").alias("n_days"), F.count_if(F.col("n_main") != F.col("n_other")).alias("unpaired_days"),
        F.coalesce(F.sum(F.abs(F.col("n_main") - F.col("n_other"))), F.lit(0)).alias("unpaired_shots"),
        F.min(day).alias("first_day"), F.max(day).alias("last_day"),
    )
    left, days_left = F.greatest(F.lit(0), repeats - F.col("complete")), F.greatest(F.lit(0), least_days - F.col("n_days"))
    status = F.when((left == 0) & (days_left == 0), "complete").when(left == 0, "spread").otherwise("in_progress")
    return t.select("*", left.alias("remaining"), days_left.alias("days_remaining"), (left * 2).alias("photos_remaining"), F.lit(repeats).alias("repeats"), F.lit(least_days).alias("least_days"), status.alias("status"))


def prior(rows: DataFrame, by: str, order: list[str], values: list[str]) -> DataFrame:
    """Each row with the values of the one before it in its group, an as-of join with itself."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.select("*", *(F.lag(v).over(w).alias(f"prior_{v}") for v in values))


def lifecycles(seen: DataFrame, what: str, session: str, last: Column, born_in: int = 2, of: int = 3, absent: int = 3) -> DataFrame:
    """When each thing was born (seen in `born_in` of the latest `of` sessions) and resolved (not seen
    in `absent` sessions on end; dated back to the first of them), by session numbers; null if never."""
    w = Window.partitionBy(what).orderBy(session)
    recent = F.count("*").over(w.rangeBetween(-(of - 1), 0))
    rows = seen.select(what, session, last.alias("_last")).distinct()
    rows = rows.select(what, session, recent.alias("recent"), F.coalesce(F.lead(session).over(w), F.col("_last") + 1).alias("next"))
    born = F.min(F.when(F.col("recent") >= born_in, F.col(session)))
    gone = rows.withColumn("gone", F.when(F.col("next") - F.col(session) > absent, F.col(session) + 1))
    return gone.groupBy(what).agg(born.alias("born"), F.max_by("gone", session).alias("resolved"))


def lag_slope(series: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Slope of each value over the one before it, least squares per group."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(order))
    return series.withColumn("_before", before).groupBy(by).agg(F.regr_slope(value, "_before").alias("slope"), F.count("_before").alias("n"))


def wrong_digests(files: DataFrame, stated: DataFrame, key: str) -> DataFrame:
    """Keys whose content isn't what its stated SHA-256 says, or that one side lacks."""
    found = files.select(key, F.sha2("content", 256).alias("found"))
    both = found.join(stated.select(key, F.col("sha256").alias("stated")), key, "full")
    why = F.when(F.col("found").isNull(), "missing").when(F.col("stated").isNull(), "unknown").when(F.col("found") != F.col("stated"), "changed")
    return both.withColumn("why", why).filter("why IS NOT NULL")


def split_manifest(plan: DataFrame, day: str) -> DataFrame:
    """One row per split: its dates in order, as a list, and how many there are."""
    return plan.groupBy("split").agg(F.array_sort(F.collect_set(day)).alias("dates"), F.countDistinct(day).alias("n_dates"))

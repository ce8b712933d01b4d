"""Chronological splits that keep days of one block away from the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import half_even


class TooFewDates(ValueError):
    pass


def check_arguments(ratios: tuple[float, float, float], gap: int) -> None:
    """Three positive ratios that sum to 1, and a gap of whole days."""
    if len(ratios) != 3 or min(ratios) <= 0 or abs(sum(ratios) - 1) > 1e-6:
        raise ValueError(f"three positive ratios with sum 1 are needed, not {ratios}")
    if gap < 0 or gap != int(gap):
        raise ValueError(f"the gap is a number of days, not {gap}")


def without_calibration(rows: DataFrame, kind: str, calibration: str = "calibration") -> DataFrame:
    """Calibration rows never enter a split."""
    return rows.filter(F.coalesce(F.col(kind) != calibration, F.lit(True)))


def ratio_split(dates: DataFrame, day: str, ratios: tuple[float, float, float], gap: int) -> DataFrame:
    """(day, split): distinct dates in blocks of the ratios; heads of later blocks that are within
    `gap` days of the last kept day before are 'gap'. One row per calendar day, so a window
    without partitions is bounded by the calendar."""
    check_arguments(ratios, gap)
    d = dates.select(F.col(day).alias("d")).filter("d IS NOT NULL").distinct()
    ranked = d.select("d", F.row_number().over(Window.orderBy("d")).alias("k"), F.count("*").over(Window.partitionBy()).alias("n"))
    train = F.greatest(F.lit(1), F.least(half_even(F.col("n") * ratios[0]), F.col("n").cast("int") - 2))
    val = F.greatest(F.lit(1), F.least(half_even(F.col("n") * ratios[1]), F.col("n").cast("int") - train - 1))
    block = F.when(F.col("k") <= train, "train").when(F.col("k") <= train + val, "val").otherwise("test")
    blocks = ranked.select("d", block.alias("block"))
    whole = Window.partitionBy()
    last_train = F.max(F.when(F.col("block") == "train", F.col("d"))).over(whole)
    b = blocks.withColumn("last_train", last_train)
    b = b.withColumn("keep_val", (F.col("block") == "val") & (F.datediff("d", "last_train") > gap))
    b = b.withColumn("last_val", F.max(F.when(F.col("keep_val"), F.col("d"))).over(whole))
    keep_test = (F.col("block") == "test") & (F.datediff("d", F.coalesce("last_val", "last_train")) > gap)
    return b.select(F.col("d").alias(day), F.when(F.col("block") == "train", "train").when(F.col("keep_val"), "val").when(keep_test, "test").otherwise("gap").alias("split"))


def trailing_split(dates: DataFrame, day: str, val_days: int, test_days: int, gap: int) -> DataFrame:
    """(day, split) by fixed windows that end at the last date."""
    d = dates.select(F.col(day).alias("d")).filter("d IS NOT NULL").distinct()
    back = F.datediff(F.max("d").over(Window.partitionBy()), "d")
    test, val = test_days - 1, test_days + gap
    split = F.when(back <= test, "test").when((back >= val) & (back < val + val_days), "val").when(back >= val + val_days + gap, "train").otherwise("gap")
    return d.select(F.col("d").alias(day), split.alias("split"))


def check_enough(plan: DataFrame) -> None:
    found = {r[0]: r[1] for r in plan.groupBy("split").count().collect()}
    lacking = [s for s in ("train", "val", "test") if not found.get(s)]
    if lacking:
        raise TooFewDates(f"no dates for {', '.join(lacking)} among {sum(found.values())}")


def members(rows: DataFrame, plan: DataFrame, day: str) -> DataFrame:
    """Rows with the split of their day. The plan is as small as the calendar."""
    return rows.join(F.broadcast(plan), day)


def leaks(assigned: DataFrame, identity: str) -> DataFrame:
    """Identities that occur in more than one split."""
    return assigned.filter("split <> 'gap'").groupBy(identity).agg(F.countDistinct("split").alias("n_splits")).filter("n_splits > 1")


def readiness(assigned: DataFrame, positive: Column) -> DataFrame:
    """One row: are the three blocks there, with positives in train and val."""
    a = assigned.agg(*(F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")), *(F.count_if((F.col("split") == s) & positive).alias(f"positive_{s}") for s in ("train", "val")))
    ready = (F.col("n_train") > 0) & (F.col("n_val") > 0) & (F.col("n_test") > 0) & (F.col("positive_train") > 0) & (F.col("positive_val") > 0)
    return a.withColumn("ready", ready)


def totals(assigned: DataFrame, day: str, session: str, n_images: str) -> DataFrame:
    """Days, sessions and images per split, and of all in a row whose split is null. `assigned` has a
    row per session with its images counted; each day has one split, so the rows of (split, day),
    as many as the calendar has, are what is rolled up."""
    per_day = assigned.groupBy("split", day).agg(F.countDistinct(session).alias("n_sessions"), F.sum(n_images).alias("n_images"))
    return per_day.rollup("split").agg(F.count("*").alias("n_days"), F.sum("n_sessions").alias("n_sessions"), F.sum("n_images").alias("n_images"))

"""Limits of a workspace: what of a conversation is sent on, which uploads are accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .validation import reasons


def recent_turns(turns: DataFrame, conv: str, turn: str, text: str, most: int = 8, budget: int = 10_000) -> DataFrame:
    """(conv, turn) of the history that goes with the last turn of each conversation.

    Of the `most` turns before the last one, pairs are dropped from the oldest on until the rest
    and the last turn have at most `budget` characters. Lengths are never negative, so a pair
    stays just if all from it to the end fits.
    """
    size = F.length(F.coalesce(F.col(text), F.lit("")))
    back = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn))) - 1
    everything = Window.partitionBy(conv)
    t = turns.select(conv, turn, size.alias("n")).withColumn("back", back)
    t = t.withColumn("history", F.count("*").over(everything) - 1).withColumn("question", F.max(F.when(F.col("back") == 0, F.col("n"))).over(everything))
    recent = t.filter(F.col("back").between(1, most)).withColumn("pair", F.floor((F.least(F.lit(most), "history") - F.col("back")) / 2))
    to_the_end = Window.partitionBy(conv).orderBy(F.desc("pair")).rangeBetween(Window.unboundedPreceding, 0)
    return recent.withColumn("total", F.col("question") + F.sum("n").over(to_the_end)).filter(F.col("total") <= budget).select(conv, turn)


def upload_reasons(incoming: DataFrame, stored: DataFrame, profile: str, size: str, content: str, largest: int, capacity: int, **rules: Column) -> DataFrame:
    """`incoming` with the reasons against each row: too large, no room in its profile next to
    what is stored, bytes that the profile has already, and any further rules. Each row is judged
    against the stored rows alone."""
    used = stored.groupBy(profile).agg(F.sum(size).alias("_used"))
    known = stored.select(profile, content).distinct().withColumn("_known", F.lit(True))
    rows = incoming.join(used, profile, "left").join(known, [profile, content], "left")
    room = F.coalesce("_used", F.lit(0)) + F.col(size) <= capacity
    why = reasons(size=F.col(size) <= largest, room=room, new_bytes=F.col("_known").isNull(), **rules)
    return rows.withColumn("reasons", why).drop("_used", "_known")


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many distinct keys only one side has, and whether there are none."""
    sides = a.select(key, F.lit(1).alias("side")).union(b.select(key, F.lit(2).alias("side")))
    per_key = sides.groupBy(key).agg(F.min("side").alias("low"), F.max("side").alias("high"))
    return per_key.agg(F.count_if(F.col("high") == 1).alias("only_left"), F.count_if(F.col("low") == 2).alias("only_right")).withColumn("same", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def cyclic_neighbours(pending: DataFrame, by: str, key: str) -> DataFrame:
    """(by, key, next, previous): the pending key after and before each one within its group, going
    round at the ends; a single key is its own neighbour. Null keys are left out."""
    ordered, whole = Window.partitionBy(by).orderBy(key), Window.partitionBy(by)
    rows = pending.select(by, key).filter(F.col(key).isNotNull()).distinct()
    after, before = F.coalesce(F.lead(key).over(ordered), F.min(key).over(whole)), F.coalesce(F.lag(key).over(ordered), F.max(key).over(whole))
    return rows.select(by, key, after.alias("next"), before.alias("previous"))


def photo_rules(kind: Column, day: Column, today: Column) -> dict[str, Column]:
    """Rules of an added photo beside those of `upload_reasons`: JPEG or PNG, taken on a day that isn't in the future."""
    return {"type": kind.isin("image/jpeg", "image/png"), "date": day <= today}


def upload_in_order(incoming: DataFrame, stored: DataFrame, profile: str, size: str, content: str, order: str, largest: int, capacity: int, **rules: Column) -> DataFrame:
    """`upload_reasons` for rows that come one after the other (by `order`) in one upload: of equal bytes in a profile only
    the first may stay, and what the rows before it that are fit by themselves and new take up counts, whether there was
    room for them or not: one that doesn't fit closes the upload."""
    judged = upload_reasons(incoming, stored, profile, size, content, largest, capacity, **rules)
    before = Window.partitionBy(profile).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    twin = F.row_number().over(Window.partitionBy(profile, content).orderBy(order)) > 1
    alone = F.size(F.array_remove("reasons", "room")) == 0
    rows = judged.withColumn("_twin", twin).withColumn("_takes", F.when(alone & ~F.col("_twin"), F.col(size)).otherwise(0))
    used = stored.groupBy(profile).agg(F.sum(size).alias("_used"))
    rows = rows.withColumn("_before", F.coalesce(F.sum("_takes").over(before), F.lit(0))).join(used, profile, "left")
    full = F.coalesce("_used", F.lit(0)) + F.col("_before") + F.col(size) > capacity
    more = F.array_compact(F.array(F.when(full, F.lit("room")), F.when(F.col("_twin"), F.lit("new_bytes"))))
    return rows.withColumn("reasons", F.array_sort(F.array_union("reasons", more))).drop("_twin", "_takes", "_before", "_used")


def next_pending(roster: DataFrame, placed: DataFrame, key: str) -> DataFrame:
    """One row: the least id of the roster that isn't placed, else the next number that neither has; 0 if there are none."""
    open_ = roster.select(key).distinct().join(placed.select(key).distinct(), key, "left_anti").agg(F.min(key).alias("open"))
    top = roster.select(key).union(placed.select(key)).agg(F.max(key).alias("top"))
    return open_.join(top).select(F.coalesce("open", F.col("top") + 1, F.lit(0)).alias(key))

"""Tile grids, points in tiles and the tile that owns a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import contains


def stride(tile: int, overlap: float) -> int:
    if not 0 <= overlap < 1:
        raise ValueError("overlap is from 0 to below 1")
    return max(1, round(tile * (1 - overlap)))


def starts(length: Column, tile: int, step: int) -> Column:
    """Starts along an axis; the last tile is moved back to end at the edge."""
    inner = F.array_distinct(F.concat(F.sequence(F.lit(0), length - tile, F.lit(step)), F.array(length - tile)))
    return F.when(length <= tile, F.array(F.lit(0))).otherwise(inner)


def grid(images: DataFrame, image: str, width: str, height: str, tile: int, step: int) -> DataFrame:
    """One row per tile: image, tile_id, row, col and its half-open rectangle."""
    w, h = F.col(width), F.col(height)
    t = images.select(image, w.alias("w"), h.alias("h"), F.posexplode(starts(h, tile, step)).alias("row", "y0"))
    t = t.select("*", F.posexplode(starts(F.col("w"), tile, step)).alias("col", "x0"))
    return t.select(image, F.format_string("r%dc%d", "row", "col").alias("tile_id"), "row", "col", "x0", "y0", F.least(F.col("x0") + tile, F.col("w")).alias("x1"), F.least(F.col("y0") + tile, F.col("h")).alias("y1"))


def _cells(x: Column, length: Column, tile: int, step: int) -> Column:
    """Indices of the starts that may cover x: the regular ones before it, and the last."""
    last = F.when(length <= tile, 0).otherwise(F.ceil((length - tile) / step)).cast("int")
    k = F.floor(x / step).cast("int")
    back = -(-tile // step)
    near = [F.greatest(F.lit(0), F.least(k - i, last)) for i in range(back + 1)]
    return F.array_distinct(F.array(*near, last))


def tiles_of(points: DataFrame, tiles: DataFrame, image: str, x: str, y: str, width: str, height: str, tile: int, step: int) -> DataFrame:
    """Points with every tile that contains them. The grid is regular, so a point names its
    candidate rows and columns itself: an equi join, with the exact rectangle as its rest."""
    p = points.withColumn("row", F.explode(_cells(F.col(y), F.col(height), tile, step))).withColumn("col", F.explode(_cells(F.col(x), F.col(width), tile, step)))
    j = p.join(tiles, [image, "row", "col"])
    return j.filter(contains(F.col(x), F.col(y), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))


def owners(inside: DataFrame, point: str, x: str, y: str) -> DataFrame:
    """The tile with the nearest centre; ties go to the upper, then the left one."""
    dx, dy = F.col(x) - (F.col("x0") + F.col("x1")) / 2, F.col(y) - (F.col("y0") + F.col("y1")) / 2
    return inside.groupBy(point).agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), "row", "col", "tile_id")).alias("o")).select(point, F.col("o.tile_id").alias("tile_id"), F.col("o.d2").alias("d2"))


def uncovered(intervals: DataFrame, by: str, start: str, stop: str) -> DataFrame:
    """Gaps in the union of intervals, by a running maximum of the ends before."""
    before = F.max(stop).over(Window.partitionBy(by).orderBy(start, stop).rowsBetween(Window.unboundedPreceding, -1))
    return intervals.withColumn("reach", before).filter(F.col(start) > F.col("reach")).select(by, F.col("reach").alias("gap_start"), F.col(start).alias("gap_stop"))


def thin(points: DataFrame, cell: list[str], order: str, per_cell: int) -> DataFrame:
    return points.withColumn("k", F.row_number().over(Window.partitionBy(*cell).orderBy(order))).filter(F.col("k") <= per_cell).drop("k")


def axis_index(x: Column, length: Column, tile: int, step: int) -> Column:
    """Index of the tile along an axis that holds x (from 0 to below the length) and whose centre is nearest to it, the lower
    one on ties. The grid is regular, so it comes from the place alone: the regular tile whose centre is nearest,
    or the last one, which ends with the image, beyond the middle of its centre and the one before."""
    last = F.greatest(F.lit(0), F.ceil((length - tile) / step).cast("int"))
    # Tiles without overlap: a place is held by one alone.
    nearest = F.floor(x / step) if step >= tile else F.ceil((x - tile / 2) / step - 0.5)
    before = (last - 1) * step
    beyond = (x > (before + length) / 2) | (x >= before + tile)
    return F.when((last == 0) | beyond, last).otherwise(F.greatest(F.lit(0), F.least(nearest.cast("int"), last - 1)))


def _start(index: Column, length: Column, tile: int, step: int) -> Column:
    return F.least(index * step, F.greatest(F.lit(0), length - tile)).cast("int")


def axis_owner(x: Column, length: Column, tile: int, step: int) -> Column:
    """Struct of the index, start and stop of the tile that owns x along an axis; null where no tile holds x."""
    index = axis_index(x, length, tile, step)
    start = _start(index, length, tile, step)
    return F.when((x >= 0) & (x < length), F.struct(index.alias("index"), start.alias("start"), F.least(start + tile, length).cast("int").alias("stop")))


def owner_of(x: Column, y: Column, width: Column, height: Column, tile: int, step: int) -> Column:
    """Struct of the tile that owns a point: tile_id, x0, y0, and the point's place in the tile;
    null for a point outside the image. The squared distance is a sum over the axes, so each axis
    has its own nearest tile; ties go to the upper, then the left one."""
    row, col = axis_index(y, height, tile, step), axis_index(x, width, tile, step)
    x0, y0 = _start(col, width, tile, step), _start(row, height, tile, step)
    tile_id = F.concat(F.lit("r"), row.cast("string"), F.lit("c"), col.cast("string"))
    found = F.struct(tile_id.alias("tile_id"), x0.alias("x0"), y0.alias("y0"), *(c.alias(n) for n, c in zip(("tile_x", "tile_y"), to_tile(x, y, x0, y0))))
    return F.when((x >= 0) & (x < width) & (y >= 0) & (y < height), found)


def owned_or_fail(owner: Column, what: Column) -> Column:
    """The owner; a point that no tile owns ends the job."""
    return F.when(owner.isNotNull(), owner).otherwise(F.raise_error(F.concat(F.lit("no tile holds "), what.cast("string"))))


def to_tile(x: Column, y: Column, x0: Column, y0: Column) -> tuple[Column, Column]:
    return x - x0, y - y0


def to_image(x: Column, y: Column, x0: Column, y0: Column) -> tuple[Column, Column]:
    return x + x0, y + y0


def uncovered_within(intervals: DataFrame, by: str, start: str, stop: str, low: Column, high: Column) -> DataFrame:
    """As `uncovered`, with the stretches before the first and after the last interval of [low, high)."""
    ends = intervals.groupBy(by).agg(F.min(start).alias("first"), F.max(stop).alias("last"), F.min(low).alias("low"), F.max(high).alias("high"))
    before = ends.filter("first > low").select(by, F.col("low").alias("gap_start"), F.col("first").alias("gap_stop"))
    after = ends.filter("last < high").select(by, F.col("last").alias("gap_start"), F.col("high").alias("gap_stop"))
    return uncovered(intervals, by, start, stop).unionByName(before).unionByName(after)


def thin_to(points: DataFrame, cell: list[str], order: str, target: int, cells: int) -> DataFrame:
    """About `target` points spread over a grid of `cells`: an equal share of each cell, `target`
    rows at most, in the order of the cells and of `order`."""
    spread = thin(points, cell, order, max(1, target // cells))
    return spread.orderBy(*cell, order).limit(target)

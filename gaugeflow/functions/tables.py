"""Table functions for SQL: tiles of images, and the sittings of a partition of shots."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.types import Row


class TileGrid:
    """tile_grid(TABLE(images), tile, step): the tiles of each image (image, w, h), with half-open rectangles."""

    RETURNS = "image STRING, tile_id STRING, row INT, col INT, x0 INT, y0 INT, x1 INT, y1 INT"

    def eval(self, image: Row, tile: int, step: int):
        if tile < 1 or step < 1:
            raise ValueError("tile and step are whole pixels")
        if image["w"] is None or image["h"] is None:
            return

        def axis(length: int) -> list[int]:
            return [0] if length <= tile else sorted({*range(0, length - tile, step), length - tile})

        for row, y in enumerate(axis(image["h"])):
            for col, x in enumerate(axis(image["w"])):
                yield str(image["image"]), f"r{row}c{col}", row, col, x, y, min(x + tile, image["w"]), min(y + tile, image["h"])


class Sittings:
    """sittings(TABLE(shots) PARTITION BY (day) ORDER BY (at), main, other): the slots of a day, as its shots (day, lens) come in;
    the i-th shot of either lens belongs to the i-th sitting. Holds two counts, however many shots there are."""

    RETURNS = "day DATE, slot INT, has_main BOOLEAN, has_other BOOLEAN"

    def __init__(self):
        self.day, self.n = None, [0, 0]

    def eval(self, shot: Row, main: str, other: str):
        self.day = shot["day"]
        if shot["lens"] in (main, other):
            self.n[shot["lens"] == other] += 1

    def terminate(self):
        for slot in range(1, max(self.n) + 1):
            yield self.day, slot, slot <= self.n[0], slot <= self.n[1]


def register_tables(spark: SparkSession) -> None:
    """Makes the table functions known to SQL of the session."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("tile_grid", udtf(TileGrid, returnType=TileGrid.RETURNS))
    spark.udtf.register("sittings", udtf(Sittings, returnType=Sittings.RETURNS))

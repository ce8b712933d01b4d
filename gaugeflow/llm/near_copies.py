"""Groups of near copies by the exact Jaccard similarity of their word shingles."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, release, slices, staged, text_bytes
from .graph import components
from .simhash import SEED, links, shingle_hashes, vote

WORDS_IN, SIMILARITY = 5, 0.8
#: Against rounding of SIMILARITY x size, on the side of more candidates and of equality.
SLACK = 1e-9
#: Shingles in COMMON or more distinct texts of a sample (SAMPLED rows, a quarter of all at most)
#: come last in the order of prefixes, so many at most. This is for speed alone: prefixes of any
#: common order meet.
COMMON, SAMPLED, LATE = 4, 200_000, 1_000_000
#: Pairs of one hub that are confirmed together, beside one copy of its text.
HUB_PAIRS = 256
SKETCHES, SIGNATURE, WIDE, _FACTOR = 4, 256, 2048, np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, words_in: int) -> np.ndarray:
    """Hashes of the text's distinct shingles, ascending; a text without words has none."""
    return np.unique(np.array(shingle_hashes(text.lower().split(), words_in), np.uint64))


def _ordered(s: np.ndarray, late: np.ndarray) -> np.ndarray:
    """The set in the order of prefixes: common shingles last, else by hash."""
    at = np.minimum(np.searchsorted(late, s), max(len(late) - 1, 0))
    high = (late[at] == s).astype(np.uint64) if len(late) else np.zeros(len(s), np.uint64)
    return np.sort(s >> np.uint64(1) | high << np.uint64(63))


def _common(words_in):
    def run(batches):
        for batch in slices(batches):
            sets = [shingle_set(t, words_in) for t in text_bytes(batch.column("_text"))]
            value, n = np.unique(np.concatenate(sets) if sets else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["shingle", "n"])

    return run


def common_shingles(docs: DataFrame, text: str, words_in: int) -> np.ndarray:
    step = max(4, -(-docs.count() // SAMPLED))
    sample = docs.select(F.col(text).alias("_text")).filter(F.pmod(F.xxhash64("_text"), F.lit(step)) == 0).distinct()
    counts = sample.mapInArrow(_common(words_in), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    found = counts.filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "shingle").limit(LATE).select("shingle").toArrow()
    return np.sort(found.column("shingle").to_numpy().view(np.uint64))


def _prepare(names, words_in, similarity, late):
    """Appends node (hash of the whole set), size, center (how common its shingles are, in
    thousandths), fp (its SimHash), bits (each shingle flips one of SIGNATURE), wide (the same of WIDE), sketch (the least of
    the set under SKETCHES orders), and the prefix: sets of sizes x <= y share similarity * y elements at least, so of each the first
    size - ceil(similarity * size) + 1 elements, in any order common to all sets, have one in
    common."""

    def run(batches):
        for batch in slices(batches):
            out = [[] for _ in range(5)]
            lists = [[], [], [], []]
            for text in text_bytes(batch.column("_text")):
                hashes = np.array(shingle_hashes(text.lower().split(), words_in), np.uint64)
                s = np.unique(hashes)
                ordered = _ordered(s, late)
                center = int(1000 * (ordered >> np.uint64(63)).mean()) if len(s) else 0
                for column, value in zip(out, (xxhash.xxh3_64_intdigest(s.tobytes(), SEED), len(s), center, vote(hashes))):
                    column.append(value)
                with np.errstate(over="ignore"):
                    sketch = [int((s * np.uint64(2 * k + 1) * _FACTOR).min()) ^ k for k in range(SKETCHES)] if len(s) else []
                lists[0].append(_flips(s, SIGNATURE))
                lists[3].append(_flips(s, WIDE))
                lists[1].append(np.array(sketch, np.uint64).view(np.int64))
                lists[2].append(ordered[: len(s) - math.ceil(similarity * len(s) - SLACK) + 1 if len(s) else 0].view(np.int64))
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (out[0], out[3])]
            columns = [*(batch.column(n) for n in names), longs[0], pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), longs[1], *map(_lists, lists)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "node", "size", "center", "fp", "bits", "sketch", "prefix", "wide"])

    return run


def _flips(s: np.ndarray, bits: int) -> np.ndarray:
    """A signature: which of `bits` an odd number of the set's elements fall on, as words of 64."""
    odd = np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _lists(values):
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)), pa.array(flat))


def _cells(batches, emit):
    """Rows sorted by (cell, size, node): what `emit` makes of the columns of whole cells."""
    rest = None
    for batch in batches:
        now = [np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(batch.num_columns)]
        if rest is not None:
            now = [np.concatenate(x) for x in zip(rest, now)]
        cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
        rest = [x[cut:] for x in now]
        yield from emit(*(x[:cut] for x in now))
    if rest is not None:
        yield from emit(*rest)


def _batch(a, b):
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _shared(batches):
    """Rows of cells with more than one row."""

    def emit(cell, node, size, place):
        same = cell[1:] == cell[:-1]
        on = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(cell) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(cell[on]), pa.array(node[on]), pa.array(size[on]), pa.array(place[on])], ["cell", "node", "size", "place"])

    return _cells(batches, emit)


def _may_be_alike(similarity, size, other, bits, other_bits):
    """Sets of sizes m and n that are similar differ in (m + n)(1 - s)/(1 + s) elements at most, and
    their signatures in no more bits than that: every differing element flips one."""
    apart = np.bitwise_count((bits ^ other_bits).view(np.uint64)).sum(axis=1, dtype=np.int64)
    return apart <= (size + other) * (1 - similarity) / (1 + similarity) + SLACK


def _stars(similarity):
    """Of rows in the order of (cell, how common they are): pairs with the cell's first row, which
    is the likeliest original of its copies, and in the first sketch with the row before."""

    def emit(cell, center, size, node, order, *bits):
        if len(cell) < 2:
            return
        bits = np.stack(bits, axis=1)
        first, at = np.searchsorted(cell, cell), np.arange(len(cell))
        for other in (first, at - 1):
            low, high = np.minimum(size[other], size), np.maximum(size[other], size)
            on = (at > first) & (low >= similarity * high - SLACK) & ((other == first) | (order == 0))
            on &= _may_be_alike(similarity, size, size[other], bits, bits[other])
            yield _batch(node[other[on]], node[at[on]])

    return lambda batches: _cells(batches, emit)


def _all_pairs(similarity):
    """All pairs of a cell that are still apart (by root, and by side if any) and that sizes,
    signatures and places allow. Of the elements two sets share, let the cell's be the first: then they share
    no more than what is left of either set from there on."""

    def emit(cell, size, node, root, place, side, *bits):
        live, gap, bits = np.arange(len(cell)), 1, np.stack(bits, axis=1)
        ends, left = np.searchsorted(cell, cell, side="right"), size - place
        while True:
            live = live[live + gap < ends[live]]
            live = live[size[live] >= similarity * size[live + gap] - SLACK]
            if not live.size:
                return
            other = live + gap
            least = similarity / (1 + similarity) * (size[live] + size[other]) - SLACK
            on = (root[live] != root[other]) & ((side[live] != side[other]) | (side[live] == 0)) & (np.minimum(left[live], left[other]) >= least)
            on[on] = _may_be_alike(similarity, size[live[on]], size[other[on]], bits[live[on]], bits[other[on]])
            if on.any():
                yield _batch(node[live[on]], node[other[on]])
            gap += 1

    return lambda batches: _cells(batches, emit)


def _confirm(words_in, similarity):
    """Of rows in the order of (hub, chunk, role): those that are similar to the hub's own row, which comes first."""

    def run(batches):
        cell, left = None, None
        for batch in slices(batches):
            hub, chunk, role, node = (batch.column(n).to_pylist() for n in ("hub", "chunk", "role", "node"))
            one, two = [], []
            for h, c, r, b, text in zip(hub, chunk, role, node, text_bytes(batch.column("text"))):
                own = shingle_set(text, words_in)
                if r == 0:
                    cell, left = (h, c), own
                    continue
                if cell != (h, c):
                    raise ValueError("a pair without its hub's text")
                both = len(np.intersect1d(left, own, assume_unique=True))
                if both >= similarity * (len(left) + len(own) - both) - SLACK:
                    one.append(h), two.append(b)
            yield _batch(np.array(one, np.int64), np.array(two, np.int64))

    return run


def _plausible(pairs: DataFrame, single: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose wide signatures allow it, by the bound of `_may_be_alike`; a signature is a fraction of a text."""
    own = single.select("node", "size", "wide")
    both = pairs.join(own.toDF("a", "m", "one"), "a").join(own.toDF("b", "n", "two"), "b")
    apart = F.aggregate(F.zip_with("one", "two", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x.cast("int"))
    return both.filter(apart <= (F.col("m") + F.col("n")) * ((1 - similarity) / (1 + similarity)) + SLACK).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, words_in: int, similarity: float) -> DataFrame:
    """The pairs whose texts are similar. Each pair goes to its hub, the end with more pairs; the hub's text goes there once per
    HUB_PAIRS of its pairs, the others' once a pair, in one shuffle of texts by node and one by hub. So
    a hub of any size is spread, and its text isn't repeated for each partner."""
    pairs = Staged(pairs, "pairs")
    degree = pairs.df.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
    both = pairs.df.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    first = F.col("da") >= F.col("db")
    ends = both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("node"), F.ceil(F.greatest("da", "db") / HUB_PAIRS).cast("int").alias("chunks"))
    ends = Staged(ends.select("hub", "node", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk")), "ends")
    hubs = ends.df.select("hub", F.col("hub").alias("node"), "chunk").distinct().withColumn("role", F.lit(0))
    routes = hubs.unionByName(ends.df.withColumn("role", F.lit(1)))
    at = texts.join(routes, "node").select("hub", "chunk", "role", "node", "text")
    at = at.repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", "role", "node")
    found = staged(at.mapInArrow(_confirm(words_in, similarity), "a long, b long"), "links")
    pairs.drop(), ends.drop()
    return found


def near_groups(docs: DataFrame, text: str = "text", words_in: int = WORDS_IN, similarity: float = SIMILARITY, cell_rows: int = 20_000) -> tuple[DataFrame, DataFrame]:
    """The columns of docs with row (an id of the row), written once; and (row, root), where root is
    equal in all rows of a group.

    Rows whose texts' sets of `words_in`-word shingles have a Jaccard similarity of `similarity`
    or more are linked, and groups are what links reach. Texts of fewer words are one shingle;
    texts without words are equal. Sets meet by 64-bit hashes. Keys and nulls play no part; a row
    stays a row.

    Likely pairs are confirmed first: each row of a SimHash group (3 bits, by anchor-point covering)
    with one of them, and of rows that share a sketch with the likeliest original. Bits of a
    SimHash can't be the only filter: at 0.8 about 10 of 64 differ, up to 20, too many for any
    covering that still separates. So, in order to miss no similar pair, all pairs that share a
    shingle of their prefixes follow, but for those in one group by then, and those that sizes,
    signatures and places of the shingle rule out. Each pair is confirmed on its texts. Cells (the rows of one
    shingle) over `cell_rows` are compared as pairs of blocks.
    """
    names, kinds = docs.columns, dict(docs.dtypes)
    schema = ", ".join([*(f"`{n}` {kinds[n]}" for n in names), "node long, size int, center int, fp long, bits array<long>, sketch array<long>, prefix array<long>, wide array<long>"])
    late = common_shingles(docs, text, words_in)
    rows = docs.withColumn("_text", F.col(text)).mapInArrow(_prepare(names, words_in, similarity, late), schema)
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    again = rows.groupBy("node").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1").select("node", "first")
    first_rows = rows.join(staged(again, "again"), "node", "left").filter("first IS NULL OR first = row")
    texts = first_rows.select("node", F.col(text).alias("text"))
    # What most steps need of a text, written once: each plan that would join it again costs the driver.
    words = [f"bits{k}" for k in range(SIGNATURE // 64)]
    single = staged(first_rows.select("node", "size", "center", "fp", *(F.col("bits")[k].alias(w) for k, w in enumerate(words)), "wide", "sketch"), "single")
    release(docs.sparkSession)

    # Likely pairs first: of each SimHash group and of each sketch a row with the others.
    groups = components(links(single.select("fp").distinct())).toDF("fp", "root")
    member = single.select("fp", "node").join(groups, "fp", "left").select(F.coalesce("root", "fp").alias("root"), "node")
    least = member.groupBy("root").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").select("root", "a")
    near = member.join(least, "root").filter("a <> node").select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
    sketched = single.select(F.posexplode("sketch").alias("order", "cell"), "center", "size", "node", *words)
    sketched = sketched.select("cell", "center", "size", "node", "order", *words)
    sketched = sketched.repartition("cell").sortWithinPartitions("cell", F.desc("center"), "size", "node")
    likely = near.union(sketched.mapInArrow(_stars(similarity), "a long, b long")).distinct()
    first = _confirmed(_plausible(likely, single, similarity), texts, words_in, similarity)
    roots = staged(components(first), "roots")
    release(docs.sparkSession)

    # Then every pair that shares an element of its prefixes, unless it is in one group already.
    cells = first_rows.select(F.posexplode("prefix").alias("place", "cell"), "node", "size").select("cell", "node", "size", "place")
    cells = cells.repartition("cell").sortWithinPartitions("cell", "size", "node")
    cells = Staged(cells.mapInArrow(_shared, "cell long, node long, size int, place int"), "cells")
    release(docs.sparkSession)
    apart = cells.df.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = apart.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / cell_rows).cast("int").alias("blocks")).filter("low < high").select("cell", "blocks")
    apart = apart.join(mixed, "cell").join(single.select("node", *words), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    block = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(
            F.xxhash64("cell", F.least(k, F.col("own")), F.greatest(k, F.col("own"))).alias("cell"),
            F.when(k == F.col("own"), 0).when(F.col("own") < k, 1).otherwise(2).alias("side"),
        ),
    )
    apart = apart.withColumn("at", F.explode(block)).select("at.cell", "size", "node", "root", "place", "at.side", *words)
    apart = apart.repartition("cell").sortWithinPartitions("cell", "size", "node")
    more = apart.mapInArrow(_all_pairs(similarity), "a long, b long").distinct()
    second = _confirmed(_plausible(more, single, similarity), texts, words_in, similarity)
    cells.drop()
    release(docs.sparkSession)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(second))
    of = rows.select("row", "node").join(roots, "node", "left").select("row", F.coalesce("root", "node").alias("root"))
    return rows.select(*names, "row"), of


def near_copies(docs: DataFrame, text: str = "text", words_in: int = WORDS_IN, similarity: float = SIMILARITY, cell_rows: int = 20_000) -> DataFrame:
    """The columns of docs, row and root: `near_groups` in one table."""
    rows, of = near_groups(docs, text, words_in, similarity, cell_rows)
    return rows.join(of, "row")

"""SimHash near-duplicates: 64-bit fingerprints linked by anchor-point covering."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, staged, table, text_bytes
from .graph import Forest, components

BITS, DISTANCE, SEED = 64, 3, 42


def shingle_hashes(words: list[bytes], words_in: int) -> list[int]:
    """Hashes of all runs of `words_in` words, or of all words if there are no more."""
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= words_in:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -words_in]))
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts.tolist(), (ends[words_in - 1 :] - 1).tolist())]


def vote(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes; zero if there are none."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, words_in: int) -> int:
    """The vote of the shingles' hashes, repeats included."""
    return vote(np.array(shingle_hashes(text.lower().split(), words_in), np.uint64))


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", words_in: int = 3) -> DataFrame:
    """`keep` columns and fp (the fingerprint as a signed long) of every document."""
    kinds = dict(docs.dtypes)

    def run(batches):
        for batch in slices(batches):
            fps = np.array([fingerprint(x, words_in) for x in text_bytes(batch.column("_text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(f"_k{i}") for i in range(len(keep))), pa.array(fps)], [*(f"_k{i}" for i in range(len(keep))), "fp"])

    at = docs.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keep)), F.col(text).alias("_text"))
    at = at.mapInArrow(run, ", ".join([*(f"_k{i} {kinds[k]}" for i, k in enumerate(keep)), "fp long"]))
    return at.select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)), "fp")


class Covering:
    """A covering code of 48-bit words: Golay (23 bits, radius 3) twice, and all words of the last 2
    bits. Its 2^26 words are the anchors; every word has one at most 6 bits away."""

    BITS, POLY, CHECKS, RADIUS, FREE = 23, 0xAE3, 11, 3, 2
    #: Two words at THRESHOLD differing bits have a word between them, 1 bit from each; its nearest
    #: anchor is within the covering radius of it, hence within REACH of both.
    THRESHOLD = 2
    REACH = 2 * RADIUS + THRESHOLD // 2

    def __init__(self):
        single = []
        for bit in range(self.BITS):  # the remainder of a single bit
            value = 1 << bit
            for high in range(self.BITS - 1, self.CHECKS - 1, -1):
                if value >> high & 1:
                    value ^= self.POLY << (high - self.CHECKS)
            single.append(value)
        self.remainder = np.zeros(1, np.uint16)
        for value in single:  # of all words, doubling
            self.remainder = np.concatenate((self.remainder, self.remainder ^ np.uint16(value)))
        # The errors of up to REACH bits in the order of (remainder, weight), and where each run begins.
        words = np.zeros(1, np.uint32)
        weights = np.zeros(1, np.uint8)
        for bit in range(self.BITS):
            on = weights < self.REACH
            words, weights = np.concatenate((words, words[on] | np.uint32(1 << bit))), np.concatenate((weights, weights[on] + 1))
        run = self.remainder[words].astype(np.int64) * (self.REACH + 1) + weights
        self.errors = words[np.argsort(run, kind="stable")].astype(np.uint64)
        self.size = np.bincount(run, minlength=(self.REACH + 1) << self.CHECKS)
        self.start = np.cumsum(self.size) - self.size

    def anchors(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, anchor): for each word all anchors within REACH."""
        mask, shift, runs = np.uint64((1 << self.BITS) - 1), np.uint64(self.BITS), self.REACH + 1
        low = self.remainder[words & mask].astype(np.int64) * runs
        high = self.remainder[(words >> shift) & mask].astype(np.int64) * runs
        out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for a in range(runs):
            for b in range(runs - a):
                many = self.size[low + a] * self.size[high + b]
                index = np.repeat(np.arange(len(words)), many)
                k = np.arange(len(index)) - np.repeat(np.cumsum(many) - many, many)
                wide = self.size[high + b][index]
                one = self.errors[self.start[low + a][index] + k // np.maximum(wide, 1)]
                two = self.errors[self.start[high + b][index] + k % np.maximum(wide, 1)]
                near = words[index] ^ one ^ (two << shift)
                for free in range(1 << self.FREE):
                    if a + b + free.bit_count() <= self.REACH:
                        out.append((index, near ^ np.uint64(free << 2 * self.BITS)))
        return tuple(np.concatenate(x) for x in zip(*out))


@lru_cache(maxsize=1)
def covering() -> Covering:
    return Covering()


def replicas(fps: DataFrame) -> DataFrame:
    """(anchor, fp): each fingerprint at every anchor within reach.

    Of four blocks of 16 bits, fingerprints at 3 or fewer differing bits have one that takes at
    least one of these; the other three blocks, 48 bits, differ by 2 at most. So the covering is
    laid over all four choices of three blocks, with 2 as its threshold.
    """

    def run(batches):
        code = covering()
        for batch in batches:
            for part in range(0, batch.num_rows, 1 << 13):
                fp = batch.column("fp").slice(part, 1 << 13).to_numpy().view(np.uint64)
                for left_out in range(4):
                    low = fp & np.uint64((1 << 16 * left_out) - 1)
                    high = fp >> np.uint64(16 * left_out + 16) if left_out < 3 else np.zeros_like(fp)
                    index, anchor = code.anchors(low | high << np.uint64(16 * left_out))
                    anchor |= np.uint64(left_out << 48)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp[index].view(np.int64))], ["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor long, fp long")


def _compare(most: int | None):
    """Rows sorted by cell: links of every cell, as stars. Cells of more than `most` rows are not
    held; their rows pass as they are, with crowded set."""

    def run(batches):
        forest, rest, full = Forest(), None, None

        def passed(cell, fp):
            return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp), pa.array(np.ones(len(fp), bool))], ["a", "b", "crowded"])

        for batch in batches:
            cell, fp, side = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in ("cell", "fp", "side"))
            if full is not None:
                on = cell == full
                yield passed(cell[on], fp[on])
                cell, fp, side = cell[~on], fp[~on], side[~on]
            if rest is not None:
                cell, fp, side = (np.concatenate(x) for x in zip(rest, (cell, fp, side)))
            if not len(cell):
                continue
            # A batch may complete a cell that is over the limit; it is compared as any other.
            cut = int(np.searchsorted(cell, cell[-1]))
            _links(cell[:cut], fp[:cut], side[:cut], forest)
            rest = (cell[cut:], fp[cut:], side[cut:])
            if most is not None and len(rest[0]) > most:
                full = cell[-1]
                yield passed(rest[0], rest[1])
                rest = None
        if rest is not None:
            _links(*rest, forest)
        forest.reduce()
        yield pa.RecordBatch.from_arrays([pa.array(forest.a), pa.array(forest.b), pa.array(np.zeros(len(forest.a), bool))], ["a", "b", "crowded"])

    return run


def _links(cell, fp, side, forest):
    word = fp.view(np.uint64)
    ends = np.searchsorted(cell, cell, side="right")
    live, gap = np.arange(len(cell)), 1
    while True:
        live = live[live + gap < ends[live]]
        if not live.size:
            return
        other = live + gap
        near = (np.bitwise_count(word[live] ^ word[other]) <= DISTANCE) & ((side[live] != side[other]) | (side[live] == 0))
        if near.any():
            forest.add(fp[live[near]], fp[other[near]])
        gap += 1


def links(fps: DataFrame, cell_rows: int = 20_000) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of `fps(fp)` (distinct) at DISTANCE or less.

    An anchor with (well) more than `cell_rows` replicas is cut into blocks by a hash of the
    fingerprint, and each pair of blocks is compared as a cell of its own, so that a task holds
    two blocks at most however many rows an anchor has.
    """
    schema = "a long, b long, crowded boolean"
    cells = replicas(fps).select(F.col("anchor").alias("cell"), F.lit(0).alias("side"), "fp")
    found = staged(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_compare(cell_rows), schema), "links")
    usual, crowded = found.filter("NOT crowded").select("a", "b"), found.filter("crowded").select(F.col("a").alias("anchor"), F.col("b").alias("fp"))
    if crowded.isEmpty():
        return usual
    blocks = crowded.groupBy("anchor").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(
            F.xxhash64("anchor", F.least(k, F.col("own")), F.greatest(k, F.col("own"))).alias("cell"),
            # 0: the cell is one block; else its two blocks are 1 and 2, compared only with each other.
            F.when(k == F.col("own"), 0).when(F.col("own") < k, 1).otherwise(2).alias("side"),
        ),
    )
    cells = crowded.join(blocks, "anchor").withColumn("own", own).withColumn("at", F.explode(pairs)).select("at.cell", "at.side", "fp")
    cells = cells.repartition("cell").sortWithinPartitions("cell")
    return usual.union(cells.mapInArrow(_compare(None), schema).select("a", "b"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words_in: int = 3) -> DataFrame:
    """key, fp, component_id of every document.

    Fingerprints at 3 or fewer differing bits are linked; component_id is the smallest key that
    links reach, the own one included. Null and empty texts have fingerprint zero, linked like
    any other; equal texts share a fingerprint; a null key is never the smallest, and a component
    of null keys alone has a null id. Repeated rows each keep their row; an empty table gives
    none; other columns are ignored.
    """
    docs = staged(fingerprints(docs.select(key, text), [key], text, words_in).withColumnRenamed(key, "id"), "prints")
    distinct = staged(docs.groupBy("fp").agg(F.min("id").alias("least")), "fps")
    roots = components(links(distinct)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Only linked fingerprints have to meet; the root of the others is their own.
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return docs.join(of, "fp").select(F.col("id").alias(key), "fp", "component_id")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

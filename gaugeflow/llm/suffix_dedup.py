"""Repeated-passage removal with a logarithmic family of sparse suffix arrays.

A 100-byte string is found through one of its suffixes: the one that starts at the string's
minimizer, the 24-byte gram with the least hash (leftmost on ties). Equal strings have it at the
same place, so an index of the suffixes at minimizers (about 3 in 100 positions) misses nothing.

An index entry stands for all windows (100-byte strings) that share a minimizer: `gram` is the
hash of the suffix's first 24 bytes, `around` the hash of all bytes under those windows, and the
entry keeps the first place where that context occurs. A suffix array is the table of entries in
the order (gram, around), cut into ranges of the gram's hash. New documents come in batches in
the order of their keys. A batch's array is merge-scanned with the arrays of the existing levels:
  - a context seen before repeats in full: its windows are repeated passages;
  - contexts that share a gram only may still share some windows: their bytes are compared;
  - new contexts become the batch's own level; levels of equal size merge, so that after n
    batches there are about log2(n) levels.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staged, release, slices, staged, table, text_bytes

LENGTH, GRAM = 100, 24
GRAMS = LENGTH - GRAM + 1
#: Bytes that one pass of the sampler takes; longer documents are cut with an overlap.
PIECE = 1 << 20
_MASK = np.uint64((1 << 24) - 1)
_FACTOR = 0x9E3779B97F4A7C15
_VALUES = np.frombuffer(b"".join(hashlib.blake2b(bytes([c]), digest_size=8).digest() for c in range(256)), np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Sampler:
    """Minimizers of a buffer of documents, by rolling hashes over the whole buffer at once."""

    def __init__(self):
        n = PIECE + 2 * LENGTH
        self.up, self.down = _powers(_FACTOR, n), _powers(pow(_FACTOR, -1, 1 << 64), n)

    def entries(self, data: np.ndarray, ends: np.ndarray):
        """(gram, around, place, first, last): `first` to `last` are the starts of the windows
        that have their minimizer at `place`; `ends` are the ends of the documents in `data`."""
        n = len(data)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[data] * self.up[:n], out=sums[1:])
        gram = _mix((sums[GRAM:] - sums[:-GRAM]) * self.down[: n - GRAM + 1])
        least = (gram & ~_MASK) | np.arange(len(gram), dtype=np.uint64)
        span = 1
        while span * 2 <= GRAMS:
            least, span = np.minimum(least[:-span], least[span:]), span * 2
        least = np.minimum(least[: len(least) - (GRAMS - span)], least[GRAMS - span :])
        inside = np.ones(len(least), bool)
        for end in ends.tolist():  # windows don't cross documents
            inside[max(0, end - LENGTH + 1) : end] = False
        start = np.flatnonzero(inside)
        place = (least[start] & _MASK).astype(np.int64)
        if not len(start):
            return (np.zeros(0, np.uint64),) * 2 + (start,) * 3
        new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1))))
        first, last, place = start[new], start[np.append(new[1:], len(start)) - 1], place[new]
        around = _mix((sums[last + LENGTH] - sums[first]) * self.down[first]) ^ ((place - first).astype(np.uint64) << np.uint64(48))
        return gram[place], around, place, first, last


def _packed(place, first, last):
    """Place, windows before it (7 bits) and further windows after the first (7 bits) in a long."""
    return (place << 16) | ((place - first) << 8) | (last - first)


def _unpacked(pack):
    place = pack >> 16
    first = place - ((pack >> 8) & 127)
    return place, first, first + (pack & 127)


LOCAL = 1 << 15


def _sample(batches):
    sampler = Sampler()
    names = ["gram", "around", "seq", "pack"]

    def emit(parts, seqs, starts):
        data = np.frombuffer(b"".join(parts), np.uint8)
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths)
        gram, around, place, first, last = sampler.entries(data, ends[:-1]) if len(data) >= LENGTH else (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
        doc = np.searchsorted(ends, place, side="right")
        shift = np.array(starts)[doc] - (ends - lengths)[doc] if len(place) else place
        seq = np.array(seqs, np.int64)[doc] if len(place) else place
        place, first, last = place + shift, first + shift, last + shift
        # What repeats within this buffer needs no index: all but its first place is a repeat.
        order = np.lexsort((place, seq, around, gram))
        g, a = gram[order], around[order]
        again = np.zeros(len(g), bool)
        again[1:] = (g[1:] == g[:-1]) & (a[1:] == a[:-1])
        repeat = np.zeros(len(g), bool)
        repeat[order] = again
        pack = _packed(place, first, last) | np.where(repeat, LOCAL, 0)
        # Repeats only pass through; they are spread over the ranges.
        gram = np.where(repeat, _mix(seq.astype(np.uint64) * np.uint64(_FACTOR) + place.astype(np.uint64)), gram)
        return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(around.view(np.int64)), pa.array(seq), pa.array(pack)], names)

    with np.errstate(over="ignore"):
        for batch in slices(batches):
            parts, seqs, starts, size = [], [], [], 0
            for seq, text in zip(batch.column("seq").to_pylist(), text_bytes(batch.column("text"))):
                for at in range(0, max(1, len(text) - LENGTH + 1), PIECE - LENGTH):
                    piece = text[at : at + PIECE - 1]
                    if size + len(piece) > PIECE and parts:
                        yield emit(parts, seqs, starts)
                        parts, seqs, starts, size = [], [], [], 0
                    parts.append(piece), seqs.append(seq), starts.append(at)
                    size += len(piece)
            if parts:
                yield emit(parts, seqs, starts)


#: What a merge-scan returns: a repeated run of bytes, an entry whose bytes are to be compared
#: with those of others of its gram, a new entry of the index.
REPEAT, COMPARE, ENTRY = 0, 1, 2


def _merge_scan(begin: int):
    """Rows in the order (gram, around, seq, pack), old entries (seq < begin) and new ones."""

    def run(batches):
        gram_now = around_now = None
        olds = reps = 0
        old_row = only_row = None  # the one old entry of the open gram; its one entry so far

        def rows(kind, gram, around, seq, pack):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(seq), kind, np.int8)), pa.array(gram), pa.array(around), pa.array(seq), pa.array(pack)], ["kind", "gram", "around", "seq", "pack"])

        def one(kind, row):
            return rows(kind, *(np.array([x], np.int64) for x in row))

        for batch in batches:
            gram, around, seq, pack = (batch.column(k).to_numpy() for k in ("gram", "around", "seq", "pack"))
            local = (pack & LOCAL) > 0
            if local.any():
                yield rows(REPEAT, gram[local], around[local], seq[local], pack[local])
                gram, around, seq, pack = (x[~local] for x in (gram, around, seq, pack))
            if not len(gram):
                continue
            rep = np.ones(len(gram), bool)
            rep[1:] = (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])
            rep[0] = gram[0] != gram_now or around[0] != around_now
            around_now = around[-1]
            new = seq >= begin
            yield rows(REPEAT, *(x[~rep & new] for x in (gram, around, seq, pack)))
            yield rows(ENTRY, *(x[rep & new] for x in (gram, around, seq, pack)))
            gram, around, seq, pack, new = (x[rep] for x in (gram, around, seq, pack, new))
            if not len(gram):
                continue
            if gram[0] != gram_now and gram_now is not None:
                if olds == 1 and reps > 1:
                    yield one(COMPARE, old_row)
            if gram[0] != gram_now:
                olds = reps = 0
                old_row = only_row = None
            starts = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
            sizes = np.diff(np.append(starts, len(gram)))
            n_old = np.add.reduceat(~new, starts, dtype=np.int64)
            total, old_total = sizes.copy(), n_old.copy()
            total[0] += reps
            old_total[0] += olds
            of = np.repeat(np.arange(len(starts)), sizes)
            closed = of < len(starts) - 1
            # New entries are compared as soon as there is a second one; a single old one with them.
            wanted = (total[of] > 1) & (new | ((old_total[of] == 1) & closed))
            yield rows(COMPARE, *(x[wanted] for x in (gram, around, seq, pack)))
            if only_row is not None and total[0] > 1 and only_row[2] >= begin:
                yield one(COMPARE, only_row)
            if old_row is not None and len(starts) > 1 and old_total[0] == 1 and total[0] > 1:
                yield one(COMPARE, old_row)
            carried = len(starts) == 1
            gram_now, olds, reps = gram[-1], int(old_total[-1]), int(total[-1])
            tail = slice(starts[-1], None)
            old_at = np.flatnonzero(~new[tail])
            if olds == 1 and len(old_at):
                old_row = tuple(int(x[tail][old_at[0]]) for x in (gram, around, seq, pack))
            elif olds != 1 or not carried:
                old_row = None
            only_row = tuple(int(x[-1]) for x in (gram, around, seq, pack)) if reps == 1 else None
        if olds == 1 and reps > 1:
            yield one(COMPARE, old_row)

    return run


def _contexts(batches):
    """For every entry to compare: the bytes under its windows."""
    for batch in slices(batches):
        out = [[], [], [], [], []]
        for seq, text, entries in zip(batch.column("seq").to_pylist(), text_bytes(batch.column("text")), batch.column("entries").to_pylist()):
            for e in entries:
                place, first, last = _unpacked(e["pack"])
                # Windows that hold the 62 bytes from the minimizer on meet by those, the others
                # by the 39 bytes before it: rows of a frequent gram spread by what is around it.
                for side, has, key in ((0, place - last <= 38, text[place : place + 62]), (1, place - first >= 39, text[place - 39 : place + GRAM] if place >= 39 else b"")):
                    if has:
                        cell = int.from_bytes(hashlib.blake2b(key, digest_size=8, person=bytes([side])).digest(), "little", signed=True)
                        for column, value in zip(out, (cell, side, seq, e["pack"], text[first : last + LENGTH])):
                            column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int8()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())], ["cell", "side", "seq", "pack", "context"])


def _repeated_windows(cell, side, seq, pack, contexts):
    """(seq, first, last) of runs of windows that start earlier in another entry of the cell."""
    place, first, last = _unpacked(pack)
    width = GRAMS - 1 + LENGTH
    grid = np.zeros((len(seq), width), np.uint8)
    for row, (text, left) in enumerate(zip(contexts, (place - first).tolist())):
        at = GRAMS - 1 - left
        grid[row, at : at + len(text)] = np.frombuffer(text, np.uint8)
    sums = np.zeros((len(seq), width + 1), np.uint64)
    np.cumsum(_VALUES[grid] * _powers(_FACTOR, width)[None, :], axis=1, out=sums[:, 1:])
    found = [[], []]
    for left in range(GRAMS):
        start = place - left
        rows = np.flatnonzero((start >= first) & (start <= last) & ((left >= 39) == (side == 1)))
        if len(rows) < 2:
            continue
        column = GRAMS - 1 - left
        h = _mix(sums[rows, column + LENGTH] - sums[rows, column]) ^ cell[rows].view(np.uint64)
        order = np.lexsort((place[rows], seq[rows], h))
        rows, h = rows[order], h[order]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        head = rows[np.flatnonzero(new)[np.cumsum(new) - 1]]
        again = ~new & ((seq[head] != seq[rows]) | (place[head] != place[rows]))
        rows, head = rows[again], head[again]
        same = (grid[rows, column : column + LENGTH] == grid[head, column : column + LENGTH]).all(axis=1)
        found[0].append(rows[same])
        found[1].append(rows[same] * 0 + left)
    rows, left = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)
    start = place[rows] - left
    order = np.lexsort((start, rows))
    rows, start = rows[order], start[order]
    if not len(rows):
        return rows, rows, rows
    new = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (start[1:] != start[:-1] + 1))))
    return seq[rows[new]], start[new], start[np.append(new[1:], len(rows)) - 1]


def _compare(batches, limit: int = 20_000):
    """Rows in the order of the cell."""
    names = ["cell", "side", "seq", "pack", "context"]
    held = []

    def settle(rows):
        cell, side, seq, pack = (np.concatenate([b.column(k).to_numpy() for b in rows]) for k in names[:4])
        contexts = [x for b in rows for x in b.column("context").to_pylist()]
        s, a, b = _repeated_windows(cell, side, seq, pack, contexts)
        return pa.RecordBatch.from_arrays([pa.array(s.astype(np.int64)), pa.array(a.astype(np.int64)), pa.array((b + LENGTH).astype(np.int64))], ["seq", "start", "stop"])

    with np.errstate(over="ignore"):
        for batch in batches:
            for at in range(0, batch.num_rows, limit):
                part = batch.slice(at, limit)
                cells = part.column("cell").to_numpy()
                cut = int(np.searchsorted(cells, cells[-1]))
                if cut or (held and held[0].column("cell")[0].as_py() != cells[-1]):
                    yield settle([*held, part.slice(0, cut)])
                    held = []
                held.append(part.slice(cut))
        if held:
            yield settle(held)


def _explode_windows(batches):
    """Every window of a crowded cell with the digest of its bytes."""
    for batch in slices(batches):
        out = [[], [], []]
        for side, seq, pack, context in zip(*(batch.column(k).to_pylist() for k in ("side", "seq", "pack", "context"))):
            place, first, last = _unpacked(pack)
            for start in range(first, last + 1):
                if (place - start >= 39) == (side == 1):
                    out[0].append(hashlib.blake2b(context[start - first : start - first + LENGTH], digest_size=16).digest())
                    out[1].append(seq)
                    out[2].append(start)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["window", "seq", "start"])


def _shared_windows(contexts: DataFrame, crowded_rows: int) -> DataFrame:
    """Runs of bytes (seq, start, stop) that contexts of one cell repeat. A cell of more than
    crowded_rows contexts is not gathered: its windows are grouped one by one."""
    crowded = contexts.groupBy("cell").count().filter(F.col("count") > crowded_rows).select("cell", F.lit(True).alias("crowded"))
    rows = contexts.join(crowded, "cell", "left")
    usual = rows.filter("crowded IS NULL").drop("crowded").repartition("cell").sortWithinPartitions("cell")
    windows = rows.filter("crowded").drop("crowded").mapInArrow(_explode_windows, "window binary, seq long, start long")
    heads = windows.groupBy("window").agg(F.min(F.struct("seq", "start")).alias("head"))
    again = windows.join(heads, "window").filter("head.seq < seq OR head.start < start")
    return usual.mapInArrow(_compare, "seq long, start long, stop long").union(again.select("seq", "start", F.expr(f"start + {LENGTH}")))


def _finish(carried):
    def run(batches):
        for batch in slices(batches):
            out = [[], [], [], []]
            for text, spans in zip(text_bytes(batch.column("text")), batch.column("spans").to_pylist()):
                kept, runs, removed, at, reach = hashlib.sha256(), 0, 0, 0, -1
                for span in sorted((s["start"], s["stop"]) for s in spans or ()):
                    if span[0] > reach:  # neither overlaps nor touches the run before
                        runs += 1
                        kept.update(text[at : span[0]])
                    at = max(at, span[1])
                    removed += max(0, span[1] - max(span[0], reach))
                    reach = max(reach, span[1])
                kept.update(text[at:])
                for column, value in zip(out, (len(text), removed, runs, kept.hexdigest())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], [*carried, "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _sequenced(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(seq, id, text): seq is the key itself where it is an integral number, unique and never
    null; else the place in the order of key (null last) and text, written once."""
    docs = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if dict(docs.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint"):
        n, given, distinct = docs.agg(F.count("*"), F.count("id"), F.countDistinct("id")).first()
        if n == given == distinct:
            return docs.select(F.col("id").cast("long").alias("seq"), "id", "text")
    ranged = docs.repartitionByRange(F.col("id").asc_nulls_last(), "text").sortWithinPartitions(F.col("id").asc_nulls_last(), "text")
    ranged = staged(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    sizes, starts, so_far = ranged.groupBy("part").count().collect(), {}, 0  # a row for each partition
    for part, count in sorted(map(tuple, sizes)):
        starts[part], so_far = so_far, so_far + count
    offset = F.element_at(F.create_map(*(F.lit(x) for kv in starts.items() for x in kv)), F.col("part")) if starts else F.lit(0)
    return ranged.select((F.col("at") + offset).cast("long").alias("seq"), "id", "text")


class IndexFamily:
    """Levels of disjoint entries; two of equal size (in batches) merge before a new one comes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.levels = spark, []

    def entries(self) -> list[DataFrame]:
        return [level.df for _, level in self.levels]

    def make_room(self) -> None:
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            merged = a.df.union(b.df).repartition("gram").sortWithinPartitions("gram", "around")
            self.levels.append((n + m, Staged(merged, "level")))
            a.drop(), b.drop()
            release(self.spark)

    def add(self, level: DataFrame) -> None:
        self.levels.append((1, Staged(level, "level")))


def repeated_runs(docs: DataFrame, batches: int = 4, crowded_rows: int = 50_000) -> DataFrame:
    """(seq, start, stop) of byte runs of `docs(seq, text)` made of 100-byte strings that start
    earlier too, by batches of the order of seq."""
    spark = docs.sparkSession
    cuts = sorted({*(docs.agg(F.percentile_approx("seq", [k / batches for k in range(1, batches)], 1000)).first()[0] or [])}) if batches > 1 else []
    family, scans = IndexFamily(spark), []
    for n, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        part = docs
        part = part.filter(F.col("seq") > low) if low is not None else part
        part = part.filter(F.col("seq") <= high) if high is not None else part
        family.make_room()
        rows = part.mapInArrow(_sample, "gram long, around long, seq long, pack long")
        for level in family.entries():
            rows = rows.union(level)
        rows = rows.repartition("gram").sortWithinPartitions("gram", "around", "seq", "pack")
        scan = Staged(rows.mapInArrow(_merge_scan(-(1 << 63) if low is None else low + 1), "kind byte, gram long, around long, seq long, pack long"), "scan")
        if n < len(cuts):
            family.add(scan.df.filter(F.col("kind") == ENTRY).drop("kind"))
        found = Staged(scan.df.filter(F.col("kind") != ENTRY), "found")
        scan.drop()
        scans.append(found.df)
        release(spark)
    for _, level in family.levels:
        level.drop()  # no batch follows that would be scanned against them
    found = scans[0]
    for more in scans[1:]:
        found = found.union(more)
    lists = found.filter(F.col("kind") == COMPARE).groupBy("seq").agg(F.collect_list(F.struct("pack")).alias("entries"))
    with_text = docs.select("seq", "text").join(lists, "seq")
    contexts = staged(with_text.mapInArrow(_contexts, "cell long, side byte, seq long, pack long, context binary"), "contexts")
    release(spark)
    first = F.expr("shiftright(pack, 16) - (shiftright(pack, 8) & 127)")
    full = found.filter(F.col("kind") == REPEAT).select("seq", first.alias("start"), (first + F.expr("pack & 127") + LENGTH).alias("stop"))
    return full.union(_shared_windows(contexts, crowded_rows))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", batches: int = 4) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Each byte under a 100-byte string that also starts earlier is removed; runs that touch count
    as one span. Texts are UTF-8 bytes, null is empty, shorter ones than 100 bytes keep all.
    Rows that share a key are documents of their own, in the order of their texts; null keys come
    last. An empty table gives no rows; other columns are ignored.
    """
    kind = dict(docs.dtypes)[key]
    docs = _sequenced(docs, key, text)
    runs = staged(repeated_runs(docs, batches), "runs")
    release(docs.sparkSession)
    spans = runs.groupBy("seq").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    out = docs.join(spans, "seq", "left").select("id", "text", "spans")
    return out.mapInArrow(_finish(["id"]), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", key)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))

"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, staged, table, text_bytes

WINDOW, BLOCK = 10, 2
#: Bytes of benchmark text that one search holds; a larger benchmark is searched in several passes.
#: A byte of it takes about 130 bytes in each Python worker (measured), so a pass some 260 MB.
PASS_BYTES = 2 << 20
#: Every byte to itself in lower case, or to a space where it isn't part of a word.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class WuManber:
    """Finds sequences of words. Patterns are searched by length, so the shift of a long one is
    not held back by a short one: `shift` says how far a pair of words lets the search move,
    `ends` has the patterns that end in it, by their hash, so that of many patterns with one
    ending only those are compared word by word whose hash is that of the place."""

    def __init__(self, patterns: dict[tuple[bytes, ...], tuple[str, ...]]):
        by_length = defaultdict(dict)
        for words, items in patterns.items():
            by_length[len(words)][words] = items
        self.classes = []
        for length, group in sorted(by_length.items()):
            block = min(BLOCK, length)
            shift, ends = {}, defaultdict(dict)
            for words, items in group.items():
                for at in range(block, length + 1):
                    pair = words[at - block : at]
                    shift[pair] = min(shift.get(pair, length), length - at)
                ends[words[-block:]][words] = items
            self.classes.append((length, block, length - block + 1, shift, dict(ends)))

    def search(self, words: list[bytes]) -> list[tuple[int, int, tuple[str, ...]]]:
        """(start, end, items) of every occurrence."""
        found = []
        for length, block, furthest, shift, ends in self.classes:
            at, n = length, len(words)
            while at <= n:
                pair = tuple(words[at - block : at])
                step = shift.get(pair, furthest)
                if step:
                    at += step
                    continue
                items = ends[pair].get(tuple(words[at - length : at]))
                if items is not None:
                    found.append((at - length, at, items))
                at += 1
        return found


def item_windows(items: list[tuple[object, str | None]]) -> dict[tuple[bytes, ...], tuple[str, ...]]:
    windows = defaultdict(set)
    for item, text in items:
        words = words_of((text or "").encode())
        for at in range(max(1, len(words) - WINDOW + 1)) if words else ():
            windows[tuple(words[at : at + WINDOW])].add("" if item is None else str(item))
    return {w: tuple(sorted(x)) for w, x in windows.items()}


def _passes(benchmark: DataFrame, item: str, text: str, pass_bytes: int) -> list[DataFrame]:
    """The benchmark in parts of about pass_bytes, each a proven bound on what a search holds."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    parts = -(-size // pass_bytes) if size else 0
    part = F.pmod(F.xxhash64(F.col(item).cast("string"), text), F.lit(max(parts, 1)))
    return [benchmark.filter(part == k).select(item, text) for k in range(parts)]


def _found(finder: WuManber, words: list[bytes]) -> tuple[list[int], list[str]]:
    """Starts and ends of the occurrences, one after the other, and the items they belong to."""
    found = finder.search(words)
    return [x for a, b, _ in found for x in (a, b)], sorted({i for _, _, ids in found for i in ids})


def _told(words: list[bytes], spans: list[int], items: list[str]) -> tuple[int, int, int, str]:
    hit, reach = 0, 0
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        hit, reach = hit + max(0, b - max(a, reach)), max(reach, b)
    return len(words), hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest()


def _result(carried, batch, told):
    cols = [list(x) for x in zip(*told)] or [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *(pa.array(c, k) for c, k in zip(cols, kinds))], [*carried, "n_words", "n_hit", "n_items", "items_sha256"])


def _search_once(patterns, carried):
    """A benchmark that one search holds: found and counted in the same pass."""

    def run(batches):
        finder = WuManber(patterns)
        for batch in slices(batches):
            words = map(words_of, text_bytes(batch.column("_text")))
            yield _result(carried, batch, [_told(w, *_found(finder, w)) for w in words])

    return run


def _search_part(patterns):
    """Row, spans and items of the documents where this part of the benchmark occurs."""

    def run(batches):
        finder = WuManber(patterns)
        for batch in slices(batches):
            out = [(row, *_found(finder, words_of(t))) for row, t in zip(batch.column("_row").to_pylist(), text_bytes(batch.column("_text")))]
            rows, spans, items = [list(x) for x in zip(*(o for o in out if o[1]))] or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["_row", "spans", "items"])

    return run


def _count_parts(carried):
    def run(batches):
        for batch in slices(batches):
            told = [
                _told(words_of(t), [x for part in s or () for x in part], sorted({i for part in ids or () for i in part}))
                for t, s, ids in zip(text_bytes(batch.column("_text")), batch.column("spans").to_pylist(), batch.column("items").to_pylist())
            ]
            yield _result(carried, batch, told)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """`keep` columns of every document with n_words, n_hit, n_items, items_sha256, contaminated.

    A null document text has no words; an item without words is no pattern; items of equal text
    all count; a null item id counts as ''. The digest of no items is that of the empty string.
    The benchmark is held in memory in parts of pass_bytes. More than one part: the documents are
    written once with a row number, each part is searched in a map over them that leaves the row,
    spans and items of hits alone, and a last map counts what all parts found.
    """
    parts = _passes(benchmark, item, text, pass_bytes)
    fields = {f.name: f for f in docs.schema.fields}
    carried = [f"_k{i}" for i in range(len(keep))]
    names = ", ".join(f"{c} {fields[k].dataType.simpleString()}" for c, k in zip(carried, keep))
    schema = f"{names}, n_words long, n_hit long, n_items long, items_sha256 string"
    at = docs.select(*(F.col(k).alias(c) for c, k in zip(carried, keep)), F.col(text).alias("_text"))
    patterns = (item_windows([tuple(r) for r in part.toLocalIterator()]) for part in parts)
    if len(parts) <= 1:
        at = at.mapInArrow(_search_once(next(patterns, {}), carried), schema)
    else:
        at = staged(at.withColumn("_row", F.monotonically_increasing_id()), "documents")
        hits = [staged(at.select("_row", "_text").mapInArrow(_search_part(p), "_row long, spans array<int>, items array<string>"), "hits") for p in patterns]
        every = hits[0]
        for more in hits[1:]:
            every = every.union(more)
        lists = every.groupBy("_row").agg(F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
        at = at.join(lists, "_row", "left").drop("_row").mapInArrow(_count_parts(carried), schema)
    return at.select(*(F.col(c).alias(k) for c, k in zip(carried, keep)), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])

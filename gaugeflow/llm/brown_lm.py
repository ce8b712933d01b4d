"""Language-model scoring with Brown's class-based bigrams and exchange clustering.

Every word of the training part is assigned to a class by exchange. The class that stands before a
word, its context class, is the word's own class for frequent words and that of the ending for all
others, so that a text's context classes are known where the text is:
P(word | word before) = P(class of word | context class of word before) * P(word | class of word).
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from itertools import count, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staged, in_split, release, slices, staged, table, text_bytes

#: The end of a text, a token no word can equal.
END = b""
#: Words of at least one token in HEAD_SHARE (so that many at most) are sent to every task.
HEAD_SHARE = 1 << 20
#: The exchange starts on the driver, with the most frequent words and with groups of endings as
#: units; then ROUNDS rounds on Spark move every frequent word by its own contexts, and
#: at last every other word of the vocabulary is put where its contexts fit best.
SINGLE, ENDINGS, CLASSES, ROUNDS = 1000, 256, 40, 2
SMOOTH, LINK_SMOOTH = 0.5, 0.1


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def ending(word: bytes) -> int:
    """The group of a word's last two bytes (the end of a text has its own unit)."""
    return zlib.crc32(word[-2:]) % ENDINGS


def _count(batches):
    """(word, count), summed over as much of the task as some memory allows."""
    counts = Counter()

    def rows():
        words = list(counts)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    for batch in slices(batches):
        for text in text_bytes(batch.column("text")):
            counts.update(text.lower().split())
            counts[END] += 1
        if len(counts) > 1_000_000:
            yield rows()
            counts.clear()
    if counts:
        yield rows()


def _pairs(unit_of: dict[bytes, int], units: int):
    """Counts of adjacent units; every text starts after an end."""

    def run(batches):
        group, total = _Tails(), np.zeros(units * units, np.int64)
        get, singles = unit_of.get, len(unit_of)
        for batch in slices(batches):
            line = [unit_of[END]]
            for text in text_bytes(batch.column("text")):
                line += [u if (u := get(w)) is not None else singles + group[w[-2:]] for w in tokens(text)]
            at = np.array(line, np.int64)
            total += np.bincount(at[:-1] * units + at[1:], minlength=units * units)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["pair", "n"])

    return run


def exchange(pairs: np.ndarray, classes: int, rounds: int = 10) -> np.ndarray:
    """Classes of units from their bigram counts: each unit in turn moves to the class that gives
    the class bigram model the greatest likelihood, until none moves."""

    def f(x):
        return x * np.log(np.maximum(x, 1.0))

    units = len(pairs)
    weight = pairs.sum(axis=0)
    order = np.argsort(-weight, kind="stable")
    of = np.zeros(units, np.int64)
    of[order] = np.arange(units) % classes
    member = np.zeros((units, classes))
    member[np.arange(units), of] = 1
    after, before = pairs @ member, pairs.T @ member  # counts of the classes that follow, precede
    links = member.T @ after
    left, right = links.sum(axis=1), links.sum(axis=0)
    out, into, own = pairs.sum(axis=1), weight, np.diag(pairs)
    for _ in range(rounds):
        moved = 0
        for u in order:
            if not out[u] and not into[u]:
                continue
            a, r, c = of[u], after[u].copy(), before[u].copy()
            r[a], c[a] = r[a] - own[u], c[a] - own[u]
            links[a] -= r
            links[:, a] -= c
            links[a, a] -= own[u]
            left[a], right[a] = left[a] - out[u], right[a] - into[u]
            rows = f(links + r) - f(links)
            columns = f(links + c[:, None]) - f(links)
            d = np.arange(classes)
            both = f(links[d, d] + r + c + own[u]) - f(links[d, d])
            gain = rows.sum(axis=1) - rows[d, d] + columns.sum(axis=0) - columns[d, d] + both
            gain -= f(left + out[u]) - f(left) + f(right + into[u]) - f(right)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            links[b] += r
            links[:, b] += c
            links[b, b] += own[u]
            left[b], right[b] = left[b] + out[u], right[b] + into[u]
            if b != a:
                of[u], moved = b, moved + 1
                after[:, a] -= pairs[:, u]
                after[:, b] += pairs[:, u]
                before[:, a] -= pairs[u]
                before[:, b] += pairs[u]
        if not moved:
            break
    return of


class _Tails(dict):
    """Group of a word by its last two bytes."""

    def __missing__(self, tail):
        self[tail] = zlib.crc32(tail) % ENDINGS
        return self[tail]


class _Ids:
    """Numbers of a task's words, in the order in which they turn up; per number the class in
    class_of (-1 if it has none there), the group of the ending, and the context class."""

    def __init__(self, class_of: dict[bytes, int], of_ending: np.ndarray):
        self.numbers, self.words = defaultdict(count().__next__), []
        self.class_of, self.of_ending, self.tails = class_of, of_ending.astype(np.int32), _Tails()
        self.known = self.ending = self.context = np.zeros(0, np.int32)

    def __len__(self):
        return len(self.words)

    def read(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all tokens of the texts: number, own class, context class of the token before; and
        where the texts begin. An end stands before every text."""
        number, ids, starts = self.numbers.__getitem__, [], []
        end = number(END)
        for text in texts:
            starts.append(len(ids))
            ids.extend(map(number, text.lower().split()))
            ids.append(end)
        new = list(islice(self.numbers, len(self.words), None))
        known = np.fromiter(map(self.class_of.get, new, repeat(-1)), np.int32, len(new))
        ending = np.fromiter(map(self.tails.__getitem__, [w[-2:] for w in new]), np.int32, len(new))
        self.words += new
        self.known, self.ending = np.append(self.known, known), np.append(self.ending, ending)
        self.context = np.append(self.context, np.where(known >= 0, known, self.of_ending[ending]))
        ids = np.array(ids, np.int64)
        return ids, self.known[ids], self.context[np.concatenate(([end], ids[:-1]))], np.array(starts, np.int64)


#: A task's word numbers start anew beyond so many words.
MOST_IDS = 1_000_000


def _contexts(class_of: dict[bytes, int], of_ending: np.ndarray, every: bool):
    """(word, before, n): how often a word follows a context class, per task; of the words of
    class_of alone, or of every word."""

    def run(batches):
        numbers, waiting, size = _Ids(class_of, of_ending), [], 0

        def rows():
            keys, at = np.unique(np.concatenate([k for k, _ in waiting]), return_inverse=True)
            n = np.bincount(at, np.concatenate([x for _, x in waiting]), len(keys)).astype(np.int64)
            words = pa.array(numbers.words, pa.binary()).take(pa.array(keys // CLASSES))
            return pa.RecordBatch.from_arrays([words, pa.array((keys % CLASSES).astype(np.int32)), pa.array(n)], ["word", "before", "n"])

        for batch in slices(batches):
            ids, known, before, _ = numbers.read(text_bytes(batch.column("text")))
            keys = ids * CLASSES + before
            keys, n = np.unique(keys if every else keys[known >= 0], return_counts=True)
            waiting.append((keys, n))
            size += len(keys)
            if size > 4_000_000 or len(numbers) > MOST_IDS:
                yield rows()
                numbers, waiting, size = _Ids(class_of, of_ending), [], 0
        if waiting:
            yield rows()

    return run


def _gathered(batches):
    """Rows sorted by word: (word, n, contexts), the counts after each context class."""
    last, carried = None, None

    def rows(words, table):
        offsets = pa.array(np.arange(len(words) + 1, dtype=np.int32) * CLASSES)
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(table.sum(axis=1)), pa.ListArray.from_arrays(offsets, pa.array(table.ravel()))], ["word", "n", "contexts"])

    for batch in batches:
        if not batch.num_rows:
            continue
        column, new = batch.column("word"), np.ones(batch.num_rows, bool)
        new[1:] = pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        words = column.filter(pa.array(new)).to_pylist()
        table = np.zeros((len(words), CLASSES), np.int64)
        np.add.at(table, (np.cumsum(new) - 1, batch.column("before").to_numpy()), batch.column("n").to_numpy())
        if words[0] == last:
            table[0] += carried
        elif last is not None:
            yield rows([last], carried[None])
        yield rows(words[:-1], table[:-1])
        last, carried = words[-1], table[-1]
    if last is not None:
        yield rows([last], carried[None])


def best_classes(contexts: np.ndarray, of: np.ndarray, links: np.ndarray) -> np.ndarray:
    """One round of exchange for words given by their counts after each context class (rows) and
    by their class `of` (-1: none yet): each is taken out of its class and put where the likelihood
    of the class model grows most, against the same class table for all."""

    def f(x):
        return x * np.log(np.maximum(x, 1.0))

    word, before = np.nonzero(contexts)
    times, n = contexts[word, before], contexts.sum(axis=1)
    gain = np.empty((len(of), links.shape[1]))
    for c in range(links.shape[1]):
        # The class without the word.
        rest = links[before, c] - np.where(of[word] == c, times, 0)
        size = links[:, c].sum() - np.where(of == c, n, 0)
        gain[:, c] = np.bincount(word, f(rest + times) - f(rest), len(of)) - f(size + n) + f(size)
    gain = np.round(gain, 6)  # so that ties, which the order of sums would break, go to the first class
    stay = np.where(of >= 0, gain[np.arange(len(of)), np.maximum(of, 0)], -np.inf)
    best = np.argmax(gain, axis=1)
    return np.where(gain[np.arange(len(of)), best] > stay, best, of)


def _classed(class_of: dict[bytes, int], links: np.ndarray | None, moving: bool):
    """Adds the class of each word: the one of class_of, moved where `moving`; words that have none
    there get the best one."""

    def run(batches):
        for batch in slices(batches):
            words = batch.column("word").to_pylist()
            of = np.array([class_of.get(w, -1) for w in words], np.int64)
            if links is not None and len(words):
                table = batch.column("contexts").flatten().to_numpy().astype(float).reshape(-1, CLASSES)
                of = best_classes(table, of, links) if moving else np.where(of >= 0, of, best_classes(table, of, links))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int32())], [*batch.schema.names, "class"])

    return run


CLASSED = "word binary, n long, contexts array<long>, class int"


def _links(classed: DataFrame) -> np.ndarray:
    """Context class x class: the counts of the words of each class, CLASSES rows at most."""
    sums = classed.filter("class >= 0").groupBy("class").agg(*(F.sum(F.col("contexts")[c]).alias(f"c{c}") for c in range(CLASSES))).collect()
    links = np.zeros((CLASSES, CLASSES))
    for r in sums:
        links[:, r[0]] = r[1:]
    return links


def _score(model):
    """Sums over what every task has: frequent words and their classes. Other words leave with
    their counts by context class; what they add to the sums is looked up in the word table."""
    head, class_of, of_ending, link, base_norm = model

    def run(batches):
        own = {w: c for w, c in class_of.items() if w in head}
        numbers, log_of = None, np.zeros(0)
        for batch in slices(batches):
            if numbers is None or len(numbers) > MOST_IDS:
                numbers, log_of = _Ids(own, of_ending), np.zeros(0)
            texts = text_bytes(batch.column("text"))
            ids, of, before, starts = numbers.read(texts)
            log_of = np.append(log_of, np.log10(np.array([head.get(w, 0) for w in numbers.words[len(log_of) :]]) + SMOOTH))
            common = of >= 0
            logs = np.where(common, log_of[ids], 0.0)
            steps = np.where(common, link[before, of], 0.0)
            sizes = np.diff(np.append(starts, len(ids)))
            some, base, model_sum = (np.add.reduceat(x, starts) if len(starts) else np.zeros(0) for x in (common.astype(np.int64), logs, logs + steps))
            # What is left, in the order of (text, word): a list of words a text, of classes a word.
            rest = np.flatnonzero(~common)
            doc = np.repeat(np.arange(len(starts)), sizes)[rest]
            order = np.lexsort((before[rest], ids[rest], doc))
            doc, word, before = doc[order], ids[rest][order], before[rest][order]
            new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])))) if len(doc) else np.zeros(0, np.int64)
            after = pa.ListArray.from_arrays(pa.array(np.append(new, len(doc)).astype(np.int32)), pa.array(before.astype(np.int8)))
            rare = [numbers.words[i] for i in word[new].tolist()]
            fields = [pa.array(rare, pa.binary()), pa.array(numbers.ending[word[new]], pa.int32()), after]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[new], np.arange(len(starts) + 1)).astype(np.int32)), pa.StructArray.from_arrays(fields, ["word", "ending", "after"]))
            columns = {"n_tokens": pa.array(sizes), "common": pa.array(some, pa.int64()), "base": pa.array(base - base_norm * sizes), "model": pa.array(model_sum), "rare": lists}
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), *columns.values()], ["id", "held_out", *columns])

    return run


def lm_scores(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 5, held: int = 1) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    Learns from the documents whose crc32(key) mod `modulus` is not `held` (a null key counts as
    ''). P(class | context class) and P(word | class) are each smoothed by addition, where a class
    keeps the mass of one more word for all unseen ones, as base_score does for the whole
    vocabulary; an unseen word has the class of its ending. Null is an empty text of one token,
    the end; every text starts after an end. Repeated rows are scored, and counted, each. An empty
    table gives no rows.

    Counts, contexts and classes cover every word of the training part. The driver gets the words
    of one token in HEAD_SHARE or more, and the bigrams of SINGLE + ENDINGS + 1 units that the
    exchange starts from; all other words meet their counts and classes in a join, where by
    their rarity no key is hot.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[key]
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), in_split(key, modulus, held).alias("held_out"))
    training = docs.filter("NOT held_out").select("text")
    counted = training.mapInArrow(_count, "word binary, n long")
    words = Staged(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    release(spark)
    total, known = words.df.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # END isn't a word but counts as one token of the vocabulary.
    head = {bytes(r[0]): r[1] for r in words.df.filter(F.col("n") * HEAD_SHARE >= total).toLocalIterator()}
    words.drop()
    single = sorted((w for w in head if w != END), key=lambda w: (-head[w], w))[:SINGLE]
    unit_of = {w: i for i, w in enumerate([END, *single])}
    units = len(unit_of) + ENDINGS

    pairs = np.zeros(units * units)
    counts = training.mapInArrow(_pairs(unit_of, units), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    pairs[counts.column("pair").to_numpy()] = counts.column("n").to_numpy()
    of_unit = exchange(pairs.reshape(units, units), CLASSES)
    of_ending = of_unit[len(unit_of) :]
    class_of = {w: int(of_unit[unit_of[w]] if w in unit_of else of_ending[ending(w)]) for w in {END, *head}}
    for last in [False] * ROUNDS + [True]:
        seen = training.mapInArrow(_contexts(class_of, of_ending, last), "word binary, before int, n long")
        seen = Staged(seen.repartition("word").sortWithinPartitions("word").mapInArrow(_gathered, "word binary, n long, contexts array<long>"), "contexts")
        release(spark)
        links = _links(seen.df.mapInArrow(_classed(class_of, None, False), CLASSED))
        moved = seen.df.mapInArrow(_classed(class_of, links, not last), CLASSED)
        if last:
            classed = staged(moved, "classes")
        else:
            class_of |= {bytes(r[0]): r[1] for r in moved.select("word", "class").toLocalIterator()}
        seen.drop()
    links = _links(classed)
    kinds = np.zeros(CLASSES)
    for c, n in classed.groupBy("class").count().collect():  # CLASSES rows at most
        kinds[c] = n
    emit_norm = np.log10(links.sum(axis=0) + SMOOTH * (kinds + 1))
    link = np.log10((links + LINK_SMOOTH) / (links.sum(axis=1, keepdims=True) + LINK_SMOOTH * CLASSES)) - emit_norm[None]
    base_norm = float(np.log10(total + SMOOTH * (known + 1)))

    schema = f"id {kind}, held_out boolean, n_tokens long, common long, base double, model double, rare array<struct<word:binary,ending:int,after:array<byte>>>"
    local = docs.mapInArrow(_score((head, class_of, of_ending, link, base_norm)), schema)
    local = staged(local.withColumn("row", F.monotonically_increasing_id()), "local")
    rare = local.select("row", F.explode("rare").alias("w")).select("row", "w.word", "w.ending", "w.after")
    found = rare.join(classed.filter(F.col("n") * HEAD_SHARE < total).select("word", "n", "class"), "word", "left")
    times, count = F.size("after"), F.coalesce("n", F.lit(0))
    of = F.coalesce("class", F.element_at(F.lit(of_ending.tolist()), F.col("ending") + 1)).cast("int")
    steps = F.aggregate("after", F.lit(0.0), lambda a, c: a + F.element_at(F.lit(link.ravel().tolist()), c * CLASSES + F.col("of") + 1))
    found = found.withColumn("of", of).withColumn("logs", times * F.log10(count + SMOOTH))
    sums = found.groupBy("row").agg(F.sum("logs").alias("rest"), F.sum(steps).alias("steps"), F.sum(F.when(F.col("n") > 0, times).otherwise(0)).alias("also_known"))
    rest = F.coalesce("rest", F.lit(0.0))
    return local.join(sums, "row", "left").select(
        F.col("id").alias(key), "held_out", "n_tokens",
        (F.col("common") + F.coalesce("also_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + rest).alias("base_score"),
        (F.col("model") + rest + F.coalesce("steps", F.lit(0.0))).alias("score"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))

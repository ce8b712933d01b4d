"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network,
probabilities calibrated by a temperature."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staged, in_split, release, slices, table, text_bytes

#: Word vectors: words of at least one piece in HEAD_SHARE (so that many at most) have a row of
#: their own, all others share BUCKETS rows by hash; an index vector has NONZERO entries of +-1.
HEAD_SHARE, BUCKETS, DIMS, NONZERO, REACH = 1 << 19, 1 << 14, 32, 4, 2
#: The network learns from so many labelled rows at most, taken in the order of a hash.
SAMPLE_ROWS, HIDDEN, EPOCHS = 8000, 32, 400
THRESHOLD = 0.7
#: Runs of letters and digits, and runs of other signs; white space separates.
PIECES = re.compile(rb"[a-z0-9\x80-\xff]+|[^\sa-z0-9\x80-\xff]+")


class _Buckets(dict):
    """Row of a piece; forgets all when it holds too many."""

    def __init__(self, own: dict[bytes, int]):
        self.own = own

    def __missing__(self, piece):
        if len(self) > 500_000:
            self.clear()
        row = self.own.get(piece)
        self[piece] = row = len(self.own) + zlib.crc32(piece) % BUCKETS if row is None else row
        return row


def _count(batches):
    """(piece, n), summed over as much of the task as some memory allows."""
    counts = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(counts.values(), pa.int64())], ["piece", "n"])

    for batch in slices(batches):
        for text in text_bytes(batch.column("text")):
            counts.update(PIECES.findall(text.lower()))
        if len(counts) > 1_000_000:
            yield rows()
            counts.clear()
    if counts:
        yield rows()


def frequent_words(docs: DataFrame, text: str = "text") -> dict[bytes, int]:
    """Rows of the words of one piece in HEAD_SHARE or more, counted over all documents."""
    counts = Staged(docs.select(F.col(text).alias("text")).mapInArrow(_count, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n")), "pieces")
    total = counts.df.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = sorted(bytes(r[0]) for r in counts.df.filter(F.col("n") * HEAD_SHARE >= total).select("piece").toLocalIterator())
    counts.drop()
    return {w: i for i, w in enumerate(words)}


def _bucketed(texts, cache, most: int = 200_000):
    """(buckets, starts of the documents' parts, documents) in runs of about `most` pieces; a
    long document is cut into parts, each with the last piece of the part before."""
    ids, starts, docs, n = [], [], [], 0
    for doc, text in enumerate(texts):
        found = PIECES.findall(text.lower())
        rows = np.fromiter(map(cache.__getitem__, found), np.int64, len(found))
        for at in range(0, len(rows), most):
            ids.append(rows[max(0, at - 1) : at + most])
            starts.append(n)
            docs.append((doc, at > 0))
            n += len(ids[-1])
            if n >= most:
                yield np.concatenate(ids), np.array(starts), docs
                ids, starts, docs, n = [], [], [], 0
    if ids:
        yield np.concatenate(ids), np.array(starts), docs


def index_vectors(rows: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each row's index vector."""
    draw = np.random.default_rng(seed)
    places = np.argsort(draw.random((rows, DIMS), np.float32), axis=1)[:, :NONZERO]
    return places.astype(np.int64), draw.choice([-1.0, 1.0], (rows, NONZERO))


def _contexts(own):
    return lambda batches: _context_sums(batches, own)


def _neighbours(ids, starts, index):
    """Per piece the sum of the index vectors of the pieces within REACH in its part; small integers."""
    part = np.zeros(len(ids), np.int32)
    part[starts[1:]] = 1
    part = np.cumsum(part)
    own = index[ids]
    near = np.zeros_like(own)
    for gap in range(1, REACH + 1):
        before, after = own[:-gap].copy(), own[gap:].copy()
        other = np.flatnonzero(part[gap:] != part[:-gap])
        before[other] = after[other] = 0
        near[gap:] += before
        near[:-gap] += after
    return near


def _context_sums(batches, own):
    """Sums of the index vectors of each row's neighbours, over the whole task."""
    size = len(own) + BUCKETS
    places, signs = index_vectors(size)
    index = np.zeros((size, DIMS), np.int8)
    np.put_along_axis(index, places, signs.astype(np.int8), axis=1)
    sums, cache = np.zeros((size, DIMS)), _Buckets(own)
    for batch in slices(batches):
        for ids, starts, _ in _bucketed(text_bytes(batch.column("text")), cache):
            order = np.argsort(ids, kind="stable")
            word = ids[order]
            at = np.flatnonzero(np.diff(word, prepend=-1))
            sums[word[at]] += np.add.reduceat(_neighbours(ids, starts, index)[order], at, axis=0, dtype=np.int32)
    used = np.flatnonzero(np.abs(sums).sum(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(sums[used, d]) for d in range(DIMS))], ["bucket", *(f"v{d}" for d in range(DIMS))])


def word_vectors(docs: DataFrame, own: dict[bytes, int], text: str = "text") -> np.ndarray:
    """DIMS-dimensional unit vectors learned from all documents: of the words in `own`, then of the
    buckets."""
    size = len(own) + BUCKETS
    sums = docs.select(F.col(text).alias("text")).mapInArrow(_contexts(own), "bucket long, " + ", ".join(f"v{d} double" for d in range(DIMS)))
    rows = sums.groupBy("bucket").agg(*(F.sum(f"v{d}").alias(f"v{d}") for d in range(DIMS))).toArrow()
    vectors = np.zeros((size, DIMS), np.float32)
    if rows.num_rows:
        vectors[rows.column("bucket").to_numpy()] = np.stack([rows.column(f"v{d}").to_numpy() for d in range(DIMS)], axis=1)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.maximum(norms, 1e-9)


def pooled(texts: list[bytes], vectors: np.ndarray, cache) -> np.ndarray:
    """Per document the mean word vector and the mean absolute step between adjacent words."""
    sums, steps = np.zeros((len(texts), DIMS)), np.zeros((len(texts), DIMS))
    n, pairs = np.zeros(len(texts)), np.zeros(len(texts))
    for ids, starts, docs in _bucketed(texts, cache):
        for (doc, continued), start, end in zip(docs, starts.tolist(), [*starts[1:].tolist(), len(ids)]):
            near = vectors.take(ids[start:end], axis=0)  # of one part, so that it stays in the processor's cache
            sums[doc] += near[int(continued) :].sum(axis=0)
            change = near[1:] - near[:-1]
            steps[doc] += np.abs(change, out=change).sum(axis=0)
            n[doc] += end - start - continued
            pairs[doc] += end - start - 1
    return np.hstack([sums / np.maximum(n, 1)[:, None], steps / np.maximum(pairs, 1)[:, None]])


class Network:
    """Two layers, trained by Adam on the whole sample; `temperature` divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5):
        self.mean, self.scale, self.temperature, self.constant = 0.0, 1.0, 1.0, None
        if len(y) == 0 or y.min() == y.max():
            # One label, or none, teaches nothing but its share.
            self.constant = float((y.sum() + 0.5) / (len(y) + 1))
            return
        draw = np.random.default_rng(seed)
        tune = np.arange(len(y)) % 5 == 0
        if y[tune].min() == y[tune].max():
            tune[:] = True
        learn = ~tune if not tune.all() else tune
        self.mean, self.scale = x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-6
        w = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.weights = w
        m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
        z, target = (x[learn] - self.mean) / self.scale, y[learn]
        for step in range(1, EPOCHS + 1):
            hidden = np.tanh(z @ w[0] + w[1])
            wrong = (1 / (1 + np.exp(-np.clip(hidden @ w[2] + w[3][0], -30, 30))) - target) / len(target)
            back = np.outer(wrong, w[2]) * (1 - hidden**2)
            slopes = [z.T @ back + 1e-4 * w[0], back.sum(axis=0), hidden.T @ wrong + 1e-4 * w[2], np.array([wrong.sum()])]
            for k, g in enumerate(slopes):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                w[k] -= 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        # The temperature that makes the rows kept apart likeliest.
        logit, label = self.logits(x[tune]), y[tune]
        losses = [(np.logaddexp(0, -np.where(label == 1, 1, -1) * logit / t).mean(), t) for t in np.geomspace(0.25, 8, 61)]
        self.temperature = min(losses)[1]

    def logits(self, x):
        z = (x - self.mean) / self.scale
        return np.tanh(z @ self.weights[0] + self.weights[1]) @ self.weights[2] + self.weights[3][0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def _features(vectors, own):
    def run(batches):
        cache = _Buckets(own)
        for batch in slices(batches):
            x = pooled(text_bytes(batch.column("text")), vectors, cache)
            yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], ["draw", "label", "x"])

    return run


def _scores(vectors, own, network):
    def run(batches):
        cache = _Buckets(own)
        for batch in slices(batches):
            score = network.scores(pooled(text_bytes(batch.column("_text")), vectors, cache))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    return run


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, own: dict[bytes, int], key: str, text: str, label: str, modulus: int, held: int) -> Network:
    """Learns from SAMPLE_ROWS labelled rows at most, none of them in the held-out part; of
    documents that share a key, from the one with the least hash."""
    rows = labels.filter(~in_split(key, modulus, held) & F.col(label).isin(0, 1)).select(key, F.col(label).cast("long").alias("label"))
    draw = F.xxhash64(F.col(key))
    rows = rows.withColumn("draw", draw).orderBy("draw", "label").limit(SAMPLE_ROWS)
    sample = docs.select(key, F.col(text).alias("text")).join(F.broadcast(rows), key).select("draw", "label", F.struct(F.xxhash64("text").alias("hash"), "text").alias("t"))
    sample = sample.groupBy("draw", "label").agg(F.min("t").alias("t")).select("draw", "label", "t.text")
    got = sample.mapInArrow(_features(vectors, own), "draw long, label long, x array<double>").orderBy("draw", "label").toArrow()
    return Network(pc.list_flatten(got.column("x")).to_numpy().reshape(len(got), 2 * DIMS), got.column("label").to_numpy().astype(float))


def quality_scores(docs: DataFrame, labels: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", label: str = "quality", modulus: int = 4, held: int = 2) -> DataFrame:
    """`keep` columns with held_out, score and predicted (1 from a score of THRESHOLD) of every document.

    Word vectors are learned from all texts, the network from labelled rows outside the held-out
    part. A label other than 0 or 1 is ignored; without both labels every score is the share of
    ones. Null is an empty text, whose vector is zero. A null key has no label; rows that share a
    key share its label. An empty table gives no rows.
    """
    own = frequent_words(docs, text)
    release(docs.sparkSession)
    vectors = word_vectors(docs, own, text)
    network = train(docs, labels, vectors, own, key, text, label, modulus, held)
    release(docs.sparkSession)
    kinds = dict(docs.dtypes)
    names = [f"_k{i}" for i in range(len(keep))]
    at = docs.select(*(F.col(k).alias(n) for k, n in zip(keep, names)), in_split(key, modulus, held).alias("_held"), F.col(text).alias("_text"))
    schema = ", ".join([*(f"{n} {kinds[k]}" for k, n in zip(keep, names)), "_held boolean, _text string, score double"])
    out = at.mapInArrow(_scores(vectors, own, network), schema)
    return out.select(*(F.col(n).alias(k) for k, n in zip(keep, names)), F.col("_held").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm.common import staged
from gaugeflow.llm import brown_lm, decontaminate, exact_dedup, graph, html_text, mixing, quality, secrets, sharding, simhash, suffix_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, cell int"
LONG = " ".join(f"word{i * 7919 % 10007}" for i in range(4000))
TEXTS = [None, "", "   \t\n", "a", "A b c d", LONG, LONG, LONG + " tail", LONG[:900] + " changed " + LONG[900:],
         'x password="abcdef12" user: bob AKIA' + "Z" * 16 + " token: token: abcdefgh " + "0a" * 20, "secret=ab mail me@host.example pwd: hunter22 https://h.example:80/x",
         "é" * 300, "ab" * 400, "of of of of of", LONG.replace(" ", "\n"), LONG[200:700] + LONG[100:450]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, (None, "null id", None, None, 1, "x", 1), (3, "a", "en", "s", 1, "x", 1)], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_jump_hash_and_growth():
    def plain(key, n):
        b, j = -1, 0
        while j < n:
            b, key = j, (key * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return b

    keys = np.array([0, 1, 5, 2**63, 2**64 - 1, *range(100, 400)], np.uint64)
    for n in (1, 7, 40):
        shard, grown = sharding.jump_hash(keys, n)
        assert shard.tolist() == [plain(int(k), n) for k in keys]
        assert grown.tolist() == [plain(int(k), n + 1) for k in keys]


def test_slots_are_gapless(docs, real):
    for df, chunk in ((docs, 1), (real, 3)):
        out = sharding.shard_rows(df.select("doc_id", "text"), "doc_id", 5, ["text"], chunk_rows=chunk).toPandas()
        assert len(out) == df.count()
        assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_exact_dedup(docs):
    out = exact_dedup.exact_dedup(docs).toPandas()
    assert len(out) == docs.count() and out.kept.sum() == len({"".join((t or "").split(" ")).translate({9: None, 10: None}) for t in TEXTS} | {"nullid"})
    assert out[out.doc_id == 14].keep_id.item() == 5 and out[out.doc_id == 3].kept.sum() == 1
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_exact_dedup_beyond_the_broadcast(docs, monkeypatch):
    want = sorted(map(str, exact_dedup.exact_dedup(docs).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_HASHES", 0)
    assert sorted(map(str, exact_dedup.exact_dedup(docs).collect())) == want


@pytest.mark.parametrize("op,sql,key", [(exact_dedup.exact_dedup, exact_dedup.SQL, "doc_id"), (secrets.scan_secrets, secrets.SQL, "doc_id")])
def test_sql_agrees_on_edge_cases(docs, op, sql, key):
    con = duckdb.connect()
    documents = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    con.register("documents", documents.toPandas().assign(doc_id=lambda d: d.doc_id.astype("int64")))
    got, want = op(documents).toPandas(), con.sql(sql).df()
    a, b = (sorted(map(tuple, x[sorted(got.columns)].astype(str).values.tolist())) for x in (got, want))
    assert a == b


def test_weak_secrets_need_company(spark):
    rows = spark.createDataFrame([(1, "pwd: hunter22"), (2, "pwd: hunter22 login: bob"), (3, "pwd: hunter22" + " x" * 300 + " login: bob"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.spans for r in secrets.scan_secrets(rows).collect()} == {1: "", 2: "phrase:0:13,account:14:24", 3: "", 4: ""}


def simple_fp(text):
    import xxhash

    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(docs):
    for r in simhash.near_duplicates(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r.fp % 2**64 == simple_fp(r.text)
    out = simhash.near_duplicates(docs).toPandas()
    assert len(out) == docs.count() and out[out.doc_id.isin([5, 6, 7, 8, 14])].component_id.nunique() == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_every_pair_at_two_bits_shares_an_anchor():
    code, draw = simhash.covering(), np.random.default_rng(1)
    words = draw.integers(0, 1 << 48, 3000, dtype=np.uint64)
    words[:2] = 0, (1 << 48) - 1
    others = words ^ (np.uint64(1) << draw.integers(0, 48, len(words)).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 48, len(words)).astype(np.uint64))
    (i, a), (j, b) = code.anchors(words), code.anchors(others)
    assert {x for x, _ in {*zip(i.tolist(), a.tolist())} & {*zip(j.tolist(), b.tolist())}} == set(range(len(words)))
    assert np.bitwise_count(a ^ words[i]).max() == code.REACH and len(i) < 25 * len(words)


@pytest.mark.parametrize("cell_rows", [20_000, 3])
def test_links_reach_all_near_fingerprints(spark, cell_rows, monkeypatch):
    seen = {}
    draw = np.random.default_rng(4)
    fps = list(draw.integers(0, 2**64, 150, dtype=np.uint64))
    for _ in range(450):
        x = int(fps[draw.integers(len(fps))])
        for b in draw.choice(64, draw.integers(1, 5), replace=False):
            x ^= 1 << int(b)
        fps.append(np.uint64(x))
    fps = np.unique(np.array(fps, np.uint64))
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= 3, 1)):
        root[max(find(a), find(b))] = min(find(a), find(b))
    want = Counter(frozenset(g) for g in pd.Series(fps.view(np.int64)).groupby([find(i) for i in range(len(fps))]).agg(set) if len(g) > 1)
    if cell_rows == 3:  # batches that cells reach over, and crowded ones
        monkeypatch.setattr(simhash, "staged", lambda df, name: seen.setdefault(name, staged(df, name)))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = graph.components(simhash.links(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), cell_rows)).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert cell_rows > 3 or seen["links"].filter("crowded").count() > 0
    assert Counter(frozenset(g) for g in got.groupby("root").node.agg(set)) == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (None, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}}


def test_components_take_few_rounds(spark, monkeypatch):
    """Each table of edges is written by jobs whose plans and threads stay in the driver's memory for a while."""
    from gaugeflow.operators import graph as operators

    written = []
    monkeypatch.setattr(operators, "Staged", lambda df, name, write=operators.Staged: written.append(name) or write(df, name))
    draw = np.random.default_rng(2)
    edges = [(int(a), int(a) + 1) for a in draw.permutation(400) if a % 50] + [(1000, int(x)) for x in draw.integers(1001, 1400, 600)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    want = {k: (k - 1) // 50 * 50 + 1 for k in range(1, 401)} | {x: 1000 for e in edges if e[0] == 1000 for x in e}
    assert got == want and len(written) <= 3
    monkeypatch.setattr(operators, "MOST_LINKS", 3)
    batches = pa.table({"u": [e[1] for e in edges[:300]], "v": [e[0] for e in edges[:300]]}).to_batches(max_chunksize=20)
    parts = list(operators._contracted(iter(batches)))
    assert len(parts) > 2
    assert all(u > v for p in parts for u, v in zip(p.column("u").to_pylist(), p.column("v").to_pylist()))


def brute_hits(text, items):
    words = decontaminate.words_of((text or "").encode())
    hit, ids = set(), set()
    for item, t in items:
        w = decontaminate.words_of((t or "").encode())
        size = min(10, len(w))
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1 if w else 0):
            if tuple(words[i : i + size]) in grams:
                hit.update(range(i, i + size))
                ids.add(str(item))
    return len(words), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("pass_bytes", [1 << 24, 600])
def test_contamination(spark, docs, real, pass_bytes):
    items = [*map(tuple, spark.read.parquet(f"{SF}/benchmark.parquet").collect()), (900, LONG[300:500]), (901, "of of"), (902, ""), (903, None), (904, "A, b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for df in (docs, real):  # null and repeated ids, repeated rows
        df = df.union(df.limit(3))
        want = sorted(((str(r.doc_id), *brute_hits(r.text, items)) for r in df.select("doc_id", "text").collect()), key=str)
        assert sorted(map(lambda r: (str(r[0]), *r[1:]), decontaminate.contamination(df, bench, ["doc_id"], pass_bytes=pass_bytes).collect()), key=str) == want
    assert decontaminate.contamination(docs, bench.limit(0), ["doc_id"]).filter("contaminated").count() == 0


@pytest.mark.parametrize("batches,crowded", [(1, 50_000), (4, 3)])
def test_suffix_dedup(docs, real, batches, crowded, monkeypatch):
    monkeypatch.setattr(suffix_dedup.repeated_runs, "__defaults__", (4, crowded))
    for df in (docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), real):
        seen, want = set(), {}
        for key, text in sorted((r.doc_id, r.text or "") for r in df.collect()):
            b = text.encode()
            gone = np.zeros(len(b), bool)
            for i in range(len(b) - 99):
                if b[i : i + 100] in seen:
                    gone[i : i + 100] = True
                seen.add(b[i : i + 100])
            runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
            want[key] = (len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
        got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(df, batches=batches).collect()}
        assert got == want


def test_levels_of_suffix_arrays_merge_geometrically(docs, monkeypatch):
    seen, add = [], suffix_dedup.IndexFamily.add

    def added(self, level):
        add(self, level)
        seen.append([n for n, _ in self.levels])

    monkeypatch.setattr(suffix_dedup.IndexFamily, "add", added)
    df = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    want = sorted(map(tuple, suffix_dedup.remove_repeats(df, batches=1).collect()))
    assert sorted(map(tuple, suffix_dedup.remove_repeats(df, batches=9).collect())) == want
    assert seen == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1], [4, 1, 1], [4, 2, 1], [4, 2, 1, 1]]


def test_suffix_dedup_of_repeated_and_null_keys(docs):
    assert suffix_dedup.remove_repeats(docs).count() == docs.count()
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_lm_scores(docs, real):
    for df in (docs, real):
        rows = [(r.doc_id, brown_lm.tokens((r.text or "").encode())) for r in df.select("doc_id", "text").collect()]
        held = lambda k: zlib.crc32(str("" if k is None else k).encode()) % 5 == 1
        counts = Counter(w for k, ws in rows if not held(k) for w in ws)
        n, v = sum(counts.values()), len(counts)
        want = sorted((str(k), held(k), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for k, ws in rows)
        got = brown_lm.lm_scores(df).toPandas()
        assert sorted((str(None if pd.isna(r.doc_id) else int(r.doc_id)), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.itertuples()) == want
    out = got[got.held_out]
    assert out.score.sum() > out.base_score.sum()
    assert brown_lm.lm_scores(docs.limit(0)).count() == 0


def test_exchange_finds_planted_classes():
    draw, of = np.random.default_rng(0), np.arange(12) % 3
    pairs = np.array([[200 + draw.integers(20) if of[b] == (of[a] + 1) % 3 else draw.integers(3) for b in range(12)] for a in range(12)], float)
    found = brown_lm.exchange(pairs, 3)
    assert len({(a, b) for a, b in zip(of, found)}) == 3


def log_loss(p, y):
    return -np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-9, 1)).mean()


def test_quality(spark, docs):
    sf = "/root/testdata/sf0.01"
    out = quality.op2_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    assert (out.predicted == out.quality).mean() > 0.9
    # Calibrated: what is said with some probability happens about as often.
    assert log_loss(out.score.to_numpy(), out.quality.to_numpy()) < 0.3
    bins = out.groupby((out.score * 5).clip(upper=4.999).astype(int))
    assert sum(len(g) * abs(g.score.mean() - g.quality.mean()) for _, g in bins) / len(out) < 0.06
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, none, ["doc_id"]).toPandas()
    assert len(got) == docs.count() and (got.score == 0.5).all()
    labels = spark.createDataFrame([(5, 1), (5, 0), (3, 0), (None, 1), (0, 2), (6, 1)], "doc_id long, quality int")
    twice = quality.quality_scores(docs.union(docs), labels, ["doc_id", "fp"]).toPandas()
    assert len(twice) == 2 * docs.count() and twice.groupby("doc_id", dropna=False).score.nunique().max() <= 2
    assert quality.quality_scores(docs.limit(0), labels, ["doc_id"]).count() == 0


def test_temperature_makes_held_rows_likelier():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(400, 8))
    y = (draw.random(400) < 1 / (1 + np.exp(-1.5 * x[:, 0]))).astype(float)
    network = quality.Network(x, y)
    held = draw.normal(size=(4000, 8))
    truth = (draw.random(4000) < 1 / (1 + np.exp(-1.5 * held[:, 0]))).astype(float)
    calibrated = log_loss(network.scores(held), truth)
    network.temperature = 1.0
    assert calibrated < log_loss(network.scores(held), truth)


def test_pooling_holds_a_document_at_a_time_and_is_that_of_a_plain_loop(monkeypatch):
    """The vectors of all pieces of a run at once are tens of MB, which no processor's cache holds."""
    import tracemalloc

    draw = np.random.default_rng(4)
    texts = [b" ".join(b"w%d" % k for k in draw.integers(0, 900, 500)) for _ in range(400)]
    own = {b"w%d" % k: k for k in range(900)}
    vectors = draw.normal(size=(900 + quality.BUCKETS, quality.DIMS)).astype(np.float32)
    cache = quality._Buckets(own)
    tracemalloc.start()
    got = quality.pooled(texts, vectors, cache)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    cut = quality._bucketed
    monkeypatch.setattr(quality, "_bucketed", lambda texts, cache: cut(texts, cache, 7))
    few = [b"", b"w1", *texts[:3]]
    for text, row in [*zip(texts[:5], got), *zip(few, quality.pooled(few, vectors, cache))]:
        near = vectors[[cache[p] for p in text.split()]].astype(float)
        want = np.concatenate((near.sum(axis=0) / max(len(near), 1), np.abs(np.diff(near, axis=0)).sum(axis=0) / max(len(near) - 1, 1)))
        assert np.allclose(row, want, atol=1e-4)


def test_contexts_of_short_and_cut_texts():
    own = {b"a": 0, b"b": 1}
    places, signs = quality.index_vectors(2 + quality.BUCKETS)
    sums = next(quality._context_sums(iter([pa.record_batch([pa.array(["a", "b a", None, "", "a"])], ["text"])]), own))
    got = {b: np.array([sums.column(f"v{d}")[i].as_py() for d in range(quality.DIMS)]) for i, b in enumerate(sums.column("bucket").to_pylist())}
    for word, near in ((0, 1), (1, 0)):  # texts do not run into each other
        want = np.zeros(quality.DIMS)
        want[places[near]] = signs[near]
        assert (got[word] == want).all()
    assert set(got) == {0, 1}


def test_word_vectors_are_sums_of_index_vectors(spark, monkeypatch):
    monkeypatch.setattr(quality, "HEAD_SHARE", 8)
    texts = ["a b c a b", "a, b", None, "c"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    own = quality.frequent_words(df)
    assert sorted(own) == [b"a", b"b", b"c"]
    rows = quality._Buckets(own)
    places, signs = quality.index_vectors(len(own) + quality.BUCKETS)
    want = np.zeros((len(own) + quality.BUCKETS, quality.DIMS))
    for t in texts:
        ids = [rows[p] for p in quality.PIECES.findall((t or "").encode())]
        for i, w in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if i != j:
                    want[w, places[ids[j]]] += signs[ids[j]]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.word_vectors(df, own), want, atol=1e-6)


def plain_rates(n, p, wanted):
    """Rates nearest to 1 that meet the wanted tokens, by small projected steps on all rows."""
    pull, mass = np.zeros(p.shape[1]), n / n.sum()
    for _ in range(400_000):
        rate = np.maximum(0, 1 + p @ pull)
        wrong = (mass * rate) @ p - wanted
        if np.abs(wrong).max() < 1e-9:
            break
        pull -= 0.9 * wrong / (mass @ p)
    return rate


@pytest.mark.parametrize("targets", [mixing.TARGETS, {"low": 0.2, "low_toxic": 0.02, "high": 0.7, "high_toxic": 0.08}, {"high_toxic": 0.01}])
def test_mixing_meets_targets(spark, targets):
    sf = "/root/testdata/sf0.01"
    out = mixing.document_rates(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), targets).toPandas()
    n, p = out.n_tokens.to_numpy(float), out[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    present = n @ p / n.sum()
    assert np.allclose(p.sum(axis=1), 1) and (out.rate >= 0).all() and out.targets_met.all()
    reached = (n * out.rate) @ p / n.sum()
    for k, d in enumerate(mixing.DOMAINS):
        assert reached[k] == pytest.approx(present[k] if d not in targets and len(targets) < 4 else targets[d] * reached.sum(), rel=0.01)
    plain = plain_rates(n, p, np.array(mixing.wanted_tokens(present.tolist(), [targets.get(d) for d in mixing.DOMAINS])))
    assert np.allclose(out.rate, plain, rtol=0.05, atol=0.02)


def test_steps_of_the_fit_share_their_generated_code(spark):
    rows = spark.createDataFrame([(10, [0.9, 0.1]), (20, [0.8, 0.2])], "n_tokens long, p array<double>")

    def code(pull):
        plan = rows.select(mixing.rate_of(F.col("p"), pull))._jdf.queryExecution()
        return spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan.executedPlan()).split("Generated code:")[1]

    assert code([0.25, -3.5]) == code([0.125, 7.0])
    got = [r[0] for r in rows.select(mixing.rate_of(F.col("p"), [0.25, -30.0])).collect()]
    assert got == [max(0.0, 1.0 + 0.25 * a + -30.0 * b) for a, b in ((0.9, 0.1), (0.8, 0.2))]


def test_mixing_tells_of_targets_out_of_reach(spark):
    rows = spark.createDataFrame([(10, [0.9, 0.1]), (20, [0.8, 0.2])], "n_tokens long, p array<double>")
    assert not mixing.fit_rates(rows, [0.1, 0.9])[1].met
    assert mixing.fit_rates(rows, [0.85, 0.15])[1].met
    rated, fit = mixing.fit_rates(rows.limit(0), [0.5, 0.5])
    assert not fit.met and rated.count() == 0
    with pytest.raises(ValueError):
        mixing.wanted_tokens([0.5, 0.5], [1.0, None])


def test_mixing_edge_cases(spark, docs):
    labels = spark.createDataFrame([(5, 1, 0), (None, 1, 1), (6, None, 0)], "doc_id long, quality int, toxic int")
    assert mixing.document_rates(docs, labels).count() == docs.count()
    assert mixing.document_rates(docs.limit(0), labels).count() == 0
    words = docs.select("text", mixing.count_of(mixing.words_of(F.col("text"))).alias("n")).collect()
    assert all(r.n == len((r.text or "").replace(" ", "_").split()) for r in words)


PAGE = '<html><head><title>t</title><script>x("</p>")</script></head><body><div class="top"><a>Site</a></div><nav><li>n{0}</nav><div id="m"><p>First {0} &amp; more<br>line<p>Second  {0}<ul><li>a{0}<li>b</ul></div><div class="comments"><p>me {0}</p></div><footer>f</footer>'


def test_pages(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i)) for i in range(8)]
    rows += [(50, None, None), (51, "x", "<article><h1>T</h1><p>a<aside>b</aside></article>rest"), (52, "http://o.example", "plain &lt; text"), (None, "http://h.example/9", PAGE.format(9)), (53, "http://q.example", "<p" + "<div>" * 3000 + "deep")]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id", "url"]).collect()}
    assert got[3] == "First 3 & more line\nSecond 3\na3\nb" and got[None] == "First 9 & more line\nSecond 9\na9\nb"
    assert (got[50], got[51], got[52], got[53]) == ("", "T\na", "plain < text", "deep")
    shuffled = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"], broadcast_bytes=0)
    assert {r.page_id: r.text for r in shuffled.collect()} == got


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, stage in pipeline.STAGES:
        assert docs.columns == pipeline.COLUMNS
        out = stage(spark, docs, SF).cache()
        if name == "benchmark decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect() if not brute_hits(r.text, items)[4]}
        docs = out
    assert sorted(out.columns) == sorted(["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]) and out.count() > 0


def word_sets(text, words_in=5):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + words_in]) for i in range(max(1, len(w) - words_in + 1))) if w else frozenset()


def groups_by_jaccard(texts):
    """For each text the least index that pairs of Jaccard 0.8 or more reach."""
    sets, root = [word_sets(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 10 * len(a & b) >= 8 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def near_copy_texts():
    """Texts of 3 to 300 words with copies that differ by few to many words, below 0.8 as well."""
    draw, texts = np.random.default_rng(7), [None, "", " \n", "one two", "One  two", "one three"]
    for k, n in enumerate((3, 5, 6, 9, 12, 30, 60, 120, 300) * 2):
        words = [f"w{draw.integers(10**6)}" for _ in range(n)]
        texts.append(" ".join(words))
        for changes in (0, 1, 2, 3, 5, 8, 12):
            copy = list(words)
            for at in draw.integers(0, n, changes):
                copy[at] = f"x{draw.integers(10**6)}"
            texts.append(" ".join(copy + ["tail"] * (k % 2)))
    return texts


@pytest.mark.parametrize("task_links", [500_000, 3])
def test_components_with_one_task_and_with_star_rounds(spark, monkeypatch, task_links):
    """Few links take few jobs, since plans, threads and compiled code of each stay in the driver's memory."""
    from gaugeflow.operators import graph as operators

    monkeypatch.setattr(operators, "TASK_LINKS", task_links)
    draw = np.random.default_rng(3)
    edges = [(int(a), int(a) + 1) for a in draw.permutation(120) if a % 30] + [(1000, int(x)) for x in draw.integers(1001, 1100, 200)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    group = f"components-{task_links}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = graph.components(df)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    got = {r.node: r.root for r in out.collect()}
    assert got == {**{k: (k - 1) // 30 * 30 + 1 for k in range(1, 121)}, **{x: 1000 for e in edges if e[0] == 1000 for x in e}}
    assert len(jobs) <= 6 or task_links == 3
    assert graph.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("cell_rows", [20_000, 2])
def test_near_copies_are_those_of_jaccard(spark, cell_rows):
    from gaugeflow.llm import near_copies

    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    texts = near_copy_texts() + real
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = near_copies.near_copies(df, cell_rows=cell_rows).toPandas()
    assert len(got) == len(texts)
    want = pd.Series(range(len(texts))).groupby(groups_by_jaccard(texts)).agg(frozenset)
    assert set(got.groupby("root").doc_id.agg(frozenset)) == set(want)
    assert near_copies.near_copies(df.limit(0)).count() == 0


def test_near_dedup_keeps_a_row_of_each_group(spark):
    """Null ids, an id that unrelated texts share, and rows that are equal throughout."""
    import corpus_pipeline as pipeline

    long = [" ".join(f"t{k}w{i}" for i in range(60)) for k in range(6)]
    near = long[1].replace("t1w30", "changed")
    pairs = [(None, long[0]), (None, long[1]), (4, near), (9, near), (7, long[2]), (7, long[3]), (7, long[3]), (None, long[4]), (None, long[4]), (7, None), (None, "")]
    df = spark.createDataFrame([(k, t, "en", "s", None) for k, t in pairs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    root, want = groups_by_jaccard([t for _, t in pairs]), []
    for g in set(root):
        want.append(min((k is None, k or 0, "" if t is None else t) for (k, t), r in zip(pairs, root) if r == g))
    got = [(r.doc_id is None, r.doc_id or 0, r.text or "") for r in pipeline.near_dedup(spark, df, SF).collect()]
    assert sorted(got) == sorted(want) and len(got) == 6


def test_nested_articles_give_the_same_text_on_small_and_large_hosts(spark):
    page = '<body><div class="top">Site</div><article><h1>Title {0}</h1><p>Lead {0}</p><div class="entry">' + "<p>Long body of {0} with many words</p>" * 5 + "</div><p>Closing {0}</p></article><footer>f</footer>"
    rows = [(100 * n + i, f"http://h{n}.example/{i}", page.format(i)) for n in (2, 8) for i in range(n)]
    rows.append((799, "http://h8.example/empty", ""))  # the first page of its host
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    for n in (2, 8):
        for i in range(n):
            assert got[100 * n + i] == "\n".join([f"Title {i}", f"Lead {i}", *[f"Long body of {i} with many words"] * 5, f"Closing {i}"])
    assert got[799] == ""


def test_secrets_of_very_long_runs(spark):
    """A million characters without a match, labels without end, and many spans in one text."""
    many = "token=abcdefgh pwd: hunter22 login: bob " * 20_000
    texts = ["x" * 1_000_000 + "@", "x@a" + ".a" * 100_000, "z" * 1_000_000 + "://", "secret" + " " * 1_000_000, "0a" * 500_000, many, "pwd: hunter22 " + "y" * 100 + "@host.example" + " @" * 50_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan_secrets(rows).collect()}
    assert [got[i].spans for i in range(5)] == ["", "", "", "", "hex:0:1000000"]
    assert got[5].n_assign == 20_000 and got[5].spans.startswith("assign:0:14,phrase:15:28,account:29:39,assign:40:54")
    assert got[5].spans.count(",") == 3 * 20_000 - 1
    assert got[6].spans == "phrase:0:13,address:50:127"


def plain_scores(rows, head_share):
    """The model of brown_lm word by word, from counts in dictionaries."""
    held = lambda k: zlib.crc32(str("" if k is None else k).encode()) % 5 == 1
    docs = [(k, brown_lm.tokens((t or "").encode())) for k, t in rows]
    training = [w for k, w in docs if not held(k)]
    counts = Counter(w for ws in training for w in ws)
    total, K = sum(counts.values()), brown_lm.CLASSES
    head = {w for w, n in counts.items() if n * head_share >= total}
    single = sorted((w for w in head if w != b""), key=lambda w: (-counts[w], w))[: brown_lm.SINGLE]
    unit_of = {w: i for i, w in enumerate([b"", *single])}
    unit = lambda w: unit_of.get(w, len(unit_of) + brown_lm.ending(w))
    pairs = np.zeros((len(unit_of) + brown_lm.ENDINGS,) * 2)
    follows = [(a, b) for ws in training for a, b in zip([b"", *ws], ws)]
    for a, b in follows:
        pairs[unit(a), unit(b)] += 1
    of_unit = brown_lm.exchange(pairs, K)
    of_ending = lambda w: int(of_unit[len(unit_of) + brown_lm.ending(w)])
    class_of = {w: int(of_unit[unit(w)]) for w in head | {b""}}

    def value(column):
        return sum(x * math.log(x) for x in column if x > 0) - (sum(column) * math.log(sum(column)) if sum(column) > 0 else 0)

    def best(word, contexts, table, own):
        without = [[t - (x if c == own else 0) for t, x in zip(table[c], contexts)] for c in range(K)]
        gains = [value([t + x for t, x in zip(col, contexts)]) - value(col) for col in without]
        gains = [round(g, 6) for g in gains]
        top = max(range(K), key=lambda c: (gains[c], -c))
        return own if own >= 0 and gains[top] <= gains[own] else top

    def seen(words):
        out = {w: [0] * K for w in words}
        for a, b in follows:
            if b in out:
                out[b][class_of[a] if a in class_of else of_ending(a)] += 1
        return out

    def table_of(contexts, of):
        return [[sum(x[k] for w, x in contexts.items() if of[w] == c) for k in range(K)] for c in range(K)]

    for _ in range(brown_lm.ROUNDS):
        contexts = seen(head)
        table = table_of(contexts, class_of)
        class_of |= {w: best(w, x, table, class_of[w]) for w, x in contexts.items()}
    contexts = seen(counts)
    table = table_of({w: contexts[w] for w in head}, class_of)
    own = {w: class_of[w] if w in head else best(w, x, table, -1) for w, x in contexts.items()}
    table, kinds = table_of(contexts, own), Counter(own.values())

    def log_p(a, b):
        k, c = class_of[a] if a in class_of else of_ending(a), own[b] if b in own else of_ending(b)
        transition = (table[c][k] + 0.1) / (sum(t[k] for t in table) + 0.1 * K)
        return math.log10(transition) + math.log10((counts[b] + 0.5) / (sum(table[c]) + 0.5 * (kinds[c] + 1)))

    return [(k, sum(log_p(a, b) for a, b in zip([b"", *ws], ws))) for k, ws in docs]


@pytest.mark.parametrize("head_share", [1 << 20, 40])
def test_lm_scores_are_those_of_the_plain_model(spark, head_share, monkeypatch):
    monkeypatch.setattr(brown_lm, "HEAD_SHARE", head_share)
    monkeypatch.setattr(brown_lm, "SINGLE", 15)
    draw, rows = np.random.default_rng(3), []
    for k in range(40):
        words = [f"{'abcd'[j % 4]}{draw.zipf(1.5) % 30}{'xyz'[j % 3]}" for j in range(draw.integers(0, 60))]
        rows.append((k, " ".join(words)))
    rows += [(None, None), (7, "never seen words"), (7, "never seen words"), (50, "")]
    got = brown_lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).toPandas()
    want = sorted((str(k), round(s, 6)) for k, s in plain_scores(rows, head_share))
    assert sorted((str(None if pd.isna(r.doc_id) else int(r.doc_id)), round(r.score, 6)) for r in got.itertuples()) == want


def test_pages_without_telling_tags_or_names(spark):
    """Only what changes from page to page tells the main text: menus, notices and footers are made
    of the same elements, with classes that say nothing."""
    draw = np.random.default_rng(11)
    def page(i):
        body = "".join(f"<p class=k3>{' '.join(f'w{draw.integers(900)}' for _ in range(40))}</p>" for _ in range(3 + i % 3))
        return f"<body><div class=k1><p>Home</p><p>About us</p><p>All about the firm</p></div><div class=k2><div class=k4><h2>Title {i}</h2>{body}</div></div><div class=k5><p>Terms of use</p><p>Write to us</p></div>"

    pages = [page(i) for i in range(9)]
    rows = [(i, f"http://plain.example/{i}", h) for i, h in enumerate(pages)]
    df = spark.createDataFrame(rows + rows[:2], "page_id long, url string, html string")
    got = html_text.main_text(df, ["page_id"]).collect()
    assert len(got) == 11 and html_text.main_text(df.limit(0), ["page_id"]).count() == 0
    for r in got:
        blocks = [f"Title {r.page_id}"] + [x.split("</p>")[0] for x in pages[r.page_id].split("<p class=k3>")[1:]]
        assert r.text == "\n".join(blocks)


def test_very_many_siblings(spark):
    a, b = (html_text.Page("<body><div>" + "".join(f"<p>{x} {i}" for i in range(20_000)) + "</div>") for x in ("one", "two"))
    assert len(html_text.align(a, b)) == 20_003
    few = [html_text.Page("<ul>" + "".join(f"<li>{k}" if k % 7 else f"<h3>{k}" for k in range(n)) + "</ul>") for n in (300, 290)]
    assert len(html_text.align(*few)) >= 280


def plain_weight(a, b, x=0, y=0):
    """Weight of the largest match of two trees, by its definition."""
    best = {}
    for i, p in enumerate(a.children[x]):
        for k, q in enumerate(b.children[y]):
            here = best.get((i - 1, k - 1), 0) + plain_weight(a, b, p, q) if a.tag[p] == b.tag[q] else 0
            best[i, k] = max(here, best.get((i - 1, k), 0), best.get((i, k - 1), 0))
    return 1 + (a.hint[x] == b.hint[y]) + max(best.values(), default=0)


@pytest.mark.parametrize("cells", [0, html_text.CELLS])
def test_matches_are_the_largest_at_any_number_of_siblings(cells, monkeypatch):
    monkeypatch.setattr(html_text, "CELLS", cells)
    draw = np.random.default_rng(8)
    tags = ["p", "h3", "section", "div"]

    def page(n):
        def one():
            t = tags[draw.integers(4)]
            return f"<{t} class=k{draw.integers(2)}>{'<h4>a</h4>' * draw.integers(3) if t in tags[2:] else ''}</{t}>"

        return html_text.Page("<div>" + "".join(one() for _ in range(n)) + "</div>")

    for n, m in ((4, 6), (95, 100), (120, 130), (150, 140)):
        a, b = page(n), page(m)
        pairs = html_text.align(a, b)
        assert all(a.tag[x] == b.tag[y] for x, y in pairs.items())
        assert sorted(pairs.values()) == [pairs[x] for x in sorted(pairs)]
        assert sum(1 + (a.hint[x] == b.hint[y]) for x, y in pairs.items()) == plain_weight(a, b)


def test_depth_of_a_page_changes_nothing(spark):
    page = "<body>{1}<nav><ul><li>menu {0}</li></ul></nav><div class=k><p>Text {0}</p></div>{2}"
    rows = [(1000 * k + i, f"http://deep{k}.example/{i}", page.format(i, "<div>" * k, "</div>" * k)) for k in (10, 400) for i in range(3)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()
    assert {r.page_id: r.text for r in got} == {k: f"Text {k % 1000}" for k, _, _ in rows}


def test_shards_by_brute_force(spark, docs):
    got = sharding.shard_documents(docs.union(docs), 7).toPandas()
    rows = docs.union(docs).collect()
    assert len(got) == len(rows)
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((None if pd.isna(k) else int(k), n, c) for k, n, c in zip(got.doc_id, got["size"], got.text_crc32)) == want
    key = np.array([0 if pd.isna(k) else int(k) for k in got.doc_id], np.int64).view(np.uint64)
    shard, grown = sharding.jump_hash(key, 7)
    assert got.shard.tolist() == shard.tolist() and got.grown_shard.tolist() == grown.tolist() and set(got.law) == {"key"}
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_pipeline_stages_on_odd_rows(spark, docs):
    """Nulls, empty texts, repeated rows and ids, an empty table: no stage fails, none drops a row
    that it has no reason to."""
    import corpus_pipeline as pipeline

    df = docs.union(docs.limit(4)).select(*pipeline.COLUMNS)
    for rows in (df, df.limit(0)):
        n = rows.count()
        kept = pipeline.decontamination(spark, rows, SF)
        assert kept.columns == pipeline.COLUMNS and kept.count() == n
        mixed = pipeline.mix_sources(spark, rows, SF)
        assert mixed.columns == pipeline.COLUMNS and (mixed.count() > 0) == (n > 0)
        assert pipeline.shard(spark, rows, SF).count() == n
        assert pipeline.quality_filter(spark, rows, SF).columns == pipeline.COLUMNS
        near = pipeline.near_dedup(spark, rows, SF)
        assert near.count() == len(set(groups_by_jaccard([r.text for r in rows.collect()])))


def test_mixing_stage_keeps_clean_documents(spark):
    """On a corpus that is nearly clean, and on one that isn't."""
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    clean = docs.join(labels.filter("quality = 1 AND toxic = 0"), "doc_id", "left_semi")
    few = docs.join(labels.filter("toxic = 1"), "doc_id", "left_semi").limit(5)
    for df in (clean.union(few), docs):
        df = df.select(*pipeline.COLUMNS)
        rated = mixing.document_rates(df, labels, pipeline.TARGETS, keep=["doc_id"], ceilings=True).toPandas()
        sure = rated[rated.p_high_toxic + rated.p_low_toxic < 0.05]
        assert (sure.rate > 0.97).all() and len(sure) > 0.7 * len(rated)
        left = {r.doc_id for r in pipeline.mix_sources(spark, df, sf).collect()}
        assert len(set(sure.doc_id) - left) <= 0.01 * len(sure)
    assert rated[rated.p_high_toxic > 0.9].rate.mean() < 0.3 and rated.targets_met.all()

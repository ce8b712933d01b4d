import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, lo int, path string"


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels_of(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def plain(rows):
    """Every row's digests from whole levels, one tree after the other."""
    trees = {}
    for doc_id, source, lang, n, text in rows:
        leaf = H(*map(field, (doc_id, source, lang, n, text)))
        hit = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        wrong = H(*map(field, (doc_id, source, lang, n + 1, text))) if hit else leaf
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, wrong, doc_id))
    order = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    low = {k: levels_of([r[2] for r in sorted(trees[k])]) for k in order}
    top = levels_of([low[k][-1][0] for k in order])
    out = []
    for t, k in enumerate(order):
        for i, r in enumerate(sorted(trees[k])):
            at, siblings = r[3], []
            for tree, place in ((low[k], i), (top, t)):
                for row in tree[:-1]:
                    pair = row[place & ~1 : (place & ~1) + 2]
                    other = [x for j, x in enumerate(pair) if j != place % 2]
                    siblings += other
                    at = H(at, *other) if place % 2 == 0 else H(*other, at)
                    place >>= 1
            out.append((r[4], r[2], low[k][-1][0], top[-1][0], H(*siblings), at, at == top[-1][0]))
    return sorted(map(str, out))


ROWS = [
    *((i, "s", "en", 5 + i, f"text {i}") for i in range(300)),
    *((i, "ß", "de", None if i % 3 else i, None if i % 5 == 0 else "é" * i) for i in range(1000, 1037)),
    (7, None, None, 3, ""), (8, "x" * 3000, "", 2**63 - 1, "long " * 60_000), (None, "s", "en", 4, "no id"), (None, None, None, None, None),
    (5, "s", "fr", 1, "same"), (5, "s", "fr", 1, "same"), (5, "s", "fr", 1, "another"), (-7, "s", "zh", 0, "文"),
]


def run(df, **how):
    wrong = manifest.digest(*(manifest.encoded(F.col("n_chars").cast("decimal(20,0)") + 1 if f == "n_chars" else F.col(f)) for f in manifest.FIELDS))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest.verified(manifest.manifest(df, altered=F.when(hit, wrong), **how), "doc_id", F.col("altered"))


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], ROWS[:2], ROWS[:256], ROWS[:257], ROWS[-2:]])
def test_manifest_equals_whole_levels(spark, rows):
    df = spark.createDataFrame([(*r, "t", 1, "p") for r in rows], SCHEMA).repartition(3)
    assert sorted(str(tuple(r)) for r in run(df).collect()) == plain(rows)


def test_manifest_of_an_empty_table(spark):
    assert run(spark.createDataFrame([], SCHEMA)).collect() == []


def test_manifest_goes_on_over_three_bands(spark):
    df = spark.createDataFrame([(*r, "t", 1, "p") for r in ROWS], SCHEMA).repartition(3)
    assert sorted(str(tuple(r)) for r in run(df, levels=3).collect()) == plain(ROWS)


def test_sql_equals_whole_levels():
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, source varchar, lang varchar, n_chars bigint, text varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", [list(r) for r in ROWS])
    assert sorted(str(tuple(r)) for r in con.sql(manifest.SQL).fetchall()) == plain(ROWS)

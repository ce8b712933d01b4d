"""Merkle manifest of a dataset: nested-interval labels, containment joins, proofs and their check."""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Staged, staged, table

#: Levels that are built at once: a block holds the 2^8 nodes below one node eight levels up.
LEVELS = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
NODES = "tree string, level int, bucket long, lo long, hi long, mid long, digest binary, left binary, right binary, n long, depth int"
PATH = "array<struct<level:int,left:boolean,sibling:binary>>"


def encoded(column: Column) -> Column:
    """A field of a leaf: '-' if null, else its UTF-8 byte count, ':' and its value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def hexed(column: Column) -> Column:
    return F.lower(F.hex(column))


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` (with `tree`) and lo, the rank in the tree by `order`, n, the tree's leaves, and depth.

    A range sort deals the order over tasks and each row has its place in its task's part; the
    parts' counts, one row a tree and part, give where a part starts. No tree passes through one
    task. Rows that `order` can't tell apart take ranks in any order, fixed once by the written
    table: `_nth` splits a hot value of the order, too.
    """
    nth = rows.withColumn("_nth", F.monotonically_increasing_id())
    cut = nth.repartitionByRange("tree", *order, "_nth").sortWithinPartitions("tree", *order, "_nth").drop("_nth")
    placed = staged(cut.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)), "ranks")
    whole = Window.partitionBy("tree")
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("tree", "_part").agg(F.count("*").alias("c"), F.min("_at").alias("first"))
    n = F.sum("c").over(whole)
    starts = parts.select("tree", "_part", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"), n.alias("n"))
    depth = F.when(F.col("n") <= 1, 0).otherwise(F.length(F.bin(F.col("n") - 1)))
    out = placed.join(starts, ["tree", "_part"]).withColumn("lo", F.col("_at") + F.col("shift")).withColumn("depth", depth)
    return out.drop("_at", "_part", "shift")


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes above one block's members, each with its interval of leaf ranks, where its second
    child's interval starts (`mid`; its end for a lone child) and its children's digests."""
    rows = rows.sort_values("lo")
    first = rows.iloc[0]
    base, depth, until = int(first["base"]), int(first["depth"]), int(first["until"])
    now = list(zip(rows["lo"].tolist(), rows["hi"].tolist(), rows["digest"]))
    out = []
    for level in range(base + 1, min(until, depth) + 1):
        above = []
        for k in range(0, len(now), 2):
            lo, mid, left = now[k]
            end, right = (now[k + 1][1], now[k + 1][2]) if k + 1 < len(now) else (mid, None)
            made = sha256((left.hex() + (right.hex() if right else "")).encode()).digest()
            out.append((first["tree"], level, lo >> level, lo, end, mid, made, left, right, int(first["n"]), depth))
            above.append((lo, end, made))
        now = above
    return pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")])


def build(leaves: DataFrame, levels: int = LEVELS) -> tuple[list, DataFrame]:
    """The nodes above `leaves` (tree, lo, n, depth, digest, ...), in bands of eight levels, and the root
    of every tree as (tree, lo, hi, n, depth, digest).

    Every two consecutive nodes of a level, or a last lone one, have a parent, until one remains.
    Blocks of 256 members give the nodes of a band, each block in one task; the tops of blocks are
    the members of the next band. A tree that has ended is carried on as its root.
    """
    bands, base, members = [], 0, leaves.withColumn("hi", F.col("lo") + 1)
    deepest = leaves.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    columns = ["tree", "lo", "hi", "n", "depth", "digest"]
    while base < max(deepest, 1):
        members = members.withColumn("block", F.shiftright("lo", base + levels))
        open_ = members.filter(F.col("depth") > base).select(*columns, "block", F.lit(base).alias("base"), F.lit(base + levels).alias("until"))
        nodes = Staged(open_.groupBy("tree", "block").applyInPandas(_block, NODES), "nodes").df
        bands.append((members, nodes, base, base + levels))
        tops = nodes.filter((F.col("level") == base + levels) | (F.col("level") == F.col("depth"))).select(*columns)
        members = staged(tops.unionByName(members.filter(F.col("depth") <= base).select(*columns)), "members")
        base += levels
    return bands, members


def attach(bands: list, above: DataFrame) -> DataFrame:
    """The leaves of `build` with path, which goes on as that of their tree in `above` (tree, block 0,
    path, ...), and the other columns of `above`. A step of a path is the level, whether the own
    node is the left one, and the sibling's digest (null where there is none).

    A member meets its ancestors of a band by a join on tree, level and the bucket of its rank at that level,
    with the rank contained in the ancestor's interval; that interval without the own child's is
    the sibling. What is above a band is shared by a block and meets it by the block. So a row is
    joined with eight ancestors, however deep its tree is, and no key has more than 256 rows.
    """
    for members, nodes, base, until in reversed(bands):
        levels = F.sequence(F.lit(base + 1), F.least("depth", F.lit(until)))
        climb = members.filter(F.col("depth") > base).select("tree", "lo", F.explode(levels).alias("level"))
        climb = climb.withColumn("bucket", F.expr("shiftright(lo, level)"))
        node = nodes.select("tree", "level", "bucket", F.col("lo").alias("a"), F.col("hi").alias("b"), "mid", F.col("left").alias("one"), F.col("right").alias("two"))
        met = climb.join(node, ["tree", "level", "bucket"]).filter("a <= lo AND lo < b")
        own_left = F.col("lo") < F.col("mid")
        step = F.struct("level", own_left.alias("left"), F.when(own_left, F.col("two")).otherwise(F.col("one")).alias("sibling"))
        below = met.groupBy("tree", "lo").agg(F.array_sort(F.collect_list(step)).alias("below"))
        path = F.when(F.col("below").isNull(), F.col("path")).otherwise(F.concat("below", "path"))
        joined = members.join(below, ["tree", "lo"], "left").join(above, ["tree", "block"]).withColumn("path", path).drop("below", "hi")
        shared = [c for c in above.columns if c != "block"]
        above = joined.withColumn("block", F.shiftright("lo", base)).select("block", *shared)
    return joined.drop("block")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give, in hex."""

    def up(at: Column, step: Column) -> Column:
        other = F.coalesce(hexed(step["sibling"]), F.lit(""))
        return F.sha2(F.when(step["left"], F.concat(at, other)).otherwise(F.concat(other, at)).cast("binary"), 256)

    return F.aggregate(path, hexed(leaf), up)


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: list[str] = FIELDS, levels: int = LEVELS, **carry: Column) -> DataFrame:
    """(key, leaf, subroot, root, path) for every row of `docs`, digests in binary, and the columns of `carry`.

    A leaf is the SHA-256 of the row's `fields`, in this order. A group's leaves, by ascending key, make
    a tree with the subroot; the subroots, by group (null first, then by UTF-8 bytes), make the
    tree with the root. A null key comes before all others; rows that share a key follow the order of
    their leaves, and equal rows have a place each. A null group is a group of its own. Texts are
    read whole: a very long one counts as any other and leaves its task as a digest. Columns of
    `docs` that aren't named here are ignored, so their names can't clash. An empty table gives no
    rows and has no root. The path goes up to the subroot and on to the root; `folded` checks it.
    """
    tree = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    rows = docs.select(F.col(key).alias("key"), tree.alias("tree"), digest(*(encoded(F.col(f)) for f in fields)).alias("digest"), *(c.alias(name) for name, c in carry.items()))
    low, subroots = build(Staged(ranked(rows, ["key", "digest"]), "leaves").df, levels)
    groups = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    high, root = build(Staged(ranked(groups, ["group"]), "subroots").df, levels)
    seed = root.select("tree", F.lit(0).cast("long").alias("block"), F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    above = attach(high, seed).select(F.col("group").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("digest").alias("subroot"), "root", "path")
    return attach(low, above).select(F.col("key").alias(key), F.col("digest").alias("leaf"), "subroot", "root", "path", *carry)


def verified(proofs: DataFrame, key: str, altered: Column) -> DataFrame:
    """What op13 returns of `manifest`: its digests in hex, the digest of each proof, and whether the
    leaf, or the altered one where that isn't null, still leads to the root."""
    siblings = F.array_join(F.transform("path", lambda step: hexed(step["sibling"])), "")
    out = proofs.withColumn("folded_root", folded(F.coalesce(altered, F.col("leaf")), F.col("path")))
    return out.select(
        key,
        hexed(F.col("leaf")).alias("leaf"),
        hexed(F.col("subroot")).alias("subroot"),
        hexed(F.col("root")).alias("root"),
        F.sha2(siblings.cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == hexed(F.col("root"))).alias("verified"),
    )


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    wrong = digest(*(encoded(more if f == "n_chars" else F.col(f)) for f in FIELDS))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return verified(manifest(docs, altered=F.when(hit, wrong)), "doc_id", F.col("altered"))


SQL = r"""
WITH RECURSIVE e AS (
  SELECT doc_id, coalesce('=' || lang, '') AS t, n_chars,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
         coalesce(strlen(text) || ':' || text, '-') AS z,
         doc_id IS NOT NULL AND xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
             lambda p, q: list_reduce(list_concat([xor(p, q)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda u, v: xor(u >> 1, (u & 1) * 3988292384))), 4294967295) % 7 = 0 AS hit
  FROM documents
), d AS (
  SELECT doc_id, t, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf,
         sha256(a || coalesce(strlen((n_chars + hit::INT)::VARCHAR) || ':' || (n_chars + hit::INT), '-') || z) AS altered FROM e
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY t) AS n FROM d
), nodes AS (
  SELECT t, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT t, level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY t, level, i // 2
), subroots AS (
  SELECT t, h AS subroot, row_number() OVER (ORDER BY t) - 1 AS k, count(*) OVER () AS trees, level AS depth FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, k AS i, trees AS n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, any_value((n + 1) // 2), sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2
), root AS (SELECT h AS root FROM tops WHERE n = 1),
levels AS (SELECT DISTINCT t, level, n FROM nodes WHERE n > 1), top_levels AS (SELECT DISTINCT level, n FROM tops WHERE n > 1),
steps AS (
  SELECT l.t, l.i, v.level, coalesce(s.h, '') AS sibling, (l.i >> v.level) % 2 = 0 AS own_left
  FROM leaves l JOIN levels v USING (t) LEFT JOIN nodes s ON s.t = l.t AND s.level = v.level AND s.i = xor(l.i >> v.level, 1)
  UNION ALL
  SELECT l.t, l.i, r.depth + v.level, coalesce(s.h, ''), (r.k >> v.level) % 2 = 0
  FROM leaves l JOIN subroots r USING (t) CROSS JOIN top_levels v LEFT JOIN tops s ON s.level = v.level AND s.i = xor(r.k >> v.level, 1)
), fold AS (
  SELECT t, i, 0 AS level, altered AS h FROM leaves
  UNION ALL
  SELECT t, i, level + 1, sha256(CASE WHEN own_left THEN h || sibling ELSE sibling || h END) FROM fold JOIN steps USING (t, i, level)
), ends AS (SELECT t, i, arg_max(h, level) AS folded_root FROM fold GROUP BY t, i),
proofs AS (SELECT t, i, sha256(string_agg(sibling, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY t, i)
SELECT l.doc_id, l.leaf, r.subroot, root.root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root.root AS verified
FROM leaves l JOIN subroots r USING (t) CROSS JOIN root JOIN ends USING (t, i) LEFT JOIN proofs USING (t, i)
"""

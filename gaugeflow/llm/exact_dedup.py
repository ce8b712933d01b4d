"""Exact deduplication: group by a 128-bit content hash, compare bytes inside groups, keep one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, staged, table


#: Up to so many repeated hashes (16 bytes each) and their groups (some 100 bytes each) are broadcast, so
#: that a group of any size is spread as its rows are; beyond, rows are shuffled to them.
BROADCAST_HASHES = 1_000_000


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space; null counts as empty, and empty texts
    equal each other. Of a group the longest original stays, then the smallest key; a null key
    comes after all others. Rows that share key, length and text are copies of one another: the
    first counts as kept, the others not. Other columns of `docs` are ignored, an empty table
    gives no rows.

    First pass: MD5 (the 128-bit hash), SHA-256 and length of each row. Only rows of hashes that
    occur more than once have their texts shuffled, as one row per task and text; those are
    grouped by the bytes, so equal hashes never merge different texts. A group is addressed by
    both hashes; should two different texts agree in both, the job stops with an error.
    """
    norm = F.translate(F.coalesce(F.col(text), F.lit("")), SPACE, "")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"),
        norm.alias("norm"),
    ).withColumn("h", F.unhex(F.md5(F.col("norm").cast("binary"))))
    hashed = rows.select("doc_id", "n", "h", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"))
    ids = staged(hashed.groupBy("doc_id", "n", "h", "sha").agg(F.count("*").alias("copies")), "content")
    repeated = staged(ids.groupBy("h").agg(F.sum("copies").alias("c")).filter("c > 1").select("h"), "repeated")
    # Repeated hashes bound the repeated texts, too: both are broadcast or both are shuffled to.
    small = F.broadcast if repeated.count() <= BROADCAST_HASHES else (lambda df: df)
    repeated = small(repeated)

    by_bytes = rows.join(repeated, "h", "left_semi").groupBy("h", "norm").agg(F.count("*").alias("members"))
    texts = by_bytes.groupBy("h", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha")).agg(
        F.count("*").alias("texts"), F.sum("members").alias("group_size")
    )
    texts = texts.select(
        "h", "sha", F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share both content hashes"))).otherwise(F.col("group_size")).alias("group_size")
    )
    first = F.struct((-F.col("n")).alias("n"), F.isnull("doc_id").alias("none"), F.col("doc_id").alias("id"))
    best = ids.join(repeated, "h", "left_semi").groupBy("h", "sha").agg(F.min(first).alias("best"))
    groups = small(staged(texts.join(best, ["h", "sha"]), "groups"))

    out = ids.join(groups, ["h", "sha"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    alone = F.col("best").isNull()
    stays = alone | (F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("n") == -F.col("best.n")))
    return out.select(
        F.col("doc_id").alias(key),
        F.when(alone, F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (stays & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT norm, count(*) AS group_size,
         arg_min(doc_id, (-n, doc_id)) AS keep_id
  FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""

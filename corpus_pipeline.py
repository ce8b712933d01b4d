"""A corpus pipeline: quality filter, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm import decontaminate, mixing, near_copies, quality, sharding
from gaugeflow.llm.common import staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Token shares that the toxic domains may have in the mixture; the others keep their tokens, so that
#: clean text is not thinned out, however much of the corpus it is.
TARGETS = {"low_toxic": 0.001, "high_toxic": 0.004}


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of good quality."""
    scored = quality.quality_scores(docs, table(spark, sf_dir, "labels"), COLUMNS)
    return scored.filter("predicted = 1").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more).

    The row of the smallest id stays; a null id comes last, and of rows that share the id the one
    with the least hash of its text. Ids don't tell groups: rows without one, or with one that
    unrelated texts share, stay as any other row does."""
    rows, of = near_copies.near_groups(docs.select(*COLUMNS))
    order = F.struct(F.isnull("doc_id").alias("none"), "doc_id", F.xxhash64("text").alias("hash"), "row")
    stay = rows.select("row", order.alias("order")).join(of, "row").groupBy("root").agg(F.min("order").alias("least"))
    return rows.join(stay.select(F.col("least.row").alias("row")), "row", "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), COLUMNS)
    return found.filter("NOT contaminated").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: rounded down, or up by a hash of the row."""
    rated = mixing.document_rates(docs, table(spark, sf_dir, "labels"), TARGETS, keep=COLUMNS, ceilings=True)
    times = mixing.copies(F.col("rate"), "doc_id", "text")
    return rated.withColumn("_times", times).filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]
#: The classifier and the fingerprints are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

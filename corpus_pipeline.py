"""From raw documents to packed batches: toxicity, exact and near duplicates, repeated passages, packing.

Every stage reads all rows that the stage before kept; all but the last return the columns of documents.
Nulls and empty texts pass all stages. Rows that repeat an id leave exact deduplication as one if their
texts are equal; those of different texts are documents of their own in every stage. Further columns go
along as far as the last stage. An empty table leaves every stage empty. Stages begin by releasing what the stage
before left on the driver, whose heap otherwise grows with the number of plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from devquarry.llm.common import cut, documents, release, shared_dir, small_batches, version
from devquarry.llm.exact_dedup import exact_groups
from devquarry.llm.minhash import near_duplicates
from devquarry.llm.packing import pack
from devquarry.llm.recompression import few, remove_repeats
from devquarry.llm.toxicity import rejected, trained

#: No SQL expresses the classifier, shingle classes and the optimal buckets; tests compare with brute force.
ORACLE_SQL = None


def less(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose doc_id and text are not among ``dropped``'s (doc_id, ver). Only rows that a bitmap can't clear are shuffled."""
    marked = docs.select(F.col("doc_id").alias("id"), F.struct(*docs.columns).alias("row"))
    suspects = few(marked, "id", dropped, "doc_id").select("row.*")
    clear = few(marked, "id", dropped, "doc_id", inside=False).select("row.*")
    suspects = suspects.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), version(F.col("text")).alias("ver"))
    gone = dropped.select(F.col("doc_id").alias("id"), "ver").distinct()
    return clear.unionByName(suspects.join(gone, ["id", "ver"], "left_anti").select("row.*"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier doesn't reject."""
    small_batches(spark)
    model = trained(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(~rejected(model)(F.col("text")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    release(spark)
    folder = shared_dir(spark)
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id")
    again = cut(again, folder, "again")
    if not again.isEmpty():  # only rows that a bitmap can't clear are shuffled
        marked = docs.select(F.col("doc_id").alias("id"), F.struct(*docs.columns).alias("row"))
        suspects = few(marked, "id", again, "doc_id").select("row.*")
        repeated = suspects.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        others = few(marked, "id", again, "doc_id", inside=False).select("row.*").unionByName(suspects.join(again, "doc_id", "left_anti"))
        docs = others.unionByName(repeated)
    dropped = exact_groups(docs).filter("not kept and doc_id is not null").select("doc_id", F.col("fp").alias("ver"))
    return less(docs, cut(dropped, folder, "dropped"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class at a similarity of 0.8 on shingles of five words, the row with the smallest id."""
    release(spark)
    folder = shared_dir(spark)
    dropped = near_duplicates(docs, width=5, percent=80).filter("not kept").select("doc_id", "ver")
    return less(docs, cut(dropped, folder, "dropped"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 50-word windows that also start in a row of smaller id; others are left as they are."""
    release(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    found = remove_repeats(docs, span=50, carry=others)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    values = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[values.get(c, F.col("carried")[c]).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's length bucket, batch and padding."""
    release(spark)
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written as Parquet and read again."""
    folder, docs = shared_dir(spark), documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), folder, name)
    return docs

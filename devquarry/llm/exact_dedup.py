"""Exact duplicates by content-defined chunk recipes, with DataFrame functions alone.

1. A fingerprint per text, and a bitmap of the fingerprints that more than one row has, of at most
   ``BITMAP_BITS`` bits whatever the input. Texts outside it have no equal and never move.
2. The others are cut where their content says so. Equal chunks meet once, after each map task has
   dropped its repeats, and get an identifier that is checked against the chunks' own characters.
3. Rows are equal when their ordered identifier lists are; only these lists move.

Null texts count as empty. Repeated rows are members of a group like any others. A very long text is many
chunks, none of which is longer than 2,048 characters. Only the id and the text are read, so further columns
can't clash. An empty table gives an empty result. Rows with a null id come back too; a null loses the choice of the row that stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: At least 256 characters, then up to the end of a line or sentence; 2,048 characters where there is none.
CHUNK = r"(?s).{256,2047}?(?:\n|[.] )|.{1,2048}"
BITMAP_BITS = 1 << 22


def chunks(text: Column) -> Column:
    """The text cut at content-defined places; the pieces joined are the text."""
    return F.regexp_extract_all(text, F.lit(f"({CHUNK})"), F.lit(1))


def repeated_bitmap(sums: DataFrame) -> DataFrame:
    """The bitmap of the ``place`` values whose fingerprint several rows have: 64 bits a row, so at most BITMAP_BITS / 64 rows."""
    return (
        sums.groupBy("fp", "place").agg(F.count("*").alias("n")).filter("n > 1")
        .groupBy(F.expr("place >> 6").alias("word"))
        .agg(F.bit_or(F.expr("1L << cast(place & 63 as int)")).alias("bits"))
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and fp, a 64-bit hash of the text, of every row."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("fp", F.xxhash64("text")).withColumn("place", F.expr(f"fp & {BITMAP_BITS - 1}L"))
    base = base.withColumn("word", F.expr("place >> 6"))
    bitmap = F.broadcast(repeated_bitmap(base.select("fp", "place")))  # 1 MB at most
    marked = base.join(bitmap, "word").filter("((bits >> cast(place & 63 as int)) & 1L) = 1L")
    suspects = marked.select("doc_id", "fp", "text", chunks(F.col("text")).alias("chunks"))

    # identifiers: the chunk's 64-bit hash, and a number that tells apart different chunks of one hash
    distinct = suspects.select(F.explode("chunks").alias("chunk")).groupBy("chunk").agg(chunk_hash(F.col("chunk")).alias("hash"))
    clashing = distinct.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    recipe = F.transform("chunks", lambda c: chunk_hash(c))
    if clashing.isEmpty():
        lists = suspects.select("doc_id", "fp", recipe.alias("recipe"), F.lit(1).alias("n"))
    else:
        number = distinct.join(clashing, "hash").select("hash", "chunk").groupBy("hash").agg(F.array_sort(F.collect_set("chunk")).alias("same"))
        told = (
            suspects.select("doc_id", "fp", F.posexplode("chunks").alias("at", "chunk")).withColumn("hash", chunk_hash(F.col("chunk")))
            .join(number, "hash", "left").withColumn("part", F.struct("at", "hash", F.coalesce(F.array_position("same", F.col("chunk")), F.lit(0)).alias("n")))
        )
        told = told.groupBy("doc_id", "fp").agg(F.array_sort(F.collect_set("part")).alias("parts"), F.count_if(F.col("at") == 0).alias("n"))  # rows that repeat id and text are counted by their first chunks
        lists = told.select("doc_id", "fp", F.flatten(F.transform("parts", lambda p: F.array(p["hash"], p["n"].cast("long")))).alias("recipe"), "n")
        empty = suspects.filter("text = ''").select("doc_id", "fp", F.expr("cast(array() as array<bigint>)").alias("recipe"), F.lit(1).cast("long").alias("n"))
        lists = lists.unionByName(empty)

    # once per id and text, so that repeated rows find one partner each and nothing is summed after the join
    lists = lists.withColumn("key", F.xxhash64("recipe")).groupBy("doc_id", "fp", "key", "recipe").agg(F.sum("n").alias("n"))
    groups = lists.groupBy("key", "recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size")).filter("group_size > 1")
    found = lists.join(groups, ["key", "recipe"]).select("doc_id", "fp", "keep_id", "group_size")
    whole = base.select("doc_id", "fp", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")).alias("b")
    joined = whole.join(found.alias("f"), F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b.fp") == F.col("f.fp")), "left")
    keep = F.when(F.col("f.group_size").isNull(), F.col("b.doc_id")).otherwise(F.col("f.keep_id"))
    return joined.select(
        F.col("b.doc_id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("f.group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("b.doc_id").eqNullSafe(keep).alias("kept"), F.col("b.text_sha256").alias("text_sha256"), F.col("b.fp").alias("fp"),
    )


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir)).drop("fp")


OP5_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

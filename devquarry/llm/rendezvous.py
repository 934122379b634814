"""Shards by rendezvous hashing, with DataFrame functions alone.

Each record key draws an exponential waiting time for every shard, scaled by the shard's weight; the shard with
the shortest one takes the record. A draw depends on the key and the shard's number alone, so a further shard
takes the records for which it is shortest and moves no other, and a shard that leaves gives away its own only.

A null key is a key like others. Slots are gapless in each shard: rows are counted by parts of a shard, dealt by
hash, and a row's slot is the count of the parts before its own plus its place in its part. Rows alike in id,
size and checksum, however many, are summed first and numbered by blocks. Null texts count as empty; a very
long text is read once, for its length and checksum. An empty table gives an empty result. Only the id and the
text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, documents, shared_dir

#: Rows of a part, about, and of a block of rows that are alike.
ROWS, BLOCK = 1 << 17, 1 << 14
#: Bytes that a record has besides its text.
HEADER = 8


def wait(key: Column, shard: Column, weight: Column) -> Column:
    """The time after which the shard would take the key: exponential with the weight as its rate."""
    unit = (F.shiftrightunsigned(F.xxhash64(key, shard), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(unit) / weight


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard that takes the key; of equal times the first shard's."""
    if not weights or min(weights) <= 0:
        raise ValueError("shards need weights above zero")
    rates = F.array(*[F.lit(float(w)) for w in weights])
    return F.array_min(F.transform(rates, lambda w, i: F.struct(wait(key, i, w).alias("t"), i.alias("i"))))["i"]


def grown_shard_of(key: Column, weights: Sequence[float], added: float = 1.0) -> Column:
    """The shard that takes the key once one more, of weight ``added``, stands at the end."""
    return shard_of(key, [*weights, added])


def numbered(sized: DataFrame, shard: str, count: str) -> DataFrame:
    """``sized`` (rows that stand for ``count`` alike) with ``first``, the rows of the shard before its own; needs stable input, as it is read twice."""
    total = sized.agg(F.sum(count)).first()[0] or 0
    n_parts = max(total // ROWS, 64)
    by = [c for c in sized.columns if c != shard]
    placed = sized.withColumn("part", F.pmod(F.xxhash64(*by), F.lit(n_parts)))
    parts = placed.groupBy(shard, "part").agg(F.sum(count).alias("rows"))
    ahead = Window.partitionBy(shard).orderBy("part")  # one row a part
    before = parts.select(shard, "part", (F.sum("rows").over(ahead) - F.col("rows")).alias("before"))
    own = Window.partitionBy(shard, "part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    inside = placed.withColumn("within", F.sum(count).over(own) - F.col(count))
    return inside.join(before, [shard, "part"]).withColumn("first", F.col("before") + F.col("within")).drop("part", "before", "within")


def sharded(docs: DataFrame, weights: Sequence[float], added: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard of every row."""
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    size = (F.octet_length(raw) + HEADER).cast("long")
    alike = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(raw).alias("text_crc32"))
    alike = alike.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    blocks = alike.withColumn("block", F.explode(F.expr(f"sequence(0L, (n - 1) div {BLOCK})")))
    blocks = blocks.select("doc_id", "size", "text_crc32", "block", F.least(F.lit(BLOCK), F.col("n") - F.col("block") * BLOCK).alias("n"))
    blocks = blocks.withColumn("shard", shard_of(F.col("doc_id"), weights))
    found = numbered(cut(blocks, shared_dir(docs.sparkSession), "sizes"), "shard", "n")
    found = found.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    grown = grown_shard_of(F.col("doc_id"), weights, added)
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("i")).alias("slot"), grown.alias("grown_shard"))


def op12_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharded(documents(spark, sf_dir), [1.0] * 24)
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")

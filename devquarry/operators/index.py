"""A stored inverted index: postings by term, so that a query reads its terms' rows and never the texts.

Postings lie in immutable segments (``segments.py``). An update writes the postings of what changed and the keys that are
dead, whatever the index holds, and a manifest that makes both visible; segments of one size are merged.
"""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import segments
from .retrieval import B, K1

#: Documents for which a segment has a folder of terms, the most folders, and documents for which a term's postings are dealt to one file.
DOCS_A_BUCKET, BUCKETS, DOCS_A_PART = 512, 4096, 1 << 20
#: Most tasks that write a segment.
WRITERS = 1 << 14


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder that all machines share, below spark.checkpoint.dir; a local session without one gets a temporary folder."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="devquarry-"))
        top = spark.sparkContext.getCheckpointDir()
    return f"{top.rstrip('/')}/index-{uuid.uuid4().hex}"


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass
class Index:
    """A version of an index: postings (term, key, tf, length), the number of documents, and their mean length (1 at least)."""

    spark: SparkSession
    version: segments.Version

    @property
    def folder(self) -> str:
        return self.version.folder

    @property
    def n_docs(self) -> int:
        return self.version.facts["docs"]

    @property
    def mean(self) -> float:
        return max(self.version.facts["length"] / self.n_docs, 1.0) if self.n_docs else 1.0

    def read(self, what: str, fields: str, kept, of: list[segments.Segment] | None = None) -> DataFrame:
        """The live rows of a part of the segments, each reduced by ``kept`` (segment, rows) before the dead keys are looked up."""
        kind, found = self.version.facts["key"], None
        for s in self.version.segments if of is None else of:
            own = kept(s, self.spark.read.schema(f"key {kind}, {fields}").parquet(f"{s.path}/{what}")).withColumn("segment", F.lit(s.number))
            found = own if found is None else found.unionByName(own)
        if found is None:
            found = kept(None, self.spark.createDataFrame([], f"key {kind}, {fields}")).withColumn("segment", F.lit(0))
        return segments.live(found, segments.dead_keys(self.spark, self.version, kind)).drop("segment")

    def postings(self, terms: list[str] | None = None, of: list[segments.Segment] | None = None) -> DataFrame:
        def kept(s: segments.Segment | None, rows: DataFrame) -> DataFrame:
            if terms is not None:
                rows = rows.filter(F.col("term").isin(*terms))
            if terms is not None and s is not None:  # the terms' buckets are constants to the optimizer, which lists their folders alone
                rows = rows.filter(F.col("bucket").isin(*[bucket_of(F.lit(t), s.facts["buckets"]) for t in terms]))
            return rows.select("term", "key", "tf", "length")

        return self.read("postings", "length long, term string, tf long, bucket int", kept, of)

    def lengths(self, of: list[segments.Segment] | None = None) -> DataFrame:
        return self.read("lengths", "length long", lambda _, rows: rows, of)


def counted(rows: DataFrame) -> DataFrame:
    """key, length, term and tf of token lists (key, length, all): equal tokens are counted in their row, so nothing moves."""
    n, tokens = F.size("all"), F.col("all")
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(tokens, i - 1) != F.get(tokens, i - 2)))
    # starts are an element of an array, so that they are found once a row and not once for each of them
    repeated = F.flatten(F.transform(F.array(starts), lambda own: F.transform(own, lambda i, j: F.struct(F.get(tokens, i - 1).alias("term"), (F.coalesce(F.get(own, j + 1), n + 1) - i).cast("long").alias("tf")))))
    once = F.transform(tokens, lambda w: F.struct(w.alias("term"), F.lit(1).cast("long").alias("tf")))
    plain = rows.filter(n > 0).withColumn("plain", n == F.size(F.array_distinct("all")))
    listed = plain.withColumn("all", F.when(F.col("plain"), tokens).otherwise(F.sort_array("all")))
    return listed.select("key", "length", F.explode(F.when(F.col("plain"), once).otherwise(repeated)).alias("p")).select("key", "length", "p.term", "p.tf")


def write_segment(spark: SparkSession, folder: str, number: int, lengths: DataFrame, postings: DataFrame) -> segments.Segment:
    """Lengths and postings as one segment. A term's postings are dealt to files by key where there are many documents, so that no frequent term is one task's work."""
    path = segments.fresh(folder, "segment")
    lengths.select("key", "length").write.parquet(f"{path}/lengths")
    docs, total = spark.read.parquet(f"{path}/lengths").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    buckets = min(1 << max(docs // DOCS_A_BUCKET, 1).bit_length() - 1, BUCKETS)
    parts = 1 + docs // DOCS_A_PART
    dealt = postings.select("key", "length", "term", "tf", bucket_of(F.col("term"), buckets).alias("bucket"))
    dealt = dealt.repartition(min(buckets * parts, WRITERS), "bucket", F.pmod(F.xxhash64("key"), F.lit(parts))).sortWithinPartitions("bucket", "term", "key")
    dealt.write.partitionBy("bucket").parquet(f"{path}/postings")
    return segments.Segment(number, path, docs, {"buckets": buckets, "length": total})


def build(chunks: DataFrame, key: str, tokens: Column, folder: str | None = None) -> Index:
    """Write the index of the chunks, whose keys are unique."""
    spark = chunks.sparkSession
    kind = chunks.schema[key].dataType.simpleString()
    empty = segments.Version(folder or shared_folder(spark), facts={"key": kind, "docs": 0, "length": 0})
    return Index(spark, segments.commit(spark, grown(spark, empty, chunks, key, tokens)))


def grown(spark: SparkSession, version: segments.Version, chunks: DataFrame, key: str, tokens: Column) -> segments.Version:
    """``version`` with a segment of the chunks; not yet visible."""
    number = max(version.next_number() - 1, 1) if version.dead else version.next_number()  # what the last dead keys leave room for
    path = segments.fresh(version.folder, "tokens")  # texts are cut once, for lengths and postings
    chunks.select(F.col(key).alias("key"), tokens.alias("all")).select("key", F.size("all").cast("long").alias("length"), "all").write.parquet(path)
    told = spark.read.schema(f"key {version.facts['key']}, length long, all array<string>").parquet(path)
    own = write_segment(spark, version.folder, number, told, counted(told))
    target, fs = segments.path_of(spark, path)
    fs.delete(target, True)
    facts = version.facts | {"docs": version.facts["docs"] + own.rows, "length": version.facts["length"] + own.facts["length"]}
    return replace(version, segments=(*version.segments, own) if own.rows else version.segments, facts=facts)


def opened(spark: SparkSession, folder: str, number: int | None = None) -> Index:
    return Index(spark, segments.opened(spark, folder, number))


def forked(index: Index) -> Index:
    """An index of its own that begins with this one's segments; nothing is copied."""
    return Index(index.spark, segments.forked(index.spark, index.version, shared_folder(index.spark)))


def update(index: Index, chunks: DataFrame, key: str, tokens: Column, removed: DataFrame | None = None, merging: bool = True) -> Index:
    """The next version: ``chunks`` in place of what their keys had, ``removed`` keys gone. It writes what changed alone, besides merges; this version stays readable."""
    spark, version = index.spark, index.version
    gone = chunks.select(F.col(key).alias("key"))
    if removed is not None:
        gone = gone.unionByName(removed.select(F.col(key).alias("key")))
    dead = segments.with_dead(spark, version, gone)
    keys = spark.read.schema(f"key {version.facts['key']}").parquet(dead.dead[-1][0])
    docs, length = index.lengths().join(keys, "key", "left_semi").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    dead = replace(dead, facts=version.facts | {"docs": version.facts["docs"] - docs, "length": version.facts["length"] - length})
    found = Index(spark, segments.commit(spark, grown(spark, dead, chunks, key, tokens)))
    while merging and (old := segments.to_merge(found.version)):
        found = merge(found, old)
    return found


def merge(index: Index, old: list[segments.Segment] | None = None) -> Index:
    """The next version, with the live rows of some segments (all unless told) as one."""
    old = list(index.version.segments) if old is None else old
    number = max((s.number for s in old), default=1)
    new = write_segment(index.spark, index.folder, number, index.lengths(old), index.postings(None, old))
    return Index(index.spark, segments.commit(index.spark, segments.merged(index.version, old, new)))


def holding_all(index: Index, terms: list[str]) -> DataFrame:
    """The keys of documents that hold every term."""
    wanted = sorted(set(terms))
    return index.postings(wanted).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("key")


def search(index: Index, terms: list[str], top_k: int | None = None) -> DataFrame:
    """key and score of chunks with a term: sum over terms of idf x saturated frequency; the best ``top_k``, ties by key."""
    own = index.postings(sorted(set(terms)))
    frequent = own.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term of the query
    idf = F.log((index.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / index.mean))
    parts = own.join(F.broadcast(frequent), "term").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("term", (idf * weight).alias("part")))).alias("parts"))
    # parts are added in the order of terms, not of their arrival: chunks that are alike have one score, and ties stay ties
    scored = parts.select("key", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["part"]).alias("score")).filter("score > 0")
    return scored.orderBy(F.desc("score"), "key").limit(top_k) if top_k else scored


def score_one(index: Index, terms: list[str], key) -> float:
    """The score of one chunk, 0 if it has no term."""
    found = search(index, terms).filter(F.col("key") == F.lit(key)).first()
    return found.score if found else 0.0


def top_terms(index: Index, least: int = 1) -> DataFrame:
    """term and df, the number of chunks that have it."""
    return index.postings().groupBy("term").agg(F.count("*").alias("df")).filter(F.col("df") >= least)

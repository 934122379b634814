"""Keyed tables that streams keep: a micro-batch writes what it changes as one segment, never the whole table.

Rows lie in folders by key, so that a lookup lists its keys' folders alone. The number of the last micro-batch is part of
the version that it made, so a batch that is repeated after a failure changes nothing. Of changes of a key the greatest
order wins, whenever it comes; at equal order the later batch. A removal is a row that only hides its key.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import segments
from ..operators.delivery import keep_last

#: Rows for which a segment has a folder, and the most folders.
ROWS_A_BUCKET, BUCKETS = 8192, 4096


@dataclass
class Table:
    """A version of a keyed table. Its facts: columns (DDL), key, order, and batch, the last micro-batch."""

    spark: SparkSession
    version: segments.Version

    @property
    def key(self) -> str:
        return self.version.facts["key"]

    def read(self, keys: list | None = None, of: Iterable[segments.Segment] | None = None, hidden: bool = False) -> DataFrame:
        """The live rows, of some keys alone if told."""
        facts, found = self.version.facts, None
        fields = f"{facts['columns']}, removed boolean, own_bucket int"
        for s in self.version.segments if of is None else of:
            own = self.spark.read.schema(fields).parquet(s.path)
            if keys is not None:  # the keys' folders are constants to the optimizer
                own = own.filter(F.col("own_bucket").isin(*[F.pmod(F.xxhash64(self.literal(k)), F.lit(s.facts["buckets"])).cast("int") for k in keys]) & F.col(self.key).isin(*keys))
            own = own.withColumn("own_segment", F.lit(s.number))
            found = own if found is None else found.unionByName(own)
        if found is None:
            found = self.spark.createDataFrame([], fields).withColumn("own_segment", F.lit(0))
        dead = segments.dead_keys(self.spark, self.version, facts["kind"])
        if dead is not None and keys is not None:
            dead = dead.filter(F.col("dead").isin(*keys))
        rows = segments.live(found, dead, self.key, "own_segment").drop("own_segment", "own_bucket")
        return rows if hidden else rows.filter("not removed").drop("removed")

    def literal(self, value):
        return F.lit(value).cast(self.version.facts["kind"])

    def rows(self) -> DataFrame:
        return self.read()

    def get(self, keys: list) -> DataFrame:
        """The rows of some keys; other folders are not read."""
        return self.read(keys)


def create(spark: SparkSession, folder: str, columns: str, key: str, order: str) -> Table:
    """An empty table; ``columns`` is DDL and holds the key and the order. The names removed, dead, before, own_segment and own_bucket are the table's."""
    kind = dict(spark.createDataFrame([], columns).dtypes)[key]
    return Table(spark, segments.commit(spark, segments.Version(folder, facts={"columns": columns, "key": key, "order": order, "kind": kind, "batch": -1})))


def opened(spark: SparkSession, folder: str) -> Table:
    return Table(spark, segments.opened(spark, folder))


def write_segment(table: Table, number: int, rows: DataFrame, expected: int) -> segments.Segment:
    path = segments.fresh(table.version.folder, "segment")
    buckets = min(1 << max(expected // ROWS_A_BUCKET, 1).bit_length() - 1, BUCKETS)
    dealt = rows.withColumn("own_bucket", F.pmod(F.xxhash64(table.key), F.lit(buckets)).cast("int")).repartition(buckets, "own_bucket").sortWithinPartitions("own_bucket", table.key)
    dealt.write.partitionBy("own_bucket").parquet(path)
    written = table.spark.read.schema(f"{table.version.facts['columns']}, removed boolean, own_bucket int").parquet(path).count() if expected else 0
    return segments.Segment(number, path, written, {"buckets": buckets})


def apply(table: Table, changes: DataFrame, batch: int | None = None, merging: bool = True) -> Table:
    """The next version after changes (the table's columns and removed). A batch that the table has already changes nothing."""
    spark, facts = table.spark, table.version.facts
    if batch is not None and batch <= facts["batch"]:
        return table
    key, order = facts["key"], facts["order"]
    columns = [*table.spark.createDataFrame([], facts["columns"]).columns, "removed"]
    last = keep_last(changes.select(*columns).filter(F.col(key).isNotNull()), [key], order)
    have = table.read(hidden=True).select(F.col(key).alias("k"), F.col(order).alias("o"))
    late = have.join(last.select(F.col(key).alias("k")).distinct(), "k", "left_semi")
    newer = last.join(late, (F.col(key) == F.col("k")) & (F.col("o") > F.col(order)), "left_anti").select(*columns)
    held = segments.fresh(table.version.folder, "segment")  # what wins is settled before anything of it is used twice
    newer.write.parquet(held)
    own = spark.read.schema(newer.schema).parquet(held)
    count = own.count()
    version = replace(table.version, facts=facts | ({} if batch is None else {"batch": batch}))
    if count:
        version = segments.with_dead(spark, version, own.select(F.col(key).alias("key")))
        new = write_segment(Table(spark, version), version.dead[-1][1], own, count)
        version = replace(version, segments=(*version.segments, new))
    found = Table(spark, segments.commit(spark, version))
    target, fs = segments.path_of(spark, held)
    fs.delete(target, True)
    while merging and (old := segments.to_merge(found.version)):
        found = merge(found, old)
    return found


def merge(table: Table, old: list[segments.Segment] | None = None) -> Table:
    """The next version with the live rows of some segments (all unless told) as one."""
    old = list(table.version.segments) if old is None else old
    new = write_segment(table, max((s.number for s in old), default=1), table.read(of=old, hidden=True), sum(s.rows for s in old))
    return Table(table.spark, segments.commit(table.spark, segments.merged(table.version, old, new)))


def maintain(changes: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the table of ``folder``, which must be there, by a stream of changes."""
    def step(batch: DataFrame, number: int) -> None:
        apply(opened(batch.sparkSession, folder), batch, number)

    writer = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="100 milliseconds")).start()


# -- logs ----------------------------------------------------------------------------------------------------


def append(events: DataFrame, folder: str, checkpoint: str, as_json: bool = False) -> StreamingQuery:
    """An append-only log of a stream. Each micro-batch has a folder of its own that it overwrites, so a repeated batch adds nothing."""
    def step(batch: DataFrame, number: int) -> None:
        writer = batch.write.mode("overwrite")
        (writer.json if as_json else writer.parquet)(f"{folder}/batch={number}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scan(spark: SparkSession, folder: str, columns: str, at: str | None = None, since=None, until=None, as_json: bool = False) -> DataFrame:
    """The log's events, of a time from ``since`` to ``until`` (both included) if told; newest batches are no different from others."""
    reader = spark.read.schema(f"{columns}, batch int")
    rows = (reader.json if as_json else reader.parquet)(folder).drop("batch")
    if since is not None:
        rows = rows.filter(F.col(at) >= F.lit(since))
    return rows.filter(F.col(at) <= F.lit(until)) if until is not None else rows

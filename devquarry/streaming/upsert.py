"""Incremental maintenance: keyed upserts and removals, counters, skipped repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.delivery import keep_last


def read_changes(spark: SparkSession, folder: str, schema: str, files_at_once: int = 64) -> DataFrame:
    """Change files as they arrive, a bounded number for each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(folder)


def apply_changes(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """The table after changes (its columns, ``order`` and ``removed``): the last change of a key wins, removed keys go."""
    last = keep_last(changes, [key], order)
    return table.join(last.select(key), key, "left_anti").unionByName(last.filter("not removed").select(*table.columns))


def access_counts(events: DataFrame, key: str) -> DataFrame:
    """Running counts; write in update mode."""
    return events.groupBy(key).agg(F.count("*").alias("accesses"))


def fresh_content(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files (path, content) whose content hash the ledger (path, hash) does not have."""
    return files.withColumn("hash", F.sha2("content", 256)).join(known, ["path", "hash"], "left_anti")

"""Signals of external sources for messages: sources in order, keys asked once, answers kept in a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..streaming import tables

CACHE = "place string, source string, name string, signal string, asked timestamp"


@dataclass(frozen=True)
class Source:
    """A named source: the keys of a message (an array, in order), and what answers a list of keys with a signal for those that have one."""

    name: str
    keys: Callable[[Column], Column]
    ask: Callable[[list[str]], dict[str, str]]


def cache(spark, folder: str) -> tables.Table:
    """An empty table of answers; a key without a signal is kept too, so that it isn't asked again."""
    return tables.create(spark, folder, CACHE, "place", "asked")


def answered(known: tables.Table, source: Source, keys: DataFrame, at_once: int) -> tables.Table:
    """The answers with those of ``keys`` (name) that they lack, asked in lists of ``at_once`` at most."""
    have = known.rows().filter(F.col("source") == source.name).select("name")
    lacking = keys.select("name").distinct().join(have, "name", "left_anti")

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            names = sorted(frame["name"])
            for i in range(0, len(names), at_once):
                found = source.ask(names[i : i + at_once])
                yield pd.DataFrame({"name": names[i : i + at_once], "signal": [found.get(n) for n in names[i : i + at_once]]})

    told = lacking.mapInPandas(asked, "name string, signal string")
    rows = told.select(F.concat(F.lit(f"{source.name}|"), "name").alias("place"), F.lit(source.name).alias("source"), "name", "signal", F.current_timestamp().alias("asked"), F.lit(False).alias("removed"))
    # what was asked is written before it is used, so that no plan asks again
    held = tables.segments.fresh(known.version.folder, "segment")
    rows.write.parquet(held)
    return tables.apply(known, known.spark.read.parquet(held))


def resolved(messages: DataFrame, sources: list[Source], known: tables.Table, at_once: int = 50) -> tuple[DataFrame, tables.Table]:
    """id, source, name and signal of the messages (id, message) that have one, and the table of answers.

    A source is asked only about messages that those before it left open. Of a message's keys the first with a signal
    counts. Ids are unique.
    """
    out, left = None, messages.select("id", "message")
    for source in sources:
        keyed = left.select("id", F.posexplode(source.keys(F.col("message"))).alias("n", "name"))
        known = answered(known, source, keyed, at_once)
        told = known.rows().filter((F.col("source") == source.name) & F.col("signal").isNotNull()).select("name", "signal")
        hit = keyed.join(told, "name").groupBy("id").agg(F.min_by(F.struct("name", "signal"), "n").alias("x")).select("id", F.lit(source.name).alias("source"), "x.name", "x.signal")
        out = hit if out is None else out.unionByName(hit)
        left = left.join(hit.select("id"), "id", "left_anti")
    return out, known

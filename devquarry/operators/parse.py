"""Source files as their definitions: chunks with kind, parent, bases, parameters and measures by scopes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code, scopes

LANGUAGES = tuple(scopes.HEADS)
FIELDS = "kind string, name string, parent string, start_line int, end_line int, parameters int, cyclomatic int, cognitive int, nesting int, bases array<string>, content string"


def parsed(files: DataFrame) -> DataFrame:
    """path, language, definitions (an array) and cyclomatic, cognitive and nesting of files (path, language, content) in one of LANGUAGES.

    A file is parsed on its own, in Arrow batches; the limit on scanned files bounds it. Null contents count as empty.
    """
    kinds = pa.struct([("kind", pa.string()), ("name", pa.string()), ("parent", pa.string()), *((n, pa.int32()) for n in ("start_line", "end_line", "parameters", "cyclomatic", "cognitive", "nesting")), ("bases", pa.list_(pa.string())), ("content", pa.string())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, languages = batch.column("path"), batch.column("language")
            rows, sizes = [], []
            for language, content in zip(languages.to_pylist(), batch.column("content").to_pylist()):
                text = content or ""
                own, size = scopes.definitions(text, language)
                rows.append([{**{f.name: d.get(f.name) for f in kinds}, "name": d["qualified"], "content": text[d["at"] : d["end"]]} for d in own])
                sizes.append(size)
            columns = [paths, languages, pa.array(rows, pa.list_(kinds)), *(pa.array([s[i] for s in sizes], pa.int32()) for i in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "language", "definitions", "cyclomatic", "cognitive", "nesting"])

    own = files.filter(F.col("language").isin(*LANGUAGES)).select("path", "language", "content")
    return own.mapInArrow(found, f"path string, language string, definitions array<struct<{', '.join(x.replace(' ', ': ', 1) for x in FIELDS.split(', '))}>>, cyclomatic int, cognitive int, nesting int")


def chunk_id(path: Column, kind: Column, name: Column, start: Column, end: Column) -> Column:
    placed = F.concat_ws(":", path, start, end)
    return F.when(name == "", placed).otherwise(F.concat_ws("::", path, kind, name, start))


def definitions(files: DataFrame) -> DataFrame:
    """A chunk for each definition: id, path, language, the fields of FIELDS and its signature."""
    rows = parsed(files).select("path", "language", F.explode("definitions").alias("d")).select("path", "language", "d.*")
    id_ = chunk_id(F.col("path"), F.col("kind"), F.col("name"), F.col("start_line"), F.col("end_line"))
    return rows.withColumn("id", id_).withColumn("signature", code.signature(F.col("content")))


def inheritance(chunks: DataFrame) -> DataFrame:
    """src (id of a definition), kind and base of each base that a definition names."""
    return chunks.select(F.col("id").alias("src"), "kind", F.explode("bases").alias("base"))


def measures(files: DataFrame) -> DataFrame:
    """path, cyclomatic, cognitive and way of every file: by scopes for LANGUAGES, by text for others."""
    own = parsed(files).select("path", F.col("cyclomatic").cast("long").alias("cyclomatic"), F.col("cognitive").cast("long").alias("cognitive"), F.lit("scopes").alias("way"))
    rest = files.filter(F.col("language").isNull() | ~F.col("language").isin(*LANGUAGES)).withColumn("content", F.coalesce("content", F.lit("")))
    return own.unionByName(rest.select("path", code.cyclomatic(F.col("content")).alias("cyclomatic"), code.cognitive(F.col("content")).alias("cognitive"), F.lit("text").alias("way")))

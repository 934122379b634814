"""Lookups and removals over the stores of an index: chunks, entities, and what else is kept by file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(chunks: DataFrame, key: str, ids: list) -> DataFrame:
    """The chunks of some ids, a list of the caller's; ids that aren't there are passed over."""
    return chunks.filter(F.col(key).isin(*ids)) if ids else chunks.limit(0)


def files(chunks: DataFrame, file: str) -> DataFrame:
    """The distinct files of the chunks."""
    return chunks.select(file).filter(F.col(file).isNotNull()).distinct()


def entities(rows: DataFrame, kind: str, name: str, kinds: tuple[str, ...] = (), file: str | None = None, language: str | None = None) -> DataFrame:
    """Entities, of some kinds, of one file and of one language (a column of that name) if told, in order of kind and name; ``kind`` and ``name`` are columns."""
    own = rows.filter(F.col(kind).isin(*kinds)) if kinds else rows
    own = own.filter(F.col("language") == F.lit(language)) if language is not None else own
    own = own.filter(F.col("file") == F.lit(file)) if file is not None else own
    return own.orderBy(kind, name)


def seed(chunks: DataFrame, ending: str, name: str | None = None) -> DataFrame:
    """The chunk with the lowest start line, then end line and id, among those (id, file, name, start_line, end_line) whose file ends with ``ending``, and which a function's name picks if told."""
    own = chunks.filter(F.col("file").endswith(ending))
    own = own.filter(F.col("name") == F.lit(name)) if name is not None else own
    return own.orderBy("start_line", "end_line", "id").limit(1)


def without_file(stores: dict[str, DataFrame], file: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every store (with a column file) without a file's rows, and store and removed, the number of rows that went, of each."""
    gone = None
    for name, rows in stores.items():
        own = rows.filter(F.col("file") == F.lit(file)).agg(F.count("*").alias("removed")).select(F.lit(name).alias("store"), "removed")
        gone = own if gone is None else gone.unionByName(own)
    return {name: rows.filter(F.col("file").isNull() | (F.col("file") != F.lit(file))) for name, rows in stores.items()}, gone


def dispatched(chunks: DataFrame, adapters: list[tuple[str, Callable[[Column], Column], Callable[[DataFrame], tuple[DataFrame, DataFrame]]]]) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, symbol, file) and edges (src, dst, kind) of all chunks (file among their columns), each given to the first adapter that supports its file.

    An adapter is a name, a condition on the file, and what makes nodes and edges of its chunks. Nodes of one symbol and
    file that overlapping chunks gave are the one of smallest id; edges follow. Chunks without an adapter give nothing.
    """
    taken, nodes, edges = F.lit(False), None, None
    for _, supports, make in adapters:
        own = F.coalesce(supports(F.col("file")), F.lit(False))
        n, e = make(chunks.filter(own & ~taken))
        nodes, edges = (n, e) if nodes is None else (nodes.unionByName(n), edges.unionByName(e))
        taken = taken | own
    canonical = nodes.groupBy("symbol", "file").agg(F.min("id").alias("only"))
    same = nodes.select("id", "symbol", "file").distinct().join(canonical, ["symbol", "file"]).select("id", "only")
    for end in ("src", "dst"):
        met = same.withColumnRenamed("id", end).withColumnRenamed("only", f"{end}_only")
        edges = edges.join(met, end, "left").withColumn(end, F.coalesce(f"{end}_only", end)).drop(f"{end}_only")
    return canonical.select(F.col("only").alias("id"), "symbol", "file"), edges.select("src", "dst", "kind").distinct()

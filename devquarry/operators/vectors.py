"""An approximate index of vectors: cells around centroids, so that a query reads its nearest cells.

Centroids are fitted on a sample of at most ``SAMPLE`` vectors; every vector is stored, in the folder of its nearest
centroid. How many cells a query reads is chosen when the index is built: the fewest that find ``recall`` of the true
neighbours of at most ``ASKED`` sampled vectors among all vectors. Changes are segments with dead keys (``segments.py``);
cells stay as they are until the index is built anew. Scores are cosines. Vectors without a length, with nulls or NaNs
in them or of another dimension are not stored, and repeated keys must not be.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import segments
from .index import shared_folder

#: Vectors that the centroids are fitted on, rounds of the fit, most cells, and vectors that the number of cells to read is chosen on.
SAMPLE, ROUNDS, CELLS, ASKED = 20_000, 10, 4096, 64
#: Vectors of a cell and queries of it that one group compares, about, and queries and products that are held at once.
VECTORS, QUERIES, SLICE, AT_ONCE = 2048, 4096, 128, 1 << 17


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def units(vectors: DataFrame, key: str, vector: str, dim: int | None = None) -> DataFrame:
    """key and vec, of length 1 in doubles, of the vectors that have a direction."""
    own = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    own = own.withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v"))))
    own = own.filter("norm > 0 and norm < double('Infinity')" + (f" and size(v) = {dim}" if dim else ""))
    return own.select("key", F.transform("v", lambda x: x / F.col("norm")).alias("vec"))


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def fitted(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of length 1 of a sample: spherical k-means from the sample's first distinct rows, empty cells left where they are."""
    centroids = np.unique(sample, axis=0)
    centroids = centroids[np.random.default_rng(7).permutation(len(centroids))[:cells]].copy()
    for _ in range(ROUNDS):
        nearest = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        norms = np.linalg.norm(sums, axis=1)
        centroids[norms > 0] = sums[norms > 0] / norms[norms > 0, None]
    return centroids


def in_cells(unit: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds the nearest centroid's number as cell."""
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest = (matrix(batch.column("vec")) @ centroids.T).argmax(1) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int32())], names=["key", "vec", "cell"])

    return unit.mapInArrow(told, f"key {unit.schema['key'].dataType.simpleString()}, vec array<double>, cell int")


@dataclass
class VectorIndex:
    """A version of an index, its centroids and the cells that a query reads unless told."""

    spark: SparkSession
    version: segments.Version

    @property
    def centroids(self) -> np.ndarray:
        return np.array(self.version.facts["centroids"], float).reshape(-1, max(self.version.facts["dim"], 1))

    @property
    def probes(self) -> int:
        return self.version.facts["probes"]

    @property
    def count(self) -> int:
        return self.version.facts["vectors"]

    def stored(self, cells: list[int] | None = None, of: list[segments.Segment] | None = None) -> DataFrame:
        """key, vec and cell of the live vectors, of some cells alone if told: other folders are not listed."""
        kind, found = self.version.facts["key"], None
        for s in self.version.segments if of is None else of:
            own = self.spark.read.schema(f"key {kind}, vec array<double>, cell int").parquet(s.path)
            own = (own if cells is None else own.filter(F.col("cell").isin(*cells))).withColumn("segment", F.lit(s.number))
            found = own if found is None else found.unionByName(own)
        if found is None:
            found = self.spark.createDataFrame([], f"key {kind}, vec array<double>, cell int, segment int")
        return segments.live(found, segments.dead_keys(self.spark, self.version, kind)).drop("segment")

    def nearest_cells(self, query: list[float], probes: int) -> list[int]:
        scores = self.centroids @ np.array(query, float)
        return [int(c) for c in np.argsort(-scores, kind="stable")[:probes]]


def write_segment(spark: SparkSession, version: segments.Version, number: int, placed: DataFrame) -> segments.Segment:
    path = segments.fresh(version.folder, "segment")
    few = max(len(version.facts["centroids"]), 1)
    # a cell with many vectors is several tasks' work, as rows are dealt by key as well
    dealt = placed.select("key", "vec", "cell").repartition(few, "cell", F.pmod(F.xxhash64("key"), F.lit(4)))
    dealt.write.partitionBy("cell").parquet(path)
    rows = spark.read.schema(f"key {version.facts['key']}, vec array<double>, cell int").parquet(path).count()
    return segments.Segment(number, path, rows)


def build(vectors: DataFrame, key: str, vector: str, cells: int | None = None, recall: float = 0.97, top_k: int = 10, folder: str | None = None) -> VectorIndex:
    """Write the index of all vectors: about sqrt(n) cells unless told, and cells to read for the wanted recall of the best ``top_k``."""
    spark = vectors.sparkSession
    kind = vectors.schema[key].dataType.simpleString()
    unit = units(vectors, key, vector)
    order = F.xxhash64("key", F.lit(11))  # a sample that no order of the rows decides
    dims = unit.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    dim, n = (dims.d, dims.n) if dims else (0, 0)
    unit = unit.filter(F.size("vec") == dim)
    sample = np.array([r.vec for r in unit.orderBy(order).limit(SAMPLE).select("vec").collect()], float).reshape(-1, max(dim, 1))
    cells = min(cells or max(int(n**0.5), 1), CELLS)
    centroids = fitted(sample, cells) if n else sample
    facts = {"key": kind, "dim": dim, "vectors": n, "probes": max(len(centroids), 1), "centroids": centroids.tolist()}
    version = segments.Version(folder or shared_folder(spark), facts=facts)
    if n:
        version = replace(version, segments=(write_segment(spark, version, 1, in_cells(unit, centroids)),))
    index = VectorIndex(spark, version)
    if n:
        asked = index.stored().orderBy(order).limit(ASKED).select("key", "vec")
        version = replace(version, facts=facts | {"probes": probes_for(index, asked, recall, top_k)})
    return VectorIndex(spark, segments.commit(spark, version))


def probes_for(index: VectorIndex, asked: DataFrame, recall: float, top_k: int) -> int:
    """The fewest nearest cells that hold ``recall`` of the true best ``top_k`` of the asked vectors, which are few."""
    rows = {r.key: np.array(r.vec) for r in asked.collect()}
    true = search_many(index, asked, top_k, exact=True).select("query", "cell").collect()
    centroids = index.centroids
    ranks = {key: {int(c): i for i, c in enumerate(np.argsort(-(centroids @ vec), kind="stable"))} for key, vec in rows.items()}
    depth = sorted(ranks[r.query][r.cell] for r in true)
    return depth[min(int(np.ceil(recall * len(depth))), len(depth)) - 1] + 1 if depth else 1


def search(index: VectorIndex, query: list[float], top_k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """key and score of the nearest vectors, ties by key; ``exact`` reads all cells."""
    asked = np.array(query, float)
    norm = float(np.linalg.norm(asked))
    unit = F.array(*[F.lit(float(x)) for x in (asked / norm if norm else asked)])
    rows = index.stored(None if exact or not index.version.segments else index.nearest_cells(query, probes or index.probes))
    return rows.select("key", dot(F.col("vec"), unit).alias("score")).orderBy(F.desc("score"), "key").limit(top_k)


def best_of(queries: np.ndarray, vectors: np.ndarray, keys: list, top_k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of queries, rows of vectors and scores of the best ``top_k`` of each query, ties by key.

    A product of matrices finds what can be among them; these are scored in the order of the dimensions, as ``dot`` does.
    """
    rank = np.empty(len(keys), np.int64)
    rank[sorted(range(len(keys)), key=keys.__getitem__)] = np.arange(len(keys))
    out = []
    for start in range(0, len(queries), SLICE):
        own = queries[start : start + SLICE]
        near = own @ vectors.T
        least = np.partition(near, len(keys) - top_k, axis=1)[:, len(keys) - top_k] if len(keys) > top_k else np.full(len(own), -np.inf)
        rows, cols = np.nonzero(near >= least[:, None] - 1e-9)  # unit vectors: both sums err by far less
        score = np.concatenate([np.zeros(0), *[np.cumsum(own[rows[i : i + AT_ONCE]] * vectors[cols[i : i + AT_ONCE]], axis=1)[:, -1] for i in range(0, len(rows), AT_ONCE)]])
        order = np.lexsort((rank[cols], -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < top_k
        out.append((rows[first] + start, cols[first], score[first]))
    return tuple(np.concatenate(x) for x in zip(*out))


def search_many(index: VectorIndex, queries: DataFrame, top_k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
    """query, key, score, rank and cell of the nearest vectors of each of a block of queries (key, vec).

    A query meets the vectors of its nearest cells by cell; large cells are dealt, and each part is compared as a product of
    matrices that keeps the best ``top_k`` of a query, so that only those meet.
    """
    want = len(index.centroids) if exact else (probes or index.probes)
    centroids = index.centroids
    unit = units(queries, "key", "vec", index.version.facts["dim"])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(-(matrix(batch.column("vec")) @ centroids.T), axis=1, kind="stable")[:, :want] if batch.num_rows else np.zeros((0, want))
            cells = pa.array(order.tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=["query", "asked", "cells"])

    kind = unit.schema["key"].dataType.simpleString()
    probed = unit.mapInArrow(probing, f"query {kind}, asked array<double>, cells array<int>").select("query", "asked", F.explode("cells").alias("cell"))
    stored = index.stored()
    sizes = stored.groupBy("cell").agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("vs"))
    sizes = sizes.join(probed.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qs")), "cell")
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = probed.join(F.broadcast(sizes), "cell").select("cell", "query", "asked", dealt("query", "qs").alias("q"), every("vs").alias("v"))  # sizes: a row for each cell
    right = stored.join(F.broadcast(sizes), "cell").select("cell", "key", "vec", dealt("key", "vs").alias("v"), every("qs").alias("q"))
    own = index.version.facts["key"]

    def compared(a: pa.Table, b: pa.Table) -> pa.Table:
        names, rows, hits = ["query", "hits"], pa.array([], a.schema.field("query").type), []
        type_ = pa.list_(pa.struct([("d", pa.float64()), ("key", b.schema.field("key").type), ("cell", pa.int32())]))
        if not (a.num_rows and b.num_rows):
            return pa.table([rows, pa.array(hits, type_)], names=names)
        a, b = a.combine_chunks(), b.combine_chunks()
        q, v, score = best_of(matrix(a.column("asked").combine_chunks()), matrix(b.column("vec").combine_chunks()), b.column("key").to_pylist(), top_k)
        key, cell = b.column("key").combine_chunks().take(pa.array(v)), b.column("cell").combine_chunks().take(pa.array(v))
        found = pa.StructArray.from_arrays([pa.array(-score), key, cell], fields=list(type_.value_type))
        ends = pa.array(np.searchsorted(q, np.arange(a.num_rows + 1)).astype(np.int32))
        return pa.table([a.column("query"), pa.ListArray.from_arrays(ends, found, type=type_)], names=names)

    by = ["cell", "v", "q"]
    parts = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(compared, f"query {kind}, hits array<struct<d: double, key: {own}, cell: int>>")
    best = parts.groupBy("query").agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, top_k).alias("hits"))
    return best.select("query", F.posexplode("hits").alias("i", "hit")).select("query", "hit.key", (-F.col("hit.d")).alias("score"), (F.col("i") + 1).alias("rank"), "hit.cell")


def upsert(index: VectorIndex, vectors: DataFrame, key: str, vector: str, removed: DataFrame | None = None, merging: bool = True) -> VectorIndex:
    """The next version: ``vectors`` in place of what their keys had, ``removed`` keys dead. Only these are written, besides merges."""
    spark, version = index.spark, index.version
    gone = vectors.select(F.col(key).alias("key"))
    if removed is not None:
        gone = gone.unionByName(removed.select(F.col(key).alias("key")))
    new = segments.with_dead(spark, version, gone)
    keys = spark.read.schema(f"key {version.facts['key']}").parquet(new.dead[-1][0])
    lost = index.stored().join(keys, "key", "left_semi").count()
    own = write_segment(spark, version, new.dead[-1][1], in_cells(units(vectors, key, vector, version.facts["dim"]), index.centroids))
    facts = version.facts | {"vectors": version.facts["vectors"] - lost + own.rows}
    new = replace(new, segments=(*version.segments, own) if own.rows else version.segments, facts=facts)
    found = VectorIndex(spark, segments.commit(spark, new))
    while merging and (old := segments.to_merge(found.version)):
        found = compact(found, old)
    return found


def delete(index: VectorIndex, keys: DataFrame, key: str) -> VectorIndex:
    """The next version, with the keys dead; no vector is written."""
    return upsert(index, index.stored([-1]).limit(0), "key", "vec", keys.select(F.col(key).alias("key")), merging=False)


def compact(index: VectorIndex, old: list[segments.Segment] | None = None, owners: DataFrame | None = None) -> VectorIndex:
    """The next version, with the live vectors of some segments (all unless told) as one; with ``owners`` (key) also without vectors that none of them owns."""
    old = list(index.version.segments) if old is None else old
    rows = index.stored(None, old)
    rows = rows if owners is None else rows.join(owners.select("key"), "key", "left_semi")
    new = write_segment(index.spark, index.version, max((s.number for s in old), default=1), rows)
    version = segments.merged(index.version, old, new)
    found = VectorIndex(index.spark, version)
    if owners is not None:
        found = replace(found, version=replace(version, facts=version.facts | {"vectors": found.stored().count()}))
    return VectorIndex(index.spark, segments.commit(index.spark, found.version))

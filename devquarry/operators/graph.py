"""Graph operators over (src, dst, kind) tables, as joins by level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import shared_folder

#: How much a score keeps over an edge of each kind; 0.70 for all others.
MULTIPLIERS = {"Implements": 0.85, "UsesType": 0.75, "TestedBy": 0.80, "Documents": 0.65, "ReferencesConcept": 0.60, "Writes": 0.90, "Reads": 0.80, "AccessesResource": 0.75}


def edge_multiplier(kind: Column) -> Column:
    out = F.lit(0.70)
    for name, value in MULTIPLIERS.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def settled(front: DataFrame) -> DataFrame:
    """What a hop has found, in the checkpoint folder: the next hop's plan begins there, however many there are."""
    shared_folder(front.sparkSession)  # a local session gets a folder if it has none
    return front.checkpoint()


def reachable(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """id and hop of nodes within ``hops`` of the seeds (column id), seeds left out; first visit counts."""
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    front = seen
    for hop in range(1, hops + 1):
        front = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop))
        front = settled(front)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("hop > 0")


def shortest_path(edges: DataFrame, source, target, most: int) -> DataFrame:
    """One row: the nodes of a shortest path of ``most`` edges at most, the smallest nodes first; none if there is none."""
    front = edges.sparkSession.createDataFrame([(source, [source])], f"id {dict(edges.dtypes)['src']}, path array<{dict(edges.dtypes)['src']}>")
    levels = front
    seen = front.select("id")
    for _ in range(most):
        step = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        front = settled(step.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        if front.isEmpty():
            break
        levels, seen = levels.unionByName(front), seen.unionByName(front.select("id"))
        if not front.filter(F.col("id") == F.lit(target)).isEmpty():
            break
    return levels.filter(F.col("id") == F.lit(target)).select("path")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))


def merge_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges (src, dst, kind, weight) after renaming nodes by (old, new): loops go, weights of equal edges add up."""
    for end in ("src", "dst"):
        own = mapping.select(F.col("old").alias(end), F.col("new").alias(f"new_{end}"))
        edges = edges.join(own, end, "left").withColumn(end, F.coalesce(f"new_{end}", end)).drop(f"new_{end}")
    return edges.filter("src <> dst").groupBy("src", "dst", "kind").agg(F.sum("weight").alias("weight"))


def components(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """id and component, the smallest id of the weakly connected part. Labels fall by neighbours and jumps; each round is checkpointed.

    Pairs are written once to the shared folder, for all rounds, and repeats stay, as they move no smallest label: a task
    holds labels of nodes, and no table of edges.
    """
    spark, path = edges.sparkSession, shared_folder(edges.sparkSession)
    pairs = edges.select("src", "dst")
    pairs.write.parquet(path)
    pairs = spark.read.schema(pairs.schema).parquet(path)
    both = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("component", F.col("id"))
    for _ in range(rounds):
        near = both.join(labels, both["dst"] == labels["id"]).groupBy("src").agg(F.min("component").alias("near"))
        step = labels.join(near, labels["id"] == near["src"]).select("id", "component", F.least("component", "near").alias("new"))
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("far"))
        new = step.join(jump, "new").select("id", "component", F.least("new", "far").alias("new")).checkpoint()
        labels = new.select("id", F.col("new").alias("component"))
        if new.filter("component <> new").isEmpty():
            return labels
    raise RuntimeError(f"components not found in {rounds} rounds")


#: Entries of a graph that one step of ``louvain`` copies at once, and communities up to which a node's links are counted for all of them.
ENTRIES, FEW = 1 << 22, 2048


def adjacency(pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of rows, columns and weights of the directed entries in pieces (row, column, weight), which are used up."""
    counts = np.zeros(n + 1, np.int64)
    for rows, _, _ in pieces:
        counts[1:] += np.bincount(rows, minlength=n)
    starts = np.cumsum(counts)
    free, columns = starts[:-1].copy(), np.empty(starts[-1], np.int32)
    exact = all((w == w.astype(np.float32)).all() for _, _, w in pieces)
    weights = np.empty(starts[-1], np.float32 if exact else np.float64)
    while pieces:
        rows, cols, w = pieces.pop()
        for a in range(0, len(rows), ENTRIES):
            order = np.argsort(rows[a : a + ENTRIES], kind="stable")
            own = rows[a : a + ENTRIES][order]
            at = free[own] + np.arange(len(own)) - np.searchsorted(own, own)
            columns[at], weights[at] = cols[a : a + ENTRIES][order], w[a : a + ENTRIES][order]
            free += np.bincount(own, minlength=n)
    return starts, columns, weights


def moved_nodes(starts: np.ndarray, columns: np.ndarray, weights: np.ndarray, loops: np.ndarray, passes: int) -> np.ndarray | None:
    """The community of each node after moves node by node; None if none moves. Weights are above 0."""
    n = len(loops)
    community = np.arange(n)
    degree = 2 * loops + np.array([weights[starts[i] : starts[i + 1]].sum(dtype=float) for i in range(n)])
    inside, total, ever = degree.copy(), float(degree.sum()), False
    names = community  # of the communities that have nodes, which are numbered anew in their order before each pass
    for _ in range(passes if total else 0):
        moved = False
        left, community = np.unique(community, return_inverse=True)
        names, inside = names[left], inside[left]
        for i in range(n):
            near = community[columns[starts[i] : starts[i + 1]]]
            if len(left) <= FEW:
                links = np.bincount(near, weights[starts[i] : starts[i + 1]], len(left))
                found = np.flatnonzero(links)
                links = links[found]
            else:
                found, place = np.unique(near, return_inverse=True)
                links = np.bincount(place, weights[starts[i] : starts[i + 1]], len(found))
            own = best = int(community[i])
            inside[own] -= degree[i]
            gains = links - inside[found] * degree[i] / total
            at = int(np.searchsorted(found, own))
            most = gains[at] if at < len(found) and found[at] == own else 0.0 - inside[own] * degree[i] / total
            at = 0
            while at < len(found) and (better := gains[at:] > most + 1e-12).any():
                at += int(better.argmax())
                best, most, at = int(found[at]), gains[at], at + 1
            inside[best] += degree[i]
            community[i] = best
            moved |= best != own
        ever |= moved
        if not moved:
            break
    return names[community] if ever else None


def contracted(starts: np.ndarray, columns: np.ndarray, weights: np.ndarray, loops: np.ndarray, community: np.ndarray, n: int) -> tuple[list, np.ndarray]:
    """The entries between communities, summed, and the loops of communities."""
    own = np.bincount(community, loops, n)
    keys, sums = np.zeros(0, np.int64), np.zeros(0)
    first = 0
    while first < len(community):
        last = max(int(np.searchsorted(starts, starts[first] + ENTRIES, "right")) - 1, first + 1)
        rows = np.repeat(community[first:last], np.diff(starts[first : last + 1]))
        cols, w = community[columns[starts[first] : starts[last]]], weights[starts[first] : starts[last]].astype(float)
        own += np.bincount(rows[rows == cols], w[rows == cols], n)
        apart = rows != cols
        keys, place = np.unique(np.concatenate([keys, rows[apart] * n + cols[apart]]), return_inverse=True)
        sums = np.bincount(place, np.concatenate([sums, w[apart]]), len(keys))
        first = last
    return [((keys // n).astype(np.int32), (keys % n).astype(np.int32), sums)], own / 2


class Names:
    """The distinct values of many pieces, sorted. Pieces wait until they outweigh what is known, so values aren't sorted anew for each of them."""

    def __init__(self) -> None:
        self.known, self.waiting, self.held = None, [], 0

    def add(self, values: np.ndarray) -> None:
        self.waiting.append(np.unique(values))
        self.held += len(self.waiting[-1])
        if self.held > max(ENTRIES >> 2, 0 if self.known is None else 2 * len(self.known)):
            self.all()

    def all(self) -> np.ndarray:
        if self.waiting:
            self.known = np.unique(np.concatenate(self.waiting if self.known is None else [self.known, *self.waiting]))
            self.waiting, self.held = [], 0
        return self.known


def louvain(edges: DataFrame, part: str | None = None, passes: int = 32) -> DataFrame:
    """id and community by Louvain moves, level by level; an edge has weight 1, so repeated pairs weigh as often as they occur.

    Pairs are summed by Spark first. Moves go node by node, each on what the moves before left, so a graph is one task's
    work, whose memory is some 30 bytes for each of its distinct pairs; each value of ``part`` is a graph of its own.
    """
    own = [part] if part else []
    edges = edges.groupBy(*own, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    kind = dict(edges.dtypes)["src"]

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, own = [], Names()
        for batch in batches:
            ends = [batch.column(c) for c in ("src", "dst")]
            type_ = ends[0].type
            ends = [x.to_numpy(zero_copy_only=False) for x in ends]
            w = batch.column("weight").to_numpy()
            small = w.astype(np.float32)
            read.append((*ends, small if (small == w).all() else w))
            own.add(np.concatenate(ends))
        names = own.all()
        pieces, loops = [], np.zeros(len(names))
        while read:
            a, b, w = read.pop()
            a, b = (np.searchsorted(names, x).astype(np.int32) for x in (a, b))
            np.add.at(loops, a[a == b], w[a == b])
            a, b, w = a[a != b], b[a != b], w[a != b]
            pieces += [(a, b, w), (b, a, w)]
        belongs, n = np.arange(len(names)), len(names)
        while True:
            starts, columns, weights = adjacency(pieces, n)
            community = moved_nodes(starts, columns, weights, loops, passes)
            if community is None:
                break
            kept, community = np.unique(community, return_inverse=True)
            belongs, n = community[belongs], len(kept)
            pieces, loops = contracted(starts, columns, weights, loops, community, n)
        first = np.unique(belongs, return_index=True)[1]  # names are sorted: the first of a community is its smallest
        yield pa.RecordBatch.from_arrays([pa.array(names, type_), pa.array(names[first[belongs]], type_)], names=["id", "community"])

    return edges.groupBy(part or F.lit(1).alias("one")).applyInArrow(partition, f"id {kind}, community {kind}")


# -- the symbol graph --------------------------------------------------------------------------------------

#: Kinds of chunks that contain a file's other symbols, and kinds of edges that each intent follows.
CONTAINERS = ("impl", "class", "struct", "module")
INTENT_KINDS = {
    "definition": ("Implements", "Aliases", "UsesType"),
    "usage": ("CallsFunction", "CalledByFunction", "TestedBy", "CoOccursInTest"),
    "conceptual": ("ReferencesConcept", "Documents"),
    "bug_debt": ("RaisesError", "ErrorDescribes", "Configures"),
    "unknown": ("CallsFunction", "CalledByFunction"),
}


def symbols(chunks: DataFrame) -> DataFrame:
    """symbol, chunk and file of the first definition of each name."""
    named = chunks.filter("name is not null and name <> ''")
    return named.groupBy(F.col("name").alias("symbol")).agg(F.min(F.struct("id", "file")).alias("first")).select("symbol", F.col("first.id").alias("chunk"), F.col("first.file").alias("file"))


def resolved(asked: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """``asked`` with ``to``: the symbol that ``name`` is, else the smallest whose last ``::`` segment it is; others go."""
    exact = nodes.select(F.col("symbol").alias(name), F.col("symbol").alias("exact"))
    suffix = nodes.groupBy(F.element_at(F.split("symbol", "::"), -1).alias(name)).agg(F.min("symbol").alias("near"))
    joined = asked.join(exact, name, "left").join(suffix, name, "left")
    return joined.withColumn("to", F.coalesce("exact", "near")).filter("to is not null").drop("exact", "near")


def symbol_graph(chunks: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """src, dst and kind of the edges between symbols.

    Chunks have id, file, name, chunk_type, calls and inherits; entities file, text and entity_type. Five passes: calls and
    inheritance, what containers hold, what tests test, tests of one symbol, and what documentation names. Pairs of tests
    are dealt by symbol and salt; repeated edges are one.
    """
    from .chunking import tests_of_same

    nodes = symbols(chunks)
    own = chunks.filter("name is not null and name <> ''")
    out = None
    called = resolved(own.select("name", "chunk_type", F.explode("calls").alias("target")), nodes, "target")
    inherited = resolved(own.select("name", F.explode("inherits").alias("target")), nodes, "target")
    in_file = own.select("file", F.col("name").alias("other")).distinct()
    contains = own.filter(F.col("chunk_type").isin(*CONTAINERS)).select("file", "name").distinct().join(in_file, "file").filter("name <> other")
    tested = called.filter("chunk_type = 'test' and to <> name")
    together = tests_of_same(tested.select(F.col("name").alias("src"), F.col("to").alias("callee")))
    parts = [
        called.select(F.col("name").alias("src"), F.col("to").alias("dst"), F.lit("CallsFunction").alias("kind")), inherited.select(F.col("name").alias("src"), F.col("to").alias("dst"), F.lit("Implements").alias("kind")),
        contains.select(F.col("name").alias("src"), F.col("other").alias("dst"), F.lit("ModuleContains").alias("kind")), tested.select(F.col("to").alias("src"), F.col("name").alias("dst"), F.lit("TestedBy").alias("kind")),
        together.select("src", "dst", F.lit("CoOccursInTest").alias("kind")),
    ]
    if entities is not None:
        kind = F.when(F.col("entity_type") == "doc_concept", "Documents").when(F.col("entity_type") == "phrase", "ReferencesConcept")
        told = resolved(entities.withColumn("kind", kind).filter("kind is not null").select("file", "kind", F.col("text").alias("target")), nodes, "target")
        parts.append(told.join(in_file, "file").select(F.col("other").alias("src"), F.col("to").alias("dst"), "kind"))
    for p in parts:
        p = p.filter("src <> dst").distinct()
        out = p if out is None else out.unionByName(p)
    return out


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int, kinds: tuple[str, ...] | None = None, forward: bool = True, backward: bool = False) -> DataFrame:
    """id, hop, via and kind of nodes within ``hops`` over edges of the kinds and directions; the smallest edge (via, kind) of the first visit, seeds left out."""
    own = edges.filter(F.col("kind").isin(*kinds)) if kinds else edges
    step = []
    if forward:
        step.append(own.select(F.col("src").alias("via"), F.col("dst").alias("id"), "kind"))
    if backward:
        step.append(own.select(F.col("dst").alias("via"), F.col("src").alias("id"), "kind"))
    step = (step[0] if len(step) == 1 else step[0].unionByName(step[1])).distinct()
    seen, front, out = seeds.select("id"), seeds.select(F.col("id").alias("via")), None
    for hop in range(1, hops + 1):
        reached = step.join(front, "via").join(seen, "id", "left_anti").groupBy("id").agg(F.min(F.struct("via", "kind")).alias("e"))
        found = settled(reached.select("id", F.lit(hop).alias("hop"), F.col("e.via").alias("via"), F.col("e.kind").alias("kind")))
        out = found if out is None else out.unionByName(found)
        if found.isEmpty():
            break
        seen, front = seen.unionByName(found.select("id")), found.select(F.col("id").alias("via"))
    return out


def entry_point(nodes: DataFrame, edges: DataFrame, asked: str, chunks: DataFrame | None = None) -> DataFrame:
    """symbol of an entry: of ``file:line`` the chunk's symbol, else the exact name, else names that contain it ignoring case, the most connected first, then by name."""
    exact = F.col("symbol") == F.lit(asked)
    near = F.lower("symbol").contains(asked.lower())
    ranked = nodes.filter(exact | near).join(degrees(edges).withColumnRenamed("id", "symbol"), "symbol", "left")
    found = ranked.orderBy(F.desc(exact), F.desc(F.coalesce("degree", F.lit(0))), "symbol").select("symbol").limit(1)
    file, colon, line = asked.rpartition(":")
    if chunks is None or not colon or not line.isdigit():
        return found
    unnamed = F.concat("file", F.lit(":"), F.col("start").cast("string"))
    name = F.col("name") if "name" in chunks.columns else F.lit(None).cast("string")
    at = chunk_at(chunks, file, int(line)).select(F.coalesce(name, unnamed).alias("symbol"))
    return at.withColumn("o", F.lit(0)).unionByName(found.withColumn("o", F.lit(1))).orderBy("o").select("symbol").limit(1)


def chunk_at(chunks: DataFrame, file: str, line: int) -> DataFrame:
    """The first chunk, by path, start and end, whose path ends with ``file`` and that holds the line."""
    held = F.col("file").endswith(file) & (F.col("start") <= line) & (F.col("end") >= line)
    return chunks.filter(held).orderBy("file", "start", "end").limit(1)


def subgraph(nodes: DataFrame, edges: DataFrame, keep: Column) -> tuple[DataFrame, DataFrame]:
    """The nodes that a condition keeps, and the edges both of whose ends it keeps."""
    own = nodes.filter(keep)
    ids = own.select("id")
    return own, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def export(nodes: DataFrame, edges: DataFrame, node_kinds: tuple[str, ...] = (), edge_kinds: tuple[str, ...] = (), least_weight: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """A graph for display: nodes of the kinds, edges of the kinds and the weight between them."""
    own = edges.filter(F.col("weight") >= least_weight)
    own = own.filter(F.col("kind").isin(*edge_kinds)) if edge_kinds else own
    return subgraph(nodes, own, F.col("node_kind").isin(*node_kinds) if node_kinds else F.lit(True))


def refine(expanded: DataFrame, vectors: DataFrame, asked: list[float], least: float = 0.4) -> DataFrame:
    """Expanded hits (id, score) whose vector is alike the query's."""
    from ..functions.scores import cosine

    return expanded.join(vectors, "id").filter(cosine(F.col("vec"), F.array(*map(F.lit, asked))) >= least).select("id", "score")


def knowledge_gaps(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """community, members, density and bridges of sparse communities: a density under 0.2 and as many bridges as members at most. Edges (src, dst) are undirected and once each."""
    label = lambda end: communities.select(F.col("id").alias(end), F.col("community").alias(f"c_{end}"))
    both = edges.join(label("src"), "src").join(label("dst"), "dst")
    inside = both.filter("c_src = c_dst").groupBy(F.col("c_src").alias("community")).agg(F.count("*").alias("inside"))
    across = both.filter("c_src <> c_dst")
    bridges = across.select(F.col("c_src").alias("community")).unionByName(across.select(F.col("c_dst").alias("community"))).groupBy("community").agg(F.count("*").alias("bridges"))
    out = communities.groupBy("community").agg(F.count("*").alias("members")).join(inside, "community", "left").join(bridges, "community", "left").fillna(0, ["inside", "bridges"])
    out = out.withColumn("density", F.when(F.col("members") >= 2, F.col("inside") / (F.col("members") * (F.col("members") - 1) / 2)).otherwise(0.0))
    return out.filter("density < 0.2 and bridges <= members").select("community", "members", "density", "bridges")


def save(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """The graph as tables: nodes, and edges sorted by source; their reverse is the same table read by its other column."""
    nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.repartition("src").sortWithinPartitions("src").write.mode("overwrite").parquet(f"{folder}/edges")


def load(spark, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and reversed edges of a saved graph."""
    edges = spark.read.parquet(f"{folder}/edges")
    return spark.read.parquet(f"{folder}/nodes"), edges, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def context(nodes: DataFrame, edges: DataFrame, name: str, depth: int) -> DataFrame:
    """id, symbol and hop of what is within ``depth`` calls of a symbol (the smallest id of its name), callers and callees alike; the symbol itself is left out."""
    start = nodes.filter(F.col("symbol") == F.lit(name)).agg(F.min("id").alias("id")).filter("id is not null")
    if depth < 1:
        return nodes.limit(0).select("id", "symbol", F.lit(0).alias("hop"))
    return neighbours(edges, start, depth, ("Calls",), True, True).join(nodes.select("id", "symbol"), "id").select("id", "symbol", "hop")

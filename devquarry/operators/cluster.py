"""k-means with a fixed generator, and concepts named by a vocabulary."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import retrieval

#: Factor, step and first state (for seed 0) of the generator, of 64 bits.
FACTOR, STEP, FIRST = 6364136223846793005, 1442695040888963407, 0x9E3779B97F4A7C15
#: The names that a concept can have.
VOCABULARY = (
    "authentication", "serialization", "caching", "networking", "persistence", "testing", "error-handling", "indexing", "parsing", "concurrency", "embedding", "search", "compression", "validation", "graph",
)
#: Documented chunks that a file needs to have concepts, and the most concepts of a file.
LEAST_DOCUMENTED, MOST_CONCEPTS = 4, 20


def draws(seed: int):
    """The generator's numbers."""
    state = seed or FIRST
    while True:
        state = (state * FACTOR + STEP) & 0xFFFFFFFFFFFFFFFF
        yield state


def share(number: int) -> float:
    return (number >> 40) / (1 << 24)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.stack([((x - c) ** 2).sum(1) for c in centroids], 1)


def kmeans(items: DataFrame, key: str, vec: str, k: int, most: int = 100, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Members (key, cluster, distance) and clusters (cluster, label, size, cohesion) of vectors of one length.

    Starts are drawn in the order of keys, which must be unique: the first evenly, others by the squared distance to the
    nearest one. Rounds end when no member moves, or after ``most``. A label is the member nearest the centre, ties by key;
    cohesion the mean distance; clusters are numbered by falling size. Rows without a vector go; none at all gives empty
    tables. Sums have 64 bits. Centres (k vectors) and a number for each partition are all that the driver holds.
    """
    kind = dict(items.dtypes)[key]
    rows = items.select(F.col(key).alias("key"), F.col(vec).alias("vec")).filter("key is not null and vec is not null")
    placed = rows.repartitionByRange("key").sortWithinPartitions("key").withColumn("part", F.spark_partition_id()).checkpoint()
    counts = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect()}
    if counts:
        starts = first_centres(placed, counts, k, draws(seed))
        asked, centres = rounds(placed, starts, most)
    else:
        asked = centres = np.zeros((1, 1), np.float32)

    def assigned(batches):
        for pdf in batches:
            x = matrix(pdf["vec"])
            own = squared(x, asked).argmin(1) if len(x) else np.zeros(0, int)
            yield pd.DataFrame({"key": pdf["key"], "cluster": own, "distance": np.sqrt(((x - centres[own]) ** 2).sum(1)) if len(x) else []})

    found = placed.select("key", "vec").mapInPandas(assigned, f"key {kind}, cluster int, distance double").checkpoint()
    each = found.groupBy("cluster").agg(F.count("*").alias("size"), F.avg("distance").alias("cohesion"), F.min(F.struct("distance", "key")).alias("near"))
    ranked = each.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "cluster")) - 1)  # k rows at most
    members = found.join(F.broadcast(ranked.select("cluster", "rank")), "cluster")
    return members.select(F.col("key").alias(key), F.col("rank").alias("cluster"), "distance"), ranked.select(F.col("rank").alias("cluster"), F.col("near.key").alias("label"), "size", "cohesion")


def matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float32) if len(vectors) else np.zeros((0, 1), np.float32)


def first_centres(placed: DataFrame, counts: dict[int, int], k: int, numbers) -> np.ndarray:
    """Starts of the clusters: each round sums the distances of every partition, then one partition gives its row."""
    place, parts = next(numbers) % sum(counts.values()), sorted(counts)
    k = max(1, min(k, sum(counts.values())))
    for p in parts:
        if place < counts[p]:
            break
        place -= counts[p]
    centres = [pick(placed, p, place + 1, None)]
    while len(centres) < k:
        now = np.stack(centres)

        def sums(batches, now=now):
            for pdf in batches:
                yield pd.DataFrame({"part": pdf["part"], "d": squared(matrix(pdf["vec"]), now).min(1).astype(float)}) if len(pdf) else pd.DataFrame({"part": [], "d": []})

        weights = {r["part"]: r["d"] for r in placed.mapInPandas(sums, "part int, d double").groupBy("part").agg(F.sum("d").alias("d")).collect()}
        total = sum(weights[p] for p in parts)
        if total <= 0:
            centres += [centres[0]] * (k - len(centres))
            break
        target = min(share(next(numbers)) * total, total)
        for p in parts:
            if target <= weights[p]:
                break
            target -= weights[p]
        centres.append(pick(placed, p, target, now))
    return np.stack(centres)


def pick(placed: DataFrame, part: int, target: float, centres: np.ndarray | None) -> np.ndarray:
    """The vector of a partition at which the rows' weights reach ``target``, or its last; without centres a row weighs 1."""

    def rows(batches):
        sofar, last, done = 0.0, None, False
        for pdf in batches:
            if done or not len(pdf):
                continue
            weight = np.ones(len(pdf)) if centres is None else squared(matrix(pdf["vec"]), centres).min(1).astype(float)
            reached = sofar + np.cumsum(weight)
            at = int(np.searchsorted(reached, target))
            sofar, last = reached[-1], pdf["vec"].iloc[min(at, len(pdf) - 1)]
            done = at < len(pdf)
        if last is not None:
            yield pd.DataFrame({"vec": [list(map(float, last))]})

    return np.array(placed.filter(F.col("part") == part).select("vec").mapInPandas(rows, "vec array<float>").first()["vec"], np.float32)


def rounds(placed: DataFrame, centres: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The centres that members were dealt by last, and the means of these members; each round reads the vectors once."""
    k, size = centres.shape
    before = None
    for _ in range(max(most, 1)):

        def sums(batches, now=centres, before=before):
            total, n, moved = np.zeros((k, size)), np.zeros(k, np.int64), 0
            for pdf in batches:
                if not len(pdf):
                    continue
                x = matrix(pdf["vec"])
                own = squared(x, now).argmin(1)
                moved += int((own != (0 if before is None else squared(x, before).argmin(1))).sum())
                n += np.bincount(own, minlength=k)
                np.add.at(total, own, x)
            yield pd.DataFrame({"place": np.arange(k * size + k + 1), "value": np.concatenate([total.ravel(), n, [moved]])})

        found = placed.select("vec").mapInPandas(sums, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
        values = found.sort_values("place")["value"].to_numpy()
        total, n, moved = values[: k * size].reshape(k, size), values[k * size : -1], values[-1]
        before, centres = centres, np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres).astype(np.float32)
        if not moved:
            break
    return before, centres


def lloyd(x: np.ndarray, k: int, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres and each row's cluster, for rows that one task holds; the same rules as ``kmeans``."""
    numbers, k = draws(seed), max(1, min(k, len(x)))
    centres = [x[next(numbers) % len(x)]]
    while len(centres) < k:
        reached = np.cumsum(squared(x, np.stack(centres)).min(1).astype(float))
        if reached[-1] <= 0:
            centres += [centres[0]] * (k - len(centres))
            break
        centres.append(x[min(int(np.searchsorted(reached, min(share(next(numbers)) * reached[-1], reached[-1]))), len(x) - 1)])
    centres, own = np.stack(centres), np.zeros(len(x), int)
    for _ in range(max(most, 1)):
        before, own = own, squared(x, centres).argmin(1)
        centres = np.stack([x[own == c].astype(float).mean(0) if (own == c).any() else centres[c] for c in range(k)]).astype(np.float32)
        if (own == before).all():
            break
    return centres, own


def concepts(chunks: DataFrame, key: str, text: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Members and clusters of chunks by their counted words (256 places, 100 rounds, seed 42)."""
    return kmeans(retrieval.bag_of_words(chunks, key, text, 256), key, "vec", k)


def doc_comment(content: Column) -> Column:
    """The text of the lines that begin with three slashes, joined by spaces; null without one."""
    lines = F.filter(F.split(content, r"\r?\n"), lambda x: F.ltrim(x).startswith("///"))
    joined = F.array_join(F.transform(lines, lambda x: F.trim(F.substring(F.ltrim(x), F.lit(4), F.length(x)))), " ")
    return F.when(F.trim(joined) != "", joined)


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(name, "[^A-Za-z0-9]+", "-")), "^-|-$", "")


@functools.lru_cache(1 << 16)
def word_hash(word: str) -> int:
    h = 0
    for b in word.lower().encode():
        h = (h * 31 + b) & 0xFFFFFFFFFFFFFFFF
    return h


def words(texts: list[str], size: int = 256) -> np.ndarray:
    """Counted words of texts, of length 1: what ``retrieval.bag_of_words`` gives."""
    out = np.zeros((len(texts), size), np.float32)
    for row, t in zip(out, texts):
        for w in re.findall(r"[A-Za-z0-9]+", t):
            row[word_hash(w) % size] += 1
        row /= max(float(np.sqrt((row * row).sum())), 1e-30)
    return out


def file_concepts(chunks: DataFrame, embed: Callable[[list[str]], np.ndarray] = words, most: int = 50, seed: int = 42) -> DataFrame:
    """id, file and label of the concepts of each file's documented chunks (file, id, content).

    Half as many clusters as documented chunks, at most 20; each has the word of the vocabulary nearest its centre, and a
    word is given once. Files with fewer than four such chunks have none. ``embed`` turns texts into rows. One task holds
    the documentation of one file, which the scan's limit of 1 MiB bounds.
    """
    told = chunks.select("file", "id", doc_comment(F.col("content")).alias("doc")).filter("file is not null and doc is not null")
    enough = told.groupBy("file").count().filter(F.col("count") >= LEAST_DOCUMENTED).select("file")

    def named(pdf):
        x, names = embed(list(pdf.sort_values("id")["doc"])), embed(list(VOCABULARY))
        centres, _ = lloyd(x, min(max(len(x) // 2, 1), MOST_CONCEPTS), most, seed)
        length = np.maximum(np.linalg.norm(centres, axis=1)[:, None] * np.linalg.norm(names, axis=1)[None, :], 1e-30)
        labels = list(dict.fromkeys(VOCABULARY[i] for i in (centres @ names.T / length).argmax(1)))
        return pd.DataFrame({"file": pdf["file"].iloc[0], "label": labels})

    found = told.join(enough, "file").groupBy("file").applyInPandas(named, f"file {dict(chunks.dtypes)['file']}, label string")
    return found.select(F.concat(F.col("file").cast("string"), F.lit(":cluster:"), slug(F.col("label"))).alias("id"), "file", "label")

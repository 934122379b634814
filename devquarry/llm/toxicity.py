"""Toxicity score by a counterfactual-regularised linear classifier.

Features are a text's distinct words and their beginnings, so that inflected forms of one stem share
evidence. Training minimises log loss + ``penalty`` x the mean squared change of the log-odds between
a labelled text and its copies with identity terms swapped for others of their kind + an L1 norm. A
mention of a group, which changes under the swap, so cannot carry weight that another group's mention
does not, and neutral mentions are not scored as toxic.

The fit sees at most ``max_toxic`` + ``max_clean`` labelled rows, taken by hash of the id; their features are
counted by Spark, and only those that are significant go to the driver. Scoring covers every whole text. Null
and empty texts have no features and score as the intercept. Rows whose label or text is null, and nearly equal
copies of a row, are left out of the fit; without rows of both labels every score is 0. Repeated rows score
alike, a null id stays null and is never learnt from, and an empty table gives an empty result. A very long text is
one set of features. Only ids, texts and labels are read, so further columns can't clash.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, delete, documents, fold_remainder, shared_dir, slices, small_batches

WORD = re.compile(r"[^\W\d_]+")
#: Identity terms by kind; a swap replaces each by the next of its line. Fixed values.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("immigrants", "citizens"), ("disabled", "abled"), ("old", "young"), ("african", "european", "american"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
SWAP = {w: line[(i + 1) % len(line)] for line in IDENTITY_TERMS for i, w in enumerate(line)}
#: Words whose weights a worker remembers.
CACHE = 300_000
#: Counters of the first selection of features.
BINS = 1 << 20


def features_of(word: str) -> list[int]:
    """Hashes of the word and of its first four to six letters."""
    raw = [zlib.crc32(word.encode())]
    return raw + [zlib.crc32(f"^{word[:n]}".encode(), n) for n in (4, 5, 6) if len(word) >= n]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def hashed(words: set[str]) -> np.ndarray:
    return np.array([f for w in words for f in features_of(w)], np.uint32)  # a beginning counts once for each word


def extract(batches):
    """label, near-copy key, features, and features after the swap (empty if nothing changes)."""
    for batch in (part for whole in batches for part in slices(whole)):
        out = []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = words_of(text)
            x = hashed(words)
            other = {SWAP.get(w, w) for w in words} if words & SWAP.keys() else set()
            key = 0
            for k in (1, 3, 5, 7):
                key = hash((key, int(np.min((x * np.uint32(2654435761 + 2 * k)) ^ np.uint32(k * 40503), initial=2**32 - 1))))
            out.append((int(label), key, np.sort(x).tobytes(), np.sort(hashed(other)).tobytes()))
        columns = list(zip(*out)) or [[], [], [], []]
        yield pa.record_batch([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.binary())], ["label", "near", "x", "swapped"])


@dataclass
class Model:
    """Weights by feature hash."""

    bias: float = -30.0
    weights: dict[int, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        return math.fsum(self.weights.get(f, 0.0) for f in features_of(word))

    def score(self, text: str | None, cache: dict[str, float]) -> float:
        parts = []
        for w in words_of(text):
            v = cache.get(w)
            if v is None:
                v = self.word(w)
                if len(cache) < CACHE:
                    cache[w] = v
            if v:
                parts.append(v)
        z = max(-30.0, min(30.0, self.bias + math.fsum(parts)))  # fsum: the same for any order of the words
        return 1 / (1 + math.exp(-z))


class Rows:
    """Sparse rows over the selected features."""

    def __init__(self, rows: list[np.ndarray], chosen: np.ndarray):
        at = [np.searchsorted(chosen, x) for x in rows]
        keep = [(i < len(chosen)) & (chosen[np.minimum(i, max(len(chosen) - 1, 0))] == x) if len(chosen) else np.zeros(len(x), bool) for i, x in zip(at, rows)]
        self.col = np.concatenate([i[k] for i, k in zip(at, keep)] or [np.empty(0, int)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), [int(k.sum()) for k in keep])
        self.n, self.m = len(rows), len(chosen)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.m)


def significant(rows: list[np.ndarray], y: np.ndarray, least_rows: int, least_z: float) -> np.ndarray:
    """Features whose share of toxic and clean rows differs by ``least_z`` standard errors."""
    n1, n0 = max(y.sum(), 1), max((1 - y).sum(), 1)

    def chosen(c1: np.ndarray, c: np.ndarray, share: float = 1.0) -> np.ndarray:
        p1, p0, p = c1 / n1, (c - c1) / n0, c / len(y)
        z = (p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))
        return (c >= least_rows) & (np.abs(z) >= share * least_z)

    # first by the hash's lower bits, in arrays of fixed size, then exactly for what is left
    low, counts = np.uint32(BINS - 1), np.zeros((2, BINS), np.int32)
    for x, label in zip(rows, y):
        counts[int(label), np.unique(x & low)] += 1
    step = 1 << 16  # temporaries of a stretch at a time
    likely = np.concatenate([chosen(c[1].astype(float), c.sum(0).astype(float), 0.7) for c in (counts[:, i : i + step] for i in range(0, BINS, step))])
    left = [np.unique(x[likely[x & low]]) for x in rows]
    f, where = np.unique(np.concatenate(left), return_inverse=True)
    c1 = np.bincount(where, np.repeat(y, [len(x) for x in left]), len(f))
    return f[chosen(c1, np.bincount(where, minlength=len(f)).astype(float))]


def significant_features(rows: DataFrame, least_rows: int = 5, least_z: float = 5.0) -> DataFrame:
    """feature: what ``significant`` finds in rows (label, x), counted by Spark, so that the driver sees the chosen ones alone."""

    def counts(batches):
        for batch in batches:
            for label in (0, 1):
                own = [np.unique(np.frombuffer(x, np.uint32)) for x, y in zip(batch.column("x").to_pylist(), batch.column("label").to_pylist()) if y == label]
                if own:
                    f, n = np.unique(np.concatenate(own), return_counts=True)
                    yield pa.record_batch([pa.array(f.astype(np.int64)), pa.array(n), pa.array(n * label)], ["feature", "n", "n1"])

    sums = rows.select("label", "x").mapInArrow(counts, "feature long, n long, n1 long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1")).filter(F.col("n") >= least_rows)
    totals = rows.agg(F.greatest(F.sum("label"), F.lit(1)).cast("double").alias("ones"), F.count("*").cast("double").alias("all"))  # one row
    share = F.col("n") / F.col("all")
    spread = F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / F.col("ones") + 1 / F.greatest(F.col("all") - F.col("ones"), F.lit(1.0)))
    z = (F.col("n1") / F.col("ones") - (F.col("n") - F.col("n1")) / F.greatest(F.col("all") - F.col("ones"), F.lit(1.0))) / F.sqrt(spread)
    return sums.join(F.broadcast(totals)).filter(F.abs(z) >= least_z).select("feature")


def only(chosen: np.ndarray):
    """Rows with the chosen features alone."""

    def kept(batches):
        pick = lambda x: (v := np.frombuffer(x, np.uint32))[np.isin(v, chosen)].tobytes()
        for batch in batches:
            swapped = [pick(s) or (b"" if not s else np.uint32(0).tobytes()) for s in batch.column("swapped").to_pylist()]
            yield pa.record_batch([batch.column("label"), batch.column("near"), pa.array([pick(x) for x in batch.column("x").to_pylist()], pa.binary()), pa.array(swapped, pa.binary())], ["label", "near", "x", "swapped"])

    return kept


def fit(labels: np.ndarray, rows: list[np.ndarray], swapped: list[np.ndarray], chosen: np.ndarray | None = None, clean_weight: float = 1.0, penalty: float = 1.0, l1: float = 2e-4, steps: int = 400, least_rows: int = 5, least_z: float = 5.0) -> Model:
    """Accelerated proximal gradient on the regularised loss, over the features ``chosen`` (sorted), else those that are significant in the rows."""
    y = np.asarray(labels, float)
    if not len(y) or y.min() == y.max():
        return Model()
    chosen = significant(rows, y, least_rows, least_z) if chosen is None else chosen
    x = Rows(rows, chosen)
    pairs = [i for i, s in enumerate(swapped) if len(s)]
    plain, other = Rows([rows[i] for i in pairs], chosen), Rows([swapped[i] for i in pairs], chosen)
    weight = np.where(y == 1, 1.0, clean_weight)
    weight /= weight.sum()
    w, b = np.zeros(len(chosen)), math.log(max((weight * y).sum(), 1e-9) / max((weight * (1 - y)).sum(), 1e-9))
    # a step that the steepest curvature allows: a quarter of the largest row norm squared, times the mean
    norms = np.bincount(x.row, minlength=x.n) if x.n else np.zeros(1)
    curve = 0.25 * (weight * (norms + 1)).sum() * 2 + 1e-9
    if pairs:
        change = np.bincount(plain.row, minlength=plain.n) + np.bincount(other.row, minlength=other.n)
        curve += 2 * penalty * 2 * change.mean()
    v, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        g = weight * (1 / (1 + np.exp(-np.clip(x.dot(v) + vb, -30, 30))) - y)
        grad, gb = x.back(g), g.sum()
        if pairs:
            d = plain.dot(v) - other.dot(v)
            grad = grad + 2 * penalty / len(pairs) * (plain.back(d) - other.back(d))
        nw, nb = v - grad / curve, vb - gb / curve
        nw = np.sign(nw) * np.maximum(np.abs(nw) - l1 / curve, 0)
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return Model(float(b), {int(f): float(c) for f, c in zip(chosen, w) if c})


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = 3000, max_clean: int = 6000) -> Model:
    """A model of the rows in ``docs`` that ``labels`` marks; both have doc_id."""
    marked = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # in doubt, toxic
    order = F.xxhash64("doc_id")
    small_batches(docs.sparkSession)

    def first(label: int, most: int) -> DataFrame:
        return marked.filter(F.col("toxic") == label).orderBy(order, "doc_id").limit(most)

    sample = first(1, max_toxic).unionByName(first(0, max_clean))
    texts = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(sample), "doc_id")  # max_toxic + max_clean ids
    raw = texts.select("text", "toxic").mapInArrow(extract, "label int, near long, x binary, swapped binary")
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    once = cut(raw.groupBy("label", "near").agg(F.min(F.struct("x", "swapped")).alias("f")).select("label", "near", "f.*"), folder, "features")
    chosen = np.sort(np.array([r.feature for r in significant_features(once).collect()], np.uint32))
    got = once.mapInArrow(only(chosen), "label int, near long, x binary, swapped binary").toPandas().sort_values(["label", "near"])
    delete(spark, folder)
    labels, rows, swapped = got["label"].to_numpy(), *([np.frombuffer(x, np.uint32) for x in got[name]] for name in ("x", "swapped"))
    return fit(labels, rows, swapped, chosen) if len(got) else Model()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every row."""
    bias, weights = model.bias, model.weights

    def scored(batches):
        own, cache = Model(bias, weights), {}
        for batch in (part for whole in batches for part in slices(whole)):
            scores = [own.score(x, cache) for x in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.7) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scored, "doc_id long, score double, predicted int")


def rejected(model: Model, least: float = 0.7):
    """A column function: whether a text's score is ``least`` or more. Texts go to Python alone; rows stay with the JVM."""
    bias, weights = model.bias, model.weights

    @F.arrow_udf("boolean")
    def over(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own, cache = Model(bias, weights), {}
        for x in texts:
            yield pa.array([own.score(t.as_py(), cache) >= least for t in x], pa.bool_())

    return over


def trained(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """A model learnt from the rows outside fold 1 of 3."""
    learn = labels.select("doc_id", "toxic").filter(fold_remainder(F.col("doc_id"), 3) != 1)
    return train(docs, learn)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = trained(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (fold_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")

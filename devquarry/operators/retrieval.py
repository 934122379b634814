"""Retrieval: term statistics, BM25, vector search, rank fusion, diversity, graph expansion."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import cosine
from ..functions.text import chat_tokens, code_tokens

K1, B, RRF = 1.5, 0.75, 60


def postings(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """key, term and length: a chunk's distinct code tokens; its length is their number."""
    tokens = chunks.select(F.col(key), code_tokens(F.col(text)).alias("terms"))
    return tokens.select(key, F.explode("terms").alias("term"), F.size("terms").cast("long").alias("length"))


def corpus_statistics(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """n_docs and avg_length (1 at least) of the corpus."""
    lengths = chunks.select(F.size(code_tokens(F.col(text))).alias("length"))
    return lengths.agg(F.count("*").alias("n_docs"), F.greatest(F.avg("length"), F.lit(1.0)).alias("avg_length"))


def document_frequency(chunks: DataFrame, key: str, text: str) -> DataFrame:
    return postings(chunks, key, text).groupBy("term").agg(F.count("*").alias("df"))


def bm25(chunks: DataFrame, key: str, text: str, terms: list[str], top_k: int) -> DataFrame:
    """key and score of the best chunks; a term counts once a chunk. One pass: only the query's terms leave the scan."""
    tokens = chunks.select(F.col(key), code_tokens(F.col(text)).alias("all")).select(key, F.size("all").alias("length"), *[F.array_contains("all", t).cast("int").alias(f"t{i}") for i, t in enumerate(terms)])
    stats = tokens.agg(F.count("*").alias("n"), F.greatest(F.avg("length"), F.lit(1.0)).alias("mean"), *[F.coalesce(F.sum(f"t{i}"), F.lit(0)).alias(f"df{i}") for i in range(len(terms))])
    norm = (K1 + 1) / (1 + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    score = sum((F.col(f"t{i}") * F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1) * norm for i in range(len(terms))), F.lit(0.0))
    return tokens.join(F.broadcast(stats)).select(key, score.alias("score")).filter("score > 0").orderBy(F.desc("score"), key).limit(top_k)  # stats: one row


def equal_to(term: str):
    return lambda w: w == F.lit(term)


def bm25_true_tf(chunks: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key and score with repeated terms counted; zero scores stay."""
    tokens = chunks.select(F.col(key), chat_tokens(F.col(text)).alias("all")).select(key, F.size("all").alias("length"), *[F.size(F.filter("all", equal_to(t))).alias(f"t{i}") for i, t in enumerate(terms)])
    stats = tokens.agg(F.count("*").alias("n"), F.greatest(F.avg("length"), F.lit(1.0)).alias("mean"), *[F.sum((F.col(f"t{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(terms))])
    part = lambda i: F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1) * F.col(f"t{i}") * (K1 + 1) / (F.col(f"t{i}") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return tokens.join(F.broadcast(stats)).select(key, sum((part(i) for i in range(len(terms))), F.lit(0.0)).alias("score"))


def vector_search(vectors: DataFrame, key: str, vector: str, query: list[float], top_k: int) -> DataFrame:
    """key and score = cosine of the nearest vectors; exact, one scan and a top-k."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(key), cosine(F.col(vector), asked).alias("score")).orderBy(F.desc("score"), key).limit(top_k)


def ranked(lane: DataFrame, key: str) -> DataFrame:
    """A bounded lane with rank from 1; lanes are top-k lists, so their single window is small."""
    return lane.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def fuse(lanes: list[tuple[DataFrame, float]], key: str, top_k: int) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (60 + rank)."""
    parts = [ranked(lane, key).select(key, (F.lit(weight) / (RRF + F.col("rank"))).alias("part")) for lane, weight in lanes]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(key).agg(F.sum("part").alias("score")).orderBy(F.desc("score"), key).limit(top_k)


def mmr(items: DataFrame, key: str, relevance: str, vector: str, balance: float = 0.5) -> DataFrame:
    """key, position and score of a top-k list in the order of maximal marginal relevance; the last wins ties."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([relevance, key], ascending=[False, True]).reset_index(drop=True)
        m = np.stack(pdf[vector].map(np.asarray)).astype(float)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)
        rel, near, left, order = pdf[relevance].to_numpy(), np.zeros(len(m)), list(range(len(m))), []
        while left:
            value = balance * rel[left] - (1 - balance) * near[left]
            best = left[len(left) - 1 - int(np.argmax(value[::-1]))]
            order.append(best)
            left.remove(best)
            near = np.maximum(near, m @ m[best])
        out = pdf.loc[order, [key, relevance]].rename(columns={relevance: "score"})
        out["position"] = range(1, len(out) + 1)
        return out

    kind = dict(items.dtypes)[key]
    return items.groupBy(F.lit(1).alias("one")).applyInPandas(pick, f"{key} {kind}, score double, position long")


def expand(hits: DataFrame, edges: DataFrame, multiplier: Column) -> DataFrame:
    """id and score of the hits' neighbours: score x multiplier of the edge, the largest of each, hits left out."""
    both = edges.select("src", "dst", "kind").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "kind"))
    reached = both.join(hits.select(F.col("id").alias("src"), "score"), "src").select(F.col("dst").alias("id"), (F.col("score") * multiplier).alias("score"))
    return reached.groupBy("id").agg(F.max("score").alias("score")).join(hits.select("id"), "id", "left_anti")


def budget_cut(items: DataFrame, key: str, cost: str, score: str, budget: int, at_once: int = 10_000) -> DataFrame:
    """The items of a ranked list that fit a token budget: too large ones are skipped, the first always stays. Keys are unique, costs 0 or more.

    The driver walks the list range by range: each is the next ``at_once`` items of those that the rest of the budget still
    holds, so no task sees the whole list. What costs nothing is kept without a walk.
    """
    fields = dict(items.dtypes)
    walk = items.select(F.col(key).alias("k"), F.col(score).alias("s"), F.col(cost).alias("c"))
    order = [F.desc_nulls_last("s"), F.asc("k")]
    first = walk.orderBy(*order).limit(1).collect()
    used, kept, last = sum(r.c for r in first), [r.k for r in first], first
    while last and used < budget:
        k, s = last[-1].k, last[-1].s
        later = F.col("s").isNull() & (F.col("k") > F.lit(k)) if s is None else F.col("s").isNull() | (F.col("s") < F.lit(s)) | ((F.col("s") == F.lit(s)) & (F.col("k") > F.lit(k)))
        last = walk.filter(later & (F.col("c") > 0) & (F.col("c") <= F.lit(budget - used))).orderBy(*order).limit(at_once).collect()
        for r in last:
            if used + r.c <= budget:
                used += r.c
                kept.append(r.k)
    keys = items.sparkSession.createDataFrame([(k,) for k in kept], f"{key} {fields[key]}")
    chosen = items.filter(F.col(cost) > 0) if used <= budget else items
    chosen = chosen.join(F.broadcast(keys), key, "left_semi").select(*items.columns)
    return chosen.unionByName(items.filter(F.col(cost) == 0)) if used <= budget else chosen


def add_lane(fused: DataFrame, lane: DataFrame, key: str, weight: float) -> DataFrame:
    """Fused scores with weight / (60 + rank) of a third lane added."""
    more = ranked(lane, key).select(key, (F.lit(weight) / (RRF + F.col("rank"))).alias("more"))
    return fused.join(more, key, "full").select(key, (F.coalesce("score", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))).alias("score"))


def fuse_all(vectors: DataFrame, lexical: DataFrame, key: str) -> DataFrame:
    """Two-lane fusion over the vector lane: what the other lane lacks ranks after its last; ties by raw lexical score."""
    n = lexical.agg(F.count("*").alias("n"))
    a, b = ranked(vectors, key).select(key, F.col("rank").alias("a")), ranked(lexical, key).select(key, F.col("rank").alias("b"), F.col("score").alias("raw"))
    joined = a.join(b, key, "left").join(F.broadcast(n))
    score = 1 / (RRF + F.col("a")) + 1 / (RRF + F.coalesce("b", F.col("n") + 1))
    return joined.select(key, score.alias("score"), F.coalesce("raw", F.lit(0.0)).alias("raw")).orderBy(F.desc("score"), F.desc("raw"), key)


def route(contexts: DataFrame, key: str, vector: str, query: list[float], top: int | None = None, least: float | None = None) -> DataFrame:
    """Indexes to search with their weights, max(0, cosine) or 1 where unknown: all, the best ``top``, or those of ``least`` and more."""
    asked = F.array(*[F.lit(float(x)) for x in query])
    weight = F.when(F.col(vector).isNull(), 1.0).otherwise(F.greatest(cosine(F.col(vector), asked), F.lit(0.0)))
    out = contexts.select(key, weight.alias("weight"))
    if least is not None:
        out = out.filter(F.col("weight") >= least)
    return out.orderBy(F.desc("weight"), key).limit(top) if top else out


def memory_rank(items: DataFrame, key: str, top_k: int = 5) -> DataFrame:
    """(0.6 cosine + 0.4 BM25) x e^(-0.1 hours), doubled in the query's cluster; items have these columns."""
    score = (0.6 * F.col("cos") + 0.4 * F.col("bm25")) * F.exp(-0.1 * F.col("age_hours")) * F.when(F.col("in_cluster"), 2.0).otherwise(1.0)
    return items.select(key, score.alias("score")).orderBy(F.desc("score"), key).limit(top_k)


def similar_to(vectors: DataFrame, key: str, vector: str, seed, top_k: int) -> DataFrame:
    """key and score of what is nearest to one item, which is left out; none if the item is unknown."""
    found = vectors.filter(F.col(key) == F.lit(seed)).select(vector).first()
    if found is None or found[0] is None:
        return vectors.select(key, F.lit(0.0).alias("score")).limit(0)
    return vector_search(vectors.filter(F.col(key) != F.lit(seed)), key, vector, [float(x) for x in found[0]], top_k)


def child_weight(weight: Column, is_child: Column) -> Column:
    """The weight of an index; one below the asked one gains half, between 1 and 4."""
    return F.when(is_child, F.least(F.greatest(weight * 1.5, F.lit(1.0)), F.lit(4.0))).otherwise(weight)


def indexed_text(content: Column, terms: Column) -> Column:
    """What the lexical lane indexes: the content and its virtual terms."""
    return F.concat_ws(" ", content, F.array_join(terms, " "))


def bag_of_words(items: DataFrame, key: str, text: str, size: int = 256) -> DataFrame:
    """key and vec: counts of lower-case ASCII words by a polynomial hash of base 31 modulo ``size``, of length 1. The hash wraps at 64 bits, which no builtin does."""

    def rows(batches):
        import re

        for pdf in batches:
            out = []
            for t in pdf[text]:
                v = np.zeros(size, np.float32)
                for w in re.findall(r"[A-Za-z0-9]+", t or ""):
                    h = 0
                    for b in w.lower().encode():
                        h = (h * 31 + b) & 0xFFFFFFFFFFFFFFFF
                    v[h % size] += 1
                norm = np.float32(np.sqrt((v * v).sum()))
                out.append((v / norm if norm > 0 else v).tolist())
            yield pd.DataFrame({key: pdf[key], "vec": out})

    return items.select(key, text).mapInPandas(rows, f"{key} {dict(items.dtypes)[key]}, vec array<float>")

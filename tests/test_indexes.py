"""Segmented indexes: versions, dead keys, merges, writers that die, and recall of the cells."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from devquarry.functions import text
from devquarry.operators import index, segments, vectors

SF = "/root/testdata/sf0.01"


def tokens():
    return text.code_tokens(F.col("text"))


def scores(built, terms):
    return {r.key: round(r.score, 9) for r in index.search(built, terms).collect()}


def rows_of(spark, texts):
    return spark.createDataFrame(list(texts.items()), "id long, text string")


def test_updates_equal_a_fresh_build(spark, monkeypatch):
    monkeypatch.setattr(segments, "LEAST", 8)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    said = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))
    texts = {i: said() for i in range(40)}
    own = index.build(rows_of(spark, texts), "id", tokens())
    first = scores(own, words[:4])
    begin, old = own, dict(texts)
    for step in range(6):
        changed = {rng.randrange(60): said() for _ in range(5)}
        gone = [k for k in rng.sample(sorted(texts), 3) if k not in changed]
        own = index.update(own, rows_of(spark, changed), "id", tokens(), spark.createDataFrame([(k,) for k in gone], "id long"))
        texts = {k: v for k, v in {**texts, **changed}.items() if k not in gone}
        fresh = index.build(rows_of(spark, texts), "id", tokens())
        assert (own.n_docs, own.mean) == (fresh.n_docs, pytest.approx(fresh.mean))
        assert scores(own, words[:4]) == scores(fresh, words[:4]), step
    assert len(own.version.segments) < 7  # merged on the way
    assert scores(begin, words[:4]) == first and begin.n_docs == len(old)  # the old version is as it was
    whole = index.merge(own)
    assert len(whole.version.segments) == 1 and not whole.version.dead and scores(whole, words[:4]) == scores(own, words[:4])
    lost = segments.vacuum(spark, whole.version)
    assert lost > 6 and scores(index.opened(spark, whole.folder), words[:4]) == scores(fresh, words[:4])
    assert segments.vacuum(spark, whole.version) == 0


def test_small_updates_write_little(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    own = index.build(d, "doc_id", tokens())
    size = segments.bytes_of(spark, own.folder)
    new = index.update(own, d.filter("doc_id % 100 = 7"), "doc_id", tokens())
    assert new.n_docs == own.n_docs and segments.bytes_of(spark, own.folder) - size < 0.04 * size
    terms = text.code_terms("the thing ention")
    assert scores(new, terms) == scores(own, terms)
    plan = new.postings(["the"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:200]


def test_writers_that_die_or_race(spark):
    own = index.build(rows_of(spark, {1: "alpha", 2: "beta"}), "id", tokens())
    kept = own.version
    segments.with_dead(spark, kept, spark.createDataFrame([(1,)], "key long"))  # dies before its manifest
    assert index.opened(spark, own.folder).version == kept and scores(index.opened(spark, own.folder), ["alpha"])
    newer = index.update(own, rows_of(spark, {3: "alpha gamma"}), "id", tokens())
    with pytest.raises(segments.Outdated):
        index.update(own, rows_of(spark, {4: "x"}), "id", tokens())
    assert index.opened(spark, own.folder).version == newer.version and index.opened(spark, own.folder, 1).version == kept
    apart = index.forked(own)
    assert scores(index.update(apart, rows_of(spark, {4: "alpha"}), "id", tokens()), ["alpha"]).keys() == {1, 4}
    assert scores(newer, ["alpha"]).keys() == {1, 3}
    nothing = index.update(newer, rows_of(spark, {1: "x"}).limit(0), "id", tokens(), spark.createDataFrame([(1,), (2,), (3,), (9,)], "id long"))
    assert nothing.n_docs == 0 and nothing.mean == 1.0 and scores(nothing, ["alpha"]) == {}
    assert index.holding_all(newer, ["alpha", "gamma"]).collect()[0].key == 3


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_recall_of_cells(spark, sf):
    e = spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet")
    column = next(c for c, k in e.dtypes if k.startswith("array"))
    own = vectors.build(e, "vec_id", column)
    asked = e.select(F.col("vec_id").alias("key"), F.col(column).alias("vec"))
    found = {(r.query, r.key) for r in vectors.search_many(own, asked, 10).collect()}
    rows = asked.collect()
    m = np.array([r.vec for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    keys = np.array([r.key for r in rows])
    true = {(int(keys[i]), int(keys[j])) for i, s in enumerate(m @ m.T) for j in np.lexsort((keys, -s))[:10]}
    recall = len(found & true) / len(true)
    print(f"sf{sf}: {len(rows)} vectors, {len(own.centroids)} cells, {own.probes} read, recall {recall:.4f}")
    assert recall >= 0.95
    exact = {(r.query, r.key) for r in vectors.search_many(own, asked, 10, exact=True).collect()}
    assert len(exact & true) >= 0.999 * len(true)  # all but ties in the last digit


def test_vector_changes(spark):
    rng = np.random.default_rng(2)
    base = {i: rng.normal(size=8).tolist() for i in range(120)}
    frame = lambda rows: spark.createDataFrame([(k, v) for k, v in rows.items()], "id long, v array<double>")
    own = vectors.build(frame(base | {900: [0.0] * 8, 901: None, 902: [1.0, 2.0], 903: [float("nan")] * 8}), "id", "v", cells=6)
    assert own.count == 120

    def wanted(rows, query):
        score = {k: float(np.dot(v, query) / np.linalg.norm(v) / np.linalg.norm(query)) for k, v in rows.items()}
        return sorted(score, key=lambda k: (-score[k], k))[:5]

    query = base[7]
    assert [r.key for r in vectors.search(own, query, 5, exact=True).collect()] == wanted(base, query)
    changed = {7: rng.normal(size=8).tolist(), 500: query}
    new = vectors.upsert(own, frame(changed), "id", "v", spark.createDataFrame([(3,), (777,)], "id long"))
    now = {k: v for k, v in {**base, **changed}.items() if k != 3}
    assert new.count == len(now) and [r.key for r in vectors.search(new, query, 5, exact=True).collect()] == wanted(now, query)
    assert [r.key for r in vectors.search(own, query, 1, probes=1).collect()] == [7] and vectors.search(new, query, 1, probes=1).first().key == 500
    less = vectors.delete(new, spark.createDataFrame([(500,)], "id long"), "id")
    assert 500 not in {r.key for r in vectors.search(less, query, 200, exact=True).collect()} and less.count == len(now) - 1
    owners = spark.createDataFrame([(k,) for k in range(50)], "key long")
    small = vectors.compact(less, owners=owners)
    assert small.count == 49 and len(small.version.segments) == 1 and not small.version.dead
    assert {r.key for r in vectors.search(small, query, 200, exact=True).collect()} == set(range(50)) - {3}
    none = vectors.build(frame(base).limit(0), "id", "v")
    assert none.count == 0 and vectors.search(none, query, 3).count() == 0
    assert vectors.search_many(own, frame({1: base[1], 2: [0.0] * 8}).select(F.col("id").alias("key"), F.col("v").alias("vec")), 1).collect()[0].key == 1

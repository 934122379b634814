"""Language model, classifier and packing."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest

from devquarry.llm import kneser_ney, packing, toxicity


def brute(train, test, n):
    tokens = lambda t: [*(t or "").lower().split(), "</e>"]
    counts, words = {n: Counter()}, Counter()
    for t in train:
        w = ["<s>"] * (n - 1) + tokens(t)
        words.update(tokens(t))
        counts[n].update(tuple(w[i - n + 1 : i + 1]) for i in range(n - 1, len(w)))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: (0, *kneser_ney.discounts(np.array([sum(v == j for v in counts[k].values()) for j in (1, 2, 3, 4)]))) for k in counts}

    def p(context, w):
        k = len(context) + 1
        own = {g: v for g, v in counts[k].items() if g[:-1] == context}
        total = sum(own.values())
        lower = p(context[1:], w) if k > 1 else 1 / (len(words) + 1)
        if not total:
            return lower
        c = own.get((*context, w), 0)
        return (c - d[k][min(c, 3)]) / total + sum(d[k][min(v, 3)] for v in own.values()) / total * lower

    out = []
    for t in test:
        w = ["<s>"] * (n - 1) + tokens(t)
        out.append(sum(math.log10(p(tuple(w[i - n + 1 : i]), w[i])) for i in range(n - 1, len(w))))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_kneser_ney(spark, order):
    train = ["a b a b c", "A c d\n e", "", None, "the cat sat on the mat", "the cat ate the rat on the mat", *["x y z a b"] * 3]
    test = ["a b c", "unknown a b", "", None, "the cat on the x"]
    frame = lambda x: spark.createDataFrame(list(enumerate(x)), "doc_id long, text string")
    model = kneser_ney.train(frame(train), order, shard_bytes=16)
    found = {r.doc_id: r for r in kneser_ney.score(frame(test), model).collect()}
    for i, wanted in enumerate(brute(train, test, order)):
        assert found[i].score == pytest.approx(wanted, abs=1e-9)
    empty = kneser_ney.train(frame([]), order)
    assert kneser_ney.score(frame(["a b"]), empty).first().score == pytest.approx(0.0)


def test_counterfactual_penalty():
    """Identity terms that go with toxic labels keep no weight of their own under the penalty."""
    rng = np.random.default_rng(1)
    filler = [f"w{i}" for i in range(40)]
    sentences, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = set(rng.choice(filler, 8))
        if toxic:
            words |= {"awful"} if rng.random() < 0.7 else set()
            words |= {"muslim"} if rng.random() < 0.8 else set()
        elif rng.random() < 0.1:
            words |= {"christian"}
        sentences.append(words)
        labels.append(int(toxic))
    rows = [toxicity.hashed(s) for s in sentences]
    swapped = [toxicity.hashed({toxicity.SWAP.get(w, w) for w in s}) if s & toxicity.SWAP.keys() else np.empty(0, np.uint32) for s in sentences]
    plain = toxicity.fit(labels, rows, swapped, penalty=0.0)
    fair = toxicity.fit(labels, rows, swapped, penalty=20.0)
    gap = lambda m: abs(m.word("muslim") - m.word("christian"))
    assert gap(fair) < 0.25 * gap(plain)
    assert fair.word("awful") > 1
    neutral = "a muslim went to the shop with w1"
    assert fair.score(neutral, {}) < 0.7


def test_toxicity_columns(spark):
    rows = [(i, f"word{i % 7} " + ("scumlike idiot" if i % 4 == 0 else "fine day")) for i in range(200)] + [(900, None), (901, ""), (902, "x" * 50000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(900, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    found = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(found) == 203 and found[900].score == found[901].score
    assert toxicity.train(docs.limit(0), labels) == toxicity.Model()


def test_boundaries():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(1, 9))
        units, counts, most = np.sort(rng.choice(40, n, replace=False)), rng.integers(1, 9, n), int(rng.integers(1, 5))
        cost = lambda ends: sum(int(c) * (min(e for e in ends if e >= u) - u) for u, c in zip(units, counts))  # noqa: B023, E731
        best = min(cost([*x, units[-1]]) for m in range(min(most, n)) for x in itertools.combinations(units[:-1], m))
        found = packing.boundaries(units, counts, most)
        assert cost(found) == best and len(found) <= most


def test_batches(docs, texts, nothing):
    found = packing.pack(docs, buckets=4, budget=300).collect()
    assert sorted(r.doc_id for r in found) == sorted(i for i, _ in texts)
    batches = {}
    for r in found:
        assert r.n_tokens + r.padding == r.boundary >= 0 <= r.padding
        batches.setdefault((r.bucket, r.batch_id), []).append(r)
    for own in batches.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert len(own) == 1 or len(own) * own[0].boundary <= 300
    assert packing.pack(nothing).count() == 0

"""Rows that repeat an id, with equal and with other texts, null ids and empty tables, against brute force."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from devquarry.llm import minhash, packing, recompression, suffix_array
from devquarry.llm.common import cut, shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ver string, id int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    pool = [" ".join(f"{rng.choice('abcdef')}{rng.randrange(40)}" for _ in range(60)) for _ in range(8)]
    a, b, c = pool[0] + " a-end", pool[1] + " b-end", pool[2]
    out = [(1, a), (2, a), (2, b), (3, b), (3, b), (3, c), (9, c), (None, a), (None, None), (4, None), (4, ""), (5, " ")]
    for _ in range(60):
        out.append((rng.randrange(20, 40), " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 4)))))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, 1, "v", 7) for i, t in rows], SCHEMA).repartition(4)


def counted(found):
    return Counter(map(tuple, found))


def test_words_by_row(spark, rows):
    span, first = 50, {}
    words = [WORD.findall(t or "") for _, t in rows]
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - span + 1) if i is not None else ():
            key = tuple(w[k : k + span])
            first[key] = min(first.get(key, i), i)
    wanted = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - span + 1) if i is not None else ():
            if first[tuple(w[k : k + span])] < i:
                gone.update(range(k, k + span))
        wanted.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    found = recompression.remove_repeats(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert counted(found) == counted(wanted)


@pytest.mark.parametrize("options", [{}, {"gram": 7, "rows_each": 3, "shard_bytes": 2000}])
def test_bytes_by_row(spark, rows, options):
    span = 40
    seen = Counter(b[k : k + span] for i, t in rows if i is not None for b in [(t or "").encode()] for k in range(len(b) - span + 1))
    wanted = []
    for i, t in rows:
        b = (t or "").encode()
        keep = bytearray(b"\1" * len(b))
        for k in range(len(b) - span + 1) if i is not None else ():
            if seen[b[k : k + span]] > 1:
                keep[k : k + span] = bytes(span)
        wanted.append((i, len(b), keep.count(0), bytes(c for c, k in zip(b, keep) if k)))
    found = suffix_array.remove_repeats(frame(spark, rows), span, **options).select("doc_id", "n_bytes", "n_removed", "kept").collect()
    assert counted((r[0], r[1], r[2], bytes(r[3])) for r in found) == counted(wanted)


def components(rows, width, percent):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        sets.append(({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()) if i is not None else set())
    own = list(range(len(rows)))

    def root(x):
        while own[x] != x:
            x = own[x]
        return x

    for x, a in enumerate(sets):
        for y in range(x):
            if a and sets[y] and 100 * len(a & sets[y]) >= percent * len(a | sets[y]):
                own[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    return [least.get(root(x)) for x in range(len(rows))]


@pytest.mark.parametrize("percent", [50, 80])
def test_near_by_row(spark, rows, percent):
    wanted = [(i, c, c == i) for (i, _), c in zip(rows, components(rows, 2, percent))]
    found = minhash.near_duplicates(frame(spark, rows), width=2, percent=percent).select("doc_id", "component_id", "kept").collect()
    assert counted(found) == counted(wanted)


def test_no_text_leaves_the_pipeline_unseen(spark, rows):
    """Each deduplication keeps a row of every text or class, whichever ids repeat."""
    docs = frame(spark, rows)
    one = cut(corpus_pipeline.exact_dedup(spark, docs, ""), shared_dir(spark), "one")
    assert one.columns == docs.columns
    assert {r.text or "" for r in one.collect()} == {t or "" for _, t in rows}
    left = [(r.doc_id, r.text) for r in one.collect()]
    two = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, one, "").collect()]
    wanted = [(i, t) for (i, t), c in zip(left, components(left, 5, 80)) if c == i]
    assert counted(two) == counted(wanted)


def test_empty_tables(spark, rows):
    nothing = frame(spark, rows).limit(0)
    for f in (minhash.near_duplicates, recompression.remove_repeats, suffix_array.remove_repeats, packing.pack):
        assert f(nothing).count() == 0
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, nothing, "").count() == 0


def test_packing_takes_every_row(spark, rows):
    found = packing.pack(frame(spark, rows), buckets=4, budget=500).collect()
    assert counted((r.doc_id, r.n_tokens) for r in found) == counted((i, len(WORD.findall(t or ""))) for i, t in rows)
    assert len({(r.bucket, r.batch_id, r.slot) for r in found}) == len(rows)
    assert all(r.padding == r.boundary - r.n_tokens >= 0 for r in found)

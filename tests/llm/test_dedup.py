"""Duplicate operators against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from devquarry.llm import exact_dedup, minhash, recompression, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_exact(spark, docs, texts, nothing):
    groups = defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    found = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect()}
    assert len(found) == len(texts)
    for i, t in texts:
        own = groups[t or ""]
        assert (found[i].keep_id, found[i].group_size, found[i].kept) == (max(own), len(own), i == max(own))
        assert found[i].text_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert exact_dedup.exact_groups(nothing).count() == 0
    again = exact_dedup.exact_groups(docs.filter("doc_id in (1, 2)").union(docs.filter("doc_id = 1"))).collect()
    assert sorted((r.doc_id, r.group_size) for r in again) == [(1, 2), (1, 2), (2, 1)]
    null = exact_dedup.exact_groups(spark.createDataFrame([(None, "x"), (1, "x")], "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.keep_id, r.group_size) for r in null) == [(0, 1, 2), (1, 1, 2)]


def test_chunks_of_one_hash(spark, docs, texts):
    """Different chunks of one hash get numbers; rows that repeat an id are counted each."""
    weak = lambda c: F.length(c).cast("long") % 3
    rows = docs.union(docs.filter("doc_id in (0, 1, 151, 159)")).union(docs.filter("doc_id = 1"))
    wanted = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(rows).collect())
    found = exact_dedup.exact_groups(rows, chunk_hash=weak).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == wanted and len(found) == len(texts) + 5
    sizes, groups = {r.doc_id: r.group_size for r in found}, Counter((t or "") for _, t in texts)
    assert sizes[159] == 2 and sizes[1] >= 3 and sizes[151] >= groups[""] + 1


def test_chunks_make_the_text(docs, spark):
    assert docs.filter(F.array_join(exact_dedup.chunks(F.col("text")), "") != F.col("text")).count() == 0


@pytest.mark.parametrize("width", [2, 5])
def test_near(docs, texts, nothing, width):
    sets = {}
    for i, t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    found = {r.doc_id: r for r in minhash.near_duplicates(docs, width=width).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in found.items()} == {i: (len(sets[i]), root(i), root(i) == i) for i in sets}
    if width == 2:
        assert minhash.near_duplicates(nothing, width=2).count() == 0


@pytest.mark.parametrize("span,rounds", [(10, 0), (10, 4), (50, 4)])
def test_words(docs, texts, nothing, span, rounds):
    words, first = {i: WORD.findall(t or "") for i, t in texts}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - span + 1):
            first.setdefault(tuple(words[i][k : k + span]), i)
    found = {r.doc_id: r for r in recompression.remove_repeats(docs, span, rounds).collect()}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - span + 1):
            if first[tuple(w[k : k + span])] < i:
                gone.update(range(k, k + span))
        assert (found[i].n_words, found[i].n_removed, found[i].kept) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)), i
    if span == 50:
        assert recompression.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("options", [{}, {"gram": 7, "rows_each": 3, "shard_bytes": 2000}])
def test_bytes(docs, texts, nothing, options):
    span = 40
    raw = {i: (t or "").encode() for i, t in texts}
    seen = Counter(b[k : k + span] for b in raw.values() for k in range(len(b) - span + 1))
    found = {r.doc_id: r for r in suffix_array.remove_repeats(docs, span, **options).collect()}
    for i, b in raw.items():
        keep = bytearray(b"\1" * len(b))
        for k in range(len(b) - span + 1):
            if seen[b[k : k + span]] > 1:
                keep[k : k + span] = bytes(span)
        runs = len(re.findall(rb"\0+", keep))
        assert (found[i].n_bytes, found[i].n_removed, found[i].n_spans, bytes(found[i].kept)) == (len(b), keep.count(0), runs, bytes(c for c, k in zip(b, keep) if k)), i
    if not options:
        assert suffix_array.remove_repeats(nothing).count() == 0

"""Change points, rendezvous shards and fill-in-middle forms against plain versions."""

import datetime
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from devquarry.llm import change_points, fill_in_middle, registry, rendezvous

SF = "/root/testdata/sf0.001"


def plain(values, least, penalty):
    """All prefixes in order, keys of (cost, segments, starts from the last backwards)."""
    n = len(values)

    def cost(a, b):
        own = values[a:b]
        m, s, q = b - a, sum(own), sum(x * x for x in own)
        return m * math.floor(1000 * math.log(1 + (m * q - s * s) // (m * m)))

    if n < least:
        return cost(0, n), 1, (0,)
    best = {0: (0, 0, ())}
    for e in range(least, n + 1):
        tried = [(best[s][0] + cost(s, e) + (penalty if s else 0), best[s][1] + 1, (s, *best[s][2])) for s in best if e - s >= least]
        best[e] = min(tried)
    return best[n]


def series(rng, kind):
    n = rng.choice([1, 3, 6, 7, 8, 13, 14, 15, 21, 40, 90])
    if kind == "flat":
        return [5] * n
    if kind == "big":
        return [rng.randrange(10**12) for _ in range(n)]
    out, level, width = [], 0, 1
    for _ in range(n):
        if rng.random() < 0.08:
            level, width = rng.randrange(3000), rng.choice([1, 2, 40, 900])
        out.append(max(level + rng.randrange(width), 0) if rng.random() < 0.9 else 0)
    return out


@pytest.mark.parametrize("least,penalty", [(7, 20000), (7, 0), (3, 2000), (1, 500), (2, 0)])
@pytest.mark.parametrize("kind", ["steps", "flat", "big"])
def test_segments(least, penalty, kind):
    rng = random.Random(f"{least}{penalty}{kind}")
    for _ in range(25):
        values = series(rng, kind)
        days = [d for d in range(len(values)) if values[d] or d in (0, len(values) - 1)]
        found = change_points.segments([100 + d for d in days], [values[d] for d in days], least, penalty)
        cost, count, starts = plain(values, least, penalty)
        assert [r[1] - 100 for r in found] == list(starts[::-1])
        assert {(r[6], r[7]) for r in found} == {(count, cost)}
        assert [r[0] for r in found] == list(range(1, count + 1)) and sum(r[2] for r in found) == len(values)
        assert sum(r[3] for r in found) == sum(values)


def test_blocks_of_a_long_series(monkeypatch):
    rng = random.Random(1)
    values = [rng.randrange(50) + 400 * (k // 60 % 2) for k in range(300)]
    wanted = change_points.segments(list(range(300)), values, 7, 20000)
    monkeypatch.setattr(change_points, "CELLS", 2000)
    assert change_points.segments(list(range(300)), values, 7, 20000) == wanted


def test_bounds_are_bounds():
    rng = np.random.default_rng(3)
    values = [int(x) for x in rng.integers(0, 900, 70)]
    bound = change_points.Series(values, 7, 20000).lower_bounds()
    assert all(bound[e] <= plain(values[:e], 7, 20000)[0] for e in range(7, 71)) and bound[70] > 0


def test_op13(spark):
    sums = defaultdict(Counter)
    for r in pq.read_table(f"{SF}/sale_lines.parquet").to_pylist():
        if r["flag"] == "kept" and r["quantity"] is not None and r["shipped_at"] is not None:
            sums[r["vendor_id"]][(r["shipped_at"].date() - datetime.date(1970, 1, 1)).days] += r["quantity"]
    found = defaultdict(list)
    for r in registry.queries()["op13_change_points"](spark, SF).collect():
        found[r.vendor_id].append(r)
    assert set(found) == set(sums)
    for vendor, own in found.items():
        own.sort(key=lambda r: r.segment_no)
        first, last = min(sums[vendor]), max(sums[vendor])
        values = [sums[vendor][d] for d in range(first, last + 1)]
        cost, count, starts = plain(values, 7, 20000)
        assert [r.first_day - first for r in own] == list(starts[::-1]) and {(r.n_segments, r.best_cost) for r in own} == {(count, cost)}
        for r in own:
            part = values[r.first_day - first :][: r.n_days]
            assert r.total == sum(part) and r.spread == 1 + (r.n_days * sum(x * x for x in part) - r.total**2) // r.n_days**2
            assert r.cost == r.n_days * math.floor(1000 * math.log(r.spread))


def test_change_points_of_odd_rows(spark):
    day = datetime.date(2024, 1, 1)
    rows = [(None, day, 4, "x"), (None, day, 4, "x"), ("a", day, None, "x"), ("a", None, 3, "x"), ("b", day, 1, "x"), ("b", day + datetime.timedelta(30), 1, "x")]
    df = spark.createDataFrame(rows, "who string, on date, value int, total string")
    found = {r.who: r for r in change_points.change_points(df, "who", "on", "value").collect()}
    assert set(found) == {None, "b"} and found[None].total == 8 and (found["b"].n_days, found["b"].total) == (31, 2)
    assert change_points.change_points(df.limit(0), "who", "on", "value").count() == 0


def test_op12(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    rows = registry.queries()["op12_rendezvous"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    slots = defaultdict(list)
    for r in rows:
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]), "key")
        assert r.grown_shard in (r.shard, 24) and 0 <= r.shard < 24
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_by_weight(spark):
    keys = spark.range(40000)
    weights = [1.0, 2.0, 5.0]
    rows = keys.select("id", rendezvous.shard_of(F.col("id"), weights).alias("a"), rendezvous.grown_shard_of(F.col("id"), weights, 2.0).alias("b"), rendezvous.shard_of(F.col("id"), [1.0, 2.0]).alias("c")).collect()
    counts = Counter(r.a for r in rows)
    assert all(abs(counts[i] / 40000 - w / 8) < 0.01 for i, w in enumerate(weights))
    moved = [r for r in rows if r.a != r.b]
    assert {r.b for r in moved} == {3} and abs(len(moved) / 40000 - 0.2) < 0.01
    assert all(r.a == r.c for r in rows if r.a < 2)  # a shard that leaves moves its own records alone
    with pytest.raises(ValueError):
        rendezvous.shard_of(F.col("id"), [1.0, 0.0])


def test_shards_of_odd_rows(spark, docs, nothing, texts, monkeypatch):
    monkeypatch.setattr(rendezvous, "BLOCK", 7)
    many = docs.union(spark.createDataFrame([(None, "x", "en", None, 1, "w")] * 50, docs.schema))
    rows = rendezvous.sharded(many, [1.0] * 3).collect()
    assert Counter(r.doc_id for r in rows) == Counter([i for i, _ in texts] + [None] * 50)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert rendezvous.sharded(nothing, [1.0]).count() == 0


@pytest.mark.parametrize("text", ["", "a", "abc" * 700, "é" * 900, "aé漢😀" * 300, "漢" * 5000, "😀"])
def test_boundary_lists(text):
    raw = text.encode()
    n, *own = fill_in_middle.boundary_list(raw)
    assert n == len(text)
    assert [fill_in_middle.boundary(k, *own) for k in range(n + 1)] == [len(text[:k].encode()) for k in range(n + 1)]


def wanted_form(i, text):
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("weak", [False, True])
def test_forms(spark, docs, nothing, texts, weak, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "HEAVY", 20)
    odd = [(900 + i, t) for i, t in enumerate(["<P> of", "a <S> b", "x<M>", "<", "<<P", "é<", "hot 漢"])] + [(1000 + i, "hot 漢") for i in range(80)] + [(None, "no id"), (7, "<S"), (7, "<S")]
    rows = docs.union(spark.createDataFrame([(i, t, "en", None, 1, "w") for i, t in odd], docs.schema))
    option = {"fingerprint": lambda text: F.length(text).cast("long") % 3} if weak else {}
    found = fill_in_middle.fill_in_middle(rows, **option).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    wanted = [(i, *wanted_form(i, t or ""), t or "") for i, t in [*texts, *odd]]
    assert Counter(map(tuple, found)) == Counter(wanted)
    assert fill_in_middle.fill_in_middle(nothing).count() == 0

"""Steps whose shuffles must not grow faster than their input, with odd rows, against plain Python."""

import datetime as dt
import math
import random
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from devquarry.functions import scopes
from devquarry.operators import chunking, cluster, delivery, diffs, entities, graph, identity, index, vectors


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_callers_are_made_once_without_a_shuffle(spark):
    rng = random.Random(1)
    calls = [(rng.randrange(60), rng.randrange(40)) for _ in range(260)] + [(7, c) for c in range(40)] + [(s, 3) for s in range(50)] + [(None, 3), (5, None)] + [(7, 3)] * 3
    df = spark.createDataFrame(calls, "src long, callee long")
    known = {c for c in calls if None not in c}
    wanted = sorted({(a, b) for a, x in known for b, y in known if x == y and a != b})
    for bounds in ((64, 4096), (2, 8), (5, 4096)):
        assert sorted(map(tuple, chunking.tests_of_same(df, *bounds).collect())) == wanted, bounds
    text = plan(chunking.tests_of_same(df))
    above = text[: text.index("SortMergeJoin")]
    assert "Exchange" not in above and "HashAggregate" not in above


def test_first_commits_are_found_without_a_join(spark):
    rng, day = random.Random(2), dt.datetime(2024, 1, 1)
    at = lambda: day + dt.timedelta(hours=rng.randrange(200) / 2)
    deploys = [(f"d{i % 70}", f"r{i % 3}", "production", "success", at()) for i in range(90)] + [("x", None, "production", "success", day), ("y", "r0", "production", "success", None), ("z", "r0", "staging", "success", day)]
    commits = [(f"c{i}", f"r{i % 4}", at(), i % 2 == 0) for i in range(60)] + [("n", None, day, True), ("m", "r0", None, True)]
    deploys.append(("micro", "r9", "production", "success", day + dt.timedelta(microseconds=10)))
    commits += [("late", "r9", day + dt.timedelta(microseconds=20), True), ("early", "r9", day + dt.timedelta(microseconds=5), False)]
    first = {}
    for d, r, e, s, t in deploys:
        for c, q, u, flag in commits:
            if e == "production" and s == "success" and r is not None and r == q and t and u and t < u <= t + dt.timedelta(hours=24):
                first[d] = min(first.get(d, (u, c, flag)), (u, c, flag))
    wanted = sorted((d, c) for d, (_, c, flag) in first.items() if flag)
    left = spark.createDataFrame(deploys, "deploy_id string, repo string, environment string, status string, triggered_at timestamp")
    right = spark.createDataFrame(commits, "sha string, repository string, timestamp timestamp, flag boolean")
    out = delivery.first_after(left, right, 24, F.col("flag"))
    assert ("micro", "late") in wanted and sorted(map(tuple, out.collect())) == wanted
    assert "Join" not in plan(out)


def test_keyed_words_are_not_broadcast_and_scored_once(spark):
    words = ["", "a", "ab", "supplier#000000012o", "supplier#000000120", "maria", "mariah", "marai", "\0b", "jürgen müller", "jurgen muller"]
    df = spark.createDataFrame([(w,) for w in [*words, None]], "word string")
    wanted = sorted((a, b, identity.winkler(a, b)) for a in words for b in words if identity.winkler(a, b) >= 0.85)
    out = identity.alike(df, df, 0.85)
    assert sorted(map(tuple, out.collect())) == wanted
    text = plan(out)
    assert "BroadcastHashJoin" not in text and "ArrowEvalPython" not in text
    a, b = (pd.Series(x) for x in zip(*((a, b) for a in words for b in words)))
    sure = identity.likely(a, b, 0.85)
    assert all(k or identity.winkler(x, y) < 0.85 for x, y, k in zip(a, b, sure)) and not sure.all()


def test_near_emails_are_not_broadcast_and_none_is_lost(spark):
    rng = random.Random(3)
    mails = {f"{''.join(rng.choice('ab0') for _ in range(n))}@{d}" for n in (3, 3, 4, 5, 6, 23, 24, 25) for d in ("co.com", "mail.co.com", "x.org") for _ in range(12)}
    base = "abcdefghijklmnopqrstuvwx"
    mails |= {f"{w}@co.com" for w in (base, base[1:], base + "y", base[1:] + "zz", base[::-1], "\0bcd", "\0bce", "あ", "い", "ab", "aab", "aba")}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            last, row = row, [i]
            for j, e in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != e)))
        return row[-1]

    wanted = set()
    for x in mails:
        for y in mails:
            (a, d), (b, e) = x.split("@"), y.split("@")
            if x < y and min(len(a.encode()), len(b.encode())) >= 3 and (d.endswith(e) or e.endswith(d)) and edits(a, b) in (1, 2):
                wanted.add((x, y, edits(a, b)))
    out = identity.near_emails(spark.createDataFrame([(m,) for m in sorted(mails)], "email string"))
    rows = out.select("first", "second", "edits").collect()
    assert len(wanted) > 100 and sorted(map(tuple, rows)) == sorted(wanted)
    text = plan(out)
    assert "piece" not in "".join(line for line in text.splitlines() if "BroadcastHashJoin" in line)


def test_chunks_alike_have_one_score_whatever_order_their_terms_arrive_in(spark):
    alike = [(k, ["ention", "the", "thing"] + [f"w{k % 7}"] * 1) for k in range(400)]
    other = [(1000 + k, ["the"] + (["thing"] if k % 3 == 0 else []) + [f"v{k}"] * (k % 5)) for k in range(300)]
    chunks = spark.createDataFrame(alike + other + [(5000, []), (5001, None)], "key long, terms array<string>")
    found = index.search(index.build(chunks, "key", F.col("terms")), ["the", "thing", "ention"], 40).collect()
    assert [r.key for r in found] == list(range(40)) and len({r.score for r in found}) == 1
    text = plan(index.search(index.build(chunks, "key", F.col("terms")), ["the", "thing", "ention"]))
    assert "collect_list" in text and "sum(" not in text


def test_terms_are_counted_in_their_row(spark):
    rows = [(1, ["b", "a", "b", "b"]), (2, ["x"]), (3, []), (4, None), (5, ["d", "c"]), (6, ["é", "e", "é"])]
    told = spark.createDataFrame(rows, "key long, all array<string>").withColumn("length", F.size("all").cast("long"))
    out = index.counted(told)
    wanted = sorted((k, len(w), t, w.count(t)) for k, w in rows if w for t in set(w))
    assert sorted(map(tuple, out.select("key", "length", "term", "tf").collect())) == wanted
    assert "Exchange" not in plan(out)


def test_near_vectors_are_compared_as_matrices(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 8)).round(1)
    data = [(i, base[i % 60].tolist()) for i in range(300)] + [(900, [0.0] * 8), (901, None), (902, [1.0, 2.0])]
    rows = spark.createDataFrame(data, "id long, vec array<double>")
    own = vectors.build(rows, "id", "vec")
    asked = rows.filter("id % 10 = 0").select(F.col("id").alias("key"), "vec")

    def score(a, b):  # in the order of the dimensions
        unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
        total = 0.0
        for x, y in zip(unit(a), unit(b)):
            total += x * y
        return total

    wanted = sorted((q, r, k) for q, a in data[:300:10] for r, (_, k) in enumerate(sorted((-score(a, b), k) for k, b in data[:300])[:7], 1))
    out = vectors.search_many(own, asked, 7, exact=True)
    assert sorted((r.query, r.rank, r.key) for r in out.collect()) == wanted
    assert "FlatMapCoGroupsInArrow" in plan(out)
    many = vectors.best_of(base, np.repeat(base, 40, axis=0), [f"{i:05d}" for i in range(2400)][::-1], 5)
    assert [int(x) for x in many[1][:5]] == [39, 38, 37, 36, 35] and len(many[0]) == 300


def test_louvain_moves_as_over_dictionaries_in_less_memory(spark, monkeypatch):
    def plain(pdf, passes=32):
        names = np.unique(np.concatenate([pdf["src"], pdf["dst"]]))
        weights: dict[int, dict[int, float]] = {i: {} for i in range(len(names))}
        for a, b, w in zip(np.searchsorted(names, pdf["src"]).tolist(), np.searchsorted(names, pdf["dst"]).tolist(), pdf["weight"].tolist(), strict=True):
            weights[a][b] = weights[a].get(b, 0.0) + w
            if a != b:
                weights[b][a] = weights[b].get(a, 0.0) + w
        belongs = np.arange(len(names))
        while True:
            community = {i: i for i in weights}
            degree = {i: sum(w.values()) + w.get(i, 0.0) for i, w in weights.items()}
            total, inside = sum(degree.values()), dict(degree)
            moved_ever = False
            for _ in range(passes if total else 0):
                moved = False
                for i in sorted(weights):
                    links: dict[int, float] = {}
                    for j, w in weights[i].items():
                        if j != i:
                            links[community[j]] = links.get(community[j], 0.0) + w
                    own = community[i]
                    inside[own] -= degree[i]
                    gain = lambda c: links.get(c, 0.0) - inside[c] * degree[i] / total  # noqa: B023, E731
                    best = own
                    for c in sorted(links):
                        if gain(c) > gain(best) + 1e-12:
                            best = c
                    inside[best] += degree[i]
                    community[i] = best
                    moved |= best != own
                moved_ever |= moved
                if not moved:
                    break
            if not moved_ever:
                break
            belongs = np.array([community[b] for b in belongs])
            merged: dict[int, dict[int, float]] = {c: {} for c in set(community.values())}
            for i, own in weights.items():
                for j, w in own.items():
                    a, b = community[i], community[j]
                    merged[a][b] = merged[a].get(b, 0.0) + (w if a != b or i != j else w)
            for c in merged:
                if c in merged[c]:
                    merged[c][c] /= 2
            weights = merged
        least = {c: names[belongs == c].min() for c in np.unique(belongs)}
        return sorted((int(n), int(least[c])) for n, c in zip(names, belongs))

    rng = random.Random(4)
    for n, m in ((12, 20), (40, 60), (120, 900)):
        pairs = [(rng.randrange(n) // rng.choice([1, 1, 3]), rng.randrange(n)) for _ in range(m)] + [(n + 5, n + 5)]
        df = spark.createDataFrame(pairs, "src long, dst long")
        summed = pd.DataFrame([(min(p), max(p)) for p in pairs], columns=["src", "dst"]).assign(weight=1.0).groupby(["src", "dst"], as_index=False).sum()
        out = graph.louvain(df)
        assert sorted(map(tuple, out.collect())) == plain(summed)
    assert "FlatMapGroupsInArrow" in plan(out)
    monkeypatch.setattr(graph, "ENTRIES", 7)
    rows, cols, w = np.array([0, 0, 0, 0, 0, 0, 0, 0, 3, 1, 3]), np.arange(11), np.arange(11) + 0.5
    starts, columns, weights = graph.adjacency([(rows, cols, w), (np.array([1]), np.array([4]), np.array([2.0]))], 4)
    assert starts.tolist() == [0, 8, 10, 10, 12] and sorted(zip(columns[8:10].tolist(), weights[8:10].tolist())) == [(4, 2.0), (9, 9.5)]


def test_entities_of_many_lines_in_a_string_take_linear_time():
    began = time.process_time()
    found = entities.rust_entities('fn f() { let t = "' + "a\n" * 8000 + '"; }\n \t\n use a::b;')
    assert time.process_time() - began < 1
    assert found[0][:3] == ("LiteralString", 17, 16019) and [e[0] for e in found[1:]] == ["ModulePath"]
    assert [e[0] for e in entities.rust_entities("\n \t\n use Abc;\n type T = Vec<u8>;\nfn f() { x.unwrap() }")] == ["NamedType", "NamedType", "ErrorVariant", "TypeAlias"]


def test_forms_of_definitions_are_looked_up_once(monkeypatch):
    def never(*_):
        raise AssertionError("a form was looked up for a text")

    monkeypatch.setattr(scopes.regex, "finditer", never)
    own, size = scopes.definitions("fn f(a: u8) {\n  words of prose; if a || b { x.map(|y| y ?? z) }\n}\n", "rust")
    assert [(d["name"], d["cyclomatic"], d["parameters"], d["end_line"]) for d in own] == [("f", 4, 1, 3)] and size[0] == 4


def test_words_of_texts_are_hashed_once():
    cluster.word_hash.cache_clear()
    found = cluster.words(["abc Abc x9 " * 50, "abc, é", ""])
    assert cluster.word_hash.cache_info().misses == 3
    plain = sum(b * 31 ** (2 - i) for i, b in enumerate(b"abc")) % 256
    assert found[1, plain] == 1 and found[1].sum() == 1 and not found[2].any() and abs(float((found[0] ** 2).sum()) - 1) < 1e-6


def test_forms_of_names_are_tried_on_lines_with_their_word(spark):
    lines = ["+pub fn run_all(x: TypeName)", "-  private Foo2bar \r", "+++ class Head", "--- fn head", " fn same", "+fn \rclass Xy", "+\U0001d4eaBc \U0001d400bc Iⅷ \u01c5a Ünï ABC aB", "+fn as fn é if", "-", "+const  Ab", "+async fn zz(pub struct QqQ)"]
    df = spark.createDataFrame([("\r\n".join(lines),), ("",), (None,)], "d string").repartition(1)
    found = [r.n for r in df.select(diffs.changed_names(F.col("d"), 100).alias("n")).collect()]
    own = ["run_all", "TypeName", "Foo2bar", "\U0001d400bc", "Iⅷ", "Ünï", "zz", "QqQ"]
    assert found == [own, [], None]
    forms = [line for line in plan(df.select(diffs.changed_names(F.col("d"), 100))).splitlines() if "regexp_extract(" in line]
    assert forms and all("THEN regexp_extract(" in line and line.count("regexp_extract(") == line.count("THEN regexp_extract(") for line in forms)


def test_components_keep_no_edges_in_a_task(spark, monkeypatch):
    rows = [(1, 2), (2, 1), (1, 2), (3, 3), (9, 8), (8, 7), (7, 9), (20, 10), (10, 30), (30, 30), (None, 5), (6, None)] + [(100, i) for i in range(101, 400)] * 3 + [(i, i + 1) for i in range(500, 560)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    monkeypatch.setattr(graph, "undirected", None, raising=False)  # every edge in both directions, told apart
    found = graph.components(edges)
    wanted = {1: 1, 2: 1, 3: 3, 7: 7, 8: 7, 9: 7, 10: 10, 20: 10, 30: 10} | {i: 100 for i in range(100, 400)} | {i: 500 for i in range(500, 561)}
    assert sorted(map(tuple, found.collect())) == sorted(wanted.items())


def test_indexed_files_are_measured_once_whatever_diffs_change_them(spark):
    mixed = "+++ b/a.rs\n@@ -0,0 +2,1 @@\n+if x {{ y }}\n+++ b/{}.rs\n@@ -0,0 +1,2 @@\n+for a in b\n+\tif c && d"
    df = spark.createDataFrame([(i, mixed.format("n" if i % 2 else "m")) for i in range(6)], "id int, diff string")
    body = "fn f(a, b, c, d, e, g) {\n\t\tif x && y { z }\n          while q\n}"
    chunks = spark.createDataFrame([("a.rs", 5, 9, "for é in b"), ("a.rs", 1, 3, body), ("m.rs", 1, 1, None)], "file string, start_line long, end_line long, content string")
    out = diffs.reviewed_files(df, chunks)
    found = {(r.id, r.file, r.source, r.modified_chunks, r.cyclomatic, r.cognitive, tuple(x.category for x in r.smells)) for r in out.collect()}
    wanted = {(i, "a.rs", "indexed", 1, 5, 10, ("too_many_params", "missing_docstring")) for i in range(6)}
    wanted |= {(i, "n.rs", "new_file", None, 4, 5, ("missing_docstring",)) if i % 2 else (i, "m.rs", "indexed", 1, 1, 0, ("missing_docstring",)) for i in range(6)}
    assert found == wanted
    assert not any("old_text" in line for line in plan(out).splitlines() if "Join" in line or "coalesce(old_text" in line)
    assert "coalesce(old_text" not in plan(out)


def test_places_of_repeated_terms_are_found_once_a_row(spark):
    text = [f"w{i % 9000}" for i in range(18000)] + ["once"]
    told = spark.createDataFrame([(1, text, len(text))], "key long, all array<string>, length long")
    index.counted(told.limit(0)).collect()
    began = time.time()
    out = index.counted(told).groupBy("tf").agg(F.count("*").alias("n"), F.min("term").alias("first")).collect()
    assert sorted(map(tuple, out)) == [(1, 1, "once"), (2, 9000, "w0")]
    assert time.time() - began < 8  # 48 s when each term looked for all places


def test_names_of_a_graph_are_not_sorted_anew_for_each_piece(spark, monkeypatch):
    monkeypatch.setattr(graph, "ENTRIES", 400)
    rng, seen, plain = np.random.default_rng(3), [], np.unique
    monkeypatch.setattr(np, "unique", lambda values, *a, **k: seen.append(len(values)) or plain(values, *a, **k))
    own, pieces = graph.Names(), [rng.integers(0, 20000, 50) for _ in range(1000)]
    for piece in pieces:
        own.add(piece)
    assert own.all().tolist() == sorted(set(np.concatenate(pieces).tolist())) == own.all().tolist()
    assert sum(seen) < 6 * 50000  # some 10,000,000 when they were
    monkeypatch.undo()
    chain = spark.createDataFrame([(i, i + 1) for i in range(30000)], "src long, dst long").repartition(3)
    assert sorted(r.id for r in graph.louvain(chain).collect()) == list(range(30001))

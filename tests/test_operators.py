"""Operators that SQL does not express, and small numeric cases."""

import json

import numpy as np
import pandas as pd

from devquarry import queries
from devquarry.functions import text
from devquarry.operators import chunking, graph, identity, memory, ranges, retrieval
from devquarry.sources import files
from devquarry.streaming import tables, upsert
from pyspark.sql import functions as F


def test_intents():
    assert text.intent("callers of parse")[0] == "usage"
    assert text.intent("fn parse_tree")[0] == "definition"
    assert text.intent("how does ranking work") == ("conceptual", 0.8, 0.2, False)
    assert text.intent("xyz")[0] == "unknown"


def test_louvain_finds_two_clusters(spark):
    edges = [(a, b) for group in ("abcd", "wxyz") for i, a in enumerate(group) for b in group[i + 1 :]] + [("d", "w")]
    found = dict(graph.louvain(spark.createDataFrame(edges, "src string, dst string")).collect())
    assert {found[x] for x in "abcd"} == {"a"} and {found[x] for x in "wxyz"} == {"w"}


def test_shortest_path_and_components(spark):
    edges = spark.createDataFrame([("A", "B"), ("B", "C"), ("C", "D"), ("X", "Y")], "src string, dst string")
    assert [r.path for r in graph.shortest_path(edges, "A", "D", 5).collect()] == [["A", "B", "C", "D"]]
    assert graph.shortest_path(edges, "A", "Y", 5).count() == 0
    chain = spark.range(14).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("Calls").alias("kind"))
    assert graph.shortest_path(chain.select("src", "dst"), 0, 13, 20).first().path == list(range(14))
    seeds = spark.createDataFrame([(0,)], "id long")
    far = graph.reachable(chain, seeds, 40)
    assert {r.id: r.hop for r in far.collect()} == {i: i for i in range(1, 15)} and far._jdf.queryExecution().toString().count("Join") == 0
    assert {(r.id, r.hop, r.via) for r in graph.neighbours(chain, seeds, 40).collect()} == {(i, i, i - 1) for i in range(1, 15)}
    found = dict(graph.components(edges).collect())
    assert found == {"A": "A", "B": "A", "C": "A", "D": "A", "X": "X", "Y": "X"}


def test_fnv1a(spark):
    found = spark.createDataFrame([("",), ("a",), (None,)], "t string").select(memory.fnv1a("t")).collect()
    assert [r[0] if r[0] is None else r[0] % 2**64 for r in found] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, None]


def test_lcov_and_diffs(spark):
    report = spark.createDataFrame([("r", i, v) for i, v in enumerate("SF:a.py\nDA:1,3\nDA:2,0\nend_of_record\nSF:b.py\nDA:7,1".split("\n"))], "report string, number int, value string")
    hits = files.lcov(report)
    assert sorted(map(tuple, hits.collect())) == [("a.py", 1, 3), ("a.py", 2, 0), ("b.py", 7, 1)]
    diff = "diff --git a/a.py b/a.py\n--- a/a.py\n+++ b/a.py\n@@ -1,2 +1,3 @@\n+x = 1\n y = 2\n-z\n+w\n"
    diffs = spark.createDataFrame([(1, diff)], "id int, diff string")
    added = files.added_lines(diffs)
    assert sorted((r.file, r.line) for r in added.collect()) == [("a.py", 1), ("a.py", 3)]
    assert diffs.select(files.changed_files(F.col("diff"))).first()[0] == ["a.py"]
    out = ranges.coverage(added.select("file", "line"), hits).first()
    assert (out.instrumented, out.covered, out.percent) == (1, 1, 100.0)


def test_source_tree_and_sinks(spark, tmp_path):
    (tmp_path / "src/node_modules").mkdir(parents=True)
    (tmp_path / "src/a.py").write_text("x = 1")
    (tmp_path / "src/min.js").write_text("x" * 600)
    (tmp_path / "src/node_modules/b.py").write_text("no")
    assert [r.content for r in files.source_tree(spark, str(tmp_path / "src")).collect()] == ["x = 1"]
    df = spark.createDataFrame([("a", 1.234)], "name string, value double")
    files.write_csv(df, str(tmp_path / "csv"))
    files.write_json(df, str(tmp_path / "json"))
    files.write_markdown(df, str(tmp_path / "md"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first().value == "1.23"
    assert json.loads(spark.read.text(str(tmp_path / "json")).first()[0]) == {"name": "a", "value": 1.234}
    assert spark.read.text(str(tmp_path / "md"), wholetext=True).first()[0].rstrip().endswith("| a | 1.234 |")


def test_changes_are_applied_by_key(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "id int, content string, at int, removed boolean"
    pd.DataFrame([{"id": 1, "content": "a", "at": 1, "removed": False}, {"id": 2, "content": "b", "at": 1, "removed": False}, {"id": 1, "content": "c", "at": 2, "removed": False}]).to_json(source / "0.json", orient="records", lines=True)
    made = tables.create(spark, str(tmp_path / "t"), "id int, content string, at int", "id", "at")
    run = lambda: tables.maintain(upsert.read_changes(spark, str(source), schema), str(tmp_path / "t"), str(tmp_path / "ck")).awaitTermination()
    now = lambda: sorted(map(tuple, tables.opened(spark, str(tmp_path / "t")).rows().select("id", "content").collect()))
    run()
    assert now() == [(1, "c"), (2, "b")] and made.rows().count() == 0
    pd.DataFrame([{"id": 2, "content": "", "at": 3, "removed": True}]).to_json(source / "1.json", orient="records", lines=True)
    run()
    assert now() == [(1, "c")]


def test_routing_sees_every_vector(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    m = np.array([r.embedding for r in rows], float)
    asked = m[[r.vec_id for r in rows].index(0)]
    cos = np.maximum(m @ asked / np.linalg.norm(m, axis=1) / np.linalg.norm(asked), 0)
    wanted = sorted((-round(c, 5), r.vec_id) for c, r in zip(cos, rows))[:5]
    found = [(-round(r.weight, 5), r.vec_id) for r in queries.QUERIES["search_routing"](spark, sf).collect()]
    assert found == wanted and any(i >= 20 for _, i in found)


def test_pairs_of_a_large_callee_are_kept(spark):
    calls = spark.range(1100).select(F.col("id").alias("src"), F.lit(7).alias("callee"))
    few = spark.createDataFrame([(1, 8), (2, 8), (2, 8), (5000, 9), (None, 8)], "src long, callee int")
    found = chunking.tests_of_same(calls.union(few))
    assert found.count() == found.distinct().count() == 1100 * 1099
    assert sorted(map(tuple, chunking.tests_of_same(few).collect())) == [(1, 2), (2, 1)]
    groups = chunking.test_groups(calls.union(few))
    assert groups.count() == 1102 and {(r.callee, r.tests) for r in groups.select("callee", "tests").distinct().collect()} == {(7, 1100), (8, 2)}
    asked = spark.createDataFrame([(1,)], "src long")
    assert {r.dst for r in chunking.siblings(groups, asked).collect()} == set(range(1100)) - {1}


def test_identities_by_likeness(spark):
    known = [("cj@corp.com", "Catherine Jones"), ("bt@corp.com", "Ben Takahashi"), ("margaret.hamilton@corp.com", "M H")]
    people = [("kj@y.net", "Katherine Jones"), ("ben.takahashi@co.com", "Ben T"), ("margaret.hamiltom@corp.com", "root"), ("zz@q.io", "Wyx Quux"), (None, "Catherine-Jones")]
    have = spark.createDataFrame([(e, n, n) for e, n in known], "email string, name string, author string")
    found = {r.name: r.author for r in identity.resolve(spark.createDataFrame(people, "email string, name string"), have).collect()}
    assert found == {"Katherine Jones": "Catherine Jones", "Ben T": "Ben Takahashi", "root": "M H", "Wyx Quux": "Wyx Quux", "Catherine-Jones": "Catherine Jones"}


def test_near_emails_of_related_domains(spark):
    emails = ["alice1@co.com", "alice2@contractor.co.com", "alice3@other.org", "alicex@co.com", "alice4@xco.com", "bob@co.com"]
    found = identity.near_emails(spark.createDataFrame([(e,) for e in emails], "email string"))
    wanted = [("alice1@co.com", "alice2@contractor.co.com", 1), ("alice1@co.com", "alice4@xco.com", 1), ("alice1@co.com", "alicex@co.com", 1), ("alice2@contractor.co.com", "alicex@co.com", 1), ("alice4@xco.com", "alicex@co.com", 1)]
    assert sorted(map(tuple, found.select("first", "second", "edits").collect())) == wanted


def test_budget_cut_sees_the_whole_list(spark):
    def fits(rows, budget):
        used, kept = 0, []
        for i, (k, c, _) in enumerate(rows):
            if i == 0 or used + c <= budget:
                used += c
                kept.append(k)
        return kept

    rng = np.random.default_rng(1)
    small = [(i, int(c), float(300 - i)) for i, c in enumerate(rng.integers(0, 400, 300))]
    late = [(i, 400 - (i == 260), float(300 - i)) for i in range(300)]
    for rows, budget in ((small, 5000), (late, 1199), (small, 1), ([(1, 9, 1.0), (2, 0, 0.5)], 5), ([], 5)):
        found = retrieval.budget_cut(spark.createDataFrame(rows, "id long, cost long, score double"), "id", "cost", "score", budget, at_once=7)
        assert sorted(r.id for r in found.collect()) == sorted(fits(rows, budget))
    found = queries.QUERIES["search_token_budget"](spark, "/root/testdata/sf0.001").collect()
    ranked = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "cast(floor((length(text) + 80) / 4) as long) as cost", "n_chars").orderBy(F.desc("n_chars"), "doc_id").collect()
    assert sorted(r.doc_id for r in found) == sorted(fits(list(map(tuple, ranked)), 50000))

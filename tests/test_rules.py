"""Rules by hand-made cases, grants in order, sources from real repositories and files."""

import json
import subprocess

from pyspark.sql import functions as F

from devquarry.functions import code, paths, rules, text
from devquarry.operators import graph, index, reports, retrieval, review
from devquarry.plans import search
from devquarry.sources import delivery


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(column(F.col("x"))).collect()]


def test_intents_in_order(spark):
    wanted = {
        "explain the schema": "definition", "what is the error handling model": "definition", "QueryClassifier intent classification": "definition", "apply_archive_downrank": "definition",
        "MAX_BATCH_SIZE": "definition", "BM25": "definition", "HNSW vector similarity search": "conceptual", "callers of parse": "usage", "tested by whom": "usage", "fn parse": "definition", "TODO list": "bug_debt",
        "axum middleware concurrency limiter": "conceptual", "reservation booking flow": "unknown", "RoomType struct": "definition", "callers of the user class": "definition", "API endpoints": "definition", "the payment_processor retries failed attempts five times": "unknown", "how does ranking work": "conceptual",
    }
    assert {q: text.intent(q)[0] for q in wanted} == wanted
    assert values(spark, list(wanted), text.intent_of) == list(wanted.values())
    assert text.intent("rate strategy", ("Rate",))[0] == "definition" and text.intent("callers of rate", ("rate",))[0] == "usage"


def test_tokens_of_identifiers(spark):
    asked = ["fooBar2", "HTTP2Client", "CodeIndexer", "v3alpha", "aB cD"]
    found = values(spark, asked, text.code_tokens)
    assert found[0] == ["2", "bar2", "foo", "foobar", "foobar2"] and {"http", "2", "client"} <= set(found[1]) and {"code", "indexer", "codeindexer"} == set(found[2])
    assert found == [text.code_terms(x) for x in asked]


def test_smells_see_marks_anywhere(spark):
    found = values(spark, ["x = 1 /// doc", "//! inner", 'a """b"""'], code.smells)
    assert ["missing_docstring" in x for x in found] == [False, True, False]


def test_triples_are_directed_to_the_note(spark):
    rows = [(1, " Backend ", [" Rust ", ""], "Alice works at Acme. The app requires Spark, #Design-doc"), (2, None, ["secret"], "a is a b")]
    notes = spark.createDataFrame(rows, "id long, room string, tags array<string>, content string")
    found = {(r.subject, r.predicate, r.object) for r in review.extract_triples(notes, ("secret",)).collect()}
    assert found == {("tag:rust", "tags", "drawer:1"), ("room:Backend", "contains", "drawer:1"), ("topic:design-doc", "mentioned-in", "drawer:1"), ("alice", "works-at", "acme"), ("app", "depends-on", "spark")}


def test_verdicts(spark):
    reviews = [(1, "APPROVE"), (2, "APPROVE*"), (3, "UNKNOWN"), (4, "APPROVE"), (5, "BLOCK"), (6, "APPROVE"), (7, "APPROVE"), (8, "REQUEST_CHANGES")]
    findings = [(1, "high", 0.2), (2, "medium", 0.6), (2, "low", 0.65), (3, "high", 0.9), (4, "medium", 0.9), (4, "medium", 0.85), (5, "low", 0.9), (6, "medium", 0.9), (7, "medium", 0.8), (7, "medium", 0.7)]
    out = review.verdicts(spark.createDataFrame(reviews, "id int, model string"), spark.createDataFrame(findings, "id int, effort string, confidence double"), ["id"])
    assert dict(out.collect()) == {1: "BLOCK", 2: "APPROVE", 3: "UNKNOWN", 4: "REQUEST_CHANGES", 5: "BLOCK", 6: "APPROVE*", 7: "APPROVE", 8: "REQUEST_CHANGES"}


def test_a_rejected_claim_renews_nothing(spark):
    rows = [("a", 0, "in_progress"), ("a", 20, "in_progress"), ("a", 30, "in_progress"), ("b", 0, "in_progress"), ("b", 1, "completed"), ("b", 99, "in_progress")]
    events = spark.createDataFrame(rows, "sha string, hour int, state string").select(F.lit("o").alias("owner"), F.lit("r").alias("repo"), F.lit(1).alias("pr"), "sha", "state", F.timestamp_seconds(F.col("hour") * 3600).alias("at"), "hour")
    assert sorted((r.sha, r.hour) for r in review.claims(events, 24).collect()) == [("a", 0), ("a", 30), ("b", 0)]


def test_louvain_weighs_repeated_pairs(spark):
    edges = [("a", "b"), ("c", "d"), ("b", "c"), *[("a", "d")] * 9, *[("d", "a")] * 9]
    found = dict(graph.louvain(spark.createDataFrame(edges, "src string, dst string")).collect())
    assert found["a"] == found["d"] and found["b"] == found["c"] != found["a"]


def test_sections_rooms_hunks_and_files(spark):
    prompt = "head\n## A\nx\n## B\ny\n## A\nx\n"
    assert values(spark, [prompt, "## A\nx\n## A\nx", "no"], rules.unique_sections) == ["head\n## A\nx\n## B\ny\n", "## A\nx", "no"]
    hunks = [("a.py", "+import os\n-import sys"), ("a.py", "+# x\n c"), ("a.rs", "+  \n-"), ("a.rs", "+let x = 1;\n+// y"), ("a.rs", " ctx"), ("a.txt", "+import os")]
    found = spark.createDataFrame(hunks, "p string, h string").select(rules.hunk_drop(F.col("p"), F.col("h"))).collect()
    assert [r[0] for r in found] == ["import-only", "comment-only", "whitespace-only", None, None, None]
    paths = [("x/Cargo.lock", ""), ("security/Cargo.lock", ""), ("a/__snapshots__/b", ""), ("a.pb.go", ""), ("data.csv", "l\n" * 80), ("data.csv", "l"), ("src/a.rs", ""), ("dist/a.js", "https://u:p@h"), ("skip/a.rs", "")]
    found = spark.createDataFrame(paths, "p string, d string").select(rules.file_disposition(F.col("p"), F.col("d"), suppress=("^skip/",))).collect()
    assert [r[0] for r in found] == ["lockfile", "kept", "snapshot", "generated", "summary", "kept", "kept", "kept", "suppress-pattern"]


def test_index_search_and_update(spark):
    docs = spark.createDataFrame([(1, "authentication login password secure"), (2, "rendering ui components"), (3, "CodeIndexer")], "id long, text string")
    built = index.build(docs, "id", text.code_tokens(F.col("text")))
    assert [r.key for r in index.search(built, text.code_terms("indexer")).collect()] == [3]
    assert index.score_one(built, ["authentication"], 1) > index.score_one(built, ["authentication"], 2) == 0.0
    changed = index.update(built, spark.createDataFrame([(2, "login page")], "id long, text string"), "id", text.code_tokens(F.col("text")), spark.createDataFrame([(1,)], "id long"))
    assert [r.key for r in index.search(changed, ["login"]).collect()] == [2] and changed.n_docs == 2
    assert [r.key for r in index.search(built, ["login"]).collect()] == [1]
    assert index.build(docs.limit(0), "id", text.code_tokens(F.col("text"))).mean == 1.0
    found = search.hybrid(built, built, search.SearchQuery("CodeIndexer", 2)).collect()
    assert [(r.key, r.reason, r.intent) for r in found] == [(3, "hybrid", "definition")]


def test_graph_tables(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    graph.save(edges.select(F.col("src").alias("id")), edges, str(tmp_path / "g"))
    nodes, forward, backward = graph.load(spark, str(tmp_path / "g"))
    assert nodes.count() == 2 and sorted(map(tuple, backward.select("src", "dst").collect())) == [("b", "a"), ("c", "b")] and forward.count() == 2
    chunks = spark.createDataFrame([("src/f", 10, 20, "inner"), ("src/f", 1, 90, "outer"), ("g", 1, 90, None)], "file string, start int, end int, name string")
    assert graph.chunk_at(chunks, "f", 15).first().start == 1  # the first in order whose path ends so
    named = edges.select(F.col("src").alias("symbol"))
    assert [graph.entry_point(named, edges, asked, chunks).first().symbol for asked in ("f:15", "g:3")] == ["outer", "g:1"]
    assert graph.entry_point(named, edges, "A", chunks).first().symbol == "a" and graph.entry_point(named, edges, "f:99", chunks).first() is None


def test_normalized_queries(spark):
    asked = ["The quick Brown Fox!", "don't re-index foo/bar.rs", "what is it?", "  ", None]
    assert values(spark, asked, text.normalize_query) == ["quick brown fox", "don t re index foo bar rs", "what", "", None]


def test_files_by_mode(spark):
    files = ["a.rs", "x.zig", "up.sql", "README", "docs/LICENSE-MIT", "n.md", "x.json", "x.bin", "vendor/P/a.py"]
    shown = lambda mode, *out: [f for f, ok in zip(files, values(spark, files, lambda p: paths.allowed_in(p, mode, *out))) if ok]
    assert shown("code") == ["a.rs", "x.zig", "up.sql", "vendor/P/a.py"] and shown("code", ("vendor/p/",)) == ["a.rs", "x.zig", "up.sql"]
    assert shown("text") == ["README", "docs/LICENSE-MIT", "n.md"] and shown("data") == ["up.sql", "x.json"] and shown("all") == files
    tests = ["tests/a.rs", "x/tests/a", "a_test.rs", "src/a_test.go", "test_a.py", "a.spec.ts", "a.test.js", "spec/a.rb", "test/a.py", "__tests__/a.js", "contest.py", "tests", "a.tests.x"]
    assert [f for f, ok in zip(tests, values(spark, tests, paths.is_test_file)) if ok] == ["tests/a.rs", "x/tests/a", "a_test.rs", "test_a.py", "a.spec.ts", "a.test.js", "__tests__/a.js", "tests"]


def test_adjusted_scores(spark):
    rows = [("a", 1.0, "x.json", "struct", "CodeIndexer"), ("b", 1.0, "a.rs", "interface", "CodeIndexer"), ("c", 1.0, "a.rs", "struct", "CodeIndexer"), ("d", 1.0, "a.rs", "struct", "Indexer"), ("e", 1.0, "a.rst", "struct", "Other"), ("f", 1.0, "a.rs", "type_alias", None)]
    hits = spark.createDataFrame(rows, "key string, score double, file string, chunk_type string, name string")
    found = {r.key: r.score for r in search.adjust(hits, "struct CodeIndexer").collect()}
    assert {k: round(v, 9) for k, v in found.items()} == {"a": 0.2, "b": 1.0, "c": 2.0, "d": 1.0, "e": 0.1, "f": 1.0}
    lanes = spark.createDataFrame([(v, b, g) for v in (True, False) for b in (True, False) for g in (True, False)], "v boolean, b boolean, g boolean")
    assert [r[0] for r in lanes.select(search.reason(F.col("v"), F.col("b"), F.col("g"))).collect()] == ["hybrid", "hybrid", "vector", "vector", "bm25", "bm25", "hybrid+kg", "fallback:ripgrep"]


def test_bag_of_words(spark):
    found = retrieval.bag_of_words(spark.createDataFrame([(1, "A a b"), (2, "")], "id int, t string"), "id", "t", 256).collect()
    first = found[0].vec if found[0].id == 1 else found[1].vec
    assert abs(first[97] - 2 / 5**0.5) < 1e-6 and abs(first[98] - 1 / 5**0.5) < 1e-6


def test_git_sources(spark, tmp_path):
    def run(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ann", "-c", "user.email=a@x", *a], check=True, capture_output=True)

    run("init", "-q")
    (tmp_path / "a.txt").write_text("1\n2\n3\n4\n5\n6\n")
    run("add", "-A")
    run("commit", "-q", "-m", "first\n\nbody")
    run("tag", "v1")
    run("mv", "a.txt", "b.txt")
    run("commit", "-q", "-m", "move")
    repository = [str(tmp_path)]
    commits = delivery.git_commits(spark, repository).collect()
    assert sorted(r.message for r in commits) == ["first\n\nbody", "move"] and {r.email for r in commits} == {"a@x"}
    changes = {r.path: (r.old_path, r.insertions, r.deletions) for r in delivery.git_file_changes(spark, repository).collect()}
    assert changes == {"a.txt": (None, 6, 0), "b.txt": ("a.txt", 0, 0)}
    assert delivery.git_patches(spark, repository).filter("patch like '%rename to b.txt%'").count() == 1
    tags = delivery.git_tags(spark, repository)
    assert [r.git_tag for r in delivery.deployments_of_tags(tags, r"^v\d").collect()] == ["v1"]
    long = values(spark, ["x" * 300_000, "y"], delivery.capped_patch)
    assert len(long[0]) == delivery.PATCH_LIMIT + len(delivery.PATCH_MARK) and long[1] == "y"


def test_incident_exports_and_reports(spark, tmp_path):
    one = {"id": "i1", "created": "1700000000", "resolved": "1700003600", "severity": "P1", "repo": "r"}
    for name, body in (("a", [one]), ("b", {"data": [one | {"id": "i2", "created": "2024-01-01T00:00:00Z", "resolved": None}]}), ("c", one | {"id": "i3"}), ("d", "broken{")):
        (tmp_path / f"{name}.json").write_text(json.dumps(body) if name != "d" else body)
    found = {r.incident_id: r.mttr_hours for r in delivery.incidents_of_exports(spark, str(tmp_path)).collect()}
    assert found == {"i1": 1.0, "i2": None, "i3": 1.0}
    df = spark.createDataFrame([("2024-W01", 2, 1.5, 3.25159)], "week_id string, prs_merged int, avg_pr_cycle_time_hours double, commits_per_developer double")
    delivery.write_report(df, "weekly_velocity", str(tmp_path / "out"))
    row = spark.read.csv(str(tmp_path / "out/weekly_velocity"), header=True)
    assert row.columns == delivery.HEADERS["weekly_velocity"].split() and tuple(row.first()) == ("2024-W01", "2", "1.50", None, "3.25")


def test_period_labels(spark):
    d = spark.createDataFrame([("2024-01-01", "2024-01-28"), ("2023-12-25", "2024-01-07")], "a string, b string").select(reports.period_label(F.col("a").cast("date"), F.col("b").cast("date")))
    assert [r[0] for r in d.collect()] == ["2024-W01..W04", "2023-W52..2024-W01"]

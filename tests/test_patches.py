"""Diffs as tables and back, coverage by endings, fact hashes, external sources, ledgers and rendering."""

import datetime

import pytest
import xxhash
from pyspark.sql import functions as F

from devquarry.functions import text
from devquarry.operators import classify, diffs, external, graph, ledgers, memory, patches, ranges
from devquarry.plans import search

GIT = """commit text
diff --git a/src/a.rs b/src/a.rs
index 1..2 100644
--- a/src/a.rs
+++ b/src/a.rs
@@ -1,3 +1,4 @@ fn top()
 one
-two
--- x
+++ y
+2
+three
@@ -10 +12,2 @@
-ten
+ten!
+@@ -9,9 +9,9 @@
diff --git a/old name.txt b/new name.txt
similarity index 95%
rename from old name.txt
rename to new name.txt
diff --git a/run.sh b/run.sh
old mode 100644
new mode 100755
diff --git a/new.py b/new.py
new file mode 100644
--- /dev/null
+++ b/new.py
@@ -0,0 +1 @@
+import os
\\ No newline at end of file
diff --git a/gone b/gone
deleted file mode 100644
--- a/gone
+++ /dev/null
@@ -1 +0,0 @@
-x
diff --git a/p.png b/p.png
index 3..4
Binary files a/p.png and b/p.png differ
"""
UNIFIED = "--- a.c\t2024-01-01\n+++ a.c\t2024-01-02\n@@ -1,2 +1,2 @@\n-a\n+b\n c\n--- b.c\n+++ b.c\n@@ -5 +5 @@\n-q\n+r"


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame([(1, GIT), (2, UNIFIED), (3, ""), (4, None), (5, "no diff\n")], "id int, diff string")


def test_files(raw):
    found = {(r.id, r.file_no): r for r in patches.changed_files(raw).collect()}
    assert set(found) == {(1, n) for n in range(1, 7)} | {(2, 1), (2, 2)}
    short = lambda r: (r.old_path, r.new_path, r.change, r.hunks, r.binary)
    assert short(found[1, 1]) == ("src/a.rs", "src/a.rs", "modified", 2, False)
    assert short(found[1, 2]) == ("old name.txt", "new name.txt", "renamed", 0, False) and found[1, 2].similarity == 95
    assert (found[1, 3].old_mode, found[1, 3].new_mode, found[1, 3].old_path) == ("100644", "100755", "run.sh")
    assert short(found[1, 4]) == (None, "new.py", "added", 1, False) and found[1, 4].new_mode == "100644"
    assert short(found[1, 5]) == ("gone", None, "deleted", 1, False) and short(found[1, 6]) == ("p.png", "p.png", "modified", 0, True)
    assert short(found[2, 1]) == ("a.c", "a.c", "modified", 1, False) and found[2, 2].new_path == "b.c"


def test_hunks_and_lines(raw):
    own = {(r.id, r.file_no, r.hunk_no): (r.old_start, r.old_lines, r.new_start, r.new_lines, r.section) for r in patches.hunks(raw).collect()}
    assert own == {(1, 1, 1): (1, 3, 1, 4, "fn top()"), (1, 1, 2): (10, 1, 12, 2, ""), (1, 4, 1): (0, 0, 1, 1, ""), (1, 5, 1): (1, 1, 0, 0, ""), (2, 1, 1): (1, 2, 1, 2, ""), (2, 2, 1): (5, 1, 5, 1, "")}
    rows = sorted((r.file_no, r.hunk_no, r.line_no, r.kind, r.old_line, r.new_line, r.text) for r in patches.lines(raw.filter("id = 1")).collect())
    assert rows[:6] == [(1, 1, 1, "context", 1, 1, "one"), (1, 1, 2, "removed", 2, None, "two"), (1, 1, 3, "removed", 3, None, "-- x"), (1, 1, 4, "added", None, 2, "++ y"), (1, 1, 5, "added", None, 3, "2"), (1, 1, 6, "added", None, 4, "three")]
    assert rows[6:9] == [(1, 2, 1, "removed", 10, None, "ten"), (1, 2, 2, "added", None, 12, "ten!"), (1, 2, 3, "added", None, 13, "@@ -9,9 +9,9 @@")]
    assert rows[9:11] == [(4, 1, 1, "added", None, 1, "import os"), (4, 1, 2, "mark", None, None, " No newline at end of file")]


def test_round_trip(raw):
    assert {r.id: r.diff for r in patches.joined(patches.parts(raw)).collect()} == {1: GIT, 2: UNIFIED, 3: "", 5: "no diff\n"}


def test_units_and_coverage_from_raw_diffs(spark, raw):
    kept = patches.filtered(raw.filter("id = 1"))
    rows = {(r.file, r.hunk_no): r.disposition for r in kept.collect()}
    assert rows[("new.py", None)] == "kept" and ("src/a.rs", 1) in rows  # an import alone is dropped, its file stays
    assert {(r.file, r.chunks) for r in diffs.units(kept).collect()} >= {("src/a.rs", 1)}
    hits = spark.createDataFrame([("/b/src/a.rs", 2, 1), ("/b/src/a.rs", 3, 0), ("/c/src/a.rs", 4, 5), ("new.py", 9, 1)], "file string, line long, hits long")
    found = {r.file: (r.instrumented, r.covered, r.percent, r.found, r.candidates) for r in ranges.coverage_by_ending(patches.added_lines(raw.filter("id = 1")), hits).collect()}
    assert found == {"src/a.rs": (2, 1, 50.0, "ending", 2), "new.py": (0, 0, None, "none", 0)}


def test_fact_hashes(spark):
    assert xxhash.xxh3_64_intdigest(b"") == 0x2D06800538D394C2  # the published value of the empty text
    rows = spark.createDataFrame([("a", "b", "c"), ("ab", "", "c"), ("x" * 1024, "é", ""), (None, "b", "c")], "s string, p string, o string")
    found = [r[0] for r in rows.select(memory.fact_hash("s", "p", "o")).collect()]
    raw = lambda *parts: xxhash.xxh3_64(b"".join(len(p.encode()).to_bytes(8, "little") + p.encode() for p in parts)).intdigest()
    assert [x and x % 2**64 for x in found] == [raw("a", "b", "c"), raw("ab", "", "c"), raw("x" * 1024, "é", ""), None] and len(set(found)) == 4


def test_sources_are_asked_once(spark, tmp_path):
    log = tmp_path / "asked"
    log.touch()

    def ask(kind, answers):
        def one(keys):
            with open(log, "a") as f:
                f.write("".join(f"{kind}:{k}\n" for k in keys))
            return {k: v for k, v in answers.items() if k in keys}

        return one

    sources = [
        external.Source("tracker", lambda m: F.regexp_extract_all(m, F.lit(r"([A-Z]+-\d+)"), F.lit(1)), ask("tracker", {"A-2": "bug", "B-1": "feature"})),
        external.Source("forge", lambda m: F.regexp_extract_all(m, F.lit(r"#(\d+)"), F.lit(1)), ask("forge", {"7": "docs"})),
    ]
    messages = spark.createDataFrame([(1, "A-1 A-2 #7"), (2, "#7 #8"), (3, "B-1"), (4, "none"), (5, None), (6, "A-1 #9")], "id int, message string")
    found, known = external.resolved(messages, sources, external.cache(spark, str(tmp_path / "c")))
    wanted = {(1, "tracker", "A-2", "bug"), (2, "forge", "7", "docs"), (3, "tracker", "B-1", "feature")}
    assert {tuple(r) for r in found.collect()} == wanted
    assert sorted(log.read_text().split()) == ["forge:7", "forge:8", "forge:9", "tracker:A-1", "tracker:A-2", "tracker:B-1"]
    again, known = external.resolved(messages.union(spark.createDataFrame([(9, "A-9 #8")], messages.schema)), sources, known)
    assert {tuple(r) for r in again.collect()} == wanted and sorted(log.read_text().split())[-1] == "tracker:B-1"
    assert log.read_text().split().count("tracker:A-1") == 1 and log.read_text().count("A-9") == 1


def test_ledgers(spark):
    runs = spark.createDataFrame([("r", 2024, 1, "t1", 5, 1), ("r", 2024, 2, "t1", 6, 1)], "repo_name string, iso_year int, iso_week int, collected_at string, commit_count int, repo_count int")
    newer = spark.createDataFrame([("r", 2024, 2, "t2", 7, 1), ("r", 2024, 2, "t3", 8, 1), ("s", 2024, 2, "t2", 1, 1)], runs.schema)
    found = ledgers.record_runs(runs, newer)
    assert {(r.repo_name, r.iso_week, r.commit_count) for r in found.collect()} == {("r", 1, 5), ("r", 2, 8), ("s", 2, 1)} and ledgers.collected_weeks(found, F.lit("r")).count() == 2
    schema = "pr_id long, provider string, reviewer_id string, display_name string, vote int, is_required int, is_container int, review_state string, submitted_at string"
    have = spark.createDataFrame([(1, "github", "ann", "Ann", 10, 0, 0, "OLD", "t0"), (1, "azure", "ann", "Ann", 10, 1, 0, None, "t0")], schema)
    reviews = spark.createDataFrame([(1, "ann", "APPROVED", "t2"), (1, "ann", "COMMENTED", "t1"), (2, "", "X", "t1"), (2, None, "X", "t1")], "pr_id long, login string, state string, submitted_at string")
    assert {(r.provider, r.reviewer_id, r.vote, r.review_state) for r in ledgers.record_reviewers(have, reviews).collect()} == {("github", "ann", 0, "APPROVED"), ("azure", "ann", 10, None)}
    over = spark.createDataFrame([("a", "r", "feature", "x", None, "t1"), ("b", "r", "bug", "x", "n", "t3"), ("c", "q", "bug", "x", None, "t2")], "commit_sha string, repo_path string, work_type string, change_type string, notes string, created_at string")
    more = ledgers.add_overrides(over, spark.createDataFrame([("a", "r", "docs", "x", None, "t9")], over.schema))
    assert [(r.commit_sha, r.work_type) for r in ledgers.listed_overrides(more, "r").collect()] == [("a", "docs"), ("b", "bug")]
    assert [r.commit_sha for r in ledgers.listed_overrides(ledgers.remove_overrides(more, over.filter("commit_sha = 'b'"))).collect()] == ["a", "c"]
    at = datetime.datetime(2024, 1, 31, 23, 0)
    commits = spark.createDataFrame([(1, 10, at), (1, 11, at), (1, None, at), (2, 10, at), (1, 10, at + datetime.timedelta(hours=2))], "author_id int, classification_id int, timestamp timestamp_ntz")
    people = spark.createDataFrame([(1, "A@b.c"), (2, "d@e.f")], "id int, canonical_email string")
    kinds = spark.createDataFrame([(10, "bug"), (11, None)], "id int, category string")
    assert [tuple(r) for r in ledgers.author_categories(commits, people, kinds, "a@B.c", "2024-01-01", "2024-01-31").collect()] == [("bug", 1)]


def test_rendered(spark):
    rows = [(1, "a.rs", 1, 9, "rust", "fn a() {}\n", None, 0.956, "hybrid"), (2, "b", 2, 3, None, "long", "short", 0.5, "bm25")]
    hits = spark.createDataFrame(rows, "rank int, file string, start_line int, end_line int, language string, content string, compact_snippet string, score double, reason string")
    assert search.rendered(hits, "q").first().text == '## Search Results for "q" (2 results)\n\n### 1. `a.rs:1-9` [score: 0.96, hybrid]\n```rust\nfn a() {}\n```\n\n### 2. `b:2-3` [score: 0.50, bm25]\n```\nshort\n```\n'
    told = search.rendered(hits.filter("rank = 2"), "q", True, True).first().text
    assert told.startswith('## Search Results for "q" (1 result)\n\n_Note: results truncated') and "\nlong\n" in told
    assert search.rendered(hits.limit(0), "q").first().text == '## Search Results for "q" (0 results)\n'
    v = spark.createDataFrame([(1, [1.0, 0.0], "Rust"), (2, [1.0, 0.1], "go"), (3, [0.0, 1.0], "rust")], "id int, v array<double>, language string")
    assert [r.id for r in search.in_language(v, "id", "v", [1.0, 0.0], 2, "RUST").collect()] == [1]


def test_agent_intents(spark):
    wanted = {"callers of foo": "usage", "fn foo": "definition", "CodeIndexer": "definition", "crate::search::indexer": "definition", "how does it work": "conceptual", "TODO list": "bug_debt", "foo definition": "definition", "however it goes": "unknown", "show me things": "unknown", "": "unknown", "who calls x": "usage"}
    found = spark.createDataFrame([(q,) for q in wanted], "q string").select("q", text.agent_intent(F.col("q")).alias("i")).collect()
    assert {r.q: r.i for r in found} == wanted


def test_context(spark):
    nodes = spark.createDataFrame([(i, s) for i, s in enumerate("abcdx")], "id long, symbol string")
    edges = spark.createDataFrame([(0, 1, "Calls"), (1, 2, "Calls"), (3, 0, "Calls"), (0, 4, "Uses")], "src long, dst long, kind string")
    assert {(r.symbol, r.hop) for r in graph.context(nodes, edges, "a", 2).collect()} == {("b", 1), ("d", 1), ("c", 2)}
    assert graph.context(nodes, edges, "a", 0).count() == 0 and graph.context(nodes, edges, "zz", 3).count() == 0


def test_rule_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "r1", "category": "bugfix", "tier": "regex", "pattern": "^fix", "priority": 10}\n{"id": "r2", "category": "docs", "tier": "exact", "pattern": "readme"}\n')
    (tmp_path / "b.json").write_text('{"id": "r1", "category": "repair", "tier": "regex", "pattern": "^fix", "priority": 10}\n')
    rules = classify.load_rules(spark, [str(tmp_path / "a.json"), str(tmp_path / "b.json")])
    assert [(r.id, r.category, r.priority) for r in rules.collect()] == [("r1", "repair", 10), ("r2", "docs", 100)]
    assert [(r.category, r.method) for m in ("fix it", "the README", "other") for r in classify.dry_run(rules, m).collect()] == [("repair", "regex"), ("docs", "exact"), ("uncategorized", "none")]
    with pytest.raises(ValueError):
        classify.load_rules(spark, [])

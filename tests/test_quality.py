"""Quality, archives, splits, references, staff, contributions, trends and histories on hand-made rows."""

from pyspark.sql import functions as F

from devquarry.functions import paths, text
from devquarry.operators import chunking, classify, delivery, quality, reports, review, stores


def test_issue_references(spark):
    rows = [("ABC-12 fixes ABC-12, X-1 and UIARCH-123456789",), ("TOOLONGNAME1-2 #7 see (#8) org/repo#9 org/repo#9 c#5 #0 #99999999999999999999",), ("[CONF-4] /wiki/spaces/E/pages/3 [CONF-0] /wiki/spaces/F/pages/3",), (None,)]
    m = F.col("m")
    found = spark.createDataFrame(rows, "m string").select(text.issue_keys(m), text.issue_keys(m, ("X",)), text.hosted_issues(m), text.wiki_pages(m)).collect()
    assert found[0][0] == ["ABC-12", "X-1"] and found[0][1] == ["X-1"]
    assert found[1][0] == [] and [tuple(x) for x in found[1][2]] == [("org/repo", 9), (None, 7), (None, 8)]
    assert found[2][3] == [3, 4] and list(found[3]) == [None] * 4


def test_code_tokens_of_parts(spark):
    found = spark.createDataFrame([("HTTPServer parseJson2Xml foo_bar a1B Ünïcode9 plain",), ("",), (None,)], "t string").select(text.code_tokens(F.col("t"))).collect()
    assert found[0][0] == text.code_terms("HTTPServer parseJson2Xml foo_bar a1B Ünïcode9 plain") and found[1][0] == [] and found[2][0] is None


def test_archived(spark):
    chunks = spark.createDataFrame([("src/Legacy/a.rs", "x", 1), ("lib/a.rs", "// DEPRECATED", 500), ("top.rs", "x", 500), ("new/b.rs", "x", 1), ("src/old/archive/c.rs", "@deprecated", 1), ("new/d/b.rs", "x", 366), (None, None, None)], "file string, content string, age_days int")
    present = spark.createDataFrame([("new/.archived",), ("new/DEPRECATED",), ("lib/DEPRECATED",), ("new/d/DEPRECATED.md",), (None,)], "file string")
    found = {r.file: (round(r.keeps, 6), r.reason) for r in quality.archived(chunks, present).collect()}
    assert found == {
        "src/Legacy/a.rs": (0.3, "path:legacy"), "lib/a.rs": (0.1, "annotation:// DEPRECATED"), "top.rs": (0.7, "stale:git_mtime"), "new/b.rs": (0.3, "marker:.archived"),
        "src/old/archive/c.rs": (0.1, "path:archive"), "new/d/b.rs": (0.7, "stale:git_mtime"), None: (1.0, None),
    }
    assert quality.archived(chunks, present.limit(0)).filter("keeps < 1").count() == 5


def test_smells_and_report(spark):
    chunks = spark.createDataFrame([(1, "/// ok\nfn f(a)"), (2, "fn f(a, b, c, d, e, g)"), (3, None), (4, "x\n" * 60)], "id int, text string")
    assert [(r.id, r.smells) for r in quality.smelly(chunks, "id", "text").collect()] == [(2, ["too_many_params", "missing_docstring"]), (4, ["long_function", "missing_docstring"])]
    assert [r.id for r in quality.smelly(chunks, "id", "text", 1, 1).collect()] == [4]
    assert tuple(quality.report(chunks, "text").first()) == (1.0, 1.0, 5, 4)
    assert tuple(quality.report(chunks.limit(0), "text").first()) == (0.0, 0.0, 0, 0)


def test_detected(spark):
    files = spark.createDataFrame([(3, "a/pom.xml"), (1, "x.py"), (2, "b/Cargo.toml"), (4, "y.go"), (5, "z.GO"), (6, "w.py"), (7, "noext")], "place int, file string")
    r = quality.detected(files).first()
    assert (r.primary_language, r.languages, r.build_system) == ("go", ["go", "python"], "cargo") and round(r.confidence, 6) == round(4 / 7, 6)
    assert tuple(quality.detected(files.limit(0)).first()) == ("unknown", [], None, 0.0)
    assert files.select(paths.build_system(F.lower("file")).alias("b")).filter("b is not null").count() == 2


def test_split_oversized(spark):
    content = "\n".join(f"l{i}" for i in range(260)) + "\n"
    chunks = spark.createDataFrame([("big", "f", 5, 265, content, ["g"], "rust"), ("small", "f", 1, 200, "x", ["h"], "rust"), ("none", "f", 1, 900, None, ["k"], None)], "id string, file string, start_line long, end_line long, content string, calls array<string>, language string")
    rows = {r.id: r for r in chunking.split_oversized(chunks, emptied=("calls",)).collect()}
    subs = [f"big::sub::{i}" for i in range(5)]
    assert set(rows) == {"big", "small", "none", *subs} and rows["big"].child_ids == subs and rows["small"].child_ids == rows["none"].child_ids == []
    assert [(rows[s].start_line, rows[s].end_line) for s in subs] == [(5, 104), (55, 154), (105, 204), (155, 254), (205, 264)]
    assert rows[subs[-1]].content.split("\n")[-1] == "l259" and rows[subs[0]].parent_id == "big" and rows[subs[0]].language == "rust"
    assert rows[subs[0]].calls == [] and rows["big"].calls == ["g"] and rows["big"].content == content


def test_rebinned_and_signals(spark):
    few = spark.createDataFrame([("a", 1.0, "S"), ("b", 2.0, "XL"), ("c", None, "odd")], "sha string, score double, size string")
    assert {r.sha: r.tshirt for r in delivery.rebinned(few).collect()} == {"a": 2, "b": 5, "c": 0}
    many = spark.range(10).select(F.col("id").alias("sha"), F.col("id").cast("double").alias("score"), F.lit("XS").alias("size"))
    assert [r.tshirt for r in delivery.rebinned(many).orderBy("sha").collect()] == [1, 2, 2, 3, 3, 4, 4, 5, 5, 5]
    rows = spark.createDataFrame([("Revert x", "feature"), ("fix y", "BUGFIX"), ("fix y", None), (None, "bugfix")], "m string, c string")
    held = lambda *signals: [r[0] for r in rows.select(delivery.failure_signal(F.col("m"), F.col("c"), list(signals))).collect()]
    assert held(("bugfix", "^fix"), (None, "^Revert")) == [True, True, False, False]
    assert held(("bugfix", None)) == [False, True, False, True] and held((None, None)) == [True] * 4 and held() == [False] * 4


def test_staff(spark):
    people = spark.createDataFrame([("a", "t", "d", "Contractor", "active", "v"), ("b", None, "d", "FTE", "active", None), ("c", "t", None, None, "active", None), ("d", "t", "d", "FTE", "left", None)], "full_name string, team string, department string, employment_type string, status string, contractor_source string")
    people = people.withColumns({"title": F.lit("x"), "level": F.lit("1")})
    assert [tuple(r) for r in reports.headcount(people, "team").collect()] == [("t", 2), ("<unassigned>", 1)]
    assert [tuple(r) for r in reports.headcount(people, "vendor").collect()] == [("v", 1)]
    assert {tuple(r) for r in reports.headcount(people, "status").collect()} == {("Contractor", 1), ("FTE", 1), ("<unknown>", 1)}
    assert [r.full_name for r in reports.people_list(people, 2).collect()] == ["c", "b"]
    lines = spark.createDataFrame([("t", "o", "Active", 10.125, 1.0), ("t", "o", None, 1.0, 2.0), ("t", None, "closed", 5.0, 5.0), (None, "o", "active", 7.0, 9.0)], "team string, organization string, status string, annual_cost double, year_total double")
    assert [tuple(r) for r in reports.budget(lines).collect()] == [("<unassigned>", "o", 1, 7.0, 9.0), ("t", "o", 2, 11.13, 3.0)]
    assert reports.budget(lines, "t", "o").count() == 1 and reports.budget(lines, "t", "p").count() == 0


def test_contributions(spark):
    kind = "producer string, id string, src string, dst string, kind string, tag string"
    old = spark.createDataFrame([("b", "N", None, None, None, None), ("a", "M", None, None, None, None), ("a", None, "M", "N", "reads", None)], kind)
    new = spark.createDataFrame([("a", "A", None, None, None, None), ("a", "A", None, None, None, None), ("a", None, "A", "N", "reads", None), ("a", None, "A", "X", "nope", "custom:z"), ("c", None, "A", "N", "calls_proc", None), ("c", None, "A", "N", "calls_function", None), ("c", None, "X", "N", "nope", None), ("d", None, None, None, None, None)], kind)
    kept, flags = review.replace_contributions(old, new)
    assert {(r.producer, r.replaced) for r in flags.collect()} == {("a", True), ("c", False), ("d", False)}
    assert kept.filter("id = 'M'").count() == 0 and review.without_producer(kept, "a").filter("producer = 'a'").count() == 0
    nodes, edges = spark.createDataFrame([("X",)], "id string"), spark.createDataFrame([("X", "X", "Calls")], "src string, dst string, kind string")
    n, e, stats = review.merge_contributions(nodes, edges, kept)
    assert {r.id for r in n.collect()} == {"X", "A", "N"}  # a -> N is dangling, as b gives N after a
    assert {tuple(r) for r in e.collect()} == {("X", "X", "Calls"), ("A", "X", "custom:z"), ("A", "N", "CallsFunction")}
    assert stats.first().asDict() == {"nodes_added": 2, "nodes_existing": 1, "edges_added": 2, "edges_duplicate": 1, "edges_dangling": 1, "edges_unknown_kind": 1}
    again = review.merge_contributions(n, e, kept)
    assert {tuple(r) for r in again[1].collect()} == {tuple(r) for r in e.collect()} | {("A", "N", "Reads")} and again[2].first().nodes_added == 0
    nothing = review.merge_contributions(nodes.limit(0), edges.limit(0), kept.limit(0))
    assert nothing[0].count() == nothing[1].count() == 0 and set(nothing[2].first()) == {0}


def test_trends(spark):
    rows = [(1, "p1", "w", 0.2), (2, "p1", "r", 0.5), (3, "p1", "gone", 0.9), (4, "p2", "w", 0.4), (5, "p2", "r", 0.6), (6, "p2", "fresh", 0.1)]
    f = spark.createDataFrame(rows, "place int, period string, cluster string, confidence double").withColumn("g", F.lit(1))
    found = {r.cluster: r.trend for r in review.trend_tags(f, "g", "cluster", "place", "period", "confidence").collect()}
    assert found == {"w": "worsening", "r": "recurring", "gone": "resolved", "fresh": "new"}


def test_history(spark):
    rows = [(1, 0, "start here"), *[(1, i, "ok ok ok ok" if i % 2 else f"word{i} other{i} thing{i} more{i}") for i in range(1, 9)], (1, 9, "last words"), (2, 0, None), (2, 1, "")]
    turns = spark.createDataFrame(rows, "c int, t int, text string")
    kept = lambda budget, last: sorted((r.c, r.t) for r in review.compress_history(turns, "c", "t", "text", budget, last).collect())
    assert kept(None, 2) == sorted((c, t) for c, t, _ in rows)
    short = [(2, 0), (2, 1)]
    assert kept(14, 2) == [(1, 0), (1, 2), (1, 8), (1, 9), *short]  # 2 + 5 + 2 of 14 leave one turn of five
    assert kept(0, 1) == [(1, 0), (1, 9), *short] and kept(10**6, 6) == sorted((c, t) for c, t, _ in rows)


def test_entities_of_a_language(spark):
    rows = spark.createDataFrame([("fn", "b", "rust"), ("fn", "a", "go"), ("class", "z", "rust")], "kind string, name string, language string")
    assert [(r.kind, r.name) for r in stores.entities(rows, "kind", "name", language="rust").collect()] == [("class", "z"), ("fn", "b")]


def test_all_tiers(spark):
    rows = [("a", "fix(x): AB-1 typo", False, "Bug"), ("b", "AB-1 thing", False, " bug "), ("c", "AB-1 thing", False, None), ("d", "bump it", False, None), ("e", "add new feature support", False, None), ("f", "x", True, None), ("g", "some words that tell nothing", False, None), ("h", None, None, None), ("m", "AB-9 by hand", False, "bug")]
    commits = spark.createDataFrame(rows, "sha string, message string, is_merge boolean, issue_type string").withColumn("repository", F.lit("r"))
    manual = spark.createDataFrame([("m", "r", "hotfix"), ("a", "other", "docs")], "sha string, repository string, category string")
    found = classify.classified(commits, [("typo", "docs", 1)], [("^bump", "release", 1)], {"AB": "platform"}, manual, own={"release": "shipping"})
    got = {r.sha: (r.category, r.method, r.top_level, r.ticket_id) for r in found.collect()}
    assert got == {
        "a": ("docs", "exact", "content", "AB-1"), "b": ("bugfix", "external", "bugfix", "AB-1"), "c": ("platform", "external", "platform_work", "AB-1"), "d": ("release", "regex", "shipping", None), "e": ("feature", "weighted", "feature", None),
        "f": ("merge", "weighted", got["f"][2], None), "g": ("uncategorized", "none", got["g"][2], None), "h": ("uncategorized", "none", got["h"][2], None), "m": ("hotfix", "override", "bugfix", None),
    }
    bare = {r.sha: r.method for r in classify.classified(commits, scored=False, defaults=False).collect()}
    assert bare["b"] == "external" and {bare[x] for x in "cdefgh"} == {"none"} and classify.classified(commits.limit(0)).count() == 0


def test_united_graphs(spark):
    node, edge = "id string, name string", "src string, dst string, kind string, weight int"
    old = spark.createDataFrame([("a", "mine"), ("b", None)], node), spark.createDataFrame([("a", "b", "Calls", 1), ("a", "b", "Calls", 2)], edge)
    new = spark.createDataFrame([("a", "theirs"), ("c", "z"), ("c", "y"), (None, "n")], node), spark.createDataFrame([("a", "b", "Calls", 9), ("a", "b", None, 7), ("a", "b", None, 6), ("x", "y", "Calls", 5)], edge)
    nodes, edges = review.united(*old, *new)
    assert {tuple(r) for r in nodes.collect()} == {("a", "mine"), ("b", None), ("c", "y"), (None, "n")}
    assert sorted(map(str, map(tuple, edges.collect()))) == sorted(map(str, [("a", "b", "Calls", 1), ("a", "b", "Calls", 2), ("a", "b", None, 6), ("x", "y", "Calls", 5)]))
    assert review.united(*new, old[0].limit(0), old[1].limit(0))[1].count() == 4

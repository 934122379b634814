"""Scans with ignore files, manifests, code indexes, clusters and diff units, against hand-made cases and plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from devquarry.operators import classify, cluster, diffs, entities, memory
from devquarry.sources import files, scip, walk


def write(root, texts):
    for path, text in texts.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)


def test_walk_reads_ignore_files(spark, tmp_path):
    write(tmp_path, {
        ".gitignore": "# note\n*.log\n/only_top.py\nlib/**/gen_*.py\n!keep.log\nbuilt/\nodd[0-9].py\n", "a/.gitignore": "!b.log\nmine.py\n", ".ignore": "never.py\n", "a/never.py": "x", ".git/info/exclude": "local.py\n", "local.py": "x",
        "x.log": "x", "keep.log": "x", "a/b.log": "x", "only_top.py": "x", "a/only_top.py": "x", "lib/one/two/gen_a.py": "x", "lib/gen_b.py": "x", "lib/ok.py": "x", "built/in.py": "x", "a/mine.py": "x", "mine.py": "x",
        "odd3.py": "x", "oddx.py": "x", ".github/w.yml": "x", "__init__.py": "x", "node_modules/n.py": "x", "big.py": "y" * (files.LARGEST + 1), "app.min.js": "x", "main-0123abcd.js": "x", "yarn.lock": "x", "README.md": "x", "min.js": "x" * 600,
    })
    found = {r.path for r in walk.source_files(spark, [str(tmp_path)]).collect()}
    assert found == {"keep.log", "a/b.log", "a/only_top.py", "lib/ok.py", "mine.py", "oddx.py", ".github/w.yml", "__init__.py", "README.md"}
    assert {r.path for r in walk.source_files(spark, [str(tmp_path)], prose=False).collect()} == found - {"README.md"}
    assert {"x.log", "only_top.py", "a/mine.py", "local.py", "a/never.py"} <= {r.path for r in walk.source_files(spark, [str(tmp_path)], ignore=False).collect()}
    assert walk.source_files(spark, []).count() == 0


@pytest.mark.parametrize(("line", "path", "fits"), [("a?c", "abc", True), ("a?c", "a/c", False), ("/x/*", "x/y", True), ("/x/*", "x/y/z", False), ("**/z", "q/r/z", True), ("d/**", "d/e/f", True), ("[!a]b", "ab", False), (r"\#x", "#x", True), ("a/**/b", "a/b", True), ("end ", "end", True)])
def test_ignore_patterns(line, path, fits):
    pattern, _, _ = walk.ignore_rule(line)
    assert bool(pattern.fullmatch(path)) is fits


def test_project_facts(spark, tmp_path):
    write(tmp_path, {
        "p/Cargo.toml": '[package]\nname = "alpha"\nversion = "1.2"\nedition = "2021"\n[workspace]\nmembers = ["x", "y"]\n', "p/package.json": '{"name": "web", "dependencies": {"b": "1", "a": "2"}}', "p/go.mod": "module ex.org/m\n",
        "p/CLAUDE.md": "text\n# The title\n", "p/.git/config": '[core]\n  url = no\n[remote "origin"]\n  fetch = f\n  url = https://ex.org/r.git\n', "q/pyproject.toml": "broken [", "q/CLAUDE.md": "# Unused\n",
    })
    rows = walk.project_facts(walk.read_manifests(spark, [str(tmp_path / "p"), str(tmp_path / "q")]), F.lit("2024-01-02 03:04:05").cast("timestamp")).collect()
    p = {(r.subject, r.predicate, r.object) for r in rows if r.project.endswith("/p")}
    assert p == {
        ("alpha", "has_language", "Rust"), ("alpha", "has_version", "1.2"), ("alpha", "has_edition", "2021"), ("alpha", "has_workspace_member", "x"), ("alpha", "has_workspace_member", "y"), ("web", "has_language", "JavaScript"),
        ("web", "has_dependency", "a"), ("web", "has_dependency", "b"), ("ex.org/m", "has_language", "Go"), ("ex.org/m", "has_module_path", "ex.org/m"), ("alpha", "has_description", "The title"),
        ("alpha", "source_repo", "https://ex.org/r.git"), ("alpha", "bootstrapped_at", "2024-01-02T03:04:05Z"),
    }
    assert [(r.subject, r.predicate) for r in rows if r.project.endswith("/q")] == [(str(tmp_path / "q"), "bootstrapped_at")]


def number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(place, value):
    return number(place << 3) + number(value) if isinstance(value, int) else number(place << 3 | 2) + number(len(value)) + value


def test_scip_index(spark):
    def occurrence(symbol, defines, *span):
        return field(2, field(1, b"".join(map(number, span))) + field(2, symbol) + (field(3, 1) if defines else b""))

    symbol = lambda name, kind, *more: field(3, field(1, name) + field(5, kind) + b"".join(more))
    document = field(1, b"src/lib.rs") + occurrence(b"r hello().", True, 10, 0, 20) + occurrence(b"r Foo#", False, 12, 1, 4) + occurrence(b"r Foo#", True, 300, 0, 310, 1) + occurrence(b"r Foo#", False, 301, 0, 3) + occurrence(b"r hello().", False, 302, 0, 3)
    document += symbol(b"r hello().", 17, field(6, b"hello"), field(3, b"one"), field(3, b"two")) + symbol(b"r a/Foo#", 7, field(4, field(1, b"r Bar#") + field(3, 1)), field(4, field(1, b"r Baz#") + field(2, 1))) + symbol(b"r v", 61)
    index = field(1, b"") + field(2, document) + field(2, field(1, b"x.zig") + field(4, b"Zig"))
    nodes, edges = scip.scip_graph(spark.createDataFrame([("i", bytearray(index))], "path string, content binary"))
    assert {tuple(r) for r in nodes.collect()} == {
        ("scip:rust:r hello().", "function", "hello", "r hello().", "rust", "src/lib.rs", 10, 10, "one\ntwo"), ("scip:rust:r a/Foo#", "class", "Foo", "r a/Foo#", "rust", "src/lib.rs", 0, 0, None),
    }
    assert {(r.src[10:], r.dst[10:], r.kind) for r in edges.collect()} == {("r a/Foo#", "r Bar#", "Implements"), ("r hello().", "r Foo#", "References"), ("r Foo#", "r hello().", "References")}
    with pytest.raises(ValueError, match="cut"):
        scip.graph_of(index[:-3])


def test_kmeans_as_in_one_task(spark):
    made = np.random.default_rng(5)
    x = np.concatenate([made.normal(m, 0.3, (40, 6)) for m in (-3, 0, 4)]).astype(np.float32)
    made.shuffle(x)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None), (None, [0.0] * 6)], "id long, vec array<float>")
    for k, most, n in ((3, 100, 120), (5, 2, 120), (200, 3, 4)):
        members, clusters = cluster.kmeans(df.filter(f"id is null or id < {n} or id = 900").coalesce(2), "id", "vec", k, most, 7)
        _, own = cluster.lloyd(x[:n], k, most, 7)
        groups = lambda pairs: {frozenset(i for i, c in pairs if c == g) for g in {c for _, c in pairs}}
        assert groups([(r.id, r.cluster) for r in members.collect()]) == groups(list(enumerate(own.tolist())))
        sizes = [r["size"] for r in clusters.orderBy("cluster").collect()]
        assert sizes == sorted(sizes, reverse=True) and sum(sizes) == n
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, vec array<float>")
    assert [tuple(r) for r in cluster.kmeans(same, "id", "vec", 3)[1].collect()] == [(0, 0, 5, 0.0)]
    assert cluster.kmeans(df.filter("id < 0"), "id", "vec", 3)[0].count() == 0


def test_concepts_of_files(spark):
    docs = ["/// caching of pages\nfn a() {}", "  /// search the graph\n", "/// parsing, parsing", "/// testing"]
    rows = [("f.rs", i, d) for i, d in enumerate(docs)] + [("g.rs", i, d) for i, d in enumerate(docs[:3])] + [("h.rs", 9, "// none"), (None, 1, docs[0])]
    df = spark.createDataFrame(rows, "file string, id int, content string")
    found = cluster.file_concepts(df).collect()
    assert found and {r.file for r in found} == {"f.rs"} and len({r.label for r in found}) == len(found) <= 2 and {r.label for r in found} <= set(cluster.VOCABULARY)
    assert all(r.id == f"f.rs:cluster:{r.label}" for r in found)
    told = spark.createDataFrame([("/// hello world\n/// second line\nfn f() {}",), ("fn f() {}\n// regular",), ("///  \n",)], "c string").select(cluster.doc_comment(F.col("c"))).collect()
    assert [r[0] for r in told] == ["hello world second line", None, None]
    assert spark.createDataFrame([("Error  Handling!",)], "c string").select(cluster.slug(F.col("c"))).first()[0] == "error-handling"


def plain_units(files, unit, total, calls):
    out, used, n = [], 0, 0
    for file_no, (name, status, disposition, hunks) in enumerate(files):
        if status == "removed" or disposition == "summary" or not hunks:
            out.append((file_no, 0, 0, True))
            continue
        head, groups = f"--- a/{name}\n+++ b/{name}\n", [[]]
        for h in hunks:
            if groups[-1] and len((head + "".join(x + "\n" for x in [*groups[-1], h])).encode()) > unit:
                groups.append([])
            groups[-1].append(h)
        for i, g in enumerate(groups):
            size = len((head + "".join(x + "\n" for x in g)).encode())
            if n >= calls or used + size > total:
                out.append((file_no, i, 0, True))
            else:
                n, used = n + 1, used + size
                out.append((file_no, i, size, False))
    return out


def test_units_of_diffs(spark):
    made = np.random.default_rng(3)
    reviews = {}
    for review in range(6):
        reviews[review] = [
            (f"src/ä{i}.rs", ["modified", "removed", "renamed", "added"][made.integers(4)], ["kept", "kept", "summary"][made.integers(3)], ["é" * int(made.integers(0, 90)) for _ in range(made.integers(0, 9))]) for i in range(12)
        ]
    rows = [(r, f, n, s, d, h, t) for r, fs in reviews.items() for f, (n, s, d, hunks) in enumerate(fs) for h, t in (enumerate(hunks) if hunks else [(None, None)])]
    df = spark.createDataFrame(rows, "review int, file_no int, file string, status string, disposition string, hunk_no int, text string").repartition(5)
    for unit, total, calls in ((200, 2500, 40), (120, 10_000, 5)):
        found = diffs.units(df, unit, total, calls).collect()
        for review, fs in reviews.items():
            own = sorted((r.file_no, r.chunk, r.chars, r.note is not None) for r in found if r.review == review)
            assert own == plain_units(fs, unit, total, calls)
        assert all(len(r.diff.encode()) == r.chars and (r.chars <= unit or r.oversized) for r in found if r.diff is not None)
        assert {r.note for r in found} >= {None, "deleted file", "summary-only (fixture/generated)"}
    assert diffs.units(df.limit(0)).count() == 0


def test_names_and_sections(spark):
    diff = "+++ b/Head.rs\n--- a/Head.rs\n+pub fn run_all(x: TypeName) {\n-class Foo: Bar2x\n fn same()\n+let do = IfX;\n+fn if\n+const é_x = 1;"
    df = spark.createDataFrame([(diff,)], "d string")
    assert df.select(diffs.changed_names(F.col("d"), 10)).first()[0] == ["run_all", "TypeName", "Foo", "Bar2x", "IfX", "é_x"]
    assert df.select(diffs.changed_names(F.col("d"), 2)).first()[0] == ["run_all", "TypeName"]
    source = "/// Title\n/// Why: first\n///  more words\n\n/// What: does it\n/// Test: none\n/// not taken\nfn f() {}\n/// Why: late"
    asked = spark.createDataFrame([(source,), ("# Why:\n# What: py\nx = 1",), ("code\n/// Why: no",), (None,)], "s string").select(diffs.doc_sections(F.col("s")).alias("d")).select("d.*").collect()
    assert [tuple(r) for r in asked] == [("first more words", "does it"), (None, "py"), (None, None), (None, None)]


def test_keywords_do_not_overlap(spark):
    rules = [("re", "a", 9), ("revert", "b", 50), ("vertex", "c", 90), ("Fix.", "d", 50), ("", "e", 99), ("fix.", "f", 100)]
    cases = {"Revertex": "b", "vertex revert": "c", "fix. then revert": "d", "REVERT fix.": "b", "fixe": None, "pre": "a", "": None}
    df = spark.createDataFrame([(x,) for x in cases], "m string").select("m", classify.exact_tier(F.col("m"), rules).alias("x"), classify.exact_tier(F.col("m"), []).alias("y"))
    assert {r.m: r.x and r.x.category for r in df.collect()} == cases and df.filter("y is not null").count() == 0


def test_scores_of_messages(spark):
    rows = [("Merge branch x", False, []), ("fix bug", False, []), ("add support for new feature", False, []), ("", False, []), ("fix add", False, []), (" AB-1: fix", False, []), ("tidy", True, []), ("docs", False, ["a.md", "b.md"]), ("fix", None, None), (None, False, [])]
    df = spark.createDataFrame(rows, "m string, g boolean, p array<string>").select(classify.scored_tier(F.col("m"), F.col("g"), F.col("p")).alias("w"))
    found = [r.w and (r.w.category, round(r.w.confidence, 4)) for r in df.collect()]
    assert found == [("merge", 0.65), ("bugfix", 0.57), ("feature", 0.75), None, None, None, ("merge", 0.75), ("docs", 0.6), None, None]


def test_reviews_of_diffs(spark):
    mixed = "--- a/old.rs\n+++ b/old.rs\n@@ -1,2 +2,3 @@\n fn a() {}\n+fn a2() {}\n--- /dev/null\n+++ b/new.rs\n@@ -0,0 +1,1 @@\n+/// doc of b\n"
    body = "fn big() {\n" + "if x && y { z }\n" * 8 + "}"
    df = spark.createDataFrame([(1, mixed), (2, "")], "id int, diff string")
    chunks = spark.createDataFrame([("old.rs", 1, 3, body), ("old.rs", 10, 20, "fn other() {}"), ("else.rs", 1, 9, "x")], "file string, start_line long, end_line long, content string")
    found = diffs.reviewed_files(df, chunks)
    rows = {r.file: r for r in found.collect()}
    assert set(rows) == {"old.rs", "new.rs"}
    old, new = rows["old.rs"], rows["new.rs"]
    assert (old.source, old.modified_chunks, old.cyclomatic, old.grade, old.changed) == ("indexed", 1, 17, "D", 1)
    assert [tuple(x) for x in old.smells] == [("missing_docstring", 3, "low")]
    assert old.recommendations[0] == "Cyclomatic complexity is 17 (grade D); extract logic into smaller helper functions" and len(old.recommendations) == 3 and "modifies 1 already" in old.recommendations[2]
    assert (new.source, new.modified_chunks, new.grade, new.smells, new.recommendations) == ("new_file", None, "A", [], [])
    reports = {r.id: r for r in diffs.review_reports(df, found).collect()}
    assert reports[1].summary == "2 files analyzed (1 indexed, 1 new); 1 smell found; overall grade D" and reports[1].changed_lines == 2
    assert reports[2].summary == "0 files analyzed (0 indexed, 0 new); 0 smells found; overall grade A"


def test_consolidation(spark):
    answers = {
        1: '```json\n[{"action":"merge","canonical_content":"C","superseded_ids":["b","a","zz"]},{"action":"alias","from":"x","to":"y"},{"action":"flag","drawer_id":"a","reason":"r"}]\n```', 2: "sorry", 3: '[{"action":"merge","canonical_content":"D"}]',
        4: '[{"action":"merge","canonical_content":"E","superseded_ids":["q"]}]', 5: None, 6: "[]", 7: '[{"action":"alias","from":"x"',
    }
    drawers = spark.createDataFrame([(1, 0, "a", 0.2, ["t", "u"]), (1, 1, "b", 0.9, ["u", "v"]), (1, 2, "c", 1.0, ["w"]), (4, 0, "a", 0.9, None)], "batch int, place int, id string, importance double, tags array<string>")
    merged, aliases, flags, gone = memory.applied_actions(drawers, spark.createDataFrame(list(answers.items()), "batch int, answer string"))
    assert {(r.batch, r.content, r.importance, tuple(r.tags)) for r in merged.collect()} == {(1, "C", 0.9, ("t", "u", "v")), (4, "E", 0.5, ())}
    assert [(r.alias, r.name) for r in aliases.collect()] == [("x", "y")] and [(r.id, r.reason) for r in flags.collect()] == [("a", "r")]
    assert {r.id for r in gone.collect()} == {"a", "b", "zz", "q"}
    batches = spark.createDataFrame([(i, k) for i, k in enumerate("abcadeb")], "batch int, cache_key string")
    cache = spark.createDataFrame([("b", "1"), ("b", "0")], "cache_key string, answer string")
    plan = lambda most: [(r.batch, r.answer) for r in memory.planned_calls(batches, cache, most).orderBy("batch").collect()]
    assert plan(2) == [(0, None), (1, "0"), (2, None)] and len(plan(20)) == 7 and plan(3)[-1] == (4, None)


def test_entities_of_sources(spark):
    source = '''use std::sync::Arc;
use serde::{Deserialize, Serialize};
// Comment with NotAType and "not a string literal"
#[derive(Debug)]
pub struct MyType<T: Clone + Send> { v: Vec<T> }
type Alias = Option<MyType<u8>>;
fn run(x: &str) -> Outcome { let é = "a long literal"; if bad { bail!("no {}", x) } open(x).unwrap(); Arc::new("short") }
#[test]
fn it_works() { let made = Arc::new(MyType { v: 1 }); check(made) }
'''
    df = spark.createDataFrame([("a.rs", "rust", source), ("b.py", "python", "# NoType\nclass Foo(Base):\n    x = 'Quoted'\n"), ("c.cpp", "cpp", "std::map<Key, int> m;"), ("d.zig", "zig", "const X"), ("e.rs", "rust", None), ("f.rs", "rust", "")], "file string, language string, content string")
    found = entities.entities(df).cache()
    of = lambda file, kind: [r.text for r in found.filter(f"file = '{file}' and kind = '{kind}'").orderBy("start").collect()]
    assert of("a.rs", "ExternalCrate") == ["serde"] and of("a.rs", "Annotation") == ["#[derive(Debug)]", "#[test]"] and of("a.rs", "LiteralString") == ['"a long literal"']
    assert set(of("a.rs", "NamedType")) == {"MyType", "T", "Clone", "Send", "Vec", "Alias", "Option", "Outcome"} and of("a.rs", "TraitBound") == [": Clone + Send"]
    assert set(of("a.rs", "ModulePath")) == {"std::sync::Arc", "std::sync", "serde::{Deserialize, Serialize}", "Arc::new"}
    assert of("a.rs", "ErrorVariant") == ['bail!("no {}", x)', "open(x).unwrap()"] and of("a.rs", "TypeAlias") == ["type Alias = Option<MyType<u8>>;"]
    assert of("a.rs", "TestRelation") == ["made", "Arc", "new", "v", "check", "made"]
    assert of("b.py", "NamedType") == ["Foo", "Base"] and of("c.cpp", "ModulePath") == ["std::map"] and of("c.cpp", "NamedType") == ["Key"]
    raw = source.encode()
    for r in found.filter("file = 'a.rs' and kind not in ('ExternalCrate', 'ModulePath')").collect():
        assert raw[r.start : r.end].decode() == r.text and raw[: r.start].count(b"\n") + 1 == r.line
    assert found.filter("file > 'c.cpp'").count() == 0 and {r.kind for r in entities.entities_of(found, "TypeAlias").collect()} == {"TypeAlias"}

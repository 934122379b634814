"""Grep: lines, columns, context, matches over lines, paths alone, and pruning that loses nothing."""

import re

import pytest
from pyspark.sql import functions as F

from devquarry.operators import index
from devquarry.plans import grep


@pytest.fixture(scope="module")
def files(spark):
    rows = [("a.rs", "fn a() {}\n// TODO refactor\nfn b() {}\n// TODO inline\n"), ("src/b.rs", "one\ntwo\n"), ("c.py", "héé lo wörld\r\nXx foo bar\r\n\nlast"), ("d", ""), ("e", None), ("f", "\n\n"), ("g.rs", "aSK ſet\nKelvin K\n")]
    return spark.createDataFrame(rows, "path string, content string")


def found(files, pattern, pruned=None, **options):
    return [(r.path, r.line, r.column, r.text, r.before, r.after) for r in grep.grep(files, grep.Request(pattern, **options), pruned).collect()]


def short(rows):
    return [r[:4] for r in rows]


def test_lines(files):
    assert short(found(files, "TODO")) == [("a.rs", 2, 4, "// TODO refactor"), ("a.rs", 4, 4, "// TODO inline")]
    assert found(files, "TODO", before=1, after=1)[1][4:] == (["fn b() {}"], [])
    assert found(files, "TODO", context=2, before=0)[0][4:] == (["fn a() {}"], ["fn b() {}", "// TODO inline"])
    assert short(found(files, "o", invert=True, glob="src/*")) == []
    assert short(found(files, "one", invert=True, glob="src/*")) == [("src/b.rs", 2, 1, "two")]  # no line after the last
    assert short(found(files, "wörld|foo")) == [("c.py", 1, 8, "héé lo wörld"), ("c.py", 2, 4, "Xx foo bar")]
    assert short(found(files, "^$")) == [("c.py", 3, 1, ""), ("f", 1, 1, ""), ("f", 2, 1, "")]
    assert short(found(files, "xx", ignore_case=True)) == [("c.py", 2, 1, "Xx foo bar")]
    assert short(found(files, "a.b", fixed=True)) == [] and short(found(files, "a()", fixed=True))[0][:3] == ("a.rs", 1, 4)
    assert short(found(files, "fo", word=True)) == [] and len(found(files, "foo", word=True)) == 1
    assert len(found(files, "o", most=2)) == 2 and short(found(files, "(o)(n)e"))[0][2] == 1


def test_over_lines(files):
    assert short(found(files, "one.two")) == []
    assert short(found(files, "one.two", multiline=True)) == [("src/b.rs", 1, 1, "one")]
    assert short(found(files, "TODO.*?fn", multiline=True)) == [("a.rs", 2, 4, "// TODO refactor")]
    assert found(files, "bar\\s+last", multiline=True, before=1, after=2) == [("c.py", 2, 8, "Xx foo bar", ["héé lo wörld"], ["", "last"])]


def test_paths_alone(files):
    assert found(files, "TODO", files_with_matches=True) == [("a.rs", 0, 0, "", [], [])]
    assert [r[0] for r in found(files, "fn", files_with_matches=True, invert=True)] == ["a.rs", "c.py", "f", "g.rs", "src/b.rs"]
    assert [r[0] for r in found(files, "fn|TODO|one|two", files_with_matches=True, invert=True)] == ["c.py", "f", "g.rs"]


@pytest.mark.parametrize("pattern", ["TODO (re|in)", "fn [ab]\\(\\)", "two$", "(?i)todo in", "ask", "set", "kelvin k", "wörld", "(foo)+ bar", "x?foo", "a|b", "one\\ntwo", "(?:todo)? refactor", "[[:alpha:]]", "(?<n>foo) bar"])
def test_pruning_loses_nothing(spark, files, pattern):
    pruned = grep.trigram_index(files.filter("path <> 'e'"))
    for options in ({}, {"ignore_case": True}, {"multiline": True}, {"files_with_matches": True}, {"invert": True}):
        if "(?<n>" in pattern and options.get("multiline"):
            continue
        assert found(files, pattern, **options) == found(files, pattern, pruned, **options)


def test_needed_trigrams(spark, files):
    need = lambda pattern, **o: grep.needed(grep.Request(pattern, **o))
    assert need("abcd") == ["abc", "bcd"] and need("ab.cd") == [] and need("a.bc", fixed=True) == [".bc", "a.b"]
    assert need("foo(bar)?baz") == ["baz", "foo"] and need("fooX|bar") == [] and need("FOO", ignore_case=True) == ["foo"]
    assert need("ask it", ignore_case=True) == [" it"] and need("fée!") == [] and need("(abc)+") == ["abc"] and need("abc", invert=True) == []
    pruned = grep.trigram_index(files.filter("path <> 'e'"))
    newer = index.update(pruned, spark.createDataFrame([("a.rs", "nothing")], "path string, content string"), "path", grep.trigrams(F.col("content")))
    assert [r.key for r in index.holding_all(newer, ["hin", "not"]).collect()] == ["a.rs"] and index.holding_all(newer, ["tod"]).count() == 0
    assert re.compile(grep.Request("a.b", fixed=True, word=True).regex()).search("x a.b y")

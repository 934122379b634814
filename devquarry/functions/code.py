"""Textual code metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks of documentation, anywhere in a text; substrings that count as decisions, each on its own.
DOC_MARKS = ("///", "/**", '"""', "'''")
DECISIONS = ("if ", "else if", "} else", "match ", "loop ", "while ", "for ", " && ", " || ", "? ")


def occurrences(text: Column, part: str) -> Column:
    """How often ``part`` occurs, without overlaps; bytes are counted, as they are stored with a text."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part.encode()))).cast("long")


def decisions(text: Column) -> Column:
    total = F.lit(0).cast("long")
    for part in DECISIONS:
        total = total + occurrences(text, part)
    return total


def cyclomatic(text: Column) -> Column:
    return decisions(text) + 1


def indent_depth(line: Column) -> Column:
    """Leading tabs plus a quarter of the leading spaces."""
    lead = F.regexp_extract(line, r"^([ \t]*)", 1)
    tabs = F.length(lead) - F.length(F.replace(lead, F.lit("\t"), F.lit("")))
    return F.least(tabs + F.floor((F.length(lead) - tabs) / 4), F.lit(255)).cast("long")


def indented(text: Column) -> Column:
    """The lines of a text that begin with a space or a tab; all others have no depth."""
    return F.filter(F.split(text, "\n"), lambda line: F.startswith(line, F.lit(" ")) | F.startswith(line, F.lit("\t")))


def cognitive(text: Column) -> Column:
    """Decisions of each line times one more than its depth: those of the text, as none goes beyond a line, and those of indented lines by depth."""
    return F.aggregate(indented(text), decisions(text), lambda total, line: total + decisions(line) * indent_depth(line))


def max_depth(text: Column) -> Column:
    return F.array_max(F.concat(F.array(F.lit(0).cast("long")), F.transform(indented(text), indent_depth)))


def parameters(text: Column) -> Column:
    """The number of parameters of the first signature; markers are tried in order."""
    after = F.lit(None).cast("string")
    for marker in ("fn ", "def ", "function "):
        spot = F.locate(marker, text)
        found = F.when(spot > 0, F.substring(text, spot, F.length(text)))
        after = F.coalesce(after, found)
    inner = F.trim(F.regexp_extract(after, r"^[^(]*\(([^)]*)\)", 1))
    parts = F.filter(F.split(inner, ","), lambda p: F.trim(p) != "")
    return F.coalesce(F.when(inner.isin("", "self", "&self", "&mut self"), 0).otherwise(F.size(parts)), F.lit(0)).cast("long")


def grade(cyclomatic: Column) -> Column:
    return F.when(cyclomatic <= 5, "A").when(cyclomatic <= 10, "B").when(cyclomatic <= 15, "C").when(cyclomatic <= 20, "D").otherwise("F")


def smells(text: Column) -> Column:
    """Names of the smells of a function's text, in fixed order."""
    documented = F.contains(text, F.lit(DOC_MARKS[0]))
    for mark in DOC_MARKS[1:]:
        documented |= F.contains(text, F.lit(mark))
    return F.array_compact(F.array(
        F.when(occurrences(text, "\n") > 50, "long_function"), F.when(max_depth(text) > 4, "deep_nesting"),
        F.when(parameters(text) > 5, "too_many_params"), F.when(~documented, "missing_docstring"),
    ))


def signature(source: Column) -> Column:
    """The first line that is no comment, attribute or decorator, 240 characters of it at most; null without any."""
    lines = F.transform(F.split(source, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.left(F.get(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(//|@|#(?!define))")), F.lit(0)), F.lit(240))

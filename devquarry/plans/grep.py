"""Grep over files: lines or matches that span lines, with columns and context, pruned by an index of trigrams.

Lines are searched inside the array of a file's lines, so only those found are made rows, each with its own context. A
match over lines is found in the whole text and placed by the cumulated lengths of the lines. The index holds each file's
trigrams in lower case; a file without the trigrams of what a pattern must hold can't match and is not read.
"""

from __future__ import annotations

import re
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import index

FIELDS = "path string, line long, column long, text string, before array<string>, after array<string>"


@dataclass(frozen=True)
class Request:
    """What to find. ``context`` takes the place of ``before`` and ``after``; ``most`` bounds the matches, in order of path and place."""

    pattern: str
    fixed: bool = False
    word: bool = False
    ignore_case: bool = False
    multiline: bool = False
    invert: bool = False
    files_with_matches: bool = False
    before: int = 0
    after: int = 0
    context: int | None = None
    glob: str | None = None
    most: int | None = None

    def body(self) -> str:
        """The regular expression without flags."""
        own = re.escape(self.pattern) if self.fixed else self.pattern
        return rf"\b(?:{own})\b" if self.word else own

    def regex(self) -> str:
        """The regular expression as Spark takes it."""
        return ("(?iu)" if self.ignore_case else "") + ("(?s)" if self.multiline else "") + self.body()

    def around(self) -> tuple[int, int]:
        return (self.before, self.after) if self.context is None else (self.context, self.context)


def lines_of(content: Column) -> Column:
    """The lines without their ends; a text that ends with a line's end has no further line."""
    all_ = F.transform(F.split(content, "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))
    return F.when(content == "", F.array().cast("array<string>")).when(content.endswith("\n"), F.slice(all_, 1, F.size(all_) - 1)).otherwise(all_)


def by_line(files: DataFrame, request: Request) -> DataFrame:
    before, after = request.around()
    pattern = request.regex()
    rows = files.select("path", lines_of(F.col("content")).alias("lines"))
    numbered = F.transform("lines", lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    hits = F.filter(numbered, lambda x: ~x["text"].rlike(pattern) if request.invert else x["text"].rlike(pattern))
    head = ("(?iu)" if request.ignore_case else "") + "(?s)^(.*?)(?:" + ("(?-s:" + request.body() + ")" if not request.multiline else request.body()) + ")"

    def told(x: Column) -> Column:
        column = F.lit(1) if request.invert else F.char_length(F.regexp_extract(x["text"], head, 1)) + 1
        least = F.greatest(x["line"] - before, F.lit(1))
        return F.struct(
            x["line"].cast("long").alias("line"), column.cast("long").alias("column"), x["text"].alias("text"),
            F.slice("lines", least, x["line"] - least).alias("before"), F.slice("lines", x["line"] + 1, F.lit(after)).alias("after"),
        )

    return rows.select("path", F.explode(F.transform(hits, told)).alias("hit")).select("path", "hit.*")


def over_lines(files: DataFrame, request: Request) -> DataFrame:
    """Each match in the whole text, at its line and column; a row for a match."""
    before, after = request.around()
    body, flags = request.body(), request.ignore_case

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        own = regex.compile(body, regex.DOTALL | regex.V0 | (regex.IGNORECASE if flags else 0))
        for batch in batches:
            out: list[tuple] = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                raw = content.split("\n") if content else []
                if raw and content.endswith("\n"):
                    raw.pop()
                starts = np.cumsum([0, *(len(x) + 1 for x in raw)])[: max(len(raw), 1)]
                lines = [x.removesuffix("\r") for x in raw]
                for m in own.finditer(content):
                    i = int(np.searchsorted(starts, m.start(), "right")) - 1
                    text = lines[i] if i < len(lines) else ""
                    column = min(m.start() - int(starts[i]), len(text)) + 1
                    out.append((path, i + 1, column, text, lines[max(i - before, 0) : i], lines[i + 1 : i + 1 + after]))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], k) for c, k in enumerate(kinds)], names=["path", "line", "column", "text", "before", "after"])

    return files.select("path", "content").mapInArrow(found, FIELDS)


def grep(files: DataFrame, request: Request, pruned: index.Index | None = None) -> DataFrame:
    """path, line, column, text, before and after of what matches in files (path, content), in order of path and place.

    With ``files_with_matches`` a row for each file alone, at line and column 0: a file with a match, or where the match is
    inverted with a line that has none. Without files nothing is found; null contents have no lines.
    """
    own = files.select("path", "content").filter("content is not null")
    if request.glob:
        own = own.filter(F.col("path").rlike(paths.glob_regex(request.glob)))
    if pruned is not None and (terms := needed(request)):
        own = own.join(index.holding_all(pruned, terms).withColumnRenamed("key", "path"), "path", "left_semi")
    pattern = request.regex()
    if request.files_with_matches:
        hit = F.exists(lines_of(F.col("content")), lambda x: ~x.rlike(pattern)) if request.invert else F.col("content").rlike(pattern)
        none = F.array().cast("array<string>")
        out = own.filter(hit).select("path", F.lit(0).cast("long").alias("line"), F.lit(0).cast("long").alias("column"), F.lit("").alias("text"), none.alias("before"), none.alias("after"))
    elif request.multiline:
        out = over_lines(own, request)
    else:
        out = by_line(own, request)
    out = out.orderBy("path", "line", "column")
    return out.limit(request.most) if request.most else out


# -- trigrams ------------------------------------------------------------------------------------------------

#: Letters that other characters fold to when case is ignored; no trigram with one of them is asked for then.
FOLDED = set("sk")


def trigrams(content: Column) -> Column:
    """The distinct runs of three characters of a text in lower case; null has none."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(F.lower(content), F.lit("")), F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))


def trigram_index(files: DataFrame) -> index.Index:
    """The index of files (path, content); ``index.update`` with ``trigrams`` keeps it."""
    return index.build(files, "path", trigrams(F.col("content")))


def runs(parsed, out: list[str]) -> None:
    """Adds the runs of characters that every match of a parsed expression holds; what may be left out ends a run."""
    run = ""
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        if name == "AT":  # a place without width
            continue
        out.append(run)
        run = ""
        if name == "SUBPATTERN":
            runs(value[3], out)
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
            runs(value[2], out)
    out.append(run)


def needed(request: Request) -> list[str]:
    """Trigrams in lower case that a file needs for a match; none for a pattern that names no fixed text, and for inverted ones."""
    if request.invert:
        return []
    if request.fixed:
        found, ignores = [request.pattern], request.ignore_case
    else:
        try:
            parsed = parser.parse(request.pattern)
        except (re.error, OverflowError):  # what Python can't parse is not pruned
            return []
        found, ignores = [], request.ignore_case or bool(parsed.state.flags & re.IGNORECASE) or "(?" in request.pattern.replace("(?:", "")
        runs(parsed, found)
    # characters whose lower case has another length or depends on their neighbours are not asked for
    plain = [w if w.isascii() else "".join(c if c.isascii() else "\0" for c in w) for w in found]
    all_ = {w[i : i + 3].lower() for w in plain for i in range(len(w) - 2)}
    return sorted(x for x in all_ if "\0" not in x and not (ignores and FOLDED & set(x)))

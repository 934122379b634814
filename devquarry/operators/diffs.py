"""Diffs of reviews: units of bounded size, changed names, and what their comments say."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import code
from ..sources import files

#: Bytes of a unit, bytes of all units of a review, and units of a review.
UNIT, TOTAL, CALLS = 120_000, 1_000_000, 40
#: Words before a name, in the order in which a line is searched, and short words that are no names.
BEFORE = (
    "fn ", "def ", "class ", "struct ", "type ", "impl ", "interface ", "const ", "enum ", "trait ", "async fn ", "pub fn ", "pub struct ", "pub enum ", "pub trait ", "pub type ", "pub const ", "private ", "protected ",
)
RESERVED = ("if", "as", "fn", "in", "is", "do", "be", "by", "or")
#: What the smells are called in a review, and how severe they are.
SMELLS = {"long_function": ("long_method", "medium"), "deep_nesting": ("deep_nesting", "high"), "too_many_params": ("too_many_params", "medium"), "missing_docstring": ("missing_docstring", "low")}


def units(hunks: DataFrame, unit: int = UNIT, total: int = TOTAL, calls: int = CALLS) -> DataFrame:
    """review, file_no, file, status, chunk, chunks, note, chars, oversized and diff of the units of filtered diffs.

    Rows of ``hunks`` have review, file_no, file, status, disposition, hunk_no and text, null in a file without hunks. Whole
    hunks fill a unit up to ``unit`` bytes with the file's header; one that is larger is a unit of its own, marked oversized.
    In the order of files a unit is left out, with a note in place of its diff, once ``calls`` are used up or where it does
    not fit into what is left of ``total``; later smaller ones may. Removed, summed-up and empty files have a note alone.
    The greedy pass streams sorted rows of lengths; texts meet their unit afterwards, so no review is held by a task.
    """
    key = ["review", "file_no"]
    header = 2 * F.octet_length("file") + 14
    lean = hunks.select(*key, "file", "status", "disposition", "hunk_no", F.octet_length("text").alias("size"), header.alias("header"))
    types = dict(hunks.dtypes)
    schema = f"review {types['review']}, file_no {types['file_no']}, file string, status string, chunk int, from {types['hunk_no']}, to {types['hunk_no']}, note string, chars long, oversized boolean"
    columns = [c.split()[0] for c in schema.split(", ")]

    def rows(batches):
        state = {"review": None, "used": 0, "calls": 0}
        open_unit, last = None, None

        def closed(u):
            note, chars = None, u["chars"]
            if state["calls"] >= calls:
                note, chars = "max-calls reached", 0
            elif state["used"] + chars > total:
                note, chars = "budget exhausted", 0
            else:
                state["calls"] += 1
                state["used"] += chars
            return (*u["key"], u["chunk"], u["from"], u["to"], note, chars, u["n"] == 1 and u["chars"] > unit)

        for pdf in batches:
            out = []
            for review, file_no, file, status, disposition, hunk, size, head in pdf.itertuples(index=False, name=None):
                if last != (review, file_no):
                    if open_unit:
                        out.append(closed(open_unit))
                        open_unit = None
                    chunk, last = 0, (review, file_no)
                    if review != state["review"]:
                        state.update(review=review, used=0, calls=0)
                    noted = None
                    if status == "removed":
                        noted = "deleted file"
                    elif disposition == "summary":
                        noted = "summary-only (fixture/generated)"
                    elif pd.isna(size):
                        noted = "rename-only (no content change)" if status == "renamed" else "binary file or empty diff"
                    if noted:
                        out.append((review, file_no, file, status, 0, None, None, noted, 0, False))
                if noted:
                    continue
                size = int(size) + 1
                if open_unit and open_unit["chars"] + size > unit:
                    out.append(closed(open_unit))
                    open_unit, chunk = None, chunk + 1
                if open_unit is None:
                    open_unit = {"key": (review, file_no, file, status), "chunk": chunk, "from": hunk, "to": hunk, "chars": int(head), "n": 0}
                open_unit.update(to=hunk, chars=open_unit["chars"] + size, n=open_unit["n"] + 1)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([closed(open_unit)] if open_unit else [], columns=columns)

    found = lean.repartition("review").sortWithinPartitions(*key, "hunk_no").mapInPandas(rows, schema)
    counted = found.groupBy(*key).agg(F.count("*").cast("int").alias("chunks"))
    texts = hunks.filter("text is not null").select(*key, "hunk_no", "text")
    met = found.filter("note is null").join(texts, key).filter("hunk_no between `from` and `to`")
    body = met.groupBy(*key, "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk_no", "text"))), lambda x: F.concat(x["text"], F.lit("\n"))), "").alias("body"))
    diff = F.concat(F.lit("--- a/"), "file", F.lit("\n+++ b/"), "file", F.lit("\n"), "body")
    return found.join(body, [*key, "chunk"], "left").join(counted, key).select(*key, "file", "status", "chunk", "chunks", "note", "chars", "oversized", F.when(F.col("note").isNull(), diff).alias("diff"))


def changed_names(diff: Column, most: int) -> Column:
    """The first ``most`` names in changed lines: those after a keyword, then words in camel case, line by line.

    Each line is stripped once, and a keyword's form is only tried on lines that hold the keyword. A return at a line's
    end is no part of a name, so lines are cut at their feeds alone.
    """
    own = lambda x: (F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++"))) | (F.startswith(x, F.lit("-")) & ~F.startswith(x, F.lit("---")))
    lines = F.transform(F.filter(F.split(diff, "\n"), own), lambda x: F.trim(F.substring(x, F.lit(2), F.length(x))))
    letters = r"\p{IsAlphabetic}\p{N}_"

    def names(rest: Column) -> Column:
        after = [F.when(F.contains(rest, F.lit(word)), F.regexp_extract(rest, rf"^.*?{word}([{letters}]*)", 1)) for word in BEFORE]
        named = F.filter(F.array(*after), lambda x: (F.octet_length(x) >= 2) & x.rlike(r"^[\p{IsAlphabetic}_]") & ~x.isin(*RESERVED))
        camel = F.regexp_extract_all(rest, F.lit(rf"(?:^|[^{letters}])(?=\p{{IsUppercase}})([{letters}]*?\p{{IsLowercase}}[{letters}]*)"), F.lit(1))
        return F.concat(named, F.filter(camel, lambda x: F.octet_length(x) >= 3))

    return F.slice(F.array_distinct(F.flatten(F.transform(lines, names))), 1, most)


def doc_sections(source: Column) -> Column:
    """why and what: the sections of those names in the leading comments of a source; null where one is missing or empty."""
    lines = F.transform(F.split(source, r"\r?\n"), lambda x: F.ltrim(x))
    blank = F.struct(F.lit(False).alias("done"), F.lit("").alias("at"), F.lit(None).cast("string").alias("why"), F.lit(None).cast("string").alias("what"))

    def step(s: Column, line: Column) -> Column:
        body = F.trim(F.regexp_replace(line, r"^(///|//!|//|#)", ""))
        done = s["done"] | ((line != "") & ~line.rlike("^(//|#)"))
        still = ~done & (line != "")
        head = F.when(still, F.regexp_extract(body, "^(Why|What|Test):", 1)).otherwise("")
        value = F.trim(F.regexp_replace(body, "^(Why|What):", ""))

        def section(name: str, field: str) -> Column:
            more = F.when(s[field] != "", F.concat(s[field], F.lit(" "), body)).otherwise(body)
            return F.when(head == name, value).when(still & (head == "") & (s["at"] == name) & (body != ""), more).otherwise(s[field])

        return F.struct(done.alias("done"), F.when(head != "", head).otherwise(s["at"]).alias("at"), section("Why", "why").alias("why"), section("What", "what").alias("what"))

    return F.aggregate(lines, blank, step, lambda s: F.struct(F.nullif(s["why"], F.lit("")).alias("why"), F.nullif(s["what"], F.lit("")).alias("what")))


def reviewed_files(diffs: DataFrame, chunks: DataFrame) -> DataFrame:
    """id, file, changed, source, modified_chunks, cyclomatic, cognitive, grade, smells and recommendations of each file of unified diffs (id, diff).

    A file with indexed chunks (file, start_line, end_line, content) is measured on all of them in their order, another on
    its added lines. Chunks are measured once a file, however many diffs change it, and joins move no text of theirs. Modified are the chunks that hold an added line. Smells are placed at the first added line. A file's
    chunks make one text, which the limit on scanned files bounds; files outside the diffs are not read further.
    """
    changed = diffs.select("id", F.explode(files.changed_files(F.col("diff"))).alias("file")).distinct()
    added = files.added_text(diffs).filter("file is not null")
    joined = lambda *order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order))), lambda x: x[order[-1]]), "\n")
    new = added.groupBy("id", "file").agg(F.count("*").alias("changed"), F.min("line").alias("line"), joined("line", "text").alias("new_text"))
    wanted = chunks.select("file", "start_line", "end_line", "content").join(changed.select("file").distinct(), "file", "left_semi")
    measures = {"cyclomatic": code.cyclomatic, "cognitive": code.cognitive, "names": code.smells}
    indexed = wanted.groupBy("file").agg(joined("start_line", "end_line", "content").alias("old_text"))
    indexed = indexed.select("file", F.struct(*[f(F.col("old_text")).alias(n) for n, f in measures.items()]).alias("own"))
    pairs = wanted.select("file", "start_line", "end_line").join(changed, "file")
    lines = added.select(F.col("id").alias("i"), F.col("file").alias("f"), "line")
    touched = pairs.join(lines, (F.col("id") == F.col("i")) & (F.col("file") == F.col("f")) & F.col("line").between(F.col("start_line"), F.col("end_line")), "left_semi").groupBy("id", "file").agg(F.count("*").alias("touched"))
    rows = changed.join(new, ["id", "file"], "left").join(indexed, "file", "left").join(touched, ["id", "file"], "left")
    text, old = F.coalesce("new_text", F.lit("")), F.col("own").isNotNull()
    found = rows.select(
        "id", "file", F.coalesce("changed", F.lit(0)).alias("changed"), F.coalesce("line", F.lit(0)).alias("line"), F.when(old, "indexed").otherwise("new_file").alias("source"),
        F.when(old, F.coalesce("touched", F.lit(0))).alias("modified_chunks"), *[F.when(old, F.col("own")[n]).otherwise(f(text)).alias(n) for n, f in measures.items()],
    ).withColumn("grade", code.grade(F.col("cyclomatic")))
    near = lambda told, rest: F.concat(F.lit(f"{told} near line "), F.col("line").cast("string"), rest)
    advice = F.create_map(
        F.lit("long_function"), near("Long method detected", F.concat(F.lit("; split the "), F.col("changed").cast("string"), F.lit("-line change into focused functions"))),
        F.lit("deep_nesting"), near("Deep nesting", F.lit("; use early returns or guard clauses")), F.lit("too_many_params"), near("Too many parameters", F.lit("; group related arguments into a struct")),
        F.lit("missing_docstring"), F.lit("Add a doc comment explaining the intent of the new code"),
    )
    complex_ = F.when(F.col("grade") >= "C", F.concat(F.lit("Cyclomatic complexity is "), F.col("cyclomatic").cast("string"), F.lit(" (grade "), F.col("grade"), F.lit("); extract logic into smaller helper functions")))
    known = F.when(F.col("modified_chunks") > 0, F.concat(F.lit("This change modifies "), F.col("modified_chunks").cast("string"), F.lit(" already-indexed chunk(s); review their existing complexity before merging")))
    table = F.create_map(*[x for k, (name, severity) in SMELLS.items() for x in (F.lit(k), F.struct(F.lit(name).alias("category"), F.lit(severity).alias("severity")))])
    smells = F.transform("names", lambda n: F.struct(table[n]["category"].alias("category"), F.col("line").alias("line"), table[n]["severity"].alias("severity")))
    told = F.array_compact(F.concat(F.array(complex_), F.transform("names", lambda n: advice[n]), F.array(known)))
    return found.select("id", "file", "changed", "source", "modified_chunks", "cyclomatic", "cognitive", "grade", smells.alias("smells"), told.alias("recommendations"))


def review_reports(diffs: DataFrame, reviewed: DataFrame) -> DataFrame:
    """id, files, overall_grade (the worst), changed_lines, smell_count and summary of each diff; one without files has grade A."""
    sums = reviewed.groupBy("id").agg(F.count("*").alias("n"), F.max("grade").alias("worst"), F.sum("changed").alias("lines"), F.sum(F.size("smells")).alias("found"), F.count_if(F.col("source") == "indexed").alias("old"))
    all_ = diffs.select("id").distinct().join(sums, "id", "left")
    out = all_.select("id", F.coalesce("n", F.lit(0)).alias("files"), F.coalesce("worst", F.lit("A")).alias("overall_grade"), F.coalesce("lines", F.lit(0)).alias("changed_lines"), F.coalesce("found", F.lit(0)).alias("smell_count"), F.coalesce("old", F.lit(0)).alias("old"))
    many = lambda column: F.when(F.col(column) == 1, "").otherwise("s")
    summary = F.format_string("%d file%s analyzed (%d indexed, %d new); %d smell%s found; overall grade %s", "files", many("files"), "old", F.col("files") - F.col("old"), "smell_count", many("smell_count"), "overall_grade")
    return out.withColumn("summary", summary).drop("old")

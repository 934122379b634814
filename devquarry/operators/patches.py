"""Unified diffs as tables: files with their change, hunks with their places, and lines with their numbers; and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules

#: Where a file's part of a diff begins: at its own heading, or in a diff without such at the old name before the new name and a hunk.
FILE, PLAIN = r"(?m)^(?=diff --git )", r"(?m)^(?=--- [^\n]*\n\+\+\+ [^\n]*\n@@ )"
HUNK, PLACE = r"(?m)^(?=@@ -\d)", r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@ ?([^\n]*)"


def parts(diffs: DataFrame) -> DataFrame:
    """id, file_no, header and hunks (an array of their texts) of the files of diffs (id, diff). What stands before the first file is file 0; header and hunks joined are the diff."""
    git = F.col("diff").rlike(r"(?m)^diff --git ")
    cut = F.when(git, F.split("diff", FILE)).otherwise(F.split("diff", PLAIN))
    listed = diffs.filter("diff is not null").select("id", F.posexplode(cut).alias("n", "part"), git.alias("git"))
    starts = F.when(F.col("git"), F.startswith("part", F.lit("diff --git "))).otherwise(F.col("part").rlike(PLAIN.replace("(?m)^(?=", "^(?:")))
    # a diff begins with a file, which is 1 then, or with other text, which is 0 as long as no file begins
    rows = listed.withColumn("pieces", F.split("part", HUNK)).withColumn("starts", starts)
    first = F.col("pieces")[0]
    headed = ~first.rlike(r"^@@ -\d")
    header = F.when(headed, first).otherwise("")
    hunks = F.filter(F.when(headed, F.slice("pieces", 2, F.size("pieces"))).otherwise(F.col("pieces")), lambda x: x != "")
    lead = F.first(F.when(F.col("n") == 0, F.col("starts")), True).over(Window.partitionBy("id"))
    return rows.select("id", (F.col("n") + F.when(lead, 1).otherwise(0)).alias("file_no"), header.alias("header"), hunks.alias("hunks"))


def part_of(pattern: str) -> Column:
    return F.nullif(F.regexp_extract("header", pattern, 1), F.lit(""))


def changed_files(diffs: DataFrame) -> DataFrame:
    """id, file_no, old_path, new_path, change, old_mode, new_mode, similarity, binary and hunks (their number) of each file. A side without a file is null."""
    def path(named: str, mark: str, side: str) -> Column:
        told = F.regexp_extract("header", rf"(?m)^{mark} (?:{side}/)?([^\t\n]*)", 1)
        own = F.when(F.col("header").rlike(rf"(?m)^{mark} "), F.when(told != "/dev/null", told))
        # without marks, as of renames and binary files, the heading's names
        heads = F.regexp_extract("header", r"^diff --git a/(.*) b/(.*)", 1 if side == "a" else 2)
        return F.coalesce(part_of(rf"(?m)^{named} ([^\n]*)"), own, F.when(~F.col("header").rlike(rf"(?m)^{mark} "), F.nullif(heads, F.lit(""))))

    p = parts(diffs).filter("file_no > 0")
    old, new = path("(?:rename|copy) from", "---", "a"), path("(?:rename|copy) to", r"\+\+\+", "b")
    added, gone = F.col("header").rlike(r"(?m)^new file mode|^--- /dev/null"), F.col("header").rlike(r"(?m)^deleted file mode|^\+\+\+ /dev/null")
    change = F.when(F.col("header").rlike("(?m)^rename from "), "renamed").when(F.col("header").rlike("(?m)^copy from "), "copied").when(added, "added").when(gone, "deleted").otherwise("modified")
    return p.select(
        "id", "file_no", F.when(~added, old).alias("old_path"), F.when(~gone, new).alias("new_path"), change.alias("change"),
        part_of(r"(?m)^(?:old mode|deleted file mode) (\d+)").alias("old_mode"), part_of(r"(?m)^new (?:file )?mode (\d+)").alias("new_mode"),
        part_of(r"(?m)^(?:dis)?similarity index (\d+)%").cast("int").alias("similarity"), F.col("header").rlike(r"(?m)^(Binary files |GIT binary patch)").alias("binary"), F.size("hunks").alias("hunks"),
    )


def hunks(diffs: DataFrame) -> DataFrame:
    """id, file_no, hunk_no (from 1), old_start, old_lines, new_start, new_lines, section and text of each hunk; a count that is left out is 1."""
    rows = parts(diffs).select("id", "file_no", F.posexplode("hunks").alias("n", "text"))
    place = lambda i: F.regexp_extract("text", PLACE, i)
    count = lambda i: F.coalesce(F.nullif(place(i), F.lit("")).cast("long"), F.lit(1).cast("long"))
    return rows.select("id", "file_no", (F.col("n") + 1).alias("hunk_no"), place(1).cast("long").alias("old_start"), count(2).alias("old_lines"), place(3).cast("long").alias("new_start"), count(4).alias("new_lines"), place(5).alias("section"), "text")


def lines(diffs: DataFrame) -> DataFrame:
    """id, file_no, hunk_no, line_no (from 1), kind (context, added, removed or mark), old_line, new_line and text of each line below a hunk's head. The lines of a hunk are numbered by one task."""
    body = F.split(F.regexp_replace(F.regexp_replace("text", r"^[^\n]*\n?", ""), r"\n\z", ""), "\n")
    rows = hunks(diffs).filter(F.col("text").rlike(r"^[^\n]*\n[\s\S]")).select("id", "file_no", "hunk_no", "old_start", "new_start", F.posexplode(body).alias("n", "raw"))
    first = F.left("raw", F.lit(1))
    kind = F.when(first == "+", "added").when(first == "-", "removed").when(first == "\\", "mark").otherwise("context")
    own = Window.partitionBy("id", "file_no", "hunk_no").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    moves = lambda *kinds: F.sum(F.col("kind").isin(*kinds).cast("long")).over(own)
    placed = rows.withColumn("kind", kind).withColumn("old", F.col("old_start") + moves("context", "removed") - 1).withColumn("new", F.col("new_start") + moves("context", "added") - 1)
    return placed.select(
        "id", "file_no", "hunk_no", (F.col("n") + 1).alias("line_no"), "kind", F.when(F.col("kind").isin("context", "removed"), F.col("old")).alias("old_line"),
        F.when(F.col("kind").isin("context", "added"), F.col("new")).alias("new_line"), F.substring("raw", 2, 2**31 - 1).alias("text"),
    )


def joined(split: DataFrame) -> DataFrame:
    """id and diff from the rows of ``parts``: the diffs that they came from."""
    own = split.select("id", F.struct("file_no", F.concat("header", F.array_join("hunks", "")).alias("text")).alias("p"))
    return own.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "").alias("diff"))


def added_lines(diffs: DataFrame) -> DataFrame:
    """id, file and line of what the diffs add, for coverage."""
    named = changed_files(diffs).select("id", "file_no", F.col("new_path").alias("file"))
    return lines(diffs).filter("kind = 'added'").join(named, ["id", "file_no"]).select("id", "file", F.col("new_line").alias("line"))


def filtered(diffs: DataFrame) -> DataFrame:
    """What ``diffs.units`` takes, from raw diffs: review, file_no, file, status, disposition, hunk_no and text. Hunks that a rule drops are left out; a file without hunks has one row without."""
    files = changed_files(diffs).select("id", "file_no", F.coalesce("new_path", "old_path").alias("file"), F.col("change").alias("status"))
    text = parts(diffs).filter("file_no > 0").select("id", "file_no", F.concat("header", F.array_join("hunks", "")).alias("patch"))
    kept = hunks(diffs).join(files.select("id", "file_no", "file"), ["id", "file_no"]).filter(rules.hunk_drop(F.col("file"), F.col("text")).isNull()).select("id", "file_no", "hunk_no", "text")
    rows = files.join(text, ["id", "file_no"]).withColumn("disposition", rules.file_disposition(F.col("file"), F.col("patch"))).drop("patch")
    return rows.join(kept, ["id", "file_no"], "left").select(F.col("id").alias("review"), "file_no", "file", "status", "disposition", "hunk_no", "text")

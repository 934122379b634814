"""Reports on the quality of chunks and on what marks them as archived."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import code, paths
from ..functions.paths import ARCHIVE_MARKS, ARCHIVE_PATHS

#: Files that mark their folder as archived, in order.
MARKERS = (".archived", "DEPRECATED")


def smelly(chunks: DataFrame, key: str, text: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """The chunks that have smells, with them, in order of ``key``: all, or a page of them. Null texts have none."""
    found = chunks.withColumn("smells", code.smells(F.col(text))).filter("size(smells) > 0").orderBy(key)
    found = found.offset(offset) if offset else found
    return found if limit is None else found.limit(limit)


def report(chunks: DataFrame, text: str) -> DataFrame:
    """One row: mean decisions, the share of grade A, the sum of smells and the number of chunks; 0 for no chunks."""
    own = chunks.select(code.cyclomatic(F.coalesce(text, F.lit(""))).alias("c"), F.size(code.smells(F.coalesce(text, F.lit("")))).alias("s"))
    mean = lambda x: F.coalesce(F.avg(x), F.lit(0.0))
    return own.agg(mean("c").alias("avg_cyclomatic"), mean((code.grade(F.col("c")) == "A").cast("int")).alias("pct_grade_a"), F.coalesce(F.sum("s"), F.lit(0)).cast("long").alias("smell_count"), F.count("*").alias("chunk_count"))


def archived(chunks: DataFrame, present: DataFrame) -> DataFrame:
    """Chunks (file, content, age_days) with keeps and reason, from the files that are present (file).

    A word in the path, a mark in the content and a marker file in the folder keep 0.3 each, and without them an age over
    a year keeps 0.7; 0.1 is left at least. The reason is the first of them, null where there is none. Only folders with
    markers are joined. A null file, content or age tells nothing.
    """
    file, lower = F.col("file"), F.lower("file")
    folder = lambda f: F.regexp_extract(f, r"^(.*/)?[^/]*$", 1)
    marks = present.filter(F.substring_index("file", "/", -1).isin(*MARKERS)).groupBy(folder(F.col("file")).alias("archive_folder")).agg(F.min(F.substring_index("file", "/", -1)).alias("archive_mark"))
    joined = chunks.withColumn("archive_folder", folder(file)).join(marks, "archive_folder", "left")
    by_path = F.coalesce(*[F.when(F.contains(lower, F.lit(k)), f"path:{k.strip('/')}") for k in ARCHIVE_PATHS])
    by_content = F.coalesce(*[F.when(F.contains("content", F.lit(k)), f"annotation:{k}") for k in ARCHIVE_MARKS])
    by_marker = F.concat(F.lit("marker:"), "archive_mark")
    strong = F.lit(1.0)
    for reason in (by_path, by_content, by_marker):
        strong = strong * F.when(reason.isNotNull(), 0.3).otherwise(1.0)
    stale = F.when(F.col("age_days") > 365, "stale:git_mtime")
    keeps = F.greatest(F.when(strong < 1, strong).when(stale.isNotNull(), 0.7).otherwise(1.0), F.lit(0.1))
    return joined.withColumns({"keeps": keeps, "reason": F.coalesce(by_path, by_content, by_marker, stale)}).drop("archive_folder", "archive_mark")


def detected(files: DataFrame, file: str = "file", place: str = "place") -> DataFrame:
    """One row: primary_language, languages (the most frequent first, then by name), build_system and confidence of files.

    The build system is that of the first manifest by ``place``; confidence is the share of files whose language is known.
    Without files the language is unknown and the confidence 0. Languages are few, so that their list is small.
    """
    told = files.select(F.nullif(paths.language(F.col(file)), F.lit("unknown")).alias("language"), paths.build_system(F.col(file)).alias("build"), F.col(place).alias("place"))
    counts = told.groupBy("language").agg(F.count("*").alias("n"), F.min(F.when(F.col("build").isNotNull(), F.struct("place", "build"))).alias("first"))
    order = F.array_sort(F.collect_list(F.when(F.col("language").isNotNull(), F.struct((-F.col("n")).alias("n"), "language"))))
    found = counts.agg(F.transform(order, lambda x: x["language"]).alias("languages"), F.min("first")["build"].alias("build_system"), F.sum(F.when(F.col("language").isNotNull(), F.col("n"))).alias("known"), F.sum("n").alias("total"))
    confidence = F.coalesce(F.col("known"), F.lit(0)) / F.greatest(F.coalesce("total", F.lit(0)), F.lit(1))
    return found.select(F.coalesce(F.get("languages", F.lit(0)), F.lit("unknown")).alias("primary_language"), "languages", "build_system", confidence.alias("confidence"))

"""Source trees, coverage reports, diffs and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File endings that a scan keeps.
SOURCE_ENDINGS = "rs py ts tsx js jsx mjs cjs go java c cpp h hpp cs rb php swift kt kts scala groovy gradle sh md mdx yaml yml toml json xml txt log".split()
#: Folders that a scan skips; ``skipped`` adds those of a team's own tools.
SKIPPED = (
    ".git target node_modules .venv venv __pycache__ dist build .build .next .nuxt .svelte-kit vendor .cargo .npm .cache .pnpm-store .yarn .rustup .tox .bundle coverage .nyc_output .pytest_cache .mypy_cache .ruff_cache"
    " .gradle .mvn .m2 out bin classes generated generated-sources generated-test-sources cdk.out cdk.out2 .aws-sam .turbo .idea .vscode .claude .cursor .aider .continue .obsidian"
    " fixtures __fixtures__ testdata test-data test_data testresources test_resources"
).split()
#: Lock files, binary endings, endings and name parts of prose, and the size of files above which a scan skips them.
SKIPPED_FILES = "Cargo.lock package-lock.json yarn.lock pnpm-lock.yaml poetry.lock Pipfile.lock Gemfile.lock composer.lock go.sum".split()
BINARY_ENDINGS = "wasm so dylib dll exe pdf png jpg jpeg gif ico webp zip tar gz bz2 xz 7z rar ttf otf woff woff2 mp3 mp4 mov avi mkv db sqlite lock pyc class o a".split()
PROSE_ENDINGS, PROSE_NAMES = "md mdx rst adoc txt".split(), r"(?i)changelog|license|notice"
LARGEST = 1 << 20


def source_tree(spark: SparkSession, root: str, glob: str = "*", prose: bool = True, skipped: tuple[str, ...] = ()) -> DataFrame:
    """path and content of the text files below ``root`` that the rules keep, from any storage that Spark reads.

    Spark's readers leave out files and folders whose name begins with a dot or an underscore, ignore files among them;
    ``walk.source_files`` reads those too, from mounted folders.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    kept = files.filter((F.col("length") <= LARGEST) & ~skipped_path(F.col("path"), skipped) & kept_file(F.col("path"), prose))
    out = kept.select("path", F.decode("content", "UTF-8").alias("content"))
    return out.filter(~minified(F.col("path"), F.col("content")))


def skipped_path(path: Column, skipped: tuple[str, ...] = ()) -> Column:
    return F.exists(F.split(path, "/"), lambda p: p.isin(*SKIPPED, *skipped))


def kept_file(path: Column, prose: bool = True) -> Column:
    """Whether a file's name and ending are those of a source: no lock, binary, minified or bundled file, and no prose unless asked."""
    name = F.element_at(F.split(path, "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"^.+\.([^.]+)$", 1))
    bundled = name.rlike(r"\.(min|bundle)\.(js|css)$|\.chunk\.js$") | (ending.isin("js", "css") & name.rlike(r"-[A-Za-z0-9]{8,}\.[^.]+$"))
    kept = ending.isin(*SOURCE_ENDINGS) & ~name.isin(*SKIPPED_FILES) & ~ending.isin(*BINARY_ENDINGS) & ~bundled
    return kept if prose else kept & ~ending.isin(*PROSE_ENDINGS) & ~name.rlike(PROSE_NAMES)


def minified(path: Column, content: Column) -> Column:
    """JavaScript of fewer than five lines with one over 500 bytes."""
    lines = F.split(content, "\n")
    return path.rlike(r"\.(js|mjs|cjs)$") & (F.size(lines) < 5) & F.exists(lines, lambda x: F.octet_length(x) > 500)


def lcov(lines: DataFrame) -> DataFrame:
    """file, line and hits from a coverage report's lines (report, number, value); a report's lines are one group."""
    own = Window.partitionBy("report").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("file", F.last(F.nullif(F.regexp_extract("value", r"^SF:(.*)$", 1), F.lit("")), ignorenulls=True).over(own))
    data = named.filter(F.col("value").rlike(r"^DA:\d+,\d+"))
    return data.select("file", F.regexp_extract("value", r"^DA:(\d+),", 1).cast("long").alias("line"), F.regexp_extract("value", r"^DA:\d+,(\d+)", 1).cast("long").alias("hits"))


def changed_files(diff: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(diff, F.lit(r"(?m)^\+\+\+ b/(\S+)"), F.lit(1)))


def added_lines(diffs: DataFrame) -> DataFrame:
    """id, file and line of what unified diffs (id, diff) add."""
    return added_text(diffs).drop("text")


def added_text(diffs: DataFrame) -> DataFrame:
    """id, file, line and text of what unified diffs (id, diff) add."""
    text = diffs.select("id", F.posexplode(F.split("diff", "\n")).alias("n", "value"))
    own = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    named = text.withColumn("file", F.last(F.nullif(F.regexp_extract("value", r"^\+\+\+ b/(\S+)", 1), F.lit("")), True).over(own))
    hunk = F.when(F.col("value").rlike(r"^@@ "), F.struct("n", F.regexp_extract("value", r"\+(\d+)", 1).cast("long").alias("at")))
    named = named.withColumn("hunk", F.last(hunk, True).over(own))
    moved = F.when((F.col("n") > F.col("hunk.n")) & ~F.col("value").rlike(r"^[-\\]"), 1).otherwise(0)
    placed = named.withColumn("moved", F.sum(moved).over(Window.partitionBy("id", "hunk.n").orderBy("n")))
    return placed.filter(F.col("value").rlike(r"^\+(?!\+\+ )") & F.col("hunk").isNotNull()).select("id", "file", (F.col("hunk.at") + F.col("moved") - 1).alias("line"), F.substring("value", F.lit(2), F.length("value")).alias("text"))


def category_text(counts: Column) -> Column:
    """A map of counts as sorted k=v;k=v."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")


def write_csv(df: DataFrame, path: str, decimals: int = 2) -> None:
    """Doubles with fixed decimals, a header, one folder."""
    columns = [F.format_string(f"%.{decimals}f", c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_markdown(df: DataFrame, path: str, top: int = 10) -> None:
    """The first rows as a Markdown table."""
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    rows = df.limit(top).select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.col(c).cast("string") for c in df.columns]), F.lit(" |")).alias("row"))
    rows.agg(F.concat_ws("\n", F.lit(head), F.collect_list("row")).alias("value")).write.mode("overwrite").text(path)

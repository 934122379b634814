"""Sources of commits, tags, incidents and work items, and the report files with their fixed headers."""

from __future__ import annotations

import subprocess

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The size that a patch is cut to with its mark, and the columns of the report files; doubles have two decimals but those of four.
PATCH_LIMIT, PATCH_MARK = 200 * 1024, "\n[... truncated ...]"
HEADERS = {
    "authors": "name email commit_count insertions deletions files_changed first_commit last_commit categories",
    "weekly_activity": "week author repository commit_count insertions deletions categories revert_count bugfix_count ticketed_count quality_score quality_tshirt abandoned_pr_count ai_assisted_count avg_complexity",
    "weekly_metrics": "week_id total_commits feature_commits bugfix_commits maintenance_commits refactor_commits test_commits doc_commits active_developers story_points",
    "developer_activity_summary": "developer_id display_name total_commits active_weeks avg_commits_per_week primary_work_type story_points_total activity_score",
    "summary": "date_range total_commits total_developers total_weeks classification_coverage_pct",
    "untracked_commits": "sha author date message",
    "weekly_categorization": "week_id change_type commit_count pct_of_week",
    "weekly_velocity": "week_id prs_merged avg_pr_cycle_time_hours story_points commits_per_developer",
    "weekly_dora_metrics": "deployment_frequency_per_week lead_time_hours change_failure_rate mttr_hours performance_level",
}
FOUR_DECIMALS = {"quality_score", "avg_complexity", "activity_score", "deployment_frequency_per_week", "change_failure_rate"}


def write_report(df: DataFrame, name: str, folder: str) -> None:
    """A report as CSV: the columns of its header in their order (missing ones empty), maps as k=v;k=v, doubles with fixed decimals."""
    from .files import category_text

    kinds, out = dict(df.dtypes), []
    for c in HEADERS[name].split():
        if c not in kinds:
            out.append(F.lit("").alias(c))
        elif kinds[c].startswith("map"):
            out.append(category_text(F.col(c)).alias(c))
        elif kinds[c] in ("double", "float"):
            out.append(F.format_string(f"%.{4 if c in FOUR_DECIMALS else 2}f", F.col(c).cast("double")).alias(c))
        else:
            out.append(F.col(c).cast("string").alias(c))
    df.select(*out).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def git(repository: str, *arguments: str) -> str:
    return subprocess.run(["git", "-C", repository, *arguments], capture_output=True, text=True, errors="replace", check=True).stdout


def per_repository(spark: SparkSession, repositories: list[str], read, schema: str) -> DataFrame:
    """Rows that ``read`` gives of each repository, a task each; repositories are in a folder that all machines see."""

    def rows(batches):
        for batch in batches:
            for path in batch["path"]:
                yield pd.DataFrame(read(path), columns=[c.split()[0] for c in schema.split(", ")])

    paths = spark.createDataFrame([(p,) for p in repositories], "path string").repartition(max(len(repositories), 1), "path")
    return paths.mapInPandas(rows, schema)


COMMIT = "sha string, repository string, author string, email string, timestamp string, parents int, message string"


def git_commits(spark: SparkSession, repositories: list[str], since: str | None = None, until: str | None = None, everything: bool = True) -> DataFrame:
    """The commits of all references, or of the head alone, in a date window; a sha that several repositories have stays once."""

    def read(path: str):
        window = [*([f"--since={since}"] if since else []), *([f"--until={until}"] if until else []), *(["--all"] if everything else [])]
        text = git(path, "log", "-z", "--format=%H%x1f%an%x1f%ae%x1f%aI%x1f%P%x1f%B", *window)
        for entry in filter(None, text.split("\0")):
            sha, name, email, at, parents, message = entry.split("\x1f", 5)
            yield sha, path, name, email, at, len(parents.split()), message.rstrip("\n")

    found = per_repository(spark, repositories, read, COMMIT)
    return found.withColumn("timestamp", F.to_timestamp("timestamp")).dropDuplicates(["sha"])


FILE = "sha string, repository string, path string, old_path string, insertions long, deletions long"


def git_file_changes(spark: SparkSession, repositories: list[str]) -> DataFrame:
    """Lines added and deleted by file and commit; a renamed file has its old path. Binary files have null counts."""

    def read(path: str):
        fields, sha = iter(git(path, "log", "--all", "-M", "-z", "--numstat", "--format=%x1e%H").split("\0")), ""
        for field in fields:
            while field.startswith(("\x1e", "\n\x1e")):
                sha, _, field = field.lstrip("\n")[1:].partition("\n")
            field = field.lstrip("\n")
            if not field:
                continue
            added, deleted, name = field.split("\t", 2)
            old = None
            if not name:
                old, name = next(fields), next(fields)
            yield sha, path, name, old, None if added == "-" else int(added), None if deleted == "-" else int(deleted)

    return per_repository(spark, repositories, read, FILE).dropDuplicates(["sha", "path"])


def capped_patch(patch: Column) -> Column:
    """A patch of PATCH_LIMIT bytes at most, with a mark where it was cut."""
    raw = F.encode(patch, "UTF-8")
    return F.when(F.octet_length(patch) > PATCH_LIMIT, F.concat(F.decode(F.substring(raw, 1, PATCH_LIMIT), "UTF-8"), F.lit(PATCH_MARK))).otherwise(patch)


def git_patches(spark: SparkSession, repositories: list[str]) -> DataFrame:
    """sha and patch of every commit, cut at PATCH_LIMIT."""

    def read(path: str):
        for sha in git(path, "rev-list", "--all").split():
            yield sha, git(path, "show", "--format=", sha)

    return per_repository(spark, repositories, read, "sha string, patch string").select("sha", capped_patch(F.col("patch")).alias("patch"))


def git_tags(spark: SparkSession, repositories: list[str]) -> DataFrame:
    """Tags with the commit that they name and its time."""

    def read(path: str):
        for line in git(path, "for-each-ref", "refs/tags", "--format=%(refname:short)%1f%(if)%(*objectname)%(then)%(*objectname)%(else)%(objectname)%(end)").splitlines():
            tag, sha = line.split("\x1f")
            yield path.rstrip("/").rsplit("/", 1)[-1], tag, sha, git(path, "show", "-s", "--format=%cI", sha).strip()

    return per_repository(spark, repositories, read, "repo string, tag string, sha string, at string").withColumn("at", F.to_timestamp("at"))


def deployments_of_tags(tags: DataFrame, pattern: str) -> DataFrame:
    """Tags (repo, tag, sha, at) that match as production deployments that succeeded; one for each id."""
    own = tags.filter(F.col("tag").rlike(pattern))
    out = own.select(F.concat_ws("@", "repo", "tag").alias("deploy_id"), "repo", F.lit("production").alias("environment"), F.lit("success").alias("status"), F.col("at").alias("triggered_at"), F.col("sha").alias("git_sha"), F.col("tag").alias("git_tag"))
    return out.groupBy("deploy_id").agg(*[F.min_by(c, "triggered_at").alias(c) for c in out.columns[1:]])


def parsed_time(value: Column) -> Column:
    """Seconds since 1970 or an ISO date and time."""
    return F.when(value.rlike(r"^\d+(\.\d+)?$"), F.timestamp_seconds(value.cast("double"))).otherwise(F.try_to_timestamp(value))


def incidents_of_items(items: DataFrame) -> DataFrame:
    """Incidents among work items (id, source, project, item_type, raw_json): bugs and incidents of the operations project."""
    own = items.filter("source = 'jira' and project = 'SRE' and item_type in ('Bug', 'Incident')")
    field = lambda name: F.get_json_object("raw_json", f"$.fields.{name}")
    out = own.select(F.col("id").alias("incident_id"), F.lit("jira_sre").alias("source"), parsed_time(field("created")).alias("detected_at"), parsed_time(field("resolutiondate")).alias("resolved_at"), field("priority.name").alias("severity"), F.col("id").alias("jira_ticket"))
    return out.withColumn("mttr_hours", (F.unix_timestamp("resolved_at") - F.unix_timestamp("detected_at")) / 3600.0)


def incidents_of_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Incidents in JSON files of three shapes: a list, an object with ``data`` or ``incidents``, or one incident. Files that can't be read are left out."""
    texts = spark.read.option("wholetext", True).text(folder)
    row = "struct<id:string,created:string,resolved:string,severity:string,repo:string>"
    shapes = [F.from_json("value", f"array<{row}>"), F.from_json("value", f"struct<data:array<{row}>>")["data"], F.from_json("value", f"struct<incidents:array<{row}>>")["incidents"], F.array(F.from_json("value", row))]
    first = F.substring(F.trim("value"), 1, 1)
    listed = F.when(first == "[", shapes[0]).otherwise(F.coalesce(shapes[1], shapes[2], shapes[3]))
    out = texts.select(F.explode(listed).alias("i")).filter("i.id is not null")
    out = out.select(F.col("i.id").alias("incident_id"), F.lit("export").alias("source"), parsed_time(F.col("i.created")).alias("detected_at"), parsed_time(F.col("i.resolved")).alias("resolved_at"), F.col("i.severity").alias("severity"), F.col("i.repo").alias("repo"))
    return out.withColumn("mttr_hours", (F.unix_timestamp("resolved_at") - F.unix_timestamp("detected_at")) / 3600.0)

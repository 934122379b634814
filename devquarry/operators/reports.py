"""Report tables over commits, pull requests, deployments and incidents, and what they are kept in.

Commits have sha, author, repository, timestamp, insertions, deletions, category, message and the marks revert, bugfix,
ticketed, ai, and complexity. All are aggregates by small keys, with map-side sums before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from .delivery import SUCCESS, iso_week, week_label

#: Categories that the weekly table counts, and hours and rates up to which delivery is of a level.
WEEKLY_CATEGORIES = ("feature", "bugfix", "maintenance", "refactor", "test", "docs")


def iso_label(ts: Column) -> Column:
    year, week = iso_week(ts)
    return F.format_string("%d-W%02d", year, week)


def period_label(since: Column, until: Column) -> Column:
    """2024-W01..W04, or both years where they differ."""
    year = lambda d: F.extract(F.lit("YEAROFWEEK"), d)
    short = F.format_string("%d-W%02d..W%02d", year(since), F.weekofyear(since), F.weekofyear(until))
    return F.when(year(since) == year(until), short).otherwise(F.format_string("%d-W%02d..%d-W%02d", year(since), F.weekofyear(since), year(until), F.weekofyear(until)))


def clamp_week(start: Column, end: Column, first: Column, last: Column) -> tuple[Column, Column]:
    return F.greatest(start, first), F.least(end, last)


def between(rows: DataFrame, ts: str, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Rows of a date range; a bound that is None is none."""
    rows = rows.filter(F.col(ts) >= since) if since is not None else rows
    return rows.filter(F.col(ts) <= until) if until is not None else rows


def categories_of(commits: DataFrame, *keys: str) -> DataFrame:
    """keys and a map of category counts, built from counts, so no list of commits is gathered."""
    counts = commits.groupBy(*keys, "category").agg(F.count("*").alias("k"))
    return counts.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "k")))).alias("categories"))


def weekly_activity(commits: DataFrame) -> DataFrame:
    """The grain of week, author and repository."""
    own = commits.withColumn("week", iso_label(F.col("timestamp")))
    keys = ["week", "author", "repository"]
    mark = lambda c: F.sum(F.col(c).cast("long"))
    sums = own.groupBy(*keys).agg(
        F.count("*").alias("commit_count"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), mark("revert").alias("revert_count"),
        mark("bugfix").alias("bugfix_count"), mark("ticketed").alias("ticketed_count"), mark("ai").alias("ai_assisted_count"), F.avg("complexity").alias("avg_complexity"),
    )
    sums = sums.withColumn("quality_score", scores.quality(F.col("commit_count"), F.col("revert_count"), F.col("bugfix_count"), F.col("ticketed_count")))
    return sums.join(categories_of(own, *keys), keys)


def author_summary(commits: DataFrame) -> DataFrame:
    sums = commits.groupBy("author").agg(F.count("*").alias("commit_count"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.min("timestamp").alias("first_commit"), F.max("timestamp").alias("last_commit"))
    return sums.join(categories_of(commits, "author"), "author")


def repository_summary(commits: DataFrame, top: int = 5) -> DataFrame:
    """Per repository: commits, authors, line sums and its most frequent categories, ties by name."""
    sums = commits.groupBy("repository").agg(F.count("*").alias("commit_count"), F.countDistinct("author").alias("authors"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"))
    ranked = F.array_sort(F.transform(F.map_entries("categories"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("category"))))
    best = categories_of(commits, "repository").select("repository", F.transform(F.slice(ranked, 1, top), lambda e: F.concat(e["category"], F.lit("="), (-e["n"]).cast("string"))).alias("top_categories"))
    return sums.join(best, "repository")


def weekly_metrics(commits: DataFrame) -> DataFrame:
    counts = [F.count(F.when(F.col("category") == c, 1)).alias(f"{c}_commits") for c in WEEKLY_CATEGORIES]
    return commits.groupBy(iso_label(F.col("timestamp")).alias("week_id")).agg(F.count("*").alias("total_commits"), *counts, F.countDistinct("author").alias("active_developers"))


def weekly_velocity(commits: DataFrame, prs: DataFrame) -> DataFrame:
    """Per week: merged requests, their mean cycle hours, and commits per developer."""
    hours = (F.unix_timestamp("merged_at") - F.unix_timestamp("created_at")) / 3600.0
    merged = prs.filter("merged_at is not null").groupBy(iso_label(F.col("merged_at")).alias("week_id")).agg(F.count("*").alias("prs_merged"), F.avg(hours).alias("avg_pr_cycle_time_hours"))
    per = commits.groupBy(iso_label(F.col("timestamp")).alias("week_id")).agg((F.count("*") / F.countDistinct("author")).alias("commits_per_developer"))
    return merged.join(per, "week_id", "full").fillna(0, ["prs_merged"]).fillna(0.0, ["avg_pr_cycle_time_hours", "commits_per_developer"])


def developer_activity(commits: DataFrame) -> DataFrame:
    """Per developer: commits, active weeks, commits a week, and the most frequent category, ties by name."""
    sums = commits.groupBy("author").agg(F.count("*").alias("total_commits"), F.countDistinct(iso_label(F.col("timestamp"))).alias("active_weeks"))
    kinds = commits.groupBy("author", "category").agg(F.count("*").alias("k")).groupBy("author").agg(F.min(F.struct((-F.col("k")).alias("k"), "category"))["category"].alias("primary_work_type"))
    return sums.join(kinds, "author").withColumn("avg_commits_per_week", F.col("total_commits") / F.col("active_weeks"))


def report_summary(commits: DataFrame) -> DataFrame:
    """One row over all commits; coverage is the percent that has a category."""
    known = F.count(F.when(F.col("category") != "uncategorized", 1))
    return commits.agg(
        F.concat_ws("..", F.min("timestamp").cast("date").cast("string"), F.max("timestamp").cast("date").cast("string")).alias("date_range"), F.count("*").alias("total_commits"), F.countDistinct("author").alias("total_developers"),
        F.countDistinct(iso_label(F.col("timestamp"))).alias("total_weeks"), F.when(F.count("*") > 0, 100.0 * known / F.count("*")).otherwise(0.0).alias("classification_coverage_pct"),
    )


def untracked(commits: DataFrame) -> DataFrame:
    return commits.filter(~F.col("ticketed")).select("sha", "author", F.col("timestamp").cast("date").alias("date"), F.split("message", "\n")[0].alias("message"))


def ticketed_share(commits: DataFrame) -> DataFrame:
    """One row: all commits, those with a ticket, and both percents (0 without commits)."""
    out = commits.agg(F.count("*").alias("total"), F.count(F.when(F.col("ticketed"), 1)).alias("ticketed"))
    share = F.when(F.col("total") > 0, 100.0 * F.col("ticketed") / F.col("total")).otherwise(0.0)
    return out.withColumn("ticketed_pct", share).withColumn("untracked_pct", F.when(F.col("total") > 0, 100.0 - F.col("ticketed_pct")).otherwise(0.0))


def period_trends(commits: DataFrame, weeks: int = 4) -> DataFrame:
    """Per author: periods of ``weeks`` ISO weeks from the first commit's week to the last's, empty ones too, with commits and lines."""
    monday = F.date_trunc("week", F.col("timestamp")).cast("date")
    own = commits.select("author", "insertions", monday.alias("monday"))
    spans = own.groupBy("author").agg(F.min("monday").alias("first"), F.max("monday").alias("last"))
    weeks = max(weeks, 1)
    starts = spans.select("author", "first", "last", F.explode(F.sequence("first", "last", F.expr(f"interval {7 * weeks} days"))).alias("since"))
    starts = starts.withColumn("until", F.date_add(F.least(F.date_add("since", 7 * (weeks - 1)), F.col("last")), 6)).withColumn("period", (F.datediff("since", "first") / (7 * weeks)).cast("int"))
    sums = own.join(spans, "author").groupBy("author", F.floor(F.datediff("monday", "first") / (7 * weeks)).cast("int").alias("period")).agg(F.count("*").alias("commits"), F.sum("insertions").alias("insertions"))
    joined = starts.join(sums, ["author", "period"], "left")
    return joined.select("author", period_label(F.col("since"), F.col("until")).alias("label"), "since", "until", F.coalesce("commits", F.lit(0)).alias("commits"), F.coalesce("insertions", F.lit(0)).alias("insertions"))


def date_bounds(commits: DataFrame, since: Column | None = None, until: Column | None = None) -> DataFrame:
    return between(commits, "timestamp", since, until).groupBy("author").agg(F.min("timestamp").cast("date").alias("first"), F.max("timestamp").cast("date").alias("last"))


def mean_quality(weekly: DataFrame, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Mean quality by author over weekly facts (author, iso_year, iso_week, quality) between two weeks; 0 where an author has none."""
    key = F.col("iso_year") * 100 + F.col("iso_week")
    inside = key.between(first[0] * 100 + first[1], last[0] * 100 + last[1])
    return weekly.groupBy("author").agg(F.coalesce(F.avg(F.when(inside, F.col("quality"))), F.lit(0.0)).alias("quality"))


def weekly_engineer(commits: DataFrame) -> DataFrame:
    """Facts by author, ISO week and repository: net commits, generated ones and their percent of net. Marks: revert, mode."""
    year, week = iso_week(F.col("timestamp"))
    out = commits.groupBy("author", year, week, "repository").agg(F.greatest(F.count("*") - F.sum(F.col("revert").cast("long")), F.lit(0)).alias("net_commits"), F.count(F.when(F.col("mode") == "full_agentic", 1)).alias("agentic_count"), F.count(F.when(F.col("mode") == "ide_assisted", 1)).alias("ide_assisted_count"))
    return out.withColumn("agentic_pct", F.when(F.col("net_commits") > 0, 100.0 * F.col("agentic_count") / F.col("net_commits")).otherwise(0.0))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows with the new ones in place of those of equal keys; nulls are equal."""
    same = [old[k].eqNullSafe(new[k]) for k in keys]
    return old.join(new.select(*keys).distinct(), same, "left_anti").unionByName(new)


def effort_histogram(commits: DataFrame, effort: DataFrame) -> DataFrame:
    """author, size and commits, sizes in the order of XS to XL."""
    counts = commits.select("sha", "author").join(effort.select("sha", "size"), "sha").groupBy("author", "size").agg(F.count("*").alias("commits"))
    return counts.withColumn("place", F.array_position(F.array(*map(F.lit, ("XS", "S", "M", "L", "XL"))), F.col("size")).cast("int")).orderBy("author", "place")


def recovery(incidents: DataFrame) -> DataFrame:
    """Incidents with a known time to recovery."""
    return incidents.filter("mttr_hours is not null")


def dora_summary(deployments: DataFrame, commits: DataFrame, failures: DataFrame, incidents: DataFrame, since: Column | None = None) -> DataFrame:
    """One row: deployments, active weeks, deployments a week, mean lead hours, failure rate and mean recovery hours. ``since`` bounds frequency and failure rate alone."""
    recent = between(deployments, "triggered_at", since)
    often = recent.filter(SUCCESS).agg(F.count("*").alias("deploys"), F.countDistinct(week_label(F.col("triggered_at"))).alias("weeks"))
    lead = deployments.filter(SUCCESS).join(commits.select("sha", "timestamp"), F.col("sha") == F.col("git_sha")).agg(F.avg((F.unix_timestamp("triggered_at") - F.unix_timestamp("timestamp")) / 3600.0).alias("lead_hours"))
    bad = failures.select(F.col("deploy_id").alias("bad")).distinct()
    rate = recent.filter("environment = 'production'").join(bad, F.col("deploy_id") == F.col("bad"), "left").agg(F.countDistinct("deploy_id").alias("production"), F.countDistinct("bad").alias("failed"))
    mttr = recovery(incidents).agg(F.avg("mttr_hours").alias("mttr_hours"))
    row = often.join(lead).join(rate).join(mttr)  # one row each
    return row.select("deploys", "weeks", F.when(F.col("weeks") > 0, F.col("deploys") / F.col("weeks")).otherwise(0.0).alias("per_week"), "lead_hours", "failed", F.when(F.col("production") > 0, F.col("failed") / F.col("production")).otherwise(0.0).alias("failure_rate"), "mttr_hours")


# -- ledgers, overrides, identities ------------------------------------------------------------------------


def open_weeks(wanted: DataFrame, runs: DataFrame) -> DataFrame:
    """Weeks (repository, iso_year, iso_week) that no run has collected."""
    return wanted.join(runs, ["repository", "iso_year", "iso_week"], "left_anti")


def week_size(runs: DataFrame) -> DataFrame:
    """Per week the greatest number of repositories of a run."""
    return runs.groupBy("iso_year", "iso_week").agg(F.max("repositories").alias("repositories"))


def explain(commits: DataFrame, classifications: DataFrame, sha: str) -> DataFrame:
    """A commit with its classification, which may be none."""
    return commits.filter(F.col("sha") == F.lit(sha)).join(classifications, "sha", "left")


def listed_overrides(overrides: DataFrame, repository: str | None = None) -> DataFrame:
    own = overrides.filter(F.col("repository") == F.lit(repository)) if repository else overrides
    return own.orderBy(F.desc("created_at"), "sha")


def iterations(rows: DataFrame, project: str) -> DataFrame:
    return rows.filter(F.col("project") == F.lit(project)).orderBy(F.asc_nulls_last("start_date"), "id")


def items_of_commits(links: DataFrame, items: DataFrame) -> DataFrame:
    """Work items of commits by (item, source); repeated links count once."""
    return links.select("sha", "item", "source").distinct().join(items, ["item", "source"])


def author_of(authors: DataFrame, email: Column) -> DataFrame:
    """The author of an e-mail, ignoring case; the smallest id if several have it."""
    return authors.filter(F.lower("email") == F.lower(email)).orderBy("id").limit(1)


def merge_aliases(commits: DataFrame, authors: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commits and authors (author, aliases) after merging ``source`` authors into ``target`` ones: commits move, aliases unite, sources go."""
    moved = commits.join(mapping.select(F.col("source").alias("author"), "target"), "author", "left").withColumn("author", F.coalesce("target", "author")).drop("target")
    named = authors.join(mapping.select(F.col("source").alias("author"), "target"), "author", "left").withColumn("owner", F.coalesce("target", "author"))
    own = F.when(F.col("target").isNotNull(), F.array_union("aliases", F.array("author"))).otherwise(F.col("aliases"))
    united = named.groupBy("owner").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(own)))).alias("aliases"))
    return moved, united.withColumnRenamed("owner", "author")


def same_commit_pairs(commits: DataFrame) -> DataFrame:
    """source and target e-mail of authors of one sha: the smallest is the target."""
    pairs = commits.select("sha", "email").distinct()
    return pairs.join(pairs.groupBy("sha").agg(F.min("email").alias("target")), "sha").filter("email <> target").select(F.col("email").alias("source"), "target").distinct()


def best_suggestions(pairs: DataFrame, least: float) -> DataFrame:
    """The greatest confidence of each (source, target), ``least`` or more, best first."""
    return pairs.groupBy("source", "target").agg(F.max("confidence").alias("confidence")).filter(F.col("confidence") >= least).orderBy(F.desc("confidence"), "source", "target")


def preferred_authors(rows: DataFrame, domain: str) -> DataFrame:
    """One row for each name: an e-mail of the canonical domain before others, then the smallest."""
    other = (~F.lower("email").endswith("@" + domain.lower())).cast("int")
    return rows.groupBy("name").agg(F.min(F.struct(other.alias("o"), "email"))["email"].alias("email"))


def logins(authors: DataFrame) -> DataFrame:
    """author and login from a JSON array of aliases such as ["github:x", "a@b"]."""
    listed = authors.select("author", F.explode(F.from_json("aliases", "array<string>")).alias("alias"))
    return listed.filter(F.col("alias").rlike(r"^[a-z]+:")).select("author", F.regexp_replace("alias", r"^[a-z]+:", "").alias("login")).distinct()


def package_aliases(packages: DataFrame) -> DataFrame:
    """name and alias, the first letters of a hyphenated name: two or more, of one package alone, and no package's name."""
    initials = F.array_join(F.transform(F.filter(F.split("name", "-"), lambda x: x != ""), lambda x: F.substring(x, 1, 1)), "")
    found = packages.select("name", initials.alias("alias")).filter(F.length("alias") >= 2).distinct()
    sole = found.groupBy("alias").agg(F.count("*").alias("n"), F.min("name").alias("name")).filter("n = 1").select("name", "alias")
    return sole.join(packages.select(F.col("name").alias("alias")), "alias", "left_anti").select("name", "alias")


def most_common(findings: DataFrame, kind: str, top: int = 10) -> DataFrame:
    return findings.groupBy(kind).agg(F.count("*").alias("n")).orderBy(F.desc("n"), kind).limit(top)


def newest(entries: DataFrame, order: str, key: str, keep: int) -> DataFrame:
    """The newest entries that a log of ``keep`` entries holds."""
    return entries.orderBy(F.desc(order), F.desc(key)).limit(keep)


def activity_log(entries: DataFrame, since: Column | None = None, until: Column | None = None, offset: int = 0, limit: int = 50, **equal) -> DataFrame:
    """Entries (id, at, ...) of a range, both ends included, with the given values, newest first, one page."""
    for name, value in equal.items():
        entries = entries.filter(F.col(name) == F.lit(value))
    return between(entries, "at", since, until).orderBy(F.desc("at"), F.desc("id")).offset(offset).limit(limit)


#: What people are counted by, and the name of those without it.
HEADCOUNTS = {"team": ("team", "<unassigned>"), "status": ("employment_type", "<unknown>"), "vendor": ("contractor_source", "<unknown>")}


def headcount(people: DataFrame, by: str) -> DataFrame:
    """Active people by team, status (kind of employment) or vendor (of contractors), the largest group first; the name of the group is in a column ``by``."""
    column, unknown = HEADCOUNTS[by]
    own = people.filter("status = 'active'")
    own = own.filter("employment_type = 'Contractor'") if by == "vendor" else own
    return own.groupBy(F.coalesce(column, F.lit(unknown)).alias(by)).agg(F.count("*").alias("headcount")).orderBy(F.desc("headcount"), by)


def people_list(people: DataFrame, most: int = 500) -> DataFrame:
    """The first ``most`` active people by department, team and name; those without come first."""
    names = ["full_name", "team", "department", "title", "level", "employment_type", "status", "contractor_source"]
    return people.filter("status = 'active'").orderBy("department", "team", "full_name").limit(most).select(*names)


def budget(lines: DataFrame, team: str | None = None, category: str | None = None) -> DataFrame:
    """Heads, yearly cost and the year's total of active lines by team and organisation, of one of each if told, the dearest first."""
    own = lines.filter("status is null or status in ('Active', 'active')")
    own = own.filter(F.col("team") == F.lit(team)) if team is not None else own
    own = own.filter(F.col("organization") == F.lit(category)) if category is not None else own
    named = [F.coalesce(c, F.lit("<unassigned>")).alias(c) for c in ("team", "organization")]
    sums = own.groupBy(*named).agg(F.count("*").alias("headcount"), F.round(F.sum("annual_cost"), 2).alias("annual_cost_total"), F.round(F.sum("year_total"), 2).alias("year_total"))
    return sums.orderBy(F.desc("year_total"), "team", "organization")

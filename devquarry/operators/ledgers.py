"""Ledgers of what was collected, reviewed and decided by hand: rows replaced by key, lists newest first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .delivery import keep_last


def replaced(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``old`` with ``new`` in place of the rows of its keys; of new rows with one key the last by ``order`` stays."""
    last = keep_last(new, keys, order)
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*old.columns))


def record_runs(runs: DataFrame, new: DataFrame) -> DataFrame:
    """Collection runs (repo_name, iso_year, iso_week, collected_at, commit_count, repo_count) after further ones."""
    return replaced(runs, new, ["repo_name", "iso_year", "iso_week"], "collected_at")


def collected_weeks(runs: DataFrame, repo: Column) -> DataFrame:
    """iso_year and iso_week of a repository's runs."""
    return runs.filter(F.col("repo_name") == repo).select("iso_year", "iso_week")


def record_reviewers(reviewers: DataFrame, reviews: DataFrame, provider: str = "github") -> DataFrame:
    """Reviewers (pr_id, provider, reviewer_id, display_name, vote, is_required, is_container, review_state, submitted_at) after reviews (pr_id, login, state, submitted_at); reviews without a login are left out, and this provider's reviews have no vote."""
    own = reviews.filter("login is not null and login <> ''").select(
        "pr_id", F.lit(provider).alias("provider"), F.col("login").alias("reviewer_id"), F.lit(None).cast("string").alias("display_name"), F.lit(0).alias("vote"),
        F.lit(0).alias("is_required"), F.lit(0).alias("is_container"), F.col("state").alias("review_state"), "submitted_at",
    )
    return replaced(reviewers, own, ["pr_id", "provider", "reviewer_id"], "submitted_at")


def add_overrides(overrides: DataFrame, new: DataFrame) -> DataFrame:
    """Overrides (commit_sha, repo_path, work_type, change_type, notes, created_at) after further ones."""
    return replaced(overrides, new, ["commit_sha", "repo_path"], "created_at")


def remove_overrides(overrides: DataFrame, gone: DataFrame) -> DataFrame:
    """Overrides without those of the keys (commit_sha, repo_path)."""
    return overrides.join(gone.select("commit_sha", "repo_path"), ["commit_sha", "repo_path"], "left_anti")


def listed_overrides(overrides: DataFrame, repo: str | None = None) -> DataFrame:
    """Overrides, of one repository if told, newest first."""
    own = overrides.filter(F.col("repo_path") == F.lit(repo)) if repo is not None else overrides
    return own.orderBy(F.desc("created_at"), "commit_sha", "repo_path")


def author_categories(commits: DataFrame, authors: DataFrame, classes: DataFrame, email: str, since: str, until: str) -> DataFrame:
    """category and commits of an author, e-mail ignoring case, from a day to another; commits without a category don't count."""
    own = authors.filter(F.lower("canonical_email") == email.lower()).select(F.col("id").alias("author_id"))
    dated = commits.filter((F.col("timestamp") >= F.lit(since).cast("timestamp_ntz")) & (F.col("timestamp") < F.date_add(F.lit(until).cast("date"), 1).cast("timestamp_ntz")))
    rows = dated.join(own, "author_id", "left_semi").join(classes.select(F.col("id").alias("classification_id"), "category"), "classification_id", "left")
    return rows.filter("category is not null").groupBy("category").agg(F.count("*").alias("commits"))

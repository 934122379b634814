"""Delivery analytics over commits, deployments, incidents and pull requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores

SUCCESS = "environment = 'production' and status = 'success'"


def week_label(ts: Column) -> Column:
    """Year and Monday-based week of the year, 00 before the first Monday."""
    day, weekday = F.dayofyear(ts) - 1, F.weekday(ts)
    return F.format_string("%04d-W%02d", F.year(ts), F.floor((day + 7 - weekday) / 7).cast("int"))


def iso_week(ts: Column) -> tuple[Column, Column]:
    return F.extract(F.lit("YEAROFWEEK"), ts).alias("iso_year"), F.weekofyear(ts).alias("iso_week")


def deploy_frequency(deployments: DataFrame) -> DataFrame:
    return deployments.filter(SUCCESS).groupBy("repo", week_label(F.col("triggered_at")).alias("week")).agg(F.count("*").alias("deploys"))


def lead_times(deployments: DataFrame, commits: DataFrame) -> DataFrame:
    """deploy_id, repo and hours from the commit to the deployment."""
    joined = deployments.filter(SUCCESS).join(commits.select("sha", "timestamp"), F.col("sha") == F.col("git_sha"))
    return joined.select("deploy_id", "repo", ((F.unix_timestamp("triggered_at") - F.unix_timestamp("timestamp")) / 3600.0).alias("lead_hours"))


def change_failure_rate(deployments: DataFrame, failures: DataFrame) -> DataFrame:
    """repo, deploys, failed and their ratio, 0 without deployments."""
    bad = failures.select(F.col("deploy_id").alias("failed_id")).distinct()
    joined = deployments.filter(SUCCESS).join(bad, F.col("deploy_id") == F.col("failed_id"), "left")
    out = joined.groupBy("repo").agg(F.countDistinct("deploy_id").alias("deploys"), F.countDistinct("failed_id").alias("failed"))
    return out.withColumn("rate", F.when(F.col("deploys") > 0, F.col("failed") / F.col("deploys")).otherwise(0.0))


def first_after(deployments: DataFrame, commits: DataFrame, within_hours: int, signal: Column) -> DataFrame:
    """deploy_id and sha: the first commit of the repository in (t, t + within] if the signal holds for it.

    Nothing is joined: time is cut into stretches of ``within_hours``, commits stand in their own stretch and the one
    before, and one pass over a stretch from its end hands each deployment the next commit.
    """
    width = within_hours * 3_600_000_000
    micros = lambda name: F.unix_micros(F.col(name).cast("timestamp"))
    stretch = F.expr(f"(at - pmod(at, {width}L)) div {width}L")
    ask = deployments.filter(SUCCESS).select("repo", micros("triggered_at").alias("at"), "deploy_id").withColumn("stretch", stretch)
    have = commits.select(F.col("repository").alias("repo"), micros("timestamp").alias("at"), F.struct("sha", signal.alias("signal")).alias("commit"))
    have = have.groupBy("repo", "at").agg(F.min("commit").alias("commit")).withColumn("stretch", F.explode(F.array(stretch, stretch - 1)))
    both = ask.withColumn("asks", F.lit(True)).unionByName(have.withColumn("asks", F.lit(False)), allowMissingColumns=True).filter("repo is not null and at is not null")
    down = Window.partitionBy("repo", "stretch").orderBy(F.desc("at"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = F.last(F.when(~F.col("asks"), F.struct("at", "commit.sha", "commit.signal")), ignorenulls=True).over(down)
    near = both.withColumn("after", after).filter(F.col("asks") & (F.col("after.at") <= F.col("at") + width))
    first = near.groupBy("deploy_id").agg(F.min("after").alias("first"))
    return first.filter("first.signal").select("deploy_id", F.col("first.sha").alias("sha"))


def pr_metrics(prs: DataFrame) -> DataFrame:
    """Per author: opened, merged, merge rate and mean cycle hours of what took no negative time."""
    hours = (F.unix_timestamp("merged_at") - F.unix_timestamp("created_at")) / 3600.0
    out = prs.groupBy("author").agg(F.count("*").alias("opened"), F.count("merged_at").alias("merged"), F.avg(F.when(hours >= 0, hours)).alias("cycle_hours"))
    return out.withColumn("merge_rate", F.col("merged") / F.col("opened"))


def pr_durations(prs: DataFrame) -> DataFrame:
    """Per author over merges of 0.5 to 720 hours: number, upper median, and 95th percentile from 20 on, by rank."""
    timed = prs.withColumn("hours", (F.unix_timestamp("merged_at") - F.unix_timestamp("created_at")) / 3600.0).filter("hours between 0.5 and 720")
    own = Window.partitionBy("author")
    ranked = timed.select("author", "hours", (F.row_number().over(own.orderBy("hours")) - 1).alias("i"), F.count("*").over(own).alias("n"))
    return ranked.groupBy("author").agg(
        F.max("n").alias("n"), F.max(F.when(F.col("i") == F.floor(F.col("n") / 2), F.col("hours"))).alias("median_hours"),
        F.max(F.when((F.col("n") >= 20) & (F.col("i") == F.floor(F.col("n") * 95 / 100)), F.col("hours"))).alias("p95_hours"),
    )


def commit_summary(commits: DataFrame) -> DataFrame:
    return commits.groupBy("author").agg(
        F.count("*").alias("commits"), F.sum(F.col("ticketed").cast("int")).alias("ticketed"), F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"),
        F.sum("insertions").alias("insertions"), F.countDistinct("repository").alias("repositories"),
    )


def weekly_quality(commits: DataFrame) -> DataFrame:
    """Facts by author, ISO week and repository with the quality score and its band."""
    year, week = iso_week(F.col("timestamp"))
    out = commits.groupBy("author", year, week, "repository").agg(F.count("*").alias("commits"), *[F.sum(F.col(c).cast("int")).alias(f"{c}s") for c in ("revert", "bugfix", "ticketed")])
    out = out.withColumn("quality", scores.quality(F.col("commits"), F.col("reverts"), F.col("bugfixs"), F.col("ticketeds")))
    return out.withColumn("band", scores.quality_band(F.col("quality")))


def percentile_thresholds(values: DataFrame, value: str, shares=(0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """One row: the values of rank ceil(share n), null below five values.

    Values are counted, equal ones once, and split by 1,000 approximate quantiles into stretches whose counts place each
    rank in one of them; only the stretches that hold a rank are sorted, each by itself, so no window holds all rows.
    """
    counts = values.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    cuts = counts.agg(F.percentile_approx("v", [i / 1000 for i in range(1, 1000)], 10000).alias("cuts"))
    passes = lambda lo, step: F.get("cuts", lo + step - 1) < F.col("v")
    below = F.aggregate(F.array(*[F.lit(2**k) for k in range(9, -1, -1)]), F.lit(0), lambda lo, step: F.when(passes(lo, step), lo + step).otherwise(lo))  # how many cuts, by halves
    placed = counts.join(F.broadcast(cuts)).withColumn("stretch", below).drop("cuts")
    sums = placed.groupBy("stretch").agg(F.sum("n").alias("own"))  # 1,000 rows at most
    before = sums.withColumn("before", F.sum("own").over(Window.orderBy("stretch")) - F.col("own")).withColumn("total", F.sum("own").over(Window.partitionBy()))
    asked = F.array(*[F.ceil(F.lit(s) * F.col("total")) for s in shares])
    holding = before.filter(F.exists(asked, lambda r: (r > F.col("before")) & (r <= F.col("before") + F.col("own"))))
    ranked = placed.join(F.broadcast(holding), "stretch").withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("stretch").orderBy("v")))
    hit = lambda s: (F.ceil(F.lit(s) * F.col("total")) > F.col("upto") - F.col("n")) & (F.ceil(F.lit(s) * F.col("total")) <= F.col("upto"))
    return ranked.agg(*[F.max(F.when((F.col("total") >= 5) & hit(s), F.col("v"))).alias(f"p{int(s * 100)}") for s in shares])


def rebinned(efforts: DataFrame, score: str = "score", size: str = "size") -> DataFrame:
    """Efforts with tshirt: 1 to 5 by the thresholds of all scores, by the size label where there are fewer than five."""
    cuts = percentile_thresholds(efforts, score)  # one row
    banded = scores.percentile_band(F.col(score), [F.col(f"_cuts.{c}") for c in cuts.columns])
    out = efforts.withColumn("_cuts", cuts.select(F.struct(*cuts.columns)).scalar())
    return out.withColumn("tshirt", F.coalesce(banded, scores.tshirt(F.col(size)))).drop("_cuts")


def failure_signal(message: Column, category: Column, signals: list[tuple[str | None, str | None]]) -> Column:
    """Whether any of the signals (work type, pattern) holds: a type equal but for case, a pattern found in the message; a signal without both always holds. A null message or type holds none that asks for it."""
    held = F.lit(False)
    for kind, pattern in signals:
        own = F.lit(True)
        if kind is not None:
            own = own & (F.lower(category) == kind.lower())
        if pattern is not None:
            own = own & message.rlike(pattern)
        held = held | F.coalesce(own, F.lit(False))
    return held


def commit_effort(files: DataFrame) -> DataFrame:
    """sha, score, size and T-shirt number from its files (sha, path, lines, is_test)."""
    out = files.groupBy("sha").agg(F.sum("lines").alias("loc"), F.count("*").alias("files"), F.sum(F.when(F.col("is_test"), F.col("lines")).otherwise(0)).alias("test_loc"))
    out = out.withColumn("score", scores.effort(F.col("loc"), F.col("files"), F.col("test_loc"))).withColumn("size", scores.effort_size(F.col("score")))
    return out.withColumn("tshirt", scores.tshirt(F.col("size")))


def latest_rows(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """All rows of a key at its greatest ``order``."""
    marked = rows.withColumn("own_order", order)
    last = marked.groupBy(key).agg(F.max("own_order").alias("own_order"))
    return marked.join(last, [key, "own_order"]).drop("own_order")


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert: of rows with equal keys the one with the greatest order."""
    columns = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(order)).alias("last")).select(*keys, *[F.col(f"last.{c}").alias(c) for c in columns])


def slope(points: DataFrame, key: str, index: str, value: str) -> DataFrame:
    """Least-squares slope and its trend; stable below two points."""
    out = points.groupBy(key).agg(F.count("*").alias("n"), F.regr_slope(F.col(value), F.col(index)).alias("raw"))
    out = out.withColumn("slope", F.when(F.col("n") >= 2, F.coalesce("raw", F.lit(0.0))).otherwise(0.0))
    return out.select(key, "n", "slope", scores.trend(F.col("slope")).alias("trend"))

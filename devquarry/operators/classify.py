"""Commit classification: tiers that each give category, confidence and method, and their cascade."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text


def result(category: Column | str, confidence: float, method: str) -> Column:
    category = F.lit(category) if isinstance(category, str) else category
    return F.struct(category.alias("category"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method"))


def exact_tier(message: Column, rules: list[tuple[str, str, int]]) -> Column:
    """Of the rules (keyword, category, priority) whose keyword occurs, ignoring case, that of highest priority, the first in the message on ties.

    Keywords are found from left to right, the longest at each place, and do not overlap; of equal keywords the first counts.
    """
    known = {}
    for k, c, priority in rules:
        if k:
            known.setdefault(k.lower(), (k, c, priority))
    if not known:
        return F.lit(None).cast("struct<category:string,confidence:double,method:string>")
    pattern = "(?i)(" + "|".join(re.escape(k) for k, _, _ in sorted(known.values(), key=lambda r: -len(r[0]))) + ")"
    table = F.create_map(*[x for k, (_, c, priority) in known.items() for x in (F.lit(k), F.struct(F.lit(priority).alias("priority"), F.lit(c).alias("category")))])

    def placed(match: Column, place: Column) -> Column:
        rule = F.element_at(table, F.lower(match))
        return F.struct(rule["priority"].alias("priority"), (-place).alias("place"), rule["category"].alias("category"))

    best = F.array_max(F.transform(F.regexp_extract_all(message, F.lit(pattern), F.lit(1)), placed))
    return F.when(best.isNotNull(), result(best["category"], 1.0, "exact"))


def regex_tier(message: Column, rules: list[tuple[str, str, int]], confidence: float = 0.85) -> Column:
    ordered = sorted(enumerate(rules), key=lambda r: (-r[1][2], r[0]))
    return F.coalesce(*[F.when(message.rlike(p), result(c, confidence, "regex")) for _, (p, c, _) in ordered])


def weighted_tier(message: Column, signals: dict[str, list[tuple[str, float]]], least: float = 0.55, most: float = 0.95) -> Column:
    """Of categories with summed signal weights the largest; none below ``least`` or on a tie."""
    sums = {c: sum((F.when(message.rlike(p), w).otherwise(0.0) for p, w in own), F.lit(0.0)) for c, own in signals.items()}
    top = F.greatest(*sums.values())
    ties = sum(((s == top).cast("int") for s in sums.values()), F.lit(0))
    name = F.coalesce(*[F.when(s == top, F.lit(c)) for c, s in sums.items()])
    return F.when((ties == 1) & (top >= least), F.struct(name.alias("category"), F.least(top, F.lit(most)).alias("confidence"), F.lit("weighted").alias("method")))


#: Categories of the scored tier with the words that speak for each.
WORDS = {
    "feature": "add implement feature support introduce create build new extend enable", "bugfix": "fix bug issue broken regression hotfix patch resolve repair correct",
    "chore": "chore ci build ops release version bump update upgrade automate", "integration": "integrate api webhook sdk plugin connector bridge endpoint external third-party",
    "platform": "perf performance infra infrastructure architecture devops deploy scale optimize database", "docs": "docs readme documentation comment typo copy translation locale i18n asset",
    "refactor": "refactor cleanup rename deps dependency style lint format test remove", "merge": "",
}
#: Scores of one, two and more words; of a ticket in front; of short and long messages; of merges.
WORD_SCORES, TICKET_SCORE, SHORT, LONG = (0.40, 0.60, 0.75), 0.05, 12, 80
SHORT_SCORES, LONG_SCORES = {"chore": 0.10, "merge": 0.10, "refactor": 0.05, "feature": -0.05, "bugfix": -0.03}, {"feature": 0.10, "platform": 0.10, "refactor": 0.05, "bugfix": 0.05}
MERGE_SCORE, OTHER_THAN_MERGE = 0.65, -0.05
#: Paths of tests, prose and manifests, each with the scores of a commit all of whose files are such; less than half gives none.
PATH_SCORES = (
    (r"tests?/|spec/|_test\.rs$|_spec\.rb$|\.(test|spec)\.ts$", {"refactor": 0.20, "bugfix": 0.10}), (r"docs?/|\.(md|rst|txt)$", {"docs": 0.20}),
    (r"(^|/)(Cargo\.toml|package\.json|pyproject\.toml|requirements\.txt|Gemfile|pom\.xml|build\.gradle|go\.mod|Pipfile|setup\.py|composer\.json)$", {"chore": 0.20, "refactor": 0.10}),
)
TICKET = r"^[A-Z][A-Z0-9]*-[0-9]+[:,-]*(\s|$)"


def scored_tier(message: Column, is_merge: Column, paths: Column, least: float = 0.55, most: float = 0.95) -> Column:
    """The category whose words, ticket, length, merge marks and file paths score highest, in 32-bit sums; null on ties and below ``least``."""
    single = lambda x: F.lit(x).cast("float")
    trimmed = F.regexp_replace(message, r"^\s+|\s+$", "")

    def ratio_of(pattern: str) -> Column:
        return (F.size(F.filter(paths, lambda p: p.rlike(pattern))).cast("double") / F.when(F.size(paths) > 0, F.size(paths))).cast("float")

    def score(category: str, v: Column) -> Column:
        n = sum((v["lower"].contains(w).cast("int") for w in WORDS[category].split()), F.lit(0))
        out = F.element_at(F.array(single(0.0), *map(single, WORD_SCORES)), F.least(n, F.lit(len(WORD_SCORES))) + 1)
        out = out + F.when(v["ticket"], single(TICKET_SCORE)).otherwise(single(0.0))
        out = out + F.when(v["length"] < SHORT, single(SHORT_SCORES.get(category, 0.0))).when(v["length"] > LONG, single(LONG_SCORES.get(category, 0.0))).otherwise(single(0.0))
        out = out + F.when(v["merged"], single(MERGE_SCORE if category == "merge" else OTHER_THAN_MERGE)).otherwise(single(0.0))
        own = single(0.0)
        for i, (_, weights) in enumerate(PATH_SCORES):
            if category in weights:
                own = own + F.when(v[f"r{i}"] >= single(0.5), v[f"r{i}"] * single(weights[category])).otherwise(single(0.0))
        return out + own

    def choice(s: Column) -> Column:
        top = s[0]["score"]
        found = F.struct(s[0]["category"].alias("category"), F.least(top.cast("double"), F.lit(most)).alias("confidence"), F.lit("weighted").alias("method"))
        return F.when((top != s[1]["score"]) & (top >= single(least)), found)

    # lambdas bind what is used more than once, so that each part is found once a row
    ratios = [ratio_of(x).alias(f"r{i}") for i, (x, _) in enumerate(PATH_SCORES)]
    merged = F.coalesce(is_merge, F.lit(False))
    parts = F.transform(F.array(trimmed), lambda x: F.struct(F.lower(x).alias("lower"), F.octet_length(x).alias("length"), x.rlike(TICKET).alias("ticket"), (merged | F.lower(x).startswith("merge ")).alias("merged"), *ratios))
    ranked = F.transform(parts, lambda v: F.sort_array(F.array(*[F.struct(score(c, v).alias("score"), F.lit(c).alias("category")) for c in WORDS]), False))
    return F.transform(ranked, choice)[0]


def fuzzy_tier(message: Column, is_merge: Column) -> Column:
    lower = F.lower(F.trim(message))
    return (
        F.when(is_merge | lower.rlike("^merge (pull request|branch|remote-tracking)"), result("merge", 0.95, "fuzzy")).when(lower.rlike("^revert[ :]"), result("revert", 0.9, "fuzzy"))
        .when(F.trim(message).rlike(r"^[A-Z][A-Z0-9]+-\d+"), result("feature", 0.6, "fuzzy")).when((F.octet_length(lower) < 12) & (lower != ""), result("chore", 0.4, "fuzzy"))
    )


def cascade(commits: DataFrame, tiers: list[Column]) -> DataFrame:
    """The commits with the first tier's result that is not null, else uncategorised."""
    found = F.coalesce(*tiers, result("uncategorized", 0.0, "none"))
    return commits.withColumn("found", found).select(*commits.columns, "found.*")


def overrides(commits: DataFrame, manual: DataFrame) -> DataFrame:
    """Manual categories by (sha, repository) win over the found ones."""
    own = manual.select("sha", "repository", F.col("category").alias("manual"))
    joined = commits.join(own, ["sha", "repository"], "left")
    return joined.withColumn("category", F.coalesce("manual", "category")).withColumn("confidence", F.when(F.col("manual").isNotNull(), 1.0).otherwise(F.col("confidence"))).withColumn("method", F.when(F.col("manual").isNotNull(), "override").otherwise(F.col("method"))).drop("manual")


def fallback(commits: DataFrame, rules: DataFrame, least: float) -> DataFrame:
    """A repository's own category where the found one is none or below ``least``."""
    joined = commits.join(rules.select("repository", F.col("category").alias("usual")), "repository", "left")
    weak = ((F.col("category") == "uncategorized") | (F.col("confidence") < least)) & F.col("usual").isNotNull()
    return joined.withColumn("category", F.when(weak, F.col("usual")).otherwise(F.col("category"))).drop("usual")


def classified(commits: DataFrame, exact: list = (), regex: list = (), projects: dict[str, str] | None = None, manual: DataFrame | None = None, scored: bool = True, defaults: bool = True, own: dict[str, str] | None = None) -> DataFrame:
    """Commits (sha, repository, message, is_merge, issue_type) with category, confidence, method, top_level and ticket_id by all tiers.

    Manual categories (sha, repository, category; one a commit) go first, then exact words, issue types, project keys,
    patterns, scored words unless ``scored`` is off, and rough guesses with ``defaults``; the first that holds counts.
    ``own`` are one's own top levels. A manual category has no ticket; null messages are uncategorised but for a manual
    category, an issue type or a merge.
    """
    message, merge = F.col("message"), F.coalesce("is_merge", F.lit(False))
    tiers = [exact_tier(message, list(exact))] if exact else []
    tiers.append(rules.issue_type_tier(F.col("issue_type")))
    tiers += [rules.project_tier(message, projects)] if projects else []
    tiers += [regex_tier(message, list(regex))] if regex else []
    tiers += [scored_tier(message, merge, F.array().cast("array<string>"))] if scored else []
    tiers += [fuzzy_tier(message, merge)] if defaults else []
    found = cascade(commits, tiers)
    found = overrides(found, manual) if manual is not None else found
    ticket = F.when(F.col("method") != "override", text.ticket_id(message))
    return found.withColumns({"top_level": rules.top_level(F.col("category"), own), "ticket_id": ticket})


#: Columns of a rule file's rows.
RULE = "id string, category string, tier string, pattern string, priority int"


def load_rules(spark, paths: list[str]) -> DataFrame:
    """id, category, tier (exact or regex), pattern and priority of rule files in JSON lines; a rule that several files name is the last file's, at its first place."""
    if not paths:
        raise ValueError("at least one rule file is needed")
    found = None
    for i, path in enumerate(paths):
        own = spark.read.schema(RULE).json(path).withColumn("file", F.lit(i)).withColumn("line", F.monotonically_increasing_id())
        found = own if found is None else found.unionByName(own)
    columns = ["category", "tier", "pattern", "priority"]
    last = found.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("file", "line")).alias("rule"), F.min(F.struct("file", "line")).alias("place"))
    return last.orderBy("place").select("id", *[F.coalesce(f"rule.{c}", F.lit(100)).alias(c) if c == "priority" else F.col(f"rule.{c}").alias(c) for c in columns])


def tiers_of(rules: DataFrame, message: Column) -> list[Column]:
    """The exact and the regex tier of loaded rules, which are a short list."""
    rows = rules.collect()
    listed = {tier: [(r.pattern, r.category, r.priority) for r in rows if r.tier == tier] for tier in ("exact", "regex")}
    return [make(message, listed[tier]) for tier, make in (("exact", exact_tier), ("regex", regex_tier)) if listed[tier]]


def dry_run(rules: DataFrame, message: str) -> DataFrame:
    """message, category, confidence and method of one message by loaded rules; the method is none where no rule holds."""
    one = rules.sparkSession.createDataFrame([(message,)], "message string")
    return cascade(one, tiers_of(rules, F.col("message")))

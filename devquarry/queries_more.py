"""Queries of reports, rules, graphs, stores and search adjustments, registered beside those of ``queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import code, rules, text
from .operators import chunking, classify, cluster, delivery, diffs, entities, graph, identity, index, ledgers, memory, parse, patches, ranges, reports, retrieval, stores
from .plans import grep, search
from .queries import DECISION_SQL, SHAPES, checkpointed, first_vector, indexed, kept, lexical_lane, query, sql_list, vectors
from .queries import BM25_SQL, COS_SQL, DOC_TOKENS_SQL
from .sources import delivery as delivery_sources
from .sources import walk
from .streaming import tables

CATEGORY = "CASE o_orderkey % 7 WHEN 0 THEN 'feature' WHEN 1 THEN 'bugfix' WHEN 2 THEN 'docs' WHEN 3 THEN 'test' WHEN 4 THEN 'refactor' WHEN 5 THEN 'uncategorized' ELSE 'maintenance' END"
SHAPES["work"] = f"""SELECT CAST(o_orderkey AS STRING) AS sha, concat('dev', CAST(o_custkey % 40 AS STRING)) AS author, concat('repo', CAST(o_custkey % 7 AS STRING)) AS repository, o_orderdate AS timestamp,
    CAST(floor(o_totalprice) AS BIGINT) AS insertions, o_orderkey % 100 AS deletions, {CATEGORY} AS category, o_orderkey % 11 = 0 AS revert, o_orderkey % 7 = 1 AS bugfix, o_orderkey % 3 = 0 AS ticketed, o_orderkey % 5 = 0 AS ai,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 20 AS DOUBLE) END AS complexity, concat('change ', CAST(o_orderkey AS STRING)) AS message,
    CASE o_orderkey % 5 WHEN 0 THEN 'full_agentic' WHEN 1 THEN 'ide_assisted' ELSE 'none' END AS mode FROM {{orders}}"""
WEEK = "strftime(timestamp, '%G-W%V')"
QUALITY = "0.35 * (1 - r / n) + 0.4 * (1 - b / n) + 0.25 * (k / n)"


@query(f"""WITH s AS (SELECT {WEEK} AS week, author, repository, count(*) AS n, CAST(sum(insertions) AS BIGINT) AS ins, CAST(sum(deletions) AS BIGINT) AS del, count(*) FILTER (revert) AS r, count(*) FILTER (bugfix) AS b, count(*) FILTER (ticketed) AS k, count(*) FILTER (ai) AS a, avg(complexity) AS c FROM work GROUP BY ALL),
    m AS (SELECT week, author, repository, string_agg(concat(category, '=', n), ';' ORDER BY category) AS categories FROM (SELECT {WEEK} AS week, author, repository, category, count(*) AS n FROM work GROUP BY ALL) GROUP BY ALL)
    SELECT week, author, repository, n AS commit_count, ins AS insertions, del AS deletions, r AS revert_count, b AS bugfix_count, k AS ticketed_count, a AS ai_assisted_count, round(c, 6) AS avg_complexity, round({QUALITY}, 6) AS quality_score, categories FROM s JOIN m USING (week, author, repository)""", "work")
def report_weekly_activity(t):
    from .sources.files import category_text

    out = reports.weekly_activity(t("work"))
    return out.withColumns({"categories": category_text(F.col("categories")), "quality_score": F.round("quality_score", 6), "avg_complexity": F.round("avg_complexity", 6)})


@query("WITH m AS (SELECT author, string_agg(concat(category, '=', n), ';' ORDER BY category) AS categories FROM (SELECT author, category, count(*) AS n FROM work GROUP BY ALL) GROUP BY author) SELECT author, count(*) AS commit_count, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions, min(timestamp) AS first_commit, max(timestamp) AS last_commit, any_value(categories) AS categories FROM work JOIN m USING (author) GROUP BY author", "work")
def report_authors(t):
    from .sources.files import category_text

    return reports.author_summary(t("work")).withColumn("categories", category_text(F.col("categories")))


@query("""WITH c AS (SELECT repository, category, count(*) AS n FROM work GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY n DESC, category) AS i FROM c), m AS (SELECT repository, string_agg(concat(category, '=', n), ';' ORDER BY i) AS top FROM r WHERE i <= 3 GROUP BY repository)
    SELECT repository, count(*) AS commit_count, count(DISTINCT author) AS authors, CAST(sum(insertions) AS BIGINT) AS insertions, CAST(sum(deletions) AS BIGINT) AS deletions, any_value(top) AS top_categories FROM work JOIN m USING (repository) GROUP BY repository""", "work")
def report_repositories(t):
    return reports.repository_summary(t("work"), 3).withColumn("top_categories", F.array_join("top_categories", ";"))


@query(f"SELECT {WEEK} AS week_id, count(*) AS total_commits, {', '.join(f'count(*) FILTER (category = {chr(39)}{c}{chr(39)}) AS {c}_commits' for c in reports.WEEKLY_CATEGORIES)}, count(DISTINCT author) AS active_developers FROM work GROUP BY 1", "work")
def report_weekly_metrics(t):
    return reports.weekly_metrics(t("work"))


@query(f"""WITH m AS (SELECT strftime(merged_at, '%G-W%V') AS week_id, count(*) AS p, avg((epoch(merged_at) - epoch(created_at)) / 3600.0) AS h FROM prs WHERE merged_at IS NOT NULL GROUP BY 1), c AS (SELECT {WEEK} AS week_id, count(*) / count(DISTINCT author) AS per FROM work GROUP BY 1)
    SELECT week_id, coalesce(p, 0) AS prs_merged, round(coalesce(h, 0), 6) AS avg_pr_cycle_time_hours, round(coalesce(per, 0), 6) AS commits_per_developer FROM m FULL JOIN c USING (week_id)""", "work", "prs")
def report_weekly_velocity(t):
    return reports.weekly_velocity(t("work"), t("prs")).withColumns({c: F.round(c, 6) for c in ("avg_pr_cycle_time_hours", "commits_per_developer")})


@query(f"WITH k AS (SELECT author, category, row_number() OVER (PARTITION BY author ORDER BY count(*) DESC, category) AS i FROM work GROUP BY author, category) SELECT author, count(*) AS total_commits, count(DISTINCT {WEEK}) AS active_weeks, any_value(k.category) AS primary_work_type, round(count(*) / count(DISTINCT {WEEK}), 6) AS avg_commits_per_week FROM work JOIN k USING (author) WHERE i = 1 GROUP BY author", "work")
def report_developer_activity(t):
    return reports.developer_activity(t("work")).withColumn("avg_commits_per_week", F.round("avg_commits_per_week", 6))


@query(f"SELECT concat(CAST(CAST(min(timestamp) AS DATE) AS VARCHAR), '..', CAST(CAST(max(timestamp) AS DATE) AS VARCHAR)) AS date_range, count(*) AS total_commits, count(DISTINCT author) AS total_developers, count(DISTINCT {WEEK}) AS total_weeks, round(100.0 * count(*) FILTER (category <> 'uncategorized') / count(*), 6) AS classification_coverage_pct FROM work", "work")
def report_summary(t):
    return reports.report_summary(t("work")).withColumn("classification_coverage_pct", F.round("classification_coverage_pct", 6))


@query("SELECT sha, author, CAST(timestamp AS DATE) AS date, message FROM work WHERE NOT ticketed", "work")
def report_untracked(t):
    return reports.untracked(t("work"))


@query("SELECT count(*) AS total, count(*) FILTER (ticketed) AS ticketed, round(100.0 * count(*) FILTER (ticketed) / count(*), 6) AS ticketed_pct, round(100 - 100.0 * count(*) FILTER (ticketed) / count(*), 6) AS untracked_pct FROM work", "work")
def report_ticketed_share(t):
    return reports.ticketed_share(t("work")).withColumns({c: F.round(c, 6) for c in ("ticketed_pct", "untracked_pct")})


@query("""WITH o AS (SELECT author, insertions, CAST(date_trunc('week', timestamp) AS DATE) AS monday FROM work), s AS (SELECT author, min(monday) AS a, max(monday) AS z FROM o GROUP BY author),
    p AS (SELECT author, a, z, CAST(unnest(generate_series(a, z, INTERVAL 28 DAY)) AS DATE) AS since FROM s), q AS (SELECT author, since, CAST(least(since + INTERVAL 21 DAY, z) + INTERVAL 6 DAY AS DATE) AS until, date_diff('day', a, since) // 28 AS i FROM p),
    c AS (SELECT author, date_diff('day', a, monday) // 28 AS i, count(*) AS n, CAST(sum(insertions) AS BIGINT) AS ins FROM o JOIN s USING (author) GROUP BY ALL)
    SELECT q.author, CASE WHEN strftime(since, '%G') = strftime(until, '%G') THEN concat(strftime(since, '%G-W%V'), strftime(until, '..W%V')) ELSE concat(strftime(since, '%G-W%V'), '..', strftime(until, '%G-W%V')) END AS label, since, until, coalesce(n, 0) AS commits, coalesce(ins, 0) AS insertions FROM q LEFT JOIN c ON c.author = q.author AND c.i = q.i""", "work")
def report_period_trends(t):
    return reports.period_trends(t("work"), 4)


@query("SELECT author, CAST(min(timestamp) AS DATE) AS first, CAST(max(timestamp) AS DATE) AS last FROM work WHERE timestamp >= TIMESTAMP '1996-01-01' AND timestamp <= TIMESTAMP '1999-06-30' GROUP BY author", "work")
def report_date_bounds(t):
    return reports.date_bounds(t("work"), F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1999-06-30").cast("timestamp_ntz"))


@query("""WITH f AS (SELECT author, isoyear(timestamp) * 100 + weekofyear(timestamp) AS w, repository, count(*) AS n, count(*) FILTER (revert) AS r, count(*) FILTER (bugfix) AS b, count(*) FILTER (ticketed) AS k FROM work GROUP BY ALL)
    SELECT author, round(coalesce(avg(CASE WHEN w BETWEEN 199610 AND 199720 THEN """ + QUALITY + """ END), 0), 6) AS quality FROM f GROUP BY author""", "work")
def report_mean_quality(t):
    return reports.mean_quality(delivery.weekly_quality(t("work")), (1996, 10), (1997, 20)).withColumn("quality", F.round("quality", 6))


@query("""WITH f AS (SELECT author, CAST(isoyear(timestamp) AS INT) AS iso_year, CAST(weekofyear(timestamp) AS INT) AS iso_week, repository, greatest(count(*) - count(*) FILTER (revert), 0) AS net, count(*) FILTER (mode = 'full_agentic') AS a, count(*) FILTER (mode = 'ide_assisted') AS i FROM work GROUP BY ALL)
    SELECT author, iso_year, iso_week, repository, net AS net_commits, a AS agentic_count, i AS ide_assisted_count, round(CASE WHEN net > 0 THEN 100.0 * a / net ELSE 0 END, 6) AS agentic_pct FROM f""", "work")
def report_weekly_engineer(t):
    return reports.weekly_engineer(t("work")).withColumn("agentic_pct", F.round("agentic_pct", 6))


@query("WITH f AS (SELECT author, repository, count(*) AS n FROM work GROUP BY ALL) SELECT author, repository, CASE WHEN author IN ('dev1', 'dev2') THEN -1 ELSE n END AS n FROM f", "work")
def report_facts_upsert(t):
    old = t("work").groupBy("author", "repository").agg(F.count("*").alias("n"))
    return reports.upsert(old, old.filter("author in ('dev1', 'dev2')").withColumn("n", F.lit(-1).cast("long")), ["author", "repository"])


SHAPES["effort"] = "SELECT CAST(l_orderkey AS STRING) AS sha, CASE WHEN sum(l_quantity) <= 20 THEN 'XS' WHEN sum(l_quantity) <= 60 THEN 'S' WHEN sum(l_quantity) <= 120 THEN 'M' WHEN sum(l_quantity) <= 180 THEN 'L' ELSE 'XL' END AS size FROM {lineitem} GROUP BY l_orderkey"


@query("SELECT author, size, count(*) AS commits, CASE size WHEN 'XS' THEN 1 WHEN 'S' THEN 2 WHEN 'M' THEN 3 WHEN 'L' THEN 4 ELSE 5 END AS place FROM work JOIN effort USING (sha) GROUP BY author, size", "work", "effort")
def report_effort_histogram(t):
    return reports.effort_histogram(t("work"), t("effort"))


@query("SELECT user_id, CAST(greatest(date_trunc('week', ts), TIMESTAMP '2024-01-03') AS DATE) AS first, CAST(least(date_trunc('week', ts) + INTERVAL 6 DAY, TIMESTAMP '2024-01-27') AS DATE) AS last, count(*) AS n FROM events GROUP BY ALL")
def report_clamped_weeks(t):
    monday = F.date_trunc("week", "ts").cast("date")
    a, b = reports.clamp_week(monday, F.date_add(monday, 6), F.lit("2024-01-03").cast("date"), F.lit("2024-01-27").cast("date"))
    return t("events").groupBy("user_id", a.alias("first"), b.alias("last")).agg(F.count("*").alias("n"))


SHAPES["incidents"] = "SELECT event_id AS incident_id, user_id % 7 AS repo, CASE WHEN event_type <> 'error' THEN value / 10.0 END AS mttr_hours FROM {events}"


@query("SELECT repo, count(*) AS n, round(avg(mttr_hours), 6) AS mean FROM incidents WHERE mttr_hours IS NOT NULL GROUP BY repo", "incidents")
def dora_recovery(t):
    return reports.recovery(t("incidents")).groupBy("repo").agg(F.count("*").alias("n"), F.round(F.avg("mttr_hours"), 6).alias("mean"))


@query("""WITH f AS (SELECT DISTINCT deploy_id AS bad FROM deployments WHERE quantity > 45), o AS (SELECT count(*) AS deploys, count(DISTINCT strftime(triggered_at, '%Y-W%W')) AS weeks FROM deployments WHERE environment = 'production' AND status = 'success' AND triggered_at >= TIMESTAMP '1997-01-01'),
    l AS (SELECT avg((epoch(triggered_at) - epoch(timestamp)) / 3600.0) AS lead FROM deployments JOIN commits ON sha = git_sha WHERE environment = 'production' AND status = 'success'),
    c AS (SELECT count(DISTINCT deploy_id) AS production, count(DISTINCT bad) AS failed FROM deployments LEFT JOIN f ON deploy_id = bad WHERE environment = 'production' AND triggered_at >= TIMESTAMP '1997-01-01'), m AS (SELECT avg(mttr_hours) AS mttr FROM incidents)
    SELECT deploys, weeks, round(deploys / weeks, 6) AS per_week, round(lead, 6) AS lead_hours, failed, round(failed / production, 9) AS failure_rate, round(mttr, 6) AS mttr_hours FROM o, l, c, m""", "deployments", "commits", "incidents")
def dora_summary(t):
    d = t("deployments")
    out = reports.dora_summary(d, t("commits"), d.filter("quantity > 45"), t("incidents"), F.lit("1997-01-01").cast("timestamp_ntz"))
    return out.withColumns({"per_week": F.round("per_week", 6), "lead_hours": F.round("lead_hours", 6), "failure_rate": F.round("failure_rate", 9), "mttr_hours": F.round("mttr_hours", 6)})


# -- ledgers and identities --------------------------------------------------------------------------------

SHAPES["runs"] = "SELECT concat('repo', CAST(o_custkey % 7 AS STRING)) AS repository, CAST(year(o_orderdate) AS INT) AS iso_year, CAST(o_orderkey % 52 AS INT) AS iso_week, count(*) AS repositories FROM {orders} WHERE o_orderstatus = 'F' GROUP BY ALL"


@query("WITH w AS (SELECT DISTINCT repository, CAST(isoyear(timestamp) AS INT) AS iso_year, CAST(weekofyear(timestamp) AS INT) AS iso_week FROM work) SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.repository = w.repository AND r.iso_year = w.iso_year AND r.iso_week = w.iso_week)", "work", "runs")
def collect_open_weeks(t):
    year, week = delivery.iso_week(F.col("timestamp"))
    return reports.open_weeks(t("work").select("repository", year, week).distinct(), t("runs"))


@query("SELECT iso_year, iso_week, max(repositories) AS repositories FROM runs GROUP BY ALL", "runs")
def collect_week_size(t):
    return reports.week_size(t("runs"))


@query("SELECT sha, repository, timestamp AS created_at FROM work WHERE repository = 'repo3'", "work")
def rules_overrides(t):
    return reports.listed_overrides(t("work").select("sha", "repository", F.col("timestamp").alias("created_at")), "repo3")


@query("SELECT w.sha, author, e.size FROM work w LEFT JOIN effort e ON e.sha = w.sha WHERE w.sha = '7'", "work", "effort")
def rules_explain(t):
    return reports.explain(t("work").select("sha", "author"), t("effort"), "7")


@query("SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS start_date FROM supplier WHERE s_nationkey = 3")
def work_iterations(t):
    rows = t("supplier").selectExpr("s_suppkey as id", "s_name as name", "case when s_suppkey % 3 = 0 then null else s_acctbal end as start_date", "cast(s_nationkey as string) as project")
    return reports.iterations(rows, "3").drop("project")


@query("SELECT DISTINCT l_orderkey AS sha, l_partkey AS item, CASE l_linestatus WHEN 'O' THEN 'jira' ELSE 'github' END AS source, p_name AS title FROM lineitem JOIN part ON p_partkey = l_partkey WHERE (CASE l_linestatus WHEN 'O' THEN 'jira' ELSE 'github' END) = (CASE WHEN p_size % 2 = 0 THEN 'jira' ELSE 'github' END)")
def work_items_of_commits(t):
    links = t("lineitem").selectExpr("l_orderkey as sha", "l_partkey as item", "case l_linestatus when 'O' then 'jira' else 'github' end as source")
    items = t("part").selectExpr("p_partkey as item", "case when p_size % 2 = 0 then 'jira' else 'github' end as source", "p_name as title")
    return reports.items_of_commits(links, items)


@query("SELECT c_custkey AS id, c_name AS email FROM customer WHERE lower(c_name) = lower('CUSTOMER#000000042') ORDER BY 1 LIMIT 1")
def identity_lookup(t):
    return reports.author_of(t("customer").selectExpr("c_custkey as id", "c_name as email"), F.lit("CUSTOMER#000000042"))


MERGED = "WITH m AS (SELECT DISTINCT author AS source, 'dev0' AS target FROM work WHERE author IN ('dev5', 'dev9'))"


@query(f"{MERGED} SELECT coalesce(target, author) AS author, count(*) AS commits FROM work LEFT JOIN m ON author = source GROUP BY 1", "work")
def identity_merge(t):
    w = t("work")
    authors = w.select("author").distinct().withColumn("aliases", F.array(F.concat("author", F.lit("@x"))))
    mapping = w.select(F.col("author").alias("source")).distinct().filter("source in ('dev5', 'dev9')").withColumn("target", F.lit("dev0"))
    return reports.merge_aliases(w, authors, mapping)[0].groupBy("author").agg(F.count("*").alias("commits"))


@query(f"{MERGED}, o AS (SELECT coalesce(target, author) AS author, CASE WHEN target IS NULL THEN [concat(author, '@x')] ELSE [concat(author, '@x'), author] END AS a FROM (SELECT DISTINCT author FROM work) LEFT JOIN m ON author = source) SELECT author, array_to_string(list_sort(list_distinct(flatten(list(a)))), ',') AS aliases FROM o GROUP BY author", "work")
def identity_merged_aliases(t):
    w = t("work")
    authors = w.select("author").distinct().withColumn("aliases", F.array(F.concat("author", F.lit("@x"))))
    mapping = w.select(F.col("author").alias("source")).distinct().filter("source in ('dev5', 'dev9')").withColumn("target", F.lit("dev0"))
    return reports.merge_aliases(w, authors, mapping)[1].withColumn("aliases", F.array_join("aliases", ","))


@query("WITH p AS (SELECT DISTINCT l_orderkey AS sha, concat('d', CAST(l_suppkey AS VARCHAR), '@x') AS email FROM lineitem), m AS (SELECT sha, min(email) AS target FROM p GROUP BY sha) SELECT DISTINCT email AS source, target FROM p JOIN m USING (sha) WHERE email <> target")
def identity_same_commit(t):
    return reports.same_commit_pairs(t("lineitem").selectExpr("l_orderkey as sha", "concat('d', cast(l_suppkey as string), '@x') as email"))


@query("SELECT l_suppkey AS source, l_partkey AS target, max(l_discount) AS confidence FROM lineitem GROUP BY 1, 2 HAVING max(l_discount) >= 0.05")
def identity_suggestions(t):
    return reports.best_suggestions(t("lineitem").selectExpr("l_suppkey as source", "l_partkey as target", "l_discount as confidence"), 0.05)


@query("WITH a AS (SELECT n_name AS name, concat(c_name, CASE WHEN c_custkey % 3 = 0 THEN '@co.com' ELSE '@x.org' END) AS email FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT name, coalesce(min(email) FILTER (email LIKE '%@co.com'), min(email)) AS email FROM a GROUP BY name")
def identity_preferred(t):
    a = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("name"), F.expr("concat(c_name, case when c_custkey % 3 = 0 then '@co.com' else '@x.org' end)").alias("email"))
    return reports.preferred_authors(a, "co.com")


@query("SELECT DISTINCT s_name AS author, concat('u', CAST(s_nationkey AS VARCHAR)) AS login FROM supplier")
def identity_logins(t):
    return reports.logins(t("supplier").select(F.col("s_name").alias("author"), F.expr("""concat('["github:u', cast(s_nationkey as string), '", "a@b"]')""").alias("aliases")))


@query("""WITH p AS (SELECT DISTINCT lower(replace(p_type, ' ', '-')) AS name FROM part), a AS (SELECT name, list_aggregate(list_transform(list_filter(string_split(name, '-'), lambda x: x <> ''), lambda x: x[1]), 'string_agg', '') AS alias FROM p)
    SELECT min(name) AS name, alias FROM a WHERE length(alias) >= 2 AND alias NOT IN (SELECT name FROM p) GROUP BY alias HAVING count(*) = 1""")
def identity_package_aliases(t):
    return reports.package_aliases(t("part").select(F.lower(F.expr("replace(p_type, ' ', '-')")).alias("name")).distinct())


@query("SELECT effort, count(*) AS n FROM findings GROUP BY effort ORDER BY n DESC, effort LIMIT 2", "findings")
def review_common_kinds(t):
    return reports.most_common(t("findings"), "effort", 2)


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def activity_newest(t):
    return reports.newest(t("events").select("event_id", "ts"), "ts", "event_id", 100)


@query("SELECT event_id AS id, ts AS at, event_type AS source FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 10")
def activity_log(t):
    e = t("events").selectExpr("event_id as id", "ts as at", "event_type as source")
    return reports.activity_log(e, F.lit("2024-01-05").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"), 10, 20, source="click")


# -- rules -------------------------------------------------------------------------------------------------

SHAPES["attributed"] = """SELECT o_orderkey AS sha, concat('change', chr(10), chr(10), CASE o_orderkey % 8 WHEN 0 THEN 'Co-Authored-By: Claude <c@x>' WHEN 1 THEN 'co-authored-by: GitHub Copilot <c@x>' WHEN 2 THEN 'Co-authored-by: Ann Cursor-Smith <a@x>'
    WHEN 3 THEN 'Co-authored-by: Cursor <x@cursor.sh>' WHEN 4 THEN 'X-AI-Model: m1' WHEN 5 THEN concat('Co-authored-by: Bo <b@x>', chr(10), 'Co-authored-by: copilot') ELSE 'signed' END) AS message FROM {orders}"""
TOOL_SQL = r"""list_filter(list_transform(regexp_extract_all(message, '(?im)^co-authored-by:\s*(.+)$', 1), lambda v: CASE WHEN regexp_matches(v, '(?i)\bclaude\b') THEN 'claude' WHEN regexp_matches(v, '(?i)\bcopilot\b') THEN 'copilot'
    WHEN regexp_extract(v, '(?i)(@cursor\.sh|\bcursor\b-?)', 1) LIKE '%@%' OR (regexp_extract(v, '(?i)(@cursor\.sh|\bcursor\b-?)', 1) <> '' AND regexp_extract(v, '(?i)(@cursor\.sh|\bcursor\b-?)', 1) NOT LIKE '%-') THEN 'cursor' END), lambda x: x IS NOT NULL)"""


@query(f"""WITH a AS (SELECT sha, message, {TOOL_SQL} AS t FROM attributed) SELECT sha, t[1] AS tool, CASE WHEN list_contains(t, 'claude') OR regexp_matches(message, '(?im)^X-AI-Model:\\s*\\S') THEN 'full_agentic' WHEN len(t) > 0 THEN 'ide_assisted' ELSE 'none' END AS mode FROM a""", "attributed")
def git_attribution(t):
    m = F.col("message")
    return t("attributed").select("sha", rules.ai_tool(m).alias("tool"), rules.agentic_mode(m).alias("mode"))


def case_of(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


TAXONOMY_SQL = " ".join(f"WHEN {{c}} IN ({sql_list(names.split())}) THEN '{top}'" for top, names in rules.TAXONOMY.items())


@query(f"SELECT category, CASE {TAXONOMY_SQL.format(c='category')} END AS top, count(*) AS n FROM work GROUP BY ALL", "work")
def git_taxonomy(t):
    return t("work").groupBy("category", rules.top_level(F.col("category")).alias("top")).agg(F.count("*").alias("n"))


@query(f"""WITH i AS (SELECT o_orderkey AS sha, CASE o_orderkey % 5 WHEN 0 THEN ' Bug ' WHEN 1 THEN 'Story' WHEN 2 THEN 'Tech Debt' WHEN 3 THEN '' ELSE 'other' END AS kind, CASE WHEN o_orderkey % 4 = 0 THEN concat('INFRA-', o_orderkey, ' x') ELSE concat('see WEB-', o_orderkey) END AS message FROM orders), r AS (SELECT sha, {case_of("lower(trim(kind))", rules.ISSUE_TYPES)} AS a, CASE WHEN message LIKE 'INFRA%' THEN 'platform' END AS b FROM i)
    SELECT sha, coalesce(a, b, 'uncategorized') AS category, CASE WHEN a IS NOT NULL THEN 0.90 WHEN b IS NOT NULL THEN 0.88 ELSE 0.0 END::DOUBLE AS confidence, CASE WHEN coalesce(a, b) IS NOT NULL THEN 'external' ELSE 'none' END AS method FROM r""")
def git_ticket_tiers(t):
    from .operators import classify

    i = t("orders").selectExpr("o_orderkey as sha", "case o_orderkey % 5 when 0 then ' Bug ' when 1 then 'Story' when 2 then 'Tech Debt' when 3 then '' else 'other' end as kind", "case when o_orderkey % 4 = 0 then concat('INFRA-', o_orderkey, ' x') else concat('see WEB-', o_orderkey) end as message")
    return classify.cascade(i, [rules.issue_type_tier(F.col("kind")), rules.project_tier(F.col("message"), {"infra": "platform"})]).drop("kind", "message")


SHAPES["notes"] = """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'Tool use: grep' WHEN 1 THEN 'Running cargo test...' WHEN 2 THEN '/src/a/b.rs' WHEN 3 THEN 'fix(core): null check here' WHEN 4 THEN '0123456789abcdef0123456789abcdef01234567' WHEN 5 THEN 'two words' WHEN 6 THEN '()[]<>;;== 1 2 3 a b' ELSE text END AS content FROM {documents}"""
NOISE_SQL = " OR ".join(f"regexp_matches(trim(content), '{p}')" for p in rules.NOISE)


@query(f"""SELECT doc_id, CASE WHEN {NOISE_SQL} THEN 'noise_pattern' WHEN len(regexp_extract_all(content, '\\S*[\\p{{L}}\\p{{N}}]\\S*')) < 3 THEN 'too_short' WHEN length(regexp_replace(content, '\\s', '', 'g')) > 0 AND length(regexp_replace(regexp_replace(content, '\\s', '', 'g'), '\\p{{L}}', '', 'g')) / length(regexp_replace(content, '\\s', '', 'g')) > 0.8 THEN 'non_alphabetic' END AS reason,
    CASE WHEN regexp_matches(trim(content), '{rules.NOISE[2]}') OR regexp_matches(trim(content), '{rules.NOISE[3]}') THEN 'commit' WHEN starts_with(lower(trim(content)), 'tool use:') OR starts_with(lower(trim(content)), 'tool result:') OR (starts_with(lower(trim(content)), 'running ') AND ends_with(lower(trim(content)), '...')) THEN 'session_event' ELSE 'note' END AS kind FROM notes""", "notes")
def memory_ingest_rules(t):
    c = F.col("content")
    return t("notes").select("doc_id", rules.reject_reason(c).alias("reason"), rules.drawer_type(c, "note").alias("kind"))


@query(f"SELECT lang, coalesce({case_of('lower(lang)', {k: v for k, v in rules.ROOMS.items() if k})}, lower(lang)) AS room, count(*) AS n FROM (SELECT CASE doc_id % 5 WHEN 0 THEN 'Docs' WHEN 1 THEN 'TEST' WHEN 2 THEN 'meeting' WHEN 3 THEN 'Lab' ELSE lang END AS lang FROM documents) GROUP BY ALL")
def memory_room_names(t):
    d = t("documents").selectExpr("case doc_id % 5 when 0 then 'Docs' when 1 then 'TEST' when 2 then 'meeting' when 3 then 'Lab' else lang end as lang")
    return d.groupBy("lang", rules.parse_room(F.col("lang")).alias("room")).agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT doc_id, CAST({DECISION_SQL} + 1 AS BIGINT) AS c FROM documents), g AS (SELECT doc_id, c, CASE WHEN c <= 5 THEN 0 WHEN c <= 10 THEN 1 WHEN c <= 15 THEN 2 WHEN c <= 20 THEN 3 ELSE 4 END + CASE WHEN doc_id % 2 = 0 AND c > 5 THEN 1 ELSE 0 END AS s FROM c)
    SELECT doc_id, ['low', 'medium', 'high', 'critical'][least(s, 4)] AS severity, CASE WHEN doc_id % 2 = 0 THEN 'reduce_nesting' WHEN c >= 10 THEN 'extract_method' ELSE 'review_for_clarity' END AS type, CASE WHEN doc_id % 2 <> 0 AND c >= 10 THEN c // 2 END AS after FROM g WHERE s > 0""")
def code_refactoring(t):
    c = code.cyclomatic(F.col("text"))
    found = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("missing_docstring"), F.lit("deep_nesting"), F.lit("too_many_params"))).otherwise(F.array(F.lit("missing_docstring")))
    d = t("documents").select("doc_id", c.alias("c")).select("doc_id", rules.refactoring(F.col("c"), code.grade(F.col("c")), found).alias("r"))
    return d.filter("r is not null").select("doc_id", "r.*")


@query("SELECT user_id, CASE substr(g, 1, 1) WHEN 'A' THEN 'APPROVE' WHEN 'B' THEN 'APPROVE' WHEN 'C' THEN 'APPROVE*' WHEN 'D' THEN 'REQUEST_CHANGES' ELSE 'BLOCK' END AS verdict, count(*) AS n FROM (SELECT user_id, ['A+', 'B-', 'C', 'D+', 'F'][event_id % 5 + 1] AS g FROM events) GROUP BY ALL")
def review_grade_verdicts(t):
    g = F.element_at(F.array(*map(F.lit, ("A+", "B-", "C", "D+", "F"))), (F.col("event_id") % 5 + 1).cast("int"))
    return t("events").groupBy("user_id", rules.verdict_of_grade(g).alias("verdict")).agg(F.count("*").alias("n"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END < 80, false) OR coalesce(CASE WHEN event_id % 4 = 0 THEN NULL ELSE value + event_id % 5 END - value > 2, false) AS gated FROM events")
def review_coverage_gate(t):
    new = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    base = F.when(F.col("event_id") % 4 != 0, F.col("value") + F.col("event_id") % 5)
    return t("events").select("event_id", rules.coverage_gate(F.col("value"), new, base).alias("gated"))


# -- graph -------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT DISTINCT src, dst, kind FROM edges WHERE kind IN ('Calls', 'Writes')), b AS (SELECT src AS via, dst AS id, kind FROM e UNION SELECT dst, src, kind FROM e),
    h1 AS (SELECT id, min((via, kind)) AS x FROM b WHERE via = 5 AND id <> 5 GROUP BY id), h2 AS (SELECT b.id, min((b.via, b.kind)) AS x FROM b JOIN h1 ON b.via = h1.id WHERE b.id <> 5 AND b.id NOT IN (SELECT id FROM h1) GROUP BY b.id)
    SELECT id, 1 AS hop, x[1] AS via, x[2] AS kind FROM h1 UNION ALL SELECT id, 2, x[1], x[2] FROM h2""", "edges")
def graph_neighbours(t):
    e = t("edges")
    return graph.neighbours(e, e.sparkSession.createDataFrame([(5,)], "id long"), 2, ("Calls", "Writes"), True, True)


SHAPES["defs"] = """SELECT p_partkey AS id, concat('f', CAST(p_size AS STRING)) AS file, CASE WHEN p_partkey % 3 = 0 THEN concat('mod', CAST(p_partkey % 50 AS STRING), '::fn', CAST(p_partkey % 200 AS STRING)) ELSE concat('fn', CAST(p_partkey % 400 AS STRING)) END AS name,
    CASE p_partkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'test' ELSE 'function' END AS chunk_type, concat('fn', CAST((p_partkey * 7) % 450 AS STRING)) AS called, concat('fn', CAST((p_partkey * 3) % 450 AS STRING)) AS base FROM {part}"""


@query("""WITH n AS (SELECT DISTINCT name AS symbol FROM defs), s AS (SELECT string_split(symbol, '::')[-1] AS suffix, min(symbol) AS near FROM n GROUP BY 1),
    c AS (SELECT DISTINCT name, chunk_type, coalesce(n.symbol, near) AS dst FROM defs LEFT JOIN n ON n.symbol = called LEFT JOIN s ON suffix = called WHERE coalesce(n.symbol, near) IS NOT NULL), i AS (SELECT DISTINCT name, coalesce(n.symbol, near) AS dst FROM defs LEFT JOIN n ON n.symbol = base LEFT JOIN s ON suffix = base WHERE coalesce(n.symbol, near) IS NOT NULL),
    f AS (SELECT DISTINCT file, name FROM defs), t AS (SELECT DISTINCT name, dst FROM c WHERE chunk_type = 'test' AND name <> dst)
    SELECT DISTINCT name AS src, dst, 'CallsFunction' AS kind FROM c WHERE name <> dst UNION ALL SELECT name, dst, 'Implements' FROM i WHERE name <> dst
    UNION ALL SELECT DISTINCT d.name, f.name, 'ModuleContains' FROM defs d JOIN f ON f.file = d.file WHERE d.chunk_type = 'class' AND d.name <> f.name UNION ALL SELECT dst, name, 'TestedBy' FROM t
    UNION ALL SELECT DISTINCT a.name, b.name, 'CoOccursInTest' FROM t a JOIN t b ON a.dst = b.dst WHERE a.name <> b.name""", "defs")
def graph_symbols(t):
    return graph.symbol_graph(t("defs").withColumns({"calls": F.array("called"), "inherits": F.array("base")}))


@query("WITH g AS (SELECT symbol, count(*) AS k FROM (SELECT name AS symbol FROM defs UNION ALL SELECT called FROM defs) GROUP BY 1) SELECT symbol FROM g WHERE symbol IN (SELECT name FROM defs) AND contains(lower(symbol), 'mod4') ORDER BY k DESC, symbol LIMIT 1", "defs")
def graph_entry_point(t):
    d = t("defs")
    nodes = d.select(F.col("name").alias("symbol")).distinct()
    return graph.entry_point(nodes, d.select(F.col("name").alias("src"), F.col("called").alias("dst")), "MOD4")


@query("SELECT src, dst, kind FROM edges WHERE src % 2 = 0 AND dst % 2 = 0 AND kind = 'Calls'", "edges")
def graph_export(t):
    e = t("edges").withColumn("weight", F.lit(1.0))
    nodes = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("node_kind", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    return graph.export(nodes, e, ("even",), ("Calls",), 0.5)[1].drop("weight")


@query("WITH e AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst), c AS (SELECT DISTINCT x AS id, x % 40 AS c FROM (SELECT a AS x FROM e UNION ALL SELECT b FROM e)), j AS (SELECT x.c AS p, y.c AS q FROM e JOIN c x ON x.id = a JOIN c y ON y.id = b), k AS (SELECT c, count(*) AS n FROM c GROUP BY c), i AS (SELECT p AS c, count(*) AS n FROM j WHERE p = q GROUP BY p), o AS (SELECT c, count(*) AS n FROM (SELECT p AS c FROM j WHERE p <> q UNION ALL SELECT q FROM j WHERE p <> q) GROUP BY c) SELECT k.c AS community, k.n AS members, round(CASE WHEN k.n >= 2 THEN coalesce(i.n, 0) / (k.n * (k.n - 1) / 2) ELSE 0 END, 6) AS density, coalesce(o.n, 0) AS bridges FROM k LEFT JOIN i USING (c) LEFT JOIN o USING (c) WHERE CASE WHEN k.n >= 2 THEN coalesce(i.n, 0) / (k.n * (k.n - 1) / 2) ELSE 0 END < 0.2 AND coalesce(o.n, 0) <= k.n", "edges")
def graph_knowledge_gaps(t):
    e = t("edges").filter("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    c = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().withColumn("community", F.col("id") % 40)
    return graph.knowledge_gaps(e, c).withColumn("density", F.round("density", 6))


# -- search and stores -------------------------------------------------------------------------------------

HITS = "SELECT doc_id AS key, n_chars / 100.0 AS score, concat(CASE doc_id % 11 WHEN 0 THEN 'docs/guide.md' WHEN 1 THEN 'src/lib.rs' WHEN 2 THEN 'data/x.json' WHEN 3 THEN 'src/x.zig' WHEN 4 THEN 'x.bin' WHEN 5 THEN 'License' WHEN 6 THEN 'db/up.sql' WHEN 7 THEN 'b.adoc' WHEN 8 THEN 'conf.toml' ELSE 'lib/a.PY' END) AS file, CASE doc_id % 5 WHEN 0 THEN 'struct' WHEN 1 THEN 'function' WHEN 2 THEN 'interface' WHEN 3 THEN 'type_alias' ELSE 'docstring' END AS chunk_type, concat('Code', CAST(doc_id % 10 AS STRING), CASE WHEN doc_id % 7 = 0 THEN 'Walker' ELSE 'Indexer' END) AS name, text AS content, doc_id AS age_days FROM {documents}"
SHAPES["hits"] = HITS


@query("""SELECT key, file, round(score * CASE WHEN file LIKE '%.md' THEN 0.1 * 0.5 WHEN file IN ('data/x.json', 'conf.toml') THEN 0.2 * 0.5 WHEN file IN ('License', 'b.adoc') THEN 0.1 WHEN file = 'db/up.sql' THEN 0.2 ELSE 1.0 END * CASE WHEN chunk_type IN ('struct', 'function', 'type_alias') AND name LIKE '%Indexer' THEN 2.0 ELSE 1.0 END * CASE WHEN file = 'src/lib.rs' THEN 3.0 ELSE 1.0 END, 6) AS score FROM hits""", "hits")
def search_adjust(t):
    h = t("hits")
    branch = h.sparkSession.createDataFrame([("src/lib.rs",)], "file string")
    return search.adjust(h, "struct Indexer", "code", branch, 9.0).withColumn("score", F.round("score", 6))


@query("SELECT key, file, round(score * CASE WHEN age_days > 365 THEN 0.7 ELSE 1.0 END, 6) AS score FROM hits WHERE chunk_type <> 'docstring' AND file IN ('src/lib.rs', 'src/x.zig', 'db/up.sql', 'lib/a.PY')", "hits")
def search_post_filter(t):
    return search.post_filter(t("hits").withColumn("content", F.lit("x")), "code", True).select("key", "file", F.round("score", 6).alias("score"))


@query(f"WITH {BM25_SQL}, l AS (SELECT doc_id, score FROM bm ORDER BY bm.score DESC, doc_id LIMIT 40), n AS (SELECT min(doc_id) AS doc_id FROM documents WHERE lower(source) = lower((SELECT min(source) FROM documents))) SELECT doc_id, 1.05::DOUBLE AS score, 1 AS rank FROM n UNION ALL SELECT doc_id, round(score, 6), CAST(1 + row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) FROM l WHERE doc_id NOT IN (SELECT doc_id FROM n)")
def search_entity_first(t):
    d = t("documents")
    word = d.agg(F.min("source")).first()[0]
    out = search.entity_first(lexical_lane(t).withColumnRenamed("doc_id", "key"), d.select(F.col("doc_id").alias("key"), F.col("source").alias("name")), word.upper())
    return out.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"), "rank")


@query("SELECT doc_id AS key, 0.001::DOUBLE AS score FROM documents WHERE contains(text, 'thing ') ORDER BY doc_id LIMIT 40")
def search_literal(t):
    return search.literal(t("documents"), "doc_id", "text", "thing ", 40)


#: A text's lines; none after a last line feed.
LINES_SQL = "SELECT doc_id, CASE WHEN text = '' THEN [] WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS a FROM documents"


def grepped(t):
    return t("documents").select(F.concat(F.lit("d/"), "doc_id", F.lit(".md")).alias("path"), F.col("text").alias("content"))


@query(rf"WITH f AS ({LINES_SQL}), l AS (SELECT doc_id, unnest(a) AS text, unnest(range(1, len(a) + 1)) AS line FROM f) SELECT concat('d/', doc_id, '.md') AS path, line, text FROM l WHERE regexp_matches(text, '(?i)\b(?:the|license)\b')")
def search_grep(t):
    return grep.grep(grepped(t), grep.Request("the|license", word=True, ignore_case=True, glob="d/*.md")).select("path", "line", "text")


@query(f"WITH f AS ({LINES_SQL}), l AS (SELECT doc_id, unnest(a) AS text FROM f) SELECT doc_id, count(*) AS n FROM l WHERE NOT contains(text, 'a.b') AND NOT contains(text, 'e') GROUP BY doc_id")
def search_grep_inverted(t):
    f = t("documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    found = grep.grep(f, grep.Request(r"a\.b|e", invert=True))
    return found.groupBy(F.col("path").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))


@query(f"""WITH f AS ({LINES_SQL}), l AS (SELECT doc_id, a, unnest(a) AS text, unnest(range(1, len(a) + 1)) AS line FROM f)
    SELECT concat('d/', doc_id, '.md') AS path, line, CAST(strpos(lower(text), 'licen') AS BIGINT) AS "column", text, array_to_string(a[greatest(line - 1, 1):line - 1], '|') AS before, array_to_string(a[line + 1:line + 2], '|') AS after FROM l WHERE contains(lower(text), 'licen')""")
def search_grep_context(t):
    """Pruned by the trigrams of the kept index."""
    found = grep.grep(grepped(t), grep.Request("licen", ignore_case=True, before=1, after=2), kept(t, "documents", "trigrams", lambda: grep.trigram_index(grepped(t))))
    return found.withColumn("before", F.array_join("before", "|")).withColumn("after", F.array_join("after", "|"))


@query("SELECT concat('d/', doc_id, '.md') AS path FROM documents WHERE regexp_matches(text, 'icen[cs]ed?\\s+\\w')")
def search_grep_files(t):
    pruned = kept(t, "documents", "trigrams", lambda: grep.trigram_index(grepped(t)))
    return grep.grep(grepped(t), grep.Request(r"icen[cs]ed?\s+\w", files_with_matches=True), pruned).select("path")


@query("""WITH m AS (SELECT doc_id, string_split(text, 'n.' || chr(10)) AS p FROM documents WHERE contains(text, 'n.' || chr(10))), k AS (SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM m),
    h AS (SELECT doc_id, array_to_string(p[1:i], 'n.' || chr(10)) AS head FROM k) SELECT concat('d/', doc_id, '.md') AS path, CAST(1 + length(head) - length(replace(head, chr(10), '')) AS BIGINT) AS line, CAST(1 + length(string_split(head, chr(10))[-1]) AS BIGINT) AS "column" FROM h""")
def search_grep_multiline(t):
    return grep.grep(grepped(t), grep.Request("n\\.\n", multiline=True)).select("path", "line", "column")


@query("WITH e AS (SELECT vec_id, COLUMNS('^(embedding|vec|vector)$') AS vec FROM embeddings), a AS (SELECT vec AS q FROM e WHERE vec_id = 3) SELECT vec_id, round(" + COS_SQL + ", 5) AS score FROM e, a WHERE vec_id <> 3 ORDER BY " + COS_SQL + " DESC, vec_id LIMIT 10")
def search_similar(t):
    return retrieval.similar_to(vectors(t), "vec_id", "vec", 3, 10).withColumn("score", F.round("score", 5))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN least(greatest(value / 50 * 1.5, 1), 4) ELSE value / 50 END AS weight FROM events")
def search_child_weight(t):
    return t("events").select("event_id", retrieval.child_weight(F.col("value") / 50, F.col("event_id") % 2 == 0).alias("weight"))


@query("WITH e AS (SELECT vec_id, COLUMNS('^(embedding|vec|vector)$') AS vec FROM embeddings), a AS (SELECT vec AS q FROM e WHERE vec_id = 0) SELECT vec_id AS id, round(1.0 / (1 + vec_id), 6) AS score FROM e, a WHERE " + COS_SQL + " >= 0.2")
def search_refined_expansion(t):
    v = vectors(t).select(F.col("vec_id").alias("id"), "vec")
    return graph.refine(v.select("id", (1.0 / (1 + F.col("id"))).alias("score")), v, first_vector(t), 0.2).withColumn("score", F.round("score", 6))


@query("SELECT doc_id, md5(concat_ws(' ', text, concat(lang, ' ', source))) AS digest FROM documents")
def search_indexed_text(t):
    return t("documents").select("doc_id", F.md5(retrieval.indexed_text(F.col("text"), F.array("lang", "source")).cast("binary")).alias("digest"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (3, 14, 15, 92, -1)")
def store_lookup(t):
    return stores.lookup(t("documents").select("doc_id", "source"), "doc_id", [3, 14, 15, 92, -1])


@query("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL")
def store_files(t):
    return stores.files(t("documents"), "source")


SHAPES["placed"] = "SELECT l_orderkey * 8 + l_linenumber AS id, concat('src/f', CAST(l_orderkey % 97 AS STRING), '.rs') AS file, concat('fn', CAST(l_partkey % 40 AS STRING)) AS name, l_suppkey AS start_line, l_suppkey + CAST(l_quantity AS BIGINT) AS end_line FROM {lineitem}"


@query("SELECT store, CAST(sum(removed) AS BIGINT) AS removed, CAST(sum(kept) AS BIGINT) AS kept FROM (SELECT 'chunks' AS store, CAST(file = 'src/f7.rs' AS INT) AS removed, CAST(file <> 'src/f7.rs' AS INT) AS kept FROM placed UNION ALL SELECT 'entities', CAST(file = 'src/f7.rs' AS INT), CAST(file <> 'src/f7.rs' AS INT) FROM (SELECT DISTINCT file, name FROM placed)) GROUP BY store", "placed")
def store_remove_file(t):
    chunks = t("placed")
    kept, gone = stores.without_file({"chunks": chunks, "entities": chunks.select("file", "name").distinct()}, "src/f7.rs")
    left = kept["chunks"].select(F.lit("chunks").alias("store")).unionByName(kept["entities"].select(F.lit("entities").alias("store")))
    return gone.join(left.groupBy("store").agg(F.count("*").alias("kept")), "store")


@query("SELECT 'any' AS asked, * FROM (SELECT id, start_line FROM placed WHERE file LIKE '%f7.rs' ORDER BY start_line, end_line, id LIMIT 1) UNION ALL SELECT 'named', * FROM (SELECT id, start_line FROM placed WHERE file LIKE '%f7.rs' AND name = 'fn3' ORDER BY start_line, end_line, id LIMIT 1)", "placed")
def store_seed(t):
    one = lambda asked, *name: stores.seed(t("placed"), "f7.rs", *name).select(F.lit(asked).alias("asked"), "id", "start_line")
    return one("any").unionByName(one("named", "fn3"))


@query("SELECT id, name, chunk_type FROM defs WHERE chunk_type = 'class' AND file = 'f10' ORDER BY chunk_type, name", "defs")
def store_entities(t):
    return stores.entities(t("defs"), "chunk_type", "name", ("class",), "f10").select("id", "name", "chunk_type")


@query("WITH r AS (SELECT CASE WHEN value >= 20 THEN user_id END AS d FROM events) SELECT d AS drawer_id, count(*) AS hits FROM r WHERE d IS NOT NULL GROUP BY d ORDER BY hits DESC, d LIMIT 10")
def memory_top_drawers(t):
    return memory.top_drawers(t("events").select(F.when(F.col("value") >= 20, F.col("user_id")).alias("drawer_id")))


@query("SELECT event_id % 97 AS query_hash, count(*) AS misses FROM events WHERE value < 20 GROUP BY 1 ORDER BY misses DESC, query_hash LIMIT 10")
def memory_top_misses(t):
    e = t("events").select((F.col("event_id") % 97).alias("query_hash"), F.when(F.col("value") >= 20, F.col("user_id")).alias("drawer_id"))
    return memory.top_misses(e)


@query("SELECT subject, predicate, object, valid_from FROM triples WHERE predicate = 'click' AND object = '3'", "triples")
def memory_match_facts(t):
    return memory.match_facts(t("triples"), predicate="click", object="3").select("subject", "predicate", "object", "valid_from")


@query("WITH v AS (SELECT *, lead(valid_from) OVER (PARTITION BY subject, predicate ORDER BY valid_from, object) AS valid_to FROM triples) SELECT DISTINCT predicate, object AS other, 'out' AS direction FROM v WHERE valid_to IS NULL AND subject = 'u7' UNION SELECT DISTINCT predicate, subject, 'in' FROM v WHERE valid_to IS NULL AND object = 'u7'", "triples")
def memory_neighbours(t):
    return memory.neighbours_of(memory.validity(t("triples")), "u7")


@query("WITH v AS (SELECT *, lead(valid_from) OVER (PARTITION BY subject, predicate ORDER BY valid_from, object) AS valid_to FROM triples) SELECT subject, predicate, valid_from, CASE WHEN subject = 'u7' AND predicate = 'view' THEN coalesce(valid_to, 99999999) ELSE valid_to END AS valid_to FROM v", "triples")
def memory_retract(t):
    return memory.retract(memory.validity(t("triples")), "u7", "view", F.lit(99999999).cast("long")).select("subject", "predicate", "valid_from", "valid_to")


@query("SELECT room AS palace, id, importance AS score FROM drawers ORDER BY importance DESC, room, id LIMIT 12", "drawers")
def memory_recall_across(t):
    return memory.recall_across(t("drawers").select(F.col("room").alias("palace"), "id", F.col("importance").alias("score")), 12)


@query("SELECT id, CASE WHEN kind = 'click' THEN created_at + INTERVAL 7 DAY END AS expires_at FROM drawers", "drawers")
def memory_expiry(t):
    return memory.with_expiry(t("drawers").withColumn("kind", F.when(F.col("kind") == "click", "session_event").otherwise(F.col("kind")))).select("id", "expires_at")


@query("SELECT conv_id, substr(sha256(string_agg(text, chr(10) ORDER BY turn, text)), 1, 32) AS cache_key FROM conversations GROUP BY conv_id")
def memory_batch_keys(t):
    return memory.batch_key(t("conversations"), "conv_id", "turn", "text")


@query("SELECT CASE WHEN id % 10 IN (1, 2) THEN id - id % 10 ELSE id END AS id, max(importance) AS importance, array_to_string(list_sort(list_distinct(list(kind))), ',') AS tags FROM drawers GROUP BY 1", "drawers")
def memory_consolidation(t):
    d = t("drawers").select("id", "importance", F.array("kind").alias("tags"))
    actions = d.filter("id % 10 in (1, 2)").select((F.col("id") - F.col("id") % 10).alias("kept"), F.col("id").alias("superseded"))
    return memory.consolidate(d, actions).withColumn("tags", F.array_join("tags", ","))


@query("SELECT concat(CAST(l_suppkey AS VARCHAR), '@v', CAST(l_linenumber AS VARCHAR)) AS deploy_id, CAST(l_suppkey AS VARCHAR) AS repo, min(l_shipdate) AS triggered_at FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL")
def source_tag_deployments(t):
    tags = t("lineitem").selectExpr("cast(l_suppkey as string) as repo", "concat('v', cast(l_linenumber as string)) as tag", "cast(l_orderkey as string) as sha", "l_shipdate as at")
    return delivery_sources.deployments_of_tags(tags, "^v[1-3]$").select("deploy_id", "repo", "triggered_at")


@query("SELECT event_id AS incident_id, CASE WHEN event_id % 3 <> 0 THEN round((epoch(ts + INTERVAL 5 HOUR) - epoch(ts)) / 3600.0, 6) END AS mttr_hours, 'P1' AS severity FROM events WHERE event_type IN ('error', 'click')")
def source_item_incidents(t):
    e = t("events").filter("event_type in ('error', 'click')").select(
        F.col("event_id").alias("id"), F.lit("jira").alias("source"), F.lit("SRE").alias("project"), F.when(F.col("event_type") == "error", "Bug").otherwise("Incident").alias("item_type"),
        F.to_json(F.struct(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created"), F.when(F.col("event_id") % 3 != 0, F.date_format(F.col("ts") + F.expr("interval 5 hours"), "yyyy-MM-dd'T'HH:mm:ss")).alias("resolutiondate"), F.struct(F.lit("P1").alias("name")).alias("priority")).alias("fields"))).alias("raw_json"),
    )
    return delivery_sources.incidents_of_items(e).select("incident_id", F.round("mttr_hours", 6).alias("mttr_hours"), "severity")


@query()
def concept_embeddings(t):
    return retrieval.bag_of_words(t("documents"), "doc_id", "text", 64).select("doc_id", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 3).alias("norm"))


#: Phrases with their intents, which every turn of a conversation stands for in turn.
PHRASES = {
    "what is BM25": "conceptual", "FIXME authentication": "bug_debt", "abc": "unknown", "callers of the user class": "definition", "where is CodeIndexer used": "usage", "structs that derives from Default": "definition",
    "functions that raises ConfigError": "bug_debt", "authenticate tested by login_test": "usage", "error handling in payment flow": "bug_debt", "axum middleware concurrency limiter": "conceptual", "is_default_doc_excluded": "definition", "reservation booking flow": "unknown",
}


@query("WITH i AS (SELECT CASE turn % 12 " + " ".join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(PHRASES)) + " END AS q FROM conversations) SELECT q, CASE q " + " ".join(f"WHEN '{q}' THEN '{n}'" for q, n in PHRASES.items()) + " END AS intent, count(*) AS n FROM i GROUP BY ALL")
def search_intents(t):
    listed = F.array(*map(F.lit, PHRASES))
    c = t("conversations").select(F.get(listed, (F.col("turn") % 12).cast("int")).alias("q"))
    return c.groupBy("q", text.intent_of(F.col("q")).alias("intent")).agg(F.count("*").alias("n"))


@query(f"WITH {DOC_TOKENS_SQL} SELECT u AS term, count(*) AS df FROM (SELECT unnest(terms) AS u FROM tok) GROUP BY u HAVING count(*) >= 3")
def search_frequent_terms(t):
    return index.top_terms(indexed(t, "code"), 3)


# -- clusters, diffs and projects --------------------------------------------------------------------------


@query()
def concept_clusters(t):
    return cluster.kmeans(checkpointed(t("embeddings")), "vec_id", "embedding", 8)[0].withColumn("distance", F.round("distance", 4))


SHAPES["documented"] = """SELECT doc_id // 8 AS file, doc_id AS id, concat(CASE WHEN doc_id % 3 <> 0 THEN '/// ' ELSE '// ' END, replace(text, ' a', concat(chr(10), '  ///')), chr(10), 'fn f()') AS content FROM {documents}""".replace("doc_id // 8", "CAST(floor(doc_id / 8) AS BIGINT)")


@query()
def concept_files(t):
    return cluster.file_concepts(t("documented"))


@query("""WITH l AS (SELECT id, list_transform(string_split_regex(content, '\\r?\\n'), lambda x: ltrim(x, ' ')) AS x FROM documented), j AS (SELECT id, array_to_string(list_transform(list_filter(x, lambda y: starts_with(y, '///')), lambda y: trim(substr(y, 4), ' ')), ' ') AS doc FROM l)
    SELECT id, CASE WHEN trim(doc, ' ') <> '' THEN doc END AS doc FROM j""", "documented")
def code_doc_comments(t):
    return t("documented").select("id", cluster.doc_comment(F.col("content")).alias("doc"))


SHAPES["changes"] = """SELECT doc_id, concat('--- a/Head.rs', chr(10), '+pub fn ', lang, '_run(x: ', source, 'Kind)', chr(10), '-', replace(replace(text, ' a', concat(chr(10), '+class A')), ' de', concat(chr(10), ' fn x', chr(10), '-const De'))) AS diff FROM {documents}"""
BEFORE_SQL = ", ".join(f"regexp_extract(y, '^.*?{word}([\\p{{L}}\\p{{N}}_]*)', 1)" for word in diffs.BEFORE)


@query(f"""WITH l AS (SELECT doc_id, list_transform(list_filter(string_split_regex(diff, '\\r?\\n'), lambda x: regexp_matches(x, '^[+-]') AND NOT regexp_matches(x, '^(\\+\\+\\+|---)')), lambda x: trim(substr(x, 2), ' ')) AS x FROM changes),
    n AS (SELECT doc_id, flatten(list_transform(x, lambda y: list_concat(list_filter([{BEFORE_SQL}], lambda z: strlen(z) >= 2 AND regexp_matches(z, '^[\\p{{L}}_]') AND z NOT IN ({sql_list(diffs.RESERVED)})),
        list_filter(string_split_regex(y, '[^\\p{{L}}\\p{{N}}_]'), lambda z: strlen(z) >= 3 AND regexp_matches(z, '^\\p{{Lu}}') AND regexp_matches(z, '\\p{{Ll}}'))))) AS names FROM l)
    SELECT doc_id, array_to_string(list_sort(list_distinct(names)), ',') AS names FROM n""", "changes")
def review_changed_names(t):
    return t("changes").select("doc_id", F.array_join(F.sort_array(diffs.changed_names(F.col("diff"), 1 << 30)), ",").alias("names"))


@query()
def review_units(t):
    """Documents as files of reviews by source and language, their lines of three sentences as hunks."""
    d = t("documents").select(F.concat_ws("/", "source", "lang").alias("review"), F.col("doc_id").alias("file_no"), F.expr("concat('src/', doc_id, '.rs')").alias("file"), F.expr("case doc_id % 9 when 0 then 'removed' when 1 then 'renamed' else 'modified' end").alias("status"), F.expr("case when doc_id % 7 = 0 then 'summary' else 'kept' end").alias("disposition"), F.posexplode_outer(F.when(F.col("doc_id") % 9 != 1, F.split("text", r"\. "))).alias("hunk_no", "text"))
    return diffs.units(d, 2_000, 100_000, 40).select("review", "file_no", "chunk", "chunks", "note", "chars", "oversized", F.sha2("diff", 256).alias("diff_sha256"))


@query("""WITH s AS (SELECT s_name AS project, CAST(s_suppkey AS VARCHAR) AS version, s_suppkey % 3 AS kind FROM supplier)
    SELECT project, project AS subject, 'has_language' AS predicate, CASE kind WHEN 0 THEN 'Rust' ELSE 'JavaScript' END AS object FROM s WHERE kind < 2 UNION ALL SELECT project, project, 'has_version', version FROM s WHERE kind < 2
    UNION ALL SELECT project, project, 'has_dependency', 'left' FROM s WHERE kind = 1 UNION ALL SELECT project, project, 'has_description', concat('About ', version) FROM s WHERE kind < 2 UNION ALL SELECT project, project, 'bootstrapped_at', '2024-01-01T00:00:00Z' FROM s""")
def memory_project_facts(t):
    s = t("supplier").select(F.col("s_name").alias("project"), F.col("s_suppkey").cast("string").alias("v"), (F.col("s_suppkey") % 3).alias("kind"))
    cargo = s.filter("kind = 0").select("project", F.lit("Cargo.toml").alias("file"), F.concat(F.lit('[package]\nname = "'), "project", F.lit('"\nversion = "'), "v", F.lit('"')).alias("content"))
    package = s.filter("kind = 1").select("project", F.lit("package.json").alias("file"), F.to_json(F.struct(F.col("project").alias("name"), F.col("v").alias("version"), F.struct(F.lit("1").alias("left")).alias("dependencies"))).alias("content"))
    about = s.select("project", F.lit("CLAUDE.md").alias("file"), F.concat(F.lit("# About "), "v").alias("content"))
    return walk.project_facts(cargo.union(package).union(about), F.lit("2024-01-01").cast("timestamp")).drop("provenance")


SHAPES["worded"] = """SELECT o_orderkey AS sha, o_orderkey % 13 = 0 AS is_merge, concat(CASE o_orderkey % 6 WHEN 0 THEN 'AB-12: ' WHEN 1 THEN 'Merge branch ' WHEN 2 THEN ' ab-1 ' ELSE '' END, CASE o_orderkey % 11 WHEN 0 THEN 'Fix broken cache' WHEN 1 THEN 'add' WHEN 2 THEN 'Refactor and rename parser tests'
    WHEN 3 THEN 'docs: typo in readme' WHEN 4 THEN 'bump version' WHEN 5 THEN 'integrate webhook API' WHEN 6 THEN 'fix and add' WHEN 7 THEN 'hotfixes' WHEN 8 THEN 'x' ELSE o_comment END) AS message,
    concat(CASE WHEN o_orderkey % 4 = 0 THEN 'a/tests/x.rs;' ELSE 'src/y.rs;' END, CASE o_orderkey % 5 WHEN 0 THEN 'docs/a.md' WHEN 1 THEN 'b/Cargo.toml' WHEN 2 THEN 'tests/t.ts' ELSE 'z.rs' END) AS paths FROM {orders}""".replace("o_comment", "o_orderpriority")


def scored_sql() -> str:
    """The scores by category, as 32-bit sums."""
    single = lambda x: f"{x}::FLOAT"
    sums = []
    for c, words in classify.WORDS.items():
        n = " + ".join(f"CAST(contains(l, '{w}') AS INT)" for w in words.split()) or "0"
        parts = [f"CASE {n} WHEN 0 THEN {single(0)} WHEN 1 THEN {single(0.4)} WHEN 2 THEN {single(0.6)} ELSE {single(0.75)} END", f"CASE WHEN regexp_matches(m, '{classify.TICKET}') THEN {single(0.05)} ELSE {single(0)} END"]
        parts.append(f"CASE WHEN strlen(m) < 12 THEN {single(classify.SHORT_SCORES.get(c, 0))} WHEN strlen(m) > 80 THEN {single(classify.LONG_SCORES.get(c, 0))} ELSE {single(0)} END")
        parts.append(f"CASE WHEN is_merge OR starts_with(l, 'merge ') THEN {single(0.65 if c == 'merge' else -0.05)} ELSE {single(0)} END")
        own = " + ".join(f"CASE WHEN r{i} >= 0.5 THEN r{i} * {single(w[c])} ELSE {single(0)} END" for i, (_, w) in enumerate(classify.PATH_SCORES) if c in w)
        sums.append(f"({' + '.join(parts)} + ({own or single(0)})) AS {c}")
    return ", ".join(sums)


PATH_RATIOS_SQL = ", ".join(f"len(list_filter(p, lambda x: regexp_matches(x, '{pattern}')))::FLOAT / len(p)::FLOAT AS r{i}" for i, (pattern, _) in enumerate(classify.PATH_SCORES))


@query(f"""WITH a AS (SELECT sha, is_merge, trim(message) AS m, lower(trim(message)) AS l, string_split(paths, ';') AS p FROM worded), b AS (SELECT *, {PATH_RATIOS_SQL} FROM a), s AS (SELECT sha, {scored_sql()} FROM b),
    g AS (SELECT sha, unnest([{', '.join(f"{{'c': '{c}', 's': {c}}}" for c in classify.WORDS)}]) AS x FROM s), k AS (SELECT sha, max(x.s) AS top FROM g GROUP BY sha), f AS (SELECT sha, any_value(x.c) AS c, any_value(top) AS top, count(*) AS n FROM g JOIN k USING (sha) WHERE x.s = top GROUP BY sha)
    SELECT sha, c AS category, round(least(top::DOUBLE, 0.95), 6) AS confidence FROM f WHERE n = 1 AND top >= 0.55::FLOAT""", "worded")
def git_scored_classification(t):
    found = classify.scored_tier(F.col("message"), F.col("is_merge"), F.split("paths", ";"))
    return t("worded").select("sha", found.alias("w")).filter("w is not null").select("sha", "w.category", F.round("w.confidence", 6).alias("confidence"))


@query()
def review_diff_reports(t):
    """Documents as diffs of files of eight documents each, half of which have their documents as indexed chunks."""
    d = t("documents").selectExpr("doc_id as id", "concat('+++ b/f', floor(doc_id / 8), '.rs\\n@@ -0,0 +', doc_id % 30 + 1, ',9 @@\\n+', replace(text, '. ', '\\n+')) as diff")
    chunks = t("documents").filter("floor(doc_id / 8) % 2 = 0").selectExpr("concat('f', floor(doc_id / 8), '.rs') as file", "doc_id % 7 * 10 + 1 as start_line", "doc_id % 7 * 10 + 10 as end_line", "text as content")
    return diffs.review_reports(d, diffs.reviewed_files(d, chunks))


@query("""WITH a AS (SELECT o_custkey AS batch, o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'merge' WHEN 1 THEN 'flag' ELSE 'bad' END AS kind, o_totalprice / 1e6 AS importance, o_orderpriority AS tag FROM orders),
    g AS (SELECT batch, list_sort(list(id) FILTER (kind = 'merge')) AS ids, count(*) FILTER (kind = 'bad') AS bad FROM a GROUP BY batch), k AS (SELECT * FROM g WHERE bad = 0 AND len(ids) > 0)
    SELECT k.batch, array_to_string(any_value(ids), ',') AS canonical_for, round(greatest(max(importance), 0.5), 9) AS importance, array_to_string(list_sort(list_distinct(list(tag))), ',') AS tags FROM k JOIN a ON a.batch = k.batch AND list_contains(ids, a.id) GROUP BY k.batch""")
def memory_applied_actions(t):
    o = t("orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("place"), (F.col("o_totalprice") / 1e6).alias("importance"), F.array("o_orderpriority").alias("tags"))
    ids = F.array_sort(F.collect_list(F.when(F.col("id") % 3 == 0, F.col("id").cast("long"))))
    wrong = F.count_if(F.col("id") % 3 == 2)
    merge = F.to_json(F.struct(F.lit("merge").alias("action"), F.lit("c").alias("canonical_content"), F.transform(ids, lambda x: x.cast("string")).alias("superseded_ids")))
    answers = o.groupBy("batch").agg(F.when(F.size(ids) > 0, F.concat(F.lit("```json\n["), merge, F.when(wrong > 0, ',{"action":"bad"}').otherwise(""), F.lit("]\n```"))).otherwise("none").alias("answer"))
    found = memory.applied_actions(o, answers)[0]
    return found.select("batch", F.array_join("canonical_for", ",").alias("canonical_for"), F.round("importance", 9).alias("importance"), F.array_join(F.array_sort("tags"), ",").alias("tags"))


SHAPES["rusty"] = """SELECT CAST(doc_id AS STRING) AS file, concat('x', regexp_replace(lower(concat(source, '')), '[^a-z0-9]', '_')) AS own, concat('"', replace(replace(coalesce(text, ''), '"', ''), chr(92), ''), '"') AS told, CAST(doc_id % 10 AS STRING) AS n FROM {documents}""".replace(
    "regexp_replace(lower(concat(source, '')), '[^a-z0-9]', '_')", "translate(lower(source), '-. /:', '_____')"
)


@query("""WITH s AS (SELECT file, own, told, strlen(own) AS k, strlen(n) AS d, n FROM rusty)
    SELECT file, 'ExternalCrate' AS kind, own AS text, 0 AS "start", 8 + k + d AS "end", CAST(1 AS BIGINT) AS line FROM s UNION ALL SELECT file, 'ModulePath', concat(own, '::a', n), 0, 8 + k + d, 1 FROM s
    UNION ALL SELECT file, 'ModulePath', concat(own, '::a', n), 4, 4 + k + 3 + d, 1 FROM s UNION ALL SELECT file, 'Annotation', concat('#[', own, ']'), 9 + k + d, 9 + k + d + k + 3, 2 FROM s
    UNION ALL SELECT file, 'LiteralString', told, 30 + k + k + d, 30 + k + k + d + strlen(told), 3 FROM s WHERE strlen(told) >= 13""", "rusty")
def code_entities(t):
    sources = t("rusty").select("file", F.lit("rust").alias("language"), F.expr("concat('use ', own, '::a', n, ';\\n#[', own, ']\\nfn f() { let t = ', told, '; }')").alias("content"))
    return entities.entities(sources).drop("id")


# -- definitions by scopes -----------------------------------------------------------------------------------


@query("""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN doc_id % 40 ELSE 0 END AS k FROM documents)
    SELECT concat('s', doc_id, '.rs::function::f', doc_id, '::2') AS id, 'function' AS kind, CAST(CASE WHEN doc_id % 3 = 0 THEN 6 ELSE 2 END AS INTEGER) AS parameters, CAST(6 + 3 * k AS INTEGER) AS cyclomatic, CAST(9 + 15 * k AS INTEGER) AS cognitive, CAST(CASE WHEN k > 0 THEN 5 ELSE 2 END AS INTEGER) AS nesting, CAST(7 + k AS INTEGER) AS end_line FROM s""")
def code_definitions(t):
    """The function that begins each source; what follows it is prose, which may hold other heads."""
    own = parse.definitions(t("sources").select(F.concat(F.lit("s"), "doc_id", F.lit(".rs")).alias("path"), F.lit("rust").alias("language"), F.col("text").alias("content")))
    return own.filter(F.col("start_line") == 2).select("id", "kind", "parameters", "cyclomatic", "cognitive", "nesting", "end_line")


@query(r"SELECT doc_id, md5(left(list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^(//|@)') AND (NOT starts_with(x, '#') OR starts_with(x, '#define')))[1], 240)) AS digest FROM documents")
def code_signatures(t):
    return t("documents").select("doc_id", F.md5(code.signature(F.col("text")).cast("binary")).alias("digest"))


# -- names ---------------------------------------------------------------------------------------------------

SHAPES["mails"] = """SELECT DISTINCT concat(lower(split_part(name, ' ', 1)), CASE WHEN client_id % 5 = 0 THEN '' ELSE CAST(client_id % 90 AS STRING) END, CASE client_id % 7 WHEN 0 THEN '@co.com' WHEN 1 THEN '@c0.com' WHEN 2 THEN '@mac.local' WHEN 3 THEN '@coo.com' ELSE '@else.org' END) AS email FROM {clients} WHERE name IS NOT NULL
    UNION SELECT concat(CAST(client_id AS STRING), '+', lower(split_part(name, ' ', 1)), CASE WHEN client_id % 2 = 0 THEN CAST(client_id % 9 AS STRING) ELSE '' END, '@users.noreply.github.com') FROM {clients} WHERE name IS NOT NULL AND client_id % 50 = 3"""


@query("""WITH m AS (SELECT email, split_part(email, '@', 1) AS l, split_part(email, '@', 2) AS d FROM mails WHERE email NOT LIKE '@%'), p AS (SELECT email, split_part(l, '+', 2) AS login FROM m WHERE d = 'users.noreply.github.com' AND split_part(l, '+', 2) <> ''),
    a AS (SELECT email AS source, l || '@co.com' AS target, CASE WHEN d LIKE '%.local' THEN 0.90 ELSE 0.88 END AS confidence, CASE WHEN d LIKE '%.local' THEN 'host' ELSE 'typo' END AS rule FROM m WHERE (d LIKE '%.local' OR (d <> 'co.com' AND levenshtein(d, 'co.com') BETWEEN 1 AND 2)) AND l || '@co.com' IN (SELECT email FROM mails)
    UNION ALL SELECT p.email, m.email, CASE WHEN l = login THEN 0.90 ELSE 0.78 END, CASE WHEN l = login THEN 'login' ELSE 'part' END FROM p, m WHERE p.email <> m.email AND (contains(l, login) OR contains(login, l)))
    SELECT source, target, confidence::DOUBLE AS confidence, rule FROM a""", "mails")
def identity_noise_aliases(t):
    return identity.noise_aliases(t("mails"), "co.com")


@query("WITH n AS (SELECT DISTINCT regexp_replace(lower(name), '[^ -~]', '?', 'g') AS word FROM clients WHERE name IS NOT NULL), v AS (SELECT DISTINCT regexp_replace(lower(name), '[^ -~]', '?', 'g') AS word FROM vendors WHERE name IS NOT NULL) SELECT v.word AS a, n.word AS b, round(jaro_winkler_similarity(v.word, n.word), 6) AS score FROM v, n WHERE jaro_winkler_similarity(v.word, n.word) >= 0.85")
def identity_alike_names(t):
    named = lambda table: t(table).select(F.regexp_replace(F.lower("name"), "[^ -~]", "?").alias("word"))
    return identity.alike(named("vendors"), named("clients"), 0.85).withColumn("score", F.round("score", 6))


# -- diffs, ledgers, streams ---------------------------------------------------------------------------------

#: A text's lines as a diff of one file: the first is its head's section, others are added, removed or kept by their number.
SHAPES["patches"] = """SELECT doc_id AS id, concat('diff --git a/d', CAST(doc_id AS STRING), '.md b/d', CAST(doc_id AS STRING), '.md', chr(10), '--- a/d', CAST(doc_id AS STRING), '.md', chr(10), '+++ b/d', CAST(doc_id AS STRING), '.md', chr(10), '@@ -', CAST(doc_id % 90 AS STRING), ',3 +', CAST(doc_id % 70 AS STRING), ' @@ sec', chr(10), '-old', chr(10), ' same', chr(10), '+', replace(text, chr(10), concat(chr(10), '+')), chr(10)) AS diff FROM {documents}"""


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents) SELECT doc_id AS id, concat('d', doc_id, '.md') AS file, CAST(doc_id % 70 + 1 AS BIGINT) AS first_line, CAST(doc_id % 70 + len(a) AS BIGINT) AS last_line, CAST(len(a) AS BIGINT) AS n FROM l")
def diff_added_lines(t):
    own = patches.added_lines(t("patches"))
    return own.groupBy("id", "file").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), F.count("*").alias("n"))


@query("SELECT id, md5(diff) AS digest FROM patches", "patches")
def diff_round_trip(t):
    return patches.joined(patches.parts(t("patches"))).select("id", F.md5(F.col("diff").cast("binary")).alias("digest"))


@query("SELECT doc_id AS id, CAST(doc_id % 90 AS BIGINT) AS old_start, 3::BIGINT AS old_lines, CAST(doc_id % 70 AS BIGINT) AS new_start, 1::BIGINT AS new_lines, 'sec' AS section, 'modified' AS change FROM documents")
def diff_hunks(t):
    d = t("patches")
    return patches.hunks(d).join(patches.changed_files(d).select("id", "file_no", "change"), ["id", "file_no"]).select("id", "old_start", "old_lines", "new_start", "new_lines", "section", "change")


@query("""WITH a AS (SELECT DISTINCT concat('src/f', l_suppkey % 50, '.rs') AS file, l_partkey % 50 AS line FROM lineitem WHERE l_linenumber = 1), h AS (SELECT concat(CASE WHEN l_suppkey % 3 = 0 THEN '/build/b/' WHEN l_suppkey % 3 = 1 THEN '/build/a/' ELSE '' END, 'src/f', l_suppkey % 50, '.rs') AS file, l_partkey % 50 AS line, max(l_linenumber % 3) AS hits FROM lineitem WHERE l_linenumber > 1 GROUP BY 1, 2),
    p AS (SELECT DISTINCT file FROM h), o AS (SELECT f.file, min(p.file) AS path, count(*) AS candidates FROM (SELECT DISTINCT file FROM a) f JOIN p ON ends_with(p.file, f.file) AND p.file <> f.file GROUP BY f.file),
    j AS (SELECT a.file, coalesce(o.candidates, 0) AS candidates, x.hits AS own, y.hits AS near FROM a LEFT JOIN o USING (file) LEFT JOIN h x ON x.file = a.file AND x.line = a.line LEFT JOIN h y ON y.file = o.path AND y.line = a.line)
    SELECT file, count(coalesce(own, near)) AS instrumented, count(*) FILTER (coalesce(own, near) > 0) AS covered, round(100.0 * count(*) FILTER (coalesce(own, near) > 0) / nullif(count(coalesce(own, near)), 0), 6)::DOUBLE AS percent,
    CASE WHEN count(own) > 0 AND count(*) FILTER (own IS NULL AND near IS NOT NULL) > 0 THEN 'both' WHEN count(own) > 0 THEN 'exact' WHEN count(near) > 0 THEN 'ending' ELSE 'none' END AS found, CAST(max(candidates) AS BIGINT) AS candidates FROM j GROUP BY file""")
def review_coverage_by_ending(t):
    lines = t("lineitem").selectExpr("concat('src/f', l_suppkey % 50, '.rs') as file", "l_partkey % 50 as line", "l_linenumber", "l_suppkey % 3 as side")
    where = F.expr("concat(case side when 0 then '/build/b/' when 1 then '/build/a/' else '' end, file)")
    hits = lines.filter("l_linenumber > 1").groupBy(where.alias("file"), "line").agg(F.max(F.col("l_linenumber") % 3).alias("hits"))
    return ranges.coverage_by_ending(lines.filter("l_linenumber = 1").select("file", "line").distinct(), hits).withColumn("percent", F.round("percent", 6))


@query("WITH r AS (SELECT o_custkey % 50 AS repo, CAST(isoyear(o_orderdate) AS INT) AS iso_year, CAST(week(o_orderdate) AS INT) AS iso_week, o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders) SELECT repo AS repo_name, iso_year, iso_week, max(o_orderkey) AS collected_at, arg_max(n, o_orderkey) AS commit_count FROM r GROUP BY 1, 2, 3")
def ledger_runs(t):
    """Odd orders are in the ledger, even ones are recorded on it; a key's later row replaces the one before where it is newer."""
    o = t("orders").select((F.col("o_custkey") % 50).alias("repo_name"), F.expr("cast(extract(yearofweek from o_orderdate) as int)").alias("iso_year"), F.weekofyear("o_orderdate").alias("iso_week"), F.col("o_orderkey").alias("collected_at"), F.floor("o_totalprice").cast("long").alias("commit_count"), F.lit(1).alias("repo_count"))
    runs = ledgers.record_runs(o.limit(0), o.filter("collected_at % 2 = 1"))
    newer = ledgers.record_runs(runs, o.filter("collected_at % 2 = 0").unionByName(runs))
    return newer.select("repo_name", "iso_year", "iso_week", "collected_at", "commit_count")


@query("WITH a AS (SELECT doc_id % 4 AS k FROM documents) SELECT CASE k WHEN 0 THEN 'usage' WHEN 1 THEN 'conceptual' WHEN 2 THEN 'definition' ELSE 'unknown' END AS intent, count(*) AS n FROM a GROUP BY k")
def search_agent_intents(t):
    asked = F.expr("case doc_id % 4 when 0 then concat('who calls ', source) when 1 then 'how it works' when 2 then concat('fn f', doc_id) else 'show me it' end")
    return t("documents").groupBy(text.agent_intent(asked).alias("intent")).agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT vec_id, label, COLUMNS('^(embedding|vec|vector)$') AS vec FROM embeddings), a AS (SELECT vec AS q FROM e WHERE vec_id = 0), b AS (SELECT vec_id, label, round(" + COS_SQL + ", 5) AS score FROM e, a ORDER BY " + COS_SQL + " DESC, vec_id LIMIT 40) SELECT vec_id, score FROM b WHERE label % 2 = 0")
def search_in_language(t):
    v = vectors(t).withColumn("language", F.when(F.col("label") % 2 == 0, "Rust").otherwise("go"))
    return search.in_language(v, "vec_id", "vec", first_vector(t), 40, "rust").select("vec_id", F.round("score", 5).alias("score"))


@query(f"WITH {BM25_SQL}, b AS (SELECT doc_id, score, row_number() OVER (ORDER BY bm.score DESC, doc_id) AS rank FROM bm ORDER BY bm.score DESC, doc_id LIMIT 10) SELECT md5(concat('## Search Results for \"the thing ention\" (', count(*), ' result', CASE WHEN count(*) = 1 THEN '' ELSE 's' END, ')', chr(10), string_agg(concat(chr(10), '### ', rank, '. `d', b.doc_id, ':1-2` [score: ', format('{{:.2f}}', score), ', bm25]', chr(10), '```', lang, chr(10), text, CASE WHEN text LIKE '%' || chr(10) THEN '' ELSE chr(10) END, '```', chr(10)), '' ORDER BY rank))) AS digest FROM b JOIN documents d ON d.doc_id = b.doc_id")
def search_rendered(t):
    best = retrieval.ranked(index.search(indexed(t, "code"), ["the", "thing", "ention"], 10), "key")
    d = t("documents").select(F.col("doc_id").alias("key"), F.col("lang").alias("language"), F.col("text").alias("content"))
    hits = best.join(d, "key").select("rank", F.concat(F.lit("d"), "key").alias("file"), F.lit(1).alias("start_line"), F.lit(2).alias("end_line"), "language", "content", F.lit(None).cast("string").alias("compact_snippet"), "score", F.lit("bm25").alias("reason"))
    return search.rendered(hits, "the thing ention").select(F.md5(F.col("text").cast("binary")).alias("digest"))


@query("WITH l AS (SELECT client_id, max(change_id) AS at FROM client_changes WHERE client_id IS NOT NULL GROUP BY 1) SELECT DISTINCT l.client_id, l.at, c.segment, c.city FROM l JOIN client_changes c ON c.change_id = l.at WHERE coalesce(c.op, '') <> 'D'")
def stream_client_state(t):
    """The clients' last changes by a stream into a keyed table: its rows are the state."""
    source = t("client_changes")
    columns = "client_id long, at long, segment string, city string"
    table = tables.create(source.sparkSession, index.shared_folder(source.sparkSession), columns, "client_id", "at")
    files = source.inputFiles()
    folder, _, name = files[0].rpartition("/")
    read = source.sparkSession.readStream.schema(source.schema).option("pathGlobFilter", name if len(files) == 1 else "*").parquet(folder)
    changes = read.select("client_id", F.col("change_id").alias("at"), "segment", "city", (F.coalesce("op", F.lit("")) == "D").alias("removed"))
    tables.maintain(changes, table.version.folder, f"{table.version.folder}-checkpoint").awaitTermination()
    return tables.opened(source.sparkSession, table.version.folder).rows()


@query("WITH o AS (SELECT file, name, min(id) AS only FROM defs GROUP BY 1, 2) SELECT DISTINCT a.only AS src, b.only AS dst FROM defs p JOIN o a USING (file, name) JOIN o b ON b.file = p.file AND b.name = p.called", "defs")
def graph_dispatched(t):
    """Chunks by the number of their file's name go to one of two adapters, which make edges inside a file."""
    def make(chunks):
        nodes = chunks.select("id", F.col("name").alias("symbol"), "file")
        first = nodes.groupBy("file", "symbol").agg(F.min("id").alias("dst"))
        calls = chunks.select(F.col("id").alias("src"), "file", F.col("called").alias("symbol"))
        return nodes, calls.join(first, ["file", "symbol"]).select("src", "dst", F.lit("Calls").alias("kind"))

    odd = ("odd", lambda f: f.rlike("[13579]$"), make)
    return stores.dispatched(t("defs"), [odd, ("any", lambda f: f.isNotNull(), make)])[1].drop("kind")


@query("WITH o AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS callee FROM lineitem), g AS (SELECT callee, count(*) AS tests FROM o GROUP BY 1 HAVING count(*) > 1) SELECT callee, src, tests FROM o JOIN g USING (callee)")
def chunk_test_groups(t):
    return chunking.test_groups(t("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("callee")))


@query("WITH o AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS callee FROM lineitem) SELECT DISTINCT a.src, b.src AS dst FROM o a JOIN o b USING (callee) WHERE a.src = 3 AND b.src <> 3")
def chunk_siblings(t):
    calls = t("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("callee"))
    return chunking.siblings(chunking.test_groups(calls), calls.filter("src = 3"))

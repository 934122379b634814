"""Queries of quality reports, archives, splits, issue references, staff, contributions, trends and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import code, paths, text
from .operators import chunking, classify, delivery, quality, reports, review
from .queries import DECISION_SQL, EXT, SHAPES, SQL, query, sql_list
from .queries_more import TAXONOMY_SQL, scored_sql

LEAD = "regexp_extract(l, '^([ \\t]*)', 1)"
DEPTH_OF_LINE = f"least((length({LEAD}) - length(replace({LEAD}, ' ', ''))) // 4 + length(replace({LEAD}, chr(9), 'x')) - (length({LEAD}) - length(replace({LEAD}, ' ', ''))), 255)"
AFTER = "CASE " + " ".join(f"WHEN instr(text, '{m}') > 0 THEN substr(text, instr(text, '{m}'))" for m in ("fn ", "def ", "function ")) + " END"
INNER = f"trim(regexp_extract({AFTER}, '^[^(]*\\(([^)]*)\\)', 1))"
SMELLS_SQL = f"""parts AS (SELECT *, CASE WHEN coalesce({INNER}, '') IN ('', 'self', '&self', '&mut self') THEN 0 ELSE len(list_filter(string_split({INNER}, ','), lambda p: trim(p) <> '')) END AS parameters, length(text) - length(replace(text, chr(10), '')) AS breaks,
    list_max(list_transform(string_split(text, chr(10)), lambda l: {DEPTH_OF_LINE})) AS depth, {" OR ".join(f"contains(text, '{m.replace(chr(39), chr(39) * 2)}')" for m in code.DOC_MARKS)} AS documented FROM sources),
    smelt AS (SELECT *, concat_ws(',', CASE WHEN breaks > 50 THEN 'long_function' END, CASE WHEN depth > 4 THEN 'deep_nesting' END, CASE WHEN parameters > 5 THEN 'too_many_params' END, CASE WHEN NOT documented THEN 'missing_docstring' END) AS smells FROM parts)"""
COUNT_SMELLS = "CASE WHEN smells = '' THEN 0 ELSE len(string_split(smells, ',')) END"
SQL["code_smells"] = f"WITH sources AS ({SHAPES['sources'].format(documents='documents')}), {SMELLS_SQL} SELECT doc_id, smells, CAST(parameters AS BIGINT) AS parameters FROM smelt"


@query(f"WITH {SMELLS_SQL} SELECT doc_id, smells FROM smelt WHERE smells <> '' ORDER BY doc_id LIMIT 50 OFFSET 20", "sources")
def code_smelly_page(t):
    """A page of the chunks with smells, which is the feature."""
    return quality.smelly(t("sources"), "doc_id", "text", 20, 50).select("doc_id", F.array_join("smells", ",").alias("smells"))


@query(f"WITH {SMELLS_SQL}, c AS (SELECT {DECISION_SQL} + 1 AS c, {COUNT_SMELLS} AS s FROM smelt) SELECT round(avg(c), 6) AS avg_cyclomatic, round(avg(CAST(c <= 5 AS INT)), 6) AS pct_grade_a, CAST(sum(s) AS BIGINT) AS smell_count, count(*) AS chunk_count FROM c", "sources")
def code_quality_totals(t):
    return quality.report(t("sources"), "text").withColumns({c: F.round(c, 6) for c in ("avg_cyclomatic", "pct_grade_a")})


SHAPES["kept_files"] = "SELECT doc_id, concat(CASE doc_id % 6 WHEN 0 THEN 'src/Legacy/' WHEN 1 THEN 'src/old/' WHEN 2 THEN '' ELSE 'lib/' END, 'd', CAST(doc_id % 40 AS STRING), '/f', CAST(doc_id AS STRING), '.rs') AS file, CASE WHEN doc_id % 5 = 0 THEN concat('// DEPRECATED ', text) ELSE text END AS content, doc_id % 800 AS age_days FROM {documents}"
SHAPES["present_files"] = "SELECT concat(CASE doc_id % 6 WHEN 0 THEN 'src/Legacy/' WHEN 2 THEN '' ELSE 'lib/' END, 'd', CAST(doc_id % 40 AS STRING), '/', CASE doc_id % 9 WHEN 0 THEN 'DEPRECATED' WHEN 1 THEN '.archived' ELSE 'readme.md' END) AS file FROM {documents}"
MARKS_IN_ORDER = " ".join(f"WHEN contains(content, '{m}') THEN 'annotation:{m}'" for m in paths.ARCHIVE_MARKS)
PATHS_IN_ORDER = " ".join(f"WHEN contains(lower(file), '{p}') THEN 'path:{p.strip('/')}'" for p in paths.ARCHIVE_PATHS)


@query(f"""WITH m AS (SELECT regexp_extract(file, '^(.*/)?[^/]*$', 1) AS folder, min(regexp_extract(file, '[^/]*$')) AS mark FROM present_files WHERE regexp_extract(file, '[^/]*$') IN ({sql_list(quality.MARKERS)}) GROUP BY 1),
    r AS (SELECT doc_id, CASE {PATHS_IN_ORDER} END AS a, CASE {MARKS_IN_ORDER} END AS b, 'marker:' || mark AS c, CASE WHEN age_days > 365 THEN 'stale:git_mtime' END AS d FROM kept_files LEFT JOIN m ON folder = regexp_extract(file, '^(.*/)?[^/]*$', 1))
    SELECT doc_id, coalesce(a, b, c, d) AS reason, CASE CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT) + CAST(c IS NOT NULL AS INT) WHEN 0 THEN CASE WHEN d IS NULL THEN 1.0 ELSE 0.7 END WHEN 1 THEN 0.3 ELSE 0.1 END::DOUBLE AS keeps FROM r""", "kept_files", "present_files")
def path_archived(t):
    return quality.archived(t("kept_files"), t("present_files")).select("doc_id", "reason", "keeps")


MANIFEST_SQL = "CASE regexp_extract(lower(path), '[^/]*$') " + " ".join(f"WHEN '{m}' THEN '{b}'" for m, b in paths.MANIFESTS.items()) + " END"
LANGUAGE_SQL = f"CASE {EXT} " + " ".join(f"WHEN '{e}' THEN '{n}'" for e, n in paths.LANGUAGES.items()) + " END"
SHAPES["projects"] = "SELECT doc_id, concat('p/', CASE doc_id % 11 WHEN 5 THEN 'pom.xml' WHEN 7 THEN 'Cargo.toml' WHEN 8 THEN 'go.mod' ELSE concat(source, CASE doc_id % 7 WHEN 0 THEN '.rs' WHEN 1 THEN '.go' WHEN 2 THEN '.java' WHEN 3 THEN '.PY' WHEN 4 THEN '.rs' ELSE '.bin' END) END) AS path FROM {documents}"


@query(f"""WITH f AS (SELECT doc_id, {LANGUAGE_SQL} AS language, {MANIFEST_SQL} AS build FROM projects), n AS (SELECT language, count(*) AS n FROM f WHERE language IS NOT NULL GROUP BY 1)
    SELECT (SELECT language FROM n ORDER BY n DESC, language LIMIT 1) AS primary_language, (SELECT string_agg(language, ',' ORDER BY n DESC, language) FROM n) AS languages, arg_min(build, doc_id) FILTER (build IS NOT NULL) AS build_system, round(count(language) / count(*), 9) AS confidence FROM f""", "projects")
def path_detected(t):
    return quality.detected(t("projects"), "path", "doc_id").withColumns({"languages": F.array_join("languages", ","), "confidence": F.round("confidence", 9)})


@query(r"""WITH c AS (SELECT doc_id, string_split_regex(replace(coalesce(text, ''), ' ', chr(10)), '\r?\n') AS p, replace(text, ' ', chr(10)) AS content FROM documents), l AS (SELECT doc_id, content, len(p) AS had, CASE WHEN p[-1] = '' THEN p[:len(p) - 1] ELSE p END AS w FROM c),
    k AS (SELECT *, CASE WHEN had > 200 AND len(w) > 0 THEN CAST(ceil(greatest(len(w) - 100, 0) / 50) AS BIGINT) + 1 ELSE 0 END AS kids FROM l)
    SELECT CAST(doc_id AS STRING) AS id, 10 AS start_line, CAST(9 + had AS BIGINT) AS end_line, NULL::STRING AS parent_id, kids AS children, md5(content) AS digest FROM k
    UNION ALL SELECT concat(doc_id, '::sub::', i), 10 + i * 50, CAST(9 + least(i * 50 + 100, len(w)) AS BIGINT), CAST(doc_id AS STRING), 0, md5(array_to_string(w[i * 50 + 1:least(i * 50 + 100, len(w))], chr(10))) FROM (SELECT *, unnest(range(kids)) AS i FROM k)""")
def chunk_oversized(t):
    lines = F.replace("text", F.lit(" "), F.lit("\n"))
    chunks = t("documents").select(F.col("doc_id").alias("id"), F.lit("f").alias("file"), F.lit(10).cast("long").alias("start_line"), (F.size(F.split(F.coalesce(lines, F.lit("")), "\r?\n")) + 9).cast("long").alias("end_line"), lines.alias("content"))
    return chunking.split_oversized(chunks).select("id", "start_line", "end_line", "parent_id", F.size("child_ids").cast("long").alias("children"), F.md5(F.col("content").cast("binary")).alias("digest"))


SHAPES["linked"] = """SELECT o_orderkey AS sha, concat('ABC-', CAST(o_orderkey AS STRING), ' and X1-', CAST(o_custkey AS STRING), CASE o_orderkey % 5 WHEN 0 THEN ' see acme/app#12 (#9) #0 acme/app#12' WHEN 1 THEN concat(' #', CAST(o_custkey AS STRING), ' [CONF-7] https://x/wiki/spaces/ENG/pages/', CAST(o_orderkey AS STRING))
    WHEN 2 THEN concat(' QRS-123456', CAST(o_orderkey AS STRING), ' ABC-', CAST(o_orderkey AS STRING)) WHEN 3 THEN ' LONGPREFIXX-1 c#5 [CONF-0]' ELSE ' #abc' END) AS message FROM {orders}"""


@query(r"""WITH k AS (SELECT sha, message, list_sort(list_distinct(list_filter(regexp_extract_all(message, '\b([A-Z][A-Z0-9]{0,9}-\d+)', 1), lambda k: regexp_matches(k, '-\d{1,7}$')))) AS keys FROM linked)
    SELECT sha, array_to_string(keys, ',') AS keys, array_to_string(list_filter(keys, lambda k: starts_with(k, 'ABC-')), ',') AS own_keys,
    array_to_string(list_sort(list_filter(list_distinct(list_concat(list_transform(regexp_extract_all(message, '(?:^|\s)([A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+#\d+)\b', 1), lambda x: x), list_transform(regexp_extract_all(message, '(?:^|[\s(])(#\d+)\b', 1), lambda x: x))), lambda x: NOT regexp_matches(x, '#0+$'))), ',') AS issues,
    array_to_string(list_sort(list_filter(list_distinct(list_transform(list_concat(regexp_extract_all(message, '/wiki/spaces/[^/]+/pages/(\d+)', 1), regexp_extract_all(message, '\[CONF-(\d+)\]', 1)), lambda x: CAST(x AS BIGINT))), lambda x: x > 0)), ',') AS pages FROM k""", "linked")
def git_issue_references(t):
    m, joined = F.col("message"), lambda a: F.array_join(F.array_sort(a), ",")
    issues = F.transform(text.hosted_issues(m), lambda x: F.concat(F.coalesce(x["repo"], F.lit("")), F.lit("#"), x["number"].cast("string")))
    pages = F.transform(F.array_sort(text.wiki_pages(m)), lambda n: n.cast("string"))
    return t("linked").select("sha", joined(text.issue_keys(m)).alias("keys"), joined(text.issue_keys(m, ("ABC",))).alias("own_keys"), joined(issues).alias("issues"), F.array_join(pages, ",").alias("pages"))


@query("""WITH s AS (SELECT list_sort(list(o_totalprice)) AS l FROM orders), c AS (SELECT l[CAST(ceil(0.2 * len(l)) AS BIGINT)] AS a, l[CAST(ceil(0.4 * len(l)) AS BIGINT)] AS b, l[CAST(ceil(0.6 * len(l)) AS BIGINT)] AS c, l[CAST(ceil(0.8 * len(l)) AS BIGINT)] AS d FROM s)
    SELECT o_orderkey AS sha, 1 + CAST(o_totalprice >= a AS INT) + CAST(o_totalprice >= b AS INT) + CAST(o_totalprice >= c AS INT) + CAST(o_totalprice >= d AS INT) AS tshirt FROM orders, c""")
def git_effort_rebinned(t):
    return delivery.rebinned(t("orders").select(F.col("o_orderkey").alias("sha"), F.col("o_totalprice").alias("score"), F.lit("M").alias("size"))).select("sha", "tshirt")


@query("""WITH n AS (SELECT deploy_id, sha, message, insertions, row_number() OVER (PARTITION BY deploy_id ORDER BY timestamp, sha) AS r FROM deployments d JOIN commits c ON d.repo = c.repository AND c.timestamp > d.triggered_at AND c.timestamp <= d.triggered_at + INTERVAL '24' HOUR
    WHERE environment = 'production' AND status = 'success') SELECT deploy_id, sha FROM n WHERE r = 1 AND (regexp_matches(message, '(?i)revert') OR (insertions % 2 = 0 AND regexp_matches(message, '^fix')))""", "deployments", "commits")
def dora_typed_signals(t):
    kind = F.when(F.col("insertions") % 2 == 0, "Bugfix").otherwise("feature")
    return delivery.first_after(t("deployments"), t("commits"), 24, delivery.failure_signal(F.col("message"), kind, [(None, "(?i)revert"), ("bugFIX", "^fix")]))


SHAPES["people"] = """SELECT concat('n', CAST(client_id AS STRING)) AS full_name, segment AS team, city AS department, source AS title, CAST(nation_id AS STRING) AS level, CASE client_id % 3 WHEN 0 THEN 'FTE' WHEN 1 THEN 'Contractor' END AS employment_type,
    CASE WHEN client_id % 10 = 0 THEN 'left' ELSE 'active' END AS status, CASE WHEN client_id % 4 <> 0 THEN source END AS contractor_source FROM {clients} WHERE client_id IS NOT NULL"""


@query("""SELECT 'team' AS by, coalesce(team, '<unassigned>') AS name, count(*) AS headcount FROM people WHERE status = 'active' GROUP BY team UNION ALL SELECT 'status', coalesce(employment_type, '<unknown>'), count(*) FROM people WHERE status = 'active' GROUP BY employment_type
    UNION ALL SELECT 'vendor', coalesce(contractor_source, '<unknown>'), count(*) FROM people WHERE status = 'active' AND employment_type = 'Contractor' GROUP BY contractor_source""", "people")
def staff_headcount(t):
    one, *more = [reports.headcount(t("people"), by).select(F.lit(by).alias("by"), F.col(by).alias("name"), "headcount") for by in reports.HEADCOUNTS]
    return one.unionByName(more[0]).unionByName(more[1])


@query("SELECT full_name, team, department, title, level, employment_type, status, contractor_source FROM people WHERE status = 'active' ORDER BY department NULLS FIRST, team NULLS FIRST, full_name LIMIT 500", "people")
def staff_list(t):
    """The list ends at 500, which is the feature."""
    return reports.people_list(t("people"))


SHAPES["costs"] = "SELECT CASE WHEN item_id % 6 <> 0 THEN kind END AS team, brand AS organization, CASE item_id % 4 WHEN 0 THEN 'Active' WHEN 1 THEN 'active' WHEN 2 THEN 'closed' END AS status, CAST(size AS BIGINT) * 100 AS annual_cost, item_id % 1000 * 8 AS year_total FROM {items}"


@query("""SELECT coalesce(team, '<unassigned>') AS team, coalesce(organization, '<unassigned>') AS organization, count(*) AS headcount, round(CAST(sum(annual_cost) AS DOUBLE), 2) AS annual_cost_total, round(CAST(sum(year_total) AS DOUBLE), 2) AS year_total FROM costs WHERE status IS NULL OR status IN ('Active', 'active') GROUP BY costs.team, costs.organization""", "costs")
def staff_budget(t):
    return reports.budget(t("costs")).withColumns({c: F.col(c).cast("double") for c in ("annual_cost_total", "year_total")})


SHAPES["given"] = """SELECT concat('p', CAST(l_linenumber % 3 AS STRING)) AS producer, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 400 END AS id, CASE WHEN l_linenumber % 2 = 1 THEN l_suppkey END AS src, CASE WHEN l_linenumber % 2 = 1 THEN l_partkey % 450 END AS dst,
    CASE l_orderkey % 5 WHEN 0 THEN 'reads' WHEN 1 THEN 'calls_proc' WHEN 2 THEN 'odd' WHEN 3 THEN 'Writes' END AS kind, CASE WHEN l_orderkey % 3 = 0 THEN 'custom:x' END AS tag FROM {lineitem}"""
KIND_SQL = "CASE kind " + " ".join(f"WHEN '{w}' THEN '{k}'" for w, k in review.EDGE_WORDS.items()) + " ELSE coalesce(CASE WHEN kind IN ('Writes', 'Calls') OR starts_with(kind, 'custom:') THEN kind END, CASE WHEN tag IN ('Writes', 'Calls') OR starts_with(tag, 'custom:') THEN tag END) END"
MERGED_SQL = f"""base AS (SELECT DISTINCT src AS id FROM edges UNION SELECT dst FROM edges), first AS (SELECT id, min(since) AS since FROM (SELECT id, '' AS since FROM base UNION ALL SELECT id, producer FROM given WHERE id IS NOT NULL) GROUP BY id),
    drawn AS (SELECT g.src, g.dst, {KIND_SQL} AS word, coalesce(a.since <= producer AND b.since <= producer, false) AS there FROM given g LEFT JOIN first a ON a.id = g.src LEFT JOIN first b ON b.id = g.dst WHERE g.src IS NOT NULL OR g.dst IS NOT NULL), fresh AS (SELECT DISTINCT src, dst, word FROM drawn WHERE there AND word IS NOT NULL EXCEPT SELECT src, dst, kind FROM edges)"""


def merged(t):
    nodes = t("edges").select(F.col("src").alias("id")).union(t("edges").select("dst")).distinct()
    return review.merge_contributions(nodes, t("edges"), t("given"), ("Writes", "Calls"))


@query(f"WITH {MERGED_SQL} SELECT src, dst, kind FROM edges UNION ALL SELECT * FROM fresh", "edges", "given")
def graph_contributed_edges(t):
    return merged(t)[1]


@query(f"WITH {MERGED_SQL} SELECT (SELECT count(*) FROM first WHERE since <> '') AS nodes_added, (SELECT count(*) FROM given WHERE id IS NOT NULL) - (SELECT count(*) FROM first WHERE since <> '') AS nodes_existing, (SELECT count(*) FROM fresh) AS edges_added, count(*) FILTER (there AND word IS NOT NULL) - (SELECT count(*) FROM fresh) AS edges_duplicate, count(*) FILTER (NOT there AND word IS NOT NULL) AS edges_dangling, count(*) FILTER (word IS NULL) AS edges_unknown_kind FROM drawn", "edges", "given")
def graph_contribution_counts(t):
    return merged(t)[2]


@query("""WITH f AS (SELECT user_id AS g, event_id AS place, CASE WHEN event_id % 9 = 0 THEN 'late' ELSE event_type END AS period, event_id // 7 % 8 AS cluster, value / 100 AS confidence FROM events), p AS (SELECT g, period, min(place) AS a FROM f GROUP BY ALL), m AS (SELECT g, arg_max(period, a) AS latest FROM p GROUP BY g),
    s AS (SELECT g, cluster, bool_or(period = latest) AS now, bool_or(period <> latest) AS earlier, arg_min(confidence, place) AS b, arg_max(confidence, place) AS e FROM f JOIN m USING (g) GROUP BY ALL)
    SELECT g, place, CASE WHEN now AND earlier AND e > b + 0.1 THEN 'worsening' WHEN now AND earlier THEN 'recurring' WHEN now THEN 'new' ELSE 'resolved' END AS trend FROM f JOIN s USING (g, cluster)""")
def review_trends(t):
    period = F.when(F.col("event_id") % 9 == 0, "late").otherwise(F.col("event_type"))
    f = t("events").select(F.col("user_id").alias("g"), F.col("event_id").alias("place"), period.alias("period"), F.expr("event_id div 7 % 8").alias("cluster"), (F.col("value") / 100).alias("confidence"))
    return review.trend_tags(f, "g", "cluster", "place", "period", "confidence").select("g", "place", "trend")


@query(r"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(text, '') AS x FROM conversations), w AS (SELECT conv_id, turn, x, CAST(floor(len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) * 1.3) AS BIGINT) AS cost, list_filter(list_transform(string_split_regex(x, '\s+'), lambda w: lower(regexp_replace(w, '[^\p{L}\p{N}]', '', 'g'))), lambda w: w <> '') AS ws FROM c),
    t AS (SELECT conv_id, turn, unnest(list_distinct(ws)) AS term FROM w), d AS (SELECT conv_id, term, count(*) AS df FROM t GROUP BY ALL), z AS (SELECT conv_id, count(*) AS n FROM w GROUP BY 1),
    q AS (SELECT conv_id, turn, avg(greatest(ln(n / df), 0) + 1) AS rare FROM t JOIN d USING (conv_id, term) JOIN z USING (conv_id) GROUP BY ALL),
    s AS (SELECT conv_id, turn, cost, round(CASE WHEN len(ws) > 0 THEN len(list_distinct(ws)) / len(ws) * rare * ln(greatest(strlen(x), 1)) ELSE 0 END, 9) AS score, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM w LEFT JOIN q USING (conv_id, turn)),
    e AS (SELECT * FROM s WHERE i = 1 OR i > n - 2 OR n <= 3), r AS (SELECT conv_id, greatest(60 - sum(cost), 0) AS room FROM e GROUP BY 1), m AS (SELECT conv_id, turn, cost, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS k FROM s WHERE NOT (i = 1 OR i > n - 2 OR n <= 3)),
    g AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, NULL::BIGINT AS turn, CAST(room AS BIGINT) AS room, false AS taken FROM r UNION ALL SELECT g.conv_id, m.k, CAST(m.turn AS BIGINT), CAST(CASE WHEN m.cost <= g.room THEN g.room - m.cost ELSE g.room END AS BIGINT), m.cost <= g.room FROM g JOIN m ON m.conv_id = g.conv_id AND m.k = g.k + 1)
    SELECT conv_id, CAST(turn AS BIGINT) AS turn FROM e UNION ALL SELECT conv_id, turn FROM g WHERE taken""")
def chat_history(t):
    return review.compress_history(t("conversations"), "conv_id", "turn", "text", 60, 2).select("conv_id", F.col("turn").cast("long").alias("turn"))


FOUND_SQL = "CASE WHEN o IS NOT NULL THEN {o} WHEN e IS NOT NULL THEN {e} WHEN i IS NOT NULL THEN {i} WHEN p IS NOT NULL THEN {p} WHEN r IS NOT NULL THEN {r} WHEN c IS NOT NULL THEN {s} WHEN f IS NOT NULL THEN {f} ELSE {n} END"


@query(rf"""WITH b AS (SELECT sha, message, is_merge, trim(message) AS m, lower(trim(message)) AS l, {', '.join(f'0::FLOAT AS r{i}' for i in range(len(classify.PATH_SCORES)))} FROM worded), s AS (SELECT sha, {scored_sql()} FROM b),
    g AS (SELECT sha, unnest([{', '.join(f"{{'c': '{c}', 's': {c}}}" for c in classify.WORDS)}]) AS x FROM s), k AS (SELECT sha, max(x.s) AS top FROM g GROUP BY sha), h AS (SELECT sha, any_value(x.c) AS c, any_value(top) AS top, count(*) AS n FROM g JOIN k USING (sha) WHERE x.s = top GROUP BY sha),
    t AS (SELECT b.sha, message, h.c, top, CASE WHEN b.sha % 50 = 0 THEN 'security' END AS o, CASE WHEN contains(l, 'hotfixes') THEN 'bugfix' WHEN contains(l, 'typo') THEN 'docs' END AS e, CASE b.sha % 17 WHEN 0 THEN 'bugfix' WHEN 1 THEN 'feature' END AS i,
    CASE WHEN regexp_extract(message, '\b([A-Z][A-Z0-9]+)-\d+\b', 1) = 'AB' THEN 'platform' END AS p, CASE WHEN regexp_matches(message, '^bump') THEN 'release' END AS r,
    CASE WHEN is_merge OR regexp_matches(l, '^merge (pull request|branch|remote-tracking)') THEN 'merge' WHEN regexp_matches(l, '^revert[ :]') THEN 'revert' WHEN regexp_matches(m, '^[A-Z][A-Z0-9]+-\d+') THEN 'feature' WHEN strlen(l) < 12 AND l <> '' THEN 'chore' END AS f FROM b LEFT JOIN h ON h.sha = b.sha AND n = 1 AND top >= 0.55::FLOAT),
    z AS (SELECT sha, {FOUND_SQL.format(o='o', e='e', i='i', p='p', r='r', s='c', f='f', n="'uncategorized'")} AS category, {FOUND_SQL.format(o="'override'", e="'exact'", i="'external'", p="'external'", r="'regex'", s="'weighted'", f="'fuzzy'", n="'none'")} AS method,
    round(CAST({FOUND_SQL.format(o=1.0, e=1.0, i=0.9, p=0.88, r=0.85, s='least(top::DOUBLE, 0.95)', f="CASE f WHEN 'merge' THEN 0.95 WHEN 'revert' THEN 0.9 WHEN 'feature' THEN 0.6 ELSE 0.4 END", n=0.0)} AS DOUBLE), 6) AS confidence, CASE WHEN o IS NULL THEN nullif(regexp_extract(message, '\b([A-Z][A-Z0-9]*-\d+)\b', 1), '') END AS ticket_id FROM t)
    SELECT *, CASE {TAXONOMY_SQL.format(c='category')} END AS top_level FROM z""", "worded")
def git_classified(t):
    """All tiers over all commits; a fiftieth has a manual category."""
    c = t("worded").withColumns({"repository": F.lit("r"), "issue_type": F.when(F.col("sha") % 17 == 0, " Bug").when(F.col("sha") % 17 == 1, "epic")})
    manual = t("worded").filter("sha % 50 = 0").select("sha", F.lit("r").alias("repository"), F.lit("security").alias("category"))
    found = classify.classified(c, [("hotfixes", "bugfix", 50), ("typo", "docs", 60)], [("^bump", "release", 10)], {"AB": "platform"}, manual)
    return found.select("sha", "category", "method", F.round("confidence", 6).alias("confidence"), "ticket_id", "top_level")


@query("""WITH old AS (SELECT src, dst, kind, 0 AS weight FROM edges), new AS (SELECT l_suppkey + 3 AS src, l_partkey % 280 AS dst, CASE WHEN l_linenumber > 4 THEN 'Calls' END AS kind, l_linenumber AS weight FROM lineitem)
    SELECT * FROM old UNION ALL SELECT src, dst, kind, min(weight) FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.src = new.src AND old.dst = new.dst AND old.kind IS NOT DISTINCT FROM new.kind) GROUP BY src, dst, kind""", "edges")
def graph_united_edges(t):
    old = t("edges").withColumn("weight", F.lit(0))
    new = t("lineitem").select((F.col("l_suppkey") + 3).alias("src"), (F.col("l_partkey") % 280).alias("dst"), F.when(F.col("l_linenumber") > 4, "Calls").alias("kind"), F.col("l_linenumber").cast("int").alias("weight"))
    return review.united(old.select(F.col("src").alias("id")).distinct(), old, new.select(F.col("src").alias("id")), new)[1]

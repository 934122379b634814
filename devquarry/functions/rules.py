"""Rules on messages, notes, paths and patches: attribution, taxonomy, rejection, refactoring and diff filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# -- who wrote a commit ------------------------------------------------------------------------------------

#: The trailer that names a co-author, the tools it may name in the order of preference, and marks of a wholly generated message.
TRAILER = r"(?im)^co-authored-by:\s*(.+)$"
TOOLS = (("claude", r"(?i)\bclaude\b"), ("copilot", r"(?i)\bcopilot\b|GitHub\s+Copilot"))
CURSOR = r"(?i)(@cursor\.sh|\bcursor\b-?)"
GENERATED = (r"(?i)Generated\s+with\s+Claude\s+Code", r"(?im)^X-AI-Tokens-(?:In|Out):\s*\d", r"(?im)^X-AI-Model:\s*\S")


def tools(message: Column) -> Column:
    """The tool that each co-author trailer names, in order; a hyphenated surname is no tool."""

    def tool(value: Column) -> Column:
        mark = F.regexp_extract(value, CURSOR, 1)
        out = F.when((mark != "") & (mark.contains("@") | ~mark.endswith("-")), "cursor")
        for name, pattern in reversed(TOOLS):
            out = F.when(value.rlike(pattern), name).otherwise(out)
        return out

    return F.array_compact(F.transform(F.regexp_extract_all(message, F.lit(TRAILER), F.lit(1)), tool))


def ai_tool(message: Column) -> Column:
    """The tool of the first trailer that names one, else null."""
    return F.get(tools(message), F.lit(0))


def agentic_mode(message: Column) -> Column:
    named = tools(message)
    whole = F.array_contains(named, "claude")
    for pattern in GENERATED:
        whole = whole | message.rlike(pattern)
    return F.when(whole, "full_agentic").when(F.size(named) > 0, "ide_assisted").otherwise("none")


# -- taxonomy and ticket tiers -----------------------------------------------------------------------------

#: Subcategories by their top level.
TAXONOMY = {
    "feature": "feature enhancement new-feature breaking new_feature experiment spike prototype",
    "bugfix": "bugfix bug hotfix security bug_fix",
    "ktlo": "ci build ops release",
    "integrations": "integration integrations api webhook",
    "platform_work": "infra platform performance perf architecture devops cloud monitoring observability database messaging networking storage",
    "content": "docs documentation content localization content-docs translation assets",
    "maintenance": "refactor test tests style cleanup maintenance deps dependencies revert merge chore tech_debt_refactoring rollback config tooling",
    "unknown": "wip uncategorized",
}
#: Issue types with their category, and the confidences of the tiers.
ISSUE_TYPES = {"story": "feature", "bug": "bugfix", "defect": "bugfix", "task": "maintenance", "sub-task": "maintenance", "epic": "feature", "improvement": "feature", "tech debt": "refactor", "spike": "maintenance", "test": "test", "documentation": "documentation"}
ISSUE_TYPE, PROJECT_KEY = 0.90, 0.88


def lookup(value: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[value] if table else F.lit(None).cast("string")


def top_level(subcategory: Column, own: dict[str, str] | None = None) -> Column:
    """The top level of a subcategory, ignoring case; entries of one's own go before the built-in ones; null for others."""
    table = {name: top for top, names in TAXONOMY.items() for name in names.split()} | {k.lower(): v for k, v in (own or {}).items()}
    return lookup(F.lower(subcategory), table)


def issue_type_tier(issue_type: Column) -> Column:
    found = lookup(F.lower(F.trim(issue_type)), ISSUE_TYPES)
    return F.when(found.isNotNull(), F.struct(found.alias("category"), F.lit(ISSUE_TYPE).alias("confidence"), F.lit("external").alias("method")))


def project_tier(message: Column, projects: dict[str, str]) -> Column:
    """The category of the project whose key the message names first."""
    key = F.regexp_extract(message, r"\b([A-Z][A-Z0-9]+)-\d+\b", 1)
    found = lookup(key, {k.upper(): v for k, v in projects.items()})
    return F.when(found.isNotNull(), F.struct(found.alias("category"), F.lit(PROJECT_KEY).alias("confidence"), F.lit("external").alias("method")))


# -- notes -------------------------------------------------------------------------------------------------

#: Patterns of notes that are noise; the least number of tokens and the greatest share of non-letters of others.
NOISE = (
    r"(?i)^tool use:", r"(?i)^tool result:", r"^[0-9a-f]{40}$",
    r"(?i)^(feat|fix|chore|refactor|test|docs|perf|build|ci|style|revert)(\([^)]*\))?:",
    r"^Running .*\.\.\.$", r"^[/~][^\s]*\.(rs|py|ts|js|tsx|jsx|toml|json|md|yaml|yml)$",
)
MIN_TOKENS, MOST_OTHER = 3, 0.80
#: Names of rooms with their synonyms.
ROOMS = {"frontend": "frontend", "backend": "backend", "testing": "testing", "tests": "testing", "test": "testing", "planning": "planning", "documentation": "documentation", "docs": "documentation", "doc": "documentation", "research": "research", "configuration": "configuration", "config": "configuration", "meetings": "meetings", "meeting": "meetings", "general": "general", "": "general"}


def reject_reason(content: Column, enforce_tokens: bool = True) -> Column:
    """noise_pattern, too_short or non_alphabetic, the first that holds; null for what is worth keeping."""
    from . import text

    own = F.trim(content)
    noise = F.lit(False)
    for pattern in NOISE:
        noise = noise | own.rlike(pattern)
    short = text.meaningful_tokens(content) < MIN_TOKENS if enforce_tokens else F.lit(False)
    return F.when(noise, "noise_pattern").when(short, "too_short").when(text.non_alpha_ratio(own) > MOST_OTHER, "non_alphabetic")


def drawer_type(content: Column, fallback: Column | str) -> Column:
    own, lower = F.trim(content), F.lower(F.trim(content))
    event = lower.startswith("tool use:") | lower.startswith("tool result:") | (lower.startswith("running ") & lower.endswith("..."))
    return F.when(own.rlike(NOISE[2]) | own.rlike(NOISE[3]), "commit").when(event, "session_event").otherwise(F.lit(fallback) if isinstance(fallback, str) else fallback)


def parse_room(name: Column) -> Column:
    """The room of a name; an unknown name is a room of its own, in lower case."""
    return F.coalesce(lookup(F.lower(name), ROOMS), F.lower(name))


def unique_sections(prompt: Column) -> Column:
    """A prompt without the sections ("## ") whose trimmed text an earlier one has; what stands before the first section stays."""
    parts = F.split(prompt, r"(?=\n## )")
    whole = prompt.startswith("## ")
    norms = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"^\n+", ""), r"\s+$", ""))
    first = F.when(whole, 0).otherwise(1)
    kept = F.filter(parts, lambda p, i: (i < first) | (F.array_position(F.slice(norms, first + 1, F.size(norms)), F.get(norms, i)) == i - first + 1))
    out = F.array_join(kept, "")
    return F.when(prompt.endswith("\n") & ~out.endswith("\n"), F.concat(out, F.lit("\n"))).otherwise(out)


# -- code and reviews --------------------------------------------------------------------------------------

SEVERITIES = ("low", "medium", "high", "critical")


def refactoring(cyclomatic: Column, grade: Column, smells: Column) -> Column:
    """severity, type and the cyclomatic number after it; null for grade A. Three smells raise the severity by one step."""
    step = F.when(grade == "B", 1).when(grade == "C", 2).when(grade == "D", 3).when(grade == "F", 4)
    step = F.when(step.isNotNull(), F.least(step + (F.size(smells) >= 3).cast("int"), F.lit(4)))
    kinds = {"deep_nesting": "reduce_nesting", "too_many_params": "introduce_parameter_object", "long_function": "extract_method"}
    specific = F.get(F.array_compact(F.transform(smells, lambda s: lookup(s, kinds))), F.lit(0))
    kind = F.coalesce(specific, F.when(cyclomatic >= 10, "extract_method").otherwise("review_for_clarity"))
    after = F.when(kind == "extract_method", F.floor(cyclomatic / 2))
    return F.when(step.isNotNull(), F.struct(F.element_at(F.array(*map(F.lit, SEVERITIES)), step).alias("severity"), kind.alias("type"), after.alias("after")))


def verdict_of_grade(letter: Column) -> Column:
    """The verdict of a letter grade with or without plus and minus."""
    own = F.substring(letter, 1, 1)
    return F.when(own.isin("A", "B"), "APPROVE").when(own == "C", "APPROVE*").when(own == "D", "REQUEST_CHANGES").when(own == "F", "BLOCK")


def coverage_gate(net: Column, new_code: Column, baseline: Column, least_new: float = 80.0, most_drop: float = 2.0, enabled: bool = True) -> Column:
    """Whether a review needs changes: new code below its least percent, or a greater drop than allowed."""
    return (F.coalesce(new_code < least_new, F.lit(False)) | F.coalesce(baseline - net > most_drop, F.lit(False))) & F.lit(enabled)


#: Names, endings and folders of files that a diff review drops, sums up or always keeps.
LOCKFILES = "package-lock.json yarn.lock pnpm-lock.yaml Cargo.lock uv.lock poetry.lock Pipfile.lock Gemfile.lock composer.lock go.sum".split()
SNAPSHOTS = (r"\.snap$", r"\.snapshot\.$", "__snapshots__/", "__fixtures__/")
GENERATED_FILES = (r"_pb2\.py$", r"_pb2_grpc\.py$", r"\.pb\.go$", r"\.generated\.$", r"\.gen\.go$", "dist/", "build/", r"\.next/", "__generated__/", r"(?i)generated/.*\.(java|ts|js)$")
FIXTURES = r"(?i)\.(tsv|csv)$|nls/|messages/|labels/|fixtures/|generated/|fixture.*\.(json|xml|sql)$"
PRESERVED, CREDENTIALS, CREDENTIAL_URL = r"(?i)security/|\.env|secrets/", r"(?i)(secret|token|password|key|dsn|credential)[^/]*$", r"https?://[^@ ]+@"


def file_disposition(path: Column, patch: Column, preserve: tuple[str, ...] = (), suppress: tuple[str, ...] = (), fixture_lines: int = 50) -> Column:
    """kept, summary, or the reason why a file of a diff is dropped; rules in order."""
    any_of = lambda patterns: F.exists(F.array(*map(F.lit, patterns)), lambda p: F.rlike(path, p)) if patterns else F.lit(False)
    lock = F.element_at(F.split(path, "/"), -1).isin(*LOCKFILES)
    return (
        F.when(path.rlike(PRESERVED) | path.rlike(CREDENTIALS) | patch.rlike(CREDENTIAL_URL), "kept").when(any_of(preserve), "kept").when(any_of(suppress), "suppress-pattern")
        .when(lock, "lockfile").when(any_of(SNAPSHOTS), "snapshot").when(any_of(GENERATED_FILES), "generated").when(path.rlike(FIXTURES) & (F.size(F.split(patch, "\n")) > fixture_lines), "summary").otherwise("kept")
    )


#: Patterns of import and comment lines by file ending.
IMPORTS = (
    (r"\.pyi?$", r"^(import\s+[\w.,\s]+|from\s+[\w.]+\s+import\s+.+)$"), (r"\.(jsx?|tsx?|mjs|cjs)$", r"""^(import\s+.*\s+from\s+['"].+['"]|import\s+['"].+['"]|require\s*\(|export\s+\{.*\}\s+from\s+['"].+['"]);?\s*$"""),
    (r"\.java$", r"^import\s+(static\s+)?[\w.]+(\.\*)?\s*;\s*$"), (r"\.go$", r"""^(import\s+("[\w./]+"|\()|"[\w./]+")\s*$"""),
    (r"\.rs$", r"^(use\s+[\w:{},\s*]+(\s+as\s+\w+)?;|extern\s+crate\s+\w+;)\s*$"), (r"\.(c|cpp|cc|cxx|h|hpp)$", r"""^#\s*include\s*[<"].+[>"]"""),
)
COMMENTS = ((r"\.(pyi?|c|cpp|cc|cxx|h|hpp)$", r"^(#.*|/\*.*\*/|//.*)$"), (r"\.(jsx?|tsx?|mjs|cjs|java|go|rs)$", r"^(/\*.*\*/|//.*|\s*\*\s?.*)$"))


def hunk_drop(path: Column, hunk: Column) -> Column:
    """whitespace-only, import-only or comment-only, the first that holds for all changed lines of a hunk; null for what stays."""
    lines = F.split(hunk, "\n")
    changed = F.transform(F.filter(lines, lambda x: x.rlike(r"^[+-]") & ~x.rlike(r"^(\+\+\+|---)")), lambda x: F.trim(F.substring(x, F.lit(2), F.length(x))))
    blank = F.when(F.size(changed) == 0, ~F.exists(lines, lambda x: F.trim(x) != "")).otherwise(F.forall(changed, lambda x: x == ""))

    def all_match(pattern: str) -> Column:
        return F.forall(changed, lambda x: x.rlike(pattern))

    def all_of(table) -> Column:
        out = F.lit(False)
        for ending, pattern in table:
            out = out | (path.rlike(ending) & all_match(pattern))
        return out & (F.size(changed) > 0)

    return F.when(blank, "whitespace-only").when(all_of(IMPORTS), "import-only").when(all_of(COMMENTS), "comment-only")

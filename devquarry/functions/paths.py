"""Rules on file paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions of text and data files; name beginnings that make a file text.
TEXT = "md mdx rst txt adoc asciidoc html htm tex org wiki rtf".split()
DATA = "json jsonl ndjson csv tsv psv yaml yml toml xml xls xlsx ods parquet avro arrow proto graphql sql db sqlite lock".split()
CODE = "rs ts tsx js jsx mjs cjs py go java c cpp cc cxx h hpp cs rb swift kt kts scala ex exs hs ml elm zig nim v sol sh bash zsh fish ps1 lua r jl dart cr clj cljs erl fs fsx sql".split()
TEXT_NAMES = "readme changelog license notice contributing".split()
#: What a score keeps of text, data and code files in each mode; mode all is mode code.
PENALTIES = {"code": (0.1, 0.2, 1.0), "text": (1.0, 0.3, 0.5), "data": (0.3, 1.0, 0.3)}
#: Marks of archived files, each x 0.3.
ARCHIVE_PATHS = ("archive", "deprecated", "legacy", "/old/", "backup", "obsolete", "unused")
ARCHIVE_MARKS = ("#[deprecated]", "@deprecated", "// TODO: remove", "// FIXME: obsolete", "// DEPRECATED", "#[allow(deprecated)]")
LANGUAGES = {"rs": "rust", "py": "python", "ts": "typescript", "js": "javascript", "go": "go", "java": "java", "rb": "ruby", "cs": "csharp", "cpp": "cpp", "c": "c", "kt": "kotlin", "scala": "scala"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def file_class(path: Column) -> Column:
    """text, data, code or other; names like readme are text whatever their extension."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    named = F.exists(F.array(*map(F.lit, TEXT_NAMES)), lambda p: F.startswith(name, p))
    return F.when(extension(path).isin(*TEXT) | named, "text").when(extension(path).isin(*DATA), "data").when(extension(path).isin(*CODE), "code").otherwise("other")


def allowed_in(path: Column, mode: str, left_out: tuple[str, ...] = ()) -> Column:
    """Whether a mode shows the file: code and data by their endings, text by its endings and names, all everything. Code leaves out paths that contain a fragment of ``left_out``."""
    if mode == "all":
        return F.lit(True)
    if mode == "text":
        return file_class(path) == "text"
    own = extension(path).isin(*(CODE if mode == "code" else DATA))
    for fragment in left_out if mode == "code" else ():
        own = own & ~F.contains(F.lower(path), F.lit(fragment.lower()))
    return own


def mode_penalty(path: Column, mode: str) -> Column:
    text, data, code = PENALTIES["code" if mode == "all" else mode]
    kind = file_class(path)
    return F.when(kind == "text", text).when(kind == "data", data).when(kind == "code", code).otherwise(1.0)


def archive_multiplier(path: Column, content: Column, age_days: Column) -> Column:
    """0.3 for the path and for the content each, else 0.7 over a year of age; 0.1 at least."""
    lower = F.lower(path)
    by_path = F.exists(F.array(*map(F.lit, ARCHIVE_PATHS)), lambda k: F.contains(lower, k))
    by_content = F.exists(F.array(*map(F.lit, ARCHIVE_MARKS)), lambda k: F.contains(content, k))
    strong = F.when(by_path, 0.3).otherwise(1.0) * F.when(by_content, 0.3).otherwise(1.0)
    return F.greatest(F.when(strong < 1, strong).when(age_days > 365, 0.7).otherwise(1.0), F.lit(0.1))


def language(path: Column) -> Column:
    out = F.lit("unknown")
    for ext, name in LANGUAGES.items():
        out = F.when(extension(path) == ext, name).otherwise(out)
    return out


#: Manifests and the build system that each tells of.
MANIFESTS = {"cargo.toml": "cargo", "pom.xml": "maven", "build.gradle": "gradle", "build.gradle.kts": "gradle", "package.json": "npm", "pyproject.toml": "pip", "setup.py": "pip", "requirements.txt": "pip", "go.mod": "go-mod"}


def build_system(path: Column) -> Column:
    """What a manifest's name tells; null for other files."""
    name = F.substring_index(F.lower(path), "/", -1)
    return F.coalesce(*[F.when(name == m, b) for m, b in MANIFESTS.items()])


def room(path: Column) -> Column:
    """The room of a path; rules in order."""
    p = F.lower(path)
    return (
        F.when(p.rlike("test|spec"), "testing").when(p.rlike(r"\.(css|scss|html|svelte|tsx|jsx)$|frontend|ui/|components/"), "frontend")
        .when(p.rlike(r"\.github/|^makefile$|^dockerfile$|\.(yml|yaml|toml)$|ci/|deploy"), "configuration").when(p.rlike(r"\.md$|docs/|readme"), "documentation")
        .when(p.rlike(r"\.(rs|py|ts|go|java)$|src/|lib/|backend/"), "backend").otherwise("general")
    )


def glob_regex(pattern: str) -> str:
    """The regular expression of a glob with stars."""
    import re

    return "^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$"


def is_test_file(path: Column) -> Column:
    """A path below tests or __tests__, or a name like x_test.rs, test_x, x.spec.y or x.test.y."""
    return F.lower(path).rlike(r"^tests\z|(^|/)(tests|__tests__)/|_test\.rs\z|(^|/)test_[^/]*\z|(^|/)[^/]*\.(spec|test)\.[^./]*\z")

"""Source trees in mounted folders, walked by tasks with their ignore files, and the manifests of projects."""

from __future__ import annotations

import json
import os
import re
import tomllib
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .delivery import per_repository
from .files import LARGEST, SKIPPED, kept_file, minified

#: Ignore files; a rule of a later one goes before those of an earlier one, wherever they lie.
IGNORE_FILES = (".gitignore", ".ignore")
#: Bytes of file contents that a reading task holds at once.
SLICE = 4 << 20


def ignore_rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """The pattern of an ignore file's line, whether it takes paths back in, and whether it is for folders alone."""
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    body = line[1:] if back else line
    folders = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    body = body.removeprefix("/")
    if not body:
        return None
    out, i = "", 0
    while i < len(body):
        rest = body[i:]
        if rest.startswith("**/") and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif rest == "**" and i and body[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif rest[0] == "*":
            out, i = out + "[^/]*", i + 1
        elif rest[0] == "?":
            out, i = out + "[^/]", i + 1
        elif rest[0] == "[" and (m := re.match(r"\[[!^]?\]?[^\]]*\]", rest)):
            kind = m[0][1:-1]
            turned = kind[:1] in ("!", "^")
            kind = kind[1:] if turned else kind
            out, i = out + ("[^/" if turned else "[") + kind.replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]") + "]", i + m.end()
        else:
            if rest[0] == "\\" and len(rest) > 1:
                i += 1
            out, i = out + re.escape(body[i]), i + 1
    try:
        return re.compile(("" if anchored else "(?:.*/)?") + out), back, folders
    except re.error:
        return None


def rules_in(folder: str, name: str) -> list[tuple[re.Pattern, bool, bool]]:
    try:
        text = Path(folder, name).read_text(errors="replace")
    except OSError:
        return []
    return [r for r in map(ignore_rule, text.splitlines()) if r]


def ignored(path: str, is_folder: bool, levels: list[list[tuple[str, list]]]) -> bool:
    """Whether the last rule that fits ``path`` drops it; levels have rules by folder from the outermost to the innermost, the strongest kind last."""
    for level in reversed(levels):
        for folder, rules in reversed(level):
            below = path[len(folder) + 1 :] if folder else path
            for pattern, back, folders in reversed(rules):
                if (is_folder or not folders) and pattern.fullmatch(below):
                    return not back
    return False


def walk(root: str, ignore: bool = True, skipped: tuple[str, ...] = ()):
    """path below ``root`` and size of each file outside skipped and ignored folders; links to folders are followed once."""
    seen, names = set(), {*SKIPPED, *skipped}
    own = [[("", rules_in(root, ".git/info/exclude"))]] if ignore else []
    todo = [("", [*own, *([] for _ in IGNORE_FILES)] if ignore else [])]
    while todo:
        at, levels = todo.pop()
        folder = os.path.join(root, at)
        real = os.path.realpath(folder)
        if real in seen:
            continue
        seen.add(real)
        if ignore:
            found = [rules_in(folder, n) for n in IGNORE_FILES]
            levels = [levels[0], *([*level, (at, rules)] if rules else level for level, rules in zip(levels[1:], found))]
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            path = f"{at}/{e.name}" if at else e.name
            try:
                is_folder, size = e.is_dir(), e.stat().st_size
            except OSError:
                continue
            if ignored(path, is_folder, levels):
                continue
            if is_folder:
                if e.name not in names:
                    todo.append((path, levels))
            elif e.is_file():
                yield path, size


def source_files(spark: SparkSession, roots: list[str], prose: bool = True, ignore: bool = True, skipped: tuple[str, ...] = ()) -> DataFrame:
    """root, path below it and content of the source files of trees in folders that all machines see.

    A tree is listed by one task, which skips ignored folders without reading them; contents are then read by all tasks, at
    most 4 MB at a time. Bytes that are no UTF-8 are replaced; files that cannot be read, are minified or over 1 MiB go.
    """

    def listed(root: str) -> list[tuple]:
        return [(root, path, size) for path, size in walk(root, ignore, skipped) if size <= LARGEST]

    def contents(batches):
        for pdf in batches:
            held, size = [], 0
            for root, path in zip(pdf["root"], pdf["path"]):
                try:
                    text = Path(root, path).read_text(errors="replace")
                except OSError:
                    continue
                held.append((root, path, text))
                size += len(text)
                if size >= SLICE:
                    yield pd.DataFrame(held, columns=["root", "path", "content"])
                    held, size = [], 0
            yield pd.DataFrame(held, columns=["root", "path", "content"])

    files = per_repository(spark, roots, listed, "root string, path string, size long").filter(kept_file(F.col("path"), prose))
    out = files.repartition("root", "path").select("root", "path").mapInPandas(contents, "root string, path string, content string")
    return out.filter(~minified(F.col("path"), F.col("content")))


# -- manifests ---------------------------------------------------------------------------------------------

#: The files that describe a project, in the order of their weight, and the most entries of a list that are taken from one.
MANIFESTS = ("Cargo.toml", "package.json", "pyproject.toml", "go.mod", "CLAUDE.md", ".git/config")
LISTED = 64


def table(value, *names: str):
    for n in names:
        value = value.get(n) if isinstance(value, dict) else None
    return value


def parsed(read, text: str | None):
    try:
        return read(text) if text else None
    except ValueError:
        return None


def string(value) -> str | None:
    return value if isinstance(value, str) else None


def facts_of(project: str, texts: dict[str, str | None], fallback: str) -> tuple[str, list[tuple[str, str, str, str]]]:
    """A project's name, and (subject, predicate, object, provenance) of what its manifests state.

    Each manifest speaks of the name that it gives itself; the first such name is the project's, else ``fallback``. The
    description and the repository's address are stated only of a project with a name. A broken manifest states nothing.
    """
    out, names = [], []

    def tell(name: str, language: str, source: str, *pairs: tuple[str, object]) -> None:
        names.append(name)
        out.extend((name, p, o, f"bootstrap:{source}") for p, o in (("has_language", language), *pairs) if isinstance(o, str))

    cargo = parsed(tomllib.loads, texts.get("Cargo.toml"))
    if cargo is not None:
        name = string(table(cargo, "package", "name")) or string(table(cargo, "workspace", "package", "name")) or project.rstrip("/").rpartition("/")[2]
        members = table(cargo, "workspace", "members")
        listed = members[:LISTED] if isinstance(members, list) else []
        own = [(p, table(cargo, "package", k)) for p, k in (("has_version", "version"), ("has_edition", "edition"), ("has_rust_version", "rust-version"))]
        tell(name, "Rust", "cargo.toml", *own, *(("has_workspace_member", m) for m in listed))
    package = parsed(json.loads, texts.get("package.json"))
    if string(table(package, "name")) is not None:
        needs = table(package, "dependencies")
        listed = sorted(needs)[:LISTED] if isinstance(needs, dict) else []
        tell(package["name"], "JavaScript", "package.json", ("has_version", package.get("version")), *(("has_dependency", d) for d in listed))
    python = table(parsed(tomllib.loads, texts.get("pyproject.toml")), "project")
    if string(table(python, "name")) is not None:
        tell(python["name"], "Python", "pyproject.toml", ("has_version", python.get("version")), ("requires_python", python.get("requires-python")))
    module = re.search(r"(?m)^[ \t]*module (.*)$", texts.get("go.mod") or "")
    if module and module[1].strip():
        tell(module[1].strip(), "Go", "go.mod", ("has_module_path", module[1].strip()))
    if not names:
        return fallback, out
    title = re.search(r"(?m)^[ \t]*# (.+)$", texts.get("CLAUDE.md") or "")
    if title:
        out.append((names[0], "has_description", title[1].strip(), "bootstrap:claude.md"))
    origin = re.search(r"(?m)^[ \t]*\[remote \"origin\"\][ \t]*\n((?:(?![ \t]*\[).*\n?)*)", texts.get(".git/config") or "")
    url = re.search(r"(?m)^[ \t]*url[ \t]*=[ \t]*(\S.*)$", origin[1]) if origin else None
    if url:
        out.append((names[0], "source_repo", url[1].strip(), "bootstrap:git.config"))
    return names[0], out


def project_facts(manifests: DataFrame, at: Column) -> DataFrame:
    """project, subject, predicate, object and provenance from manifests (project, file, content) read at time ``at``.

    Of several rows of one file of a project the greatest content counts. Every project has its time of reading; a project
    without a manifest that names it is told of by its own id.
    """
    one = manifests.groupBy("project").agg(*[F.max(F.when(F.col("file") == m, F.col("content"))).alias(f"f{i}") for i, m in enumerate(MANIFESTS)])

    def rows(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                texts = {m: v for m, v in zip(MANIFESTS, r[1:]) if isinstance(v, str)}
                subject, found = facts_of(r[0], texts, r[0])
                out += [(r[0], *f) for f in found] + [(r[0], subject, "bootstrapped_at", None, "bootstrap:temporal")]
            yield pd.DataFrame(out, columns=["project", "subject", "predicate", "object", "provenance"])

    told = one.filter("project is not null").mapInPandas(rows, "project string, subject string, predicate string, object string, provenance string")
    return told.withColumn("object", F.coalesce("object", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")))


def read_manifests(spark: SparkSession, roots: list[str]) -> DataFrame:
    """project, file and content of the manifests in folders that all machines see."""

    def read(root: str) -> list[tuple]:
        return [(root, m, p.read_text(errors="replace")) for m in MANIFESTS if (p := Path(root, m)).is_file()]

    return per_repository(spark, roots, read, "project string, file string, content string")

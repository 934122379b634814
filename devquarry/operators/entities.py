"""Entities of source texts, found by their textual forms: comments and strings are set aside first."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages whose types and paths are found, crates that are no outside ones, names that stand for errors, and the least bytes of a string that counts.
PLAIN = ("python", "javascript", "typescript", "go", "java", "c", "cpp")
OWN_CRATES = ("crate", "super", "self", "std", "core", "alloc")
RAISING, UNWRAPPING, LEAST_STRING = ("bail", "anyhow", "panic", "unwrap", "expect"), ("unwrap", "expect"), 11
#: Comments and strings: Rust's raw strings and nested comments to one level, Python's long strings, and the common forms.
RUST_TOKENS = re.compile(r'''(?=[/br"'])(?:(?P<comment>//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*\*/)|(?P<string>b?r(?P<h>#*)".*?"(?P=h)|b?"(?:[^"\\]++|\\.)*+")|(?P<char>'(?:\\.[^']*|[^'\\])'))''', re.S)
PLAIN_TOKENS = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>\"{3}.*?\"{3}|'{3}.*?'{3}|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)""", re.S)
HASH_TOKENS = re.compile(PLAIN_TOKENS.pattern.replace(r"//[^\n]*|/\*.*?\*/", r"\#[^\n]*"), re.S)
BOUND = r"[?'\w][\w:']*(?:<[^<>]*>)?"
CLOSING = {"(": ")", "[": "]", "{": "}"}


def blanks(text: str) -> str:
    """Spaces in place of all but line ends."""
    return "\n".join([" " * len(line) for line in text.split("\n")])


def masked(text: str, tokens: re.Pattern) -> tuple[str, list[tuple[int, int]]]:
    """The text with blanks in place of comments and of what strings hold, and the places of strings."""
    strings = []

    def blank(m: re.Match) -> str:
        if m["string"]:
            strings.append(m.span())
        return blanks(m[0])

    return tokens.sub(blank, text), strings


def closed(code: str, at: int) -> int:
    """The place after the bracket that closes the one at ``at``, or the end."""
    depth, own, other = 0, code[at], CLOSING[code[at]]
    for m in re.compile(f"[{re.escape(own + other)}]").finditer(code, at):
        depth += 1 if m[0] == own else -1
        if not depth:
            return m.end()
    return len(code)


def plain_entities(text: str, language: str) -> list[tuple[str, int, int]]:
    """Kind and place of the types and paths in a text of a language without rules of its own."""
    code, _ = masked(text, HASH_TOKENS if language == "python" else PLAIN_TOKENS)
    out = [("NamedType", *m.span()) for m in re.finditer(r"(?<![\w.:])[A-Z](?=\w*[a-z])\w*(?!\w|::|\.)", code)]
    if language == "cpp":
        out += [("ModulePath", *m.span()) for m in re.finditer(r"(?<![\w:])\w+(?:::\w+)+", code)]
    return out


def rust_entities(text: str) -> list[tuple[str, int, int, str | None]]:
    """Kind, place and, where it is not the text at the place, text of the entities of a Rust source."""
    code, strings = masked(text, RUST_TOKENS)
    out: list[tuple] = [("LiteralString", a, b) for a, b in strings if len(text[a:b].strip('"').encode()) >= LEAST_STRING]
    for m in re.finditer(r"(?m)^(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]*);", code):
        path = text[m.start(1) : m.end(1)].strip()
        first = next((p for p in re.split(r"[:\s{,]", path) if p), "")
        if first and first not in OWN_CRATES:
            out.append(("ExternalCrate", *m.span(), first))
        out.append(("ModulePath", *m.span(), path))
    for m in re.finditer(r"(?<![\w:])\w+(?:::\w+)+", code) if "::" in code else ():
        places = [m.start() + p.end() for p in re.finditer(r"\w+", m[0])]
        out += [("ModulePath", m.start(), end) for end in places[1:]]
    # a line's own blanks alone: across lines, every line of a blanked text would search the rest of it
    uses = re.sub(r"(?m)^[^\S\n]*(?:pub(?:\([^)]*\))?\s+)?use\s[^;]*;", lambda m: blanks(m[0]), code)
    marks = []
    for m in re.finditer(r"#!?\[", code):
        end = closed(code, m.end() - 1)
        out.append(("Annotation", m.start(), end))
        marks.append((m.start(), end))
        uses = uses[: m.start()] + " " * (end - m.start()) + uses[end:]
    out += [("NamedType", *m.span()) for m in re.finditer(r"[A-Z](?<![\w:'!].)(?:(?=\w*[a-z])\w*)?(?!\w|::|!)", uses)]
    out += [("TraitBound", *m.span(1)) for m in re.finditer(rf"(?:<|,|\bwhere)\s*\w+\s*(:\s*{BOUND}(?:\s*\+\s*{BOUND})*)(?=\s*[,>{{=])", uses)]
    for m in re.finditer(r"\b(?:\w+::)*(\w+)!\s*([(\[{])", code) if "!" in code else ():
        if m[1] in RAISING:
            out.append(("ErrorVariant", m.start(), closed(code, m.start(2))))
    for m in re.finditer(r"(?:[\w:]+(?:\([^()]*\))?\??\s*\.\s*)+(\w+)\(", code) if "." in code else ():
        if m[1] in UNWRAPPING:
            out.append(("ErrorVariant", m.start(), closed(code, m.end() - 1)))
    out += [("TypeAlias", *m.span()) for m in re.finditer(r"(?:\bpub(?:\([^)]*\))?\s+)?\btype\s+\w+[^;={]*=[^;]*;", code if "type" in code else "")]
    for m in re.finditer(r"((?:#!?\[[^\]]*\]\s*)+)(?:pub\s+)?(?:async\s+)?fn\s+\w+[^{;]*\{", code):
        if "test" in m[1]:
            body = m.end() - 1
            end = closed(code, body)
            words = [(body + w.start(), body + w.end()) for w in re.finditer(r"(?<!\w)[a-z_]\w*|[A-Z]\w*(?=::)", code[body:end])]
            out += [("TestRelation", a, b) for a, b in words if code[a:b] not in RUST_WORDS]
    return [(*e, None) if len(e) == 3 else e for e in out]


#: Words of the language that are no identifiers.
RUST_WORDS = frozenset(
    "_ as async await bool break char const continue crate dyn else enum extern f32 f64 false fn for i128 i16 i32 i64 i8 if impl in isize let loop match mod move mut pub ref return self static str struct super trait true type u128 u16 u32 u64 u8 unsafe use usize where while".split()
)


def entities(files: DataFrame) -> DataFrame:
    """id, file, kind, text, start, end and line of the entities of sources (file, language, content); places count bytes, lines from 1; a use declaration is one place.

    Rust has types, bounds, paths, errors, attributes, strings, aliases, crates and what tests name; other known languages
    types and, in C++, paths; unknown ones, null and empty sources have none. No parser is at hand: forms stand for syntax
    nodes, so a capital word outside paths counts as a type. The id is the same for equal kind, text and file.
    """

    def rows(batches):
        for pdf in batches:
            out = []
            for file, language, content in zip(pdf["file"], pdf["language"], pdf["content"]):
                if not content:
                    continue
                if language == "rust":
                    found = rust_entities(content)
                else:
                    found = [(*e, None) for e in plain_entities(content, language)] if language in PLAIN else []
                at, size, line = 0, 0, 1
                for kind, a, b, text in sorted(found, key=lambda e: (e[1], -e[2], e[0])):
                    size, line, at = size + len(content[at:a].encode()), line + content.count("\n", at, a), a
                    out.append((file, kind, text or content[a:b], size, size + len(content[a:b].encode()), line))
            yield pd.DataFrame(out, columns=["file", "kind", "text", "start", "end", "line"])

    told = files.select("file", "language", "content").mapInPandas(rows, "file string, kind string, text string, start long, end long, line long")
    return told.select(entity_id(F.col("kind"), F.col("text"), F.col("file")).alias("id"), "*")


def entity_id(kind: Column, text: Column, file: Column) -> Column:
    return F.sha2(F.concat_ws("\0", kind, text, file), 256)


def entities_of(found: DataFrame, kind: str | None = None) -> DataFrame:
    """Entities of one kind, or all, by kind, text and place."""
    kept = found if kind is None else found.filter(F.col("kind") == kind)
    return kept.orderBy("kind", "text", "file", "start")

"""Definitions and branches of one source text, by a table of each language's forms and a stack of scopes.

Comments and the contents of strings are blanked first, so that nothing in them counts. Languages with braces are walked
bracket by bracket, Python by its indents. A branch has the depth of the branching forms around it.
"""

from __future__ import annotations

from bisect import bisect_right

import regex

#: Comments and strings of each family of languages.
C_LIKE = r'//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|"(?:\\(?s:.)|[^"\\])*"'
BLANKED = {
    "rust": r'//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|\bb?r(?P<h>#*)"(?s:.*?)"(?P=h)|b?"(?:\\(?s:.)|[^"\\])*"|\bb?\'(?:\\[^\']+|[^\\\'\n])\'',
    "python": r'#[^\n]*|(?:\b[rRbBfFuU]{1,2})?(?P<q>"""|\'\'\')(?s:(?:\\.|.)*?)(?P=q)|"(?:\\(?s:.)|[^"\\\n])*"|\'(?:\\(?s:.)|[^\'\\\n])*\'',
    "javascript": C_LIKE + r"|'(?:\\(?s:.)|[^'\\\n])*'|`(?:\\(?s:.)|[^`\\])*`",
    "java": r'"""(?s:.*?)"""|' + C_LIKE + r"|'(?:\\[^']+|[^\\'\n])'",
    "c": C_LIKE + r"|'(?:\\[^']+|[^\\'\n])'",
    "go": C_LIKE + r"|`[^`]*`|'(?:\\[^']+|[^\\'\n])'",
}
BLANKED["typescript"], BLANKED["cpp"] = BLANKED["javascript"], BLANKED["c"]
#: Definitions: the form of a head whose name is the group n, its kind, and whether a body is a function's.
NAME = r"(?P<n>[\p{L}_$][\w$]*)"
C_NOT = r"(?!if\b|for\b|while\b|switch\b|return\b|else\b|catch\b|sizeof\b|new\b|throw\b|do\b)"
HEADS = {
    "rust": [
        (rf"\bfn\s+{NAME}", "function", True), (r"\b(?<!->\s*|[(:,=&<]\s*)impl\b(?P<g>\s*<(?:[^<>]|<[^<>]*>)*>)?\s*(?:(?P<base>[^{;]+?)\s+for\s+)?(?P<n>[^{;]+?)\s*(?=\bwhere\b|\{)", "impl", False),
        (rf"\bstruct\s+{NAME}", "class", False), (rf"\btrait\s+{NAME}", "trait", False), (rf"\benum\s+{NAME}", "enum", False), (rf"\bmod\s+{NAME}", "module", False),
        (rf"\bpub(?:\s*\([^)]*\))?\s+(?:const|static)(?:\s+mut)?\s+(?!fn\b){NAME}", "constant", False),
    ],
    "javascript": [(rf"(?<!=\s*|\(\s*|,\s*|return\s+|:\s*)\bfunction\b\s*\*?\s*{NAME}", "function", True), (rf"\bclass\s+{NAME}(?:\s+extends\s+(?P<base>[\w.$]+))?", "class", False), (rf"(?m)^[ \t]*(?:(?:public|private|protected|static|async|get|set|readonly|override)\s+)*\*?{C_NOT}(?!function\b){NAME}\s*(?:<[^<>{{}}]*>)?\s*(?=\([^;{{}}]*\)\s*(?::[^;={{}}]+)?\{{)", "method", True)],
    "go": [(rf"(?m)^func\s+{NAME}", "function", True), (rf"(?m)^func\s+\([^)]*\)\s*{NAME}", "method", True), (rf"(?m)^type\s+{NAME}", "class", False)],
    "java": [(rf"\bclass\s+{NAME}(?:\s*<[^{{]*?>)?(?:\s+extends\s+(?P<base>[\w.]+))?", "class", False), (rf"(?<!@)\binterface\s+{NAME}", "trait", False), (rf"(?m)(?:^|(?<=[{{}};]))[ \t]*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+|@\w+\s+)*(?!return\b|new\b|throw\b|else\b)[\w.<>\[\], ?]+?\s+{C_NOT}{NAME}\s*(?=\([^;{{}}()]*\)\s*(?:throws\s+[\w., ]+)?[{{;])", "method", True)],
    "c": [(rf"\bstruct\s+{NAME}(?=\s*\{{)", "class", False), (rf"(?m)^(?!\s*(?:return|else|typedef|struct\s+\w+\s*\{{))[ \t]*[\w][\w\s*&:<>,~]*?[\s*&]{C_NOT}(?:\w+::)?{NAME}\s*(?=\([^;{{}}]*\)[\w\s]*\{{)", "function", True)],
    "python": [(rf"(?m)^(?P<i>[ \t]*)(?:async\s+)?def\s+{NAME}", "function", True), (rf"(?m)^(?P<i>[ \t]*)class\s+{NAME}\s*(?:\((?P<base>[^)]*)\))?", "class", False)],
}
HEADS["typescript"] = HEADS["javascript"]
HEADS["cpp"] = [*HEADS["c"], (rf"(?<!enum\s+)\bclass\s+{NAME}(?=[^;{{}}()]*\{{)", "class", False)]
FOUND = {language: [(regex.compile(form), *rest) for form, *rest in heads] for language, heads in HEADS.items()}
LINE_END = regex.compile("\n")
#: What counts as a branch. Forms that branch and nest, forms that nest alone, and cases of a switch: whether the first counts, and whether each nests.
FORMS = {
    "rust": ("if while loop for", "match", ("=>", False, False)), "javascript": ("if while do for catch", "switch", ("case", False, False)),
    "java": ("if for while do catch", "", ("case default", True, False)), "go": ("if for switch select", "", ("case", True, True)),
    "c": ("if for while do", "", ("case default", True, True)), "cpp": ("if for while do catch", "", ("case default", True, True)),
}
FORMS["typescript"] = FORMS["javascript"]
TOKEN = regex.compile(r"(?P<closure>(?=\|)(?<=(?:[(,={;&:]|=>|\bmove|\breturn)\s*)\|[^|\n]*\||(?=\|\|)(?<=(?:[(,={;]|\bmove)\s*)\|\|)|=>|&&|\|\||\?\.|\?\?|[{}()\[\];,?]|[\p{L}_]\w*")


def blank(text: str, language: str) -> str:
    """The text with comments and strings as spaces, line ends kept."""
    return regex.sub(BLANKED[language], lambda m: "\n".join([" " * len(line) for line in m[0].split("\n")]), text)


def walked(code: str, language: str) -> tuple[list[tuple[int, int, int]], dict[int, int]]:
    """(place, depth, depth inside) of the branches and nesting forms of a text with braces, and the place of each bracket's partner. Depth is -1 - depth where a form nests but is no branch."""
    branching, nesting, (cases, first_counts, case_nests) = FORMS[language]
    branching, nesting, cases = set(branching.split()), set(nesting.split()), set(cases.split())
    switches = nesting | ({"switch", "select"} & (branching | {"switch"}))
    tokens = []
    for m in TOKEN.finditer(code):
        t = m[0]
        if t[0] == "|" and m["closure"]:
            if language != "rust" and t != "||":
                continue
            t = "|" if language == "rust" else t
        tokens.append((m.start(), t))
    stack: list[dict] = []  # brackets, and forms that nest: form, whether a body is open, whether an else has begun
    out, partner = [], {}

    def depth() -> int:
        return sum("form" in s and not s.get("quiet") for s in stack)

    def ended(k: int) -> None:
        """A statement is over: forms on top whose body it was end too, unless their else follows."""
        after = tokens[k + 1][1] if k + 1 < len(tokens) else ""
        while stack and "form" in stack[-1]:
            top = stack[-1]
            if top["form"] == "case" or (top["form"] == "if" and after == "else" and not top["else"]) or (top["form"] == "do" and after == "while"):
                return
            stack.pop()

    told = {*"([{)]};,|?", "else", "switch", "=>", "function", "&&", "||", *branching, *nesting, *cases}
    for k, (at, t) in enumerate(tokens):
        if t not in told:
            continue
        before = tokens[k - 1][1] if k else ""
        if t in "([{":
            owner = next((s for s in reversed(stack) if "form" in s), None) if t == "{" and stack and "form" in stack[-1] else None
            stack.append({"open": t, "at": at, "owner": owner, "arms": 0})
        elif t in ")]}":
            while stack and "form" in stack[-1]:
                stack.pop()
            if stack:
                held = stack.pop()
                partner[held["at"]] = at
                if t == "}" and held["owner"] is not None:
                    ended(k)
        elif t in ";,":
            if t == ";" or (stack and stack[-1].get("form") in ("closure", "=>")):
                if stack and "form" in stack[-1] and stack[-1]["form"] != "case":
                    ended(k)
        elif t == "else":
            if stack and stack[-1].get("form") == "if":
                stack[-1]["else"] = True
                if language in ("rust", "javascript", "typescript") and tokens[k + 1 : k + 2] and tokens[k + 1][1] == "if":
                    out.append((at, depth(), depth()))
        elif t in cases and stack:
            held = next((s for s in reversed(stack) if "open" in s), None)
            inside = held is not None and held["open"] == "{" and held["owner"] is not None and held["owner"]["form"] in switches | {"switch", "select", "match"}
            if inside:
                if case_nests and stack[-1].get("form") == "case":
                    stack.pop()
                held["arms"] += 1
                if first_counts or held["arms"] > 1:
                    out.append((at, depth(), depth() + case_nests))
                if case_nests:
                    stack.append({"form": "case", "else": False})
        elif t in branching or t in nesting or (t == "switch" and language in ("java", "c", "cpp")):
            if t == "while" and stack and stack[-1].get("form") == "do":
                stack[-1]["form"] = "while"  # the end of do
                continue
            if t == "for" and language == "rust" and (before in ("impl", ">") or tokens[k + 1 : k + 2] == [(at + 3, "<")] or not regex.match(r"for\s+[^{;]*?\bin\b", code[at : at + 400])):
                continue
            counted = t in branching
            nests = counted or t in nesting
            if counted:
                out.append((at, depth(), depth() + 1))
            elif nests:
                out.append((at, -1 - depth(), depth() + 1))
            stack.append({"form": t, "else": False, "quiet": not nests})
        elif t == "|" or (t == "=>" and language in ("javascript", "typescript")) or (t == "function" and language in ("javascript", "typescript") and before in ("(", ",", "return", "=>", "[", "") and k):
            out.append((at, depth(), depth() + 1))
            stack.append({"form": "closure" if t != "=>" else "=>", "else": False})
        elif t in ("&&", "||"):
            out.append((at, depth(), depth()))
        elif t == "?":
            after = code[at + 1 : at + 2]
            ternary = language in ("javascript", "typescript", "java", "c", "cpp") and after not in (":", ")", ",", ".", ";", ">")
            if ternary or (language == "rust" and regex.search(r"[\w)\]>]\s*\Z", code[max(at - 8, 0) : at])):
                out.append((at, depth(), depth()))
    return out, partner


def indented(code: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(place, depth, depth inside) of the branches of a Python text, and (place, indent) of its logical lines."""
    out, lines, stack, at, level = [], [], [], 0, 0
    for line in code.splitlines(keepends=True):
        body = line.strip()
        if level <= 0 and body:
            indent = len(line) - len(line.lstrip(" \t"))
            lines.append((at, indent))
            word = regex.match(r"(?:async\s+)?(\w*)", body)[1]
            while stack and (stack[-1][0] > indent or (stack[-1][0] == indent and not (word in ("elif", "else") and stack[-1][1] in ("if", "for", "while") or word == "else"))):
                stack.pop()
            while word in ("elif", "else") and len(stack) > 1 and stack[-1][0] == indent and stack[-1][1] == "elif":
                stack.pop()
            if word in ("if", "elif", "for", "while", "except", "with"):
                out.append((at + indent, len(stack), len(stack) + 1))
                stack.append((indent, word))
        inner = len(stack)
        for m in regex.finditer(r"\b(?:and|or|if)\b", line):
            if m[0] != "if" or (m.start() > len(line) - len(line.lstrip()) and regex.search(r"\belse\b", line[m.end() :])):
                out.append((at + m.start(), inner, inner + (m[0] == "if")))
        level += sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}")
        at += len(line)
    return out, lines


def parameters(code: str, at: int) -> int:
    """The number of parameters of the list that begins at or after ``at``; receivers don't count."""
    begin = code.find("(", at)
    if begin < 0:
        return 0
    level, parts, own = 0, 0, ""
    for c in code[begin + 1 :]:
        if c in "([{<":
            level += 1
        elif c in ")]}>":
            level -= 1
            if level < 0 and c == ")":
                break
        if c == "," and level == 0:
            parts, own = parts + (own.strip() != ""), ""
        else:
            own += c
    receiver = regex.match(r"\s*(?:&\s*(?:'\w+\s+)?)?(?:mut\s+)?(?:self|cls)\b", code[begin + 1 :])
    return max(parts + (own.strip() != "") - bool(receiver), 0)


def definitions(text: str, language: str) -> tuple[list[dict], tuple[int, int, int]]:
    """The definitions of a text in order, and its own (cyclomatic, cognitive, nesting).

    A definition inside a function's body belongs to that function and is none of its own.
    """
    code = blank(text, language)
    if language == "python":
        branches, lines = indented(code)
        starts = [a for a, _ in lines]
    else:
        branches, partner = walked(code, language)
    ends = [m.start() for m in LINE_END.finditer(text)]

    def measured(a: int, b: int) -> tuple[int, int, int]:
        own = [x for x in branches if a <= x[0] < b]
        base = min((x[1] if x[1] >= 0 else -1 - x[1] for x in own), default=0)
        counted = [x[1] - base for x in own if x[1] >= 0]
        return 1 + len(counted), sum(d + 1 for d in counted), max((x[2] - base for x in own), default=0)

    found = []
    for form, kind, function in FOUND[language]:
        for m in form.finditer(code):
            head = m.start() + len(m[0]) - len(m[0].lstrip())
            if language == "python":
                k = bisect_right(starts, m.start("i")) - 1
                if k < 0 or starts[k] != m.start("i"):
                    continue
                later = next((a for a, indent in lines[k + 1 :] if indent <= len(m["i"])), len(code))
                end = m.start() + len(code[m.start() : later].rstrip())
            else:
                i = m.end()
                while i < len(code) and code[i] not in "{;":
                    i = partner.get(i, i) + 1 if code[i] in "([" else i + 1
                end = (partner.get(i, len(code) - 1) if i < len(code) and code[i] == "{" and kind != "constant" else min(i, len(code) - 1)) + 1
                if kind == "constant":
                    while end < len(code) and code[end - 1] != ";":
                        end = partner.get(end - 1, end - 1) + 2 if code[end - 1] == "{" else end + 1
            base = m.groupdict().get("base")
            own = text[m.start("base") : m.end("base")] if base else ""
            found.append({"kind": kind, "name": text[m.start("n") : m.end("n")].strip(), "at": head, "end": end, "function": function, "head": m.end("n"), "bases": [b.strip() for b in own.split(",") if b.strip() and "=" not in b]})
    found.sort(key=lambda d: (d["at"], -d["end"]))
    out, around = [], []
    for d in found:
        while around and around[-1]["end"] <= d["at"]:
            around.pop()
        if any(p["function"] for p in around) or (out and out[-1]["at"] == d["at"]):
            continue
        parent = around[-1] if around else None
        owner = next((p for p in reversed(around) if p["kind"] in ("impl", "trait", "class")), None)
        d["kind"] = "method" if d["kind"] == "function" and owner and language in ("rust", "python") else d["kind"]
        qualified = f"{owner['name']}::{d['name']}" if language == "rust" and d["kind"] == "method" and owner["kind"] == "impl" else d["name"]
        around.append(d)
        size = measured(d["at"], d["end"])
        out.append(d | {
            "qualified": qualified, "parent": parent["name"] if parent else None, "start_line": bisect_right(ends, d["at"] - 1) + 1, "end_line": bisect_right(ends, d["end"] - 2) + 1,
            "parameters": parameters(code, d["head"]) if d["function"] else 0, "cyclomatic": size[0], "cognitive": size[1], "nesting": size[2],
        })
    return out, measured(0, len(code) + 1)

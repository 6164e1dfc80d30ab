"""Source files as symbols, imports and calls. Python goes by its own parser; brace languages by a scanner of declarations.

A file that can't be parsed has parse_error and no symbols, never an exception. The brace scanner masks comments and
strings and follows braces; it is an approximation of a full parser.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field
from itertools import groupby

# Languages by file ending, and those of which only the presence is told.
LANGUAGES = {
    ".py": "python",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".java": "java",
    ".c": "c",
    ".h": "cpp",
    ".cc": "cpp",
    ".cpp": "cpp",
    ".cxx": "cpp",
    ".hpp": "cpp",
    ".hh": "cpp",
    ".hxx": "cpp",
    ".toml": "toml",
    ".html": "html",
    ".css": "css",
}
BARE = frozenset({"toml", "html", "css"})
#: Endings beside those.
LANGUAGES |= {".pyi": "python", ".mts": "typescript", ".cts": "typescript", ".ipynb": "notebook"}
LONGEST_UNIT, WINDOW_LINES = 120, 80
# How lines of comments begin.
COMMENT_STARTS = ("#", "//", "/*", "*", "*/", "--", ";")


@dataclass
class Skeleton:
    """What is known of a file. symbols: (kind, name, parent, signature, doc, line, end_line); calls: (name, parent, line)."""

    language: str
    imports: list[str] = field(default_factory=list)
    deferred: list[str] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)
    symbols: list[tuple] = field(default_factory=list)
    calls: list[tuple] = field(default_factory=list)
    reexports: list[tuple] = field(default_factory=list)
    dunder_all: list[str] = field(default_factory=list)
    doc: str = ""
    has_main: bool = False
    parse_error: bool = False


# How lines of a licence begin, and characters of lines that only rule off.
LICENCE = re.compile(r"^(SPDX-[\w-]+:|Copyright\b|All rights reserved)", re.I)
RULES = "-=_*#~+ "


def clean_comment(block: str) -> str:
    """A comment's lines but for those of a licence, rules and blanks."""
    return "\n".join(x for x in block.splitlines() if x.strip(RULES + "\t") and not LICENCE.match(x.strip())).strip()


def language_for(path: str) -> str | None:
    return next((v for k, v in LANGUAGES.items() if path.lower().endswith(k)), None)


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        left = _dotted(node.value)
        return f"{left}.{node.attr}" if left else ""
    return ""


def _python(text: str) -> Skeleton:
    out = Skeleton("python")
    tree = ast.parse(text)
    lines = text.split("\n")
    out.doc = (ast.get_docstring(tree) or "").split("\n")[0]

    def bring(node: ast.AST, into: list[str]) -> None:
        if isinstance(node, ast.Import):
            for a in node.names:
                into.append(a.name)
                out.aliases[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
        elif isinstance(node, ast.ImportFrom):
            base = "." * node.level + (node.module or "")
            for a in node.names:
                whole = base + ("" if base.endswith(".") or not base else ".") + a.name
                into.append(whole)
                out.aliases[a.asname or a.name] = whole

    def declare(node: ast.AST, parent: str) -> None:
        kind = "class" if isinstance(node, ast.ClassDef) else "method" if parent else "function"
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        end_head = node.body[0].lineno - 1 if node.body and node.body[0].lineno > node.lineno else node.lineno
        signature = re.sub(r"\s+", " ", " ".join(lines[node.lineno - 1 : end_head])).split('"""')[0].strip().rstrip(":")
        out.symbols.append((kind, node.name, parent, signature, (ast.get_docstring(node) or "").split("\n")[0], first, node.end_lineno))

    for node in tree.body:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            bring(node, out.imports)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            declare(node, "")
        elif isinstance(node, ast.ClassDef):
            declare(node, "")
            for inner in node.body:
                if isinstance(inner, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                    declare(inner, node.name)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(target, ast.Name):
                    if target.id == "__all__" and isinstance(node.value, (ast.List, ast.Tuple)):
                        out.dunder_all = [e.value for e in node.value.elts if isinstance(e, ast.Constant)]
                    elif target.id.isupper():
                        out.symbols.append(("constant", target.id, "", lines[node.lineno - 1].strip(), "", node.lineno, node.end_lineno))
        elif isinstance(node, ast.If) and "__main__" in ast.dump(node.test):
            out.has_main = True
        container = node.name if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)) else ""
        for inner in ast.walk(node):
            if isinstance(inner, ast.Call) and (name := _dotted(inner.func)):
                out.calls.append((name, container, inner.lineno))
            elif inner is not node and isinstance(inner, (ast.Import, ast.ImportFrom)):
                bring(inner, out.deferred)
    top = {s[1] for s in out.symbols if not s[2]}
    out.reexports = [(n, out.aliases[n]) for n in out.dunder_all if n not in top and n in out.aliases]
    return out


def masked(text: str) -> str:
    """Comments and strings blanked, line ends kept."""
    pattern = r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def _close(code: str, at: int) -> int:
    """Position after the brace that closes the one at a position."""
    level = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        level += 1 if m[0] == "{" else -1
        if not level:
            return m.end()
    return len(code)


TYPES = {
    "typescript": r"(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?P<k>class|interface|enum|namespace)\s+(?P<n>\w+)[^{;]*\{",
    "java": r"(?:(?:public|protected|private|static|final|abstract|sealed)\s+)*(?P<k>class|interface|enum|record)\s+(?P<n>\w+)[^{;]*\{",
    "c": r"(?:typedef\s+)?(?P<k>struct|class|enum(?:\s+class)?|union)\s+(?P<n>\w+)[^{;()]*\{"}
FUNCTIONS = {
    "typescript": r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(?P<n>\w+)\s*(?:<[^>]*>)?\([^{;]*\{"
                  r"|(?:export\s+)?(?:const|let|var)\s+(?P<a>\w+)[^=\n]*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)[^=\n]*=>",
    "java": r"(?!)", "c": r"(?m)^[\w*&<>:,\s~]*?\b(?P<n>~?\w+(?:::~?\w+)*)\s*\([^;{}()]*(?:\([^)]*\)[^;{}()]*)*\)\s*(?:const|noexcept|override|\s)*(?::[^{;]*)?(?:\{|;)"}
METHODS = {
    "typescript": r"(?m)^\s*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?P<n>[\w#]+)\s*(?:<[^>]*>)?\([^;{}]*\)[^;{}]*\{",
    "java": r"(?m)^\s*(?:@\w+(?:\([^)]*\))?\s*)*(?:(?:public|protected|private|static|final|abstract|synchronized|default|native)\s+)*(?:<[^>]*>\s*)?(?:[\w.<>\[\],?]+\s+)?(?P<n>\w+)\s*\([^;{}]*\)[^;{}]*[{;]",
    "c": r"(?m)^\s*[\w*&<>:,\s~]*?\b(?P<n>~?\w+)\s*\([^;{}]*\)\s*(?:const|noexcept|override|=\s*\w+|\s)*[{;]"}
WORDS = frozenset("if for while switch return catch else do new throw sizeof function super this await typeof case".split())


def _braced(text: str, language: str) -> Skeleton:
    family = {"javascript": "typescript", "cpp": "c"}.get(language, language)
    out, code = Skeleton(language), masked(text)
    line = lambda at: code.count("\n", 0, at) + 1
    source = text.split("\n")

    def doc_above(n: int) -> str:
        block = []
        for row in reversed(source[: n - 1]):
            if not row.strip().startswith(("//", "/*", "*", "@")):
                break
            block.insert(0, row.strip().strip("/*").strip())
        return next((b for b in clean_comment("\n".join(block)).split("\n") if b and not b.startswith("@")), "")

    def add(kind: str, m: re.Match, parent: str, name: str) -> tuple[int, int]:
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        brace = code.find("{", m.end() - 1) if m[0].rstrip().endswith("{") or "=>" in m[0] else -1
        end = _close(code, brace) if brace >= 0 and brace - m.end() < 4 else m.end()
        first = line(start)
        signature = re.sub(r"\s+", " ", text[start : m.end()]).strip().rstrip("{;").strip()
        out.symbols.append((kind, name, parent, signature, doc_above(first), first, line(max(start, end - 1))))
        return brace, end

    spans: list[tuple[int, int, str]] = []
    for m in re.finditer(TYPES[family], code):
        outer = next((n for a, b, n in reversed(spans) if a < m.start() < b), "")
        kind = "class" if family != "c" or m["k"].startswith("class") else "type" if m["k"] != "struct" else "class"
        brace, end = add(kind if m["k"] not in ("interface", "enum", "namespace") or family == "java" else "type", m, outer, m["n"])
        spans.append((brace, end, m["n"]))
    for m in re.finditer(METHODS[family], code):
        inside = [s for s in spans if s[0] < m.start("n") < s[1]]
        if inside and m["n"] not in WORDS and code.count("{", inside[-1][0], m.start("n")) - code.count("}", inside[-1][0], m.start("n")) == 1:
            add("method", m, inside[-1][2], m["n"])
    for m in re.finditer(FUNCTIONS[family], code):
        name = m["n"] or (m["a"] if "a" in m.re.groupindex else None)
        at = m.start("n") if m["n"] else m.start()
        if name and name not in WORDS and not any(a < at < b for a, b, _ in spans) and code.count("{", 0, at) == code.count("}", 0, at):
            parent, _, leaf = name.rpartition("::")
            if not any(s[1] == leaf and s[2] == parent for s in out.symbols):
                add("method" if parent else "function", m, parent, leaf)
    if family == "typescript":
        for m in re.finditer(r"(?m)^\s*(import|export)\s+(?:type\s+)?(?:([^'\"\n;]*?)\s+from\s+)?['\"]([^'\"]+)['\"]", text):
            out.imports.append(m[3])
            for a, b in re.findall(r"(\w+)(?:\s+as\s+(\w+))?", re.sub(r"[{}]", " ", m[2] or "")):
                if m[1] == "import" and a not in ("type", "as"):
                    out.aliases[b or a] = m[3]
                elif m[1] == "export" and a not in ("type", "as"):
                    out.reexports.append((b or a, m[3]))
        out.imports += re.findall(r"require\(\s*['\"]([^'\"]+)['\"]", text)
    elif family == "java":
        for m in re.finditer(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", code):
            out.imports.append(m[1])
            out.aliases[m[1].rsplit(".", 1)[-1]] = m[1]
        out.has_main = bool(re.search(r"public\s+static\s+void\s+main\s*\(", code))
    else:
        out.imports = [f"{a}{b}" for a, b in re.findall(r"(?m)^\s*#\s*include\s*([<\"])([^>\"\n]+)", text)]
    tops = sorted((s for s in out.symbols), key=lambda s: (s[5], -s[6]))
    for m in re.finditer(r"\b([\w$]+(?:(?:\.|::|->)\w+)*)\s*\(", code):
        n = line(m.start())
        if m[1].split(".")[0] not in WORDS and not any(s[5] == n and s[1] == re.split(r"\.|::|->", m[1])[-1] for s in tops):
            owner = [s for s in tops if s[5] <= n <= s[6]]
            out.calls.append((re.sub(r"::|->", ".", m[1]), owner[-1][1] if owner else "", n))
    out.symbols.sort(key=lambda s: (s[5], -s[6]))
    return out


def skeleton(text: str | None, language: str | None) -> Skeleton:
    """The skeleton of a source text; parse_error on any failure."""
    if language is None or language in BARE:
        return Skeleton(language or "")
    try:
        if language == "notebook":
            from gleanery.functions.markdown import notebook_cells

            found = notebook_cells(text)
            return Skeleton(language, parse_error=True) if found is None else _python(found[1])
        return _python(text or "") if language == "python" else _braced(text or "", language)
    except (SyntaxError, ValueError, RecursionError, IndexError):
        return Skeleton(language, parse_error=True)


def units(path: str, text: str | None) -> list[tuple[int, str, str]]:
    """(offset, text, title): runs of lines that one innermost symbol owns; long runs in windows.

    A run of nothing but comments and blank lines goes with the symbol below it.
    """
    lines = (text or "").splitlines(keepends=True)
    owner = [""] * len(lines)
    for _, name, parent, _, _, first, last in sorted(skeleton(text, language_for(path)).symbols, key=lambda s: (s[5], -s[6])):
        owner[first - 1 : min(last, len(lines))] = [f"{parent}.{name}" if parent else name] * (min(last, len(lines)) - first + 1)
    runs = [(title, [line for _, line in part]) for title, part in groupby(zip(owner, lines, strict=True), key=lambda x: x[0])]
    out, held, offset = [], [], 0
    for (title, part), (following, _) in zip(runs, [*runs[1:], ("", [])], strict=True):
        held += part
        if following and all(not x.strip() or x.strip().startswith(COMMENT_STARTS) for x in part):
            continue
        size = len(held) if len(held) <= LONGEST_UNIT else WINDOW_LINES
        for at in range(0, len(held), size):
            piece = "".join(held[at : at + size])
            if piece.strip():
                out.append((offset, piece, title))
            offset += len(piece)
        held = []
    return out


def supertypes(signature: str) -> list[str]:
    """The last names of the types that a class signature extends or implements."""
    text = re.sub(r"/\*.*?\*/|//[^\n]*", " ", signature, flags=re.S)
    if m := re.match(r"\s*class\s+\w+\s*\((.*)\)\s*:?\s*$", text, re.S):
        parts = m[1]
    elif m := re.search(r"\bclass\s+\w+[^:{]*:(?!:)\s*([^{]*)", text):
        parts = re.sub(r"\b(public|private|protected|virtual)\b", " ", m[1])
    else:
        parts = ",".join(re.findall(r"\b(?:extends|implements)\s+(.*?)(?=\bextends\b|\bimplements\b|\{|$)", text, re.S))
    while re.search(r"<[^<>]*>|\[[^\[\]]*\]", parts):
        parts = re.sub(r"<[^<>]*>|\[[^\[\]]*\]", "", parts)
    names = [re.split(r"\.|::", p.strip())[-1].strip() for p in parts.split(",") if "=" not in p and "(" not in p]
    return [n for n in dict.fromkeys(names) if re.fullmatch(r"\w+", n)]


def skeleton_diff(old: Skeleton, new: Skeleton) -> list[str]:
    """What changed in shape: + and - for imports (deferred ones count) and for symbols, then symbols of another signature."""

    def named(kind: str, name: str, parent: str) -> str:
        return f"{kind} {parent}.{name}" if parent else f"{kind} {name}"

    def changes(before, after, label) -> list[str]:
        return [f"{sign} {label(x)}" for sign, some in (("+", after - before), ("-", before - after)) for x in sorted(some)]

    a, b = ({s[:3]: s[3] for s in k.symbols} for k in (old, new))
    out = changes({*old.imports, *old.deferred}, {*new.imports, *new.deferred}, lambda x: f"import {x}")
    out += changes(set(a), set(b), lambda x: named(*x))
    return out + [f"signature changed: {named('', *x[1:]).strip()}" for x in sorted(set(a) & set(b)) if a[x] != b[x]]

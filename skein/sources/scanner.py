"""Definitions, imports and calls of source files, without a grammar.

Python goes through the standard library's own parser. For all other languages a lexer blanks comments and literals
(but not code inside them), patterns of a profile find definitions, brackets or indentation give their extents, and
what stands around a name tells calls from declarations, constructors, annotations and patterns. What a grammar would
need types or macros for stays approximate."""

from __future__ import annotations

import ast
import re
from bisect import bisect_left
from dataclasses import dataclass, replace
from itertools import accumulate

from skein.sources import lexer

NAME = r"[A-Za-z_$][\w$]*"
#: Words of each language that a bracket may follow without being called.
RESERVED = {
    "javascript": "if for while switch catch return function typeof instanceof in of new delete void throw await yield do else case super import with",
    "java": "if for while switch catch return new throw synchronized try do else case super this instanceof assert yield",
    "c": "if for while switch int char void float double long short unsigned signed return sizeof do else case goto typeof alignof _Alignof _Generic __attribute__ defined",
    "cpp": "if for while switch catch return sizeof do else case goto typeid decltype alignof new delete throw noexcept static_assert operator int char void float double long short unsigned signed bool auto co_await co_return co_yield static_cast dynamic_cast const_cast reinterpret_cast alignas requires explicit defined",
    "csharp": "if for foreach while switch catch return new throw using lock fixed checked unchecked typeof sizeof default nameof when in is as do else case base this await yield stackalloc",
    "go": "if for switch select func return go defer case range chan map struct interface type var const import package else",
    "rust": "if for while loop match return fn in as let mut pub where impl dyn move else unsafe ref use Fn FnMut FnOnce",
    "php": "if for foreach while switch match catch return function fn new throw echo print isset unset empty list array declare exit die include require include_once require_once and or xor elseif else case use static clone instanceof yield",
    "kotlin": "if for while when catch return throw fun in is as do else constructor init by where super this object class",
    "swift": "if for while switch guard catch return throw func in is as do else case init subscript where let var self super some any",
    "dart": "if for while switch catch return throw in is as do else case assert super this await yield new const on rethrow",
    "sql": "create replace function procedure returns return table values in and or not exists as select from where on using over with when then else case varchar numeric decimal char into references check primary key unique foreign",
    "scala": "if for while match catch return throw def in do else case yield new with extends this super type val var given using",
    "powershell": "if for foreach while switch catch return throw function filter param begin process end else elseif try finally class enum do until default hidden static using trap data dynamicparam in exit break continue import-module",
}
RESERVED |= dict.fromkeys(("typescript", "tsx"), RESERVED["javascript"] + " keyof satisfies as")
RESERVED = {k: frozenset(v.split()) for k, v in RESERVED.items()}
#: Where a word before a name makes it a declaration, and where NAME(...) { is a constructor's or method's head.
TYPED = frozenset(("java", "c", "cpp", "csharp", "dart"))
HEADED = TYPED | {"javascript", "typescript", "tsx", "php"}
#: Words after which a name is called all the same.
STATEMENTS = frozenset("return else do throw case goto await yield in is as and or not new delete co_await co_return co_yield when".split())


@dataclass(frozen=True)
class Profile:
    """Patterns with a group for the name. owner: a group for the type that a function belongs to. skipped: heads of brackets that hold no calls."""

    classes: str | None
    functions: str
    imports: tuple[str, ...] = ()
    reopens: str | None = None
    namespace: str | None = None
    calls: str = rf"(?<![\w$])({NAME})\s*\("
    skipped: str | None = None
    flags: int = re.MULTILINE
    not_names: frozenset[str] = frozenset("if for while switch catch else do return new throw function".split())


_MODIFIERS = r"(?:(?:public|private|protected|internal|static|final|abstract|virtual|override|async|readonly|get|set|sealed|synchronized|native|default|export|extern|unsafe|partial|open|suspend|inline|operator|external|late|const|factory)\s+)*"
_ANNOTATIONS = r"(?:@[\w.]+(?:\([^()]*\))?\s*)*"
_TYPED_METHOD = rf"(?:^|(?<=[{{}};]))[ \t]*{_ANNOTATIONS}{_MODIFIERS}(?:<[^>\n]+>\s*)?[\w$<>\[\],.?& \t*:]*?[\w$>\]?*&]\s+\**&?({NAME})\s*(?:<[^>\n]*>\s*)?\([^;{{}}]*?\)\s*(?:const|noexcept|override|throws\s+[\w., ]+|async\*?|sync\*)?\s*(?={{|=>)"
_SCRIPT_METHOD = rf"(?:^|[{{}};])[ \t]*(?:(?:static|async|public|private|protected|readonly|get|set|override|abstract)\s+)*\*?({NAME})\s*(?:<[^>\n]*>)?\([^;{{}}]*?\)\s*(?::[^={{;\n]+)?(?={{)"
_SCRIPT = Profile(
    classes=rf"\bclass\s+({NAME})",
    functions=rf"\bfunction\s*\*?\s*({NAME})\s*(?:<[^>\n]*>)?\(|{_SCRIPT_METHOD}",
    imports=(r"^[ \t]*import\b[^;'\"]*?['\"]([^'\"\n]+)['\"]",),
)
_GENERIC_CALL = rf"(?<![\w$])({NAME})(?:<[\w\s,.<>?\[\]]*>)?\s*\("
_JAVA_LIKE = rf"{_TYPED_METHOD}|(?:^|(?<=[{{}};]))[ \t]*{_ANNOTATIONS}{_MODIFIERS}(?:<[^>\n]+>\s*)?[\w<>\[\], ?.]+\s+({NAME})\s*(?:<[^>\n]*>\s*)?\([^;{{}}]*?\)(?=\s*;)"

#: One profile for each of the languages but Python.
PROFILES: dict[str, Profile] = {
    "javascript": _SCRIPT,
    "typescript": replace(_SCRIPT, calls=_GENERIC_CALL),
    "tsx": replace(_SCRIPT, calls=_GENERIC_CALL),
    "java": Profile(rf"\b(?:class|interface)\s+({NAME})", _JAVA_LIKE, (r"^[ \t]*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;",), skipped=r"\benum\s+\w+[^{;]*\{"),
    "c": Profile(None, _TYPED_METHOD, (r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]",), calls=r"(?<![\w.>:])([A-Za-z_]\w*)\s*\("),
    "cpp": Profile(r"\b(?:class|struct)\s+([A-Za-z_]\w*)\s*(?:final\s*)?(?::[^;{]*)?(?=\{)", _TYPED_METHOD, (r"^[ \t]*#[ \t]*include[ \t]*[<\"]([^>\"\n]+)[>\"]",), calls=r"(?<![\w:])([A-Za-z_]\w*)\s*\(", skipped=r"::\s*~?[A-Za-z_]\w*\s*\([^;{}]*\)[^;{}()]*(?::[^;{]*(?:\w\{[^{}]*\}[^;{]*)*)?\{|~[A-Za-z_]\w*\s*\(\s*\)[^;{}]*\{"),
    "csharp": Profile(rf"\b(?:class|interface|struct)\s+({NAME})", _JAVA_LIKE, (r"^[ \t]*using\s+(?:static\s+)?([\w.]+)\s*;",), namespace=r"^[ \t]*namespace\s+([\w.]+)\s*(?=\{)"),
    "go": Profile(r"^[ \t]*type\s+([A-Za-z_]\w*)\s", r"^[ \t]*func\s+(?:\(\s*(?:\w+\s+)?\*?(?P<owner>\w+)[^)]*\)\s*)?([A-Za-z_]\w*)\s*[\[(]", (r"^[ \t]*import\s+(?:[\w.]+\s+)?\"([^\"\n]+)\"",), skipped=r"^[ \t]*import\s*\(|\binterface\s*\{"),
    "rust": Profile(r"(?:^|[{};])[ \t]*(?:pub(?:\([^)]*\))?\s+)?struct\s+([A-Za-z_]\w*)", r"(?:^|[{};])[ \t]*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+)*fn\s+([A-Za-z_]\w*)", (r"^[ \t]*(?:pub\s+)?use\s+([\w:]+::\w+)\s*;",), reopens=r"^[ \t]*(?:unsafe\s+)?impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?([A-Za-z_]\w*(?:<[^>{]*>)?)", calls=r"(?<![\w:!])([A-Za-z_]\w*)\s*\(", skipped=r"\benum\s+\w+[^{;]*\{"),
    "php": Profile(r"\bclass\s+([A-Za-z_]\w*)", r"\bfunction\s+&?([A-Za-z_]\w*)\s*\(", (r"^[ \t]*use\s+([^;(]+?)\s*;",), calls=r"(?<![\w$])(?<!new )([A-Za-z_]\w*)\s*\("),
    "kotlin": Profile(r"\bclass\s+([A-Za-z_]\w*)", r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.]+\.)?([A-Za-z_]\w*)\s*\(", (r"^[ \t]*import\s+([\w.]+)",), calls=_GENERIC_CALL, skipped=r"\benum\s+class\s+\w+[^{;]*\{"),
    "swift": Profile(r"\bclass\s+(?!func\b)([A-Za-z_]\w*)", r"\bfunc\s+([A-Za-z_]\w*)\s*[<(]", (r"^[ \t]*import\s+([\w.]+)",)),
    "dart": Profile(r"\bclass\s+([A-Za-z_]\w*)", rf"{_TYPED_METHOD}", (r"^[ \t]*import\s+['\"]([^'\"\n]+)['\"]",), calls=_GENERIC_CALL),
    "sql": Profile(None, r"\bcreate\s+(?:or\s+replace\s+)?function\s+([\w.\"]+)\s*\(", flags=re.MULTILINE | re.IGNORECASE),
    "scala": Profile(r"\bclass\s+([A-Za-z_]\w*)", r"\bdef\s+([A-Za-z_]\w*)", (r"^[ \t]*import\s+([^\n;]+?)[ \t]*(?:;|$)",)),
    "powershell": Profile(r"^[ \t]*class\s+([A-Za-z_]\w*)", r"^[ \t]*function\s+([\w:-]+)|^[ \t]*(?:static\s+|hidden\s+)*(?:\[[^\]\n]+\]\s*)([A-Za-z_]\w*)\s*\([^{};]*\)\s*(?=\{)", (r"^[ \t]*import-module\s+([^\n;|]+?)[ \t]*$",), calls=r"(?:^|[;{|(=])[ \t]*([A-Za-z][\w-]*)(?=[ \t]|$|;)", flags=re.MULTILINE | re.IGNORECASE),
}
LANGUAGES = ("python", *PROFILES)


_BRACKETS = {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}
#: Languages where a line's end may end a head, and those where a head may go on with = and an expression.
LINED, EXPRESSED = frozenset(("kotlin", "swift", "scala", "go")), frozenset(("kotlin", "scala"))


def _matching(text: str, at: int) -> int:
    """Just behind the bracket that closes the one at ``at``."""
    depth = 0
    for m in re.compile(r"[()\[\]{}]").finditer(text, at):
        depth += _BRACKETS[m[0]]
        if depth == 0:
            return m.end()
    return len(text)


def _expression_end(text: str, start: int, at: int) -> int:
    """Where a body without brackets ends: before the first line that is indented no deeper than the line of ``start``."""
    indent = lambda k: len(text[k:]) - len(text[k:].lstrip(" \t"))
    own, depth = indent(text.rfind("\n", 0, start) + 1), 0
    for m in re.compile(r"[()\[\]{}]|\n(?=[^\n]*\S)").finditer(text, at):
        if m[0] == "\n":
            if depth <= 0 and indent(m.end()) <= own:
                return m.start()
        else:
            depth += _BRACKETS[m[0]]
            if depth < 0:
                return m.start()
    return len(text)


def _extent(text: str, start: int, at: int, language: str) -> tuple[int, bool]:
    """Where the definition from ``start`` on ends, whose head is read up to ``at``, and whether it has a body."""
    depth, lists = int(text[at - 1 : at] in ("(", "[")), False
    for m in re.compile(r"[()\[\]{};\n:]|=>?|\$\$").finditer(text, at):
        x = m[0]
        if x == "$$" and language == "sql":
            end = text.find("$$", m.end())
            return (len(text) if end < 0 else end + 2), True
        if x in "()[]":
            depth += _BRACKETS[x]
        if depth > 0 or m.start() < at:
            continue
        if x == "{":
            end = _matching(text, m.start())
            if language == "go" and re.search(r"\b(?:interface|struct)\s*$", text[start : m.start()]) and re.match(r"[ \t]*[{,)]", text[end:]):
                at = end  # a type, not the body
                continue
            if lists and re.match(r"\w", text[m.start() - 1]):
                at = end  # a member's initializer
                continue
            return end, True
        if x == ";":
            return m.end(), False
        if x == "}":
            return m.start(), False
        if x == ":":
            lists = language == "cpp"
        elif x in ("=", "=>") and language in EXPRESSED:
            follows = re.compile(r"[ \t]*\{").match(text, m.end())
            return (_matching(text, follows.end() - 1) if follows else _expression_end(text, start, m.end())), True
        elif x == "\n" and language in LINED and not re.compile(r"\s*(?:[{=:]|->|where\b|throws\b|extends\b|with\b)").match(text, m.end()):
            return m.start(), False
    return len(text), False


def _hidden(clean: str, language: str, profile: Profile) -> list[tuple[int, int]]:
    """Brackets that hold neither definitions nor calls."""
    out = []
    for m in re.finditer(profile.skipped, clean, profile.flags) if profile.skipped else ():
        end = _matching(clean, m.end() - 1)
        if language in ("java", "kotlin"):  # an enumeration's members follow its constants
            depth = [k for k in (x.start() for x in re.compile(";").finditer(clean, m.end(), end)) if clean.count("{", m.end(), k) == clean.count("}", m.end(), k)]
            end = depth[0] if depth else end
        out.append((m.end(), end))
    return out


def _declares(clean: str, at: int) -> bool:
    """Whether the name at ``at`` is declared there rather than called: a type stands before it in its statement."""
    begin = max(clean.rfind(c, 0, at) for c in ";{}") + 1
    before = re.sub(r"^\s*(?:(?:public|private|protected)\s*:\s*)*", "", clean[begin:at])
    words = re.findall(r"[A-Za-z_]\w*", before)
    if not words or words[0] in STATEMENTS or words[-1] in STATEMENTS:
        return False
    return bool(re.fullmatch(r"(?:[A-Za-z_][\w:.]*(?:\s*<[^;{}()]*>)?(?:\s*\[\s*\])*[\s*&?]+)+", before))


def _constructors(clean: str, classes: list[tuple], names: set[int]) -> list[tuple]:
    """C++ functions that are named as the class around them; what they initialize isn't called."""
    out = []
    for _, label, _, start, end, _ in classes:
        for m in re.compile(rf"(?<![\w~:.>])(?<!new )({re.escape(label)})\s*\(").finditer(clean, clean.find("{", start, end), end):
            close = _matching(clean, m.end() - 1)
            head = re.compile(r"\s*(?:noexcept\s*)?(:[^;{]*(?:\w\{[^{}]*\}[^;{]*)*)?\{").match(clean, close)
            if not head:
                continue
            names.add(m.start(1))
            depth = 0
            for x in re.finditer(r"[(){}]|[A-Za-z_]\w*(?=\s*\()", head[1] or ""):
                if x[0] in _BRACKETS:
                    depth += _BRACKETS[x[0]]
                elif not depth:
                    names.add(head.start(1) + x.start())
            out.append(("function", label, clean.count("\n", 0, m.start()) + 1, m.start(), _matching(clean, head.end() - 1), None))
    return out


def _is_call(clean: str, at: int, name: str, close: int, language: str, class_level) -> bool:
    """Whether ``name`` at ``at``, with brackets up to ``close``, is called."""
    before = clean[max(0, at - 200) : at]
    dotted = re.search(r"(?:\.|->|::)\s*$", before)
    if not dotted and (name.lower() if language in ("sql", "powershell") else name) in RESERVED[language]:
        return False
    if re.search(r"\bnew\s+(?:[\w$]+\s*(?:\.|\\|::)\s*|\\)*$", before):
        return False
    if before.endswith("@") and language not in ("javascript", "typescript", "tsx"):
        return False  # an annotation
    if language in TYPED and (not dotted and _declares(clean, at) or (not dotted or language == "dart") and class_level(at)):
        return False
    if language == "csharp" and re.search(r"(?:^|[;{}\]])\s*\[[^\]\n]*$", before):
        return False  # an attribute
    after = clean[close : close + 80]
    if language in HEADED and not dotted and not re.search(r"\b(?:extends|implements)\s+$", before) and re.match(r"\s*(?:throws\s[^{;]*|:\s*(?:base|this)\b[^{;]*|const\s*|noexcept\s*)?\{", after):
        return False  # a head
    if language == "rust" and (re.match(r"\s*(?:=>|\|(?!\|))", after) or re.search(r"\blet\s+$", before)):
        return False  # a pattern
    return not (language in ("scala", "swift") and re.search(r"\bcase\s+(?:let\s+)?(?:\w*\.)?$", before))


def events(text: str, language: str) -> tuple[list[tuple], str | None]:
    """((kind, name, line, start, end, extra), ...) in the text's order, and the file's declared namespace.

    kind: class, function, reopen, import, call. Raises SyntaxError where Python's parser does."""
    if language == "python":
        return _python_events(text), None
    profile = PROFILES[language]
    clean = lexer.blanked(text, language)
    if language in ("c", "cpp"):  # the preprocessor's lines hold no code of the grammar's
        clean = re.sub(r"^[ \t]*#(?:[^\n]*\\\n)*[^\n]*", lambda m: re.sub(r"[^\n]", " ", m[0]), clean, flags=re.MULTILINE)
    elif language in ("rust", "php"):
        clean = re.sub(r"#!?\[[^\]]*\]", lambda m: re.sub(r"[^\n]", " ", m[0]), clean)
    line = lambda at: text.count("\n", 0, at) + 1
    out, names, hidden = [], set(), _hidden(clean, language, profile)
    for kind, pattern in (("class", profile.classes), ("reopen", profile.reopens), ("function", profile.functions)):
        for m in re.finditer(pattern, clean, profile.flags) if pattern else ():
            index = next((k for k in range(1, m.re.groups + 1) if k != m.re.groupindex.get("owner") and m[k]), None)
            if index is None or kind == "function" and m[index] in profile.not_names:
                continue
            at = m.start() + len(m[0]) - len(m[0].lstrip(" \t\r\n{};"))
            head = clean[at : m.start(index)]
            if kind == "function" and (re.match(r"[a-z_]*", head)[0] in STATEMENTS or language in TYPED and re.fullmatch(_ANNOTATIONS + _MODIFIERS, head)):
                continue  # a statement, or a constructor
            names.add(m.start(index))
            body = m.end() if clean[m.end() - 1 : m.end()] != ";" else m.end() - 1
            end, has_body = _extent(clean, at, body, language)
            if kind == "function" and not has_body and language in ("rust", "swift"):
                continue  # a signature
            if kind == "class" and language in ("kotlin", "scala"):
                brace = clean.find("{", m.end(), end)
                hidden.append((m.end(), brace if brace >= 0 else end))  # parameters and what is extended
            owner = m["owner"] if "owner" in m.re.groupindex else None
            out.append((kind, m[index].strip('"'), line(at), at, end, owner))
    if language == "cpp":
        out += _constructors(clean, [e for e in out if e[0] == "class"], names)
    places = [m.start() for m in re.finditer(r"[{}]", clean)]
    depths = list(accumulate((1 if clean[k] == "{" else -1 for k in places), initial=0))
    depth = lambda at: depths[bisect_left(places, at)]
    classes = [(e[3], e[4], depth(e[3])) for e in out if e[0] == "class"]

    def class_level(at: int) -> bool:
        """Right inside a class, outside a member's initial value."""
        inner = max((c for c in classes if c[0] < at < c[1]), default=None)
        begin = max(clean.rfind(c, 0, at) for c in ";{}") + 1
        return inner is not None and depth(at) == inner[2] + 1 and "=" not in clean[begin:at]

    shown = lambda at: not any(a <= at < b for a, b in hidden)
    out = [e for e in out if shown(e[3])]
    for pattern in profile.imports:
        for m in re.finditer(pattern, text, profile.flags):
            begin = m.start() + len(m[0]) - len(m[0].lstrip())
            if clean[begin : begin + 1].strip() or language in ("c", "cpp") and lexer.blanked(text[: begin + 1], language)[begin:].strip():  # not in a comment
                out.append(("import", m[1].strip(), line(m.start(1)), m.start(), m.end(), "imports"))
    for m in re.finditer(profile.calls, clean, profile.flags):
        at = m.start(1)
        close = _matching(clean, m.end() - 1) if clean[m.end() - 1 : m.end()] == "(" else m.end()
        if at not in names and shown(at) and _is_call(clean, at, m[1], close, language, class_level):
            out.append(("call", m[1], line(at), at, m.end(), None))
    space = re.search(profile.namespace, clean, profile.flags) if profile.namespace else None
    return sorted(out, key=lambda e: (e[3], -e[4])), space[1] if space else None


def _python_events(text: str) -> list[tuple]:
    tree = ast.parse(text)
    starts = [0]
    for x in text.splitlines(keepends=True):
        starts.append(starts[-1] + len(x))
    encoded = text.splitlines()

    def at(line: int, column: int) -> int:
        row = encoded[line - 1] if line <= len(encoded) else ""
        return starts[min(line, len(starts)) - 1] + len(row.encode()[:column].decode(errors="ignore"))

    out = []
    for node in ast.walk(tree):
        if not hasattr(node, "lineno"):
            continue
        start, end = at(node.lineno, node.col_offset), at(node.end_lineno, node.end_col_offset)
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            out.append(("function", node.name, node.lineno, start, end, None))
        elif isinstance(node, ast.ClassDef):
            out.append(("class", node.name, node.lineno, start, end, None))
        elif isinstance(node, ast.Import):
            out.append(("import", node.names[0].name, node.lineno, start, end, "imports"))
        elif isinstance(node, ast.ImportFrom):
            out.append(("import", "." * node.level + (node.module or ""), node.lineno, start, end, "imports_from"))
        elif isinstance(node, ast.Call):
            name = node.func.id if isinstance(node.func, ast.Name) else node.func.attr if isinstance(node.func, ast.Attribute) else None
            if name is not None:
                out.append(("call", name, node.lineno, start, end, None))
    return sorted(out, key=lambda e: (e[3], -e[4]))

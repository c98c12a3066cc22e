"""Source text with comments and literals as blanks, for any of the brace languages: a small lexer with a stack of modes.

What is blanked keeps its length and its line ends, so offsets and line numbers stay. Code inside a literal (template and
interpolated strings) is code: a literal pushes a mode, an interpolation pushes code on top of it, and its closing
bracket pops back. A quote without its partner on the line is no literal where literals end with their line."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Literal:
    """opens and closes: patterns; {0} in closes is what the group of opens took. within: how code begins inside, and its closing bracket."""

    opens: str
    closes: str
    escape: str | None = r"\\[\s\S]"
    lines: bool = False
    within: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Syntax:
    literals: tuple[Literal, ...]
    line: str = "//"
    block: tuple[str, str] | None = (r"/\*", r"\*/")
    nested: bool = False
    regex: bool = False


def _quoted(q: str, **more) -> Literal:
    return Literal(q, q, **more)


_BRACED, _ROUND = (r"\$\{", "}"), (r"\\\(", ")")
_PLAIN = (_quoted('"'), _quoted("'"))
_CHAR = Literal(r"'(?=(?:\\.[^'\n]*|[^'\\\n])')", "'")  # a quote that isn't a character's is none
_SCRIPT = Syntax((*_PLAIN, _quoted("`", lines=True, within=(_BRACED,))), regex=True)
_TRIPLE = r'"""'
_C = Syntax((Literal(r'R"([^ ()\\\n]{0,16})\(', r"\){0}\"", escape=None, lines=True), _quoted('"'), _CHAR))

SYNTAXES = {
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "tsx": _SCRIPT,
    "java": Syntax((Literal(_TRIPLE, _TRIPLE, lines=True), *_PLAIN)),
    "c": _C,
    "cpp": _C,
    "csharp": Syntax((Literal(r'("{3,})', "{0}", escape=None, lines=True), Literal(r'\$@"|@\$"', '"', escape='""|{{', lines=True, within=((r"\{(?!\{)", "}"),)), Literal(r'@"', '"', escape='""', lines=True), Literal(r'\$"', '"', escape=r"\\.|{{", within=((r"\{(?!\{)", "}"),)), *_PLAIN)),
    "go": Syntax((_quoted("`", escape=None, lines=True), *_PLAIN)),
    "rust": Syntax((Literal(r'\bb?r(#*)"', r'"{0}', escape=None, lines=True), _quoted('"', lines=True), _CHAR), nested=True),
    "php": Syntax((Literal(r"<<<[ \t]*'(\w+)'\n", r"^[ \t]*{0}\b", escape=None, lines=True), Literal(r"<<<[ \t]*\"?(\w+)\"?\n", r"^[ \t]*{0}\b", lines=True, within=((r"\{(?=\$)", "}"),)), _quoted('"', lines=True, within=((r"\{(?=\$)", "}"),)), _quoted("'", lines=True)), line=r"//|#(?!\[)"),
    "kotlin": Syntax((Literal(_TRIPLE, _TRIPLE, escape=None, lines=True, within=(_BRACED,)), _quoted('"', within=(_BRACED,)), _CHAR), nested=True),
    "swift": Syntax((Literal(r'(#+)"', '"{0}', escape=None, lines=True), Literal(_TRIPLE, _TRIPLE, lines=True, within=(_ROUND,)), _quoted('"', within=(_ROUND,))), nested=True),
    "dart": Syntax((Literal(r"\br(\"\"\"|'''|\"|')", "{0}", escape=None), *(Literal(q * 3, q * 3, lines=True, within=(_BRACED,)) for q in "\"'"), *(_quoted(q, within=(_BRACED,)) for q in "\"'")), nested=True),
    "sql": Syntax((_quoted("'", escape=None, lines=True),), line="--"),
    "scala": Syntax((Literal(_TRIPLE, _TRIPLE, escape=None, lines=True, within=(_BRACED,)), _quoted('"', within=(_BRACED,)), _CHAR), nested=True),
    "powershell": Syntax((Literal(r'@"(?=\s*\n)', r'^"@', escape=None, lines=True, within=((r"\$\(", ")"),)), Literal(r"@'(?=\s*\n)", "^'@", escape=None, lines=True), _quoted('"', lines=True, escape='""|`.', within=((r"\$\(", ")"),)), _quoted("'", lines=True, escape="''")), line="#", block=("<#", "#>")),
}
_PAIRS = {"}": "{", ")": "("}
#: What stands before a regular expression, where a slash would otherwise divide.
_BEFORE_REGEX = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%~^<>]|=>|\b(?:return|typeof|case|in|of|do|else|void|yield|await))\s*\Z")
_REGEX = re.compile(r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")


def _end_of_comment(text: str, at: int, syntax: Syntax) -> int:
    """Where the block comment whose opening ends at ``at`` ends."""
    opens, closes = syntax.block
    depth = 1
    for m in re.compile(f"({closes})|{opens}" if syntax.nested else f"({closes})").finditer(text, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return len(text)


def blanked(text: str, language: str) -> str:
    syntax = SYNTAXES[language]
    starts = [f"(?P<line>{syntax.line})", *([f"(?P<block>{syntax.block[0]})"] if syntax.block else [])]
    # groups of the literals' own are counted from their name on
    starts += [f"(?P<l{k}>{x.opens})" for k, x in enumerate(syntax.literals)] + ["(?P<bracket>[{}()])"] + (["(?P<slash>/)"] if syntax.regex else [])
    code = re.compile("|".join(starts), re.MULTILINE)
    pieces, kept, at = [], 0, 0
    #: Literals that are open, each with the closing bracket of the code inside it and how deep that stands.
    stack: list[list] = []

    def blank(begin: int, end: int) -> None:
        nonlocal kept
        pieces.append(text[kept:begin])
        pieces.append(re.sub(r"[^\n]", " ", text[begin:end]))
        kept = max(kept, end)

    def literal(kind: Literal, own: str, begin: int, body: int) -> int:
        """Blanks a literal from ``begin`` on, up to its end or to code inside it; where to go on."""
        closes = kind.closes.replace("{0}", re.escape(own))
        inner = "|".join(f"(?P<w{k}>{o})" for k, (o, _) in enumerate(kind.within))
        pattern = re.compile((f"{inner}|" if inner else "") + (f"(?P<escape>{kind.escape})|" if kind.escape else "") + ("" if kind.lines else r"(?P<line>\n)|") + f"(?P<close>{closes})", re.MULTILINE)
        for m in pattern.finditer(text, body):
            if m.lastgroup == "escape":
                continue
            if m.lastgroup == "line":  # no partner
                blank(begin, body)
                return body
            if m.lastgroup == "close":
                blank(begin, m.end())
            else:
                closing = kind.within[int(m.lastgroup[1:])][1]
                blank(begin, m.end() - (closing == ")"))  # round brackets stay, in pairs
                stack.append([kind, own, closing, 0])
            return m.end()
        if kind.lines:
            blank(begin, len(text))
            return len(text)
        blank(begin, body)
        return body

    while m := code.search(text, at):
        kind = next(n for n, v in m.groupdict().items() if v is not None)
        at = m.end()
        if kind == "line":
            end = text.find("\n", at)
            at = len(text) if end < 0 else end
            blank(m.start(), at)
        elif kind == "block":
            at = _end_of_comment(text, at, syntax)
            blank(m.start(), at)
        elif kind == "slash":
            if _BEFORE_REGEX.search(text[max(0, m.start() - 40) : m.start()]) and (r := _REGEX.match(text, m.start())):
                at = r.end()
                blank(m.start(), at)
        elif kind == "bracket":
            if stack:
                closing = stack[-1][2]
                if m[0] == closing and not stack[-1][3]:
                    opened, own, _, _ = stack.pop()
                    at = literal(opened, own, m.start() + (closing == ")"), at)
                elif m[0] in (closing, _PAIRS[closing]):
                    stack[-1][3] += -1 if m[0] == closing else 1
        else:
            own = next((g for g in m.groups()[m.re.groupindex[kind] : m.re.groupindex[kind] + 1] if g), "") if re.compile(syntax.literals[int(kind[1:])].opens).groups else ""
            at = literal(syntax.literals[int(kind[1:])], own, m.start(), at)
    pieces.append(text[kept:])
    return "".join(pieces)

"""Comments and strings of source text, by a small lexicon for each language."""

from __future__ import annotations

import re
from dataclasses import dataclass

_STRING = r'"(?:\\.|[^"\\\n])*"'
_SINGLE = r"'(?:\\.|[^'\\\n])*'"
_CHAR = r"'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'"
_TRIPLE = r'"""(?:\\.|[^\\])*?(?:"""|\Z)'


@dataclass(frozen=True)
class Lexicon:
    """How a language writes comments and strings; ``nested``: the block comments' pair if they nest."""

    comments: tuple[str, ...]
    strings: tuple[str, ...]
    nested: tuple[str, str] | None = None

    def pattern(self) -> re.Pattern:
        parts = [f"(?P<nest>{re.escape(self.nested[0])})"] if self.nested else []
        return re.compile("|".join([*parts, f"(?P<comment>{'|'.join(self.comments)})", f"(?P<string>{'|'.join(self.strings)})"]), re.S)


_C = (r"//[^\n]*", r"/\*.*?(?:\*/|\Z)")
_HASH = r"#[^\n]*"
LEXICONS: dict[str, Lexicon] = {
    **dict.fromkeys(("typescript", "tsx", "javascript"), Lexicon(_C, (_STRING, _SINGLE, r"`(?:\\.|[^`\\])*`", r"(?<=[(,=:\[!&|?{};\n])[ \t]*/(?![*/ ])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"))),
    "go": Lexicon(_C, (_STRING, _CHAR, r"`[^`]*`")),
    "rust": Lexicon((r"//[^\n]*",), (r'r#".*?"#', _STRING, _CHAR), ("/*", "*/")),
    "zig": Lexicon((r"//[^\n]*",), (r"\\\\[^\n]*", _STRING, _CHAR)),
    "csharp": Lexicon(_C, (_TRIPLE, r'\$?@\$?"(?:""|[^"])*"', _STRING, _CHAR)),
    "php": Lexicon((*_C, r"#(?!\[)[^\n]*"), (r'"(?:\\.|[^"\\])*"', r"'(?:\\.|[^'\\])*'")),
    **dict.fromkeys(("java", "kotlin", "scala", "swift"), Lexicon(_C, (_TRIPLE, _STRING, _CHAR))),
    "dart": Lexicon(_C, (_TRIPLE, r"'''.*?(?:'''|\Z)", _STRING, _SINGLE)),
    "solidity": Lexicon(_C, (_STRING, _SINGLE)),
    **dict.fromkeys(("c", "cpp", "objc"), Lexicon(_C, (r'R"\((?:.*?)\)"', _STRING, _CHAR))),
    "python": Lexicon((_HASH,), (_TRIPLE, r"'''(?:\\.|[^\\])*?(?:'''|\Z)", _STRING, _SINGLE)),
    "ruby": Lexicon((r"(?m:^=begin\b.*?^=end\b[^\n]*)", _HASH), (r'"(?:\\.|[^"\\])*"', r"'(?:\\.|[^'\\])*'", r"(?<=[(,=~\s])/(?![ =])(?:\\.|[^/\\\n])+/[a-z]*")),
    "elixir": Lexicon((_HASH,), (_TRIPLE, r'"(?:\\.|[^"\\])*"', r"'(?:\\.|[^'\\\n])*'")),
    "bash": Lexicon((r"(?:(?<=[\s;])|(?m:^))#[^\n]*",), (r'"(?:\\.|[^"\\])*"', r"'[^']*'")),
    "lua": Lexicon((r"--\[\[.*?(?:\]\]|\Z)", r"--[^\n]*"), (r"\[\[.*?(?:\]\]|\Z)", _STRING, _SINGLE)),
    "julia": Lexicon((_HASH,), (_TRIPLE, r'"(?:\\.|[^"\\])*"', _CHAR), ("#=", "=#")),
    "haskell": Lexicon((r"--+(?![!#$%&*+./<=>?@\\^|~:-])[^\n]*",), (r'"(?:\\.|[^"\\])*"', _CHAR), ("{-", "-}")),
    **dict.fromkeys(("ocaml", "ocaml_interface"), Lexicon((r"(?!)",), (r'"(?:\\.|[^"\\])*"', _CHAR), ("(*", "*)"))),
}
_PATTERNS = {k: v.pattern() for k, v in LEXICONS.items()}


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def masked(text: str, language: str) -> tuple[str, str, list[tuple[int, int]]]:
    """The text with comments and the insides of strings blanked, the text with comments alone blanked, and the comments' spans; nothing moves."""
    code, bare, comments = [], [], []
    lexicon, pattern, at, last = LEXICONS[language], _PATTERNS[language], 0, 0
    while m := pattern.search(text, at):
        start, end = m.span()
        kind = m.lastgroup
        if kind == "nest":
            kind, depth = "comment", 0
            for x in re.finditer("|".join(map(re.escape, lexicon.nested)), text[start:]):
                depth += 1 if x[0] == lexicon.nested[0] else -1
                if not depth:
                    end = start + x.end()
                    break
            else:
                end = len(text)
        plain = text[last:start]
        whole = text[start:end]
        if kind == "comment":
            comments.append((start, end))
            code += [plain, _blank(whole)]
            bare += [plain, _blank(whole)]
        else:
            code += [plain, '"' + _blank(whole[1:-1]) + '"' if len(whole) > 1 else whole]
            bare += [plain, whole]
        at = last = max(end, start + 1)
    return "".join([*code, text[last:]]), "".join([*bare, text[last:]]), comments


DIRECTIVE = re.compile(r"#!|//(?:go:| ?\+build| ?@ts-| ?swift-tools-version|/ ?<reference)|/\* ?eslint|# ?(?:-\*-|type:|noqa|pragma)|#\s*(?:frozen_string_literal|encoding|coding)[:=]")
DOC = re.compile(r"/\*\*(?!/)|/\*!|//[/!]|--- |-- \||\{- ?\||\(\*\*(?!\))")


def looks_like_code(comment: str) -> bool:
    """At least half of a comment's lines end or begin as code does (the same rule as the column form in ``transform``)."""
    inner = re.sub(r"\*+/\s*$", "", re.sub(r"^\s*(?:/\*+|//+|#+)", "", comment))
    lines = [x for x in (re.sub(r"^\s*(?://+|#+|\*)?", "", y).strip() for y in inner.split("\n")) if x]
    code = [x for x in lines if x[-1] in ";{}()," or re.match(r"(?:func|fn|def|import|for|if|return|var|let|const)\b", x)]
    return bool(lines) and 2 * len(code) >= len(lines)


def removal(text: str, start: int, end: int) -> tuple[int, int]:
    """What goes with a comment: its whole lines if it stands alone on them, else the blanks beside it."""
    line = text.rfind("\n", 0, start) + 1
    stop = text.find("\n", end)
    stop = len(text) if stop < 0 else stop
    if not text[line:start].strip():
        if not text[end:stop].strip():
            return line, min(stop + 1, len(text))
        while text[end : end + 1] in (" ", "\t"):
            end += 1
        return start, end
    while start > line and text[start - 1] in " \t":
        start -= 1
    return start, end


def comment_cuts(text: str, code: str, comments: list[tuple[int, int]], policy: str, bodies: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of the comments that ``policy`` (docs, none) drops. ``bodies``: where a plain comment documents nothing."""
    out = []
    for k, (a, b) in enumerate(comments):
        said = text[a:b]
        if DIRECTIVE.match(said) or a == 0 and said.startswith("#!"):
            continue
        if policy == "docs" and _documents(text, code, comments, k, bodies):
            continue
        out.append(removal(text, a, b))
    return out


def _documents(text: str, code: str, comments: list[tuple[int, int]], k: int, bodies: list[tuple[int, int]]) -> bool:
    a, b = comments[k]
    if DOC.match(text[a:b]):
        return True
    if text[text.rfind("\n", 0, a) + 1 : a].strip() or any(x < a < y for x, y in bodies) or looks_like_code(text[a:b]):
        return False
    # Attached: code begins on the very next line, maybe after more comments without a gap.
    for _, end in comments[k:]:
        following = re.match(r"[ \t]*\n?[ \t]*", text[end:])
        at = end + following.end()
        if at >= len(text) or text[at] == "\n":
            return False
        if code[at].strip():
            return True
    return False


_BRANCH = re.compile(r"\s*#\s*(if|ifdef|ifndef|elif|elseif|else|endif)\b")


def blank_branches(text: str, branch: int) -> str:
    """Keep the given branch of every top-level ``#if``, blanking the others and the directives without moving anything."""
    out, depth, current = [], 0, 0
    for line in text.split("\n"):
        m = _BRANCH.match(line)
        word = m[1] if m else ""
        if word.startswith("if"):
            depth += 1
            current = 0 if depth == 1 else current
        elif word.startswith("el") and depth == 1:
            current += 1
        out.append(" " * len(line) if word or depth and current != branch else line)
        if word == "endif":
            depth = max(0, depth - 1)
    return "\n".join(out)


def branch_count(text: str) -> int:
    """The most branches that a top-level ``#if`` has; 0 without one."""
    most, depth, current = 0, 0, 0
    for m in re.finditer(rf"(?m)^{_BRANCH.pattern}", text):
        if m[1].startswith("if"):
            depth += 1
            current = 1 if depth == 1 else current
        elif m[1].startswith("el") and depth == 1:
            current += 1
        elif m[1] == "endif":
            depth = max(0, depth - 1)
        most = max(most, current)
    return most

"""Skeletons and outlines of languages other than Python, from masked text: brackets are matched, headers are classified by rules of each language.

A rule table (:data:`BRACES`, :data:`BLOCKS`) says what heads a container, a function or a declaration. Further languages are
added with :func:`register`.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from lodestone.operators import lexing


@dataclass
class Result:
    content: str
    bodies: int = 0
    comments: int = 0
    errors: bool = False
    outline: list[str] = field(default_factory=list)


#: start, end, new text, bodies that it stands for
Edit = tuple[int, int, str, int]


def apply(text: str, edits: list[Edit], cuts: list[tuple[int, int]] = ()) -> tuple[str, int, int]:
    """Replace spans; of overlapping ones the first stays (the longest of those that begin together). Text, bodies, comments."""
    out, at, bodies, comments = [], 0, 0, 0
    everything = [(a, b, new, n, False) for a, b, new, n in edits] + [(a, b, "", 0, True) for a, b in cuts]
    for a, b, new, n, cut in sorted(everything, key=lambda e: (e[0], -e[1])):
        if a >= at:
            out += [text[at:a], new]
            at, bodies, comments = b, bodies + n, comments + cut
    return "".join([*out, text[at:]]), bodies, comments


def tidy(header: str) -> str:
    """A declaration on one line, without what opens its body."""
    one = re.sub(r",?\s+([)\]])", r"\1", re.sub(r"([(\[])\s+", r"\1", re.sub(r"\s+", " ", header))).strip()
    one = re.sub(r"(?:\s*(?:\{|:|=(?!>)|;|\bdo|\bwhere|\bbegin)\s*)+$", "", one)
    return one if len(one) <= 240 else one[:239] + "…"


@dataclass(frozen=True)
class Braces:
    """A language with braces. Patterns are searched in masked headers."""

    container: str
    function: str
    declaration: str = r"(?!)"
    member: str = r"(?!)"
    newlines: bool = False  # a statement may end with its line
    inside: str = r"(?!)"  # functions among arguments: arrows, closures
    calls: bool = False  # anything with a parameter list and a block is a function
    block: str = "{ /* ... */ }"
    empty: bool = True  # empty bodies are replaced too


_MODS = r"(?:^|[\s;}>\])])"
_CONTROL = re.compile(r"^(?:\}?\s*)(?:else\b|if\b|for\b|while\b|switch\b|catch\b|do\b|try\b|finally\b|return\b|throw\b|using\b|lock\b|foreach\b|synchronized\b|match\b|loop\b|unsafe\b|when\b|guard\b|repeat\b|defer\b|select\b|case\b|elseif\b|with\b|new\b|await\b|yield\b)")
_ARROW = r"=>\s*$|\bfunction\b[^;{}]*\)[^;{}()=]*$"
_TS = Braces(rf"{_MODS}(?:class|interface|namespace|module|declare\s+global)\b(?![^{{}}]*=>)[^()={{}}]*(?:\([^()]*\))?[^()={{}}]*$", _ARROW + r"|^static\s*$", rf"{_MODS}(?:enum|type)\b[^(){{}}]*$|\btype\s+\w+[^{{}}]*=[^{{}}]*$", r".", True, _ARROW, True)
_CLIKE = rf"{_MODS}(?:class|struct|union|namespace|extern\s+\"[^\"]*\")\b[^(){{}}=]*$"
BRACES: dict[str, Braces] = {
    "typescript": _TS, "tsx": _TS, "javascript": _TS,
    "go": Braces(r"(?!)", r"\bfunc\b[^{}]*$", r"\btype\b[^{}]*$", newlines=True, inside=r"\bfunc\s*\([^{}]*$"),
    "rust": Braces(rf"{_MODS}(?:impl|trait|mod)\b[^{{}};=]*$", r"\bfn\b[^{};]*$|\|[^|{};]*\|\s*(?:->[^{}]*)?$", r"\b(?:struct|enum|union|type|const|static|macro_rules!)\b", r"\bfn\b", inside=r"\|[^|{};]*\|\s*(?:->[^{}]*)?$"),
    "java": Braces(rf"{_MODS}(?:class|interface|enum|record|@interface)\s+\w[^{{}}=]*$", r"->\s*$|^(?:static)?\s*$|^(?:(?:public|private|protected)\s+)?[A-Z]\w*\s*$", r"(?!)", r"\)", inside=r"->\s*$", calls=True),
    "csharp": Braces(rf"{_MODS}(?:class|interface|struct|record|namespace)\b[^{{}}=]*$", r"=>\s*$|\bdelegate\b[^{}]*$|^(?:\[[^\]]*\]\s*)*(?:(?:private|protected|internal|public)\s+)*(?:get|set|init|add|remove)\s*$", rf"{_MODS}(?:enum|delegate)\b", r".", inside=r"=>\s*$|\bdelegate\b[^{}]*$", calls=True),
    "c": Braces(r"(?!)", r"(?!)", r"\b(?:struct|union|enum|typedef)\b", r"\)", calls=True),
    "cpp": Braces(_CLIKE, r"\]\s*(?:\([^{}]*\))?[^;{}()]*$", r"\b(?:enum|typedef|using)\b", r"\)", inside=r"\]\s*(?:\([^{}]*\))?[^;{}()]*$", calls=True),
    "objc": Braces(r"(?!)", r"[-+]\s*\([^)]*\)[^;{}]*$|\^[^;{}]*\)\s*$", r"\btypedef\b", r"^\s*[-+]\s*\(|@property", inside=r"\^[^;{}]*$", calls=True),
    "php": Braces(rf"{_MODS}(?:class|interface|trait|enum)\b[^{{}}=]*$", r"\bfunction\b[^{};]*$", member=r"\bfunction\b", inside=r"\bfunction\b[^{};]*$"),
    "kotlin": Braces(rf"{_MODS}(?:class|interface|object)\b[^{{}}=]*$", r"\bfun\b[^{}=]*$|^init\s*$|\bconstructor\s*\([^{}]*$|^(?:\w+\s+)*[gs]et\s*\([^()]*\)[^{}=]*$", member=r"\bfun\b", newlines=True),
    "swift": Braces(rf"{_MODS}(?:class|struct|enum|extension|actor|protocol)\b(?!\s+(?:func|var))[^{{}}()=]*$", r"\bfunc\b[^{}]*$|\binit\b[?!]?\s*[(<][^{}]*$|\bdeinit\s*$|\bsubscript\b[^{}]*$|\bvar\s+\w+\s*:[^={}]+$", member=r"\bfunc\b|\binit\b", newlines=True),
    "scala": Braces(rf"{_MODS}(?:class|trait|object)\b[^{{}}=]*$", r"\bdef\b[^{}]*$", member=r"\bdef\b", newlines=True),
    "dart": Braces(rf"{_MODS}(?:class|mixin|extension)\b[^{{}}()=]*$", r"(?!)", rf"{_MODS}enum\b", inside=r"\)\s*(?:async\*?|sync\*)?\s*$", calls=True),
    "zig": Braces(r"\b(?:struct|enum|union|opaque)\b(?:\s*\([^)]*\))?\s*$", r"\bfn\b(?![^{}]*\)\s*type\s*$)[^{}]*$|^(?:pub\s+)?test\b[^{}]*$|^comptime\s*$", block="zig", empty=False),
    "solidity": Braces(r"\b(?:contract|interface|library)\b[^{}();]*$", r"\b(?:function|modifier|constructor|receive|fallback)\b[^{};]*$", r"\b(?:struct|enum|type)\b", r"\b(?:function|event|error|modifier)\b|^[\w\[\]. ]+(?:\([^)]*\))?[\w\s]*\w+(?:\s*=[^;]*)?$", empty=False),
}
_TOKEN = re.compile(r"[{}()\[\];\n]")
_CLOSE = {"(": ")", "[": "]", "{": "}"}
#: A line that goes on: by its end, or by the beginning of the next one.
_OPEN_END = re.compile(r"(?:[=(,+\-*/|&.?:<\[\\^%~!]|=>|->|\b(?:extends|implements|where|with|of|in|is|as|return|throws))\s*$")
_OPEN_START = re.compile(r"\s*(?:[.?:)\]}{,+*/|&=<>]|extends\b|implements\b|where\b|throws\b|else\b|catch\b|finally\b|with\b)")


def _pairs(code: str) -> dict[int, int] | None:
    """Closing brackets by their opening ones; None if they don't match."""
    stack, out = [], {}
    for m in re.finditer(r"[{}()\[\]]", code):
        if m[0] in _CLOSE:
            stack.append(m.start())
        elif not stack or _CLOSE[code[stack[-1]]] != m[0]:
            return None
        else:
            out[stack.pop()] = m.start()
    return None if stack else out


class _BraceScan:
    def __init__(self, text: str, code: str, bare: str, rules: Braces, language: str) -> None:
        self.text, self.code, self.bare, self.rules, self.language = text, code, bare, rules, language
        self.pairs = _pairs(code)
        self.edits: list[Edit] = []
        self.bodies: list[tuple[int, int]] = []
        self.outline: list[str] = []

    def body(self, open_: int, close: int) -> None:
        inner = self.text[open_ + 1 : close]
        self.bodies.append((open_, close + 1))
        if not inner.strip() and not self.rules.empty or inner.strip() in ("/* ... */", "// ..."):
            return
        if self.rules.block == "zig":
            line = self.text.rfind("\n", 0, open_) + 1
            lead = re.match(r"[ \t]*", self.text[line:])[0]
            new = f"{{\n{lead}    // ...\n{lead}}}"
        else:
            new = self.rules.block
        self.edits.append((open_, close + 1, new, 1))

    def arguments(self, a: int, b: int) -> None:
        """Functions among the arguments between two brackets."""
        i = a
        while (m := _TOKEN.search(self.code, i, b)) is not None:
            i = m.end()
            if m[0] in "([":
                self.arguments(i, self.pairs[m.start()])
                i = self.pairs[m.start()] + 1
            elif m[0] == "{":
                close = self.pairs[m.start()]
                if re.search(self.rules.inside, self.code[a : m.start()]) and not self._suite(a, m.start()):
                    self.body(m.start(), close)
                else:
                    self.walk(i, close, -1, False)
                i = close + 1

    def _suite(self, a: int, at: int) -> bool:
        """Whether an arrow is the callback of a group of tests."""
        return self.language in ("typescript", "tsx", "javascript") and re.search(r"\b(?:describe|context|suite)(?:\.\w+)?\s*$", self.code[max(0, a - 40) : a - 1]) is not None

    def say(self, depth: int, a: int, b: int) -> None:
        line = tidy(self.bare[a:b])
        if depth >= 0 and line:
            self.outline.append("  " * depth + line)

    def fields(self, a: int, b: int, depth: int, inside: bool) -> int:
        """Fields that end with a comma before a declaration; where that begins."""
        if not inside or "," not in self.code[a:b]:
            return a
        cut = a + re.search(r"(?:\s*\w+\s*:[^,()]*,)*", self.code[a:b]).end()
        for x in self.bare[a:cut].split(","):
            if x.strip() and depth > 0:
                self.outline.append("  " * depth + tidy(x))
        return cut + len(self.code[cut:b]) - len(self.code[cut:b].lstrip())

    def statement(self, a: int, b: int, depth: int, inside: bool) -> None:
        """A statement without a block of its own: an expression body, a member, a declaration."""
        a += len(re.match(r"(?:\s|(?:public|private|protected)\s*:)*", self.code[a:b])[0])
        head = self.code[a:b]
        bare = head.strip()
        if not bare:
            return
        multi = "\n" in self.text[a:b].rstrip()
        arrow = head.find("=>")
        if self.language in ("csharp", "dart") and arrow >= 0 and "\n" in self.text[a + arrow : b] and (")" in head[:arrow] or inside):
            at = self.code.index("=>", a)
            if self.language == "csharp":
                self.edits.append((at + 2, b, " default /* ... */", 1))
            else:
                self.edits.append((at, b + 1, "{ /* ... */ }", 1))
            self.bodies.append((at, b))
            self.say(depth, a, at)
            return
        if self.language in ("kotlin", "scala") and multi and (m := re.search(r"\b(?:fun|def)\b[^=]*?(?<![<>=!])=(?!=)", self.code[a:b])):
            at = a + m.end()
            if self.language == "kotlin":
                self.edits.append((at, b, " TODO() /* ... */", 1))
            else:
                begin = at + re.match(r"\s*", self.code[at:b]).end()
                if self.text[begin:b].strip() != "{ /* ... */ }":
                    self.edits.append((begin, b, "{ /* ... */ }", 1))
            self.bodies.append((at, b))
            self.say(depth, a, at)
            return
        if m := re.search(r"\b(?:fun|def)\b[^=]*=", bare) if self.language in ("kotlin", "scala") else None:
            self.say(depth, a, a + m.end())
        elif self.language in ("typescript", "tsx", "javascript") and depth >= 0 and (m := re.search(r"=>", bare)) and re.search(r"\b(?:const|let|var)\b|^\w+\s*=", bare):
            self.say(depth, a, a + m.end())
        elif inside and depth > 0 and re.search(self.rules.member, bare) and not _CONTROL.match(bare) and not re.match(r"(?:import|export\s*[{*]|package|public:|private:|protected:)", bare):
            self.say(depth, a, b)
        elif depth >= 0 and (re.search(self.rules.declaration, bare) or self.language in ("c", "cpp") and re.search(r"\)\s*$", bare) and "=" not in bare):
            one = re.sub(r"\{[^{}]*\}", "", self.bare[a:b]) if self.language == "c" else self.bare[a:b].split("\n")[0]
            self.outline.append("  " * depth + tidy(one))
        elif depth >= 0 and self.language in ("typescript", "tsx") and re.match(r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b", bare):
            self.say(depth, a, b)

    def walk(self, lo: int, hi: int, depth: int, inside: bool) -> None:
        code, rules = self.code, self.rules
        start, i = lo, lo
        while (m := _TOKEN.search(code, i, hi)) is not None:
            at, i = m.start(), m.end()
            if m[0] in "([":
                self.arguments(i, self.pairs[at])
                i = self.pairs[at] + 1
            elif m[0] == ";":
                self.statement(start, at, depth, inside)
                start = i
            elif m[0] == "\n":
                preprocessor = self.language in ("c", "cpp", "objc", "csharp") and code[start:at].lstrip().startswith("#") or self.language == "objc" and code[start:at].lstrip().startswith("@") and not code[start:at].lstrip().startswith("@property")
                if preprocessor or rules.newlines and code[start:at].strip() and not _OPEN_END.search(code[start:at]) and not _OPEN_START.match(code[at:hi]):
                    if preprocessor:
                        head = code[start:at].strip()
                        if head.startswith(("@interface", "@implementation", "@protocol")):
                            self.say(0, start, at)
                            depth, inside = 1, True
                        elif head.startswith("@end"):
                            depth, inside = 0, False
                    else:
                        self.statement(start, at, depth, inside)
                    start = i
            elif m[0] == "{":
                close = self.pairs[at]
                head = code[start:at]
                bare = re.sub(r"^(?:\s|public:|private:|protected:)+", "", head).rstrip()
                begin = start + len(head) - len(head.lstrip())
                begin += len(re.match(r"(?:(?:public|private|protected):\s*)*", code[begin:at])[0])
                expression = self.language in ("kotlin", "scala") and re.search(r"\b(?:fun|def)\b[^=]*(?<![<>=!])=(?!=)\s*\S", bare)
                if expression:
                    i = close + 1
                    continue
                control = _CONTROL.match(bare)
                if not control and re.search(rules.container, head.rstrip() or head):
                    one = "\n" not in code[at:close]
                    if self.language == "zig":
                        begin = self.fields(begin, at, depth, inside)
                        self.say(depth, begin, close + 1 if one else begin + re.search(r"\s*=[^=]*$|$", code[begin:at]).start())
                    else:
                        self.say(depth, begin, at)
                    if not (self.language == "zig" and one):
                        self.walk(i, close, depth + 1 if depth >= 0 else -1, True)
                elif self._is_function(bare, head, inside, control, at, close):
                    begin = self.fields(begin, at, depth, inside) if self.language == "zig" else begin
                    self.say(depth, begin, at)
                    self.body(at, close)
                elif not control and re.search(rules.declaration, bare):
                    if self.language in ("c", "cpp") and "typedef" in bare:
                        i = close + 1
                        continue
                    one = "\n" not in self.text[at:close]
                    self.say(depth, begin, close + 1 if one and self.language not in ("c", "cpp", "go") else at)
                elif self.language == "csharp" and inside and re.fullmatch(r"[\s\w<>,\[\]?.@]+", bare) and re.search(r"\b(?:get|set|init|add|remove)\b", code[at:close]):
                    self.say(depth, begin, close + 1 if "\n" not in self.text[at:close] else at)
                    self.walk(i, close, -1, True)
                else:
                    literal = bare.endswith(("=", ":", "(", ",", "?")) or re.search(r"=\s*[\w.]+\s*$", bare)
                    self.walk(i, close, -1, self.language == "zig" and inside)
                    if literal:
                        i = close + 1
                        continue
                start = i = close + 1
        if code[start:hi].strip():
            self.statement(start, hi, depth, inside)

    def _is_function(self, bare: str, head: str, inside: bool, control: re.Match | None, at: int, close: int) -> bool:
        if control or self.language == "zig" and not re.search(self.rules.function, bare):
            return False
        if not bare:
            return self.language == "java" and inside
        if self.language == "swift" and re.search(r"\bvar\s+\w+\s*:[^={}]+$", bare):
            return re.fullmatch(r"[\s]*(?:get|set|async|throws|mutating|nonmutating|\s)*", self.code[at + 1 : close]) is None
        if self.language == "java" and re.fullmatch(r"(?:(?:public|private|protected)\s+)?[A-Z]\w*", bare):
            return inside
        if re.search(self.rules.function, bare):
            return not (self.language == "java" and not inside and bare == "static")
        if not self.rules.calls or ")" not in bare:
            return False
        tail = bare[bare.rfind(")") + 1 :]
        if self.language in ("c", "cpp"):
            return not re.search(r"=", tail) and not bare.startswith(("#", "@")) and re.match(r"[\w\s:*&<>\-\[\],.]*$", tail) is not None
        return re.match(r"(?:\s*(?:async\*?|sync\*|throws[\w\s,.]*|const|override|where\b.*|:.*|->.*))?\s*$", tail, re.S) is not None and re.search(r"[\w\]>\"'=+\-*/!<&|^~%]\s*(?:<[^()]*>)?\(", bare) is not None


#: Languages with ``#if``, and how many of its branches are read.
CONDITIONAL, MAX_BRANCHES = ("c", "cpp", "objc", "csharp", "swift"), 5


def brace_skeleton(text: str, language: str, comments: str = "all", bodies: bool = True) -> Result:
    """A language with braces: bodies of functions are emptied, containers are looked into. Of conditional code each branch is read by itself."""
    code, bare, found = lexing.masked(text, language)
    branches = min(lexing.branch_count(code), MAX_BRANCHES) if language in CONDITIONAL else 0
    edits, inner, outline, errors = [], [], [], True
    for k in range(max(branches, 1)):
        own, said = (lexing.blank_branches(x, k) for x in (code, bare)) if branches else (code, bare)
        scan = _BraceScan(text, own, said, BRACES[language], language)
        if scan.pairs is None:
            continue
        scan.walk(0, len(own), 0, False)
        errors = False
        outline += [x for x in scan.outline if x not in outline] if k else scan.outline
        inner += scan.bodies
        edits += [e for e in scan.edits if not any(e[0] < b and a < e[1] for a, b, *_ in edits)]
    cuts = lexing.comment_cuts(text, code, found, comments, inner) if comments != "all" else []
    content, n, cut = apply(text, edits if bodies else [], cuts)
    return Result(content, n, cut, errors, _unrepeated(outline))


def _unrepeated(lines: list[str]) -> list[str]:
    return [x for k, x in enumerate(lines) if x.strip() and (not k or x != lines[k - 1])]


# Languages whose blocks end with a word.


@dataclass(frozen=True)
class Blocks:
    """A language with ``end``: what opens a block at the start of a statement, and anywhere; functions, containers, what stands for a body."""

    opens: str
    function: str
    container: str
    short: str = r"(?!)"  # forms of functions without a block
    comment: str = "# ..."


BLOCKS: dict[str, Blocks] = {
    "ruby": Blocks(r"(?:(?<=^)|(?<=[;=(\s]))(?:class|module|def|begin|case)\b|(?m:(?<=\n)|^)[ \t]*(?:if|unless|while|until|for)\b|\bdo\b(?=\s*(?:\|[^|]*\|)?\s*(?:\n|;|$))", r"def\b", r"class\b|module\b", r"def\b[^\n;]*[)\w?!]\s*=\s"),
    "elixir": Blocks(r"\bdo\b(?!:)|\bfn\b", r"(?:def|defp|defmacro|defmacrop|defguard|defguardp|defdelegate|defn|defnp|test)\b", r"(?:defmodule|defprotocol|defimpl)\b"),
    "lua": Blocks(r"\b(?:function|if|do|repeat)\b", r"function\b", r"(?!)", comment="--[[ ... ]]"),
    "julia": Blocks(r"(?:(?<=^)|(?<=[\n;=(\s]))(?:function|macro|module|baremodule|begin|let|if|for|while|try|quote|do|struct|mutable\s+struct)\b|\b(?:abstract|primitive)\s+type\b", r"(?:function|macro)\b", r"(?:module|baremodule)\b", comment="#= ... =#"),
}


def block_skeleton(text: str, language: str, comments: str = "all", bodies: bool = True) -> Result:
    """Ruby, Elixir, Lua, Julia: words open and close blocks."""
    rules = BLOCKS[language]
    code, bare, found = lexing.masked(text, language)
    token = re.compile(rf"(?P<open>{rules.opens})|(?P<end>\bend\b|\buntil\b)" if language == "lua" else rf"(?P<open>{rules.opens})|(?P<end>(?<![.:@])\bend\b(?!\s*:))", re.M)
    stack: list[tuple[str, int, int, str]] = []  # word, start of the statement, end of the header, kind
    edits: list[Edit] = []
    inner: list[tuple[int, int]] = []
    outline: list[tuple[int, int, str]] = []
    errors = False
    for m in token.finditer(code):
        word = (m["open"] or "").strip()
        line = code.rfind("\n", 0, m.start()) + 1
        if m["end"]:
            if language == "julia" and _in_brackets(code, m.start()):
                continue
            if not stack or language == "lua" and m["end"] == "until" and stack[-1][0] != "repeat":
                errors = not stack
                continue
            word, begin, header, kind = stack.pop()
            if kind in ("function", "call") and not any(k in ("function", "call") for *_, k in stack):
                _block_body(text, code, language, rules, begin, header, m.start(), edits)
                inner.append((header, m.start()))
            continue
        if language == "ruby":
            if word.startswith("def") and re.match(rules.short, code[m.start() :]):
                if not any(k == "function" for *_, k in stack):
                    outline.append((len([1 for *_, k in stack if k == "container"]), m.start(), tidy(re.split(r"\s*=\s", bare[line : code.find("\n", m.start())])[0])))
                continue
            if word == "do" and re.search(r"\b(?:while|until|for)\b[^\n]*$", code[line : m.start()]):
                continue
        if language == "lua" and word == "do" and re.search(r"\b(?:while|for)\b[^;]*$", code[max(0, line - 200) : m.start()]) and stack and stack[-1][0] == "loop":
            continue
        if language == "julia" and (word in ("if", "for") and _in_brackets(code, m.start()) or word.startswith("struct") and code[: m.start()].rstrip().endswith("mutable") or word in ("begin", "end") and _in_brackets(code, m.start())):
            continue
        begin = m.start()
        if language in ("elixir",):
            begin = line + len(code[line:]) - len(code[line:].lstrip())
            head = code[begin : m.start()]
            if not re.match(r"\w", head) and word == "do":  # the header began on an earlier line
                back = re.search(rf"(?m)^[ \t]*(?:{rules.function}|{rules.container})[^\n]*(?:\n[^\n]*){{0,8}}\Z", code[: m.start()])
                begin = back.start() + len(back[0]) - len(back[0].lstrip()) if back else begin
            said = code[begin:]
            kind = "function" if re.match(rules.function, said) else "container" if re.match(rules.container, said) else "other"
            header = m.end()
        else:
            kind = "function" if re.match(rules.function, word) else "container" if re.match(rules.container, word) else "other"
            header = _header_end(code, language, m.end())
            if language == "ruby" and word == "do" and re.match(r"[ \t]*(?:it|specify|test|before|after|setup|teardown|should|scenario|example)\b", code[line:]):
                kind, header = "call", m.end() + re.match(r"[ \t]*(?:\|[^|]*\|)?", code[m.end() :]).end()
        if kind not in ("other", "call") and not any(k in ("function", "call") for *_, k in stack):
            outline.append((len([1 for *_, k in stack if k == "container"]), begin, tidy(bare[line if language == "lua" else begin : m.start() if language == "elixir" else header])))
        stack.append((word, begin, header, kind))
    if language == "elixir":
        for m in re.finditer(rf"(?m)^([ \t]*)({rules.function}[^\n]*?),\s*do:", code):
            outline.append((_depth_at(outline, m.start()), m.start() + len(m[1]), tidy(bare[m.start(2) : m.end(2)])))
    errors = errors or bool(stack)
    cuts = lexing.comment_cuts(text, code, found, comments, inner) if comments != "all" else []
    content, n, cut = apply(text, edits if bodies and not errors else [], cuts)
    lines = ["  " * d + x for d, _, x in sorted(outline, key=lambda o: o[1])] if language != "lua" else []
    return Result(content, n, cut, errors, _unrepeated(lines))


def _depth_at(outline: list[tuple[int, int, str]], at: int) -> int:
    before = [o for o in outline if o[1] < at]
    return max((o[0] + (o[2].startswith("def") and "module" in o[2].split(" ")[0]) for o in before[-1:]), default=0)


def _in_brackets(code: str, at: int) -> bool:
    depth = 0
    for c in reversed(code[max(0, at - 400) : at]):
        depth += (c in ")]") - (c in "([")
        if depth < 0:
            return True
    return False


def _header_end(code: str, language: str, at: int) -> int:
    """End of a function's header: after its parameters, or its line."""
    m = re.compile(r"[ \t]*[\w.:?!=<>+\-*/%\[\]~^&|]*[ \t]*").match(code, at)
    i = m.end() if language != "julia" else re.compile(r"[ \t]*[\w.!]*(?:\{[^}]*\})?").match(code, at).end()
    if language == "lua":
        i = re.compile(r"[ \t]*[\w.:]*[ \t]*").match(code, at).end()
    if code[i : i + 1] == "(":
        depth = 0
        for k in range(i, len(code)):
            depth += (code[k] == "(") - (code[k] == ")")
            if not depth:
                i = k + 1
                break
        if language == "julia":
            rest = re.compile(r"(?:::[\w{}.,<: ]+)?(?:[ \t]+where[^\n;]*)?").match(code, i)
            i = rest.end()
        return i
    ends = [k for k in (code.find("\n", at), code.find(";", at)) if k >= 0]
    return min(ends, default=len(code))


def _block_body(text: str, code: str, language: str, rules: Blocks, begin: int, header: int, end: int, edits: list[Edit]) -> None:
    inside = text[header:end]
    said = inside.strip().strip(";").strip()
    if not said or said in (rules.comment, '"..."'):
        return
    if language == "julia":
        edits.append((header, end, f" {rules.comment} ", 1))
        return
    line = text.rfind("\n", 0, begin) + 1
    lead = re.match(r"[ \t]*", text[line:])[0]
    if "\n" in inside:
        edits.append((header, end, f"\n{lead}  {rules.comment}\n{lead}", 1))
    elif language == "ruby":
        edits.append((header, end, '; "..." ', 1))
    elif language == "lua":
        edits.append((header, end, f" {rules.comment} ", 1))


def bash_skeleton(text: str, comments: str = "all", bodies: bool = True) -> Result:
    """Functions of shell scripts; braces of expansions are none."""
    code, bare, found = lexing.masked(text, "bash")
    edits, inner, outline = [], [], []
    head = re.compile(r"(?m)^[ \t]*(?:function[ \t]+([\w:.-]+)[ \t]*(?:\(\))?|([\w:.-]+)[ \t]*\(\))\s*\{")
    at = 0
    while m := head.search(code, at):
        depth, k = 1, m.end()
        while depth and k < len(code):
            if code[k] == "$" and code[k + 1 : k + 2] == "{":
                k = max(code.find("}", k), k + 1)
            else:
                depth += (code[k] == "{") - (code[k] == "}")
            k += 1
        if depth:
            return Result(text, errors=True, outline=outline)
        outline.append(tidy(bare[m.start() : m.end() - 1]))
        inner.append((m.end() - 1, k))
        if text[m.end() : k - 1].strip() != ": '...';":
            edits.append((m.end() - 1, k, "{ : '...'; }", 1))
        at = k
    cuts = lexing.comment_cuts(text, code, found, comments, inner) if comments != "all" else []
    content, n, cut = apply(text, edits if bodies else [], cuts)
    return Result(content, n, cut, False, outline)


# Languages laid out by indentation.


def _top_items(code: str, lead: str = r"") -> list[tuple[int, int]]:
    """Runs of lines from one that begins at the margin to the next."""
    starts = [m.start() for m in re.finditer(rf"(?m)^{lead}\S", code)]
    return [(a, b) for a, b in zip(starts, [*starts[1:], len(code)])]


def haskell_skeleton(text: str, comments: str = "all", bodies: bool = True) -> Result:
    """Equations of several lines, or of more than 80 characters, are undefined."""
    code, bare, found = lexing.masked(text, "haskell")
    edits, inner, outline, signed = [], [], [], set()
    for a, b in _top_items(code):
        item = code[a:b].rstrip()
        end = a + len(item)
        word = re.match(r"[\w']+", item)
        if re.match(r"(?:module|import)\b", item):
            continue
        if re.match(r"(?:class|instance)\b", item):
            outline.append(tidy(bare[a : a + (re.search(r"\bwhere\b|$", item).start())]))
            outline += ["  " + tidy(x) for x in re.findall(r"(?m)^[ \t]+([\w', ]+::[^\n]*)", bare[a:end])]
        elif re.match(r"(?:data|newtype|type|deriving|infix[lr]?)\b", item):
            outline.append(tidy(bare[a:end].split("\n")[0]))
        elif m := re.match(r"[\w', ]+::", item):
            signed |= set(re.findall(r"[\w']+", m[0]))
            outline.append(tidy(bare[a:end]))
        elif word and (m := re.search(r"(?<![=<>/!:+*&|.$^-])=(?![=>])|\n[ \t]*\|", item)):
            if word[0] not in signed:
                outline.append(tidy(bare[a : a + m.start()]))
                signed.add(word[0])
            # Whole equations only: guards go with what follows them.
            at = a + m.start()
            right = text[at:end]
            if "\n" in right.strip() or len(right) > 80:
                inner.append((at, end))
                if "undefined {- ... -}" not in right:
                    lead = "" if text[at - 1 : at] in (" ", "\n") else " "
                    edits.append((at, end, f"{lead if item[m.start()] == '=' else ' '}= undefined {{- ... -}}", 1))
    cuts = lexing.comment_cuts(text, code, found, comments, inner) if comments != "all" else []
    content, n, cut = apply(text, edits if bodies else [], cuts)
    return Result(content, n, cut, False, _unrepeated(outline))


def ocaml_skeleton(text: str, comments: str = "all", bodies: bool = True, interface: bool = False) -> Result:
    """Bindings of several lines that take parameters, unit, or ``function``."""
    code, bare, found = lexing.masked(text, "ocaml")
    edits, inner, outline = [], [], []
    words = re.compile(r"\b(?:struct|sig|object|begin|end)\b")
    depth_of, depth = {}, 0
    for m in words.finditer(code):
        depth += -1 if m[0] == "end" else 1
        depth_of[m.end()] = depth
    errors = depth != 0
    borders = sorted(depth_of)

    def level(at: int) -> int:
        from bisect import bisect_right

        k = bisect_right(borders, at)
        return depth_of[borders[k - 1]] if k else 0

    keyword = re.compile(r"(?m)^([ \t]*)(let(?:\s+rec)?|and|module(?:\s+type)?|type|exception|external|val|class|method|open|include|end)\b")
    heads = list(keyword.finditer(code))
    for m, following in zip(heads, [*heads[1:], None]):
        indent = len(m[1])
        stop = len(code)
        for x in heads[heads.index(m) + 1 :]:
            if len(x[1]) <= indent:
                stop = x.start()
                break
        del following
        item = code[m.start(2) : stop].rstrip()
        # Comments before the next binding belong to it.
        end = m.start(2) + len(item)
        nest = level(m.start())
        word = m[2].split()[0]
        if word in ("module", "class", "type", "exception", "external", "val"):
            outline.append("  " * nest + tidy(re.sub(r"=?\s*(?:struct|sig|object)\b.*", "", bare[m.start(2) : end].split("\n")[0])))
        if word in ("let", "and") and not interface:
            eq = re.search(r"(?<![<>=!:|&+*-])=(?![=>])", item)
            if not eq:
                continue
            outline.append("  " * nest + tidy(bare[m.start(2) : m.start(2) + eq.start()]))
            head = re.sub(r"^(?:let(?:\s+rec)?|and)\s+", "", item[: eq.start()]).strip()
            right = m.start(2) + eq.end()
            begin = right + re.match(r"\s*", code[right:]).end()
            takes = len(re.sub(r":[^)]*$", "", head).split()) > 1 or code[begin:].startswith(("function", "fun "))
            if takes and "\n" in text[m.start(2) + eq.start() : end]:
                inner.append((begin, end))
                if not text[begin:end].startswith("assert false"):
                    edits.append((begin, end, "assert false (* ... *)", 1))
    cuts = lexing.comment_cuts(text, code, found, comments, inner) if comments != "all" else []
    content, n, cut = apply(text, edits if bodies and not errors else [], cuts)
    return Result(content, n, cut, errors, _unrepeated(outline))


#: Parsers by language: (text, comments, bodies) -> Result.
Parser = Callable[[str, str, bool], Result]
PARSERS: dict[str, Parser] = {}


def register(language: str, parser: Parser) -> None:
    """Add a language's parser, or replace one."""
    PARSERS[language] = parser


for _name in BRACES:
    register(_name, lambda t, c, b, k=_name: brace_skeleton(t, k, c, b))
for _name in BLOCKS:
    register(_name, lambda t, c, b, k=_name: block_skeleton(t, k, c, b))
register("bash", bash_skeleton)
register("haskell", haskell_skeleton)
register("ocaml", ocaml_skeleton)
register("ocaml_interface", lambda t, c, b: ocaml_skeleton(t, c, b, True))

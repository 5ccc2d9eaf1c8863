"""Skeletons and outlines of source text: Python by its own parser, other languages by :mod:`parsers`, pages and notebooks by their parts."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import paths
from lodestone.operators import lexing, parsers
from lodestone.operators.lexing import blank_branches
from lodestone.operators.parsers import Edit, Result, apply, tidy

__all__ = ["Result", "Transformed", "blank_branches", "chunks", "embedded_regions", "notebook_script", "outline", "skeleton", "skeletons", "transform_text", "transformed"]

SCHEMA = "path string, content string, stripped_bodies int, stripped_comments int, parse_errors boolean, outline string"
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _is_doc(node: ast.stmt) -> bool:
    return isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str)


def _is_stub(body: list[ast.stmt]) -> bool:
    one = body[0]
    return len(body) == 1 and (isinstance(one, ast.Pass) or isinstance(one, ast.Expr) and isinstance(one.value, ast.Constant) and one.value.value is ...)


def python_skeleton(text: str, comments: str = "all", bodies: bool = True) -> Result:
    """Function bodies become ``...``; docstrings stay unless no comment is wanted."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return Result(text, errors=True)
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)

    def place(row: int, col: int) -> int:
        return starts[row - 1] + len(lines[row - 1].encode()[:col].decode("utf-8", "ignore"))

    code, bare, found = lexing.masked(text, "python")
    edits: list[Edit] = []
    cuts: list[tuple[int, int]] = []
    inner: list[tuple[int, int]] = []
    outline: list[str] = []

    def header(node: ast.stmt, body: list[ast.stmt]) -> str:
        a = place(node.lineno, node.col_offset)
        b = place(body[0].lineno, body[0].col_offset)
        # Up to the colon that opens the body.
        cut = code.rfind(":", a, b) if ":" in code[a:b] else b
        return tidy(bare[a:cut])

    def walk(node: ast.AST, depth: int, inside: bool) -> None:
        if isinstance(node, (ast.Module, ast.ClassDef, *_DEFS)) and comments == "none" and node.body and _is_doc(node.body[0]) and not (bodies and (inside or isinstance(node, _DEFS))):
            doc = node.body[0]
            a, b = place(doc.lineno, doc.col_offset), place(doc.end_lineno, doc.end_col_offset)
            if len(node.body) == 1 and not isinstance(node, ast.Module):
                edits.append((a, b, "...", 0))
            else:
                cuts.append(lexing.removal(text, a, b))
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                if not inside:
                    outline.append("  " * depth + header(child, child.body))
                walk(child, depth + 1, inside)
            elif isinstance(child, _DEFS):
                if not inside:
                    outline.append("  " * depth + header(child, child.body))
                body = child.body
                rest = body[1:] if _is_doc(body[0]) and comments != "none" else body
                if not inside and rest:
                    first = rest[0]
                    row = min([first.lineno, *(d.lineno for d in getattr(first, "decorator_list", []))])
                    a = place(row, first.col_offset) if row == first.lineno else starts[row - 1] + len(lines[row - 1]) - len(lines[row - 1].lstrip())
                    b = place(rest[-1].end_lineno, rest[-1].end_col_offset)
                    inner.append((place(child.lineno, child.col_offset), b))
                    if bodies and not _is_stub(rest):
                        edits.append((a, b, "...", 1))
                walk(child, depth, True)
            else:
                walk(child, depth, inside)

    try:
        walk(tree, 0, False)
    except RecursionError:
        return Result(text, errors=True)
    if comments != "all":
        cuts += lexing.comment_cuts(text, code, found, comments, inner)
    content, n, cut = apply(text, edits, cuts)
    return Result(content, n, cut + sum(not e[3] for e in edits), False, outline)


parsers.register("python", python_skeleton)


def skeleton(text: str, language: str | None, comments: str = "all", bodies: bool = True) -> Result:
    """A file's skeleton; whatever goes wrong in a parser, and a language without one, gives the text as it is, marked."""
    parser = parsers.PARSERS.get(language or "")
    if parser is None:
        return Result(text, errors=language is not None)
    try:
        return parser(text, comments, bodies)
    except Exception:  # a parser's failure must not fail the task
        return Result(text, errors=True)


def outline(text: str, language: str | None) -> str:
    """A line a declaration, members indented; empty if there is none."""
    lines = skeleton(text, language).outline
    return "\n".join(lines) + "\n" if lines else ""


# Pages and notebooks

_SCRIPT = re.compile(r"<script\b([^>]*)>(.*?)</script\s*>", re.S | re.I)
_SCRIPT_LANGUAGES = {"ts": "typescript", "typescript": "typescript", "tsx": "tsx", "js": "javascript", "javascript": "javascript", "jsx": "javascript"}
EMBEDDED = ("vue", "svelte", "astro")


def embedded_regions(text: str, kind: str = "vue") -> list[tuple[int, int, str]]:
    """The scripts of a page and their languages; of an ``astro`` page also what stands between its first rules of dashes."""
    out, offset, usual = [], 0, "javascript"
    if kind == "astro":
        usual = "typescript"
        if m := re.match(r"\s*---\r?\n(.*?)\r?\n---", text, re.S):
            out.append((m.start(1), m.end(1), usual))
            offset = m.end()
    for m in _SCRIPT.finditer(text, offset):
        if re.search(r"\btype\s*=\s*[\"']?(?:application/(?:ld\+)?json|text/(?:x-)?template)", m[1], re.I):
            continue
        lang = re.search(r"\blang\s*=\s*[\"']?([a-z]+)", m[1], re.I)
        language = _SCRIPT_LANGUAGES.get(lang[1].lower()) if lang else usual
        if language:
            out.append((m.start(2), m.end(2), language))
    return out


def embedded_skeleton(text: str, kind: str, comments: str = "all", bodies: bool = True) -> Result:
    """A page whose scripts are skeletons; markup stays."""
    out, at, total = [], 0, Result("")
    for a, b, language in embedded_regions(text, kind):
        got = skeleton(text[a:b], language, comments, bodies)
        out += [text[at:a], got.content]
        at = b
        total.bodies, total.comments, total.errors = total.bodies + got.bodies, total.comments + got.comments, total.errors or got.errors
        total.outline += got.outline
    total.content = "".join([*out, text[at:]])
    return total


for _kind in EMBEDDED:
    parsers.register(_kind, lambda t, c, b, k=_kind: embedded_skeleton(t, k, c, b))

#: Language, extension and comment mark of a notebook's kernel.
KERNELS = {"python": ("python", ".py", "#"), "julia": ("julia", ".jl", "#"), "r": ("r", ".r", "#"), "scala": ("scala", ".scala", "//"), "typescript": ("typescript", ".ts", "//"), "javascript": ("javascript", ".js", "//")}
_MAGIC = re.compile(r"\s*[%!?]|\s*[\w.]+\?{1,2}\s*$")


def notebook_script(text: str) -> tuple[str, str, str] | None:
    """A notebook's cells as a script (without outputs), its extension and its fence; None if the text is no notebook."""
    try:
        book = json.loads(text)
    except ValueError:
        return None
    if not isinstance(book, dict) or not isinstance(book.get("cells"), list):
        return None
    about = book.get("metadata") or {}
    name = str((about.get("kernelspec") or {}).get("language") or (about.get("language_info") or {}).get("name") or "python").lower()
    language, extension, mark = KERNELS.get(name, (name, ".txt", "#"))
    blocks = []
    for cell in book["cells"]:
        source = cell.get("source") or ""
        body = ("".join(source) if isinstance(source, list) else str(source)).replace("\r\n", "\n").rstrip()
        if cell.get("cell_type") == "code":
            lines = body.split("\n")
            if name == "python":
                whole = re.match(r"\s*%%", body)
                lines = [f"# {x}".rstrip() if whole else f"# {x}" if _MAGIC.match(x) else x for x in lines]
            blocks.append(f"{mark} %%\n" + "\n".join(lines) if body else f"{mark} %%")
        elif cell.get("cell_type") in ("markdown", "raw"):
            said = "".join(f"\n{mark} {x}" if x else f"\n{mark}" for x in body.split("\n")) if body else ""
            blocks.append(f"{mark} %% [{cell['cell_type']}]{said}")
    return ("\n\n".join(blocks) + "\n" if blocks else ""), extension, language


# The transform of a file

MAX_LINES, MAX_CHARS = 200, 16_000


@dataclass
class Transformed:
    content: str
    strategy: str
    language: str | None = None
    fence: str = "text"
    bodies: int = 0
    comments: int = 0
    errors: bool = False


def cut_text(text: str, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS) -> tuple[str, bool]:
    """A text up to the limits, cut at a line's end where there is one, with what was dropped."""
    end = len(text)
    at = -1
    for _ in range(max_lines):
        at = text.find("\n", at + 1)
        if at < 0:
            break
    end = min(end if at < 0 else at + 1, max_chars)
    if end >= len(text):
        return text, False
    last = text.rfind("\n", 0, end)
    end = last + 1 if last > 0 else end
    kept, rest = text[:end], text[end:]
    lines = rest.count("\n") + (not rest.endswith("\n"))
    return f"{kept}{'' if kept.endswith(chr(10)) else chr(10)}... [truncated: {lines} more line{'' if lines == 1 else 's'}, {len(rest)} chars]\n", True


def is_minified(text: str) -> bool:
    lines = text.split("\n")
    return len(text) >= 4096 and max(map(len, lines)) >= 2000 and len(text) / len(lines) > 300


def transform_text(path: str, text: str, mode: str = "skeleton", comments: str = "all", max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, language: str | None = None) -> Transformed:
    """How one file is shown in a mode (full, skeleton, outline), as :func:`transform.strategy` decides in columns."""
    if path.lower().endswith(".ipynb") and (book := notebook_script(text)):
        script, extension, fence = book
        got = transform_text(path + extension, script, mode, comments, max_lines, max_chars)
        got.language, got.fence = "notebook", fence
        return got
    language = language or paths.language_of(path)
    fence = paths.fence_of(path)
    if mode != "full" and not re.search(paths.PROSE_PATH, path.lower()) and is_minified(text):
        lines = text.count("\n") + 1
        return Transformed(f"[minified: {lines} line{'' if lines == 1 else 's'}, {len(text)} chars omitted]\n", "minified", language, fence)
    if mode == "outline" or mode == "skeleton" and language and paths.is_generated_head(text):
        got = skeleton(text, language) if language else Result(text)
        if got.outline:
            return Transformed("\n".join(got.outline) + "\n", "outline", language, "text", errors=got.errors)
        mode = "skeleton"
    if language:
        bodies = mode == "skeleton"
        if not bodies and comments == "all":
            return Transformed(text, "full", language, fence)
        got = skeleton(text, language, comments, bodies)
        if got.errors and got.content == text and bodies and language not in parsers.PARSERS:
            content, cut = cut_text(text, max_lines, max_chars)
            return Transformed(content, "truncated" if cut else "full", language, fence, errors=True)
        return Transformed(got.content, "skeleton" if bodies else "full", language, fence, got.bodies, got.comments, got.errors)
    content, cut = (text, False) if mode == "full" else cut_text(text, max_lines, max_chars)
    return Transformed(content, "truncated" if cut else "full", None, fence)


def chunks(text: str, low: int = 8192, high: int = 65536) -> list[str]:
    """Pieces that end where a line's own hash says so, at least ``low`` and at most ``high`` characters; they join to the text."""
    out, start, at = [], 0, 0
    for line in text.splitlines(keepends=True):
        at += len(line)
        signature = 0
        for c in line[:64]:
            signature = (signature * 31 + ord(c)) & 0xFFFFFFFF
        following = text[at : at + 1]
        if at - start >= high or at - start >= low and signature % 8 == 0 and following.strip() and following != "/":
            out.append(text[start:at])
            start = at
    return [*out, text[start:]] if start < len(text) else out


def skeletons(files: DataFrame, comments: str = "all") -> DataFrame:
    """Files (path, language, text) through the parsers, in small Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [skeleton(t or "", k, comments) for t, k in zip(pdf["text"], pdf["language"])]
            yield pd.DataFrame({"path": pdf["path"], "content": [g.content for g in got], "stripped_bodies": [g.bodies for g in got], "stripped_comments": [g.comments for g in got], "parse_errors": [g.errors for g in got], "outline": ["\n".join(g.outline) for g in got]})

    return files.select("path", "language", "text").mapInPandas(run, SCHEMA)


TRANSFORMED = "path string, level string, content string, strategy string, language string, fence string, stripped_bodies int, stripped_comments int, parse_errors boolean"
#: What a level of the ladder means: mode and comments (None: as asked for).
LEVELS = {"full": ("full", None), "skeleton": ("skeleton", None), "docs": ("skeleton", "docs"), "bare": ("skeleton", "none"), "outline": ("outline", None)}


def transformed(files: DataFrame, comments: str = "all", max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS) -> DataFrame:
    """Files (path, language, text, level) as each level shows them: ``TRANSFORMED``. A file that is omitted has no content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, language, text, level in zip(pdf["path"], pdf["language"], pdf["text"], pdf["level"]):
                if level == "omitted":
                    rows.append((path, level, "", "omitted", language, paths.fence_of(path), 0, 0, False))
                    continue
                mode, own = LEVELS[level]
                g = transform_text(path, text or "", mode, own or comments, max_lines, max_chars, language)
                rows.append((path, level, g.content, g.strategy, g.language, g.fence, g.bodies, g.comments, g.errors))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TRANSFORMED.split(", ")])

    return files.select("path", "language", "text", "level").mapInPandas(run, TRANSFORMED)


def unrepeated(lines: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Lines without those that say what the one before says."""
    before = F.lag(text).over(Window.partitionBy(group).orderBy(order))
    return lines.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(text))).drop("_before")

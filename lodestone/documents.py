"""Documents of a pack: Markdown, XML and JSON, whole or in parts, put together block by block."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.operators import graph, render
from lodestone.operators.transform import with_newline

EXTENSION = {"markdown": "md", "xml": "xml", "json": "json"}


@dataclass
class Options:
    """What stands around the files; ``part``: number and total."""

    tree: bool = True
    instructions: str | None = None
    focus: tuple[str, ...] = ()
    deps: bool = False
    diff: tuple[str, str] | None = None
    diff_last: bool = False
    part: tuple[int, int] | None = None


@dataclass
class Part:
    index: int
    total: int
    paths: list[str]
    tokens: int
    oversized: list[str]


def _attribute(text: str) -> str:
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        text = text.replace(a, b)
    return text


def _fenced(text: str, kind: str) -> str:
    run = longest = 0
    for c in text:
        run = run + 1 if c == "`" else 0
        longest = max(longest, run)
    fence = "`" * max(3, longest + 1)
    return f"{fence}{kind}\n{text}{'' if text.endswith(chr(10)) else chr(10)}{fence}\n"


def block(form: str) -> Column:
    """A file's part of the document, from the columns of a pack's files."""
    note = render.note(F.col("strategy"), F.col("focused"), F.col("language"))
    if form == "xml":
        return F.concat(render.xml_open(F.col("path"), F.col("language"), F.col("strategy"), F.col("focused"), F.col("related")), F.lit("\n"), with_newline(F.col("content")), F.lit("</file>\n"))
    if form == "json":
        fields = F.struct("path", "language", "strategy", "focused", F.nullif("related", F.lit(False)).alias("related"), "size", F.col("stripped_bodies").alias("strippedBodies"), "content")
        return F.to_json(fields)
    return F.concat(render.markdown_block(F.col("path"), note, F.col("fence"), F.col("content")), F.lit("\n"))


@dataclass
class _Around:
    flags: dict[str, bool]
    n_files: int
    n_here: int
    tree: str
    deps: list[tuple[str, str]]


def _around(result, options: Options, paths: Iterable[str] | None = None) -> _Around:
    files = result.files
    names = ("outline", "skeleton", "truncated", "omitted")
    r = files.agg(F.count("*").alias("n"), *[F.coalesce(F.bool_or(F.col("strategy") == s), F.lit(False)).alias(s) for s in names], F.coalesce(F.bool_or("focused"), F.lit(False)).alias("focus"), F.coalesce(F.bool_or(F.col("stripped_comments") > 0), F.lit(False)).alias("comments")).first()
    first = not options.part or options.part[0] == 1
    tree, deps = "", []
    if first and options.tree:
        noted = files.select(F.lit(0).alias("g"), "path", render.note(F.col("strategy"), F.col("focused"), F.col("language")).alias("note"))
        tree = "\n".join([".", *(x["line"] for x in render.tree(noted, "g", "note").orderBy("key").collect())])
    if first and options.deps and result.edges is not None:
        places = files.select("path", F.struct("sort_n", "sort_key").alias("ordinal"))
        deps = [tuple(x["line"].split(" -> ", 1)) for x in graph.rendered(result.edges, places).orderBy("ordinal").collect()]
    return _Around({**{k: r[k] for k in (*names, "focus", "comments")}}, r["n"], r["n"] if paths is None else len(list(paths)), tree, deps)


def _markdown(result, name: str, o: Options, a: _Around) -> tuple[str, str, str]:
    first = not o.part or o.part[0] == 1
    said = [f"mode: {result.mode}", f"{a.n_here} of {a.n_files} files" if o.part else f"{a.n_files} files", *([f"focus: {', '.join(o.focus)}"] if o.focus else [])]
    head = f"# {name}{f' (part {o.part[0]} of {o.part[1]})' if o.part else ''}\n\n> {' · '.join(said)}\n>\n> {render.legend(a.flags)}\n"
    if not first:
        head += f">\n> The directory structure is in the first of the {o.part[1]} parts.\n"
    head += "\n"
    if first and (o.instructions or "").strip():
        head += f"## Instructions\n\n{o.instructions.strip()}\n\n"
    if a.tree:
        head += f"## Directory structure\n\n```text\n{a.tree}\n```\n\n"
    if a.deps:
        head += "## Dependencies\n\nA line a file: the file, and the files that it imports.\n\n```text\n" + "\n".join(f"{x} -> {y}" for x, y in a.deps) + "\n```\n\n"
    diff = f"## Changes (since `{o.diff[0]}`)\n\n{_fenced(o.diff[1], 'diff')}\n" if first and o.diff and o.diff[1].strip() else ""
    return head + ("" if o.diff_last else diff) + "## Files\n\n", "", diff if o.diff_last else ""


def _xml(result, name: str, o: Options, a: _Around) -> tuple[str, str, str]:
    first = not o.part or o.part[0] == 1
    part = f' part="{o.part[0]}" parts="{o.part[1]}"' if o.part else ""
    focus = f' focus="{_attribute(",".join(o.focus))}"' if o.focus else ""
    head = f'<project name="{_attribute(name)}" mode="{result.mode}" files="{a.n_files}"{part}{focus}>\n<notes>{render.legend(a.flags)}</notes>\n'
    if first and (o.instructions or "").strip():
        head += f"<instructions>\n{o.instructions.strip()}\n</instructions>\n"
    if a.tree:
        head += f"<directory_structure>\n{a.tree}\n</directory_structure>\n"
    if a.deps:
        head += "<dependencies>\n" + "\n".join(f"{x} -> {y}" for x, y in a.deps) + "\n</dependencies>\n"
    diff = f'<diff ref="{_attribute(o.diff[0])}">\n{o.diff[1].rstrip(chr(10))}\n</diff>\n' if first and o.diff and o.diff[1].strip() else ""
    return head + ("" if o.diff_last else diff) + "<files>\n", "", "</files>\n" + (diff if o.diff_last else "") + "</project>\n"


def _json(result, name: str, o: Options, a: _Around) -> tuple[str, str, str]:
    first = not o.part or o.part[0] == 1
    top = {
        "project": name, "mode": result.mode, "focus": list(o.focus), "notes": render.legend(a.flags), "part": {"index": o.part[0], "total": o.part[1]} if o.part else None, "instructions": (o.instructions or "").strip() or None if first else None,
        "tree": a.tree or None, "diff": {"ref": o.diff[0], "text": o.diff[1]} if first and o.diff and o.diff[1].strip() else None, "dependencies": {x: y.split(", ") for x, y in a.deps} or None,
    }
    head = json.dumps({k: v for k, v in top.items() if v is not None}, indent=2, ensure_ascii=False)[:-2] + ',\n  "files": [\n'
    skipped = [{"path": r["path"], "reason": r["reason"]} for r in result.skipped.orderBy("path").collect()]
    tail = '\n  ],\n  "skipped": ' + json.dumps(skipped, indent=2, ensure_ascii=False).replace("\n", "\n  ") + "\n}\n"
    return head, ",\n", tail


#: What stands before, between and after the blocks, by form. Further forms can be added.
Renderer = Callable[..., tuple[str, str, str]]
RENDERERS: dict[str, Renderer] = {"markdown": _markdown, "xml": _xml, "json": _json}


def pieces(result, name: str, form: str, options: Options, paths: Iterable[str] | None = None) -> Iterator[str]:
    """The document in pieces; blocks come from the cluster one partition at a time, in order. ``paths``: the files of a part."""
    if form not in RENDERERS:
        raise ValueError(f"no such form: {form}; there are {', '.join(RENDERERS)}")
    around = _around(result, options, paths)
    head, between, tail = RENDERERS[form](result, name, options, around)
    yield head
    files = result.files.where("strategy <> 'omitted'")
    if paths is not None:
        files = files.where(F.col("path").isin(list(paths)))
    rows = files.select("sort_n", "sort_key", block(form).alias("b")).orderBy("sort_n", "sort_key")
    for k, r in enumerate(rows.toLocalIterator()):
        text = json.dumps(json.loads(r["b"]), indent=2, ensure_ascii=False).replace("\n", "\n    ") if form == "json" else r["b"]
        yield (between if k else "") + ("    " if form == "json" else "") + text
    yield tail


def overhead(result, form: str, options: Options, counter) -> int:
    """Tokens of a document without its files."""
    head, _, tail = RENDERERS[form](result, "project", options, _around(result, options))
    return result.files.sparkSession.range(1).select(counter(F.lit(head + tail)).alias("n")).first()["n"]

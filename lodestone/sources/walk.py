"""A tree of files as a Spark data source.

Spark's own listing drops names that begin with a dot or an underscore and follows links; this
one keeps the former and reports the latter. Ignored folders are pruned before they are
listed, cheap checks (rules, size) come before a file is opened, and each top-level entry is a partition.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.operators.filters import NOTEBOOK_FACTOR, SIZE_LIMIT, Rule, compile_rules, default_patterns, ignored

SCHEMA = "path string, size long, reason string, content binary"
IGNORE_FILES = (".gitignore", ".packignore")


@dataclass
class Entry(InputPartition):
    name: str


def _rule_lines(folder: str) -> list[str]:
    lines: list[str] = []
    for name in IGNORE_FILES:
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                lines += f.read().splitlines()
        except OSError:
            pass
    return lines


class TreeReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = os.path.abspath(options["path"])
        self.limit = int(options.get("maxsize", SIZE_LIMIT))
        self.extra = [x for x in options.get("ignore", "").split("\n") if x]
        self.include = [x for x in options.get("include", "").split("\n") if x]
        self.defaults = options.get("defaults", "true") == "true"
        self.follow = options.get("followlinks", "false") == "true"

    def _rules(self) -> list:
        lines = (default_patterns() if self.defaults else []) + self.extra
        info = os.path.join(self.root, ".git", "info", "exclude")
        if os.path.isfile(info):
            with open(info, encoding="utf-8", errors="replace") as f:
                lines += f.read().splitlines()
        return compile_rules(lines) + self._above() + compile_rules(_rule_lines(self.root), start=100_000)

    def _above(self) -> list:
        """Rules of the folders between the root and the repository that it lies in; none if they would hide the root itself."""
        folders, top = [], self.root
        while not os.path.isdir(os.path.join(top, ".git")):
            parent = os.path.dirname(top)
            if parent == top:
                return []
            folders, top = [parent, *folders], parent
        if not folders:
            return []
        lines = {os.path.relpath(f, top).replace(os.sep, "/"): _rule_lines(f) for f in folders}
        rel = os.path.relpath(self.root, top).replace(os.sep, "/")
        # As seen from the repository.
        whole = [r for f, own in lines.items() for r in compile_rules(own, base="" if f == "." else f)]
        if ignored(rel, whole, True):
            return []
        # A rule that is anchored above meets paths below the root by what is left of it.
        out = []
        for n, (f, own) in enumerate(lines.items()):
            for r in compile_rules(own, base="" if f == "." else f, start=50_000 + 1_000 * n):
                out.append(Rule(r.seq, r.base, r.regex, r.negated, r.dir_only, rel + "/"))
        return out

    def partitions(self) -> list[Entry]:
        # With links followed, one task must see which folder was met first.
        return [Entry("")] if self.follow else [Entry(n) for n in sorted(os.listdir(self.root))] or [Entry("")]

    def read(self, partition: Entry) -> Iterator[tuple]:
        seen: set[str] = set()
        if partition.name:
            yield from self._entry(partition.name, self._rules(), seen)
        elif self.follow:
            yield from self._folder("", self._rules(), seen)

    def _folder(self, folder: str, rules: list, seen: set[str]) -> Iterator[tuple]:
        try:
            names = sorted(os.listdir(os.path.join(self.root, folder)))
        except OSError:
            yield folder, None, "unreadable", None
            return
        paths = [f"{folder}/{n}" if folder else n for n in names]
        for is_dir in (False, True):
            for p in paths:
                if os.path.isdir(os.path.join(self.root, p)) == is_dir:
                    yield from self._entry(p, rules, seen)

    def _entry(self, path: str, rules: list, seen: set[str]) -> Iterator[tuple]:
        full = os.path.join(self.root, path)
        is_dir = os.path.isdir(full)
        if ignored(path, rules, is_dir):
            yield path, None, "ignored", None
        elif os.path.islink(full) and not self.follow:
            yield path, None, "symlink", None
        elif is_dir:
            real = os.path.realpath(full)
            if self.follow:
                if real in seen:
                    return
                seen.add(real)
            yield from self._folder(path, rules + compile_rules(_rule_lines(full), base=path, start=200_000 + len(rules)), seen)
        else:
            yield self._file(path, full)

    def _file(self, path: str, full: str) -> tuple:
        if self.include and not any(path == t or path.startswith(t.rstrip("/") + "/") or ignored(path, compile_rules([t])) for t in self.include):
            return path, None, "not-included", None
        try:
            size = os.path.getsize(full)
            if self.limit and size > self.limit * (NOTEBOOK_FACTOR if path.lower().endswith(".ipynb") else 1):
                return path, size, "too-large", None
            with open(full, "rb") as f:
                content = f.read()
        except OSError:
            return path, None, "unreadable", None
        if b"\0" in content[:8192]:
            return path, size, "binary", None
        return path, size, None, content


class TreeSource(DataSource):
    """``spark.read.format("tree")`` with options maxsize, ignore and include (a pattern a line), defaults, followLinks."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def read_tree(spark: SparkSession, root: str, **options: str):
    """Files and skipped entries below a folder: path, size, reason (null: taken), content."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").options(**options).load(root)

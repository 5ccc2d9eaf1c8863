"""Remote repositories: reading a spec, cloning, and what changed."""

from __future__ import annotations

import re
import subprocess
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remote_parts(spec: Column) -> dict[str, Column]:
    """url, name and branch of ``owner/repo``, ``host/owner/repo`` or any URL, with ``#branch`` or ``/tree/branch``."""
    spec = F.trim(spec)
    marked = spec.rlike(".#")
    branch = F.when(marked, F.nullif(F.regexp_extract(spec, "#([^#]*)$", 1), F.lit("")))
    rest = F.when(marked, F.regexp_replace(spec, "#[^#]*$", "")).otherwise(spec)
    tree = r"^(https?://github\.com/[^/]+/[^/]+)/tree/(.+)$"
    branch = F.coalesce(branch, F.nullif(F.regexp_extract(rest, tree, 2), F.lit("")))
    base = F.when(rest.rlike(tree), F.regexp_extract(rest, tree, 1)).otherwise(rest)
    short, host = base.rlike(r"^[\w.-]+/[\w.-]+$"), base.rlike(r"^(github|gitlab)\.com/[\w.-]+/[\w.-]+")
    url = F.when(short, F.concat(F.lit("https://github.com/"), base, F.lit(".git"))).when(host, F.concat(F.lit("https://"), base)).otherwise(base)
    name = F.regexp_extract(F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", ""), "([^/:]*)$", 1)
    return {"url": url, "name": F.when(name == "", "repo").otherwise(name), "branch": branch}


def git(args: list[str], cwd: str) -> str:
    return subprocess.run(["git", *args], cwd=cwd, check=True, capture_output=True, text=True).stdout


def changed_files(cwd: str, ref: str = "HEAD") -> list[str]:
    """Paths below ``cwd`` that differ from where ``ref`` and HEAD part, staged, unstaged or untracked, and exist."""
    try:
        base = git(["merge-base", ref, "HEAD"], cwd).strip()
    except subprocess.CalledProcessError:
        base = ref
    names = git(["diff", "--name-only", "--relative", "-z", base], cwd) + git(["ls-files", "--others", "--exclude-standard", "-z"], cwd)
    return sorted({n for n in names.split("\0") if n and (Path(cwd) / n).is_file()})


def resolve_ref(ref: str, cwd: str) -> str:
    """``@base`` is the branch that work starts from; anything else is itself, if git knows it."""
    name = default_base(cwd) if ref == "@base" else ref
    try:
        git(["rev-parse", "--verify", "--quiet", f"{name}^{{commit}}"], cwd)
    except subprocess.CalledProcessError:
        raise ValueError(f"unknown reference: {ref}") from None
    return name


def parse_spec(spec: str) -> tuple[str, str, str | None]:
    """:func:`remote_parts` of one spec on the driver: url, name, branch."""
    spec = spec.strip()
    rest, mark, branch = spec.rpartition("#") if "#" in spec[1:] else (spec, "", "")
    if m := re.match(r"(https?://github\.com/[^/]+/[^/]+)/tree/(.+)$", rest):
        rest, branch = m[1], branch or m[2]
    if re.fullmatch(r"[\w.-]+/[\w.-]+", rest):
        rest = f"https://github.com/{rest}.git"
    elif re.match(r"(?:github|gitlab)\.com/[\w.-]+/[\w.-]+", rest):
        rest = f"https://{rest}"
    name = re.sub(r"\.git$", "", rest.rstrip("/")).rsplit("/", 1)[-1].rsplit(":", 1)[-1]
    return rest, name or "repo", branch or None


def default_base(cwd: str) -> str:
    """The branch that work starts from."""
    for name in ("origin/HEAD", "origin/main", "origin/master", "main", "master"):
        try:
            return git(["rev-parse", "--verify", "--quiet", "--abbrev-ref", name], cwd).strip() or name
        except subprocess.CalledProcessError:
            continue
    raise ValueError("no base branch found")


def diff_text(cwd: str, ref: str, names: list[str] = ()) -> str:
    return git(["diff", "--no-color", "--no-ext-diff", ref, "--", *names], cwd)


def last_changed(cwd: str, commits: int = 5000) -> dict[str, float]:
    """Time of each path's last commit; infinity for changed ones."""
    out: dict[str, float] = {}
    now = 0.0
    for line in git(["log", f"-{commits}", "--format=%x01%ct", "--name-only"], cwd).splitlines():
        if line.startswith("\x01"):
            now = float(line[1:])
        elif line:
            out.setdefault(line, now)
    return out | dict.fromkeys(changed_files(cwd), float("inf"))


def clone(url: str, branch: str | None = None) -> str:
    """A shallow clone in a new temporary folder."""
    folder = tempfile.mkdtemp(prefix="lodestone-clone-")
    name = re.sub(r"\.git$", "", url.rstrip("/")).rsplit("/", 1)[-1].rsplit(":", 1)[-1] or "repo"
    git(["clone", "--quiet", "--depth", "1", "--single-branch", "--no-tags", *(["--branch", branch] if branch else []), url, name], folder)
    return f"{folder}/{name}"


def latest(history: DataFrame, dirty: DataFrame | None, key: str) -> DataFrame:
    """The last of the times (key, changed) of each key; infinity for the dirty keys."""
    rows = history.select(key, F.col("changed").cast("double").alias("changed"))
    if dirty is not None:
        rows = rows.union(dirty.select(key, F.lit(float("inf"))))
    return rows.groupBy(key).agg(F.max("changed").alias("changed"))


def changed(differing: DataFrame, untracked: DataFrame, existing: DataFrame) -> DataFrame:
    """Paths that differ or are untracked, and exist."""
    return differing.union(untracked).intersect(existing)

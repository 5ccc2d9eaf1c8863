"""``python -m lodestone``: pack, tree, init, cache, schema and serve."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone import api, config, summary
from lodestone import cache as caches
from lodestone.documents import EXTENSION, Options
from lodestone.operators import stats, transform
from lodestone.operators.tokens import library_counter, proxy
from lodestone.session import build_session
from lodestone.sources import remote
from lodestone.streaming.watch import watch

#: Options of a pack: flag, key in the configuration, how it is read.
_FLAGS = [
    ("--output", "output", str), ("--format", "format", str), ("--mode", "mode", str), ("--comments", "comments", str), ("--query", "query", str), ("--query-limit", "queryLimit", int), ("--related", "related", int), ("--max-file-size", "maxFileSize", config.size), ("--fallback-lines", "fallbackLines", int),
    ("--fallback-chars", "fallbackChars", int), ("--max-tokens", "maxTokens", config.count), ("--split-tokens", "splitTokens", config.count), ("--order", "order", str), ("--instructions", "instructions", str), ("--changed", "changed", str), ("--diff", "diff", str), ("--top", "top", int), ("--preset", "preset", str),
]
_LISTS = [("--focus", "focus"), ("--ignore", "ignore"), ("--include", "include"), ("--model", "models")]
_SWITCHES = [("--stdout", "stdout", True), ("--deps", "deps", True), ("--follow-symlinks", "followSymlinks", True), ("--no-tree", "tree", False), ("--no-redact", "redact", False), ("--no-default-ignores", "defaultIgnores", False)]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone", description="Pack source trees into documents of few tokens.")
    commands = top.add_subparsers(dest="command", required=True)
    pack = commands.add_parser("pack", help="write a document of a tree")
    pack.add_argument("root", nargs="?", default=".")
    for flag, key, kind in _FLAGS:
        pack.add_argument(flag, dest=key, type=kind, default=argparse.SUPPRESS)
    for flag, key in _LISTS:
        pack.add_argument(flag, dest=key, action="append", default=argparse.SUPPRESS)
    for flag, key, value in _SWITCHES:
        pack.add_argument(flag, dest=key, action="store_const", const=value, default=argparse.SUPPRESS)
    pack.add_argument("--remote", help="pack a repository: owner/name, or any address, with #branch")
    pack.add_argument("--config", help="a configuration file, or 'none'")
    pack.add_argument("--tokenizer", help="a tokenizers file for exact counts")
    pack.add_argument("--stats-json", help="write the statistics there")
    pack.add_argument("--no-cache", action="store_true")
    pack.add_argument("--dry-run", action="store_true", help="write nothing")
    pack.add_argument("--quiet", action="store_true")
    pack.add_argument("--watch", action="store_true", help="pack again whenever something changes")
    tree = commands.add_parser("tree", help="show where the tokens are")
    tree.add_argument("root", nargs="?", default=".")
    tree.add_argument("--depth", type=int, default=3)
    tree.add_argument("--min", type=float, default=0.0, help="least share of all tokens")
    tree.add_argument("--mode", default="skeleton")
    init = commands.add_parser("init", help="write a starter configuration")
    init.add_argument("root", nargs="?", default=".")
    init.add_argument("--force", action="store_true")
    cached = commands.add_parser("cache", help="tell about the cache, or clear it")
    cached.add_argument("action", nargs="?", choices=["info", "clear"], default="info")
    commands.add_parser("schema", help="print the JSON Schema of the configuration")
    serve = commands.add_parser("serve", help="answer JSON-RPC on standard input")
    serve.add_argument("roots", nargs="*", default=["."])
    return top


def settings(args: argparse.Namespace, root: str, cwd: str) -> tuple[dict, list[str]]:
    """The options of a run, and warnings: flags win over the file, this over a preset."""
    explicit = {k: v for k, v in vars(args).items() if k in config.SCHEMA}
    path = None if args.config == "none" else Path(args.config) if args.config else config.find([cwd] if args.remote else [root, cwd])
    found, warnings = config.load(path) if path else ({}, [])
    out = config.merged(explicit, found)
    config.validate(out)
    if out.get("splitTokens") and out.get("stdout"):
        raise config.ConfigError("parts are files; they can't go to standard output")
    unknown = [m for m in out.get("models", []) if m not in {x[0] for x in stats.MODELS}]
    if unknown:
        raise config.ConfigError(f"unknown models: {', '.join(unknown)}; there are {', '.join(x[0] for x in stats.MODELS)}")
    return out, warnings


def own_outputs(root: str, paths: list[str | None]) -> list[str]:
    """Ignore patterns for what a run writes itself: documents, their parts, statistics."""
    out = []
    for p in paths:
        rel = os.path.relpath(os.path.abspath(p), root).replace(os.sep, "/") if p else ""
        if rel and not rel.startswith(".."):
            out += [f"/{rel}", f"/{summary.part_file(rel, 0).replace('.part0', '.part*')}"]
    return out


def run_pack(spark: SparkSession, args: argparse.Namespace, out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    root, name, identity, clone = os.path.abspath(args.root), "", "", None
    try:
        if args.remote:
            url, name, branch = remote.parse_spec(args.remote)
            clone = remote.clone(url, branch)
            root, identity = clone, f"remote:{url}#{branch or ''}"
        o, warnings = settings(args, root, os.getcwd())
        for w in warnings:
            print(f"warning: {w}", file=err)
        name, identity = name or os.path.basename(root), identity or root
        form = o.get("format", "markdown")
        target = None if o.get("stdout") else o.get("output", f"packed.{EXTENSION[form]}")
        counter = library_counter(args.tokenizer) if args.tokenizer else proxy
        scan = {"ignore": "\n".join([*o.get("ignore", []), *own_outputs(root, [target, args.stats_json])]), "include": "\n".join(o.get("include", [])), "defaults": str(o.get("defaultIgnores", True)).lower(), "followlinks": str(o.get("followSymlinks", False)).lower()}
        if "maxFileSize" in o:
            scan["maxsize"] = str(config.size(o["maxFileSize"]))
        changed = "HEAD" if o.get("changed") is True else o.get("changed") or None
        cache = None if args.no_cache or "LODESTONE_NO_CACHE" in os.environ else caches.ParquetCache(identity)
        result = api.pack(
            spark, root, o.get("mode", "skeleton"), o.get("comments", "all"), o.get("focus"), o.get("query"), int(o.get("queryLimit", 5)), int(o.get("related", 0)), o.get("redact", True), changed, o.get("order", "path"),
            int(o.get("fallbackLines", transform.MAX_LINES)), int(o.get("fallbackChars", transform.MAX_CHARS)), o.get("extensions"), None if args.remote else os.getcwd(), o.get("deps", False), cache, **scan,
        )
        for t in result.outside:
            print(f"warning: {t} lies outside {root}", file=err)
        if result.files.isEmpty():
            print(f"warning: no files from {root}", file=err)
        ref = (changed or "HEAD") if o.get("diff") is True else o.get("diff") or None
        diff = None
        if ref:
            ref = remote.resolve_ref(ref, root)
            text = remote.diff_text(root, ref)
            diff = (ref, transform.redact_text(text) if o.get("redact", True) else text)
        around = Options(o.get("tree", True), config.instructions(o.get("instructions"), os.getcwd()), tuple(o.get("focus") or ()), o.get("deps", False), diff, o.get("order") == "stable")
        plan, parts, written = None, None, []
        if o.get("maxTokens"):
            result, plan = api.fit(result, config.count(o["maxTokens"]), form, around, counter)
        if o.get("splitTokens"):
            parts = api.split(result, config.count(o["splitTokens"]), form, around, counter)
            texts = [(summary.part_file(target, p.index), api.render_part(result, p, name, form, around)) for p in parts]
        else:
            texts = [(target, api.render(result, name, form, around))]
        for path, text in texts:
            if path is None:
                out.write(text)
            elif not args.dry_run:
                Path(path).parent.mkdir(parents=True, exist_ok=True)
                Path(path).write_text(text, encoding="utf-8")
                written.append(path)
        # Parts count as one document.
        whole = "\n".join(t for _, t in texts)
        tokens = spark.createDataFrame([(whole,)], "t string").select(counter(F.col("t")).alias("n")).first()["n"]
        told = api.statistics(result, tokens, len(whole), o.get("models", []), top=int(o.get("top", 10)), counter=counter)
        sizes = [p.tokens for p in parts] if parts else None
        if args.stats_json:
            Path(args.stats_json).write_text(summary.stats_json(told, plan, sizes), encoding="utf-8")
        if not args.quiet:
            hits = [(r["path"], r["matched"]) for r in result.hits.orderBy(F.desc("score"), "path").collect()] if result.hits is not None else None
            stream = err if o.get("stdout") else out
            print(summary.summary(told, ", ".join(written) or ("standard output" if o.get("stdout") else "nothing written"), result.mode, int(o.get("top", 10)), plan, sizes, hits, summary.wants_color(stream)), file=stream)
        if os.environ.get("GITHUB_OUTPUT") or os.environ.get("GITHUB_STEP_SUMMARY"):
            summary.report(told, written, os.environ.get("GITHUB_OUTPUT"), os.environ.get("GITHUB_STEP_SUMMARY"))
        result.release()
        return 0 if plan is None or plan.fits else 2
    except (config.ConfigError, ValueError) as e:
        print(f"error: {e}", file=err)
        return 1
    finally:
        if clone:
            shutil.rmtree(Path(clone).parent, ignore_errors=True)


def run_tree(spark: SparkSession, args: argparse.Namespace, out=None) -> int:
    result = api.pack(spark, os.path.abspath(args.root), args.mode)
    counted = result.files.select("path", proxy(F.col("content")).alias("tokens"), proxy(F.col("original")).alias("raw"))
    rows = [r.asDict() for r in stats.folder_lines(counted, args.depth, args.min).collect()]
    t = api.totals(result).first()
    print(f"{summary.short(t['output'] or 0)} tokens, {summary.short(t['baseline'] or 0)} raw", *summary.tree_lines(rows, args.depth, args.min), sep="\n", file=out)
    return 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "init":
        made = config.initialize(args.root, args.force)
        print("\n".join(f"wrote {p}" for p in made) or "nothing to do")
        return 0
    if args.command == "cache":
        print(f"cleared {caches.clear()}" if args.action == "clear" else json.dumps(caches.info()))
        return 0
    if args.command == "schema":
        print(json.dumps(config.json_schema(), indent=2))
        return 0
    spark = spark or build_session()
    if args.command == "tree":
        return run_tree(spark, args)
    if args.command == "serve":
        from lodestone.server import Server, serve

        serve(Server(spark, args.roots))
        return 0
    code = run_pack(spark, args)
    if args.watch and code != 1 and not args.remote:
        # Each rebuild reads the options, what changed since a reference, and the cache anew.
        watching(spark, args).awaitTermination()
    return code


def watching(spark: SparkSession, args: argparse.Namespace, interval: str = "1 second"):
    """The running query that packs again after changes below the root; stop it to end the watch."""
    root = os.path.abspath(args.root)
    o, _ = settings(args, root, os.getcwd())
    target = os.path.abspath(o.get("output", f"packed.{EXTENSION[o.get('format', 'markdown')]}"))
    return watch(spark, root, lambda _: run_pack(spark, args), interval, os.path.relpath(target, root).replace(os.sep, "/"))

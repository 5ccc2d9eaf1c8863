"""The library in a few calls: pack a tree, order and relate its files, render it, fit it to a budget, split it, count it."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import documents
from lodestone.cache import CacheStore
from lodestone.documents import Options, Part
from lodestone.functions import paths
from lodestone.operators import filters, fitting, graph, parsing, search, stats, transform
from lodestone.operators.tokens import Counter, exact_or_estimated, proxy
from lodestone.session import save
from lodestone.sources import remote
from lodestone.sources.walk import read_tree

ORDERS = ("path", "stable", "size")


@dataclass
class Pack:
    """A packed tree; ``files`` has path, size, language, fence, strategy, focused, related, matched, content, original, counts, and its place (``sort_n``, ``sort_key``)."""

    root: str
    mode: str
    files: DataFrame
    skipped: DataFrame
    comments: str = "all"
    redact: bool = True
    outside: list[str] = field(default_factory=list)
    hits: DataFrame | None = None
    edges: DataFrame | None = None
    cached: DataFrame | None = None
    source: DataFrame | None = None

    def release(self) -> None:
        """Let go of the files' contents, which are kept from the scan on."""
        if self.source is not None:
            self.source.unpersist()


def focus_targets(root: str, focus: list[str], cwd: str | None = None) -> tuple[list[str], list[str]]:
    """Focus targets as paths or globs below the root, and those that lie outside it."""
    inside, outside = [], []
    for t in focus:
        if any(c in t for c in "*?[") and not os.path.exists(os.path.join(cwd or root, t)):
            inside.append(t)
            continue
        rel = os.path.relpath(os.path.join(cwd or root, t), root).replace(os.sep, "/")
        (outside if rel.startswith("..") else inside).append(t if rel.startswith("..") else rel)
    return inside, outside


def flagged(files: DataFrame, focus: Column, hits: DataFrame | None = None, near: DataFrame | None = None) -> DataFrame:
    """Files with ``focused``, ``matched`` (hits that weren't focused) and ``related`` (near files that are neither)."""
    out = files.withColumn("focused", focus).withColumn("matched", F.lit(False)).withColumn("related", F.lit(False))
    if hits is not None:
        out = out.drop("matched").join(hits.select("path", F.lit(True).alias("_h")).distinct(), "path", "left").withColumn("matched", F.coalesce("_h", F.lit(False)) & ~F.col("focused")).drop("_h")
        out = out.withColumn("focused", F.col("focused") | F.col("matched"))
    if near is not None:
        out = out.drop("related").join(near.select(F.col("node").alias("path"), F.lit(True).alias("_n")).distinct(), "path", "left").withColumn("related", F.coalesce("_n", F.lit(False)) & ~F.col("focused")).drop("_n")
        out = out.withColumn("focused", F.col("focused") | F.col("related"))
    return out


def ordered(files: DataFrame, order: str = "path", changed: DataFrame | None = None) -> DataFrame:
    """Files with their place: by scan order; by size of content, then path; or by the time of the last change (path, changed), then path."""
    key = F.array_join(filters.scan_key(F.col("path")), "/")
    if order == "size":
        return files.withColumn("sort_n", F.length("content").cast("double")).withColumn("sort_key", F.col("path"))
    if order == "stable" and changed is not None:
        return files.join(changed.select("path", F.col("changed").cast("double").alias("_t")), "path", "left").withColumn("sort_n", F.coalesce("_t", F.lit(0.0))).withColumn("sort_key", F.col("path")).drop("_t")
    return files.withColumn("sort_n", F.lit(0.0)).withColumn("sort_key", key)


def pack(
    spark: SparkSession, root: str, mode: str = "skeleton", comments: str = "all", focus: list[str] | None = None, query: str | None = None, query_limit: int = 5, related: int = 0, redact: bool = True,
    changed: str | None = None, order: str = "path", max_lines: int = transform.MAX_LINES, max_chars: int = transform.MAX_CHARS, extensions: dict[str, str] | None = None, cwd: str | None = None, deps: bool = False, cache: CacheStore | None = None, **scan: str,
) -> Pack:
    """Scan, relate, transform and mask a tree of files."""
    targets, outside = focus_targets(root, [*(focus or [])], cwd)
    if changed:
        targets += remote.changed_files(root, remote.resolve_ref(changed, root))
    tree = read_tree(spark, root, **scan).persist()
    text = transform.normalized(F.decode("content", "UTF-8"))
    files = tree.where("reason IS NULL").select("path", "size", text.alias("original")).withColumn("language", paths.language(F.col("path"), extensions))
    hits = None
    if query:
        hits = search.top_hits(search.search(files.select("path", F.col("original").alias("text"), search.path_weight(F.col("path")).alias("weight")), query), query_limit)
    files = flagged(files, filters.focused(F.col("path"), targets), hits)
    edges = graph.dependency_graph(files.select("path", "language", F.col("original").alias("text"))) if related or deps else None
    if related:
        near = graph.related(edges, files.where("focused").select(F.col("path").alias("node")), related)
        files = files.drop("related").join(near.select(F.col("node").alias("path"), F.lit(True).alias("_n")), "path", "left").withColumn("related", F.coalesce("_n", F.lit(False))).drop("_n").withColumn("focused", F.col("focused") | F.col("related"))
    out, used = shown(files, mode, comments, redact, max_lines, max_chars, cache)
    times = spark.createDataFrame([*remote.last_changed(root).items()], "path string, changed double") if order == "stable" else None
    result = Pack(root, mode, ordered(out, order, times), tree.where("reason IS NOT NULL").select("path", "reason", "size"), comments, redact, outside, hits, edges, used, tree)
    if cache is not None and used is not None:
        cache.save(used.select("key", *CACHED))
    return result


CACHED = ("content", "strategy", "stripped_bodies", "stripped_comments", "parse_errors")


def shown(files: DataFrame, mode: str, comments: str = "all", redact: bool = True, max_lines: int = transform.MAX_LINES, max_chars: int = transform.MAX_CHARS, cache: CacheStore | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Files (path, size, language, original, focused, related, matched) as they are shown, and the rows of the cache that this used.

    Only files with a parser leave the JVM; focused ones are whole with all comments. With a cache only texts that it lacks are parsed.
    """
    book = F.lower("path").endswith(".ipynb")
    parsed = ~F.col("focused") & (F.col("language").isNotNull() | book) & F.lit(mode != "full" or comments != "all")
    level = F.lit({"full": "full", "outline": "outline"}.get(mode, "skeleton"))
    kind = F.concat(F.coalesce("language", F.lit("")), F.when(book, "|book").otherwise(""))
    options = F.lit(f"{mode}|{comments}|{max_lines}|{max_chars}")
    keyed = files.withColumn("key", transform.content_key(kind, options, F.col("original"), F.lower("path").rlike(paths.PROSE_PATH)))
    todo = keyed.where(parsed)
    known = cache.load(files.sparkSession) if cache is not None else None
    missing = todo.join(known.select("key"), "key", "left_anti") if known is not None else todo
    fresh = parsing.transformed(missing.dropDuplicates(["key"]).select("path", "language", F.col("original").alias("text"), level.alias("level")), comments, max_lines, max_chars)
    fresh = fresh.join(missing.select("path", "key"), "path").select("key", *CACHED)
    rows = fresh.unionByName(known.select("key", *CACHED)) if known is not None else fresh
    if cache is not None:
        rows = rows.persist()
    found = rows.withColumnRenamed("content", "_short").withColumnRenamed("strategy", "_how").withColumnRenamed("key", "_key")
    both = keyed.join(found, F.when(parsed, F.col("key")) == F.col("_key"), "left").drop("_key")
    strategy = F.coalesce("_how", transform.strategy(F.col("path"), F.col("original"), mode, F.col("focused"), max_lines, max_chars))
    lines = F.size(F.split("original", "\n"))
    minified = F.concat(F.lit("[minified: "), lines, F.when(lines == 1, " line, ").otherwise(" lines, "), F.length("original"), F.lit(" chars omitted]\n"))
    plain = F.when(F.col("strategy") == "truncated", transform.truncated(F.col("original"), max_lines, max_chars)).when(F.col("strategy") == "minified", minified).otherwise(F.col("original"))
    out = both.withColumn("strategy", strategy).withColumn("_text", F.coalesce("_short", plain))
    content = transform.redacted(F.col("_text")) if redact else F.col("_text")
    count = lambda c, d: F.coalesce(c, F.lit(d)).alias(c)
    # Notebooks are shown as their kernel's script.
    out = out.select(
        "path", "size", F.when(book & F.col("_how").isNotNull(), "notebook").otherwise(F.col("language")).alias("language"), F.when(F.col("strategy") == "outline", "text").when(book & F.col("_how").isNotNull(), "python").otherwise(paths.fence(F.col("path"))).alias("fence"),
        "strategy", "focused", "related", "matched", content.alias("content"), "original", count("stripped_bodies", 0), count("stripped_comments", 0), count("parse_errors", False), "key",
    )
    out = out.withColumn("redactions", F.when(F.lit(redact), transform.redactions_by_rule(F.col("content"))))
    used = out.where("key IS NOT NULL").select("key").join(rows, "key") if cache is not None else None
    return out.drop("key"), used


# Documents, budgets, parts


def render(result: Pack, name: str, form: str = "markdown", options: Options | None = None) -> str:
    """The whole document as one text."""
    return "".join(documents.pieces(result, name, form, options or Options()))


def markdown(result: Pack, name: str) -> str:
    return render(result, name)


def write(result: Pack, path: str, name: str, form: str = "markdown", options: Options | None = None) -> None:
    """Write the document, block by block, and the folders above it."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(documents.pieces(result, name, form, options or Options()))


def variants(result: Pack, form: str = "markdown", counter: Counter = proxy) -> DataFrame:
    """Every level to which each file can come down, rendered and counted: path, rank, tier, level, name, tokens, and the file's columns."""
    files = result.files
    tier = F.when(F.col("related"), 1).when(F.col("focused"), F.lit(None)).otherwise(0).cast("int")
    base = files.withColumn("tier", tier).withColumn("rank", paths.omission_rank(F.col("path"))).withColumn("levels", fitting.ladder(F.col("strategy"), F.col("language"), result.comments))
    own = base.select("*", F.lit(0).alias("level"), F.get("levels", F.lit(0)).alias("name"))
    below = base.where("tier IS NOT NULL").select("*", F.posexplode("levels").alias("level", "name")).where("level > 0")
    asked = below.select(F.concat_ws("\x00", F.col("level"), F.col("path")).alias("id"), "path", "language", "original", "name")
    got = parsing.transformed(asked.select("path", "language", F.col("original").alias("text"), F.col("name").alias("level")), result.comments)
    got = got.select("path", F.col("level").alias("name"), F.col("content").alias("_c"), F.col("strategy").alias("_s"), F.col("fence").alias("_f"), F.col("stripped_bodies").alias("_b"), F.col("stripped_comments").alias("_m"), F.col("parse_errors").alias("_e"))
    masked = transform.redacted(F.col("_c")) if result.redact else F.col("_c")
    # A related file that is brought down is no longer shown as focused.
    lower = below.drop("content", "strategy", "fence", "stripped_bodies", "stripped_comments", "parse_errors", "focused", "related").join(got, ["path", "name"])
    lower = lower.select("*", masked.alias("content"), F.col("_s").alias("strategy"), F.when(F.col("_s") == "outline", "text").otherwise(F.col("_f")).alias("fence"), F.col("_b").alias("stripped_bodies"), F.col("_m").alias("stripped_comments"), F.col("_e").alias("parse_errors"), F.lit(False).alias("focused"), F.lit(False).alias("related")).drop("_c", "_s", "_f", "_b", "_m", "_e")
    every = own.unionByName(lower).drop("levels")
    every = every.withColumn("tokens", F.when(F.col("strategy") == "omitted", 0).otherwise(counter(documents.block(form))).cast("long"))
    return save(every)


def fit(result: Pack, limit: int, form: str = "markdown", options: Options | None = None, counter: Counter = proxy) -> tuple[Pack, fitting.Fit]:
    """Bring files down until the document fits: the pack as it then is, and what changed. Each level is rendered and counted, nothing is guessed."""
    every = variants(result, form, counter)
    head = documents.overhead(result, form, options or Options(), counter)
    measure = lambda state: head + (state.agg(F.sum("tokens")).first()[0] or 0)
    plan = fitting.fit_to_budget(every.select("path", "rank", "tier", "level", "name", "tokens"), limit, measure)
    chosen = plan.state.select("path", "level").join(every, ["path", "level"]).drop("level", "name", "tier", "rank", "tokens")
    return replace(result, files=chosen.select(*result.files.columns)), plan


def focus_tokens(files: DataFrame, counter: Counter = proxy) -> DataFrame:
    """Tokens of what is focused by itself: one row."""
    return files.agg(F.coalesce(F.sum(F.when(F.col("focused") & ~F.col("related"), counter(F.col("content")))), F.lit(0)).alias("focus_tokens"))


def split(result: Pack, limit: int, form: str = "markdown", options: Options | None = None, counter: Counter = proxy) -> list[Part]:
    """Parts of at most ``limit`` tokens, cut between files; the first carries the tree and all that stands in front."""
    options = options or Options()
    first, later = (documents.overhead(result, form, replace(options, part=(k, 2)), counter) for k in (1, 2))
    costs = result.files.select("path", "sort_n", "sort_key", F.when(F.col("strategy") == "omitted", 0).otherwise(counter(documents.block(form))).cast("long").alias("tokens"))
    placed = fitting.prefix_sums(costs.withColumn("one", F.lit(1)), [F.col("sort_n"), F.col("sort_key")], "one", name="ord")
    placed = save(placed)
    items = placed.select(F.lit(0).alias("g"), "ord", F.when(F.col("tokens") > 0, F.col("tokens")).otherwise(0).alias("cost"))
    parts = fitting.split_parts(items, "g", limit, first, later)
    parts = save(parts)
    fixed = fitting.fixed_parts(parts.join(placed, "ord").select("ord", "part", "tokens"), limit, first, later)
    table = fixed.join(placed.select("ord", "path"), "ord")
    table = save(table)
    oversized = {r["path"] for r in parts.where("oversized").join(placed, "ord").select("path").collect()}
    sums = {r["part"]: r for r in table.groupBy("part").agg(F.sum("tokens").alias("tokens"), F.collect_set("path").alias("paths")).collect()}
    total = max(sums, default=1)
    return [Part(k, total, sums[k]["paths"] if k in sums else [], (first if k == 1 else later) + (sums[k]["tokens"] if k in sums else 0), sorted(oversized & set(sums[k]["paths"] if k in sums else []))) for k in range(1, total + 1)]


def render_part(result: Pack, part: Part, name: str, form: str = "markdown", options: Options | None = None) -> str:
    """The document of one part."""
    return "".join(documents.pieces(result, name, form, replace(options or Options(), part=(part.index, part.total)), part.paths))


# Counts


def totals(result: Pack, counter: Counter = proxy) -> DataFrame:
    """Tokens out, tokens of the originals, and the share saved."""
    t = result.files.agg(F.sum(counter(F.col("content"))).alias("output"), F.sum(counter(F.col("original"))).alias("baseline"))
    return t.select("output", "baseline", stats.savings(F.col("output").cast("double"), F.col("baseline").cast("double")).alias("saved"))


def statistics(result: Pack, document_tokens: int, output_chars: int = 0, models: list[str] = (), exact: Mapping[str, int] = {}, top: int = 10, counter: Counter = proxy) -> dict:
    """What a run made, as one dictionary: files by reason and strategy, tokens, costs, masks, parse errors, the largest files."""
    counted = result.files.select("path", "strategy", "focused", "related", "matched", "stripped_bodies", "stripped_comments", "parse_errors", "redactions", counter(F.col("content")).alias("tokens"), counter(F.col("original")).alias("raw")).persist()
    by = {r["strategy"]: r["files"] for r in stats.by_strategy(counted).collect()}
    skipped = {r["reason"]: r["files"] for r in stats.by_reason(result.skipped).collect()}
    sums = stats.totals(counted, document_tokens).first()
    masked = [(r["path"], r["n"]) for r in counted.select("path", F.aggregate(F.coalesce("redactions.n", F.array().cast("array<int>")), F.lit(0), lambda a, x: a + x).alias("n")).where("n > 0").orderBy("path").collect()]
    costs = []
    for model, label, _, price in stats.MODELS:
        if model in models:
            tokens, sure = exact_or_estimated(sums["output"], exact, model)
            scale = tokens / sums["output"] if sums["output"] else 1.0
            costs.append({"model": model, "label": label, "tokens": tokens, "exact": sure, "usd": round(tokens / 1e6 * price, 6), "rawUsd": round(sums["baseline"] * scale / 1e6 * price, 6)})
    largest = [r.asDict() for r in stats.largest(counted, top).collect()]
    return {
        "files": {"included": sum(by.values()), "scanned": sum(by.values()) + sum(skipped.values()), "skipped": skipped, "byStrategy": by}, "strippedBodies": sums["bodies"], "strippedComments": sums["comments"],
        "output": {"chars": output_chars}, "tokens": {"output": sums["output"], "baseline": sums["baseline"]}, "savedRatio": round(sums["saved"], 4), "costs": costs,
        "redacted": [{"path": p, "count": n} for p, n in masked], "parseErrors": [r["path"] for r in counted.where("parse_errors").select("path").orderBy("path").collect()], "filesByTokens": largest,
    }

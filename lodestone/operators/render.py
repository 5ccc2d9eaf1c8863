"""Documents: notes, blocks, the directory tree, Markdown, XML and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.filters import scan_key
from lodestone.operators.transform import attribute, code_fence, with_newline


def note(strategy: Column, focused: Column, language: Column) -> Column:
    """What is said beside a file's name."""
    out = F.when(focused, "[focus]")
    for s in ("truncated", "minified", "omitted", "outline"):
        out = out.when(strategy == s, f"[{s}]")
    return out.when((strategy == "full") & language.isNotNull(), "[full]")


def part_path(path: Column, index: Column) -> Column:
    """out.md to out.part2.md."""
    dotted = path.rlike(r"[^/\\]\.[^./\\]*$")
    stem, ext = F.regexp_extract(path, r"^(.*)(\.[^./\\]*)$", 1), F.regexp_extract(path, r"^(.*)(\.[^./\\]*)$", 2)
    return F.when(dotted, F.concat(stem, F.lit(".part"), index, ext)).otherwise(F.concat(path, F.lit(".part"), index))


def markdown_block(path: Column, said: Column, fence: Column, content: Column) -> Column:
    head = F.concat(F.lit("### `"), path, F.lit("`"), F.coalesce(F.concat(F.lit(" "), said), F.lit("")))
    return F.concat(head, F.lit("\n\n"), code_fence(content), fence, F.lit("\n"), with_newline(content), code_fence(content), F.lit("\n"))


def xml_open(path: Column, language: Column, strategy: Column, focused: Column, related: Column) -> Column:
    return F.concat(
        F.lit('<file path="'), attribute(path), F.lit('"'),
        F.coalesce(F.concat(F.lit(' language="'), language, F.lit('"')), F.lit("")),
        F.lit(' strategy="'), strategy, F.lit('"'),
        F.when(focused, ' focus="true"').otherwise(""), F.when(related, ' related="true"').otherwise(""), F.lit(">"),
    )


def joined(blocks: DataFrame, group: str, ordinal: str, block: str) -> DataFrame:
    """Blocks put together in order, a document a group."""
    return blocks.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, block))), lambda x: x[block]), "\n").alias("document"))


def tree(files: DataFrame, group: str, note: str | None = None) -> DataFrame:
    """Lines of each group's directory tree (group, path, and maybe a note): key (in order), line. Sibling windows only; no recursion."""
    parts = F.split("path", "/")
    up = files.select(group, F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"), parts.alias("p"))
    nodes = up.select(group, F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("node"), F.array_join(F.slice("p", 1, F.col("depth") - 1), "/").alias("parent"), "depth", F.expr("p[depth - 1]").alias("name"), (F.col("depth") == F.size("p")).alias("is_file")).groupBy(group, "node", "parent", "depth", "name").agg(F.bool_or("is_file").alias("is_file"))
    order = F.concat(F.when(F.col("is_file"), "0").otherwise("1"), "name")
    last = nodes.withColumn("last", F.row_number().over(Window.partitionBy(group, "parent").orderBy(order.desc())) == 1)
    flags = last.select(F.col(group).alias("_g"), F.col("node").alias("_n"), F.when(F.col("last"), "    ").otherwise("│   ").alias("bar"))
    above = last.select(group, "node", "depth", "name", "is_file", "last", F.explode_outer(F.transform(F.sequence(F.lit(0), F.col("depth") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(F.split("node", "/"), 1, k), "/").alias("a")))).alias("x"))
    led = above.join(flags, (F.col(group) == F.col("_g")) & (F.col("x.a") == F.col("_n")), "left")
    lines = led.groupBy(group, "node", "name", "is_file", "last").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("x.k").alias("k"), "bar"))), lambda b: F.coalesce(b["bar"], F.lit(""))), "").alias("lead"))
    text = F.concat("lead", F.when(F.col("last"), "└── ").otherwise("├── "), "name", F.when(F.col("is_file"), "").otherwise("/"))
    if note:
        said = files.select(F.col(group).alias("_g"), F.col("path").alias("_p"), F.col(note).alias("_note")).where("_note IS NOT NULL")
        lines = lines.join(said, (F.col(group) == F.col("_g")) & (F.col("node") == F.col("_p")) & F.col("is_file"), "left")
        text = F.concat(text, F.coalesce(F.concat(F.lit(" "), "_note"), F.lit("")))
    key = F.when(F.col("is_file"), scan_key(F.col("node"))).otherwise(F.transform(F.split("node", "/"), lambda s: F.concat(F.lit("1"), s)))
    return lines.select(group, F.array_join(key, "/").alias("key"), text.alias("line"))


def legend(flags: dict[str, bool]) -> str:
    """A paragraph that explains how the files are shown."""
    out = []
    if flags.get("outline"):
        out.append("[outline] files show declarations only.")
    if flags.get("skeleton"):
        out.append("Bodies of functions are left out of source files; the rest of them is whole.")
    elif not flags.get("outline"):
        out.append("Source files are whole.")
    for k, said in (("comments", "Some comments are gone."), ("focus", "[focus] files are untouched."), ("truncated", "[truncated] files were cut."), ("omitted", "[omitted] files exist but are not shown.")):
        if flags.get(k):
            out.append(said)
    return " ".join(out)

"""Watching a tree: which events matter, debouncing, snapshots and rebuilds."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUIET = ("node_modules", ".git", ".hg", ".svn")


def relevant(events: DataFrame, output: str, dropped: DataFrame | None = None) -> DataFrame:
    """Events (path, ...) outside folders of tools, own outputs and their parts, and paths dropped before.

    Works on streams too: the filter is row by row and the anti-join has a static side.
    """
    parts = F.split("path", "/")
    stem, dot, ext = output.rpartition(".")
    quoted = "".join(c if c.isalnum() or c == "/" else "\\" + c for c in (stem or output))
    own = (F.col("path") == output) | F.col("path").rlike(rf"^{quoted}\.part[0-9]+{(chr(92) + '.' + ext) if dot else ''}$")
    kept = events.where(~F.exists(parts, lambda s: s.isin(*QUIET)) & ~own)
    return kept.join(dropped, "path", "left_anti").select(*events.columns) if dropped is not None else kept


def debounced(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """Runs of events with less than ``gap`` between neighbours: first_ts, last_ts, events."""
    runs = events.groupBy(key, F.session_window(ts, gap)).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("events"))
    return runs.drop("session_window")


def snapshot(root: str) -> list[tuple[str, float, int]]:
    """Path, time and size of every file under a folder."""
    out = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in QUIET]
        for n in names:
            p = os.path.join(folder, n)
            try:
                s = os.stat(p)
            except OSError:
                continue
            out.append((os.path.relpath(p, root).replace(os.sep, "/"), s.st_mtime, s.st_size))
    return out


def differences(before: DataFrame, now: DataFrame) -> DataFrame:
    """Of two snapshots (path, mtime, size): path and change (added, removed, modified)."""
    a, b = before.alias("a"), now.alias("b")
    both = a.join(b, "path", "full_outer")
    change = F.when(F.col("a.mtime").isNull(), "added").when(F.col("b.mtime").isNull(), "removed").when((F.col("a.mtime") != F.col("b.mtime")) | (F.col("a.size") != F.col("b.size")), "modified")
    return both.select("path", change.alias("change")).where("change IS NOT NULL")


def watch(spark: SparkSession, root: str, rebuild: Callable[[list[tuple[str, str]]], None], interval: str = "1 second", output: str = "out.md"):
    """Call ``rebuild`` with the changes of each interval; while it runs, further changes wait and come together.

    A file that is written again is not announced by Spark's file sources, so each micro-batch compares snapshots.
    """
    schema = "path string, mtime double, size long"
    last = [snapshot(root)]

    def step(_: DataFrame, __: int) -> None:
        now = snapshot(root)
        found = differences(spark.createDataFrame(last[0], schema), spark.createDataFrame(now, schema))
        changed = [(r["path"], r["change"]) for r in relevant(found, output).orderBy("path").collect()]
        last[0] = now
        if changed:
            rebuild(changed)

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(step).trigger(processingTime=interval).start()


def once(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first event of each key."""
    return events.groupBy(*keys).agg(F.min(order).alias(order))

"""Budgets, splits and other greedy folds over small (ordinal, cost) tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.session import save

FILE_OVERHEAD = 12
PHASES = ("skeleton", "docs", "bare", "outline", "omitted")


def prefix_sums(rows: DataFrame, order: list[Column], value: str, within: str | None = None, name: str = "before") -> DataFrame:
    """Add the sum of ``value`` over the rows that come before, in order (of each ``within``).

    Rows are dealt by ranges of the order, so no group is one task's; one row a range goes to the driver. ``order`` should tell all rows apart.
    """
    spark = rows.sparkSession
    dealt = rows.withColumn("_g", F.col(within).cast("string") if within else F.lit("")).repartitionByRange("_g", *order).withColumn("_range", F.spark_partition_id())
    dealt = save(dealt)
    sums = dealt.groupBy("_range", "_g").agg(F.sum(value).cast("long").alias("s"))
    ends = sums.groupBy("_range").agg(F.min(F.struct("_g", "s")).alias("first"), F.max(F.struct("_g", "s")).alias("last")).orderBy("_range").collect()
    carries, group, held = [], None, 0
    for e in ends:
        carry = held if e["first"]["_g"] == group else 0
        carries.append((e["_range"], e["first"]["_g"], carry))
        held = e["last"]["s"] + (carry if e["first"]["_g"] == e["last"]["_g"] else 0)
        group = e["last"]["_g"]
    table = spark.createDataFrame(carries, "_range int, _first string, _carry long")
    frame = Window.partitionBy("_range", "_g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = F.coalesce(F.sum(value).over(frame), F.lit(0)) + F.when(F.col("_g") == F.col("_first"), F.col("_carry")).otherwise(0)
    return dealt.join(F.broadcast(table), "_range").withColumn(name, here.cast("long")).drop("_range", "_g", "_first", "_carry")


def prefix_until(moves: DataFrame, order: list[Column], saving: str, gap: int, within: str | None = None) -> DataFrame:
    """Moves in order until their savings reach the gap."""
    return prefix_sums(moves, order, saving, within).where(F.col("before") < gap)


def fold(items: DataFrame, group: str, order: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple[object, tuple | None]], schema: str) -> DataFrame:
    """A left fold over each group's items in order: ``step`` takes the state and an item and gives the state and a row (or none).

    Items stream through a task in sorted batches with the state carried on, so memory and time don't depend on a group's size but linearly.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None
        for pdf in batches:
            out = []
            for key, *item in pdf.itertuples(index=False, name=None):
                if key != now:
                    now, state = key, start()
                state, row = step(state, tuple(item))
                if row is not None:
                    out.append((key, *row))
            yield pd.DataFrame(out, columns=names)

    return items.select(group, *order).repartition(group).sortWithinPartitions(group, *order).mapInPandas(run, schema)


def backfill(items: DataFrame, group: str, room: int) -> DataFrame:
    """Items (group, ord, cost) that fit one after another into the room; what doesn't fit is passed over."""

    def step(left: int, item: tuple) -> tuple[int, tuple | None]:
        ord_, cost = item
        return (left - cost, (ord_,)) if cost <= left else (left, None)

    kind = items.schema[group].dataType.simpleString()
    return fold(items, group, ["ord", "cost"], lambda: room, step, f"{group} {kind}, ord bigint")


def split_parts(items: DataFrame, group: str, limit: int, first: int, later: int) -> DataFrame:
    """Items (group, ord, cost) cut, in order, into parts of at most ``limit``; each part has an overhead, the first its own."""

    def step(state: tuple, item: tuple) -> tuple[tuple, tuple]:
        part, held, used = state
        ord_, cost = item
        # The first part may hold nothing but its header.
        alone = part == 0 and not held and first + cost > limit and later + cost <= limit
        if alone or held and (later if part else first) + used + cost > limit:
            part, held, used = part + 1, 0, 0
        return (part, held + 1, used + cost), (ord_, part + 1, (later if part else first) + cost > limit)

    kind = items.schema[group].dataType.simpleString()
    return fold(items, group, ["ord", "cost"], lambda: (0, 0, 0), step, f"{group} {kind}, ord bigint, part int, oversized boolean")


def fixed_parts(parts: DataFrame, limit: int, first: int, later: int, passes: int = 3) -> DataFrame:
    """Parts (ord, part, tokens as measured) with the last files of what is too large moved forward; a part keeps one file at least."""
    for _ in range(passes):
        base = F.when(F.col("part") == 1, first).otherwise(later)
        run = prefix_sums(parts, [F.col("ord")], "tokens", "part").withColumn("over", (F.col("before") > 0) & (base + F.col("before") + F.col("tokens") > limit))
        run = save(run)
        if run.where("over").isEmpty():
            return run.select("ord", "part", "tokens")
        # A part that takes files from the one before is new only if it is the last.
        parts = run.select("ord", (F.col("part") + F.col("over").cast("int")).alias("part"), "tokens")
    return parts


def keep_first_spans(spans: DataFrame, group: str) -> DataFrame:
    """Spans (group, a, b) without those that overlap one kept before."""

    def step(upto: int, item: tuple) -> tuple[int, tuple | None]:
        a, b = item
        return (b, (a, b)) if a >= upto else (upto, None)

    kind = spans.schema[group].dataType.simpleString()
    return fold(spans, group, ["a", "b"], lambda: -1, step, f"{group} {kind}, a bigint, b bigint")


def ladder(strategy: Column, language: Column, comments: str = "all") -> Column:
    """The levels to which a file can be brought down, in order."""
    steps = ["skeleton"] + (["docs"] if comments == "all" else []) + (["bare"] if comments != "none" else []) + ["outline", "omitted"]
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    return (
        F.when(strategy == "outline", lit(["outline", "omitted"]))
        .when((strategy == "full") & language.isNull(), lit(["full", "skeleton", "omitted"]))
        .when(language.isNotNull() & (strategy == "full"), lit(["full", *steps]))
        .when(language.isNotNull(), lit(steps))
        .otherwise(lit(["skeleton", "omitted"]))
    )


@dataclass
class Fit:
    """``state``: path, level (number), name, tokens of every file; ``changes``: path, was, now of those that moved."""

    state: DataFrame
    changes: DataFrame
    tokens: int
    initial: int
    limit: int

    @property
    def fits(self) -> bool:
        return self.tokens <= self.limit


def estimated(state: DataFrame) -> int:
    """Tokens of all contents, and a heading for each file that is shown."""
    return state.agg(F.sum(F.col("tokens") + F.when(F.col("name") == "omitted", 0).otherwise(FILE_OVERHEAD))).first()[0] or 0


def omission(rank: str, saving: str) -> list[Column]:
    """In which order files are left out: by kind, then the largest first."""
    return [F.col(rank), F.desc(saving), F.col("path")]


def fit_to_budget(variants: DataFrame, limit: int, measure: Callable[[DataFrame], int] = estimated, phases: tuple[str, ...] = PHASES) -> Fit:
    """Bring files down, a phase at a time and the largest savings first, until they fit; then restore what still has room.

    ``variants``: path, rank, tier (0; 1: related files, which come last; null: focused, never touched), level (0: as it is), name and
    the real tokens of each level. ``measure`` (state -> tokens) is the size of the whole document. Only counts are moved: a batch
    is one prefix sum over ranges of the savings.
    """
    variants = save(variants)
    columns = ("path", "rank", "tier", "level", "name", "tokens")
    state = variants.where("level = 0").select(*columns)
    size = initial = measure(state)
    for tier in (0, 1):
        for phase in phases:
            to = variants.where(F.col("name") == phase).select("path", F.col("level").alias("to"), F.col("tokens").alias("left"))
            bonus = FILE_OVERHEAD if phase == "omitted" else 0
            order = omission("rank", "saving") if bonus else [F.desc("saving"), F.col("path")]
            # Savings are estimates: measure again after each batch, until it fits or nothing moves.
            while size > limit:
                moves = state.where(F.col("tier") == tier).join(to, "path").where("to > level").withColumn("saving", F.col("tokens") - F.col("left") + bonus).where("saving > 0")
                chosen = prefix_until(moves, order, "saving", size - limit).select("path", "to", "left")
                chosen = save(chosen)
                if chosen.isEmpty():
                    break
                state = _moved(state, chosen.withColumn("as", F.lit(phase)))
                size = measure(state)
    if size <= limit and "omitted" in phases:
        gone = state.where("name = 'omitted' AND level > 0").select("path", "rank", "tier", (F.col("level") - 1).alias("to"))
        back = gone.join(variants.select("path", F.col("level").alias("to"), F.col("name").alias("as"), F.col("tokens").alias("left")), ["path", "to"])
        # Related files first, then the most valuable, then the smallest.
        back = back.select(F.lit(0).alias("g"), (-F.col("tier")).alias("t"), (-F.col("rank")).alias("r"), (F.col("left") + FILE_OVERHEAD).alias("cost"), "path", "to", "left", "as")

        def step(room: int, item: tuple) -> tuple[int, tuple | None]:
            cost, path, to_, left, name = item[2:]
            return (room - cost, (path, to_, left, name)) if cost <= room else (room, None)

        room = limit - size
        taken = fold(back, "g", ["t", "r", "cost", "path", "to", "left", "as"], lambda: room, step, "g int, path string, to int, left long, as string").drop("g")
        taken = save(taken)
        if not taken.isEmpty():
            restored = _moved(state, taken)
            exact = measure(restored)
            if exact <= limit:
                state, size = restored, exact
    start = variants.where("level = 0").select("path", F.col("name").alias("was"))
    changes = start.join(state.select("path", F.col("name").alias("now")), "path").where("was <> now")
    return Fit(state.select("path", "level", "name", "tokens"), changes, size, initial, limit)


def _moved(state: DataFrame, moves: DataFrame) -> DataFrame:
    """``state`` after moves (path, to, left, as)."""
    return save(state.join(moves, "path", "left").select("path", "rank", "tier", F.coalesce("to", "level").alias("level"), F.coalesce("as", "name").alias("name"), F.coalesce("left", "tokens").alias("tokens")))


def collapsed(history: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Of a history of values: the first and the last of each key and how many there are; keys that end as they began are dropped."""
    return history.groupBy(key).agg(F.min_by(value, order).alias("was"), F.max_by(value, order).alias("now"), F.count("*").alias("changes")).where("was <> now")

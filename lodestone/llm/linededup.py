"""Removal of repeated runs of lines with a suffix array over line ids.

The corpus is the sequence of its documents' lines that hold a word. A run of lines (inside one
document) of ``MIN_WORDS`` words or more that stands again, whole and apart, in a later place is a repeated run; its
first place is kept and the lines of later ones are deleted.

1. Equal texts are one string of the corpus (in the place of the first); later copies of a text of
   ``MIN_WORDS`` words lose all lines with words, without going further.
2. Line ids: lines (named by 128-bit digests) that stand at two places or more. Any other line ends every run.
3. Suffix array by prefix doubling: a suffix's rank is the number of suffixes that are smaller in their
   first 2**k lines. Each round sorts the suffixes that still share a rank by (rank, rank 2**k lines
   on) over ranges of the cluster, until every suffix has its own place. Ranks of each width are kept.
4. Longest common prefixes of neighbours in the array: from the widest ranks down, both suffixes step 2**k lines
   on where their ranks of that width are equal.
5. Intervals: along the array a front holds, for each prefix length that is still shared, the first place in
   the corpus that shares it. It gives each suffix the longest run that starts there and stands earlier, the
   maximal repeated run. Ranges of the array find their own fronts first; the
   driver chains them (a front a range, of no more entries than a run has lines), so an interval may span many tasks.
6. The runs of a document are united, and cut from its text in one pass.

No step gathers an interval or the copies of a line in a task. Documents stand in the order of their ids (null last), rows of one id in the order of a
digest of their texts; rows equal in both are one place and fare alike. Null and empty texts
have no lines; a null text stays null. Long texts are linear in their lines. Columns travel as one struct, so no name clashes. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import textcore as tc
from lodestone.llm.runtime import map_arrow, ranked, save, text_blocks

MIN_WORDS = 50
LAST = (1 << 63) - 1
SHARES = 16
LINE_SCHEMA = "doc long, digest long, n int, line int, h1 long, h2 long, words int, upto long"
WORD = r"[^\x20\x09-\x0D]"
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """The lines with words of all documents of ``min_words`` or more: number among them and in the text, digest, words, and words up to its end.

    ``docs``: doc, text, digest.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, "text"):
            if not len(data):
                continue
            n = len(offsets) - 1
            white = _WHITE[data]
            first = np.zeros(len(data) + 1, bool)
            first[offsets] = True
            word = ~white
            word[1:] &= white[:-1] | first[1:-1]
            breaks = np.flatnonzero(data == 10)
            starts = np.union1d(breaks + 1, offsets[:-1][np.diff(offsets) > 0])
            starts = starts[starts < len(data)]
            # A line ends before its break or with its text.
            doc = np.searchsorted(offsets, starts, "right") - 1
            ends = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, starts)], offsets[1:][doc])
            before = np.concatenate([[0], np.cumsum(word)])
            words = before[ends] - before[starts]
            number = np.arange(len(starts)) - np.searchsorted(starts, offsets)[doc]
            # A text that starts with a break has an empty first line there; starts holds it, as the text's own start.
            keep = (words > 0) & (np.bincount(doc, words, n)[doc] >= min_words)
            if not keep.any():
                continue
            starts, ends, doc, words, number = starts[keep], ends[keep], doc[keep], words[keep], number[keep]
            raw = memoryview(data)
            h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]), np.int64).reshape(-1, 2)
            bounds = np.searchsorted(doc, np.arange(n + 1))
            place = np.arange(len(doc)) - bounds[doc]
            total = np.concatenate([[0], np.cumsum(words)])
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(take), rows.column(2).take(take), pa.array(place, pa.int32()), pa.array(number, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(words, pa.int32()), pa.array(total[1:] - total[bounds[doc]])],
                names=["doc", "digest", "n", "line", "h1", "h2", "words", "upto"],
            )

    return map_arrow(docs.select("doc", "text", "digest"), run, LINE_SCHEMA)


def refined(rows: DataFrame, key: list[str], keep: list[str]) -> DataFrame:
    """New ranks of suffixes. ``rows``: r (the old rank), ``key`` (what tells them apart inside it), d, n, and columns to ``keep``.

    A suffix's new rank is the old one plus the number of suffixes of that rank with a lesser key. Rows are dealt by
    ranges of all of it, so neither a rank nor a key is one task's; how much of the first rank and key of a range lies
    before it comes from one row a range on the driver. Adds ``sa`` (the new rank) and ``alone``.
    """
    spark = rows.sparkSession
    name = ["r", *key]
    order = [*name, "d", "n"]
    dealt = save(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    here = dealt.withColumn("_at", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
    for columns, label in ((["r"], "r"), (name, "k")):
        w = Window.partitionBy("_range", *columns)
        here = here.withColumn(f"_{label}0", F.min("_at").over(w)).withColumn(f"_{label}n", F.count("*").over(w))
    here = save(here)
    ends = here.groupBy("_range").agg(F.count("*").alias("rows"), F.min(F.struct(*name, "_rn", "_kn")).alias("first"), F.max(F.struct(*name, "_rn", "_kn")).alias("last")).collect()
    before, later = [], {}
    seen = {"r": (None, 0), "k": (None, 0)}
    ends.sort(key=lambda e: e["_range"])
    for e in ends:
        first, last = tuple(e["first"]), tuple(e["last"])
        carry = {}
        for label, k, n in (("r", 1, -2), ("k", len(name), -1)):
            known, count = seen[label]
            carry[label] = count if known == first[:k] else 0
            seen[label] = (last[:k], last[n] + (carry[label] if first[:k] == last[:k] else 0))
        before.append([e["_range"], first, last, carry["r"], carry["k"], False])
    for one, two in zip(before, before[1:]):
        one[5] = one[2][: len(name)] == two[1][: len(name)]
    schema = "_range int, _fr long, _fk array<long>, _lk array<long>, _cr long, _ck long, _more boolean"
    table = spark.createDataFrame([(g, f[0], list(f[: len(name)]), list(z[: len(name)]), cr, ck, more) for g, f, z, cr, ck, more in before], schema)
    own = F.array(*[F.col(c).cast("long") for c in name])
    out = here.join(F.broadcast(table), "_range")
    rank_before = F.when(F.col("r") == F.col("_fr"), F.col("_cr")).otherwise(0)
    key_before = F.when(own == F.col("_fk"), F.col("_ck")).otherwise(0)
    alone = (F.col("_kn") == 1) & (key_before == 0) & ~((own == F.col("_lk")) & F.col("_more"))
    return save(out.select(*keep, (F.col("r") + (F.col("_k0") - key_before) - (F.col("_r0") - rank_before)).alias("sa"), alone.alias("alone")))


def suffix_array(lines: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """The suffix array of the repeated lines (d, n, id: equal for equal lines): d, n, sa; and the ranks of width 1, 2, 4, ... that suffixes share: d, n, r."""
    first = refined(lines.select("d", "n", F.lit(0).cast("long").alias("r"), "h1", "h2"), ["h1", "h2"], ["d", "n"])
    now = first.select("d", "n", F.col("sa").alias("r"))
    levels, placed, width = [now], None, 1
    while True:
        both = now.withColumn("_open", F.lit(True))
        if placed is not None:
            both = both.unionByName(placed.select("d", "n", F.col("sa").alias("r"), F.lit(False).alias("_open")))
        ahead = Window.partitionBy("d").orderBy("n").rangeBetween(width, width)
        pairs = both.withColumn("r2", F.max("r").over(ahead)).where("_open")
        # A suffix whose run ends before has no like: it stands first, in the order of the corpus.
        ended = F.col("r2").isNull()
        pairs = pairs.select("d", "n", "r", F.coalesce("r2", F.lit(-1)).alias("r2"), F.when(ended, F.col("d")).otherwise(-1).alias("td"), F.when(ended, F.col("n").cast("long")).otherwise(-1).alias("tn"))
        done = refined(pairs, ["r2", "td", "tn"], ["d", "n"])
        fresh = done.where("alone").select("d", "n", "sa")
        placed = fresh if placed is None else placed.unionByName(fresh)
        now = done.where("NOT alone").select("d", "n", F.col("sa").alias("r"))
        if now.isEmpty():
            return placed, levels
        levels.append(now)
        width *= 2


def common_prefixes(array: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """``array`` (d, n, sa) in ranges of sa (``part``), with ``lcp``: the lines shared with the suffix before."""
    spark = array.sparkSession
    dealt = save(array.repartitionByRange("sa").withColumn("part", F.spark_partition_id()))
    lasts = {r["part"]: r["x"] for r in dealt.groupBy("part").agg(F.max(F.struct("sa", "d", "n")).alias("x")).collect()}
    parts = sorted(lasts)
    bridge = spark.createDataFrame([(b, lasts[a]["d"], lasts[a]["n"]) for a, b in zip(parts, parts[1:])], "part int, ld long, ln int")
    w = Window.partitionBy("part").orderBy("sa")
    now = dealt.join(F.broadcast(bridge), "part", "left").select("part", "sa", "d", "n", F.coalesce(F.lag("d").over(w), "ld").alias("pd"), F.coalesce(F.lag("n").over(w), "ln").alias("pn"), F.lit(0).alias("lcp"))
    for k in range(len(levels) - 1, -1, -1):
        mine = levels[k].select(F.col("d").alias("_d"), F.col("n").alias("_n"), F.col("r").alias("_r"))
        theirs = levels[k].select(F.col("d").alias("_d2"), F.col("n").alias("_n2"), F.col("r").alias("_r2"))
        now = now.join(mine, (F.col("d") == F.col("_d")) & (F.col("n") + F.col("lcp") == F.col("_n")), "left").join(theirs, (F.col("pd") == F.col("_d2")) & (F.col("pn") + F.col("lcp") == F.col("_n2")), "left")
        now = now.select("part", "sa", "d", "n", "pd", "pn", (F.col("lcp") + F.when(F.col("_r") == F.col("_r2"), 1 << k).otherwise(0)).alias("lcp"))
        if k % 4 == 0:
            now = save(now)
    return now.select("part", "sa", "d", "n", "lcp")


Place = tuple[int, int]


class Front:
    """Prefix lengths that the suffixes passed share with the present one, each with the first place that shares it; longer ones have later places."""

    def __init__(self, entries: list[tuple[int, int, int]] = ()) -> None:
        self.lengths = [e[0] for e in entries]
        self.places: list[Place] = [(e[1], e[2]) for e in entries]

    def pass_link(self, shared: int) -> None:
        """Go on to a neighbour that shares ``shared`` lines."""
        k = bisect_left(self.lengths, shared)
        if k < len(self.lengths):
            best = self.places[k]
            del self.lengths[k:], self.places[k:]
            if shared:
                self.lengths.append(shared)
                self.places.append(best)

    def longest(self, d: int, n: int) -> int:
        """Lines of the longest prefix that stands at an earlier place, and apart from this one."""
        best = 0
        for k in range(bisect_left(self.places, (d, n)) - 1, -1, -1):
            if self.lengths[k] <= best:
                break
            pd, pn = self.places[k]
            best = max(best, self.lengths[k] if pd != d else min(self.lengths[k], n - pn))
            if pd != d:
                break
        return best

    def add(self, length: int, place: Place) -> None:
        """A suffix that shares ``length`` lines, no fewer than any other here."""
        k = bisect_left(self.places, place)
        del self.lengths[k:], self.places[k:]
        self.lengths.append(length)
        self.places.append(place)

    def entries(self) -> list[tuple[int, int, int]]:
        return [(x, *p) for x, p in zip(self.lengths, self.places)]


WHOLE = (1 << 31) - 1


def _walk(d: list[int], n: list[int], links: list[int], front: Front) -> list[int]:
    """Along suffixes in the order given (``links``: lines shared with the one before): each one's longest earlier run; ``front`` is left as it is after the last."""
    out = []
    for x, y, shared in zip(d, n, links):
        front.pass_link(shared)
        out.append(front.longest(x, y) if shared else 0)
        front.add(WHOLE, (x, y))
    return out


def _chained(summaries: list[tuple[int, int, list]]) -> list[list[tuple[int, int, int]]]:
    """The front that comes into each range, from (first link, least link inside, own front) of each in order."""
    front, out = Front(), []
    for _, least, own in summaries:
        out.append(front.entries())
        front.pass_link(least)
        for e in own:
            # Own entries come in ascending lengths; what is shorter and later than one of them goes.
            while front.lengths and (front.lengths[-1] > e[0] or front.places[-1] >= (e[1], e[2])):
                front.lengths.pop()
                front.places.pop()
            front.add(e[0], (e[1], e[2]))
    return out


def earlier_runs(array: DataFrame) -> DataFrame:
    """Of suffixes in ranges of the array (part, sa, d, n, lcp, the last 0 where it holds too few words): d, n, m: the maximal run of m lines that starts there and stands earlier."""

    def columns(batches: Iterator[pa.RecordBatch]) -> tuple[list[int], list[int], list[int], int]:
        held = list(batches)
        if not any(b.num_rows for b in held):
            return [], [], [], -1
        t = pa.Table.from_batches(held)
        return t.column("d").to_pylist(), t.column("n").to_pylist(), t.column("lcp").to_pylist(), t.column("part")[0].as_py()

    entry = pa.list_(pa.struct([("l", pa.int32()), ("d", pa.int64()), ("n", pa.int32())]))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, n, lcp, part = columns(batches)
        if not d:
            return
        fore, back = Front(), Front()
        _walk(d, n, [0, *lcp[1:]], fore)
        _walk(d[::-1], n[::-1], [0, *lcp[:0:-1]], back)
        told = [[{"l": a, "d": b, "n": c} for a, b, c in f.entries()] for f in (fore, back)]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([lcp[0]], pa.int32()), pa.array([min(lcp[1:], default=WHOLE)], pa.int32()), pa.array([told[0]], entry), pa.array([told[1]], entry)], names=["part", "link", "least", "fore", "back"])

    kind = "array<struct<l:int,d:long,n:int>>"
    table = sorted(map_arrow(array, ends, f"part int, link int, least int, fore {kind}, back {kind}").collect(), key=lambda r: r["part"])
    fores = _chained([(r["link"], min(r["link"], r["least"]), [tuple(e) for e in r["fore"]]) for r in table])
    after = [r["link"] for r in table[1:]] + [0]
    backs = _chained([(link, min(link, r["least"]), [tuple(e) for e in r["back"]]) for r, link in zip(table[::-1], after[::-1])])[::-1]
    shared = array.sparkSession.sparkContext.broadcast({r["part"]: (f, b, link) for r, f, b, link in zip(table, fores, backs, after)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, n, lcp, part = columns(batches)
        if not d:
            return
        fore, back, link = shared.value[part]
        one = _walk(d, n, lcp, Front(fore))
        two = _walk(d[::-1], n[::-1], [link, *lcp[:0:-1]], Front(back))[::-1]
        m = np.maximum(one, two)
        at = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(d)[at]), pa.array(np.array(n, np.int32)[at]), pa.array(m[at].astype(np.int32))], names=["d", "n", "m"])

    return map_arrow(array, run, "d long, n int, m int")


def repeated_runs(lines: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The maximal repeated runs of the strings ``lines`` (d, n, line, h1, h2, words, upto) in later places, united: d, spans of the text's lines (first and last)."""
    spark = lines.sparkSession
    names = lines.groupBy("h1", "h2").agg(F.min(F.struct("d", "n")).alias("_a"), F.max(F.struct("d", "n")).alias("_z")).where("_a < _z")
    # A very common line's rows meet their name in SHARES places.
    names = names.select("h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_s"))
    own = save(lines.withColumn("_s", F.pmod(F.xxhash64("d", "n"), F.lit(SHARES)).cast("int")).join(names, ["h1", "h2", "_s"]).drop("_s"))
    if own.isEmpty():
        return spark.createDataFrame([], "d long, spans array<struct<a:int,z:int>>")
    array = common_prefixes(*suffix_array(own))
    ends = own.select(F.col("d").alias("_d"), F.col("n").alias("_n"), F.col("upto").alias("_upto"), F.col("line").alias("_line"))
    begins = own.select("d", "n", F.col("line").alias("_from"), (F.col("upto") - F.col("words")).alias("_before"))

    def words(m: Column) -> Column:
        return (F.col("d") == F.col("_d")) & (F.col("n") + m - 1 == F.col("_n"))

    # A link of too few words is none.
    told = array.join(begins.drop("_from"), ["d", "n"]).join(ends, words(F.col("lcp")), "left")
    told = told.select("part", "sa", "d", "n", F.when(F.col("_upto") - F.col("_before") >= min_words, F.col("lcp")).otherwise(0).alias("lcp"))
    told = save(told.repartitionByRange("part", "sa").sortWithinPartitions("sa").withColumn("part", F.spark_partition_id()))
    runs = earlier_runs(told).join(begins, ["d", "n"]).join(ends, words(F.col("m"))).where(F.col("_upto") - F.col("_before") >= min_words)
    by = Window.partitionBy("d").orderBy("_from")
    reach = F.max("_line").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("_new", (reach.isNull() | (F.col("_from") > reach)).cast("int")).withColumn("_span", F.sum("_new").over(by))
    spans = runs.groupBy("d", "_span").agg(F.min("_from").alias("a"), F.max("_line").alias("z"))
    return spans.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("a", "z"))).alias("spans"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of the texts, and the numbers of lines and of those removed (``n_lines``, ``n_removed``, in place of any such columns)."""
    number = lambda c: F.coalesce(c.cast("long"), F.lit(LAST))
    digest = lambda text: F.xxhash64(F.coalesce(text, F.lit("")))
    text = F.col(text_col)
    plain = docs.where(text.isNotNull()).select(number(F.col(id_col)).alias("doc"), text.alias("text"), digest(text).alias("digest"))
    # Texts with equal digests and lengths are equal; the first of them stands for all.
    strings = plain.groupBy("digest", F.xxhash64(F.lit(1), F.col("text")).alias("_second"), F.length("text").alias("_size")).agg(F.min("doc").alias("doc"))
    strings, _ = ranked(strings.select("doc", "digest").distinct(), [F.col("doc"), F.col("digest")], "d")
    strings = save(strings)
    lines = save(line_table(plain, min_words).join(strings, ["doc", "digest"]).drop("doc", "digest").dropDuplicates(["d", "n"]))
    cuts = repeated_runs(lines, min_words)
    fate = save(strings.join(cuts, "d", "left").select("doc", "digest", "spans", F.lit(True).alias("first")))
    # The rows travel as one struct, so no column of theirs can clash.
    rows = docs.select(F.struct("*").alias("row")).withColumn("key", number(F.col("row")[id_col])).withColumn("own", digest(F.col("row")[text_col]))
    joined = rows.join(fate, (F.col("key") == F.col("doc")) & (F.col("own") == F.col("digest")), "left")
    whole = F.col("row")[text_col]
    parts = F.split(whole, "\n")
    blank = lambda xs: F.filter(xs, lambda x: ~F.regexp_like(x, F.lit(WORD)))
    spans = F.col("spans")
    between = lambda k: F.coalesce(F.get(spans, k - 1)["z"], F.lit(-1)) + 1

    def without(lines_: Column) -> Column:
        pieces = F.transform(spans, lambda s, k: F.concat(F.slice(lines_, between(k) + 1, s["a"] - between(k)), blank(F.slice(lines_, s["a"] + 1, s["z"] - s["a"] + 1))))
        last = F.element_at(spans, -1)["z"]
        return F.concat(F.flatten(pieces), F.slice(lines_, last + 2, F.greatest(F.size(lines_) - last - 1, F.lit(0))))

    copied = F.col("first").isNull() & (F.size(F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != "")) >= min_words)
    kept = F.when(whole.isNull(), None).when(copied, blank(parts)).when(spans.isNotNull(), without(parts))
    cut = joined.withColumn("_kept", kept)
    fresh = F.when(F.col("_kept").isNull(), whole).otherwise(F.array_join("_kept", "\n"))
    n = F.when(F.length(F.coalesce(whole, F.lit(""))) == 0, 0).otherwise(F.size(parts)).cast("long")
    out = [(fresh if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return cut.select(*out, n.alias("n_lines"), F.when(F.col("_kept").isNull(), 0).otherwise(F.size(parts) - F.size("_kept")).cast("long").alias("n_removed"))

"""Shards along a Hilbert curve through the documents' metadata.

Each metadata dimension is quantised to ``2**BITS`` levels of about equal numbers of rows
(thresholds are quantiles over all rows: of numbers by a sketch, of strings, compared whole, by the counts of
their values), the levels are the coordinates of a cell, and rows are sorted by the cell's place on
the Hilbert curve. Cutting the order into runs of equal row counts gives shards (law
``rows``: counts are at most one apart) in which every dimension spans a short range, so a
filter on any of them skips most files.

Null metadata takes the lowest level; equal rows are told apart by doc_id, digest and size,
and rows equal in these too get neighbouring places in any order; of a very long text only size and digest go on; columns that are no
dimension are not read, whatever their names; an empty table gives no rows.
Cells may hold any share of the rows, as the sort goes on inside a cell.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.llm.runtime import map_arrow, ranked, save

BITS = 8
DIMENSIONS = ("source", "lang", "n_chars")


def hilbert_index(levels: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of coordinates (0 to 2**bits - 1): Skilling's transform."""
    x = levels.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def is_ordered(docs: DataFrame, name: str) -> bool:
    """Whether a column is handled as numbers; all others are strings."""
    return isinstance(docs.schema[name].dataType, (T.NumericType, T.DateType, T.TimestampType))


def ordinal(docs: DataFrame, name: str) -> Column:
    """A column's number, or its string; null below all."""
    if isinstance(docs.schema[name].dataType, T.NumericType):
        return F.coalesce(F.col(name).cast("double"), F.lit(float("-inf")))
    if is_ordered(docs, name):
        return F.coalesce(F.col(name).cast("timestamp").cast("double"), F.lit(float("-inf")))
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def string_cuts(values: DataFrame, levels: int) -> list[str]:
    """Strings (fewer than ``levels``) that part the rows of ``values`` (v) into runs of about equal numbers, as far as equal strings allow."""
    counts = values.groupBy("v").agg(F.count("*").alias("n"))
    dealt = save(counts.repartitionByRange("v").withColumn("_range", F.spark_partition_id()))
    sizes = {r["_range"]: r["n"] for r in dealt.groupBy("_range").agg(F.sum("n").alias("n")).collect()}
    total = sum(sizes.values())
    if not total:
        return []
    offsets, at = [], 0
    for k in sorted(sizes):
        offsets.append((k, at))
        at += sizes[k]
    before = values.sparkSession.createDataFrame(offsets, "_range int, _before long")
    running = F.sum("n").over(Window.partitionBy("_range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    placed = dealt.join(F.broadcast(before), "_range").select("v", (F.col("_before") + F.coalesce(running, F.lit(0))).alias("at"), "n")
    step = lambda c: F.floor(c * F.lit(levels) / F.lit(total))
    # A value begins a level if a border lies in the rows before it; more than levels - 1 there can't be.
    found = placed.withColumn("level", step(F.col("at"))).where("level > 0").groupBy("level").agg(F.min("v").alias("v"))
    return sorted({r["v"] for r in found.collect()})


def _levels(cuts: np.ndarray, column: pa.Array) -> np.ndarray:
    """The level of each value: how many cuts are not above it."""
    if cuts.dtype != object:
        return np.searchsorted(cuts, column.to_numpy(zero_copy_only=False), "right")
    coded = column.dictionary_encode()
    known, marks = coded.dictionary.to_pylist(), cuts.tolist()
    return np.array([bisect_right(marks, v) for v in known], np.int64)[coded.indices.to_numpy()] if known else np.zeros(0, np.int64)


def hilbert_shards(docs: DataFrame, shards: int = 16, dimensions: Sequence[str] = DIMENSIONS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row a document: its size and digest, its cell on the curve, its shard and its place there."""
    names = [f"_d{i}" for i in range(len(dimensions))]
    coded = docs.select(*[ordinal(docs, d).alias(n) for d, n in zip(dimensions, names)])
    steps = [k / (1 << bits) for k in range(1, 1 << bits)]
    plain = [n for d, n in zip(dimensions, names) if is_ordered(docs, d)]
    quantiles = dict(zip(plain, coded.approxQuantile(plain, steps, 1 / (1 << (bits + 2))))) if plain else {}
    cuts = [np.unique(quantiles[n]) if n in quantiles else np.array(string_cuts(coded.select(F.col(n).alias("v")), 1 << bits), object) for n in names]

    raw = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    keys = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), *[ordinal(docs, d).alias(n) for d, n in zip(dimensions, names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = np.stack([_levels(c, batch.column(3 + i)) for i, c in enumerate(cuts)], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hilbert_index(levels, bits))], names=["doc_id", "size", "text_crc32", "hilbert"])

    cells = map_arrow(keys, run, "doc_id long, size long, text_crc32 long, hilbert long")
    out, n = ranked(cells, [F.col("hilbert"), F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    rank = F.col("rank")
    shard = F.floor(rank * shards / F.lit(max(n, 1)).cast("long")) if n * shards < 1 << 52 else F.expr(f"rank * {shards} div {n}")
    first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    return out.withColumn("shard", shard.cast("int")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (rank - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(docs: DataFrame, path: str, shards: int = 16, dimensions: Sequence[str] = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the whole documents (distinct ids) to one folder a shard, each sorted along the curve."""
    at = hilbert_shards(docs, shards, dimensions, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("_id"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    dealt = docs.join(at, F.col(id_col).eqNullSafe(F.col("_id"))).drop("_id").repartitionByRange(shards, "_shard").sortWithinPartitions("_shard", "_slot")
    dealt.drop("_slot").withColumnRenamed("_shard", "shard").write.partitionBy("shard").parquet(path)

"""What the operators share on the Spark side: saved intermediate tables and Arrow loops."""

from __future__ import annotations

import itertools
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.llm import textcore as tc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark wherever it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and all runs on one machine (a ``local`` master), as in tests, a temporary one is made.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
    return context._jsc.sc().getCheckpointDir().get()


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage there.

    Now and then the driver's collector is asked to run, so that Spark's cleaner drops shuffles and tables of rounds that are over.
    """
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    if not next(_SAVES) % 8:
        df.sparkSession._jvm.System.gc()
    return out


_SAVES = itertools.count(1)


def ranked(df: DataFrame, keys: list[Column], name: str = "rank", parts: int | None = None) -> tuple[DataFrame, int]:
    """Add 0, 1, 2, ... in the order of ``keys`` without bringing all rows to one task; the number of rows too.

    Rows are dealt by ranges and saved; a rank is the row's place in its range plus the rows
    of the ranges before (one number a range). ``keys`` should tell all rows apart: equal rows
    get an arbitrary order among themselves.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    dealt = df.repartitionByRange(*([parts] if parts else []), *keys).withColumn("_range", F.spark_partition_id())
    dealt = save(dealt)
    sizes = {r["_range"]: r["n"] for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for k in sorted(sizes):
        offsets.append((k, total))
        total += sizes[k]
    before = spark.createDataFrame(offsets or [(0, 0)], "_range int, _before long")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    out = dealt.withColumn("_place", place).join(F.broadcast(before), "_range")
    return out.withColumn(name, F.col("_before") + F.col("_place") - 1).drop("_range", "_before", "_place"), total


def text_blocks(batches: Iterator[pa.RecordBatch], text: str, size: int = tc.BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The rows of Arrow batches in blocks of bounded bytes: (rows, bytes of the texts, offsets)."""
    for batch in batches:
        data, offsets = tc.utf8_column(batch.column(batch.schema.get_field_index(text)))
        for i, j in tc.blocks(offsets, size):
            yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator reads, under fixed names; other columns stay unread."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Bytes of an Arrow batch: rows are whole texts, and each batch stands in memory on both sides.
BATCH_BYTES = 8 << 20


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` in batches of bounded bytes (a setting of the session, which this lowers)."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)

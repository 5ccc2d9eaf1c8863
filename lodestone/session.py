"""Session settings that the library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows are whole files: small batches between the JVM and Python.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(app: str = "lodestone", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | extra).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's ``spark.checkpoint.dir`` and cut its lineage there.

    Only where that is unset and all runs on one machine (a ``local`` master) a temporary folder is made.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
    return df.checkpoint(eager=True)

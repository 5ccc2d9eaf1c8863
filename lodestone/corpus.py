"""Adapters that read the driver's tables as a tree of files, an import graph and the like."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: doc_id, path, original, size in bytes, lang, source."""
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "concat(CASE WHEN doc_id % 7 = 0 THEN 'tests/' ELSE '' END, source, '/', lang, '/doc_', doc_id, CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.py' WHEN 3 THEN '.ts' ELSE '.json' END) AS path",
        "text AS original",
        "CAST(octet_length(text) AS BIGINT) AS size",
        "lang",
        "source",
    )


CORPUS = """corpus AS (SELECT doc_id, (CASE WHEN doc_id % 7 = 0 THEN 'tests/' ELSE '' END) || source || '/' || lang || '/doc_' || CAST(doc_id AS VARCHAR)
 || (CASE doc_id % 5 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.py' WHEN 3 THEN '.ts' ELSE '.json' END) AS path,
 text AS original, CAST(strlen(text) AS BIGINT) AS size, lang, source FROM documents)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of prefixed ids: customers and suppliers import their nation, nations their region."""
    c, s, n = (table(spark, sf_dir, t) for t in ("customer", "supplier", "nation"))
    return (
        c.selectExpr("concat('c:', c_custkey) AS src", "concat('n:', c_nationkey) AS dst")
        .union(s.selectExpr("concat('s:', s_suppkey)", "concat('n:', s_nationkey)"))
        .union(n.selectExpr("concat('n:', n_nationkey)", "concat('r:', n_regionkey)"))
    )


LINKS = """links AS (SELECT 'c:' || CAST(c_custkey AS VARCHAR) AS src, 'n:' || CAST(c_nationkey AS VARCHAR) AS dst FROM customer
 UNION ALL SELECT 's:' || CAST(s_suppkey AS VARCHAR), 'n:' || CAST(s_nationkey AS VARCHAR) FROM supplier
 UNION ALL SELECT 'n:' || CAST(n_nationkey AS VARCHAR), 'r:' || CAST(n_regionkey AS VARCHAR) FROM nation)"""


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each file imports: the path of document (id * 7 + 3) % n, as a relative stem, a file name and a dotted name."""
    files = corpus(spark, sf_dir).select("doc_id", "path")
    n = files.agg(F.count("*").alias("n"))
    wanted = files.crossJoin(F.broadcast(n)).selectExpr("path AS src", "(doc_id * 7 + 3) % n AS target")  # one row
    named = files.selectExpr("doc_id AS target", "path AS target_path")
    return wanted.join(named, "target").selectExpr(
        "src",
        "regexp_replace(target_path, '\\\\.[a-z]+$', '') AS stem",
        "regexp_extract(target_path, '([^/]+)$', 1) AS name",
        "replace(regexp_replace(target_path, '\\\\.[a-z]+$', ''), '/', '.') AS dotted",
    )


SPECS = CORPUS + """, specs AS (SELECT a.path AS src, regexp_replace(b.path, '\\.[a-z]+$', '') AS stem, regexp_extract(b.path, '([^/]+)$', 1) AS name,
 replace(regexp_replace(b.path, '\\.[a-z]+$', ''), '/', '.') AS dotted FROM corpus a JOIN corpus b ON b.doc_id = (a.doc_id * 7 + 3) % (SELECT count(*) FROM corpus))"""

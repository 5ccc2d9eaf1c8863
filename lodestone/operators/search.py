"""Ranking of files against a plain-language query (BM25 with path bonus)."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths, words
from lodestone.operators.transform import let

K1, B, PATH_BONUS = 1.2, 0.75, 1.5


def query_terms(spark: SparkSession, text: str) -> dict[str, str]:
    """Distinct stems of a query, in order, with the words that the user wrote (in lower case)."""
    raw = re.findall(r"[^\W_]+", text)
    row = spark.range(1).select(words.words(F.lit(text)), *[words.words(F.lit(r)) for r in raw]).first()
    spelled: dict[str, str] = {}
    for word, stems in zip(raw, row[1:]):
        for s in stems:
            spelled.setdefault(s, word.lower())
    return {s: spelled.get(s, s) for s in row[0]}


def path_weight(path):
    """Texts that mention everything weigh less."""
    return F.when(paths.language(path).isNull(), 0.4).when(F.lower(path).rlike(paths.TEST_PATH), 0.7).otherwise(1.0)


def head(term: str) -> str:
    """What every word begins with whose stem matches a term loosely: it shares four letters with it or equals it, and its last letter may be a y for ``ies``."""
    return term[: 3 if len(term) >= 4 else len(term) - term.endswith("y")]


def alike(found: Column, terms: list[str]) -> Column:
    """The stems of those words of a list that begin like a term."""
    heads = {head(t) for t in terms}
    begins = lambda w: reduce(Column.__or__, [F.left(w, F.lit(n)).isin([h for h in heads if len(h) == n]) for n in sorted({len(h) for h in heads})])
    return F.transform(F.filter(found, begins), words.stem)


def term_counts(files: DataFrame, terms: list[str]) -> DataFrame:
    """Files (path, text, weight) with, for each term, how often it is in the text (``tf``) and whether it is in the path (``there``), and their words (``len``).

    Each text is split once, and only its words that begin like a term are stemmed and compared; what is kept is a few numbers a file, so statistics and
    scores are both taken from the saved rows.
    """
    listed = F.array(*[F.lit(t) for t in terms])
    split = files.select("path", "weight", words.plain_words(F.col("text")).alias("body"), words.plain_words(F.col("path")).alias("own"))
    # Bound by let: in a lambda over the terms the optimizer would put the whole expression, to be taken anew for each.
    tf = let(alike(F.col("body"), terms), lambda ws: F.transform(listed, lambda t: F.size(F.filter(ws, lambda w: words.loosely(t, w)))))
    there = let(alike(F.col("own"), terms), lambda ws: F.transform(listed, lambda t: F.exists(ws, lambda w: words.loosely(t, w))))
    return split.select("path", "weight", tf.alias("tf"), there.alias("there"), (F.size("body") + 1).alias("len")).persist()


def search(files: DataFrame, query: str) -> DataFrame:
    """Files (path, text, weight) with a matching word: path, score, and the matched words of the query as the user wrote them. Corpus statistics are one row."""
    spelled = query_terms(files.sparkSession, query)
    terms = list(spelled)
    if not terms:
        return files.sparkSession.createDataFrame([], "path string, score double, matched array<string>")
    counted = term_counts(files, terms)
    hit = lambda k: (F.get("tf", F.lit(k)) > 0) | F.get("there", F.lit(k))
    stats = counted.agg(F.avg("len").alias("avg"), F.count("*").alias("n"), *[F.sum(hit(k).cast("int")).alias(f"df{k}") for k in range(len(terms))]).first()
    score, matched = F.lit(0.0), F.lit(0)
    for k in range(len(terms)):
        f, df = F.get("tf", F.lit(k)).cast("double"), stats[f"df{k}"] or 0
        idf = F.lit(math.log(1 + (stats["n"] - df + 0.5) / (df + 0.5)))
        part = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.lit(stats["avg"] or 1.0))) + F.when(F.get("there", F.lit(k)), idf * PATH_BONUS).otherwise(0.0)
        score = score + F.when(hit(k), part).otherwise(0.0)
        matched = matched + hit(k).cast("int")
    names = F.filter(F.array(*[F.when(hit(k), F.lit(spelled[t])) for k, t in enumerate(terms)]), lambda x: x.isNotNull())
    return counted.withColumn("m", matched).where("m > 0").select("path", (score * (1 + (F.col("m") - 1) / len(terms)) * F.col("weight")).alias("score"), names.alias("matched"))


def top_hits(hits: DataFrame, limit: int = 5, cutoff: float = 0.25) -> DataFrame:
    """The best hits, without the tail far below the best."""
    best = hits.orderBy(F.desc("score"), "path").limit(max(limit, 1))
    return best.crossJoin(F.broadcast(best.agg(F.max("score").alias("best")))).where(F.col("score") >= F.col("best") * cutoff).drop("best")

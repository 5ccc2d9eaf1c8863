"""Queries that need a parser: rows only, no SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.corpus import corpus, table
from lodestone.functions import paths
from lodestone.operators import parsing
from lodestone.plans.registry import query


#: What a document's lines become in turn, by language: a comment, a string, the body of a function, and of a method or an inner block.
_PROGRAM = {
    "python": ("concat('# ', x)", "concat('S', i, ' = \"', e, '\"')", "concat('def f', i, '(a):\\n    return \"', e, '\"')", "concat('class C', i, ':\\n    def m(self, a):\\n        # ', x, '\\n        return a')"),
    "typescript": ("concat('// ', x)", "concat('const S', i, ' = \"', e, '\";')", "concat('function f', i, '(a: number) {\\n  return \"', e, '\";\\n}')", "concat('export class C', i, ' {\\n  m(a: number) {\\n    // ', x, '\\n    return a;\\n  }\\n}')"),
}


def program(language: str) -> Column:
    """The whole text as a program: each line (whatever ends it) is a comment, a string or a line of a body."""
    escaped = "replace(replace(x, '\\\\', '\\\\\\\\'), '\"', '\\\\\"')"
    cases = " ".join(f"WHEN {k} THEN {c.replace(', e, ', f', {escaped}, ')}" for k, c in enumerate(_PROGRAM[language]))
    return F.expr(f"concat(array_join(transform(split(original, '\\r\\n|\\r|\\n'), (x, i) -> CASE i % 4 {cases} END), '\\n'), '\\n')")


def sources(spark, sf_dir):
    """The corpus as program text: the lines of prose as comments, strings and bodies of functions."""
    df = corpus(spark, sf_dir).withColumn("language", paths.language(F.col("path")))
    return df.select("path", "language", F.when(F.col("language") == "python", program("python")).when(F.col("language") == "typescript", program("typescript")).otherwise(F.col("original")).alias("text"))


#: The lines of a document in turn: the first branch of an ``#if``, the second, the last, and code outside.
_BRANCHES = """concat('int a;\\n', array_join(transform(split(text, '\\n'), (x, i) -> concat(CASE i % 4 WHEN 0 THEN '#if X\\n// ' WHEN 1 THEN '#elif Y\\n// ' WHEN 2 THEN '#else\\n// ' ELSE '#endif\\n// ' END, x)), '\\n'),
 CASE size(split(text, '\\n')) % 4 WHEN 0 THEN '' ELSE '\\n#endif' END, '\\nint c;\\n')"""


@query("skeleton_counts")
def skeleton_counts(spark, sf_dir):
    return parsing.skeletons(sources(spark, sf_dir)).select("path", "stripped_bodies", "stripped_comments", "parse_errors", F.length("content").alias("n_chars"))


@query("blank_branches")
def blank_branches(spark, sf_dir):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "branch": pdf["branch"], "content": [parsing.blank_branches(t, b) for t, b in zip(pdf["text"], pdf["branch"])]})

    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_BRANCHES).alias("text"), F.explode(F.array(F.lit(0), F.lit(1))).alias("branch"))
    return rows.mapInPandas(run, "doc_id long, branch int, content string")


@query("chunk_text")
def chunk_text(spark, sf_dir):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, k, len(c)) for d, t in zip(pdf["doc_id"], pdf["text"]) for k, c in enumerate(parsing.chunks(t or "", 512, 4096))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "n_chars"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, chunk int, n_chars int")

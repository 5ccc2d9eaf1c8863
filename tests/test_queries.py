"""Every query with SQL against DuckDB on the smallest tables, and the schema of the others."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.functions import words
from lodestone.operators import search
from lodestone.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return ("inf" if math.isinf(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert rows
    if name in ORACLES:
        got = duck.sql(ORACLES[name])
        assert sorted(got.columns) == cols
        at = [got.columns.index(c) for c in cols]
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)


def test_entry_schema(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["path", "score", "matched"]


def written(folder, rows):
    """A documents table of (doc_id, text, lang, source) in a folder, and DuckDB over it."""
    pq.write_table(pa.table(dict(zip(("doc_id", "text", "lang", "source"), zip(*rows)))), folder / "documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    return c


def test_normalize_text_of_odd_texts(spark, tmp_path):
    odd = [None, "", "\n", "a\r\nb", "a\r\nb\r\n", "\ufeff", "\ufeffa", "\ufeff\ufeffa\r\n", "\r", "\r\r\n", "\n\r", "é\x00😀"]
    c = written(tmp_path, [(i if i >= 0 else None, t, "en", "src1") for t in odd for i in (-1, 0, 1, 2)])
    got = QUERIES["normalize_text"](spark, str(tmp_path)).select("doc_id", "digest", "n").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(c.sql(ORACLES["normalize_text"]).select("doc_id, digest, n").fetchall(), key=repr)


def test_search_of_odd_texts(spark, tmp_path):
    odd = ["", " ", "12 345 6x x6 7²", "aBc ABc ABC aBCd A1B 1Aa éÀb", "parse_invoices PARSEInvoices parsedInvoice2 parsies 12pars", "things THINGThing thin thi th tHe THE The", "licensed licenses license licence", "éan éans éanies ÉAN", "tests-rendering\ttest\nTestRender", "1" * 300 + "render", "2" * 5000, "ab\U00010400cd \U00010400\U00010400\U00010428\U00010428 render"]
    c = written(tmp_path, [(i, t, "en", f"src{i % 3}") for i, t in enumerate(odd)])
    for name, cols in (("search_bm25", ["path", "score", "matched"]), ("search_top_hits", ["path", "score"])):
        got = [tuple(map(plain, r)) for r in QUERIES[name](spark, str(tmp_path)).select(*cols).collect()]
        assert len(got) > 3
        assert sorted(got) == sorted(tuple(map(plain, r)) for r in c.sql(ORACLES[name]).select(", ".join(cols)).fetchall())


def test_search_compares_only_words_that_begin_like_a_term(spark):
    terms = ["thing", "parsy", "éan", "sky", "ab", "invoic"]
    near = [t[:n] + end for t in terms for n in range(1, len(t) + 1) for end in ("", "s", "es", "ed", "ing", "e", "ies", "y", "xies", "ness")]
    far = ["other", "words", "that", "are", "not", "like", "them"]
    said = lambda ws: F.filter(ws, lambda w: F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: words.loosely(t, w)))
    row = spark.createDataFrame([(near + far,)], "ws array<string>").select(said(F.transform("ws", words.stem)).alias("all"), search.alike(F.col("ws"), terms).alias("some"), said(search.alike(F.col("ws"), terms)).alias("found")).first()
    assert row["found"] == row["all"] and not set(far) & set(row["some"])
    files = spark.createDataFrame([("a.py", "things", 1.0)], "path string, text string, weight double")
    plan = search.term_counts(files, terms)._jdf.queryExecution().analyzed()
    assert spark._jsparkSession.sessionState().optimizer().execute(plan).toString().count("regexp_extract_all(") == 2  # once for texts, once for paths

"""Queries that rank, relate, count, fit and render."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone import api, cache, config, documents
from lodestone.corpus import CORPUS, LINKS, SPECS, corpus, links, specs, table
from lodestone.functions import paths, words
from lodestone.operators import filters, fitting, graph, parsing, render, search, stats, transform
from lodestone.plans.files import _RANK, STRATEGY, strategies
from lodestone.plans.registry import ORACLES, query
from lodestone.session import save
from lodestone.sources import remote

QUERY = "thing tests rendering the licensed éan parse_invoices"


@query("stem_words", f"WITH w AS (SELECT DISTINCT unnest(list_filter(regexp_extract_all(lower(text), '[a-zà-ÿ]+'), lambda x: length(x) > 1)) AS word FROM documents WHERE doc_id % 10 = 0 OR doc_id % 10 > 0) SELECT word, {words.STEM_SQL.format(w='word')} AS stem FROM w")
def stem_words(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(F.explode(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-zà-ÿ]+)"), F.lit(1)), lambda x: F.length(x) > 1)).alias("word")).distinct()
    return found.select("word", words.stem(F.col("word")).alias("stem"))


_CAMEL = "text || ' parseInvoicePDF HTTPServer_v2 x1Y' || CAST(doc_id AS VARCHAR)"


@query("tokenize_identifiers", f"SELECT doc_id, array_to_string({words.words_sql('(' + _CAMEL + ')')}, ' ') AS words FROM documents")
def tokenize_identifiers(spark, sf_dir):
    text = F.concat("text", F.lit(" parseInvoicePDF HTTPServer_v2 x1Y"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(words.words(text), " ").alias("words"))


_TERMS = ["thing", "test", "render", "licens", "éan", "pars", "invoic"]
_BODY = words.words_sql("original")
_OWN = words.words_sql("path")
BM25 = f"""{CORPUS}, terms AS (SELECT unnest({_TERMS}) AS t),
 split AS (SELECT path, CASE WHEN NOT (path LIKE '%.py' OR path LIKE '%.ts') THEN 0.4 WHEN regexp_matches(lower(path), '{paths.TEST_PATH}') THEN 0.7 ELSE 1.0 END AS weight, {_BODY} AS body, {_OWN} AS own FROM corpus),
 tf AS (SELECT path, CAST(weight AS DOUBLE) AS weight, t, len(body) + 1 AS len, len(list_filter(body, lambda w: {words.loosely_sql('t', 'w')})) AS f, len(list_filter(own, lambda w: {words.loosely_sql('t', 'w')})) > 0 AS there FROM split, terms),
 hit AS (SELECT * FROM tf WHERE f > 0 OR there),
 st AS (SELECT count(*) AS n, avg(len) AS a FROM (SELECT path, any_value(len) AS len FROM tf GROUP BY path) x),
 idf AS (SELECT t, ln(1 + ((SELECT n FROM st) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM hit GROUP BY t),
 hits AS (SELECT path, sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / (SELECT a FROM st))) + CASE WHEN there THEN 1.5 * idf ELSE 0 END) * (1 + CAST(count(*) - 1 AS DOUBLE) / {len(_TERMS)}) * any_value(weight) AS score, count(*) AS matched FROM hit JOIN idf USING (t) GROUP BY path)"""


def ranked_hits(spark, sf_dir):
    files = corpus(spark, sf_dir)
    return search.search(files.select("path", F.col("original").alias("text"), search.path_weight(F.col("path")).alias("weight")), QUERY)


@query("search_bm25", f"WITH {BM25} SELECT path, round(score, 6) AS score, CAST(matched AS INT) AS matched FROM hits")
def search_bm25(spark, sf_dir):
    return ranked_hits(spark, sf_dir).select("path", F.round("score", 6).alias("score"), F.size("matched").alias("matched"))


@query("search_top_hits", f"WITH {BM25}, top AS (SELECT path, score FROM hits ORDER BY score DESC, path LIMIT 5) SELECT path, round(score, 6) AS score FROM top WHERE score >= 0.25 * (SELECT max(score) FROM top)")
def search_top_hits(spark, sf_dir):
    return search.top_hits(ranked_hits(spark, sf_dir)).select("path", F.round("score", 6).alias("score"))


@query("token_proxy", f"SELECT doc_id, len(regexp_extract_all(text, '{stats.TOKEN}')) AS tokens FROM documents")
def token_proxy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", stats.token_proxy(F.col("text")).alias("tokens"))


# Joins and the import graph


@query("deps_first_candidate", f"WITH {SPECS}, c AS (SELECT src, stem, unnest(['.ts', '.py', '.md', '.txt', '.json']) AS e, unnest(range(5)) AS r FROM specs) SELECT src, stem AS spec, arg_min(path, r) AS dst FROM c JOIN corpus ON path = stem || e GROUP BY src, stem")
def deps_first_candidate(spark, sf_dir):
    tried = F.posexplode(F.array(*[F.concat("stem", F.lit(e)) for e in (".ts", ".py", ".md", ".txt", ".json")])).alias("rank", "candidate")
    return graph.first_candidate(specs(spark, sf_dir).select("src", F.col("stem").alias("spec"), tried), corpus(spark, sf_dir))


@query("deps_unique_suffix", f"WITH {SPECS} SELECT src, name AS suffix, min(path) AS dst FROM specs JOIN corpus ON regexp_extract(path, '([^/]+)$', 1) = name GROUP BY src, name HAVING count(*) = 1")
def deps_unique_suffix(spark, sf_dir):
    return graph.unique_suffix(specs(spark, sf_dir).select("src", F.col("name").alias("suffix")), corpus(spark, sf_dir)).select("src", "suffix", "dst")


@query("deps_python", f"WITH {SPECS}, a AS (SELECT src, dotted AS module, path AS dst, row_number() OVER (PARTITION BY src ORDER BY path) AS k FROM specs JOIN corpus ON path = replace(dotted, '.', '/') || '.py'), w AS (SELECT DISTINCT src, regexp_replace(dotted, '\\.[^.]*$', '') AS pkg, path AS dst FROM specs JOIN corpus ON path = replace(dotted, '.', '/') || '.py') SELECT DISTINCT src, module, dst FROM (SELECT src, module, dst FROM a UNION ALL SELECT src, pkg, dst FROM w) z")
def deps_python(spark, sf_dir):
    """Each file's import once as a module, and once as a name of its package."""
    s = specs(spark, sf_dir)
    whole = s.select("src", F.col("dotted").alias("module"), F.array(F.lit("run"), F.lit("stop")).alias("names"))
    named = s.select("src", F.regexp_replace("dotted", r"\.[^.]*$", "").alias("module"), F.array(F.regexp_extract("dotted", r"([^.]*)$", 1), F.lit("other")).alias("names"))
    return graph.python_modules(whole.union(named), corpus(spark, sf_dir))


_DIR = "regexp_replace({p}, '/?[^/]*$', '')"


@query("deps_longest_prefix", f"WITH {SPECS}, f AS (SELECT {_DIR.format(p='path')} AS dir, min(path) AS dst FROM corpus WHERE path LIKE '%.md' GROUP BY 1) SELECT DISTINCT src, {_DIR.format(p='stem')} AS spec, dst FROM specs JOIN f ON f.dir = {_DIR.format(p='stem')} WHERE {_DIR.format(p='src')} <> f.dir")
def deps_longest_prefix(spark, sf_dir):
    files = corpus(spark, sf_dir)
    modules = files.select(F.col("source").alias("module")).union(files.select(F.concat("source", F.lit("/"), "lang"))).distinct().select("module", F.col("module").alias("dir"))
    modules = modules.union(spark.range(1).selectExpr("'tests'", "'tests'"))
    wanted = specs(spark, sf_dir).select("src", graph.folder(F.col("stem")).alias("spec")).distinct()
    return graph.longest_prefix(wanted, modules, files, ".md", "_test.md")


GRAPH = SPECS + """, edges AS (SELECT DISTINCT src, path AS dst FROM specs JOIN corpus ON (src LIKE '%.ts' AND path = stem || '.ts') OR (src LIKE '%.py' AND path = stem || '.py') WHERE src <> path)"""


def import_graph(spark, sf_dir):
    """Texts with one import each, in the file's language, put through extraction and resolution."""
    up = F.when(F.col("src").startswith("tests/"), "../../../").otherwise("../../")
    text = F.when(F.col("src").endswith(".ts"), F.concat(F.lit("import x from '"), up, "stem", F.lit("';\n"))).otherwise(F.concat(F.lit("import os\nimport "), "dotted", F.lit("\n")))
    importing = specs(spark, sf_dir).select(F.col("src").alias("path"), paths.language(F.col("src")).alias("language"), text.alias("text"))
    return graph.dependency_graph(importing)


@query("deps_graph", f"WITH {GRAPH} SELECT src, dst FROM edges")
def deps_graph(spark, sf_dir):
    return import_graph(spark, sf_dir)


@query("render_graph", f"WITH {GRAPH} SELECT src || ' -> ' || string_agg(dst, ', ' ORDER BY dst) AS line, any_value(doc_id) AS ordinal FROM edges JOIN corpus ON src = path GROUP BY src")
def render_graph(spark, sf_dir):
    return graph.rendered(import_graph(spark, sf_dir), corpus(spark, sf_dir).select("path", F.col("doc_id").alias("ordinal")))


@query("most_imported", f"WITH {LINKS} SELECT dst AS path, count(*) AS importers FROM links GROUP BY dst ORDER BY importers DESC, path LIMIT 10")
def most_imported(spark, sf_dir):
    return graph.most_imported(links(spark, sf_dir))


@query("related_khop", f"WITH {LINKS}, b AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links), h1 AS (SELECT DISTINCT b AS node FROM b WHERE a IN ('n:1', 'n:7') AND b NOT IN ('n:1', 'n:7')), h2 AS (SELECT DISTINCT b.b AS node FROM b JOIN h1 ON a = node WHERE b.b NOT IN ('n:1', 'n:7') AND b.b NOT IN (SELECT node FROM h1)) SELECT node, 1 AS hop FROM h1 UNION ALL SELECT node, 2 FROM h2")
def related_khop(spark, sf_dir):
    return graph.related(links(spark, sf_dir), spark.range(1).select(F.explode(F.array(F.lit("n:1"), F.lit("n:7"))).alias("node")), 2)


@query("focus_flags", f"WITH {SPECS}, foc AS (SELECT path FROM corpus WHERE starts_with(path, 'src1/')), mat AS (SELECT path FROM corpus WHERE contains(original, 'token =') AND path NOT IN (SELECT path FROM foc)), seed AS (SELECT path FROM foc UNION SELECT path FROM mat), rel AS (SELECT c.path FROM specs JOIN corpus c ON regexp_extract(c.path, '([^/]+)$', 1) = name WHERE src IN (SELECT path FROM seed) AND c.path NOT IN (SELECT path FROM seed) UNION SELECT src FROM specs JOIN corpus c ON regexp_extract(c.path, '([^/]+)$', 1) = name WHERE c.path IN (SELECT path FROM seed) AND src NOT IN (SELECT path FROM seed)) SELECT path, path IN (SELECT path FROM seed) AS focused, path IN (SELECT path FROM mat) AS matched, path IN (SELECT path FROM rel) AS related FROM corpus")
def focus_flags(spark, sf_dir):
    files = corpus(spark, sf_dir).select("path", "original")
    hits = files.where("contains(original, 'token =')").select("path")
    seeds = api.flagged(files, filters.focused(F.col("path"), ["src1"]), hits)
    edges = graph.unique_suffix(specs(spark, sf_dir).select("src", F.col("name").alias("suffix")), files).select("src", "dst")
    near = graph.related(edges, seeds.where("focused").select(F.col("path").alias("node")), 1)
    return api.flagged(files, filters.focused(F.col("path"), ["src1"]), hits, near).select("path", (F.col("focused") & ~F.col("related")).alias("focused"), "matched", "related")



# Orders, statistics, folders


@query("order_size", f"WITH {CORPUS} SELECT path, length(original) AS n, row_number() OVER (PARTITION BY source ORDER BY length(original), path) AS place FROM corpus")
def order_size(spark, sf_dir):
    placed = api.ordered(corpus(spark, sf_dir).withColumn("content", F.col("original")), "size")
    return placed.select("path", F.col("sort_n").cast("long").alias("n"), F.row_number().over(Window.partitionBy("source").orderBy("sort_n", "sort_key")).cast("long").alias("place"))



@query("last_changed", "WITH m AS (SELECT user_id, epoch(date_trunc('second', max(ts))) AS t FROM events GROUP BY user_id) SELECT user_id, CASE WHEN user_id % 17 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(t AS DOUBLE) END AS changed FROM m")
def last_changed(spark, sf_dir):
    seen = table(spark, sf_dir, "events").select("user_id", F.unix_timestamp(F.date_trunc("second", "ts")).cast("double").alias("changed"))
    return remote.latest(seen, seen.where("user_id % 17 = 0").select("user_id"), "user_id")



@query("order_stable", f"WITH {CORPUS}, m AS (SELECT user_id, max(ts) AS t FROM events GROUP BY user_id) SELECT path, coalesce(CAST(epoch(date_trunc('second', t)) AS BIGINT), 0) AS changed, row_number() OVER (PARTITION BY source ORDER BY coalesce(CAST(epoch(date_trunc('second', t)) AS BIGINT), 0), path) AS place FROM corpus LEFT JOIN m ON user_id = doc_id")
def order_stable(spark, sf_dir):
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.unix_timestamp(F.date_trunc("second", "ts")).cast("double").alias("changed"))
    times = remote.latest(seen, None, "doc_id")
    files = corpus(spark, sf_dir)
    placed = api.ordered(files, "stable", files.select("doc_id", "path").join(times, "doc_id").select("path", "changed"))
    return placed.select("path", F.col("sort_n").cast("long").alias("changed"), F.row_number().over(Window.partitionBy("source").orderBy("sort_n", "sort_key")).cast("long").alias("place"))



@query("config_precedence", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 'cli' END, CASE WHEN o_orderkey % 4 = 0 THEN 'config' END, 'preset') AS mode, list_concat(['a'], CASE WHEN o_orderkey % 4 = 0 THEN ['b'] ELSE [] END)[-1] AS last_ignore FROM orders")
def config_precedence(spark, sf_dir):
    """The three places of an option merged for each of the twelve kinds of orders."""
    kinds = []
    for k in range(12):
        explicit, found = {"mode": "cli"} if k % 3 == 0 else {}, {"mode": "config", "ignore": ["b"]} if k % 4 == 0 else {}
        o = config.merged({**explicit, "ignore": ["a"]}, {"mode": "preset", **found})
        kinds.append((k, o["mode"], sorted(o["ignore"])[-1]))
    made = spark.createDataFrame(kinds, "k int, mode string, last_ignore string")
    return table(spark, sf_dir, "orders").withColumn("k", F.expr("CAST(o_orderkey % 12 AS INT)")).join(F.broadcast(made), "k").select("o_orderkey", "mode", "last_ignore")  # twelve rows



_REASON = "CASE WHEN lang = 'fr' THEN 'ignored' WHEN size > 8000 THEN 'too-large' WHEN doc_id % 50 = 0 THEN 'binary' END"


@query("stats_by_reason", f"WITH {CORPUS} SELECT {_REASON} AS reason, count(*) AS files FROM corpus WHERE {_REASON} IS NOT NULL GROUP BY 1")
def stats_by_reason(spark, sf_dir):
    return stats.by_reason(corpus(spark, sf_dir).selectExpr(f"{_REASON} AS reason"))



@query("stats_by_strategy", f"WITH {STRATEGY} SELECT CASE WHEN focused THEN 'focus' ELSE strategy END AS strategy, count(*) AS files FROM strategies GROUP BY 1")
def stats_by_strategy(spark, sf_dir):
    return stats.by_strategy(strategies(spark, sf_dir))



_COUNT = lambda t: f"len(regexp_extract_all({t}, '{stats.TOKEN}'))"
_END = "least(length(original), length(array_to_string(string_split(original, chr(10))[1:lines], chr(10))) + 1, chars)"
COSTS = STRATEGY + f""", c0 AS (SELECT *, CASE strategy WHEN 'skeleton' THEN 10 ELSE 20 END AS lines, CASE strategy WHEN 'skeleton' THEN 1000 ELSE 2000 END AS chars FROM strategies),
 c1 AS (SELECT *, {_END} AS e, substr(original, 1, {_END}) AS head FROM c0),
 c2 AS (SELECT *, CASE WHEN NOT contains(head, chr(10)) OR length(head) - length(string_split(head, chr(10))[-1]) <= 1 THEN e ELSE length(head) - length(string_split(head, chr(10))[-1]) END AS z FROM c1),
 c3 AS (SELECT *, substr(original, 1, z) AS kept, substr(original, z + 1) AS rest FROM c2),
 c4 AS (SELECT *, len(string_split(rest, chr(10))) - CASE WHEN rest LIKE '%' || chr(10) THEN 1 ELSE 0 END AS more FROM c3),
 shown AS (SELECT *, CASE WHEN strategy = 'full' OR (strategy <> 'minified' AND e >= length(original)) THEN original WHEN strategy = 'minified' THEN '[minified: ' || CAST(len(string_split(original, chr(10))) AS VARCHAR) || ' lines omitted]'
  ELSE kept || CASE WHEN kept LIKE '%' || chr(10) THEN '' ELSE chr(10) END || '... [truncated: ' || CAST(more AS VARCHAR) || CASE WHEN more = 1 THEN ' more line, ' ELSE ' more lines, ' END || CAST(length(rest) AS VARCHAR) || ' chars]' || chr(10) END AS content FROM c4),
 costs AS (SELECT *, {_COUNT('original')} AS raw, {_COUNT('content')} AS tokens FROM shown)"""


def costs(spark, sf_dir):
    """The corpus as its strategies show it, with the tokens of what is shown and of the originals. (Source files are cut at 10 lines in place of a skeleton, which SQL can't make.)"""
    df = strategies(spark, sf_dir)
    whole = F.col("original")
    minified = F.concat(F.lit("[minified: "), F.size(F.split(whole, "\n")).cast("string"), F.lit(" lines omitted]"))
    content = F.when(F.col("strategy") == "full", whole).when(F.col("strategy") == "minified", minified).when(F.col("strategy") == "skeleton", transform.truncated(whole, 10, 1000)).otherwise(transform.truncated(whole, 20, 2000))
    df = df.withColumn("content", content)
    return df.withColumn("raw", stats.token_proxy(F.col("original"))).withColumn("tokens", stats.token_proxy(F.col("content"))).drop("original", "content")


@query("stats_totals", f"WITH {COSTS} SELECT CAST(sum(tokens) AS BIGINT) AS output, CAST(sum(raw) AS BIGINT) AS baseline, round(greatest(0.0, 1 - CAST(sum(tokens) AS DOUBLE) / CAST(sum(raw) AS DOUBLE)), 9) AS saved, CAST(round(sum(raw) * (CAST(sum(raw) AS DOUBLE) / sum(tokens))) AS BIGINT) AS scaled, count(*) AS files, CAST(sum(doc_id % 3) AS BIGINT) AS bodies, CAST(sum(doc_id % 5) AS BIGINT) AS comments FROM costs")
def stats_totals(spark, sf_dir):
    df = costs(spark, sf_dir).withColumn("stripped_bodies", F.expr("CAST(doc_id % 3 AS INT)")).withColumn("stripped_comments", F.expr("CAST(doc_id % 5 AS INT)"))
    t = stats.totals(df)
    return t.select("output", "baseline", F.round("saved", 9).alias("saved"), stats.scaled(F.col("baseline"), F.col("output"), F.col("baseline")).alias("scaled"), "files", "bodies", "comments")



@query("stats_json")
def stats_json(spark, sf_dir):
    """Totals as one JSON text; flags that are false are left out."""
    t = stats_totals(spark, sf_dir)
    by = stats_by_strategy(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct("strategy", "files"))).alias("by"))
    return t.crossJoin(F.broadcast(by)).select(F.to_json(F.struct("files", F.struct("output", "baseline", "saved").alias("tokens"), "bodies", "comments", F.map_from_entries("by").alias("strategies"), F.nullif(F.lit(False), F.lit(False)).alias("partial"))).alias("json"))


@query("top_files", f"WITH {COSTS} SELECT path, tokens FROM costs ORDER BY tokens DESC, path LIMIT 20")
def top_files(spark, sf_dir):
    return stats.largest(costs(spark, sf_dir).select("path", "tokens"), 20)



_UP = "list_transform(range(0, len(string_split(path, '/'))), lambda k: CASE WHEN k = 0 THEN '.' ELSE array_to_string(string_split(path, '/')[1:k], '/') END)"


@query("dir_rollup", f"WITH {COSTS}, up AS (SELECT unnest({_UP}) AS dir, tokens, raw FROM costs), t AS (SELECT dir, CASE WHEN dir = '.' THEN 0 ELSE len(string_split(dir, '/')) END AS depth, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(raw) AS BIGINT) AS raw, count(*) AS files FROM up GROUP BY dir) SELECT dir, CAST(depth AS INT) AS depth, tokens, raw, files, CAST(row_number() OVER (PARTITION BY depth, regexp_replace(dir, '/?[^/]*$', '') ORDER BY tokens DESC, dir) AS INT) AS place FROM t WHERE depth <= 3")
def dir_rollup(spark, sf_dir):
    t = stats.folder_totals(costs(spark, sf_dir).select("path", "tokens", "raw")).where("depth <= 3")
    return t.withColumn("place", F.row_number().over(Window.partitionBy("depth", graph.folder(F.col("dir"))).orderBy(F.desc("tokens"), "dir")))


_PRICES = ", ".join(f"('{m}', '{e}', CAST({p} AS DOUBLE))" for m, _, e, p in stats.MODELS)


@query("model_cost", f"WITH {COSTS}, n AS (SELECT 'cl100k' AS encoding, sum(tokens) AS tokens FROM costs UNION ALL SELECT 'o200k', sum(raw) FROM costs) SELECT model_id, CAST(tokens AS BIGINT) AS tokens, round(CAST(tokens AS DOUBLE) / 1e6 * usd, 9) AS usd FROM n JOIN (VALUES {_PRICES}) m(model_id, encoding, usd) USING (encoding)")
def model_cost(spark, sf_dir):
    n = costs(spark, sf_dir).agg(F.sum("tokens").alias("cl100k"), F.sum("raw").alias("o200k")).selectExpr("stack(2, 'cl100k', cl100k, 'o200k', o200k) AS (encoding, tokens)")
    models = spark.createDataFrame([(m, e, p) for m, _, e, p in stats.MODELS], "model_id string, encoding string, usd_per_million double")
    return stats.model_costs(n, models).select("model_id", "tokens", F.round("usd", 9).alias("usd"))


@query("legend", f"WITH {STRATEGY} SELECT bool_or(strategy = 'outline') AS outline, bool_or(strategy = 'skeleton') AS skeleton, bool_or(focused) AS focus, bool_or(strategy = 'truncated') AS truncated, bool_or(strategy = 'omitted') AS omitted FROM strategies")
def legend(spark, sf_dir):
    has = lambda s: F.bool_or(F.col("strategy") == s).alias(s)
    return strategies(spark, sf_dir).agg(has("outline"), has("skeleton"), F.bool_or("focused").alias("focus"), has("truncated"), has("omitted"))


# Budgets, splits, folds


@query("budget_focus_tokens", f"WITH {COSTS} SELECT CAST(coalesce(sum(tokens) FILTER (focused), 0) AS BIGINT) AS focus_tokens FROM costs")
def budget_focus_tokens(spark, sf_dir):
    return costs(spark, sf_dir).agg(F.coalesce(F.sum(F.when(F.col("focused"), F.col("tokens"))), F.lit(0)).alias("focus_tokens"))



@query("budget_omission_order", f"WITH {COSTS} SELECT path, {_RANK} AS rank, tokens + 12 AS saving, CAST(row_number() OVER (PARTITION BY source ORDER BY {_RANK}, tokens DESC, path) AS INT) AS place FROM costs WHERE NOT focused")
def budget_omission_order(spark, sf_dir):
    df = costs(spark, sf_dir).where("NOT focused").withColumn("rank", paths.omission_rank(F.col("path"))).withColumn("saving", F.col("tokens") + fitting.FILE_OVERHEAD)
    return df.select("path", "rank", "saving", F.row_number().over(Window.partitionBy("source").orderBy(*fitting.omission("rank", "saving"))).alias("place"))



@query("budget_ladder", f"WITH {STRATEGY} SELECT path, CASE WHEN strategy = 'full' AND language IS NULL THEN 'full,skeleton,omitted' WHEN language IS NOT NULL AND strategy = 'full' THEN 'full,skeleton,docs,bare,outline,omitted' WHEN language IS NOT NULL THEN 'skeleton,docs,bare,outline,omitted' ELSE 'skeleton,omitted' END AS levels FROM strategies")
def budget_ladder(spark, sf_dir):
    return strategies(spark, sf_dir).select("path", F.array_join(fitting.ladder(F.col("strategy"), F.col("language")), ",").alias("levels"))


@query("budget_prefix", f"WITH {COSTS}, m AS (SELECT source, path, raw - tokens AS saving FROM costs WHERE raw > tokens), s AS (SELECT *, coalesce(sum(saving) OVER (PARTITION BY source ORDER BY saving DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM m) SELECT source, path, saving FROM s WHERE b < 2000")
def budget_prefix(spark, sf_dir):
    moves = costs(spark, sf_dir).selectExpr("source", "path", "raw - tokens AS saving").where("saving > 0")
    return fitting.prefix_until(moves, [F.desc("saving"), F.col("path")], "saving", 2000, within="source").select("source", "path", "saving")


_PLAN = f"""WITH RECURSIVE {COSTS}, v AS (SELECT path, {_RANK} AS rank, CAST(raw AS BIGINT) AS full_, CAST(tokens AS BIGINT) AS cut, focused FROM costs),
 s AS (SELECT *, CASE WHEN NOT focused AND cut < full_ THEN cut ELSE full_ END AS now FROM v),
 g AS (SELECT sum(now + 12) AS size, sum(now + 12) // 4 AS lim FROM s),
 o AS (SELECT *, coalesce(sum(now + 12) OVER (ORDER BY rank, now + 12 DESC, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM s WHERE NOT focused),
 gone AS (SELECT o.* FROM o, g WHERE b < size - lim),
 room AS (SELECT lim - (size - (SELECT coalesce(sum(now + 12), 0) FROM gone)) AS r FROM g),
 q AS (SELECT path, cut + 12 AS cost, row_number() OVER (ORDER BY rank DESC, cut + 12, path) AS k FROM gone),
 f AS (SELECT q.k, q.path, CASE WHEN cost <= r THEN r - cost ELSE r END AS r, cost <= r AS taken FROM q, room WHERE k = 1 UNION ALL SELECT q.k, q.path, CASE WHEN cost <= f.r THEN f.r - cost ELSE f.r END, cost <= f.r FROM f JOIN q ON q.k = f.k + 1)
 SELECT s.path, CASE WHEN f.taken THEN 'skeleton' WHEN f.path IS NOT NULL THEN 'omitted' WHEN NOT focused AND cut < full_ THEN 'skeleton' ELSE 'full' END AS level FROM s LEFT JOIN f ON f.path = s.path"""


@query("budget_plan", _PLAN)
def budget_plan(spark, sf_dir):
    """The library's fit of whole files, cut files and omitted files to a quarter of what all cut files take."""
    df = costs(spark, sf_dir).withColumn("rank", paths.omission_rank(F.col("path"))).withColumn("tier", F.when(F.col("focused"), F.lit(None)).otherwise(0).cast("int"))
    levels = F.array(F.struct(F.lit("full").alias("name"), F.col("raw").cast("long").alias("tokens")), F.struct(F.lit("skeleton").alias("name"), F.col("tokens").cast("long").alias("tokens")), F.struct(F.lit("omitted").alias("name"), F.lit(0).cast("long").alias("tokens")))
    every = save(df.select("path", "rank", "tier", F.posexplode(levels).alias("level", "x")).select("path", "rank", "tier", "level", "x.name", "x.tokens"))
    least = every.where("name <> 'omitted'").groupBy("path").agg(F.when(F.first("tier").isNull(), F.max(F.when(F.col("level") == 0, F.col("tokens")))).otherwise(F.min("tokens")).alias("n"))
    size = least.agg(F.sum(F.col("n") + fitting.FILE_OVERHEAD)).first()[0] or 0
    return fitting.fit_to_budget(every, size // 4).state.select("path", F.col("name").alias("level"))


_ITEMS = f"{COSTS}, items AS (SELECT source, doc_id, tokens + 12 AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM costs)"


@query("budget_backfill", f"WITH RECURSIVE {_ITEMS}, r AS (SELECT source, k, doc_id, CASE WHEN cost <= 3000 THEN 3000 - cost ELSE 3000 END AS room, cost <= 3000 AS taken FROM items WHERE k = 1 UNION ALL SELECT i.source, i.k, i.doc_id, CASE WHEN i.cost <= r.room THEN r.room - i.cost ELSE r.room END, i.cost <= r.room FROM r JOIN items i ON i.source = r.source AND i.k = r.k + 1) SELECT source, doc_id AS ord FROM r WHERE taken")
def budget_backfill(spark, sf_dir):
    return fitting.backfill(costs(spark, sf_dir).selectExpr("source", "doc_id AS ord", "tokens + 12 AS cost"), "source", 3000)


_FIRST, _LATER, _LIMIT = 900, 20, 1500


@query("split_parts", f"""WITH RECURSIVE {_ITEMS}, r AS (
 SELECT source, k, doc_id, cost, CASE WHEN {_FIRST} + cost > {_LIMIT} AND {_LATER} + cost <= {_LIMIT} THEN 1 ELSE 0 END AS part, cost AS used FROM items WHERE k = 1
 UNION ALL SELECT i.source, i.k, i.doc_id, i.cost, r.part + CASE WHEN CASE WHEN r.part = 0 THEN {_FIRST} ELSE {_LATER} END + r.used + i.cost > {_LIMIT} THEN 1 ELSE 0 END,
  CASE WHEN CASE WHEN r.part = 0 THEN {_FIRST} ELSE {_LATER} END + r.used + i.cost > {_LIMIT} THEN i.cost ELSE r.used + i.cost END FROM r JOIN items i ON i.source = r.source AND i.k = r.k + 1)
 SELECT source, doc_id AS ord, CAST(part + 1 AS INT) AS part, CASE WHEN part = 0 THEN {_FIRST} ELSE {_LATER} END + cost > {_LIMIT} AS oversized FROM r""")
def split_parts(spark, sf_dir):
    return fitting.split_parts(costs(spark, sf_dir).selectExpr("source", "doc_id AS ord", "tokens + 12 AS cost"), "source", _LIMIT, _FIRST, _LATER)


_SPANS = "(l_orderkey % 50) * 40 + l_linenumber * 7"


@query("merge_spans", f"WITH RECURSIVE s AS (SELECT DISTINCT l_suppkey AS g, {_SPANS} AS a, {_SPANS} + CAST(l_quantity AS BIGINT) AS b FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY a, b) AS k FROM s), r AS (SELECT g, k, a, b, b AS upto, true AS kept FROM k WHERE k = 1 UNION ALL SELECT k.g, k.k, k.a, k.b, CASE WHEN k.a >= r.upto THEN k.b ELSE r.upto END, k.a >= r.upto FROM r JOIN k ON k.g = r.g AND k.k = r.k + 1) SELECT g, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b FROM r WHERE kept")
def merge_spans(spark, sf_dir):
    spans = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS g", f"CAST({_SPANS} AS BIGINT) AS a", f"CAST({_SPANS} + CAST(l_quantity AS BIGINT) AS BIGINT) AS b").distinct()
    return fitting.keep_first_spans(spans, "g")


@query("budget_collapse", "WITH f AS (SELECT user_id, arg_min(event_type, ts) AS was, arg_max(event_type, ts) AS now, count(*) AS changes FROM (SELECT DISTINCT user_id, ts, min(event_type) OVER (PARTITION BY user_id, ts) AS event_type FROM events) e GROUP BY user_id) SELECT user_id, was, now, changes FROM f WHERE was <> now")
def budget_collapse(spark, sf_dir):
    steps = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.min("event_type").alias("event_type"))
    return fitting.collapsed(steps, "user_id", "ts", "event_type")



# Sets, windows, events


@query("set_changed", f"WITH {CORPUS} SELECT path FROM (SELECT path FROM corpus WHERE doc_id % 3 = 0 UNION SELECT path FROM corpus WHERE doc_id % 5 = 0) x INTERSECT SELECT path FROM corpus WHERE lang = 'en'")
def set_changed(spark, sf_dir):
    files = corpus(spark, sf_dir)
    pick = lambda c: files.where(c).select("path")
    return remote.changed(pick("doc_id % 3 = 0"), pick("doc_id % 5 = 0"), pick("lang = 'en'"))



@query("set_except_outputs", f"WITH {CORPUS} SELECT path FROM corpus WHERE NOT regexp_matches(path, 'doc_[0-9]*5\\.(md|json)$')")
def set_except_outputs(spark, sf_dir):
    rules = filters.compile_rules(["doc_*5.md", "doc_*5.json"])
    return corpus(spark, sf_dir).where(~filters.is_ignored(F.col("path"), rules)).select("path")



@query("outline_dedupe", "WITH l AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) SELECT conv_id, turn, role FROM l WHERE before IS NULL OR before <> role")
def outline_dedupe(spark, sf_dir):
    return parsing.unrepeated(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "role")



@query("hint_once", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def hint_once(spark, sf_dir):
    from lodestone.streaming.watch import once

    return once(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id")



_WATCHED = "CASE event_id % 10 WHEN 0 THEN '.git/HEAD' WHEN 1 THEN 'a/node_modules/x.js' WHEN 2 THEN 'out.part2.md' WHEN 3 THEN 'out.md' ELSE concat('src/', user_id, '/', event_type) END"


@query("watch_filter", f"SELECT event_id, path FROM (SELECT event_id, {_WATCHED} AS path FROM events) e WHERE event_id % 10 > 3 AND path NOT LIKE 'src/7/%'")
def watch_filter(spark, sf_dir):
    from lodestone.streaming.watch import relevant

    events = table(spark, sf_dir, "events").selectExpr("event_id", f"{_WATCHED} AS path")
    gone = events.where("path LIKE 'src/7/%'").select("path").distinct()
    return relevant(events, "out.md", gone)


@query("watch_debounce", "WITH l AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM s GROUP BY user_id, k")
def watch_debounce(spark, sf_dir):
    from lodestone.streaming.watch import debounced

    return debounced(table(spark, sf_dir, "events"), "user_id", "ts", "6 hours")


# Rendering


_FENCE = "repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(original, '`+'), lambda x: length(x))), 0)))"


@query("render_files", f"WITH {STRATEGY}, b AS (SELECT source, doc_id, '### `' || path || '`' || CASE WHEN focused THEN ' [focus]' WHEN strategy = 'truncated' THEN ' [truncated]' WHEN strategy = 'minified' THEN ' [minified]' WHEN strategy = 'full' AND language IS NOT NULL THEN ' [full]' ELSE '' END || chr(10) || chr(10) || {_FENCE} || CASE WHEN path LIKE '%.md' THEN 'markdown' WHEN path LIKE '%.txt' THEN 'text' WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' THEN 'ts' ELSE 'json' END || chr(10) || original || CASE WHEN original LIKE '%' || chr(10) OR original = '' THEN '' ELSE chr(10) END || {_FENCE} || chr(10) AS block FROM strategies WHERE strategy <> 'minified') SELECT source, sha1(string_agg(block, chr(10) ORDER BY doc_id)) AS digest FROM b GROUP BY source")
def render_files(spark, sf_dir):
    df = strategies(spark, sf_dir).where("strategy <> 'minified'")
    block = render.markdown_block(F.col("path"), render.note(F.col("strategy"), F.col("focused"), F.col("language")), paths.fence(F.col("path")), F.col("original"))
    return render.joined(df.select("source", "doc_id", block.alias("block")), "source", "doc_id", "block").select("source", F.sha1(F.encode("document", "UTF-8")).alias("digest"))


@query("render_xml_headers", f"WITH {STRATEGY} SELECT doc_id, '<file path=\"' || path || '\"' || CASE WHEN language IS NULL THEN '' ELSE ' language=\"' || language || '\"' END || ' strategy=\"' || strategy || '\"' || CASE WHEN focused THEN ' focus=\"true\"' ELSE '' END || '>' AS header FROM strategies")
def render_xml_headers(spark, sf_dir):
    return strategies(spark, sf_dir).select("doc_id", render.xml_open(F.col("path"), F.col("language"), F.col("strategy"), F.col("focused"), F.lit(False)).alias("header"))


@query("render_tree", f"""WITH {CORPUS}, u AS (SELECT source, string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')) + 1)) AS d FROM corpus),
 n AS (SELECT source, array_to_string(p[1:d], '/') AS node, array_to_string(p[1:d-1], '/') AS parent, d, p[d] AS name, bool_or(d = len(p)) AS is_file FROM u GROUP BY ALL),
 l AS (SELECT *, row_number() OVER (PARTITION BY source, parent ORDER BY CASE WHEN is_file THEN '0' ELSE '1' END || name DESC) = 1 AS last FROM (SELECT source, node, parent, d, name, bool_or(is_file) AS is_file FROM n GROUP BY ALL) z),
 a AS (SELECT l.source, l.node, l.name, l.is_file, l.last, coalesce(string_agg(CASE WHEN b.node IS NULL THEN '' WHEN b.last THEN '    ' ELSE '│   ' END, '' ORDER BY b.d), '') AS lead FROM l LEFT JOIN l b ON b.source = l.source AND starts_with(l.node, b.node || '/') GROUP BY ALL)
 SELECT source, array_to_string(list_transform(string_split(node, '/'), lambda s, i: CASE WHEN is_file AND i = len(string_split(node, '/')) THEN '0' ELSE '1' END || s), '/') AS key, lead || CASE WHEN last THEN '└── ' ELSE '├── ' END || name || CASE WHEN is_file THEN '' ELSE '/' END AS line FROM a""")
def render_tree(spark, sf_dir):
    return render.tree(corpus(spark, sf_dir).select("source", "path"), "source")


@query("render_xml_blocks", f"WITH {STRATEGY} SELECT doc_id, sha1('<file path=\"' || path || '\"' || CASE WHEN language IS NULL THEN '' ELSE ' language=\"' || language || '\"' END || ' strategy=\"' || strategy || '\"' || CASE WHEN focused THEN ' focus=\"true\"' ELSE '' END || '>' || chr(10) || original || CASE WHEN original LIKE '%' || chr(10) OR original = '' THEN '' ELSE chr(10) END || '</file>' || chr(10)) AS digest FROM strategies")
def render_xml_blocks(spark, sf_dir):
    df = strategies(spark, sf_dir).withColumn("content", F.col("original")).withColumn("related", F.lit(False))
    return df.select("doc_id", F.sha1(F.encode(documents.block("xml"), "UTF-8")).alias("digest"))


@query("tree_notes", f"WITH {STRATEGY} SELECT path, CASE WHEN focused THEN ' [focus]' WHEN strategy IN ('truncated', 'minified') THEN ' [' || strategy || ']' WHEN strategy = 'full' AND language IS NOT NULL THEN ' [full]' ELSE '' END AS note FROM strategies")
def tree_notes(spark, sf_dir):
    """The notes at the ends of the tree's lines."""
    df = strategies(spark, sf_dir).select("source", "path", render.note(F.col("strategy"), F.col("focused"), F.col("language")).alias("note"))
    lines = render.tree(df, "source", "note").select(F.regexp_extract("line", r"(doc_[0-9]+\.[a-z]+)", 1).alias("name"), F.regexp_extract("line", r"doc_[0-9]+\.[a-z]+(.*)$", 1).alias("note")).where("name <> ''")
    return df.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name")).join(lines, "name").select("path", "note")


@query("folder_lines", f"WITH {COSTS}, u AS (SELECT unnest(range(1, least(len(string_split(path, '/')), 2) + 1)) AS d, string_split(path, '/') AS p, tokens, raw FROM costs), n AS (SELECT CASE WHEN d = 1 THEN '.' ELSE array_to_string(p[1:d-1], '/') END AS dir, d AS depth, p[d] AS name, sum(tokens) AS tokens, sum(raw) AS raw, count(*) AS files FROM u GROUP BY ALL), t AS (SELECT sum(tokens) AS a FROM costs), k AS (SELECT n.*, n.tokens < a * 0.02 AS small FROM n, t) SELECT dir, CAST(depth AS INT) AS depth, name, CAST(tokens AS BIGINT) AS tokens, CAST(raw AS BIGINT) AS raw, CAST(files AS BIGINT) AS files FROM k WHERE NOT small UNION ALL SELECT dir, CAST(depth AS INT), NULL, CAST(sum(tokens) AS BIGINT), CAST(sum(raw) AS BIGINT), count(*) FROM k WHERE small GROUP BY dir, depth")
def folder_lines(spark, sf_dir):
    """Two levels of folders; entries below two hundredths of all tokens are one row of their folder."""
    return stats.folder_lines(costs(spark, sf_dir).select("path", "tokens", "raw"), 2, 0.02).select("dir", "depth", "name", "tokens", "raw", "files")


_RULES = [r for r, _ in transform.SECRET_RULES] + ["assigned-secret"]


@query("redactions_by_rule", ORACLES["redact_secrets"].partition(" SELECT doc_id, sha1(t)")[0] + f", n AS (SELECT unnest({_RULES}) AS rule) SELECT rule, CAST(sum(len(regexp_extract_all(t, '\\[REDACTED:' || rule || '\\]'))) AS BIGINT) AS n FROM r, n GROUP BY rule")
def redactions_by_rule(spark, sf_dir):
    """How many secrets of each rule all documents hold."""
    masked = table(spark, sf_dir, "documents").select(F.explode(transform.redactions_by_rule(transform.redacted(F.col("text")))).alias("x"))
    every = spark.createDataFrame([(r, 0) for r in _RULES], "rule string, n long")
    return masked.select("x.rule", F.col("x.n").cast("long").alias("n")).union(every).groupBy("rule").agg(F.sum("n").alias("n"))


@query("graph_specs", f"WITH {SPECS} SELECT src, CASE WHEN src LIKE '%.ts' THEN 'javascript' ELSE 'python' END AS family, CASE WHEN src LIKE '%.ts' THEN './' || stem ELSE dotted END AS spec FROM specs WHERE src LIKE '%.ts' OR src LIKE '%.py'")
def graph_specs(spark, sf_dir):
    text = F.when(F.col("src").endswith(".ts"), F.concat(F.lit("export * from './"), "stem", F.lit("'\n"))).otherwise(F.concat(F.lit("  import "), "dotted", F.lit("\n")))
    return graph.extract_specs(specs(spark, sf_dir).select(F.col("src").alias("path"), paths.language(F.col("src")).alias("language"), text.alias("text")))


@query("cache_counts", f"WITH {CORPUS} SELECT count(*) FILTER (h) AS hits, count(*) FILTER (NOT h) AS misses FROM (SELECT sha1(original) IN (SELECT sha1(original) FROM corpus WHERE doc_id % 3 = 0) AS h FROM corpus) x")
def cache_counts(spark, sf_dir):
    from lodestone.plans.files import cache_hit_miss

    return cache.counts(cache_hit_miss(spark, sf_dir))

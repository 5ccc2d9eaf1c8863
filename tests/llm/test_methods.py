"""The methods against independent brute force: hashes, pages, runs of lines, near-duplicates, histograms, fingerprints, the pipeline."""

from __future__ import annotations

import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe_core, bpe_reuse, fingerprints, html_extract, language, linededup, neardup, quality, registry, sharding, token_counts
from lodestone.llm import textcore as tc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"


def thue_morse(n: int) -> tuple[str, str]:
    x = "a"
    while len(x) < n:
        x += x.translate({97: 98, 98: 97})
    return x, x.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_words_that_meet_modulo_powers_of_two_are_kept_apart(n):
    pair = [*thue_morse(n)]
    data, offsets = tc.utf8_column(pa.array(pair))
    assert len(set(tc.span_hash(data, offsets[:-1], offsets[1:]).tolist())) == 2
    enc = bpe_core.ByteBPE(public_tokenizers.path("byte_bpe_50k.json"))
    want = [e.ids for e in enc.library.encode_batch(pair, add_special_tokens=False)]
    ids, counts = enc.encode_block(data, offsets)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want
    got = bpe_reuse.ChunkEncoder(enc).encode(data, offsets)
    assert [x[1].decode() for x in got] == [",".join(map(str, w)) for w in want]
    sets, sizes = neardup.shingle_sets(data, offsets)
    assert sizes.tolist() == [1, 1] and sets[0] != sets[1]
    words = language.find_words(data, offsets)
    assert len(set(words.key.tolist())) == 2


def test_pages_cost_time_linear_in_their_length():
    pages = ["<p" + " " * 1_000_000 + "<", ("<p" + " " * 40 + "<") * 20_000, "<div>a" * 60_000, "<svg>" * 200_000, "<head>" * 150_000, '<p a="<p" b="' * 60_000, "<!x" * 300_000, "<div>" * 90_000 + "</b2>" * 90_000, "<script " * 100_000]
    began = time.time()
    for page in pages:
        html_extract.blocks_of(page)
    assert time.time() - began < 20
    assert [b[0] for b in html_extract.blocks_of("<head><title>t</title><p a='x>y' b=c>One &lt; two</p><p <b>three")] == ["One < two", "<p three"]


def test_network_equals_a_plain_one():
    """A page at a time, a block at a time, with loops; short pages in groups and a long page in parts."""
    w = html_extract.load_weights()
    n = html_extract.HIDDEN

    def plain(x: np.ndarray, k: str) -> list[np.ndarray]:
        h, c, out = np.zeros(n), np.zeros(n), []
        for row in x:
            a = row @ w[f"w{k}"] + h @ w[f"u{k}"] + w[f"b{k}"]
            i, f, o = (1 / (1 + np.exp(-a[j * n : j * n + n])) for j in range(3))
            c = f * c + i * np.tanh(a[3 * n :])
            h = o * np.tanh(c)
            out.append(h)
        return out

    pages = [html_extract.blocks_of(p) for p in ("<nav><a>x</a></nav><h1>T</h1><p>Some words, here they are.</p><footer>f</footer>", "<p>a</p>" * 7, "<ul><li>b<li>c</ul><p>A longer text of several words. And more.</p>" * 9)]
    vectors = [html_extract.vectors(b) for b in pages]
    got = html_extract.main_blocks(vectors, w)
    for blocks, x, keep in zip(pages, vectors, got):
        fore, back = plain(x, "f"), plain(x[::-1], "b")[::-1]
        score = np.array([h @ w["vf"] + g @ w["vb"] + r @ w["vx"] + w["c"][0] for h, g, r in zip(fore, back, x)])
        assert (keep == (score > 0)).all()
        assert (html_extract.long_page(blocks, w, 4) == keep).all()


def test_maximal_runs_by_all_pairs(spark):
    """For every line of a later place: is it in a run of enough words that stands earlier and apart? Runs are found by comparing all pairs of places."""
    r = random.Random(11)
    pool = [" ".join(r.choice("abcde") for _ in range(r.randint(1, 8))) for _ in range(7)]
    rows = [(i, "\n".join(r.choice(pool + [f"own {i} {k}"]) for k in range(r.randint(1, 16)))) for i in range(30)]
    rows += [(i, rows[3][1] + "\nnew line\n" + rows[4][1]) for i in range(30, 33)] + [(40, "\n".join(["a b"] * 40)), (None, rows[5][1])]
    least = 9
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    lines = [t.split("\n") for _, t in order]
    size = [[len(WORD.findall(x)) for x in own] for own in lines]
    want = []
    for i, own in enumerate(lines):
        gone = set()
        for a in range(len(own)):
            for j in range(i + 1):
                for b in range(len(lines[j])):
                    if (j, b) >= (i, a):
                        continue
                    m = 0
                    while a + m < len(own) and b + m < len(lines[j]) and own[a + m] == lines[j][b + m] and (j < i or b + m < a):
                        m += 1
                    # Every prefix of the run stands there too, but maybe earlier and overlapping: the first place counts.
                    while m and sum(size[i][a : a + m]) >= least:
                        first = min((k, c) for k in range(i + 1) for c in range(len(lines[k]) - m + 1) if lines[k][c : c + m] == own[a : a + m])
                        if first < (i, a) and (first[0] < i or first[1] + m <= a):
                            gone |= set(range(a, a + m))
                            break
                        m -= 1
        want.append((order[i][0], "\n".join(x for k, x in enumerate(own) if k not in gone)))
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), least).collect()
    assert sorted(((x["doc_id"] or -1), x["text"]) for x in got) == sorted(((i or -1), t) for i, t in want)


def test_equal_rows_stay_linear(spark):
    text = "\n".join(f"line {k} of a text that says this and that in some ten words" for k in range(20))
    rows = spark.range(1000).select(F.when(F.col("id") < 500, F.lit(1)).otherwise(F.col("id")).alias("doc_id"), F.lit(text).alias("text"))
    out = linededup.dedup_lines(rows).groupBy("doc_id").agg(F.min("n_removed").alias("a"), F.max("n_removed").alias("z"), F.count("*").alias("n")).collect()
    assert {(r["a"], r["z"]) for r in out if r["doc_id"] > 1} == {(20, 20)} and [(r["a"], r["z"], r["n"]) for r in out if r["doc_id"] == 1] == [(0, 0, 500)]


def test_near_duplicates_equal_all_pairs_on_a_table(spark):
    """Recall against all pairs, with null ids, equal ids and copies."""
    r = random.Random(5)
    texts = []
    for _ in range(25):
        base = [r.choice("abcdefghijklmnop") + str(r.randint(0, 400)) for _ in range(r.randint(40, 160))]
        for _ in range(r.randint(1, 6)):
            own = base[:]
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = "new" + str(r.randint(0, 99))
            texts.append(" ".join(own))
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, texts[0]), (7, texts[-1]), (500, texts[0])]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert [(x["component_id"], x["kept"]) for x in got if x["doc_id"] is None] == [(None, True)] * 2
    nodes = [(i, {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}) for i, t in rows if i is not None]
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(nodes)):
        for b in range(a):
            s, t = nodes[a][1], nodes[b][1]
            if 100 * len(s & t) >= 85 * len(s | t):
                parent[find(a)] = find(b)
    least: dict[int, int] = {}
    for k, (i, _) in enumerate(nodes):
        least[find(k)] = min(i, least.get(find(k), i))
    want = sorted((i, len(s), least[find(k)], i == least[find(k)]) for k, (i, s) in enumerate(nodes))
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in got if x["doc_id"] is not None) == want


def test_a_path_may_use_any_number_of_languages():
    langs = 200
    model = language.Model([f"l{k:03}" for k in range(langs)], np.zeros((language.BUCKETS, langs), np.float32), np.zeros((language.N_SCRIPTS, langs), np.float32))
    scores = np.zeros((140, langs), np.float32)
    scores[:70, 150] = scores[70:, 180] = 5
    path = language.Labeller(model).paths(scores, np.array([0, 140]))
    assert path.tolist() == [150] * 70 + [180] * 70


def test_long_words_and_full_automata(monkeypatch):
    r = random.Random(3)
    values = ["".join(r.choice("etaoin") for _ in range(30_000)), "the" * 4000, "x y " * 200 + "q" * 900 + " z", "漢字" * 700]
    tokens = token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))
    want = [len(e.ids) for e in tokens.library.encode_batch(values, add_special_tokens=False)]
    data, offsets = tc.utf8_column(pa.array(values))
    assert tokens.count(data, offsets).tolist() == want
    monkeypatch.setattr(token_counts, "HARD_LIMIT", 300)
    tokens.automaton.restart()
    assert tokens.count(data, offsets).tolist() == want


def js(p: dict, q: dict) -> float:
    out = 0.0
    for k in {*p, *q}:
        a, b = p.get(k, 0.0), q.get(k, 0.0)
        for x in (a, b):
            if x > 0:
                out += x * math.log2(x / ((a + b) / 2)) / 2
    return math.sqrt(max(0.0, out))


def test_quality_equals_a_plain_computation(spark):
    """Counts, references, distances and verdicts of the smallest table, computed in Python."""
    rows = [(r["doc_id"], r["text"] or "", r["lang"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()]
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D.,;:'\"()\-]+", t.lower()) if w]
    lettered = lambda w: re.search(r"[^\W\d_]", w) is not None or "a" <= w[:1] <= "z"

    def classes(t: str) -> dict[str, int]:
        n = {"upper": sum(c.isupper() for c in t), "lower": sum(c.islower() for c in t), "number": sum(c.isdigit() for c in t), "mark": sum(c in ".,;:'\"()-" for c in t), "symbol": sum(c in "#*$%&|<>!?=_/\\+~^@[]{}`" for c in t), "white": sum(c in " \t\n\x0b\x0c\r" for c in t)}
        return n | {"rest": len(t) - sum(n.values())}

    refs = {}
    for lang in {x for *_, x in rows if x}:
        words, chars = {}, {}
        for _, t, own in rows:
            if own == lang:
                for w in split(t):
                    k = w if lettered(w) else ""
                    words[k] = words.get(k, 0) + 1
                for k, v in classes(t).items():
                    chars[k] = chars.get(k, 0) + v
        total = sum(words.values())
        if total >= quality.MIN_REFERENCE_WORDS:
            top = sorted((w for w in words if w), key=lambda w: (-words[w], w.encode()))[: quality.COMMON_WORDS]
            refs[lang] = ({k: v / sum(chars.values()) for k, v in chars.items()}, {w: words.get(w, 0) / total for w in [*top, ""]})
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert refs
    for i, t, _ in rows:
        r, w = got[i], WORD.findall(t)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        times: dict[tuple, int] = {}
        for x in windows:
            times[x] = times.get(x, 0) + 1
        covered = {k + d for k, x in enumerate(windows) if times[x] > 1 for d in range(3)}
        full = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(covered))
        own = split(t)
        best = []
        for lang, (cls, common) in sorted(refs.items()):
            mine = {k: own.count(k) / max(len(own), 1) for k in common if k} | {"": sum(not lettered(x) for x in own) / max(len(own), 1)}
            a = js({**mine, "\0": max(0.0, 1 - sum(mine.values()))}, {**common, "\0": max(0.0, 1 - sum(common.values()))})
            n = max(len(t), 1)
            b = js({k: v / n for k, v in classes(t).items()} if t else {"rest": 1.0}, cls)
            best.append((max(a / quality.word_limit(common, quality.MAX_WORD_DISTANCE), b / quality.MAX_CLASS_DISTANCE), a, b, lang))
        worst, a, b, lang = min(best)
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert r["base_failed"] == failed
        if not failed:
            assert abs(r["word_distance"] - a) < 1e-5 and abs(r["class_distance"] - b) < 1e-5 and r["near_lang"] == lang and r["kept"] == (worst <= 1)


def test_quality_counts_words_in_compiled_code(spark):
    """No lambda runs for each word of the counting pass, and its sums are those of a count character by character."""
    text = "Über  12 Äpfel,\tÉté | ΟΔΟΣ ж٣ 漢字😀 a_b {x} -- 7%\r\n"
    df = spark.createDataFrame([(1, text * 3, "de"), (2, None, "de"), (3, "", "de"), (4, " a ", "de"), (5, text, None)], "doc_id long, text string, lang string")
    counts = quality.word_counts(df)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(" in plan and "filter(split(" not in plan
    got = {r["word"]: r["n"] for r in counts.collect()}
    t = text * 3 + " a "
    want = {" upper": sum(c.isupper() for c in t), " lower": sum(c.islower() for c in t), " number": sum(c.isdigit() for c in t), " mark": sum(c in ".,;:'\"()-" for c in t)}
    want |= {" symbol": sum(c in "#*$%&|<>!?=_/\\+~^@[]{}`" for c in t), " white": sum(c in " \t\n\x0b\x0c\r" for c in t), " chars": len(t)}
    words = [w for w in re.split(r"[\x20\x09-\x0D.,;:'\"()\-]+", t.lower()) if w]
    for w in words:
        k = w if re.search(r"[^\W\d_]", w) else ""
        want[k] = want.get(k, 0) + 1
    assert got == want


def test_likeness_of_fingerprints_is_that_of_their_leaves(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    rows = fingerprints.fingerprints_of_edits(df).orderBy("doc_id").collect()
    leaves = lambda f: {x[k : k + 12] for x in re.findall(r"\.([0-9A-F]*)", f) for k in range(0, len(x), 12)}
    alike = lambda a, b: round(len(a & b) / len(a | b), 6) if a | b else 1.0
    for k, r in enumerate(rows):
        own, after = leaves(r["fingerprint"]), leaves(rows[(k + 1) % len(rows)]["fingerprint"])
        assert r["near_edited"] == pytest.approx(alike(own, leaves(r["edited_fingerprint"]))) and r["near_next"] == pytest.approx(alike(own, after))
        root, tree = r["fingerprint"].split(":", 1)
        import hashlib

        assert root == hashlib.sha256(",".join(re.findall(r"([0-9A-F]{16})\(", tree)).encode()).hexdigest()


def test_ids_of_many_rows_are_spread_over_ranges(spark):
    """A third of all rows without an id, and one id of many rows: every text still meets its successor."""
    rows = [(None if k % 3 == 0 else 5 if k % 3 == 1 else k, f"text {k} " * (k % 7)) for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    own = df.select("doc_id", F.coalesce("doc_id", F.lit(fingerprints._LOWEST)).alias("_key"), F.col("text").alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    dealt, window, mine = fingerprints.with_next(own, "_key", "_tie", "_text", ["_key", "_tie", "_text"], 12)
    got = dealt.withColumn("_next", F.lead("_text").over(window)).where(mine).select("_key", "_tie", "_text", "_next", "_range").collect()
    order = sorted((r["_key"], r["_tie"], r["_text"]) for r in own.collect())
    assert len({r["_range"] for r in got if r["_key"] == fingerprints._LOWEST}) > 1
    after = {}
    for a, b in zip(order, [*order[1:], order[0]]):
        after.setdefault(a, set()).add(b[2])
    assert len(got) == len(rows) and all(r["_next"] in after[r["_key"], r["_tie"], r["_text"]] for r in got)


def test_strings_that_begin_alike_get_levels_of_their_own(spark):
    df = spark.range(400).select(F.concat(F.lit("common_crawl_"), F.col("id") % 8).alias("v"))
    cuts = sharding.string_cuts(df, 256)
    assert [int(x) for x in sharding._levels(np.array(cuts, object), pa.array([f"common_crawl_{k}" for k in range(8)]))] == list(range(8))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_registered_queries_run_over_whole_tables(spark, name):
    df = registry.queries()[name](spark, DATA)
    source = spark.read.parquet(f"{DATA}/{'pages' if name.startswith('op8') else 'documents'}.parquet")
    key = "page_id" if name.startswith("op8") else "doc_id"
    assert df.select(key).distinct().count() == source.count()


def test_pipeline_stages_equal_their_operators(spark):
    """run() against the stages' verdicts taken from the operators' own results."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    placed = corpus_pipeline.run(spark, DATA)
    kept = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    good = {r["doc_id"] for r in language.identify(docs).where("lang_pred <> 'und'").where(F.col("score") >= language.MIN_SCORE).collect()}
    rest = docs.where(F.col("doc_id").isin(list(good)))
    good = {r["doc_id"] for r in quality.judge(rest).where("kept").collect()}
    rest = rest.where(F.col("doc_id").isin(list(good)))
    cut = linededup.dedup_lines(rest).select("doc_id", "text", "n_removed").collect()
    left = spark.createDataFrame([(r["doc_id"], r["text"]) for r in cut if not r["n_removed"] or WORD.search(r["text"])], "doc_id long, text string")
    want = {r["doc_id"] for r in neardup.near_duplicates(left).where("kept").collect()}
    assert {r["doc_id"] for r in placed.select("doc_id").distinct().collect()} == want and want < set(kept)
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total: dict[int, int] = {}
    for r in placed.collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        ids = [*tok.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 0]
        assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
    assert all(total[i] == len(tok.encode(texts[i], add_special_tokens=False).ids) + 1 for i in want)


def test_tables_without_rows(spark):
    import corpus_pipeline

    none = spark.createDataFrame([], spark.read.parquet(f"{DATA}/documents.parquet").schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0

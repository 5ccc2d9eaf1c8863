"""The operators on small tables: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import bpe_reuse, fingerprints, html_extract, language, linededup, neardup, packing, quality, sharding, token_counts
from lodestone.llm.components import components

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, row string, r string, words string, _text string, node string, kept string, hash string, n_lines string"
EN = "the cat sat on the mat and it was of the kind that is in the house for all to see with this and that "
DE = "der hund ist in dem haus und die katze ist mit der maus auf dem dach das ist nicht von ihnen aber sie "
LONG = " ".join(f"{w}{i % 97}" for i, w in enumerate(EN.split() * 900))
NEAR = " ".join(f"word{i}" for i in range(200))
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    (1, EN * 4), (2, EN * 4), (2, EN * 4), (3, None), (4, ""), (5, "   \n\t"), (6, LONG), (7, DE * 5), (8, NEAR), (9, NEAR.replace("word199", "other")), (10, "short one"), (11, "short one"),
    (12, "Line A is here\n" + NEAR + "\ntail"), (None, "a text without an id " * 12), (13, "!!! ??? 123"), (14, EN + "\n" + DE * 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, {7: "de", 14: "de", 4: None}.get(i, "en"), None if i == 5 else f"s{(i or 0) % 3}", None if t is None else len(t), 1, "x", "x", "x", "x", "x", "x", "x", "x") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_packing(docs, none):
    tok = Tokenizer.from_file(BYTE)
    rows = packing.pack_documents(docs, BYTE).collect()
    want = sorted((str(i), len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in TEXTS)
    total: dict[str, int] = {}
    for r in rows:
        total[str(r["doc_id"])] = total.get(str(r["doc_id"]), 0) + r["length"]
        ids = [*tok.encode(dict(TEXTS)[r["doc_id"]] or "", add_special_tokens=False).ids, 0][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))
    assert sum(n for _, n in want) == sum(total.values())
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack_documents(none, BYTE).count() == 0


def test_sequences(docs):
    own = docs.where("doc_id IN (1, 6, 8, 10)")
    placed = packing.pack_documents(own, BYTE)
    tok = Tokenizer.from_file(BYTE)
    got = {}
    for r in packing.sequences(own, placed, BYTE).collect():
        for s in r["spans"]:
            got[s["doc_id"], s["piece"]] = r["ids"][s["offset"] : s["offset"] + s["length"]]
    for i in (1, 6, 8, 10):
        assert [x for (d, p) in sorted(got) if d == i for x in got[d, p]] == [*tok.encode(dict(TEXTS)[i], add_special_tokens=False).ids, 0]


def test_sharding(docs, none):
    rows = sharding.hilbert_shards(docs, 4).collect()
    counts = [sum(r["shard"] == k for r in rows) for k in range(4)]
    assert len(rows) == len(TEXTS) and max(counts) - min(counts) <= 1
    for k in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(counts[k]))
    for r in rows:
        raw = (dict(TEXTS)[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert sharding.hilbert_shards(none).count() == 0


def test_write_shards(docs, tmp_path):
    own = docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    sharding.write_shards(own, str(tmp_path / "out"), 4)
    back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == own.count() and back.select("shard").distinct().count() == 4


def test_encode_decode(docs, none):
    tok = Tokenizer.from_file(BYTE)
    for r in bpe_reuse.encode_decode(docs, BYTE).collect():
        text = dict(TEXTS)[r["doc_id"]] or ""
        ids = tok.encode(text, add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe_reuse.encode_decode(none, BYTE).count() == 0
    back = {r["doc_id"]: r["text"] for r in bpe_reuse.decode(bpe_reuse.encode(docs, BYTE), BYTE).collect()}
    assert all(back[i] == (t or "") for i, t in TEXTS)


def test_token_counts(docs, none):
    tok = Tokenizer.from_file(WORD)
    for r in token_counts.count_tokens(docs, WORD).collect():
        text = dict(TEXTS)[r["doc_id"]] or ""
        n = len(tok.encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 2048)
    assert token_counts.count_tokens(none, WORD).count() == 0


def test_near_duplicates(docs, none):
    got = {}
    rows = neardup.near_duplicates(docs).collect()
    for r in rows:
        got[r["doc_id"]] = (r["n_shingles"], r["component_id"], r["kept"])
    assert len(rows) == len(TEXTS)
    assert got[2][1:] == (1, False) and got[9][1:] == (8, False) and got[11][1:] == (10, False)
    assert got[3] == (0, 3, True) and got[4] == (0, 4, True) and got[5] == (0, 5, True)
    assert got[None][1:] == (None, True) and got[10][0] == 1 and got[7][1:] == (7, True)
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i in (1, 3, 4, 5, 6, 7, 8, 10, None, 13, 14))


def test_links_off_the_stars_are_found(spark):
    """A chain in which only neighbours are alike: no member is linked to all others."""
    base = [f"w{i}" for i in range(400)]
    chain = []
    for k in range(8):
        base = [f"k{k}_{i}" if 24 * k <= i < 24 * k + 24 else w for i, w in enumerate(base)]
        chain.append((100 - k, " ".join(base)))
    got = neardup.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string")).collect()
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(396)} for i, t in chain}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    parent = {i: i for i in sets}

    def find(x: int) -> int:
        return x if parent[x] == x else find(parent[x])

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert links and {r["doc_id"]: r["component_id"] for r in got} == {i: find(i) for i in sets}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 299)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {300: 299}


def brute_repeats(rows: list[tuple[int, str]], least: int) -> dict[int, str]:
    first: dict[tuple, tuple] = {}
    windows = []
    for i, t in rows:
        lines = t.split("\n")
        k = [(j, x, len(WORDS.findall(x))) for j, x in enumerate(lines) if WORDS.search(x)]
        own = set()
        for a in range(len(k)):
            for b in range(a, len(k)):
                if sum(x[2] for x in k[a : b + 1]) >= least:
                    own.add((a, b + 1))
                    break
        for b in range(len(k)):
            for a in range(b, -1, -1):
                if sum(x[2] for x in k[a : b + 1]) >= least:
                    own.add((a, b + 1))
                    break
        windows.append((i, lines, k, sorted(own)))
    out = {}
    for i, lines, k, own in windows:
        gone = set()
        for a, b in own:
            f = first.setdefault(tuple(x[1] for x in k[a:b]), (i, a))
            if f[0] != i or a >= f[1] + b - a:
                gone |= {x[0] for x in k[a:b]}
        out[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
    return out


def test_line_dedup_equals_brute_force(spark):
    import random

    r = random.Random(8)
    pool = [" ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(12)] + [""]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 25)))) for i in range(40)] + [(40, "\n".join(["a b"] * 60)), (41, "\n".join(["a b"] * 60))]
    got = {x["doc_id"]: x["text"] for x in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 12).collect()}
    assert got == brute_repeats(rows, 12)


def test_line_dedup_edges(docs, none):
    out = linededup.dedup_lines(docs)
    assert out.columns == [*[c for c in docs.columns if c != "n_lines"], "n_lines", "n_removed"]
    rows = out.collect()
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in rows}
    assert len(rows) == len(TEXTS) and got[1] == (EN * 4, 1, 0) and got[2] == ("", 1, 1)
    assert got[3] == (None, 0, 0) and got[4] == ("", 0, 0) and got[12] == ("Line A is here\ntail", 3, 1) and got[8][2] == 0
    assert linededup.dedup_lines(none).count() == 0


def test_quality(docs, none):
    rows = quality.judge(docs).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        w = WORDS.findall(dict(TEXTS)[r["doc_id"]] or "")
        assert (r["n_words"], r["word_chars"]) == (len(w), sum(map(len, w)))
        three = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {j for i, x in enumerate(three) if three.count(x) > 1 for j in (i, i + 1, i + 2)} if len(w) < 3000 else None
        if covered is not None:
            assert r["n_repeat_words"] == len(covered)
            assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["kept"] and r["base_failed"])
    assert quality.judge(none).count() == 0
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["kept"]}


def test_quality_rejects_other_histograms(spark):
    import random

    r = random.Random(1)
    common, rare = EN.split(), [f"{a}{b}{c}" for a in ("ka", "lo", "mi") for b in ("ren", "tas", "vol") for c in ("ing", "es", "um")]
    prose = lambda: " ".join(r.choice(common if r.random() < 0.5 else rare) for _ in range(120))
    good = [(i, prose(), "en") for i in range(60)]
    bad = [(100, prose().upper().replace(" ", "!! "), "en"), (101, prose().replace(" ", "### "), "en"), (102, " | ".join(r.choice(rare) + str(r.randint(0, 99)) for _ in range(120)), "en")]
    kept = {x["doc_id"] for x in quality.judge(spark.createDataFrame(good + bad, "doc_id long, text string, lang string")).where("kept").collect()}
    assert kept >= set(range(60)) and not kept & {100, 101, 102}


def test_quality_rejects_texts_without_common_words(spark):
    import random

    r = random.Random(2)
    common = EN.split()
    rare = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(9))
    prose = lambda share, bar="": " ".join((r.choice(common) if r.random() < share else rare()) + bar * (k % 3 > 0) for k in range(200))
    good = [(i, prose(0.3), "en") for i in range(60)]
    bad = [(100, prose(0.0), "en"), (101, prose(0.3, " |"), "en")]
    rows = quality.judge(spark.createDataFrame(good + bad, "doc_id long, text string, lang string")).collect()
    assert {x["doc_id"] for x in rows if x["kept"]} == set(range(60))
    assert all(x["class_distance"] <= quality.MAX_CLASS_DISTANCE and not x["base_failed"] for x in rows)  # by words alone


def test_common_words_have_any_length(spark):
    df = spark.createDataFrame([(k, "gewöhnlich außerdem natürlich " * 500, "de") for k in range(3)], "doc_id long, text string, lang string")
    counts = quality.word_counts(df)
    top = quality.common_words(counts)
    assert {(r["word"], r["n"]) for r in top.collect()} == {(w, 1500) for w in ("gewöhnlich", "außerdem", "natürlich")}
    assert list(quality.references(counts, top)) == ["de"]


def test_language(docs, none, spark):
    import random

    r = random.Random(3)
    mix = lambda base: " ".join(r.choice(base.split()) for _ in range(60))
    rows = [(i, mix(EN if i % 2 else DE), "en" if i % 2 else "de") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(df).collect()
    assert all(x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2) for x in got)
    assert sum(x["lang_pred"] == ("en" if x["doc_id"] % 2 else "de") for x in got) / len(got) > 0.98
    model = language.fit(df)
    both = spark.createDataFrame([(1, EN + DE, "en"), (2, "123 !!", "en"), (3, None, "en"), (4, "Привет мир", "en")], "doc_id long, text string, lang string")
    found = {x["doc_id"]: x for x in language.identify(both, model, spans=True).collect()}
    assert [s["lang"] for s in found[1]["spans"]] == ["en", "de"] and found[2]["lang_pred"] == found[3]["lang_pred"] == "und" and found[4]["lang_pred"] in ("en", "de")
    edge = {x["doc_id"]: x for x in language.identify(docs).collect()}
    assert edge[3]["lang_pred"] == edge[4]["lang_pred"] == edge[13]["lang_pred"] == "und" and edge[13]["score"] == 0
    assert language.identify(none).count() == 0
    assert language.filter_language(docs).columns == docs.columns
    assert {x["doc_id"] for x in docs.collect()} - {x["doc_id"] for x in language.filter_language(docs).collect()} == {3, 4, 5, 13}


def test_language_rejects_scripts_that_no_language_uses(spark):
    rows = [(i, EN if i % 2 else DE, "en" if i % 2 else "de") for i in range(40)]
    odd = [(100, "Привет мир это текст " * 20, None), (101, "这是一个中文文档 " * 20, None), (102, "Привет мир это текст " * 20 + "the cat", None), (103, EN + "Привет", None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    score = {x["doc_id"]: x["score"] for x in language.identify(df).collect()}
    assert score[100] == score[101] == 0 and score[102] < 0.05 and 0.8 < score[103] < 1 and score[0] == score[1] == 1
    assert {x["doc_id"] for x in language.filter_language(df).collect()} == {*range(40), 103}


def test_fingerprints(docs, none):
    tie = {r["t"]: r["h"] for r in docs.select(F.coalesce("text", F.lit("")).alias("t")).select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, tie[x[1] or ""]))
    rows = fingerprints.fingerprints_of_edits(docs).collect()
    assert len(rows) == len(TEXTS)
    want = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(want)
    by: dict[str, set] = {}
    for r in rows:
        by.setdefault(r["fingerprint"], set()).add(dict(TEXTS)[r["doc_id"]] or "")
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(x) == 1 for x in by.values())
    assert len(by) == len({t or "" for _, t in TEXTS})
    assert fingerprints.fingerprints_of_edits(none).count() == 0


def test_fingerprints_lead_to_the_edit(spark):
    lines = [f"Paragraph number {i} says something. It has two sentences." for i in range(12)]
    other = [*lines[:5], "Quite another paragraph.", *lines[6:]]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(other)), (3, "\n".join(lines[:3] + ["New."] + lines[3:]))], "doc_id long, text string")
    f = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprint(df).collect()}
    ask = lambda a, b: spark.range(1).select(fingerprints.differing(F.lit(f[a]), F.lit(f[b]))).first()[0]
    assert ask(1, 2) == [5] and ask(1, 1) == [] and ask(3, 1) == [3] and ask(1, 3) == []


def test_pages(spark):
    page = "<body><nav><ul><li><a href=a>x</a></ul></nav><article><h1>T</h1><p>One. Two.</p></article><footer>f</footer></body>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p>" + "word " * 30_000)], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    rows = html_extract.extract_pages(df).collect()
    assert [r["text"] for r in rows if r["page_id"] == 1] == ["T\nOne. Two."] * 2
    assert all(r["n_chars"] == len(r["text"]) for r in rows) and {r["text"] for r in rows if r["page_id"] in (2, 3)} == {""}
    assert html_extract.extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("start", "lost"),
    [("<head><title>t</title><body>", 0), ("<head><meta a=b><title>t</title>", 0), ("<head><title>t</title></head><body>", 0), ("<svg/>", 0), ("<p>a<svg width=1 />b</p>", 1), ("<iframe src=x>", 0), ("<object data=x>", 0), ("<script src=x />", 0), ("<svg><text>no</text></svg>", 0), ("<script>no</script>", 0)],
)
def test_open_elements_keep_what_follows(start, lost):
    blocks = [t for t, _, _ in html_extract.blocks_of(f"{start}<p>Main text.</p><p>More.</p>")]
    assert blocks == ["ab"] * lost + ["Main text.", "More."]


def test_unclosed_head_reaches_the_model():
    body = "".join(f"<p>Sentence number {k} of the article, which says rather more than a few words.</p>" for k in range(8))
    closed, unclosed = (html_extract.extract([f"<html><head><title>t</title>{end}<body><article>{body}</article></body></html>"], html_extract.load_weights())[0] for end in ("</head>", ""))
    assert unclosed == closed and unclosed[0]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "line_dedup", "minhash_near_dedup", "best_fit_packing"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, "")
        kept.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes and 0 < kept.count() <= before.count()
    assert kept.where("n_chars <> length(text)").count() == 0
    placed = corpus_pipeline.STAGES[-1][1](spark, kept, "")
    assert placed.select("doc_id").distinct().count() == kept.count()

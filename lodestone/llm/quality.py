"""Quality rules by the divergence of a document's histograms from those of its language.

Two histograms are taken of each whole text: of character classes (upper-case and lower-case letters, digits,
marks of punctuation, symbols, white space, the rest), and of common words (the ``COMMON_WORDS``
most frequent words with a letter, of whatever length, of each language; words without a letter,
such as ``|``, as one bin; and all other words as one bin). Words are parted alike in documents and references.
References come from all documents of each non-null ``lang``: class counts and word
counts summed over the whole corpus, in one scan. A document is compared with each reference by
Jensen-Shannon distance (base 2, 0 to 1) and passes if one language is near enough in
both: a text without one common word is as far from a reference as that reference's common words
hold shares, and the word distance must stay below ``MAX_WORD_PART`` of that. Guards: a text of fewer than ``MIN_WORDS`` words, or with more than half of its words in
repeated three-word windows, fails before; a language with fewer than ``MIN_REFERENCE_WORDS``
words gives no reference, and where there is no reference at all nothing is rejected by
distance. At most ``MAX_LANGUAGES`` values of ``lang`` are languages, those with the most words: the others (a column may
hold dirt) give no reference, as rare languages don't.

Everything runs as DataFrame expressions. A null text has no words; null languages give no
reference; repeated rows count and are judged as often as they appear, and rows of one id apart; of languages equally near the first
by name counts; very long texts cost time linear in their length but for one sort of their words; columns of any name may stand beside
(those of the result replace their like); an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.runtime import save

MIN_WORDS = 50
REPEAT_PERCENT = 50
COMMON_WORDS = 32
MIN_REFERENCE_WORDS = 2000
MAX_CLASS_DISTANCE = 0.26
MAX_WORD_DISTANCE = 0.445
#: Of the distance that a text without a common word has from the reference.
MAX_WORD_PART = 0.95
#: The bin of the words without a letter; no word is empty.
LETTERLESS = ""
#: The most values of ``lang`` that become references: each is an expression of the plan.
MAX_LANGUAGES = 250
WHITE = r"[\x20\x09-\x0D]+"
MARKS, SYMBOLS = r"[.,;:'\"()\-]+", r"[#*$%&|<>!?=_/\\+~^@\[\]{}`]+"
CLASSES = ("upper", "lower", "number", "mark", "symbol", "white")


def words_of(text: Column) -> Column:
    """The words of a text: runs of anything but ASCII white space."""
    return F.array_remove(F.split(text, WHITE), "")


def bare_words(text: Column) -> Column:
    """The words of a text in lower case, parted at white space and the usual marks."""
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D.,;:'\"()\-]+"), "")


def letterless(word: Column) -> Column:
    """Whether a word in lower case has no letter."""
    return ((word < "a") | (word >= "{")) & ~word.rlike(r"\p{L}")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once and only where it is needed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more in the text."""

    def covered(windows: Column) -> Column:
        # A window's hash gives way to its place in the low bits, so plain numbers are sorted; neighbours are then compared whole.
        bits = F.ceil(F.log2(F.size(windows) + F.lit(1.0)))

        def placed(mask: Column) -> Column:
            packed = F.sort_array(F.transform(windows, lambda h, i: h.bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))))

            def like(s: Column) -> Column:
                own = lambda k: F.get(windows, F.get(s, k).bitwiseAND(mask).cast("int"))
                twice = F.filter(s, lambda x, k: own(k - 1).eqNullSafe(F.get(windows, x.bitwiseAND(mask).cast("int"))) | own(k + 1).eqNullSafe(F.get(windows, x.bitwiseAND(mask).cast("int"))))
                return F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(mask).cast("int")))

            places = let(packed, like)
            # Each window covers three words, or those up to the next one.
            return let(places, lambda at: F.aggregate(F.transform(at, lambda x, k: F.least(F.coalesce(F.get(at, k + 1) - x, F.lit(3)), F.lit(3))), F.lit(0), lambda n, x: n + x))

        return let(F.pow(F.lit(2.0), bits).cast("long") - 1, placed)

    def windows(h: Column) -> Column:
        return F.slice(F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), 1, F.greatest(F.size(h) - 2, F.lit(0)))

    return let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w)))


def after(array: Column) -> Column:
    """An array without its first element: zipped with the array, each element meets its successor, and the last a null."""
    return F.slice(array, 2, F.size(array))


def class_counts(text: Column) -> Column:
    """Characters of each class in a text: a struct of longs, with ``chars`` (all) and ``noted`` (``[#*$%&|<>]``).

    Most characters are plain lower-case letters and go first, then white space; A, a and 0 are written for the other upper-case and lower-case letters and digits.
    """

    def lost(x: Column, pattern: str) -> Column:
        return F.length(x) - F.length(F.regexp_replace(x, pattern, ""))

    def counts(s: Column) -> Column:
        marked, rest = s["marked"], s["rest"]
        upper, number = (F.length(marked) - F.length(F.replace(marked, F.lit(x), F.lit(""))) for x in "A0")
        parts = {
            "upper": upper, "number": number, "lower": s["plain"] + F.length(marked) - F.length(rest) - upper - number, "white": s["chars"] - s["plain"] - F.length(marked),
            "mark": lost(rest, MARKS), "symbol": lost(rest, SYMBOLS), "noted": lost(rest, r"[#*$%&|<>]+"), "chars": s["chars"],
        }
        return F.struct(*[c.cast("long").alias(n) for n, c in parts.items()])

    def split(s: Column) -> Column:
        marked = F.mask(F.regexp_replace(s["other"], WHITE, ""), F.lit("A"), F.lit("a"), F.lit("0"), F.lit(None))
        return let(marked, lambda m: F.struct(m.alias("marked"), F.regexp_replace(m, "[Aa0]+", "").alias("rest"), s["chars"].alias("chars"), (s["chars"] - F.length(s["other"])).alias("plain")))

    return let(let(F.struct(F.length(text).alias("chars"), F.regexp_replace(text, "[a-z]+", "").alias("other")), split), counts)


def word_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Of each language over all its documents: how often each word with a letter occurs (lang, word, n), all words without one as ``LETTERLESS``, and the characters of each class as a blank and its name."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_c", class_counts(F.col("_text")))
    # A class goes as a word that no text can hold: it begins with a blank, and its count follows another.
    classes = F.array(*[F.concat(F.lit(f" {c} "), F.col("_c")[c].cast("string")) for c in (*CLASSES, "chars")])
    word = F.col("_word")
    tag = F.startswith(word, F.lit(" "))
    pairs = rows.select("lang", F.explode(F.concat(bare_words(F.col("_text")), classes)).alias("_word")).select(
        "lang",
        F.when(tag, F.substring_index(word, " ", 2)).when(letterless(word), LETTERLESS).otherwise(word).alias("word"),
        F.when(tag, F.substring_index(word, " ", -1).cast("long")).otherwise(1).alias("n"),
    )
    return pairs.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def common_words(counts: DataFrame, k: int = COMMON_WORDS) -> DataFrame:
    """The ``k`` most frequent words with a letter of each language in ``word_counts``."""
    counts = counts.where("word <> '' AND NOT startswith(word, ' ')")
    # The best k of each hash part first, so no task sorts a language's whole vocabulary.
    order = [F.desc("n"), F.col("word")]
    part = counts.withColumn("_part", F.pmod(F.xxhash64("word"), F.lit(64)))
    first = part.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(f"_r <= {k}")
    return first.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(f"_r <= {k}").select("lang", "word", "n")


def js_terms(p: Column, q: Column) -> Column:
    """A bin's part of the Jensen-Shannon divergence (base 2), for shares p and q."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return (part(p) + part(q)) / 2


def with_counts(df: DataFrame, text: str, vocabulary: list[str]) -> DataFrame:
    """Add the base counts, the class counts and the counts of the vocabulary's words (by their hashes) of a non-null text column."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("_words", words_of(F.col(text))).withColumn("_solid", F.array_join("_words", "")).withColumn("_lines", lines).withColumn("_bare", bare_words(F.col(text))).withColumn("_c", class_counts(F.col("_solid")))
    known = lambda w: w.isin(vocabulary)
    listed = F.transform(F.filter("_bare", lambda w: known(w) | letterless(w)), lambda w: F.xxhash64(F.when(known(w), w).otherwise(LETTERLESS))) if vocabulary else F.array().cast("array<bigint>")
    df = df.select(
        "*",
        F.size("_words").cast("long").alias("n_words"),
        F.col("_c.chars").alias("word_chars"),
        F.col("_c.noted").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        *[F.col(f"_c.{c}").alias(f"_{c}") for c in CLASSES if c != "white"],
        F.length(text).cast("long").alias("_chars"),
        F.size("_bare").cast("long").alias("_n"),
        F.sort_array(listed).alias("_listed"),
    ).drop("_words", "_solid", "_lines", "_bare", "_c")
    df = df.withColumn("_white", F.col("_chars") - F.col("word_chars"))
    # Of each run in the sorted hashes the place behind its end, and from that its length.
    ends = F.transform(F.zip_with("_listed", after(F.col("_listed")), lambda x, y: x == y), lambda same, k: F.when(~F.coalesce(same, F.lit(False)), k + 1))
    lengths = let(F.filter(ends, lambda x: x.isNotNull()), lambda e: F.zip_with(e, F.concat(F.array(F.lit(0)), F.slice(e, 1, F.greatest(F.size(e) - 1, F.lit(0)))), lambda x, y: x - y))
    runs = F.zip_with(F.array_distinct("_listed"), lengths, lambda w, n: F.struct(w.alias("w"), n.cast("double").alias("n")))
    return df.withColumn("_common", runs).drop("_listed")


def references(counts: DataFrame, top: DataFrame, min_words: int = MIN_REFERENCE_WORDS) -> dict[str, tuple[dict[str, float], dict[str, float]]]:
    """Of each language the shares of the classes, and of its common words and the words without a letter; a few numbers a language."""
    sums = counts.groupBy("lang").agg(
        F.sum(F.when(~F.startswith("word", F.lit(" ")), F.col("n"))).alias("_n"), *[F.coalesce(F.sum(F.when(F.col("word") == w, F.col("n"))), F.lit(0)).alias(c) for c, w in [("letterless", LETTERLESS), *((c, f" {c}") for c in (*CLASSES, "chars"))]]
    )
    sums = {r["lang"]: r for r in sums.where(f"_n >= {min_words}").orderBy(F.desc("_n"), "lang").limit(MAX_LANGUAGES).collect()}
    words: dict[str, dict[str, int]] = {}
    for r in top.where(F.col("lang").isin(list(sums))).collect() if sums else ():
        words.setdefault(r["lang"], {})[r["word"]] = r["n"]
    out = {}
    for lang, r in sums.items():
        if lang in words:
            own = {c: r[c] for c in CLASSES}
            own["rest"] = r["chars"] - sum(own.values())
            out[lang] = ({c: max(n, 0) / r["chars"] for c, n in own.items()}, {w: n / r["_n"] for w, n in {**words[lang], LETTERLESS: r["letterless"]}.items()})
    return out


def class_distance(shares: dict[str, float]) -> Column:
    """Distance of the row's class histogram from a reference's."""
    chars = F.greatest(F.col("_chars"), F.lit(1)).cast("double")
    own = {c: F.col(f"_{c}") / chars for c in CLASSES}
    own["rest"] = F.greatest(F.lit(0.0), F.lit(1.0) - reduce(lambda a, b: a + b, own.values()))
    return F.sqrt(F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, [js_terms(p, F.lit(shares[c])) for c, p in own.items()])))


def word_distance(shares: dict[str, float], hashes: dict[str, int]) -> Column:
    """Distance of the row's common-word histogram from a reference's; words it lacks add half their share."""
    names = sorted(shares)
    codes = F.array(*[F.lit(hashes[w]) for w in names])
    total = F.greatest(F.col("_n"), F.lit(1)).cast("double")
    q = F.array(*[F.lit(shares[w]) for w in names])
    mine = F.filter("_common", lambda x: x["w"].isin([hashes[w] for w in names]))
    pairs = F.transform(mine, lambda x: F.struct((x["n"] / total).alias("p"), F.element_at(q, F.array_position(codes, x["w"]).cast("int")).alias("q")))
    sums = F.aggregate(pairs, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q")), lambda a, x: F.struct((a["d"] + js_terms(x["p"], x["q"])).alias("d"), (a["p"] + x["p"]).alias("p"), (a["q"] + x["q"]).alias("q")))
    all_q = math.fsum(shares.values())
    other = lambda a: js_terms(F.greatest(F.lit(0.0), 1.0 - a["p"]), F.lit(max(0.0, 1.0 - all_q)))
    return F.sqrt(F.greatest(F.lit(0.0), F.element_at(F.transform(F.array(sums), lambda a: a["d"] + F.greatest(F.lit(0.0), all_q - a["q"]) / 2 + other(a)), 1)))


def word_hashes(spark: SparkSession, words: list[str]) -> dict[str, int]:
    """The hashes by which rows name the words of the vocabulary."""
    return {r[0]: r[1] for r in spark.range(1).select(F.explode(F.lit(words)).alias("w")).select("w", F.xxhash64("w")).collect()}


def word_limit(shares: dict[str, float], max_word: float) -> float:
    """The largest word distance from a reference that is allowed: less than that of a text without a common word."""
    listed = math.fsum(shares.values())
    rest = max(0.0, 1.0 - listed)
    m = (1.0 + rest) / 2
    none = listed / 2 + (math.log2(1.0 / m) + (rest * math.log2(rest / m) if rest else 0.0)) / 2
    return min(max_word, MAX_WORD_PART * math.sqrt(none)) or max_word


def judged(docs: DataFrame, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with each row's counts, its nearest language (``near_lang``), the two distances from it, and the verdict."""
    counts = save(word_counts(docs, text_col, lang_col))
    refs = references(counts, common_words(counts))
    vocabulary = sorted({w for _, shares in refs.values() for w in shares if w != LETTERLESS})
    hashes = word_hashes(docs.sparkSession, [*vocabulary, LETTERLESS])
    rows = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    df = with_counts(rows, "_text", vocabulary)
    none = F.lit(None).cast("struct<worst:double,word:double,cls:double,near:string>")
    options = F.array(*[F.struct(word_distance(w, hashes).alias("word"), class_distance(c).alias("cls"), F.lit(lang).alias("near"), F.lit(word_limit(w, max_word)).alias("limit")) for lang, (c, w) in sorted(refs.items())])
    near = lambda xs: F.transform(xs, lambda o: F.struct(F.greatest(o["word"] / o["limit"], o["cls"] / max_class).alias("worst"), o["word"].alias("word"), o["cls"].alias("cls"), o["near"].alias("near")))
    df = df.withColumn("_best", F.array_min(near(options)) if refs else none)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    added = [
        failed.alias("base_failed"),
        (~failed & (F.coalesce(F.col("_best.worst"), F.lit(0.0)) <= 1.0)).alias("kept"),
        F.col("_best.near").alias("near_lang"),
        F.round("_best.cls", 6).alias("class_distance"),
        F.round("_best.word", 6).alias("word_distance"),
    ]
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in (*BASE, "base_failed", "kept", "near_lang", "class_distance", "word_distance")]
    return df.select(*own, *BASE, *added)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The verdicts without the texts."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    return judged(plain).drop("text", "lang")


def filter_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns only."""
    own = [F.col(c).alias(f"_own_{c}") for c in docs.columns]
    plain = docs.select(*own, F.col(text_col).alias("_t"), F.col(lang_col).alias("_l"))
    # A filter that could be pushed down would take the verdict's whole expression along, several times over.
    verdict = judged(plain, text_col="_t", lang_col="_l").withColumn("_row", F.monotonically_increasing_id())
    return verdict.where("kept AND _row >= 0").select(*[F.col(f"_own_{c}").alias(c) for c in docs.columns])

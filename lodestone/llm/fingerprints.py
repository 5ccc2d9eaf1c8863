r"""Document fingerprints: a Merkle tree over sections, paragraphs and sentence parts.

Leaves are the parts of at most ``LEAF`` characters into which each sentence of a paragraph
(a line) falls; a paragraph's node hashes its leaves, a section's its paragraphs, and the root
(SHA-256) the sections. Sections end at paragraphs that their own hash marks, so an
inserted paragraph moves no later border. The fingerprint writes the tree down:

    root:section(paragraph.leaves,paragraph.leaves)section(...)

with 16 hex digits a node and 12 a leaf. Equal roots mean equal texts; where roots differ, unequal
sections and paragraphs lead to the edit (:func:`differing`). The likeness of two
fingerprints is the Jaccard index of their leaves.

Everything runs as DataFrame expressions. To meet its successor in order of doc_id, each
text is shuffled once, by ranges of doc_id of about ``RANGE_BYTES``; the first document of each range also goes to the
range before. An id (or the null one) that many rows have is spread over as many ranges as it fills. A null text is an empty one, a null doc_id comes first, rows of one doc_id stand
in the order of a digest of their texts, then of the texts, and the only document is its own successor. Very long texts cost time linear in
their length. Other columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LEAF = 24
#: One paragraph in so many ends a section.
SECTION = 4
_PARTS = rf"[^.!?]{{1,{LEAF}}}[.!?]{{0,3}}|[.!?]{{1,{LEAF}}}"
_LOWEST = -(1 << 63)
#: What a range of documents should hold, and the most ranges (their borders are a literal of the plan).
RANGE_BYTES, MAX_RANGES = 32 << 20, 20_000
#: Bits of a leaf.
_LEAF_BITS, _LEAF_DIGITS = (1 << 48) - 1, 12


def _digits(h: Column) -> Column:
    return F.lpad(F.hex(h), 16, "0")


def with_tree(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add ``name`` (the fingerprint) and ``name_leaves`` (48 bits a leaf) of a text column."""
    df = df.withColumn("_leaves", F.transform(F.split(text, "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(_PARTS), F.lit(0)), lambda x: F.xxhash64(x))))
    df = df.withColumn("_nodes", F.transform("_leaves", lambda x: F.xxhash64(x)))
    nodes = F.col("_nodes")
    df = df.withColumn("_ends", F.filter(F.sequence(F.lit(1), F.size(nodes)), lambda i: (i == F.size(nodes)) | (F.pmod(F.get(nodes, i - 1), F.lit(SECTION)) == 0)))
    ends = F.col("_ends")
    begin = lambda k: F.coalesce(F.get(ends, k - 1), F.lit(0)) + 1
    df = df.withColumn("_sections", F.transform(ends, lambda e, k: F.xxhash64(F.slice(nodes, begin(k), e - begin(k) + 1))))
    short = F.transform("_leaves", lambda p: F.transform(p, lambda x: x.bitwiseAND(F.lit(_LEAF_BITS))))
    df = df.withColumn("_short", short)
    said = F.transform("_short", lambda p, i: F.concat(_digits(F.get(nodes, i)), F.lit("."), F.array_join(F.transform(p, lambda x: F.lpad(F.hex(x), _LEAF_DIGITS, "0")), "")))
    df = df.withColumn("_said", said)
    tree = F.array_join(F.transform("_sections", lambda s, k: F.concat(_digits(s), F.lit("("), F.array_join(F.slice(F.col("_said"), begin(k), F.get(ends, k) - begin(k) + 1), ","), F.lit(")"))), "")
    root = F.sha2(F.array_join(F.transform("_sections", _digits), ","), 256)
    df = df.withColumn(name, F.concat(root, F.lit(":"), tree)).withColumn(f"{name}_leaves", F.flatten("_short"))
    return df.drop("_leaves", "_nodes", "_ends", "_sections", "_short", "_said")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of leaves; two without leaves are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def with_next(docs: DataFrame, key: str, tie: str, text: str, columns: list[str], ranges: int | None = None) -> tuple[DataFrame, Window, Column]:
    """Deal rows to ranges of ``key`` (a long), each with a guest: the first row after it (after the last range, the first of all).

    ``tie`` (a long) orders rows of one key, then ``text``. Returns the rows with ``_range`` and ``_guest``, the window in which the next row stands, and the
    condition that drops guests.
    """
    spark = docs.sparkSession
    size = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    count = ranges or min(MAX_RANGES, max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(str(size)) // RANGE_BYTES))
    ids = docs.select(key, tie)
    quantiles = sorted(int(c) for c in ids.approxQuantile(key, [k / count for k in range(1, count)], 1 / (4 * count))) if count > 1 else []
    at = _range_of(F.col(key), quantiles)
    # A key at which several borders fall fills as many ranges: its rows are parted by the tie.
    heavy = [(k, n) for k, n in Counter(quantiles).items() if n > 1]
    if heavy:
        parts = F.coalesce(F.get(F.lit([n for _, n in heavy]), F.array_position(F.lit([k for k, _ in heavy]), F.col(key)).cast("int") - 1), F.lit(1))
        share = F.floor((F.shiftrightunsigned(F.col(tie).bitwiseXOR(F.lit(_LOWEST)), 32)) * parts / F.lit(1 << 32)).cast("int")
        at = at - parts + 1 + share
    firsts = {r["b"]: tuple(r["k"]) for r in ids.groupBy(at.alias("b")).agg(F.min(F.struct(key, tie)).alias("k")).collect()}
    full = sorted(firsts)
    before = {b: full[i - 1] for i, b in enumerate(full)}
    rows = docs.select(*columns, at.alias("_own"))
    if full:
        top = full[-1] + 1
        previous = F.lit([before.get(b, 0) for b in range(top)])
        key_of, tie_of = (F.get(F.lit([firsts.get(b, (_LOWEST, _LOWEST))[j] for b in range(top)]), F.col("_own")) for j in (0, 1))
        both = F.when((F.col(key) == key_of) & (F.col(tie) == tie_of), F.array(F.col("_own"), F.get(previous, F.col("_own")))).otherwise(F.array(F.col("_own")))
    else:
        both = F.array(F.col("_own"))
    dealt = rows.select(*columns, F.posexplode(both).alias("_guest", "_range"))
    return dealt, Window.partitionBy("_range").orderBy("_guest", key, tie, text), F.col("_guest") == 0


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``key``: a binary search in an expression."""
    if not cuts:
        return F.lit(0)
    table = F.lit(cuts)
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(table, at + step - 1) <= key), at + step).otherwise(at))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The fingerprint of each text: doc_id, fingerprint."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return with_tree(df, "_text", "fingerprint").select("doc_id", "fingerprint")


def differing(a: Column, b: Column) -> Column:
    """Of two fingerprints: the numbers (from 0) of a's paragraphs that b has nowhere; empty if the roots are equal."""
    nodes = lambda f: F.regexp_extract_all(f, F.lit(r"([0-9A-F]{16})\."), F.lit(1))
    return F.when(F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1), F.array().cast("array<int>")).otherwise(
        F.transform(F.filter(F.transform(nodes(a), lambda n, i: F.struct(n.alias("n"), i.alias("i"))), lambda x: ~F.array_contains(nodes(b), x["n"])), lambda x: x["i"])
    )


def fingerprints_of_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of an edited copy, whose last quarter is the next document's beginning."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col), F.lit(_LOWEST)).cast("long").alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    own = own.withColumn("_tie", F.xxhash64("_text"))
    rows, window, mine = with_next(own, "_key", "_tie", "_text", ["doc_id", "_key", "_tie", "_text"])
    df = rows.withColumn("_next", F.coalesce(F.lead("_text").over(window), F.lit("")))
    df = with_tree(df, "_text", "fingerprint")
    df = df.withColumn("_next_leaves", F.lead("fingerprint_leaves").over(window)).where(mine)
    n = F.length("_text")
    cut = F.floor(n / 4).cast("int")
    df = df.select("doc_id", "fingerprint", "fingerprint_leaves", "_next_leaves", n.cast("long").alias("n_chars"), F.concat(F.left("_text", n - cut), F.left("_next", cut)).alias("_edited"))
    df = with_tree(df.withColumn("edited_sha256", F.sha2("_edited", 256)), "_edited", "edited_fingerprint")
    return df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.round(likeness(F.col("fingerprint_leaves"), F.col("edited_fingerprint_leaves")), 6).alias("near_edited"), F.round(likeness(F.col("fingerprint_leaves"), F.col("_next_leaves")), 6).alias("near_next"))

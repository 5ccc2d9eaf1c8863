"""MinHash near-duplicates: banded minima, verification on full sets, connected components.

A text's set holds its distinct runs of five words (A-Z in lower case); a text with fewer words
is one run, a text without words has the empty set and no links. Two sets are linked
if 100 * intersection >= ``percent`` * union.

1. One pass over the texts gives each set's size, a 128-bit digest, ``BANDS * ROWS`` hash
   minima (a byte of each is kept as a sketch) and a key for each band of ``ROWS`` minima. At the
   similarity 0.85 a pair shares no band with a probability below 1e-6.
2. Equal sets (equal digests) become one node, named by a hash of the digest, so copies cost nothing further on.
3. Bands met by two or more nodes are buckets. A bucket pairs its members only with three of its own, the
   least, the greatest and the least by a hash (linear in its size; over all bands a node meets few different hubs). Sketches drop
   pairs that are far below the threshold (at 0.85, by more than seven standard deviations);
   the others are verified on the full sets made from the whole texts. A hub's sketch and text go to as many
   tasks as its buckets have shares of ``HUB_SHARE`` members.
4. Buckets whose members are then not all in one component are compared in full, but
   only between components, inside tasks of bounded size (a large bucket is cut into
   blocks, a task for each pair of blocks), and only pairs near the threshold leave
   a task. These are verified too. Nothing is capped, and no group emits all its pairs.
5. Components by large-star and small-star.

Null texts are empty; rows with a null id keep to themselves (``component_id`` null, kept); rows equal in id and set
fall together, and rows of one id with unequal sets are nodes of their own, each with the least id that it reaches.
Very long texts are blocks of their own. Other columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textcore as tc
from lodestone.llm.components import components
from lodestone.llm.runtime import map_arrow, save, text_blocks

WORDS, PERCENT = 5, 85
BANDS, ROWS = 32, 6
BLOCK = 1024
#: Members of a bucket that share one copy of the hub.
HUB_SHARE = 512
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_STEPS = _RNG.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_FEW = _RNG.integers(0, 1 << 63, WORDS + 64, np.uint64)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
SET_SCHEMA = "doc_id long, digest long, n_shingles long, d1 long, d2 long, sketch binary, bands array<long>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingles of each text, one text after another, and their numbers."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n, np.int64)
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    solid = ~_SEPARATOR[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | first[1:-1]
    a, b = np.flatnonzero(start), np.flatnonzero(stop) + 1
    h = tc.span_hash(low, a, b)
    bounds = np.searchsorted(a, offsets)
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(n), counts)
    place = np.arange(len(h)) - np.repeat(bounds[:-1], counts)
    full = counts[doc] - place >= words
    mixed = np.zeros(len(h), np.uint64)
    padded = np.concatenate([h, np.zeros(words, np.uint64)])
    for k in range(words):
        mixed += padded[k : k + len(h)] * _STEPS[k % WORDS]
    keep = full.copy()
    # Fewer words than a run: the whole sequence as one.
    few = np.flatnonzero((counts > 0) & (counts < words))
    for d in few.tolist():
        i, m = int(bounds[d]), int(counts[d])
        mixed[i] = (h[i : i + m] * _STEPS[np.arange(m) % WORDS]).sum(dtype=np.uint64) ^ _FEW[m % len(_FEW)]
        keep[i] = True
    x, d = tc.mix(mixed[keep]), doc[keep]
    order = np.lexsort((x, d))
    x, d = x[order], d[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    return x[new], np.bincount(d[new], minlength=n)


def minima(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The hash minima of non-empty sets: sets x (BANDS * ROWS)."""
    at = np.cumsum(counts) - counts
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(counts), BANDS * ROWS), np.uint32)
    work = np.empty_like(x)
    for k in range(BANDS * ROWS):
        np.multiply(x, _A[k], out=work)
        work += _B[k]
        out[:, k] = np.minimum.reduceat(work, at)
    return out


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``SET_SCHEMA`` of each (doc_id, text, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, "text"):
            sets, counts = shingle_sets(data, offsets, words)
            full = np.flatnonzero(counts)
            n = len(counts)
            d1, d2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
            sketch: list[bytes | None] = [None] * n
            bands = np.zeros((0, BANDS), np.uint64)
            if len(full):
                at = np.cumsum(counts[full]) - counts[full]
                d1[full] = np.add.reduceat(tc.mix(sets), at)
                d2[full] = np.add.reduceat(tc.mix(sets ^ np.uint64(0x5851F42D4C957F2D)), at)
                low = minima(sets, counts[full])
                bytes_ = ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
                for k, row in zip(full.tolist(), bytes_):
                    sketch[k] = row.tobytes()
                groups = low.reshape(len(full), BANDS, ROWS).astype(np.uint64)
                bands = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(full), BANDS)).copy()
                for r in range(ROWS):
                    bands = tc.mix(bands ^ groups[:, :, r]) * np.uint64(0xD6E8FEB86659FD93)
            cuts = np.concatenate([[0], np.cumsum((counts > 0) * BANDS)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column(rows.schema.get_field_index("doc_id")), rows.column(rows.schema.get_field_index("digest")), pa.array(counts), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(sketch, pa.binary()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(bands.reshape(-1).view(np.int64)))],
                names=["doc_id", "digest", "n_shingles", "d1", "d2", "sketch", "bands"],
            )

    return map_arrow(docs, run, SET_SCHEMA)


def agreement(percent: int) -> int:
    """Least number of equal sketch bytes of a pair that is verified: the expected number at the threshold less seven deviations."""
    k, p = BANDS * ROWS, percent / 100
    return int(k * p - 7 * (k * p * (1 - p)) ** 0.5)


def beside(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Pairs (a, b, hub, size) with the columns x of a ``table`` (node, x) of their members and hubs as ``ta`` and ``tb`` (a is the member, b the hub).

    The member's value travels once; the hub's as often as ``size`` (members of its bucket) has shares.
    """
    salted = pairs.select(F.when(F.col("hub") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("m"), "hub", F.ceil(F.col("size") / HUB_SHARE).cast("int").alias("shares"))
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("m"), F.col("shares")).cast("int"))
    value = next(c for c in table.columns if c != "node")
    hubs = salted.select("hub", "salt").distinct().join(table.select(F.col("node").alias("hub"), F.col(value).alias("tb")), "hub")
    members = salted.join(table.select(F.col("node").alias("m"), F.col(value).alias("ta")), "m")
    return members.join(hubs, ["hub", "salt"]).select(F.col("m").alias("a"), F.col("hub").alias("b"), "ta", "tb")


def near_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b, hub, size) those whose sizes and sketches allow a link: a, b with a < b, hub, size."""
    both = beside(pairs, nodes.select("node", F.struct("n_shingles", "sketch").alias("x")))
    both = both.where(100 * F.least("ta.n_shingles", "tb.n_shingles") >= percent * F.greatest("ta.n_shingles", "tb.n_shingles")).select("a", "b", "ta.sketch", "tb.sketch")
    least = agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sa, sb = _sketches(batch.column(2)), _sketches(batch.column(3))
                keep = pa.array((sa == sb).sum(1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    near = map_arrow(both.toDF("a", "b", "sa", "sb"), run, "a long, b long")
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("b").alias("hub"))


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


def verified(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (a, b, hub, size) whose full sets are linked: a, b. ``texts``: node, text."""
    both = beside(pairs, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(tc.utf8_column(batch.column(2))[1]) + np.diff(tc.utf8_column(batch.column(3))[1])
            for i, j in tc.blocks(np.concatenate([[0], np.cumsum(sizes)]), 2 * tc.BLOCK_BYTES):
                rows = batch.slice(i, j - i)
                (sa, ca), (sb, cb) = (shingle_sets(*tc.utf8_column(rows.column(k)), words) for k in (2, 3))
                pair = np.concatenate([np.repeat(np.arange(j - i), ca), np.repeat(np.arange(j - i), cb)])
                x = np.concatenate([sa, sb])
                order = np.lexsort((x, pair))
                x, pair = x[order], pair[order]
                same = (x[1:] == x[:-1]) & (pair[1:] == pair[:-1])
                shared = np.bincount(pair[1:][same], minlength=j - i)
                keep = pa.array(100 * shared >= percent * (ca + cb - shared))
                yield pa.RecordBatch.from_arrays([rows.column(0).filter(keep), rows.column(1).filter(keep)], names=["a", "b"])

    return map_arrow(both, run, "a long, b long")


def cross_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a bucket and whose sizes and sketches allow a link.

    ``members``: bucket, node, n_shingles, sketch, component, size (the bucket's). Buckets of more than ``BLOCK``
    members are cut into blocks by a hash of the node; a task sees two blocks at most.
    """
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.lit(1)).cast("int")
    cut = members.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))
    # Rows as dealt: a member of a bucket of k blocks goes to k tasks' groups.
    total = cut.agg(F.sum("blocks").alias("n")).first()["n"] or 0
    parts = max(1, total // 5_000)
    # Small buckets share a task; each pair of blocks of a large one goes its own way.
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("bucket", "low", "high"), F.lit(parts)))
    least = agreement(percent)

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        bucket, low, high, mine = (t.column(c).to_numpy() for c in ("bucket", "low", "high", "mine"))
        node, size, comp = (t.column(c).to_numpy() for c in ("node", "n_shingles", "component"))
        sketch = _sketches(t.column("sketch").combine_chunks())
        order = np.lexsort((node, high, low, bucket))
        key = np.stack([bucket[order], low[order], high[order]])
        edges = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0), [True]]))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i, j in zip(edges, edges[1:]):
            rows = order[i:j]
            if j - i < 2 or len(np.unique(comp[rows])) < 2:
                continue
            for k in range(len(rows) - 1):
                a, rest = rows[k], rows[k + 1 :]
                ok = (comp[rest] != comp[a]) & (100 * np.minimum(size[rest], size[a]) >= percent * np.maximum(size[rest], size[a]))
                if low[a] != high[a]:
                    ok &= mine[rest] != mine[a]
                rest = rest[ok]
                if len(rest):
                    rest = rest[(sketch[rest] == sketch[a]).sum(1) >= least]
                    if len(rest):
                        found.append((np.full(len(rest), node[a]), node[rest]))
        if not found:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        x, y = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        p = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
        return pa.table({"a": p[:, 0], "b": p[:, 1]})

    return dealt.select("part", "bucket", "low", "high", "mine", "node", "n_shingles", "component", "sketch").groupBy("part").applyInArrow(run, "a long, b long").distinct()


def _node(*key: str) -> Column:
    """The name of a set in links: a hash of its digest."""
    return F.xxhash64(*key)


KEY = ("d1", "d2", "n_shingles")


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("digest"))


def _grouped(docs: DataFrame, percent: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest (of the text), n_shingles, component_id of every row."""
    plain = _plain(docs, id_col, text_col)
    sets = save(signatures(plain, words))
    full = sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = save(full.groupBy(*KEY).agg(F.min(F.struct("doc_id", "digest")).alias("first")).select(_node(*KEY).alias("node"), *KEY, "first"))
    own = full.join(classes, [*KEY]).where((F.col("doc_id") == F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest")))
    nodes = save(own.dropDuplicates(["node"]).select("node", F.col("first.doc_id").alias("doc_id"), "digest", "n_shingles", "sketch", "bands"))
    # Buckets that two or more nodes share.
    exploded = nodes.select(F.explode("bands").alias("bucket"), "node")
    shared = exploded.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min_by("node", F.xxhash64("node")).alias("mid"), F.count("*").alias("size")).where("lo < hi")
    members = save(exploded.join(shared, "bucket").select("bucket", "node", "lo", "mid", "hi", "size"))
    sketches = nodes.select("node", "n_shingles", "sketch")
    met = members.select("node", "size", F.explode(F.array("lo", "mid", "hi")).alias("hub")).where("node <> hub")
    # A pair has one hub; of several buckets the largest counts.
    stars = save(met.groupBy(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).agg(F.max("size").alias("size"), F.min("hub").alias("hub")))
    tried = save(near_pairs(stars, sketches, percent).drop("hub").join(stars, ["a", "b"]).select("a", "b", "hub", "size"))
    links = save(verified(tried, _texts(plain, nodes, tried), percent, words))
    label = components(links)
    # Buckets that still hold several components.
    labelled = members.join(label, "node", "left").select("bucket", "node", "size", F.coalesce("component", "node").alias("component"))
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
    open_ = save(labelled.join(mixed, "bucket").join(sketches, "node").select("bucket", "node", "n_shingles", "sketch", "component", "size"))
    more = save(cross_pairs(open_, percent).join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    if not more.isEmpty():
        # The end that stands in more pairs is the hub, and how often it does decides into how many shares its pairs fall.
        ends = more.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
        both = more.join(ends.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(ends.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
        near = both.select("a", "b", F.when(F.col("na") >= F.col("nb"), F.col("a")).otherwise(F.col("b")).alias("hub"), F.greatest("na", "nb").alias("size"))
        found = save(verified(near, _texts(plain, nodes, near), percent, words))
        if not found.isEmpty():
            label = components(links.union(found))
    linked = classes.join(label, "node", "left").select(*KEY, F.coalesce("component", "node").alias("component"), F.col("first.doc_id").alias("doc_id"))
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = save(linked.join(least, "component").select(*KEY, "component_id"))
    joined = sets.select("doc_id", "digest", *KEY).join(named, [*KEY], "left")
    return joined.select("doc_id", "digest", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's set size, component (the least id that links reach), and whether it is the one kept."""
    rows = _grouped(docs, percent, words, id_col, text_col)
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _texts(plain: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The whole texts of the nodes in pairs: node, text."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc_id", "digest"), "node")
    return plain.join(ids, ["doc_id", "digest"]).dropDuplicates(["node"]).select("node", "text")


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which none with a lesser id is a near-duplicate; rows equal in id and text become one, rows with a null id stay."""
    kept = _grouped(docs, percent, words, id_col, text_col).where("doc_id = component_id").select(F.col("doc_id").alias("_kept"), F.col("digest").alias("_digest")).distinct()
    rows = docs.select(F.struct("*").alias("row")).withColumn("id", F.col("row")[id_col].cast("long")).withColumn("digest", F.xxhash64(F.coalesce(F.col("row")[text_col], F.lit(""))))
    own = rows.where("id IS NOT NULL").join(kept, (F.col("id") == F.col("_kept")) & (F.col("digest") == F.col("_digest")), "left_semi").dropDuplicates(["id", "digest"])
    both = own.union(rows.where("id IS NULL"))
    return both.select(*[F.col("row")[c].alias(c) for c in docs.columns])

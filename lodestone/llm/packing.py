"""Best-fit packing of tokenised documents into fixed-length training sequences.

A document is its token ids and a closing id. Only a document longer than a sequence is cut:
into full pieces, the first of which is the rest and so may be shorter. Pieces are dealt at random
(by a hash of their row's place in the saved table) to shards of about ``SHARD_PIECES``, so
no key decides a shard's size, and each shard is packed alone:

1. Full pieces are sequences of their own.
2. Martello-Toth reduction: for the largest free piece, a set of one to three pieces that
   dominates every other set containing it is fixed as a sequence for good, and the instance shrinks.
3. What remains is packed best fit, in decreasing order.

A shard leaves at most about one sequence partly filled, so shards cost about one sequence in
some thousands; each needs a few hundred kilobytes, whatever the corpus.

Nulls and empty texts are documents of the closing id only; repeated rows are packed as
often as they appear; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textcore as tc
from lodestone.llm.bpe_core import encoder
from lodestone.llm.runtime import id_and_text, map_arrow, save, text_blocks

CAPACITY = 2048
SHARD_PIECES = 8192
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long"


def cut(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents of ``lengths`` ids (1 or more): each piece's document, number, start and length."""
    count = -(-lengths // capacity)
    doc = np.repeat(np.arange(len(lengths)), count)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    head = lengths - (count - 1) * capacity
    start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, head[doc], capacity)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenise documents and cut the long ones: a row a piece, with its ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for rows, data, offsets in text_blocks(batches, "text"):
            ids, counts = enc.encode_block(data, offsets)
            at = np.cumsum(counts + 1)
            flat = np.full(int(at[-1]) if len(at) else 0, end_id, np.uint32)
            keep = np.ones(len(flat), bool)
            keep[at - 1] = False
            flat[keep] = ids
            doc, piece, start, length = cut(counts + 1, capacity)
            begin = (at - counts - 1)[doc] + start
            view = memoryview(flat.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist())]
            out = [rows.column(rows.schema.get_field_index("doc_id")).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cuts = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat[tc.ragged(begin, length)].astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names=names)

    return map_arrow(id_and_text(docs, id_col, text_col), run, PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))


class _Free:
    """The sizes that still have free pieces, as the bits of one integer."""

    def __init__(self, sizes: np.ndarray, capacity: int) -> None:
        self.have: list[list[int]] = [[] for _ in range(capacity + 1)]
        for k, s in enumerate(sizes.tolist()):
            self.have[s].append(k)
        self.bits = sum(1 << s for s, x in enumerate(self.have) if x)

    def most(self, limit: int) -> int:
        """The largest free size up to ``limit``; 0 if none."""
        return (self.bits & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 and self.bits & ((1 << (limit + 1)) - 1) else 0

    def least(self) -> int:
        return (self.bits & -self.bits).bit_length() - 1 if self.bits else 0

    def take(self, size: int) -> int:
        x = self.have[size]
        k = x.pop()
        if not x:
            self.bits &= ~(1 << size)
        return k

    def give(self, size: int, k: int) -> None:
        self.have[size].append(k)
        self.bits |= 1 << size

    def smallest_sum(self, n: int) -> int | None:
        """Sum of the ``n`` smallest free sizes."""
        total, bits = 0, self.bits
        while n and bits:
            s = (bits & -bits).bit_length() - 1
            m = min(n, len(self.have[s]))
            total, n, bits = total + m * s, n - m, bits & (bits - 1)
        return None if n else total


def _best_pair(free: _Free, room: int) -> tuple[int, int] | None:
    """Two free sizes, larger first, with the largest sum of at most ``room``."""
    best, pair, a = 0, None, free.most(room)
    while a and 2 * a > best:
        first = free.take(a)
        b = free.most(min(a, room - a))
        free.give(a, first)
        if b and a + b > best:
            best, pair = a + b, (a, b)
            if best == room:
                break
        a = free.most(a - 1)
    return pair


def dominating_set(free: _Free, size: int, capacity: int) -> tuple[int, ...] | None:
    """Sizes that, put with a piece of ``size`` (taken out of ``free``), dominate all other such sets; None if not known."""
    room = capacity - size
    if not free.bits or free.least() > room:
        return ()
    partner = free.most(room)
    if partner == room:
        return (partner,)
    two = free.smallest_sum(2)
    if two is None or two > room:
        return (partner,)
    three = free.smallest_sum(3)
    if three is None or three > room:
        pair = _best_pair(free, room)
        if pair is None or partner >= sum(pair):
            return (partner,)
        if partner == pair[0]:
            # Both smaller neighbours of the pair's second piece can't go in together.
            a, b = free.take(pair[0]), free.take(pair[1])
            below = free.most(room)
            bigger = [s for s in (free.most(k) for k in (pair[0], below)) if s > pair[1]]
            free.give(pair[1], b)
            free.give(pair[0], a)
            if len(bigger) < 2:
                return pair
    return None


def reduce_and_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each piece (sizes 1 to ``capacity``): dominance reduction, then best fit."""
    bins, used = np.full(len(sizes), -1, np.int64), 0
    free = _Free(sizes, capacity)
    rest: list[tuple[int, int]] = []
    while free.bits:
        size = free.most(capacity)
        k = free.take(size)
        chosen = dominating_set(free, size, capacity)
        if chosen is None:
            rest.append((size, k))
            continue
        bins[k] = used
        for s in chosen:
            bins[free.take(s)] = used
        used += 1
    # Best fit, decreasing: the fullest open bin that has room, found by the bits of free room.
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bits = 0
    for size, k in rest:  # already in decreasing order
        fits = bits >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                bits &= ~(1 << room)
        else:
            room, b = capacity, used
            used += 1
        bins[k] = b
        if room > size:
            open_bins[room - size].append(b)
            bits |= 1 << (room - size)
    return bins


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Give each piece (``PIECE_SCHEMA``) a sequence and a place in it."""
    saved = save(cut_pieces)
    shards = max(1, -(-saved.count() // shard_pieces))
    dealt = saved.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        sizes = t.column("length").to_numpy()
        bins = reduce_and_fit(sizes, capacity)
        order = np.argsort(bins, kind="stable")
        running = np.cumsum(sizes[order])
        firsts = np.flatnonzero(np.diff(bins[order], prepend=-1))
        base = np.repeat(running[firsts] - sizes[order][firsts], np.diff(np.append(firsts, len(order))))
        offset = np.empty(len(order), np.int64)
        offset[order] = running - sizes[order] - base
        shard = t.column("shard").to_numpy()
        return t.drop(["shard"]).append_column("sequence_id", pa.array(shard * (1 << 32) + bins)).append_column("offset", pa.array(offset))

    return dealt.groupBy("shard").applyInArrow(run, PLACED_SCHEMA)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack: a row a piece with its sequence and place (``PLACED_SCHEMA``)."""
    return pack(pieces(docs, tokenizer, capacity, end_id, id_col, text_col), capacity)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the documents' spans in them.

    ``docs`` must have distinct ids here; ids shuffle once, by sequence.
    """
    own = pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids=True).select("doc_id", "piece", "ids")
    parts = own.join(placed, ["doc_id", "piece"]).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "piece", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("spans"))

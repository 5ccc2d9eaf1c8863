"""Byte-level BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last ``WINDOW`` bytes cuts texts at places that their content alone
decides, so a passage gives the same chunks wherever it stands. Each chunk is named by a hash
of its bytes; a chunk met before is not encoded again. A chunk's own encoding can differ from
its encoding inside a text only near its two ends: a chunk therefore keeps the ids of its
core, from its first to its last *safe* place (a blank between a non-white ASCII character
and a letter, where a word starts whatever surrounds it), and the seam between two cores is
encoded anew from the text. Since words never reach over a safe place, core and seam ids
agree with those of the whole text exactly; a chunk with fewer than two safe places is all seam.

The table of chunks belongs to a worker process and holds at most ``CHUNK_LIMIT`` chunks; then
it starts anew. Chunks are thus shared by the documents a worker meets, and no
chunk, id or text is shuffled. (A table for the whole cluster would need a shuffle of all
ids, which costs more than the encoding it saves.)

A null text is an empty one; repeated rows give equal rows; texts that hold the special
token's string, or unassigned code points, are encoded by the library itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm import textcore as tc
from lodestone.llm.bpe_core import ByteBPE, encoder, word_starts
from lodestone.llm.runtime import id_and_text, map_arrow, text_blocks

WINDOW = 16
#: A window is a cut where these top bits of its hash are 0: a chunk has about 512 bytes.
CUT_BITS = 9
CHUNK_LIMIT = 50_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chunks long, n_reused long"

_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_ASCII_SOLID = np.zeros(256, bool)
_ASCII_SOLID[33:127] = True


def chunk_starts(data: np.ndarray, prefix: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """First bytes of the chunks; every text starts one, and no window reaches over a text's start."""
    n = len(data)
    if n <= WINDOW:
        return text_starts
    _, down = tc.POWERS.get(n + 1)
    h = tc.mix((prefix[WINDOW:] - prefix[:-WINDOW]) * down[: n + 1 - WINDOW])
    at = np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + WINDOW
    at = at[at < n]
    own = text_starts[np.searchsorted(text_starts, at, "right") - 1]
    return np.union1d(at[(at - own >= WINDOW) & ((data[at] & 0xC0) != 0x80)], text_starts)


def safe_places(data: np.ndarray) -> np.ndarray:
    """Blanks where a word starts whatever stands around."""
    if len(data) < 3:
        return np.zeros(0, np.int64)
    return np.flatnonzero((data[1:-1] == 32) & _ASCII_SOLID[data[:-2]] & _ASCII_LETTER[data[2:]]) + 1


def _padded(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    width = int(lengths.max())
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width), lengths


class ChunkEncoder:
    """Encodes blocks of texts with a bounded table of chunks."""

    def __init__(self, words: ByteBPE, limit: int = CHUNK_LIMIT) -> None:
        self.words, self.limit = words, limit
        top = max(words._bytes) + 1
        self.digits, self.n_digits = _padded([f"{i},".encode() for i in range(top)])
        self.token_bytes, self.n_bytes = _padded([words.bytes_of(i) for i in range(top)])
        self.table: dict[int, tuple[int, bytes, bytes]] = {}

    def _segments(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, bytes, bytes]]:
        """Of segments that begin and end at safe places or texts' ends: number of ids, ids in decimal with a comma after each, decoded bytes."""
        lengths = ends - starts
        if not len(starts) or not lengths.sum():
            return [(0, b"", b"")] * len(starts)
        own = data[tc.ragged(starts, lengths)]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        firsts, _ = word_starts(own, offsets[:-1][lengths > 0])
        ids, counts = self.words.ids_of_words(self.words.word_ids(own, firsts))
        at = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(firsts, offsets)]
        decimal, decimal_at = self._joined(ids, self.digits, self.n_digits, at)
        decoded, decoded_at = self._joined(ids, self.token_bytes, self.n_bytes, at)
        sizes = np.diff(at).tolist()
        return [(sizes[k], decimal[decimal_at[k] : decimal_at[k + 1]], decoded[decoded_at[k] : decoded_at[k + 1]]) for k in range(len(sizes))]

    @staticmethod
    def _joined(ids: np.ndarray, strings: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[bytes, list[int]]:
        """The strings of all ids in a row, and the places that the counts of ids ``at`` become."""
        n = lengths[ids]
        ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        width = strings.shape[1]
        if width > 8:  # few ids have long strings
            starts = ids.astype(np.int64) * width
            return strings.reshape(-1)[tc.ragged(starts, n)].tobytes(), ends[at].tolist()
        return strings[ids][np.arange(width) < n[:, None]].tobytes(), ends[at].tolist()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, bytes, bytes, int, int]]:
        """Of each text: number of ids, ids in decimal, decoded bytes, chunks, chunks that were known."""
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        if not len(data):
            return [(0, b"", b"", 0, 0)] * n
        prefix = tc.rolling_prefix(data)
        starts = chunk_starts(data, prefix, offsets[:-1][sizes > 0])
        ends = np.append(starts[1:], len(data))
        keys = tc.span_hash(data, starts, ends)
        # The core of each chunk: from its first to its last safe place that lies inside with both neighbours.
        safe = safe_places(data)
        lo, hi = np.searchsorted(safe, starts + 1), np.searchsorted(safe, ends - 1) - 1
        whole = hi > lo
        core_a, core_b = starts.copy(), starts.copy()
        core_a[whole], core_b[whole] = safe[lo[whole]], safe[hi[whole]]
        if len(self.table) > self.limit:
            self.table.clear()
        table = self.table
        named = keys.tolist()
        known = [k in table for k in named]
        fresh: dict[int, int] = {}
        for i, (k, seen) in enumerate(zip(named, known)):
            if not seen and k not in fresh:
                fresh[k] = i
        new = np.fromiter(fresh.values(), np.int64, len(fresh))
        # Seams: from a core's end (or the text's start) to the next core's start (or the text's end).
        doc = np.searchsorted(offsets, starts, "right") - 1
        cores = np.flatnonzero(whole)
        seam_a = np.concatenate([offsets[:-1], core_b[cores]])
        seam_doc = np.concatenate([np.arange(n), doc[cores]])
        order = np.lexsort((seam_a, seam_doc))
        seam_a, seam_doc = seam_a[order], seam_doc[order]
        next_core = np.append(core_a[cores], len(data))
        k = np.searchsorted(core_a[cores], seam_a) if len(cores) else np.zeros(len(seam_a), np.int64)
        seam_b = np.minimum(next_core[k], offsets[1:][seam_doc])
        a, b = np.concatenate([core_a[new], seam_a]), np.concatenate([core_b[new], seam_b])
        done = self._segments(data, a, b)
        table.update(zip(fresh, done))
        seams = iter(done[len(new) :])
        out, c, m = [], 0, len(starts)
        whole, doc = whole.tolist(), doc.tolist()
        for d in range(n):
            parts, chunks, reused = [next(seams)], 0, 0
            while c < m and doc[c] == d:
                chunks += 1
                if whole[c]:
                    parts.append(table[named[c]])
                    parts.append(next(seams))
                    reused += fresh.get(named[c]) != c
                c += 1
            out.append((sum(p[0] for p in parts), b"".join([p[1] for p in parts])[:-1], b"".join([p[2] for p in parts]), chunks, reused))
        _, odd = word_starts(data, offsets[:-1][sizes > 0]) if data.max() >= 0x80 else (None, np.zeros(0, np.int64))
        raw = None
        for r in self.words.odd_texts(data, offsets, odd).tolist():
            raw = raw or data.tobytes()
            ids = self.words.library.encode(raw[offsets[r] : offsets[r + 1]].decode(), add_special_tokens=False).ids
            out[r] = (len(ids), ",".join(map(str, ids)).encode(), b"".join(map(self.words.bytes_of, ids)), 0, 0)
        return out


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    """The encoder of this worker process for a file."""
    return ChunkEncoder(ByteBPE(path))


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode whole texts; digests of the ids and of the decoded text, and how many chunks were reused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = chunk_encoder(tokenizer)
        for rows, data, offsets in text_blocks(batches, "text"):
            got = enc.encode(data, offsets)
            sha = [(hashlib.sha256(x[1]).hexdigest(), hashlib.sha256(x[2].decode("utf-8", "replace").encode()).hexdigest()) for x in got]
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), pa.array([x[0] for x in got], pa.int64()), pa.array([x[0] for x in sha]), pa.array([x[1] for x in sha]), pa.array([x[3] for x in got], pa.int64()), pa.array([x[4] for x in got], pa.int64())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chunks", "n_reused"])

    return map_arrow(id_and_text(docs, id_col, text_col), run, SCHEMA)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of each text: doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = chunk_encoder(tokenizer)
        for rows, data, offsets in text_blocks(batches, "text"):
            ids = [list(map(int, x[1].split(b","))) if x[0] else [] for x in enc.encode(data, offsets)]
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_arrow(id_and_text(docs, id_col, text_col), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """The texts of encoded documents: doc_id, text. Ids that the vocabulary lacks give nothing; a null list gives a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            texts = [None if x is None else b"".join(map(enc.bytes_of, x)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")

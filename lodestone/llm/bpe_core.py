"""A byte-level BPE encoder that works on whole blocks of text.

The words that the pre-tokenizer cuts are found for a block at once in numpy, hashed, and
looked up in a bounded table of words that were encoded before; only a new word goes to the
library. The result equals the library's: a word is encoded alone in byte-level BPE, and
texts with anything unusual (the special token's string, unassigned code points) are handed
to the library whole.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

from lodestone.llm import textcore as tc

#: Entries after which the table of words starts anew.
WORD_LIMIT_BITS = 20


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def word_starts(data: np.ndarray, text_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a word of the byte-level pre-tokenizer starts, and unassigned characters' places.

    ``text_starts``: first bytes of the (non-empty) texts that lie one after another in ``data``.
    """
    places, cls = tc.char_classes(data)
    n = len(cls)
    byte = data if places is None else data[places]
    first = np.zeros(n, bool)
    first[text_starts if places is None else np.searchsorted(places, text_starts)] = True
    odd = np.flatnonzero(cls == tc.UNASSIGNED)
    white = cls == tc.SPACE
    blank = byte == 32
    prev_white = np.empty(n, bool)
    prev_white[0], prev_white[1:] = False, white[:-1]
    prev_white &= ~first
    start = np.empty(n, bool)
    start[0], start[1:] = True, cls[1:] != cls[:-1]
    start |= first
    # A single blank before a word belongs to it.
    prev_blank = np.empty(n, bool)
    prev_blank[0], prev_blank[1:] = False, blank[:-1]
    prev_blank &= ~first
    start &= ~(prev_blank & ~white)
    # The last of several white characters before a word stands apart from the others.
    last_white = np.zeros(n, bool)
    last_white[:-1] = white[:-1] & ~white[1:] & ~first[1:]
    start |= last_white & prev_white
    # Contractions: 's 't 'm 'd 're 've 'll where a word would start.
    quotes = np.flatnonzero((byte == 39) & start)
    if len(quotes):
        pad = np.concatenate([byte, np.zeros(3, np.uint8)])
        ends = np.concatenate([first, np.ones(3, bool)])
        a, b = pad[quotes + 1], pad[quotes + 2]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & ~ends[quotes + 1]
        two = (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))) & ~ends[quotes + 1] & ~ends[quotes + 2]
        for at, step in ((quotes[one], 2), (quotes[two & ~one], 3)):
            start[at + 1] = False
            stop = at + step
            start[stop[stop < n]] = True
            after = stop[stop < n]
            fix = after[prev_blank[after] & ~white[after]]
            start[fix] = True
    at = np.flatnonzero(start)
    if places is not None:
        at, odd = places[at], places[odd]
    return at, odd


class ByteBPE:
    """Encoder for one tokenizer file; keeps the words that it has seen, up to a bound."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError(f"{path}: not a plain byte-level BPE")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        alphabet = byte_alphabet()
        vocab = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if all(c in alphabet for c in t)}
        merged = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError(f"{path}: ids don't follow the merges")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_bytes = [s.encode() for s in self.special]
        self._bytes = {i: t for t, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=vocab, special_tokens={})
        self._piece = core._core_bpe.encode_single_piece
        self.words = tc.HashIndex(WORD_LIMIT_BITS + 1)
        self.forget()

    def forget(self) -> None:
        self.words.clear()
        self._flat: np.ndarray = np.zeros(1 << 16, np.int32)
        self._used = 0
        self._off: np.ndarray = np.zeros(1 << 14, np.int64)
        self._len: np.ndarray = np.zeros(1 << 14, np.int64)

    def bytes_of(self, token: int) -> bytes:
        return self._bytes.get(token, b"")

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        ids = [self._piece(p) for p in pieces]
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((t for x in ids for t in x), np.int32, int(lens.sum()))
        n = self.words.n
        self.words.add(keys)
        while len(self._off) < n + len(ids):
            self._off, self._len = np.concatenate([self._off, self._off]), np.concatenate([self._len, self._len])
        while len(self._flat) < self._used + len(flat):
            self._flat = np.concatenate([self._flat, self._flat])
        self._len[n : n + len(ids)] = lens
        self._off[n : n + len(ids)] = self._used + np.cumsum(lens) - lens
        self._flat[self._used : self._used + len(flat)] = flat
        self._used += len(flat)

    def ids_of_words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of the table, one after another, and the number of each word's ids."""
        lens = self._len[words]
        return self._flat[tc.ragged(self._off[words], lens)], lens

    def word_ids(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Numbers in the table of the words that start at ``starts`` and lie gapless in ``data``."""
        ends = np.append(starts[1:], len(data))
        h = tc.span_hash(data, starts, ends)
        if self.words.n + len(h) > self.words.limit and self.words.n > self.words.limit // 2:
            self.forget()
        found = self.words.find(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            keys, at = np.unique(h[new], return_index=True)
            at = new[at]
            raw = data.tobytes()
            self._learn(keys, [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            found[new] = self.words.find(h[new])
        return found

    def odd_texts(self, data: np.ndarray, offsets: np.ndarray, odd: np.ndarray) -> np.ndarray:
        """Numbers of the texts that the library itself must encode."""
        places = [odd]
        raw = data.tobytes()
        for s in self._special_bytes:
            k = raw.find(s)
            while k >= 0:
                places.append(np.array([k]))
                k = raw.find(s, k + 1)
        at = np.concatenate(places)
        return np.unique(np.searchsorted(offsets, at, "right") - 1) if len(at) else at

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block, one after another, and the number of each text's ids."""
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        starts, odd = word_starts(data, offsets[:-1][sizes > 0])
        words = self.word_ids(data, starts)
        ids, lens = self.ids_of_words(words)
        bounds = np.searchsorted(starts, offsets)
        total = np.concatenate([[0], np.cumsum(lens)])
        at = total[bounds]
        rare = self.odd_texts(data, offsets, odd)
        if len(rare):
            parts = np.split(ids, at[1:-1])
            raw = data.tobytes()
            for r in rare.tolist():
                parts[r] = np.array(self.library.encode(raw[offsets[r] : offsets[r + 1]].decode(), add_special_tokens=False).ids, np.int32)
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, n)
        return ids, np.diff(at)


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBPE:
    """The encoder of this worker process for a file."""
    return ByteBPE(path)

"""Token counts by a finite-state transducer compiled from a BPE vocabulary with word ends.

**Transducer.** Reading a word byte by byte, a state knows every place where the last token
of a longer word could begin: the part of that token read so far, which merges with the
token before the place would forbid it, and how many tokens the place has before it,
counted from the present. Two tokens stand next to each other in BPE exactly if no
merge over their border comes before the merges that close either side, so each byte has
exactly one last token, hence one next state, and the change of the token count is that
transition's output. States are determinised when first met and interned; equal futures of
different pasts meet in one state. A second output gives the count if the byte ends the word.
The automaton starts anew between blocks once it holds ``STATE_LIMIT`` states; should one block alone
need ``HARD_LIMIT`` states, or an output not fit its field, the library counts that block's texts. So it is bounded and always exact.

**Parallel prefix scan.** A block's word bytes are cut into chunks of ``CHUNK`` bytes that advance
together, one table lookup a step for all. A chunk's map takes the state before it to the state after it
and the sum of its outputs. Any word start resets the state, so after its first word start a chunk's map is constant.
A chunk without one lies inside a long word; its map is kept for the states that can come in, at first
the one that a chunk's length of the word itself leads to (the automaton forgets its past within
a token or two). Maps are composed by pointer doubling: after k rounds a chunk knows the map of the 2**k
chunks up to it. Where the true state that comes in has no entry yet, it is added and the scan is
repeated, until all agree.

The library's own steps before BPE (NFC, lower case, word pattern) are done on whole blocks.
A text with an added token's string or an unassigned code point goes to the library whole.
A null text is an empty one; very long texts and words cost no more a byte than short ones; repeated rows and rows of one id are counted
each by itself; other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from lodestone.llm import textcore as tc
from lodestone.llm.bpe_core import byte_alphabet
from lodestone.llm.runtime import id_and_text, map_arrow, text_blocks

TOKEN_LIMIT = 2048
STATE_LIMIT = 150_000
HARD_LIMIT = 1_000_000
CHUNK = 128
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

_END = "\uffff"
_NEVER = 1 << 40
#: An entry of the table is a state times FIELD, and an output plus ZERO.
FIELD, ZERO = 1 << 10, 1 << 9
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

Place = tuple[str, frozenset[tuple[str, int]], int]


class Full(Exception):
    """The automaton can't hold what a block needs."""


class Transducer:
    """The lazily compiled automaton: state 0 is a word's start."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        alphabet = byte_alphabet()
        end = len(suffix)

        def own(t: str) -> str:
            body, last = (t[:-end], _END) if t.endswith(suffix) else (t, "")
            return "".join(chr(alphabet[c]) for c in body) + last

        symbols = {own(c) for t in vocab for c in [t] if len(t.removesuffix(suffix)) == 1}
        self.tokens: set[str] = set(symbols)
        rank_of: dict[str, int] = dict.fromkeys(symbols, -1)
        parts: dict[str, tuple[str, str]] = {}
        follow: dict[str, list[tuple[str, int]]] = {}
        for rank, (a, b) in enumerate(merges):
            a, b = own(a), own(b)
            c = a + b
            follow.setdefault(a, []).append((b, rank))
            if c not in rank_of:
                if max(rank_of[a], rank_of[b]) >= rank:
                    raise ValueError("a merge comes before the merges of its parts")
                rank_of[c], parts[c] = rank, (a, b)
                self.tokens.add(c)
        self._rank, self._parts, self._follow = rank_of, parts, follow
        self.prefixes = {t[:k] for t in self.tokens for k in range(len(t) + 1)}
        # Left parts of each token, with the ranks between which they are the left edge.
        self._left: dict[str, dict[str, tuple[int, int]]] = {}
        # Which left parts matter below a prefix.
        self._under: dict[str, set[str]] = {}
        for t in self.tokens:
            spine, top, until = {}, t, _NEVER
            while True:
                spine[top] = (rank_of[top], until)
                if top not in parts:
                    break
                until, top = rank_of[top], parts[top][0]
            self._left[t] = spine
            for k in range(1, len(t) + 1):
                self._under.setdefault(t[:k], set()).update(spine)
        self._forbid: dict[str, frozenset[tuple[str, int]]] = {}
        self._narrow: dict[tuple[frozenset, str], frozenset] = {}
        self.restart()

    def restart(self) -> None:
        start: tuple[Place, ...] = (("", frozenset(), 0),)
        self._number = {start: 0}
        self._states = [start]
        self.column = np.full(256, -1, np.int64)
        self.width = 0
        self._rows = 0
        self._grow(1 << 12, 64)

    def _grow(self, rows: int, width: int) -> None:
        """The table: for each state, and each byte inside and at the end of a word, ``FIELD`` * next state + output + ``ZERO``; -1: not known yet."""
        table = np.full((rows, 2 * width), -1, np.int32)
        if self._rows:
            table[: self._rows, : 2 * self._columns] = self.table
        self.table, self._rows, self._columns = table, rows, width

    def columns(self, data: np.ndarray) -> np.ndarray:
        for b in np.flatnonzero(np.bincount(data, minlength=256)[:256]):
            if self.column[b] < 0:
                self.column[b] = self.width
                self.width += 1
        if self.width > self._columns:
            self._grow(self._rows, 256 if self.width > 128 else 128)
        self._bytes = {int(c): b for b, c in enumerate(self.column.tolist()) if c >= 0}
        return self.column[data] * 2

    def _forbidden_after(self, token: str) -> frozenset[tuple[str, int]]:
        """Left parts (with a merge's rank) that would have merged with ``token``'s right edge."""
        got = self._forbid.get(token)
        if got is None:
            found, top, until = [], token, _NEVER
            while True:
                born = self._rank[top]
                found += [(y, m) for y, m in self._follow.get(top, ()) if born < m < until]
                if top not in self._parts:
                    break
                until, top = born, self._parts[top][1]
            got = self._forbid[token] = frozenset(found)
        return got

    def _narrowed(self, forbidden: frozenset, part: str) -> frozenset:
        if not forbidden:
            return forbidden
        got = self._narrow.get((forbidden, part))
        if got is None:
            under = self._under[part]
            got = self._narrow[forbidden, part] = frozenset(x for x in forbidden if x[0] in under)
        return got

    def _stands(self, forbidden: frozenset, token: str) -> bool:
        left = self._left[token]
        for y, m in forbidden:
            if y in left and left[y][0] < m <= left[y][1]:
                return False
        return True

    def fill(self, state: int, column: int) -> None:
        """Compile the transition of a state by a byte."""
        x = chr(self._bytes[column])
        kept, winner = [], None
        for part, forbidden, count in self._states[state]:
            part += x
            if part in self.prefixes:
                forbidden = self._narrowed(forbidden, part)
                kept.append((part, forbidden, count))
                if winner is None and part in self.tokens and self._stands(forbidden, part):
                    winner = (part, count + 1)
        token, change = winner
        places = (*((p, f, c - change) for p, f, c in kept), ("", self._forbidden_after(token), 0))
        number = self._number.get(places)
        if number is None:
            if len(self._states) >= HARD_LIMIT:
                raise Full
            number = self._number[places] = len(self._states)
            self._states.append(places)
            if number >= self._rows:
                self._grow(2 * self._rows, self._columns)
        if not -ZERO <= change < ZERO:
            raise Full
        self.table[state, 2 * column] = FIELD * number + change + ZERO

    def fill_last(self, state: int, column: int) -> None:
        """Compile the output of a state by a byte that ends the word."""
        x = chr(self._bytes[column]) + _END
        for part, forbidden, count in self._states[state]:
            token = part + x
            if token in self.tokens and self._stands(self._narrowed(forbidden, token), token):
                if not -ZERO <= count + 1 < ZERO:
                    raise Full
                self.table[state, 2 * column + 1] = count + 1 + ZERO
                return
        raise ValueError("no token ends here")

    def advance(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The table's entries for one step of many runs (``column``: twice the byte's, one more at a word's end)."""
        at = state * (2 * self._columns)
        at += column
        got = self.table.ravel()[at]
        if got.min() < 0:
            width = 2 * self._columns
            for k in np.unique(at[got < 0]).tolist():
                (self.fill_last if k & 1 else self.fill)(k // width, k % width >> 1)
            got = self.table.ravel()[at]
        return got

    def run(self, data: np.ndarray, first: np.ndarray, last: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """The output at each byte of words that lie gapless in ``data``; first, last: the words' ends."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        if len(self._states) > STATE_LIMIT:
            self.restart()
        lanes = -(-n // chunk)
        pad = lanes * chunk - n
        columns = np.concatenate([self.columns(data) + last, np.zeros(pad, np.int64)]).reshape(lanes, chunk)
        firsts = np.concatenate([first, np.zeros(pad, bool)]).reshape(lanes, chunk)
        # From each chunk's first word start on: the same whatever came before. Lanes in the order of their starts.
        head = np.where(firsts.any(1), firsts.argmax(1), chunk)
        head[-1] = min(head[-1], chunk - pad)
        order = np.argsort(head, kind="stable")
        awake = np.searchsorted(head[order], np.arange(chunk), "right").tolist()
        mine = columns[order].T.copy()
        got = np.full((chunk, lanes), ZERO, np.int32)
        run_state = np.zeros(lanes, np.int64)
        ends = chunk - pad  # steps of the last chunk
        short = int(np.flatnonzero(order == lanes - 1)[0])
        for k in range(chunk):
            m = awake[k]
            if k >= ends and m:  # the last lane rests; a column of state 0 that is known, or found harmlessly
                mine[k, short], run_state[short] = mine[0, 0] & ~1, 0
            if m:
                step = self.advance(run_state[:m], mine[k, :m])
                got[k, :m] = step
                run_state[:m] = step // FIELD
        state, out = np.empty(lanes, np.int64), np.empty((lanes, chunk), np.int16)
        state[order] = run_state
        out[order] = (got % FIELD - ZERO).T
        todo = np.flatnonzero(head > 0)
        if len(todo):
            # The parts before the first word starts: whole chunks (inside long words), and heads of chunks.
            sums = self._scan(columns, head, state, todo, chunk)
            out[todo] *= np.arange(chunk) >= head[todo, None]
            flat = out.reshape(-1)[:n].astype(np.int64)
            flat[todo * chunk] += sums  # a part lies inside one word, so its sum may stand at its first byte
            return flat
        return out.reshape(-1)[:n].astype(np.int64)

    def _through(self, columns: np.ndarray, lane: np.ndarray, steps: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after, and sums of outputs over, the first ``steps`` bytes of lanes."""
        by = np.argsort(-steps, kind="stable")
        s, total = state[by].copy(), np.zeros(len(lane), np.int64)
        left = np.searchsorted(-steps[by], -np.arange(int(steps.max())), "left").tolist()
        for k, m in enumerate(left):
            step = self.advance(s[:m], columns[lane[by[:m]], k])
            total[:m] += step % FIELD - ZERO
            s[:m] = step // FIELD
        back = np.empty_like(by)
        back[by] = np.arange(len(by))
        return s[back], total[back]

    def _scan(self, columns: np.ndarray, head: np.ndarray, state: np.ndarray, todo: np.ndarray, chunk: int) -> np.ndarray:
        """Sums of outputs over the parts before the first word starts of the lanes ``todo``; ``state``: after each lane that has one."""
        inside = head[todo] == chunk  # whole chunks, whose maps are composed
        whole = todo[inside]
        # A chunk after one with a word start has its true state; others begin with a guess.
        first = head[whole - 1] < chunk
        enters = state[whole - 1].copy()
        guess = np.flatnonzero(~first)
        if len(guess):
            enters[guess], _ = self._through(columns, whole[guess] - 1, np.full(len(guess), chunk), np.zeros(len(guess), np.int64))
        lane, came = whole, enters
        leaves, sums = self._through(columns, lane, np.full(len(lane), chunk), came) if len(lane) else (came, came)
        maps = {(x, s): (z, t) for x, s, z, t in zip(lane.tolist(), came.tolist(), leaves.tolist(), sums.tolist())}
        while len(whole):
            # Pointer doubling over the entries: entry e hands on to the next chunk's entry for its last state.
            keys = list(maps)
            number = {k: e for e, k in enumerate(keys)}
            jump = np.array([number.get((x + 1, maps[x, s][0]), -1) for x, s in keys])
            real = np.zeros(len(keys), bool)
            real[[number[x, s] for x, s in zip(whole[first].tolist(), enters[first].tolist())]] = True
            reach = jump.copy()
            while True:
                sources = np.flatnonzero(real & (reach >= 0))
                fresh = np.unique(reach[sources])
                grown = real.copy()
                grown[fresh] = True
                if (grown == real).all() and (reach < 0).all():
                    break
                real, reach = grown, np.where(reach >= 0, reach[reach], -1)
            here = {keys[e][0]: keys[e][1] for e in np.flatnonzero(real).tolist()}
            # The first chunk of each word that no true state has reached yet gets the entry that it needs.
            lost = [x for x in whole.tolist() if x not in here and x - 1 in here]
            if not lost:
                break
            x = np.array(lost)
            s = np.array([maps[y - 1, here[y - 1]][0] for y in lost])
            z, t = self._through(columns, x, np.full(len(x), chunk), s)
            maps.update(((a, b), (c, d)) for a, b, c, d in zip(lost, s.tolist(), z.tolist(), t.tolist()))
        if len(whole):
            state[whole] = [maps[x, here[x]][0] for x in whole.tolist()]
        out = np.zeros(len(todo), np.int64)
        out[inside] = [maps[x, here[x]][1] for x in whole.tolist()]
        part = todo[~inside]
        if len(part):
            _, out[~inside] = self._through(columns, part, head[part], state[part - 1])
        return out


class Counter:
    """Counts tokens of whole blocks of texts for one tokenizer file."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model, steps = spec["model"], spec["pre_tokenizer"].get("pretokenizers", [])
        plain = len(steps) == 2 and steps[0].get("pattern") == {"Regex": _PATTERN} and steps[0].get("invert") and [x["type"] for x in spec["normalizer"].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        if not plain or model["type"] != "BPE" or not model["end_of_word_suffix"]:
            raise ValueError(f"{path}: not a lower-case BPE with word ends")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self._special = [t["content"].encode() for t in spec["added_tokens"]]
        added = {t["content"] for t in spec["added_tokens"]}
        self.automaton = Transducer({t: i for t, i in model["vocab"].items() if t not in added}, [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"])

    def _normal(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """NFC and lower case of each text, as the library has them."""
        if not len(data) or data.max() < 0x80:
            return _LOWER[data], offsets
        raw = data.tobytes()
        parts = []
        for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
            x = raw[a:b]
            # The library lowers character by character, so a final capital sigma isn't special.
            parts.append(x.lower() if x.isascii() else unicodedata.normalize("NFC", x.decode()).replace("Σ", "σ").lower().encode())
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(n, np.int64)
        rare = set()
        raw = data.tobytes()
        for s in self._special:
            k = raw.find(s)
            while k >= 0:
                rare.add(int(np.searchsorted(offsets, k, "right")) - 1)
                k = raw.find(s, k + 1)
        text, at = self._normal(data, offsets)
        sizes = np.diff(at)
        places, cls = tc.char_classes(text)
        if places is None:
            places = np.arange(len(text))
        odd = places[cls == tc.UNASSIGNED]
        if len(odd):
            rare.update((np.searchsorted(at, odd, "right") - 1).tolist())
        begins = np.zeros(len(cls), bool)
        begins[np.searchsorted(places, at[:-1][sizes > 0])] = True
        start = np.empty(len(cls), bool)
        start[0], start[1:] = True, cls[1:] != cls[:-1]
        start |= begins | (cls == tc.NUMBER)
        quotes = np.flatnonzero((text[places] == 39) & start)
        if len(quotes):
            byte = np.concatenate([text[places], np.zeros(3, np.uint8)])
            stop = np.concatenate([begins, np.ones(3, bool)])
            a, b = byte[quotes + 1], byte[quotes + 2]
            one = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & ~stop[quotes + 1]
            two = (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))) & ~stop[quotes + 1] & ~stop[quotes + 2]
            for q, step in ((quotes[one], 2), (quotes[two], 3)):
                start[q + 1] = False
                end = q + step
                start[end[end < len(cls)]] = True
        # Only bytes of words go on.
        char = np.repeat(np.arange(len(cls)), np.diff(np.append(places, len(text))))
        solid = cls != tc.SPACE
        first_byte = np.zeros(len(text), bool)
        first_byte[places] = start
        keep = solid[char]
        word_bytes, first = text[keep], first_byte[keep]
        last = np.append(first[1:], True)
        try:
            steps = self.automaton.run(word_bytes, first, last)
        except Full:
            self.automaton.restart()
            return np.array([self._exact(raw, offsets, r) for r in range(n)], np.int64)
        out = np.concatenate([[0], np.cumsum(steps)])
        kept_before = np.concatenate([[0], np.cumsum(keep)])[at]
        counts = np.diff(out[kept_before])
        for r in rare:
            counts[r] = self._exact(raw, offsets, r)
        return counts

    def _exact(self, raw: bytes, offsets: np.ndarray, r: int) -> int:
        return len(self.library.encode(raw[offsets[r] : offsets[r + 1]].decode(), add_special_tokens=False).ids)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The counter of this worker process for a file."""
    return Counter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = TOKEN_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes and tokens of each whole text, and whether it has more than ``limit`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer)
        for rows, data, offsets in text_blocks(batches, "text"):
            n = tokens.count(data, offsets)
            yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("doc_id")), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(id_and_text(docs, id_col, text_col), run, SCHEMA)

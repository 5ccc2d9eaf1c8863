"""Main text of web pages by a bidirectional LSTM over each page's blocks.

A page is cut into its leaf blocks: runs of text between block-level tags, with character
references decoded and white space folded. Each block is a vector of its tag path (hashed
names, classes, ids and roles of its ancestors), its hashed words, and a few numbers (length, links,
place). A two-way LSTM in numpy reads a page's whole sequence, so that a block is judged by all
others on the page, and labels it main text or not. Scripts, styles, forms' fields, comments in the
source and the head are no blocks at all. A head without ``</head>`` ends at the first text or tag that no head holds;
of an unclosed or self-closed element other than a script or a style only the tag is left out.

The weights (``html_model.npz``, some tens of kilobytes) are trained by :mod:`lodestone.llm.html_train`
on pages that it makes up. Pages go through the network side by side, a step for
each block's place, in groups of bounded numbers of blocks.

Malformed pages cost time linear in their length: tags are read without backtracking, unfinished ones are text, and
paths of deep elements share what they have in common. A page of more than ``GROUP_BLOCKS`` blocks goes through the network in parts.
A null or empty page gives an empty text; repeated rows and rows of one id give equal rows, each by itself; other columns are
not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.runtime import map_arrow

PATH_DIMS, WORD_DIMS, NUMBERS, HIDDEN = 64, 24, 8, 24
DIMS = PATH_DIMS + WORD_DIMS + NUMBERS
SCHEMA = "page_id long, url string, text string, n_chars long, n_blocks int, n_main int"
#: Blocks that go through the network together.
GROUP_BLOCKS = 20_000

_RAW = "noscript|template|textarea|select|svg|title|iframe|object|math|datalist|canvas"
#: What a head holds besides ``_RAW``; any other tag, or text, ends a head that isn't closed.
_HEAD = {*"head base basefont bgsound link meta noframes noscript script style template title".split()}
_TAGS_ONLY = {*_RAW.split("|"), "script", "style"}
_SKIPPED = _TAGS_ONLY | {"head"}
#: A tag, or what a comment or declaration starts with. Every byte is read a bounded number of times: nothing here backtracks, and an unfinished tag is text as far as it was read.
_TOKEN = re.compile(r"""<!--|<!\[CDATA\[|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)(?=[\s/>"'])((?:[^<>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)(>?)""")
# Script and style run to the page's end if unclosed; a head is closed before the body; other raw elements that are unclosed or self-closed are tags only.
_CLOSE = re.compile(rf"</(script|style|head|{_RAW})\s*+>|<(body)\b", re.I)
_INLINE = {*"a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr label input".split()}
_VOID = {*"area base br col embed hr img input link meta param source track wbr".split()}
_CLOSES_P = {*"address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_WORD = re.compile(r"\w+")

class TagPath:
    """The tokens of an element and of all above it, as a hashed vector that is made when a block first asks for it."""

    __slots__ = ("above", "last", "names", "size", "vector")

    def __init__(self, above: TagPath | None, names: tuple[str, ...]) -> None:
        self.above, self.names, self.vector = above, names, None
        self.size: int = len(names) + (above.size if above else 0)
        self.last: str = names[-1] if names else above.last if above else ""

    def hashed(self) -> np.ndarray:
        todo, node = [], self
        while node is not None and node.vector is None:
            todo.append(node)
            node = node.above
        for p in reversed(todo):
            p.vector = np.zeros(PATH_DIMS, np.float32) if p.above is None else p.above.vector.copy()
            for token in p.names:
                b, sign = _bucket(token, PATH_DIMS)
                p.vector[b] += sign
        return self.vector


#: text, path, share of letters in links
Block = tuple[str, TagPath, float]


def _element_names(tag: str, attributes: str) -> tuple[str, ...]:
    """The tokens that an element adds to the path."""
    out = [tag]
    for m in _ATTRIBUTE.finditer(attributes) if "=" in attributes else ():
        value = (m[2] or m[3] or m[4] or "").lower()
        out += [f".{w}" for w in _SPLIT.split(value) if w and not w.isdigit()]
    return tuple(dict.fromkeys(out))


_known_names = lru_cache(maxsize=50_000)(_element_names)


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    return (_known_names if len(attributes) < 200 else _element_names)(tag, attributes)


class _Closers:
    """Where the raw elements of a page are closed: found in one pass, when first asked for."""

    def __init__(self, page: str) -> None:
        self.page, self.found = page, None

    def after(self, tag: str, at: int) -> tuple[int, int] | None:
        """First and last byte of the next closing tag (of ``body``: opening tag) from ``at`` on."""
        if self.found is None:
            self.found = {}
            for m in _CLOSE.finditer(self.page):
                starts, ends = self.found.setdefault((m[1] or m[2]).lower(), ([], []))
                starts.append(m.start())
                ends.append(m.end())
        starts, ends = self.found.get(tag, ((), ()))
        k = bisect_left(starts, at)
        return (starts[k], ends[k]) if k < len(starts) else None


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in their order, in time linear in its length."""
    out: list[Block] = []
    root = TagPath(None, ())
    stack: list[tuple[str, TagPath]] = [("", root)]
    opened: Counter[str] = Counter()
    buffer: list[str] = []
    linked: list[int] = []
    closers = _Closers(page)
    in_link, at, in_head, ended = 0, 0, False, False

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                out.append((text, stack[-1][1], min(1.0, sum(linked) / len(text))))
            buffer.clear()
            linked.clear()

    def add(piece: str) -> None:
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            buffer.append(piece)
            if in_link:
                linked.append(len(piece))

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    m = _TOKEN.search(page)
    while m:
        begin, end, tag = m.start(), m.end(), m[2]
        raw = False
        if tag is None:
            stop = page.find("-->" if m[0] == "<!--" else "]]>" if m[0] == "<![CDATA[" else ">", end) if not (ended and len(m[0]) == 2) else -1
            if stop >= 0:
                end = stop + (1 if len(m[0]) == 2 else 3)
            elif len(m[0]) == 2:  # no tag ends from here on
                ended = True
                m = _TOKEN.search(page, end)
                continue
            else:
                end = len(page)
        elif not m[4]:
            m = _TOKEN.search(page, end)
            continue
        else:
            tag = tag.lower()
            if not m[1] and tag in _SKIPPED:
                close = closers.after(tag, end)
                own = not m[3].endswith("/")
                if tag == "head":
                    body = closers.after("body", end)
                    raw = close is not None and (body is None or close[0] < body[0])
                else:
                    raw = own and (close is not None or tag in ("script", "style"))
                if raw:
                    end = close[1] if close else len(page)
        in_head = in_head and not page[at:begin].strip()
        add(page[at:begin])
        at = end
        m, attributes, closing = _TOKEN.search(page, end), m[3], m[1]
        if tag is None or raw:
            if raw and tag in ("head", "title"):
                flush()
            continue
        if tag in _TAGS_ONLY or tag == "head" or in_head and tag in _HEAD:
            if tag in ("head", "title"):
                flush()
            in_head = not closing if tag == "head" else in_head
            continue
        in_head = False
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag == "br":
                buffer.append(" ")
            continue
        flush()
        in_link = 0
        if closing:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
        elif tag not in _VOID:
            top = stack[-1][0]
            if top == "p" and tag in _CLOSES_P or top == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
                pop()
            above = stack[-1][1]
            stack.append((tag, above if tag in ("html", "body") else TagPath(above, _names(tag, attributes or ""))))
            opened[tag] += 1
    add(page[at:])
    flush()
    return out


def _hash_bucket(token: str, dims: int) -> tuple[int, float]:
    h = zlib.crc32(token.encode())
    return h % dims, 1.0 if h & 0x10000 else -1.0


_known_bucket = lru_cache(maxsize=100_000)(_hash_bucket)


def _bucket(token: str, dims: int) -> tuple[int, float]:
    return (_known_bucket if len(token) < 100 else _hash_bucket)(token, dims)


def vectors(blocks: list[Block], first: int = 0, total: int | None = None) -> np.ndarray:
    """The input vectors of a page's blocks (or of some of its ``total`` blocks, from number ``first`` on)."""
    x = np.zeros((len(blocks), DIMS), np.float32)
    n = total or len(blocks)
    for i, (text, path, links) in enumerate(blocks):
        row = x[i]
        row[:PATH_DIMS] = path.hashed()
        words = _WORD.findall(text.lower())
        for w in words:
            b, sign = _bucket(w, WORD_DIMS)
            row[PATH_DIMS + b] += sign
        if words:
            row[PATH_DIMS : PATH_DIMS + WORD_DIMS] /= len(words) ** 0.5
        size = len(text)
        alone = path.last in ("p", "h1", "h2", "h3")
        row[PATH_DIMS + WORD_DIMS :] = (min(size, 2000) ** 0.5 / 20, links, text[-1] in ".!?:;\"'”»", (first + i) / n, min(1.0, text.count(",") / 10), path.size / 10, alone, size < 40)
    return np.clip(x, -3, 3)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def run_lstm(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Hidden states (steps x pages x HIDDEN) of an LSTM, and its last state; a page's state stands still where its mask is 0."""
    steps, pages, _ = x.shape
    h, c = state or (np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32))
    out = np.empty((steps, pages, HIDDEN), np.float32)
    z = x.reshape(steps * pages, -1) @ w + b
    z = z.reshape(steps, pages, -1)
    for t in range(steps):
        a = z[t] + h @ u
        i, f, o = sigmoid(a[:, : 3 * HIDDEN]).reshape(pages, 3, HIDDEN).transpose(1, 0, 2)
        m = mask[t][:, None]
        c = m * (f * c + i * np.tanh(a[:, 3 * HIDDEN :])) + (1 - m) * c
        h = m * (o * np.tanh(c)) + (1 - m) * h
        out[t] = h
    return out, (h, c)


def main_blocks(pages: list[np.ndarray], weights: dict[str, np.ndarray]) -> list[np.ndarray]:
    """For each page's vectors: which blocks are main text."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j + 1 - i) * len(pages[order[j]]) <= GROUP_BLOCKS:
            j += 1
        group = order[i:j]
        sizes = np.array([len(pages[k]) for k in group])
        steps = int(sizes.max())
        x = np.zeros((steps, len(group), DIMS), np.float32)
        for g, k in enumerate(group):
            x[: sizes[g], g] = pages[k]
        mask = (np.arange(steps)[:, None] < sizes).astype(np.float32)
        fore, _ = run_lstm(x, mask, weights["wf"], weights["uf"], weights["bf"])
        back = run_lstm(x[::-1], mask[::-1], weights["wb"], weights["ub"], weights["bb"])[0][::-1]
        score = fore @ weights["vf"] + back @ weights["vb"] + x @ weights["vx"] + weights["c"]
        for g, k in enumerate(group):
            out[k] = score[: sizes[g], g] > 0
        i = j
    return out


def long_page(blocks: list[Block], weights: dict[str, np.ndarray], part: int = GROUP_BLOCKS // 4) -> np.ndarray:
    """Which blocks of one page of any number of blocks are main text: ``part`` blocks at a time, with the network's state carried on."""
    n = len(blocks)
    score = np.empty(n, np.float32)
    state = None
    for i in range(0, n, part):
        x = vectors(blocks[i : i + part], i, n)[:, None]
        h, state = run_lstm(x, np.ones((len(x), 1), np.float32), weights["wf"], weights["uf"], weights["bf"], state)
        score[i : i + part] = (h @ weights["vf"] + x @ weights["vx"] + weights["c"])[:, 0]
    state = None
    for i in range((n - 1) // part * part, -1, -part):
        x = vectors(blocks[i : i + part], i, n)[::-1, None]
        h, state = run_lstm(x, np.ones((len(x), 1), np.float32), weights["wb"], weights["ub"], weights["bb"], state)
        score[i : i + part] += (h @ weights["vb"])[::-1, 0]
    return score > 0


@lru_cache(maxsize=1)
def load_weights() -> dict[str, np.ndarray]:
    with np.load(Path(__file__).with_name("html_model.npz")) as z:
        return {k: z[k] for k in z.files}


def extract(pages: list[str], weights: dict[str, np.ndarray]) -> list[tuple[str, int, int]]:
    """Main text, blocks and main blocks of each page."""
    cut = [blocks_of(p) for p in pages]
    keep = main_blocks([vectors(b if len(b) <= GROUP_BLOCKS else []) for b in cut], weights)
    keep = [k if len(b) <= GROUP_BLOCKS else long_page(b, weights) for b, k in zip(cut, keep)]
    return [("\n".join(t for (t, _, _), k in zip(b, own.tolist()) if k), len(b), int(own.sum())) for b, own in zip(cut, keep)]


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = 500) -> DataFrame:
    """The main text of each whole page."""
    weights = load_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, group):
                rows = batch.slice(k, group)
                got = extract([x or "" for x in rows.column(2).to_pylist()], weights)
                text = [g[0] for g in got]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_main"])

    return map_arrow(pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")), run, SCHEMA)

"""Language identification by script, word scores and a Viterbi path through each text.

**Learning.** Labelled documents of the training part (crc32 of the id as text, modulo 4, is
not 2) are drawn by a hash of the id, about ``PER_LANGUAGE`` a language: a bounded sample. Executors count
their words' byte n-grams (1 to 4 bytes, with word borders) in ``BUCKETS`` hashed buckets, and their letters by script; only these
counts go to the driver, of a size that texts don't change. They give smoothed log probabilities for each language, and the scripts that it uses.

**Labelling.** A word is a run of letters. Its script narrows the candidates to languages
that use it; each candidate's score is the sum of its n-grams' log probabilities. The
Viterbi path maximises the sum of scores less ``SWITCH_PENALTY`` for each change of language, so
stray words are outvoted while longer foreign passages become spans of their own. Texts
are cut into segments of ``SEGMENT`` words whose best-path matrices are found side by side and
then chained, so a very long text costs no more a word than a short one.

The prediction is the language with the most letters on the path and the score its share of
all letters; letters of words in a script that no language uses count for none, so a text of such words alone
has score 0, whatever language is named. A text that is null or has no letter is ``und`` with score 0. The
filter drops texts below ``MIN_SCORE``. Nothing but the text
enters a prediction; of languages with equally many letters the first by name is named. Any number of languages may be learned. Repeated rows
give equal rows, rows of one id each its own; columns of other names are carried or ignored, never read; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textcore as tc
from lodestone.llm.runtime import map_arrow, text_blocks

PER_LANGUAGE = 1500
BUCKETS = 1 << 16
SWITCH_PENALTY = 12.0
SEGMENT = 64
#: A language uses a script that has at least this share of its letters.
SCRIPT_SHARE = 0.01
FOREIGN = -1000.0
#: Texts stay if their language has at least this share of their letters.
MIN_SCORE = 0.25
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_spans int"
SPANS_SCHEMA = "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"

_SCRIPTS = [
    (0x0370, 0x0400, 1), (0x0400, 0x0530, 2), (0x0530, 0x0590, 3), (0x0590, 0x0600, 4), (0x0600, 0x0780, 5), (0x0900, 0x0980, 6), (0x0980, 0x0A00, 7), (0x0A00, 0x0A80, 8),
    (0x0A80, 0x0B00, 9), (0x0B80, 0x0C00, 10), (0x0C00, 0x0C80, 11), (0x0C80, 0x0D00, 12), (0x0D00, 0x0D80, 13), (0x0E00, 0x0E80, 14), (0x10A0, 0x1100, 15), (0x1100, 0x1200, 16),
    (0x1200, 0x13A0, 17), (0x1F00, 0x2000, 1), (0x3040, 0x3100, 18), (0x3130, 0x3190, 16), (0x3400, 0x4DC0, 19), (0x4E00, 0xA000, 19), (0xAC00, 0xD7B0, 16), (0xF900, 0xFB00, 19), (0xFB50, 0xFE00, 5),
]
N_SCRIPTS = 20


def script_of(points: np.ndarray) -> np.ndarray:
    """The script's number of each letter; 0: Latin and all that no range holds."""
    starts = np.array([a for a, _, _ in _SCRIPTS])
    ends = np.array([b for _, b, _ in _SCRIPTS])
    numbers = np.array([n for _, _, n in _SCRIPTS])
    k = np.searchsorted(starts, points, "right") - 1
    return np.where((k >= 0) & (points < ends[k]), numbers[k], 0)


@dataclass
class Words:
    """The words of a block: first and last bytes, hash, script, letters; and each text's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    script: np.ndarray
    letters: np.ndarray
    bounds: np.ndarray


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of letters, in lower case for ASCII and Latin-1."""
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1 if len(data) else np.zeros(0, np.int64)
    latin = latin[(data[latin] >= 0x80) & (data[latin] <= 0x9E) & (data[latin] != 0x97)]
    low[latin] += 32
    places, cls = tc.char_classes(data)
    if places is None:
        places = np.arange(len(data))
    letter = cls == tc.LETTER
    first = np.zeros(len(cls) + 1, bool)
    full = offsets[:-1][np.diff(offsets) > 0]
    first[np.searchsorted(places, full)] = True
    before = np.concatenate([[False], letter[:-1]]) & ~first[:-1] if len(cls) else letter
    after = np.concatenate([letter[1:], [False]]) & ~first[1:] if len(cls) else letter
    a, b = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after)
    edge = np.append(places, len(data))
    start, end = edge[a], edge[b + 1]
    key = tc.span_hash(low, start, end)
    points = tc.code_points(low, start) if len(start) else np.zeros(0, np.int64)
    return Words(low, start, end, key, script_of(points), b - a + 1, np.searchsorted(start, offsets))


def grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of words (with borders), and the number of each word's."""
    n = end - start
    size = n + 2
    at = np.cumsum(size) - size
    raw = np.full(int(size.sum()), 1, np.uint64)
    inside = tc.ragged(at + 1, n)
    raw[inside] = data[tc.ragged(start, n)]
    own = np.repeat(np.arange(len(n)), size)
    buckets, owner = [], []
    rolled = raw.copy()
    for k in range(1, 5):
        if k > 1:
            if len(raw) < k:
                break
            rolled = (rolled[:-1] << np.uint64(8)) | raw[k - 1 :]
            whole = own[: len(rolled)] == own[k - 1 :]
        else:
            whole = np.zeros(len(raw), bool)
            whole[inside] = True
        h = (rolled[whole] + np.uint64(k << 40)) * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((h >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1))
        owner.append(own[: len(rolled)][whole])
    return np.concatenate(buckets), np.concatenate(owner)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages
    uses: np.ndarray  # scripts x languages: 0, or FOREIGN


def counted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of each n-gram bucket, and letters of each script, in a block of texts."""
    w = find_words(data, offsets)
    if not len(w.start):
        return np.zeros(BUCKETS, np.int64), np.zeros(N_SCRIPTS, np.int64)
    _, at, times = np.unique(w.key, return_index=True, return_counts=True)
    bucket, owner = grams(w.data, w.start[at], w.end[at])
    return np.bincount(bucket, times[owner], BUCKETS).astype(np.int64), np.bincount(w.script, w.letters, N_SCRIPTS).astype(np.int64)


def model_of(langs: list[str], counts: np.ndarray, scripts: np.ndarray) -> Model:
    """From counts (buckets x languages, scripts x languages) of at least one language."""
    share = (counts + 0.05) / (counts + 0.05).sum(0)
    table = np.log(share)
    table -= table.mean(1, keepdims=True)
    total = np.maximum(scripts.sum(0), 1)
    return Model(langs, table.astype(np.float32), np.where(scripts / total >= SCRIPT_SHARE, 0.0, FOREIGN).astype(np.float32))


class Labeller:
    """Labels blocks of texts; keeps the scores of words that it has met, up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.words = tc.HashIndex(20)
        self.scores = np.zeros((1 << 12, len(model.langs)), np.float32)

    def word_scores(self, w: Words) -> np.ndarray:
        if self.words.n + len(w.key) > self.words.limit and self.words.n > self.words.limit // 2:
            self.words.clear()
        found = self.words.find(w.key)
        new = np.flatnonzero(found < 0)
        if len(new):
            keys, at = np.unique(w.key[new], return_index=True)
            at = new[at]
            n = self.words.n
            self.words.add(keys)
            while len(self.scores) < n + len(keys):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            bucket, owner = grams(w.data, w.start[at], w.end[at])
            sums = np.stack([np.bincount(owner, self.model.table[bucket, j], len(at)) for j in range(len(self.model.langs))], 1)
            sums /= 2.0  # overlapping n-grams say things twice
            narrowed = sums + self.model.uses[w.script[at]]
            alien = (self.model.uses[w.script[at]] < 0).all(1)
            narrowed[alien] = 0.0
            self.scores[n : n + len(keys)] = narrowed
            found[new] = self.words.find(w.key[new])
        return self.scores[found]

    def paths(self, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The language (number) of each word on its text's best path."""
        n, langs = scores.shape
        if not n:
            return np.zeros(0, np.int64)
        counts = np.diff(bounds)
        per = -(-counts // SEGMENT)
        doc = np.repeat(np.arange(len(counts)), per)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
        first = bounds[:-1][doc] + place * SEGMENT
        size = np.minimum(SEGMENT, bounds[1:][doc] - first)
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        longest = int(size[0])
        awake = np.searchsorted(-size, -np.arange(longest), "left").tolist()
        # Best-path matrices: from the language before a segment to the language at its end.
        change = np.where(np.eye(langs, dtype=bool), 0.0, -SWITCH_PENALTY).astype(np.float32)
        v = np.repeat(change[None], len(first), 0)
        for k in range(longest):
            m = awake[k]
            s = scores[first[:m] + k][:, None, :]
            v[:m] = (v[:m] if k == 0 else np.maximum(v[:m], v[:m].max(2, keepdims=True) - SWITCH_PENALTY)) + s
        matrix = np.empty_like(v)
        matrix[order] = v
        # Chain the segments of each text: the best score at each border, then the best languages back.
        begin = np.cumsum(per) - per
        rounds = int(per.max())
        by = np.argsort(-per, kind="stable")
        left = np.searchsorted(-per[by], -np.arange(rounds), "left").tolist()
        best = np.zeros((len(counts), langs), np.float32)
        came = np.zeros((len(doc), langs), np.int32)
        for k in range(rounds):
            d = by[: left[k]]
            t = best[d][:, :, None] + matrix[begin[d] + k]
            came[begin[d] + k] = t.argmax(1)
            best[d] = t.max(1)
        start, stop = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        now = best.argmax(1)
        for k in range(rounds - 1, -1, -1):
            d = by[: left[k]]
            at = begin[d] + k
            stop[at] = now[d]
            now[d] = came[at, now[d]]
            start[at] = now[d]
        # Inside the segments, from the known language before each to the known one at its end.
        start, stop = start[order], stop[order]
        v = change[start]
        keep = np.zeros((longest, len(first), langs), bool)
        lead = np.zeros((longest, len(first)), np.int32)
        for k in range(longest):
            m = awake[k]
            if k:
                lead[k, :m] = v[:m].argmax(1)
                top = v[:m].max(1, keepdims=True) - SWITCH_PENALTY
                keep[k, :m] = v[:m] >= top
                v[:m] = np.maximum(v[:m], top)
            v[:m] += scores[first[:m] + k]
        out = np.zeros(n, np.int64)
        now = stop.copy()
        for k in range(longest - 1, -1, -1):
            m = awake[k]
            out[first[:m] + k] = now[:m]
            if k:
                same = keep[k, np.arange(m), now[:m]]
                now[:m] = np.where(same, now[:m], lead[k, :m])
        return out

    def label(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
        """Words, their languages, and each text's language (-1: none) and score."""
        w = find_words(data, offsets)
        n, langs = len(offsets) - 1, len(self.model.langs)
        if not langs or not len(w.start):
            return w, np.zeros(len(w.start), np.int64), np.full(n, -1), np.zeros(n)
        path = self.paths(self.word_scores(w), w.bounds)
        doc = np.repeat(np.arange(n), np.diff(w.bounds))
        known = (self.model.uses[w.script] >= 0).any(1)
        letters = np.bincount(doc * langs + path, w.letters * known, n * langs).reshape(n, langs)
        total = np.bincount(doc, w.letters, n)
        return w, path, np.where(total > 0, letters.argmax(1), -1), letters.max(1) / np.maximum(total, 1)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from a bounded sample of the training part; ``docs`` with no label at all gives a model of no language."""
    ids = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    ids = ids.where("lang IS NOT NULL AND doc_id IS NOT NULL AND crc32(cast(doc_id AS string)) % 4 <> 2")
    sizes = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((N_SCRIPTS, 0), np.float32))
    share = F.lit(0)
    for lang, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == lang, min(1_000_000, -(-per_language * 1_000_000 // n))).otherwise(share)
    rows = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).where("text IS NOT NULL").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for part, data, offsets in text_blocks(batches, "text"):
            names = np.array(part.column(0).to_pylist(), object)
            for lang in set(names.tolist()):
                own = np.flatnonzero(names == lang)
                sizes = (offsets[1:] - offsets[:-1])[own]
                text = data[tc.ragged(offsets[:-1][own], sizes)]
                found[lang] = found.get(lang, 0) + np.concatenate(counted(text, np.concatenate([[0], np.cumsum(sizes)])))
        for lang, both in found.items():
            at = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(both[at])], names=["lang", "slot", "n"])

    sums = map_arrow(rows, count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(sizes)
    if not sums.num_rows:
        return model_of(langs, np.zeros((BUCKETS, len(langs))), np.zeros((N_SCRIPTS, len(langs))))
    number = {x: k for k, x in enumerate(langs)}
    column = np.array([number[x] for x in sums.column("lang").to_pylist()])
    table = np.zeros((BUCKETS + N_SCRIPTS, len(langs)))
    table[sums.column("slot").to_numpy(), column] = sums.column("n").to_numpy()
    return model_of(langs, table[:BUCKETS], table[BUCKETS:])


def _ids(column: pa.Array) -> np.ndarray:
    return np.array([x is not None and zlib.crc32(str(x).encode()) % 4 == 2 for x in column.to_pylist()], bool)


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", spans: bool = False) -> DataFrame:
    """Predict each whole text's language; with ``spans`` the labelled spans (byte offsets of their first and last words) too."""
    model = model or fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        names = np.array([*shared.value.langs, "und"], object)
        for rows, data, offsets in text_blocks(batches, "text"):
            w, path, lang, score = labeller.label(data, offsets)
            ids = rows.column(rows.schema.get_field_index("doc_id"))
            doc = np.repeat(np.arange(len(offsets) - 1), np.diff(w.bounds))
            new = np.ones(len(path), bool)
            new[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
            pred = pa.array(names[lang], pa.string())
            if not spans:
                n = np.bincount(doc[new], minlength=len(offsets) - 1)
                yield pa.RecordBatch.from_arrays([ids, pa.array(_ids(ids)), pred, pa.array(score), pa.array(n, pa.int32())], names=["doc_id", "held_out", "lang_pred", "score", "n_spans"])
                continue
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(path))[: len(at)] - 1
            parts: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
            for d, a, b, x in zip(doc[at].tolist(), w.start[at].tolist(), w.end[last].tolist(), names[path[at]].tolist()):
                parts[d].append({"start": a - int(offsets[d]), "end": b - int(offsets[d]), "lang": x})
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
            yield pa.RecordBatch.from_arrays([ids, pred, pa.array(score), pa.array(parts, kind)], names=["doc_id", "lang_pred", "score", "spans"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, SPANS_SCHEMA if spans else SCHEMA)


def filter_language(docs: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose text has a language with at least this score, with their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value)
        for rows, data, offsets in text_blocks(batches, text_col):
            _, _, lang, score = labeller.label(data, offsets)
            yield rows.filter(pa.array((lang >= 0) & (score >= min_score)))

    return map_arrow(docs, run, docs.schema)

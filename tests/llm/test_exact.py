"""The kernels against the libraries and against brute force, without Spark."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bpe_core, bpe_reuse, html_extract, html_train, language, neardup, packing, sharding, token_counts
from lodestone.llm import textcore as tc

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'t", "'re", "'ll", "'", "''", "1", "2é", "é", "ß", "漢字", "　", " ", "!", "...", "<|endoftext|>", "<|startoftext|>", "🎉", "\U00011b00", "́", "é", "'ve", "D", "'S", "\r\n", "\x1c", "\x85", "½", "Σ", "ΑΣ", "İ", "the", "ing", "aaaa", "abab", " word"]


def texts(n: int, longest: int = 30, seed: int = 1) -> list[str]:
    r = random.Random(seed)
    return ["", *("".join(r.choice(PARTS) for _ in range(r.randint(0, longest))) for _ in range(n)), "x" * 3000, "the" * 300]


def each_block(values: list[str], size: int = 1 << 14):
    data, offsets = tc.utf8_column(pa.array(values))
    for i, j in tc.blocks(offsets, size):
        yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def test_byte_level_ids_equal_the_library():
    values, enc = texts(3000), bpe_core.encoder(BYTE)
    got = [p.tolist() for d, o in each_block(values) for ids, n in [enc.encode_block(d, o)] for p in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [e.ids for e in enc.library.encode_batch(values, add_special_tokens=False)]


@given(st.lists(st.text(max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_byte_level_ids_of_any_text(values):
    values = [v.encode("utf-8", "replace").decode() for v in values] or [""]
    enc = bpe_core.encoder(BYTE)
    got = [p.tolist() for d, o in each_block(values) for ids, n in [enc.encode_block(d, o)] for p in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [e.ids for e in enc.library.encode_batch(values, add_special_tokens=False)]


def test_chunk_reuse_agrees_with_whole_texts():
    values = [t for t in texts(400, 400) for _ in range(2)]
    enc = bpe_reuse.ChunkEncoder(bpe_core.ByteBPE(BYTE), limit=100)
    got = [x for d, o in each_block(values) for x in enc.encode(d, o)]
    want = enc.words.library.encode_batch(values, add_special_tokens=False)
    assert [x[1].decode() for x in got] == [",".join(map(str, e.ids)) for e in want]
    assert [x[2].decode() for x in got] == [enc.words.library.decode(e.ids, skip_special_tokens=False) for e in want]
    assert sum(x[4] for x in got) > 0


@pytest.mark.parametrize("chunk", [3, 17, 128])
def test_transducer_counts_equal_the_library(chunk, monkeypatch):
    values, tokens = texts(1500), token_counts.counter(WORD)
    monkeypatch.setattr(tokens.automaton, "run", lambda d, f, n, run=tokens.automaton.run: run(d, f, n, chunk))
    got = [int(x) for d, o in each_block(values) for x in tokens.count(d, o)]
    assert got == [len(e.ids) for e in tokens.library.encode_batch(values, add_special_tokens=False)]


def test_transducer_restarts_when_full(monkeypatch):
    monkeypatch.setattr(token_counts, "STATE_LIMIT", 50)
    values, tokens = texts(300, seed=5), token_counts.counter(WORD)
    got = [int(x) for d, o in each_block(values, 512) for x in tokens.count(d, o)]
    assert got == [len(e.ids) for e in tokens.library.encode_batch(values, add_special_tokens=False)]


def test_packing_is_legal_and_near_the_bound():
    rng = np.random.default_rng(3)
    for sizes in (np.minimum(2048, rng.lognormal(6, 1.1, 4000).astype(int) + 1), rng.integers(1, 2049, 500), np.full(300, 1025), np.array([2048, 1, 2047])):
        bins = packing.reduce_and_fit(sizes)
        load = np.bincount(bins, weights=sizes)
        assert (bins >= 0).all() and load.max() <= 2048 and (load > 0).all()
        assert len(load) >= -(-sizes.sum() // 2048)
    sizes = np.minimum(2048, rng.lognormal(6, 1.1, 4000).astype(int) + 1)
    assert packing.reduce_and_fit(sizes).max() + 1 <= -(-sizes.sum() // 2048) * 1.005 + 1


def best_possible(sizes: tuple[int, ...], room: int) -> int:
    best = len(sizes)

    def go(k: int, bins: list[int]) -> None:
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(sizes):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + sizes[k] <= room:
                bins[i] += sizes[k]
                go(k + 1, bins)
                bins[i] -= sizes[k]
        bins.append(sizes[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best


@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_dominating_sets_cost_nothing(sizes):
    """A set that the reduction fixes leaves the best number of bins as it was."""
    room = 20
    free = packing._Free(np.array(sizes), room)
    size = free.most(room)
    free.take(size)
    chosen = packing.dominating_set(free, size, room)
    if chosen is not None:
        left = list(sizes)
        left.remove(size)
        for s in chosen:
            left.remove(s)
        assert 1 + (best_possible(tuple(sorted(left, reverse=True)), room) if left else 0) == best_possible(tuple(sorted(sizes, reverse=True)), room)


def test_cut():
    doc, piece, start, length = packing.cut(np.array([1, 2048, 2049, 5000]), 2048)
    assert list(zip(doc, piece, start, length)) == [(0, 0, 0, 1), (1, 0, 0, 2048), (2, 0, 0, 1), (2, 1, 1, 2048), (3, 0, 0, 904), (3, 1, 904, 2048), (3, 2, 2952, 2048)]


def test_hilbert_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(sharding.hilbert_index(grid, 3))
    assert sorted(sharding.hilbert_index(grid, 3).tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


def test_shingle_sets_equal_brute_force():
    values = ["", "a", "A b", "a  B\tc d", "a b c d e f a b c d e", "É é a b c d", "x " * 30, *texts(200, 40)]
    got = [p for d, o in each_block(values) for sets, n in [neardup.shingle_sets(d, o)] for p in np.split(sets, np.cumsum(n)[:-1])]
    lower = {i: i + 32 for i in range(65, 91)}
    seen: dict[tuple, int] = {}
    for text, found in zip(values, got):
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(lower))
        want = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        assert len(found) == len(want)
        for s in want:
            seen.setdefault(s, len(seen))
    again = {tuple(sorted(p.tolist())) for p in got}
    assert len(again) <= len(values)


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(2)
    model = language.Model(["a", "b", "c"], np.zeros((language.BUCKETS, 3), np.float32), np.zeros((language.N_SCRIPTS, 3), np.float32))
    labeller = language.Labeller(model)
    counts = np.array([0, 1, 5, 64, 65, 200, 130])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    scores = (rng.normal(0, 8, (bounds[-1], 3)) + np.repeat(rng.normal(0, 6, (bounds[-1] // 5 + 1, 3)), 5, 0)[: bounds[-1]]).astype(np.float32)
    path = labeller.paths(scores, bounds)
    value = lambda p, s: s[np.arange(len(p)), p].sum() - language.SWITCH_PENALTY * (p[1:] != p[:-1]).sum()
    for i, j in zip(bounds, bounds[1:]):
        s = scores[i:j]
        if not len(s):
            continue
        v = s[0].copy()
        for row in s[1:]:
            v = np.maximum(v, v.max() - language.SWITCH_PENALTY) + row
        assert abs(value(path[i:j], s) - v.max()) < 1e-2


def test_html_blocks_and_held_out_pages():
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><!-- <p>no --><script>var t='</p>';</script><article><h1>A &amp; B</h1><p><b>one\n two<br><p>three &lt;x&gt;</article><footer>&copy; me</footer>"
    assert [b[0] for b in html_extract.blocks_of(page)] == ["Menu", "A & B", "one two", "three <x>", "© me"]
    assert html_extract.extract(["", page], html_extract.load_weights())[1][0] == "A & B\none two\nthree <x>"
    held = html_train.examples(random.Random(1234), 200)
    got = html_extract.main_blocks([x for x, _ in held], html_extract.load_weights())
    right = sum(int((g == (y > 0)).sum()) for g, (_, y) in zip(got, held))
    assert right / sum(len(y) for _, y in held) > 0.97


def test_chunks_depend_on_content_only():
    r = random.Random(4)
    shared = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "of", "the"]) + str(r.randint(0, 99)) for _ in range(3000))
    found = []
    for lead in ("", "some other beginning. "):
        data, offsets = tc.utf8_column(pa.array([lead + shared]))
        starts = bpe_reuse.chunk_starts(data, tc.rolling_prefix(data), offsets[:-1])
        found.append(collections.Counter((starts[1:] - len(lead)).tolist()))
    assert sum((found[0] & found[1]).values()) >= 0.9 * sum(found[0].values()) > 5

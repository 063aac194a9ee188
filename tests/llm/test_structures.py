"""The data structures inside the operators, against plain Python."""

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nextbuy.llm import minhash, packing
from nextbuy.llm.decontaminate import MASKS, MISSES, SHORTEST, WINDOW
from nextbuy.llm.fuse import FuseFilter
from nextbuy.llm.packing import BestFit, WordEncoder, tokenizer_path
from nextbuy.llm.quality import Ftrl
from nextbuy.llm.suffix_array import lyndon_suffix_array, repeated_starts
from nextbuy.llm.textnp import RangeHash, doc_blocks, utf8


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_order(symbols):
    assert lyndon_suffix_array(symbols) == sorted(range(len(symbols)), key=lambda i: symbols[i:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abé ", max_size=60), min_size=1, max_size=6), st.integers(2, 12))
def test_repeated_starts(texts, length):
    strings, windows, at = [t.encode() for t in texts], Counter(), {}
    begin = 0
    for s in strings:
        for i in range(len(s) - length + 1):
            windows[s[i:i + length]] += 1
            at[begin + i] = s[i:i + length]
        begin += len(s) + 1
    got = repeated_starts(strings, np.ones(len(strings), int), length).tolist()
    assert got == sorted(p for p, w in at.items() if windows[w] > 1)


def test_weights_count_as_occurrences():
    assert repeated_starts([b"abcdefgh"], np.array([2]), 5).tolist() == [0, 1, 2, 3]
    assert repeated_starts([b"abcdefgh"], np.array([1]), 5).tolist() == []


@pytest.mark.parametrize("n", [0, 1, 2, 5, 40, 3000, 60_000])
def test_fuse_filter(n):
    rnd = np.random.default_rng(n)
    keys = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
    f = FuseFilter.build(keys)
    assert f.takes(keys).all()
    assert f.takes(rnd.integers(0, 2**63, 50_000).astype(np.uint64)).mean() < 0.01


def test_best_fit():
    rnd = random.Random(1)
    for capacity, max_open in ((10, 1), (10, 3), (64, 8)):
        fit, used = BestFit(capacity, max_open), {}
        for _ in range(500):
            n = rnd.randint(1, capacity)
            before = {b: f for f, own in fit.bins.items() for b in own}
            assert before == {b: capacity - used[b] for b in before} and fit.n_open == len(before) <= max_open
            s, at = fit.place(n)
            after = {b for own in fit.bins.values() for b in own}
            fits = [f for f in before.values() if f >= n]
            if fits:  # the least free space that takes it
                assert before[s] == min(fits) and set(before) - {s} <= after
            else:
                assert s not in used
                closed = set(before) - after
                assert len(closed) == (len(before) >= max_open) and all(before[b] == min(before.values()) for b in closed)
            assert at == used.get(s, 0)
            used[s] = at + n
            assert used[s] <= capacity


def test_masks_find_every_window():
    """Whichever tokens of a window are substituted, some mask fits beside them."""
    for width, misses in [(WINDOW, MISSES), *[(w, 1) for w in range(SHORTEST, WINDOW)]]:
        for gone in itertools.combinations(range(width), misses):
            assert any(not {p + at for p in m} & set(gone) for m in MASKS for at in range(width - m[-1]))


def test_words_are_encoded_like_texts():
    e = WordEncoder(tokenizer_path())
    rnd = random.Random(3)
    odd = ["", " ", "It's we'LL ''s ..'s", "a\x85b c\x1cd", "ΣΑΣ İs é é ½7", "<|endoftext|> x <|", "日本語 テ", "q" * 3000]
    odd += ["".join(rnd.choice("ab'sT \n\t.!é×²0<|>ß\xa0\x85") for _ in range(rnd.randint(0, 50))) for _ in range(500)]
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(odd, add_special_tokens=False)]
    assert e.by_text(odd) == want and list(e(pa.array(odd))) == want
    assert list(e(pa.array([None, "a"]))) == [b"", *e.by_text(["a"])]


def test_long_words_keep_all_ids():
    """Words of 65,536 ids or more, beside others in the same block and met again."""
    e = WordEncoder(tokenizer_path())
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), "a few other words", "x" * 1_000_000, "." * 300_000, "a few more words"]
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert max(map(len, want)) > 4 * 65_536
    assert list(e(pa.array(texts))) == want and list(e(pa.array(texts[::-1]))) == want[::-1]


def test_full_pool_is_learnt_anew(monkeypatch):
    monkeypatch.setattr(packing, "_POOL_LIMIT", 3)
    e = WordEncoder(tokenizer_path())
    texts = ["several words and more", "and several others", "more words"]
    want = [np.array(x.ids, "<u4").tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [next(iter(e(pa.array([t])))) for t in texts] == want


def test_range_hash_depends_on_bytes_alone():
    d = np.frombuffer(b"abcXabcYab", np.uint8)
    h = RangeHash(d)(np.array([0, 4, 8]), np.array([3, 7, 10]))
    assert h[0] == h[1] != h[2]


def test_blocks_and_nulls():
    off, b = utf8(pa.array(["ab", None, "", "cde"]))
    assert off.tolist() == [0, 2, 2, 2, 5] and b.tobytes() == b"abcde"
    assert [j for _, j in doc_blocks(off, 2)][-1] == 4


def test_ftrl_learns_a_sign():
    f = Ftrl(2, 0.5, 1.0, 0.0, 0.1)
    for _ in range(50):
        f.learn(np.array([0, 2]), np.array([1.0, 1.0]), 1)
        f.learn(np.array([1, 2]), np.array([1.0, 1.0]), 0)
    w = f.weights()
    assert w[0] > 0.5 > -0.5 > w[1]


def test_estimate_keeps_similar_and_drops_unlike():
    rnd = np.random.default_rng(5)
    for n in (150, 1000, 5000):
        a, new, far = (rnd.integers(0, 2**64, k, dtype=np.uint64) for k in (n, n // 10, n))
        near = np.append(a[: int(n * 0.9)], new)  # Jaccard about 0.82
        regs = minhash.registers(np.concatenate([np.sort(x) for x in (a, near, far)]), np.repeat([0, 1, 2], [n, len(near), n]), 3)
        sizes = np.array([n]), np.array([n])
        assert minhash.similar_enough(np.array([(regs[0] == regs[1]).sum()]), *sizes, 80)[0]
        assert not minhash.similar_enough(np.array([(regs[0] == regs[2]).sum()]), *sizes, 80)[0]
        assert (minhash.band_keys(regs[:1]) == minhash.band_keys(regs[1:2])).any()


def test_registers_of_small_sets_have_no_gap():
    regs = minhash.registers(np.array([1 << 60, 5], np.uint64)[::-1].copy(), np.array([0, 0]), 2)
    assert (regs[0] != 0xFFFF).all() and (regs[1] == 0xFFFF).all()

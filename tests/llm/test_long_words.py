"""Words that collide under polynomial hashes modulo 2**64, and long texts."""

import struct
from collections import defaultdict

import numpy as np
import pytest

from nextbuy.llm.minhash import near_duplicates
from nextbuy.llm.packing import pack, tokenize, tokenizer_path
from nextbuy.llm.quality import ngrams
from nextbuy.llm.textnp import SHORT, WORDS, RangeHash, tokens

from . import plain


def thue_morse(n):
    """Two different words of n letters (a power of two) with equal hashes modulo 2**64 for any odd base."""
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048])
def test_hashes_differ(n):
    t, u = thue_morse(n)
    data = np.frombuffer(f"{t} {u} {t}".encode(), np.uint8)
    ranges = RangeHash(data)
    assert ranges(np.array([0]), np.array([n])) == ranges(np.array([n + 1]), np.array([2 * n + 1]))  # the family is real
    h, _ = tokens(data, np.array([0, len(data)]), WORDS, lower=True)
    assert h[0] != h[1] and h[0] == h[2]
    f, _ = ngrams(data, np.array([0, len(data)]), 40)
    assert len(set(f.tolist())) >= 4


def test_short_words_of_all_kinds_differ():
    seen = {}
    for n in (SHORT, SHORT - 1):
        rnd = np.random.default_rng(n)
        data = rnd.integers(97, 99, (4000, n + 1)).astype(np.uint8)
        data[:, -1] = 32
        h, _ = tokens(data.ravel(), np.array([0, data.size]), WORDS, lower=True)
        for x, row in zip(h.tolist(), data, strict=True):
            assert seen.setdefault(x, row.tobytes()) == row.tobytes()


@pytest.mark.parametrize("n", [1024, 2048])
def test_operators_tell_the_words_apart(spark, n):
    from tokenizers import Tokenizer

    t, u = thue_morse(n)
    rows = [(1, f"{t} one two three"), (2, f"{u} four five six"), (3, t), (4, u), (5, f"{t} {u} {t}"), (6, f"{t} {t} {u}"), (7, f"{u}. {t}! x")]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(d).collect()}
    assert got == {i: (s, i if c is None else c, k) for i, (s, c, k) in plain_near(rows).items()}
    model = Tokenizer.from_file(tokenizer_path())
    ids = {i: [*model.encode(x, add_special_tokens=False).ids, 1] for i, x in rows}
    pieces = defaultdict(bytes)
    for r in tokenize(d, capacity=4096).orderBy("doc_id", "piece").collect():
        pieces[r.doc_id] += bytes(r.ids)
    assert pieces == {i: struct.pack(f"<{len(x)}I", *x) for i, x in ids.items()}
    assert {(r.doc_id, r.piece): r.ids_crc32 for r in pack(d).collect()} == {
        (i, k // 4096): plain.crc(struct.pack(f"<{len(x[k:k + 4096])}I", *x[k:k + 4096])) for i, x in ids.items() for k in range(0, len(x), 4096)}


def plain_near(rows, words=2, percent=80):
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k:k + words]) for k in range(max(len(w) - words + 1, 1))} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    return {i: (len(s), comp[i], comp[i] == i) for i, s in sets.items()}

"""Plain-Python definitions that the operators are held against."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import regex

WS = " \t\n\x0b\x0c\r"


def data(t: str | None) -> bytes:
    return (t or "").encode()


def repeats(rows, length):
    """[(n_bytes, removed runs, kept)] in the order of rows."""
    windows = Counter()
    for _, t in rows:
        b = data(t)
        windows.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for _, t in rows:
        b, gone = data(t), bytearray(len(data(t)))
        for i in range(len(b) - length + 1):
            if windows[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = [m.span() for m in re.finditer(b"\1+", bytes(gone))]
        out.append((len(b), runs, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def lower(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def lines(rows, min_chars=20, min_docs=3):
    """[(n_lines, n_dropped, kept text)]; null ids are smallest."""
    holders = defaultdict(list)
    for i, t in rows:
        for k in {lower(x.strip(WS)) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(-math.inf if i is None else i)
    often = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        gone = [lower(x.strip(WS)) in often and often[lower(x.strip(WS))] != (-math.inf if i is None else i) for x in own]
        out.append((len(own), sum(gone), "\n".join(x for x, g in zip(own, gone, strict=True) if not g)))
    return out


def normal(t: str | None) -> str:
    return re.sub(r"[ \t\n\x0b\x0c\r]+", " ", t or "")


def sha(b: bytes | str) -> str:
    return hashlib.sha256(b.encode() if isinstance(b, str) else b).hexdigest()


def crc(b: bytes) -> int:
    return zlib.crc32(b) & 0xFFFFFFFF


def shingles(t: str | None, words: int) -> frozenset:
    w = [lower(x) for x in re.split(r"[ \t\n\x0b\x0c\r]+", t or "") if x]
    return frozenset(tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def near_components(rows, words, percent):
    """[(set size, smallest id reachable)]; null ids are largest, empty sets alone."""
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    parent[find(a)] = find(b)
    least = defaultdict(lambda: math.inf)
    for x, (i, _) in enumerate(rows):
        least[find(x)] = min(least[find(x)], math.inf if i is None else i)
    return [(len(sets[x]), (None if least[find(x)] == math.inf else least[find(x)]) if sets[x] else i) for x, (i, _) in enumerate(rows)]


def tokens(t: str | None) -> list[str]:
    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]


def contaminated(rows, items):
    """[set of the numbers of the items found]."""
    laid = [tokens(t) for _, t in items]
    out = []
    for _, t in rows:
        doc, found = tokens(t), set()
        for x, item in enumerate(laid):
            n = len(item)
            width, need = min(n, 14), 12 if n >= 14 else n - 1
            if n < 8:
                continue
            for shift in range(-n, len(doc)):
                same = [item[j] == doc[j + shift] for j in range(max(0, -shift), min(n, len(doc) - shift))]
                if len(same) >= width and any(sum(same[k:k + width]) >= need for k in range(len(same) - width + 1)):
                    found.add(x)
                    break
        out.append(found)
    return out

"""Suffix arrays by linear grouping, and the repeats of a fixed length in a set of byte strings.

``lyndon_suffix_array`` sorts suffixes in two phases. Phase one keeps the
suffixes in groups of equal prefix and processes the groups in descending
order. For each suffix of the current group the nearest earlier suffix of a
lower group is found by following previous-smaller pointers; the suffixes so
reached are followed by the group's prefix once or several times, so they rise,
within their own group, above the others, ordered by how often. When all groups
are processed each group holds the suffixes with the same longest Lyndon prefix.
Phase two emits the order: walking the array from its least suffix, the suffix
before each emitted one, and those along its pointers that are not emitted
yet, take the next free places of their groups. Nothing is renamed or sorted
recursively.

``repeated_starts`` needs the byte suffixes of many strings. It cuts the
strings at content-defined marks into phrases (each phrase runs to the end of the next
mark, so no phrase is a proper prefix of another) and sorts the suffixes of the
phrase sequence, which is the byte order of the suffixes that start at a mark. Any
other byte suffix is ordered by (its bytes up to the next mark's end, the rank of the
suffix at that mark), so all suffixes that share a prefix of the given length
are neighbours, and neighbours are compared byte by byte.
"""

from __future__ import annotations

import numpy as np

from .textnp import RangeHash

#: Ends each string; never part of a UTF-8 text.
END = 0xFF
MARK = 4
_RATE = 15  # about every 16th position is a mark


def lyndon_suffix_array(symbols: list[int]) -> list[int]:
    """Starts of the suffixes of ``symbols`` (ints from 1) in ascending order."""
    text = [*symbols, 0]
    n = len(text)
    places: dict[int, list[int]] = {}
    for i, c in enumerate(text):
        places.setdefault(c, []).append(i)
    group, size, start_at_end = [0] * n, [0] * n, [0] * n
    members: list[list[int] | None] = [None] * n
    at = 0
    for c in sorted(places):
        own = places[c]
        members[at], size[at], start_at_end[at + len(own) - 1] = own, len(own), at
        for i in own:
            group[i] = at
        at += len(own)
    pointer = [-1] * n

    end = n - 1
    while end >= 0:
        g = start_at_end[end]
        reached: dict[int, int] = {}
        own = members[g]
        if size[g] != len(own):  # some members have risen since
            own = [i for i in own if group[i] == g]
        own.sort()
        for i in own:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = pointer[j]
            pointer[i] = j
            if j >= 0:
                reached[j] = reached.get(j, 0) + 1
        members[g] = None
        if reached:
            if len(reached) == len(own):
                levels = [list(reached)]
            else:
                by_count: dict[int, list[int]] = {}
                for j, k in reached.items():
                    by_count.setdefault(k, []).append(j)
                levels = [by_count[k] for k in sorted(by_count, reverse=True)]
            for level in levels:
                rising: dict[int, list[int]] = {}
                for j in level:
                    rising.setdefault(group[j], []).append(j)
                for h, some in rising.items():
                    k, all_of_h = len(some), size[h]
                    if k < all_of_h:
                        top = h + all_of_h - 1
                        new = top - k + 1
                        size[h], size[new] = all_of_h - k, k
                        start_at_end[top], start_at_end[new - 1] = new, h
                        members[new] = some
                        for j in some:
                            group[j] = new
        end = g - 1

    order, free, emitted = [0] * n, list(range(n)), bytearray(n)
    order[0] = n - 1
    emitted[n - 1] = 1
    for i in range(n):
        j = order[i] - 1
        while j >= 0 and not emitted[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            emitted[j] = 1
            j = pointer[j]
    return order[1:]


def _phrase_ranks(data: np.ndarray, hashes: RangeHash) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the phrases, rank of the suffix at each of them); ``data`` holds strings that end in END."""
    n = len(data)
    ends = np.flatnonzero(data == END)
    mark = np.zeros(n, bool)
    if n >= MARK:
        at = np.arange(n - MARK + 1)
        mark[:n - MARK + 1] = hashes(at, at + MARK) & np.uint64(_RATE) == 0
        for k in range(MARK):  # a mark lies within one string
            mark[np.maximum(ends - k, 0)] = False
    starts = np.union1d(np.flatnonzero(mark), np.append(0, ends[:-1] + 1))
    # a phrase ends with the next mark, or with its string's END
    following = np.append(starts[1:], n)
    stop = ends[np.searchsorted(ends, starts)] + 1
    stop = np.where(following < stop, following + MARK, stop)
    raw = data.tobytes()
    phrases = [raw[a:b] for a, b in zip(starts.tolist(), stop.tolist(), strict=True)]
    rank_of = {p: r for r, p in enumerate(sorted(set(phrases)), 1)}
    order = lyndon_suffix_array([rank_of[p] for p in phrases])
    rank = np.empty(len(starts), np.int64)
    rank[order] = np.arange(len(order))
    return starts, rank


def repeated_starts(strings: list[bytes], weights: np.ndarray, length: int, chunk: int = 1 << 15) -> np.ndarray:
    """Positions in the strings, each followed by END, where a ``length``-byte string starts whose occurrences weigh 2 or more.

    ``weights`` says how often each string occurs.
    """
    data = np.frombuffer(b"".join(s + bytes([END]) for s in strings), np.uint8)
    hashes = RangeHash(data)
    marks, rank = _phrase_ranks(data, hashes)
    ends = np.flatnonzero(data == END)
    own_string = np.searchsorted(ends, np.arange(len(data)))
    start = np.flatnonzero(ends[own_string] - np.arange(len(data)) >= length)
    if not len(start):
        return start
    # a string's first phrase starts without a mark: then the next one counts
    is_mark = np.append(~np.isin(marks, np.append(0, ends[:-1] + 1)) | _marked(data, hashes, marks), False)
    real = marks[is_mark[:-1]]
    real_rank = rank[is_mark[:-1]]
    k = np.searchsorted(real, start)
    mark_at = np.append(real, len(data) + length)[k]
    inside = mark_at + MARK <= start + length
    stop = np.where(inside, mark_at + MARK, start + length)
    order = np.lexsort((np.where(inside, np.append(real_rank, 0)[k], 0), hashes(start, stop)))
    start = start[order]
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    same = np.zeros(len(start), bool)  # same bytes as the one before
    whole = hashes(start, start + length)
    close = np.flatnonzero(whole[1:] == whole[:-1]) + 1
    for i in range(0, len(close), chunk):
        c = close[i:i + chunk]
        same[c] = (view[start[c]] == view[start[c - 1]]).all(1)
    first = np.flatnonzero(~same)
    weight = np.add.reduceat(weights[own_string[start]], first)
    often = np.repeat(weight >= 2, np.diff(np.append(first, len(start))))
    return np.sort(start[often])


def _marked(data: np.ndarray, hashes: RangeHash, at: np.ndarray) -> np.ndarray:
    """Which of the positions are marks."""
    ok = at + MARK <= len(data)
    safe = np.where(ok, at, 0)
    hit = hashes(safe, np.minimum(safe + MARK, len(data))) & np.uint64(_RATE) == 0
    window = np.minimum(safe[:, None] + np.arange(MARK), len(data) - 1)
    return ok & hit & (data[window] != END).all(1)

"""Best-fit packing of token sequences (operator 6).

Documents are tokenised (BPE ids, then a closing id), cut into pieces of at
most ``capacity`` tokens, and the pieces are packed into sequences. Packing is
bounded-space online best-fit: pieces arrive in a fixed pseudo-random order; at
most ``max_open`` bins are open, held in a bitset keyed by free space. A piece
goes to the open bin with the least free space that still takes it; when a new
bin would exceed the bound, the fullest open bin closes first.

Tokenising is one pass over the texts. Only the pieces' measures (no tokens)
are exchanged, to tasks of about ``pieces_per_task`` pieces that pack
independently, so packing scales out and loses at most ``max_open`` partly
filled bins per task.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_text, stored
from .textnp import BLOCK, doc_blocks, token_hashes, utf8

CLOSING_ID = 1
_WORD_LIMIT = 700_000
_TEXT_WORD_LIMIT = 200_000
_POOL_LIMIT = 1 << 26
_PART = 1 << 19
_WHITE_SPACE = re.compile(r"[ \t-\r]+")
_LONG_WORD = 10_000
_LOWER_CASE = np.arange(256, dtype=np.uint8)
_LOWER_CASE[65:91] += 32
_KINDS = np.array([1 if b >= 128 or chr(b).isalpha() else 2 if chr(b).isdigit() else 0 if chr(b) in " \t\n\x0b\x0c\r" else 3 for b in range(256)], np.uint8)
_CONTRACTED = np.isin(np.arange(256), np.frombuffer(b"strvmldSTRVMLD", np.uint8))
_encoders: dict[str, WordEncoder] = {}


class WordTable:
    """Ids by word hash: open addressing in numpy arrays, probed for many words at once."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys, self.places = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64)
        self.pool, self.used, self.size = np.zeros(1 << 16, "<u4"), 0, 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Where each word's ids are (offset << 32 | count), -1 if it is not known."""
        slot = (h & np.uint64(len(self.keys) - 1)).astype(np.int64)
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        while len(left):
            key = self.keys[slot[left]]
            hit = key == h[left]
            out[left[hit]] = self.places[slot[left[hit]]]
            left = left[~hit & (key != 0)]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
        return out

    def add(self, h: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """New distinct words with the ids of one after the other."""
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.used], np.zeros(max(len(self.pool), 2 * len(ids)), "<u4")])
        self.pool[self.used:self.used + len(ids)] = ids
        place = (self.used + np.cumsum(counts) - counts) << 32 | counts
        self.used += len(ids)
        self.size += len(h)
        if 2 * self.size > len(self.keys):
            known = self.keys != 0
            h, place = np.concatenate([self.keys[known], h]), np.concatenate([self.places[known], place])
            slots = 1 << int(2 * self.size).bit_length()
            self.keys, self.places = np.zeros(slots, np.uint64), np.zeros(slots, np.int64)
        self._put(h, place)

    def _put(self, h: np.ndarray, place: np.ndarray) -> None:
        slot = (h & np.uint64(len(self.keys) - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = left[self.keys[slot[left]] == 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.places[slot[won]] = h[won], place[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)


class WordEncoder:
    """Encodes texts word by word with bounded caches of words' ids.

    The vocabulary lower-cases, drops white space and cuts texts into words by a
    fixed rule, so a text's ids are its words' ids one after the other. Texts of
    ASCII and Latin letters are cut and hashed in numpy and looked up in a ``WordTable``; only
    words new to it go through the tokenizer. Texts with other Latin-1 characters or
    contractions are cut by a regular expression; the rest, and texts with a special token's
    string, go to the tokenizer in parts between white space.
    """

    #: Fixed by the vocabulary: runs of letters, contractions, single numbers, runs of the rest (Latin-1, lower-cased).
    CUTS = re.compile("[a-z\xdf-\xf6\xf8-\xff\xaa\xb5\xba]+|'(?:s|t|re|ve|m|ll|d)|[0-9\xb2\xb3\xb9\xbc-\xbe]"
                      "|[^\t-\r \x85\xa0a-z\xdf-\xf6\xf8-\xff\xaa\xb5\xba0-9\xb2\xb3\xb9\xbc-\xbe]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.table = WordTable()
        self.cut: dict[str, bytes] = {}
        self.raw: dict[str, bytes] = {}

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """Each text's ids, little-endian unsigned 32-bit, without the closing id."""
        off, data = utf8(texts)
        for i, j in doc_blocks(off):
            yield from self._block(texts, i, j, off[i:j + 1] - off[i], data[off[i]:off[j]])

    def _block(self, texts: pa.Array, i: int, j: int, off: np.ndarray, data: np.ndarray) -> list[bytes]:
        plain = np.ones(j - i, bool)
        plain[np.searchsorted(off, np.flatnonzero(_odd(data)), "right") - 1] = False
        plain &= np.diff(off) <= 2 * BLOCK
        if len(data) > 2 * BLOCK:
            data, off = data[:0], np.zeros(j - i + 1, np.int64)
            plain[:] = False
        low, kind = _lowered(data)
        edge = np.ones(len(data), bool)
        edge[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)  # every digit is a word
        edge[off[:-1][off[:-1] < len(data)]] = True
        start = np.flatnonzero(edge)
        end = np.append(start[1:], len(data))
        real = kind[start] != 0
        start, end = start[real], end[real]
        doc = np.searchsorted(off, start, "right") - 1
        real = plain[doc]
        start, end, doc = start[real], end[real], doc[real]
        h = np.maximum(token_hashes(low, start, end), np.uint64(1))
        place = self.table.find(h)
        new = np.flatnonzero(place < 0)
        if len(new):
            if self.table.size > _WORD_LIMIT or self.table.used > _POOL_LIMIT:
                self.table.clear()
                new = np.arange(len(h))
            _, first = np.unique(h[new], return_index=True)
            self._learn_hashed(h, low.tobytes(), start, end, new[first])
            place = self.table.find(h)
        count = place & 0xFFFFFFFF
        begin = np.cumsum(count) - count
        ids = self.table.pool[np.repeat((place >> 32) - begin, count) + np.arange(int(count.sum()))]
        bounds = np.append(begin, len(ids))[np.searchsorted(doc, np.arange(j - i + 1))]
        out = [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k in np.flatnonzero(~plain).tolist():
            out[k] = self.by_text([texts[i + k].as_py() or ""])[0]
        return out

    def _learn_hashed(self, h: np.ndarray, low: bytes, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> None:
        """Learn the words at the given places (of distinct hashes)."""
        size = end[at] - start[at]
        for k in at[size > _LONG_WORD].tolist():
            ids = np.frombuffer(b"".join(self.by_text([low[start[k]:end[k]].decode()])), "<u4")
            self.table.add(h[[k]], np.array([len(ids)]), ids)
        at = at[size <= _LONG_WORD]
        if len(at):
            words = [low[a:b].decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            ids, ends = self._encoded(words)
            self.table.add(h[at], np.diff(ends), ids)

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds) of words that the vocabulary does not cut any further, all encoded in one text."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        return ids, np.append(0, np.flatnonzero(self.last[ids]) + 1)

    def by_text(self, texts: list[str]) -> list[bytes]:
        """As a call, text by text."""
        out = [b""] * len(texts)
        parts = [(i, part) for i, text in enumerate(texts) for part in parts_at_white_space(text, _PART)]
        at = 0
        while at < len(parts):  # words new to the cache are learnt together, for about _PART characters at a time
            size, end = 0, at
            while end < len(parts) and (end == at or size + len(parts[end][1]) <= _PART):
                size += len(parts[end][1])
                end += 1
            cut = [(i, self.CUTS.findall(p.lower())) if "<|" not in p and _latin1(p) else None for i, p in parts[at:end]]
            raw = [(i, _WHITE_SPACE.split(p)) if c is None else None for c, (i, p) in zip(cut, parts[at:end], strict=True)]
            passing: list[tuple[dict[str, bytes], list[str]]] = []
            for own, cache, learn in ((cut, self.cut, self._learn_cuts), (raw, self.raw, self._learn_raw)):
                if new := list(set().union(*[x[1] for x in own if x]).difference(cache)):
                    learn(new)
                    if len(cache) > _TEXT_WORD_LIMIT:  # full: the words met first, which are the frequent ones, stay
                        passing.append((cache, new))
            for c, r in zip(cut, raw, strict=True):
                i, words = c or r
                out[i] += b"".join(map((self.cut if c else self.raw).__getitem__, words))
            for cache, new in passing:
                for w in new:
                    del cache[w]
            at = end
        return out

    def _learn_cuts(self, new: list[str]) -> None:
        ids, ends = self._encoded(new)
        ids, ends = ids.tobytes(), (4 * ends).tolist()
        for w, a, b in zip(new, ends[:-1], ends[1:], strict=True):
            self.cut[w] = ids[a:b]

    def _learn_raw(self, new: list[str]) -> None:
        for w, e in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False), strict=True):
            self.raw[w] = np.array(e.ids, "<u4").tobytes()


def _odd(data: np.ndarray) -> np.ndarray:
    """Bytes that rule out the plain rule of ``_block``: beyond ASCII and Latin letters, contractions, special tokens."""
    after = np.append(data[1:], np.uint8(0))
    odd = (data == 0xC2) | (data >= 0xC4) | (data == 0xC3) & ((after == 0x97) | (after == 0xB7))
    return odd | (data == 0x27) & _CONTRACTED[after] | (data == 0x3C) & (after == 0x7C)


def _lowered(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased bytes, their kinds) of plain text; kinds: 0 white space, 1 letter, 2 digit, 3 other."""
    low = _LOWER_CASE[data]
    second = np.flatnonzero(data == 0xC3) + 1
    second = second[second < len(data)]
    upper = second[low[second] <= 0x9E]
    low[upper] += 0x20
    return low, _KINDS[low]


def _latin1(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def parts_at_white_space(text: str, limit: int) -> Iterator[str]:
    """``text`` in parts of about ``limit`` characters, cut only at ASCII white space."""
    at = 0
    while len(text) - at > limit:
        cut = _WHITE_SPACE.search(text, at + limit)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.end()
    yield text[at:]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenize(docs: DataFrame, capacity: int = 4096, tokenizer: str = "word_bpe_49k.json", id_col: str = "doc_id",
             text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids) with ids as little-endian 32-bit binary.

    Without ``with_ids`` the ids stay in the worker and only their checksum comes out. A null or empty text is its closing id alone. Repeated rows give repeated
    pieces. Only id and text are read.
    """
    docs = id_text(docs, id_col, text_col)
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                           T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
                           *[T.StructField("ids", T.BinaryType())] * with_ids])
    closing = struct.pack("<I", CLOSING_ID)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_path(tokenizer)
        if path not in _encoders:
            _encoders[path] = WordEncoder(path)
        encode = _encoders[path]
        names = [f.name for f in schema.fields]
        for batch in batches:
            rows: list[tuple[int, int, int, int, int, bytes | None]] = []
            size = 0

            def flush(rows, batch=batch):
                cols = list(zip(*rows, strict=True))
                own = batch.column(0).take(pa.array(cols[0], pa.int64()))
                return pa.RecordBatch.from_arrays([own, pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:5]],
                                                   *[pa.array(cols[5], pa.binary())] * with_ids], names)

            for i, ids in enumerate(encode(batch.column(1))):
                ids += closing
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
                    size += len(part) * with_ids
                    if size > 4 << 20:
                        yield flush(rows)
                        rows, size = [], 0
            if rows:
                yield flush(rows)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class BestFit:
    """Bounded-space online best-fit: (sequence, offset) of each arriving length."""

    def __init__(self, capacity: int, max_open: int):
        self.capacity, self.max_open = capacity, max_open
        self.free = 0  # bit f is set when an open bin has f free places
        self.bins: dict[int, list[int]] = {}
        self.n_open = self.made = 0

    def _put(self, number: int, free: int) -> None:
        if free:
            self.bins.setdefault(free, []).append(number)
            self.free |= 1 << free
            self.n_open += 1

    def _take(self, free: int) -> int:
        own = self.bins[free]
        number = own.pop()
        if not own:
            self.free &= ~(1 << free)
        self.n_open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1  # the least free space that takes it
            number = self._take(free)
        else:
            if self.n_open >= self.max_open:  # the fullest closes
                self._take((self.free & -self.free).bit_length() - 1)
            number, free = self.made, self.capacity
            self.made += 1
        self._put(number, free - length)
        return number, self.capacity - free


def assign(pieces: DataFrame, capacity: int = 4096, max_open: int = 2048, pieces_per_task: int = 50_000) -> DataFrame:
    """Adds (sequence_id, offset) to rows that have doc_id, piece and length (1 to ``capacity``).

    Runs on the rows' measures: store them first if they are costly to make.
    """
    n_tasks = max(1, -(-pieces.count() // pieces_per_task))
    order = F.xxhash64("doc_id", "piece", "length")
    dealt = pieces.withColumn("order", order).repartition(n_tasks, "order").sortWithinPartitions("order", "doc_id", "piece").drop("order")
    schema = T.StructType(list(pieces.schema.fields) + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fit, first = BestFit(capacity, max_open), TaskContext.get().partitionId() << 40
        for pdf in batches:
            at = [fit.place(n) for n in pdf["length"].tolist()]
            yield pdf.assign(sequence_id=[first + s for s, _ in at], offset=[o for _, o in at])

    return dealt.mapInPandas(run, schema)


def pack(docs: DataFrame, capacity: int = 4096, max_open: int = 2048, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row."""
    measures = stored(tokenize(docs, capacity, id_col=id_col, text_col=text_col, with_ids=False, **kw), "pieces")
    return assign(measures, capacity, max_open)


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) from ``tokenize`` and ``assign`` (ids that are unique): at most ``capacity`` tokens a group."""
    both = placed.join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    own = both.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x.ids))
    return own.select("sequence_id", "n_tokens", joined.alias("ids"))

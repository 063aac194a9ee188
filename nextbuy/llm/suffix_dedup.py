"""Removal of repeated byte strings by suffix arrays (operator 1).

A byte is removed when a ``length``-byte string that covers it also starts
anywhere else in the corpus. To find such strings without one suffix array over
everything, windows of ``length`` bytes are dealt out so that equal ones meet:

1. Each window has an anchor that depends on its bytes alone (see
   ``segments``). Runs of windows with one anchor are segments; only segments
   whose anchor occurs more than once can hold a repeated window.
2. Segments with the same bytes are one *string* with a weight (aggregated in the
   map tasks first, so a passage that a third of all documents hold is one row per
   task). Its bytes are cut out of one document that holds it.
3. Strings meet by anchor. A task sorts all suffixes of the strings of whole
   anchors (about ``task_bytes`` at a time) with the suffix array
   of ``suffix_array`` and marks the window starts that recur, by weight.
4. An anchor whose strings exceed ``task_bytes`` is split exactly: its windows
   are halved by their distance to the anchor, and each half meets by anchor
   *and* the bytes that all its windows share, again and again, until the
   groups are small; a group of single windows has one string only.
5. The marks go back to every document that holds the string and are merged there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, fits_broadcast, keyed, release, stored
from .suffix_array import repeated_starts
from .textnp import BLOCK, RangeHash, utf8

_POSITION_BITS = 24
ID = ["key", "content"]
#: Lists of up to this many 8-byte keys may be broadcast.
BROADCAST_ROWS = 1_000_000


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    done = 1
    while 2 * done <= width:
        v = np.minimum(v[:-done], v[done:])
        done *= 2
    return np.minimum(v[:done - width], v[width - done:]) if done < width else v


def segments(off: np.ndarray, data: np.ndarray, length: int, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, first, n, before, key, content) of every segment, in arrays.

    Every ``length``-byte window has an anchor: of the ``seed``-byte strings in
    it the one with the least hash (the leftmost of equal ones). It depends on the window's bytes
    alone, so equal windows have equal anchors at equal places. A segment is a
    run of ``n`` window starts from ``first`` on with one anchor, ``before``
    bytes after the first start; ``key`` is the anchor's hash, ``content`` that of the segment's bytes.
    """
    width = length - seed + 1
    for b0 in range(0, len(data), BLOCK):
        b1 = min(len(data), b0 + BLOCK)
        part = data[b0:min(len(data), b1 + length - 1)]
        m = len(part) - length + 1
        if m <= 0:
            break
        at = np.arange(len(part) - seed + 1)
        hashes = RangeHash(part)
        h = hashes(at, at + seed)
        least = _sliding_min((h >> np.uint64(_POSITION_BITS) << np.uint64(_POSITION_BITS)) | at.astype(np.uint64), width)
        anchor = (least & np.uint64((1 << _POSITION_BITS) - 1)).astype(np.int64)
        valid = np.ones(m, bool)
        for e in off[np.searchsorted(off, b0):np.searchsorted(off, b0 + m + length)]:  # windows stay within a document
            valid[max(0, e - b0 - length + 1):max(0, e - b0)] = False
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
        cut = np.append(np.flatnonzero(new | ~valid), m)
        start = np.flatnonzero(new)
        n = cut[np.searchsorted(cut, start, "right")] - start
        doc = np.searchsorted(off, b0 + start, "right") - 1
        content = hashes(start, start + n + length - 1)
        yield doc, b0 + start - off[doc], n, anchor[start] - start, h[anchor[start]], content


def _segments(docs: DataFrame, length: int, seed: int) -> DataFrame:
    """(k1, k2, key, content, first, n, before) of keyed documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = utf8(batch.column(2))
            for doc, first, n, before, key, content in segments(off, data, length, seed):
                own = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(own), batch.column(1).take(own), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)),
                     pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(before.astype(np.int32))],
                    [*KEY, *ID, "first", "n", "before"])

    return docs.select(*KEY, "text").mapInArrow(run, "k1 long, k2 long, key long, content long, first int, n int, before int")


def _cut_out(strings: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Adds the strings' bytes (``bytes``) from the one document each names."""
    per_doc = strings.groupBy(*KEY).agg(F.collect_list(F.struct(*ID, "first", "n", "before", "weight")).alias("own"))  # a document's, each once
    texts = docs.select(*KEY, F.col("text").cast("binary").alias("text")).join(per_doc, KEY)
    texts = texts.select("text", F.inline("own"))
    cut = F.substring("text", F.col("first") + 1, F.col("n") + F.lit(length - 1))
    return texts.select(*ID, "n", "before", "weight", cut.alias("bytes"))


def _marks(strings: DataFrame, length: int, task_bytes: int) -> DataFrame:
    """(key, content, low, high): ranges of window starts in the strings that recur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def sort() -> pa.RecordBatch:
            keys, contents, weights, strs = zip(*held, strict=True)
            at = repeated_starts(list(strs), np.array(weights), length)
            begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in strs])])
            cut = np.flatnonzero(np.append(True, at[1:] != at[:-1] + 1)) if len(at) else at
            low, high = at[cut], at[np.append(cut[1:], len(at)) - 1] + 1 if len(at) else at
            own = np.searchsorted(begin, low, "right") - 1
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array(keys, np.int64)[own]), pa.array(np.array(contents, np.int64)[own]),
                 pa.array((low - begin[own]).astype(np.int32)), pa.array((high - begin[own]).astype(np.int32))], [*ID, "low", "high"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= task_bytes and row[0] != last:  # only between anchors
                    yield sort()
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                last = row[0]
        if held:
            yield sort()

    dealt = strings.select(*ID, "weight", "bytes").repartition("key").sortWithinPartitions("key", "content")
    return dealt.mapInArrow(run, "key long, content long, low int, high int")


def _halves(strings: DataFrame, length: int) -> DataFrame:
    """Each string's windows in two: those at least ``middle`` bytes before the anchor, and the others.

    (key, content, skip) name the parent and where the part starts in it; the
    part has (key2, content2, n, before, low_d, high_d, weight, bytes).
    """
    middle = F.floor((F.col("low_d") + F.col("high_d") + 1) / 2).cast("int")
    far = F.least(F.greatest(F.col("before") - middle + 1, F.lit(0)), F.col("n"))
    s = strings.withColumns({"middle": middle, "far": far})
    parts = F.array(
        F.struct(F.lit(0).alias("skip"), F.col("far").alias("n"), F.col("before").alias("before"), F.col("middle").alias("low_d"), F.col("high_d").alias("high_d")),
        F.struct(F.col("far").alias("skip"), (F.col("n") - F.col("far")).alias("n"), (F.col("before") - F.col("far")).alias("before"),
                 F.col("low_d").alias("low_d"), (F.col("middle") - 1).alias("high_d")))
    s = s.select(*ID, "weight", F.col("bytes").alias("whole"), F.inline(parts)).filter("n > 0")
    s = s.withColumn("bytes", F.substring("whole", F.col("skip") + 1, F.col("n") + F.lit(length - 1))).drop("whole")
    core = F.substring("bytes", F.col("before") - F.col("low_d") + 1, F.lit(length) - (F.col("high_d") - F.col("low_d")))
    return s.withColumns({"key2": F.xxhash64("key", "low_d", core), "content2": F.xxhash64("bytes", "before")})


def _all_marks(strings: DataFrame, length: int, seed: int, task_bytes: int) -> DataFrame:
    """Marks of all strings, however many share an anchor."""
    level = strings.withColumns({"low_d": F.lit(0), "high_d": F.lit(length - seed)})
    found, links = [], []
    while True:
        large = level.groupBy("key").agg(F.sum(F.length("bytes")).alias("b"), F.count("*").alias("c"))
        large = stored(large.filter((F.col("b") > task_bytes) & (F.col("c") > 1)).select("key"), "large-anchors")
        if large.isEmpty():
            found.append(_marks(level, length, task_bytes))
            break
        keys = F.broadcast(large) if fits_broadcast(large, BROADCAST_ROWS) else large
        found.append(_marks(level.join(keys, "key", "left_anti"), length, task_bytes))
        halves = stored(_halves(level.join(keys, "key", "left_semi"), length), "halves")
        links.append(halves.select(*ID, "key2", "content2", "skip"))
        level = stored(halves.groupBy(F.col("key2").alias("key"), F.col("content2").alias("content"), "n", "before", "low_d", "high_d", "bytes")
                       .agg(F.sum("weight").alias("weight")), "strings")
    marks = stored(found.pop(), "marks")
    while links:  # a part's marks belong to every string it was cut from
        link = links.pop()
        up = marks.toDF("key2", "content2", "low", "high").join(link, ["key2", "content2"])
        up = up.select(*ID, (F.col("low") + F.col("skip")).alias("low"), (F.col("high") + F.col("skip")).alias("high"))
        marks = stored(up.unionByName(found.pop()), "marks")
    return marks


def _without(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) from keyed documents and their (k1, k2, own) lists of byte ranges."""
    rows = docs.join(spans, KEY, "left").select("doc_id", "text", "own")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, merged, kept = [], [], []
            for i, ranges in enumerate(batch.column(2).to_pylist()):
                text = batch.column(1)[i].as_buffer().to_pybytes()
                runs: list[list[int]] = []
                for r in sorted((r["start"], r["end"]) for r in ranges or ()):
                    if runs and r[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], r[1])
                    else:
                        runs.append([*r])
                edges = [0, *(x for r in runs for x in r), len(text)]
                n_bytes.append(len(text))
                merged.append([{"start": a, "end": b} for a, b in runs])
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(merged, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                 pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def remove_repeats(docs: DataFrame, length: int = 200, seed: int = 40, task_bytes: int = 1 << 20, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row: maximal removed byte ranges and the remaining bytes.

    Every byte covered by a ``length``-byte string that also starts anywhere
    else (same document included) is removed; strings are judged on the
    input and never cross documents. Null text counts as empty; texts shorter
    than ``length`` stay whole. A row repeated with the same id and text is another
    occurrence of all its strings. Only id and text are read. ``seed`` (bytes
    of an anchor) changes the work, not the result.
    """
    docs = keyed(docs, id_col, text_col)
    found = _segments(docs, length, seed)
    often = stored(found.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"), "anchors")
    keys = F.broadcast(often) if fits_broadcast(often, BROADCAST_ROWS) else often
    found = stored(found.join(keys, "key", "left_semi"), "segments")
    release(docs.sparkSession)
    strings = found.groupBy(*ID, "n", "before").agg(F.count("*").alias("weight"), *[F.first(c).alias(c) for c in (*KEY, "first")])
    strings = stored(_cut_out(stored(strings, "string-places"), docs, length), "strings")
    release(docs.sparkSession)
    marks = _all_marks(strings, length, seed, task_bytes)
    release(docs.sparkSession)
    spans = found.select(*KEY, *ID, "first").join(marks, ID).groupBy(*KEY).agg(
        F.collect_set(F.struct((F.col("first") + F.col("low")).alias("start"), (F.col("first") + F.col("high") + F.lit(length - 1)).alias("end"))).alias("own"))
    return _without(docs, stored(spans, "spans"))

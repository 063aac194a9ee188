"""Histogram sort into shards of near equal bytes (operator 8).

The sort key is (hash of the text, hash of the row), 32 hex digits: equal
texts are neighbours, and a group of copies of any size can still be cut
between two of its rows. Shards are ranges of that order.

Splitters are found as in a histogram sort. Candidate boundaries are key
prefixes. The first round counts the exact bytes (and rows) below each
3-digit prefix over all partitions; then only the prefixes that hold a
splitter not yet within tolerance are refined by two more digits, until every splitter is within tolerance (or its
prefix is a full key). The driver sees only these histograms: 4,096 rows, then at most
256 for each of the (n_shards - 1) splitters and round, whatever the size of the data.

With the splitters fixed, rows are exchanged once, by shard and ranges of the key that hold
about ``leaf_rows`` rows, and numbered from the range's offset in a stored
table of the ranges' counts. A range of copies of one text is cut further by the row's hash,
so neither a shard nor a group of copies is sorted in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_text, fits_broadcast, id_text, stored

DIGITS = 32
#: Key ranges that rows are numbered in: no more than this, however many rows there are.
MOST_RANGES = 200_000
BROADCAST_ROWS = 500_000


def _histogram(rows: DataFrame, depth: int, prefixes: list[str] | None) -> list[tuple[str, int, int]]:
    """(prefix of ``depth`` digits, bytes, rows) below the given shorter prefixes."""
    if prefixes is not None:
        rows = rows.filter(F.substring("key", 1, len(prefixes[0])).isin(prefixes))
    got = rows.groupBy(F.substring("key", 1, depth).alias("p")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    return [(r.p, int(r.b), int(r.n)) for r in got]  # bounded, see the module's notes


def find_splitters(rows: DataFrame, n_shards: int, tolerance: float) -> tuple[list[str], int]:
    """(n_shards - 1 rising key prefixes, number of rows): shard i takes the keys from splitter i - 1 up to splitter i."""
    leaves = sorted(_histogram(rows, 3, None))
    total, n, depth = sum(b for _, b, _ in leaves), sum(k for _, _, k in leaves), 3
    targets = [total * i / n_shards for i in range(1, n_shards)]
    slack = tolerance * total / n_shards
    while True:
        below, i, open_ = 0, 0, []
        for p, b, k in leaves:
            while i < len(targets) and targets[i] < below:
                i += 1
            j, unsettled = i, False
            while j < len(targets) and targets[j] <= below + b:
                unsettled |= min(targets[j] - below, below + b - targets[j]) > slack
                j += 1
            if unsettled and k > 1 and len(p) == depth < DIGITS:
                open_.append(p)  # at most one for each splitter
            below += b
        if not open_:
            break
        shut = set(open_)
        deeper = min(DIGITS, depth + 2)
        leaves = sorted([x for x in leaves if x[0] not in shut] + _histogram(rows, deeper, open_))
        depth = deeper
    edges, below = [], 0
    for p, b, _ in leaves:
        edges.append((below, p))
        below += b
    edges.append((below, "g"))  # after all keys
    places, out, k = [x for x, _ in edges], [], 0
    for t in targets:
        while k + 1 < len(edges) and abs(places[k + 1] - t) <= abs(places[k] - t):
            k += 1
        out.append(edges[k][1])
    return out, n


def _numbered(rows: DataFrame, n: int, leaf_rows: int) -> DataFrame:
    """Adds ``slot``, the place of each row within its shard, counted over key ranges of about ``leaf_rows`` rows."""
    leaf_rows = max(leaf_rows, n // MOST_RANGES)
    digits = max(1, round(math.log(max(n / leaf_rows, 1), 16)))
    rows = rows.withColumn("p", F.substring("key", 1, digits))
    counts = stored(rows.groupBy("shard", "p").agg(F.count("*").alias("c")), "ranges")
    more = F.least(F.ceil(F.log(16.0, F.col("c") / F.lit(float(leaf_rows)))), F.lit(DIGITS - 16)).cast("int")
    large = counts.filter(F.col("c") > 4 * leaf_rows).select("shard", "p", more.alias("more"))  # fewer than MOST_RANGES
    rows = rows.join(F.broadcast(large), ["shard", "p"], "left")
    rows = rows.withColumn("q", F.when(F.col("more").isNotNull(), F.substring("key", F.lit(17), F.col("more"))).otherwise("")).drop("more")
    counts = rows.groupBy("shard", "p", "q").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("shard").orderBy("p", "q")) - F.col("c")
    offsets = stored(counts.select("shard", "p", "q", before.alias("before")), "offsets")
    # the one exchange of the rows
    place = F.row_number().over(Window.partitionBy("shard", "p", "q").orderBy("key", "doc_id")) - 1
    ranked = rows.withColumn("place", place)
    small = F.broadcast(offsets) if fits_broadcast(offsets, BROADCAST_ROWS) else offsets
    return ranked.join(small, ["shard", "p", "q"]).withColumn("slot", (F.col("before") + F.col("place")).cast("long"))


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, overhead: int = 16, tolerance: float = 0.002,
                   leaf_rows: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot) for every row; law ``bytes``.

    size is the text's UTF-8 bytes plus ``overhead`` (null text: no bytes).
    Shard sizes differ by at most the tolerance and one row. slot numbers a
    shard's rows from 0 without gaps, in a fixed order of their keys; repeated rows get a slot
    each. Null ids are kept. No rows: no shards. Only id and text are read.
    """
    text = F.col("text")
    rows = id_text(docs, id_col, text_col).select(
        "doc_id", (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), crc32_text(text).alias("text_crc32"),
        F.concat(F.lpad(F.hex(F.xxhash64(text)), 16, "0"),
                 F.lpad(F.hex(F.xxhash64(F.lit(3), F.coalesce(F.col("doc_id").cast("string"), F.lit("~null")), text)), 16, "0")).alias("key"))
    rows = stored(rows, "shard-rows")  # narrow: no texts in the rounds and the exchange
    splitters, n = find_splitters(rows, n_shards, tolerance)
    shard = F.lit(0)
    for x in splitters:
        shard = shard + (F.col("key") >= x).cast("int")
    placed = _numbered(rows.withColumn("shard", shard), n, leaf_rows)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot")

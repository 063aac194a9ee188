"""Near-duplicate groups by HyperMinHash (operator 9).

1. *Sketch.* A document's set is its distinct word shingles, as 64-bit hashes.
   The hash's first bits pick one of 128 buckets; of the bucket's least value a
   register keeps the leading-zero count (6 bits) and the next 10 mantissa
   bits. Empty registers take a neighbour's in a fixed order.
   Documents with the same set share one *node* (exact copies collapse).
2. *Band.* 32 bands of 4 compressed registers; nodes that agree in a band are
   candidates. (At similarity 0.8 a pair misses all bands with a probability of
   5e-8.)
3. *Estimate.* The registers' Jaccard estimate, corrected for the collisions
   that the sets' sizes let expect, drops candidates 4.5 standard errors below
   the threshold.
4. *Verify.* Candidates are confirmed on their full sets.

Groups need only be connected, so pairs within a band are not listed. In a few
star rounds each node is tested against the most similar centre of its bands that has another
label (one centre a band and round); of the nodes of one label only the most similar one is tested
against a centre's label, and labels that turn out to be linked become one.
Then, in each band that still holds several labels, the nodes outside the
largest one are compared with all nodes of the band, so no link is lost: what passes
the estimate is verified there, and only links that join two labels leave the band.

Bands of more than ``BLOCK_NODES`` nodes are not compared pair by pair, which would
grow with their square. The bands with one largest label form a *family* around one of
its nodes, the centre, and a node is held as its difference to the centre: with B missing
and Q added shingles, 100 |B| + t |Q| <= (100 - t) |centre| says that it is linked with the centre.
Of two linked nodes, x not linked with the centre, both differences hold more than
(100 |B| + t |Q|) / (100 + t) common shingles, B and Q being the other node's. So one of them is among the other's
|B| + |Q| - floor((100 |B| + t |Q|) / (100 + t)) rarest ones (about those it adds), and only nodes that meet in
such a shingle are verified. This is exact for every choice of centres.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, apply_decisions, fits_broadcast, keyed, stored, with_row_key
from .components import components
from .textnp import WORDS, doc_blocks, long_tokens, mix, utf8

N_REGISTERS, BANDS = 128, 32
_ROWS = N_REGISTERS // BANDS
_EMPTY = np.uint16(0xFFFF)
_MANTISSA = 10
#: For an empty register: the order in which the others are asked.
_ASK = np.stack([np.random.default_rng(i).permutation(N_REGISTERS) for i in range(N_REGISTERS)])
BROADCAST_ROWS = 500_000
#: Bands of at most so many nodes are compared pair by pair, larger ones by the differences to a centre.
BLOCK_NODES = 256
#: So many of a family's nodes are looked at to choose its centre.
LIKELY = 32


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, document) of a block of documents."""
    h, doc = long_tokens(data, off, WORDS, lower=True)
    n = len(off) - 1
    count = np.bincount(doc, minlength=n)
    per = np.minimum(count, words)  # fewer words: the whole sequence is the one shingle
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    at = np.arange(len(h)) - first[doc]
    starts = np.flatnonzero(at <= count[doc] - per[doc])
    out, owner = mix(h[starts] + np.uint64(17)), doc[starts]
    for k in range(1, words):
        more = per[owner] > k
        out[more] = mix(out[more] * np.uint64(3) + h[starts[more] + k])
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    if len(out):
        new = np.append(True, (out[1:] != out[:-1]) | (owner[1:] != owner[:-1]))
        out, owner = out[new], owner[new]
    return out, owner


def registers(sets: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, 128) registers of sorted sets; a document without shingles has only empty ones."""
    table = np.full((n, N_REGISTERS), _EMPTY, np.uint16)
    if not len(sets):
        return table
    bucket = (sets >> np.uint64(57)).astype(np.int64)
    slot = owner * N_REGISTERS + bucket
    first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))  # sorted: the least value of its bucket
    value = sets[first] << np.uint64(7)
    zeros, x = np.zeros(len(value), np.uint64), value.copy()
    for s in (32, 16, 8, 4, 2, 1):
        small = x >> np.uint64(64 - s) == 0
        zeros[small] += np.uint64(s)
        x[small] <<= np.uint64(s)
    mantissa = (x << np.uint64(1)) >> np.uint64(64 - _MANTISSA)
    table.reshape(-1)[slot[first]] = (np.minimum(zeros, 62) << np.uint64(_MANTISSA) | mantissa).astype(np.uint16)
    own = table.copy()
    rows = np.unique(owner)
    for k in range(N_REGISTERS):
        rows = rows[(table[rows] == _EMPTY).any(1)]
        if not len(rows):
            break
        part = table[rows]
        table[rows] = np.where(part == _EMPTY, own[rows][:, _ASK[:, k]], part)
    return table


@cache
def _collision_rate(size_class: int) -> float:
    """Chance that registers of two unrelated sets of about 1.25**size_class shingles agree."""
    per_bucket = 1.25**size_class / N_REGISTERS
    lead, cell = np.meshgrid(np.arange(45), np.arange(1 << _MANTISSA), indexing="ij")
    low = 0.5 ** (lead + 1) * (1 + cell / (1 << _MANTISSA))
    high = low + 0.5 ** (lead + 1) / (1 << _MANTISSA)
    chance = np.exp(per_bucket * np.log1p(-low)) - np.exp(per_bucket * np.log1p(-np.minimum(high, 1 - 1e-12)))
    return float((chance**2).sum()) if per_bucket >= 1 else 2.0**-_MANTISSA


def similar_enough(equal: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether the collision-corrected estimate from ``equal`` agreeing registers is within 4.5 standard errors of the threshold."""
    least = np.minimum(size_a, size_b)
    rate = np.array([_collision_rate(c) for c in range(90)])[np.clip(np.log(np.maximum(least, 1)) / np.log(1.25), 0, 89).astype(int)]
    jaccard = (equal / N_REGISTERS - rate) / (1 - rate)
    t = percent / 100
    error = np.sqrt(t * (1 - t) / np.minimum(np.maximum(least, 1), N_REGISTERS))
    return (jaccard >= t - 4.5 * error) & (100 * least >= percent * np.maximum(size_a, size_b))


def _matrix(column, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(n, N_REGISTERS)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """(n, 32): a hash of each band's four registers."""
    packed = np.ascontiguousarray(regs).view(np.uint64)
    return mix(packed + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """(k1, k2, doc_id, n, s1, s2, regs) of keyed documents; (s1, s2) identifies the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = utf8(batch.column(3))
            n = batch.num_rows
            size, s1, s2, regs = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64), []
            for i, j in doc_blocks(off):
                sets, owner = shingle_sets(data[off[i]:off[j]], off[i:j + 1] - off[i], words)
                size[i:j] = np.bincount(owner, minlength=j - i)
                np.add.at(s1[i:j], owner, mix(sets + np.uint64(101)))
                np.add.at(s2[i:j], owner, mix(sets ^ np.uint64(0xABCDEF0123456789)))
                regs.append(registers(sets, owner, j - i))
            rows = np.concatenate(regs) if regs else np.zeros((0, N_REGISTERS), np.uint16)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(size), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)),
                 pa.array([r.tobytes() for r in rows], pa.binary())], ["k1", "k2", "doc_id", "n", "s1", "s2", "regs"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(*KEY, "doc_id", "text").mapInArrow(run, f"k1 long, k2 long, doc_id {id_type}, n long, s1 long, s2 long, regs binary")


def _banded(nodes: DataFrame) -> DataFrame:
    """(band, node, n) for each of a node's 32 bands."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = band_keys(_matrix(pdf["regs"], len(pdf)))
            yield pd.DataFrame({"band": keys.ravel(), "node": np.repeat(pdf["node"].to_numpy(), BANDS), "n": np.repeat(pdf["n"].to_numpy(), BANDS)})

    return nodes.select("node", "n", "regs").mapInPandas(run, "band long, node long, n long")


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Of (a, la, b, lb) rows those that pass the estimate, with the number of agreeing registers (``equal``)."""
    own = nodes.select("node", "n", "regs")
    rows = pairs.join(own.toDF("a", "na", "ra"), "a").join(own.toDF("b", "nb", "rb"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            equal = (_matrix(pdf["ra"], len(pdf)) == _matrix(pdf["rb"], len(pdf))).sum(1)
            ok = similar_enough(equal, pdf["na"].to_numpy(), pdf["nb"].to_numpy(), percent)
            yield pd.DataFrame({"a": pdf["a"], "la": pdf["la"], "b": pdf["b"], "lb": pdf["lb"], "equal": equal})[ok]

    return rows.select("a", "la", "b", "lb", "na", "nb", "ra", "rb").mapInPandas(run, "a long, la long, b long, lb long, equal long")


def _sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the full sets of the wanted nodes (a stored list, repeats allowed), from their documents' texts."""
    if fits_broadcast(wanted, BROADCAST_ROWS):  # then its nodes fit, too
        rows = F.broadcast(nodes.select("node", *KEY).join(F.broadcast(wanted), "node", "left_semi"))
    else:
        rows = nodes.select("node", *KEY).join(wanted.distinct(), "node")
    texts = docs.select(*KEY, "text").join(rows, KEY).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = utf8(batch.column(1))
            for i, j in doc_blocks(off):
                sets, owner = shingle_sets(data[off[i]:off[j]], off[i:j + 1] - off[i], words)
                ends = np.searchsorted(owner, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array([sets[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())],
                    ["node", "shingles"])

    # a row repeated with one id and text gives its node's set again, which does no harm
    return stored(texts.mapInArrow(run, "node long, shingles binary"), "sets")


def _linked(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    at = np.searchsorted(x, y)
    common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, la, b, lb) rows whose nodes' full sets are similar enough."""
    rows = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [_linked(x, y, percent) for x, y in zip(pdf["sa"], pdf["sb"], strict=True)]
            yield pdf.loc[ok, ["a", "la", "b", "lb"]]

    return rows.select("a", "la", "b", "lb", "sa", "sb").mapInPandas(run, "a long, la long, b long, lb long")


def _star_round(members: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int, number: int) -> tuple[DataFrame, DataFrame]:
    """(members with new labels, verified links). A band's centre is its node with the least hash in this round."""
    least = F.min(F.struct(F.xxhash64(F.lit(number), "node").alias("o"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("label").alias("la")))
    centre = members.groupBy("band").agg(least.alias("c")).select("band", "c.a", "c.na", F.col("c.la").alias("la"))
    star = members.join(centre, "band").filter("la <> label")
    star = star.filter(100 * F.least("n", "na") >= percent * F.greatest("n", "na")).select("a", "la", F.col("node").alias("b"), F.col("label").alias("lb")).distinct()
    best = _estimated(star, nodes, percent).groupBy("b", "lb").agg(F.max(F.struct("equal", "a", "la")).alias("m"))
    best = best.groupBy("lb", F.col("m.la").alias("la")).agg(F.max(F.struct("m.equal", "m.a", "b")).alias("m"))
    best = stored(best.select(F.col("m.a").alias("a"), "la", F.col("m.b").alias("b"), "lb"), "pairs")
    sets = _sets_of(best.select(F.explode(F.array("a", "b")).alias("node")), nodes, docs, words)
    links = stored(_verified(best, sets, percent), "links")
    # each label takes the least one that it is linked with, and then that one's
    both = links.select("la", "lb").unionByName(links.select(F.col("lb").alias("la"), F.col("la").alias("lb")))
    least = stored(both.groupBy(F.col("la").alias("label")).agg(F.min("lb").alias("m")).select("label", F.least("label", "m").alias("least")), "labels")
    small = F.broadcast if fits_broadcast(least, BROADCAST_ROWS) else lambda d: d
    moved = least.join(small(least.toDF("least", "next")), "least", "left").select("label", F.coalesce("next", "least").alias("new"))
    members = members.join(small(moved), "label", "left").select("band", "node", "n", F.coalesce("new", "label").alias("label"))
    return stored(members, "members"), links.select("a", "b")


def _unsettled(members: DataFrame) -> DataFrame:
    """(band, top, all) of the bands that hold several labels: the most frequent one and the number of nodes."""
    counts = members.groupBy("band", "label").agg(F.count("*").alias("c")).groupBy("band")
    return counts.agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all")).filter("all > top.c").select("band", "top.label", "all").toDF("band", "top", "all")


def _in_blocks(members: DataFrame, bands: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """What passes the estimate across labels in the small ones of ``bands``: (block, node, label, near), ``near`` listing nodes of the same block.

    Of a band's nodes those outside its most frequent label are compared with
    all. A block is a band. A pair is listed in the first band it shares.
    """
    rows = members.join(bands.filter(F.col("all") <= BLOCK_NODES), "band")
    rows = rows.select(F.col("band").alias("block"), "band", (F.col("label") != F.col("top")).alias("minor"), "node", "label")
    rows = rows.join(nodes.select("node", "n", "regs"), "node")
    dealt = rows.repartition("block").sortWithinPartitions("block", "node").select("block", "band", "minor", "node", "label", "n", "regs")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame | None:
        block, band, minor, node, label, n = (pdf[c].to_numpy() for c in ("block", "band", "minor", "node", "label", "n"))
        regs = _matrix(pdf["regs"], len(pdf))
        keys = band_keys(regs)
        start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        size = np.diff(np.append(start, len(block)))
        small = np.repeat(size <= 16, size)
        near: list[tuple[np.ndarray, np.ndarray]] = []

        def take(x: np.ndarray, y: np.ndarray) -> None:
            ok = label[x] != label[y]
            x, y = x[ok], y[ok]
            first = keys[x, (keys[x] == keys[y]).argmax(1)] == band[x]
            x, y = x[first], y[first]
            ok = similar_enough((regs[x] == regs[y]).sum(1), n[x], n[y], percent)
            if ok.any():
                near.append((x[ok], y[ok]))

        for d in range(1, 16):  # small blocks: all of them at once, by distance
            x = np.flatnonzero((block[:-d] == block[d:]) & small[d:] & (minor[:-d] | minor[d:])) if d < len(block) else np.zeros(0, int)
            if len(x):
                take(np.where(minor[x], x, x + d), np.where(minor[x], x + d, x))
        for s, c in zip(start[size > 16], size[size > 16], strict=True):
            own = np.arange(s, s + c)
            for x in own[minor[own]]:
                others = own[~minor[own] | (own > x)]  # two minor nodes once
                take(np.full(len(others), x), others)
        if not near:
            return None
        x, y = (np.concatenate(v) for v in zip(*near, strict=True))
        order = np.argsort(x, kind="stable")
        own, first = np.unique(x[order], return_index=True)
        lists = np.split(node[y[order]], first[1:])  # arrays, not lists of objects
        rest = np.setdiff1d(y, own)
        at = np.concatenate([own, rest])
        return pd.DataFrame({"block": block[at], "node": node[at], "label": label[at], "near": [*lists, *[node[:0]] * len(rest)]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in _whole_blocks(batches):
            if (found := compare(whole)) is not None:
                yield found

    return dealt.mapInPandas(run, "block long, node long, label long, near array<long>")


def _whole_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by block, regrouped so that no block is cut."""
    held = None
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        last = pdf["block"] == pdf["block"].iloc[-1]  # may go on in the next batch
        held = pdf[last]
        if not last.all():
            yield pdf[~last]
    if held is not None and len(held):
        yield held


def _links_across(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The verified (a, b) that join two labels of a block; each set travels once per block."""
    rows = found.join(sets, "node").repartition("block").sortWithinPartitions("block", "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_blocks(batches):
            links = []
            for _, own in pdf.groupby("block", sort=False):
                of = dict(zip(own["node"], own["shingles"], strict=True))
                label = dict(zip(own["node"], own["label"], strict=True))
                parent = {x: x for x in label.values()}

                def root(x: int, parent=parent) -> int:
                    while parent[x] != x:
                        parent[x] = x = parent[parent[x]]
                    return x

                for a, near in zip(own["node"], own["near"], strict=True):
                    for b in near:
                        x, y = root(label[a]), root(label[b])
                        if x != y and _linked(of[a], of[b], percent):
                            parent[x] = y
                            links.append((a, b))
            if links:
                yield pd.DataFrame(links, columns=["a", "b"])

    return rows.select("block", "node", "label", "near", "shingles").mapInPandas(run, "a long, b long")


def _centres(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(family, centre, core, middle): the node, with its label and set, that is most like what most of a family's likely centres hold.

    Any node would do for the result; the fewer shingles a centre has of its own, the fewer nodes meet.
    """
    order = Window.partitionBy("family").orderBy(F.desc("met"), "node")  # those that meet the others in most bands
    likely = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= LIKELY).select("family", "node", "label")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        held, often = np.unique(np.concatenate(own), return_counts=True)
        most = held[2 * often > len(own)]
        differs = [len(x) + len(most) - 2 * len(np.intersect1d(x, most, assume_unique=True)) for x in own]
        best = pdf.iloc[min(range(len(own)), key=lambda i: (differs[i], pdf["node"].iloc[i]))]
        return pd.DataFrame({"family": [best["family"]], "centre": [best["node"]], "core": [best["label"]], "middle": [best["shingles"]]})

    return likely.join(sets, "node").groupBy("family").applyInPandas(choose, "family long, centre long, core long, middle binary")


def _in_families(members: DataFrame, bands: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The verified (a, b) across labels of the large ones of ``bands``: links with their families' centres, and pairs that meet in a rare difference."""
    large = members.join(bands.filter(F.col("all") > BLOCK_NODES), "band")
    rows = stored(large.groupBy(F.col("top").alias("family"), "node", "label", "n").agg(F.sum("all").alias("met")), "families")
    sets = _sets_of(rows.select("node"), nodes, docs, words).dropDuplicates(["node"])
    sets = stored(sets, "family-sets")
    middle = _centres(rows, sets)
    rows = rows.join(sets, "node").join(middle, "family").select("family", "centre", "core", "node", "label", "n", "shingles", "middle")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for mine, middle in zip(pdf["shingles"], pdf["middle"], strict=True):
                x, c = np.frombuffer(mine, np.uint64), np.frombuffer(middle, np.uint64)
                more, less = np.setdiff1d(x, c, assume_unique=True), np.setdiff1d(c, x, assume_unique=True)
                weight = 100 * len(less) + percent * len(more)
                differs = np.concatenate([more, less])
                out.append((weight <= (100 - percent) * len(c), len(differs) - weight // (100 + percent), differs.view(np.int64)))
            linked, first, differs = zip(*out, strict=True) if out else ((), (), ())
            yield pdf[["family", "centre", "core", "node", "label", "n"]].assign(linked=np.array(linked, bool), first=np.array(first, np.int64), differs=list(differs))

    schema = "family long, centre long, core long, node long, label long, n long, linked boolean, first long, differs array<long>"
    held = stored(rows.mapInPandas(run, schema), "differences")
    direct = held.filter("linked and label <> core").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    each = held.select("family", "node", "label", "n", (~F.col("linked")).alias("asks"), "first", F.explode("differs").alias("s"))
    count = each.groupBy("family", "s").agg(F.count("*").alias("often"), F.max("asks").alias("asked"), (F.min("label") != F.max("label")).alias("across"))
    rank = F.row_number().over(Window.partitionBy("family", "node").orderBy("often", "s"))
    ranked = each.join(count, ["family", "s"]).withColumn("rank", rank).filter("asked and across and (asks or rank <= first)")
    ranked = stored(ranked.select("family", "s", "node", "label", "n", "asks", (F.col("rank") <= F.col("first")).alias("rare")), "meetings")
    asks = ranked.filter("asks").select("family", "s", F.col("node").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"))
    pairs = asks.join(ranked.filter("rare").select("family", "s", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb")), ["family", "s"])
    pairs = pairs.filter("la <> lb").filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "la", "b", "lb").distinct()
    return direct.unionByName(_verified(pairs, sets, percent).select("a", "b"))


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = 80, star_rounds: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Words are runs of other than ASCII white space, A-Z lower-cased; a set is
    the distinct ``words``-word shingles (with fewer words the whole sequence;
    without words empty and linked with nothing). Documents are linked when
    100 * intersection >= ``percent`` * union; component_id is the smallest id
    reachable (null ids last). kept marks one row of each component, the one with that id;
    of rows repeated with one id, one. Null text counts as empty. Only id and
    text are read; no rows give no rows.
    """
    return _decided(keyed(docs, id_col, text_col), words, percent, star_rounds).drop(*KEY)


def keep_one_of_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80,
                     star_rounds: int = 2) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each near-duplicate component, and every text without words."""
    rows, keys = with_row_key(docs, id_col, text_col)
    decided = _decided(keyed(docs, id_col, text_col), words, percent, star_rounds)
    return apply_decisions(rows, decided.select(F.col("k1").alias(keys[0]), F.col("k2").alias(keys[1]), "kept"), keys).select(*docs.columns)


def _decided(docs: DataFrame, words: int, percent: int, star_rounds: int) -> DataFrame:
    """(k1, k2, doc_id, n_shingles, component_id, kept) of keyed documents."""
    sketches = stored(sketch(docs, words), "sketches")
    one = sketches.filter("n > 0").dropDuplicates(["s1", "s2"]).withColumn("node", F.monotonically_increasing_id())
    nodes = stored(one.select("node", "n", "s1", "s2", *KEY, "regs"), "nodes")  # written once: the numbers are fixed
    banded = _banded(nodes)
    shared = banded.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1").select("band")
    # a node's label is a node that it is known to be connected with
    members = stored(banded.join(shared, "band").select("band", "node", "n", F.col("node").alias("label")), "members")
    links = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    if not members.isEmpty():
        for r in range(star_rounds):
            members, new = _star_round(members, nodes, docs, words, percent, r)
            links = links.unionByName(new)
        bands = stored(_unsettled(members), "bands")
        found = stored(_in_blocks(members, bands, nodes, percent), "near")
        sets = _sets_of(found.select("node"), nodes, docs, words)
        links = links.unionByName(_links_across(found, sets, percent))
        if not bands.filter(F.col("all") > BLOCK_NODES).isEmpty():
            links = links.unionByName(_in_families(members, bands, nodes, docs, words, percent))
    comps = stored(components(links), "components")
    comps = F.broadcast(comps) if fits_broadcast(comps, BROADCAST_ROWS) else comps
    # per set, then per component: the row that stays
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    per_set = sketches.filter("n > 0").groupBy("s1", "s2").agg(F.min(place).alias("least"))
    per_set = per_set.join(nodes.select("s1", "s2", "node"), ["s1", "s2"]).join(comps, "node", "left")
    per_set = stored(per_set.select("s1", "s2", F.coalesce("comp", "node").alias("comp"), "least"), "set-components")
    stays = per_set.groupBy("comp").agg(F.min("least").alias("stay"))
    per_set = per_set.join(stays, "comp").select("s1", "s2", "stay")
    rows = sketches.groupBy(*KEY, "doc_id", "n", "s1", "s2").agg(F.count("*").cast("int").alias("copies"))
    out = rows.join(per_set, ["s1", "s2"], "left").select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    mine = (F.col("stay.k1") == F.col("k1")) & (F.col("stay.k2") == F.col("k2")) & (F.col("copy") == 1)
    alone = F.col("n") == 0
    return out.select(*KEY, "doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("stay.doc_id")).alias("component_id"),
                      F.when(alone, F.lit(True)).otherwise(mine).alias("kept"))

"""Exact deduplication with static filters over immutable snapshots (operator 5).

Texts are equal when identical after replacing each run of ASCII white space
by one space. Rows arrive in batches; every batch becomes an immutable
snapshot in the shared folder:

1. New-batch duplicates are grouped by (digest, text): byte-exact, with partial
   aggregation in the map tasks, so a group of copies moves one row per task.
2. The batch's digests are screened by the binary fuse filters of every earlier
   snapshot. Filters are split by digest into buckets of bounded size; digests
   meet their filter by bucket.
3. Only digests that a filter lets through join that snapshot's exact rows, and
   count as known only if the texts are the same bytes.
4. Texts that no earlier snapshot owns are owned by this one, which gets filters
   over the digests of the texts it owns, never changed afterwards.

A text's rows are then those of its owner and of the known groups linked to it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import apply_decisions, fits_broadcast, fresh, id_text, stored
from .fuse import FuseFilter

#: Digest lists of up to this many rows (8 bytes each) may be broadcast.
BROADCAST_ROWS = 500_000


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space (the pattern matches only what changes)."""
    return F.regexp_replace(text, r"[ \t\n\x0B\f\r]{2,}|[\t\n\x0B\f\r]", " ")


@dataclass
class Snapshot:
    """Immutable: ``groups`` (digest, sha, keep_id, n, norm) and ``known`` (sha, owner), and filters over the rest."""

    groups: DataFrame
    known: DataFrame
    filters: DataFrame
    n_buckets: int

    def owned(self) -> DataFrame:
        return self.groups.join(self.known.select("sha"), "sha", "left_anti")


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint only if the row count is proven to be within bounds."""
    return F.broadcast(df) if fits_broadcast(df, BROADCAST_ROWS) else df


def build_filters(digests: DataFrame, n_buckets: int) -> DataFrame:
    """(bucket, seed, segment, segments, prints): one binary fuse filter per bucket of digests."""

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        f = FuseFilter.build(np.unique(pdf["digest"].to_numpy(np.int64).view(np.uint64)))
        return pd.DataFrame({"bucket": [pdf["bucket"].iloc[0]], "seed": [np.uint64(f.seed).view(np.int64)], "segment": [f.segment],
                             "segments": [f.segments], "prints": [f.prints]})

    rows = digests.select("digest", F.pmod("digest", F.lit(n_buckets)).cast("int").alias("bucket"))
    return rows.groupBy("bucket").applyInPandas(make, "bucket int, seed long, segment int, segments int, prints binary")


def screen(digests: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The digests that the snapshot's filters let through."""

    def probe(incoming: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if not len(filters) or not len(incoming):
            return pd.DataFrame({"digest": pd.Series([], dtype="int64")})
        f = filters.iloc[0]
        own = FuseFilter(int(np.int64(f.seed).view(np.uint64)), int(f.segment), int(f.segments), bytes(f.prints))
        return incoming.loc[own.takes(incoming["digest"].to_numpy(np.int64).view(np.uint64)), ["digest"]]

    rows = digests.select("digest", F.pmod("digest", F.lit(snapshot.n_buckets)).cast("int").alias("bucket"))
    return rows.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInPandas(probe, "digest long")


def ingest(batch: DataFrame, snapshots: list[Snapshot], n_buckets: int) -> Snapshot:
    """Make the snapshot of a batch of (doc_id, digest, sha, norm) after the given ones."""
    groups = stored(batch.groupBy("digest", "sha", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n")), "snapshot")
    known = None
    for s in snapshots:
        maybe = _small(stored(screen(groups.select("digest").distinct(), s), "positives"))
        mine = groups.join(maybe, "digest", "left_semi").select("digest", "norm", "sha")
        theirs = s.groups.join(maybe, "digest", "left_semi").select("digest", "norm", F.col("sha").alias("owner"))
        theirs = theirs.join(s.known.select(F.col("sha").alias("owner")), "owner", "left_anti")
        same = mine.join(theirs, ["digest", "norm"]).select("sha", "owner")  # the bytes are compared
        known = same if known is None else known.unionByName(same)
    if known is None:
        known = groups.select("sha", F.col("sha").alias("owner")).limit(0)
    known = stored(known, "known")
    owned = groups.select("sha", "digest").join(known.select("sha"), "sha", "left_anti")
    return Snapshot(groups, known, stored(build_filters(owned, n_buckets), "filters"), n_buckets)


def dedup_exact(docs: DataFrame, n_batches: int = 3, digests_per_filter: int = 100_000, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row, dropped ones too.

    Of equal texts the row with the smallest id stays (null ids last; a group of
    null ids only keeps one of them, with a null keep_id). Of rows repeated
    with the same id and text one stays. Null text counts as empty. Rows are
    dealt to ``n_batches`` arriving batches by a hash; all are processed. Only
    id and text are read; no rows give no rows.
    """
    rows = id_text(docs, id_col, text_col).select("doc_id", normalised(F.col("text")).alias("norm"))
    rows = rows.select("doc_id", "norm", F.xxhash64("norm").alias("digest"), F.sha2(F.col("norm").cast("binary"), 256).alias("sha"))
    arrives = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(n_batches))
    measures = stored(rows.select("doc_id", "sha"), "digests")
    n_buckets = max(1, -(-measures.count() // (n_batches * digests_per_filter)))
    snapshots: list[Snapshot] = []
    for b in range(n_batches):
        batch = rows.filter(arrives == b).select("doc_id", "digest", F.unhex("sha").alias("sha"), "norm")
        snapshots.append(ingest(batch, snapshots, n_buckets))
    parts = [s.groups.select("sha", "keep_id", "n").join(s.known, "sha", "left").select(
        F.coalesce("owner", "sha").alias("sha"), "keep_id", "n") for s in snapshots]
    all_parts = parts[0]
    for p in parts[1:]:
        all_parts = all_parts.unionByName(p)
    texts = stored(all_parts.groupBy("sha").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size")), "texts")
    # rows repeated with one id and text are one row with a count until the end
    counted = measures.groupBy("sha", "doc_id").agg(F.count("*").cast("int").alias("copies"))
    out = counted.select(F.unhex("sha").alias("sha"), "doc_id", "copies").join(texts, "sha")
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.select("doc_id", "keep_id", "group_size",
                      (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                      F.lower(F.hex("sha")).alias("text_sha256"))


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that ``dedup_exact`` keeps."""
    tag, sha = fresh(docs, "tag"), fresh(docs, "sha")
    decided = dedup_exact(docs, id_col=id_col, text_col=text_col, **options)
    decided = decided.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("~null")).alias(tag), F.col("text_sha256").alias(sha), "kept")
    own = normalised(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    rows = docs.withColumns({tag: F.coalesce(docs[id_col].cast("string"), F.lit("~null")), sha: F.sha2(own.cast("binary"), 256)})
    return apply_decisions(rows, decided, [tag, sha]).select(*docs.columns)

"""The paths that large tables take (no broadcasts), very long texts, and odd tables for the pipeline as a whole."""

import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nextbuy.llm import common, decontaminate, exact_dedup, licenses, minhash, pii, sharding, suffix_dedup
from nextbuy.llm.decontaminate import contamination, drop_contaminated
from nextbuy.llm.exact_dedup import dedup_exact, keep_unique
from nextbuy.llm.minhash import keep_one_of_near, near_duplicates
from nextbuy.llm.pii import replace_pii
from nextbuy.llm.sharding import shard_by_bytes
from nextbuy.llm.suffix_dedup import remove_repeats

from . import plain


def bag(df):
    return Counter(str(r) for r in df.collect())


ITEMS = [(1, "a shared line of some length and one more word for a test item of enough tokens here"), (2, "one"), (3, None)]


def test_without_broadcasts(spark, docs, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    some = docs.withColumn("text", F.concat_ws(" ", "text", F.when(F.col("doc_id") % 9 == 0, F.lit(ITEMS[0][1])),
                                               F.when(F.col("doc_id") % 7 == 0, F.lit("Mr. John Smith 10.1.2.3")))).cache()
    forms = [lambda: remove_repeats(some, length=40, seed=12), lambda: replace_pii(some, key="k"), lambda: dedup_exact(some), lambda: contamination(some, items),
             lambda: near_duplicates(some), lambda: keep_unique(some).select("doc_id", "text"), lambda: keep_one_of_near(some).select("doc_id", "text"),
             lambda: drop_contaminated(some, items).select("doc_id", "text")]
    want = [bag(f()) for f in forms]
    for module in (common, decontaminate, exact_dedup, licenses, minhash, pii, sharding, suffix_dedup):
        if hasattr(module, "fits_broadcast"):
            monkeypatch.setattr(module, "fits_broadcast", lambda df, n: False)
    assert [bag(f()) for f in forms] == want


def test_very_long_texts(spark):
    words = [f"w{i * 7919 % 200_003}" for i in range(150_000)]
    long = " ".join(words)                                     # about a megabyte
    near = " ".join([*words[:70_000], "changed", *words[70_001:]])
    other = " ".join(f"v{i}" for i in range(150_000))
    item = " ".join(words[100_000:100_020])
    rows = [(1, long), (2, near), (3, other), (4, long + " "), (5, "short"), (6, long.replace(" ", "  ")), (7, "x" * 1_000_000)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in dedup_exact(d).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (3, 1), 4: (4, 1), 5: (5, 1), 6: (1, 2), 7: (7, 1)}
    assert {r.doc_id: r.component_id for r in near_duplicates(d).collect()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 1, 7: 7}
    found = {r.doc_id: r.n_items for r in contamination(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 0, 4: 1, 5: 0, 6: 1, 7: 0}
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in shard_by_bytes(d, n_shards=3).collect()}
    assert sizes == {i: (len(t) + 16, plain.crc(t.encode())) for i, t in rows}
    two = spark.createDataFrame([rows[0], rows[2], (8, "y" * 300 + long[5000:9000])], "doc_id long, text string")
    kept = {r.doc_id: (r.n_bytes, [(s.start, s.end) for s in r.spans]) for r in remove_repeats(two, length=200).collect()}
    assert kept == {1: (len(long), [(5000, 9000)]), 3: (len(other), []), 8: (4300, kept[8][1])}
    assert kept[8][1][-1][1] == 4300


@pytest.fixture
def tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    return tmp_path


def replace(spark, folder, name, change):
    df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    (folder / f"{name}.parquet").unlink()
    change(df).write.parquet(str(folder / f"{name}.parquet"))


def test_pipeline_on_empty_tables(spark, tables):
    replace(spark, tables, "documents", lambda d: d.limit(0))
    assert corpus_pipeline.run(spark, str(tables)).count() == 0
    for name in ("labels", "benchmark"):
        replace(spark, tables, name, lambda d: d.limit(0))
    assert corpus_pipeline.run(spark, str(tables)).count() == 0


def test_pipeline_without_labels_and_items(spark, tables):
    """Without labels every score is 0.5 and nothing is rejected; without items nothing is contaminated."""
    for name in ("labels", "benchmark"):
        replace(spark, tables, name, lambda d: d.limit(0))
    docs = spark.read.parquet(str(tables / "documents.parquet"))
    unique = keep_one_of_near(keep_unique(docs), words=5, percent=80)
    got = corpus_pipeline.run(spark, str(tables))
    assert {r.doc_id for r in got.select("doc_id").collect()} == {r.doc_id for r in unique.select("doc_id").collect()}


def test_pipeline_on_nulls_and_extra_columns(spark, tables):
    extra = "named as the operators' own columns"

    def change(d):
        odd = spark.createDataFrame([(None, "a text without an id"), (900_001, None), (900_002, ""), (900_003, "  \n"), (900_004, None)], "doc_id long, text string")
        odd = odd.unionByName(d.limit(3).select("doc_id", "text"))  # repeated rows
        return d.unionByName(odd, allowMissingColumns=True).withColumns({c: F.lit(extra) for c in ("score", "k1", "sha", "tag", "n_kept", "place", "batch")})

    replace(spark, tables, "documents", change)
    replace(spark, tables, "labels", lambda d: d.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, None)], d.schema)))
    replace(spark, tables, "benchmark", lambda d: d.unionByName(spark.createDataFrame([(None, "x"), (9, None)], d.schema)))
    got = corpus_pipeline.run(spark, str(tables)).collect()
    ids = Counter(r.doc_id for r in got if r.piece == 0)
    assert max(ids.values()) == 1 and len(ids) > 20
    assert sum(i in ids for i in (900_001, 900_002, 900_003, 900_004)) <= 2  # empty texts: one of each normalised form at most
    docs = spark.read.parquet(str(tables / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, str(tables)), f"test-{name}")
        assert docs.columns == spark.read.parquet(str(tables / "documents.parquet")).columns

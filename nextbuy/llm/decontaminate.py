"""Benchmark decontamination with spaced seeds (operator 7).

Tokens are runs of letters and digits, lower-cased. Three fixed masks select
six token positions each and ignore those between, so a passage that differs
in substituted tokens still agrees with its source under some mask:

1. *Hash.* At each position of each test item and each document the selected
   tokens of every mask are hashed. The masks are made of neighbouring pairs, whose
   hashes are combined once and shared.
2. *Join.* Test and training hashes are joined; a hit is (document, item,
   diagonal), the diagonal being the document position minus the item position.
   Hits are made distinct, first in the map tasks.
3. *Verify.* The item is laid along the diagonal of each hit, token by token.
   A document is contaminated by an item when, in some window of ``WINDOW``
   tokens of the item, at most ``MISSES`` tokens differ. Items shorter
   than a window count as a whole, with at most one token that differs.

The masks find every such window: whichever two tokens of 14 (or one of 8 or more)
are substituted, some mask fits beside them (a test tries all). Items of fewer
than eight tokens have an exact path: a document is contaminated by such an item when
its tokens are all tokens of one of the document's lines, or of the whole document.
Within a longer line they are no evidence of copying.

Test items are few beside the corpus, but nothing relies on it: their hashes
and the hits are broadcast only when proven to be within ``BROADCAST_ROWS``;
otherwise they join by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, fits_broadcast, id_text, keyed, stored, with_row_key

#: The token positions each mask selects. Fixed, the same for items and documents.
MASKS = [(0, 1, 2, 3, 4, 5), (0, 1, 4, 5, 6, 7), (0, 1, 2, 3, 6, 7)]
SHORTEST = 8
WINDOW, MISSES = 14, 2
BROADCAST_ROWS = 500_000


def token_hashes(text: Column) -> Column:
    """64-bit hashes of the tokens of a text."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _from(a: Column | str, k: int) -> Column:
    """The array from its k-th element on."""
    return F.slice(a, F.lit(k + 1), F.greatest(F.size(a) - k, F.lit(0)))


def _paired(a: Column | str, b: Column | str, k: int, salt: int) -> Column:
    """At each position i: a hash of a[i] and b[i + k]; positions without b[i + k] get a null, dropped later."""
    return F.zip_with(a, _from(b, k), lambda x, y: F.when(x.isNotNull() & y.isNotNull(), F.xxhash64(F.lit(salt), x, y)))


def _seeds(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns with (seed, pos) for each mask at each position; ``rows`` has ``h``, the token hashes."""
    s = rows.select(*keep, "h", _paired("h", "h", 1, 1).alias("two"))
    s = s.select(*keep, "two", _paired("two", "two", 2, 2).alias("four"))
    masks = [_paired("four", "two", 4, 11), _paired("two", "four", 4, 12), _paired("four", "two", 6, 13)]
    s = s.select(*keep, *[m.alias(f"m{i}") for i, m in enumerate(masks)])
    s = s.select(*keep, F.size("m0").alias("n0"), F.size("m1").alias("n1"), F.posexplode(F.concat("m0", "m1", "m2")).alias("at", "seed"))
    at, n0, n1 = F.col("at"), F.col("n0"), F.col("n1")
    pos = F.when(at < n0, at).when(at < n0 + n1, at - n0).otherwise(at - n0 - n1)
    return s.filter(F.col("seed").isNotNull()).select(*keep, "seed", pos.alias("pos"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df, BROADCAST_ROWS) else df


def searched_items(items: DataFrame, id_col: str, text_col: str, short: bool = False) -> DataFrame:
    """(item, item_id, h): the items long enough for the masks, or the short ones; items repeated with the same id and text are one."""
    rows = id_text(items, id_col, text_col).select(F.col("doc_id").alias("item_id"), "text")
    rows = rows.withColumn("item", F.xxhash64(F.coalesce(F.col("item_id").cast("string"), F.lit("~null")), "text")).dropDuplicates(["item"])
    rows = rows.select("item", "item_id", token_hashes(F.col("text")).alias("h"))
    return rows.filter(F.size("h").between(1, SHORTEST - 1) if short else F.size("h") >= SHORTEST)


def find_short(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """(k1, k2, item, item_id, agree) of keyed documents with a line, or as a whole, equal in tokens to a short item; None without such items."""
    items = stored(items, "short-items")
    if items.isEmpty():
        return None
    lines = F.transform(F.split("text", r"[\n\r]+", -1), token_hashes)
    passages = F.array_distinct(F.filter(F.concat(F.array(token_hashes(F.col("text"))), lines), lambda h: F.size(h).between(1, SHORTEST - 1)))
    found = docs.select(*KEY, F.explode(passages).alias("h")).join(_small(items), "h")
    return found.select(*KEY, "item", "item_id", F.size("h").alias("agree"))


def _found(docs: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, item, item_id, agree) of items of any length."""
    found = find_overlaps(docs, searched_items(items, id_col, text_col)).select(*KEY, "item", "item_id", "agree")
    short = find_short(docs, searched_items(items, id_col, text_col, short=True))
    return found if short is None else found.unionByName(short)


def find_overlaps(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(k1, k2, item, item_id, diagonal, agree, n_item): the verified overlaps of keyed documents with ``searched_items``."""
    items = stored(items, "items")
    tokens = docs.select(*KEY, token_hashes(F.col("text")).alias("h"))
    theirs = _seeds(items.select("item", "h"), ["item"]).select("seed", "item", F.col("pos").alias("item_pos"))
    hits = _seeds(tokens, KEY).join(_small(stored(theirs, "item-seeds")), "seed")
    hits = hits.select(*KEY, "item", (F.col("pos") - F.col("item_pos")).alias("diagonal")).distinct()
    hits = stored(hits.join(_small(items.select("item", F.size("h").alias("n_item"))), "item"), "hits")
    per_doc = hits.groupBy(*KEY).agg(F.collect_set(F.struct("item", "diagonal", "n_item")).alias("hits"))  # a document's own
    rows = tokens.join(_small(stored(per_doc, "hits-by-document")), KEY)

    def beside(x: Column, h: Column) -> Column:
        low = F.greatest(F.lit(0), -x.diagonal)  # the part of the item that lies within the document
        n = F.greatest(F.least(x.n_item, F.size(h) - x.diagonal) - low, F.lit(0))
        return F.struct(x.item.alias("item"), x.diagonal.alias("diagonal"), x.n_item.alias("n_item"), low.alias("low"),
                        F.slice(h, x.diagonal + low + 1, n).alias("part"))

    cut = rows.select(*KEY, F.size("h").alias("n"), F.transform("hits", lambda x: beside(x, F.col("h"))).alias("cuts"))
    cut = cut.select(*KEY, F.inline("cuts")).join(_small(items.select("item", "item_id", "h")), "item")
    agree = F.zip_with("part", F.slice("h", F.col("low") + 1, F.size("part")), lambda a, b: (a == b).cast("int"))
    cut = cut.select(*KEY, "item", "item_id", "diagonal", "n_item", agree.alias("agrees"))
    width = F.least(F.col("n_item"), F.lit(WINDOW))
    starts = F.when(F.size("agrees") >= width, F.sequence(F.lit(1), F.size("agrees") - width + 1)).otherwise(F.array().cast("array<int>"))
    best = F.array_max(F.transform(starts, lambda i: F.aggregate(F.slice("agrees", i, width), F.lit(0), lambda s, x: s + x)))
    need = F.when(F.col("n_item") >= WINDOW, F.lit(WINDOW - MISSES)).otherwise(F.col("n_item") - 1)
    total = F.aggregate("agrees", F.lit(0), lambda s, x: s + x)
    return cut.select(*KEY, "item", "item_id", "diagonal", "n_item", total.alias("agree"), best.alias("best"), need.alias("need")).filter("best >= need")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """(doc_id, contaminated, n_items, max_agree, first_item) of every row.

    n_items counts the test items found in the document, max_agree is the most
    tokens that agree along one diagonal, first_item the least id of those
    items (null if there is none). Null or empty texts, and empty tables, have no
    overlaps; repeated rows get the same result each. Only ids and texts are read.
    """
    docs = keyed(docs, id_col, text_col)
    found = _found(docs, items, item_id_col, item_text_col)
    per_doc = found.groupBy(*KEY).agg(F.count_distinct("item").alias("n_items"), F.max("agree").alias("max_agree"), F.min("item_id").alias("first_item"))
    out = docs.select(*KEY, "doc_id").join(_small(stored(per_doc, "contaminated")), KEY, "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"),
                      F.coalesce("max_agree", F.lit(0)).alias("max_agree"), "first_item")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
                      item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without a verified overlap with a test item."""
    rows, keys = with_row_key(docs, id_col, text_col)
    found = _found(keyed(docs, id_col, text_col), items, item_id_col, item_text_col)
    found = stored(found.select(F.col("k1").alias(keys[0]), F.col("k2").alias(keys[1])).distinct(), "contaminated")
    return rows.join(_small(found), keys, "left_anti").select(*docs.columns)

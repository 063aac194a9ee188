"""URL allow/block rules answered by Bloom filter cascades (operator 10).

A rule is (verdict, host, path). It fits its host and all subdomains when the
URL's path starts with the rule's path; of the rules that fit, the longest
wins. Every URL has a bounded set of *candidate keys* (host suffix + path
prefix) for the label counts and path lengths that occur among the rules; a
rule fits exactly when its key (host + path) is one of them.

For each verdict a cascade of Bloom filters is built over the corpus's
complete key universe (all candidate keys of all URLs):

* level 1 holds the listed keys; every key of the universe that level 1 takes
  by mistake goes to level 2; listed keys that level 2 takes go to level 3; ...
* building stops when a level takes no key by mistake, so the cascade answers
  every key of the universe exactly.

A key is looked up from level 1 on until a level says no: stopped at an even
level (or beyond an odd last one) it is listed. The levels are bit arrays of
known size, held as literals in the plan: pages are scanned once for the
universe and once for the verdicts, without any join. A level may grow to
``max_level_bytes``; beyond that the operator raises, it never approximates.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: Fixed by the task: (verdict, host, path).
TASK_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?>.*?://)[^/?#]*+(/[^?#]*)", 1)  # atomic: never on to a later ://


def rule_rows(rules: DataFrame) -> DataFrame:
    """(verdict, host, path) of the usable rules: host A-Z lower-cased, neither host nor path empty or null."""
    rows = rules.select("verdict", ascii_lower(F.col("host").cast("string")).alias("host"), F.col("path").cast("string").alias("path"))
    return rows.filter(F.col("verdict").isin("allow", "block") & (F.col("host") != "") & (F.col("path") != "")).distinct()


def rule_shapes(rules: DataFrame) -> tuple[list[int], list[int]]:
    """The label counts of the rules' hosts and the lengths of their paths: what a URL's candidate keys are cut by."""
    r = rules.agg(F.array_sort(F.collect_set(F.size(F.split("host", r"\.")))).alias("depths"), F.array_sort(F.collect_set(F.char_length("path"))).alias("lengths")).first()
    return list(r.depths), list(r.lengths)


def candidate_keys(host: Column, path: Column, depths: list[int], lengths: list[int]) -> Column:
    """The keys (host suffix + path prefix) under which a rule that fits can be listed, longest first."""
    keys = [F.concat(F.substring_index(host, ".", -d), F.substring(path, 1, n)) for d in depths for n in lengths]
    listed = F.array_distinct(F.array(*keys))
    usable = F.when((host == "") | (path == ""), F.array().cast("array<string>")).otherwise(listed)
    return F.array_sort(usable, lambda a, b: F.when(F.char_length(a) != F.char_length(b), F.char_length(b) - F.char_length(a))
                        .when(a < b, -1).when(a > b, 1).otherwise(0))


class BloomLevel:
    """One filter: ``bits`` positions in blocks of 32,768, as built by Spark's bitmap aggregates."""

    def __init__(self, seed: int, n_bits: int, n_hashes: int, blocks: dict[int, bytes]):
        self.seed, self.n_bits, self.n_hashes, self.blocks = seed, n_bits, n_hashes, blocks

    @staticmethod
    def positions(key: Column, seed: int, n_bits: int, n_hashes: int) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(seed), F.lit(i), key), F.lit(n_bits)) for i in range(n_hashes)]

    @classmethod
    def build(cls, keys: DataFrame, n_keys: int, seed: int, fpp_bits: int, max_bytes: int) -> BloomLevel:
        """``fpp_bits`` hash functions: about one key in 2**fpp_bits is taken by mistake."""
        n_bits = max(64, int(n_keys * fpp_bits * 1.45) + 1)
        if n_bits // 8 > max_bytes:
            raise ValueError(f"a level of {n_bits // 8} bytes exceeds max_level_bytes={max_bytes}")
        pos = keys.select(F.explode(F.array(*cls.positions(F.col("key"), seed, n_bits, fpp_bits))).alias("p"))
        maps = pos.groupBy(F.floor(F.col("p") / 32768).alias("block")).agg(
            F.bitmap_construct_agg(F.pmod(F.col("p"), F.lit(32768))).alias("bits")).collect()  # n_bits / 8 bytes, checked
        return cls(seed, n_bits, fpp_bits, {int(r.block): bytes(r.bits) for r in maps})

    def takes(self, key: Column) -> Column:
        """True if all of the key's bits are set (JVM expressions on a literal bit array)."""
        size = -(-self.n_bits // 32768) * 4096
        flat = bytearray(size)
        for b, bits in self.blocks.items():
            flat[b * 4096:b * 4096 + len(bits)] = bits
        flat = bytes(flat[:-(-self.n_bits // 8)])
        out = F.lit(True)
        for p in self.positions(key, self.seed, self.n_bits, self.n_hashes):
            byte = F.conv(F.hex(F.substring(F.lit(flat), (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            out = out & (F.getbit(byte, F.pmod(p, F.lit(8)).cast("int")) == 1)
        return out


class BloomCascade:
    """Exact membership of the listed keys over a stated key universe."""

    def __init__(self, levels: list[BloomLevel]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, seed: int = 1, first_bits: int = 10, next_bits: int = 2,
              max_levels: int = 64, max_level_bytes: int = 16 << 20) -> BloomCascade:
        """``listed`` and ``universe`` have one column ``key`` of distinct non-null keys.

        Nothing but counts and the bit arrays reaches the driver. Each level's
        wrongly taken keys are written to the shared folder.
        """
        levels: list[BloomLevel] = []
        inside = listed.select("key")
        outside = stored(universe.join(listed, "key", "left_anti"), "universe")
        for i in range(max_levels):
            n = inside.count()
            if n == 0:
                break
            levels.append(BloomLevel.build(inside, n, seed * 1000 + i, first_bits if i == 0 else next_bits, max_level_bytes))
            wrong = stored(outside.filter(levels[-1].takes(F.col("key"))), "taken")
            inside, outside = wrong, inside
        else:
            raise ValueError(f"no exact cascade within {max_levels} levels")
        return cls(levels)

    def lists(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)  # taken by all levels
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].takes(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def url_verdicts(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]] = TASK_RULES, default: str = "allow",
                 id_col: str = "page_id", url_col: str = "url", **cascade) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    ``rules``: a table with columns verdict, host and path, of any size up to what a level may hold, or a list of such rows.
    Null URLs, and URLs without ``://``, have an empty host and path; no rule
    fits an empty host or path, so they get ``default`` with a null rule.
    Repeated rows give repeated results; other input columns are not read. A
    key listed with both verdicts is blocked. No rules, or no pages: every
    page gets ``default``, or no rows.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    rules = stored(rule_rows(rules), "rules")
    urls = pages.select(pages[id_col].alias("page_id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    depths, lengths = rule_shapes(rules)
    if not depths:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keys = candidate_keys(F.col("host"), F.col("path"), depths, lengths)
    universe = stored(urls.select(F.explode(keys).alias("key")).distinct(), "keys")
    is_listed = {}
    for n, verdict in enumerate(("block", "allow")):
        listed = rules.filter(F.col("verdict") == verdict).select(F.concat("host", "path").alias("key")).distinct()
        is_listed[verdict] = BloomCascade.build(listed, universe, seed=n + 1, **cascade).lists
    # keys are sorted by length: the first listed one is the longest rule that fits
    blocked = lambda k: is_listed["block"](k)
    found = F.transform(keys, lambda k: F.when(blocked(k), F.struct(k.alias("rule"), F.lit("block").alias("verdict")))
                        .when(is_listed["allow"](k), F.struct(k.alias("rule"), F.lit("allow").alias("verdict"))))
    best = urls.withColumn("best", F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0)))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                       F.coalesce("best.verdict", F.lit(default)).alias("verdict"))

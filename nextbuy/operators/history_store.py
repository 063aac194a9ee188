"""Stored histories that grow by a month at a time, and histories cut at several months.

A store is a table bucketed by customer: every customer's observed months in order
(month, calendar month, products) and the attributes of the last one, all unscaled, plus
the moments of the standardised columns by month. A new month is merged into it bucket by
bucket: its rows are exchanged once, the stored rows not at all. Training and
test sets then come from the store alone: standardisation and time scaling are literals
applied to the stored arrays, so the result is that of building all months anew.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ATTR_COLS, Y_COLS, ZSCORE_COLS
from ..functions.clean import clamp_negative
from ..functions.scale import circular_month, time_fraction, zscore
from ..session import shared_output_dir
from ..sources.storage import store_rows
from .sequence import length_filter

_CLAMPED = "seniority"


def _moments(rows: DataFrame, cols=ZSCORE_COLS) -> list[tuple]:
    """(t, column, n, mean, m2) by month, of the columns and of clamped seniority; a few rows a month."""
    own = {c: F.col(c).cast("double") for c in cols if c in rows.columns}
    if _CLAMPED in own:
        own[f"{_CLAMPED}+"] = clamp_negative(_CLAMPED).cast("double")
    if not own:
        return [(r.t, "", 0, 0.0, 0.0) for r in rows.select("t").distinct().collect()]
    aggs = [a for c, e in own.items() for a in (F.count(e).alias(f"n {c}"), F.avg(e).alias(f"m {c}"), F.var_pop(e).alias(f"v {c}"))]
    got = rows.groupBy("t").agg(*aggs).collect()  # one row a month
    return [(r["t"], c, r[f"n {c}"], r[f"m {c}"] or 0.0, (r[f"v {c}"] or 0.0) * r[f"n {c}"]) for r in got for c in own]


def merged_stats(moments: list[tuple], month: int, clamped: bool) -> dict[str, tuple]:
    """{column: (mean, sample deviation)} of all months up to ``month``, from the months' moments."""
    out = {}
    for c in sorted({m[1].rstrip("+") for m in moments if m[1]}):
        n, mean, m2 = 0, 0.0, 0.0
        for t, name, k, own, spread in sorted(moments):
            if t <= month and k and name == (f"{c}+" if c == _CLAMPED and clamped else c):
                shift, total = own - mean, n + k
                m2 += spread + shift * shift * n * k / total
                mean += shift * k / total
                n = total
        out[c] = (mean if n else None, math.sqrt(m2 / (n - 1)) if n > 1 else None)
    return out


def _attrs(attr_cols, present) -> Column:
    return F.array(*[(F.col(c) if c in present else F.lit(None)).cast("double") for c in attr_cols]) if attr_cols else F.array().cast("array<double>")


def _step(ys) -> Column:
    return F.struct(F.col("t").cast("int").alias("t"), F.col("t_month").cast("int").alias("t_month"), F.array(*[F.col(c).cast("int") for c in ys]).alias("y"))


def shaped(rows: DataFrame, month: int, stats: dict, attr_cols, scale_time: bool = True, include_time: bool = True, keep=()) -> DataFrame:
    """History rows (``keep``, id, n_obs, t_max, attrs, x, y, y_last) of rows with ``steps`` and the raw ``last`` attributes.

    Steps before the last are the history; time is scaled by ``month``, the attributes standardised with ``stats``.
    """
    t_of = (lambda t: time_fraction(t, month)) if scale_time else (lambda t: t.cast("double"))
    month_of = (lambda m: circular_month(m, month)) if scale_time else (lambda m: m.cast("double"))

    def attr(i: int, c: str) -> Column:
        v = F.get("last", i)
        if c in ("t", "t_month"):
            return (t_of if c == "t" else month_of)(v)
        v = clamp_negative(v) if c == _CLAMPED else v
        return zscore(v, *stats[c]) if c in stats else v

    n = F.size("steps")
    channels = lambda s: F.concat(F.array(t_of(s.t), month_of(s.t_month)) if include_time else F.array().cast("array<double>"),
                                  s.y.cast("array<double>"))
    x = F.transform(F.slice("steps", 1, F.greatest(n - 1, F.lit(0))), channels)
    return rows.select(*keep, "id", n.cast("long").alias("n_obs"), F.element_at("steps", -1)["t"].alias("t_max"),
                       (F.array(*[attr(i, c) for i, c in enumerate(attr_cols)]) if attr_cols else F.array().cast("array<double>")).alias("attrs"),
                       x.alias("x"), F.element_at("steps", -1)["y"].alias("y"), F.when(n >= 2, F.get("steps", n - 2)["y"]).alias("y_last"))


@dataclass(frozen=True)
class HistoryStore:
    table: str
    buckets: int
    attr_cols: tuple
    ys: tuple
    moments: tuple
    name: str
    root: str

    @classmethod
    def build(cls, rows: DataFrame, name: str, attr_cols=ATTR_COLS, ys=Y_COLS, buckets: int | None = None, root: str | None = None,
              dealt: bool = False) -> HistoryStore:
        """Collect all rows (id, t, t_month, attributes, products; (id, t) unique) into a new store.

        ``dealt``: the rows come from a table bucketed by id into as many buckets, so they are not exchanged.
        """
        spark = rows.sparkSession
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        root = root or shared_output_dir(spark, f"histories/{name}-{uuid.uuid4().hex[:12]}")
        store = cls("", buckets, tuple(attr_cols), tuple(ys), tuple(_moments(rows)), name, root)
        g = (rows if dealt else rows.repartition(buckets, "id")).groupBy("id").agg(
            F.array_sort(F.collect_list(_step(ys))).alias("steps"), F.max_by(_attrs(attr_cols, rows.columns), F.col("t")).alias("last"))
        return store._written(g)

    def _written(self, rows: DataFrame, moments: tuple | None = None) -> HistoryStore:
        """A new version of the table; ``rows`` are already dealt by id to as many tasks as there are buckets."""
        table = f"nextbuy_{self.name}_{uuid.uuid4().hex[:12]}"
        rows.write.format("parquet").option("path", f"{self.root}/{table}").bucketBy(self.buckets, "id").sortBy("id").saveAsTable(table)
        return replace(self, table=table, moments=self.moments if moments is None else moments)

    def rows(self, spark: SparkSession) -> DataFrame:
        """(id, steps, last) of every customer, bucketed by id."""
        return spark.table(self.table)

    @property
    def last_month(self) -> int | None:
        return max((m[0] for m in self.moments), default=None)

    def merged(self, new: DataFrame) -> DataFrame:
        """The stored rows with the rows of ``new`` appended: only ``new`` is exchanged."""
        g = new.repartition(self.buckets, "id").groupBy("id").agg(
            F.array_sort(F.collect_list(_step(self.ys))).alias("more"), F.max_by(_attrs(self.attr_cols, new.columns), F.col("t")).alias("latest"))
        both = self.rows(new.sparkSession).join(g, "id", "full")
        empty = F.slice(F.coalesce("more", "steps"), 1, 0)
        return both.select("id", F.concat(F.coalesce("steps", empty), F.coalesce("more", empty)).alias("steps"),
                           F.when(F.col("latest").isNotNull(), F.col("latest")).otherwise(F.col("last")).alias("last"))

    def append(self, new: DataFrame) -> HistoryStore:
        """A version of the store with the rows of later months appended (new customers included). Earlier months are an error."""
        moments = _moments(new)
        early = [m[0] for m in moments if self.last_month is not None and m[0] <= self.last_month]
        if early:
            raise ValueError(f"month {min(early)} is not after the stored month {self.last_month}")
        return self._written(self.merged(new), (*self.moments, *moments))

    def training(self, spark: SparkSession, scale_time: bool = True, include_time: bool = True, min_len: int = 2, max_len: int | None = None) -> DataFrame:
        """Training histories up to the last stored month, as ``sequence.build_train`` gives them."""
        month = self.last_month
        h = shaped(self.rows(spark), month, merged_stats(self.moments, month, clamped=True), self.attr_cols, scale_time, include_time)
        return length_filter(h, min_len, max_len)

    def testing(self, spark: SparkSession, train_month: int, scale_time: bool = True, include_time: bool = True, min_len: int = 2) -> DataFrame:
        """Test histories of the customers of the last stored month, as ``sequence.build_test`` gives them (statistics up to ``train_month``)."""
        month = self.last_month
        own = self.rows(spark).filter(F.element_at("steps", -1)["t"] == month)
        h = shaped(own, month - 1, merged_stats(self.moments, min(train_month, month - 1), clamped=False), self.attr_cols, scale_time, include_time)
        return length_filter(h, min_len)

    def scoring(self, target: DataFrame, train_month: int, scale_time: bool = True, include_time: bool = True, min_len: int = 2) -> DataFrame:
        """Test histories of the customers of ``target``, rows of one later month, as ``sequence.build_test`` gives them.

        ``target`` may lack products (y is then null). Stored rows are not exchanged.
        """
        spark = target.sparkSession
        months = [r.t for r in target.select("t").distinct().limit(2).collect()]
        if not months:
            return shaped(self.rows(spark).limit(0), 2, {}, self.attr_cols, scale_time, include_time)
        if len(months) > 1 or (self.last_month is not None and months[0] <= self.last_month):
            raise ValueError(f"the rows to score are of months {months}; one month after {self.last_month} is wanted")
        month, has_y = months[0], all(c in target.columns for c in self.ys)
        own = _step(self.ys) if has_y else F.struct(F.col("t").cast("int").alias("t"), F.col("t_month").cast("int").alias("t_month"),
                                                    F.lit(None).cast("array<int>").alias("y"))
        new = target.select("id", own.alias("step"), _attrs(self.attr_cols, target.columns).alias("latest")).repartition(self.buckets, "id")
        both = new.join(self.rows(spark).select("id", "steps"), "id", "left")
        rows = both.select("id", F.concat(F.coalesce("steps", F.slice(F.array("step"), 1, 0)), F.array("step")).alias("steps"), F.col("latest").alias("last"))
        stats = merged_stats(self.moments, min(train_month, month - 1), clamped=False)
        return length_filter(shaped(rows, month - 1, stats, self.attr_cols, scale_time, include_time), min_len)

    def state(self) -> dict:
        """What ``reopen`` needs besides the table's files."""
        return {"table": self.table, "buckets": self.buckets, "attr_cols": list(self.attr_cols), "ys": list(self.ys),
                "moments": [list(m) for m in self.moments], "name": self.name, "root": self.root}

    @classmethod
    def reopen(cls, spark: SparkSession, state: dict) -> HistoryStore:
        """A store from its state: the table is registered anew over its files, bucketing included."""
        store = cls(state["table"], state["buckets"], tuple(state["attr_cols"]), tuple(state["ys"]), tuple(tuple(m) for m in state["moments"]), state["name"], state["root"])
        if not spark.catalog.tableExists(store.table):
            place = f"{store.root}/{store.table}"
            ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(place).schema.fields)
            spark.sql(f"CREATE TABLE {store.table} ({ddl}) USING parquet CLUSTERED BY (id) SORTED BY (id) INTO {store.buckets} BUCKETS LOCATION '{place}'")
        return store

    def drop(self, spark: SparkSession) -> None:
        """Forget this version's table (its files stay below the store's folder)."""
        spark.sql(f"DROP TABLE IF EXISTS {self.table}")


# --- several months at once ----------------------------------------------------------------------

def timelines(rows: DataFrame, pairs, attr_cols=ATTR_COLS, ys=Y_COLS) -> DataFrame:
    """(id, steps, train_<month>.., test_<month>..): every observed month in order, and for each (train month, test month) the raw attributes of the last
    row up to the train month and of the test month's row, null without one: one exchange, then the histories of each pair are cut from the array.
    """
    at = F.struct(F.col("t").cast("int").alias("t"), _step(ys).alias("step"), _attrs(attr_cols, rows.columns).alias("last"))
    trains, tests = sorted({p[0] for p in pairs}), sorted({p[1] for p in pairs})
    own = {**{f"train_{m}": F.col("t") <= m for m in trains}, **{f"test_{m}": F.col("t") == m for m in tests}}
    g = rows.groupBy("id").agg(F.array_sort(F.collect_list(_step(ys))).alias("steps"), *[F.max(F.when(c, at)).alias(k) for k, c in own.items()])
    return g.select("id", "steps", *[F.col(f"{k}.last").alias(k) for k in own])


def _cut(lines: DataFrame, attrs: str, upto: int) -> DataFrame:
    """(id, steps up to a month, last) of the customers that have the attributes named ``attrs``."""
    own = F.filter("steps", lambda s: s.t <= upto)
    return lines.filter(F.col(attrs).isNotNull()).select("id", own.alias("steps"), F.col(attrs).alias("last"))


def rolling_sets(rows: DataFrame, pairs: list[tuple[int, int]], attr_cols=ATTR_COLS, ys=Y_COLS, scale_time: bool = True,
                 include_time: bool = True) -> dict[tuple[int, int], tuple[DataFrame, DataFrame]]:
    """{(train month, test month): (training histories, test histories)}, all cut from one stored scan.

    Each equals what ``build_train`` up to the train month and ``build_test`` give on their own.
    """
    lines = store_rows(timelines(rows, pairs, attr_cols, ys), "timelines")
    moments = _moments(rows)
    out = {}
    for train_month, test_month in pairs:
        if test_month < 2:
            raise ValueError("test_month must be at least 2")
        train = shaped(_cut(lines, f"train_{train_month}", train_month), train_month, merged_stats(moments, train_month, clamped=True), attr_cols, scale_time, include_time)
        own = _cut(lines, f"test_{test_month}", test_month)
        stats = merged_stats(moments, min(train_month, test_month - 1), clamped=False)
        test = shaped(own, test_month - 1, stats, attr_cols, scale_time, include_time)
        out[train_month, test_month] = (length_filter(train), length_filter(test))
    return out

"""Quality classifier: hashed word n-grams, FTRL logistic regression (operator 3).

Features are token n-grams (n = 1, 2) hashed to ``2**bits`` weights. Tokens are
runs of word bytes or of punctuation; a token repeated next to itself gives the
same "repeat" 2-gram whatever the token is. A document's feature vector is its n-gram
counts divided by their number, times ``scale``.

Training takes at most about ``max_train_rows`` labelled rows (chosen by the
hash of the id; a documented bound). Rows are dealt to ``shards`` tasks; each
runs follow-the-regularised-leader (FTRL-Proximal) over its own rows, in a
fixed order, ``epochs`` times; the shards' weights are averaged. A shard sends
one vector of fixed size to the driver.

Scoring is one map over the documents: a sparse dot product of the hashed
counts with the weights (gathered and summed per document), then the sigmoid.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, id_text
from .textnp import WORDS_AND_MARKS, doc_blocks, long_tokens, mix, utf8

_REPEAT = np.uint64(0x5851F42D4C957F2D)


def ngrams(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature, document) of every token 1-gram and 2-gram of a block of documents."""
    h, doc = long_tokens(data, off, WORDS_AND_MARKS, lower=False)
    two = np.where(h[1:] == h[:-1], _REPEAT, mix(h[:-1] * np.uint64(3) + h[1:]))[doc[1:] == doc[:-1]]
    two_doc = doc[1:][doc[1:] == doc[:-1]]
    feature = np.concatenate([mix(h + np.uint64(1)), mix(two + np.uint64(2))]) >> np.uint64(64 - bits)
    return feature.astype(np.int64), np.concatenate([doc, two_doc])


@dataclass
class Ftrl:
    """FTRL-Proximal for logistic loss: per-coordinate rates, L1 and L2."""

    size: int
    alpha: float
    beta: float
    l1: float
    l2: float

    def __post_init__(self):
        self.z, self.n = np.zeros(self.size + 1), np.zeros(self.size + 1)  # the last is the bias

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - rate * w
        self.n[at] += g * g


@dataclass
class QualityModel:
    weights: np.ndarray  # 2**bits + 1 floats
    bits: int
    scale: float

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, score) of every row; a null or empty text gets the bias alone. Only id and text are read."""
        rows = id_text(docs, id_col, text_col)
        schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])
        return rows.mapInArrow(self._scorer(1, ["doc_id", "score"]), schema)

    def add_score(self, docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
        """All rows and columns of ``docs`` and the score as the column ``name``."""
        return docs.mapInArrow(self._scorer(docs.columns.index(text_col), [*docs.columns, name]),
                               T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))

    def _scorer(self, text_at: int, names: list[str]):
        weights, bits, scale = self.weights, self.bits, self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = score_column(batch.column(text_at), weights, bits, scale)
                yield pa.RecordBatch.from_arrays([*batch.columns[:len(names) - 1], pa.array(scores)], names)

        return run


def score_column(texts: pa.Array, weights: np.ndarray, bits: int, scale: float) -> np.ndarray:
    off, data = utf8(texts)
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for i, j in doc_blocks(off):
        feature, doc = ngrams(data[off[i]:off[j]], off[i:j + 1] - off[i], bits)
        total[i:j] = np.bincount(doc, weights[feature], j - i)
        count[i:j] = np.bincount(doc, minlength=j - i)
    dot = weights[-1] + scale * total / np.maximum(count, 1)
    return 1 / (1 + np.exp(-np.clip(dot, -35, 35)))


def fit(rows: DataFrame, bits: int = 18, scale: float = 40.0, shards: int = 6, epochs: int = 4, alpha: float = 0.3,
        beta: float = 1.0, l1: float = 0.001, l2: float = 1.0) -> QualityModel:
    """Fit on rows of (doc_id, text, label); no rows: all weights 0 (every score 0.5)."""
    size = 1 << bits

    def learnt(examples: list) -> pd.DataFrame:
        model = Ftrl(size, alpha, beta, l1, l2)
        for _ in range(epochs):
            for e in examples:
                model.learn(*e)
        return pd.DataFrame({"n": [len(examples)], "w": [model.weights().astype(np.float32).tobytes()]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, examples = None, []
        for pdf in batches:
            off, data = utf8(pa.array(pdf["text"], pa.large_string()))
            for i, (own, label) in enumerate(zip(pdf["shard"].tolist(), pdf["label"].tolist(), strict=True)):
                if own != shard and examples:
                    yield learnt(examples)
                    examples = []
                shard = own
                feature, _ = ngrams(data[off[i]:off[i + 1]], np.array([0, off[i + 1] - off[i]]), bits)
                at, count = np.unique(feature, return_counts=True)
                examples.append((np.append(at, size), np.append(scale * count / max(1, len(feature)), 1.0), int(label)))
        if examples:
            yield learnt(examples)

    order = F.xxhash64("doc_id", "text")
    # the shards are fixed by the rows, however many partitions hold them; their names are numbers that go to different tasks
    numbers = rows.sparkSession.range(100 * shards).select("id", F.pmod(F.hash("id"), F.lit(shards)).alias("task"))
    names = sorted(r.id for r in numbers.groupBy("task").agg(F.min("id").alias("id")).collect())
    dealt = rows.withColumn("order", order)
    dealt = dealt.withColumn("shard", F.get(F.lit(names), F.pmod(F.xxhash64(F.lit(5), order), F.lit(len(names))).cast("int")).cast("long"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "order").select("shard", "text", "label")
    got = dealt.mapInPandas(learn, "n long, w binary").collect()  # at most ``shards`` vectors of fixed size
    got.sort(key=lambda r: (r.n, r.w))  # one order of summing
    total = sum(r.n for r in got)
    weights = sum((np.frombuffer(r.w, np.float32).astype(np.float64) * (r.n / total) for r in got), np.zeros(size + 1))
    return QualityModel(weights, bits, scale)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0 (a null id never is)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_train_rows: int, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality") -> DataFrame:
    """(doc_id, text, label) of labelled rows that are not held out, at most about ``max_train_rows`` of them."""
    own = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("label"))
    own = own.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    n = own.count()
    if n > max_train_rows:
        own = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * max_train_rows / n))
    return id_text(docs, id_col, text_col).join(F.broadcast(own), "doc_id")  # bounded by max_train_rows


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train_rows: int = 20_000, id_col: str = "doc_id",
              text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches the threshold (see ``classify_quality``)."""
    model = fit(training_rows(docs, labels, max_train_rows, id_col, text_col), **options)
    name = fresh(docs, "score")
    return model.add_score(docs, name, text_col).filter(F.col(name) >= threshold).drop(name)


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_train_rows: int = 20_000,
                     id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Held-out rows, and the columns other than id and text, never enter the
    model. Null and empty texts get the bias's score; repeated rows repeat.
    A label repeated for one id is used as often as it occurs.
    """
    model = fit(training_rows(docs, labels, max_train_rows, id_col, text_col), **options)
    scored = model.score(docs, id_col, text_col)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))

"""Per-row array expressions (higher-order functions, evaluated in the JVM).

A customer's 24 scores / labels live in one ``array`` column, so ranking,
AP@K and the losses are row-local: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import LOSS_EPS, NUM_PRODUCTS, PAD_VALUE, TOP_K
from .clean import _c


def as_array(cols) -> Column:
    return F.array(*[_c(c) for c in cols])


def bind(value, body) -> Column:
    """``body`` of a value that is evaluated once (inside another lambda, an expression is evaluated once an element)."""
    return F.get(F.transform(F.array(value), body), 0)


def topk_indices(scores, k: int = TOP_K) -> Column:
    """0-based indices of the k largest scores; equal scores -> lower index first.

    A null score ranks below every number.
    """
    keyed = F.transform(_c(scores), lambda v, i: F.struct(
        F.coalesce(-v.cast("double"), F.lit(float("inf"))).alias("v"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: s["i"])


def hits_at(y_true, indices) -> Column:
    """1 where the ranked index is a true label, else 0."""
    return bind(_c(y_true), lambda y: F.transform(_c(indices), lambda i: F.when(F.get(y, i) > 0, 1).otherwise(0)))


def count_true(y_true) -> Column:
    return F.size(F.filter(_c(y_true), lambda v: v > 0))


def precision_on_hits(hits) -> Column:
    """Running hit count at each rank, zeroed on misses, divided by the rank."""
    return bind(_c(hits), lambda h: F.transform(h, lambda x, j: x * F.aggregate(F.slice(h, 1, j + 1), F.lit(0), lambda a, b: a + b)
                                                / (j + 1).cast("double")))


def ap_at_k(y_true, scores, k: int = TOP_K) -> Column:
    """Average precision at k; 0 when nothing is true."""
    def of(y: Column) -> Column:
        total = F.aggregate(precision_on_hits(hits_at(y, topk_indices(scores, k))), F.lit(0.0), lambda a, b: a + b)
        return bind(count_true(y), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(total / F.least(n, F.lit(k)).cast("double")))

    return bind(_c(y_true), of)


def new_labels(y_true, y_last) -> Column:
    """clip(y_true - y_last, 0, 1): products that are new this month."""
    return F.zip_with(_c(y_true), _c(y_last), lambda a, b: F.greatest(F.lit(0), F.least(F.lit(1), a - b)))


def mask_owned(scores, y_last) -> Column:
    """(1 - y_last) * score: owned products score 0."""
    return F.zip_with(_c(scores), _c(y_last), lambda p, b: (1 - b) * p)


def _clip(p: Column, eps: float) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps))


def _mean(arr: Column) -> Column:
    return bind(arr, lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / F.size(v).cast("double"))


def bce_terms(target, output, eps: float = LOSS_EPS) -> Column:
    """Element-wise binary cross-entropy with the output clipped to [eps, 1-eps]."""
    return F.zip_with(_c(target), _c(output), lambda y, p: -(
        y * F.ln(_clip(p.cast("double"), eps)) + (1 - y) * F.ln(1 - _clip(p.cast("double"), eps))))


def binary_crossentropy(y_true, y_pred, eps: float = LOSS_EPS) -> Column:
    return _mean(bce_terms(y_true, y_pred, eps))


def mean_squared_error(y_true, y_pred) -> Column:
    return _mean(F.zip_with(_c(y_true), _c(y_pred), lambda y, p: (y - p) * (y - p)))


def categorical_crossentropy(y_true, y_pred, eps: float = LOSS_EPS) -> Column:
    """-sum(y * ln(clip(p / sum(p)))); scores that are all zero have shares of zero."""
    def of(p: Column) -> Column:
        logs = lambda s: F.zip_with(_c(y_true), p, lambda y, q: y * F.ln(_clip(F.coalesce(F.try_divide(q, s), F.lit(0.0)), eps)))
        return -F.aggregate(bind(F.aggregate(p, F.lit(0.0), lambda a, b: a + b), logs), F.lit(0.0), lambda a, b: a + b)

    return bind(_c(y_pred), of)


def bce_true_only(y_true, y_pred, eps: float = LOSS_EPS) -> Column:
    """(1 + sum(p)) * mean(BCE(target=y, output=y*p)): mostly the true classes count."""
    y, p = _c(y_true), _c(y_pred)
    yp = F.zip_with(y, p, lambda a, b: a * b)
    return (1 + F.aggregate(p, F.lit(0.0), lambda a, b: a + b)) * _mean(bce_terms(y, yp, eps))


def left_pad(x, seq_len: int, width: int, value: float = PAD_VALUE) -> Column:
    """Prepend rows of ``value`` so that the sequence has ``seq_len`` steps; a longer sequence is an error."""
    x = _c(x)
    x = F.when(F.size(x) > seq_len, F.raise_error(F.concat(F.lit("a history has more steps than seq_len: "), F.size(x).cast("string")))).otherwise(x)
    pad_row = F.array_repeat(F.lit(float(value)), width)
    n_pad = F.greatest(F.lit(seq_len) - F.size(x), F.lit(0))
    return F.concat(F.array_repeat(pad_row, n_pad), x)


def ranked_candidates(scores, owned, n: int = NUM_PRODUCTS) -> Column:
    """0-based product indices with score > 0 and not owned, best first.

    Equal scores put the higher index first; a NaN score is no candidate. A null ``owned`` (no snapshot)
    removes nothing.
    """
    p, o = _c(scores), _c(owned)
    cand = F.filter(F.sequence(F.lit(0), F.lit(n - 1)),
                    lambda i: (F.nanvl(F.get(p, i), F.lit(0.0)) > 0) & ~F.coalesce(F.get(o, i) >= 1, F.lit(False)))
    keyed = F.transform(cand, lambda i: F.struct((-F.get(p, i)).alias("v"), (-i).alias("ni"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda s: s["i"])

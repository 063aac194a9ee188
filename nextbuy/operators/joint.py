"""The 24 product models fitted together on sparse history vectors.

The inputs are those of 24 separate regularised logistic regressions over
[attributes | flattened left-padded history], but

* a history's channels are stored shifted by one, so the pad value -1 becomes 0 and
  is not stored: a vector costs what its observed months cost, not ``seq_len`` steps;
* one pass over the data gives the losses and gradients of all products: tasks sum over
  their blocks of rows, the sums are added in a tree, and the driver sees matrices of
  products x inputs only;
* the passes share one copy of the data, blocks of 128 customers with histories of about one
  length in Parquet below the shared folder, so nothing is cached and a lost executor re-reads its
  files; a block names the inputs it uses, and is multiplied by those only. Blocks are stored packed, in small
  row groups, and unpacked one at a time: a task's memory does not depend on the rows it reads.

The objective is that of Spark ML's ``LogisticRegression`` (mean log loss, L2 penalty on
standardised coefficients, free intercept). Inputs are standardised and centred inside
the product (the shift and the centring go into the intercept), so vectors stay sparse.
Products are minimised side by side, each by its own limited-memory BFGS.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import NUM_PRODUCTS, PAD_VALUE
from ..session import share_package
from ..sources.storage import store_rows
from .metrics import require_labels

#: Sums of more tasks than this are added in a tree before they reach the driver.
DIRECT_TASKS = 64
MEMORY = 10
#: Blocks of up to this many cells (32 MB) are multiplied as matrices.
DENSE_CELLS = 1 << 22
#: Rows of a stored block.
GROUP_ROWS = 128
#: Blocks of a Parquet row group: the reader holds a row group at a time, unpacked up to 2.6 MB a block of long histories.
GROUP_BLOCKS = 64
CODEC = "zstd"
_INPUT = ("attrs", "x")


def _cells(attrs: pa.Array, x: pa.Array, seq_len: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(idx, val, size) of history rows: the entries of the padded vectors that are not 0 after the shift, row by row.

    A missing value counts as 0.0 (before the shift); a row without ``attrs``, ``x`` or one of its steps has no entries.
    """
    a, n_attrs = _lists(attrs)
    steps, n_steps = x.flatten(), np.diff(np.asarray(x.offsets))
    if len(n_steps) and n_steps.max() > seq_len:
        raise ValueError(f"a history has more steps than seq_len: {n_steps.max()}")
    v, n_cells = _lists(steps)
    ends = np.append(0, np.cumsum(n_cells))[np.append(0, np.cumsum(n_steps))]
    n_cells, rows = np.diff(ends), np.arange(len(n_steps))
    row = np.concatenate([np.repeat(rows, n_attrs), np.repeat(rows, n_cells)])
    within = np.concatenate([np.arange(len(a)) - np.repeat(np.cumsum(n_attrs) - n_attrs, n_attrs), np.arange(len(v)) - np.repeat(ends[:-1], n_cells)])
    within[len(a):] += np.repeat(n_attrs + (seq_len - n_steps) * width, n_cells)
    val = np.concatenate([a, v - PAD_VALUE])
    keep = val != 0
    if attrs.null_count or x.null_count or steps.null_count:
        bad = np.asarray(attrs.is_null()) | np.asarray(x.is_null())
        bad[np.repeat(rows, n_steps)[np.asarray(steps.is_null())]] = True
        keep &= ~bad[row]
    order = np.flatnonzero(keep)
    order = order[np.argsort(row[order], kind="stable")]
    return within[order].astype(np.int32), val[order], np.bincount(row[order], minlength=len(rows))


def sparse_rows(h: DataFrame, seq_len: int, width: int) -> DataFrame:
    """Replaces ``attrs`` and ``x`` by ``idx`` and ``val``: the entries of the padded vector that are not 0 after the shift.

    A missing value counts as 0.0 (before the shift). A history of more than ``seq_len`` steps is an error.
    """
    share_package(h.sparkSession)
    rest = [f for f in h.schema.fields if f.name not in _INPUT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            idx, val, size = _cells(batch.column(0), batch.column(1), seq_len, width)
            ends = pa.array(np.append(0, np.cumsum(size)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in (idx, val)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *lists], [*(f.name for f in rest), "idx", "val"])

    schema = T.StructType([*rest, T.StructField("idx", T.ArrayType(T.IntegerType())), T.StructField("val", T.ArrayType(T.DoubleType()))])
    return h.select(*_INPUT, *(f.name for f in rest)).mapInArrow(run, schema)


class _Block:
    """Rows of one batch: entries one row after the other. ``cols``: the inputs that ``idx`` numbers (default: all)."""

    def __init__(self, idx: np.ndarray, val: np.ndarray, size: np.ndarray, cols: np.ndarray | None = None):
        self.idx, self.val, self.size, self.cols = idx, val, size, cols
        self.row = np.repeat(np.arange(len(size)), size)
        self.dense = None

    def _filled(self, n_inputs: int) -> np.ndarray | None:
        """The rows as a matrix, while that is small: its products take less time than those of the entries."""
        if self.dense is None and len(self.size) * n_inputs <= DENSE_CELLS:
            self.dense = np.zeros((len(self.size), n_inputs))
            self.dense[self.row, self.idx] = self.val
        return self.dense

    def margins(self, w: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rows x products; ``w`` is inputs x products."""
        w = w if self.cols is None else w[self.cols]
        if (x := self._filled(len(w))) is not None:
            return x @ w + b
        out = np.zeros((len(self.size), w.shape[1]))
        full = np.flatnonzero(self.size)
        if len(full):
            first = (np.cumsum(self.size) - self.size)[full]
            out[full] = np.add.reduceat(w[self.idx] * self.val[:, None], first, axis=0)
        return out + b

    def back(self, r: np.ndarray, n_inputs: int, out: np.ndarray | None = None) -> np.ndarray:
        """Products x inputs: the sum over rows of residual times input, added to ``out``."""
        out = np.zeros((r.shape[1], n_inputs)) if out is None else out
        n = n_inputs if self.cols is None else len(self.cols)
        if (x := self._filled(n)) is not None:
            part = r.T @ x
        else:
            part = np.stack([np.bincount(self.idx, self.val * r[self.row, k], n) for k in range(r.shape[1])])
        out[:, slice(None) if self.cols is None else self.cols] += part
        return out

    @property
    def inputs(self) -> np.ndarray:
        """The input of each entry."""
        return self.idx if self.cols is None else self.cols[self.idx]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, sizes) of a list column; a missing number counts as 0."""
    values = column.flatten()
    if values.null_count:
        values = values.fill_null(0)
    return values.to_numpy(zero_copy_only=False), np.diff(np.asarray(column.offsets))


def _groups(idx: np.ndarray, val: np.ndarray, size: np.ndarray, y: np.ndarray, rows_a_group: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(size, cols, idx, val, y) of ``rows_a_group`` rows each, rows of about as many entries together.

    ``cols`` are the inputs that the group uses: short histories leave out the inputs of the months before them.
    """
    order = np.argsort(size, kind="stable")
    first = np.cumsum(size) - size
    for i in range(0, len(size), rows_a_group):
        rows = order[i:i + rows_a_group]
        n = size[rows]
        at = np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cols, own = np.unique(idx[at], return_inverse=True)
        yield n.astype("<i4"), cols.astype("<i4"), own.astype(_narrow(len(cols))), val[at].astype("<f8"), y[rows].astype(np.uint8)


def _narrow(n: int) -> str:
    """The type of numbers below ``n`` in stored blocks."""
    return "<u2" if n <= 1 << 16 else "<i4"


def pack_blocks(h: DataFrame, seq_len: int, width: int) -> DataFrame:
    """(size, cols, idx, val, y) with a group of sparse history rows in each row, stored once; ``idx`` and ``val`` are compressed."""
    rows_a_group = GROUP_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y, _ = _lists(batch.column(2))
                groups = _groups(*_cells(batch.column(0), batch.column(1), seq_len, width), y.reshape(batch.num_rows, -1), rows_a_group)
                parts = zip(*(map(_packed, "size cols idx val y".split(), g) for g in groups), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.binary()) for p in parts], ["size", "cols", "idx", "val", "y"])

    rows = require_labels(h.filter(F.col("y").isNotNull()))
    return store_rows(rows.select(*_INPUT, "y").mapInArrow(run, "size binary, cols binary, idx binary, val binary, y binary"), "blocks",
                      **{"parquet.block.row.count.limit": GROUP_BLOCKS})


def _packed(name: str, part: np.ndarray) -> bytes:
    return pa.compress(part.tobytes(), codec=CODEC, asbytes=True) if name in ("idx", "val") else part.tobytes()


def _unpacked(part: pa.Buffer, dtype: str, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(part, decompressed_size=n * np.dtype(dtype).itemsize, codec=CODEC), dtype)


def _blocks(batch: pa.RecordBatch, n_products: int) -> Iterator[tuple[_Block, np.ndarray]]:
    """The blocks of a batch and their labels; only the one at hand is unpacked."""
    for i in range(batch.num_rows):
        size, cols, idx, val, y = (c[i].as_buffer() for c in batch.columns)
        size, cols = np.frombuffer(size, "<i4"), np.frombuffer(cols, "<i4")
        n = int(size.sum())
        yield (_Block(_unpacked(idx, _narrow(len(cols)), n), _unpacked(val, "<f8", n), size, cols),
               np.frombuffer(y, np.uint8).reshape(-1, n_products).astype(np.float64))


def tree_sum(blocks: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], cells: int, n_tasks: int) -> np.ndarray:
    """The sum of ``part`` over all batches of ``blocks``: one array a task, added in a tree when there are many tasks."""

    def add(arrays: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(cells)
        for a in arrays:
            total += a
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["task", "total"])

    def leaf(batches):
        return add(part(b) for b in batches)

    def inner(batches):
        return add(np.frombuffer(x) for b in batches for x in b.column(1).to_pylist())

    sums = blocks.mapInArrow(leaf, "task int, total binary")
    while n_tasks > DIRECT_TASKS:
        n_tasks = int(np.ceil(np.sqrt(n_tasks)))
        sums = sums.repartition(n_tasks, "task").mapInArrow(inner, "task int, total binary")
    total = np.zeros(cells)
    for r in sorted(sums.collect(), key=lambda r: r.task):  # at most DIRECT_TASKS arrays of the model's size
        total += np.frombuffer(r.total)
    return total


class JointScorer:
    """24 logistic regressions, one per product, fitted side by side."""

    def __init__(self, max_iter: int = 20, reg_param: float = 0.01, tol: float = 1e-6, n_products: int = NUM_PRODUCTS):
        self.max_iter, self.reg_param, self.tol, self.n_products = max_iter, reg_param, tol, n_products
        self.coefficients: np.ndarray | None = None     # products x inputs, for unshifted inputs
        self.intercepts: np.ndarray | None = None
        self.seq_len = self.width = 0
        self.log: list[tuple[int, str, float]] = []

    # --- fit -----------------------------------------------------------------------------------

    def fit(self, train: DataFrame, seq_len: int, width: int, start: JointScorer | None = None,
            on_epoch: Callable[[int, JointScorer], object] | None = None) -> JointScorer:
        """Fit on history rows (``attrs``, ``x``, ``y``); an epoch is one step of all products.

        ``start``: a scorer whose weights are taken over. ``on_epoch(epoch, self)`` is called after every epoch with the
        weights of that epoch; a true result ends the fit. ``log`` then holds (epoch, metric, value): each product's objective, and their mean ``loss``.
        Products that all or no rows have get the intercept +-infinity, as in Spark ML. Without rows all weights are 0.
        """
        share_package(train.sparkSession)
        self.seq_len, self.width = seq_len, width
        n_attrs = (train.select(F.size("attrs").alias("n")).first() or [0])[0]
        blocks = pack_blocks(train, seq_len, width)
        n_tasks = len(blocks.inputFiles())
        d, k = n_attrs + seq_len * width, self.n_products
        self._history = slice(n_attrs, d)

        def moments(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros(2 * d + k + 1)
            for b, y in _blocks(batch, k):
                out += np.concatenate([np.bincount(b.inputs, b.val, d), np.bincount(b.inputs, b.val**2, d), y.sum(0), [len(y)]])
            return out

        total = tree_sum(blocks, moments, 2 * d + k + 1, n_tasks)
        n = total[-1]
        self.log = []
        if not n:
            self._set(np.zeros((k, d)), np.zeros(k))
            return self
        mean = total[:d] / n
        var = np.maximum(total[d:2 * d] - n * mean**2, 0) / max(n - 1, 1)
        scale = np.where(var > 1e-18, 1 / np.sqrt(np.maximum(var, 1e-18)), 0.0)  # a constant input takes no part
        share = total[2 * d:-1] / n
        settled = (share == 0) | (share == 1)

        def evaluate(beta: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Objectives and gradients of the products ``which`` at standardised weights (the last one: the intercept)."""
            w = beta[:, :-1] * scale
            b = beta[:, -1] - w @ mean
            wt, m = np.ascontiguousarray(w.T), len(which)

            def part(batch: pa.RecordBatch) -> np.ndarray:
                loss, grad, rest = np.zeros(m), np.zeros((m, d)), np.zeros(m)
                for block, y in _blocks(batch, k):
                    z, y = block.margins(wt, b), y[:, which]
                    e = np.exp(-np.abs(z))
                    loss += (np.log1p(e) + np.maximum(z, 0) - y * z).sum(0)
                    r = np.where(z >= 0, 1, e) / (1 + e) - y
                    rest += r.sum(0)
                    block.back(r, d, grad)
                return np.concatenate([loss, rest, grad.ravel()])

            out = tree_sum(blocks, part, m * (d + 2), n_tasks) / n
            loss, rest, grad = out[:m], out[m:2 * m], out[2 * m:].reshape(m, d)
            slope = (grad - rest[:, None] * mean) * scale + self.reg_param * beta[:, :-1]
            return loss + self.reg_param / 2 * (beta[:, :-1] ** 2).sum(1), np.column_stack([slope, rest])

        def publish(beta: np.ndarray) -> None:
            w = beta[:, :-1] * scale
            b = beta[:, -1] - w @ mean + w[:, self._history].sum(1)  # for inputs that are not shifted
            self._set(w, np.where(settled, np.where(share == 1, np.inf, -np.inf), b))

        beta = np.zeros((k, d + 1))
        if start is not None:
            w = start.coefficients
            beta[:, :-1] = np.where(scale > 0, w / np.where(scale > 0, scale, 1), 0)
            real = np.isfinite(start.intercepts)
            beta[real, -1] = (start.intercepts - w[:, self._history].sum(1) + (beta[:, :-1] * scale) @ mean)[real]
            beta[~real, -1] = 0
        else:
            odds = np.clip(share, 1e-12, 1 - 1e-12)
            beta[:, -1] = np.log(odds / (1 - odds))
        beta[settled] = 0
        publish(beta)
        for epoch, (beta, value) in enumerate(minimise(evaluate, beta, ~settled, self.max_iter, self.tol)):
            publish(beta)
            self.log += [(epoch, f"objective_{i + 1}", float(v)) for i, v in enumerate(value)] + [(epoch, "loss", float(value.mean()))]
            if on_epoch is not None and on_epoch(epoch, self):
                break
        return self

    def _set(self, coefficients: np.ndarray, intercepts: np.ndarray) -> None:
        self.coefficients, self.intercepts = coefficients, intercepts

    def training_log(self, spark: SparkSession) -> DataFrame:
        """(epoch, metric, value) of the fit, for ``trainlog``."""
        if not self.log:
            raise ValueError("fit first")
        return spark.createDataFrame(self.log, "epoch int, metric string, value double")

    # --- scores --------------------------------------------------------------------------------

    def _scored(self, h: DataFrame, name: str, probability: bool) -> DataFrame:
        share_package(h.sparkSession)
        n_attrs = self.coefficients.shape[1] - self.seq_len * self.width
        seq_len, width = self.seq_len, self.width
        rest = [f for f in h.schema.fields if f.name not in (*_INPUT, name)]
        w = np.ascontiguousarray(self.coefficients.T)
        b = self.intercepts - self.coefficients[:, n_attrs:].sum(1)  # the rows are shifted
        n_inputs = len(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                idx, val, size = _cells(batch.column(0), batch.column(1), seq_len, width)
                if len(idx) and idx.max() >= n_inputs:
                    raise ValueError(f"the model has {n_inputs} inputs; a row has input {idx.max()}")
                z = _Block(idx, val, size).margins(w, b)
                if probability:
                    e = np.exp(-np.abs(z))
                    z = np.where(z >= 0, 1, e) / (1 + e)
                ends = pa.array(np.arange(0, z.size + 1, z.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], [*(f.name for f in rest), name])

        schema = T.StructType([*rest, T.StructField(name, T.ArrayType(T.DoubleType()))])
        return h.select(*_INPUT, *(f.name for f in rest)).mapInArrow(run, schema)

    def margins(self, h: DataFrame, vec_col: str = "vec") -> DataFrame:
        """Replaces ``attrs`` and ``x`` by ``vec``: the 24 raw margins (the model's last-layer activations)."""
        return self._scored(h, vec_col, probability=False)

    def predict(self, h: DataFrame, p_col: str = "p") -> DataFrame:
        """Replaces ``attrs`` and ``x`` by ``p``: each product's probability (other columns kept)."""
        return self._scored(h, p_col, probability=True)

    # --- storage -------------------------------------------------------------------------------

    def save(self, spark: SparkSession, path: str) -> None:
        """A Parquet table: a row per product with intercept, coefficients and the padding they were fitted on."""
        rows = [(i + 1, self.seq_len, self.width, float(b), w.tolist()) for i, (b, w) in enumerate(zip(self.intercepts, self.coefficients, strict=True))]
        schema = "product int, seq_len int, width int, intercept double, coefficients array<double>"
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)  # one row a product

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> JointScorer:
        rows = spark.read.parquet(path).orderBy("product").collect()  # one row a product
        scorer = cls(n_products=len(rows))
        scorer.seq_len, scorer.width = rows[0].seq_len, rows[0].width
        scorer._set(np.array([r.coefficients for r in rows]), np.array([r.intercept for r in rows]))
        return scorer


def minimise(evaluate, x: np.ndarray, active: np.ndarray, max_iter: int, tol: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Limited-memory BFGS for many independent convex problems at once; yields (points, values) of each step.

    ``evaluate(points, which)`` gives values and gradients of the problems ``which``. A problem rests once its gradient
    is below ``tol`` (relative to its value, at least 1) or no step lowers it any more.
    """
    x, active = x.copy(), active.copy()
    value, grad = np.zeros(len(x)), np.zeros_like(x)
    pairs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in x]

    def rest() -> None:
        active[np.abs(grad).max(1) <= tol * np.maximum(1, np.abs(value))] = False

    def at(points: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return evaluate(points[which], which)

    which = np.flatnonzero(active)
    if len(which):
        value[which], grad[which] = at(x, which)
    yield x.copy(), value.copy()
    for _ in range(max_iter):
        rest()
        which = np.flatnonzero(active)
        if not len(which):
            return
        way = np.zeros_like(x)
        step = np.zeros(len(x))
        for i in which:
            way[i] = -_inverse_times(grad[i], pairs[i])
            if way[i] @ grad[i] >= 0:  # rounding: start afresh
                pairs[i].clear()
                way[i] = -grad[i]
            step[i] = 1.0 if pairs[i] else min(1.0, 1 / np.linalg.norm(grad[i]))
        slope = (way * grad).sum(1)
        todo = which
        for _ in range(25):
            point = x + step[:, None] * way
            v, g = at(point, todo)
            good = v <= value[todo] + 1e-4 * step[todo] * slope[todo]
            for i, vi, gi in zip(todo[good], v[good], g[good], strict=True):
                s, y = point[i] - x[i], gi - grad[i]
                if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
                    pairs[i] = [*pairs[i], (s, y)][-MEMORY:]
                x[i], value[i], grad[i] = point[i], vi, gi
            short, v = todo[~good], v[~good]
            if not len(short):
                break
            # the least of the parabola through both values and the slope, kept within a tenth and a half
            t = step[short]
            bend = 2 * (v - value[short] - t * slope[short])
            step[short] = t * np.clip(np.where(bend > 0, -slope[short] * t / np.where(bend > 0, bend, 1), 0.5), 0.1, 0.5)
            todo = short
        else:
            active[todo] = False
        yield x.copy(), value.copy()


def _inverse_times(g: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The inverse Hessian that the last (step, change of gradient) pairs describe, times ``g``."""
    out, shares = g.copy(), []
    for s, y in reversed(pairs):
        a = (s @ out) / (s @ y)
        shares.append(a)
        out -= a * y
    if pairs:
        s, y = pairs[-1]
        out *= (s @ y) / (y @ y)
    for (s, y), a in zip(pairs, reversed(shares), strict=True):
        out += (a - (y @ out) / (s @ y)) * s
    return out

"""Spark's multilayer perceptron, fitted on blocks of rows by numpy kernels.

The network (sigmoid layers, softmax on top), its first weights, the loss
(cross entropy, the mean over all rows) and the optimizer (L-BFGS with ten
corrections and a strong Wolfe line search, as Spark's) are those of
``MultilayerPerceptronClassifier``, and the fitted model is Spark's own class.
Rows are packed into blocks of bytes once; every step sends the weights to the
blocks and gets one sum of losses and gradients per partition.
"""

from __future__ import annotations

from functools import partial
from typing import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.common import _java2py, _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 1 << 18  # of a block of rows, about
SLICE_BYTES = 1 << 19  # of a layer's values of the rows that a kernel holds at a time: they stay in a core's cache
FEW_SUMS = 32  # (classes - 1) x (features + 1), at most, for the kernel of one hidden layer
CORRECTIONS = 10
ROUNDS = 8  # a task of a step costs about as much as 200,000 rows, so the tables' partitions that follow each other on a core are one
MANY_PARTS = 64  # beyond so many partitions their sums are added on the executors first


def _packed(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y): the features of a block of rows, row by row, and its class numbers, as bytes."""
    rows = max(1, BLOCK_BYTES // (8 * (width + 1)))
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def block(pieces) -> pa.RecordBatch:
        x, y = (np.concatenate(z) for z in zip(*pieces))
        return pa.RecordBatch.from_pydict({"x": [x.tobytes()], "y": [y.astype(np.int32).tobytes()]},
                                          schema=pa.schema([("x", pa.binary()), ("y", pa.binary())]))

    n = 0
    for batch in batches:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        y = batch.column("y").to_numpy(zero_copy_only=False)
        for lo in range(0, len(y), rows):
            held.append((x[lo:lo + rows].copy(), y[lo:lo + rows].copy()))
            n += len(held[-1][1])
            if n >= rows:
                yield block(held)
                held, n = [], 0
    if n:
        yield block(held)


def _shaped(weights: np.ndarray, layers: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per layer the weights (to x from) and the intercepts, in Spark's order."""
    out, at = [], 0
    for n, m in zip(layers[:-1], layers[1:]):
        out.append((weights[at:at + n * m].reshape(n, m).T, weights[at + n * m:at + n * m + m]))
        at += n * m + m
    return out


def _loss_and_gradient(layers: Sequence[int], weights: np.ndarray, blocks: Iterator[tuple[bytes, bytes]]) -> tuple[int, float, np.ndarray]:
    """(rows, loss, gradient), summed over the rows of ``blocks``.

    A sigmoid is (1 + tanh(z / 2)) / 2: the halves go into the weights around it, so the layers hold t = tanh(z / 2).
    """
    few = len(layers) == 3 and (layers[2] - 1) * (layers[0] + 1) <= FEW_SUMS
    return (_one_hidden if few else _any_layers)(layers, weights, blocks)


def _one_hidden(layers: Sequence[int], weights: np.ndarray, blocks: Iterator[tuple[bytes, bytes]]) -> tuple[int, float, np.ndarray]:
    """One hidden layer, few features and classes. The slope of a hidden unit is (1 - t^2) / 4, so the first layer's gradient
    comes from the sums of t^2 by (error of a class) x (feature); the errors of a row add up to 0, so one class is left out."""
    ((w1, b1), (w2, b2)), (d, hidden, classes) = _shaped(weights, layers), layers
    into = np.ascontiguousarray(0.5 * np.column_stack([w1, b1]).T)
    out_of, shift = np.ascontiguousarray(0.5 * w2), (b2 + 0.5 * w2.sum(axis=1))[:, None]
    step = max(64, SLICE_BYTES // (8 * hidden))
    by_x, by_t, by_tt = np.zeros((classes, d + 1)), np.zeros((classes, hidden)), np.zeros(((classes - 1) * (d + 1), hidden))
    rows, loss = 0, 0.0
    room, errors = np.empty((step, hidden)), np.empty((classes - 1, d + 1, step))
    for x_bytes, y_bytes in blocks:
        y = np.frombuffer(y_bytes, np.int32)
        x = np.ones((len(y), d + 1))
        x[:, :d] = np.frombuffer(x_bytes, np.float64).reshape(len(y), d)
        turned = np.ascontiguousarray(x.T)
        true = (np.arange(classes)[:, None] == y[None, :]).astype(np.float64)
        rows += len(y)
        for lo in range(0, len(y), step):
            n = min(step, len(y) - lo)
            full = n == step
            t = np.matmul(x[lo:lo + n], into, out=room if full else None)
            np.tanh(t, out=t)
            e, one = out_of @ t.T, true[:, lo:lo + n]
            e += shift
            e -= e.max(axis=0)
            loss -= (e * one).sum()
            np.exp(e, out=e)
            total = e.sum(axis=0)
            loss += np.log(total).sum()
            e /= total
            e -= one
            by_x += e @ x[lo:lo + n]
            by_t += e @ t
            each = np.multiply(e[1:, None, :], turned[None, :, lo:lo + n], out=errors if full else None).reshape(-1, n)
            np.multiply(t, t, out=t)
            by_tt += each @ t
    slope = by_x[1:, :, None] - by_tt.reshape(classes - 1, d + 1, hidden)
    first = 0.25 * np.einsum("kh,kdh->dh", w2[1:] - w2[:1], slope)
    return rows, float(loss), np.concatenate([first[:d].ravel(), first[d], (0.5 * (by_t + by_x[:, d:])).T.ravel(), by_x[:, d]])


def _any_layers(layers: Sequence[int], weights: np.ndarray, blocks: Iterator[tuple[bytes, bytes]]) -> tuple[int, float, np.ndarray]:
    shaped, last = _shaped(weights, layers), len(layers) - 2
    into, shift = [], []  # what a layer gets from the t of the layer before
    for i, (w, b) in enumerate(shaped):
        half = 1.0 if i == last else 0.5
        into.append(np.ascontiguousarray(half * (w if i == 0 else 0.5 * w)))
        shift.append((half * (b if i == 0 else b + 0.5 * w.sum(axis=1)))[:, None])
    back = [None] + [np.ascontiguousarray(0.25 * w.T) for w, _ in shaped[1:]]  # with the 1/4 of the sigmoid's slope, (1 - t^2) / 4
    step = max(64, SLICE_BYTES // (8 * max(layers[1:])))
    by_t, by_one = [np.zeros(w.shape) for w, _ in shaped], [np.zeros(b.shape) for _, b in shaped]
    rows, loss = 0, 0.0
    room = [np.empty((m, step)) for m in layers[1:]]
    slopes = [np.empty((m, step)) for m in layers[1:]]
    for x_bytes, y_bytes in blocks:
        y = np.frombuffer(y_bytes, np.int32)
        x = np.ascontiguousarray(np.frombuffer(x_bytes, np.float64).reshape(len(y), layers[0]).T)
        rows += len(y)
        for lo in range(0, len(y), step):
            n = min(step, len(y) - lo)
            full = n == step
            t = [x[:, lo:lo + n]]
            for i in range(last + 1):
                z = np.matmul(into[i], t[i], out=room[i] if full else None)
                z += shift[i]
                t.append(np.tanh(z, out=z) if i < last else z)
            out = t.pop()
            out -= out.max(axis=0)
            at = (y[lo:lo + n], np.arange(n))
            true = out[at].sum()
            np.exp(out, out=out)
            total = out.sum(axis=0)
            loss += np.log(total).sum() - true
            out /= total
            out[at] -= 1.0
            delta = out
            for i in range(last, -1, -1):
                by_t[i] += delta @ t[i].T
                by_one[i] += delta.sum(axis=1)
                if i:
                    delta = np.matmul(back[i], delta, out=slopes[i - 1] if full else None)
                    np.multiply(t[i], t[i], out=t[i])
                    np.subtract(1.0, t[i], out=t[i])
                    delta *= t[i]
    gradient = []
    for i, (g, d) in enumerate(zip(by_t, by_one)):
        g = g if i == 0 else 0.5 * (g + d[:, None])  # by sigmoids, not by t
        gradient += [g.T.ravel(), d]
    return rows, float(loss), np.concatenate(gradient)


class _Failed(Exception):
    """A search for the next weights that found none."""


def _inverse_hessian(grad: np.ndarray, steps: list, deltas: list) -> np.ndarray:
    """The descent direction by the latest steps and their changes of the gradient, the latest first."""
    out, a, rho = grad.copy(), [], []
    for s, g in zip(steps, deltas):
        rho.append(s @ g)
        a.append((s @ out) / rho[-1] if rho[-1] else np.nan)
        if np.isnan(a[-1]):
            raise _Failed("history")
        out -= a[-1] * g
    if steps:
        sy = steps[0] @ deltas[0]
        if sy < 0 or np.isnan(sy):
            raise _Failed("history")
        out *= sy / (deltas[0] @ deltas[0])
    for i in range(len(steps) - 1, -1, -1):
        out += steps[i] * (a[i] - (deltas[i] @ out) / rho[i])
    return -out


def _wolfe(phi: Callable[[float], tuple[float, float]], value: float, slope: float, t: float, most: int = 10) -> float:
    """A step with sufficient decrease (1e-4) and a slope of at most 0.9 of the first; ``phi``: value and slope at a step."""
    if slope > 0:
        raise _Failed("not a descent")

    def between(left, right):
        (lt, lf, ld), (rt, rf, rd) = left, right
        d1 = ld + rd - 3 * (lf - rf) / (lt - rt)
        under = d1 * d1 - ld * rd
        d2 = np.sqrt(under) if under >= 0 else np.nan
        t = rt - (rt - lt) * (rd + d2 - d1) / (rd - ld + 2 * d2)
        low, high = lt + 0.1 * (rt - lt), lt + 0.9 * (rt - lt)
        return low if t < low else high if t > high else t

    def zoom(low, high):
        for _ in range(most):
            t = between(high, low) if low[0] > high[0] else between(low, high)
            c = (t, *phi(t))
            if c[1] > value + 1e-4 * t * slope or c[1] >= low[1]:
                high = c
            else:
                if abs(c[2]) <= 0.9 * abs(slope):
                    return t
                if c[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = c
        raise _Failed("zoom")

    low = (0.0, value, slope)
    for i in range(most):
        c = (t, *phi(t))
        if not np.isfinite(c[1]):
            t /= 2.0
            continue
        if c[1] > value + 1e-4 * t * slope or (c[1] >= low[1] and i > 0):
            return zoom(low, c)
        if abs(c[2]) <= 0.9 * abs(slope):
            return t
        if c[2] >= 0:
            return zoom(c, low)
        low = c
        t *= 1.5
    raise _Failed("line search")


def minimized(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int, tol: float) -> np.ndarray:
    """L-BFGS from ``x`` on ``f`` (value and gradient), until ``max_iter`` steps, or values (of 20 steps) or the gradient
    change by no more than ``tol``, relative to the first value and the current one."""
    known: dict[bytes, tuple[float, np.ndarray]] = {}

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        key = w.tobytes()
        if key not in known:
            known.clear()  # the latest point is enough
            known[key] = f(w)
        return known[key]

    value, grad = at(x)
    first, values, steps, deltas, failed, done = value, [value], [], [], False, 0
    while done < max_iter and not np.linalg.norm(grad) <= max(tol * value, 1e-8):
        if len(values) >= 2 and abs(value - max(values)) <= tol * first:
            break
        try:
            direction = _inverse_hessian(grad, steps, deltas)

            def phi(t: float) -> tuple[float, float]:
                v, g = at(x + t * direction)
                return v, float(g @ direction)

            t = _wolfe(phi, value, float(grad @ direction), 1.0 / np.linalg.norm(direction) if done == 0 else 1.0)
            if t * np.linalg.norm(grad) < 1e-10:
                raise _Failed("step")
            new = x + t * direction
            new_value, new_grad = at(new)
        except _Failed:
            if failed:
                break
            failed, steps, deltas = True, [], []  # once more, without history
            continue
        failed = False
        steps, deltas = [new - x, *steps][:CORRECTIONS], [new_grad - grad, *deltas][:CORRECTIONS]
        x, value, grad, done = new, new_value, new_grad, done + 1
        values = [*values, value][-20:]
    return x


class BlockPerceptron(MultilayerPerceptronClassifier):
    """``MultilayerPerceptronClassifier`` whose L-BFGS fit works on blocks of rows (see the module)."""

    def _first_weights(self, layers: Sequence[int], sc) -> np.ndarray:
        if self.isDefined(self.initialWeights):
            return np.array(self.getInitialWeights().toArray())
        sizes = sc._gateway.new_array(sc._gateway.jvm.int, len(layers))
        for i, n in enumerate(layers):
            sizes[i] = n
        ann = sc._gateway.jvm.org.apache.spark.ml.ann
        return np.array(_java2py(sc, ann.FeedForwardTopology.multiLayerPerceptron(sizes, True).model(self.getSeed()).weights()).toArray())

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        if self.getSolver() != "l-bfgs":
            return super()._fit(dataset)
        sc, layers = dataset.sparkSession.sparkContext, [int(n) for n in self.getLayers()]
        flat = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("int").alias("y"))
        blocks = flat.mapInArrow(partial(_packed, layers[0]), "x binary, y binary").rdd.map(lambda b: (bytes(b.x), bytes(b.y)))
        cores = sc.defaultParallelism
        blocks = blocks.coalesce(cores * -(-blocks.getNumPartitions() // (cores * ROUNDS))).persist(StorageLevel.MEMORY_AND_DISK)

        def summed(weights: np.ndarray) -> tuple[float, np.ndarray]:
            parts = blocks.mapPartitions(lambda part: [_loss_and_gradient(layers, weights, part)])
            add = lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2])
            n, loss, gradient = parts.treeReduce(add) if parts.getNumPartitions() > MANY_PARTS else parts.reduce(add)
            return loss / n, gradient / n

        try:
            weights = minimized(summed, self._first_weights(layers, sc), self.getMaxIter(), self.getTol())
        finally:
            blocks.unpersist()
        make = sc._gateway.jvm.org.apache.spark.ml.classification.MultilayerPerceptronClassificationModel
        return self._copyValues(MultilayerPerceptronClassificationModel(make(self.uid, _py2java(sc, Vectors.dense(weights)))))

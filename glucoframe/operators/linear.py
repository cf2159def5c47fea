"""Linear heads and projections solved exactly, by sums of small blocks.

A fit needs a few sums over all rows whose size does not depend on their number: gradients and
second derivatives of all labels at once, or the outer products of the vectors. Each task sums its
rows in Arrow batches, a second stage adds up the tasks' blocks, and a bounded number of them
reaches the driver, which solves a system as wide as the vectors. Widths are limited
(``MOST_UNKNOWNS``), rows are not.

Fits run to a tolerance of the gradient, and the ``*_gradient`` functions state the gradient of
given weights as a table, in DataFrame functions and independently of the solver: a certificate.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: up to so many unknowns are solved for together
MOST_UNKNOWNS = 4096
#: blocks that reach the driver
LAST_BLOCKS = 8


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(n, -1) if n and len(flat) else np.zeros((n, 0))


def summed(df: DataFrame, block: Callable[[pa.RecordBatch], Sequence[np.ndarray]]) -> list[np.ndarray]:
    """The sums of the arrays that ``block`` makes of each Arrow batch, over all rows of ``df``."""
    schema = "sums binary, shapes array<array<int>>"  # doubles, and the shapes of the arrays that they make up

    def row(total):
        return pa.RecordBatch.from_arrays(
            [pa.array([np.concatenate([a.ravel() for a in total]).tobytes()], pa.binary()),
             pa.array([[list(a.shape) for a in total]], pa.list_(pa.list_(pa.int32())))], ["sums", "shapes"])

    def arrays_of(sums, shapes):
        flat, out = np.frombuffer(sums, np.float64), []
        for k in shapes:
            n = int(np.prod(k))
            out.append(flat[:n].reshape(k))
            flat = flat[n:]
        return out

    def own(batches):
        total = None
        for b in batches:
            if len(b):
                arrays = [np.asarray(a, np.float64) for a in block(b)]
                total = arrays if total is None else [x + y for x, y in zip(total, arrays)]
        if total is not None:
            yield row(total)

    def together(batches):
        total = None
        for b in batches:
            for s, k in zip(b.column("sums").to_pylist(), b.column("shapes").to_pylist()):
                arrays = arrays_of(s, k)
                total = arrays if total is None else [x + y for x, y in zip(total, arrays)]
        if total is not None:
            yield row(total)

    rows = df.mapInArrow(own, schema).repartition(LAST_BLOCKS).mapInArrow(together, schema).collect()  # LAST_BLOCKS rows
    parts = [arrays_of(r["sums"], r["shapes"]) for r in rows]
    return [sum(p) for p in zip(*parts)]


def with_one(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.ones(len(x))])


def _width(df: DataFrame, vec: str) -> int:
    first = df.select(F.size(vec).alias("d")).first()
    return first["d"] if first else 0


# ---- outer products: X4, X7 ---------------------------------------------------------------
def gram(df: DataFrame, vec: str, target: str | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, sum of z z' and sum of y z for z = (vector, 1). Rows with a null are left out."""
    cols = [vec] + ([target] if target else [])
    df = df.select(*cols).dropna()
    d = _width(df, vec) + 1
    if d > MOST_UNKNOWNS:
        raise ValueError(f"vectors of {d - 1} numbers; at most {MOST_UNKNOWNS - 1} are solved for")

    def block(batch):
        z = with_one(matrix(batch.column(vec)))
        y = batch.column(target).to_numpy(zero_copy_only=False).astype(np.float64) if target else np.zeros(len(z))
        return np.array([float(len(z))]), z.T @ z, z.T @ y

    out = summed(df, block)
    return (int(out[0][0]), out[1], out[2]) if out else (0, np.zeros((d, d)), np.zeros(d))


def least_squares(df: DataFrame, target: str, vec: str = "vec", reg: float = 0.0) -> np.ndarray:
    """Weights and intercept (last) that minimise the squared error plus ``reg`` * n * |w|^2, from
    one pass; of equally good ones the shortest."""
    n, zz, zy = gram(df, vec, target)
    ridge = np.diag([reg * n] * (len(zy) - 1) + [0.0])
    return np.linalg.lstsq(zz + ridge, zy, rcond=None)[0]


def dot(vec: str, weights: Sequence[float]) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(vec, w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def predicted(df: DataFrame, weights: np.ndarray, vec: str = "vec", out: str = "prediction") -> DataFrame:
    return df.withColumn(out, dot(vec, weights[:-1]) + F.lit(float(weights[-1])))


def principal_axes(df: DataFrame, k: int, vec: str = "vec") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the ``k`` directions of most variance (rows, unit length, largest part positive) and
    the variances along them."""
    n, zz, _ = gram(df, vec)
    if not n:
        raise ValueError("no vectors")
    mean = zz[-1, :-1] / n
    cov = zz[:-1, :-1] / n - np.outer(mean, mean)
    value, axes = np.linalg.eigh(cov)
    axes, value = axes[:, ::-1][:, :k].T, value[::-1][:k]
    sign = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return mean, axes * sign[:, None], value


def projected(df: DataFrame, mean: np.ndarray, axes: np.ndarray, vec: str = "vec", out: str = "pcs") -> DataFrame:
    """Coordinates of each vector, centred, along the axes."""
    centre = F.zip_with(vec, F.array(*[F.lit(float(m)) for m in mean]), lambda a, b: a - b)
    df = df.withColumn("_centred", centre)
    return df.withColumn(out, F.array(*[dot("_centred", a) for a in axes])).drop("_centred")


# ---- logistic heads: X3, X5 -----------------------------------------------------------------
def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _newton(sums: Callable[[np.ndarray], tuple[float, np.ndarray, list[np.ndarray]]], start: np.ndarray, tol: float, max_iter: int) -> np.ndarray:
    """Minimise a convex loss: ``sums(w)`` gives loss, gradient and the diagonal blocks of the second
    derivative. Steps that raise the loss are halved."""
    w, step = start, np.zeros_like(start)
    before = np.inf
    for _ in range(max_iter):
        loss, grad, blocks = sums(w)
        if loss > before + 1e-12 * abs(before) and np.abs(step).max() > 1e-12:
            step = step / 2
            w = w - step
            continue
        if np.abs(grad).max() <= tol:
            return w
        before = loss
        flat, at = -grad.ravel(), 0
        step = np.empty_like(flat)
        for h in blocks:
            # the gradient has no part in directions that change nothing (a shift of all classes' intercepts)
            step[at:at + len(h)] = np.linalg.solve(h + 1e-13 * np.abs(h).max() * np.eye(len(h)), flat[at:at + len(h)])
            at += len(h)
        step = step.reshape(w.shape)
        w = w + step
    raise RuntimeError(f"gradient above {tol} after {max_iter} passes")


def _penalty(w: np.ndarray, reg: float) -> np.ndarray:
    p = reg * w
    p[:, -1] = 0.0  # intercepts are free
    return p


def fit_heads(df: DataFrame, labels: Sequence[str], vec: str = "vec", reg: float = 1e-3, tol: float = 1e-9,
              max_iter: int = 60) -> np.ndarray:
    """One logistic head per 0/1 label column, all in the same passes over the rows. Minimises the
    mean loss plus ``reg`` / 2 * |w|^2 until every partial derivative is at most ``tol``. Returns one
    row of weights and intercept per label."""
    df = df.select(vec, *[F.col(c).cast("double").alias(c) for c in labels]).dropna()
    d, labels = _width(df, vec) + 1, list(labels)
    if d > MOST_UNKNOWNS:
        raise ValueError(f"vectors of {d - 1} numbers; at most {MOST_UNKNOWNS - 1} are solved for")
    context = df.sparkSession.sparkContext

    def sums(w):
        given = context.broadcast(w)

        def block(batch):
            x = with_one(matrix(batch.column(vec)))
            y = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in labels])
            z = x @ given.value.T
            p = sigmoid(z)
            curve = [(x * (p[:, k] * (1 - p[:, k]))[:, None]).T @ x for k in range(len(labels))]
            return np.array([len(x), (np.logaddexp(0.0, z) - y * z).sum()]), (p - y).T @ x, np.stack(curve)

        (n, loss), grad, curve = summed(df, block)
        given.unpersist()
        ridge = np.diag([reg] * (d - 1) + [0.0])
        return loss / n + reg / 2 * (w[:, :-1] ** 2).sum(), grad / n + _penalty(w, reg), [c / n + ridge for c in curve]

    return _newton(sums, np.zeros((len(labels), d)), tol, max_iter)


def fit_softmax(df: DataFrame, label: str, classes: Sequence, vec: str = "vec", reg: float = 1e-3, tol: float = 1e-9,
                max_iter: int = 60) -> np.ndarray:
    """Multinomial logistic regression over the given classes (rows of others are left out), to the
    same criterion as :func:`fit_heads`. Returns one row of weights and intercept per class."""
    classes = list(classes)
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    df = df.select(vec, place.cast("int").alias("_y")).dropna().where("_y >= 0")
    k, d = len(classes), _width(df, vec) + 1
    if k * d > MOST_UNKNOWNS:
        raise ValueError(f"{k} classes of vectors of {d - 1} numbers; at most {MOST_UNKNOWNS} unknowns are solved for")
    context = df.sparkSession.sparkContext

    def sums(w):
        given = context.broadcast(w)

        def block(batch):
            x, y = with_one(matrix(batch.column(vec))), batch.column("_y").to_numpy()
            z = x @ given.value.T
            p = softmax(z)
            top = z.max(axis=1)
            loss = (top + np.log(np.exp(z - top[:, None]).sum(axis=1)) - z[np.arange(len(y)), y]).sum()
            curve = np.empty((k, d, k, d))
            for a in range(k):
                for b in range(a, k):
                    curve[a, :, b] = (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x
                    curve[b, :, a] = curve[a, :, b].T
            p[np.arange(len(y)), y] -= 1.0
            return np.array([len(x), loss]), p.T @ x, curve.reshape(k * d, k * d)

        (n, loss), grad, curve = summed(df, block)
        given.unpersist()
        ridge = np.diag(([reg] * (d - 1) + [0.0]) * k)
        return loss / n + reg / 2 * (w[:, :-1] ** 2).sum(), grad / n + _penalty(w, reg), [curve / n + ridge]

    return _newton(sums, np.zeros((k, d)), tol, max_iter)


def scores(vec: str, weights: np.ndarray) -> Column:
    """Array of w . x + b, one per row of ``weights``."""
    return F.array(*[dot(vec, w[:-1]) + F.lit(float(w[-1])) for w in weights])


def head_probabilities(vec: str, weights: np.ndarray) -> Column:
    return F.transform(scores(vec, weights), lambda z: 1.0 / (1.0 + F.exp(-z)))


def class_probabilities(vec: str, weights: np.ndarray) -> Column:
    z = scores(vec, weights)
    e = F.transform(F.zip_with(z, F.array_repeat(F.array_max(z), len(weights)), lambda a, top: a - top), lambda x: F.exp(x))
    return F.zip_with(e, F.array_repeat(F.aggregate(e, F.lit(0.0), lambda s, x: s + x), len(weights)), lambda x, s: x / s)


def gradient_table(df: DataFrame, errors: Column, names: Sequence, weights: np.ndarray, reg: float, vec: str = "vec") -> DataFrame:
    """(name, dim, gradient) of the mean loss plus penalty at ``weights``: ``errors`` is the array of
    probability minus truth per name; the last dim is the intercept."""
    rows = df.select(F.concat(vec, F.array(F.lit(1.0))).alias("_x"), errors.alias("_e")).select("_x", F.posexplode("_e").alias("_k", "_err"))
    parts = (rows.select("_k", "_err", F.posexplode("_x").alias("dim", "_v")).groupBy("_k", "dim")
             .agg((F.sum(F.col("_err") * F.col("_v")) / F.count("*")).alias("_g")))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_k") + 1)
    pull = F.element_at(F.element_at(F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in _penalty(weights.copy(), reg)]),
                                     F.col("_k") + 1), F.col("dim") + 1)
    return parts.select(name.alias("name"), "dim", (F.col("_g") + pull).alias("gradient"))

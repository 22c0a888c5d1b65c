"""Whitening of embeddings by singular values of the centred rows, without forming their covariance.

Entries become integers, as the query's contract says. Three passes over the table, each a row a task:

1. the number of rows and exact sums per dimension, for the mean;
2. blockwise QR: a task stacks blocks of centred rows under its triangular factor and keeps only the new factor;
   the tasks' factors are joined the same way, `FAN` at a time, until one is left;
3. the covariance of the whitened rows, centred in each block and joined like the factors, as a check.

The one factor R (a square of the dimension, whatever the number of rows) goes to the driver. Householder
reflections make it bidiagonal, the dqds algorithm finds its squared singular values with shifts that never pass the
smallest, and twisted factorisations of the shifted product give an eigenvector each, which the reflections take back.
Vectors of values that lie very close together are made orthogonal and turned so that they stay uncorrelated.

Rows: a vector that is null or holds null or non-finite entries is dropped; all others need the same length, or a
ValueError is raised. An entry whose integer does not fit 53 bits raises an OverflowError. Repeated rows count each
time; a null id stays null. Components are those with a variance above rounding, so an empty table, empty vectors and
vectors that are all the same give no rows. A deviation beyond 64 bits is null. Memory follows `BLOCK_ROWS` times the
dimension.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketpulse.llm import frames

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
BLOCK_ROWS = 8192
#: Factors that are joined at a time.
FAN = 32
#: Values closer than this, relative to the largest, are treated as a cluster.
CLOSE = 1e-7

_EPS = np.finfo(np.float64).eps


# Rows


def integers(column: pa.Array, ids: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column that are whole, as a matrix of integers, and their numbers in the column."""
    sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    values = pc.list_flatten(column)
    numbers = values.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    bad = ~np.isfinite(numbers) | np.asarray(pc.is_null(values))
    held = np.maximum(sizes, 0)
    sums = np.concatenate([[0], np.cumsum(bad)])
    ends = np.cumsum(held)
    rows = np.flatnonzero((sizes >= 0) & (sums[ends] == sums[ends - held]))
    if not len(rows):
        return np.zeros((0, 0), np.int64), rows
    width = int(sizes[rows[0]])
    if (sizes[rows] != width).any():
        raise ValueError("vectors have different lengths")
    at = (ends - held)[rows][:, None] + np.arange(width)
    x = np.floor(SCALE * numbers[at])
    if len(x) and width and np.abs(x).max() >= 1 << 53:
        raise OverflowError("an entry is too large for an integer of 53 bits")
    return x.astype(np.int64) + SHIFT, rows


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    """Blocks of whole rows and the batch rows that they are from."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            x, rows = integers(part.column("vector"))
            if len(rows):
                yield x, part.take(pa.array(rows))


# Joining what tasks found


def _joined(found: DataFrame, combine: Callable[[list[bytes]], bytes]) -> bytes | None:
    """Joins the tasks' states (part long, state binary), FAN at a time, until one is left."""
    parts = found.rdd.getNumPartitions()

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("part")
        return pa.table({"part": [rows["part"][0].as_py()], "state": [combine(rows["state"].to_pylist())]})

    span = 1
    while span < parts:
        span *= FAN
        found = found.groupBy(F.expr(f"part div {span}")).applyInArrow(run, "part long, state binary")
    states = [bytes(r.state) for r in found.select("state").collect()]
    return combine(states) if states else None


def _per_task(rows: DataFrame, build: Callable[[Iterator[np.ndarray]], bytes | None]) -> DataFrame:
    """One state of each task that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = build(x for x, _ in _blocks(batches))
        if state is not None:
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"part": [part], "state": [state]})

    return rows.mapInArrow(run, "part long, state binary")


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of whole rows, and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for x, _ in _blocks(batches):
            if sums is not None and len(sums) != x.shape[1]:
                raise ValueError("vectors have different lengths")
            n, sums = n + len(x), x.sum(axis=0) + (0 if sums is None else sums)
        if n:
            size = len(sums)
            yield pa.RecordBatch.from_pydict({"dim": [-1, *range(size)], "total": [n, *sums.tolist()], "width": [size] * (size + 1)})

    found = rows.mapInArrow(run, "dim long, total long, width long")
    by_dim = found.groupBy("dim").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.min("width").alias("low"), F.max("width").alias("high")
    )
    rows_ = {r.dim: r for r in by_dim.collect()}  # one row a dimension
    if not rows_:
        return 0, []
    if rows_[-1].low != rows_[-1].high:
        raise ValueError("vectors have different lengths")
    return int(rows_[-1].total), [int(rows_[k].total) for k in range(rows_[-1].high)]


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The triangular factor of rows, with a row for each dimension."""
    r = np.linalg.qr(rows, mode="r")
    width = rows.shape[1]
    return r if len(r) == width else np.concatenate([r, np.zeros((width - len(r), width))])


def factor(rows: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of the QR factorisation of all centred rows."""
    width = len(mean)

    def build(blocks: Iterator[np.ndarray]) -> bytes | None:
        r = None
        for x in blocks:
            centred = x - mean
            r = _triangle(centred if r is None else np.concatenate([r, centred]))
        return None if r is None else r.tobytes()

    def combine(states: list[bytes]) -> bytes:
        stacked = np.concatenate([np.frombuffer(s).reshape(width, width) for s in states])
        return _triangle(stacked).tobytes()

    return np.frombuffer(_joined(_per_task(rows, build), combine)).reshape(width, width)


# Singular values of R


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and upper diagonal of U' R V, and the Householder vectors of V."""
    a = np.array(r, np.float64)
    n = len(a)
    right: list[np.ndarray] = []

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if not size or not np.any(x[1:]):
            return None
        v = x.copy()
        v[0] += np.copysign(size, x[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        v = reflector(a[k:, k])
        if v is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        w = reflector(a[k, k + 1 :]) if k + 2 < n else None
        right.append(w)
        if w is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """A dqds transform with a shift: new q, new e, and the intermediate d."""
    d = q[0] - shift
    new_q, new_e, every = [], [], [d]
    for k in range(len(e)):
        total = d + e[k]
        ratio = q[k + 1] / total if total else 0.0
        new_q.append(total)
        new_e.append(e[k] * ratio)
        d = d * ratio - shift
        every.append(d)
    new_q.append(d)
    return new_q, new_e, every


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, in falling order.

    A Newton step from below, 1 / sum(1 / d), never passes the smallest value. Larger steps are tried while they
    succeed; a step that makes a d negative went too far and is taken back.
    """
    scale = max(np.abs(diagonal).max(initial=0), np.abs(upper).max(initial=0)) or 1.0
    values: list[float] = []
    todo = [([float(x) for x in (diagonal / scale) ** 2], [float(x) for x in (upper / scale) ** 2], 0.0)]
    tiny = np.finfo(np.float64).tiny
    while todo:
        q, e, moved = todo.pop()
        boost = 1.0
        while len(q) > 1:
            n = len(q)
            cut = next((k for k in range(n - 2, -1, -1) if e[k] <= tiny or e[k] <= _EPS**2 * (moved + q[k] + q[k + 1])), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], moved))
                q, e = q[cut + 1 :], e[cut + 1 :]
                boost = 1.0
                continue
            if e[-1] <= _EPS * (moved + q[-1]) * _EPS:
                break
            # The d of a sweep without a shift are the inverse diagonal of the inverse.
            _, _, d = _sweep(q, e, 0.0)
            step = 0.0 if min(d) <= 0 else 1.0 / sum(1.0 / x for x in d)
            if moved and step <= _EPS * moved:  # as near as the numbers tell
                step = 0.0
            shift = min(step * boost, min(d) * (1 - 4 * _EPS))
            new_q, new_e, d = _sweep(q, e, shift)
            if min(d) < 0 and shift > step:
                boost, shift = 1.0, step
                new_q, new_e, d = _sweep(q, e, shift)
            elif shift:
                boost *= 2
            if min(d) < 0:
                shift = 0.0
                new_q, new_e, d = _sweep(q, e, 0.0)
            q, e, moved = new_q, new_e, moved + shift
        values += [moved + max(q[-1], 0.0)]
        if len(q) > 1:
            todo.append((q[:-1], e[:-1], moved))
    return np.sort(np.array(values))[::-1] * scale**2


# Vectors


def twisted(diagonal: np.ndarray, upper: np.ndarray, value: float, place: int = 0) -> tuple[np.ndarray, float]:
    """An eigenvector of B'B near a value, by the twisted factorisation of B'B - value, and the value that it has.

    `place` takes the twist with the (place + 1)-th smallest pivot instead of the smallest.
    """
    n = len(diagonal)
    if n == 1:
        return np.ones(1), float(diagonal[0] ** 2)
    least = _EPS * (np.abs(diagonal).max() + np.abs(upper).max())
    a = np.where(np.abs(diagonal) < least, least, diagonal)
    d = (a**2).tolist()
    low = (upper / a[:-1]).tolist()
    pivot = np.finfo(np.float64).tiny ** 0.5
    s, plus = [-value], []
    for k in range(n - 1):
        total = s[k] + d[k] or pivot
        plus.append(d[k] * low[k] / total)
        s.append(plus[k] * low[k] * s[k] - value)
    p, minus = [0.0] * n, [0.0] * (n - 1)
    p[-1] = d[-1] - value
    for k in range(n - 2, -1, -1):
        total = d[k] * low[k] ** 2 + p[k + 1] or pivot
        ratio = d[k] / total
        minus[k] = low[k] * ratio
        p[k] = p[k + 1] * ratio - value
    gamma = np.array(s) + np.array(p) + value
    twist = int(np.argsort(np.abs(gamma), kind="stable")[min(place, n - 1)])
    z = np.zeros(n)
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -plus[k] * z[k + 1]
    for k in range(twist, n - 1):
        z[k + 1] = -minus[k] * z[k]
    size = np.linalg.norm(z)
    return z / size, value + float(gamma[twist]) / size**2


def _rotated(product: np.ndarray) -> np.ndarray:
    """Rotations that make the columns of a narrow matrix orthogonal, by one-sided Jacobi steps."""
    a = product.copy()
    turn = np.eye(a.shape[1])
    for _ in range(60):
        off = 0.0
        for i in range(a.shape[1]):
            for j in range(i + 1, a.shape[1]):
                x, y, z = a[:, i] @ a[:, i], a[:, j] @ a[:, j], a[:, i] @ a[:, j]
                if abs(z) <= _EPS * np.sqrt(x * y):
                    continue
                off = max(off, abs(z))
                t = (y - x) / (2 * z)
                t = (1.0 if t >= 0 else -1.0) / (abs(t) + np.hypot(1.0, t))
                c = 1 / np.hypot(1.0, t)
                for m in (a, turn):
                    m[:, i], m[:, j] = c * m[:, i] - c * t * m[:, j], c * t * m[:, i] + c * m[:, j]
        if not off:
            break
    order = np.argsort(-np.linalg.norm(a, axis=0), kind="stable")
    return turn[:, order]


def directions(r: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest eigenvalues of R'R, unit eigenvectors as columns, and the sum of all eigenvalues."""
    diagonal, upper, right = bidiagonal(r)
    every = dqds(diagonal, upper)
    n = len(every)
    if not n or every[0] <= 0:
        return np.zeros(0), np.zeros((n, 0)), 0.0
    kept = int(min(wanted, (every > (n * _EPS) ** 2 * 16 * every[0]).sum()))
    last = kept
    while last < n and every[last - 1] - every[last] <= CLOSE * every[0]:  # a cluster is taken whole
        last += 1
    b = np.diag(diagonal) + np.diag(upper, 1)
    z, first = np.zeros((n, last)), 0
    rng = np.random.default_rng(1)
    for k in range(last):
        if k and every[k - 1] - every[k] > CLOSE * every[0]:
            first = k
        value, vector = every[k], None
        for trial in range(4):
            found, better = twisted(diagonal, upper, value, place=0)
            if k > first or trial:  # in a cluster: what is left beside the vectors before
                start = found if trial < 2 else rng.standard_normal(n)
                found = start - z[:, first:k] @ (z[:, first:k].T @ start)
                if k > first and np.linalg.norm(found) < 0.1:
                    found, _ = twisted(diagonal, upper, value, place=k - first + trial)
                    found -= z[:, first:k] @ (z[:, first:k].T @ found)
            size = np.linalg.norm(found)
            if size > 1e-3 and np.linalg.norm(b.T @ (b @ (found / size)) - value * found / size) < 1e-9 * every[0]:
                vector = found / size
                vector -= z[:, first:k] @ (z[:, first:k].T @ vector)
                vector /= np.linalg.norm(vector)
                break
            value = value * (1 + (2 * trial + 1) * 4 * _EPS) if trial else better
        if vector is None:
            vector = _inverse_iteration(b, every[k], z[:, first:k], rng)
        z[:, k] = vector
    for k in range(last):  # turn each cluster so that its vectors are uncorrelated
        stop = k + 1
        while stop < last and every[stop - 1] - every[stop] <= CLOSE * every[0]:
            stop += 1
        if stop > k + 1 and (not k or every[k - 1] - every[k] > CLOSE * every[0]):
            z[:, k:stop] = z[:, k:stop] @ _rotated(b @ z[:, k:stop])
    z = z[:, :kept]
    for k in range(n - 1, -1, -1):
        if right[k] is not None:
            z[k + 1 :] -= 2 * np.outer(right[k], right[k] @ z[k + 1 :])
    return every[:kept], z, float(every.sum())


def _inverse_iteration(b: np.ndarray, value: float, others: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A vector of a very tight cluster, orthogonal to those that it has already."""
    n = len(b)
    shifted = b.T @ b - (value * (1 + 8 * _EPS)) * np.eye(n)
    x = rng.standard_normal(n)
    for _ in range(4):
        x -= others @ (others.T @ x)
        x = np.linalg.lstsq(shifted, x / np.linalg.norm(x), rcond=None)[0]
    x -= others @ (others.T @ x)
    x /= np.linalg.norm(x)
    x -= others @ (others.T @ x)
    return x / np.linalg.norm(x)


# The operator


@dataclass(frozen=True)
class Whitening:
    """n rows, their sums, unit directions as columns, variances along them, and their shares of all variance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.vectors / np.sqrt(self.variances))

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums over dimensions of (n x - S)^2, exact; null where 64 bits are too few."""
        sums = np.array(self.sums, object)
        reach = float(self.n) * float(np.abs(x).max(initial=0)) + float(max(map(abs, self.sums), default=0))
        if len(self.sums) * reach**2 < 2**62:
            off = self.n * x - np.array(self.sums, np.int64)
            return pa.array((off * off).sum(axis=1), pa.int64())
        rough = ((x - self.mean) ** 2).sum(axis=1) * float(self.n) ** 2
        if reach < 2**62 and rough.max(initial=0) < 2**62:
            off = self.n * x - np.array(self.sums, np.int64)
            return pa.array((off * off).sum(axis=1), pa.int64())
        exact = ((self.n * x.astype(object) - sums) ** 2).sum(axis=1)
        return pa.array([v if v < 1 << 63 else None for v in exact.tolist()], pa.int64())


def _vectors(frame: DataFrame, vector_col: str, id_col: str) -> DataFrame:
    frames.ship(frame.sparkSession)
    return frame.select(frame[id_col].alias("vec_id"), frame[vector_col].alias("vector"))


def fit(frame: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> Whitening:
    rows = _vectors(frame, vector_col, id_col)
    n, sums = totals(rows)
    width = len(sums)
    if not width:
        return Whitening(n, sums, np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    r = factor(rows, np.array([s / n for s in sums]))
    squares, vectors, total = directions(r, components)
    # Sums of n values near S/n carry an error of that size: less variance than it is no variance.
    real = squares / n > (4 * _EPS * max(abs(s) / n for s in sums)) ** 2 * width
    squares, vectors = squares[real], vectors[:, real]
    return Whitening(n, sums, vectors, squares / n, squares / total if total else squares)


def covariance(frame: DataFrame, fitted: Whitening, vector_col: str = "embedding", id_col: str = "vec_id") -> np.ndarray:
    """The covariance of the whitened rows, from the rows."""
    size = len(fitted.variances)

    def merged(parts: Sequence[tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
        n = sum(p[0] for p in parts)
        mean = sum(p[0] * p[1] for p in parts) / n
        spread = sum(p[2] + p[0] * np.outer(p[1] - mean, p[1] - mean) for p in parts)
        return n, mean, spread

    def packed(part) -> bytes:
        return np.concatenate([[part[0]], part[1], part[2].ravel()]).tobytes()

    def unpacked(state: bytes):
        x = np.frombuffer(state)
        return x[0], x[1 : 1 + size], x[1 + size :].reshape(size, size)

    def build(blocks: Iterator[np.ndarray]) -> bytes | None:
        found = None
        for x in blocks:
            w = fitted.apply(x)
            mean = w.mean(axis=0)
            part = float(len(w)), mean, (w - mean).T @ (w - mean)
            found = part if found is None else merged([found, part])
        return None if found is None else packed(found)

    def combine(states: list[bytes]) -> bytes:
        return packed(merged([unpacked(s) for s in states]))

    rows = _vectors(frame, vector_col, id_col)
    n, _, spread = unpacked(_joined(_per_task(rows, build), combine))
    return spread / n


def whiten(frame: DataFrame, fitted: Whitening, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """Per whole row: vec_id, deviation, whitened (a list, an entry a component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, part in _blocks(batches):
            w = fitted.apply(x)
            offsets = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), fitted.deviations(x), lists], ["vec_id", "deviation", "whitened"])

    rows = _vectors(frame, vector_col, id_col)
    kind = dict(rows.dtypes)["vec_id"]
    return rows.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def report(frame: DataFrame) -> DataFrame:
    """A row for each whole row and component."""
    fitted = fit(frame)
    size = len(fitted.variances)
    error = float(np.abs(covariance(frame, fitted) - np.eye(size)).max()) if size else 0.0
    rows = whiten(frame, fitted) if size else _nothing(frame)
    shares = F.array(*[F.lit(float(x)) for x in fitted.explained]).cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("k") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def _nothing(frame: DataFrame) -> DataFrame:
    none = F.lit(None)
    rows = frame.select("vec_id", none.cast("long").alias("deviation"), none.cast("array<double>").alias("whitened"))
    return rows.where("false")

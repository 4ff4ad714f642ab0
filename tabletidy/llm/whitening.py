"""Embedding whitening (operator 11): principal components of a distributed covariance.

1. *Vectors.* Each entry c becomes the integer ``floor(256 c)``; a vector is packed with the least
   width that holds its entries, so equal vectors are equal bytes. Each distinct vector
   stands once in the fit list (a common one combines within its task before it moves).
2. *Covariance.* A pass over the fit list sums the vectors exactly; the next centres every
   vector by these sums before it multiplies. A task keeps one matrix, and the tasks' matrices
   are added in two levels.
3. *Components.* On the one matrix that is left: Householder reflections make it tridiagonal,
   bisection on Sturm counts finds the leading eigenvalues, inverse iteration with partial pivoting
   their vectors, each made orthogonal to those of its cluster of eigenvalues again and again.
4. *Projection.* Mean and components go to all tasks (their size is that of the dimension).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletidy.llm.common import reachable, staged

SCALE = 256
LIMIT = 2.0**62
EPS = float(np.finfo(np.float64).eps)
#: Eigenvalues nearer than this share of the largest form a cluster.
CLUSTER = 1e-3
BUCKETS = 256
SLICE = 1 << 20  # entries that a task holds at a time
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


# --- vectors -------------------------------------------------------------------------------


def pack(x: np.ndarray) -> list[bytes]:
    """Rows of integers as bytes: the width in bytes, then the entries."""
    top = np.maximum(x.max(axis=1), -1 - x.min(axis=1))
    out: list[bytes] = [b""] * len(x)
    widths = np.select([top < 1 << 7, top < 1 << 15, top < 1 << 31], [1, 2, 4], 8)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        rows = x[at].astype(f"<i{width}")
        for i, row in zip(at.tolist(), rows):
            out[i] = bytes([width]) + row.tobytes()
    return out


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    """Packed vectors of one dimension as rows of 64-bit integers."""
    data = column.to_pylist()
    out = np.empty((len(data), dim), np.int64)
    widths = np.array([v[0] for v in data], np.int8)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        joined = b"".join(data[i][1:] for i in at)
        out[at] = np.frombuffer(joined, f"<i{width}").reshape(len(at), dim)
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, vector) -> (vec_id, dim, packed) of the vectors whose entries all have an integer."""
    for batch in batches:
        lengths = np.array(pc.fill_null(pc.list_value_length(batch.column(1)), 0))
        for dim in np.unique(lengths[lengths > 0]).tolist():
            rows = np.flatnonzero(lengths == dim)
            for at in np.array_split(rows, max(1, len(rows) * dim // SLICE)):
                if not len(at):
                    continue
                part = batch.take(pa.array(at))
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                with np.errstate(invalid="ignore", over="ignore"):
                    scaled = np.floor(SCALE * values)
                    good = np.flatnonzero((np.abs(scaled) < LIMIT).all(axis=1))
                ids = part.column(0).take(pa.array(good))
                keys = pa.array(pack(scaled[good].astype(np.int64)) if len(good) else [], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array([dim] * len(good), pa.int32()), keys], names=["vec_id", "dim", "key"])


# --- sums over all tasks -------------------------------------------------------------------


def _whole(blob: bytes) -> np.ndarray:
    return np.array([int(v) for v in blob.split(b",")], object)


def _text(state: np.ndarray) -> bytes:
    return b",".join(b"%d" % v for v in state)


def _double(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<f8")


def _bytes(state: np.ndarray) -> bytes:
    return state.astype("<f8").tobytes()


def summed(vectors: DataFrame, dim: int, of: Callable[[np.ndarray], np.ndarray], load: Callable = _double, dump: Callable = _bytes) -> np.ndarray | None:
    """The sum of ``of(rows)`` over all rows of the packed column ``key``; None if there are none.

    A task adds up its own rows; the tasks' sums are added per bucket, then the buckets' sums.
    A task holds two sums at a time.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            keys = batch.column(0)
            for at in range(0, len(keys), max(1, SLICE // dim)):
                part = of(unpack(keys.slice(at, max(1, SLICE // dim)), dim))
                total = part if total is None else total + part
        if total is not None:
            bucket = TaskContext.get().partitionId() % BUCKETS
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([dump(total)], pa.binary())], names=["bucket", "state"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for bucket, state in zip(batch.column(0).to_pylist(), batch.column(1)):
                if bucket != now and total is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([dump(total)], pa.binary())], names=["bucket", "state"])
                    total = None
                now, part = bucket, load(state.as_py())
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([dump(total)], pa.binary())], names=["bucket", "state"])

    kind = "bucket int, state binary"
    parts = vectors.select("key").mapInArrow(first, kind)
    level = parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(again, kind)
    found = level.repartition(1).mapInArrow(again, kind).select("state").first()
    return load(bytes(found[0])) if found else None


def _sums(x: np.ndarray) -> np.ndarray:
    """Number of rows and the exact sums per entry."""
    high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
    return np.array([len(x), *(int(h) * (1 << 32) + int(v) for h, v in zip(high, low))], object)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n x - sums``, exact: 64-bit integers where they fit, Python's elsewhere."""
    top = max(abs(int(x.max())), abs(int(x.min())), 1)
    if n * top + max(abs(int(s)) for s in sums) < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Per row the exact sum of ``(n x - sums)^2``."""
    y, dim = centred(x, n, sums), x.shape[1]
    if y.dtype != object and max(int(y.max()), -int(y.min()), 1) ** 2 * dim < 1 << 63:
        return (y * y).sum(axis=1).tolist()
    top = max(abs(int(x.max())), abs(int(x.min())), 1)
    high = np.array([int(s) >> 31 for s in sums], object)
    if top * top * dim < 1 << 62 and top * dim * max(1 << 31, *(abs(h) for h in high)) < 1 << 62:
        # n^2 x.x - 2 n x.S + S.S, with the long products on one number per row
        low = np.array([int(s) & 0x7FFFFFFF for s in sums], np.int64)
        square, by_low, by_high = (x * x).sum(axis=1).astype(object), (x @ low).astype(object), (x @ high.astype(np.int64)).astype(object)
        return list(n * n * square - 2 * n * (by_low + by_high * (1 << 31)) + sum(int(s) ** 2 for s in sums))
    return [sum(int(v) ** 2 for v in row) for row in y]


# --- eigenvectors of one matrix ------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder: diagonal, second diagonal and the orthogonal q with ``a = q t q'``."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        rest = np.linalg.norm(x[1:])
        if rest == 0:
            continue
        length = -math.copysign(math.hypot(x[0], rest), x[0])
        v = x.copy()
        v[0] -= length
        v /= np.linalg.norm(v)
        below = a[k + 1 :, k + 1 :]
        p = below @ v
        w = p - (v @ p) * v
        below -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1, k], a[k + 2 :, k] = length, 0
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def counts_below(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm: how many eigenvalues of the tridiagonal matrix lie below each of ``at``."""
    tiny = EPS * EPS * max(1e-300, float(np.abs(diag).max()), float(np.abs(off).max(initial=0)))
    step, found = diag[0] - at, np.zeros(len(at), int)
    for i in range(len(diag)):
        if i:
            step = diag[i] - at - off[i - 1] ** 2 / step
        step = np.where(np.abs(step) < tiny, -tiny, step)
        found += step < 0
    return found


def leading_values(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, by bisection until no double lies between."""
    n = len(diag)
    around = np.zeros(n)
    around[:-1] += np.abs(off)
    around[1:] += np.abs(off)
    span = 2 * EPS * n * (np.abs(diag) + around).max() + 1e-300
    low, high = np.full(k, (diag - around).min() - span), np.full(k, (diag + around).max() + span)
    rank = n - 1 - np.arange(k)  # as many eigenvalues lie below
    while True:
        middle = low + (high - low) / 2
        open_ = (middle > low) & (middle < high) & (high - low > span * EPS)
        if not open_.any():
            return middle
        under = counts_below(diag, off, middle) <= rank
        low, high = np.where(open_ & under, middle, low), np.where(open_ & ~under, middle, high)


def solve_shifted(diag: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """``(t - shift) z = right`` by elimination with partial pivoting; a zero pivot becomes ``tiny``."""
    n = len(diag)
    d, e, b = (diag - shift).tolist(), [*off.tolist(), 0.0], right.tolist()
    rows = []  # pivot, next and second next entry of each row of the triangle
    here, after, value = d[0], e[0], b[0]
    for i in range(n - 1):
        below, own, more = e[i], d[i + 1], e[i + 1]
        if abs(here) >= abs(below):
            here = here or tiny
            rows.append((here, after, 0.0, value))
            factor = below / here
            here, after, value = own - factor * after, more, b[i + 1] - factor * value
        else:
            factor = here / below
            rows.append((below, own, more, b[i + 1]))
            here, after, value = after - factor * own, -factor * more, value - factor * b[i + 1]
    rows.append((here if abs(here) > tiny else math.copysign(tiny, here), 0.0, 0.0, value))
    z = [0.0] * (n + 2)
    for i in range(n - 1, -1, -1):
        pivot, one, two, value = rows[i]
        pivot = pivot if abs(pivot) > tiny else math.copysign(tiny, pivot)
        z[i] = (value - one * z[i + 1] - two * z[i + 2]) / pivot
    return np.array(z[:n])


def _leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``k`` leading eigenvalues of the symmetric ``v``, falling, and their unit vectors as
    columns, the largest entry of each positive; values that rounding cannot tell from 0 go."""
    n, size = len(v), float(np.abs(v).max())
    if not size > 0:
        return np.empty(0), np.empty((n, 0))
    diag, off, q = tridiagonal(v / size)
    values = leading_values(diag, off, min(k, n))
    values = values[values > n * EPS * values[0]]
    norm = float(np.abs(diag).max() + 2 * np.abs(off).max(initial=0))
    found: list[np.ndarray] = []
    start = 0  # first of the cluster
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * values[0]:
            start = j
        shift = value - (j - start) * 4 * EPS * norm  # equal values get shifts of their own
        z = np.random.default_rng(j).standard_normal(n)
        for _ in range(12):
            z = solve_shifted(diag, off, shift, z / np.linalg.norm(z), EPS * norm)
            z /= np.abs(z).max()
            for _ in range(2):
                for other in found[start:j]:
                    z -= (other @ z) * other
            z /= np.linalg.norm(z)
            left = diag * z - value * z
            left[:-1] += off * z[1:]
            left[1:] += off * z[:-1]
            if np.linalg.norm(left) <= 2 * EPS * norm * math.sqrt(n):
                break
        found.append(z)
    vectors = q @ np.column_stack(found)
    vectors /= np.linalg.norm(vectors, axis=0)
    return values * size, vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(found))])


# --- the operator --------------------------------------------------------------------------


def whiten(vectors: DataFrame, components: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    A vector that is null, empty, or holds a null, a non-finite entry or one whose integer is not
    below 2^62 in magnitude gives no rows. All vectors of one fit have the dimension that most rows have
    (ties: the larger); others give no rows. A repeated vector counts once in the fit, and each of its
    rows comes back; null ids stay null. There are as many components as ``components`` or the rank
    allow: vectors that are all equal have none, so they give no rows, like an empty table.
    Equal eigenvalues give some orthogonal basis, the same for all rows. Other columns aren't read.

    ``n`` distinct vectors, ``deviation`` the exact sum of ``(n x - S)^2`` (null beyond 38 digits),
    ``whitened`` the centred vector on the component over the root of its eigenvalue, ``explained`` the
    eigenvalue over the trace, ``identity_error`` the largest entry of the whitened fit list's covariance
    less the identity, measured by a pass over the fit list. The driver holds one matrix of dimension
    squared; long vectors travel as at most their own width.
    """
    spark = vectors.sparkSession
    reachable(spark)
    taken = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    held = staged(taken.mapInArrow(_packed, "vec_id long, dim int, key binary"), "whitening-vectors")
    common = held.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], OUT)
    dim = int(common["dim"])
    held = held.where(F.col("dim") == dim)
    fit = staged(held.select("key").distinct(), "whitening-fit")
    n, *sums = summed(fit, dim, _sums, _whole, _text)
    sums = np.array(sums, object)

    def gram(x: np.ndarray) -> np.ndarray:
        y = (centred(x, n, sums) / n).astype(np.float64)
        return (y.T @ y).ravel()

    covariance = summed(fit, dim, gram).reshape(dim, dim) / n
    covariance = (covariance + covariance.T) / 2
    values, axes = _leading(covariance, components)
    if not len(values):
        return spark.createDataFrame([], OUT)
    explained = values / math.fsum(np.diag(covariance))
    scaled, k = axes / np.sqrt(values), len(values)
    sent = spark.sparkContext.broadcast((n, sums, scaled, explained))

    def moments(x: np.ndarray) -> np.ndarray:
        w = (centred(x, n, sums) / n).astype(np.float64) @ sent.value[2]
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    both = summed(fit, dim, moments) / n
    off = both[k:].reshape(k, k) - np.outer(both[:k], both[:k]) - np.eye(k)
    error = float(np.abs(off).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, scaled, explained = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, SLICE // dim)):
                part = batch.slice(at, max(1, SLICE // dim))
                x = unpack(part.column(1), dim)
                w = (centred(x, n, sums) / n).astype(np.float64) @ scaled
                far = deviations(x, n, sums)
                exact = pa.array([Decimal(v) if v < 10**38 else None for v in far], pa.decimal128(38, 0))
                rows = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(rows),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(x) * k, n, np.int64)),
                        exact.take(rows),
                        pa.array(w.ravel()),
                        pa.array(np.tile(explained, len(x))),
                        pa.array(np.full(len(x) * k, error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return held.select("vec_id", "key").mapInArrow(project, OUT)

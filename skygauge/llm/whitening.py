"""Whitening of embeddings through a bidiagonal qd solver.

Entries are put on a grid of whole numbers, x = floor(SCALE * entry) + SHIFT, so counts and sums are exact. The
covariance matrix is never formed:

1. The distinct vectors are centred exactly (n * x - S in whole numbers, then divided by n) and reduced to a
   triangle: each task folds its rows into one R by blockwise QR, and triangles are folded together in groups
   of FAN_IN until one is left. Cov = R'R / n.
2. Householder reflections make R bidiagonal, R = U B P'.
3. dqds finds the squared singular values of B, each to high relative accuracy.
4. The direction of each is read off twisted factorisations of B'B - s I: a stationary transform from the top and a
   progressive one from the bottom meet where their remainder is smallest. Directions of close
   values are made orthogonal to each other, as a twisted factorisation alone cannot tell them apart.

A component is a direction turned back by P. Rows are projected on it in Arrow batches.

Only n, S and the last R, of dimension x dimension, reach the driver, whatever the number of rows.

Defined results: rows whose vector is null or has a null, NaN or infinite entry, or one of 2^50 or more, are left out, and so are vectors
that have another length than most (on a tie: the longest); copies of a vector count once in the fit and each give rows;
components without variance (beyond rounding) give no rows, so a table with fewer than two distinct vectors
gives none; a deviation beyond a long is null; a null vec_id is kept; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skygauge.session import ship_package, stage

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
# Beyond this an entry has no place on the grid.
LARGEST = 2.0**50
FAN_IN = 16
ROWS_AT_ONCE = 4096
EPS = np.finfo(float).eps
# Singular values closer than this, relative to the larger, get orthogonalised directions.
CLOSE = 1e-3

# -- solver -----------------------------------------------------------------------------


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, P) with r = U B P' for some orthogonal U."""
    a = np.array(r, float)
    n = a.shape[1]
    if len(a) < n:
        a = np.vstack([a, np.zeros((n - len(a), n))])
    p = np.eye(n)
    for k in range(n):
        _reflect(a[k:, k:])
        if k < n - 2:
            # From the right: the same on the transposed rows, kept in P.
            v = _direction(a[k, k + 1 :])
            if v is not None:
                a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
                p[:, k + 1 :] -= 2 * np.outer(p[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), p


def _direction(x: np.ndarray) -> np.ndarray | None:
    """The unit vector whose reflection sends x to a multiple of the first axis."""
    largest = np.abs(x).max(initial=0.0)
    if largest == 0 or len(x) < 2:
        return None
    v = x / largest
    v[0] += math.copysign(np.linalg.norm(v), v[0])
    return v / np.linalg.norm(v)


def _reflect(a: np.ndarray) -> None:
    """Clears the first column of ``a`` below its head, in place."""
    v = _direction(a[:, 0].copy())
    if v is not None:
        a -= 2 * np.outer(v, v @ a)


def _dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One differential qd transform of B'B - shift and its least remainder; None if the shift was too large."""
    new_q, new_e = [], []
    d = least = q[0] - shift
    for above, below in zip(e, q[1:], strict=True):
        if d < 0:
            return None
        new_q.append(d + above)
        ratio = below / new_q[-1]
        new_e.append(above * ratio)
        d = d * ratio - shift
        least = min(least, d)
    new_q.append(d)
    return None if d < 0 else (new_q, new_e, least)


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling.

    Differential quotient-difference transforms with shifts below the smallest value left: each
    value is the sum of the shifts used up to its deflation, all of one sign, so it has a small relative error.
    """
    scale = max(np.abs(diagonal).max(initial=0.0), np.abs(above).max(initial=0.0))
    if scale == 0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    blocks = [([float(x / scale) ** 2 for x in diagonal], [float(x / scale) ** 2 for x in above], 0.0)]
    while blocks:
        q, e, base = blocks.pop()
        share = 0.75
        while len(q) > 1:
            # An entry that changes no value cuts the block in two.
            cut = next((k for k, x in enumerate(e) if x <= EPS**2 * (base + max(q[k], q[k + 1]))), None)
            if cut is not None:
                blocks.append((q[cut + 1 :], e[cut + 1 :], base))
                q, e = q[: cut + 1], e[:cut]
                continue
            # Upside down the values are the same, and the smaller end belongs below.
            if q[0] < q[-1] / 4:
                q, e = q[::-1], e[::-1]
            q, e, least = _dqds_step(q, e, 0.0)
            shift = share * least
            moved = _dqds_step(q, e, shift) if base + shift > base else (q, e, least)
            if moved is None:
                share /= 4
                continue
            base, share = base + shift, 0.75
            q, e, _ = moved
        found.append(base + q[0])
    return np.sort(np.array(found))[::-1] * scale**2


def twisted_direction(diagonal: np.ndarray, above: np.ndarray, s: float) -> np.ndarray:
    """Unit right singular vector of the bidiagonal matrix for the squared singular value s."""
    n = len(diagonal)
    tiny = np.finfo(float).tiny / EPS
    q, e = np.asarray(diagonal, float) ** 2, np.asarray(above, float) ** 2
    # B'B = L D L' with D = q; the entries of L only occur in products that need no division by the diagonal.
    beside = np.asarray(diagonal, float)[:-1] * above
    # Stationary transform: L D L' - s = L+ D+ L+'.
    below, part = np.empty(n - 1), np.empty(n)
    part[0] = -s
    for k in range(n - 1):
        plus = (part[k] + q[k]) or tiny
        below[k] = beside[k] / plus
        part[k + 1] = e[k] * (part[k] / plus) - s
    # Progressive transform: L D L' - s = U- D- U-'.
    up, rest = np.empty(n - 1), np.empty(n)
    rest[n - 1] = q[n - 1] - s
    for k in range(n - 2, -1, -1):
        minus = (e[k] + rest[k + 1]) or tiny
        up[k] = beside[k] / minus
        rest[k] = q[k] * (rest[k + 1] / minus) - s
    # The remainder at each possible twist; the smallest gives the direction.
    gamma = part + rest + s
    z = np.zeros(n)
    at = int(np.argmin(np.abs(gamma)))
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -below[k] * z[k + 1]
    for k in range(at, n - 1):
        z[k + 1] = -up[k] * z[k]
    norm = np.linalg.norm(z)
    return z / norm if np.isfinite(norm) and norm > 0 else np.eye(n)[at]


def _refined(diagonal: np.ndarray, above: np.ndarray, s: float, start: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Inverse iteration at s, kept orthogonal to the directions of close values."""
    n = len(diagonal)
    main = diagonal**2 + np.concatenate([[0.0], above**2])
    off = diagonal[:-1] * above
    t = np.diag(main) + np.diag(off, 1) + np.diag(off, -1)
    # A little off the value, so that the system can be solved.
    t -= np.eye(n) * (s + 8 * EPS * main.max())
    z = start
    for attempt in range(6):
        for other in others * 2:
            z = z - other * (other @ z)
        norm = np.linalg.norm(z)
        if norm < 1e-6:
            z = np.cos(np.arange(1, n + 1) * (attempt + 1.3))
            continue
        z = np.linalg.solve(t, z / norm)
        z = z / np.linalg.norm(z)
    for other in others * 2:
        z = z - other * (other @ z)
    return z / np.linalg.norm(z)


def principal(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The largest squared singular values of r, their directions as columns, and the sum of all.

    Values without weight beyond rounding are left out.
    """
    diagonal, above, p = bidiagonalise(r)
    values = dqds(diagonal, above)
    total = float(np.sum(values))
    if total <= 0:
        return np.empty(0), np.empty((len(p), 0)), 0.0
    top = values[:count]
    top = top[top > len(p) * EPS * values[0]]
    # Where the superdiagonal vanishes, the matrix falls apart and a direction lies in one part.
    norm = np.sqrt(values[0])
    cuts = [0, *(np.flatnonzero(np.abs(above) <= EPS * norm) + 1).tolist(), len(diagonal)]
    parts = [(a, b, dqds(diagonal[a:b], above[a : b - 1])) for a, b in zip(cuts, cuts[1:], strict=False)]
    ranked = sorted(((v, a, b) for a, b, own in parts for v in own), reverse=True)[: len(top)]
    found: list[tuple[float, int, np.ndarray]] = []
    for s, a, b in ranked:
        d, e = diagonal[a:b], above[a : b - 1]
        z = np.ones(1) if b - a == 1 else twisted_direction(d, e, s)
        near = [w[a:b] for v, at, w in found if at == a and v - s <= CLOSE * v]
        if near:
            z = _refined(d, e, s, z, near)
        whole = np.zeros(len(diagonal))
        whole[a:b] = z
        found.append((s, a, whole))
    return np.array([s for s, *_ in found]), p @ np.stack([w for *_, w in found], axis=1), total


# -- Spark ------------------------------------------------------------------------------


def gridded(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that remain: all entries there and finite, length as most."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST))
    doubles = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    x = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + F.lit(SHIFT).cast("long"))
    kept = doubles.filter(F.col("v").isNotNull()).filter(F.forall("v", entry)).select("vec_id", x.alias("x"))
    # One row for each length.
    lengths = kept.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("rows"))
    most = lengths.orderBy(F.desc("rows"), F.desc("size")).first()
    return kept.filter(F.size("x") == F.lit(most["size"] if most else 0))


def _matrix(column: pa.ListArray, kind: type = np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            yield part, _matrix(part.column("x"))


def _centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """x - S / n, from the exact n * x - S."""
    if float(n) * np.abs(x).max(initial=0) < 2**62:
        return (n * x - s.astype(np.int64)) / n
    return np.array((n * x.astype(object) - s), dtype=float) / n


def _folded(batches: Iterator[pa.RecordBatch], triangle_of) -> Iterator[pa.RecordBatch]:
    """One R for all rows of a task, rows after rows."""
    r = None
    for batch in batches:
        for block in triangle_of(batch):
            r = np.linalg.qr(block if r is None else np.vstack([r, block]), mode="r")
    if r is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([len(r)], pa.int32()), pa.array([r.ravel()], pa.list_(pa.float64()))], names=["rows", "r"]
        )


def _triangles(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for rows, r in zip(batch.column("rows").to_pylist(), batch.column("r").to_pylist(), strict=True):
        yield np.array(r).reshape(rows, -1)


def triangle(fit: DataFrame, n: int, s: np.ndarray) -> np.ndarray:
    """R of the centred rows of ``fit``: by task, then FAN_IN triangles at a time."""
    schema = "rows int, r array<double>"

    def centred(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, x in _parts([batch]):
            yield _centred(x, n, s)

    found = stage(fit.mapInArrow(lambda b: _folded(b, centred), schema), "triangles")
    count = found.count()
    while count > 1:
        count = -(-count // FAN_IN)
        # Dealt out by turns, so each task has about FAN_IN of them.
        found = stage(found.repartition(count).mapInArrow(lambda b: _folded(b, _triangles), schema), "triangles")
        count = min(count, found.count())
    last = found.first()
    return np.array(last["r"]).reshape(last["rows"], -1)


@dataclass
class Whitening:
    """What rows are whitened with: x - S / n times ``directions`` (dimension x components)."""

    n: int
    s: np.ndarray
    directions: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0


def _summed(fit: DataFrame) -> tuple[int, np.ndarray]:
    """n and the exact sums of each dimension: partial sums in each task, then by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for _, x in _parts(batches):
            n, total = n + len(x), total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.list_(pa.int64()))], names=["n", "s"])

    part = stage(fit.mapInArrow(run, "n long, s array<long>"), "sums")
    n = part.agg(F.sum("n").alias("n")).first()["n"] or 0
    by = part.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    return n, np.array([int(r["v"]) for r in sorted(by.collect())], dtype=object)


def _identity_error(fit: DataFrame, w: Whitening) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity."""
    k = w.directions.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, total, n = np.zeros((k, k)), np.zeros(k), 0
        for _, x in _parts(batches):
            y = _centred(x, w.n, w.s) @ w.directions
            gram, total, n = gram + y.T @ y, total + y.sum(axis=0), n + len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([np.append(gram.ravel(), total)], pa.list_(pa.float64()))], names=["g"])

    by = fit.mapInArrow(run, "g array<double>").select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    sums = np.array([r["v"] for r in sorted(by.collect())])
    mean = sums[k * k :] / w.n
    return float(np.abs(sums[: k * k].reshape(k, k) / w.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def fit_whitening(x_rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Directions fitted to the distinct vectors in column ``x``; None if there is no variance."""
    ship_package(x_rows.sparkSession)
    fit = stage(x_rows.select("x").distinct(), "distinct vectors")
    n, s = _summed(fit)
    if n < 2:
        return None
    values, directions, total = principal(triangle(fit, n, s), components)
    if not len(values):
        return None
    found = Whitening(n, s, directions * np.sqrt(n / values), values / total)
    found.identity_error = _identity_error(fit, found)
    return found


def _deviations(x: np.ndarray, n: int, s: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, in whole numbers."""
    if float(n) * np.abs(x).max(initial=0) < 2**62:
        apart = n * x - s.astype(np.int64)
        if float(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] < 2**62:
            return (apart * apart).sum(axis=1).tolist()
    exact = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    return [v if v < 2**63 else None for v in exact]


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining row of ``embeddings`` (vec_id, embedding) and component.

    vec_id, component (from 1), n, deviation, whitened, explained, identity_error.
    """
    rows = stage(gridded(embeddings), "vectors")
    w = fit_whitening(rows, components)
    fields = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    id_type = rows.select("vec_id").dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = w.directions.shape[1]
        for part, x in _parts(batches):
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, w.n)),
                    pa.array(_deviations(x, w.n, w.s), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array((_centred(x, w.n, w.s) @ w.directions).ravel()),
                    pa.array(np.tile(w.explained, m)),
                    pa.array(np.full(m * k, w.identity_error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    if w is None:
        return rows.select("vec_id", F.explode(F.array().cast("array<int>")).alias("component")).selectExpr(
            "*", "0L as n", "0L as deviation", "0D as whitened", "0D as explained", "0D as identity_error"
        )
    return rows.mapInArrow(run, f"vec_id {id_type}, {fields}")

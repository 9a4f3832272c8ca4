"""Embedding whitening by a bidiagonal qd solver.

Entries become whole numbers, x = floor(scale * c) + offset; the fit list holds each distinct vector once.
Its sums per dimension are exact, so (n * x - S) / n, the centred row, carries one rounding.

1. Blockwise QR: every task folds its rows, block after block, into one triangular factor; factors meet in
   groups of bounded size until one is left. Its singular values are those of the centred rows, and no
   covariance is formed, which would square their spread.
2. Householder reflections make that factor bidiagonal.
3. dqds, the qd transform with shifts in its differential form, finds the squared singular values to high
   relative accuracy. A shift that was too large is noticed by a negative pivot and lowered.
4. A twisted factorisation per singular value gives its vector without a product of rotations: of all
   places where the top-down and the bottom-up factorisation can meet, the one with the least pivot.
   Vectors of values that lie close together are made orthogonal, where need be after inverse iteration.

The driver holds one triangular factor: dimensions squared, whatever the number of rows. Rows get scores in
one pass, and a last pass over the fit list measures how far its whitened covariance is from the identity.

Vectors that are null or hold null or non-finite entries take no part; shorter ones count as padded with
zeros. Entries c with ``scale`` * c beyond 2**46 on either side count as if at 2**46. Repeated rows are rows of their own in the result
and one in the fit list. A component's largest entry (the first of equals) is positive. Directions without
spread (below ``FLOOR`` of the greatest singular value) are no components, so a table whose vectors
are all equal, or empty, gives no rows. Further columns do not matter. A deviation beyond a long is null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.common import stored

COMPONENTS = 16
SCALE, OFFSET = 64, 1_000_000
#: Singular values below this share of the greatest count as none.
FLOOR = 1e-11
#: Doubles that the factors of one group may hold together.
GROUP_DOUBLES = 1 << 22
_EPS = float(np.finfo(float).eps)
_MOST = float(1 << 46)
_LONG = 1 << 63
#: Values closer than this, relative to the larger, have vectors that need orthogonalising.
_CLOSE = 1e-3


# ---- the solver, on one small matrix -------------------------------------------------------------------

def _reflector(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(v, beta, y): I - beta v v' takes ``x`` to (y, 0, ..., 0)."""
    top = float(np.abs(x).max()) if len(x) else 0.0
    if top == 0.0 or not x[1:].any():
        return np.zeros(len(x)), 0.0, float(x[0])
    v = x / top
    y = -math.copysign(float(np.sqrt(v @ v)), v[0])
    v[0] -= y
    return v, float(2.0 / (v @ v)), y * top


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, v): r = u B v', B with diagonal ``a`` and ``b`` above it, by reflections from both sides."""
    m, d = np.array(r, dtype=float), r.shape[1]
    a, b, right = np.zeros(d), np.zeros(max(0, d - 1)), np.eye(d)
    for k in range(d):
        v, beta, a[k] = _reflector(m[k:, k].copy())
        if beta:
            m[k:, k + 1:] -= np.outer(beta * v, v @ m[k:, k + 1:])
        if k + 1 < d:
            v, beta, b[k] = _reflector(m[k, k + 1:].copy())
            if beta:
                m[k + 1:, k + 1:] -= np.outer(m[k + 1:, k + 1:] @ v, beta * v)
                right[:, k + 1:] -= np.outer(right[:, k + 1:] @ v, beta * v)
    return a, b, right


def _transform(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], int]:
    """One differential qd step; the last value is the place of the first negative pivot, -1 if none."""
    d, up, over = q[0] - shift, [], []
    for i in range(len(e)):
        if d < 0.0:
            return [d], [], i
        sum_ = d + e[i]
        up.append(sum_)
        if sum_ == 0.0:
            over.append(0.0)
            d = q[i + 1] - shift
        else:
            t = q[i + 1] / sum_
            over.append(e[i] * t)
            d = d * t - shift
    up.append(d)
    return up, over, len(e) if d < 0.0 else -1


def _trailing(q: list[float], e: list[float]) -> float:
    """The smaller eigenvalue of the last two rows of B'B, a first guess for the least of all."""
    x, y = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1]
    half = math.hypot((x - y) / 2, math.sqrt(q[-2]) * math.sqrt(e[-1]))
    return max(0.0, (x + y) / 2 - half)


def _least_by_discs(q: list[float], e: list[float]) -> float:
    """A lower bound of B'B's eigenvalues: each is in a disc around a diagonal entry."""
    off = [math.sqrt(x) * math.sqrt(y) for x, y in zip(q, e)]
    sides = zip(q, [0.0, *e], [0.0, *off], [*off, 0.0])
    return max(0.0, min(x + y - left - right for x, y, left, right in sides))


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Squared singular values, falling, of the bidiagonal with squared entries ``q`` and, above, ``e``."""
    found: list[float] = []
    blocks = [(list(map(float, q)), list(map(float, e)), 0.0)]
    small = (16 * _EPS) ** 2
    while blocks:
        q, e, moved = blocks.pop()
        if len(q) > 1 and q[0] < q[-1]:  # small ones come last
            q, e = q[::-1], e[::-1]
        steps, n_at_start = 0, len(q)
        while q:
            if len(q) == 1 or e[-1] <= small * (moved + q[-1]):
                found.append(moved + q.pop())
                if e:
                    e.pop()
                continue
            cut = next((i for i in range(len(e) - 2, -1, -1) if e[i] <= small * (moved + min(q[i], q[i + 1]))), None)
            if cut is not None:
                blocks.append((q[:cut + 1], e[:cut], moved))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            steps += 1
            if steps > 60 * n_at_start:
                raise ArithmeticError("dqds did not converge")
            shift = _trailing(q, e) if steps > 1 else 0.0  # the first step moves zeros to the end
            for attempt in range(6):
                up, over, at = _transform(q, e, shift)
                if at < 0:
                    break
                # Failing only at the end, shift + pivot is below the least value and very near it.
                if attempt == 4:
                    shift = 0.0
                elif at == len(e):
                    shift = max(0.0, (shift + up[-1]) * (1 - 2 * _EPS))
                else:
                    shift = _least_by_discs(q, e) if attempt == 0 else shift / 4
            q, e, moved = up, over, moved + shift
    return sorted(found, reverse=True)


class _Twisted:
    """L D L' - value * I, factored from both ends, L and D being those of B'B."""

    def __init__(self, d: np.ndarray, l: np.ndarray, value: float) -> None:
        n = len(d)
        tiny = _EPS * _EPS * float(d.max()) + 1e-300
        self.plus, self.lo = np.empty(n), np.empty(max(0, n - 1))
        self.minus, self.up = np.empty(n), np.empty(max(0, n - 1))
        s, tops = -value, np.empty(n)
        for i in range(n):
            tops[i] = s
            p = s + d[i]
            self.plus[i] = p if p else tiny
            if i < n - 1:
                self.lo[i] = d[i] * l[i] / self.plus[i]
                s = self.lo[i] * l[i] * s - value
        p, bottoms = d[-1] - value, np.empty(n)
        for i in range(n - 1, -1, -1):
            bottoms[i] = p
            if i:
                m = d[i - 1] * l[i - 1] * l[i - 1] + p
                self.minus[i] = m if m else tiny
                t = d[i - 1] / self.minus[i]
                self.up[i - 1] = l[i - 1] * t
                p = p * t - value
        self.pivots = tops + bottoms + value
        self.at = int(np.argmin(np.abs(self.pivots)))
        self.pivot = float(self.pivots[self.at]) or tiny

    def back(self, w: np.ndarray) -> np.ndarray:
        """z with N'z = w, from the meeting place outwards."""
        z, k = w.copy(), self.at
        for i in range(k - 1, -1, -1):
            z[i] -= self.lo[i] * z[i + 1]
        for i in range(k, len(z) - 1):
            z[i + 1] -= self.up[i] * z[i]
        return z

    def vector(self) -> np.ndarray:
        w = np.zeros(len(self.plus))
        w[self.at] = 1.0
        return self.back(w)

    def solve(self, rhs: np.ndarray) -> np.ndarray:
        y, k, n = rhs.copy(), self.at, len(rhs)
        for i in range(k):
            y[i + 1] -= self.lo[i] * y[i]
        for i in range(n - 2, k - 1, -1):
            y[i] -= self.up[i] * y[i + 1]
        pivots = np.concatenate([self.plus[:k], [self.pivot], self.minus[k + 1:]])
        return self.back(y / pivots)


def _unit(z: np.ndarray) -> np.ndarray:
    z = z / np.abs(z).max()
    return z / np.sqrt(z @ z)


def _clear(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for o in others:
            z = z - (o @ z) * o
    return z


def _iterated(d: np.ndarray, l: np.ndarray, value: float, others: list[np.ndarray], seed: int) -> np.ndarray:
    """Inverse iteration from a fixed start, orthogonal to ``others``, a few roundings beside ``value``."""
    best, least = np.zeros(len(d)), math.inf
    for away in (32, -32, 512, -512):
        factored = _Twisted(d, l, value * (1 + away * _EPS))
        z = _unit(_clear(np.cos(np.arange(1, len(d) + 1) * (seed + 1.0)), others))
        for _ in range(5):
            solved = factored.solve(z)
            if not np.isfinite(solved).all() or not solved.any():
                break
            z = _unit(_clear(_unit(solved), others))
        y = z.copy()  # L'z, then the residual of L D L'
        y[:-1] += l * z[1:]
        y *= d
        y[1:] += l * y[:-1]
        off = float(np.abs(y - value * z).max())
        if off < least:
            best, least = z, off
    return best


def _block_vectors(a: np.ndarray, b: np.ndarray, values: list[float], wanted: int) -> list[np.ndarray]:
    """Unit vectors of the first ``wanted`` of ``values`` (falling) of an unreduced bidiagonal block."""
    d, l = a * a, b / a[:-1] if len(a) > 1 else b
    out: list[np.ndarray] = []
    for i in range(wanted):
        value = values[i]
        factored = _Twisted(d, l, value)
        z = factored.vector()
        for _ in range(2):  # the pivot over the squared length is what the value is off by
            if not np.isfinite(z).all() or abs(factored.pivot) <= 2 * _EPS * value * (z @ z):
                break
            nearer = _Twisted(d, l, value + factored.pivot / (z @ z))
            if abs(nearer.pivot) >= abs(factored.pivot):
                break
            factored, z = nearer, nearer.vector()
        close = [out[j] for j in range(i) if values[j] - value <= _CLOSE * values[j]]
        # A value halfway between two that are one but for rounding has no small pivot anywhere.
        told = np.isfinite(z).all() and abs(factored.pivot) <= 1e3 * _EPS * value * (z @ z)
        clear = _clear(_unit(z), close) if told else np.zeros(len(d))
        if clear @ clear < 0.5:
            clear = _iterated(d, l, value, close, i)
        out.append(_unit(clear))
    return out


def leading(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, right singular vectors as columns) of ``r``: the greatest ``most``, falling.

    Values at or below ``FLOOR`` of the greatest, squared, are left out.
    """
    d = r.shape[1]
    norm = float(np.abs(r).max()) if r.size else 0.0
    if not norm:
        return np.zeros(0), np.zeros((d, 0))
    a, b, right = bidiagonal(r / norm)
    top = max(float(np.abs(a).max()), float(np.abs(b).max()) if d > 1 else 0.0)
    # Both change the matrix by no more than its rounding; after it L D L' exists and blocks are unreduced.
    a = np.where(np.abs(a) < _EPS * top, _EPS * top, a)
    b = np.where(np.abs(b) < _EPS * top, 0.0, b)
    edges = [0, *(np.flatnonzero(b == 0.0) + 1).tolist(), d]
    blocks = [(lo, hi, dqds((a[lo:hi] ** 2).tolist(), (b[lo:hi - 1] ** 2).tolist())) for lo, hi in zip(edges, edges[1:])]
    ranked = sorted(((-v, k, i) for k, (_, _, values) in enumerate(blocks) for i, v in enumerate(values)))[:most]
    ranked = [x for x in ranked if -x[0] > FLOOR * FLOOR * -ranked[0][0]]
    columns: list[np.ndarray] = []
    made = {}
    for k, (lo, hi, values) in enumerate(blocks):
        wanted = sum(1 for x in ranked if x[1] == k)
        made[k] = _block_vectors(a[lo:hi], b[lo:hi - 1], values, wanted) if wanted else []
    for _, k, i in ranked:
        z = np.zeros(d)
        z[blocks[k][0]:blocks[k][1]] = made[k][i]
        z = right @ z
        z /= np.sqrt(z @ z)
        columns.append(z if z[np.argmax(np.abs(z))] > 0 else -z)
    values = np.array([-x[0] for x in ranked]) * norm * norm
    return values, np.column_stack(columns) if columns else np.zeros((d, 0))


# ---- the tables -----------------------------------------------------------------------------------------

def finite(vector: str) -> Column:
    ok = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.col(vector).isNotNull() & F.coalesce(ok, F.lit(False))


def whole_entries(vector: str, scale: int = SCALE, offset: int = OFFSET) -> Column:
    held = lambda c: F.least(F.greatest(F.lit(float(scale)) * c.cast("double"), F.lit(-_MOST)), F.lit(_MOST))
    return F.transform(vector, lambda c: F.floor(held(c)) + F.lit(offset))


@dataclass(frozen=True)
class Centre:
    """The fit list's length and its exact sums per dimension."""

    n: int
    sums: tuple[int, ...]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, whole; Python's integers where a long might not do."""
        if self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0) < _LONG:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float)

    def squared(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of squared deviations per row; none beyond a long."""
        d = self.deviations(x)
        if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * max(1, x.shape[1]) < _LONG:
            return (d * d).sum(axis=1).tolist()
        d = d.astype(object)
        return [s if s < _LONG else None for s in (int((row * row).sum()) for row in d)]


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(list(column)).astype(np.int64) if len(column) else np.zeros((0, dim), dtype=np.int64)


def _meet(parts: DataFrame, group: int, fold: Callable[[list[np.ndarray]], np.ndarray], n_parts: int) -> np.ndarray | None:
    """The matrices of ``parts`` (part, m) folded into one, ``group`` at a time and in order of the part."""
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("part")
        return pd.DataFrame({"part": [batch["part"].iat[0] // group], "m": [fold([np.frombuffer(x) for x in batch["m"]]).tobytes()]})

    while n_parts > 1:
        parts = parts.groupBy(F.floor(F.col("part") / group)).applyInPandas(run, "part long, m binary")
        n_parts = -(-n_parts // group)
    rows = parts.collect()  # one row
    return fold([np.frombuffer(r["m"]) for r in rows]) if rows else None


def _numbered_parts(df: DataFrame, run: Callable[[Iterator[np.ndarray]], np.ndarray | None], dim: int) -> DataFrame:
    """``run`` over the vectors of each partition, as (part, m)."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = run(_matrix(b["x"], dim) for b in batches if len(b))
        if m is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "m": [np.ascontiguousarray(m, dtype=float).tobytes()]})

    return df.mapInPandas(scan, "part long, m binary")


def _triangle(block: np.ndarray) -> np.ndarray:
    r = np.linalg.qr(block, mode="r")
    return np.vstack([r, np.zeros((block.shape[1] - len(r), block.shape[1]))])


def triangular_factor(fit: DataFrame, centre: Centre, parts: int) -> np.ndarray:
    """R of the centred rows of ``fit`` (x), which has ``parts`` partitions."""
    dim = len(centre.sums)

    def run(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
        r = None
        for x in blocks:
            rows = centre.rows(x)
            r = _triangle(rows if r is None else np.vstack([r, rows]))
        return r

    def fold(factors: list[np.ndarray]) -> np.ndarray:
        return _triangle(np.vstack([f.reshape(dim, dim) for f in factors]))

    r = _meet(_numbered_parts(fit, run, dim), max(2, GROUP_DOUBLES // (dim * dim)), fold, parts)
    return np.zeros((dim, dim)) if r is None else r.reshape(dim, dim)


def _moments(y: np.ndarray) -> np.ndarray:
    """Count, mean and summed products around the mean, in one row."""
    mean = y.mean(axis=0)
    return np.concatenate([[len(y)], mean, ((y - mean).T @ (y - mean)).ravel()])


def _joined(parts: list[np.ndarray], k: int) -> np.ndarray:
    out = parts[0]
    for p in parts[1:]:
        n, m = out[0], p[0]
        away = p[1:k + 1] - out[1:k + 1]
        out = np.concatenate([[n + m], out[1:k + 1] + away * (m / (n + m)), out[k + 1:] + p[k + 1:] + np.outer(away, away).ravel() * (n * m / (n + m))])
    return out


def identity_error(fit: DataFrame, centre: Centre, white: np.ndarray, parts: int) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = white.shape[1]

    def run(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
        out = None
        for x in blocks:
            m = _moments(centre.rows(x) @ white)
            out = m if out is None else _joined([out, m], k)
        return out

    total = _meet(_numbered_parts(fit, run, len(centre.sums)), max(2, GROUP_DOUBLES // (k * k + k + 1)), lambda p: _joined(p, k), parts)
    return float(np.abs(total[k + 1:].reshape(k, k) / total[0] - np.eye(k)).max())


@dataclass(frozen=True)
class Whitening:
    centre: Centre
    values: np.ndarray  # of the covariance
    vectors: np.ndarray  # as columns
    trace: float
    error: float

    @property
    def white(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def fit_whitening(x: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``x`` (x: long vectors of ``dim`` entries); None without a direction of spread."""
    spark = x.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # A stated number of partitions and an order inside them: the same rows fold the same way in every run.
    fit = stored(x.distinct().repartition(parts, "x").sortWithinPartitions("x").select("x", F.spark_partition_id().alias("part")))
    ordered = fit.repartition(parts, "part").sortWithinPartitions("part", "x").select("x")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(dim, dtype=object)
        for batch in batches:
            m = _matrix(batch["x"], dim)
            n += len(m)
            safe = int(np.abs(m).max(initial=0)) * max(1, len(m)) < _LONG
            total = total + (m.sum(axis=0) if safe else m.astype(object).sum(axis=0)).astype(object)
        if n:
            yield pd.DataFrame({"at": range(dim), "n": [n] * dim, "s": [str(t) for t in total]})

    found = fit.select("x").mapInPandas(sums, "at int, n long, s string").groupBy("at").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("at").collect()
    if not found:
        return None
    centre = Centre(int(found[0]["n"]), tuple(int(r["s"]) for r in found))
    r = triangular_factor(ordered, centre, parts)
    squares, vectors = leading(r, components)
    if not len(squares):
        return None
    values = squares / centre.n
    error = identity_error(ordered, centre, vectors / np.sqrt(values), parts)
    return Whitening(centre, values, vectors, float((r * r).sum() / centre.n), error)


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) per usable row and component."""
    clean = vectors.where(finite(vector)).select(F.col(id).alias("id"), whole_entries(vector, scale, offset).alias("x"))
    dim = clean.agg(F.max(F.size("x"))).first()[0] or 0
    padded = clean.select("id", F.concat("x", F.array_repeat(F.lit(offset).cast("long"), F.lit(dim) - F.size("x"))).alias("x"))
    fitted = fit_whitening(padded.select("x"), dim, components) if dim else None
    if fitted is None:
        nothing = clean.sparkSession.createDataFrame([], "component int, n long, deviation long, whitened double, explained double, identity_error double")
        return clean.select(F.col("id").alias(id)).join(nothing, F.lit(False)).limit(0)
    centre, white = fitted.centre, fitted.white

    @F.pandas_udf("deviation long, w array<double>")
    def scores(column: pd.Series) -> pd.DataFrame:
        x = _matrix(column, dim)
        # einsum adds in one order for every row, so equal vectors score alike in any block.
        w = np.einsum("ij,jk->ik", centre.rows(x), white)
        return pd.DataFrame({"deviation": pd.array(centre.squared(x), dtype="Int64"), "w": list(w)})

    explained = F.array(*[F.lit(float(v / fitted.trace)) for v in fitted.values])
    scored = padded.select("id", scores("x").alias("s")).select("id", "s.deviation", F.posexplode("s.w").alias("at", "whitened"))
    return scored.select(
        F.col("id").alias(id), (F.col("at") + 1).cast("int").alias("component"), F.lit(centre.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(fitted.error).alias("identity_error"))

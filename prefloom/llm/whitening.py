"""Embedding whitening by QDWH spectral divide-and-conquer.

Spark computes the sums and the centred covariance of all vectors.  The
covariance, a matrix of the vectors' length alone, is split on the driver:
the polar factor U of V - s*I (QDWH iterations) gives the spectral projector
(U + I) / 2 onto the eigenvalues above the shift s; orthonormal bases of its
range and of its complement cut the matrix into two smaller ones, and so on
down to single components.  The components (length x 32 numbers) are then
broadcast in the task closure and every vector is whitened in one narrow pass.

Edge cases: a null vector, one with null, NaN or infinite entries or with an
entry beyond 2**55 in size is left out; so is one whose length is not the
table's commonest (ties: the longer), and an empty one.  Repeated rows count
each time.  A component without variance has null `whitened` values and is left
out of `identity_error`.  An empty table gives no rows.  Other columns are kept
unless they bear the name of a result column.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OFFSET = 1_000_000
MAX_DIMS = 4096  # the covariance and its components are held by the driver and by each task
RESULTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")


# ---- spectral divide-and-conquer -----------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """Orthogonal polar factor of a symmetric matrix by dynamically weighted Halley steps."""
    x, n = a / np.linalg.norm(a), len(a)
    low = np.finfo(float).eps  # a bound below every singular value; seven steps lead from here to 1
    eye = np.eye(n)
    for _ in range(30):
        if abs(1 - low) < 1e-15:
            break
        d = np.cbrt(4 * (1 - low * low) / low**4)
        r = np.sqrt(1 + d)
        p = r + np.sqrt(max(8 - 4 * d + 8 * (2 - low * low) / (low * low * r), 0)) / 2
        q = (p - 1) ** 2 / 4
        s = p + q - 1
        w, _ = np.linalg.qr(np.vstack([np.sqrt(s) * x, eye]))
        x = (q / s) * x + (p - q / s) / np.sqrt(s) * (w[:n] @ w[n:].T)
        x = (x + x.T) / 2
        low = min(low * (p + q * low * low) / (1 + s * low * low), 1.0)
    for _ in range(2):  # Newton-Schulz: the last bits
        x = x @ (3 * eye - x @ x) / 2
        x = (x + x.T) / 2
    return x


def _split(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if `a` is a multiple of I."""
    n = len(a)
    spread = np.linalg.norm(a - np.trace(a) / n * np.eye(n))
    if spread <= 4 * np.finfo(float).eps * np.linalg.norm(a):
        return None
    diagonal = np.sort(np.diag(a))
    shifts = [np.median(diagonal), np.trace(a) / n]
    shifts += [np.trace(a) / n + spread * f for f in (0.011, -0.013, 0.047, -0.053, 0.17, -0.19, 0.31, -0.33, 0.47, -0.49)]
    best = None
    for shift in shifts:
        p = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        rank = int(round(float(np.trace(p))))
        error = np.linalg.norm(p @ p - p)
        if 0 < rank < n and np.isfinite(error):
            if best is None or error < best[0]:
                best = error, p, rank
            if error < 1e-12 * n:
                break
    if best is None:
        return None
    _, p, rank = best
    # columns of P and I-P with the largest residues span the two subspaces
    order = np.argsort(-np.diag(p), kind="stable")
    q, _ = np.linalg.qr(p[:, order[:rank]])
    for _ in range(2):
        q, _ = np.linalg.qr(p @ q)
    full, _ = np.linalg.qr(np.hstack([q, np.eye(n)[:, order[::-1][: n - rank]]]))
    rest = full[:, rank:]
    for _ in range(2):
        rest, _ = np.linalg.qr(rest - p @ rest)
    return q, rest


def spectral_components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix.

    The largest entry of each eigenvector is made positive.
    """
    d = len(v)
    parts, done = [(np.eye(d), (v + v.T) / 2)], []
    while parts:
        basis, a = parts.pop()
        if len(a) == 1 or (halves := _split(a)) is None:
            done.append(basis)
            continue
        for q in halves:
            b = q.T @ a @ q
            parts.append((basis @ q, (b + b.T) / 2))
    x = np.hstack(done)
    e = np.einsum("ij,ij->j", x, v @ x)
    order = np.argsort(-e, kind="stable")
    e, x = e[order], x[:, order]
    return e, x * np.where(x[np.abs(x).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)


# ---- passes over the vectors ---------------------------------------------


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Entries and lengths of a list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat, column.value_lengths().to_numpy(zero_copy_only=False)


def _integers(c: np.ndarray) -> np.ndarray:
    return np.floor(64 * c).astype(np.int64) + OFFSET


def usable(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector can be used, with the vector's length in `_d`."""
    bad = F.exists(column, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) > float(1 << 55)))
    return vectors.filter(F.col(column).isNotNull() & (F.size(column) > 0)).filter(~bad).withColumn("_d", F.size(column))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for b in batches:
        flat, sizes = _matrix(b.column(0))
        at = np.concatenate([[0], np.cumsum(sizes)])
        for d in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == d)
            x = _integers(flat[at[rows][:, None] + np.arange(d)])
            low, high = x.min(axis=0), x.max(axis=0)
            y = x - low  # small, so that the sum of a batch fits
            s = [int(a) + len(rows) * int(m) for a, m in zip(y.astype(object).sum(0) if int(y.max()) > 1 << 40 else y.sum(0), low, strict=True)]
            t = total.setdefault(d, [0, [0] * d, low, high])
            t[0] += len(rows)
            t[1] = [a + c for a, c in zip(t[1], s, strict=True)]
            t[2], t[3] = np.minimum(t[2], low), np.maximum(t[3], high)
    for d, (n, s, low, high) in total.items():
        yield pa.RecordBatch.from_pydict(
            {
                "d": pa.array([d] * d, pa.int32()),
                "i": pa.array(range(d), pa.int32()),
                "n": pa.array([n] * d, pa.int64()),
                "s": pa.array([Decimal(v) for v in s], pa.decimal128(28, 0)),
                "low": pa.array(low, pa.int64()),
                "high": pa.array(high, pa.int64()),
            }
        )


class Centre:
    """n, exact sums S and what turns integers x into the exact n*x - S."""

    def __init__(self, n: int, s: list[int], low: list[int], high: list[int]):
        self.n, self.s, self.d = n, s, len(s)
        self.near = [(2 * v + n) // (2 * n) for v in s]  # the integer nearest to S/n
        self.rest = [v - n * c for v, c in zip(s, self.near, strict=True)]
        reach = max(max(h - c, c - m) for h, c, m in zip(high, self.near, low, strict=True)) + 1
        self.wide = n * reach >= 1 << 62  # beyond this, Python integers
        self.wide_square = self.wide or self.d * (n * reach) ** 2 >= 1 << 62

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exact."""
        kind = object if self.wide else np.int64
        return (x - np.array(self.near, np.int64)).astype(kind) * self.n - np.array(self.rest, kind)

    def centred(self, scaled: np.ndarray) -> np.ndarray:
        return scaled.astype(np.float64) / self.n

    def deviation(self, scaled: np.ndarray) -> list[int]:
        z = scaled.astype(object) if self.wide_square else scaled
        return [int(v) for v in (z * z).sum(axis=1)]


def _products(centre: Centre, project: np.ndarray | None = None):
    """Sums of products of centred (or whitened) entries, a row of the matrix each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            flat, _ = _matrix(b.column(0))
            y = centre.centred(centre.scaled(_integers(flat.reshape(-1, centre.d))))
            if project is not None:
                y = np.hstack([y @ project, np.ones((len(y), 1))])  # with the sums, for the mean
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            k = len(total)
            i, j = np.divmod(np.arange(k * k), k)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "v"])

    return run


def _matrix_of(vectors: DataFrame, column: str, run, k: int) -> np.ndarray:
    """Sum over all tasks, k*k numbers."""
    parts = vectors.select(column).mapInArrow(run, "i int, j int, v double")
    out = np.zeros((k, k))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v
    return out


def centre_of(vectors: DataFrame, column: str) -> Centre | None:
    """Exact sums of the usable vectors of the commonest length."""
    parts = vectors.select(column).mapInArrow(_sums, "d int, i int, n long, s decimal(28,0), low long, high long")
    sums = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high"))
    lengths = sums.filter("i = 0").groupBy("d").agg(F.first("n").alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if first is None:
        return None
    if first.d > MAX_DIMS:
        raise ValueError(f"vectors of {first.d} entries; at most {MAX_DIMS} are whitened")
    rows = sorted(sums.filter(F.col("d") == first.d).collect(), key=lambda r: r.i)
    return Centre(rows[0].n, [int(r.s) for r in rows], [r.low for r in rows], [r.high for r in rows])


def whiten(vectors: DataFrame, column: str = "embedding", components: int = 32) -> DataFrame:
    """Each usable row with `n`, `deviation` (decimal), `whitened` (array<double>), `explained` (array<double>), `identity_error`.

    `deviation` is the exact sum over the dimensions of (n*x - S)^2; entry i of
    the arrays belongs to component i+1.  Scans the vectors four times: sums,
    covariance, check of the whitened covariance, result.
    """
    keep = [c for c in vectors.columns if c != column and c.lower() not in RESULTS]
    good = usable(vectors, column)
    centre = centre_of(good, column)
    kept = T.StructType([vectors.schema[c] for c in keep])
    number, numbers = T.DecimalType(38, 0), T.ArrayType(T.DoubleType())
    if centre is None:
        empty = T.StructType([*kept.fields]).add("n", "long").add("deviation", number).add("whitened", numbers)
        return vectors.sparkSession.createDataFrame([], empty.add("explained", numbers).add("identity_error", "double"))
    good = good.filter(F.col("_d") == centre.d)
    v = _matrix_of(good, column, _products(centre), centre.d) / centre.n
    e, x = spectral_components(v)
    k = min(components, centre.d)
    e, x = e[:k], x[:, :k]
    live = e > 1e-13 * max(float(e.max(initial=0)), 0) if e.max(initial=0) > 0 else np.zeros(k, bool)
    project = np.where(live, x / np.sqrt(np.where(live, e, 1)), 0.0)
    m = _matrix_of(good, column, _products(centre, project), k + 1) / centre.n
    check = m[:k, :k] - np.outer(m[:k, k], m[:k, k]) - np.eye(k)
    error = float(np.abs(check[np.ix_(live, live)]).max(initial=0))
    trace = float(np.trace(v))
    explained = (e / trace if trace > 0 else np.zeros(k)).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, _ = _matrix(b.column(0))
            scaled = centre.scaled(_integers(flat.reshape(-1, centre.d)))
            white = centre.centred(scaled) @ project
            values = pa.array(white.ravel(), mask=np.tile(~live, len(white)))
            white = pa.ListArray.from_arrays(pa.array(np.arange(len(white) + 1) * k, pa.int32()), values)
            deviation = pa.array([Decimal(z) for z in centre.deviation(scaled)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], deviation, white], [*b.schema.names[1:], "deviation", "whitened"])

    shape = T.StructType([*kept.fields]).add("deviation", number).add("whitened", numbers)
    done = good.select(column, *keep).mapInArrow(run, shape)
    return done.select(
        *keep,
        F.lit(centre.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.array(*[F.lit(a) for a in explained]).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def component_rows(whitened: DataFrame) -> DataFrame:
    """One row per vector and component; `deviation` as long."""
    pairs = F.posexplode(F.arrays_zip("whitened", "explained")).alias("_i", "_p")
    return whitened.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", pairs).select(
        "vec_id",
        (F.col("_i") + 1).alias("component"),
        "n",
        "deviation",
        F.col("_p.whitened").alias("whitened"),
        F.col("_p.explained").alias("explained"),
        "identity_error",
    )

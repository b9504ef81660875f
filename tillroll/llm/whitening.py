"""Whitening of embeddings by incremental eigendecomposition.

A state is (count, mean, eigenvalues, eigenvectors) of the scatter matrix of
the vectors seen so far; its size depends on the width of a vector only.

1. Every partition of the fit list streams its vectors through ``add_block``: a
   block is centred on its mean, turned into at most width rows with the same
   scatter, and each of these, like the step of the mean, is added to the
   spectrum as one rank-one update (a block of fewer rows than that goes in row
   by row, each centred on the running mean).  The new eigenvalues are the roots of the
   secular equation; directions without a share in the update, and equal
   eigenvalues (turned so that one of them holds the whole share), are
   deflated, so they keep their eigenvalue.
2. ``merge`` joins two states: the eigenpairs of one and the difference of the
   means enter the other as successive rank-one updates.  States meet in a
   tree, ``FAN_IN`` at a time, so no task holds more than that many.
3. Rayleigh-Ritz refinement: one pass over the fit list sums the Gram matrix
   of the vectors, centred and turned into the basis; its small eigenproblem
   turns the basis.  It is repeated until a pass measures nothing off the
   diagonal beyond ``TOLERANCE``, and the last pass gives the error reported.

Vectors are whole numbers x = floor(64 * c) + 1000000.  States hold x less the
shift, sums of x are exact, and each vector is centred before it is multiplied.

The updates cost width^2 a distinct vector and width^4 a block, in the tasks.  To the driver come
one state and one Gram matrix: width^2 numbers, however many rows.

Defined cases: a vector that is null, or holds a null, a non-finite entry or
one whose x is beyond 2^53, is dropped; repeated rows and null ids are returned
each, and the fit list holds equal vectors once; an empty vector has no
components and no rows; vectors of different widths are spaces of their own,
each fitted alone; a component without variance (at or under rounding of the
largest) has a null ``whitened`` and does not count in the error; ``deviation``
is null beyond 64 bits; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm.text import table
from tillroll.storage import written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: States that one task merges, and the off-diagonal share of a Gram matrix that ends the refinement.
FAN_IN = 8
TOLERANCE, MOST_PASSES = 1e-12, 6
#: Vectors that are centred on their own mean and turned together before they enter a spectrum.
BLOCK_ROWS = 1024
_EPS = np.finfo(float).eps
_STATE = "n long, sums array<long>, mean array<double>, values array<double>, vectors array<double>"


# --- rank-one updates -------------------------------------------------------------------------

def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z_i^2 / (d_i - t) = 0 for rising, distinct d and nonzero z.

    Returned as (index of the nearer pole, offset from it), so differences to the poles keep
    their digits.  Root i lies between d_i and d_i+1, the last one within |z|^2 of the last pole.
    All roots are sought at once, by rational steps within halving brackets.
    """
    k, z2 = len(d), z * z
    top = np.append(d[1:], d[-1] + z2.sum())
    gap = top - d
    middle = 1 + (z2[None, :] / (d[None, :] - (d + gap / 2)[:, None])).sum(axis=1)
    # The nearer pole: the left one if the function is already positive in the middle.
    left = (middle >= 0) | (np.arange(k) == k - 1)
    pole = np.where(left, np.arange(k), np.minimum(np.arange(k) + 1, k - 1))
    delta = d[None, :] - d[pole][:, None]
    low = np.where(left, 0.0, -gap / 2)
    high = np.where(left, np.where(np.arange(k) == k - 1, gap, gap / 2), 0.0)
    t = (low + high) / 2
    upto = np.tri(k)
    last = np.arange(k) == k - 1
    d1 = d - d[pole]
    d2 = np.append(d[1:], d[-1]) - d[pole]
    for step in range(60):
        apart = delta - t[:, None]
        parts = z2[None, :] / apart
        f = 1 + parts.sum(axis=1)
        noise = 4 * _EPS * (1 + np.abs(parts).sum(axis=1))
        low, high = np.where(f < 0, t, low), np.where(f < 0, high, t)
        slopes = parts / apart
        slope = slopes.sum(axis=1)
        before = (slopes * upto).sum(axis=1)
        # The sums up to and beyond the root are each taken as one pole that has their value and slope.
        p1, p2 = d1 - t, d2 - t
        with np.errstate(divide="ignore", invalid="ignore"):
            c = f - p1 * before - p2 * (slope - before)
            a, b = (p1 + p2) * f - p1 * p2 * slope, p1 * p2 * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            move = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            move = np.where(last, p1 * f / (f - p1 * slope), move)
            new = t + move
        inside = np.isfinite(new) & (new > low) & (new < high)
        done = (np.abs(f) <= noise) | (high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high)))
        if done.all():
            break
        t = np.where(done, t, np.where(inside & (step % 8 != 7), new, (low + high) / 2))
    return pole, t


def rank_one(d: np.ndarray, u: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of u diag(d) u' + x x'; d rising, u orthogonal."""
    z = u.T @ x
    size = max(abs(d[-1]), z @ z)
    if size == 0:
        return d, u
    tol = 8 * _EPS * size
    scale = np.sqrt(z @ z)
    live = np.abs(z) * scale > tol
    if live.any():
        # Equal eigenvalues: turn the pair so that the later one holds the whole share.
        places = np.flatnonzero(live)
        last = places[0]
        for i in places[1:]:
            if d[i] - d[last] <= tol:
                if u.base is not None or not u.flags.owndata or not u.flags.writeable:
                    u = u.copy()
                r = np.hypot(z[last], z[i])
                c, s = z[i] / r, z[last] / r
                a, b = u[:, last].copy(), u[:, i].copy()
                u[:, last], u[:, i] = c * a - s * b, s * a + c * b
                z[last], z[i] = 0.0, r
                live[last] = False
            last = i
    at = np.flatnonzero(live)
    if not len(at):
        return d, u
    dl, zl = d[at], z[at]
    pole, t = secular_roots(dl, zl)
    # diff[i, j] = dl_j - root_i, from the nearer pole.
    diff = (dl[None, :] - dl[pole][:, None]) - t[:, None]
    # The share for which these roots are exact, so that the new vectors are orthogonal to rounding.
    ratio = -diff.copy()
    k = len(at)
    between = dl[None, :] - dl[:, None]
    np.fill_diagonal(between, 1.0)
    share = np.prod(ratio / np.where(np.eye(k, dtype=bool), 1.0, between.T), axis=0)
    zs = np.sqrt(np.abs(share)) * np.where(zl < 0, -1.0, 1.0)
    q = zs[None, :] / diff
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    values, vectors = d.copy(), u.copy()
    values[at] = dl[pole] + t
    vectors[:, at] = u[:, at] @ q.T
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class State:
    """Count, exact sums, mean and spectrum of the scatter of the vectors seen."""

    def __init__(self, width: int):
        self.n, self.sums, self.mean = 0, np.zeros(width, np.int64), np.zeros(width)
        self.values, self.vectors = np.zeros(width), np.eye(width)

    def add(self, x: np.ndarray) -> None:
        """One vector of whole numbers."""
        off = x - self.mean
        self.n += 1
        self.sums += x
        if self.n > 1:
            self.values, self.vectors = rank_one(self.values, self.vectors, off * np.sqrt((self.n - 1) / self.n))
        self.mean = self.sums / self.n

    def add_block(self, block: np.ndarray) -> None:
        """Rows of whole numbers, whose centred scatter enters as at most width + 1 rank-one updates.

        More rows than dimensions are first turned (Householder) into as many rows as dimensions
        with the same scatter; each of these is one update.
        """
        k, width = block.shape
        if k <= width:
            for x in block:
                self.add(x)
            return
        sums = block.sum(axis=0)
        mean = sums / k
        if self.n:
            self.values, self.vectors = rank_one(
                self.values, self.vectors, (mean - self.mean) * np.sqrt(self.n * k / (self.n + k))
            )
        for x in np.linalg.qr(block - mean, mode="r"):
            self.values, self.vectors = rank_one(self.values, self.vectors, x)
        self.n += k
        self.sums = self.sums + sums
        self.mean = self.sums / self.n

    def merge(self, other: "State") -> None:
        if not other.n:
            return
        if self.n:
            off = other.mean - self.mean
            self.values, self.vectors = rank_one(
                self.values, self.vectors, off * np.sqrt(self.n * other.n / (self.n + other.n))
            )
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector * np.sqrt(value))
        self.n += other.n
        self.sums = self.sums + other.sums
        self.mean = self.sums / self.n

    def row(self) -> dict:
        return {"n": self.n, "sums": self.sums.tolist(), "mean": self.mean.tolist(),
                "values": self.values.tolist(), "vectors": self.vectors.ravel().tolist()}

    @staticmethod
    def of(row) -> "State":
        s = State(len(row["sums"]))
        s.n, s.sums = int(row["n"]), np.array(row["sums"], np.int64)
        s.mean, s.values = np.array(row["mean"]), np.array(row["values"])
        s.vectors = np.array(row["vectors"]).reshape(len(s.sums), len(s.sums))
        return s


# --- distributed passes -----------------------------------------------------------------------

def _blocks(batches: Iterator[pa.RecordBatch], column: str, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch with its vectors as rows of a matrix."""
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def _spectra(fit: DataFrame, width: int) -> State:
    """One state a partition, then a tree of merges."""

    def fold(batches):
        state = State(width)
        for _, block in _blocks(batches, "x", width):
            for at in range(0, len(block), BLOCK_ROWS):
                state.add_block(block[at : at + BLOCK_ROWS])
        if state.n:
            yield pa.RecordBatch.from_pylist([state.row()], schema=schema)

    def join(key: tuple, group: pa.Table) -> pa.Table:
        state, *others = [State.of(row) for row in group.to_pylist()]
        for other in others:
            state.merge(other)
        return pa.Table.from_pylist([{**state.row(), "node": key[0].as_py()}], schema=numbered)

    schema = pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("mean", pa.list_(pa.float64())),
                        ("values", pa.list_(pa.float64())), ("vectors", pa.list_(pa.float64()))])
    numbered = schema.append(pa.field("node", pa.int64()))
    states = written(fit.select("x").mapInArrow(fold, _STATE).withColumn("node", F.spark_partition_id().cast("long")), "spectra")
    # Partition numbers have gaps; count them off so that each level is FAN_IN times smaller.
    left = states.agg(F.max("node") + 1).first()[0]
    while left > 1:
        states = states.withColumn("node", F.call_function("div", F.col("node"), F.lit(FAN_IN)))
        states = states.groupBy("node").applyInArrow(join, _STATE + ", node long")
        left = -(-left // FAN_IN)
    return State.of(states.first())


def _gram(fit: DataFrame, width: int, mean: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and Gram matrix, over the fit list, of the centred vectors in the basis."""

    def fold(batches):
        sums, gram = np.zeros(width), np.zeros((width, width))
        for _, block in _blocks(batches, "x", width):
            turned = (block - mean) @ basis
            sums += turned.sum(axis=0)
            gram += turned.T @ turned
        yield pa.RecordBatch.from_pydict({"i": np.arange(width + 1), "row": list(np.vstack([sums, gram]))}, schema=schema)

    schema = pa.schema([("i", pa.int64()), ("row", pa.list_(pa.float64()))])
    parts = fit.select("x").mapInArrow(fold, "i long, row array<double>")
    # Added up entry by entry, with partial sums in the tasks.
    cells = parts.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width + 1, width))
    for r in cells.collect():
        out[r["i"], r["j"]] = r["v"]
    return out[0], out[1:]


class Fit:
    """What a fit gives: n, exact sums, falling eigenvalues, eigenvectors as columns, error."""

    def __init__(self, n, sums, values, vectors, explained, error):
        self.n, self.sums, self.values, self.vectors, self.explained, self.error = n, sums, values, vectors, explained, error


def fit_whitening(fit: DataFrame, width: int, components: int = COMPONENTS) -> Fit:
    """``fit`` holds each vector of whole numbers (column ``x``, less the shift) once."""
    state = _spectra(fit, width)
    n, sums = state.n, state.sums
    mean, basis = sums / n, state.vectors
    for attempt in range(MOST_PASSES):
        total, gram = _gram(fit, width, mean, basis)
        cov = gram / n - np.outer(total / n, total / n)
        off = np.abs(cov - np.diag(np.diag(cov))).max() if width > 1 else 0.0
        if attempt and off <= TOLERANCE * max(np.abs(np.diag(cov)).max(), np.finfo(float).tiny):
            break
        if attempt == MOST_PASSES - 1:
            break
        _, turn = np.linalg.eigh((cov + cov.T) / 2)
        basis = basis @ turn
        # Rounding of many products leaves the basis a little off; QR takes that out.
        q, r = np.linalg.qr(basis)
        basis = q * np.sign(np.diag(r))
    values = np.diag(cov)
    order = np.argsort(-values, kind="stable")[:components]
    e, trace = values[order], values.sum()
    sound = e > width * _EPS * max(values.max(), 0)
    explained = e / trace if trace > 0 else np.zeros(len(e))
    error = 0.0
    if sound.any():
        kept = order[sound]
        scale = np.sqrt(values[kept])
        error = float(np.abs(cov[np.ix_(kept, kept)] / np.outer(scale, scale) - np.eye(len(kept))).max())
    return Fit(n, sums, np.where(sound, e, 0.0), basis[:, order], np.maximum(explained, 0.0), error)


def whiten(rows: DataFrame, fitted: Fit, width: int) -> DataFrame:
    """(vec_id, x) -> vec_id, deviation and the list ``whitened``, null where a component has no variance."""
    n, sums, mean = fitted.n, fitted.sums, fitted.sums / fitted.n
    scale = np.where(fitted.values > 0, np.sqrt(fitted.values), 1.0)
    none = np.flatnonzero(fitted.values <= 0)
    turn = fitted.vectors / scale

    def project(batches):
        for batch, block in _blocks(batches, "x", width):
            white = (block - mean) @ turn
            most = n * float(np.abs(block).max()) + float(np.abs(sums).max())
            if most * most * width < 2**62:
                off = n * block - sums
                deviation = (off * off).sum(axis=1)
            else:
                off = n * block.astype(object) - sums.astype(object)
                exact = (off * off).sum(axis=1)
                deviation = [v if v < 2**63 else None for v in exact]
            lists = white.tolist()
            for k in none:
                for one in lists:
                    one[k] = None
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(deviation, pa.int64()), pa.array(lists, pa.list_(pa.float64()))],
                names=["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "x").mapInArrow(project, "vec_id long, deviation long, whitened array<double>")


def whole_numbers(vector: Column) -> Column:
    """floor(64 * c) of each entry: x less the shift; null if the vector takes no part."""
    usable = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(2.0**47), F.lit(False)))
    return F.when(usable, F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("long")))


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = embeddings.sparkSession
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col("embedding")).alias("x"))
    rows = written(vectors.where("x IS NOT NULL AND size(x) > 0"), "vectors")
    out = None
    for (width,) in sorted(map(tuple, rows.select(F.size("x")).distinct().collect())):
        ours = rows.where(F.size("x") == width)
        fit = written(ours.select("x").distinct(), "fit-list")
        f = fit_whitening(fit, width, components)
        named = F.array(*[F.lit(float(v)) for v in f.explained])
        one = whiten(ours, f, width).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
            "vec_id", (F.col("at") + 1).alias("component"), F.lit(f.n).cast("long").alias("n"), "deviation", "whitened",
            F.get(named, F.col("at")).alias("explained"), F.lit(f.error).alias("identity_error"),
        )
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame(
        [], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))

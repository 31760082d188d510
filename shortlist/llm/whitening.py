"""Whitening of embeddings by their leading principal components, found with a
block Jacobi-Davidson method that never forms the covariance matrix.

Each entry c of a vector becomes the whole number floor(1024 * c) + 100000, so
sums and deviations are exact. The covariance V is used only through products
V T with a few columns T: each task adds up X'(X T) over its centred rows, and
Spark sums the tasks' parts. On the driver stay the search space and the
locked vectors, some ``SPACE`` columns of the vectors' dimension, however many
rows there are.

A round does a Rayleigh-Ritz step in the search space, locks the leading pairs
whose residual has reached double precision, and for each other wanted pair
(u, theta) solves the correction equation

    (I - QQ') (V - theta I) (I - QQ') t = -r,     Q = the locked vectors and u

by MINRES. All equations advance together, so an inner step is one distributed
product for the whole block. The corrections, made orthogonal to all that is
known, extend the search space, which is cut back to its best vectors when it
is full. It ends when as many pairs as wanted are locked and no larger Ritz
value is left.

Vectors are kept as blocks of packed whole numbers in the checkpoint folder,
read once per product; a lost executor's part of a product is computed anew.

Defined results: vectors that are null or empty, or hold a null, a non-finite
entry or one of ``TOO_LARGE`` or more, are left out. If lengths differ, those of
the commonest length stay (of equally common ones the longer). Repeated rows
count each time; null ids are kept. Components without variance are left out,
so equal vectors, or a single one, have none. Empty tables give no rows. Extra
columns are not read. Of a component's two signs the one with a positive
largest entry is taken. Deviations of 38 digits and more are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import col
from shortlist.session import cut_lineage

SCALE, SHIFT = 1024, 100_000
#: 1024 times an entry must leave room in a long.
TOO_LARGE = 2.0 ** 40
COMPONENTS = 8
#: Columns beyond the wanted ones with which the search begins.
GUARD = 4
#: Most columns of the search space, and those kept when it is full, as
#: multiples of the wanted ones.
SPACE, KEPT = 6, 2
INNER = 6
ROUNDS = 60
EPS = float(np.finfo(float).eps)
#: A residual of so many roundings of the largest eigenvalue counts as zero.
ROUNDINGS = 64
BLOCK_BYTES = 1 << 20

Product = Callable[[np.ndarray], np.ndarray]


# -- the eigenvalue problem, on the driver -------------------------------------

def orthonormal(new: np.ndarray, *known: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what ``new`` adds to ``known``."""
    base = np.hstack([k for k in known if k.shape[1]] or [new[:, :0]])
    out: list[np.ndarray] = []
    for v in new.T:
        size = np.linalg.norm(v)
        if not size:
            continue
        v = v / size
        all_ = np.hstack([base, np.array(out).T]) if out else base
        for _ in range(3):
            v = v - all_ @ (all_.T @ v)
        left = np.linalg.norm(v)
        if left > 1e-10:
            v = v / left
            out.append(v - all_ @ (all_.T @ v))
    return np.array(out).T if out else new[:, :0]


def minres(product: Product, theta: np.ndarray, locked: np.ndarray, ritz: np.ndarray, right: np.ndarray,
           steps: int, reduce: float) -> np.ndarray:
    """Approximate solutions of the correction equations of the columns of
    ``ritz``, which all advance together; a column is done when its residual
    is ``reduce`` times the right side's."""
    def project(x: np.ndarray, u: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - locked @ (locked.T @ x)
            x = x - u * np.sum(u * x, axis=0)
        return x

    rhs = project(right, ritz)
    beta = np.linalg.norm(rhs, axis=0)
    x, w, w_old, v_old = (np.zeros_like(rhs) for _ in range(4))
    active = beta > 0
    v = np.divide(rhs, beta, out=np.zeros_like(rhs), where=active)
    eta, goal = beta.copy(), reduce * beta
    gamma, gamma_old = np.ones_like(beta), np.ones_like(beta)
    sigma, sigma_old, beta = np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        on = np.flatnonzero(active)
        if not len(on):
            break
        u, q = ritz[:, on], v[:, on]
        p = project(product(q) - theta[on] * q, u)
        alpha = np.sum(q * p, axis=0)
        p = project(p - alpha * q - beta[on] * v_old[:, on], u)
        longer = np.linalg.norm(p, axis=0)
        delta = gamma[on] * alpha - gamma_old[on] * sigma[on] * beta[on]
        rho1 = np.hypot(delta, longer)
        rho2 = sigma[on] * alpha + gamma_old[on] * gamma[on] * beta[on]
        rho3 = sigma_old[on] * beta[on]
        able = rho1 > 0
        rho1 = np.where(able, rho1, 1.0)
        gamma_old[on], sigma_old[on] = gamma[on], sigma[on]
        gamma[on], sigma[on] = delta / rho1, longer / rho1
        new = (q - rho3 * w_old[:, on] - rho2 * w[:, on]) / rho1
        w_old[:, on], w[:, on] = w[:, on], new
        x[:, on] += np.where(able, gamma[on] * eta[on], 0.0) * new
        eta[on] *= -sigma[on]
        v_old[:, on], beta[on] = q, longer
        v[:, on] = np.divide(p, longer, out=np.zeros_like(p), where=longer > 0)
        active[on] = able & (longer > EPS * np.abs(theta[on])) & (np.abs(eta[on]) > goal[on])
    return x


def jacobi_davidson(product: Product, dims: int, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues (falling) and their unit vectors of a
    symmetric positive semidefinite operator given by its products."""
    wanted = min(wanted, dims)
    locked, values = np.zeros((dims, 0)), np.zeros(0)
    space = orthonormal(np.random.default_rng(seed).standard_normal((dims, min(dims, wanted + GUARD))))
    image = product(space)
    for round_ in range(ROUNDS):
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        rest = image - space * theta
        rest = rest - locked @ (locked.T @ rest)
        size = np.linalg.norm(rest, axis=0)
        tiny = ROUNDINGS * EPS * max([0.0, *values, *theta])
        done = 0
        while done < len(theta) and size[done] <= tiny and (
                len(values) < wanted or theta[done] > values.min()):
            locked = np.hstack([locked, space[:, [done]]])
            values = np.append(values, theta[done])
            done += 1
        space, image, theta, rest = space[:, done:], image[:, done:], theta[done:], rest[:, done:]
        found = np.sort(values)[::-1][:wanted]
        if not len(theta) or len(found) == wanted and theta[0] <= found[-1] + tiny:
            order = np.argsort(-values, kind="stable")[:wanted]
            return values[order], locked[:, order]
        block = slice(0, max(1, wanted - len(values)))
        fixes = minres(product, theta[block], locked, space[:, block], -rest[:, block], INNER,
                       max(0.5 ** (round_ + 2), 1e-3))
        if space.shape[1] + fixes.shape[1] > SPACE * wanted:
            space, image = space[:, :KEPT * wanted], image[:, :KEPT * wanted]
        new = orthonormal(np.hstack([fixes, rest[:, block]]) if round_ % 8 == 7 else fixes, locked, space)
        if new.shape[1]:
            space, image = np.hstack([space, new]), np.hstack([image, product(new)])
    raise ArithmeticError(f"no convergence in {ROUNDS} rounds: {len(values)} of {wanted} pairs")


# -- rows, in Spark ------------------------------------------------------------

def blocks_of(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """ids, dims, x: blocks of vectors as packed whole numbers."""
    two = vectors.select(col(vec_id).alias("vec_id"), col(embedding).cast("array<double>").alias("embedding"))
    kind = two.schema["vec_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = pc.is_valid(batch.column(1))
            ids, lists = batch.column(0).filter(given), batch.column(1).filter(given)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)  # null entries become NaN
            first = np.cumsum(sizes) - sizes
            for dims in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == dims)
                values = flat[first[at][:, None] + np.arange(dims)]
                fine = (np.abs(values) < TOO_LARGE).all(axis=1)
                at, x = at[fine], np.floor(SCALE * values[fine]).astype(np.int64) + SHIFT
                rows = max(1, BLOCK_BYTES // (8 * dims))
                for lo in range(0, len(at), rows):
                    part = x[lo:lo + rows]
                    if np.abs(part).max() < 1 << 31:
                        part = part.astype(np.int32)
                    own = ids.take(pa.array(at[lo:lo + rows]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                         pa.array([dims], pa.int64()), pa.array([part.tobytes()], pa.binary())], ["ids", "dims", "x"])

    return two.mapInArrow(pack, f"ids array<{kind}>, dims bigint, x binary")


def unpacked(data: pa.Scalar, rows: int, dims: int) -> np.ndarray:
    raw = data.as_buffer()
    return np.frombuffer(raw, np.dtype(f"i{raw.size // (rows * dims)}")).reshape(rows, dims)


def summed(blocks: DataFrame, size: int, part: Callable[[np.ndarray], np.ndarray], kind: type = float) -> np.ndarray:
    """The sum of ``part`` (an array of ``size`` numbers) over all blocks of
    rows. A task sends its own sum, number by number; Spark adds them up, so
    the driver gets ``size`` numbers."""
    number = "bigint" if kind is int else "double"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64 if kind is int else float)
        for batch in batches:
            for ids, dims, x in zip(*batch.columns):
                total += part(unpacked(x, len(ids), dims.as_py())).reshape(-1)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["slot", "value"])

    out = np.zeros(size, np.int64 if kind is int else float)
    for slot, value in blocks.mapInArrow(add, f"slot bigint, value {number}").groupBy("slot").agg(
            F.sum("value")).collect():
        out[slot] = value
    return out


class Fit(NamedTuple):
    """What whitening needs of the fit list."""

    n: int
    dims: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean: the mean's whole part goes exactly."""
        whole, left = zip(*(divmod(s, self.n) for s in self.sums))
        return (x - np.array(whole, np.int64)).astype(float) - np.array(left) / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.vectors / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The exact sums of (n x - S)^2 of each row, decimal(38, 0)."""
        kind, sums = pa.decimal128(38, 0), np.array(self.sums, object)
        span = max(abs(int(x.max())), abs(int(x.min()))) * self.n + max(abs(s) for s in self.sums)
        if span < 1 << 62:
            apart = self.n * x.astype(np.int64) - sums.astype(np.int64)
            if int(np.abs(apart).max()) ** 2 * self.dims < 1 << 63:
                return pa.array((apart ** 2).sum(axis=1)).cast(kind)
        exact = ((self.n * x.astype(object) - sums) ** 2).sum(axis=1)
        return pa.array([str(v) if v < 10 ** 38 else None for v in exact]).cast(kind)


def fit(blocks: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The fit over all blocks; None without vectors. ``blocks`` is read some
    eighty times, so it should be a table."""
    lengths = blocks.groupBy("dims").agg(F.sum(F.size("ids")).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if lengths is None:
        return None
    dims, n = lengths
    blocks = blocks.filter(F.col("dims") == dims)
    sums = [int(s) for s in summed(blocks, dims, lambda x: x.sum(axis=0, dtype=np.int64), int)]
    known = Fit(n, dims, sums, np.zeros(0), np.zeros((dims, 0)), 0.0, 0.0)
    trace = summed(blocks, 1, lambda x: np.array((known.centred(x) ** 2).sum()))[0] / n

    def product(columns: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            apart = known.centred(x)
            return apart.T @ (apart @ columns)

        return summed(blocks, columns.size, part).reshape(columns.shape) / n

    values, vectors = jacobi_davidson(product, dims, components)
    varied = values > ROUNDINGS * dims * EPS * trace
    values, vectors = values[varied], vectors[:, varied]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[largest, np.arange(len(values))])
    known, k = known._replace(values=values, vectors=vectors, trace=trace), len(values)
    if not k:
        return known
    mean = summed(blocks, k, lambda x: known.whitened(x).sum(axis=0)) / n

    def square(x: np.ndarray) -> np.ndarray:
        apart = known.whitened(x) - mean
        return apart.T @ apart

    spread = summed(blocks, k * k, square).reshape(k, k) / n
    return known._replace(identity_error=float(np.abs(spread - np.eye(k)).max()))


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """One row per vector that stays: vec_id, n, deviation (decimal), whitened
    and explained (arrays by component) and identity_error."""
    blocks = cut_lineage(blocks_of(vectors, vec_id, embedding))
    kind = vectors.select(col(vec_id).alias("id")).schema["id"].dataType.simpleString()
    known = fit(blocks, components)
    dims = known.dims if known else 0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, _, data in zip(*batch.columns):
                x = unpacked(data, len(ids), dims)
                out = known.whitened(x)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(x) + 1) * out.shape[1], pa.int32()), pa.array(out.reshape(-1)))
                yield pa.RecordBatch.from_arrays([ids.values, known.deviations(x), lists],
                                                 ["vec_id", "deviation", "whitened"])

    found = blocks.filter(F.col("dims") == dims).mapInArrow(
        rows, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")
    share = [float(v / known.trace) for v in known.values] if known else []
    return found.select(
        "vec_id", F.lit(known.n if known else 0).cast("bigint").alias("n"), "deviation", "whitened",
        F.array(*[F.lit(s) for s in share]).cast("array<double>").alias("explained"),
        F.lit(known.identity_error if known else 0.0).alias("identity_error"))

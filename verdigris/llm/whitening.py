"""Whitening of embeddings by a compensated covariance.

Vectors are centred as unevaluated sums of two doubles; their outer products are cut, without error, into slices of
few bits whose matrix products are exact in doubles, and added up in double-double. Tasks hand on high and low parts,
which are merged in double-double too. The eigen-solve reduces the matrix to tridiagonal form and divides and
conquers (LAPACK's syevd, on a matrix of the vectors' length), then a few rounds of refinement in
double-double bring small components to full precision.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bits of a slice, slices of a number, and rows of an exact product: 2 * BITS + log2(ROWS) stays below 53.
BITS, SLICES, ROWS = 18, 6, 1 << 15
#: Components with at most this share of the trace count as absent: doubles can't project on them.
LEAST_SHARE = 1e-20
#: Partial sums are merged in so many groups first, then together.
MERGES = 64
#: Entries from here on, where whole doubles are no longer exact, count as not finite.
LARGEST = 2.0**52


def two_sum(a, b):
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(a, b):
    """Sum of two double-double numbers or arrays (high, low)."""
    s, e = two_sum(a[0], b[0])
    return two_sum(s, e + a[1] + b[1])


def cut(hi: np.ndarray, lo: np.ndarray) -> tuple[list[np.ndarray], list[float]]:
    """Whole-number slices of at most BITS bits and their units: their sum is hi + lo up to 2**(-BITS * SLICES) of the largest entry."""
    top = float(np.abs(hi).max(initial=0.0))
    unit = 2.0 ** np.frexp(top)[1] if top else 1.0
    out, units = [], []
    for _ in range(SLICES):
        unit *= 2.0**-BITS
        whole = np.rint(hi / unit)
        out.append(whole)
        units.append(unit)
        hi, lo = two_sum(hi - whole * unit, lo)
    return out, units


def exact_product(a, b) -> tuple[np.ndarray, np.ndarray]:
    """a.T @ b of double-double matrices, in double-double; the slices' products have no rounding error."""
    total = (np.zeros((a[0].shape[1], b[0].shape[1])),) * 2
    for r in range(0, len(a[0]), ROWS):
        (x, ux), (y, uy) = cut(a[0][r : r + ROWS], a[1][r : r + ROWS]), cut(b[0][r : r + ROWS], b[1][r : r + ROWS])
        for s in range(SLICES - 1, -1, -1):  # small ones first
            for i in range(s + 1):
                total = add(total, ((x[i].T @ y[s - i]) * (ux[i] * uy[s - i]), 0.0))
    return total


def times(a, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a @ b of a double-double and a plain matrix."""
    return exact_product((a[0].T.copy(), a[1].T.copy()), (b, np.zeros_like(b)))


def numbers(batch: pa.Array, scale: float, shift: int, length: int) -> np.ndarray:
    """floor(scale * entry) + shift as int64, a row a vector."""
    flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).astype(np.int64).reshape(-1, length) + shift


def usable(df: DataFrame, vector: str, key: str, scale: float) -> DataFrame:
    """k and v (doubles) of the rows whose vector is not null or empty and holds finite numbers alone."""
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(float(scale))) < LARGEST))
    return df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where((F.size("v") > 0) & fine)


def column_sums(rows: DataFrame, scale: float, shift: int, length: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of each dimension."""

    def partial(batches):
        n, sums = 0, np.zeros(length, object)
        for b in batches:
            x = numbers(b.column(0), scale, shift, length)
            n += len(x)
            sums += (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        if n:
            from decimal import Decimal

            yield from ({"dim": i, "n": n, "s": Decimal(int(s))} for i, s in enumerate(sums))

    got = common.map_dicts(rows.select("v"), partial, "dim int, n long, s decimal(38,0)").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    sums = {r["dim"]: int(r["s"]) for r in got}
    return (got[0]["n"] if got else 0), [sums.get(i, 0) for i in range(length)]


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Adds up the rows (high and low parts of one matrix row each) of a group, in the order of their tasks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = (np.zeros(len(table["hi"][0])),) * 2
        for hi, lo in zip(table["hi"], table["lo"]):
            total = add(total, (np.array(hi.values), np.array(lo.values)))
        return pa.table({"row": table["row"].slice(0, 1), "part": table["part"].slice(0, 1), "hi": pa.array([total[0]], pa.list_(pa.float64())), "lo": pa.array([total[1]], pa.list_(pa.float64()))})

    return parts.groupBy(*by).applyInArrow(run, "row int, part long, hi array<double>, lo array<double>")


def scatter(rows: DataFrame, make: Callable[[], Callable], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum over all rows of the outer product of what make()(batch) gives (high, low), in double-double."""

    def partial(batches):
        from pyspark import TaskContext

        block, total, met = make(), (np.zeros((width, width)),) * 2, False
        for b in batches:
            x = block(b)
            total, met = add(total, exact_product(x, x)), True
        if met:
            part = TaskContext.get().partitionId()
            yield from ({"row": i, "part": part, "hi": total[0][i].tolist(), "lo": total[1][i].tolist()} for i in range(width))

    parts = common.map_dicts(rows, partial, "row int, part long, hi array<double>, lo array<double>")
    few = merged(parts.withColumn("merge_", F.pmod("part", F.lit(MERGES))), ["row", "merge_"])
    hi, lo = np.zeros((width, width)), np.zeros((width, width))
    for r in merged(few, ["row"]).collect():  # width rows
        hi[r["row"]], lo[r["row"]] = r["hi"], r["lo"]
    return hi, lo


def over(total: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Double-double divided by a whole number."""
    f = float(n)
    q = total[0] / f
    # the remainder total - q * n, exactly: q is cut so that both products are exact
    big = q * 134217729.0
    high = big - (big - q)
    low = q - high
    fh = float(n >> 26 << 26)
    fl = float(n - int(fh))
    rest = (total[0], total[1])
    for p in (high * fh, high * fl, low * fh, low * fl):
        rest = add(rest, (-p, 0.0))
    return two_sum(q, (rest[0] + rest[1]) / f)


def eigen(cov: tuple[np.ndarray, np.ndarray], rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns.

    Householder reduction and divide and conquer, then refinement: with R = I - X'X and S = X'VX in
    double-double, X gains X E, E_ij = (S_ij + e_j R_ij) / (e_j - e_i). Eigenvalues that the errors so far can't tell
    apart are a group: inside it E_ij = R_ij / 2, and its own block of S, small as it may be, is solved anew.
    """
    _, x = np.linalg.eigh((cov[0] + cov[0].T) / 2)
    xs = (x[:, ::-1].copy(), np.zeros_like(x))
    eye = (np.eye(len(x)), np.zeros_like(x))
    for k in range(rounds + 1):
        gram, s = exact_product(xs, xs), exact_product(xs, exact_product(cov, xs))
        r = sum(add(eye, (-gram[0], -gram[1])))
        s = s[0] + s[1]
        e = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(-e, kind="stable")
        e, xs, r, s = e[order], (xs[0][:, order], xs[1][:, order]), r[np.ix_(order, order)], s[np.ix_(order, order)]
        if k == rounds:
            return e, xs[0] + xs[1]
        doubt = 2 * (np.linalg.norm(s - np.diag(e)) + np.abs(e).max() * np.linalg.norm(r))
        group = np.cumsum(np.diff(e, prepend=e[0]) < -doubt)
        other = group[:, None] != group[None, :]
        gap = np.where(other, e[None, :] - e[:, None], 1)
        step = np.where(other, (s + e[None, :] * r) / gap, r / 2)
        xs = add(xs, times(xs, step))
        for g in np.flatnonzero(np.bincount(group) > 1):
            i = np.flatnonzero(group == g)
            turned = times((xs[0][:, i], xs[1][:, i]), np.linalg.eigh((s[np.ix_(i, i)] + s[np.ix_(i, i)].T) / 2)[1][:, ::-1])
            xs[0][:, i], xs[1][:, i] = turned


def deviations(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n * x - S (exact, as doubles after one rounding) over n, and the exact sum of squares of n * x - S."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 1 << 62:
        y = x * n - np.array(sums, np.int64)
    else:
        y = x.astype(object) * n - np.array(sums, object)
    largest = int(np.abs(y).max(initial=0))
    square = (y * y if largest * largest * x.shape[1] < 1 << 62 else y.astype(object) ** 2).sum(axis=1)
    return (y.astype(np.float64) if y.dtype != object else np.array([[float(Fraction(int(v))) for v in r] for r in y])) / n, square


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 32, scale: float = 1.0, shift: int = 0) -> DataFrame:
    """key, component, n, deviation, whitened, explained and identity_error, a row for each usable vector and component.

    Entries become whole numbers x = floor(scale * entry) + shift. Components are numbered from 1 by falling
    eigenvalue of x's covariance; whitened is the centred vector projected on one, over the root of its eigenvalue;
    explained its share of the trace; identity_error the largest entry of whitened's covariance minus the identity;
    deviation the exact sum of squares of n * x - S (decimal).

    Four passes over the vectors: sums, covariance, check of the whitened, output; only matrices of the vectors' length
    reach the driver. Vectors that are null or empty or hold null, non-finite entries or entries beyond 2**52 are left
    out, as are those of another length than the commonest (the longest of such). A null key stays, repeated rows count
    each, an empty table (or vectors without any variance) gives no rows: components without variance (at most
    LEAST_SHARE of the trace) don't exist. Extra columns are not read, so their names may be anything. There is no text.
    """
    spark = df.sparkSession
    common.small_batches(spark)
    rows = usable(df, vector, key, scale)
    kind = df.schema[key].dataType.simpleString().replace("bigint", "long")
    ddl = f"{{key}} {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], ddl.format(key="k")).transform(common.keyed, key)
    d = lengths[0]["d"]
    rows = rows.where(F.size("v") == d)
    n, sums = column_sums(rows, scale, shift, d)
    means = [Fraction(s, n) for s in sums]
    mean_hi = np.array([float(m) for m in means])
    mean_lo = np.array([float(m - Fraction(h)) for m, h in zip(means, mean_hi)])

    def centred():
        def block(b):
            hi, lo = two_sum(numbers(b.column(0), scale, shift, d).astype(np.float64), -mean_hi)
            return two_sum(hi, lo - mean_lo)

        return block

    cov = over(scatter(rows.select("v"), centred, d), n)
    values, vectors = eigen(cov)
    trace = float(np.trace(cov[0]) + np.trace(cov[1]))
    k = min(components, int((values > LEAST_SHARE * trace).sum())) if trace > 0 else 0
    if not k:
        return spark.createDataFrame([], ddl.format(key="k")).transform(common.keyed, key)
    onto = vectors[:, :k] / np.sqrt(values[:k])
    explained = values[:k] / trace

    def whitened_and_one():
        def block(b):
            w = deviations(numbers(b.column(0), scale, shift, d), n, sums)[0] @ onto
            w = np.concatenate([w, np.ones((len(w), 1))], axis=1)  # the last row of the products holds the sums
            return w, np.zeros_like(w)

        return block

    hi, lo = over(scatter(rows.select("v"), whitened_and_one, k + 1), n)
    left = hi[k, :k] + lo[k, :k]  # what the rounding of the means has left: some 1e-17
    error = float(np.abs((hi[:k, :k] - np.eye(k)) + (lo[:k, :k] - np.outer(left, left))).max())

    out = common.arrow_schema(ddl.format(key="k"))

    def project(batches):
        for b in batches:
            x = numbers(b.column(1), scale, shift, d)
            y, square = deviations(x, n, sums)
            every = pa.array(np.repeat(np.arange(len(x)), k))
            exact = pa.array(list(map(int, square)) if square.dtype == object else square).cast(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(every), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(x) * k, n), pa.int64()),
                exact.take(every), pa.array((y @ onto).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error)),
            ], schema=out)

    return rows.mapInArrow(project, ddl.format(key="k")).transform(common.keyed, key)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = whiten(common.table(spark, sf_dir, "embeddings"), scale=64.0, shift=1_000_000)
    return d.withColumn("deviation", F.col("deviation").try_cast("long"))

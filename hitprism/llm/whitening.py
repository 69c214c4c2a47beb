"""Whitened embeddings: projections on the leading principal components, each
divided by its standard deviation.

The covariance is summed up by tasks, one matrix each, from centred values. Its
size is the square of the dimension, whatever the number of rows, so the driver
solves it: Householder reflections make it tridiagonal, Sturm counts bisect the
leading eigenvalues, inverse iteration gives their vectors, made orthogonal again
within clusters of close values. The components are sent to the tasks.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hitprism.llm.batches import map_partitions
from hitprism.llm.stored import stored

SCALE = 256
#: Eigenvalues closer than this part of the largest one are a cluster.
_CLOSE = 1e-3
_EPS = np.finfo(float).eps


def tridiagonal(matrix):
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of a
    symmetric one; and the reflections, one in each row, that lead there."""
    a = np.array(matrix, float)
    n = len(a)
    mirrors = np.zeros((max(n - 2, 0), n))
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        size = np.linalg.norm(x)
        if size == 0:
            continue
        v = x / size
        v[0] += np.copysign(1.0, v[0])
        v /= np.linalg.norm(v)
        mirrors[k, k + 1:] = v
        inner = a[k + 1:, k + 1:]
        p = inner @ v
        w = 2 * (p - (v @ p) * v)
        inner -= np.outer(v, w) + np.outer(w, v)
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = -np.copysign(size, x[0])
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def n_below(diagonal, off, values):
    """Sturm counts: how many eigenvalues lie below each value."""
    least = _EPS * (np.abs(off).max(initial=0) + np.abs(diagonal).max(initial=0)) + np.finfo(float).tiny
    pivot, count = diagonal[0] - values, np.zeros(len(values), int)
    count += pivot < 0
    for i in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        pivot = diagonal[i] - values - off[i - 1] ** 2 / pivot
        count += pivot < 0
    return count


def leading_eigenvalues(diagonal, off, k):
    """The ``k`` largest eigenvalues, falling, by bisection to the last bit."""
    n = len(diagonal)
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low = np.full(k, (diagonal - reach).min())
    high = np.full(k, (diagonal + reach).max())
    place = n - np.arange(k)  # so many are not above the value sought
    for _ in range(200):
        middle = (low + high) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        above = n_below(diagonal, off, middle) >= place
        low, high = np.where(above, low, middle), np.where(above, middle, high)
    return (low + high) / 2


def _solve(diagonal, off, value, right):
    """Of (T - value) x = right, T tridiagonal: elimination with row exchanges."""
    n = len(diagonal)
    least = _EPS * (np.abs(diagonal).max() + np.abs(off).max(initial=0)) + np.finfo(float).tiny
    rows = np.zeros((n, 4))  # diagonal, two entries to its right, right side
    rows[:, 0], rows[:-1, 1], rows[:, 3] = diagonal - value, off, right
    for i in range(n - 1):
        below = np.array([off[i], rows[i + 1, 0], rows[i + 1, 1], rows[i + 1, 3]])
        if abs(below[0]) > abs(rows[i, 0]):
            rows[i], below = below, rows[i].copy()
        if abs(rows[i, 0]) < least:
            rows[i, 0] = least
        part = below[0] / rows[i, 0]
        rows[i + 1] = below[1] - part * rows[i, 1], below[2] - part * rows[i, 2], 0, below[3] - part * rows[i, 3]
    if abs(rows[-1, 0]) < least:
        rows[-1, 0] = least
    x = np.zeros(n + 2)
    for i in range(n - 1, -1, -1):
        x[i] = (rows[i, 3] - rows[i, 1] * x[i + 1] - rows[i, 2] * x[i + 2]) / rows[i, 0]
    return x[:n]


def leading_components(matrix, k):
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and a unit
    vector for each, in rows; those of equal values are orthogonal, too."""
    diagonal, off, mirrors = tridiagonal(matrix)
    n = len(diagonal)
    values = leading_eigenvalues(diagonal, off, k)
    size = np.abs(values).max(initial=0)
    vectors = np.zeros((k, n))
    start = np.random.default_rng(11).standard_normal((k, n))
    for i in range(k):
        cluster = [j for j in range(i) if abs(values[j] - values[i]) <= _CLOSE * size]
        x = start[i] / np.linalg.norm(start[i])
        # values of a cluster are moved apart a little, or they would give one vector
        value = values[i] - len(cluster) * 4 * _EPS * size
        for _ in range(5):
            x = _solve(diagonal, off, value, x / np.linalg.norm(x))
            x /= np.abs(x).max()
            for _ in range(2):
                x -= vectors[cluster].T @ (vectors[cluster] @ x)
        vectors[i] = x / np.linalg.norm(x)
    for v in mirrors[::-1]:
        vectors -= 2 * np.outer(vectors @ v, v)
    return values, vectors


def _moments(rows, column, centre):
    """Sum of the products of centred values, as a matrix; a row for each task and
    matrix row, added up by matrix row. ``centre``: a function to call in tasks."""
    d = centre.dimension

    def run(batches):
        total = np.zeros((d, d))
        for batch in batches:
            x = centre(_matrix(batch.column(column), centre.input))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "sums"])

    def add(group):
        sums = _matrix(group.column("sums").combine_chunks(), d).sum(axis=0)
        return pa.table({"i": group.column("i")[:1], "sums": pa.array([sums.tolist()], pa.list_(pa.float64()))})

    parts = map_partitions(rows.select(column), run, "i long, sums array<double>")
    matrix = np.zeros((d, d))
    for row in parts.groupBy("i").applyInArrow(add, "i long, sums array<double>").collect():
        matrix[row["i"]] = row["sums"]
    return matrix


def _matrix(lists, d):
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class _Centred:
    """Values less the mean, for whole numbers of any size."""

    def __init__(self, sums, n):
        self.input = self.dimension = len(sums)
        self.mean = np.array([s / n for s in sums], float)

    def __call__(self, x):
        return x - self.mean


class _Whitened(_Centred):
    """Values less the mean, projected and scaled; 0 for values without variance."""

    def __init__(self, sums, n, values, vectors, usable):
        super().__init__(sums, n)
        self.dimension = len(usable)
        self.weights = vectors[usable].T / np.sqrt(values[usable])

    def __call__(self, x):
        return (x - self.mean) @ self.weights


def whole_numbers(vector):
    """``floor(256 * c)`` of each entry as a long (at the ends of its range beyond
    it); null where the vector is null or has null or non-finite entries."""
    entries = vector.cast("array<double>")
    good = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(good & (F.size(entries) > 0), F.transform(entries, lambda c: F.floor(c * SCALE)))


def _sums(fit, d):
    """Count and exact sums of each dimension, over whole numbers of 64 bits."""
    halves = F.struct(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.col("x")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(d)])
    row = fit.agg(halves.alias("all")).first()["all"]
    return row["n"], [int(row[f"s{i}"] or 0) for i in range(d)]


def _deviations(x, n, sums):
    """Sum over dimensions of (n * x - S) squared, exact; None beyond a long."""
    largest = n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, sums), default=0)
    if largest < 1 << 62 and largest ** 2 * len(sums) < 1 << 63:
        off = n * x - np.array(sums, np.int64)
        return (off * off).sum(axis=1).tolist()
    off = n * x.astype(object) - np.array(sums, object)
    return [v if v < 1 << 63 else None for v in (off * off).sum(axis=1).tolist()]


def whiten(vectors, column="embedding", components=4):
    """Add ``n`` (vectors fitted), ``deviation``, ``whitened`` and ``explained`` (one
    entry per component) and ``identity_error`` to the rows with a usable vector.

    Rows whose vector is null, empty, or holds null or non-finite entries go. All
    others must have one dimension, else a ValueError tells their lengths. Fitted is
    each distinct vector of whole numbers once, so repeated rows count once and get
    equal results. Fewer dimensions than components give fewer entries; a component
    without variance has a null ``whitened`` and no part in ``identity_error``, which
    is null without any; ``explained`` is null if nothing varies. A deviation
    beyond a long is null. An empty table gives no rows. Columns of the added names
    are replaced, others stay.
    """
    added = [T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
             T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("explained", T.ArrayType(T.DoubleType())),
             T.StructField("identity_error", T.DoubleType())]
    names = [c for c in vectors.columns if c not in {f.name for f in added}]
    rows = vectors.select(F.struct(*names).alias("row"), whole_numbers(F.col(column)).alias("x")).where("x IS NOT NULL")
    schema = T.StructType([rows.schema["row"], *added])
    fit = stored(rows.select("x").distinct(), "fit-list")
    least, most = fit.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if least != most:
        raise ValueError(f"vectors have {least} to {most} entries")
    if least is None:
        return vectors.sparkSession.createDataFrame([], schema).select("row.*", *[f.name for f in added])
    n, sums = _sums(fit, least)
    covariance = _moments(fit, "x", _Centred(sums, n)) / n
    values, basis = leading_components(covariance, min(components, least))
    trace = float(np.trace(covariance))
    usable = np.flatnonzero(values > trace * least * _EPS)
    project = _Whitened(sums, n, values, basis, usable)
    error = None
    if len(usable):
        inner = _moments(fit, "x", project) / n
        error = float(np.abs(inner - np.eye(len(usable))).max())
    explained = [float(e) / trace if trace > 0 else None for e in values]
    k = len(values)

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"), least)
            out = np.full((len(x), k), np.nan)
            out[:, usable] = project(x)
            flat = pa.array(out.reshape(-1), mask=np.isnan(out).reshape(-1))
            lists = pa.array(np.arange(0, k * len(x) + 1, k, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.full(len(x), n)), pa.array(_deviations(x, n, sums), pa.int64()),
                 pa.ListArray.from_arrays(lists, flat), pa.array([explained] * len(x), pa.list_(pa.float64())),
                 pa.array([error] * len(x), pa.float64())], names=schema.names)

    return map_partitions(rows, run, schema).select("row.*", *[f.name for f in added])

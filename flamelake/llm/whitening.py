"""Whitening of embeddings by their leading components, found by FEAST contour integration.

The covariance comes from two Arrow passes: whole-number sums give the mean, then
products of entries centred on it are summed, so no large numbers cancel.  Only
sums of the size of the dimension leave a task.  The leading eigenvalues are enclosed by inertia
counts of shifted covariances; each interval is then solved on its own.  A circle
through its ends carries quadrature nodes, at each node a task solves the shifted
covariance for a block of vectors, and the summed solutions span the wanted
subspace (``project``).  Rayleigh-Ritz takes the components out of it, until their
residuals are at rounding level.  Every interval must yield as many eigenvalues as
its inertia counts say.

Cases: null vectors, vectors with null or non-finite entries, empty vectors and
entries beyond 2**50, whose whole numbers no long holds, are dropped.  Vectors have the length most of them have
(ties: the longer one); others are dropped.  Repeated rows and ids, and null ids, are
rows like any other.  Equal eigenvalues give some orthonormal basis of their space.
Components without variance (at most 1e-13 of the trace) cannot be whitened and are left
out, so equal vectors, a single one, or an empty table give no rows.  ``deviation`` is
null where a long cannot hold it.  Other columns never enter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flamelake.llm.common import stage

SCALE, SHIFT = 1024, 100_000
#: Entries from here on have no exact whole number.
TOO_LARGE = 2.0**50
#: Quadrature nodes on the upper half circle, eigenvalues an interval may hold before it is halved, passes of the solver.
NODES, INTERVAL, PASSES = 8, 4, 40
RESIDUAL, NO_VARIANCE = 2e-14, 1e-13


_LONGS, _DOUBLES = pa.list_(pa.int64()), pa.list_(pa.float64())
_SUMS = "dim int, n bigint, high array<bigint>, low array<bigint>"
_ARROW_SUMS = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("high", _LONGS), ("low", _LONGS)])
_PRODUCTS = "row int, products array<double>"
_ARROW_PRODUCTS = pa.schema([("row", pa.int32()), ("products", _DOUBLES)])
_PARTS = "block int, node int, part binary"
_ARROW_PARTS = pa.schema([("block", pa.int32()), ("node", pa.int32()), ("part", pa.binary())])
_WHITE = "vec_id bigint, deviation bigint, whitened array<double>"
_ARROW_WHITE = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("whitened", _DOUBLES)])


@dataclass(frozen=True)
class Model:
    """``mean`` = ``centre + rest / n`` exactly; ``components`` are columns by falling ``values``."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float


# --- passes over the vectors


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Usable rows of a batch as (row numbers, whole numbers), one pair for each length of vector."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    # Nulls inside have become NaN; null vectors have no entries here.
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == size)
        values = flat[starts[rows][:, None] + np.arange(size)]
        good = (np.abs(values) < TOO_LARGE).all(axis=1)
        if good.any():
            yield rows[good], np.floor(SCALE * values[good]).astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a task and length: count and sums, high and low halves apart so that no sum overflows."""
    totals: dict[int, list] = {}
    for batch in batches:
        for _, x in _vectors(batch.column(0)):
            own = totals.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], np.int64)])
            own[0] += len(x)
            own[1] += (x >> 32).sum(axis=0)
            own[2] += (x & 0xFFFFFFFF).sum(axis=0)
    rows = [{"dim": d, "n": n, "high": h.tolist(), "low": w.tolist()} for d, (n, h, w) in totals.items()]
    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_SUMS)


def _products(centre: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(centre)
        total = np.zeros((size, size))
        for batch in batches:
            for _, x in _vectors(batch.column(0)):
                if x.shape[1] == size:
                    y = (x - centre).astype(np.float64)
                    # Whole numbers: sums below 2**53 are exact in any order.
                    total += y.T @ y
        yield pa.RecordBatch.from_pylist(
            [{"row": n, "products": total[n].tolist()} for n in range(size)], schema=_ARROW_PRODUCTS
        )

    return run


def covariance(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray, np.ndarray] | None:
    """``n``, whole part and remainder of the mean, and the covariance; None without any usable vector."""
    sums = vectors.mapInArrow(_sums, _SUMS)
    by_place = sums.select("dim", "n", F.posexplode(F.arrays_zip("high", "low")).alias("place", "s"))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("decimal(38,0)")
    rows = by_place.groupBy("dim", "place").agg(F.sum("n").alias("n"), wide("s.high").alias("high"), wide("s.low").alias("low")).collect()
    if not rows:
        return None
    counts = {r["dim"]: r["n"] for r in rows}
    dim = max(counts, key=lambda d: (counts[d], d))
    n = counts[dim]
    totals = [0] * dim
    for r in rows:
        if r["dim"] == dim:
            totals[r["place"]] = (int(r["high"]) << 32) + int(r["low"])
    centre, rest = zip(*[divmod(t, n) for t in totals])
    centre, rest = np.array(centre, np.int64), np.array(rest, np.int64)
    parts = vectors.mapInArrow(_products(centre), _PRODUCTS)
    summed = parts.select("row", F.posexplode("products").alias("place", "p")).groupBy("row", "place").agg(F.sum("p").alias("p"))
    matrix = np.zeros((dim, dim))
    # dim * dim numbers: the size of the covariance.
    for row in summed.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "p"))).alias("r")).toLocalIterator():
        matrix[row["row"]] = [x["p"] for x in row["r"]]
    part = rest / n
    cov = matrix / n - np.outer(part, part)
    return n, centre, rest, (cov + cov.T) / 2


# --- eigenvalues of a symmetric matrix


def negatives(matrix: np.ndarray) -> int:
    """Negative eigenvalues, by Sylvester's law, from a symmetric elimination.

    Pivots are the largest diagonal entry or, where an off-diagonal one exceeds it
    clearly, a block of two rows, whose determinant is then negative: one
    eigenvalue of each sign.
    """
    a, count = np.array(matrix, float), 0
    limit = (1 + np.sqrt(17)) / 8
    while len(a):
        diagonal = np.abs(np.diag(a))
        p = int(diagonal.argmax())
        off = np.abs(a - np.diag(np.diag(a)))
        q, r = divmod(int(off.argmax()), len(a))
        if diagonal[p] == 0 and off[q, r] == 0:
            return count
        block = [p] if diagonal[p] >= limit * off[q, r] else [q, r]
        rest = np.delete(np.arange(len(a)), block)
        pivot = a[np.ix_(block, block)]
        count += int(a[p, p] < 0) if len(block) == 1 else 1
        left = a[np.ix_(rest, block)]
        a = a[np.ix_(rest, rest)] - left @ np.linalg.solve(pivot, left.T)
        a = (a + a.T) / 2
    return count


def _above(matrix: np.ndarray, value: float) -> int:
    """Eigenvalues greater than ``value``."""
    return negatives(value * np.eye(len(matrix)) - matrix)


def _clear(matrix: np.ndarray, value: float, width: float) -> int | None:
    """Eigenvalues above ``value``, or None where one is so near that its side is in doubt."""
    count = _above(matrix, value)
    return count if _above(matrix, value - width) == count == _above(matrix, value + width) else None


def intervals(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, eigenvalues inside) of disjoint intervals with the ``wanted`` largest eigenvalues, or more.

    Ends lie where no eigenvalue is within 1e-6 of the spread, so that each belongs
    to one interval; a cluster that cannot be cut stays in one.
    """
    radius = np.abs(matrix).sum(axis=1)
    top, bottom = float(radius.max()), float(min((2 * np.diag(matrix) - radius).min(), 0.0))
    top, bottom = top + 1e-3 * (top - bottom), bottom - 1e-3 * (top - bottom)
    width = 1e-7 * (top - bottom)
    low, count, bar = bottom, len(matrix), top
    # Raise the lower end while enough eigenvalues stay above it.
    for _ in range(80):
        if count == wanted or bar - low < 10 * width:
            break
        for share in (0.5, 0.45, 0.55, 0.4, 0.6, 0.3, 0.7):
            middle = low + share * (bar - low)
            above = _clear(matrix, middle, width)
            if above is not None:
                break
        else:
            break
        if above >= wanted:
            low, count = middle, above
        else:
            bar = middle
    open_parts, done = [(low, top, count)], []
    while open_parts:
        low, high, count = open_parts.pop()
        # What stands above ``high`` is the same for both halves.
        over = _above(matrix, high)
        cut = None
        if count > INTERVAL and high - low > 10 * width:
            for share in (0.5, 0.45, 0.55, 0.4, 0.6, 0.3, 0.7):
                above = _clear(matrix, low + share * (high - low), width)
                if above is not None:
                    cut = low + share * (high - low), above - over
                    break
        if cut is None:
            done += [(low, high, count)] if count else []
        else:
            open_parts += [(low, cut[0], count - cut[1]), (cut[0], high, cut[1])]
    return sorted(done)


def project(spark: SparkSession, matrix: np.ndarray, blocks: list[tuple[float, float, np.ndarray]]) -> list[np.ndarray]:
    """The spectral projector of each (low, high) applied to its block of columns.

    Row (block, node) is a task of its own: one complex shifted solve.  By symmetry the lower half
    of the circle gives the conjugates, so real parts of the upper half are enough.
    """
    shared = spark.sparkContext.broadcast((matrix, blocks))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cov, given = shared.value
        for batch in batches:
            for block, node in zip(*[c.to_pylist() for c in batch.columns]):
                low, high, columns = given[block]
                turn = (high - low) / 2 * np.exp(1j * np.pi * (node + 0.5) / NODES)
                part = turn * np.linalg.solve(((low + high) / 2 + turn) * np.eye(len(cov)) - cov, columns)
                yield pa.RecordBatch.from_pylist(
                    [{"block": block, "node": node, "part": (part.real / NODES).tobytes()}], schema=_ARROW_PARTS
                )

    pairs = spark.createDataFrame([(b, k) for b in range(len(blocks)) for k in range(NODES)], "block int, node int")
    work = pairs.repartition(min(len(blocks) * NODES, max(2, spark.sparkContext.defaultParallelism)))
    out = [np.zeros_like(columns) for _, _, columns in blocks]
    # In a fixed order: a repeated run gives the same sums.
    for row in sorted(work.mapInArrow(solve, _PARTS).collect(), key=lambda r: (r["block"], r["node"])):
        out[row["block"]] += np.frombuffer(row["part"]).reshape(out[row["block"]].shape)
    shared.unpersist()
    return out


def leading(spark: SparkSession, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    size = len(matrix)
    norm = float(np.abs(matrix).sum(axis=1).max())
    if not norm:
        return np.zeros(0), np.zeros((size, 0))
    parts = intervals(matrix / norm, min(wanted, size))
    random = np.random.default_rng(20240229)
    blocks = {n: random.standard_normal((size, min(size, 2 * count + 4))) for n, (_, _, count) in enumerate(parts)}
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    scaled = matrix / norm
    for _ in range(PASSES):
        left = sorted(blocks)
        made = project(spark, scaled, [(parts[n][0], parts[n][1], blocks[n]) for n in left])
        for n, subspace in zip(left, made):
            low, high, count = parts[n]
            basis, _ = np.linalg.qr(subspace)
            values, turns = np.linalg.eigh(basis.T @ scaled @ basis)
            vectors = basis @ turns
            inside = (values > low) & (values <= high)
            off = np.linalg.norm(scaled @ vectors[:, inside] - vectors[:, inside] * values[inside], axis=0)
            if inside.sum() == count and off.max(initial=0) <= RESIDUAL * np.sqrt(size):
                found[n] = values[inside], vectors[:, inside]
                del blocks[n]
            else:
                blocks[n] = vectors
        if not blocks:
            break
    if blocks:
        raise ArithmeticError("the contour integrals did not converge to the counted eigenvalues")
    values = np.concatenate([found[n][0] for n in sorted(found)])
    vectors = np.concatenate([found[n][1] for n in sorted(found)], axis=1)
    order = np.argsort(-values, kind="stable")[:wanted]
    values, vectors = values[order] * norm, vectors[:, order]
    peaks = vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))]
    return values, vectors * np.where(peaks < 0, -1.0, 1.0)


# --- fitting and applying


def fit(vectors: DataFrame, wanted: int = 8) -> Model | None:
    """Model of a table with one column of vectors; None without any usable vector."""
    given = covariance(vectors)
    if given is None:
        return None
    n, centre, rest, matrix = given
    values, components = leading(vectors.sparkSession, matrix, wanted)
    trace = float(np.trace(matrix))
    used = values > NO_VARIANCE * trace
    return Model(n, centre, rest, values[used], components[:, used], trace)


def _apply(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(model.centre)
        scale = model.components / np.sqrt(model.values)
        part = model.rest / model.n
        squares = sum(r * r for r in model.rest.tolist())
        for batch in batches:
            ids = batch.column(0)
            for rows, x in _vectors(batch.column(1)):
                if x.shape[1] != size:
                    continue
                y = x - model.centre
                white = (y - part) @ scale
                # sum((n*x - S)**2) = n*n*sum(y*y) - 2*n*sum(y*r) + sum(r*r), in whole numbers of any size.
                small = float(np.abs(y).max()) ** 2 * size < 2**62 and float(np.abs(y).max()) * model.n * size < 2**62
                kind = np.int64 if small else object
                own = (y.astype(kind) ** 2).sum(axis=1).tolist()
                cross = (y.astype(kind) * model.rest.astype(kind)).sum(axis=1).tolist()
                deviation = [model.n * model.n * a - 2 * model.n * b + squares for a, b in zip(own, cross)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(rows)),
                        pa.array([d if d < 1 << 63 else None for d in deviation], pa.int64()),
                        pa.array(white.tolist(), pa.list_(pa.float64())),
                    ],
                    schema=_ARROW_WHITE,
                )

    return run


def whiten(embeddings: DataFrame, model: Model) -> DataFrame:
    """``vec_id, deviation, whitened`` of each usable row; ``whitened`` has an entry a component."""
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(_apply(model), _WHITE)


def identity_error(white: DataFrame, size: int) -> float:
    """Largest entry of the covariance of the whitened rows minus the identity, from two aggregates of them."""
    entry = lambda i: F.get(F.col("whitened"), F.lit(i))
    means = white.agg(*[F.avg(entry(i)).alias(f"m{i}") for i in range(size)]).first()
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    shown = white.agg(*[F.avg((entry(i) - means[i]) * (entry(j) - means[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(value - (i == j)) for (i, j), value in zip(pairs, shown))


def components(embeddings: DataFrame, wanted: int = 8) -> DataFrame:
    """One row for each usable vector and component, with the figures of the fit."""
    vectors = embeddings.select(F.col("embedding").cast("array<double>").alias("embedding"))
    model = fit(vectors, wanted)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return embeddings.sparkSession.createDataFrame([], schema)
    white = stage(whiten(embeddings, model), "whitened")
    error = identity_error(white, len(model.values))
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    return white.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")).select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )

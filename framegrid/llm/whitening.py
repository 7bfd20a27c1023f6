"""Embedding whitening from an exact integer scatter.

Components are scaled to integers, and each different vector counts once.  Tasks subtract a
common integer shift and add up sums and cross-products without any rounding: numbers are cut
into limbs so short that products of doubles and their sums stay whole, and the totals are joined
as integers of any length.  Only the finished n XtX - S St becomes floating point, once per
entry, and its eigenvectors give the projection.  The driver holds dimension x dimension numbers,
however many vectors there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrid.llm.common import materialise

#: Bits of a limb, and rows multiplied at a time: 2 * LIMB + log2(ROWS) must not exceed the 53 bits of a double.
LIMB, ROWS = 20, 8192
#: Totals are summed by Spark in pieces of so many bits.
PIECE = 40

_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def to_integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as longs; what a long can't hold becomes the nearest long."""
    y = np.floor(x * float(scale))
    low, high = y < -(2.0**63), y >= 2.0**63
    out = np.where(low | high, 0.0, y).astype(np.int64)
    out[low], out[high] = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    return out


def pack(row: np.ndarray) -> bytes:
    """A vector in the narrowest integers that hold it, their width first: equal vectors have equal bytes."""
    lo, hi = int(row.min()), int(row.max())
    k = next(k for k, w in enumerate(_WIDTHS) if np.iinfo(w).min <= lo and hi <= np.iinfo(w).max)
    return bytes([k]) + row.astype(_WIDTHS[k]).astype(np.dtype(_WIDTHS[k]).newbyteorder("<")).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.dtype(_WIDTHS[data[0]]).newbyteorder("<"), offset=1).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def vectors_by_length(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: places of the vectors without null or non-finite entries, and the vectors as doubles.  Empty vectors have no components."""
    good = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.asarray(column.value_lengths().fill_null(0))
    out = {}
    for dim in np.unique(lengths[good & (lengths > 0)]):
        at = np.flatnonzero(good & (lengths == dim))
        flat = column.take(pa.array(at)).flatten().cast(pa.float64())
        x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(len(at), dim)
        fine = np.isfinite(x).all(axis=1)
        if fine.any():
            out[int(dim)] = (at[fine], x[fine])
    return out


def limbs(x: np.ndarray, shift: list[int]) -> list[np.ndarray]:
    """x - shift as doubles in signed limbs, the lowest first; differences may exceed a long."""
    most = max(max(abs(int(x.max())), abs(int(x.min()))), max(map(abs, shift))) if x.size else 0
    if most < 2**62:
        rest = x - np.array(shift, np.int64)[None, :]
    else:
        rest = x.astype(object) - np.array(shift, object)[None, :]
    out = []
    while rest.size and max(abs(int(rest.max())), abs(int(rest.min()))) >= 1 << LIMB:
        out.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = rest >> LIMB
    return [*out, rest.astype(np.float64)]


def scatter(x: np.ndarray, shift: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products of the shifted rows, as arrays of Python integers."""
    dim = x.shape[1]
    sums, cross = np.zeros(dim, object), np.zeros((dim, dim), object)
    for at in range(0, len(x), ROWS):
        parts = limbs(x[at : at + ROWS], shift)
        for a, left in enumerate(parts):
            sums = sums + left.sum(axis=0).astype(np.int64).astype(object) * (1 << (LIMB * a))
            for b, right in enumerate(parts):
                cross = cross + (left.T @ right).astype(np.int64).astype(object) * (1 << (LIMB * (a + b)))
    return sums, cross


def pieces(dim: int, name: str, row: int, values: list[int]) -> Iterator[tuple]:
    """(dim, name, row, place, piece, value): integers cut into pieces whose sums Spark can hold; a sign goes to every piece."""
    for place, v in enumerate(values):
        sign, v, k = (-1 if v < 0 else 1), abs(v), 0
        while v:
            yield dim, name, row, place, k, sign * (v & ((1 << PIECE) - 1))
            v >>= PIECE
            k += 1


_PIECES = "dim int, name string, row int, place int, piece int, value long"


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
    columns = zip(*rows) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in _PIECES.split(", ")])


def totals(found: DataFrame) -> dict[tuple[int, str], dict[tuple[int, int], int]]:
    """Sums of the pieces by (dim, name) and (row, place): dimension x dimension entries a length, on the driver."""
    out: dict = {}
    for r in found.groupBy("dim", "name", "row", "place", "piece").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).toLocalIterator():
        own = out.setdefault((r["dim"], r["name"]), {})
        own[r["row"], r["place"]] = own.get((r["row"], r["place"]), 0) + (int(r["value"]) << (PIECE * r["piece"]))
    return out


def _by_length(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for batch in slices(batches, ROWS):
        held: dict[int, list[np.ndarray]] = {}
        for data in batch.column("x").to_pylist():
            x = unpack(data)
            held.setdefault(len(x), []).append(x)
        for dim, rows in held.items():
            yield dim, np.array(rows)


class Fit:
    """What the fit list gives for one length: n, exact sums and scatter, components and eigenvalues."""

    def __init__(self, dim: int, n: int, sums: list[int], scatter_n: list[list[int]], most: int):
        self.dim, self.n, self.sums = dim, n, sums
        cov = np.array([[v / (n * n) for v in row] for row in scatter_n])  # Python divides integers with one rounding
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(values, kind="stable")[::-1][: min(most, dim)]
        self.values, self.components = values[order], vectors[:, order]
        trace = sum(scatter_n[k][k] for k in range(dim)) / (n * n)
        self.explained = [v / trace if trace > 0 else None for v in np.maximum(self.values, 0.0).tolist()]
        # an eigenvalue within rounding of zero has no direction of its own
        self.used = self.values > max(float(values.max()), 0.0) * dim * np.finfo(float).eps
        self.error: float | None = None

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """(x - S/n as doubles, exact sum of squares of n x - S by row)."""
        most = self.n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, self.sums))
        if most * most * self.dim < 2**63:
            d = self.n * x - np.array(self.sums, np.int64)[None, :]
            return d / self.n, (d * d).sum(axis=1).tolist()
        d = self.n * x.astype(object) - np.array(self.sums, object)[None, :]
        return (d / self.n).astype(np.float64), (d * d).sum(axis=1).tolist()

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        """Rows projected on the components, over the root of the eigenvalues; not a number where an eigenvalue is zero."""
        scale = np.where(self.used, 1 / np.sqrt(np.where(self.used, self.values, 1.0)), np.nan)
        return (centred @ self.components) * scale[None, :]


def fit_list(vectors: DataFrame, vector: str, scale: int) -> DataFrame:
    """(x): every different integer vector once, packed, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for _, x in vectors_by_length(batch.column(vector)).values():
                yield pa.RecordBatch.from_arrays([pa.array([pack(r) for r in to_integers(x, scale)], pa.binary())], names=["x"])

    return materialise(vectors.select(vector).mapInArrow(run, "x binary").distinct(), "fit-list")


def fit(fits: DataFrame, components: int) -> dict[int, Fit]:
    """A ``Fit`` for every length among the packed vectors (x)."""

    def rough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, x in _by_length(batches):
            yield _piece_batch([*pieces(dim, "n", 0, [len(x)]), *pieces(dim, "rough", 0, [int(v) for v in x.astype(np.float64).sum(axis=0)])])

    first = totals(fits.mapInArrow(rough, _PIECES))
    dims = sorted({dim for dim, _ in first})
    n = {dim: first[dim, "n"][0, 0] for dim in dims}
    shift = {dim: [first.get((dim, "rough"), {}).get((0, k), 0) // n[dim] for k in range(dim)] for dim in dims}  # any shift is right; one near the mean keeps numbers short

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for dim, x in _by_length(batches):
            sums, cross = scatter(x, shift[dim])
            old = held.get(dim, (0, 0))
            held[dim] = (old[0] + sums, old[1] + cross)
        for dim, (sums, cross) in held.items():
            rows = list(pieces(dim, "sum", 0, sums.tolist()))
            for k in range(dim):
                rows += pieces(dim, "cross", k, cross[k].tolist())
            yield _piece_batch(rows)

    got = totals(fits.mapInArrow(exact, _PIECES))
    out = {}
    for dim in dims:
        s = [got.get((dim, "sum"), {}).get((0, k), 0) for k in range(dim)]
        c = got.get((dim, "cross"), {})
        scatter_n = [[n[dim] * c.get((i, j), 0) - s[i] * s[j] for j in range(dim)] for i in range(dim)]  # the shift cancels
        out[dim] = Fit(dim, n[dim], [v + n[dim] * m for v, m in zip(s, shift[dim])], scatter_n, components)
    return out


def measure(fits: DataFrame, models: dict[int, Fit]) -> None:
    """Set every model's identity error: the largest entry of the whitened fit list's covariance minus the identity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for dim, x in _by_length(batches):
            model = models[dim]
            w = model.whitened(model.deviations(x)[0])[:, model.used]
            mean = w.mean(axis=0)
            n, m, c = len(w), mean, (w - mean).T @ (w - mean)
            if dim in held:  # joined as of two samples
                n0, m0, c0 = held[dim]
                d = m - m0
                n, m, c = n + n0, m0 + d * (n / (n + n0)), c0 + c + np.outer(d, d) * (n * n0 / (n + n0))
            held[dim] = [n, m, c]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([h[0] for h in held.values()], pa.int64()), pa.array([h[1].tolist() for h in held.values()], pa.list_(pa.float64())), pa.array([h[2].ravel().tolist() for h in held.values()], pa.list_(pa.float64()))], names=["dim", "n", "mean", "scatter"])

    parts = fits.mapInArrow(run, "dim int, n long, mean array<double>, scatter array<double>")
    # A few numbers a task: means first, then scatters around the common mean.
    most = max((int(m.used.sum()) for m in models.values()), default=0)
    mean = [F.sum(F.col("n") * F.get("mean", F.lit(k))).alias(f"m{k}") for k in range(most)]
    parts = materialise(parts, "whitened-moments")
    for r in parts.groupBy("dim").agg(F.sum("n").alias("n"), *mean).collect() if most else []:
        size = int(models[r["dim"]].used.sum())
        if not size:
            continue
        m = [r[f"m{k}"] / r["n"] for k in range(size)]
        own = parts.where(F.col("dim") == r["dim"])
        entry = lambda i, j: F.sum(F.get("scatter", F.lit(i * size + j)) + F.col("n") * (F.get("mean", F.lit(i)) - m[i]) * (F.get("mean", F.lit(j)) - m[j]))  # noqa: B023, E731
        cov = own.agg(*(entry(i, j).alias(f"c{i}_{j}") for i in range(size) for j in range(size))).first()
        models[r["dim"]].error = float(np.abs(np.array(cov, float).reshape(size, size) / r["n"] - np.eye(size)).max())


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """(id column, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    Entries c become floor(scale * c).  Vectors that are null, empty or hold null or non-finite
    entries are dropped; the model is fitted on the different integer vectors, each once, for
    every length of vectors by itself.  Repeated rows and null ids give rows as often as they
    come; other columns are ignored; an empty table gives an empty one.  ``deviation`` is a
    decimal, null beyond 38 digits; integers beyond a long become the nearest long.  A component
    whose eigenvalue is zero to double precision has a null in ``whitened``; ``explained`` is null
    where all vectors are one; of equal eigenvalues any order, the same for all rows.
    """
    fits = fit_list(vectors, vector, scale)
    models = fit(fits, components)
    measure(fits, models)
    kind = vectors.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for dim, (at, c) in vectors_by_length(batch.column(1)).items():
                model = models[dim]
                centred, deviation = model.deviations(to_integers(c, scale))
                w = model.whitened(centred)
                k = w.shape[1]
                value = w.ravel()
                deviation = [v if v < 10**38 else None for v in deviation]
                columns = [
                    batch.column(0).take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array([model.n] * value.size, pa.int64()),
                    pa.array([str(v) if v is not None else None for v in deviation for _ in range(k)], pa.string()),
                    pa.array(value, pa.float64(), mask=np.isnan(value)),
                    pa.array(model.explained * len(at), pa.float64()),
                    pa.array([model.error] * value.size, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    rows = vectors.select(F.col(id), F.col(vector)).mapInArrow(run, f"id {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double")
    return rows.withColumnRenamed("id", id).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))

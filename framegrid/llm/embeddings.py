"""Embedding near-duplicates by a subspace pigeonhole join.

For unit vectors, cosine >= c means squared distance <= 2 - 2c.  The vectors are rotated at
random and split into blocks of dimensions; if two vectors are that close, then in at least one
block their squared distance is within the block's proportional share of the budget.  The range
join runs on cells, each around a pivot: a vector reaches a cell only if, in some block, it is
within the block's share of the ball that the cell's vectors fill there, and within the whole
budget of the whole ball.  Of the cells that are reached, the blocks' range tests give the union
of candidates, and candidates are verified by the cosine in double precision.

A task gets two bounded chunks of cells and returns, for each vector, how many links it found,
and a spanning forest of them, so a large group of near copies never becomes a list of pairs.
The driver holds one row per cell; which chunks a vector goes to is worked out where it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrid.llm.common import materialise
from framegrid.llm.components import connected_components

#: Dimensions of a block.
BLOCK = 16
#: Vectors in a chunk, at which two chunks are compared in one task.
CHUNK = 8192
#: Pivots of the cells are chosen among at most so many vectors; the choice only shapes the cells.
SAMPLE, CELLS = 8192, 256
#: Those vectors hold at most so many numbers.
SAMPLE_NUMBERS = 1 << 22
#: From this share of the pairs on, two chunks are compared whole, which is faster than cell by cell.
DENSE = 0.4


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int, block: int = BLOCK) -> list[slice]:
    n = max(1, dim // block)
    edges = np.linspace(0, dim, n + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def choose_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` different vectors of the sample, each the farthest from those before it."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen, near = [0], sample @ sample[0]
    while len(chosen) < most and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


def block_radii(x: np.ndarray, cell: np.ndarray, pivots: np.ndarray, parts: list[slice]) -> np.ndarray:
    """By cell and block, the whole vector last: the greatest distance of the cell's rotated vectors from its pivot; -1 for empty cells."""
    far = np.full((len(pivots), len(parts) + 1), -1.0)
    for k, p in enumerate([*parts, slice(None)]):
        np.maximum.at(far[:, k], cell, np.sqrt(((x[:, p] - pivots[cell][:, p]) ** 2).sum(axis=1)))
    return far


def reached(x: np.ndarray, pivots: np.ndarray, radii: np.ndarray, parts: list[slice], budgets: list[float]) -> np.ndarray:
    """Which cells (columns) the rotated vectors (rows) reach: no vector of any other cell can be linked with them."""

    def near(p: slice, k: int, budget: float) -> np.ndarray:
        apart = (x[:, p] ** 2).sum(axis=1)[:, None] + (pivots[:, p] ** 2).sum(axis=1)[None, :] - 2 * x[:, p] @ pivots[:, p].T
        return np.sqrt(np.maximum(apart, 0)) <= radii[:, k] + np.sqrt(budget) + 1e-6

    some = np.zeros((len(x), len(pivots)), bool)
    for k, (p, budget) in enumerate(zip(parts, budgets)):
        some |= near(p, k, budget)
    return some & near(slice(None), len(parts), sum(budgets)) & (radii[:, -1] >= 0)


def candidates(a: np.ndarray, b: np.ndarray, parts: list[slice], budgets: list[float]) -> np.ndarray:
    """Pairs within the budget of at least one block: the union of the blocks' range joins, as a mask.

    Distances are in single precision with a margin above its error, so no true pair is lost.
    """
    mask = None
    for p, budget in zip(parts, budgets):
        x, y = a[:, p], b[:, p]
        one = np.ones((len(x), 1), np.float32)
        left = np.hstack((x, (x * x).sum(axis=1, keepdims=True), one))
        right = np.hstack((-2 * y, np.ones((len(y), 1), np.float32), (y * y).sum(axis=1, keepdims=True)))
        near = left @ right.T <= np.float32(budget + 1e-4)
        mask = near if mask is None else np.logical_or(mask, near, out=mask)
    return mask


def join_chunks(ids_a, a, ids_b, b, same: bool, parts, budgets, turn, least: float, cells=None) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], int]:
    """Links between two chunks of unit vectors: counts by row of a and of b, a spanning forest of them, and the pairs compared.

    ``cells`` is (cell of each row of b, pivots, radii); rows of b are compared with the rows of a
    that reach their cell.
    """
    n_a, n_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    label = np.arange(len(a) + len(b))
    at_b = np.arange(len(b)) if same else len(a) + np.arange(len(b))
    forest: list[tuple[int, int]] = []
    compared = 0
    ra, rb = a @ turn, (b @ turn).astype(np.float32)
    cell_b, reach = np.zeros(len(b), np.int64), np.ones((len(a), 1), bool)
    if cells:
        cell_b, reach = cells[0], reached(ra, cells[1], cells[2], parts, budgets)
    ra = ra.astype(np.float32)
    present = np.unique(cell_b)
    groups = [(np.flatnonzero(reach[:, cell]), np.flatnonzero(cell_b == cell)) for cell in present]  # rows of a that reach these rows of b
    if sum(len(left) * len(right) for left, right in groups) > DENSE * len(a) * len(b):
        groups = [(np.arange(len(a)), np.arange(len(b)))]
    for left, right in groups:
        near = rb if len(right) == len(b) else rb[right]
        for start in range(0, len(left), 512):
            rows = left[start : start + 512]
            mask = candidates(ra[rows], near, parts, budgets)
            compared += mask.size
            if same:
                mask &= right[None, :] > rows[:, None]
            some = np.flatnonzero(mask.any(axis=1))
            for at in range(0, len(some), 64):
                own = some[at : at + 64]
                cols = np.flatnonzero(mask[own].any(axis=0))
                hit = mask[np.ix_(own, cols)] & (np.einsum("ik,jk->ij", a[rows[own]], b[right[cols]], optimize=True) >= least)
                n_a[rows[own]] += hit.sum(axis=1)
                n_b[right[cols]] += hit.sum(axis=0)
                for k in np.flatnonzero(hit.any(axis=1)):
                    i, js = rows[own[k]], right[cols[hit[k]]]
                    for old in np.unique(label[at_b[js]]):
                        if old != label[i]:
                            j = js[np.flatnonzero(label[at_b[js]] == old)[0]]
                            forest.append((int(ids_a[i]), int(ids_b[j])))
                            label[label == old] = label[i]
    return n_a, n_b, forest, compared


def unit_vectors(column: list | np.ndarray) -> np.ndarray:
    x = np.array(column, dtype=np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def read_vectors(column, kind: type, dim: int) -> np.ndarray:
    return unit_vectors(np.frombuffer(b"".join(column), kind).reshape(-1, dim))


def block_budgets(parts: list[slice], dim: int, least: float) -> list[float]:
    return [(2 - 2 * least) * (p.stop - p.start) / dim for p in parts]


def link_rows(ids: np.ndarray, n: np.ndarray, forest: list[tuple[int, int]]) -> pd.DataFrame:
    u, w = zip(*forest) if forest else ((), ())
    counted = pd.DataFrame({"u": ids[n > 0], "v": ids[n > 0], "n": n[n > 0]})
    return pd.concat((counted, pd.DataFrame({"u": u, "v": w, "n": 0}))).astype("int64")


def chunk_table(held: dict[int, int], cells: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """By cell: its first chunk and its number of chunks.  Neighbouring small cells share a chunk, large ones have several."""
    base, parts = np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    number, fill = -1, 0
    for cell in sorted(held):
        if number < 0 or fill + held[cell] > chunk:
            number, fill = number + 1, 0
        base[cell], parts[cell] = number, (held[cell] - 1) // chunk + 1
        number += int(parts[cell]) - 1
        fill = chunk if parts[cell] > 1 else fill + held[cell]
    return base, parts


def chunks_of(reach: np.ndarray, base: np.ndarray, parts: np.ndarray) -> list[list[int]]:
    """For every row of ``reach`` the chunks of the cells that it reaches; cells of one chunk stand side by side."""
    cells = np.flatnonzero(parts)
    first = np.flatnonzero(np.diff(base[cells], prepend=-1))
    ranges = [range(int(base[c]), int(base[c] + parts[c])) for c in cells[first]]
    return [[c for k in np.flatnonzero(row) for c in ranges[k]] for row in np.logical_or.reduceat(reach[:, cells], first, axis=1)]


class Cells:
    """The blocks, pivots, radii and chunks of the vectors of one length."""

    def __init__(self, dim: int, sample: list[bytes], kind: type, least: float, seed: int):
        self.dim, self.kind, self.parts = dim, kind, blocks_of(dim)
        self.turn, self.budgets = rotation(dim, seed), block_budgets(self.parts, dim, least)
        self.pivots = choose_pivots(self.read(sample) if sample else np.zeros((0, dim)), CELLS) @ self.turn
        self.radii = np.full((len(self.pivots), len(self.parts) + 1), -1.0)
        self.base = self.shares = np.zeros(0, np.int64)

    def read(self, column: list[bytes]) -> np.ndarray:
        return read_vectors(column, self.kind, self.dim)

    def settle(self, radii: dict[tuple[int, int], float], counts: dict[int, int]) -> None:
        """Take in what was measured over all vectors: radii by (cell, block) and numbers of vectors by cell."""
        for at, far in radii.items():
            self.radii[at] = far
        self.base, self.shares = chunk_table(counts, len(self.pivots), CHUNK)


def by_length(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(length, rows of that length), at most ``rows`` at a time."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        for k in range(0, len(at), rows):
            yield dim, batch.take(pa.array(at[k : k + rows]))


def cell_links(good: DataFrame, least: float, seed: int) -> DataFrame:
    """(u, v, n) of the vectors (id, v, dim), compared with those of their own length: counts of links where u = v, and a spanning forest of them."""
    kind = np.float32 if good.schema["v"].dataType.elementType.typeName() == "float" else np.float64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("dim"), pa.array([np.array(v, dtype=kind).tobytes() for v in batch.column("v").to_pylist()], pa.binary())], names=["dim", "x"])

    # Lengths differ in at most as many ways as the root of twice the numbers; the sample is bounded in vectors and in numbers.
    dims = sorted(r["dim"] for r in good.select("dim").distinct().collect())
    most = min(SAMPLE, max(1, SAMPLE_NUMBERS // max([1, *dims])))
    sample: dict[int, list[bytes]] = {}
    for r in good.orderBy(F.xxhash64("id")).limit(most).select("dim", "v").mapInArrow(pack, "dim int, x binary").collect():
        sample.setdefault(r["dim"], []).append(r["x"])
    cells = {dim: Cells(dim, sample.get(dim, []), kind, least, seed) for dim in dims}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_length(batch):
                x, own = np.array(part.column("v").to_pylist(), dtype=kind), cells[dim]
                cell = (unit_vectors(x) @ own.turn @ own.pivots.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("dim"), pa.array(cell), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "dim", "cell", "x"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        far: dict[int, np.ndarray] = {}
        n: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in by_length(batch):
                own, cell = cells[dim], part.column("cell").to_numpy()
                got = block_radii(own.read(part.column("x").to_pylist()) @ own.turn, cell, own.pivots, own.parts)
                far[dim] = np.maximum(far[dim], got) if dim in far else got
                n[dim] = n.get(dim, 0) + np.bincount(cell, minlength=len(own.pivots))
        for dim, reach in far.items():
            held = np.flatnonzero(n[dim])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), dim, np.int32)), pa.array(held), pa.array(n[dim][held]), pa.array(reach[held].tolist(), pa.list_(pa.float64()))], names=["dim", "cell", "n", "far"])

    placed = materialise(good.mapInArrow(place, "id long, dim int, cell long, x binary"), "placed")
    measured = materialise(placed.select("dim", "cell", "x").mapInArrow(measure, "dim int, cell long, n long, far array<double>"), "measured")
    radii: dict[int, dict] = {dim: {} for dim in dims}
    counts: dict[int, dict] = {dim: {} for dim in dims}
    blocks = measured.select("dim", "cell", F.posexplode("far").alias("k", "far")).groupBy("dim", "cell", "k").agg(F.max("far").alias("far"))
    for r in blocks.collect():  # a number per length, cell and block
        radii[r["dim"]][r["cell"], r["k"]] = r["far"]
    for r in measured.groupBy("dim", "cell").agg(F.sum("n").alias("n")).collect():
        counts[r["dim"]][r["cell"]] = r["n"]
    for dim in dims:
        cells[dim].settle(radii[dim], counts[dim])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_length(batch):
                own, cell = cells[dim], part.column("cell").to_numpy()
                reach = reached(own.read(part.column("x").to_pylist()) @ own.turn, own.pivots, own.radii, own.parts, own.budgets)
                chunk = own.base[cell] + part.column("salt").to_numpy() % own.shares[cell]
                others = pa.array(chunks_of(reach, own.base, own.shares), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "dim", "cell", "x")), pa.array(chunk), others], names=["id", "dim", "cell", "x", "chunk", "others"])

    salted = placed.withColumn("salt", F.shiftrightunsigned(F.xxhash64("id"), 1))
    tiled = salted.mapInArrow(deal, "id long, dim int, cell long, x binary, chunk long, others array<long>").withColumn("other", F.explode("others"))
    tiled = tiled.select("id", "dim", "x", "cell", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))

    def tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        dim, i, j = key
        own, left, right = cells[dim], rows[rows["chunk"] == i], rows[rows["chunk"] == j]
        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": [], "n": []}, dtype="int64")
        a = own.read(left["x"])
        b = a if i == j else own.read(right["x"])
        ids_a, ids_b = left["id"].to_numpy(), right["id"].to_numpy()
        n_a, n_b, forest, _ = join_chunks(ids_a, a, ids_b, b, i == j, own.parts, own.budgets, own.turn, least, (right["cell"].to_numpy(), own.pivots, own.radii))
        return link_rows(np.concatenate((ids_a, ids_b)), np.concatenate((n_a, n_b)), forest)

    return materialise(tiled.groupBy("dim", "i", "j").applyInPandas(tile, "u long, v long, n long"), "links")


def cosine_links(docs: DataFrame, id: str = "vec_id", vector: str = "embedding", least: float = 0.9, seed: int = 5) -> DataFrame:
    """(id column, n_links, component_id, kept): one row per id.

    Vectors are linked if their cosine, in double precision, is at least ``least``; n_links
    counts the other vectors linked directly, component_id is the smallest id reachable and kept
    marks it.  Vectors that are null, zero, or hold null or non-finite components link with
    nothing, nor do those with a null id; vectors link only with others of their length; rows that
    repeat an id are one vector, the greatest of them; other columns are ignored; an empty table
    gives an empty one.  Only a bounded sample of vectors reaches the driver, to shape the cells.
    """
    single = docs.schema[vector].dataType.simpleString() == "array<float>"
    v = F.col(vector).cast("array<float>" if single else "array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = docs.select(F.col(id).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.max("v").alias("v"))
    rows = materialise(rows.withColumn("ok", F.coalesce(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))), "vectors")
    good = rows.where("ok").select("id", "v", F.size("v").alias("dim"))
    found = cell_links(good, least, seed)
    links = found.where("u = v").groupBy("u").agg(F.sum("n").alias("n_links")).withColumnRenamed("u", "id")
    component = connected_components(found.where("u <> v").select("u", "v"))
    out = rows.select("id").join(links, "id", "left").join(component, "id", "left")
    out = out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id), F.lit(True)))

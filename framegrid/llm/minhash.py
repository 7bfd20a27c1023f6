"""MinHash near-duplicates with sequential Bayesian verification.

Banded signatures give candidates, signatures are compared batch by batch and a pair is dropped
once the posterior probability that its similarity reaches the threshold is below the chosen
miss probability (Satuluri & Parthasarathy, "Bayesian Locality Sensitive Hashing", 2012), and
survivors are confirmed on their full shingle sets.

Texts with equal shingle sets are one class and only its smallest id is compared.  A band bucket
is first compared with one leader, so a group of near copies costs one comparison a member; only
buckets whose members then still belong to different components are compared member by member,
in tiles of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framegrid.llm.common import M1, M2, M3, materialise, mix, only_ids, spread_join
from framegrid.llm.components import connected_components

#: 24 bands of 4: a pair of similarity 0.8 shares no band with probability 3e-6.
BANDS, ROWS = 24, 4
#: Signature entries compared before each pruning decision, and the probability of dropping a true pair.
BATCH, MISS = 16, 1e-6
#: Rows of a bucket on either side of a tile, within which they are compared with each other, and shingles of all of them.
TILE, TILE_SHINGLES = 1024, 1 << 21


@lru_cache(4)
def _permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, (n, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, (n, 1), dtype=np.uint64)


def shingle_set(text: bytes | None, n: int = 4) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles, A-Z lower-cased; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, np.uint64(size))
    for k in range(size):
        out = mix(out * M3 + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def signature(shingles: np.ndarray, n: int = BANDS * ROWS, seed: int = 1) -> np.ndarray:
    a, b = _permutations(n, seed)
    low = np.full(n, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 512):
        low = np.minimum(low, (a * shingles[at : at + 512] + b).min(axis=1))
    return (low >> np.uint64(32)).astype("<u4")


@lru_cache(8)
def least_matches(threshold: float, total: int = BANDS * ROWS, batch: int = BATCH, miss: float = MISS) -> tuple[int, ...]:
    """After each batch, the fewest matches that keep a pair: P(similarity >= threshold | matches) >= miss, uniform prior."""
    grid = (np.arange(20000) + 0.5) / 20000
    out = []
    for n in range(batch, total + 1, batch):
        for m in range(n + 1):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
            mass = np.exp(logs - logs.max())
            if mass[grid >= threshold].sum() >= miss * mass.sum():
                out.append(m)
                break
    return tuple(out)


def likely(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Indices of the signature pairs (rows of a and b) that no batch prunes."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int32)
    for k, least in enumerate(least_matches(threshold)):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (a[alive, part] == b[alive, part]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
    return alive


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two shingle sets."""
    small, large = sorted((len(a), len(b)))
    if not small or 100 * small < percent * large:
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (small + large - common)


def sketches(docs: DataFrame, id: str, text: str, words: int) -> DataFrame:
    """(id, n_shingles, fp1, fp2, sig) by row; the fingerprint is of the whole set, whatever its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp1, fp2, sigs = [], [], [], []
            for x in (v.as_py() for v in batch.column(1)):
                s = shingle_set(x, words)
                n.append(len(s))
                fp1.append(int(mix(s ^ M1).sum(dtype=np.uint64).astype(np.int64)))
                fp2.append(int(mix(s + M2).sum(dtype=np.uint64).astype(np.int64)))
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), pa.array(sigs, pa.binary())], names=["id", "n_shingles", "fp1", "fp2", "sig"])

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, "id long, n_shingles long, fp1 long, fp2 long, sig binary")


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u4").reshape(-1, BANDS * ROWS)


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """64-bit key of every band of every signature."""
    parts = sigs.astype(np.uint64).reshape(len(sigs), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * M3, (len(sigs), BANDS))
    for k in range(ROWS):
        key = mix(key * M3 + parts[:, :, k])
    return key.astype(np.int64)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_signatures(batch.column("sig").to_pylist()))
            ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], names=["key", "id"])


def _prune(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (leader, id), a written table, those that no batch of their signatures prunes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = likely(_signatures(batch.column("sa").to_pylist()), _signatures(batch.column("sb").to_pylist()), threshold)
                yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep)) for k in (0, 1)], names=["leader", "id"])

    with_a = spread_join(pairs, sigs.select(F.col("id").alias("leader"), F.col("sig").alias("sa")), ["leader"], ["id"])
    return with_a.join(sigs.withColumnRenamed("sig", "sb"), "id").select("leader", "id", "sa", "sb").mapInArrow(run, "leader long, id long")


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """Pairs (leader, id) whose full sets are similar enough: (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def of(id: int, text: bytes) -> np.ndarray:
            if id not in known:
                if len(known) >= 100:
                    known.clear()
                known[id] = shingle_set(text, words)
            return known[id]

        for batch in batches:
            a, b, ta, tb = (batch.column(k) for k in range(4))
            keep = [similar(of(a[i].as_py(), ta[i].as_py()), of(b[i].as_py(), tb[i].as_py()), percent) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(keep, pa.bool_())) for x in (a, b)], names=["u", "v"])

    pairs = materialise(pairs, f"{name}-pairs")
    needed = pairs.select(F.col("leader").alias("id")).unionByName(pairs.select("id")).distinct()
    held = materialise(only_ids(texts, needed, "id").groupBy("id").agg(F.max("t").alias("t")), f"{name}-texts")
    with_a = spread_join(pairs, held.select(F.col("id").alias("leader"), F.col("t").alias("ta")), ["leader"], ["id"])
    both = with_a.join(held.select("id", F.col("t").alias("tb")), "id")
    return materialise(both.select("leader", "id", "ta", "tb").mapInArrow(run, "u long, v long"), f"{name}-links")


def _candidates(rows: list[dict], threshold: float) -> tuple[list[dict], list[dict], np.ndarray]:
    """The rows of either side of a tile, and by column the matches, left and right place of the pairs of different components that no batch prunes.

    Pairs that share an earlier band are left to that band's bucket.
    """
    key, i, j = (rows[0][k] for k in ("key", "i", "j"))
    left, right = [r for r in rows if r["sub"] == i], [r for r in rows if r["sub"] == j]
    found = [np.empty((3, 0), np.int32)]
    if left and right:
        sa, sb = _signatures([r["sig"] for r in left]), _signatures([r["sig"] for r in right])
        ka, kb = band_keys(sa), band_keys(sb)
        place = int(np.flatnonzero(ka[0] == key)[0])
        comp, ids = np.array([r["comp"] for r in right]), np.array([r["id"] for r in right])
        for k, r in enumerate(left):
            new = (comp != r["comp"]) & ~(kb[:, :place] == ka[k, :place]).any(axis=1)
            if i == j:
                new &= ids > r["id"]
            new = np.flatnonzero(new)
            new = new[likely(np.broadcast_to(sa[k], (len(new), sa.shape[1])), sb[new], threshold)]
            if len(new):
                found.append(np.stack(((sb[new] == sa[k]).sum(axis=1), np.full(len(new), k), new)).astype(np.int32))
    return left, right, np.concatenate(found, axis=1)


def _survivors(rows: list[dict], threshold: float) -> list[tuple]:
    """(key, i, j, id, comp, sub) of the tile's rows that are in a candidate pair: at most the tile's rows, however many pairs."""
    left, right, (_, k, c) = _candidates(rows, threshold)
    kept = {r["id"]: r for r in [*(left[x] for x in np.unique(k)), *(right[x] for x in np.unique(c))]}
    return [tuple(r[n] for n in ("key", "i", "j", "id", "comp", "sub")) for r in kept.values()]


def _tile_links(rows: list[dict], threshold: float, words: int, percent: int) -> list[tuple[int, int]]:
    """Links that join different components within one tile of a bucket.

    Candidates are confirmed from the likeliest on, and not at all once their components have met.
    """
    left, right, found = _candidates(rows, threshold)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    sets: dict[int, np.ndarray] = {}
    links = []
    for at in np.lexsort((found[2], found[1], -found[0])):
        one, two = left[found[1, at]], right[found[2, at]]
        x, y = root(one["comp"]), root(two["comp"])
        if x != y:
            for r in (one, two):
                if r["id"] not in sets:
                    sets[r["id"]] = shingle_set(r["t"], words)
            if similar(sets[one["id"]], sets[two["id"]], percent):
                parent[max(x, y)] = min(x, y)
                links.append((one["id"], two["id"]))
    return links


def _by_tile(rest: DataFrame, columns: list[str], kernel: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """What ``kernel`` makes of each tile's rows; a task holds one tile at a time."""
    fields = [f.split() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def close() -> pa.RecordBatch:
            out = kernel(held) if held else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64() if kind == "long" else pa.int32()) for k, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])

        for row in (r for batch in batches for at in range(0, batch.num_rows, 256) for r in batch.slice(at, 256).to_pylist()):
            if held and any(row[k] != held[0][k] for k in ("key", "i", "j")):
                yield close()
                held = []
            held.append(row)
        yield close()

    tiled = rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return tiled.select("key", "i", "j", "id", "comp", "sub", *columns).mapInArrow(run, schema)


def _split_links(placed: DataFrame, split: DataFrame, sigs: DataFrame, texts: DataFrame, threshold: float, words: int, percent: int) -> DataFrame:
    """(u, v): links within the buckets that are still split, whose rows (key, id, comp) are ``placed``.

    Tiles of signatures tell which rows have a likely partner, and only these get their texts.
    """
    rest = materialise(spread_join(placed, split, ["key"], ["id"]), "rest")
    rest = rest.withColumn("sub", F.pmod(F.xxhash64("id"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rest = rest.select("key", "id", "comp", "sub", F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"))
    tile = "key long, i int, j int, id long, comp long, sub int"
    alive = materialise(_by_tile(rest.join(sigs, "id"), ["sig"], lambda rows: _survivors(rows, threshold), tile), "alive")
    held = only_ids(texts, alive.select("id").distinct(), "id").groupBy("id").agg(F.max("t").alias("t"))
    held = materialise(held.join(sigs, "id"), "alive-texts")
    more = _by_tile(alive.join(held, "id"), ["sig", "t"], lambda rows: _tile_links(rows, threshold, words, percent), "u long, v long")
    return materialise(more.distinct(), "rest-links")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 4, percent: int = 80) -> DataFrame:
    """(id column, n_shingles, component_id, kept): one row per id of ``docs``.

    Two texts are linked if 100 * intersection >= percent * union of their sets of ``words``-word
    shingles, A-Z lower-cased; component_id is the smallest id reachable by links and kept marks
    it.  Null, empty and blank texts have no shingles and link with nothing; a null id links with
    nothing, has a null component and is kept; rows that repeat an id are one document with the
    greatest of their texts; other columns are ignored; an empty table gives an empty one.
    """
    threshold = percent / 100
    sk = materialise(sketches(docs, id, text, words), "sketches")
    sets = F.struct("n_shingles", "fp1", "fp2")
    if not sk.where("id is not null").groupBy("id").agg(F.min(sets).alias("a"), F.max(sets).alias("b")).where("a <> b").isEmpty():
        one = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("t")).groupBy("id").agg(F.max("t").alias("t"))
        return near_duplicates(materialise(one, "one-text"), "id", "t", words, percent).withColumnRenamed("id", id)
    valid = sk.where("id is not null and n_shingles > 0")
    same = ["fp1", "fp2", "n_shingles"]
    classes = valid.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    member = spread_join(valid, classes, same, ["id"], "left").withColumn("rep", F.coalesce("rep", "id"))
    member = materialise(member.select("id", "rep", "sig"), "members")
    sigs = materialise(member.where("id = rep").select("id", "sig").dropDuplicates(["id"]), "signatures")

    rows = materialise(sigs.mapInArrow(_band_rows, "key long, id long"), "bands")
    shared = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    in_buckets = materialise(spread_join(rows, shared, ["key"], ["id"]), "buckets")
    scores = in_buckets.groupBy("id").agg(F.sum("c").alias("score"))
    leaders = in_buckets.join(scores, "id").groupBy("key").agg(F.max(F.struct("score", F.negative("id").alias("minus"))).alias("top")).select("key", F.negative("top.minus").alias("leader"))
    led = materialise(spread_join(in_buckets, leaders, ["key"], ["id"]).where("id <> leader"), "led")
    pairs = materialise(led.select("leader", "id").distinct(), "led-pairs")
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("t"))
    links = _confirm(_prune(pairs, sigs, threshold), texts, words, percent, "led")

    first = materialise(connected_components(links), "first")
    sized = sigs.join(valid.groupBy("id").agg(F.max("n_shingles").alias("w")), "id")
    placed = led.where("c > 2").join(first, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    placed = materialise(placed.join(sized.select("id", "w"), "id"), "placed")
    tiles = F.greatest(F.ceil(F.col("n") / TILE), F.least(F.col("n"), F.ceil(F.col("w") / TILE_SHINGLES))).cast("int")
    split = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n"), F.sum("w").alias("w")).where("low < high").select("key", tiles.alias("tiles"))
    if not split.isEmpty():
        links = links.unionByName(_split_links(placed.drop("w"), split, sigs, texts, threshold, words, percent))

    component = connected_components(links).withColumnRenamed("id", "rep")
    own = materialise(member.select("id", "rep").distinct(), "classes")
    found = spread_join(own, component, ["rep"], ["id"], "left").groupBy("id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    sizes = sk.groupBy("id").agg(F.max("n_shingles").alias("n_shingles"))
    out = sizes.join(found, "id", "left").select(F.col("id").alias(id), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col(id), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near copies: the others' rows go, all columns stay.

    Of a group the smallest id is kept, with all rows that repeat it; null, empty and blank texts
    and rows with a null id are kept; an empty table gives an empty one.
    """
    dropped = near_duplicates(docs, id, text, words, percent).where("not kept").select(id)
    return only_ids(docs, materialise(dropped, "dropped"), id, "left_anti")

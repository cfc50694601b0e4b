"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned into the order of their principal components. Tiles of them are
compared over the leading components first; what the others can still add is bounded by the product of the two
suffix norms, and rows and columns that can't reach the threshold leave the tile. Tiles whose first components
lie too far apart are never paired. Tiles are written once, as components in single precision, and each task reads those of
its pairs; pairs are not shuffled, so the disk taken grows with the vectors. Pairs within rounding of the threshold come
out as such and are decided on the vectors as given, in double precision, fetched for them alone.

A tile pair reports how many links each vector has and a spanning forest of the links, not the links.
Equal vectors are one row until the end. Vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different lengths don't link. Repeated vec_ids are separate vectors
of one node. Empty tables give empty results. Only vec_id and embedding are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, stored

#: Bytes of a tile's components at most, its vectors at least, and tiles at least; leading components after which a tile is looked through again.
TILE_BYTES, LEAST, TILES, STEPS, STRIP = 2 << 20, 512, 24, (16, 32), 512


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))


def _units(column: pa.Array) -> np.ndarray:
    """The vectors at length one."""
    x = _matrix(column)
    x = x / np.abs(x).max(1, initial=0.0, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _slack(size: int) -> float:
    """What rounding to single precision may take from a product of unit vectors, and more than that."""
    return 2e-7 * (size + 8)


def principal_axes(units: DataFrame, size: int) -> np.ndarray:
    """Columns are the principal axes of the vectors, the largest first; size x size sums are what is gathered."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = _units(batch.column(0))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], ["i", "x"])

    got = units.select("e").mapInArrow(gram, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(size * size)
    for i, x in got:
        total[i] = x
    values, axes = np.linalg.eigh(total.reshape(size, size))
    return axes[:, np.argsort(-values, kind="stable")]


class Forest:
    """Union-find over numbers 0..n-1."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the ends of all pairs at once, by handing on the smallest label until none changes."""
        label = self.up
        while True:
            la, lb = label[a], label[b]
            if (la == lb).all():
                return
            low, high = np.minimum(la, lb), np.maximum(la, lb)
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
            self.up = label


def compare(x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (rows of x, rows of y, whether within rounding of it) of unit vectors in PCA order, in single precision, whose product reaches the threshold."""
    slack = _slack(x.shape[1])
    cuts = [0, *(s for s in STEPS if s < x.shape[1]), x.shape[1]]
    rest = lambda m, c: np.sqrt((m[:, c:] ** 2).sum(1))
    x_rest, y_rest = [rest(x, c) for c in cuts], [rest(y, c) for c in cuts]
    for top in range(0, len(x), STRIP):
        rows, cols = np.arange(top, min(len(x), top + STRIP)), np.arange(len(y))
        product = np.zeros((len(rows), len(cols)), np.float32)
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            product += x[rows, a:b] @ y[cols, a:b].T
            if k + 2 == len(cuts):
                break
            alive = product >= threshold - slack - np.outer(x_rest[k + 1][rows], y_rest[k + 1][cols])
            r, c = alive.any(1), alive.any(0)
            if not r.any():
                break
            if r.mean() * c.mean() < 0.7:
                rows, cols, product = rows[r], cols[c], product[np.ix_(r, c)]
        else:
            continue
        if k + 2 < len(cuts):
            continue
        i, j = np.nonzero(product >= threshold - slack)
        yield rows[i], cols[j], product[i, j] < threshold + slack


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, tile: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("e"))
    sound = F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    top = F.array_max(F.transform("e", lambda x: F.abs(x).cast("double")))
    scaled = F.transform("e", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x / F.col("top")))
    # Vectors of one direction have one pair of hashes, so that they meet without being shuffled again.
    good = rows.where(sound).withColumn("top", top).where("top > 0").withColumns({"h": F.xxhash64(scaled), "h2": F.xxhash64(F.lit(1), scaled)})
    kinds = good.groupBy("h", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first(F.struct("e", "top")).alias("v")).select("h", "h2", "id", "copies", "v.*")
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + (x / F.col("top")) * (x / F.col("top"))))
    kinds = stored(kinds.withColumns({"size": F.size("e"), "norm": norm}))
    counts, edges = None, None
    for size, n in sorted(kinds.groupBy("size").count().collect()):
        units = kinds.where(F.col("size") == size).withColumn("u", F.transform("e", lambda x: x / F.col("top") / F.col("norm")))
        part = _compare_all(units, size, threshold, tile or max(min(LEAST, max(64, TILE_BYTES // (4 * size))), min(n // TILES, TILE_BYTES // (4 * size))))
        close = part.where("b is not null and n is not null").select("a", "b")
        vector = [units.select(F.col("id").alias(c), F.col("u").alias(f"u{c}"), F.col("copies").alias(f"n{c}")) for c in "ab"]
        product = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
        sure = checkpoint(close.join(vector[0], "a").join(vector[1], "b").where(product >= threshold).select("a", "b", "na", "nb"))
        own_counts = part.where("b is null").select("a", "n").unionByName(sure.select("a", F.col("nb").alias("n"))).unionByName(sure.select(F.col("b").alias("a"), F.col("na").alias("n")))
        own_edges = part.where("b is not null and n is null").select("a", "b").unionByName(sure.select("a", "b"))
        counts = own_counts if counts is None else counts.unionByName(own_counts)
        edges = own_edges if edges is None else edges.unionByName(own_edges)
    ids = rows.select("vec_id")
    if counts is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    twins = good.select("vec_id", "h", "h2").join(kinds.where("copies > 1").select("h", "h2", "id", "copies"), ["h", "h2"]).select("vec_id", "id", "copies")
    member = twins.unionByName(kinds.where("copies = 1").select(F.col("id").alias("vec_id"), "id", "copies"))
    total = counts.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    found = components(edges)
    known = member.join(total, "id", "left").join(found.withColumnRenamed("node", "id"), "id", "left")
    known = known.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    alone = ids.join(known.select("vec_id").distinct(), "vec_id", "left_anti").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _compare_all(units: DataFrame, size: int, threshold: float, tile: int) -> DataFrame:
    """Rows (a, b null, n): links of a counted with copies; rows (a, b, n null): links that connect what is linked;
    rows (a, b, 0): pairs within rounding of the threshold."""
    spark = units.sparkSession
    axes = principal_axes(units, size)
    shared = spark.sparkContext.broadcast(axes)
    # Unit vectors at least `threshold` alike lie within this distance, in each component; so there are few cells.
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-9 if threshold < 1 else 1e-4
    lead = [F.aggregate(F.zip_with("u", F.array(*map(F.lit, axes[:, k].tolist())), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) for k in range(min(2, size))]
    celled = units.withColumns({f"c{k}": F.floor(x / reach).cast("int") for k, x in enumerate(lead)} | ({} if size > 1 else {"c1": F.lit(0)}))
    cells = celled.groupBy("c0", "c1").count().collect()  # at most (2 / reach + 2) squared
    blocks = {(r[0], r[1]): -(-r[2] // tile) for r in cells}
    first, at = {}, 0
    for cell in sorted(blocks):
        first[cell] = at
        at += blocks[cell]
    partners = [(*c, first[c], blocks[c], [[first[d], first[d] + blocks[d] - 1] for d in sorted(blocks) if abs(c[0] - d[0]) <= 1 and abs(c[1] - d[1]) <= 1]) for c in sorted(blocks)]
    map_of = spark.createDataFrame(partners, "c0 int, c1 int, base long, blocks long, near array<array<long>>")
    placed = celled.join(F.broadcast(map_of), ["c0", "c1"]).withColumn("tile", F.col("base") + F.pmod(F.xxhash64("id"), F.col("blocks")))

    def pack(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        pc = (_units(t.column("e")) @ shared.value).astype(np.float32).tobytes()
        return pa.table({"tile": [key[0].as_py()], "ids": [t.column("id").to_numpy().tobytes()], "copies": [t.column("copies").to_numpy().tobytes()], "pc": [pc]}, schema=pa.schema([("tile", pa.int64()), ("ids", pa.binary()), ("copies", pa.binary()), ("pc", pa.binary())]))

    packed = stored(placed.select("tile", "id", "copies", "e").groupBy("tile").applyInArrow(pack, "tile long, ids binary, copies binary, pc binary"))
    base = F.broadcast(map_of.select("base", "blocks", "near"))
    one = packed.join(base, (F.col("tile") >= F.col("base")) & (F.col("tile") < F.col("base") + F.col("blocks"))).drop("base", "blocks")
    two = packed.toDF("tile2", "ids2", "copies2", "pc2")
    # Either order of two tiles is one pair; each tile comes first in half of its pairs. No column is equal, so Spark pairs the files' parts.
    once = (F.col("tile") == F.col("tile2")) | ((F.col("tile") < F.col("tile2")) == ((F.col("tile") + F.col("tile2")) % 2 == 0)) & (F.col("tile") != F.col("tile2"))
    pairs = one.join(two, once & F.exists("near", lambda r: (F.col("tile2") >= r[0]) & (F.col("tile2") <= r[1]))).drop("near")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                r = {c: batch.column(c)[row] for c in batch.schema.names}
                yield compared(r["tile"].as_py() == r["tile2"].as_py(), *([np.frombuffer(r[f"{c}{k}"].as_buffer(), kind) for k in ("", "2")] for c, kind in (("ids", np.int64), ("copies", np.int64), ("pc", np.float32))))

    def compared(own: bool, ids: list[np.ndarray], copies: list[np.ndarray], pc: list[np.ndarray]) -> pa.RecordBatch:
        pc = [p.reshape(-1, size) for p in pc]
        a, b = 0, 0 if own else 1
        everyone = ids[0] if own else np.concatenate(ids)
        shift = 0 if own else len(ids[0])
        weight = copies[0] if own else np.concatenate(copies)
        links, forest = np.zeros(len(everyone), np.int64), Forest(len(everyone))
        doubtful = [np.zeros((2, 0), np.int64)]
        for i, j, close in compare(pc[a], pc[b], threshold):
            if own:
                i, j, close = i[i < j], j[i < j], close[i < j]
            j = j + shift
            doubtful.append(np.stack([everyone[i[close]], everyone[j[close]]]))
            i, j = i[~close], j[~close]
            links += np.bincount(i, weight[j], len(links)).astype(np.int64) + np.bincount(j, weight[i], len(links)).astype(np.int64)
            forest.add(i, j)
        hit, far = np.flatnonzero(links), np.flatnonzero(forest.up != np.arange(len(everyone)))
        none = lambda n: pa.nulls(n, pa.int64())
        one, two = np.concatenate(doubtful, axis=1)
        return pa.RecordBatch.from_pydict({"a": pa.concat_arrays([pa.array(everyone[hit]), pa.array(everyone[far]), pa.array(one)]), "b": pa.concat_arrays([none(len(hit)), pa.array(everyone[forest.up[far]]), pa.array(two)]), "n": pa.concat_arrays([pa.array(links[hit]), none(len(far)), pa.array(np.zeros(len(one), np.int64))])})

    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    try:  # a row is two tiles
        spark.conf.set(limit, "4")
        return stored(pairs.mapInArrow(match, "a long, b long, n long"))
    finally:
        spark.conf.set(limit, before)

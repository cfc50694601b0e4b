"""Green's functions and forward models of tables of patches, for tables of observations, in blocks of NumPy kernels.

Observations are (row, x, y[, depth]) and patches (col and their geometry), in one unit of length, x east and y north.
Rectangles have x, y and depth of their upper edge's centre, strike, dip, length and width; triangles x1, y1, z1 .. z3 with z down.

Every patch meets every observation, so the work is spread in blocks: a patch table of up to ``near`` rows is sent to the tasks
that hold the observations, which are not shuffled; a larger one is dealt over a grid of blocks of both tables, each
block pair one task of bounded size. Sums over patches are made in the tasks before anything is shuffled. Nulls in a
geometry give null values for that patch or observation, and add nothing to sums; so do patches without area and points on
a patch's edge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dislocations

RECTANGLE = ("x", "y", "depth", "strike", "dip", "length", "width")
TRIANGLE = tuple(f"{a}{k}" for k in (1, 2, 3) for a in "xyz")
AXES = ("east", "north", "up")
VALUES = tuple(f"{s}_{a}" for s in dislocations.SLIPS for a in AXES)
#: Patches that are sent to all tasks at most; pairs that a kernel holds at once; rows of a block in the grid.
NEAR, PAIRS, BLOCK = 20_000, 50_000, 4_096
STRAINS = ("ee", "en", "eu", "nn", "nu", "uu")
_PAIR = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


def _surface(kind: str, x: np.ndarray, y: np.ndarray, patches: np.ndarray, poisson: float) -> np.ndarray:
    if kind == "rectangle":
        return dislocations.polygon_surface(x, y, dislocations.rectangle_corners(*patches.T), poisson, dislocations.rectangle_slips(patches[:, 3], patches[:, 4]))
    return dislocations.polygon_surface(x, y, patches.reshape(-1, 3, 3), poisson)


def _numbers(table: pa.Table | pa.RecordBatch, names: tuple[str, ...]) -> np.ndarray:
    return np.stack([table.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).cast(pa.float64()).to_numpy() for c in names], -1) if table.num_rows else np.zeros((0, len(names)))


def _clean(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=~np.isfinite(values))


Block = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]


def _blocks(observations: DataFrame, patches: DataFrame, seen: tuple[str, ...], geometry: tuple[str, ...], make: Block, schema: str, near: int) -> tuple[DataFrame, bool]:
    """``make`` (rows, places, cols, geometries) over all pairs, and whether each row met all patches in one call."""
    obs = observations.select(F.col("row").cast("long").alias("row"), *(F.col(c).cast("double").alias(c) for c in seen))
    given = patches.select(F.col("col").cast("long").alias("col"), *(F.col(c).cast("double").alias(c) for c in geometry))
    sources = given.count()
    if sources <= near:
        table = given.orderBy("col").toArrow()
        sent = observations.sparkSession.sparkContext.broadcast((table.column("col").to_numpy(), _numbers(table, geometry)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            col, shape = sent.value
            for batch in batches:
                yield from make(batch.column("row").to_numpy(), _numbers(batch, seen), col, shape)

        return obs.mapInArrow(run, schema), True
    across, down = -(-obs.count() // BLOCK) or 1, -(-sources // BLOCK)
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    many = obs.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda j: deal("row", across) * down + j)))
    shared = given.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda i: i * down + deal("col", down))))

    def pair(one: pa.Table, two: pa.Table) -> pa.Table:
        made = list(make(one.column("row").to_numpy(), _numbers(one, seen), two.column("col").to_numpy(), _numbers(two, geometry))) if one.num_rows and two.num_rows else []
        return pa.Table.from_batches(made) if made else _empty(schema)

    return many.groupBy("cell").cogroup(shared.groupBy("cell")).applyInArrow(pair, schema), False


def _empty(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "double": pa.float64()}
    return pa.table({c.split()[0]: pa.array([], kinds[c.split()[1]]) for c in schema.split(", ")})


def _tiles(n: int, m: int) -> Iterator[tuple[slice, slice]]:
    wide = min(m, 512) or 1
    tall = max(1, PAIRS // wide)
    for j in range(0, m, wide):
        for i in range(0, n, tall):
            yield slice(i, i + tall), slice(j, j + wide)


def surface(observations: DataFrame, patches: DataFrame, kind: str = "rectangle", poisson: float = 0.25, near: int = NEAR) -> DataFrame:
    """(row, col, strike_east .. opening_up): displacement at surface points for unit slips of each patch."""
    geometry = RECTANGLE if kind == "rectangle" else TRIANGLE

    def make(row: np.ndarray, place: np.ndarray, col: np.ndarray, shape: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i, j in _tiles(len(row), len(col)):
            u = _surface(kind, place[i, 0], place[i, 1], shape[j], poisson)
            n, m = u.shape[:2]
            u = u.reshape(n * m, 9)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(row[i], m)), pa.array(np.tile(col[j], n)), *(_clean(u[:, k]) for k in range(9))], ["row", "col", *VALUES])

    return _blocks(observations, patches, ("x", "y"), geometry, make, "row long, col long, " + ", ".join(f"{c} double" for c in VALUES), near)[0]


def along(greens: DataFrame, looks: DataFrame, slips: tuple[str, ...] = ("strike", "dip")) -> DataFrame:
    """(row, col, value): the Green's functions seen along each row's unit vector (row, le, ln, lu); a patch has a column for each slip."""
    met = greens.join(looks.select("row", "le", "ln", "lu"), "row")
    value = lambda s: F.col(f"{s}_east") * F.col("le") + F.col(f"{s}_north") * F.col("ln") + F.col(f"{s}_up") * F.col("lu")
    each = F.array(*(F.struct((F.col("col") * len(slips) + k).alias("col"), value(s).alias("value")) for k, s in enumerate(slips)))
    return met.select("row", F.explode(each).alias("g")).select("row", "g.*")


def _added(parts: DataFrame, whole: bool, names: tuple[str, ...]) -> DataFrame:
    return parts if whole else parts.groupBy("row").agg(*(F.sum(c).alias(c) for c in names))


def displacement(observations: DataFrame, patches: DataFrame, kind: str = "rectangle", poisson: float = 0.25, near: int = NEAR) -> DataFrame:
    """(row, east, north, up) at surface points: the sum over patches with their slips ``strike_slip``, ``dip_slip`` and ``opening``.

    Without patches every row is 0; a null slip counts as none.
    """
    shape = RECTANGLE if kind == "rectangle" else TRIANGLE
    geometry = (*shape, "strike_slip", "dip_slip", "opening")

    def make(row: np.ndarray, place: np.ndarray, col: np.ndarray, given: np.ndarray) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(row), 3))
        for i, j in _tiles(len(row), len(col)):
            u = _surface(kind, place[i, 0], place[i, 1], given[j, : len(shape)], poisson)
            total[i] += np.einsum("nmsk,ms->nk", np.nan_to_num(u, nan=0.0, posinf=0.0, neginf=0.0), np.nan_to_num(given[j, len(shape) :]))
        total[~np.isfinite(place).all(1)] = np.nan
        yield pa.RecordBatch.from_arrays([pa.array(row), *(_clean(total[:, k]) for k in range(3))], ["row", *AXES])

    return _added(*_blocks(observations, patches, ("x", "y"), geometry, make, "row long, " + ", ".join(f"{c} double" for c in AXES), near), AXES)


def inside(observations: DataFrame, patches: DataFrame, poisson: float = 0.25, shear_modulus: float | None = None, near: int = NEAR) -> DataFrame:
    """(row, east, north, up, ee, en, eu, nn, nu, uu): displacement and strain at points at any depth, summed over rectangles.

    With ``shear_modulus`` the stress follows as s_ee .. s_uu. Points above the surface get nulls.
    """
    geometry = (*RECTANGLE, "strike_slip", "dip_slip", "opening")
    names = (*AXES, *STRAINS)

    def make(row: np.ndarray, place: np.ndarray, col: np.ndarray, given: np.ndarray) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(row), 9))
        for patch in given:
            if not np.isfinite(patch[:7]).all():
                continue
            u, g = dislocations.rectangle_inside(*place.T, patch[:7], poisson)
            strain = np.stack([(g[:, :, a, b] + g[:, :, b, a]) / 2 for a, b in _PAIR], -1)
            total += np.einsum("nsk,s->nk", np.nan_to_num(np.concatenate([u, strain], -1), nan=0.0, posinf=0.0, neginf=0.0), np.nan_to_num(patch[7:]))
        total[~(place[:, 2] >= 0) | ~np.isfinite(place).all(1)] = np.nan
        yield pa.RecordBatch.from_arrays([pa.array(row), *(_clean(total[:, k]) for k in range(9))], ["row", *names])

    out = _added(*_blocks(observations, patches, ("x", "y", "depth"), geometry, make, "row long, " + ", ".join(f"{c} double" for c in names), near), names)
    if shear_modulus is None:
        return out
    lame = 2 * shear_modulus * poisson / (1 - 2 * poisson) * (F.col("ee") + F.col("nn") + F.col("uu"))
    return out.withColumns({f"s_{c}": 2 * shear_modulus * F.col(c) + (lame if c[0] == c[1] else F.lit(0.0)) for c in STRAINS})


COMPOUND = ("x", "y", "depth", "turn_east", "turn_north", "turn_up", "half_east", "half_north", "half_up", "opening")


def compound(observations: DataFrame, sources: DataFrame, poisson: float = 0.25, near: int = NEAR) -> DataFrame:
    """(row, east, north, up) of compound sources: three rectangles at right angles that open alike, a cavity of any shape at a distance.

    Sources are given by centre, turns (degrees), half axes and opening; a half axis of 0 makes a crack or less. A source
    that reaches above the surface adds nulls to all rows; nulls in a source add nothing.
    """

    def make(row: np.ndarray, place: np.ndarray, col: np.ndarray, given: np.ndarray) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(row), 3))
        given = given[np.isfinite(given).all(1)]
        corners = dislocations.compound_corners(*given[:, :3].T, given[:, 3:6], given[:, 6:9]).reshape(-1, 4, 3)
        opening = np.repeat(given[:, 9], 3)
        if (corners[..., 2] < 0).any():
            total[:] = np.nan
        flat = (np.linalg.norm(corners[:, 1] - corners[:, 0], axis=1) > 0) & (np.linalg.norm(corners[:, 3] - corners[:, 0], axis=1) > 0)
        corners, opening = corners[flat], opening[flat]
        for i, j in _tiles(len(row), len(corners)):
            u = dislocations.polygon_surface(place[i, 0], place[i, 1], corners[j], poisson)[:, :, 2]
            total[i] += np.einsum("nmk,m->nk", u, opening[j])
        total[~np.isfinite(place).all(1)] = np.nan
        yield pa.RecordBatch.from_arrays([pa.array(row), *(_clean(total[:, k]) for k in range(3))], ["row", *AXES])

    return _added(*_blocks(observations, sources, ("x", "y"), COMPOUND, make, "row long, " + ", ".join(f"{c} double" for c in AXES), near), AXES)


def volume(opening, half_east, half_north, half_up):
    """Volume that a compound source opens."""
    return 4 * opening * (half_east * half_north + half_north * half_up + half_east * half_up)

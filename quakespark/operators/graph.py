"""Meshes and clusters as edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import same, settled


def edges(faces: DataFrame, face: str, corners: tuple[str, str, str]) -> DataFrame:
    """(face, a, b): the three sides of each triangle, a < b."""
    a, b, c = corners
    sides = F.array(*(F.struct(F.least(p, q).alias("a"), F.greatest(p, q).alias("b")) for p, q in ((a, b), (b, c), (c, a))))
    return faces.select(F.col(face).alias("face"), F.inline(sides))


def adjacency(faces: DataFrame, face: str, corners: tuple[str, str, str]) -> DataFrame:
    """(face, neighbor): triangles that share a side."""
    one = edges(faces, face, corners)
    return one.join(one.withColumnRenamed("face", "neighbor"), ["a", "b"]).where("face <> neighbor").select("face", "neighbor").distinct()


def boundary_edges(faces: DataFrame, face: str, corners: tuple[str, str, str]) -> DataFrame:
    """Sides of one triangle only."""
    return edges(faces, face, corners).groupBy("a", "b").agg(F.count("*").alias("n"), F.min("face").alias("face")).where("n = 1").drop("n")


def laplacian(pairs: DataFrame) -> DataFrame:
    """(row, col, value) of the graph Laplacian of (face, neighbor): -1 for neighbours, their number on the diagonal."""
    diagonal = pairs.groupBy("face").agg(F.count("*").cast("double").alias("value")).select(F.col("face").alias("row"), F.col("face").alias("col"), "value")
    return diagonal.unionByName(pairs.select(F.col("face").alias("row"), F.col("neighbor").alias("col"), F.lit(-1.0).alias("value")))


def components(pairs: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """(node, component): smallest node that is reached.

    Two steps alternate until nothing changes: each node hands its smallest neighbour to its larger neighbours, then to its
    smaller ones. Edges are dealt by their ends and aggregates keep one smallest neighbour a node, so no
    component is gathered; the joins are by node, which Spark splits where a node has many edges.
    """

    def step(now: DataFrame, large: bool) -> DataFrame:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else now
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        hung = both.join(least, "a")
        if large:
            hung = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            hung = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return hung.where("a <> b").distinct()

    first, second = F.col(a), F.col(b)
    now = settled(pairs.select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b")).where("a <> b").distinct())
    seen = None
    for _ in range(most):
        now = settled(step(step(now, True), False))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = state
    raise RuntimeError(f"components didn't settle in {most} rounds")


#: Cells' sides in terms of eps: points of one cell are within eps, those within eps at most two cells away, whatever is rounded up to FAR cells from 0.
SIDE, FAR, LEVELS = 0.6, 2.0**48, 14


def _axis(c: str, side: float, level: int | None = None) -> Column:
    """A coordinate's cell, or its cell of 2^-level the side. Beyond FAR cells only equal coordinates share one, which isn't divided."""
    q = F.col(c) / side
    near = F.floor(q * 2.0 ** (level or 0)).cast("long")
    return F.when(F.abs(q) < FAR, near).otherwise(F.xxhash64(c) if level is None else F.lit(0).cast("long"))


def _within(eps: float) -> tuple[Column, Column]:
    """Whether two boxes (x0, x1, y0, y1), (x02, ...) can have two points within eps, and whether all of their points are."""
    gaps = [(F.col(f"{t}0") - F.col(f"{t}12"), F.col(f"{t}02") - F.col(f"{t}1")) for t in ("x", "y")]
    length = lambda p, q: F.sqrt(p * p + q * q)
    return length(*(F.greatest(F.lit(0.0), p, q) for p, q in gaps)) <= eps, length(*(F.greatest(-p, -q) for p, q in gaps)) <= eps


def _linked_cells(cores: DataFrame, side: float, eps: float) -> DataFrame:
    """(a, b): cells of core points (node, cx, cy, x, y) with two points within eps, cells being named by their node.

    Cells whose points' boxes are all within eps are linked, those with boxes further apart are not. The others' boxes are halved, until
    few pairs of points are left to be looked at.
    """
    box = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("c")]
    sides = ("x0", "x1", "y0", "y1", "c")
    parts = lambda level: [_axis(t, side, level).alias(f"s{t}") for t in ("x", "y")]
    again = lambda df, name: df.toDF(*(name if c == "node" else f"{c}2" for c in df.columns))
    first = settled(cores.groupBy("node", "cx", "cy", *parts(0)).agg(*box))
    around = F.array(*(F.struct((F.col("cx") + i).alias("cx2"), (F.col("cy") + j).alias("cy2")) for i in range(3) for j in range(-2, 3) if (i, j) > (0, 0)))
    pairs = first.select(F.col("node").alias("a"), "sx", "sy", *sides, F.inline(around)).join(again(first, "b"), ["cx2", "cy2"])
    few, links = max(1_000_000, 20 * cores.count()), None
    can, sure = _within(eps)
    for level in range(1, LEVELS + 1):
        judged = settled(pairs.where(can).select("a", "b", "sx", "sy", "sx2", "sy2", "c", "c2", sure.alias("sure")))
        linked = judged.where("sure").select("a", "b").distinct()
        links = linked if links is None else links.unionByName(linked)
        open_ = settled(judged.where("not sure").join(linked, ["a", "b"], "left_anti"))
        work = open_.agg(F.sum(F.col("c").cast("double") * F.col("c2"))).first()[0]
        if not work:
            return links
        if work <= few or level == LEVELS:
            break
        boxes = settled(cores.groupBy("node", *parts(level)).agg(*box).withColumns({"px": F.shiftright("sx", 1), "py": F.shiftright("sy", 1)}))
        one = boxes.withColumnRenamed("node", "a")
        held = open_.select("a", "b", F.col("sx").alias("px"), F.col("sy").alias("py"), F.col("sx2").alias("px2"), F.col("sy2").alias("py2"))
        pairs = held.join(one, ["a", "px", "py"]).join(again(boxes, "b"), ["b", "px2", "py2"])
    own = cores.select("node", *parts(level - 1), "x", "y")
    x, y = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    met = open_.select("a", "b", "sx", "sy", "sx2", "sy2").join(own.withColumnRenamed("node", "a"), ["a", "sx", "sy"]).join(again(own, "b"), ["b", "sx2", "sy2"])
    return links.unionByName(met.where(F.sqrt(x * x + y * y) <= eps).select("a", "b").distinct())


def dbscan(points: DataFrame, key: str, x: str, y: str, eps: float, least: int, salt: int = 1) -> DataFrame:
    """(key, cluster, core): cluster is the smallest core point's key; border points join their smallest cluster, noise has null.

    Points at one place are one node, named by its smallest key and counted with their number. Points of one cell of the grid are within
    eps of each other: in cells with enough of them all are core points, and a cell's core points are one node of the components. Only
    points of other cells, a few in each, meet the points around them, dealt to ``salt`` tasks a cell.
    """
    points = points.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    places = settled(points.groupBy("x", "y").agg(F.min("key").alias("k"), F.count("*").alias("n")))
    side = SIDE * eps
    placed = places.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))).select("*", _axis("x", side).alias("cx"), _axis("y", side).alias("cy"))
    cells = placed.groupBy("cx", "cy").agg(F.sum("n").alias("all"))
    placed = settled(placed.join(cells, ["cx", "cy"]).withColumn("dense", F.col("all") >= least).drop("all"))
    around = F.array(*(F.struct((F.col("cx") + i).alias("cx2"), (F.col("cy") + j).alias("cy2"), F.lit(s).alias("salt")) for i in range(-2, 3) for j in range(-2, 3) for s in range(salt)))
    other = placed.select("cx", "cy", "x", "y", "k", "n").toDF("cx2", "cy2", "x2", "y2", "k2", "n2").withColumn("salt", F.pmod(F.xxhash64("k2"), F.lit(salt)).cast("int"))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    met = placed.where("not dense").select("k", "x", "y", F.inline(around)).join(other, ["cx2", "cy2", "salt"])
    near = settled(met.where(F.sqrt(dx * dx + dy * dy) <= eps).select("k", "k2", "n2", "cx2", "cy2"))
    enough = near.groupBy("k").agg((F.sum("n2") >= least).alias("core"))
    judged = settled(placed.join(enough, "k", "left").withColumn("core", F.col("dense") | F.coalesce("core", F.lit(False))).drop("dense", "n"))
    nodes = judged.where("core").groupBy("cx", "cy").agg(F.min("k").alias("node"))
    cores = settled(judged.where("core").select("cx", "cy", "x", "y").join(nodes, ["cx", "cy"]))
    linked = components(_linked_cells(cores, side, eps)).withColumnRenamed("component", "cluster")
    clusters = settled(nodes.join(linked, "node", "left").select("cx", "cy", F.coalesce("cluster", "node").alias("cluster")))
    held = judged.where("core").join(clusters, ["cx", "cy"]).select("x", "y", "cluster", "core")
    reached = near.join(judged.where("not core").select("k"), "k").join(judged.where("core").select(F.col("k").alias("k2")), "k2")
    edge = reached.join(clusters.toDF("cx2", "cy2", "cluster"), ["cx2", "cy2"]).groupBy("k").agg(F.min("cluster").alias("cluster"))
    border = judged.where("not core").join(edge, "k").select("x", "y", "cluster", "core")
    out = held.unionByName(border)
    found = settled(places.select("x", "y").join(out, ["x", "y"], "left").withColumn("core", F.coalesce("core", F.lit(False))))
    return points.join(found, same(points, found, ("x", "y"))).select(F.col("key").alias(key), "cluster", "core")

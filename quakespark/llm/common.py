"""What the operators share: reading tables, the shared folder, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a new local one only where a local session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so that lost executors lose nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read again, so that lost executors lose nothing.

    With ``by`` the table is bucketed by that column: joins on it don't shuffle it again.
    """
    spark = df.sparkSession
    name = f"stored_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    if by is None:
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    n = shuffle_partitions(spark)
    df.repartition(n, by).write.option("compression", "zstd").option("path", path).bucketBy(n, by).saveAsTable(name)
    return spark.table(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: Column | str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo ``modulus``: the rule that splits training rows from held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus if isinstance(column, str) else F.crc32(column.cast("string").cast("binary")) % modulus


def arrow_map(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, column: str = "text", limit: int = 1 << 20) -> DataFrame:
    """Apply ``make`` to runs of rows with about ``limit`` bytes of text, so that memory doesn't follow the batch size."""
    from .text import slices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, limit):
            made = make(batch)
            if made is not None:
                yield made

    return df.mapInArrow(run, schema)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends of the edges, and the smallest end that each is connected with."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = code[: len(a)], code[len(a) :]
    label = np.arange(len(nodes))
    while (label[one] != label[two]).any():
        np.minimum.at(label, np.maximum(label[one], label[two]), np.minimum(label[one], label[two]))
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def components(edges: DataFrame, most: int = 60, task: int = 500_000) -> DataFrame:
    """(node, component): the smallest node that edges (a, b) of longs reach from each node.

    First each task turns its own edges, about ``task`` of them, into stars. Then two steps alternate until
    nothing changes: each node hands its smallest neighbour to its larger neighbours, then to its smaller ones.
    A star's edges are dealt by their far ends, so no group is gathered: the aggregates keep one smallest
    neighbour for a node. Rounds follow the logarithm of the longest path.
    """

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        node, root = forest(*(np.concatenate([np.zeros(0, np.int64), *(b.column(k).to_numpy() for b in held)]) for k in (0, 1)))
        far = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(root[far])], ["a", "b"])

    def step(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        hung = both.join(least, "a")
        if large:
            hung = hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            hung = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return hung.where("a <> b").distinct()

    now = edges.select("a", "b").where("a <> b")
    tasks = 1 + now.count() // task
    now = checkpoint(now.coalesce(tasks).mapInArrow(stars, "a long, b long"))
    seen = None
    for _ in range(most if tasks > 1 else 0):
        now = checkpoint(step(step(now, True), False))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        if tasks > 1:
            raise RuntimeError(f"components didn't settle in {most} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

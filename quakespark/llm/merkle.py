"""Merkle manifest of a dataset: a 16-ary tree of digests for each source, and one tree over the sources' roots.

Parents are stored with the concatenated digests of their children (their preimage). A leaf's proof needs the preimages
of its ancestors only: its own 64 characters are cut out of each for the siblings, and replaced in each to fold another
leaf up to a root. Paths are handed down from the roots, so that each join meets at most 16 rows a key, whatever a
source's size. Leaves are numbered by one range sort of (source, doc_id, leaf); a source that lies in several partitions
is numbered through by the partitions' counts, one row each on the driver.

A null source is a source of its own and comes first, so does a null doc_id within its source (such a row is never
tampered with). Rows with the same source and doc_id are ordered by their leaves; repeated rows are leaves of their own
with equal digests, each with its own proof. A source of one row has that leaf as its root. Null and empty texts differ.
An empty table gives an empty result. Only the five named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import shuffle_partitions, stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a parent, and characters of a digest.
FAN, DIGEST = 16, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(*values: Column) -> Column:
    """Digest of the values, each with its length in bytes before it, `-` for null."""
    texts = [v.cast("string") for v in values]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``: their place (from 0) among the rows of their ``group``, ascending by ``order``, nulls first."""
    spark = rows.sparkSession
    # rows equal in all keys are spread by the row's place in the input: their order among themselves changes nothing
    keyed = rows.withColumn("_spread", F.monotonically_increasing_id())
    keys = [group, *order, "_spread"]
    schema = StructType([*keyed.drop("_spread").schema.fields, StructField("_part", IntegerType()), StructField("_at", LongType()), StructField("_pos", LongType()), StructField("_first", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, seen, run, first = None, 0, 0, 1
        for batch in batches:
            batch = batch.drop_columns(["_spread"])
            names = batch.column(group)
            pos, firsts = [], []
            for name in names.to_pylist():
                if seen and name != before:
                    run, first = 0, 0
                before = name
                pos.append(run)
                firsts.append(first)
                seen, run = seen + 1, run + 1
            at = pa.array(range(seen - len(pos), seen), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, at, pa.array(pos, pa.int64()), pa.array(firsts, pa.int64())], schema.names)

    n = shuffle_partitions(spark)
    ordered = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id())
    kept = stored(ordered.mapInArrow(count, schema))
    ends = kept.groupBy("_part").agg(F.min_by(F.struct(group), "_at").alias("head"), F.max_by(F.struct(group, "_pos", "_first"), "_at").alias("tail")).orderBy("_part").collect()
    carried, before, sofar = [], None, 0
    for r in ends:
        carry = sofar if before is not None and r["head"][0] == before[0] else 0
        carried.append((r["_part"], carry))
        before, sofar = r["tail"], r["tail"]["_pos"] + 1 + (carry if r["tail"]["_first"] else 0)
    # one row for each partition of the sort
    offsets = F.broadcast(spark.createDataFrame(carried, "_part int, _carry long"))
    return kept.join(offsets, "_part").withColumn("rank", F.col("_pos") + F.col("_first") * F.col("_carry")).drop("_part", "_at", "_pos", "_first", "_carry")


@dataclass
class Tree:
    """The parents of each level from the leaves up: (group, idx, children, preimage, top), stored.

    ``children`` are the rows below, with their place. ``top`` marks the group's only node of the level below: it isn't
    hashed again, its digest is the group's root. ``roots`` has (group, root).
    """

    levels: list[DataFrame]
    roots: DataFrame


def grow(rows: DataFrame, group: str, keep: list[str] = ()) -> Tree:
    """Trees over ``rows`` (group, rank, digest and the columns to ``keep`` in the lowest parents' children)."""
    levels, roots = [], None
    now = rows.select(group, "rank", "digest", *keep)
    while True:
        child = F.struct("rank", "digest", *(keep if not levels else []))
        packed = now.groupBy(group, F.expr(f"rank div {FAN}").alias("idx")).agg(F.array_sort(F.collect_list(child)).alias("children"))
        pre = F.array_join(F.transform("children", lambda c: c["digest"]), "")
        top = (F.col("idx") == 0) & (F.size("children") == 1)
        level = stored(packed.select(group, "idx", "children", pre.alias("preimage"), top.alias("top")))
        levels.append(level)
        done = level.where("top").select(group, F.col("preimage").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        if level.where("not top").isEmpty():
            return Tree(levels, roots)
        now = level.where("not top").select(group, F.col("idx").alias("rank"), digest(F.col("preimage")).alias("digest"))


def _slot(place: str) -> Column:
    return F.expr(f"cast({place} % {FAN} as int)")


PATH = "array<struct<preimage: string, slot: int>>"


def _step(preimage: str, place: str) -> Column:
    return F.array(F.struct(F.col(preimage).alias("preimage"), F.expr(f"cast({place} % {FAN} as int)").alias("slot")))


def with_paths(tree: Tree, group: str, above: DataFrame) -> DataFrame:
    """The members of the tree with ``path``: preimages and own slots of all parents above them, nearest first.

    ``above`` has a row for each group: its path from the group's root upwards, and columns handed down to all members.
    """
    handed = [c for c in above.columns if c not in (group, "path")]
    own = above.select(F.col(group).alias("_group"), F.col("path").alias("_above"), *handed)
    paths = None
    for level in reversed(tree.levels):
        # a node marked as top stands for its only child, the group's root: what is above it is the group's own path
        tops = level.where("top").join(own, F.col(group).eqNullSafe(F.col("_group"))).select(*level.columns, F.col("_above").alias("path"), *handed)
        if paths is not None:
            up = paths.select(F.col(group).alias("_group"), F.col("idx").alias("_idx"), F.col("preimage").alias("_preimage"), F.col("top").alias("_top"), F.col("path").alias("_above"), *handed)
            met = level.where("not top").join(up, F.col(group).eqNullSafe(F.col("_group")) & F.expr(f"idx div {FAN} = _idx"))
            path = F.when(F.col("_top"), F.col("_above")).otherwise(F.concat(_step("_preimage", "idx"), F.col("_above")))
            tops = tops.unionByName(met.select(*level.columns, path.alias("path"), *handed))
        paths = tops
    each = paths.select(group, "preimage", "top", F.col("path").alias("_above"), *handed, F.inline("children"))
    path = F.when(F.col("top"), F.col("_above")).otherwise(F.concat(_step("preimage", "rank"), F.col("_above")))
    return each.withColumn("path", path).drop("preimage", "top", "_above")


def siblings(path: Column) -> Column:
    """The digests beside the node, level by level, left to right, as one text."""

    def beside(p: Column) -> Column:
        return F.concat(F.substring(p["preimage"], F.lit(1), p["slot"] * DIGEST), F.substring(p["preimage"], p["slot"] * DIGEST + DIGEST + 1, F.length(p["preimage"])))

    return F.array_join(F.transform(path, beside), "")


def fold(start: Column, path: Column) -> Column:
    """The root that ``start`` gives in the leaf's place."""
    return F.aggregate(path, start, lambda acc, p: digest(F.overlay(p["preimage"], acc, p["slot"] * DIGEST + 1, F.lit(DIGEST))))


def manifest(docs: DataFrame, tampered: Column | None = None, changed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``docs``.

    Where ``tampered`` is true, the text ``changed`` takes the place of the text when the root is folded again.
    """
    values = [F.col(c) for c in FIELDS]
    other = leaf(*values[:-1], changed) if changed is not None else leaf(*values)
    moved = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    rows = docs.select("doc_id", "source", leaf(*values).alias("digest"), F.when(moved, other).alias("other"))
    tree = grow(numbered(rows, "source", ["doc_id", "digest"]), "source", ["doc_id", "other"])
    subroots = tree.roots.select(F.lit(0).alias("whole"), "source", F.col("root").alias("digest"))
    crown = grow(numbered(subroots, "whole", ["source"]), "whole", ["source"])
    tops = with_paths(crown, "whole", crown.roots.withColumn("path", F.array().cast(PATH))).select("source", "path", F.col("digest").alias("subroot"), "root")
    proven = with_paths(tree, "source", stored(tops)).withColumn("folded_root", fold(F.coalesce("other", "digest"), F.col("path")))
    return proven.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered_manifest(docs: DataFrame) -> DataFrame:
    """The manifest where every document whose crc32(doc_id) is divisible by 5 has been lower-cased (A-Z) meanwhile."""
    return manifest(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate(F.col("text"), UPPER, LOWER))

"""Prefix trie of conversations: range-sorted turn arrays, common prefixes of neighbours, a stack sweep into nodes.

A conversation is its turns' 128-bit digests in one binary key, so its prefixes are prefixes of the key. Keys are range-sorted
(equal ones by conv_id, so that copies spread over partitions), cut into blocks of bounded size, and each block is swept on its
own: neighbours' common prefixes open and close nodes on a stack. A node that is open across a block's edge leaves a part in
each block that it touches; parts are named by the block where their node began, which follows from the blocks' common
prefixes (three numbers a block on the driver), and are added up by Spark. Digests of members' ids are streamed in order.

Null role and text count as empty, rows of a conversation go by turn (null first), rows of equal turn by their digest. Rows
without conv_id are one conversation, not rebuilt, that counts as a member but isn't named by any id. Repeated rows are turns of
their own. An empty table gives an empty result. Only conv_id, turn, role and text are read. One conversation's digests
(16 bytes a turn) must fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Characters that separate words, as a regular expression.
WORD = r"[^\x20\x09-\x0D]+"
#: Conversations and turns of a block at most (a longer conversation is a block of its own).
ROWS, TURNS = 1 << 15, 1 << 18
#: Nodes across blocks that are broadcast at most; more are joined by a shuffle.
SPREAD = 200_000
SIZE = 16


def sequences(rows: DataFrame, by: Column | None = None) -> DataFrame:
    """(conv_id, turns): digest in hex and number of words of each turn, in order; ``by`` keeps related ones in one partition."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    turn = F.struct("turn", F.substring(F.sha2(named, 256), 1, 2 * SIZE).alias("digest"), F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))).cast("long").alias("words"))
    near = by if by is not None else F.col("conv_id")
    light = rows.select("conv_id", near.alias("near"), turn.alias("said")).repartition("near")
    turns = F.transform(F.sort_array(F.collect_list("said")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    return light.groupBy("near", "conv_id").agg(turns.alias("turns"))


def rebuilt(rows: DataFrame, family: int = 20, share: int = 4) -> DataFrame:
    """Conversations whose first crc32(conv_id) % ``share`` turns are those of the first of their ``family`` of ids."""
    first = F.col("conv_id") - F.col("conv_id") % family
    own = sequences(rows, first)
    heads = own.where("conv_id = near").select("near", F.slice("turns", 1, share - 1).alias("head"))
    kept = F.coalesce((F.crc32(F.col("conv_id").cast("string").cast("binary")) % share).cast("int"), F.lit(0))
    head = F.coalesce(F.slice("head", F.lit(1), kept), F.slice("turns", F.lit(1), F.lit(0)))
    rest = F.slice("turns", kept + 1, F.size("turns") + 1)
    return own.join(heads, "near", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def blocks(conversations: DataFrame, rows: int = ROWS, turns: int = TURNS) -> DataFrame:
    """Runs of the sorted conversations, each packed into one row: part, seq, ids, known, lens, keys, words, first, last."""
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key")
    flat = conversations.select("conv_id", key, F.transform("turns", lambda t: t["words"]).alias("words"))
    ordered = flat.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, held, size = 0, [], 0

        def block() -> pa.RecordBatch:
            ids = np.array([r[0] or 0 for r in held], np.int64)
            known = np.array([r[0] is not None for r in held])
            lens = np.array([len(r[1]) // SIZE for r in held], np.int32)
            words = np.concatenate([np.zeros(0, np.int64), *(np.array(r[2], np.int64) for r in held)])
            row = [held[0][3], seq, ids.tobytes(), known.tobytes(), lens.tobytes(), b"".join(r[1] for r in held), words.tobytes(), held[0][1], held[-1][1]]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, BLOCK_ARROW, strict=True)], schema=BLOCK_ARROW)

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "key", "words", "part")), strict=True):
                if held and (len(held) >= rows or size + len(r[2]) > turns):
                    yield block()
                    seq, held, size = seq + 1, [], 0
                held.append(r)
                size += len(r[2])
        if held:
            yield block()

    return stored(ordered.mapInArrow(pack, "part int, seq int, ids binary, known binary, lens binary, keys binary, words binary, first binary, last binary"))


BLOCK_ARROW = pa.schema([("part", pa.int32()), ("seq", pa.int32()), *((c, pa.binary()) for c in ("ids", "known", "lens", "keys", "words", "first", "last"))])


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common at their start."""
    n = min(len(a), len(b)) // SIZE
    one, two = (np.frombuffer(x[: n * SIZE], np.uint64).reshape(-1, 2) for x in (a, b))
    differ = np.flatnonzero((one != two).any(1))
    return int(differ[0]) if len(differ) else n


def edges(packed: DataFrame) -> list:
    """(part, seq, left, span) of all blocks in order: turns shared with the block before, and by the block's own ends."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last, before = (batch.column(c).to_pylist() for c in ("first", "last", "before"))
            left = [-1 if b is None else common(a, b) for a, b in zip(first, before, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("seq"), pa.array(left, pa.int32()), pa.array([common(a, b) for a, b in zip(first, last, strict=True)], pa.int32())], ["part", "seq", "left", "span"])

    # one row for each block, not for each conversation
    ends = packed.select("part", "seq", "first", "last").withColumn("before", F.lag("last").over(Window.orderBy("part", "seq")))
    return ends.mapInArrow(measure, "part int, seq int, left int, span int").orderBy("part", "seq").collect()


def prefixes(lens: np.ndarray, keys: bytes) -> np.ndarray:
    """For each row but the first: the turns it shares with the row before (0 for the first)."""
    turn = np.frombuffer(keys, np.uint64).reshape(-1, 2)
    at = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
    row = np.repeat(np.arange(len(lens)), lens)
    place = np.arange(len(turn)) - at[row]
    before = np.maximum(row - 1, 0)
    inside = (row > 0) & (place < lens[before])
    same = np.zeros(len(turn), bool)
    same[inside] = (turn[inside] == turn[(at[before] + place)[inside]]).all(1)
    shared = lens.astype(np.int64)
    np.minimum.at(shared, row[~same], place[~same])
    shared[:1] = 0
    return shared


class Node:
    __slots__ = ("depth", "began", "conv", "n", "children", "leaves", "saved", "words", "ends", "parent", "place", "conv_of")

    def __init__(self, depth: int, began: bool, words: int, parent: Node | None):
        self.depth, self.began, self.words, self.parent = depth, began, words, parent
        self.conv, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, []


def sweep(ids: np.ndarray, known: np.ndarray, lens: np.ndarray, keys: bytes, words: np.ndarray, left: int, right: int) -> Iterator[tuple[Node, bool]]:
    """All nodes of a block, with whether they go on into the block before or after; parents come after children.

    ``left`` and ``right`` are the turns shared with the neighbouring blocks, -1 where there is none. All numbers of a
    node are sums over its rows, so the parts in several blocks add up.
    """
    shared = prefixes(lens, keys)
    at = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
    stack: list[Node] = []

    def close(to: int, goes_on: int, exact: int) -> Iterator[tuple[Node, bool]]:
        while stack and stack[-1].depth > to:
            node = stack.pop()
            node.saved += node.words * (node.n - node.began)
            node.leaves += node.depth == exact and node.depth > goes_on
            up = node.parent
            if up is not None:
                up.n += node.n
                up.children += node.began
                up.leaves += node.leaves
                up.saved += node.saved
                if node.conv is not None and (up.conv is None or node.conv < up.conv):
                    up.conv = node.conv
            yield node, not node.began or node.depth <= goes_on

    for i in range(len(lens)):
        keep = int(shared[i]) if i else -1
        yield from close(keep, -1, int(lens[i - 1]) if i else -1)
        for d in range(keep + 1, int(lens[i]) + 1):
            began = i > 0 or d > left
            stack.append(Node(d, began, int(words[at[i] + d - 1]) if d else 0, stack[-1] if stack else None))
        node = stack[-1]
        node.n += 1
        if known[i]:
            own = int(ids[i])
            node.ends.append(own)
            if node.conv is None or own < node.conv:
                node.conv = own
    yield from close(-1, right, int(lens[-1]) if len(lens) else -1)


NODE = "whole boolean, block long, owner long, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent_owner long, parent_conv_id long, ends_sha256 string, ends binary"
_NAMES = [c.split()[0] for c in NODE.split(", ")]


def swept(packed: DataFrame, order: list) -> DataFrame:
    """Whole nodes, and parts of those that blocks share, by the block where they began (``owner``) and depth."""
    place = {(r["part"], r["seq"]): k for k, r in enumerate(order)}
    left = np.array([r["left"] for r in order], np.int64)
    through = np.minimum(left, np.array([r["span"] for r in order], np.int64))
    sent = packed.sparkSession.sparkContext.broadcast((place, left, through))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, left, through = sent.value
        for batch in batches:
            for r in batch.to_pylist():
                k = place[r["part"], r["seq"]]
                right = int(left[k + 1]) if k + 1 < len(left) else -1
                # a node of depth d that is open before this block began in the last block that it doesn't run through
                least = np.minimum.accumulate(through[:k][::-1])
                owners = k - 1 - np.searchsorted(-least, -np.arange(left[k] + 1), "right") if k else np.zeros(0, np.int64)
                array = lambda c, t: np.frombuffer(r[c], t)  # noqa: E731, B023
                out: list[tuple] = []
                nodes: list[Node] = []
                for node, part in sweep(array("ids", np.int64), array("known", bool), array("lens", np.int32), r["keys"], array("words", np.int64), int(left[k]), right):
                    node.place, node.conv_of = (None if not part else k if node.began else int(owners[node.depth])), node.conv
                    nodes.append(node)
                    text = ",".join(map(str, node.ends)).encode()
                    node.ends = text if part else hashlib.sha256(text).hexdigest()
                for node in nodes:
                    up, part = node.parent, node.place is not None
                    shared = up is not None and up.place is not None
                    ends = (None, node.ends or None) if part else (node.ends, None)
                    out.append((not part, k, node.place, node.depth, node.conv, node.n, node.children, node.leaves, node.saved, up.place if shared else None, up.conv if up is not None and not shared else None, *ends))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], _NAMES)

    return stored(packed.drop("first", "last").mapInArrow(run, NODE))


_TYPES = [{"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in NODE.split(", ")]


def streamed(parts: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256): digest of a node's ids, comma-joined over the blocks in order, one piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for owner, depth, ends in zip(*(batch.column(c).to_pylist() for c in ("owner", "depth", "ends")), strict=True):
                if (owner, depth) == at:
                    state.update(b",")
                else:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = (owner, depth), hashlib.sha256()
                state.update(ends)
            yield _digests(done)
        if at is not None:
            yield _digests([(*at, state.hexdigest())])

    pieces = parts.where("ends is not null").select("owner", "depth", "block", "ends")
    return pieces.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "block").mapInArrow(run, "owner long, depth long, ends_sha256 string")


def _digests(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["owner", "depth", "ends_sha256"])


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def nodes(conversations: DataFrame, rows: int = ROWS, turns: int = TURNS, spread: int = SPREAD) -> DataFrame:
    """A row for each distinct prefix of the conversations (conv_id, turns): its members, children, leaves and saved tokens."""
    packed = blocks(conversations, rows, turns)
    found = swept(packed, edges(packed))
    parts = found.where("not whole")
    sums = parts.groupBy("owner", "depth").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("parent_owner").alias("parent_owner"))
    joined = stored(sums.join(streamed(parts), ["owner", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))))
    above = joined.select(F.col("owner").alias("parent_owner"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("above"))
    near = F.broadcast(above) if joined.count() <= spread else above
    inner = found.where("whole and parent_owner is null").select(RESULT)
    outer = found.where("whole and parent_owner is not null").drop("parent_conv_id").select(*(c for c in RESULT if c != "parent_conv_id"), "parent_owner")
    open_ = joined.select(*(c for c in RESULT if c != "parent_conv_id"), "parent_owner")
    tied = outer.unionByName(open_).join(near, ["parent_owner", "depth"], "left").withColumnRenamed("above", "parent_conv_id")
    return inner.unionByName(tied.select(RESULT))

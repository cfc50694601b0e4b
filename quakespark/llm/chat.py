"""Chat formatting of reply trees.

Self-joins that double their reach find each leaf's root, length and sum of scores; branches are ranked by the sum of
their messages' scores (ties by the smaller leaf), the same joins read downwards enumerate the nodes of the chosen ones, and
each chosen path becomes one formatted conversation.

Template: each turn is ``<s>[role] text</s>``. Inside roles and texts a backslash becomes ``\\e``, ``<`` becomes
``\\l``, ``[`` becomes ``\\b`` and ``]`` becomes ``\\c``, so no marker can stand in them and the text can be read back.
Null roles and texts count as empty. Rows of one conversation with the same turn follow by role, then text.
Rows whose conv_id is null are one conversation, as in SQL's GROUP BY. An empty table gives an empty result; columns besides those
named are not read, so they can't clash. Messages whose parent is missing are roots. Messages that only reach themselves (cycles) have no root and aren't formatted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

# What the template escapes, and how.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"), ("]", "\\c"))


def escape(text: Column) -> Column:
    for plain, marked in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(marked))
    return text


def unescape(text: Column) -> Column:
    for plain, marked in reversed(ESCAPES):
        text = F.replace(text, F.lit(marked), F.lit(plain))
    return text


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join by equal keys, where a null conv_id equals a null conv_id; each key comes once, from the left."""
    other = right.withColumnsRenamed({k: f"{k}__right" for k in keys})
    on = [left[k].eqNullSafe(other[f"{k}__right"]) if k == "conv_id" else left[k] == other[f"{k}__right"] for k in keys]
    return left.join(other, on, how).drop(*(f"{k}__right" for k in keys))


def chain(rows: DataFrame) -> DataFrame:
    """(conv_id, node, parent, role, text, score) from (conv_id, turn, role, text): each row answers the one before it."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    return rows.withColumn("node", place).select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def climb(tree: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Leaves (conv_id, leaf, size, score), and for each r the nodes' ancestors 2^r steps up (conv_id, node, up).

    Each self-join doubles the reach and adds up sizes and scores, so rounds follow the logarithm of the depth and no row holds a path.
    """
    links = checkpoint(tree.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")))
    nodes = links.select("conv_id", F.col("node").alias("parent"), F.lit(True).alias("known"))
    inner = links.where("parent is not null").select("conv_id", "parent").distinct()
    state = join_null_safe(links, nodes, ["conv_id", "parent"], "left").select("conv_id", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("size"), "score")
    levels, open_before = [], None
    while True:
        state = checkpoint(state)
        still = state.where("up is not null").count()
        if not still or still == open_before:
            break
        open_before = still
        levels.append(state.where("up is not null").select("conv_id", "node", "up"))
        above = state.select("conv_id", F.col("node").alias("up"), F.col("up").alias("next"), F.col("size").alias("longer"), F.col("score").alias("more"))
        moved = join_null_safe(state.where("up is not null"), above, ["conv_id", "up"]).select("conv_id", "node", F.col("next").alias("up"), (F.col("size") + F.col("longer")).alias("size"), (F.col("score") + F.col("more")).alias("score"))
        state = moved.unionByName(state.where("up is null"))  # nodes that have reached a root rest
    leaves = join_null_safe(state.where("up is null"), inner.withColumnRenamed("parent", "node"), ["conv_id", "node"], "left_anti")
    return leaves.select("conv_id", F.col("node").alias("leaf"), "size", "score"), levels


def steps(branches: DataFrame, levels: list[DataFrame], keys: tuple[str, ...]) -> DataFrame:
    """(conv_id, keys, place, node): the nodes of each branch, from the root on.

    Each level, the highest first, adds to the nodes so far their ancestors that many steps up: every ancestor comes in once.
    """
    rows = branches.select("conv_id", *keys, "size", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("back"))
    for r in reversed(range(len(levels))):
        known = join_null_safe(rows, levels[r], ["conv_id", "node"], "left")
        both = F.array(F.struct("node", "back"), F.struct(F.col("up").alias("node"), (F.col("back") + (1 << r)).alias("back")))
        rows = known.select("conv_id", *keys, "size", F.inline(F.filter(both, lambda x: x.node.isNotNull())))
    return rows.select("conv_id", *keys, (F.col("size") - 1 - F.col("back")).alias("place"), "node")


def paths(tree: DataFrame) -> DataFrame:
    """(conv_id, leaf, path, score): the nodes from the root to each leaf. ``tree`` has conv_id, node, parent, score."""
    leaves, levels = climb(tree)
    held = steps(leaves, levels, ("leaf", "score")).groupBy("conv_id", "leaf", "score").agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("p"))
    return held.select("conv_id", "leaf", F.col("p.node").alias("path"), "score")


def best(branches: DataFrame, most: int = 1) -> DataFrame:
    """The ``most`` branches of each conversation with the highest scores, numbered from 1."""
    ranked = branches.withColumn("branch", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf")))
    return ranked.where(F.col("branch") <= most)


def render(tree: DataFrame, chosen: DataFrame) -> DataFrame:
    """(conv_id, branch, formatted, loss_spans): one text for each branch of ``chosen`` (conv_id, branch, place, node), and where its assistant texts stand.

    ``loss_spans`` holds start and length in code points of the formatted text.
    """
    turns = join_null_safe(chosen, tree.select("conv_id", "node", "role", "text"), ["conv_id", "node"])
    head = F.concat(F.lit("<s>["), escape(F.coalesce("role", F.lit(""))), F.lit("] "))
    turn = F.struct("place", head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"), (F.col("role") == "assistant").alias("loss"))
    rows = turns.groupBy("conv_id", "branch").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit("</s>"))), "")
    ends = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)").alias("spans")),
        lambda s, t: F.struct(
            (s.at + F.char_length(t.head) + F.char_length(t.body) + 4).alias("at"),
            F.when(F.coalesce(t.loss, F.lit(False)), F.concat(s.spans, F.array(F.struct((s.at + F.char_length(t.head)).cast("long").alias("start"), F.char_length(t.body).cast("long").alias("length"))))).otherwise(s.spans).alias("spans"),
        ),
    )
    return rows.select("conv_id", "branch", whole.alias("formatted"), ends.spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``turns`` (role, text) and ``loss_text`` to rows of (formatted, loss_spans)."""
    pieces = F.filter(F.split("formatted", "</s>"), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.struct(unescape(F.regexp_extract(p, r"(?s)^<s>\[([^\]]*)\] (.*)$", 1)).alias("role"), unescape(F.regexp_extract(p, r"(?s)^<s>\[([^\]]*)\] (.*)$", 2)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", (s.start + 1).cast("int"), s.length.cast("int")))), "")
    return formatted.withColumns({"turns": turns, "loss_text": loss})


def format_conversations(tree: DataFrame, most: int = 1) -> DataFrame:
    """The ``most`` best branches of each conversation of a reply tree, formatted."""
    tree = checkpoint(tree)
    leaves, levels = climb(tree)
    return render(tree, steps(best(leaves, most), levels, ("branch",)))

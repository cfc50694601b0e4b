"""Document fingerprints by winnowing, in DataFrame functions only.

A text's tokens are its runs of up to 16 non-space characters, and each character of longer runs (scripts without spaces, links),
so that what stands before a passage doesn't change its tokens. Each ``k`` consecutive tokens have a rolling
hash; of each ``window`` consecutive hashes the smallest is kept, the rightmost of equal ones, with its position.
Texts that share ``k + window - 1`` consecutive tokens share a kept hash. A text of fewer tokens has one hash of
all of them, and null, empty and blank texts have none. Equal texts have equal fingerprints. Repeated rows follow each other
like any; an empty table gives an empty result. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions

K, WINDOW = 5, 6
#: Base of the rolling hash, and grams that roll on in a run.
BASE, RUN = 3, 32
_POSITION = (1 << 31) - 1


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?<!\S)\S{1,16}(?!\S)|\S"), F.lit(0))


def _modulus(k: int) -> int:
    """So large that what the hash multiplies stays under 63 bits."""
    return (1 << (60 - (BASE ** (k - 1)).bit_length())) - 1


def gram_hashes(tokens: Column, k: int) -> Column:
    """For each place, 32 bits of its k-gram's rolling hash, then its position counted down, in one number.

    A gram's hash is the sum of its tokens' hashes times powers of ``BASE``, modulo ``_modulus``; the next gram's takes the
    first token's part out, moves the rest up and adds the new token. Runs of ``RUN`` grams roll on, each from its own first gram.
    A text of fewer than k tokens has one gram of all of them.
    """
    m, first = _modulus(k), BASE ** (k - 1)
    shift = m.bit_length() - 32
    hashed = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(m)))

    def rolled(hashes: Column, start: Column) -> Column:
        whole = F.aggregate(F.slice(hashes, start + 1, k), F.lit(0).cast("long"), lambda h, x: (h * BASE + x) % m)
        out = F.slice(hashes, start + 1, RUN - 1)
        new = F.slice(hashes, start + 1 + k, RUN - 1)
        steps = F.filter(F.zip_with(new, out, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda z: z.x.isNotNull())
        return F.aggregate(steps, F.array(whole), lambda done, z: F.concat(done, F.array(((F.element_at(done, -1) + m - z.y * first % m) * BASE + z.x) % m)))

    def rolled_all(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - k, F.lit(0)), F.lit(RUN))
        return F.flatten(F.transform(starts, lambda start: rolled(hashes, start)))

    # A let: the tokens are hashed once.
    packed = F.element_at(F.transform(F.array(F.struct(hashed.alias("h"))), lambda one: _packed(rolled_all(one.h), shift)), 1)
    return F.when(F.size(tokens) > 0, packed).otherwise(F.expr("cast(array() as array<bigint>)"))


def _packed(hashes: Column, shift: int) -> Column:
    return F.transform(hashes, lambda h, i: F.shiftleft(F.shiftright(h, shift), 31).bitwiseOR(F.lit(_POSITION) - i.cast("long")))


def minima(packed: Column, window: int) -> Column:
    """The smallest number of each window, each once: the smallest hash, rightmost of equal ones.

    The minimum of a window is that of two that overlap, of half the length or more: each pass lengthens all windows.
    """

    def longer(least: Column, by: int) -> Column:
        return F.filter(F.zip_with(least, F.slice(least, by + 1, F.greatest(F.size(least) - by, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.least(a, b))), lambda x: x.isNotNull())

    def running(least: Column, width: int) -> Column:
        if width >= window:
            return least
        by = min(width, window - width)
        return F.element_at(F.transform(F.array(F.struct(least.alias("v"))), lambda one: running(longer(one.v, by), width + by)), 1)

    return F.when(F.size(packed) > window, F.array_distinct(running(packed, 1))).when(F.size(packed) > 0, F.array(F.array_min(packed))).otherwise(packed)


def add_fingerprint(df: DataFrame, text: str, name: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """Add column ``name``: kept hashes with positions, packed."""
    made = df.withColumn("_tokens", tokens(F.coalesce(F.col(text), F.lit("")))).withColumn(name, gram_hashes(F.col("_tokens"), k))
    return made.withColumn(name, minima(F.col(name), window)).drop("_tokens")


def hash_set(packed: Column) -> Column:
    return F.array_distinct(F.transform(packed, lambda x: F.shiftrightunsigned(x, 31)))


def as_text(packed: Column) -> Column:
    """hash:position, by first window."""
    return F.array_join(F.transform(packed, lambda x: F.concat(F.lower(F.hex(F.shiftrightunsigned(x, 31))), F.lit(":"), (F.lit(_POSITION) - x.bitwiseAND(F.lit(_POSITION))).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes among all hashes of two sets; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def _place(key: Column) -> Column:
    """The number of the last start that isn't above ``key``, found in the list of runs, then in its run."""
    run = F.greatest(F.size(F.filter("_heads", lambda x: x <= key)), F.lit(1))
    return (run - 1) * F.col("_step") + F.size(F.filter(F.element_at("_runs", run), lambda x: x <= key)) - 1


def _ranges(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` with the number of their range of keys, whether they begin it, and how many ranges there are.

    About ``n`` ranges of equal size; a doc_id that fills several (null, for instance) is cut by the hash of the text.
    Each range begins with its first row's key, so none is empty. The starts are one row of two short lists.
    """
    spark = rows.sparkSession
    marks = rows.agg(F.percentile_approx("at", [i / n for i in range(n)], 100 * n)).first()[0] or []
    times = Counter(marks)
    guess = sorted((at, -(1 << 63) + (1 << 64) // k * j) for at, k in times.items() for j in range(k))

    def lists(starts: list[tuple[int, int]]) -> DataFrame:
        step = max(1, math.isqrt(len(starts)))
        runs = [starts[i : i + step] for i in range(0, len(starts), step)]
        return spark.createDataFrame([([r[0] for r in runs], runs, step, len(starts))], "_heads array<struct<at: long, h: long>>, _runs array<array<struct<at: long, h: long>>>, _step int, _ranges int")

    key = F.struct("at", "h")
    if not guess:
        return rows.select("*", F.lit(0).alias("bucket"), F.lit(True).alias("first"), F.lit(1).alias("ranges"))
    # one row for each range
    firsts = rows.crossJoin(F.broadcast(lists(guess))).groupBy(F.greatest(_place(key), F.lit(0)).alias("b")).agg(F.min(key).alias("k")).collect()
    placed = rows.crossJoin(F.broadcast(lists(sorted((r["k"]["at"], r["k"]["h"]) for r in firsts)))).withColumn("bucket", _place(key))
    start = F.element_at(F.element_at("_runs", F.floor(F.col("bucket") / F.col("_step")).cast("int") + 1), F.col("bucket") % F.col("_step") + 1)
    return placed.withColumn("first", start == key).withColumnRenamed("_ranges", "ranges").drop("_heads", "_runs", "_step")


def with_next(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, text, own, next_text, next_own): each row's fingerprint, and text and fingerprint of the row after it.

    Rows follow by doc_id (null first), then by the hash of their text; the first follows the last. Ranges of them are
    dealt out, each with the first rows of the range after it, so texts are shuffled once and no task holds all rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"at": F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")), "h": F.xxhash64("text")})
    n = shuffle_partitions(docs.sparkSession)
    rows = _ranges(rows, 8 * n)
    before = F.when(F.col("bucket") == 0, F.col("ranges") - 1).otherwise(F.col("bucket") - 1)
    to = lambda bucket, tail: F.struct(bucket.cast("int").alias("bucket"), F.lit(tail).alias("tail"))
    sent = F.when(F.col("first"), F.array(to(F.col("bucket"), False), to(before, True))).otherwise(F.array(to(F.col("bucket"), False)))
    dealt = rows.select("doc_id", "at", "h", "text", F.explode(sent).alias("to")).select("doc_id", "at", "h", "text", "to.*")
    dealt = add_fingerprint(dealt.repartition(n, "bucket"), "text", "own", k, window)
    order = Window.partitionBy("bucket").orderBy("tail", "at", "h", "text")
    after = F.lead(F.struct("text", "own")).over(order)
    return dealt.withColumn("after", after).where(~F.col("tail")).select("doc_id", "text", "own", F.col("after.text").alias("next_text"), F.col("after.own").alias("next_own"))


def compare_edits(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """For each row (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text's second half (rounded down) gives way to the first characters of the next document.
    """
    rows = with_next(docs, k, window)
    rows = rows.withColumn("n", F.char_length("text"))
    half = F.floor(F.col("n") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = add_fingerprint(rows.withColumn("edited", edited), "edited", "edited_own", k, window)
    rows = rows.withColumns({"own_set": hash_set(F.col("own")), "edited_set": hash_set(F.col("edited_own")), "next_set": hash_set(F.col("next_own"))})
    return rows.select("doc_id", F.col("n").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edited_own")).alias("edited_fingerprint"), likeness(F.col("own_set"), F.col("edited_set")).alias("near_edited"), likeness(F.col("own_set"), F.col("next_set")).alias("near_next"))

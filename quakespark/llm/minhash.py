"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Equal texts are one kind at once. Of each kind's ``K``-word shingles, labelled with their occurrence number, every
sketch keeps the ``KEEP`` smallest under its own hash, in text order; kinds that agree in a sketch share its bucket and
are candidates. Two texts link if the edit distance of their words, found within a band as wide as the threshold
allows, is at most (1 - threshold) of the longer one's words. Classes are what links connect.

K follows that threshold: an edit takes at most ``K`` shingles, so a word in five substituted at even distances leaves 0.6
of the pairs of words (and no shingle of five words), and all sketches miss such a text with a chance of 0.008. Under ``SHORT`` words
few pairs are left, so these texts have as many sketches of single words besides.

In a bucket of any size the smallest id leads, and all others are compared with it: one pair a member. Then members of
different classes are compared with each other, in blocks of bounded size, each two in the first bucket that
they share. Before texts are fetched, numbers of words and counts of words in ``BAG`` bins rule out what can't link.

Words are lower-cased (A-Z) runs of characters other than white space. Null texts count as empty; all empty and
blank texts that are equal are copies. A null doc_id belongs to no class and is kept. Repeated rows come back as often as
they stand; a doc_id with several texts belongs to the classes of each. An empty table gives an empty result. Only doc_id and text
are read, so other columns can't clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, stored
from .text import LOWER, grams, hashes, mix, utf8, words

K, SKETCHES, KEEP, THRESHOLD, SHORT = 2, 24, 2, 0.8, 64
#: Bins of word counts; members and words of a block at most; pairs of one lead that a task aligns, about.
BAG, BLOCK, WORDS, LED = 256, 1024, 1 << 19, 512
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, at = utf8(texts)
    data = LOWER[data]
    starts, ends, first = words(data, at)
    return hashes(data, starts, ends), first


def labelled(word: np.ndarray, first: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Each text's k-gram hashes with occurrence numbers mixed in, and where each text's begin; shorter texts have one."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    begin = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), count)
    place = first[:-1][doc] + np.arange(begin[-1]) - begin[:-1][doc]
    whole = grams(word, k)
    gram = whole[np.minimum(place, max(0, len(whole) - 1))] if len(whole) else np.zeros(len(place), np.uint64)
    for d in np.flatnonzero((n > 0) & (n < k)):
        gram[begin[d]] = grams(word[first[d] : first[d + 1]], int(n[d]))[0]
    key = gram + mix(doc.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    head = np.flatnonzero(new)
    number = np.arange(len(key)) - np.repeat(head, np.diff(np.append(head, len(key))))
    label = np.empty(len(key), np.uint64)
    label[order] = number.astype(np.uint64)
    return mix(gram + label * np.uint64(0x9E3779B97F4A7C15)), begin


def sketch(label: np.ndarray, begin: np.ndarray, sketches: int = SKETCHES, keep: int = KEEP) -> np.ndarray:
    """Row per text that has k-grams, column per sketch: a hash of the smallest labelled k-mers in text order."""
    head = begin[:-1][np.diff(begin) > 0]
    size = np.diff(np.append(head, len(label)))
    out = np.zeros((len(head), sketches), np.uint64)
    if not len(head):
        return out
    seeds = mix(np.arange(1, 2 * sketches + 1, dtype=np.uint64)) | np.uint64(1)
    for s in range(sketches):
        x = (label ^ seeds[sketches + s]) * seeds[s]
        chosen = np.full((len(head), keep), len(label))
        for j in range(keep):
            least = np.minimum.reduceat(x, head)
            hit = np.flatnonzero(x == np.repeat(least, size))
            row = np.searchsorted(head, hit, "right") - 1
            one = np.append(True, row[1:] != row[:-1])
            real = size[row[one]] > j
            chosen[row[one][real], j] = hit[one][real]
            x[hit] = _FULL
        chosen.sort(axis=1)
        padded = np.append(label, np.uint64(0))
        total = np.full(len(head), np.uint64(s + 1))
        for j in range(keep):
            total = mix(total * np.uint64(0xD6E8FEB86659FD93) + padded[chosen[:, j]])
        out[:, s] = total
    return out


def banded_distance(a: list, b: list, most: int) -> int:
    """Edit distance of two sequences, or ``most + 1`` if it is larger: bit vectors of a band of 2 * most + 2 cells."""
    if len(a) < len(b):
        a, b = b, a
    while b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    k = 0
    while k < len(b) and a[k] == b[k]:
        k += 1
    a, b = a[k:], b[k:]
    if len(a) - len(b) > most:
        return most + 1
    if not b:
        return len(a)
    most = min(most, len(a))
    m, n, width = len(a), len(b), 2 * most + 2
    full, top = (1 << width) - 1, 1 << (width - 1)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    up, down, now = full ^ ((1 << (width - most - 1)) - 1), 0, most
    start, across = most + 1 - width, top >> 1
    worst = 2 * most + n - m
    for i in range(n):
        bits = where.get(b[i], 0)
        x = ((bits >> start) if start >= 0 else (bits << -start)) & full
        diagonal = ((((x & up) + up) ^ up) | x | down) & full
        plus = down | (full ^ (diagonal | up))
        minus = diagonal & up
        if i < m - most:
            now += not diagonal & top
        else:
            now += bool(plus & across) - bool(minus & across)
            across >>= 1
        if now > worst:
            return most + 1
        up = minus | (full ^ ((diagonal >> 1) | plus))
        down = (diagonal >> 1) & plus
        start += 1
    return now if now <= most else most + 1


def alike(a: list, b: list, threshold: float = THRESHOLD) -> bool:
    """Whether the words' edit distance is at most (1 - threshold) of the longer sequence."""
    most = int(most_edits(max(len(a), len(b)), threshold))
    return banded_distance(a, b, most) <= most


def most_edits(n, threshold: float):
    return np.int64((1 - threshold) * n + 1e-9)


def signatures(rows: DataFrame) -> DataFrame:
    """(doc_id, digest, n, keys, bag) of rows of doc_id and text: words, sketch values, words by bin (at most 255)."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        word, first = _words(batch.column("text"))
        n = np.diff(first)
        few = (n > 0) & (n < SHORT)
        count = np.where(n > 0, SKETCHES, 0) + np.where(few, SKETCHES, 0)
        at = np.concatenate([[0], np.cumsum(count)])
        keys, slot = np.zeros(at[-1], np.uint64), np.arange(SKETCHES)
        keys[at[:-1][n > 0][:, None] + slot] = sketch(*labelled(word, first))
        keys[at[:-1][few][:, None] + SKETCHES + slot] = sketch(*labelled(word[np.repeat(few, n)], np.concatenate([[0], np.cumsum(n[few])]), 1))
        row = np.repeat(np.arange(len(n)), n)
        bag = np.bincount(row * BAG + (word % np.uint64(BAG)).astype(np.int64), minlength=len(n) * BAG)
        bags = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.arange(0, BAG * len(n) + 1, BAG, dtype=np.int32)), pa.py_buffer(np.minimum(bag, 255).astype(np.uint8))])
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys.view(np.int64)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(n.astype(np.int64)), lists, bags], ["doc_id", "digest", "n", "keys", "bag"])

    return arrow_map(rows, make, "doc_id long, digest binary, n long, keys array<long>, bag binary")


def _bags(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BAG).astype(np.int16)


def possible(pairs: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b, n_a, n_b, bag_a, bag_b) that may link.

    An edit changes the number of words by one at most, and takes one word from a bin and adds one to another.
    """

    def keep(batches):
        for batch in batches:
            n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            apart = np.abs(_bags(batch.column("bag_a")) - _bags(batch.column("bag_b"))).sum(1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(apart + np.abs(n - m) <= 2 * most_edits(np.maximum(n, m), threshold)))

    near = F.abs(F.col("n_a") - F.col("n_b")) <= F.floor((1 - threshold) * F.greatest("n_a", "n_b") + 1e-9)
    return pairs.where(near).mapInArrow(keep, "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, b) that link. ``texts`` is bucketed by doc_id; a's that many pairs have are dealt out."""
    parts = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / LED).alias("parts")))
    one = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts"))
    one = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    two = parts.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    two = two.select("a", "text_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    joined = one.join(two, ["a", "part"]).select("a", "b", "text_a", "text_b")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        (x, fx), (y, fy) = (_words(batch.column(c)) for c in ("text_a", "text_b"))
        x, y = x.tolist(), y.tolist()
        link = [alike(x[fx[i] : fx[i + 1]], y[fy[i] : fy[i + 1]], threshold) for i in range(batch.num_rows)]
        return batch.select(["a", "b"]).filter(pa.array(link, pa.bool_()))

    return arrow_map(joined, make, "a long, b long", column="text_b")


def untested(members: DataFrame, threshold: float, block: int = BLOCK, most_words: int = WORDS) -> DataFrame:
    """What is left to align: rows (g, doc_id, class, mates) of groups g, where each doc_id has its partners once.

    ``members`` has key, size, words (of all its members), lead, doc_id, n, class, keys, bag. The lead of a bucket has been compared with all; others of different classes
    that may link meet in the first bucket that they share. Crowded buckets are dealt into parts of bounded size,
    and each two parts meet in a group of their own, so that no group follows the bucket's size.
    """
    parts = F.ceil(F.greatest(F.col("size") / block, F.col("words") / most_words)).cast("int")
    dealt = members.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = dealt.withColumns({"p": F.least("part", "with"), "q": F.greatest("part", "with")})

    def pairs(group: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        key = np.int64(group[0].as_py())
        n, kind, doc, part, lead = (t.column(c).to_numpy() for c in ("n", "class", "doc_id", "part", "lead"))
        bag = _bags(t.column("bag"))
        lists = t.column("keys").combine_chunks()
        size, flat = np.diff(lists.offsets.to_numpy()), lists.values.to_numpy()[lists.offsets[0].as_py() :]
        keys = np.zeros((len(doc), 2 * SKETCHES), np.int64)
        keys[np.repeat(np.arange(len(doc)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat[: size.sum()]
        across = part.min() < part.max()
        mates: dict[int, list] = {}
        for i in np.flatnonzero(doc != lead):
            j = np.flatnonzero((kind != kind[i]) & (doc > doc[i]) & (doc != lead) & ((part != part[i]) | (not across)))
            most, length = most_edits(np.maximum(n[j], n[i]), threshold), np.abs(n[j] - n[i])
            j, most, length = (x[length <= most] for x in (j, most, length))
            j = j[np.abs(bag[j] - bag[i]).sum(1, dtype=np.int64) + length <= 2 * most]
            shared = (keys[j] == keys[i]) & (keys[i] != 0)
            j = j[(keys[i][shared.argmax(1)] == key) & shared.any(1)]
            if len(j):
                mates.setdefault(i, []).extend(doc[j].tolist())
                for x in j:
                    mates.setdefault(x, [])
        at = np.array(sorted(mates), np.int64)
        held = pa.array([mates[i] for i in at], pa.list_(pa.int64()))
        return pa.table({"g": t.column("g").take(pa.array(at)), "doc_id": pa.array(doc[at]), "class": pa.array(kind[at]), "mates": held})

    held = dealt.select("key", "p", "q", F.xxhash64("key", "p", "q").alias("g"), "part", "lead", "doc_id", "n", "class", "keys", "bag")
    return held.groupBy("key", "p", "q").applyInArrow(pairs, "g long, doc_id long, class long, mates array<long>")


def align_groups(rows: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) that connect what is linked, of rows (g, doc_id, class, mates, text): in each group pairs are aligned, the
    likeliest first, until they are of one class."""

    def links(t: pa.Table) -> pa.Table:
        word, first = _words(pa.concat_arrays(t.column("text").chunks))
        n, kind, doc = np.diff(first), t.column("class").to_numpy(), t.column("doc_id").to_numpy()
        places: dict[int, list[int]] = {}
        for i, d in enumerate(doc.tolist()):
            places.setdefault(d, []).append(i)
        pairs = sorted({(i, j) for i, mates in enumerate(t.column("mates").to_pylist()) for d in mates for j in places.get(d, [])})
        i, j = np.array(pairs, np.int64).reshape(-1, 2).T
        _, code = np.unique(word, return_inverse=True)
        seen = [np.unique(code[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
        count, apart = np.zeros(code.max(initial=0) + 1, np.int64), np.zeros(len(i), np.int64)
        for x in np.unique(i):
            w, c = seen[x]
            count[w] = c
            for at in np.flatnonzero(i == x):
                v, k = seen[j[at]]
                apart[at] = n[x] + n[j[at]] - 2 * np.minimum(count[v], k).sum()
            count[w] = 0
        most = most_edits(np.maximum(n[i], n[j]), threshold)
        up = {c: c for c in kind.tolist()}

        def root(c: int) -> int:
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        words = code.tolist()
        found = []
        for at in np.argsort(apart / np.maximum(most, 1), kind="stable"):
            x, y = i[at], j[at]
            if apart[at] + abs(n[x] - n[y]) > 2 * most[at]:
                continue
            a, b = root(kind[x]), root(kind[y])
            if a != b and banded_distance(words[first[x] : first[x + 1]], words[first[y] : first[y + 1]], int(most[at])) <= most[at]:
                up[max(a, b)] = min(a, b)
                found.append((doc[x], doc[y]))
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return rows.groupBy("g").applyInArrow(links, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, kept, digest) for each row: its class's smallest doc_id, and whether it is that document.

    ``digest`` is the SHA-256 of the row's text: a doc_id may stand for several texts, each with a class of its own.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    signed = stored(signatures(rows))
    kinds = stored(signed.where("doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "keys", "bag")).alias("x")).select("digest", "x.*"))
    bucketed = kinds.select("doc_id", "n", F.explode("keys").alias("key"))
    full = bucketed.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("words"), F.min("doc_id").alias("lead")).where("size > 1")
    led = stored(bucketed.select("doc_id", "key").join(full, "key"))
    known = stored(kinds.join(led.select("doc_id").distinct(), "doc_id", "left_semi"))
    # Only texts that have a candidate are shuffled, once.
    texts = stored(rows.join(known.select("doc_id", "digest"), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]), by="doc_id")
    signs = [known.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bag").alias(f"bag_{x}")) for x in ("a", "b")]
    pairs = led.where("lead < doc_id").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = stored(verify(stored(possible(pairs.join(signs[0], "a").join(signs[1], "b"), threshold)), texts, threshold))
    label = components(links)
    led = led.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("class", F.coalesce("component", "doc_id"))
    more = led.where("lead < doc_id").groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("key")
    rest = led.where("lead < doc_id").join(more, "key").join(known.select("doc_id", "n", "keys", "bag"), "doc_id")
    left = stored(untested(rest, threshold))
    links = stored(links.unionByName(align_groups(left.join(texts.select("doc_id", "text"), "doc_id"), threshold)))
    label = components(links)
    classes = kinds.select("digest", F.col("doc_id").alias("first")).join(label.withColumnRenamed("node", "first"), "first", "left").select("digest", F.coalesce("component", "first").alias("class_id"))
    out = signed.select("doc_id", "digest").join(classes, "digest", "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)).alias("kept"), "digest")

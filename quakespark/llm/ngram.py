"""Interpolated modified Kneser-Ney bigram model, counted in Spark, looked up in memory-mapped sorted hash arrays.

Tokens are lower-cased (A-Z) words and one end for each text; a start precedes the first word. Counts leave the
tasks as packed arrays, dealt out by the history's hash, those of very frequent histories by the pair's hash.
Each group of arrays becomes one file in the shared folder: sorted 64-bit hashes and their counts. Workers map
the files; where the shared folder isn't a local path they keep one copy for their lifetime.
Null and empty texts are one end token. Repeated rows count each. Without training rows every token is unknown.
An empty table gives an empty result. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import atexit
import functools
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checkpoint, fold, shared_dir, shuffle_partitions
from .text import LOWER, hashes, mix, slices, utf8, words

START, END = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_TOP = np.uint64(32)
#: Bytes of text that are counted at once, pairs of which one packed array is made at most, and tokens behind a shard.
SLICE, FLUSH, PER_SHARD = 1 << 20, 1_500_000, 1_000_000


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, a start before each text's, and the place of each text's start (one entry more)."""
    data, at = utf8(texts)
    data = LOWER[data]
    starts, ends, first = words(data, at)
    docs = len(texts)
    place = first + 2 * np.arange(docs + 1)
    out = np.empty(len(starts) + 2 * docs, np.uint64)
    doc = np.repeat(np.arange(docs), np.diff(first))
    out[np.arange(len(starts)) + 2 * doc + 1] = hashes(data, starts, ends)
    out[place[:-1]] = START
    out[place[1:] - 1] = END
    return out, place


def pair_hash(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(history * np.uint64(0x9E3779B97F4A7C15) + word)


def shard_of(word: np.ndarray, shards: int) -> np.ndarray:
    return ((word >> _TOP).astype(np.int64) * shards) >> 32


def among(values: np.ndarray, sorted_list: np.ndarray) -> np.ndarray:
    if not len(sorted_list):
        return np.zeros(len(values), bool)
    return sorted_list[np.minimum(np.searchsorted(sorted_list, values), len(sorted_list) - 1)] == values


def pair_shard(history: np.ndarray, pair: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    return shard_of(np.where(among(history, hot), pair, history), shards)


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _unique_sum(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(n, head) if len(head) else n


def _pack(history: np.ndarray, word: np.ndarray, n: np.ndarray) -> bytes:
    """Histories (sorted) once with their numbers of words, words and counts."""
    head = np.flatnonzero(np.append(True, history[1:] != history[:-1]))
    runs, n = _small(np.diff(np.append(head, len(history)))), _small(n)
    parts = [history[head].tobytes(), runs.tobytes(), word.tobytes(), n.tobytes()]
    return json.dumps([len(head), runs.dtype.str, len(word), n.dtype.str]).encode().ljust(64) + b"".join(parts)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    heads, run_type, length, n_type = json.loads(data[:64])
    at = 64
    out = []
    for count, kind in ((heads, "<u8"), (heads, run_type), (length, "<u8"), (length, n_type)):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    return np.repeat(out[0], out[1]), out[2], out[3].astype(np.int64)


def _save(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Write a file whole or not at all, so that a task that runs again does no harm."""
    store, path = fs.FileSystem.from_uri(folder)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode().ljust(256))
        for a in arrays:
            out.write(a.tobytes())
            out.write(b"\0" * (-a.nbytes % 8))
    store.move(part, f"{path}/{name}")


@functools.lru_cache(4)
def _local(folder: str) -> str:
    store, path = fs.FileSystem.from_uri(folder)
    if isinstance(store, fs.LocalFileSystem):
        return path
    own = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, own, True)
    fs.copy_files(folder, own)
    return own


@functools.lru_cache(100_000)
def _mapped(folder: str, name: str) -> list[np.ndarray] | None:
    path = f"{_local(folder)}/{name}"
    if not os.path.exists(path):
        return None
    data = np.memmap(path, np.uint8, "r")
    at, out = 256, []
    for kind, n in json.loads(bytes(data[:256])):
        size = np.dtype(kind).itemsize * n
        out.append(data[at : at + size].view(kind))
        at += size + -size % 8
    return out


def _look_up(folder: str, kind: str, shard: np.ndarray, key: np.ndarray, columns: int) -> list[np.ndarray]:
    """Values of the keys in their shards' arrays; 0 for keys that aren't there."""
    order = np.lexsort((key, shard))
    found = [np.zeros(len(key)) for _ in range(columns)]
    sorted_shard = shard[order]
    bounds = np.flatnonzero(np.append(True, sorted_shard[1:] != sorted_shard[:-1])) if len(order) else []
    for a, b in zip(bounds, [*bounds[1:], len(order)], strict=True):
        arrays = _mapped(folder, f"{kind}-{sorted_shard[a]}")
        if arrays is None or not len(arrays[0]):
            continue
        at = order[a:b]
        place = np.minimum(np.searchsorted(arrays[0], key[at]), len(arrays[0]) - 1)
        hit = arrays[0][place] == key[at]
        for f, values in zip(found, arrays[1:], strict=True):
            f[at[hit]] = values[place[hit]]
    return found


@dataclass
class Model:
    folder: str
    shards: int
    hot: np.ndarray
    tokens: int
    types: int
    start_count: int
    start_gamma: float
    discounts: list[float]
    unknown: float


#: Discounts where the counts of counts give none between 0 and the count.
PLAIN = (0.5, 1.0, 1.5)


def discounts(n: list[int]) -> list[float]:
    """What is taken from counts of 1, 2, and 3 or more, given how many n-grams have counts 1 to 4.

    An estimate that isn't above 0 and below its count gives way to a plain discount, as repeated texts leave few small
    counts: every history keeps some chance for words it has not been seen with, so no chance is 0.
    """
    n1, n2, n3, n4 = (max(0, x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    rough = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [d if 0 < d < k else plain for k, (d, plain) in enumerate(zip(rough, PLAIN, strict=True), 1)]


def train(docs: DataFrame, shards: int | None = None) -> Model:
    """Count ``docs`` (doc_id, text) and write the arrays into a folder of their own in the shared folder."""
    spark = docs.sparkSession
    base = shared_dir(spark)
    folder = f"{base if '://' in base else 'file://' + os.path.abspath(base)}/ngram-{uuid.uuid4().hex}"
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    rows = docs.select("text")

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, size, texts = [], [], 0, 0
        give = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["w", "n"])
        for batch in slices(batches, limit=SLICE):
            seq, place = tokens(batch.column(0))
            texts += batch.num_rows
            k, n = np.unique(seq, return_counts=True)
            keys.append(k)
            sums.append(n.astype(np.int64))
            size += len(k)
            if size > FLUSH:
                yield give(*_unique_sum(np.concatenate(keys), np.concatenate(sums)))
                keys, sums, size = [], [], 0
        if keys:
            yield give(*_unique_sum(np.concatenate(keys), np.concatenate(sums)))

    counted = checkpoint(rows.mapInArrow(count_words, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    start = int(START.view(np.int64))
    real = counted.where(F.col("w") != start)
    n_tokens, n_types = real.agg(F.sum("n"), F.count("*")).first()
    n_tokens = n_tokens or 0
    # By tokens, so that what one task gathers doesn't grow with the corpus.
    shards = shards or max(2 * shuffle_partitions(spark), -(-n_tokens // PER_SHARD))
    # So frequent that a shard would be uneven; fewer than 4 * shards words can be.
    often = counted.where(F.col("n") >= max(1.0, n_tokens / (4 * shards))).select("w").collect()
    hot = np.sort(np.array([r[0] for r in often], np.int64).view(np.uint64))

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def give() -> pa.RecordBatch:
            h, w, n = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((w, h))
            h, w, n = h[order], w[order], n[order]
            head = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])))
            h, w, n = h[head], w[head], np.add.reduceat(n, head)
            shard = pair_shard(h, pair_hash(h, w), hot, shards)
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            full = [s for s in range(shards) if bounds[s] < bounds[s + 1]]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([_pack(*(x[order[bounds[s] : bounds[s + 1]]] for x in (h, w, n))) for s in full], pa.binary())], ["shard", "packed"])

        for batch in slices(batches, limit=SLICE):
            seq, place = tokens(batch.column(0))
            inner = np.ones(len(seq), bool)
            inner[place[1:] - 1] = False
            at = np.flatnonzero(inner)
            h, w = seq[at], seq[at + 1]
            key = pair_hash(h, w)
            _, first, n = np.unique(key, return_index=True, return_counts=True)
            held.append((h[first], w[first], n.astype(np.int64)))
            size += len(first)
            if size > FLUSH:
                yield give()
                held, size = [], 0
        if size:
            yield give()

    def write_pairs(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, w, n = (np.concatenate(x) for x in zip(*(_unpack(p) for b in parts for p in b.column("packed").to_pylist()), strict=True))
        pair = pair_hash(h, w)
        order = np.argsort(pair)
        pair, h, w, n = pair[order], h[order], w[order], n[order]
        head = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        pair, h, w, n = pair[head], h[head], w[head], np.add.reduceat(n, head)
        _save(folder, f"pair-{key[0].as_py()}", [pair, _small(n)])
        who, code = np.unique(h, return_inverse=True)
        after, code_after = np.unique(w, return_inverse=True)
        by = [np.bincount(code, c, len(who)).astype(np.int64) for c in (n == 1, n == 2, n >= 3)]
        by_after = np.bincount(code_after, minlength=len(after)).astype(np.int64)
        none, none_after = np.zeros(len(who), np.int64), np.zeros(len(after), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([who, after]).view(np.int64))] + [pa.array(np.concatenate([x, none_after])) for x in by] + [pa.array(np.concatenate([none, by_after])), pa.array(np.full(len(who) + len(after), -1, np.int32))], ["w", "n1", "n2", "n3", "before", "of"])
        kinds = np.array([(n == c).sum() for c in (1, 2, 3, 4)], np.int64)
        zero = np.zeros(4, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(zero), pa.array(kinds), pa.array(zero), pa.array(zero), pa.array(zero), pa.array(np.arange(1, 5, dtype=np.int32))], ["w", "n1", "n2", "n3", "before", "of"])

    stats = checkpoint(rows.mapInArrow(count_pairs, "shard int, packed binary").groupBy("shard").applyInArrow(write_pairs, "w long, n1 long, n2 long, n3 long, before long, of int").groupBy("w", "of").agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "n3", "before"))))
    of = dict(stats.where("of > 0").select("of", "n1").collect())
    d = discounts([of.get(k, 0) for k in (1, 2, 3, 4)])
    stats = stats.where("of < 0").drop("of")
    kinds = stats.where(F.col("before") > 0).agg(F.sum("before"), *(F.count(F.when(F.col("before") == k, 1)) for k in (1, 2, 3, 4)), F.count(F.when(F.col("before") >= 3, 1))).first()
    pairs, d1 = kinds[0] or 0, discounts([*kinds[1:5]])
    spare = (d1[0] * kinds[1] + d1[1] * kinds[2] + d1[2] * kinds[5]) / pairs if pairs else 1.0
    unknown = spare / (n_types + 1)
    lower = F.when(F.col("before") >= 3, F.col("before") - d1[2]).when(F.col("before") == 2, F.lit(2 - d1[1])).when(F.col("before") == 1, F.lit(1 - d1[0])).otherwise(0.0) / float(pairs or 1) + unknown
    left = (F.col("n1") * d[0] + F.col("n2") * d[1] + F.col("n3") * d[2]) / F.col("n")
    table = counted.join(stats, "w", "left").na.fill(0, ["n1", "n2", "n3", "before"]).select("w", "n", lower.alias("lower"), left.alias("gamma"))
    first = table.where(F.col("w") == start).select("n", "gamma").first()
    # The word's top 32 bits choose its shard.
    shard = F.shiftright(F.shiftrightunsigned("w", 32) * shards, 32).cast("int")

    def write_words(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        w = t.column("w").to_numpy().view(np.uint64)
        order = np.argsort(w)
        _save(folder, f"word-{key[0].as_py()}", [w[order]] + [t.column(c).to_numpy()[order] for c in ("n", "lower", "gamma")])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32())})

    table.where(F.col("w") != start).withColumn("shard", shard).groupBy("shard").applyInArrow(write_words, "shard int").count()
    return Model(folder, shards, hot, n_tokens, n_types, first[0] if first else 0, first[1] if first else 1.0, d, unknown)


def log_chances(model: Model, seq: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token but the starts: its training count, and the log10 of its chance after the token before it."""
    later = np.ones(len(seq), bool)
    later[place[:-1]] = False
    at = np.flatnonzero(later)
    known, code = np.unique(seq, return_inverse=True)
    count, lower, gamma = _look_up(model.folder, "word", shard_of(known, model.shards), known, 3)
    lower[count == 0] = model.unknown
    as_history = count.copy()
    i = np.searchsorted(known, START)
    if i < len(known) and known[i] == START:
        as_history[i], gamma[i] = model.start_count, model.start_gamma
    h, w = code[at - 1], code[at]
    pair = pair_hash(seq[at - 1], seq[at])
    (n,) = _look_up(model.folder, "pair", pair_shard(seq[at - 1], pair, model.hot, model.shards), pair, 1)
    cut = np.array([0.0, *model.discounts])[np.minimum(n, 3).astype(np.int64)]
    total = as_history[h]
    with np.errstate(divide="ignore", invalid="ignore"):
        chance = np.where(total > 0, (n - cut) / total + gamma[h] * lower[w], lower[w])
    return count[w], np.log10(chance)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = sent.value
        seq, place = tokens(batch.column("text"))
        count, chance = log_chances(own, seq, place)
        rows = batch.num_rows
        n = np.diff(place) - 1
        doc = np.repeat(np.arange(rows), n)
        base = np.bincount(doc, np.log10((count + 1) / (own.tokens + own.types + 1)), rows)
        total = np.bincount(doc, chance, rows)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(n.astype(np.int64)), pa.array(np.bincount(doc, count > 0, rows).astype(np.int64)), pa.array(np.full(rows, own.tokens, np.int64)), pa.array(base), pa.array(total), pa.array(10 ** np.minimum(-total / n, 300))], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold("doc_id", 7) == 2, F.lit(False)).alias("held_out"), "text")
    return arrow_map(rows, make, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")

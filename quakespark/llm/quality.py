"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Words are runs of letters and digits or runs of other characters; a text's features are its words and pairs of
neighbouring words, hashed into ``2 ** BITS`` buckets; pairs of equal words, and triples whose ends are equal, are one
feature, whatever the word. A feature's value is the logarithm of 1 + its count, divided by the length of the text's vector. Training rows are dealt into shards
by a hash; each shard is gone through in a fixed order with per-coordinate updates, shards' states are averaged over the
shards that touched a bucket, and the next pass goes on from there. With one shard that is the sequential method. Sums
are of whole numbers, so a repeated task changes no bit.

Fitted on the labelled rows of at most ``MOST_LABELLED`` ids (by the hash of their id). Every text is scored. Null and
empty texts have no feature and get the bias's score. An id with several labels counts with the largest; a row
repeated with its text counts once in training and is scored each time. Without labels every score is 0.5. An empty table
gives an empty result. Only doc_id and text, and doc_id and the label, are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, fold, stored
from .text import SPACE, hashes, mix, utf8

#: Ids of labelled rows that the weights are fitted on at most; bytes of their text behind a shard.
MOST_LABELLED, SHARD = 20_000, 4 << 20
#: Buckets (as a power of two), passes, and the update's step, smoothing and penalties.
BITS, PASSES, ALPHA, BETA, L1, L2 = 20, 5, 10.0, 1.0, 0.1, 0.01
#: Classes of bytes: 0 white space, 1 letters, digits and bytes of multi-byte characters, 2 others.
CLASS = np.full(256, 2, np.uint8)
CLASS[SPACE] = 0
CLASS[ord("0") : ord("9") + 1] = CLASS[ord("A") : ord("Z") + 1] = CLASS[ord("a") : ord("z") + 1] = CLASS[128:] = 1
SAME, PAIR = np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x9FB21C651E98DF25)
_FIXED = float(1 << 32)


def runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of one class start and end, and the number of each text's first run (one entry more)."""
    kind = CLASS[data]
    edge = np.ones(len(data) + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[at[at < len(data)]] = True
    cut = np.flatnonzero(edge)
    used = kind[cut[:-1]] > 0 if len(data) else np.zeros(0, bool)
    starts = cut[:-1][used]
    return starts, cut[1:][used], np.searchsorted(starts, at)


def features(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and counts of all texts' n-grams, and where each text's begin (one entry more)."""
    data, at = utf8(texts)
    starts, ends, first = runs(data, at)
    word = hashes(data, starts, ends)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    near = text[1:] == text[:-1]
    pair = np.where(word[1:] == word[:-1], SAME, mix(word[:-1] * PAIR + word[1:]))[near]
    again = np.flatnonzero((word[2:] == word[:-2]) & (text[2:] == text[:-2]))
    bucket = np.concatenate([word, pair, np.full(len(again), SAME)]) >> np.uint64(64 - bits)
    both = np.concatenate([text, text[1:][near], text[again]]).astype(np.uint64) << np.uint64(bits) | bucket
    found, count = np.unique(both, return_counts=True)
    begins = np.searchsorted(found, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(bits))
    return (found & np.uint64((1 << bits) - 1)).astype(np.int64), count, begins


def values(count: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    x = np.log1p(count.astype(np.float64))
    return x / np.sqrt(np.maximum(np.bincount(text, x * x, n), 1e-300))[text]


@dataclass
class Model:
    """A weight for each bucket and the bias."""

    weight: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        bucket, count, begins = features(texts, len(self.weight).bit_length() - 1)
        text = np.repeat(np.arange(len(texts)), np.diff(begins))
        z = self.bias + np.bincount(text, values(count, text, len(texts)) * self.weight[bucket], len(texts))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def weights(z: np.ndarray, n: np.ndarray, l1: np.ndarray | float = L1, l2: float = L2) -> np.ndarray:
    """The regularised leader's weights for summed gradients ``z`` and summed squares ``n``."""
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + l2))


def learn(z: np.ndarray, n: np.ndarray, rows: Iterator[tuple[np.ndarray, np.ndarray, int]]) -> None:
    """Go through rows (buckets, values, label), updating ``z`` and ``n`` in place; the last entry is the bias, without penalty."""
    for bucket, value, label in rows:
        i = np.append(bucket, len(z) - 1)
        x = np.append(value, 1.0)
        penalty = np.full(len(i), L1)
        penalty[-1] = 0.0
        w = weights(z[i], n[i], penalty)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -500, 500))) - label) * x
        grown = n[i] + g * g
        z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / ALPHA * w
        n[i] = grown


def shards(docs: DataFrame, labels: DataFrame, column: str, most: int, shard: int, bits: int) -> DataFrame:
    """The training rows' features, one packed row for each shard, in a fixed order."""
    marked = labels.select("doc_id", F.col(column).alias("mark")).where("doc_id is not null and mark is not null").where(fold("doc_id", 5) != 0)
    chosen = marked.groupBy("doc_id").agg((F.max("mark") > 0).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text", F.xxhash64("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("row"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + size // shard

    def vectors(batch: pa.RecordBatch) -> pa.RecordBatch:
        bucket, count, begins = features(batch.column("text"), bits)
        pack = lambda a, t: pa.array([a[i:j].astype(t).tobytes() for i, j in zip(begins[:-1], begins[1:], strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("label"), batch.column("row"), pack(bucket, np.uint32), pack(count, np.uint32)], ["label", "row", "bucket", "count"])

    def gather(group: pa.Table) -> pa.Table:
        got = group.sort_by([("row", "ascending"), ("label", "ascending")]).to_pylist()
        got = [r for k, r in enumerate(got) if not k or r["row"] != got[k - 1]["row"]]
        lens = np.array([len(r["bucket"]) // 4 for r in got], np.int64)
        return pa.table({"label": [bytes(r["label"] for r in got)], "lens": [lens.tobytes()], "bucket": [b"".join(r["bucket"] for r in got)], "count": [b"".join(r["count"] for r in got)]})

    once = rows.groupBy("row").agg(F.max("label").alias("label"), F.first("text").alias("text"))
    made = arrow_map(once, vectors, "label int, row long, bucket binary, count binary").withColumn("shard", F.pmod("row", F.lit(n)))
    return stored(made.groupBy("shard").applyInArrow(gather, "label binary, lens binary, bucket binary, count binary"))


def _rows(r: dict) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    at = np.concatenate([[0], np.cumsum(np.frombuffer(r["lens"], np.int64))])
    bucket, count = np.frombuffer(r["bucket"], np.uint32), np.frombuffer(r["count"], np.uint32)
    for k, label in enumerate(r["label"]):
        own = count[at[k] : at[k + 1]]
        yield bucket[at[k] : at[k + 1]].astype(np.int64), values(own, np.zeros(len(own), np.int64), 1), label


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", most_labelled: int = MOST_LABELLED, shard: int = SHARD, bits: int = BITS, passes: int = PASSES) -> Model:
    """Fit on labelled rows whose crc32(doc_id) mod 5 isn't 0.

    Each pass is one Spark job over the shards; its result, a sum for each touched bucket, is as large as the model at most.
    """
    packed = shards(docs, labels, column, most_labelled, shard, bits)
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    for _ in range(passes):
        sent = packed.sparkSession.sparkContext.broadcast((z, n))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    z, n = (a.copy() for a in sent.value)
                    learn(z, n, _rows(r))
                    moved = np.flatnonzero((z != sent.value[0]) | (n != sent.value[1]))
                    fixed = lambda new, old, at=moved: pa.array(np.rint((new[at] - old[at]) * _FIXED).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(moved), fixed(z, sent.value[0]), fixed(n, sent.value[1])], ["at", "z", "n"])

        sums = packed.mapInArrow(run, "at long, z long, n long").groupBy("at").agg(F.sum("z").alias("z"), F.sum("n").alias("n"), F.count("*").alias("of")).toArrow()
        at, of = sums["at"].to_numpy(), sums["of"].to_numpy()
        z[at] += sums["z"].to_numpy() / _FIXED / of
        n[at] += np.maximum(sums["n"].to_numpy() / _FIXED / of, 0)
        sent.unpersist()
    return Model(weights(z[:-1], n[:-1]).astype(np.float32), float(weights(z[-1:], n[-1:], 0.0)[0]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row: the chance of label 1, from a sparse dot product."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.scores(batch.column("text")))], ["doc_id", "score"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, score double")

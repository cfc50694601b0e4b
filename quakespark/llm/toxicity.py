"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, trained from document labels.

A sentence's score is the logistic of a bias and its words' weights; a text's score is the chance that
at least one sentence is toxic. Weights are fitted on a bounded sample of labelled texts (``most_labelled``,
chosen by a hash of the id), every text is scored. Null and empty texts have no sentence and score 0.
A doc_id with several labels counts with the largest; repeated rows are scored each on its own. Without labels every
sentence has the same small score. An empty table gives an empty result. ``score`` reads doc_id and text only, ``drop`` hands on all
columns whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checkpoint, fold
from .text import LOWER, NOT_LETTER, hashes, utf8, words

#: Labelled texts that the weights are fitted on at most, and how strongly a word must speak for the label to get a weight.
MOST_LABELLED, LEAST_SURPRISE = 12000, 13.0
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


def sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all words of the texts: hash and number of the sentence; for each sentence: text, first and last code point."""
    data, at = utf8(texts)
    starts, ends, first = words(data, at, NOT_LETTER)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    stops = np.cumsum(_STOP[data])[starts] if len(starts) else np.zeros(0, np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(stops) != 0) | (np.diff(text) != 0)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(starts))[: len(head)] - 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    begin = chars[at[:-1]][text[head]]
    return hashes(LOWER[data], starts, ends), np.cumsum(new) - 1, text[head], chars[starts[head]] - begin, chars[ends[tail]] - begin


@dataclass
class Model:
    """Weights of words by their sorted hashes; other words weigh nothing."""

    known: np.ndarray
    weight: np.ndarray
    bias: float

    def sentence_scores(self, word: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, word), max(0, len(self.known) - 1))
        weight = np.where(self.known[at] == word, self.weight[at], 0.0) if len(self.known) else np.zeros(len(word))
        z = self.bias + np.bincount(sentence, weight, n)
        return 1 / (1 + np.exp(-z))


def surprise(with_label: np.ndarray, without: np.ndarray, n_with: int, n_without: int) -> np.ndarray:
    """Likelihood-ratio statistic of each word's texts with and without the label; 0 where the word speaks against it."""
    n, seen = max(1, n_with + n_without), with_label + without

    def part(count: np.ndarray, total: np.ndarray, texts: int) -> np.ndarray:
        expected = total * texts / n
        return np.where(count > 0, count * np.log(np.maximum(count, 1) / np.maximum(expected, 1e-300)), 0.0)

    g = part(with_label, seen, n_with) + part(without, seen, n_without) + part(n_with - with_label, n - seen, n_with) + part(n_without - without, n - seen, n_without)
    return np.where(with_label * n_without > without * n_with, 2 * g, 0.0)


def fit(known: np.ndarray, code: np.ndarray, sentence: np.ndarray, text: np.ndarray, plain: np.ndarray, label: np.ndarray, rounds: int = 300, rate: float = 0.1, shrink: float = 0.002) -> Model:
    """Adam with weight decay on the likelihood of the labels under noisy-or.

    ``known`` are the words that get weights, ``code`` numbers of words in texts, ``sentence`` their sentences,
    ``text`` each sentence's text. ``plain`` is each text's number of sentences without such words, ``label`` its 0 or 1.
    """
    n_texts, n_sentences, bias = len(label), len(text), len(known)
    positive = label == 1
    w, m, v = np.zeros(bias + 1), np.zeros(bias + 1), np.zeros(bias + 1)
    w[bias] = -6
    for step in range(1, rounds + 1):
        z = np.clip(w[bias] + np.bincount(sentence, w[code], n_sentences), -30, 30)
        p = 1 / (1 + np.exp(-z))
        alone = np.clip(w[bias], -30, 30)
        total = np.bincount(text, np.logaddexp(0, z), n_texts) + plain * np.logaddexp(0, alone)
        slope = np.where(positive, -1 / np.expm1(np.maximum(total, 1e-6)), 1.0) / max(1, n_texts)
        own = slope[text] * p
        grad = np.append(np.bincount(code, own[sentence], bias), own.sum() + (slope * plain).sum() / (1 + np.exp(-alone)))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w[:bias] *= 1 - rate * shrink
    return Model(known, w[:bias], float(w[bias]))


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> Model:
    """Fit on labelled rows whose crc32(doc_id) mod 5 isn't 0: at most ``most_labelled``, by the hash of their id.

    Words' texts are counted in Spark; only occurrences of words that speak for the label reach the driver.
    """
    marked = labels.where("doc_id is not null and toxic is not null").where(fold("doc_id", 5) != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled)
    rows = checkpoint(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select((F.col("toxic") > 0).cast("long").alias("toxic"), "text"))
    n, n_with = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        word, sentence, text, _, _ = sentences(batch.column("text"))
        w, code = np.unique(word, return_inverse=True)
        pair = np.unique(code.astype(np.int64) * batch.num_rows + text[sentence]) if len(word) else np.zeros(0, np.int64)
        holds, toxic = pair // batch.num_rows, batch.column("toxic").to_numpy()[pair % batch.num_rows]
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(np.bincount(holds, toxic, len(w)).astype(np.int64)), pa.array(np.bincount(holds, minlength=len(w)))], ["w", "hit", "seen"])

    def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit, seen = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            yield batch.select(["w"]).filter(pa.array(surprise(hit, seen - hit, n_with, n - n_with) >= LEAST_SURPRISE))

    counted = arrow_map(rows, count, "w long, hit long, seen long").groupBy("w").agg(F.sum("hit").alias("hit"), F.sum("seen").alias("seen"))
    known = np.sort(np.array([r[0] for r in counted.mapInArrow(telling, "w long").collect()], np.int64).view(np.uint64))

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        word, sentence, text, _, _ = sentences(batch.column("text"))
        code = np.minimum(np.searchsorted(known, word), max(0, len(known) - 1))
        use = known[code] == word if len(known) else np.zeros(len(word), bool)
        code, sentence = code[use], sentence[use]
        of = text[sentence]
        plain = np.bincount(text, minlength=batch.num_rows) - np.bincount(text[np.unique(sentence)], minlength=batch.num_rows)
        cut = np.searchsorted(of, np.arange(batch.num_rows + 1))
        pack = lambda x: pa.array([x[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(plain), pack(code), pack(sentence)], ["toxic", "plain", "code", "sentence"])

    got = arrow_map(rows, mark, "toxic long, plain long, code binary, sentence binary").collect()
    got.sort(key=lambda r: (r[0], r[1], bytes(r[2]), bytes(r[3])))
    none = np.zeros(0, np.int64)
    code, sentence, text, at = [none], [none], [none], 0
    for k, r in enumerate(got):
        _, own = np.unique(np.frombuffer(r[3], np.int32), return_inverse=True)
        code.append(np.frombuffer(r[2], np.int32).astype(np.int64))
        sentence.append(own + at)
        text.append(np.full(own.max(initial=-1) + 1, k))
        at += own.max(initial=-1) + 1
    return fit(known, np.concatenate(code), np.concatenate(sentence), np.concatenate(text).astype(np.int64), np.array([r[1] for r in got], np.int64), np.array([r[0] for r in got], np.int64))


def clear(p: np.ndarray, text: np.ndarray, rows: int) -> np.ndarray:
    """Each text's score by noisy-or: the chance that not all of its sentences are clear."""
    return -np.expm1(np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), rows))


def drop(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``most``, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        word, sentence, text, _, _ = sentences(batch.column("text"))
        return batch.filter(pa.array(clear(sent.value.sentence_scores(word, sentence, len(text)), text, batch.num_rows) < most))

    return arrow_map(docs, make, docs.schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, offending) for each row; ``offending`` has start, end and score of sentences that score 0.5 or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        word, sentence, text, start, end = sentences(batch.column("text"))
        p = sent.value.sentence_scores(word, sentence, len(text))
        found: list[list] = [[] for _ in range(batch.num_rows)]
        for i in np.flatnonzero(p >= 0.5):
            found[text[i]].append({"start": int(start[i]), "end": int(end[i]), "score": float(p[i])})
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(clear(p, text, batch.num_rows)), pa.array(found, spans)], ["doc_id", "score", "offending"])

    schema = "doc_id long, score double, offending array<struct<start: long, end: long, score: double>>"
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, schema)

"""The quality classifier: features and sequential updates beside plain versions, held-out accuracy, odd rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quakespark.llm import quality, queries
from quakespark.llm.common import table
from quakespark.llm.text import hashes, mix

SCHEMA = "doc_id long, text string, label int, mark string, row string, shard string, score string"


def word_hash(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hashes(raw, np.array([0]), np.array([len(raw)]))[0])


def plain_features(text, bits):
    words = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+|[^0-9A-Za-z\u0080-\U0010ffff\x20\x09-\x0D]+", text or "")
    codes = [word_hash(w) for w in words]
    got = codes + [int(quality.SAME)] * sum(a == b for a, b in zip(codes, codes[2:], strict=False))
    for a, b in zip(codes, codes[1:], strict=False):
        with np.errstate(over="ignore"):
            got.append(int(quality.SAME) if a == b else int(mix(np.array([a], np.uint64) * quality.PAIR + np.array([b], np.uint64))[0]))
    return Counter(g >> (64 - bits) for g in got)


TEXTS = ["", None, "a", "a a a", "Nd, Nd, Nd", "the cat!! sat\x1c on é-ü", "x" * 30000, " \n\t", "be or " * 4000, "a b c"]


def test_features_match_plain_version():
    bucket, count, begins = quality.features(pa.array(TEXTS), 12)
    for k, text in enumerate(TEXTS):
        own = slice(begins[k], begins[k + 1])
        assert dict(zip(bucket[own].tolist(), count[own].tolist(), strict=True)) == plain_features(text, 12)


def plain_ftrl(rows, passes):
    """Sequential updates, one coordinate at a time; rows are (features as {bucket: value}, label)."""
    z, n = {}, {}
    weight = lambda i, l1: 0.0 if abs(z.get(i, 0.0)) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)
    for _ in range(passes):
        for x, label in rows:
            w = {i: weight(i, 0.0 if i == "bias" else quality.L1) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - label) * x[i]
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i, 0.0 if i == "bias" else quality.L1) for i in z}


def corpus(n=300):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.4
        rows.append((i, " ".join(rng.choice(["on", "off", "up", "é"]) + ("##" if bad else "") for _ in range(rng.choice([3, 20, 60]))), int(not bad)))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(d, t, 1, "m", "r", "s", "x") for d, t, _ in rows], SCHEMA).repartition(3)
    return docs, spark.createDataFrame([(d, y, "t") for d, _, y in rows], "doc_id long, quality int, text string")


def test_one_shard_is_the_sequential_method(spark):
    rows = corpus()
    docs, labels = frames(spark, rows)
    model = quality.train(docs, labels, bits=12, passes=2)
    order = {r.doc_id: r.row for r in docs.select("doc_id", F.xxhash64("doc_id", F.sha2(F.col("text").cast("binary"), 256)).alias("row")).collect()}
    given = []
    for d, text, y in sorted((r for r in rows if zlib.crc32(str(r[0]).encode()) % 5), key=lambda r: order[r[0]]):
        x = {b: math.log1p(c) for b, c in plain_features(text, 12).items()}
        length = math.sqrt(sum(v * v for v in x.values()))
        given.append(({b: v / length for b, v in x.items()} | {"bias": 1.0}, y))
    want = plain_ftrl(given, 2)
    assert model.bias == pytest.approx(want.pop("bias"), abs=1e-5)
    assert np.abs(model.weight - [want.get(i, 0.0) for i in range(1 << 12)]).max() < 1e-4


def test_shards_learn_and_repeat(spark):
    rows = corpus(600)
    docs, labels = frames(spark, rows)
    one, two = (quality.train(docs.repartition(k), labels, bits=14, shard=2000) for k in (2, 5))
    assert one.bias == two.bias and (one.weight == two.weight).all()
    held = {d: y for d, _, y in rows if zlib.crc32(str(d).encode()) % 5 == 0}
    got = {r.doc_id: r.score for r in quality.score(docs, one).collect()}
    assert len(got) == 600 and sum((got[d] >= 0.5) == y for d, y in held.items()) >= 0.98 * len(held)


def test_odd_rows(spark):
    rows = [(1, None, 1), (1, None, 1), (2, "", 0), (3, "x" * 50000, 1), (4, "##", 0), (4, "##", 0), (4, "other", 1), (None, "a", 1)]
    docs, labels = frames(spark, rows)
    labels = labels.unionByName(spark.createDataFrame([(5, None, "t"), (2, 1, "t")], labels.schema))
    got = quality.score(docs, quality.train(docs, labels, bits=8)).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 for r in got)
    none = quality.train(docs, labels.limit(0), bits=8)
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels, bits=8)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op11_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out")
    right = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.sum(((F.col("quality") == 1) & (F.col("predicted") == 0)).cast("int")), F.count("*")).first()
    assert right[2] > 700 and right[0] > 0.99 and right[1] == 0

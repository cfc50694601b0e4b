"""The Merkle manifest beside a plain version, and beside its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F

from quakespark.llm import merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, path string, rank long, root string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path(tree, i):
    runs = []
    for level in tree[:-1]:
        a = i // 16 * 16
        runs.append((level[a : a + 16], i - a))
        i //= 16
    return runs


def brute(rows):
    by = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in rows:
        lower = None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        by[source].append((doc_id, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, n_chars, lower)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {s: levels([r[1] for r in by[s]]) for s in sources}
    crown = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, (doc_id, own, other) in enumerate(by[s]):
            runs = path(trees[s], i) + path(crown, k)
            folded = other if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 else own
            for run, j in runs:
                folded = sha("".join([*run[:j], folded, *run[j + 1 :]]))
            beside = "".join(x for run, j in runs for q, x in enumerate(run) if q != j)
            out.append((doc_id, own, trees[s][-1][0], crown[-1][0], sha(beside), folded, folded == crown[-1][0]))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", "p", 1, "r") for r in rows], SCHEMA).repartition(3)


def test_manifest_matches_plain_version(spark):
    rng = random.Random(1)
    texts = ["", "Ab c", "x" * 50000, None, "É Zz", "no capitals"]
    rows = [(i, rng.choice(texts), "en", rng.choice(["a", "a", "a", "b", None, "é", "Z"]) if i < 600 else f"s{i % 40}", i) for i in range(700)]
    rows += [(None, "T", None, "a", None)] * 3 + [(5, "Dup", "en", "a", 1)] * 40 + [(7, "Z", None, "only", 2), (-3, "N", "de", "", -3)]
    got = merkle.tampered_manifest(frame(spark, rows))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_manifest_of_few_rows(spark):
    assert merkle.tampered_manifest(frame(spark, [(1, "a", "en", "s", 1)]).limit(0)).count() == 0
    for rows in ([(0, "ABC", None, None, None)], [(0, "A", "en", "s", 1), (1, "b", "en", None, 1)], [(i, "T", "en", "s", 1) for i in range(17)]):
        assert sorted(map(tuple, merkle.tampered_manifest(frame(spark, rows)).collect()), key=repr) == brute(rows)


def test_proofs_of_an_untouched_table_verify(spark):
    rows = [(i, f"T{i}", "en", f"s{i % 3}", 1) for i in range(60)]
    got = merkle.manifest(frame(spark, rows))
    assert got.where("verified and folded_root = root").count() == 60
    lost = merkle.manifest(frame(spark, rows), F.col("doc_id") == 4, F.lit(None).cast("string")).where("not verified")
    assert [r.doc_id for r in lost.collect()] == [4]


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op12_merkle_manifest"])
    got = queries.op12_merkle_manifest(spark, sf)
    assert got.columns == want.columns
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall()) and 0 < sum(not r[-1] for r in rows) < len(rows)

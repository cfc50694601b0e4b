"""The prefix trie beside a plain version, in blocks of any size, and beside its SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quakespark.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, near long, key string, block string, ends string, owner string"


def said(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        order = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        own[conv].append(((turn is not None, turn or 0, order), (role, text)))
    return {c: tuple(t for _, t in sorted(v)) for c, v in own.items()}


def plain_rebuilt(rows):
    own = said(rows)
    out = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 4
        first = None if c is None else c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(first, ())[:h] + turns[h:]
    return out


def plain_nodes(conversations):
    members, exact = defaultdict(list), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        exact[turns].append(c)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, ids in members.items():
        own = (len(ids) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += own
    out = []
    for p, ids in members.items():
        ends = ",".join(map(str, sorted(i for i in exact[p] if i is not None)))
        out.append((least(ids), len(p), least(members[p[:-1]]) if p else None, len(ids), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n):
    rng = random.Random(seed)
    lines = ["", None, "hi", "hi  there you", "x y\tz", "é" * 30, "long " * 2000]
    rows = []
    for c in [*range(-25, n), 900, 901, 947]:
        copy = rng.random() < 0.4
        for turn in range(0 if c == 900 else rng.choice([1, 2, 5]) if not copy else 3):
            rows.append((c, turn, "user" if copy else rng.choice(["user", None, "assistant"]), "same" if copy else rng.choice(lines)))
    rows += [(None, 1, "user", "same"), (None, None, "user", "hi"), (3, None, None, None), (3, None, None, None), (950, 5, "user", "a"), (950, 5, "user", "a"), (950, 5, "user", "b")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "b", "e", "o") for r in rows], SCHEMA).repartition(3)


def values(df):
    assert df.columns == trie.RESULT
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize(("rows", "turns", "spread"), [(1, 1, 0), (2, 100, 200_000), (7, 9, 0), (1 << 15, 1 << 18, 200_000)])
def test_nodes_match_plain_version_in_blocks_of_any_size(spark, rows, turns, spread):
    given = conversations(rows, 120)
    want = plain_nodes(plain_rebuilt(given))
    assert values(trie.nodes(trie.rebuilt(frame(spark, given)), rows, turns, spread)) == want


def test_copies_of_one_conversation(spark):
    given = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(3)]
    want = plain_nodes(plain_rebuilt(given))
    assert values(trie.nodes(trie.rebuilt(frame(spark, given)), 11)) == want and len(want) == 4
    assert values(trie.nodes(trie.sequences(frame(spark, given)), 11)) == plain_nodes(said(given))


def test_turnless_and_empty(spark):
    assert values(trie.nodes(trie.rebuilt(frame(spark, []).where(F.lit(True))))) == []
    alone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0)
    got = values(trie.nodes(trie.rebuilt(frame(spark, [(alone, 0, "user", "gone")]))))
    assert got == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]
    assert values(trie.nodes(trie.rebuilt(frame(spark, [(None, 0, "user", "a b")])))) == plain_nodes({None: (("user", "a b"),)})


def test_long_conversation(spark):
    given = [(20, t, "user", str(t % 7)) for t in range(120)] + [(40, t, "user", str(t % 7)) for t in range(113)]
    assert values(trie.nodes(trie.sequences(frame(spark, given)), 1)) == plain_nodes(said(given))


def test_query_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.sql(queries.oracle_sql()["op13_prefix_trie"])
    got = queries.op13_prefix_trie(spark, sf)
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr)
    assert rows == sorted(want.select(", ".join(order)).fetchall(), key=repr) and len(rows) > 50

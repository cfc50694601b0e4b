"""The operators against brute-force versions on small tables, with nulls, empty and long texts, ties and clashing names."""

import base64
import hashlib
import math
import random
import re
import sys
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quakespark.llm import bpe, chat, common, embeddings, fmindex, minhash, mixing, ngram, pii, queries, text, toxicity, winnowing

PATH, PATTERN = queries.VOCABULARY, queries.PATTERN
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
TOKENIZER = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, score string, bucket string, first string"
sha = lambda s: hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 4, 12, 13, 40, 90, 300]))]
        if rows and rng.random() < 0.5:
            other = (rng.choice(rows)[1] or "").split()
            a = rng.randrange(len(other) + 1)
            words[len(words) // 2 : len(words) // 2] = other[a : a + rng.randint(5, 60)]
        if rows and rng.random() < 0.2:
            words = (rng.choice(rows)[1] or "").split()
            if words and rng.random() < 0.6:
                words[rng.randrange(len(words))] = "edited"
        rows.append([3 * i - 9, rng.choice([" ", "\n", " \t "]).join(words) + rng.choice(["", ". ", "!"])])
    rows += [[1000, None], [1001, ""], [1002, " \n\t "], [1003, "be " * 3000], [1004, "x" * 20000], [1005, "be be be " * 20], [1006, "a b\x1cc d e"]]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "en", "s", 1, "k", "s", "b", "f") for r in rows], SCHEMA).repartition(3)


def by_id(df):
    got = {}
    for r in df.collect():
        assert r["doc_id"] not in got
        got[r["doc_id"]] = r
    return got


# op1


def brute_links(vectors, threshold):
    ok = {}
    for i, v in vectors:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, np.array(v) / np.linalg.norm(v))
    ids = sorted(ok)
    links = {i: {j for j in ids if j != i and len(ok[i]) == len(ok[j]) and float(ok[i] @ ok[j]) >= threshold} for i, _ in vectors if i in ok}
    root = {}
    for i, _ in vectors:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root[i] = min(seen)
    return {i: (len(links.get(i, ())), root[i]) for i, _ in vectors}


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = [(i, rng.normal(size=8).tolist()) for i in range(150)]
    for i in range(150, 400):
        base = np.array(vectors[rng.integers(0, 20)][1])
        vectors.append((i, (base + rng.normal(size=8) * rng.choice([0, 0.1, 0.3])).tolist()))
    vectors += [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0, None] + [0.0] * 6), (904, []), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [1e308] * 8), (908, [1e-300] * 8), (909, [float("inf")] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({"label": F.lit(1), "e": F.lit("x"), "tile": F.lit(2)})
    want = brute_links([(i, v) for i, v in vectors if i not in (907, 908)], 0.9)
    for tile in (64, 4096):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df, 0.9, tile).collect()}
        assert got[907][0] >= 1 and got[908][0] >= 1
        got = {i: x for i, x in got.items() if i not in (907, 908)}
        assert len(got) == len(vectors) - 2
        assert {i: x[:2] for i, x in got.items()} == {i: w for i, w in want.items()}
        assert all(x[2] == (i == x[1]) for i, x in got.items())


def test_embeddings_within_rounding_of_the_threshold(spark):
    rows = [(1, [1.0, 0.0]), (2, [3.0, 4.0]), (3, [3.0, 4.0]), (4, [3.0 - 2e-10, 4.0]), (5, [-1.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.6).collect()}
    assert got == {1: (2, 1), 2: (3, 1), 3: (3, 1), 4: (2, 1), 5: (0, 5)}


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    stages = context._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_embeddings_shuffle_grows_with_the_vectors(spark):
    rng = np.random.default_rng(2)
    n = 3000
    x = rng.normal(size=(n, 32))
    x[n // 2 :] = x[: n // 2] + rng.normal(size=(n // 2, 32)) * 0.05
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    before = shuffled(spark)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df, 0.9, 64).collect()}
    assert shuffled(spark) - before < 6 * n * 32 * 4
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    assert {i: c for i, (c, _) in got.items()} == dict(enumerate(((u @ u.T >= 0.9).sum(1) - 1).tolist()))
    assert all(got[i][1] == i % (n // 2) for i in range(n))


def test_embeddings_of_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()[0].kept


# op2

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_pii(text):
    spans = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                spans.append((m.start(), list(BASE).index(kind), f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(spans)]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab@.+- ()é\n") | st.sampled_from("0123456789"), max_size=60))
def test_pii_base_matches_contract(t):
    assert [f"{k}:{s}:{e}" for k, s, e, _ in pii.find(t) if k in pii.KINDS[:4]] == brute_pii(t)


def test_pii_rows(spark):
    iban, card = "GB82 WEST 1234 5698 7654 32", "4111 1111 1111 1111"
    rows = [[1, f"é mail a.b@c.de card {card}, account {iban}. tel 555-123-4567 +1 (988) 555-2485 ip 10.0.0.255"], [2, None], [3, ""], [4, "a" * 50000 + "1" * 50000 + "@"], [5, "555-123-4567 GB82 WEST 1234 5698 7654 33"]]
    got = by_id(pii.scan(frame(spark, rows), clean=True))
    assert {x.split(":")[0] for x in got[1].spans.split(",")} == {"email", "card", "iban", "local_phone", "phone", "ip"}
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    assert "@" not in got[1].clean_text and "<CARD>" in got[1].clean_text
    for i, t in rows:
        assert got[i].base_sha256 == sha(",".join(brute_pii(t or ""))) if i != 4 else got[i].spans == ""
    assert got[5].spans == ""
    kept = by_id(pii.clean(frame(spark, rows)))
    assert kept[2].text is None and kept[1].text == got[1].clean_text and kept[1].n_chars == len(kept[1].text)


def test_pii_long_digit_runs_and_many_spans(spark):
    many = " ".join(f"10.0.{i % 250}.{i % 200} tel 555-123-{i % 9000 + 1000}" for i in range(20000))
    rows = [[1, "0" * 5000 + "1.2.3.4"], [2, "9" * 6000 + ".1.2.3"], [3, "1.2.3." + "7" * 5000], [4, many], [4, many]]
    for _, t in rows[:3]:
        sys.set_int_max_str_digits(0)
        assert [f"{k}:{s}:{e}" for k, s, e, _ in pii.find(t) if k in pii.KINDS[:4]] == brute_pii(t)
        sys.set_int_max_str_digits(4300)
    began = time.perf_counter()
    found = pii.find(many)
    assert len(found) == 40000 and time.perf_counter() - began < 8
    got = pii.scan(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_ip) for r in got) == [(1, 1), (2, 0), (3, 0), (4, 20000), (4, 20000)]
    assert pii.scan(frame(spark, [])).count() == 0 and pii.clean(frame(spark, [])).count() == 0


def test_pii_context_speaks_for_and_against(spark):
    score = lambda t: {k: x for k, _, _, x in pii.find(t)}
    assert score("call 555-123-4567") == {"local_phone": 0.6} and score("555-123-4567") == score("call, order 555-123-4567") == {}
    assert score("version 1.2.3.4")["ip"] < score("1.2.3.4")["ip"] < score("host 1.2.3.4")["ip"]
    iban = "DE89370400440532013000"
    assert score(iban) == {"iban": 0.7} and score(f"konto {iban}") == {"iban": 1.0} and "iban" not in score(f"serial part {iban}")
    only = spark.createDataFrame([("a@b.cc",)], "text string")
    assert pii.clean(only).columns == ["text"] and pii.clean(only).first().text == "<EMAIL>"


# op3


def pieces(text):
    return [c for run in re.findall(r"[^ \t\n\x0b\f\r]+", text) for c in ([run] if len(run) <= 16 else run)]


def plain_hashes(fingerprint):
    return {x.split(":")[0] for x in fingerprint.split()}


def test_winnowing_minima_and_edits(spark):
    rows = corpus(2)
    got = by_id(winnowing.compare_edits(frame(spark, rows)))
    rows = sorted((i, t or "") for i, t in rows)
    cut = [pieces(t) for _, t in rows]
    one = {t: h for t, h in spark.createDataFrame([(x,) for x in {x for c in cut for x in c}], "t string").select("t", F.xxhash64("t")).collect()}
    m = winnowing._modulus(5)
    hashed = {}
    for (i, _), c in zip(rows, cut, strict=True):
        grams = [c[j : j + 5] for j in range(max(1, len(c) - 4))]
        hashed[i] = {j: (sum(one[x] % m * 3 ** (len(g) - 1 - p) for p, x in enumerate(g)) % m) >> (m.bit_length() - 32) for j, g in enumerate(grams)}
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == sha(edited)
        h = [hashed[i][j] for j in sorted(hashed[i])] if cut[k] else []
        picked = []
        for a in range(max(1, len(h) - 5)) if h else []:
            window = h[a : a + 6]
            p = a + max(j for j, x in enumerate(window) if x == min(window))
            if p not in picked:
                picked.append(p)
        assert got[i].fingerprint == " ".join(f"{h[p]:x}:{p}" for p in picked)
        mine, changed, beside = (plain_hashes(x) for x in (got[i].fingerprint, got[i].edited_fingerprint, got[rows[(k + 1) % len(rows)][0]].fingerprint))
        for found, other in ((got[i].near_edited, changed), (got[i].near_next, beside)):
            assert found == (pytest.approx(len(mine & other) / len(mine | other)) if mine | other else 1.0)
        if t == edited:
            assert got[i].near_edited == 1
    long = [got[i] for (i, t) in rows if len(t.split()) > 60]
    assert np.mean([r.near_edited for r in long]) > 0.2
    same = defaultdict(set)
    for i, t in rows:
        same[t].add(got[i].fingerprint)
    assert all(len(x) == 1 for x in same.values())
    assert winnowing.compare_edits(frame(spark, [])).count() == 0
    one = winnowing.compare_edits(frame(spark, [[5, "one two"]])).first()
    assert one.near_next == 1


@pytest.mark.parametrize("script", ["abcdefghij", "漢字仮名交文章例示", "абвгдежзик"])
def test_winnowing_guarantee_without_spaces(spark, script):
    rng = random.Random(3)
    passage = "".join(rng.choice(script) for _ in range(winnowing.K + winnowing.WINDOW - 1 + 16))
    rows = []
    for i in range(40):
        before, after = ("".join(rng.choice(script) for _ in range(rng.randint(17, 60))) for _ in range(2))
        rows.append([i, before + passage + after])
    rows += [[100, "".join(rng.choice(script) for _ in range(600))]]
    rows += [[101, "xyz" + rows[-1][1]]]
    got = by_id(winnowing.compare_edits(frame(spark, rows)))
    assert all(plain_hashes(got[i].fingerprint) & plain_hashes(got[j].fingerprint) for i in range(40) for j in range(i))
    assert got[100].near_next > 0.9


def test_winnowing_repeated_and_null_ids(spark):
    rows = [[None, f"text number {i} of those without id"] for i in range(300)] + [[7, f"seven {i % 3}"] for i in range(60)] + [[9, "last"]]
    got = winnowing.compare_edits(frame(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == {None: 300, 7: 60, 9: 1}
    nulls = [r for r in got if r.doc_id is None]
    texts = {sha(a[1][: len(a[1]) - len(a[1]) // 2] + b[1][: len(a[1]) // 2]) for a in rows for b in rows}
    assert all(r.edited_sha256 in texts for r in got) and len({r.fingerprint for r in nulls}) == 300
    last = next(r for r in got if r.doc_id == 9)
    assert last.edited_sha256 in {sha("la" + f"{r[1]}"[:2]) for r in rows if r[0] is None}


# op4


def test_bpe_matches_tiktoken(spark):
    rows = corpus(3) + [[2000, "It's 3.5 naïve ÀÉ ²³ 漢字仮名 " + "a" * 3000 + "  \n\n x　y   — ñ'll I'll\x85\x1f "], [2001, "🙂🙂 é ½ \U0001d54f"]]
    got = by_id(bpe.encode(frame(spark, rows), PATH, PATTERN, ids=True))
    for i, t in rows:
        want = TOKENIZER.encode_ordinary(t or "")
        packed = b"".join(x.to_bytes(4, "little") for x in want)
        assert got[i].ids == packed and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == sha(packed) and got[i].decoded_sha256 == sha(t or "")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_bpe_any_text(t):
    own = bpe.encoder(PATH, PATTERN)
    assert list(memoryview(own.encode(t)).cast("I")) == TOKENIZER.encode_ordinary(t)
    assert own.decode(own.encode(t)) == t.encode()


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=120), st.data())
def test_bpe_append_and_edit(piece, data):
    own = bpe.encoder(PATH, PATTERN)
    table = own.extend(piece, [-1])
    assert own.walk(table) == own.merge(piece)
    more = data.draw(st.binary(max_size=20))
    assert own.walk(own.extend(piece + more, list(table))) == own.merge(piece + more)
    a = data.draw(st.integers(0, len(piece)))
    b = data.draw(st.integers(a, len(piece)))
    changed, new = own.edit(piece, table, a, b, more)
    assert new == own.extend(changed, [-1])


def test_bpe_edit_reuses_the_rest():
    own = bpe.encoder(PATH, PATTERN)
    piece = b"theanderonation" * 200
    table = own.extend(piece, [-1])
    changed, new = own.edit(piece, table, 100, 103, b"xyzzy")
    assert new == own.extend(changed, [-1])


# op5


def brute_repeats(rows, width=13):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        for a in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][a : a + width]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for a in range(len(w) - width + 1):
            if first[tuple(w[a : a + width])] < i:
                gone.update(range(a, a + width))
        out[i] = (len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


@pytest.mark.parametrize("often", [2000, 1])
def test_substring_dedup_matches_brute_force(spark, often):
    rows = corpus(4, 80)
    got = by_id(fmindex.remove_repeats(frame(spark, rows), cut=True, bucket=20000, shard=30000, often_from=often))
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == brute_repeats(rows)
    assert any(r.n_removed for r in got.values()) and sha(got[1005].kept) == got[1005].kept_sha256
    assert fmindex.remove_repeats(frame(spark, [])).count() == 0


def test_substring_dedup_of_repeated_and_null_ids(spark):
    rng = random.Random(8)
    line = lambda n: " ".join(f"w{rng.randrange(9999)}" for _ in range(n))
    shared, other = line(20), line(20)
    rows = [[5, f"{line(5)} {shared} {line(4)}"], [5, f"{shared} {line(9)}"], [5, f"{line(3)} {other}"], [7, f"{line(2)} {shared}"], [3, f"{other} {line(3)}"]]
    rows += [[None, f"{line(i)} {shared} {other}"] for i in range(30)] + [[None, None], [9, None]]
    got = fmindex.remove_repeats(frame(spark, rows), bucket=300, shard=300).collect()
    assert Counter((r.doc_id, r.n_removed) for r in got) == {(5, 0): 2, (5, 20): 1, (7, 20): 1, (3, 0): 1, (None, 0): 31, (9, 0): 1}
    assert sum(r.n_words for r in got) == sum(len((t or "").split()) for _, t in rows)


def test_fm_index_counts():
    rng = np.random.default_rng(5)
    t = np.append(rng.integers(1, 5, 400), 0)
    index = fmindex.FMIndex(t, 5)
    joined = t.tolist()
    q = rng.integers(1, 5, 200)
    matched, low, high = index.search(q, np.arange(1, 201))
    for e, m, a, b in zip(range(1, 201), matched, low, high, strict=True):
        count = lambda p: sum(joined[i : i + len(p)] == p for i in range(len(joined)))
        assert m == max(k for k in range(0, min(13, e) + 1) if k == 0 or count(q[e - k : e].tolist()))
        assert b - a == count(q[e - m : e].tolist())


def test_fm_index_streams_segments(spark):
    rng = random.Random(12)
    words = np.array([rng.getrandbits(63) for _ in range(4)], np.uint64)
    for _ in range(20):
        index = [words[[rng.choice([0, 0, 0, 1, 2]) for _ in range(rng.randint(13, 60))]] for _ in range(rng.randint(1, 12))]
        streamed = [words[[rng.choice([0, 0, 0, 1, 3]) for _ in range(rng.randint(13, 60))]] for _ in range(8)] + [index[0][:20]]
        documents = np.array([rng.randrange(5) for _ in index])
        grams = defaultdict(set)
        for x, d in zip(index, documents, strict=True):
            for k in range(14):
                for i in range(len(x) - k + 1):
                    grams[tuple(x[i : i + k])].add(d)
        depths = set()
        for x, (depth, found) in zip(streamed, fmindex.stream(index, documents, streamed, block=50), strict=True):
            for i in range(len(x) - 12):
                whole = tuple(x[i : i + 13])
                assert depth[i] == max(k for k in range(14) if whole[13 - k :] in grams)
                assert found[i] == min(grams.get(whole, ()), default=np.iinfo(np.int64).max)
                depths.add(depth[i])
        assert 13 in depths or len(depths) > 1


# op6


def test_mixing_meets_targets(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        bad = rng.random() < 0.3
        rows.append([i, " ".join(rng.choice(["aaa***", "bb###", "the"] if bad else ["house", "tree", "the"]) for _ in range(rng.randint(5, 60)))])
        if i % 2:
            labels.append((i, int(not bad), 0))
    rows += [[900, None], [901, ""]]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = mixing.mix(docs, marks, F.col("quality").cast("string"), {"0": 0.5, "1": 0.5}).collect()
    assert len(out) == len(rows)
    total = sum(r.n_tokens for r in out)
    for k in (0, 1):
        assert abs(sum(r.rate * r.n_tokens * r.p[k] for r in out) / total - 0.5) < 1e-3
        assert abs(sum(r.copies * r.n_tokens * r.p[k] for r in out) / total - 0.5) < 0.1
    assert all(r.rate >= 0 and abs(sum(r.p) - 1) < 1e-9 and r.copies in (math.floor(r.rate), math.floor(r.rate) + 1) for r in out)
    right = sum((r.p[1] > 0.5) == ("***" not in rows[r.doc_id][1] and "###" not in rows[r.doc_id][1]) for r in out if r.doc_id < 900)
    assert right > 270
    grown = mixing.mix(docs, marks, F.col("quality").cast("string"), {"0": 0.5, "1": 0.5}, least=1.0, grow=True).collect()
    mass = [sum(r.rate * r.n_tokens * r.p[k] for r in grown) for k in (0, 1)]
    assert min(r.rate for r in grown) >= 1 and abs(mass[0] / sum(mass) - 0.5) < 1e-3
    empty = mixing.mix(frame(spark, []), marks.limit(0), F.col("quality").cast("string"), {"0": 0.5, "1": 0.5})
    assert empty.count() == 0


def test_mixing_rates_match_projected_gradient(spark):
    rng = np.random.default_rng(8)
    p = rng.dirichlet([0.5, 0.5, 0.5], 200)
    tokens = rng.integers(1, 300, 200)
    members = spark.createDataFrame([(i, int(t), [float(x) for x in q]) for i, (t, q) in enumerate(zip(tokens, p, strict=True))], "doc_id long, n_tokens long, p array<double>")
    own = tokens @ p
    for targets, least in (([0.2, 0.3, 0.5], 0.0), ([0.1, 0.1, 0.8], 0.0), ([0.3, 0.3, 0.4], 0.5)):
        got = sorted(mixing.fit_rates(members, targets, least).collect())
        mine, wanted = np.array([r.rate for r in got]), np.array(targets) * own.sum()
        # Brute force: plain descent with all rows at once, until nothing moves.
        rate = np.ones(200)
        for _ in range(20000):
            rate = np.maximum(least, rate - p @ ((rate * tokens @ p - wanted) / own))
        left, best = (np.abs(r * tokens @ p - wanted).max() / own.sum() for r in (mine, rate))
        assert left == pytest.approx(got[0].residual, abs=1e-9) and left <= best + 1e-4
        # Where nothing has met the bound, the least change that meets the targets is linear in the posteriors.
        if rate.min() > least and mine.min() > least:
            gain = np.linalg.solve((p * tokens[:, None]).T @ p, wanted - own)
            assert np.abs(mine - (1 + p @ gain)).max() < 0.02
        assert mine.min() >= least


def test_mixing_says_what_is_left_of_targets_that_no_rates_meet(spark):
    members = spark.createDataFrame([(1, 10, [0.5, 0.5]), (2, 30, [0.5, 0.5]), (2, 30, [0.5, 0.5])], "doc_id long, n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="miss their targets"):
        got = mixing.fit_rates(members, [0.9, 0.1]).collect()
    assert got[0].residual == pytest.approx(0.4, abs=0.01) and len(got) == 3


def test_mixing_reads_whole_words_and_odd_labels(spark):
    # Words differ by their beginnings only; labels hold nulls, other domains and repeats; docs have clashing columns.
    rng = random.Random(3)
    rows = [[i, " ".join(rng.choice("abc" if i % 2 else "xyz") + "tion" for _ in range(30))] for i in range(200)] + [[5, None], [None, "ation"]]
    docs = spark.createDataFrame([(*r, 1.0, 2.0, 3, 4, 5) for r in rows], "doc_id long, text string, p double, rate double, copies int, one int, n int")
    marks = spark.createDataFrame([(i, str(i % 2)) for i in range(100)] + [(None, "1"), (7, None), (8, "other"), (9, "1")], "doc_id long, kind string")
    out = mixing.mix(docs, marks, F.col("kind"), {"0": 0.5, "1": 0.5}).collect()
    assert len(out) == len(rows)
    right = [(r.p[1] > 0.5) == bool(r.doc_id % 2) for r in out if r.doc_id is not None and r.doc_id >= 100]
    assert all(right) and len(right) == 100


# op7


def brute_bigrams(train, d, d1):
    seqs = [["<s>", *re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split(), "</s>"] for t in train]
    uni, bi = Counter(w for s in seqs for w in s[1:]), Counter(p for s in seqs for p in zip(s, s[1:], strict=False))
    history, before = Counter(), Counter()
    kinds = defaultdict(lambda: [0, 0, 0])
    for (h, w), n in bi.items():
        history[h] += n
        before[w] += 1
        kinds[h][min(n, 3) - 1] += 1
    pairs = len(bi)
    spare = sum(d1[min(c, 3) - 1] for c in before.values()) / pairs
    unknown = spare / (len(uni) + 1)
    low = lambda w: (before[w] - d1[min(before[w], 3) - 1]) / pairs + unknown if before[w] else unknown

    def chance(h, w):
        if not history[h]:
            return low(w)
        n = bi[h, w]
        return (n - (d[min(n, 3) - 1] if n else 0)) / history[h] + sum(a * b for a, b in zip(d, kinds[h], strict=True)) / history[h] * low(w)

    return uni, bi, before, chance


def test_kneser_ney_matches_brute_force(spark):
    rows = corpus(7)
    docs = frame(spark, rows)
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    model = ngram.train(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2), shards=5)
    assert len(model.hot)
    _, bi, _, _ = brute_bigrams(train, [0.5] * 3, [0.5] * 3)
    of = Counter(bi.values())
    d = ngram.discounts([of[k] for k in (1, 2, 3, 4)])
    assert model.discounts == d
    before = Counter(w for _, w in bi)
    of = Counter(before.values())
    uni, _, _, chance = brute_bigrams(train, d, ngram.discounts([of[k] for k in (1, 2, 3, 4)]))
    total = sum(uni.values())
    got = by_id(ngram.score(docs, model))
    for i, t in rows:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode().split() + ["</s>"]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(words), sum(uni[w] > 0 for w in words), total)
        assert r.base_score == pytest.approx(sum(math.log10((uni[w] + 1) / (total + len(uni) + 1)) for w in words), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(chance(h, w)) for h, w in zip(["<s>", *words], words, strict=False)), rel=1e-6)
    for h in ["<s>", *list(uni)[:5], "never seen"]:
        assert sum(chance(h, w) for w in uni) + chance(h, "unknown word") == pytest.approx(1)


def test_kneser_ney_of_repeated_texts_is_finite(spark):
    train = ["a b", "c d", "e f", "g h"] * 3 + ["x y"] * 2 + ["z w"] + ["k l"]
    rows = [[10 * i, t] for i, t in enumerate(train)] + [[1000, "x q"], [1001, "x b"], [1002, "q q"], [1003, None]]
    docs = frame(spark, rows)
    model = ngram.train(docs.where("doc_id < 1000"), shards=3)
    assert all(0 < d < k for k, d in enumerate(model.discounts, 1))
    got = by_id(ngram.score(docs, model))
    assert all(math.isfinite(r.score) and math.isfinite(r.perplexity) for r in got.values())
    _, bi, _, _ = brute_bigrams(train, [0.5] * 3, [0.5] * 3)
    before = Counter(Counter(w for _, w in bi).values())
    uni, _, _, chance = brute_bigrams(train, model.discounts, ngram.discounts([before[k] for k in (1, 2, 3, 4)]))
    for h in ["<s>", *uni, "never seen"]:
        assert sum(chance(h, w) for w in uni) + chance(h, "unknown word") == pytest.approx(1)
    for i, t in rows[-4:]:
        words = (t or "").encode().split() + ["</s>"]
        assert got[i].score == pytest.approx(sum(math.log10(chance(h, w)) for h, w in zip(["<s>", *words], words, strict=False)), rel=1e-6)
    assert ngram.score(docs.limit(0), model).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=4, max_size=4))
def test_kneser_ney_discounts_stay_between_0_and_the_count(n):
    assert all(0 < d < k for k, d in enumerate(ngram.discounts(n), 1))


def test_kneser_ney_without_training_rows(spark):
    docs = frame(spark, [[1, "a b"], [2, None]])
    got = by_id(ngram.score(docs, ngram.train(docs.limit(0))))
    assert got[1].n_known == 0 and got[1].train_tokens == 0 and math.isfinite(got[1].score)


# op8


def test_toxicity_learns_and_locates(spark, sf):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        sentences = [" ".join(rng.choice(["house", "tree", "sky", "the", "Walk"]) for _ in range(6)) + "." for _ in range(rng.randint(1, 12))]
        toxic = rng.random() < 0.3
        if toxic:
            k = rng.randrange(len(sentences))
            sentences[k] = f"the {rng.choice(['vile', 'Scum'])} tree."
        rows.append([i, " ".join(sentences)])
        labels.append((i, 1, int(toxic)))
    rows += [[900, None], [901, ""], [902, "..."]]
    docs, marks = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = by_id(toxicity.score(docs, toxicity.train(docs, marks)))
    assert len(got) == len(rows) and got[900].score == got[901].score == 0
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i].score >= 0.5) == bool(labels[i][2]) for i in held) / len(held) > 0.97
    for i in held:
        for s in got[i].offending:
            assert re.search("vile|Scum", rows[i][1][s.start : s.end])
    flat = toxicity.score(docs, toxicity.train(docs, marks.limit(0)))
    assert flat.count() == len(rows)


def brute_toxicity(model, t):
    weight = dict(zip(model.known.tolist(), model.weight.tolist(), strict=True))
    clear = 1.0
    for sentence in re.split(r"[.!?\n]", t or ""):
        found = re.findall(rb"[A-Za-z\x80-\xff]+", sentence.encode())
        if found:
            data, at = text.utf8(pa.array([w.decode("utf-8", "replace").lower() for w in found]))
            clear /= 1 + math.exp(min(700.0, model.bias + sum(weight.get(h, 0.0) for h in text.hashes(data, at[:-1], at[1:]).tolist())))
    return 1 - clear


def test_toxicity_scores_match_brute_force(spark):
    rng = random.Random(9)
    rows = [[i, " ".join(rng.choice(["house", "tree", "vile", "Sky.", "Walk!", "end?\nso", "x,y"]) for _ in range(rng.randint(0, 30)))] for i in range(300)]
    rows += [[7, rows[7][1]], [None, "vile. tree"], [901, None], [902, "vile " * 5000 + "."]]
    docs = spark.createDataFrame([(*r, 0.5, "o") for r in rows], "doc_id long, text string, score double, offending string")
    marks = spark.createDataFrame([(i, int("vile" in (t or ""))) for i, t in rows if i is not None] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    assert len(model.known) >= 1
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for (i, x), (j, y) in zip(sorted(((r.doc_id, r.score) for r in got), key=key), sorted(((i, brute_toxicity(model, t)) for i, t in rows), key=key), strict=True):
        assert i == j and x == pytest.approx(y, abs=1e-9)
    left = toxicity.drop(docs, model)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted((i or 0, t or "") for i, t in rows if brute_toxicity(model, t) < 0.5)
    assert toxicity.score(docs.limit(0), model).count() == toxicity.drop(docs.limit(0), model).count() == 0


def test_toxicity_held_out_accuracy(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(docs, toxicity.train(docs, marks)).join(marks, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    right, n, found, toxic = scored.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("toxic")).cast("int")), F.count("*"), F.sum((F.col("score") >= 0.5).cast("int") * F.col("toxic")), F.sum("toxic")).first()
    assert n > 500 and right > 0.97 and found > 0.8 * toxic


# op9


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30), st.integers(0, 40))
def test_banded_distance(a, b, most):
    d = edit_distance(a, b)
    assert minhash.banded_distance(a, b, most) == (d if d <= most else most + 1)


def test_order_minhash_classes(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, group = [], {}
    for i in range(120):
        kind = rng.random()
        if i < 20 or kind < 0.3:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([30, 120, 400]))]
            group[i] = i
        else:
            k = rng.randrange(20)
            words, group[i] = rows[k][1].split(), group[k]
            for _ in range(rng.choice([0, 1, len(words) // 40])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append([i, " ".join(words)])
    rows += [[900, None], [901, ""], [902, "one two"], [903, "One  two"], [904, "two one"]]
    group |= {900: 900, 901: 900, 902: 902, 903: 902, 904: 904}
    got = by_id(minhash.near_duplicates(frame(spark, rows)))
    assert {i: r.class_id for i, r in got.items()} == group
    assert all(r.kept == (i == r.class_id) for i, r in got.items())
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    doubled = minhash.near_duplicates(frame(spark, [[1, "a b c"], [1, "a b c"], [None, "x"]]))
    assert sorted((r.doc_id or 0, r.class_id) for r in doubled.collect()) == [(0, None), (1, 1), (1, 1)]


def signed(spark, rows):
    return minhash.signatures(spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256))))


@pytest.mark.parametrize("n, similarity", [(300, 0.80), (300, 0.85), (300, 0.90), (300, 0.95), (60, 0.80), (40, 0.80), (10, 0.90), (10, 0.80), (5, 0.80)])
def test_order_minhash_recall_of_scattered_edits(spark, n, similarity):
    rng = random.Random(n)
    rows = []
    for i in range(200):
        a = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        b = list(a)
        for p in rng.sample(range(n), round(n * (1 - similarity))):
            b[p] = f"w{rng.randrange(10**6)}"
        assert minhash.alike(a, b)
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    keys = {r.doc_id: set(enumerate(r["keys"])) for r in signed(spark, rows).collect()}
    assert sum(bool(keys[2 * i] & keys[2 * i + 1]) for i in range(200)) >= 196


def test_order_minhash_links_in_crowded_buckets(spark):
    # All share a passage, and that is all that the pairs that are just alike have in common besides single words.
    rng = random.Random(3)
    fresh = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    passage = fresh(75)
    rows = [[i, " ".join(fresh(25) + passage)] for i in range(40)]
    for i in range(40, 60, 2):
        a = fresh(25) + passage
        b = [w if p % 2 == 0 and p < 25 or p % 10 and p >= 25 else fresh(1)[0] for p, w in enumerate(a)]
        assert minhash.alike(a, b)
        rows += [[i, " ".join(a)], [i + 1, " ".join(b)]]
    got = by_id(minhash.near_duplicates(frame(spark, rows)))
    assert {i: r.class_id for i, r in got.items()} == {i: i - (i > 40 and i % 2) for i, _ in rows}


def pairs_left(members, threshold, **more):
    return {(r.doc_id, b) for r in minhash.untested(members, threshold, **more).collect() for b in r.mates}


def test_order_minhash_pairs_of_parts_and_bounds(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(60)}" for _ in range(20)] for _ in range(6)]
    rows = [(i, " ".join(w if rng.random() < 0.8 else "x" for w in base[i % 6][: rng.choice([16, 18, 20])])) for i in range(60)]
    known = signed(spark, rows).withColumn("keys", F.array(F.lit(7).cast("long"), F.lit(5).cast("long")))
    members = known.select("doc_id", "n", "bag", "keys", F.lit(7).cast("long").alias("key"), F.lit(60).alias("size"), F.lit(1200).alias("words"), (F.col("doc_id") % 20).alias("class"), F.lit(-1).cast("long").alias("lead"))
    near = {(a, b) for a, x in rows for b, y in rows if a < b and a % 20 != b % 20 and minhash.alike(x.split(), y.split(), 0.6)}
    whole = pairs_left(members, 0.6)
    assert near <= whole and 5 < len(near) and len(whole) < 1000
    both = lambda found: {tuple(sorted(p)) for p in found}
    assert both(pairs_left(members, 0.6, block=7)) == both(pairs_left(members, 0.6, most_words=100)) == whole
    assert not pairs_left(members.withColumn("key", F.lit(5).cast("long")), 0.6)  # they have met in bucket 7
    linked = minhash.align_groups(minhash.untested(members, 0.6).join(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id"), 0.6).collect()
    root = {i: i % 20 for i in range(60)}
    for a, b in near:
        low, high = sorted((root[a], root[b]))
        root = {i: low if r == high else r for i, r in root.items()}
    own = {i: i % 20 for i in range(60)}
    for r in linked:
        low, high = sorted((own[r.a], own[r.b]))
        own = {i: low if x == high else x for i, x in own.items()}
    assert own == root


def test_order_minhash_links_through_absorbed_members(spark):
    # In a bucket of {lead, a, b}, a is alike the lead and b, which aren't alike; all three meet in no other sketches.
    base = [f"w{i}" for i in range(100)]
    a = [w if i >= 15 else f"a{i}" for i, w in enumerate(base)]
    b = [w if i < 85 else f"b{i}" for i, w in enumerate(a)]
    assert minhash.alike(base, a) and minhash.alike(a, b) and not minhash.alike(base, b)
    texts = {1: base, 2: a, 3: b}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    members = spark.createDataFrame([(5, 3, 300, 1, i, [5], 1 if i < 3 else 3) for i in texts], "key long, size long, words long, lead long, doc_id long, keys array<long>, class long")
    assert pairs_left(members.join(signed(spark, [(i, " ".join(t)) for i, t in texts.items()]).select("doc_id", "n", "bag"), "doc_id"), 0.8) == {(2, 3)}
    got = {(r.a, r.b) for r in minhash.verify(spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long"), docs, 0.8).collect()}
    assert got == {(1, 2), (2, 3)}


def test_order_minhash_recall_beside_all_pairs(spark):
    # Groups of six texts of 100 words with scattered edits; links are what aligning all pairs finds.
    rng = random.Random(5)
    rows, edits = [], [4, 8, 12, 16, 18, 19, 20]
    for i in range(180 * len(edits)):
        words = [f"w{rng.randrange(10**6)}" for _ in range(100)] if i % 6 == 0 else list(base)
        base = words if i % 6 == 0 else base
        for p in rng.sample(range(100), edits[i // 180] if i % 6 else 0):
            words[p] = f"w{rng.randrange(10**6)}"
        rows.append([i, " ".join(words)])
    got = by_id(minhash.near_duplicates(frame(spark, rows)))
    split = [t.split() for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i - i % 6, i) if edit_distance(split[i], split[j]) <= 20]
    for k in range(len(edits)):
        own = [(i, j) for i, j in links if i // 180 == k]
        assert len(own) >= 150
        assert sum(got[i].class_id == got[j].class_id for i, j in own) >= 0.95 * len(own)
    assert all(r.class_id // 6 == i // 6 for i, r in got.items())


def test_order_minhash_doc_ids_with_several_texts(spark):
    a, b = ([f"{x}{i}" for i in range(50)] for x in "ab")
    rows = [[1, " ".join(a)], [2, " ".join([*a[:-1], "x"])], [3, " ".join(b)], [2, " ".join([*b[:-1], "x"])], [2, " ".join([*b[:-1], "x"])]]
    assert {r.class_id for r in minhash.near_duplicates(frame(spark, rows)).collect()} == {1}


def test_components_in_many_tasks(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 300) if i % 60] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    one, many = ({r.node: r.component for r in common.components(df, task=t).collect()} for t in (10**6, 40))
    assert one == many and len(one) > 300


@pytest.mark.parametrize("seed", range(2))
def test_order_minhash_classes_are_what_all_links_connect(spark, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for p in rng.sample(range(60), rng.choice([2, 4, 9, 12])):
            words[p] = f"w{rng.randrange(10**6)}"
        rows.append([i, " ".join(words)])
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            if minhash.alike(rows[i][1].split(), rows[j][1].split()):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = by_id(minhash.near_duplicates(frame(spark, rows)))
    assert [got[i].class_id for i in range(60)] == root


# op10


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "x"), (1, 1, "user", "a\\e<s>[b] \\l"), (1, 2, "assistant", None), (1, 3, "assistant", "</s>é\n"), (2, 5, "a]<[\\r", "<s>[user] hi</s>"), (2, 5, None, ""), (3, None, "assistant", "q" * 5000), (3, None, "assistant", "q" * 5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(chat.chain(df))).collect()}
    for c in (1, 2, 3):
        want = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] or 0, x[2] or "", x[3] or ""))]
        assert [(t.role, t.text) for t in got[c].turns] == want
        assert got[c].loss_text == "".join(t for r, t in want if r == "assistant")
    assert chat.format_conversations(chat.chain(df.limit(0))).count() == 0


def test_chat_null_conversation(spark):
    rows = [(None, 0, "user", "hi"), (None, 1, "assistant", "yes"), (None, 2, None, None), (1, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.read_back(chat.format_conversations(chat.chain(df))).collect()}
    assert got == {None: [("user", "hi"), ("assistant", "yes"), ("", "")], 1: [("user", "x")]}


def test_reply_tree_branches(spark):
    nodes = [(1, 1, None, "user", "r", 0.0), (1, 2, 1, "assistant", "good", 2.0), (1, 3, 1, "assistant", "bad", -1.0), (1, 4, 3, "user", "more", 1.0), (1, 5, 99, "user", "orphan", 9.0), (2, 7, 8, "user", "cycle", 1.0), (2, 8, 7, "user", "cycle", 1.0)]
    nodes += [(3, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(40)]
    tree = spark.createDataFrame(nodes, "conv_id long, node long, parent long, role string, text string, score double")
    got = {(r.conv_id, r.leaf): (r.path, r.score) for r in chat.paths(tree).collect()}
    assert got == {(1, 2): ([1, 2], 2.0), (1, 4): ([1, 3, 4], 0.0), (1, 5): ([5], 9.0), (3, 39): (list(range(40)), 0.0)}
    top = {(r.conv_id, r.branch): r.leaf for r in chat.best(chat.paths(tree), 2).collect()}
    assert top == {(1, 1): 5, (1, 2): 2, (3, 1): 39}


def test_extra_conversation(spark, sf):
    r = queries.op10_chat_format(spark, sf).where("conv_id = -7").first()
    t = "</s>[INST] ok [/INST]"
    assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (2, sha(f"user\n{t}\nassistant\n{t}\n"), len(t), sha(t))


# words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("ab é \t\n\x0b\x1c "), max_size=12), max_size=8))
def test_words(texts):
    import pyarrow as pa

    data, at = text.utf8(pa.array(texts, pa.string()))
    starts, ends, first = text.words(data, at)
    raw = data.tobytes()
    got = [[raw[a:b] for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert got == [(t or "").encode().split() for t in texts]
    same = defaultdict(set)
    for h, w in zip(text.hashes(data, starts, ends), [w for g in got for w in g], strict=True):
        same[w].add(int(h))
    assert all(len(v) == 1 for v in same.values()) and len({*map(min, same.values())} if same else set()) == len(same)


def test_tokenizer_file():
    assert PATH == public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

"""Repeated passages by FM-indexes over wavelet matrices.

Every window of ``WINDOW`` words belongs to the smallest hash of its ``ANCHOR``-word grams. Runs of windows with
one such anchor form a segment, and equal windows fall under equal anchors; so the anchors deal segments out to
shards, and only anchors that stand in two documents matter. In a shard the distinct segments of an anchor's documents,
all but the last one, make up one FM-index: the words before each suffix in a wavelet matrix of packed bits with block
counts, and each suffix's document. The segments of all but the first document are then streamed through backward search, which gives
for each window how far it matches (its matching statistic); where that is the whole window, the smallest document
of the interval decides. Windows of anchors that stand very often are dealt out by the window instead, so that no shard holds a frequent
passage's whole context.

Texts are shuffled once, into buckets of about ``BUCKET`` bytes. A bucket tells each shard its anchors, hears which
are shared, sends its distinct segments, and hears one bit for each window: whether it starts in a document before
the bucket's first. What many copies in a bucket share is sent once.

Words are runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. Null texts
have no words. Rows that share a doc_id are one document for the comparison, and each is cut on its own; a null doc_id is
compared with nothing and kept whole. An empty table gives an empty result. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import grams, hashes, mix, utf8, words

WINDOW, ANCHOR = 13, 6
#: Occurrences of an anchor above which its windows are dealt out one by one; bytes of text in a bucket and behind a shard.
OFTEN, BUCKET, SHARD = 2000, 1 << 20, 4 << 20


def anchored(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of the texts: text, anchor's hash, first word (within the text), number of windows."""
    starts = len(word) - WINDOW + 1
    none = np.zeros(0, np.int64)
    if starts <= 0:
        return none, none.astype(np.uint64), none, none
    gram = grams(word, ANCHOR)
    span = WINDOW - ANCHOR + 1
    least = gram.copy()
    width = 1
    while width < span:  # smallest of the next `span` grams
        by = min(width, span - width)
        least = np.minimum(least[: len(least) - by], least[by:])
        width += by
    last = first[1:] - WINDOW
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[:starts]
    inside = np.arange(starts) <= last[doc]
    at = np.flatnonzero(inside)
    if not len(at):
        return none, none.astype(np.uint64), none, none
    a, d = least[at], doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    head = np.flatnonzero(new)
    return d[head], a[head], at[head] - first[:-1][d[head]], np.diff(np.append(head, len(at)))


class WaveletMatrix:
    """Rank over a sequence of small numbers: one row of packed bits and block counts for each bit, the highest first."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)]).view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]).astype(np.uint32)
            self.levels.append((level, packed, before, int(len(bit) - bit.sum())))
            values = np.concatenate([values[~bit], values[bit]])

    def follow(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where ``place`` lands when the symbol's bits are followed down: differences of two places are counts."""
        one = np.uint64(1)
        for level, packed, before, zeros in self.levels:
            block = place >> 6
            ones = before[block].astype(np.int64) + np.bitwise_count(packed[block] & ((one << (place & 63).astype(np.uint64)) - one)).astype(np.int64)
            place = np.where((symbol >> level) & 1, zeros + ones, place - ones)
        return place


class FMIndex:
    """Backward search over words (0 divides segments); suffixes are in order of their first ``WINDOW`` words.

    What is kept is the matrix, the symbols' counts and the suffixes' documents; text and order of the suffixes go.
    """

    def __init__(self, text: np.ndarray, symbols: int, document: np.ndarray | None = None):
        rank = text.astype(np.int64)
        self.text_length = len(text)

        def joined(rank: np.ndarray, by: int) -> np.ndarray:
            later = np.concatenate([rank[by:], np.full(min(by, len(rank)), -1)]) + 1
            return np.unique(rank * (len(text) + symbols + 2) + later, return_inverse=True)[1]

        for by in (1, 2, 4, WINDOW - 8):
            rank = joined(rank, by)
        order = np.argsort(rank, kind="stable")
        self.document = None if document is None else document[order]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        bits = max(1, int(symbols - 1).bit_length())
        self.matrix = WaveletMatrix(text[order - 1], bits)
        self.base = self.matrix.follow(np.arange(symbols), np.zeros(symbols, np.int64))

    def search(self, text: np.ndarray, ends: np.ndarray, most: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each end (exclusive): how many words before it match, at most ``most``, and the rows of that match."""
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.text_length)
        matched, live = np.zeros(len(ends), np.int64), np.arange(len(ends))
        for k in range(1, most + 1):
            live = live[ends[live] - k >= 0]
            symbol = text[ends[live] - k]
            shift = self.before[symbol] - self.base[symbol]
            a = shift + self.matrix.follow(symbol, low[live])
            b = shift + self.matrix.follow(symbol, high[live])
            good = (a < b) & (symbol > 0)
            live = live[good]
            low[live], high[live], matched[live] = a[good], b[good], k
        return matched, low, high


    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest document of each interval of whole windows: such intervals are equal or apart."""
        ends, code = np.unique(np.stack([low, high]), axis=1, return_inverse=True)
        return np.minimum.reduceat(np.append(self.document, self.document[-1]), ends.T.ravel())[::2][code.ravel()] if len(low) else low


def _laid_out(segments: list[np.ndarray], code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments' codes with a 0 after each, the numbers of words, and where each segment begins."""
    n = np.array([len(x) for x in segments], np.int64)
    start = np.cumsum(n + 1) - n - 1
    text = np.zeros(int((n + 1).sum()), np.int64)
    text[np.arange(len(code)) + np.repeat(np.arange(len(n)), n)] = code
    return text, n, start


def stream(segments: list[np.ndarray], documents: np.ndarray, streamed: list[np.ndarray], block: int = 1 << 16) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each streamed segment's windows: how many words back from the window's end are in the index, and the smallest document that holds the whole window.

    The index is made of ``segments``, each of its document. Windows that it doesn't hold have the largest number as document.
    """
    known, code = np.unique(np.concatenate(segments), return_inverse=True)
    text, n, _ = _laid_out(segments, code + 1)
    index = FMIndex(text, len(known) + 2, np.repeat(documents, n + 1))
    flat = np.concatenate(streamed)
    at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
    query, m, start = _laid_out(streamed, np.where(known[at] == flat, at + 1, len(known) + 1))
    windows = m - WINDOW + 1
    which = np.repeat(np.arange(len(m)), windows)
    ends = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows) + start[which] + WINDOW
    depth, found = np.empty(len(ends), np.int64), np.full(len(ends), np.iinfo(np.int64).max)
    for a in range(0, len(ends), block):
        matched, low, high = index.search(query, ends[a : a + block])
        whole = np.flatnonzero(matched >= WINDOW)
        depth[a : a + block] = matched
        found[a + whole] = index.least(low[whole], high[whole])
    cuts = np.cumsum(windows)[:-1]
    return list(zip(np.split(depth, cuts), np.split(found, cuts), strict=True))


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each length, one after another."""
    return np.arange(int(length.sum())) + np.repeat(start - (np.cumsum(length) - length), length)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit, 32-bit or 8-bit numbers after each other, behind their numbers of bytes."""
    return np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(data, np.int64, len(kinds), 8)
    at = 8 * (len(kinds) + 1)
    out = []
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(data, kind, int(size) // np.dtype(kind).itemsize, at))
        at += int(size)
    return out


class Bucket:
    """A bucket's documents in order of doc_id, as words, and their segments."""

    def __init__(self, table: pa.Table):
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        self.texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())
        ids = table.column("doc_id")
        self.null = ids.is_null().to_numpy()
        self.ids = ids.fill_null(0).to_numpy()
        self.id_column = ids
        data, at = utf8(self.texts)
        starts, ends, self.first = words(data, at)
        self.word = hashes(data, starts, ends)
        doc, anchor, start, n = anchored(self.word, self.first)
        known = ~self.null[doc] if len(doc) else np.zeros(0, bool)
        self.doc, self.anchor, self.start, self.n = doc[known], anchor[known], start[known], n[known]

    def tell_anchors(self, shards: int) -> Iterator[tuple[int, bytes]]:
        """For each shard its anchors, how often they stand here, and whether in two documents."""
        order = np.argsort(self.anchor, kind="stable")
        a, d = self.anchor[order], self.ids[self.doc[order]]
        head = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
        if not len(head):
            return
        count, two = np.diff(np.append(head, len(a))), np.minimum.reduceat(d, head) < np.maximum.reduceat(d, head)
        a = a[head]
        shard = (mix(a) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        for s, part in _by(shard, order):
            yield s, _pack(a[part], np.minimum(count[part], (1 << 32) - 1).astype(np.uint32), two[part].astype(np.uint8))

    def segments(self, heard: list[bytes], shards: int) -> tuple:
        """Occurrences (document, first word, windows) of shared anchors and their segment's number; segments by shard."""
        got = [_unpack(x, "u8", "u1") for x in heard]
        anchors, often = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, kind) for k, kind in ((0, np.uint64), (1, np.uint8)))
        order = np.argsort(anchors)
        anchors, often = anchors[order], often[order]
        at = np.minimum(np.searchsorted(anchors, self.anchor), max(0, len(anchors) - 1))
        use = anchors[at] == self.anchor if len(anchors) else np.zeros(len(self.anchor), bool)
        doc, start, n, a = self.doc[use], self.start[use], self.n[use], self.anchor[use]
        alone = often[at[use]].astype(bool) if len(anchors) else np.zeros(0, bool)
        times = np.where(alone, n, 1)
        each = np.repeat(np.arange(len(doc)), times)
        doc, start, n, a, alone = doc[each], start[each] + _ranges(np.zeros(len(times), np.int64), times), np.where(alone, 1, n)[each], a[each], alone[each]
        length = n + WINDOW - 1
        begin = self.first[:-1][doc] + start
        sid = segment_hashes(self.word, begin, length)
        _, first, code = np.unique(sid, return_index=True, return_inverse=True)
        shard = (np.where(alone, sid, mix(a))[first] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        return doc, start, n, code, begin[first], length[first], doc[first], shard, order

    def tell_segments(self, heard: list[bytes], shards: int) -> Iterator[tuple[int, bytes]]:
        *_, begin, length, doc, shard, order = self.segments(heard, shards)
        for s, part in _by(shard, order):
            yield s, _pack(length[part].astype(np.int32), self.ids[doc[part]], self.word[_ranges(begin[part], length[part])])

    def removed(self, heard: list[bytes], bits: dict[int, bytes], shards: int) -> np.ndarray:
        """Whether each word goes."""
        doc, start, n, code, _, length, first_doc, shard, order = self.segments(heard, shards)
        edge = np.zeros(len(self.word) + 1, np.int64)
        if len(code):
            windows = length - WINDOW + 1
            flags = []
            for s, part in _by(shard, order):
                flags.append(np.unpackbits(np.frombuffer(bits[s], np.uint8))[: int(windows[part].sum())])
            ordered = np.concatenate(flags).astype(bool)
            place = np.empty(len(windows), np.int64)
            place[order] = np.cumsum(windows[order]) - windows[order]
            early = ordered[_ranges(place[code], n)]
            early |= np.repeat(self.ids[doc] > self.ids[first_doc[code]], n)
            at = _ranges(self.first[:-1][doc] + start, n)[early]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
        return np.cumsum(edge)[:-1] > 0

    def finish(self, gone: np.ndarray, cut: bool) -> pa.Table:
        digest, kept = [], []
        for text, a, b in zip(self.texts.to_pylist(), self.first[:-1], self.first[1:], strict=True):
            parts = (text or "").encode().split()
            if gone[a:b].any():
                parts = [parts[i] for i in np.flatnonzero(~gone[a:b])]
            whole = b" ".join(parts)
            digest.append(hashlib.sha256(whole).hexdigest())
            kept.append(whole.decode() if cut else None)
        lost = np.concatenate([[0], np.cumsum(gone)])[self.first]
        columns = {"doc_id": self.id_column, "n_words": pa.array(np.diff(self.first).astype(np.int64)), "n_removed": pa.array(np.diff(lost).astype(np.int64)), "kept_sha256": pa.array(digest, pa.string())}
        return pa.table(columns | ({"kept": pa.array(kept, pa.string())} if cut else {}))


def _by(shard: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(order):
        return
    bounds = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0))
    for a, b in zip(bounds, [*bounds[1:], len(order)], strict=True):
        yield int(shard[order[a]]), order[a:b]


def segment_hashes(word: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of words."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    seed = np.uint64(0x9E3779B97F4A7C15)
    power = np.cumprod(np.append(np.uint64(1), np.full(int(length.max()), seed)).astype(np.uint64))
    step = _ranges(np.zeros(len(length), np.int64), length)
    return mix(np.add.reduceat(word[_ranges(begin, length)] * power[step], np.cumsum(length) - length) + length.astype(np.uint64))


_TOLD = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("packed", pa.binary())])
_HEARD = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("shard", pa.int32()), ("packed", pa.binary())])


def remove_repeats(docs: DataFrame, cut: bool = False, bucket: int = BUCKET, shard: int = SHARD, often_from: int = OFTEN) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) for each row: without words under a window that starts in an earlier document."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets, shards = 1 + size // bucket, 1 + size // shard
    # by id and text: rows of one id (or none) are compared by their id alone, so they need not lie together
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket"), F.col("doc_id").cast("long").alias("doc_id"), "text").repartition("bucket")

    def told(pairs: Iterator[tuple[int, bytes]], bucket: int) -> pa.Table:
        pairs = list(pairs)
        return pa.table([pa.array([p[0] for p in pairs], pa.int32()), pa.array([bucket] * len(pairs), pa.int32()), pa.array([p[1] for p in pairs], pa.binary())], schema=_TOLD)

    def anchors(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        return told(Bucket(t).tell_anchors(shards), key[0].as_py())

    def share(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        parts = [_unpack(x, "u8", "u4", "u1") for x in t.column("packed").to_pylist()]
        a, count, two = (np.concatenate([p[k] for p in parts]) for k in range(3))
        of = np.repeat(t.column("bucket").to_numpy(), [len(p[0]) for p in parts])
        order = np.argsort(a, kind="stable")
        head = np.flatnonzero(np.append(True, a[order][1:] != a[order][:-1]))
        size = np.diff(np.append(head, len(a)))
        shared = (size > 1) | (np.add.reduceat(two[order].astype(np.int64), head) > 0)
        often = np.add.reduceat(count[order].astype(np.int64), head) > often_from
        at = order[np.repeat(shared, size)]
        marks = np.repeat(often, size)[np.repeat(shared, size)].astype(np.uint8)
        by = np.argsort(of[at], kind="stable")
        at, marks = at[by], marks[by]
        rows = [(b, _pack(a[at[part]], marks[part])) for b, part in _by(of[at].astype(np.int64), np.arange(len(at)))]
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), pa.array([0] * len(rows), pa.int32()), pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_HEARD)

    def segments(key: tuple[pa.Scalar, ...], t: pa.Table, heard: pa.Table) -> pa.Table:
        if not t.num_rows or not heard.num_rows:
            return _TOLD.empty_table()
        return told(Bucket(t).tell_segments(heard.column("packed").to_pylist(), shards), key[0].as_py())

    def index(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        parts = [_unpack(x, "i4", "i8", "u8") for x in t.column("packed").to_pylist()]
        length, ids, word = (np.concatenate([p[k] for p in parts]) for k in range(3))
        length = length.astype(np.int64)
        begin = np.cumsum(length) - length
        early = [np.zeros(n, bool) for n in length - WINDOW + 1]
        # Of an anchor's documents, the last can't be earlier than any and the first can't be later.
        anchor = np.minimum.reduce([grams(word, ANCHOR)[begin + k] for k in range(WINDOW - ANCHOR + 1)])
        _, group = np.unique(anchor, return_inverse=True)
        high, low = np.full(group.max() + 1, np.iinfo(np.int64).min), np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.maximum.at(high, group, ids)
        np.minimum.at(low, group, ids)
        hash_of = segment_hashes(word, begin, length)
        inside, later = np.flatnonzero(ids < high[group]), np.flatnonzero(ids > low[group])
        if len(inside):
            _, first, code = np.unique(hash_of[inside], return_index=True, return_inverse=True)
            least = np.full(len(first), np.iinfo(np.int64).max)
            np.minimum.at(least, code, ids[inside])
            cut = lambda at: [word[b : b + n] for b, n in zip(begin[at], length[at], strict=True)]
            _, once, code = np.unique(hash_of[later], return_index=True, return_inverse=True)
            answers = stream(cut(inside[first]), least, cut(later[once]))
            for at, c in zip(later, code, strict=True):
                early[at] = answers[c][1] < ids[at]
        early = np.concatenate(early)
        ends = np.concatenate([[0], np.cumsum(length - WINDOW + 1)])[np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])]
        bits = [np.packbits(early[a:b]).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        n = len(bits)
        return pa.table([t.column("bucket").cast(pa.int32()), pa.array([1] * n, pa.int32()), pa.array([key[0].as_py()] * n, pa.int32()), pa.array(bits, pa.binary())], schema=_HEARD)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * cut

    def finish(key: tuple[pa.Scalar, ...], t: pa.Table, heard: pa.Table) -> pa.Table:
        own = Bucket(t)
        kind, shard, packed = (heard.column(c).to_pylist() for c in ("kind", "shard", "packed"))
        anchors = [p for k, p in zip(kind, packed, strict=True) if k == 0]
        bits = {s: p for k, s, p in zip(kind, shard, packed, strict=True) if k == 1}
        return own.finish(own.removed(anchors, bits, shards), cut)

    told_schema, heard_schema = "shard int, bucket int, packed binary", "bucket int, kind int, shard int, packed binary"
    shared = rows.groupBy("bucket").applyInArrow(anchors, told_schema).groupBy("shard").applyInArrow(share, heard_schema)
    sent = rows.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(segments, told_schema)
    answers = sent.groupBy("shard").applyInArrow(index, heard_schema)
    return rows.groupBy("bucket").cogroup(shared.unionByName(answers).groupBy("bucket")).applyInArrow(finish, schema)

"""Byte-level BPE by a table of each byte prefix's last token.

The encoding of a prefix ends in exactly one token that fits the encoding of what precedes it, so one
token per prefix is enough: the ids follow by walking back, bytes can be appended exactly, and after an
edit only the entries up to where the two tables agree again are computed anew.

Nulls and empty texts have no ids. Repeated rows are encoded each on its own; other columns are left out.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

# Unicode white space as the pattern's \s means it, and the letters and numbers of Latin-1.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATIN_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
LATIN_NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_WHITE = r"\t-\r \x85\xa0"


class Encoder:
    """Ids of pieces of bytes under the ranks of one vocabulary."""

    def __init__(self, path: str, pattern: str, most_cached: int = 300_000):
        with open(path, "rb") as file:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bytes = {i: t for t, i in self.rank.items()}
        self.longest = max(map(len, self.rank))
        tails: dict[bytes, set[int]] = {}
        for token in self.rank:
            tails.setdefault(token[-2:], set()).add(len(token))
        self._lengths = {tail: sorted(found, reverse=True) for tail, found in tails.items()}
        self.most_cached = most_cached
        self._halves: dict[int, list[int]] = {}
        self._regular: dict[int, bool] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, bytes] = {}
        self._last: dict[bytes, int] = {}
        self._general = regex.compile(pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE}\p{{L}}\p{{N}}]").replace(r"\s+(?!\S)|\s+", rf"[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"))
        self._latin = re.compile(self._general.pattern.replace(WHITE, LATIN_WHITE).replace(r"\p{L}", f"[{LATIN_LETTERS}]").replace(r"\p{N}", f"[{LATIN_NUMBERS}]").replace(f"[^{LATIN_WHITE}[{LATIN_LETTERS}][{LATIN_NUMBERS}]]", f"[^{LATIN_WHITE}{LATIN_LETTERS}{LATIN_NUMBERS}]"))

    def merge(self, piece: bytes, least: int = 1) -> list[int]:
        """Ids of a short piece by merging, lowest rank first, down to ``least`` of them."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > least:
            rank, at = min((self.rank.get(parts[i] + parts[i + 1], 1 << 32), i) for i in range(len(parts) - 1))
            if rank == 1 << 32:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def halves(self, token: int) -> list[int]:
        """The two tokens that are merged last when the token's bytes are; more if the merges don't reach the token."""
        known = self._halves.get(token)
        if known is None:
            known = self._halves[token] = self.merge(self.bytes[token], 2)
        return known

    def whole(self, token: int) -> bool:
        """Whether merging the token's own bytes gives the token."""
        return len(self.halves(token)) <= 2

    def regular(self, token: int) -> bool:
        """Whether each merge that makes the token has a higher rank than those before it."""
        known = self._regular.get(token)
        if known is None:
            halves = self.halves(token)
            known = self._regular[token] = len(halves) == 1 or len(halves) == 2 and all(self.regular(h) and (h < token or len(self.halves(h)) == 1) for h in halves)
        return known

    def fits(self, before: int, token: int) -> bool:
        """Whether the two tokens stay apart when their bytes are merged together."""
        known = self._fits.get((before, token))
        if known is None:
            if len(self._fits) >= self.most_cached:
                self._fits.clear()
            exact = self.regular(before) and self.regular(token)
            known = self._fits[before, token] = self.apart(before, token) if exact else self.merge(self.bytes[before] + self.bytes[token]) == [before, token]
        return known

    def apart(self, before: int, token: int) -> bool:
        """``fits`` of regular tokens: undo their merges from the last to the first and look at the parts that meet.

        Two parts that meet would merge if that came before each of them is merged into its own token; of equal
        ranks the one further left comes first.
        """
        never = 1 << 32
        a, b, end_a, end_b = before, token, never, never
        while True:
            joined = self.rank.get(self.bytes[a] + self.bytes[b], never)
            if joined < end_a and joined < end_b + (end_b < never):
                return False
            of_a, of_b = self.halves(a), self.halves(b)
            if len(of_a) == 2 and (len(of_b) == 1 or a > b):
                end_a, a = a, of_a[1]
            elif len(of_b) == 2:
                end_b, b = b, of_b[0]
            else:
                return True

    def extend(self, piece: bytes, last: list[int], to: int | None = None) -> list[int]:
        """Fill ``last``, the last token of each prefix of ``piece`` (the empty one's is -1), up to the prefix of ``to`` bytes."""
        rank, lengths = self.rank.get, self._lengths.get
        for end in range(len(last), (len(piece) if to is None else to) + 1):
            for size in (lengths(piece[end - 2 : end], ()) if end > 1 else ()):
                if size > end:
                    continue
                token = rank(piece[end - size : end])
                if token is not None and self.whole(token) and (size == end or self.fits(last[end - size], token)):
                    last.append(token)
                    break
            else:
                last.append(rank(piece[end - 1 : end]))
        return last

    def table(self, piece: bytes) -> list[int]:
        """The table of a short piece, going on from the prefixes that earlier pieces had."""
        known, last = self._last, [-1]
        for end in range(1, len(piece) + 1):
            token = known.get(piece[:end])
            if token is None:
                break
            last.append(token)
        new = len(last)
        if len(known) >= 2 * self.most_cached:
            known.clear()
        for end, token in enumerate(self.extend(piece, last)[new:], new):
            known[piece[:end]] = token
        return last

    def walk(self, last: list[int]) -> list[int]:
        """The ids that a table of last tokens stands for."""
        ids, end = [], len(last) - 1
        while end:
            ids.append(last[end])
            end -= len(self.bytes[last[end]])
        return ids[::-1]

    def edit(self, piece: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replace ``piece[start:end]``; entries before the edit stay, and those after it as soon as a whole token's length agrees."""
        text, shift = piece[:start] + new + piece[end:], len(new) - (end - start)
        table, agree = last[: start + 1], 0
        while len(table) <= len(text):
            n = len(table)
            self.extend(text, table, n)
            old = n - shift
            agree = agree + 1 if old > end and table[n] == last[old] else 0
            if agree >= 2 * self.longest:
                table += last[old + 1 :]
        return text, table

    def split(self, text: str) -> list[str]:
        """The pieces that are encoded separately."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._general.findall(text)
        return self._latin.findall(text)

    def piece(self, piece: str) -> bytes:
        """Ids of one piece as little-endian 32-bit numbers; a piece that is a token is that token."""
        raw = piece.encode()
        token = self.rank.get(raw)
        ids = [token] if token is not None else self.walk(self.table(raw) if len(raw) <= 64 else self.extend(raw, [-1]))
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        if len(raw) <= 64:
            if len(self._pieces) >= self.most_cached:
                self._pieces.clear()
            self._pieces[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        known = self._pieces.get
        return b"".join([known(p) or self.piece(p) for p in self.split(text)])

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, memoryview(packed).cast("I")))


@functools.lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker, which keeps its caches between tasks."""
    return Encoder(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for each row: its text encoded, and the ids decoded again.

    ``ids`` adds the ids themselves, as little-endian 32-bit numbers.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = encoder(path, pattern)
        packed = [own.encode(t or "") for t in batch.column(1).to_pylist()]
        out = [batch.column(0), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()), pa.array([hashlib.sha256(own.decode(p)).hexdigest() for p in packed], pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        return pa.RecordBatch.from_arrays(out + [pa.array(packed, pa.binary())] * ids, names + ["ids"] * ids)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return arrow_map(rows, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * ids)

"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds are email, ip, card (Luhn) and phone. The method adds, where they don't overlap a base span,
IBANs (mod 97) and phone numbers without a country code; the latter need a context word. Words nearby that speak for a
kind raise a span's score, those that speak for other numbers (an order, a version) lower it. Spans of a text are
sorted once, so time follows its length and number of spans. Null and empty texts have no spans.
Positions count code points, ends are exclusive. Repeated rows come back as often as they stand, an empty table gives an empty result.
``scan`` reads two columns and returns its own; ``clean`` returns the columns of its input, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

KINDS = ("email", "ip", "card", "phone", "iban", "local_phone")
# Scores of confirmed spans before context, words that raise them, and lengths of IBANs by country.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.7, "local_phone": 0.3}
CONTEXT = {
    "email": "email e-mail mail contact correo courriel",
    "ip": "ip address host server adresse",
    "card": "card credit visa mastercard payment karte carte tarjeta",
    "phone": "phone tel telephone call mobile fax telefon teléfono téléphone",
    "iban": "iban account bank konto compte cuenta",
    "local_phone": "phone tel telephone call mobile fax telefon teléfono téléphone",
}
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
AGAINST = {
    "email": "",
    "ip": "version release chapter section",
    "card": "order invoice serial tracking isbn",
    "phone": "order invoice serial tracking isbn",
    "iban": "serial part",
    "local_phone": "order invoice serial tracking isbn",
}
RAISE, REACH, LEAST = 0.3, 40, 0.5
_FOR, _AGAINST = ({k: frozenset(words.split()) for k, words in table.items()} for table in (CONTEXT, AGAINST))

_LOCAL_BYTES = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_WORD = re.compile(r"[\w-]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Around each @, so that long words without one cost nothing."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_BYTES:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        free = match.end() if match else at + 1
        if match:
            found.append((start, free))
        at = text.find("@", free)
    return found


def digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


class Free:
    """Whether a span overlaps none of the given ones."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for s, e in sorted(spans):
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def __call__(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end) - 1
        return at < 0 or self.ends[at] <= start


def propose(text: str) -> list[tuple[str, int, int]]:
    """Spans of all kinds that pass their kind's check, without regard to context."""
    found = [("email", *x) for x in emails(text)]
    if not re.search("[0-9]", text):
        return found
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        d = digits(m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    free = Free([(s, e) for _, s, e in found])
    for m in _IBAN.finditer(text):
        iban = m[0].replace(" ", "")
        length = IBAN_LENGTHS.get(iban[:2], 0)
        end = m.start() + next((k for k in range(1, len(m[0]) + 1) if k - m[0][:k].count(" ") == length), 0)
        if length and len(iban) >= length and mod97(iban[:length]) and not text[end : end + 1].isalnum() and free(m.start(), end):
            found.append(("iban", m.start(), end))
    free = Free([(s, e) for _, s, e in found])
    for m in _LOCAL_PHONE.finditer(text):
        if free(*m.span()):
            found.append(("local_phone", *m.span()))
    return found


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's score, raised by a word near the span that speaks for the kind, lowered by one that speaks against it."""
    near = text[max(0, start - REACH) : start] + " " + text[end : end + REACH]
    words = {w.lower() for w in _WORD.findall(near)}
    return min(1.0, max(0.0, SCORES[kind] + RAISE * (bool(words & _FOR[kind]) - bool(words & _AGAINST[kind]))))


def find(text: str, least: float = LEAST) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by start and kind: base spans all, others from the score ``least`` on."""
    scored = [(k, s, e, score(text, k, s, e)) for k, s, e in propose(text)]
    return sorted((x for x in scored if x[0] in KINDS[:4] or x[3] >= least), key=lambda x: (x[1], KINDS.index(x[0])))


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Each run of overlapping spans becomes the name of its first span's kind."""
    out, at = [], 0
    for kind, start, end, _ in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", clean: bool = False) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores[, clean_text]) for each row."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        rows = [find(t) for t in texts]
        say = lambda row: ",".join(f"{k}:{s}:{e}" for k, s, e, _ in row)
        out = [batch.column(0)]
        out += [pa.array([sum(x[0] == kind for x in row) for row in rows], pa.int64()) for kind in KINDS[:4]]
        out.append(pa.array([hashlib.sha256(say([x for x in row if x[0] in KINDS[:4]]).encode()).hexdigest() for row in rows], pa.string()))
        out.append(pa.array([say(row) for row in rows], pa.string()))
        out.append(pa.array([[x[3] for x in row] for row in rows], pa.list_(pa.float64())))
        names = ["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans", "scores"]
        if clean:
            out.append(pa.array([redact(t, row) for t, row in zip(texts, rows, strict=True)], pa.string()))
        return pa.RecordBatch.from_arrays(out, names + ["clean_text"] * clean)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return arrow_map(rows, make, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>" + ", clean_text string" * clean)


def clean(docs: DataFrame) -> DataFrame:
    """The rows of ``documents`` with personal data replaced by its kind; ``n_chars``, where it is a column, made to agree."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if t is None else redact(t, find(t)) for t in batch.column("text").to_pylist()]
        at = batch.schema.get_field_index("text")
        return batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = arrow_map(docs, make, docs.schema)
    return out if "n_chars" not in docs.columns else out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long"))

"""DuckDB SQL for the operators that SQL can express, put together by rule."""

from __future__ import annotations


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text's bytes, bit by bit, as an unsigned number."""
    step = "CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END"
    byte = f"list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda z: 1::UBIGINT)), lambda x, y: {step})"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::UBIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::UBIGINT], {codes}), lambda c, b: {byte}), 4294967295::UBIGINT)"


def _level(name: str, below: str, group: str) -> str:
    """Two tables: ``below``'s nodes with what stands beside them in their run, and the level above."""
    run = f"PARTITION BY {group}, i // 16 ORDER BY i ROWS BETWEEN"
    return f"""{below}_beside AS (
  SELECT {group}, i, n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {below}
), {name} AS (
  SELECT {group}, i // 16 AS i, CASE WHEN any_value(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, (any_value(n) + 15) // 16 AS n
  FROM {below} GROUP BY {group}, i // 16
)"""


def _climb(name: str, start: str, group: str, beside: str, place: str) -> str:
    """``start`` with the root folded, and the siblings written down, one level further."""
    return f"""{name} AS (
  SELECT s.* EXCLUDE (f, p, {place}), s.{place} // 16 AS {place}, CASE WHEN b.n = 1 THEN s.f ELSE sha256(b.before || s.f || b.after) END AS f, s.p || b.before || b.after AS p
  FROM {start} s JOIN {beside} b ON s.{group} IS NOT DISTINCT FROM b.{group} AND s.{place} = b.i
)"""


def merkle(depth: int = 6, crown: int = 4) -> str:
    """The manifest for sources of up to 16^depth rows and up to 16^crown sources."""
    value = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"
    fields = " || ".join(value(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""leaves AS (
  SELECT doc_id, source, sha256({fields} || {value('text')}) AS h,
    CASE WHEN doc_id IS NOT NULL AND {crc32('doc_id::VARCHAR')} % 5 = 0 THEN sha256({fields} || {value(lower)}) END AS other FROM documents
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS place, row_number() OVER () AS uid FROM leaves
), t0 AS (SELECT source, place AS i, h, count(*) OVER (PARTITION BY source) AS n FROM numbered)"""]
    parts += [_level(f"t{k + 1}", f"t{k}", "source") for k in range(depth)]
    parts.append(f"""u0 AS (
  SELECT 0 AS whole, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n FROM t{depth}
)""")
    parts += [_level(f"u{k + 1}", f"u{k}", "whole") for k in range(crown)]
    parts.append("""c0 AS (
  SELECT n.doc_id, n.source, n.h AS leaf, n.place, coalesce(n.other, n.h) AS f, '' AS p, u.h AS subroot, u.i AS above, 0 AS whole
  FROM numbered n JOIN u0 u ON n.source IS NOT DISTINCT FROM u.source
)""")
    parts += [_climb(f"c{k + 1}", f"c{k}", "source", f"t{k}_beside", "place") for k in range(depth)]
    parts += [_climb(f"c{depth + k + 1}", f"c{depth + k}", "whole", f"u{k}_beside", "above") for k in range(crown)]
    last = f"c{depth + crown}"
    return "WITH " + ", ".join(parts) + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = h AS verified FROM {last} JOIN u{crown} USING (whole)
"""


def prefix_trie(family: int = 20, share: int = 4) -> str:
    """All prefixes of the rebuilt conversations, each node's subtree by its members' prefixes."""
    return rf"""WITH said AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations
), own AS (
  SELECT conv_id, list(struct_pack(d := digest, w := words) ORDER BY turn NULLS FIRST, digest) AS turns,
    CASE WHEN conv_id IS NULL THEN 0 ELSE ({crc32('conv_id::VARCHAR')} % {share})::BIGINT END AS h FROM said GROUP BY conv_id
), rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(f.turns, o.turns[1:0])[1:o.h], o.turns[o.h + 1:]) AS turns
  FROM own o LEFT JOIN own f ON f.conv_id = o.conv_id - o.conv_id % {family}
), prefixes AS (
  SELECT conv_id, len(turns) AS n, d, array_to_string(list_transform(turns[1:d], lambda t: t.d), '') AS p, CASE WHEN d > 0 THEN turns[d].w ELSE 0 END AS w
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)
), node AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM prefixes GROUP BY d, p
), born AS (SELECT d - 1 AS d, left(p, (d - 1) * 64) AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL
), counted AS (SELECT n.*, coalesce(b.n_children, 0) AS n_children FROM node n LEFT JOIN born b USING (d, p)
), below AS (
  SELECT a AS d, left(p, a * 64) AS p, sum(own) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM counted) GROUP BY ALL
)
SELECT c.conv_id, c.d::BIGINT AS depth, up.conv_id AS parent_conv_id, c.n_convs, c.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN below b USING (d, p) LEFT JOIN node up ON up.d = c.d - 1 AND up.p = left(c.p, greatest(c.d - 1, 0) * 64)
"""

"""DuckDB SQL that gives the same rows as those training-data operators that SQL can express."""

from __future__ import annotations

#: The 256 steps of crc32, made of its polynomial, as a list.
CRC_STEPS = "(SELECT list(c ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"


def crc32(bytes_of: str, steps: str = "steps") -> str:
    """SQL of the crc32 of a list of bytes."""
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_of}), lambda c, b: xor(c >> 8, {steps}[(xor(c, b) & 255) + 1])), 4294967295)"


def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _levels(name: str, leaves: str) -> str:
    """Nodes of all levels, and what stands left and right of each in its run of three."""
    return f"""{name} AS ({leaves} UNION ALL SELECT g, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY g, level, i // 3, n),
{name}_beside AS (SELECT a.g, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (WHERE b.i > a.i), '') AS r
FROM {name} a JOIN {name} b ON a.g IS NOT DISTINCT FROM b.g AND a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY 1, 2, 3)"""


def _folded(name: str, start: str, levels: str) -> str:
    """Rows of `start` (id, g, level, i, h, proof) carried up, level by level."""
    return f"{name} AS ({start} UNION ALL SELECT f.id, f.g, f.level + 1, f.i // 3, sha256(s.l || f.h || s.r), f.proof || s.l || s.r FROM {name} f JOIN {levels}_beside s ON f.g IS NOT DISTINCT FROM s.g AND f.level = s.level AND f.i = s.i)"


MERKLE = f"""WITH RECURSIVE crc AS (SELECT {CRC_STEPS} AS steps),
judged AS (SELECT *, {crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x))")} % 2 = 0 AS even FROM documents, crc),
leaves AS (SELECT row_number() OVER () AS id, doc_id, source, {_leaf("text")} AS leaf, CASE WHEN even THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS start FROM judged),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves),
{_levels("nodes", "SELECT source AS g, 0 AS level, i, n, leaf AS h FROM placed")},
tops AS (SELECT g, level, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_levels("upper_nodes", "SELECT 0 AS g, 0 AS level, i, n, h FROM tops")},
top AS (SELECT level, h AS root FROM upper_nodes WHERE n = 1),
{_folded("up", "SELECT id, source AS g, 0 AS level, i, start AS h, '' AS proof FROM placed", "nodes")},
{_folded("upper_up", "SELECT up.id, 0 AS g, 0 AS level, tops.i, up.h, up.proof FROM up JOIN tops ON up.g IS NOT DISTINCT FROM tops.g AND up.level = tops.level", "upper_nodes")}
SELECT doc_id, leaf, tops.h AS subroot, root, sha256(u.proof) AS proof_sha256, u.h AS folded_root, u.h = root AS verified
FROM placed JOIN tops ON placed.source IS NOT DISTINCT FROM tops.g JOIN upper_up u USING (id) JOIN top ON u.level = top.level"""

#: The bytes of a text, in UTF-8.
_BYTES = "list_transform(range(1, strlen(f) * 2, 2), lambda j: CAST('0x' || substr(hex(encode(f)), j, 2) AS BIGINT))"

RESAMPLING = f"""WITH crc AS (SELECT {CRC_STEPS} AS steps),
words AS (SELECT row_number() OVER () AS id, doc_id, w FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents)),
target AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
met AS (SELECT id, f, count(*) AS n FROM (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM (SELECT id, w FROM words UNION ALL SELECT 0, w FROM target)) GROUP BY 1, 2),
hashed AS (SELECT f, {crc32(_BYTES)} % 10000 AS b FROM (SELECT DISTINCT f FROM met), crc),
bucketed AS (SELECT id, b, sum(n) AS n FROM met JOIN hashed USING (f) GROUP BY 1, 2),
shares AS (SELECT b, CAST(coalesce(sum(n) FILTER (WHERE id > 0), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (WHERE id = 0), 0) AS DOUBLE) AS t FROM bucketed GROUP BY 1),
gains AS (SELECT b, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM shares) + 10000) / ((s + 1) * ((SELECT sum(t) FROM shares) + 10000)))) AS BIGINT) AS gain FROM shares),
weights AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM bucketed JOIN gains USING (b) GROUP BY 1),
scores AS (SELECT id, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM words LEFT JOIN weights USING (id)),
ranked AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 5 * count(*) OVER () // 100 AS k FROM scores WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= k THEN rank END AS rank FROM scores LEFT JOIN ranked USING (id)"""

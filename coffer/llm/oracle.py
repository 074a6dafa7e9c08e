"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

_KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "list_bool_and(list_transform(string_split(value, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(TRY_CAST(p AS HUGEINT), 256) <= 255))"),
    "card": (
        r"[0-9]([\x20-]?[0-9])+",
        "length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(digits)), lambda i: list_extract([0, 2, 4, 6, 8, 1, 3, 5, 7, 9, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9], CAST(CAST(digits[length(digits) - i] AS INT) + CASE WHEN i % 2 = 1 THEN 1 ELSE 11 END AS BIGINT)))) % 10 = 0",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 9 AND 15"),
}


def _located(name: str, kind: str, rank: int, pattern: str, source: str) -> str:
    """A common table of all matches of a pattern: r, kind, rank, s, e (code points), value."""
    return f"""
{name}_m AS (SELECT r, unnest(regexp_extract_all(text, '{pattern}')) AS value, unnest(string_split_regex(text, '{pattern}')[:-2]) AS gap, generate_subscripts(regexp_extract_all(text, '{pattern}'), 1) AS i FROM {source}),
{name} AS (SELECT r, '{kind}' AS kind, {rank} AS rank, e - length(value) AS s, e, value FROM (SELECT r, value, CAST(sum(length(gap) + length(value)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS e FROM {name}_m))"""


def _personal_data(disclosure: float = 0.8, value_support: int = 2, owner_support: int = 3) -> str:
    located = ",".join(_located(kind, kind, rank, pattern, "docs") for rank, (kind, (pattern, _)) in enumerate(_KINDS.items()))
    spans = " UNION ALL ".join(
        f"SELECT r, kind, rank, s, e, lower(value) AS value FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM {kind}) WHERE {accepted}" for kind, (_, accepted) in _KINDS.items()
    )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM docs),
{located},
spans AS ({spans}),
entities AS (
  SELECT DISTINCT r, kind || ':' || value AS entity, false AS owned FROM spans UNION ALL
  SELECT DISTINCT r, kind || '@' || CASE kind WHEN 'email' THEN split_part(value, '@', 2) WHEN 'ip' THEN array_to_string(string_split(value, '.')[1:3], '.')
    WHEN 'card' THEN substring(regexp_replace(value, '[^0-9]', '', 'g'), 1, 6) ELSE substring(regexp_replace(value, '[^0-9]', '', 'g'), 1, 4) END, true FROM spans),
known AS (SELECT entity, owned, count(*) AS df_e FROM entities JOIN docs USING (r) GROUP BY ALL HAVING count(DISTINCT text) >= CASE WHEN owned THEN {owner_support} ELSE {value_support} END),
holders AS (SELECT * FROM docs WHERE r IN (SELECT r FROM spans)),
{_located("words", "term", 4, r"[\pL\pM]{3,}", "holders")},
terms AS (SELECT w.r, lower(w.value) AS term, w.s, w.e FROM words w WHERE NOT EXISTS (SELECT 1 FROM spans x WHERE x.r = w.r AND x.s < w.e AND w.s < x.e)),
frequency AS (SELECT term, count(*) AS df_t FROM (SELECT DISTINCT r, unnest(regexp_extract_all(lower(text), '[\\pL\\pM]{{3,}}')) AS term FROM docs) GROUP BY term),
pairs AS (
  SELECT entity, owned, term, df_e, df_t, count(*) AS df_te FROM (SELECT DISTINCT r, term FROM terms) JOIN entities USING (r) JOIN known USING (entity, owned) JOIN frequency USING (term) JOIN docs USING (r)
  GROUP BY ALL HAVING count(DISTINCT text) >= CASE WHEN owned THEN {owner_support} ELSE {value_support} END),
told AS (SELECT entity, term FROM pairs, total WHERE df_e < n AND log2((df_te + df_e / n) / (df_t + 1) * n / df_e) / log2(n / df_e) >= {disclosure}),
hidden AS (SELECT DISTINCT r, 'term' AS kind, 4 AS rank, s, e FROM terms JOIN entities USING (r) JOIN told USING (entity, term)),
every AS (SELECT r, kind, rank, s, e FROM spans UNION ALL SELECT * FROM hidden)
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _KINDS)},
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 4), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank), '') AS spans
FROM docs LEFT JOIN every USING (r) GROUP BY r, doc_id"""


#: Every window of 200 bytes is hashed and counted, and runs of repeated windows are cut out.
_REPEATS = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
windows AS (SELECT r, i, md5(b[i + 1 : i + 200]) AS h FROM (SELECT r, b, unnest(range(octet_length(b) - 199)) AS i FROM docs)),
repeated AS (SELECT r, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
runs AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM repeated)),
spans AS (SELECT r, min(i) AS a, max(i) + 200 AS z FROM runs GROUP BY r, g),
edges AS (SELECT r, a, z FROM spans UNION ALL SELECT r, octet_length(b), NULL FROM docs),
pieces AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a, z NULLS LAST), 0) AS from_ FROM edges)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(sum(z - a), 0) AS BIGINT) AS n_removed, count(z) AS n_spans,
  sha256(unhex(string_agg(hex(b[from_ + 1 : a]), '' ORDER BY a, z NULLS LAST))) AS kept_sha256
FROM docs JOIN pieces USING (r) GROUP BY r, doc_id, b"""

ORACLE = {"op3_repeated_strings": _REPEATS, "op7_personal_data": _personal_data()}

"""DuckDB SQL that returns the rows of the queries of this subpackage."""

from __future__ import annotations

#: A vector takes part if it is neither null nor zero and all its components are present and finite.
_USABLE = """embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0"""

OP4 = f"""
WITH v AS (SELECT row_number() OVER () AS id, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {_USABLE}),
p AS (SELECT q.id AS asked, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
      FROM v q JOIN v c ON q.id <> c.id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY asked ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 20
"""

#: Bare upper-case base32 of a SHA-1 in hex digits: 32 groups of five bits.
_BASE32 = """list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST(CAST(substr(bits, 1 + 5 * i, 5)::BIT AS INTEGER) AS INTEGER), 1)), 'string_agg', '')"""

OP3 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS sha, min(page_id) OVER (PARTITION BY sha1(body)) AS first FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(0, 40), lambda i: substr(CAST(CAST(('0x' || substr(sha, 1 + i, 1)) AS INTEGER)::BIT AS VARCHAR), 29, 4)),
      'string_agg', '') AS bits FROM h)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""


def _secrets() -> str:
    """Matches and what lies between them give each span's place."""
    from likeness.llm.secrets import RULES

    parts = []
    for rank, rule in enumerate(RULES):
        pattern = rule.pattern.replace("'", "''")
        parts.append(
            f"SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base, t, regexp_extract_all(t, '{pattern}', 0) AS whole, "
            f"regexp_extract_all(t, '{pattern}', {rule.group}) AS part, string_split_regex(t, '{pattern}') AS gap, {rule.least} AS least FROM d"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
r AS ({" UNION ALL ".join(parts)}),
e AS (SELECT doc_id, rank, kind, base, least, unnest(range(1, len(whole) + 1)) AS i, whole, part, gap FROM r),
s AS (SELECT doc_id, rank, kind, base, length(whole[i]) AS n,
        list_sum(list_transform(gap[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS start
      FROM e WHERE length(part[i]) >= least),
f AS (SELECT doc_id, rank, kind, base, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT) AS line FROM s)
SELECT d.doc_id, count(line) FILTER (kind = 'assign') AS n_assign, count(line) FILTER (kind = 'access') AS n_access, count(line) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(line, ',' ORDER BY start, rank) FILTER (base), '')) AS base_sha256,
       coalesce(string_agg(line, ',' ORDER BY start, rank), '') AS spans
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""


OP7 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS i) WHERE len(w) >= 20),
r AS (SELECT doc_id, list(i) AS hits FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM k) WHERE nth > 1 GROUP BY doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM (SELECT doc_id, unnest(hits) AS s FROM r)),
x AS (SELECT doc_id, i, w[i] AS word FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM x ANTI JOIN g USING (doc_id, i) GROUP BY x.doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

#: Lengths of the controls: <turn>, <body> and </turn>. A backslash and '<' take two characters each.
OP8 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, role || chr(10) || text || chr(10) AS said, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
      19 + length(role) + length(text) + length(regexp_replace(role || text, '[^<\\]', '', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(said, '' ORDER BY turn, role, text)) AS turns_sha256, CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
       sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

#: Sources sorted by how soon three times their size is reached: the first n of them are full, for the least n that
#: leaves the others below. Within a source, documents follow each other by the hash of their id; across sources, by the
#: words served so far over the target, until all words are used up.
OP9 = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS turn FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n FROM d GROUP BY source),
w AS (SELECT source, n, (1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3)::DOUBLE AS weight FROM s),
o AS (SELECT *, row_number() OVER r AS pos, coalesce(sum(3 * n) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
        sum(weight) OVER () - coalesce(sum(weight) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_weight, sum(n) OVER () AS total
      FROM w WINDOW r AS (ORDER BY 3 * n / weight, source)),
v AS (SELECT arg_min((total - full_before) / open_weight, pos) AS level FROM o WHERE (total - full_before) / open_weight * weight <= 3 * n),
t AS (SELECT source, CAST(n AS BIGINT) AS source_size, least(3 * n, level * weight) AS target FROM w, v),
p AS (SELECT doc_id, d.source, size, source_size, target, row_number() OVER (ORDER BY doc_id) AS id,
        coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY turn, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, start + epoch * source_size AS begin FROM p, LATERAL (SELECT unnest([0, 1, 2]) AS epoch) WHERE size > 0 AND start + epoch * source_size < target),
c AS (SELECT id, size, coalesce(sum(size) OVER (ORDER BY (begin + size) / target, source NULLS FIRST, start, epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
g AS (SELECT id, sum(greatest(0, least(size, (SELECT sum(size) FROM d) - before))) AS served FROM c GROUP BY id)
SELECT doc_id, size, source_size, target, CAST(coalesce(served, 0) AS BIGINT) AS taken FROM p LEFT JOIN g USING (id)
"""

ORACLES: dict[str, str] = {
    "op3_warc": OP3, "op4_neighbours": OP4, "op5_secrets": _secrets(), "op7_substrings": OP7,
    "op8_chat": OP8, "op9_mixing": OP9,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

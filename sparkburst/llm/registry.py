"""The corpus queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import alignment, chat, codes, encoding, fingerprints, html_text, jaccard, media, packing, search, secrets, sharding, toxicity

QUERIES = {f.__name__: f for f in (packing.op1_packing, sharding.op2_sharding, toxicity.op3_toxicity, fingerprints.op4_fingerprints, html_text.op5_html, media.op6_jpeg, encoding.op7_bpe, secrets.op8_secrets, chat.op9_chat, jaccard.op10_jaccard, codes.op11_codes, search.op12_search, alignment.op13_alignment)}

#: A conversation as the template writes it: control strings inside texts take a backslash more.
_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
_CHAT = rf"""WITH c AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
sum(length('<|turn|>' || {_ESCAPED.format("role")} || '<|text|>' || {_ESCAPED.format("text")} || '<|end|>'))::BIGINT AS formatted_chars FROM c GROUP BY conv_id"""

#: All pairs of documents that share a shingle, their exact similarity, and what links reach.
_JACCARD = r"""WITH RECURSIVE d AS (SELECT doc_id::BIGINT AS doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS seen FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id"""

_FINITE = "embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda v: NOT isfinite(v))) = 0"


def _codes(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Every round as plain nearest entries and means over all rows; vectors of one width that ``parts`` divides."""
    steps = [f"v AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id::BIGINT AS vec_id, label, list_transform(embedding, lambda c: floor(4096 * c::DOUBLE)::BIGINT) AS x FROM embeddings WHERE {_FINITE})", f"p AS MATERIALIZED (SELECT r, j, list_slice(x, j * (len(x) // {parts}) + 1, (j + 1) * (len(x) // {parts})) AS x FROM v, range({parts}) t(j))", f"c0 AS MATERIALIZED (SELECT j, r - 1 AS e, x AS c FROM p WHERE r <= {entries})"]
    for i in range(rounds + 1):
        away = "list_sum(list_transform(list_zip(p.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
        steps.append(f"n{i} AS MATERIALIZED (SELECT r, p.j, min(({away}, e)) AS m FROM p JOIN c{i} c ON c.j = p.j GROUP BY r, p.j)")
        if i < rounds:
            below = "((s - ((s % n) + n) % n) // n)::BIGINT"
            steps.append(f"s{i} AS (SELECT j, e, k, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT n.j, n.m[2] AS e, unnest(range(len(x))) AS k, unnest(x) AS y FROM n{i} n JOIN p ON p.r = n.r AND p.j = n.j) GROUP BY j, e, k)")
            steps.append(f"u{i} AS (SELECT j, e, list({below} ORDER BY k) AS c FROM s{i} GROUP BY j, e)")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.j, c.e, coalesce(u.c, c.c) AS c FROM c{i} c LEFT JOIN u{i} u ON u.j = c.j AND u.e = c.e)")
    steps.append(f"o AS (SELECT r, string_agg(printf('%02x', m[2]), '' ORDER BY j) AS code, sum(m[1])::BIGINT AS error FROM n{rounds} GROUP BY r)")
    digest = f"(SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY j, e)) FROM c{rounds})"
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, {digest} AS codebooks_sha256 FROM o JOIN v USING (r)"


#: All pairs of a query and another row.
_SEARCH = f"""WITH v AS (SELECT row_number() OVER () AS r, vec_id::BIGINT AS vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings WHERE {_FINITE}),
s AS (SELECT q.r AS qr, q.vec_id AS query_id, c.vec_id, c.r, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST, r)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5"""

ORACLES: dict[str, str] = {"op9_chat": _CHAT, "op10_jaccard": _JACCARD, "op11_codes": _codes(), "op12_search": _SEARCH}

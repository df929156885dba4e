"""SQL equivalents of the vector and secret queries, written independently of the operators."""

from __future__ import annotations

from driftline.llm.secrets import DIGITS, LIMIT, SYMBOLS, WEIGHT, WINDOW

_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_WIDTH, _ENTRIES, _ROUNDS = 16, 256, 4


def _round(r: int) -> str:
    """Assignments `a` of round r and the entries `e` after it."""
    return f"""
        a{r} AS MATERIALIZED (
            SELECT n, p, x, min({_ENTRIES} * list_sum(list_transform(range(1, {_WIDTH} + 1), lambda k: (x[k] - y[k]) * (x[k] - y[k]))) + i) AS best
            FROM parts JOIN e{r} USING (p) GROUP BY n, p, x
        ),
        m{r} AS (
            SELECT p, CAST(best % {_ENTRIES} AS BIGINT) AS i, k, CAST(sum(x[k]) AS BIGINT) AS s, count(*) AS c
            FROM a{r}, (SELECT unnest(range(1, {_WIDTH} + 1)) AS k) GROUP BY ALL
        ),
        e{r + 1} AS MATERIALIZED (
            SELECT p, i, list((s - (s % c + c) % c) // c ORDER BY k) AS y FROM m{r} GROUP BY p, i
            UNION ALL SELECT p, i, y FROM e{r} WHERE NOT EXISTS (SELECT 1 FROM m{r} WHERE m{r}.p = e{r}.p AND m{r}.i = e{r}.i)
        ),"""


_CODES = f"""
        WITH kept AS (
            SELECT row_number() OVER (ORDER BY vec_id, embedding) AS n, vec_id, label,
                   list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE {_FINITE}
        ),
        parts AS MATERIALIZED (
            SELECT n, p, v[{_WIDTH} * p + 1:{_WIDTH} * p + {_WIDTH}] AS x FROM kept, (SELECT unnest(range(4)) AS p)
        ),
        e0 AS MATERIALIZED (SELECT p, n - 1 AS i, x AS y FROM parts WHERE n <= {_ENTRIES}),
        {"".join(_round(r) for r in range(_ROUNDS + 1))}
        books AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, i)) AS h FROM e{_ROUNDS}),
        coded AS (
            SELECT n, string_agg(printf('%02x', CAST(best % {_ENTRIES} AS INT)), '' ORDER BY p) AS code,
                   CAST(sum(best // {_ENTRIES}) AS BIGINT) AS error FROM a{_ROUNDS} GROUP BY n
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
        FROM coded JOIN kept USING (n), books
    """

_NEGATIVES = f"""
        WITH v AS (
            SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND {_FINITE}
        ),
        scored AS (
            SELECT a.id AS anchor, b.id AS near, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
            FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id
        ),
        positives AS (
            SELECT anchor, near AS positive, score AS ps FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, near) <= 5
        )
        SELECT anchor AS anchor_id, positive AS positive_id,
               CAST(row_number() OVER (PARTITION BY anchor, positive ORDER BY score DESC, near) AS INTEGER) AS rank,
               near AS negative_id, ps AS positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor) WHERE NOT same AND 30 * ps <= 100 * score AND 100 * score <= 90 * ps
        QUALIFY rank <= 10
    """

_KEY = "(?i:password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?"
_SECRETS = {
    "assign": f"{_KEY}[A-Za-z0-9+/_.=-]+",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "entropy": f"[A-Za-z0-9+/_=-]{{{WINDOW},}}",
}
_PIECES = " UNION ALL ".join(
    f"SELECT doc_id, t, {o} AS o, '{kind}' AS kind, string_split_regex(t, '{p}') AS gs, regexp_extract_all(t, '{p}') AS ms FROM docs"
    for o, (kind, p) in enumerate(_SECRETS.items(), 1)
)
_COUNT = lambda characters: f"length(regexp_replace(w, '[^{characters}]', '', 'g'))"
_BOUND = f"""CASE WHEN {_COUNT("a-z")} > 0 AND {_COUNT("A-Z")} > 0 THEN CASE WHEN digits >= {DIGITS["mixed"]} THEN {LIMIT["mixed"]} END
                     WHEN regexp_matches(w, '[^0-9a-fA-F]') THEN CASE WHEN digits >= {DIGITS["lower_or_upper"]} THEN {LIMIT["lower_or_upper"]} END
                     WHEN digits >= {DIGITS["hex"]} THEN {LIMIT["hex"]} END"""

_FOUND = f"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        pieces AS ({_PIECES}),
        flat AS (
            SELECT doc_id, t, o, kind, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g FROM pieces WHERE len(ms) > 0
        ),
        placed AS (
            SELECT *, CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id, o ORDER BY i) AS BIGINT) AS e FROM flat
        ),
        base AS (
            SELECT doc_id, o, kind, e - length(m) AS s, e FROM placed WHERE CASE kind
                WHEN 'assign' THEN length(regexp_extract(m, '{_KEY}(.+)$', 1)) >= 12
                WHEN 'access' THEN length(m) >= 18 WHEN 'hex' THEN length(m) >= 16 ELSE false END
        ),
        candidates AS (
            SELECT doc_id, i, m, e - length(m) AS s FROM placed
            WHERE kind = 'entropy' AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')
              AND NOT regexp_matches(m, '(?i)example|sample|dummy|placeholder|change_?me|your_?key|redacted|xxxx')
              AND NOT regexp_matches(m, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$')
              AND NOT regexp_matches(substr(t, greatest(e - length(m) - 24, 0) + 1, least(e - length(m), 24)),
                    '(?i)(sha-?[0-9]{{1,3}}|md5|integrity|checksum|digest|commit|etag)[\\x20"'':=@-]*$|;base64,$')
        ),
        windows AS (
            SELECT doc_id, i, s + k AS s, substr(m, k + 1, {WINDOW}) AS w
            FROM (SELECT *, unnest(range(length(m) - {WINDOW} + 1)) AS k FROM candidates)
        ),
        measured AS (
            SELECT doc_id, i, s, w, {_COUNT("0-9")} AS digits, string_split(w, '') AS cs,
                   len(list_filter(range(1, {WINDOW}), lambda j: abs(ord(w[j + 1]) - ord(w[j])) <= 1)) AS steps FROM windows
        ),
        above AS (
            SELECT doc_id, i, s FROM measured
            WHERE 2 * steps < {WINDOW} AND regexp_matches(w, '[A-Za-z]') AND {_COUNT("+/_=-")} <= {SYMBOLS}
              AND list_sum(list_transform(list_distinct(cs), lambda c: {WEIGHT}[len(list_filter(cs, lambda d: d = c)) + 1])) <= {_BOUND}
        ),
        islands AS (
            SELECT doc_id, i, s, sum(CASE WHEN s - before <= {WINDOW} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, i ORDER BY s) AS island
            FROM (SELECT *, lag(s) OVER (PARTITION BY doc_id, i ORDER BY s) AS before FROM above)
        ),
        stretches AS (SELECT doc_id, min(s) AS s, max(s) + {WINDOW} AS e FROM islands GROUP BY doc_id, i, island),
        spans AS (
            SELECT doc_id, o, kind, s, e FROM base
            UNION ALL SELECT doc_id, 4, 'entropy', s, e FROM stretches x
            WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s <= x.s AND x.e <= b.e)
        ),
        told AS (
            SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
                   count(*) FILTER (kind = 'hex') AS n_hex,
                   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER (o <= 3) AS base,
                   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans
            FROM spans GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM docs LEFT JOIN told USING (doc_id)
    """

ORACLE: dict[str, str] = {"op11_vector_codes": _CODES, "op12_hard_negatives": _NEGATIVES, "op13_secrets": _FOUND}

"""SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import secrets

TOP_K = """
    WITH v AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    ), s AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
    ), r AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
    )
    SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def mixing_sql(weights: dict[str, int], block_rows: int = 16, seed: int = 3) -> str:
    """The schedule's period is simulated slot by slot; c counts the blocks that
    each source has had."""
    case = "CASE source " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in weights.items()) + " ELSE 1 END"
    due = """list_transform(range(len(ws)), lambda i: CASE WHEN c[i + 1] < ws[i + 1] AND (c[i + 1] * total) // ws[i + 1] <= slot
        THEN ((c[i + 1] + 1) * total + ws[i + 1] - 1) // ws[i + 1] ELSE 1000000000 END)"""
    return f"""
    WITH RECURSIVE docs AS (SELECT doc_id, source, coalesce('s' || source, '-') AS s, {case} AS w, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
    used AS (SELECT DISTINCT s, w::BIGINT AS w FROM docs),
    src AS (SELECT list(s ORDER BY s) AS names, list(w ORDER BY s) AS ws, sum(w)::BIGINT AS total FROM used),
    edf AS (
        SELECT 0::BIGINT AS slot, list_transform(ws, lambda x: 0::BIGINT) AS c FROM src
        UNION ALL
        SELECT slot + 1, list_transform(range(len(c)), lambda i: c[i + 1] + CASE WHEN i + 1 = pick THEN 1 ELSE 0 END)
        FROM (SELECT slot, c, list_position(due, list_min(due)) AS pick FROM (SELECT slot, c, {due} AS due FROM edf, src WHERE slot < total))
    ), plan AS (
        SELECT slot, names[pick] AS s, c[pick] AS j, ws[pick] AS w, total
        FROM (SELECT slot, c, names, ws, total, list_position(due, list_min(due)) AS pick FROM (SELECT slot, c, names, ws, total, {due} AS due FROM edf, src WHERE slot < total))
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k, doc_id) - 1 AS r FROM docs),
    placed AS (
        SELECT doc_id, source, r, (r // {block_rows}) // p.w * p.total + p.slot AS mix_slot
        FROM ranked d JOIN plan p ON p.s = d.s AND p.j = (r // {block_rows}) % p.w
    )
    SELECT doc_id, source, mix_slot::BIGINT AS mix_slot, row_number() OVER (ORDER BY mix_slot, r) - 1 AS mix_position FROM placed"""


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def secrets_sql() -> str:
    names = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = {
        "assign": rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "access": secrets.ACCESS, "hex": r"[0-9a-f]{24,}", "candidate": r"[A-Za-z0-9+/_=-]{20,}",
    }
    parts = " UNION ALL ".join(
        f"SELECT doc_id, {rank} AS kind, unnest(f) AS s, unnest(g[1:len(f)]) AS gap, "
        + (f"unnest(v) AS v" if rank == 0 else "NULL AS v") + f", generate_subscripts(f, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, {_q(p)}) AS f, "
        + (f"regexp_extract_all(t, {_q(p)}, 2) AS v, " if rank == 0 else "") + f"string_split_regex(t, {_q(p)}) AS g FROM docs)"
        for rank, p in enumerate(patterns.values())
    )
    bits = "CASE " + " ".join(f"WHEN regexp_matches(s, {_q(p)}) THEN {'NULL' if b is None else b}" for p, b in secrets.CLASS_BITS) + " END"
    allow = " AND ".join(f"NOT regexp_matches(s, {_q(p)})" for p in secrets.ALLOWED)
    kinds = "['" + "', '".join(secrets.KINDS) + "']"
    w = secrets.WINDOW
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    parts AS ({parts}),
    found AS (SELECT doc_id, kind, s, v, sum(length(gap) + length(s)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM parts),
    placed AS (SELECT doc_id, kind, s, v, (stop - length(s))::BIGINT AS start, stop::BIGINT AS stop FROM found),
    base AS (SELECT doc_id, kind, start, stop FROM placed WHERE kind = 1 OR kind = 2 OR kind = 0 AND length(v) >= {secrets.ASSIGN_LEAST}),
    candidates AS (SELECT doc_id, s, start, {bits} AS bits FROM placed WHERE kind = 3 AND {allow}),
    windows AS (SELECT doc_id, start, bits, unnest(range(length(s) - {w - 1})) AS i, s FROM candidates WHERE bits IS NOT NULL),
    chars AS (SELECT doc_id, start, bits, i, unnest(string_split(s[i + 1:i + {w}], '')) AS c FROM windows),
    counts AS (SELECT doc_id, start, bits, i, c, count(*) AS n FROM chars GROUP BY ALL),
    high AS (SELECT doc_id, start, bits, i FROM counts GROUP BY ALL HAVING log2({w}) - sum(n * log2(n)) / {w} >= bits - 1e-9),
    runs AS (SELECT doc_id, 3 AS kind, start + min(i) AS start, start + max(i) + {w} AS stop FROM high GROUP BY doc_id, high.start),
    spans AS (SELECT * FROM base UNION ALL SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.start < r.stop AND b.stop > r.start)),
    said AS (SELECT doc_id, kind, start, {kinds}[kind + 1] || ':' || start || ':' || stop AS x FROM spans)
    SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_entropy,
        sha256(coalesce(string_agg(x, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY start, kind), '') AS spans
    FROM docs d LEFT JOIN said USING (doc_id) GROUP BY d.doc_id"""

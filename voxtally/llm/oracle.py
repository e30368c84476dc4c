"""SQL for the corpus queries that SQL can express, over the same tables."""


def _lower(text: str) -> str:
    """A-Z to lower case."""
    return f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({_lower(text)}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _shingles(words: str, size: int = 5) -> str:
    return (
        f"CASE WHEN len({words}) >= {size} THEN list_distinct(list_transform(range(1, len({words}) - {size - 2}), "
        f"lambda i: array_to_string({words}[i:i + {size - 1}], ' '))) "
        f"WHEN len({words}) > 0 THEN [array_to_string({words}, ' ')] ELSE [] END"
    )


#: kind, pattern, group that must be long enough, its least length
_SECRETS = (
    (
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        2, 6,
    ),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
)


def _secret_spans() -> str:
    """doc_id, k, kind, s, e for every long enough match."""
    parts = [
        f"""
        SELECT doc_id, {k} AS k, '{kind}' AS kind, e - length(w) AS s, e FROM (
            SELECT doc_id, w, v, sum(length(g) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS e
            FROM (
                SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}')) AS w,
                       unnest(regexp_extract_all(t, '{pattern}', {group})) AS v,
                       unnest(string_split_regex(t, '{pattern}')[:-2]) AS g,
                       unnest(range(len(regexp_extract_all(t, '{pattern}')))) AS i
                FROM d
            )
        ) WHERE length(v) >= {least}"""
        for k, (kind, pattern, group, least) in enumerate(_SECRETS)
    ]
    return " UNION ALL ".join(parts)


def _codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Codebooks round by round: a{r} has each part's nearest entry of b{r}, with its distance."""
    bad = "x IS NULL OR NOT isfinite(x)"
    steps = [
        f"""k AS MATERIALIZED (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
            FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: {bad})) = 0
        )""",
        f"""p AS MATERIALIZED (
            SELECT vec_id, part, v[len(v) // {parts} * part + 1:len(v) // {parts} * (part + 1)] AS v
            FROM k, range({parts}) t(part)
        )""",
        f"""b0 AS MATERIALIZED (
            SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, v
            FROM p QUALIFY e < {entries}
        )""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
            SELECT vec_id, part, x // {entries} AS d, x % {entries} AS e FROM (
                SELECT vec_id, part, min({entries} * list_sum(
                    list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i]))
                )::BIGINT + e) AS x
                FROM p JOIN b{r} b USING (part) GROUP BY vec_id, part
            )
        )""")
        if r < rounds:
            steps.append(f"""m{r} AS (
                SELECT part, e, list(m ORDER BY i) AS v FROM (
                    SELECT part, e, i, floor(sum(x) / count(*))::BIGINT AS m FROM (
                        SELECT part, e, unnest(v) AS x, unnest(range(len(v))) AS i
                        FROM p JOIN a{r} USING (vec_id, part)
                    ) GROUP BY part, e, i
                ) GROUP BY part, e
            ),
            b{r + 1} AS MATERIALIZED (
                SELECT part, e, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m USING (part, e)
            )""")
    return f"""
        WITH {", ".join(steps)},
        c AS (
            SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error
            FROM a{rounds} GROUP BY vec_id
        )
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) FROM b{rounds}) AS codebooks_sha256
        FROM k JOIN c USING (vec_id)
    """


ORACLE = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_lower('text')} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM d
    """,
    "op6_decontamination": f"""
        WITH dw AS (SELECT doc_id, {_words('text')} AS w FROM documents),
        ds AS (SELECT doc_id, unnest({_shingles('w')}) AS s FROM dw),
        iw AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
        il AS (SELECT item_id, {_shingles('w')} AS l FROM iw),
        i AS (SELECT item_id, len(l) AS n, unnest(l) AS s FROM il)
        SELECT doc_id, item_id, count(*) AS matched, any_value(n)::BIGINT AS shingles,
               count(*) / any_value(n) AS containment
        FROM ds JOIN i USING (s) GROUP BY doc_id, item_id
        HAVING count(*) * 5 >= any_value(n) * 4
    """,
    "op8_secrets": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        spans AS ({_secret_spans()}),
        f AS (
            SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b,
                   count(*) FILTER (k = 2) AS c,
                   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base,
                   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS every
            FROM spans GROUP BY doc_id
        )
        SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
               sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
        FROM d LEFT JOIN f USING (doc_id)
    """,
    "op12_vector_codes": _codes(),
}

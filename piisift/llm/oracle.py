"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


def _periodic_runs() -> str:
    """Word pairs at each distance, their islands, and of islands that cover each other those of the least distance."""
    return r"""
        WITH RECURSIVE t AS (
            SELECT doc_id, coalesce(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x), []) AS w FROM documents
        ), crc_table AS (
            SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i)
        ), crc AS (SELECT list(c ORDER BY i) AS tab FROM crc_table), h AS (
            SELECT doc_id, w, CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
                lambda c, b: xor(c // 256, tab[CAST(xor(c & 255, b) AS BIGINT) + 1])), 4294967295) END AS h FROM t, crc
        ), g AS (
            SELECT doc_id, w, h, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM h
        ), edited AS (
            SELECT doc_id, row_number() OVER () AS row, CASE WHEN h % 10 = 0 AND n > 0
                THEN list_concat(w[1:a], list_transform(range(a, n), lambda i: w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1])) ELSE w END AS w, n FROM g
        ), word AS (SELECT row, unnest(w) AS word, unnest(range(n)) AS i FROM edited),
        often AS (SELECT row, word FROM word GROUP BY ALL HAVING count(*) >= 3),
        pair AS (
            SELECT a.row, a.i, b.i - a.i AS q FROM (SELECT * FROM word SEMI JOIN often USING (row, word)) a JOIN (SELECT * FROM word SEMI JOIN often USING (row, word)) b
            ON a.row = b.row AND a.word = b.word AND a.i < b.i
        ), island AS (
            SELECT row, q, min(i) AS s, count(*) + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS k FROM pair) GROUP BY row, q, k HAVING count(*) + q >= greatest(24, 3 * q)
        ), run AS (
            SELECT * FROM island x WHERE NOT EXISTS (SELECT 1 FROM island y WHERE y.row = x.row AND y.q < x.q AND y.s <= x.s AND x.s + x.l <= y.s + y.l)
        ), listed AS (
            SELECT row, count(*) AS n_runs, arg_max({'s': s, 'l': l, 'q': q}, [l / q, -s, -q]) AS best, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM run GROUP BY row
        ), kept AS (
            SELECT row, string_agg(word, ' ' ORDER BY i) AS collapsed FROM word WHERE NOT EXISTS (SELECT 1 FROM run WHERE run.row = word.row AND word.i >= run.s + run.q AND word.i < run.s + run.l) GROUP BY row
        )
        SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
            CAST((1000 * best.l) // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
        FROM edited LEFT JOIN listed USING (row) LEFT JOIN kept USING (row)
    """


def _clusters(k: int, rounds: int) -> str:
    """One pair of relations a round: the assignment and the centroids that follow from it."""
    distance = "list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"""v AS (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, e) - 1 AS cluster, e FROM v QUALIFY cluster < {k})"""
    ]
    nearest = "SELECT v.row, arg_min(c.cluster, [{d}, c.cluster]) AS cluster, CAST(min({d}) AS BIGINT) AS distance FROM v, c{r} c GROUP BY v.row"
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(d=distance, r=r)})")
        steps.append(f"s{r} AS (SELECT cluster, d, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, unnest(range(64)) AS d FROM v JOIN a{r} USING (row)) GROUP BY cluster, d)")
        steps.append(f"m{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS e FROM s{r} GROUP BY cluster)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{r} m USING (cluster))")
    steps.append(f"a AS MATERIALIZED ({nearest.format(d=distance, r=rounds)})")
    return f"""
        WITH {", ".join(steps)}
        SELECT v.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
            CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
        FROM a JOIN v USING (row) JOIN c{rounds} c USING (cluster)
    """


def _fingerprints() -> str:
    """Word hashes have 60 bits and turn by at most 4, so shifting by multiplication stays within 64."""
    gram = "xor(xor(xor(xor(h[i] * 16, h[i + 1] * 8), h[i + 2] * 4), h[i + 3] * 2), h[i + 4])"
    short = "list_reduce(list_prepend(0::UBIGINT, h), lambda c, x: xor(c * 2, x))"
    key = "CAST((g[i] // 1048576) & 2147483647 AS BIGINT) * 2147483648 + 2147483648 - i"
    return rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
        n AS (
            SELECT doc_id, t, n, coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id, coalesce(lead(t) OVER o, first_value(t) OVER o) AS u
            FROM d WINDOW o AS (ORDER BY doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
        ), e AS (SELECT doc_id, next_id, t, n, substring(t, 1, n - n // 4) || substring(u, 1, n // 4) AS x FROM n),
        texts AS (SELECT doc_id, false AS edited, t AS x FROM e UNION ALL SELECT doc_id, true, x FROM e),
        hashes AS (SELECT doc_id, edited, list_transform(regexp_extract_all(x, '[^ 	-]+'), lambda w: CAST('0x' || substring(md5(w), 1, 15) AS UBIGINT)) AS h FROM texts),
        grams AS (
            SELECT doc_id, edited, CASE WHEN len(h) = 0 THEN [] WHEN len(h) < 5 THEN [{short}] ELSE list_transform(range(1, len(h) - 3), lambda i: {gram}) END AS g FROM hashes
        ), keys AS (SELECT doc_id, edited, g, list_transform(range(1, len(g) + 1), lambda i: {key}) AS k FROM grams),
        chosen AS (
            SELECT doc_id, edited, g, list_sort(list_distinct(list_transform(list_transform(range(1, greatest(len(k) - 7, least(len(k), 1)) + 1), lambda i: list_min(k[i:i + 7])), lambda x: 2147483647 - x % 2147483648))) AS p FROM keys
        ), prints AS (
            SELECT doc_id, edited, list_distinct(list_transform(p, lambda i: g[i + 1])) AS s, array_to_string(list_transform(p, lambda i: printf('%X', g[i + 1]) || '@' || i), ' ') AS f FROM chosen
        ), near AS (
            SELECT e.doc_id, e.n, e.x, a.f, b.f AS ef, a.s AS s, len(list_intersect(a.s, b.s)) AS ci, len(b.s) AS cb, len(list_intersect(a.s, c.s)) AS di, len(c.s) AS cc
            FROM e JOIN prints a ON a.doc_id IS NOT DISTINCT FROM e.doc_id AND NOT a.edited JOIN prints b ON b.doc_id IS NOT DISTINCT FROM e.doc_id AND b.edited
            JOIN prints c ON c.doc_id IS NOT DISTINCT FROM e.next_id AND NOT c.edited
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(x) AS edited_sha256, f AS fingerprint, ef AS edited_fingerprint,
            CASE WHEN len(s) + cb = 0 THEN 1.0::DOUBLE ELSE ci / (len(s) + cb - ci) END AS near_edited, CASE WHEN len(s) + cc = 0 THEN 1.0::DOUBLE ELSE di / (len(s) + cc - di) END AS near_next
        FROM near
    """


ORACLE: dict[str, str] = {
    "op5_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY ALL)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
    "op2_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents
        ), s AS (
            SELECT doc_id, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 4 THEN [array_to_string(t, ' ')]
                ELSE list_distinct(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' '))) END AS g FROM w
        ), n AS (SELECT doc_id, len(g) AS n FROM s), x AS (SELECT doc_id, unnest(g) AS h FROM s),
        links AS (
            SELECT p.a, p.b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL) p
            JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * c >= 85 * (na.n + nb.n - c)
        ), reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, r.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = n.doc_id
    """,
    "op6_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10
    """,
    "op11_periodic_runs": _periodic_runs(),
    "op12_centroid_clusters": _clusters(16, 3),
    "op13_fingerprints": _fingerprints(),
}

"""DuckDB SQL with the same results as the queries of this package, where SQL can express them."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH normal AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept,
               sha256(norm) AS text_sha256
        FROM normal WINDOW same AS (PARTITION BY norm)
    """,
}


def _license_sql() -> str:
    """The scan, its index and its IDF weights in SQL; the templates come in as rows."""
    from lorekeep.llm import license_scan as L

    postings = ", ".join(f"({n}, '{w}', '{label}', {at}, {inside})" for n, w, label, at, inside in L._postings())
    lead = "lead(word, {0}) OVER (PARTITION BY doc_id ORDER BY place)"
    base = "CASE " + " ".join(
        f"WHEN word = '{words[0]}'" + "".join(f" AND {lead.format(k)} = '{w}'" for k, w in enumerate(words[1:], 1)) + f" THEN '{label}'"
        for words, label in L.BASE
    ) + " END"
    return rf"""
        WITH postings(number, word, label, spot, inside) AS (VALUES {postings}),
        files AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM files),
        hits AS (SELECT doc_id, word, place, {base} AS base FROM placed),
        idf AS (
            SELECT word, 1 + ln((1 + (SELECT count(*) FROM documents)) / (1 + coalesce(n, 0))) AS idf
            FROM (SELECT DISTINCT word FROM postings) LEFT JOIN (SELECT word, count(DISTINCT doc_id) AS n FROM placed GROUP BY 1) USING (word)),
        weighed AS (SELECT *, round({L.UNIT} * idf)::bigint AS weight FROM postings JOIN idf USING (word)),
        whole AS (SELECT number, sum(weight) AS whole, count(*) FILTER (inside) AS length FROM weighed GROUP BY 1),
        votes AS (
            SELECT doc_id, number, label, place - spot AS start, sum(weight) AS matched, count(*) FILTER (inside) AS inside
            FROM hits JOIN weighed USING (word) GROUP BY 1, 2, 3, 4),
        verified AS (SELECT doc_id, label, matched / whole AS score FROM votes JOIN whole USING (number) WHERE inside = length AND matched >= {L.GATE} * whole),
        based AS (
            SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
                   string_agg(DISTINCT base, ',' ORDER BY base) AS base_labels FROM hits WHERE base IS NOT NULL GROUP BY 1),
        every AS (SELECT doc_id, label FROM verified UNION SELECT doc_id, base FROM hits WHERE base IS NOT NULL),
        labelled AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY 1),
        scored AS (SELECT doc_id, max(score) AS score FROM verified GROUP BY 1)
        SELECT f.doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
        FROM files f LEFT JOIN based USING (doc_id) LEFT JOIN labelled USING (doc_id) LEFT JOIN scored USING (doc_id)
    """


ORACLE_SQL["op5_license_scan"] = _license_sql()


def _lines_sql() -> str:
    """Similar earlier lines in SQL: word sets, the same prefix bound on words by rarity, Jaccard on the sets."""
    from lorekeep.llm import line_dedup as D

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    t = D.SIMILARITY
    return rf"""
        WITH split AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS number
            FROM documents),
        lines AS (
            SELECT doc_id, number, list_sort(list_distinct(regexp_extract_all(translate(line, '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+'))) AS words FROM split),
        placed AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, number) AS spot FROM lines WHERE len(words) > 0),
        sets AS (SELECT words, min(spot) AS first FROM placed GROUP BY 1),
        flat AS (SELECT first, len(words) AS n, unnest(words) AS word FROM sets),
        rare AS (SELECT word, count(*) AS df FROM flat GROUP BY 1),
        ranked AS (SELECT first, n, word, row_number() OVER (PARTITION BY first ORDER BY df, word) AS k FROM flat JOIN rare USING (word)),
        prefix AS (SELECT first, n, word FROM ranked WHERE k <= n - ceil({t} * n - 1e-9) + 1),
        pairs AS (
            SELECT DISTINCT x.first AS x, y.first AS y FROM prefix x JOIN prefix y USING (word)
            WHERE y.first < x.first AND least(x.n, y.n) >= {t} * greatest(x.n, y.n) - 1e-9),
        matched AS (
            SELECT DISTINCT p.x AS first FROM pairs p JOIN sets a ON a.first = p.x JOIN sets b ON b.first = p.y
            WHERE len(list_intersect(a.words, b.words)) >= ceil({t} / (1 + {t}) * (len(a.words) + len(b.words)) - 1e-9)),
        told AS (
            SELECT doc_id, number, spot > first OR m.first IS NOT NULL AS removed FROM placed JOIN sets USING (words) LEFT JOIN matched m USING (first)),
        per AS (
            SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed,
                   string_agg(number::varchar, ',' ORDER BY number) FILTER (removed) AS removed_lines FROM told GROUP BY 1)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed_lines, '') AS removed_lines
        FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN per ON per.doc_id IS NOT DISTINCT FROM d.doc_id
    """


ORACLE_SQL["op10_line_dedup"] = _lines_sql()


ORACLE_SQL["op11_suffix_dedup"] = r"""
    WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS code FROM documents),
    sized AS (SELECT *, (length(code) // 2)::bigint AS n_bytes FROM texts),
    parts AS (
        SELECT doc_id, n_bytes, o, substr(code, 2 * o + 1, 2 * (1000 + 99)) AS part
        FROM (SELECT *, unnest(range(0, greatest(n_bytes - 99, 0), 1000)) AS o FROM sized)),
    strings AS (
        SELECT doc_id, o + k AS start, substr(part, 2 * k + 1, 200) AS string
        FROM (SELECT *, unnest(range(0, least(1000, n_bytes - 99 - o))) AS k FROM parts)),
    numbered AS (SELECT *, coalesce(doc_id, 9223372036854775807::hugeint + 1) * 4294967296::hugeint + start AS place FROM strings),
    earliest AS (SELECT string, min(place) AS first, count(*) AS n FROM numbered GROUP BY 1 HAVING count(*) > 1),
    repeats AS (SELECT doc_id, start FROM numbered JOIN earliest USING (string) WHERE place > first),
    runs AS (
        SELECT doc_id, start, CASE WHEN start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) <= 100 THEN 0 ELSE 1 END AS new FROM repeats),
    spans AS (
        SELECT doc_id, min(start) AS a, max(start) + 100 AS b
        FROM (SELECT doc_id, start, sum(new) OVER (PARTITION BY doc_id ORDER BY start) AS run FROM runs) GROUP BY doc_id, run),
    gone AS (SELECT doc_id, sum(b - a)::bigint AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS froms, list(b ORDER BY a) AS tos FROM spans GROUP BY 1)
    SELECT s.doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
           sha256(unhex(CASE WHEN n_spans IS NULL THEN code ELSE list_aggregate(list_transform(
               range(1, n_spans + 2),
               lambda i: substr(code, (2 * CASE WHEN i = 1 THEN 0 ELSE tos[i - 1] END + 1)::bigint,
                           (2 * (CASE WHEN i > n_spans THEN n_bytes ELSE froms[i] END - CASE WHEN i = 1 THEN 0 ELSE tos[i - 1] END))::bigint)
           ), 'string_agg', '') END)) AS kept_sha256
    FROM sized s LEFT JOIN gone ON gone.doc_id IS NOT DISTINCT FROM s.doc_id
"""

ORACLE_SQL["op12_hard_negatives"] = r"""
    WITH good AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::double)) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    scored AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, list_dot_product(a.v, b.v)::bigint AS score
        FROM good a JOIN good b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    positives AS (
        SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE alike
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
    SELECT anchor_id, positive_id, (row_number() OVER w)::int AS rank, other AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
    QUALIFY rank <= 10
"""


def _codes_sql() -> str:
    """Two rounds of assignment and means in SQL, then the codes."""
    from lorekeep.llm import vector_codes as V

    def assign(book: str) -> str:
        return f"""
            SELECT vec_id, label, part, arg_min(entry, d * 1000 + entry) AS entry, min(d)::bigint AS d
            FROM (SELECT p.vec_id, p.label, p.part, b.entry,
                         list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint AS d
                  FROM cut p JOIN {book} b USING (part)) GROUP BY ALL"""

    steps = []
    for r in range(V.ROUNDS):
        steps.append(f"assigned{r} AS ({assign(f'book{r}')})")
        steps.append(f"""means{r} AS (
            SELECT part, entry, list(m ORDER BY spot) AS v
            FROM (SELECT c.part, a.entry, i AS spot, floor(sum(c.v[i]) / count(*))::bigint AS m
                  FROM cut c JOIN assigned{r} a USING (vec_id, part), range(1, width + 1) t(i) GROUP BY ALL) GROUP BY 1, 2)""")
        steps.append(f"book{r + 1} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN means{r} m USING (part, entry))")
    last = f"book{V.ROUNDS}"
    return f"""
        WITH good AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: floor({V.SCALE} * x::double)::bigint) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        cut AS (
            SELECT vec_id, label, part, v[part * len(v) // {V.PARTS} + 1 : (part + 1) * len(v) // {V.PARTS}] AS v, len(v) // {V.PARTS} AS width
            FROM good, range({V.PARTS}) t(part)),
        book0 AS (
            SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v
            FROM cut QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {V.ENTRIES}),
        {', '.join(steps)},
        final AS ({assign(last)}),
        coded AS (
            SELECT vec_id, label, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::bigint AS error FROM final GROUP BY 1, 2),
        digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM {last})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, codebooks_sha256 FROM coded, digest
    """


ORACLE_SQL["op13_exponion_codes"] = _codes_sql()

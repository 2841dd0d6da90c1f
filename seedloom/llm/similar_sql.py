"""DuckDB statements of the similarity queries: pairs by prefixes of their rarest 3-grams, which loses none, then counted.

Those of p1 and p2 take 100 seconds on 3,000 rows, so only the tests use them, on the smallest tables.
"""

from __future__ import annotations

# The characters that Unicode lists as White_Space, as the engine's expressions spell them.
SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def pairs(left: str, right: str, also: str = "true", threshold: float = 0.7) -> str:
    """CTE near (a, b): similar pairs of the relations (id, text, ..) ``left``, l, and ``right``, r, that fulfil ``also``.

    A pair of similarity t shares at least t n of the n 3-grams of either text, so it shares one of any n - ceil(t n) + 1
    of them: of each text the rarest so many are joined, and the pairs that meet are compared in full.
    """
    sides = {"l": left, "r": right}
    grams = ", ".join(
        f"{s}_v AS (SELECT *, lower(regexp_replace(text, '[{SPACE}]+', ' ', 'g')) AS v FROM {t} WHERE text IS NOT NULL), "
        f"{s}_e AS (SELECT id, len(g) AS n, unnest(g) AS gram FROM (SELECT id, list_distinct(list_transform(range(1, length(v) - 1), lambda i: substr(v, i, 3))) AS g FROM {s}_v WHERE length(v) >= 3))"
        for s, t in sides.items()
    )
    # each 3-gram as its place in the order of rarity; the least ones of a text are its rarest
    numbered = ", ".join(
        f"{s}_n AS (SELECT id, n, no FROM {s}_e JOIN often USING (gram)), {s}_g AS (SELECT id, any_value(n) AS n, list(no ORDER BY no) AS g FROM {s}_n GROUP BY id), "
        f"{s}_p AS (SELECT id, n, unnest(g[:(n - ceil({threshold} * n - 1e-9) + 1)::BIGINT]) AS no FROM {s}_g)"
        for s in sides
    )
    return f"""{grams}, often AS (SELECT gram, row_number() OVER (ORDER BY count(*), gram)::INTEGER AS no FROM (SELECT gram FROM l_e UNION ALL SELECT gram FROM r_e) GROUP BY gram), {numbered},
    met AS (SELECT DISTINCT l_p.id AS a, r_p.id AS b FROM l_p JOIN r_p USING (no) WHERE l_p.n >= {threshold} * r_p.n - 1e-9 AND r_p.n >= {threshold} * l_p.n - 1e-9),
    scored AS (SELECT a, b, len(list_intersect(x.g, y.g)) AS shared, x.n AS n, y.n AS m FROM met JOIN l_g x ON x.id = a JOIN r_g y ON y.id = b JOIN l_v l ON l.id = a JOIN r_v r ON r.id = b WHERE {also}),
    near AS (SELECT a, b FROM scored WHERE shared / (n + m - shared) >= {threshold})"""


_ROWS = "(SELECT row_id AS id, text, batch_no AS batch FROM synthetic_data)"
_EVALUATION = "(SELECT row_id AS id, text FROM valid UNION ALL SELECT row_id, text FROM test)"
_OVERLAPS = pairs("(SELECT row_id AS id, text FROM train)", _EVALUATION)

P1_FOUND_SQL = f"WITH {pairs(_ROWS, _ROWS, 'l.batch < r.batch')} SELECT DISTINCT b AS row_id FROM near"

P2_FOUND_SQL = f"""
WITH RECURSIVE {pairs(_ROWS, _ROWS, 'a < b')},
both_ways AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT a AS id, b AS other FROM both_ways UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other)
SELECT least(id, min(other)) AS group_id, id AS row_id FROM reach GROUP BY id
"""

P3_FOUND_SQL = f"""
WITH {_OVERLAPS}, split AS (SELECT row_id, 'valid' AS eval_split FROM valid UNION ALL SELECT row_id, 'test' FROM test)
SELECT a AS train_row_id, b AS eval_row_id, eval_split FROM near JOIN split ON row_id = b
"""

P3_OVERLAP_REPORT_SQL = f"""
WITH {_OVERLAPS}, split AS (SELECT row_id, source, 'valid' AS eval_split FROM valid UNION ALL SELECT row_id, source, 'test' FROM test),
per AS (SELECT b AS row_id, count(*) AS k FROM near GROUP BY b)
SELECT eval_split, source, count(*) AS records, count(k) AS overlapping_records, coalesce(sum(k), 0)::BIGINT AS pairs FROM split LEFT JOIN per USING (row_id) GROUP BY ALL
"""

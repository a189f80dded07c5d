"""DuckDB SQL of the queries that SQL can express, over the driver's tables."""

from __future__ import annotations

from . import secrets, urlfilter

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(separators: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{separators}]+')"


TOPK = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.c, v.c) AS BIGINT) AS score
          FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.c) = len(v.c) WHERE q.vec_id % 50 = 0),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

# Links between rows of distinct sets; rows with equal sets are one node, and components are what links reach.
NEAR = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, {_words('\x20\x09-\x0D')} AS w FROM documents),
    s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS sh FROM w),
    node AS (SELECT sh, min(doc_id) AS id FROM s WHERE len(sh) > 0 AND doc_id IS NOT NULL GROUP BY sh),
    one AS (SELECT id, len(sh) AS n, unnest(sh) AS x FROM node),
    pair AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM one a JOIN one b ON a.x = b.x AND a.id < b.id GROUP BY ALL),
    link AS (SELECT a, b FROM pair WHERE 100 * common >= 80 * (na + nb - common)),
    way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach(a, b) AS (SELECT id, id FROM node UNION SELECT r.a, y.b FROM reach r JOIN way y ON r.b = y.a),
    least AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, CASE WHEN s.doc_id IS NOT NULL THEN coalesce(c.component_id, s.doc_id) END AS component_id,
        coalesce(s.doc_id = coalesce(c.component_id, s.doc_id), true) AS kept
    FROM s LEFT JOIN node USING (sh) LEFT JOIN least c ON c.id = node.id"""

WINDOWS = rf"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_words('\x00-\x2F\x3A-\x60\x7B-\x7F')} AS w FROM documents),
    b AS (SELECT item_id, {_words('\x00-\x2F\x3A-\x60\x7B-\x7F')} AS w FROM benchmark),
    bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS k, array_to_string(w[i : i + 9], ' ') AS win
           FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
    dw AS (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw))),
    hit AS (SELECT r, i, dw.k, item FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k),
    n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM hit)) GROUP BY r),
    m AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit WHERE item IS NOT NULL) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)"""


def _spans() -> str:
    """Rows (r, k, kind, i, j) of all rules: places come from the lengths of matches and of what is between them."""
    parts = []
    for k, rule in enumerate(secrets.BASE + secrets.ADDED):
        p = rule.pattern.replace("'", "''")
        sign = r"""["'']?\x20*[:=]\x20*["'']?"""
        value = f"regexp_replace(m, '^[A-Za-z_]+{sign}', '')" if rule.assigns else "m"
        parts.append(f"""SELECT r, {k} AS k, '{rule.kind}' AS kind, m, before + gap AS i, before + gap + length(m) AS j FROM (
            SELECT r, m, sum(length(p)) OVER o AS gap, sum(length(m)) OVER o - length(m) AS before FROM (
                SELECT r, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(list_slice(string_split_regex(t, '{p}'), 1, len(regexp_extract_all(t, '{p}')))) AS p,
                    unnest(range(1, len(regexp_extract_all(t, '{p}')) + 1)) AS place FROM t WHERE regexp_matches(t, '{p}'))
            WINDOW o AS (PARTITION BY r ORDER BY place ROWS UNBOUNDED PRECEDING)) WHERE length({value}) >= {rule.least}""")
    return " UNION ALL ".join(parts)


_base = ", ".join(f"'{r.kind}'" for r in secrets.BASE)
SECRETS = rf"""
    WITH t AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents), s AS ({_spans()}),
    g AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{x.kind}') AS n_{x.kind}" for x in secrets.BASE)},
        string_agg(kind || ':' || i || ':' || j, ',' ORDER BY i, k) FILTER (kind IN ({_base})) AS base, string_agg(kind || ':' || i || ':' || j, ',' ORDER BY i, k) AS spans
        FROM (SELECT r, k, kind, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j FROM s) GROUP BY r)
    SELECT doc_id, {", ".join(f"CAST(coalesce(n_{x.kind}, 0) AS BIGINT) AS n_{x.kind}" for x in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM t LEFT JOIN g USING (r)"""

URL_LEVELS = 12  # segments of a path that the SQL goes down


def _urls(most_branches: int = 50, strength: str = "5e0", prior: str = "1e-1", reject: str = "8e-1", z: str = "1.96e0") -> str:
    rules = sorted(urlfilter.RULES, key=lambda r: -len(r[1]) - len(r[2]))
    fits = [(v, h + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for v, h, p in rules]
    rule, verdict = (f"CASE {' '.join(f'WHEN {f} THEN ' + chr(39) + x[k] + chr(39) for *x, f in fits)} END" for k in (1, 0))
    end = r"\.[A-Za-z]{1,5}$"
    stem = f"regexp_replace(x, '{end}', '')"
    shape = rf"""CASE WHEN regexp_full_match({stem}, '[0-9]+') THEN '{{n}}' WHEN regexp_full_match({stem}, '[0-9]{{4}}-[0-9]{{2}}(-[0-9]{{2}})?') THEN '{{date}}'
        WHEN regexp_full_match({stem}, '[0-9a-fA-F-]{{8,}}') AND regexp_matches({stem}, '[0-9]') THEN '{{hex}}' WHEN length({stem}) >= 12 AND regexp_matches({stem}, '[0-9]') THEN '{{id}}' END"""
    sql = rf"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
    base AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS said,
        list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: coalesce(({shape}) || regexp_extract(x, '{end}'), x)) AS s FROM h),
    c AS (SELECT host, s, count(said) AS n, count(*) FILTER (said = 'block') AS b FROM base GROUP BY host, s),
    t0 AS (SELECT c.*, '' AS node, purity FROM c JOIN (SELECT host, (sum(b) + {strength} * {prior}) / (sum(n) + {strength}) AS purity FROM c GROUP BY host) USING (host))"""
    for k in range(1, URL_LEVELS + 1):
        sql += rf""",
    i{k} AS (SELECT *, s[{k}] AS seg FROM t{k - 1} WHERE len(s) >= {k}),
    a{k} AS (SELECT host, node, seg, sum(n) AS n, sum(b) AS b, max(purity) AS up FROM i{k} GROUP BY ALL),
    b{k} AS (SELECT *, CASE WHEN NOT starts_with(seg, '{{') AND count(*) FILTER (NOT starts_with(seg, '{{')) OVER w > {most_branches} THEN '{{*}}' ELSE seg END AS branch, sum(n) OVER w AS pn, sum(b) OVER w AS pb
        FROM a{k} WINDOW w AS (PARTITION BY host, node)),
    d{k} AS (SELECT host, node, branch, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(b) AS DOUBLE) AS b, CAST(max(pn) AS DOUBLE) AS pn, CAST(max(pb) AS DOUBLE) AS pb, max(up) AS up FROM b{k} GROUP BY ALL),
    e{k} AS (SELECT *, coalesce(abs(b / nullif(n, 0) - (pb - b) / nullif(pn - n, 0)) > {z} * sqrt(pb / nullif(pn, 0) * (1 - pb / nullif(pn, 0)) * (1 / nullif(n, 0) + 1 / nullif(pn - n, 0))), false) AS own FROM d{k}),
    f{k} AS (SELECT *, CASE WHEN own THEN n ELSE coalesce(sum(n) FILTER (NOT own) OVER w, 0) END AS mn, CASE WHEN own THEN b ELSE coalesce(sum(b) FILTER (NOT own) OVER w, 0) END AS mb FROM e{k} WINDOW w AS (PARTITION BY host, node)),
    t{k} AS (SELECT i.host, i.s, i.n, i.b, i.node || '/' || f.branch AS node, (f.mb + {strength} * f.up) / (f.mn + {strength}) AS purity
        FROM i{k} i JOIN b{k} g ON i.host = g.host AND i.node = g.node AND i.seg = g.seg JOIN f{k} f ON g.host = f.host AND g.node = f.node AND g.branch = f.branch)"""
    ends = " UNION ALL ".join(f"SELECT host, s, node, purity FROM t{k} WHERE len(s) = {k}" for k in range(URL_LEVELS + 1))
    return sql + rf"""
    SELECT page_id, base.host, path, rule, coalesce(said, CASE WHEN purity >= {reject} THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN node = '' THEN '/' ELSE node END AS template, round(purity, 9) AS purity
    FROM base JOIN ({ends}) k ON base.host = k.host AND base.s = k.s"""


PHRASES = r"""WITH parts AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part FROM documents),
pieces AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(part, '[^\x20\x09]+') AS w FROM parts),
spoken AS (SELECT lang, cast(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
words AS (SELECT piece, lang, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM pieces),
runs AS (SELECT lang, a, lead(a) OVER x AS b, lead(a, 2) OVER x AS c, lead(a, 3) OVER x AS d FROM words WINDOW x AS (PARTITION BY piece ORDER BY i)),
grams AS (SELECT lang, a AS g FROM runs UNION ALL SELECT lang, a || ' ' || b FROM runs WHERE b IS NOT NULL UNION ALL SELECT lang, a || ' ' || b || ' ' || c FROM runs WHERE c IS NOT NULL
  UNION ALL SELECT lang, a || ' ' || b || ' ' || c || ' ' || d FROM runs WHERE d IS NOT NULL),
f AS MATERIALIZED (SELECT lang, g, string_split(g, ' ') AS w, len(string_split(g, ' ')) AS k, count(*) AS a FROM grams GROUP BY lang, g HAVING count(*) >= 30),
halves AS (SELECT lang, g, a, j, array_to_string(w[1 : j], ' ') AS first, array_to_string(w[j + 1 : k], ' ') AS rest FROM f, (VALUES (1), (2), (3)) AS t(j) WHERE j < k),
cuts AS (SELECT c.lang, c.g, c.a, c.j, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score FROM halves c JOIN f l ON l.lang = c.lang AND l.g = c.first JOIN f r ON r.lang = c.lang AND r.g = c.rest),
weakest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, j) AS place FROM cuts) WHERE place = 1),
longer AS (SELECT lang, array_to_string(w[b : b + s - 1], ' ') AS g, max(a) AS a FROM f, (VALUES (2, 1), (2, 2), (2, 3), (3, 1), (3, 2)) AS t(s, b) WHERE k > s AND b + s - 1 <= k GROUP BY ALL),
kept AS (SELECT w.lang, w.g AS phrase, w.a, w.l, w.r, w.score FROM weakest w LEFT JOIN longer o ON o.lang = w.lang AND o.g = w.g WHERE o.a IS NULL OR 100::HUGEINT * o.a < 80::HUGEINT * w.a)
SELECT lang, rank, phrase, a, l, r, n, cast(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN spoken USING (lang) WHERE rank <= 2000"""

MIDDLES = r"""WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(cast(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (SELECT doc_id, t, w, len(w) AS n, list_transform([1, 9, 17, 25], lambda b: list_sum(list_transform(range(0, 8), lambda i: (strpos('0123456789abcdef', substr(h, b + cast(i AS INTEGER), 1)) - 1) * cast(pow(16, 7 - i) AS BIGINT)))) AS h FROM u),
c AS (SELECT *, cast(least(h[1] % (n + 1), h[2] % (n + 1)) AS BIGINT) AS x, cast(greatest(h[1] % (n + 1), h[2] % (n + 1)) AS BIGINT) AS y,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, coalesce(array_to_string(w[1 : x], ''), '') AS a, coalesce(array_to_string(w[x + 1 : y], ''), '') AS b, coalesce(array_to_string(w[y + 1 : n], ''), '') AS z FROM c)
SELECT doc_id, cast(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN cast(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN cast(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


ORACLE: dict[str, str] = {"op2_exact_topk": TOPK, "op5_near_duplicates": NEAR, "op6_decontamination": WINDOWS, "op7_secret_scan": SECRETS, "op9_url_templates": _urls(), "op12_collocations": PHRASES, "op13_fill_in_middle": MIDDLES}

"""DuckDB SQL for the corpus queries that SQL can express; it works on whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def lowered(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def shingles(w: str, k: int) -> str:
    return f"list_distinct(CASE WHEN len({w}) >= {k} THEN list_transform(range(1, len({w}) - {k - 2}), lambda i: array_to_string({w}[i:i + {k - 1}], ' ')) WHEN len({w}) > 0 THEN [array_to_string({w}, ' ')] ELSE [] END)"


def substring_dedup(window: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(w[p:p + {window - 1}], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window - 2})) AS p FROM d WHERE len(w) >= {window})),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS m FROM win) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + {window})) AS i FROM hit),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


def leaks(k: int, percent: int) -> str:
    def sets(table: str, key: str) -> str:
        return f"SELECT {key}, w, {shingles('w', k)} AS s FROM (SELECT {key}, {words(lowered('text'))} AS w FROM {table} WHERE text IS NOT NULL AND {key} IS NOT NULL)"

    return f"""
WITH ds AS ({sets("documents", "doc_id")}), bs AS ({sets("benchmark", "item_id")}),
d AS (SELECT doc_id, unnest(s) AS g FROM ds WHERE len(w) >= {k}),
b AS (SELECT item_id, len(s) AS n, unnest(s) AS g FROM bs WHERE len(w) >= {k}),
short AS (SELECT item_id, ' ' || array_to_string(w, ' ') || ' ' AS t FROM bs WHERE len(w) BETWEEN 1 AND {k - 1}),
c AS (SELECT doc_id, item_id, any_value(n) AS n, count(*) AS m FROM d JOIN b USING (g) GROUP BY doc_id, item_id
      UNION ALL SELECT doc_id, item_id, 1, 1 FROM ds JOIN short ON contains(' ' || array_to_string(ds.w, ' ') || ' ', short.t))
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_shingles, CAST(m AS BIGINT) AS n_shared, CAST(m AS DOUBLE) / CAST(n AS DOUBLE) AS containment
FROM c WHERE 100 * m >= {percent} * n"""


def near_duplicates(k: int, percent: int) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, {shingles("w", k)} AS s FROM (SELECT doc_id, {words(lowered("coalesce(text, '')"))} AS w FROM documents)),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM d),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c
         FROM g a JOIN g b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM pair WHERE 100 * c >= {percent} * (n + m - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(s, t) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.s, edge.b FROM reach JOIN edge ON reach.t = edge.a),
low AS (SELECT s AS doc_id, min(t) AS component_id FROM reach GROUP BY s)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN low USING (doc_id)"""


def linked_documents(k: int, percent: int) -> str:
    return f"SELECT doc_id, n_shingles, component_id FROM ({near_duplicates(k, percent)})"


def line_dedup(width: int) -> str:
    key = " || chr(10) || ".join(f"lead(t, {j}) OVER w" if j else "t" for j in range(width))
    return f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS x, unnest(range(0, len(lines))) AS i FROM d),
solid AS (SELECT doc_id, i, trim(x, ' ') AS t FROM line WHERE trim(x, ' ') <> ''),
win AS (SELECT doc_id, i AS start, lead(i, {width - 1}) OVER w + 1 AS stop, {key} AS g FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, start) AS n FROM win WHERE stop IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, stop)) AS i FROM ranked WHERE n > 1),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY i) AS t, count(*) AS n FROM line ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines), 0) - coalesce(n, 0) AS BIGINT) AS n_removed,
       CASE WHEN text IS NULL THEN NULL ELSE coalesce(t, '') END AS text
FROM d LEFT JOIN kept USING (doc_id)"""


def backoff_scores(alpha: float, min_count: int) -> str:
    """Order three."""
    return f"""
WITH d AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS c, unnest(range(1, len(w) + 1)) AS i FROM d),
gram AS (SELECT doc_id, i, lag(c, 2) OVER s AS a, lag(c) OVER s AS b, c FROM word WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
one AS (SELECT c, count(*) AS n FROM gram GROUP BY c),
two AS (SELECT b, c, count(*) AS n FROM gram WHERE b IS NOT NULL GROUP BY b, c),
three AS (SELECT a, b, c, count(*) AS n FROM gram WHERE a IS NOT NULL GROUP BY a, b, c),
scored AS (SELECT gram.doc_id, coalesce(three.n, 0) >= {min_count} AS is_full,
  CASE WHEN three.n >= {min_count} THEN ln(CAST(three.n AS DOUBLE) / history.n)
       WHEN two.n >= {min_count} THEN ln(CAST(two.n AS DOUBLE) / last.n) + CASE WHEN gram.a IS NULL THEN 0 ELSE ln({alpha}) END
       ELSE ln(CAST(one.n AS DOUBLE) / (SELECT count(*) FROM gram)) + CASE WHEN gram.b IS NULL THEN 0 WHEN gram.a IS NULL THEN ln({alpha}) ELSE ln({alpha}) + ln({alpha}) END END AS v
  FROM gram JOIN one ON one.c = gram.c LEFT JOIN one AS last ON last.c = gram.b LEFT JOIN two ON two.b = gram.b AND two.c = gram.c
  LEFT JOIN two AS history ON history.b = gram.a AND history.c = gram.b LEFT JOIN three ON three.a = gram.a AND three.b = gram.b AND three.c = gram.c)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(m, 0) AS BIGINT) AS n_full, CAST(coalesce(s, 0) AS BIGINT) AS score_micros
FROM d LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE is_full) AS m, sum(CAST(round(v * 1e6) AS BIGINT)) AS s FROM scored GROUP BY doc_id) USING (doc_id)"""


def personal_data() -> str:
    """The counts and the digest of the base spans."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    found = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, {rank} AS rank, regexp_extract_all(t, '{p}') AS v, string_split_regex(t, '{p}') AS g FROM d" for rank, (kind, p) in enumerate(patterns.items()))
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}" for kind in patterns)
    said = ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in patterns)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({found}),
piece AS (SELECT doc_id, kind, rank, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x, unnest(list_transform(g[1:len(v)], lambda y: length(y))) AS gap FROM found),
placed AS (SELECT *, regexp_replace(x, '[^0-9]', '', 'g') AS digits, CAST(sum(gap + length(x)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS BIGINT) AS stop FROM piece),
good AS (SELECT doc_id, kind, rank, stop - length(x) AS start, stop FROM placed WHERE CASE kind
  WHEN 'ip' THEN len(list_filter(string_split(x, '.'), lambda y: length(ltrim(y, '0')) > 3 OR coalesce(try_cast(ltrim(y, '0') AS INTEGER), 0) > 255)) = 0
  WHEN 'card' THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1),
    lambda j: CASE WHEN j % 2 = 1 THEN ascii(digits[-j]) - 48 WHEN ascii(digits[-j]) > 52 THEN 2 * (ascii(digits[-j]) - 48) - 9 ELSE 2 * (ascii(digits[-j]) - 48) END)) % 10 = 0
  WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15 ELSE true END),
summed AS (SELECT doc_id, {counts}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM good GROUP BY doc_id)
SELECT doc_id, {said}, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN summed USING (doc_id)"""


def listed_urls(rules: tuple) -> str:
    """Host, path and rule of every page."""
    fits = ", ".join(f"('{host}', '{path}')" for host, path, _ in rules)
    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r(name, start) AS (VALUES {fits}),
f AS (SELECT page_id, arg_max(name || start, length(name || start)) AS rule FROM h JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY page_id)
SELECT page_id, host, path, rule FROM h LEFT JOIN f USING (page_id)"""


def media_payloads(frame: int) -> str:
    """Sizes and digest of the payload that is read back from every stored text."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n, greatest(1, (length(h) // 2 + {frame - 1}) // {frame}) * {frame} AS m FROM d)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(m AS BIGINT) AS payload_bytes, sha256(unhex(h || repeat('FF', CAST(m - n AS BIGINT)))) AS payload_sha256 FROM n"""


def source_tokens() -> str:
    """Tokens and documents of every source."""
    return f"""SELECT coalesce(source, '') AS source, CAST(sum(len({words("coalesce(text, '')")})) AS BIGINT) AS tokens, count(*) AS documents FROM documents GROUP BY coalesce(source, '')"""


def phrases(least: int, top: int, inside: int) -> str:
    """Phrases of two and three words by language."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, 'und') AS lang, {lowered("coalesce(text, '')")} AS t FROM documents),
p AS (SELECT row_id, lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS t, generate_subscripts(string_split_regex(t, '[.,;:!?\x0A-\x0D]'), 1) AS piece FROM d),
w AS (SELECT lang, row_id, piece, list_filter(string_split_regex(t, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
one AS (SELECT lang, row_id, piece, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, x, lead(x) OVER s AS y, lead(x, 2) OVER s AS z FROM one WINDOW s AS (PARTITION BY row_id, piece ORDER BY i)),
f1 AS (SELECT lang, x, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, x, y, count(*) AS f FROM g WHERE y IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, x, y, z, count(*) AS f FROM g WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}),
n AS (SELECT lang, sum(f) AS n FROM f1 GROUP BY lang),
c AS (SELECT f2.lang, x || ' ' || y AS phrase, f2.f AS a, 1 AS k, p.f AS l, q.f AS r FROM f2 JOIN f1 p USING (lang, x) JOIN f1 q ON q.lang = f2.lang AND q.x = f2.y
      WHERE f2.f >= {least} AND NOT EXISTS (FROM f3 WHERE f3.lang = f2.lang AND f3.x = f2.x AND f3.y = f2.y AND 100 * f3.f >= {inside} * f2.f)
      AND NOT EXISTS (FROM f3 WHERE f3.lang = f2.lang AND f3.y = f2.x AND f3.z = f2.y AND 100 * f3.f >= {inside} * f2.f)
      UNION ALL SELECT f3.lang, x || ' ' || f3.y || ' ' || f3.z, f3.f, 1, p.f, q.f FROM f3 JOIN f1 p USING (lang, x) JOIN f2 q ON q.lang = f3.lang AND q.x = f3.y AND q.y = f3.z
      UNION ALL SELECT f3.lang, x || ' ' || y || ' ' || f3.z, f3.f, 2, p.f, q.f FROM f3 JOIN f2 p USING (lang, x, y) JOIN f1 q ON q.lang = f3.lang AND q.x = f3.z),
s AS (SELECT *, CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS score FROM c),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o JOIN n USING (lang) WHERE rank <= {top}"""

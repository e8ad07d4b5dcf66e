"""DuckDB SQL of the registered queries that SQL can express (verification only)."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op4_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), f AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p
), r AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 100) END AS first_id FROM f
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id IS NULL OR first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM r
"""

ORACLE_SQL["op6_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM iw))
), h AS (
  SELECT dw.* FROM dw SEMI JOIN iw ON dw.win = iw.win AND dw.k = iw.k
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM h) GROUP BY 1
), m AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM (SELECT DISTINCT h.doc_id, iw.item_id FROM h JOIN iw ON h.win = iw.win AND h.k = iw.k) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def _matches(kind: str, rank: int, pattern: str, keep: str) -> str:
    """Spans of a pattern: texts are split at marks around its matches."""
    mark = "chr(57344)"
    return f"""
  SELECT doc_id, text, CAST(e - length(p) AS BIGINT) AS s, {rank} AS r, CAST(e AS BIGINT) AS e, '{kind}' AS k
  FROM (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS e
        FROM (SELECT doc_id, text, unnest(l) AS p, generate_subscripts(l, 1) AS i
              FROM (SELECT doc_id, text, string_split(regexp_replace(text, '{pattern}', {mark} || '\\0' || {mark}, 'g'), {mark}) AS l
                    FROM d WHERE regexp_matches(text, '{pattern}'))))
  WHERE i % 2 = 0 AND ({keep})"""


def _secret_sql() -> str:
    from . import secret_scan as s

    quoted = {k: getattr(s, k.upper()).replace("'", "''") for k in s.KINDS}
    mixed = "regexp_matches(p, '[=:]') OR (regexp_matches(p, '[0-9]') AND regexp_matches(p, '[A-Z]') AND regexp_matches(p, '[a-z]'))"
    keep = {"assign": f"length(regexp_extract(p, '{quoted['assign']}', 2)) >= 8", "access": "length(p) >= 16", "secret": mixed}
    parts = "\n  UNION ALL".join(_matches(k, i, quoted[k], keep.get(k, "true")) for i, k in enumerate(s.KINDS))
    text = "coalesce(string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, r, e), '')"
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), chr(57344), chr(57345)) AS text FROM documents
), m AS ({parts}
), j AS (
  SELECT a.doc_id, a.s, a.r, a.e, a.k,
         bool_or(b.k IN ('access', 'identity') AND b.s - a.e <= {s.REACH} AND a.s - b.e <= {s.REACH}) AS idn,
         bool_or(b.k IN ('assign', 'hex', 'secret') AND b.s - a.e <= {s.REACH} AND a.s - b.e <= {s.REACH}) AS sec,
         bool_or(b.r < 3 AND b.s < a.e AND b.e > a.s) AS taken
  FROM m a JOIN m b USING (doc_id) GROUP BY ALL
), f AS (
  SELECT * FROM j WHERE r < 3 OR NOT taken AND CASE k WHEN 'identity' THEN sec WHEN 'secret' THEN idn ELSE idn AND sec END
)
SELECT d.doc_id, count(*) FILTER (k = 'assign') AS n_assign, count(*) FILTER (k = 'access') AS n_access, count(*) FILTER (k = 'hex') AS n_hex,
       sha256(coalesce(string_agg(k || ':' || s || ':' || e, ',' ORDER BY s, r, e) FILTER (r < 3), '')) AS base_sha256, {text} AS spans
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id
"""


ORACLE_SQL["op7_secret_scan"] = _secret_sql()

ORACLE_SQL["op8_ngram_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS g, least(len(w), 3) AS k
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""


def _rules_sql() -> str:
    from . import quality_rules as q

    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM again) GROUP BY 1
), lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d
), dup AS (
  SELECT doc_id, sum(c - 1) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')) AS n, sum(c) FILTER (line <> '') AS n_lines
  FROM (SELECT doc_id, line, count(*) AS c FROM lines GROUP BY ALL) GROUP BY 1
), top AS (
  SELECT doc_id, max(c) AS n FROM (SELECT doc_id, word, count(*) AS c FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY ALL) GROUP BY 1
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(top.n, 0) AS n_top, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_ascii,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_lettered
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN top USING (doc_id)
), b AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PCT} * n_words AS base_failed, greatest(n_words, 1) AS words_or_1 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars / words_or_1 NOT BETWEEN {q.WORD_LENGTH[0]} AND {q.WORD_LENGTH[1]} OR n_symbols / words_or_1 > {q.MAX_SYMBOLS_PER_WORD}
            OR n_dup_lines / greatest(n_lines, 1) > {q.MAX_DUP_LINE_SHARE} OR n_upper / greatest(n_ascii, 1) > {q.MAX_UPPER_SHARE}
            OR n_lettered / words_or_1 < {q.MIN_LETTER_WORDS} OR n_top / words_or_1 > {q.MAX_TOP_WORD_SHARE}) AS kept
FROM b
"""


ORACLE_SQL["op9_quality_rules"] = _rules_sql()


ORACLE_SQL["op11_byte_repeats"] = """
WITH d AS (
  SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents
), w AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, CAST(length(h) // 2 - 99 AS BIGINT))) AS p FROM d)
), r AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS i FROM w) WHERE i > 1
), s AS (
  SELECT doc_id, min(p) AS a, max(p) + 100 AS b
  FROM (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY p) AS run
        FROM (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS gap FROM r)) GROUP BY doc_id, run
), k AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS past FROM s
), j AS (
  SELECT d.doc_id, string_agg(substr(h, 2 * past + 1, 2 * (a - past)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept,
         sum(b - a) AS n_removed, count(*) AS n_spans
  FROM d JOIN k USING (doc_id) GROUP BY d.doc_id
)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN j USING (doc_id)
"""

#: crc32 of the decimal digits of an id, a byte (>= 0) or a shift (-1) at a time
CRC32 = ("xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), "
         "lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), "
         "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)")


def _tree_sql(name: str, leaves: str, levels: int) -> str:
    """Levels name_0 .. of the trees of ``leaves`` (grp, i, node, again): each node with its siblings and its number."""
    out = [f"{name}_0 AS (SELECT grp, i, node FROM {leaves})"]
    for k in range(levels):
        # a tree of one node is done and keeps it
        out.append(f"{name}_{k + 1} AS (SELECT grp, i, CASE WHEN whole = 1 THEN node ELSE sha256(node) END AS node FROM ("
                   f"SELECT grp, i // 3 AS i, string_agg(node, '' ORDER BY i) AS node, any_value(whole) AS whole FROM "
                   f"(SELECT *, count(*) OVER (PARTITION BY grp) AS whole FROM {name}_{k}) GROUP BY grp, i // 3))")
    return ", ".join(out)


def _fold_sql(name: str, start: str, levels: int) -> str:
    """Rows of ``start`` (key, grp, i, again, steps) folded through the levels of tree ``name``."""
    out, last = [], start
    for k in range(levels):
        side = f"""
  SELECT f.key, any_value(f.grp) AS grp, any_value(f.i) // 3 AS i,
         CASE WHEN any_value(whole) = 1 THEN any_value(f.again) ELSE sha256(string_agg(CASE WHEN n.i = f.i THEN f.again ELSE n.node END, '' ORDER BY n.i)) END AS again,
         any_value(f.steps) || CASE WHEN any_value(whole) = 1 THEN '' ELSE coalesce(string_agg(n.node, '' ORDER BY n.i) FILTER (n.i <> f.i), '') END AS steps
  FROM {last} f JOIN (SELECT *, count(*) OVER (PARTITION BY grp) AS whole FROM {name}_{k}) n ON n.grp IS NOT DISTINCT FROM f.grp AND n.i // 3 = f.i // 3 GROUP BY f.key"""
        out.append(f"{start}_{k + 1} AS ({side}\n)")
        last = f"{start}_{k + 1}"
    return ", ".join(out)


#: levels of the trees in SQL: 3 ** 12 rows of a group
DEPTH = 12


def _field_sql(c: str) -> str:
    return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"


def _merkle_sql() -> str:
    head = " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars"))
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS key, doc_id, source, sha256({head} || {_field_sql('text')}) AS leaf,
         sha256({head} || {_field_sql(f"CASE WHEN {CRC32} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS again FROM documents
), l AS (
  SELECT *, source AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, key) - 1 AS i, leaf AS node FROM d
), {_tree_sql('t', 'l', DEPTH)}, u AS (
  SELECT 0 AS grp, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS i, grp AS source, node FROM t_{DEPTH}
), {_tree_sql('v', 'u', DEPTH)}, s AS (
  SELECT key, grp, i, again, '' AS steps FROM l
), {_fold_sql('t', 's', DEPTH)}, x AS (
  SELECT f.key, u.grp, u.i, f.again, f.steps FROM s_{DEPTH} f JOIN u ON u.source IS NOT DISTINCT FROM f.grp
), {_fold_sql('v', 'x', DEPTH)}
SELECT doc_id, leaf, u.node AS subroot, v.node AS root, sha256(steps) AS proof_sha256, f.again AS folded_root, f.again = v.node AS verified
FROM l JOIN x_{DEPTH} f USING (key) JOIN u ON u.source IS NOT DISTINCT FROM l.source JOIN v_{DEPTH} v ON true
"""


ORACLE_SQL["op12_merkle_manifest"] = _merkle_sql()

ORACLE_SQL["op13_periodic_runs"] = rf"""
WITH d AS (
  SELECT doc_id, {CRC32} AS h, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents
), a AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d
), p AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM a
), t AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: w[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) END AS w FROM p
), x AS (
  SELECT doc_id, unnest(range(0, n)) AS i, unnest(w) AS word FROM t
), e AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM x JOIN x y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
), g AS (
  SELECT doc_id, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(24, 3 * q)
), r AS (
  SELECT doc_id, start, length, min(q) AS period FROM g GROUP BY ALL
), b AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY 1
), z AS (
  SELECT a.* FROM r a WHERE NOT EXISTS (
    SELECT 1 FROM r c WHERE c.doc_id = a.doc_id AND (c.length * a.period > a.length * c.period OR c.length * a.period = a.length * c.period AND (c.start < a.start OR c.start = a.start AND c.period < a.period)))
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r
), k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY 1
)
SELECT t.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, z.start, CAST(z.length AS BIGINT) AS length, z.period, CAST(1000 * z.length // z.period AS BIGINT) AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN z USING (doc_id) LEFT JOIN k USING (doc_id)
"""

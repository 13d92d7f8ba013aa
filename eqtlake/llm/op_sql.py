"""DuckDB SQL for the rows of the registered queries, written from their
contracts and not from the operators' methods."""

from __future__ import annotations

SQL: dict[str, str] = {}

# The kinds as asked for, in order; then the further kinds.
ASSIGN = (
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
SECRET_KINDS = [
    ("assign", ASSIGN, 2, "length(v) >= 6"),
    ("access", r"AKIA[A-Z0-9]+", 0, "length(m) >= 20"),
    ("hex", r"[0-9a-f]+", 0, "length(m) >= 24"),
    ("github", r"gh[opsu]_[A-Za-z0-9]{36}", 0, "true"),
    ("slack", r"xox[abp]-[A-Za-z0-9-]{10,}", 0, "true"),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, "true"),
    ("stripe", r"sk_live_[A-Za-z0-9]{16,}", 0, "true"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, "true"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, "true"),
]
DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = (
    f"list_sum(list_transform(string_split(reverse({DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 0 THEN "
    "CASE WHEN c::INT * 2 > 9 THEN c::INT * 2 - 9 ELSE c::INT * 2 END ELSE c::INT END)) % 10 = 0"
)
MOD97 = (
    "list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(substr(m, 5) || substr(m, 1, 4), ''), "
    "lambda c: (CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)::HUGEINT)), "
    "lambda a, x: (a * (CASE WHEN x > 9 THEN 100 ELSE 10 END) + x) % 97) = 1"
)
NEAR = (
    "regexp_matches(concat_ws(' ', substr(t, greatest(s - 59, 1), least(s, 60)), substr(t, s + length(m) + 1, 60)), "
    r"'(?i)\b(ssn|social|security)')"
)
PII_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, "true"),
    (
        "ip",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        0,
        "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INT), 0) > 255)) = 0",
    ),
    ("card", r"[0-9]([\x20-]?[0-9])+", 0, f"length({DIGITS}) BETWEEN 14 AND 19 AND {LUHN}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0, f"length({DIGITS}) BETWEEN 10 AND 15"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", 0, MOD97),
    ("card_run", r"\b[0-9]{14,19}\b", 0, LUHN),
    ("phone_nanp", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}\b", 0, "true"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0, NEAR),
]


def _spans_sql(kinds: list[tuple[str, str, int, str]], base: int) -> str:
    """Counts, digest and spans of ``kinds``, the first ``base`` of them base."""
    parts = []
    for rank, (kind, pattern, group, valid) in enumerate(kinds):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"""SELECT doc_id, {rank} AS k, '{kind}' AS kind, m, s FROM (
  SELECT doc_id, t, h[i] AS m, v[i] AS v, (list_sum(list_transform(g[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (
    SELECT doc_id, t, regexp_extract_all(t, {p}, 0) AS h, regexp_extract_all(t, {p}, {group}) AS v,
      string_split_regex(t, {p}) AS g FROM d WHERE regexp_matches(t, {p}))))
WHERE {valid}"""
        )
    counts = ",\n  ".join(
        f"count(*) FILTER (WHERE k = {rank})::BIGINT AS n_{kinds[rank][0]}" for rank in range(base)
    )
    names = ", ".join(f"coalesce(n_{kinds[rank][0]}, 0)::BIGINT AS n_{kinds[rank][0]}" for rank in range(base))
    union = "\nUNION ALL\n".join(parts)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({union}),
a AS (SELECT doc_id, {counts},
  string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY s, k) FILTER (WHERE k < {base}) AS base,
  string_agg(kind || ':' || s || ':' || (s + length(m)), ',' ORDER BY s, k) AS spans
  FROM f GROUP BY doc_id)
SELECT d.doc_id, {names}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)"""


SQL["op1_secret_scan"] = _spans_sql(SECRET_KINDS, 3)
SQL["op6_pii"] = _spans_sql(PII_KINDS, 4)

SQL["op3_quality_rules"] = r"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM p),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c > 1) GROUP BY doc_id),
f AS (SELECT w.doc_id, source, len(w)::BIGINT AS n_words,
  coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, n_words < 50 AS r1,
  100 * n_repeat_words > 50 * n_words AS r2, 100 * n_symbols > 10 * n_words AS r3,
  100 * (len(l) - len(list_distinct(l))) > 30 * len(l) AS r4,
  word_chars < 3 * n_words OR word_chars > 10 * n_words AS r5 FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, unnest([0, 1, 2, 3, 4, 5]) AS rule,
  unnest([count(*) FILTER (WHERE r1 OR r2 OR r3 OR r4 OR r5), count(*) FILTER (WHERE r1), count(*) FILTER (WHERE r2),
    count(*) FILTER (WHERE r3), count(*) FILTER (WHERE r4), count(*) FILTER (WHERE r5)])::DOUBLE AS k FROM b GROUP BY source),
m AS (SELECT rule, sum(k) / sum(n) AS m, sum(k * k / n) - sum(k) * sum(k) / sum(n) AS spread, count(*) - 1 AS free,
  (sum(n) - count(*)) - (sum(n * n) - sum(n)) / sum(n) AS depth FROM h GROUP BY rule),
q AS (SELECT rule, m, 1 / least(0.5e0, greatest(1e-6, CASE WHEN m > 0 AND m < 1 AND depth > 0
  THEN (spread / (m * (1 - m)) - free) / depth ELSE 0 END)) - 1 AS s FROM m),
x AS (SELECT source, max(rate) FILTER (WHERE rule = 0) <= 0.5 AS ok, list(rule) FILTER (WHERE rule > 0 AND rate >= 0.05e0) AS habits
  FROM (SELECT source, rule, (k + m * s) / (n + s) AS rate FROM h JOIN q USING (rule)) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r1 OR r2 AS base_failed,
  NOT (r1 OR r2) AND ok AND NOT (r3 AND list_contains(coalesce(habits, []), 3))
    AND NOT (r4 AND list_contains(coalesce(habits, []), 4)) AND NOT (r5 AND list_contains(coalesce(habits, []), 5)) AS kept
FROM b JOIN x ON b.source IS NOT DISTINCT FROM x.source"""

SQL["op9_mixing"] = r"""WITH d AS (SELECT doc_id, source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
  ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
o AS (SELECT *, 3.0 * source_size AS cap,
  coalesce(sum(3.0 * source_size) OVER b, 0) AS below, sum(w) OVER a AS free,
  (sum(source_size) OVER ())::DOUBLE AS whole FROM s
  WINDOW b AS (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  a AS (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT coalesce(arg_min((whole - below)::DOUBLE / free, below) FILTER (WHERE (whole - below)::DOUBLE / free <= cap::DOUBLE / w), 0) AS level FROM o),
t AS (SELECT source, source_size, least(cap::DOUBLE, w * level) AS target FROM o, l),
k AS (SELECT doc_id, d.source, size, source_size, target,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY substr(md5('17:' || doc_id), 1, 16), doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
  round(target)::BIGINT AS budget FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM k)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken
FROM e"""

SQL["op5_substring_dedup"] = r"""WITH w AS (SELECT doc_id,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first FROM s),
g AS (SELECT doc_id, list_sort(list(DISTINCT j)) AS gone FROM (
  SELECT doc_id, unnest(range(i, i + 13)) AS j FROM m WHERE first < doc_id) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS kept FROM (
  SELECT w.doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS j FROM w) u
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(gone) AS j FROM g) r WHERE r.doc_id = u.doc_id AND r.j = u.j)
  GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN g ON g.doc_id = w.doc_id LEFT JOIN k ON k.doc_id = w.doc_id"""

SQL["op2_decontamination"] = r"""WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
  SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT n FROM i),
s AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, l WHERE len(w) >= n)),
m AS (SELECT s.doc_id, s.n, s.i, i.item_id FROM s JOIN i ON s.n = i.n AND s.win = i.win),
h AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n_hit FROM (
  SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (
  SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

SQL["op4_warc"] = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
  max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to FROM q"""

SQL["op8_near_dup"] = r"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, c = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN m ON m.id = doc_id"""

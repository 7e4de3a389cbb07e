"""DuckDB SQL with the rows of those queries that SQL can express on whole tables."""

from __future__ import annotations

from eralith.llm.quality_rules import LEAST_SPREAD, MEASURES, STEP, WIDTH, beyond, measured
from eralith.llm.secret_scan import BASE_KINDS, RULES

_WORD = r"[^\x20\x09-\x0D]+"
_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents WHERE doc_id IS NOT NULL),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, i, min(doc_id) OVER (PARTITION BY k) AS least, doc_id FROM win), unnest(range(i, i + 50)) AS t(p) WHERE least < doc_id),
word AS (SELECT r, p, w[p] AS w FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT r, count(gone.p) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN w END, ' ' ORDER BY p) AS kept FROM word LEFT JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '{_WORD}') AS w FROM documents WHERE doc_id IS NOT NULL),
item AS (
  SELECT DISTINCT r, doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS k FROM d, unnest(range(1, len(w) - 2)) AS t(i)
  UNION SELECT r, doc_id, md5(array_to_string(w, ' ')) FROM d WHERE len(w) BETWEEN 1 AND 3
),
size AS (SELECT r, doc_id, count(*) AS n FROM item GROUP BY ALL),
link AS (
  SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM (SELECT x.r AS r, y.r AS s, count(*) AS m FROM item x JOIN item y USING (k) GROUP BY ALL) p
  JOIN size a ON a.r = p.r JOIN size b ON b.r = p.s WHERE 100 * m >= 85 * (a.n + b.n - m)
),
reach(doc, root) AS (SELECT DISTINCT doc_id, doc_id FROM d UNION SELECT b, root FROM reach JOIN link ON a = doc),
least AS (SELECT doc, min(root) AS root FROM reach GROUP BY doc)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, CAST(CASE WHEN n IS NULL THEN d.doc_id ELSE root END AS BIGINT) AS component_id
FROM d LEFT JOIN size USING (r) JOIN least ON doc = d.doc_id
"""


def _quality() -> str:
    shares = ", ".join(f"{measured(m)} AS {m}" for m in MEASURES)
    names = ", ".join(f"'{m}'" for m in MEASURES)
    fences = ", ".join(f"exp(max(CASE WHEN measure = '{m}' THEN fence END)) AS fence_{m}" for m in MEASURES)
    reasons = ", ".join(f"CASE WHEN {beyond(m, f'fence_{m}')} THEN '{m}' END" for m in MEASURES)

    def level(keys: str) -> str:
        by = f"{keys}, measure" if keys else "measure"
        return (
            f"SELECT {by}, max(total) AS n, q3 + {WIDTH} * greatest(q3 - q1, {LEAST_SPREAD}) AS f FROM (SELECT {by}, max(total) AS total, "
            f"min(CASE WHEN upto >= 0.25 * total THEN value END) AS q1, min(CASE WHEN upto >= 0.75 * total THEN value END) AS q3 FROM (SELECT {by}, bucket, "
            f"bucket * {STEP} - {STEP} / 2 AS value, sum(count(*)) OVER (PARTITION BY {by} ORDER BY bucket) AS upto, "
            f"sum(count(*)) OVER (PARTITION BY {by}) AS total FROM bucket GROUP BY {by}, bucket) GROUP BY {by}) GROUP BY {by}, q1, q3"
        )

    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, chr(0)) AS g0, coalesce(source, chr(0)) AS g1, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents WHERE doc_id IS NOT NULL),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i:i + 4], ' ')) AS c FROM d, unnest(range(1, len(w) - 3)) AS t(i)),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM win, unnest(range(i, i + 5)) AS t(p) WHERE c > 1 GROUP BY r),
m AS (
  SELECT r, doc_id, g0, g1, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (r)
),
c AS (SELECT *, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
share AS (SELECT r, g0, g1, {shares} FROM c WHERE NOT base_failed),
bucket AS (
  SELECT g0, g1, measure, CAST(ceil(ln(v) / {STEP}) AS INTEGER) AS bucket
  FROM (SELECT g0, g1, unnest([{names}]) AS measure, unnest([{", ".join(MEASURES)}]) AS v FROM share)
),
own AS ({level("g0, g1")}), lang AS ({level("g0")}), whole AS ({level("")}),
drawn AS (
  SELECT g.g0, g.g1, measure, (coalesce(own.n, 0) * coalesce(own.f, 0) + 50 * ((coalesce(lang.n, 0) * coalesce(lang.f, 0) + 50 * whole.f) / (coalesce(lang.n, 0) + 50))) / (coalesce(own.n, 0) + 50) AS fence
  FROM (SELECT DISTINCT g0, g1 FROM c) g CROSS JOIN whole LEFT JOIN lang USING (g0, measure) LEFT JOIN own USING (g0, g1, measure)
),
fence AS (SELECT g0, g1, {fences} FROM drawn GROUP BY g0, g1),
told AS (SELECT *, list_filter([CASE WHEN base_failed THEN 'base' END, {reasons}], lambda x: x IS NOT NULL) AS reasons FROM c LEFT JOIN fence USING (g0, g1))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, len(reasons) = 0 AS kept, array_to_string(reasons, ',') AS reasons FROM told
"""


def _secrets() -> str:
    found = " UNION ALL ".join(
        f"SELECT r, {k} AS kind, '{name}' AS name, string_split_regex(text, '{p.replace(chr(39), chr(39) * 2)}') AS gaps, "
        f"regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}') AS found, regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', {group}) AS counted, {least} AS least FROM d"
        for k, (name, (p, group, least)) in enumerate(RULES.items())
    )
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    counts = ", ".join(f"CAST(count(*) FILTER (name = '{k}') AS BIGINT) AS n_{k}" for k in BASE_KINDS)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
hit AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM ({found})),
span AS (
  SELECT r, kind, name, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(found[i]) AS n
  FROM hit WHERE length(counted[i]) >= least
),
told AS (
  SELECT r, {counts}, string_agg(name || ':' || s || ':' || (s + n), ',' ORDER BY s, kind) FILTER (name IN ({base})) AS base, string_agg(name || ':' || s || ':' || (s + n), ',' ORDER BY s, kind) AS spans
  FROM span GROUP BY r
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE_KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (r)
"""


FILL_IN_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents WHERE doc_id IS NOT NULL),
e AS (SELECT *, list_transform(range(0, 4), lambda i: CAST('0x' || substring(h, 8 * i + 1, 8) AS BIGINT)) AS draw FROM d),
f AS (
  SELECT *, least(draw[1] % (n + 1), draw[2] % (n + 1)) AS a, greatest(draw[1] % (n + 1), draw[2] % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR draw[3] % 100 >= 90 THEN 'plain' WHEN draw[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || t[1:a] || '<S>' || t[b + 1:] || '<M>' || t[a + 1:b] ELSE '<S>' || t[b + 1:] || '<P>' || t[1:a] || '<M>' || t[a + 1:b] END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM f
"""

#: CRC-32 is not among the functions: its table of 256 entries comes from its rule, and each text's bytes are folded over it.
SHARDING = """
WITH RECURSIVE rule(i, v, k) AS (SELECT i, CAST(i AS UBIGINT), 0 FROM range(256) AS t(i) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(3988292384::UBIGINT, v >> 1) ELSE v >> 1 END, k + 1 FROM rule WHERE k < 8),
entries AS MATERIALIZED (SELECT list(v ORDER BY i) AS c FROM rule WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS x FROM documents WHERE doc_id IS NOT NULL),
crc AS (
  SELECT r, xor(4294967295::UBIGINT, list_reduce(
    list_prepend(4294967295::UBIGINT, list_transform(range(0, size - 1), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS UBIGINT))),
    lambda v, y: xor(c[CAST(xor(v % 256, y) AS BIGINT) + 1], v >> 8))) AS text_crc32 FROM d, entries
),
score AS (SELECT r, s, -1 / ln((CAST('0x' || substring(md5(s || ':' || doc_id), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS v FROM d, range(9) AS t(s)),
best AS (SELECT r, arg_max(s, v) FILTER (s < 8) AS shard, arg_max(s, v) AS grown_shard FROM score GROUP BY r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY md5(doc_id || ':' || text_crc32), doc_id, size) - 1 AS BIGINT) AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM d JOIN crc USING (r) JOIN best USING (r)
"""

FILTER_AUDIT = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL
),
label AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END) || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN first < doc_id THEN 'E' ELSE '' END) AS failed FROM d LEFT JOIN label USING (doc_id)
),
cell AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
orders(o) AS (SELECT '' UNION ALL SELECT o || x FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS t(x) WHERE NOT contains(o, x)),
step AS (SELECT o, i, o[i:i] AS x, o[1:i - 1] AS earlier FROM orders, range(1, 6) AS t(i) WHERE length(o) = 5),
-- a mask is cut by an order's earlier filters if it has one of their letters
told AS (
  SELECT part, o, i, x, sum(n) AS total, coalesce(sum(n) FILTER (contains(failed, x)), 0) AS failing, coalesce(sum(n) FILTER (failed = x), 0) AS alone,
    coalesce(sum(n) FILTER (contains(failed, x) AND translate(failed, earlier, '') = failed), 0) AS removed, coalesce(sum(good) FILTER (contains(failed, x) AND translate(failed, earlier, '') = failed), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (contains(failed, x) AND translate(failed, earlier, '') = failed), 0) AS toxic_lost
  FROM cell, step GROUP BY ALL
)
SELECT part, o AS filter_order, CAST(i AS INTEGER) AS step, CAST(total - sum(removed) OVER (PARTITION BY part, o ORDER BY i) AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(failing - removed AS BIGINT) AS redundant, CAST(alone AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM told
"""


ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op4_ngram_join": NGRAM_JOIN,
    "op7_quality_rules": _quality(),
    "op8_secret_scan": _secrets(),
    "op11_fill_in_middle": FILL_IN_MIDDLE,
    "op12_sharding": SHARDING,
    "op13_filter_audit": FILTER_AUDIT,
}

"""SQL twins (DuckDB) of the operators that SQL can express."""

from __future__ import annotations

SPACED = r"'[^\x20\x09-\x0D]+'"

#: Exact distinct sites of every line; the first place of a line keeps it.
OP5 = r"""
WITH docs AS (SELECT doc_id, text, COALESCE(source, '') AS site, string_split(text, chr(10)) AS parts FROM documents),
lines AS (
  SELECT doc_id, site, i AS pos, trim(parts[i], chr(32) || chr(9) || chr(13)) AS line
  FROM (SELECT doc_id, site, parts, UNNEST(RANGE(1, LEN(parts) + 1)) AS i FROM docs)),
long AS (SELECT * FROM lines WHERE regexp_matches(line, '^(?:\S+\s+){4}\S')),
wide AS (
  SELECT line, MIN(struct_pack(d := doc_id, p := pos)) AS first FROM long GROUP BY line HAVING COUNT(DISTINCT site) >= 3),
gone AS (
  SELECT doc_id, LIST(pos) AS gone FROM long JOIN wide USING (line)
  WHERE NOT (doc_id = first.d AND pos = first.p) GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, LEN(parts) AS n_lines, COALESCE(LEN(gone), 0) AS n_removed,
         CASE WHEN gone IS NULL THEN text
              ELSE array_to_string([parts[i] FOR i IN RANGE(1, LEN(parts) + 1) IF NOT list_contains(gone, i)], chr(10)) END AS rest
  FROM docs d LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(COALESCE(n_lines, 0) AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed,
       CAST(LENGTH(rest) AS BIGINT) AS n_chars, md5(rest) AS text_md5
FROM kept
"""

#: Water-filling in closed form; the draw uses digits of the id's md5.
OP7 = rf"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(LEN(regexp_extract_all(text, {SPACED})), 0) AS size, md5(CAST(doc_id AS VARCHAR)) AS h
  FROM documents),
drawn AS (
  SELECT *, CAST(('0x' || h[1:3]) AS BIGINT) AS bin, CAST(('0x' || h[4:9]) AS BIGINT) / 16777216.0 AS u FROM sized),
bins AS (SELECT source, bin, SUM(size) AS n FROM drawn GROUP BY ALL),
totals AS (
  SELECT source, SUM(n) AS source_size, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM bins GROUP BY source),
weighed AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, 2.0 * source_size AS cap FROM totals),
levels AS (
  SELECT a.source, a.source_size, a.w, a.cap,
         (1.5 * (SELECT SUM(source_size) FROM totals) - COALESCE(SUM(b.cap) FILTER (b.cap / b.w <= a.cap / a.w), 0))
         / NULLIF((SELECT SUM(w) FROM weighed) - COALESCE(SUM(b.w) FILTER (b.cap / b.w <= a.cap / a.w), 0), 0) AS x
  FROM weighed a, weighed b GROUP BY ALL),
level AS (SELECT GREATEST(MAX(x), 1.5 * (SELECT SUM(source_size) FROM totals) / (SELECT SUM(w) FROM weighed)) AS x FROM levels),
targets AS (
  SELECT source, source_size, LEAST(cap, w * level.x)::DOUBLE AS target,
         FLOOR(LEAST(cap, w * level.x) / NULLIF(source_size, 0)) AS whole
  FROM levels, level),
running AS (SELECT source, bin, n, SUM(n) OVER (PARTITION BY source ORDER BY bin) AS upto FROM bins),
cuts AS (
  SELECT t.source, ARG_MIN((target - whole * source_size - (upto - n)) / n, bin) AS part, MIN(bin) AS cut
  FROM targets t JOIN running r ON t.source IS NOT DISTINCT FROM r.source
  WHERE upto > target - whole * source_size GROUP BY t.source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, CAST(t.source_size AS BIGINT) AS source_size, t.target,
       CAST(COALESCE(t.whole, 0) * d.size + CASE WHEN c.cut IS NULL OR d.bin < c.cut THEN d.size
            WHEN d.bin = c.cut THEN FLOOR(c.part * d.size + d.u) ELSE 0 END AS BIGINT) AS taken
FROM drawn d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
LEFT JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source
"""

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Windows of item words against windows of document words, by equality.
OP9 = f"""
WITH d AS (SELECT doc_id, COALESCE({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
grams AS (
  SELECT DISTINCT item_id, LEAST(10, LEN(w)) AS n, array_to_string(w[i:i + LEAST(10, LEN(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, UNNEST(RANGE(1, GREATEST(LEN(w) - 9, 1) + 1)) AS i FROM b WHERE LEN(w) > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
places AS (SELECT doc_id, w, n, UNNEST(RANGE(1, LEN(w) - n + 2)) AS i FROM d, sizes WHERE LEN(w) >= n),
found AS (
  SELECT p.doc_id, p.i, p.n, g.item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM places) p JOIN grams g ON p.n = g.n AND p.g = g.g),
hit AS (SELECT doc_id, COUNT(DISTINCT k) AS n_hit FROM (SELECT doc_id, UNNEST(RANGE(i, i + n)) AS k FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, COUNT(name) AS n_items, STRING_AGG(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(LEN(d.w) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items, sha256(COALESCE(names, '')) AS items_sha256,
       COALESCE(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

#: All runs of one to five words, counted as text.
OP12 = r"""
WITH split AS (
  SELECT COALESCE(lang, 'und') AS lang, UNNEST(regexp_split_to_array(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM split),
places AS (
  SELECT lang, w, k, UNNEST(RANGE(1, LEN(w) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3), (4), (5)) AS s(k) WHERE LEN(w) >= k),
counts AS (
  SELECT lang, k, phrase, COUNT(*) AS f FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM places) GROUP BY ALL),
sizes AS (SELECT lang, SUM(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM counts WHERE k > 1 AND f >= 100),
inner_runs AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, MAX(f) AS f
  FROM (SELECT lang, w, f, m, UNNEST(RANGE(1, k - m + 2)) AS i FROM candidates, (VALUES (2), (3), (4)) AS s(m) WHERE m < k) GROUP BY ALL),
left_over AS (
  SELECT c.* FROM candidates c LEFT JOIN inner_runs i USING (lang, phrase) WHERE i.f IS NULL OR 100 * i.f < 100 * c.f),
cuts AS (
  SELECT lang, k, phrase, f, j, array_to_string(w[1:j], ' ') AS first, array_to_string(w[j + 1:k], ' ') AS rest
  FROM (SELECT *, UNNEST(RANGE(1, k)) AS j FROM left_over)),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, j, x.f AS l, y.f AS r, n,
         (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN sizes USING (lang)
  JOIN counts x ON x.lang = c.lang AND x.phrase = c.first JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest),
lowest AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM scored),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

#: Every rule against every address; the patterns as one expression.
OP13 = r"""
WITH rules(rule, verdict) AS (
  VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
split AS (
  SELECT rule, verdict, split_part(rule, '/', 1) AS host, substr(rule, strpos(rule, '/')) AS path FROM rules),
parts AS (
  SELECT page_id, url,
         translate(COALESCE(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         COALESCE(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
         translate(COALESCE(regexp_extract(url, '://([^#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS whole
  FROM pages),
best AS (
  SELECT DISTINCT p.host, p.path, FIRST(struct_pack(rule := r.rule, verdict := r.verdict)) OVER (
           PARTITION BY p.host, p.path ORDER BY LEN(r.rule) DESC) AS best
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN split r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, parts.host, parts.path, best.rule AS rule,
       CASE WHEN best.rule IS NOT NULL THEN best.verdict
            WHEN regexp_matches(whole, '(?s)/wp-login\.|/wp-admin/|/(login|logout|signin|signup|register|cart|checkout|search)([^a-z0-9_.%-]|$)'
                 || '|/calendar/.*/day/|\?replytocom=|[^a-z0-9_.%-](phpsessid|sessionid)=|^([^/?]*\.)?(ads|adserver)\.'
                 || '|[^a-z0-9_.%-](casino|porn|viagra|xxx)([^a-z0-9_.%-]|$)')
                 AND NOT regexp_matches(whole, '/search/help([^a-z0-9_.%-]|$)') THEN 'block'
            ELSE 'allow' END AS verdict
FROM parts LEFT JOIN best ON parts.host = best.host AND parts.path = best.path
"""


def all_sql() -> dict[str, str]:
    return {
        "op5_line_spread": OP5,
        "op7_source_mix": OP7,
        "op9_decontamination": OP9,
        "op12_collocations": OP12,
        "op13_url_filter": OP13,
    }

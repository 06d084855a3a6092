"""DuckDB SQL for the queries that SQL can express; none of it reads what the operators wrote."""

from __future__ import annotations

#: White space between words, as a class of characters and as characters.
_WORD = r"[^\x20\x09-\x0D]+"
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_DOCS = "d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents)"
_LINES = f"""{_DOCS},
cut AS (SELECT rid, string_split(t, chr(10)) AS parts FROM d),
lines AS (SELECT rid, unnest(parts) AS line, unnest(range(len(parts))) AS i FROM cut)"""

SOURCE_MIX = rf"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
binned AS (SELECT *, greatest(length(bin(size)) - 4, 0) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS b FROM d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY b, h, doc_id NULLS FIRST, size) AS pos FROM binned),
sources AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY k),
weighed AS (SELECT *, CAST((row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS DOUBLE) AS w, CAST(source_size AS DOUBLE) * 3 AS cap FROM sources),
filled AS (
  SELECT *, cap / w AS q, sum(cap) OVER (ORDER BY cap / w, k ROWS UNBOUNDED PRECEDING) AS capped, coalesce(sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS open
  FROM weighed),
total AS (SELECT CAST(sum(source_size) AS DOUBLE) AS words, sum(w) AS weights FROM weighed),
level AS (SELECT capped, open FROM filled, total WHERE capped + q * open <= words AND open > 0 ORDER BY q DESC, capped DESC, open DESC LIMIT 1),
rest AS (SELECT CASE WHEN level.open IS NULL THEN words / weights ELSE (words - level.capped) / level.open END AS each FROM total LEFT JOIN level ON true),
targets AS (SELECT k, source_size, least(cap, each * w) AS target, CAST(('0x' || substr(md5(k), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE) AS off FROM filled, rest),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets)
SELECT doc_id, size, source_size, target, CAST(least(floor(pos * rate + off) - floor((pos - 1) * rate + off), 3) AS BIGINT) * size AS taken
FROM ranked JOIN rated USING (k)
"""

QUALITY_RULES = rf"""
WITH {_LINES},
said AS (
  SELECT rid, line, len(regexp_extract_all(line, '{_WORD}')) AS words, regexp_replace({_LOWER.format(f"trim(line, {_SPACES})")}, '[0-9]+', '0', 'g') AS norm
  FROM lines WHERE regexp_matches(line, '{_WORD}')),
words AS (SELECT rid, regexp_extract_all(t, '{_WORD}') AS w FROM d),
windows AS (SELECT rid, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS three, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) > 2),
twice AS (SELECT rid, unnest(list(i)) AS i FROM windows GROUP BY rid, three HAVING count(*) > 1),
repeated AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY rid),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM said GROUP BY rid),
base AS (
  SELECT d.rid, d.doc_id, d.source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
    coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words
  FROM d JOIN words USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN repeated USING (rid)),
sets AS (SELECT rid, source, list_sort(list_distinct(list(norm))) AS held FROM said JOIN d USING (rid) GROUP BY rid, source),
distinct_sets AS (SELECT DISTINCT source, held FROM sets),
hosts AS (SELECT source, count(*) AS docs FROM distinct_sets GROUP BY source),
counted AS (SELECT source, norm, count(*) AS n FROM (SELECT source, unnest(held) AS norm FROM distinct_sets) GROUP BY source, norm),
frequent AS (SELECT counted.source, norm FROM counted JOIN hosts ON counted.source IS NOT DISTINCT FROM hosts.source WHERE n > 20 AND n > CAST(0.02 AS DOUBLE) * docs),
removed AS (SELECT rid, CAST(sum(words) AS BIGINT) AS n FROM said JOIN d USING (rid) JOIN frequent ON frequent.source IS NOT DISTINCT FROM d.source AND frequent.norm = said.norm GROUP BY rid),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(removed.n, 0) AS n_removed_words FROM base LEFT JOIN removed USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - n_removed_words >= CAST(0.3 AS DOUBLE) * n_words AS kept, n_removed_words
FROM judged
"""

LINE_DEDUP = f"""
WITH {_LINES},
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACES})")} AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10),
kept AS (SELECT rid, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text FROM keyed WHERE key NOT IN (SELECT key FROM frequent) GROUP BY rid),
total AS (SELECT rid, count(*) AS n FROM lines GROUP BY rid)
SELECT doc_id, total.n AS n_lines, total.n - coalesce(kept.n, 0) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d JOIN total USING (rid) LEFT JOIN kept USING (rid)
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE {_DOCS},
words AS (SELECT rid, doc_id, regexp_extract_all({_LOWER.format("t")}, '{_WORD}') AS w FROM d),
sets AS (
  SELECT rid, doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] for i in range(1, len(w) - 3)] END)) AS held
  FROM words),
classes AS (SELECT *, min(rid) OVER (PARTITION BY held) AS class FROM sets),
shingles AS (SELECT class, len(held) AS n, unnest(held) AS shingle FROM classes WHERE rid = class),
pairs AS (
  SELECT a.class AS a, b.class AS b FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.class < b.class AND 4 * greatest(a.n, b.n) <= 5 * least(a.n, b.n)
  GROUP BY a.class, b.class, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT DISTINCT class AS a, class AS b FROM classes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
names AS (SELECT reach.a AS class, min(doc_id) AS name FROM reach JOIN classes ON classes.class = reach.b GROUP BY reach.a)
SELECT doc_id, len(held) AS n_shingles, CASE WHEN len(held) = 0 THEN doc_id ELSE name END AS component_id FROM classes JOIN names USING (class)
"""

ORACLES: dict[str, str] = {"op3_source_mix": SOURCE_MIX, "op4_quality_rules": QUALITY_RULES, "op5_line_dedup": LINE_DEDUP, "op8_jaccard_join": JACCARD_JOIN}

"""The chunker in SQL: lines, heading stack, blocks, sentence ends, and packing as a recursion over units.

Not in it, as no test table holds any: front matter, fences, inline code, addresses,
and line ends other than the newline.
"""

from __future__ import annotations

from ..functions.chunking import Limits

#: The marks that can end a sentence or clause, and the abbreviations that do not.
_MARKS = "。！？.!?；;，,：:"
_SHORT = r"(?:^|[\s(])(?:mr|mrs|ms|dr|prof|e\.g|i\.e|etc|vs)\.$"


def chunks_sql(files: str, limits: Limits, hash_prefix: str) -> str:
    """Rows of the chunker over ``files``, a SELECT of (source_file_id, relative_path, content); ``hash_prefix`` is an SQL expression."""
    lim = limits
    repeat = f"least({lim.overlap}, greatest(0, {{room}}))"
    reach = "CASE WHEN {pb} = u.b THEN greatest({at} - " + repeat + ", {pa}) ELSE {at} END" if lim.overlap else "{at}"
    # a chunk that is open when a unit comes is closed first, and is then the chunk before
    shut = f"(s.now_a IS NOT NULL AND (u.a IS NULL OR s.now_path <> u.path OR u.z - s.now_a > {lim.most} OR u.z - u.a > {lim.most}))"
    pa, pb = f"CASE WHEN {shut} THEN s.now_a ELSE s.prev_a END", f"CASE WHEN {shut} THEN s.now_b ELSE s.prev_b END"
    opened = reach.format(pa=f"({pa})", pb=f"({pb})", at="u.a", room=f"{lim.most} - (u.z - u.a)")
    sliced = reach.format(pa=f"({pa})", pb=f"({pb})", at="coalesce(s.pos, u.a)", room=f"{lim.most - 1}")
    return rf"""WITH RECURSIVE files AS MATERIALIZED ({files}
), raw AS (
  SELECT source_file_id AS id, generate_subscripts(string_split(content, chr(10)), 1) AS n, regexp_replace(unnest(string_split(content, chr(10))), '\s+$', '') AS line FROM files WHERE content IS NOT NULL
), lines AS MATERIALIZED (
  SELECT *, sum((kind <> 't')::INT) OVER (PARTITION BY id ORDER BY n) AS cut, sum((kind = 'h')::INT) OVER (PARTITION BY id ORDER BY n) AS h
  FROM (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\s+.+$') THEN 'h' WHEN line = '' THEN 'b' ELSE 't' END AS kind FROM raw)
), heads AS MATERIALIZED (
  SELECT id, h, length(regexp_extract(line, '^(#+)', 1)) AS level, trim(regexp_extract(line, '^#+\s+(.+)$', 1)) AS title FROM lines WHERE kind = 'h'
), stack AS (
  SELECT id, 0::HUGEINT AS h, []::VARCHAR[] AS path FROM (SELECT DISTINCT id FROM raw)
  UNION ALL
  SELECT s.id, x.h, s.path[1:x.level - 1] || [x.title] FROM stack s JOIN heads x ON x.id = s.id AND x.h = s.h + 1
), texts AS MATERIALIZED (
  SELECT id, n, cut, h, dense_rank() OVER (PARTITION BY id ORDER BY cut) - 1 AS b, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS k,
         CASE WHEN row_number() OVER (PARTITION BY id, cut ORDER BY n) = 1 THEN regexp_replace(line, '^\s+', '') ELSE line END AS line
  FROM lines WHERE kind = 't'
), numbers AS MATERIALIZED (SELECT id, k + b AS k, n FROM texts
), blocks AS MATERIALIZED (
  SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY id ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base,
         count(*) OVER (PARTITION BY id) = 1 AND path = '' AS plain
  FROM (SELECT id, b, array_to_string(path, ' > ') AS path, text FROM (SELECT id, b, h, string_agg(line, chr(10) ORDER BY n) AS text FROM texts GROUP BY ALL) JOIN stack USING (id, h))
), canon AS MATERIALIZED (
  SELECT id, string_agg(text, chr(10) || chr(10) ORDER BY b) AS canon, split_part(first(path ORDER BY b) FILTER (WHERE path <> ''), ' > ', 1) AS title FROM blocks GROUP BY id
), pieces AS (
  SELECT id, b, path, base, text, p, generate_subscripts(p, 1) AS i, unnest(p) AS piece FROM (
    SELECT *, CASE WHEN {'TRUE' if lim.mode == 'structure' else 'FALSE'} AND length(text) <= {lim.most} AND NOT plain THEN [text] ELSE list_filter(regexp_extract_all(text, '[^{_MARKS}]*[{_MARKS}]*'), lambda x: x <> '') END AS p FROM blocks)
), runs AS (
  SELECT id, b, path, base, i, i = len(p) AS last_, sum(length(piece)) OVER w AS z, regexp_extract(piece, '[{_MARKS}]*$') AS run, substr(p[i + 1], 1, 1) AS next,
         right(regexp_replace(piece, '[{_MARKS}]+$', ''), 1) AS before, text
  FROM pieces WINDOW w AS (PARTITION BY id, b ORDER BY i)
), ends AS (
  SELECT id, b, path, base, z FROM (SELECT *, coalesce(next, '') = '' OR regexp_matches(next, '^[\s\x{{3400}}-\x{{9fff}}]') AS clear FROM runs)
  WHERE last_ OR regexp_matches(run, '[。！？]')
     OR clear AND regexp_matches(run, '[!?;,:]')
     OR clear AND contains(run, '.') AND NOT regexp_matches(lower(right(substr(text, 1, z::BIGINT), 8)), '{_SHORT}')
     OR regexp_matches(substr(run, 2), '[；，：]') OR regexp_matches(run, '^[；，：]') AND NOT (regexp_matches(before, '^\p{{Nd}}$') AND regexp_matches(coalesce(next, ''), '^\p{{Nd}}'))
), units AS MATERIALIZED (
  SELECT id, b, path, row_number() OVER (PARTITION BY id ORDER BY b, z) AS u, (base + coalesce(lag(z) OVER (PARTITION BY id, b ORDER BY z), 0))::BIGINT AS a, (base + z)::BIGINT AS z FROM ends
), packed AS (
  SELECT id, 1::BIGINT AS u, NULL::BIGINT AS pos, NULL::BIGINT AS now_a, NULL::BIGINT AS now_z, NULL::BIGINT AS now_b, NULL::VARCHAR AS now_path, NULL::BIGINT AS prev_a, NULL::BIGINT AS prev_b,
         []::STRUCT(a BIGINT, z BIGINT, b BIGINT)[] AS spans
  FROM canon
  UNION ALL
  SELECT id, CASE WHEN big AND first + {lim.most} < z THEN u ELSE u + 1 END, CASE WHEN big AND first + {lim.most} < z THEN first + {lim.most} END,
         CASE WHEN NOT big AND NOT done THEN first END, CASE WHEN NOT big AND NOT done THEN z END, CASE WHEN NOT big AND NOT done THEN b END, CASE WHEN NOT big AND NOT done THEN path END,
         CASE WHEN big OR done THEN first ELSE pa END, CASE WHEN big OR done THEN b ELSE pb END,
         CASE WHEN shut THEN [{{'a': now_a, 'z': now_z, 'b': now_b}}] ELSE [] END || CASE WHEN big THEN [{{'a': first, 'z': least(z, first + {lim.most}), 'b': b}}] WHEN done THEN [{{'a': first, 'z': z, 'b': b}}] ELSE [] END
  FROM (
    SELECT *, z IS NOT NULL AND NOT big AND z - first >= {lim.target} AS done FROM (
      SELECT s.id, s.u, s.now_a, s.now_z, s.now_b, u.z, u.b, u.path, {shut} AS shut, {pa} AS pa, {pb} AS pb, coalesce(u.z - u.a > {lim.most}, FALSE) AS big,
             CASE WHEN u.z - u.a > {lim.most} THEN {sliced} WHEN s.now_a IS NOT NULL AND NOT {shut} THEN s.now_a ELSE {opened} END AS first
      FROM packed s LEFT JOIN units u ON u.id = s.id AND u.u = s.u WHERE u.u IS NOT NULL OR s.now_a IS NOT NULL))
), spans AS (
  SELECT id, unnest(spans, recursive := true) FROM packed WHERE len(spans) > 0
), cuts AS (
  SELECT s.id, row_number() OVER (PARTITION BY s.id ORDER BY s.z) - 1 AS ordinal, substr(canon, s.a + 1, s.z - s.a) AS text, s.a, path, title, canon
  FROM spans s JOIN canon c ON c.id = s.id JOIN blocks k ON k.id = s.id AND k.b = s.b
), placed AS (
  SELECT *, a + CASE WHEN trim(text, E' \t\n') = '' THEN 0 ELSE length(text) - length(ltrim(text, E' \t\n')) END AS first, a + CASE WHEN trim(text, E' \t\n') = '' THEN length(text) ELSE length(rtrim(text, E' \t\n')) END AS past FROM cuts
), named AS (
  SELECT source_file_id, relative_path, ordinal::INT AS ordinal, text, path AS heading_path, string_split(relative_path, '/')[-1] AS filename,
         coalesce(title, regexp_replace(string_split(relative_path, '/')[-1], '(.)\.[^.]*$', '\1')) AS title, p.n::INT AS start_line, q.n::INT AS end_line
  FROM placed x JOIN files ON source_file_id = x.id
    JOIN numbers p ON p.id = x.id AND p.k = first - length(replace(substr(canon, 1, first), chr(10), ''))
    JOIN numbers q ON q.id = x.id AND q.k = past - length(replace(substr(canon, 1, past), chr(10), ''))
)
SELECT *, sha256(text) AS content_hash, sha256({hash_prefix} || concat_ws(chr(10), CASE WHEN title <> '' THEN 'Title: ' || title END, CASE WHEN heading_path <> '' THEN 'Heading path: ' || heading_path END,
  CASE WHEN filename <> '' THEN 'Filename: ' || filename END, CASE WHEN text <> '' THEN 'Text:' || chr(10) || text END)) AS embedding_input_hash
FROM named"""

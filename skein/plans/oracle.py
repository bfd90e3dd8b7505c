"""SQL of the registered queries, on the test tables."""

from __future__ import annotations

from ..functions.chunking import Limits
from ..functions.lexing import INPUT_VERSION
from .chunk_sql import chunks_sql
from .tables import IDENTITY, PRELUDE

_LEX = """, flat AS (
  SELECT chunk_id, field, coalesce(string_agg(token, ' ' ORDER BY pos), '') AS t, count(token) AS n FROM toks LEFT JOIN lex USING (chunk_id, field) GROUP BY 1, 2
)"""


def _bm25(weights: str) -> str:
    return f""", w(field, w) AS (VALUES {weights}), hits AS (
  SELECT chunk_id, field, term AS p, count(*) AS h FROM terms WHERE term IN ('the', 'thatth', 'release', 'ete') GROUP BY ALL
  UNION ALL
  SELECT a.chunk_id, a.field, 'doc 7 txt', count(*) FROM terms a
    JOIN terms b ON b.chunk_id = a.chunk_id AND b.field = a.field AND b.place = a.place + 1 AND b.term = '7'
    JOIN terms c ON c.chunk_id = a.chunk_id AND c.field = a.field AND c.place = a.place + 2 AND c.term = 'txt'
  WHERE a.term = 'doc' GROUP BY ALL
), f AS (SELECT chunk_id, p, sum(w * h) AS f FROM hits JOIN w USING (field) GROUP BY ALL
), df AS (SELECT p, count(DISTINCT chunk_id) AS df FROM hits GROUP BY 1
), st AS (SELECT count(*) AS n, avg(n_terms) AS a FROM lengths
), bm AS (
  SELECT chunk_id, 0.0 - sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n_terms / a))) AS score
  FROM f JOIN df USING (p) JOIN lengths USING (chunk_id), st GROUP BY 1
)"""


_FOUR = _bm25("('text', 1.0::DOUBLE), ('title', 6.0), ('heading_path', 4.0), ('filename', 2.0)")
_AT = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)"
_COS = f"list_cosine_distance(vector, {_AT})"
_L2 = f"list_sum(list_transform(list_zip(vector, {_AT}), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"
_SEARCH = _FOUR + f""", words AS (
  SELECT chunk_id, score, row_number() OVER (ORDER BY score, chunk_id) AS rank
  FROM (SELECT chunk_id, score FROM bm JOIN active USING (chunk_id) ORDER BY score, chunk_id LIMIT 20) WHERE chunk_id IN (SELECT chunk_id FROM allowed)
), near AS (
  SELECT chunk_id, score, row_number() OVER (ORDER BY score, chunk_id) AS rank
  FROM (SELECT chunk_id, {_COS} AS score FROM vectors WHERE embedding_space_id = 'space-a' ORDER BY 2, 1 LIMIT 40) WHERE chunk_id IN (SELECT chunk_id FROM allowed)
), both_ AS (
  SELECT chunk_id, rank, 'fts' AS channel FROM words UNION ALL SELECT chunk_id, rank, 'vector' FROM near
), fused AS (
  SELECT *, row_number() OVER (ORDER BY rrf_score DESC, chunk_id) AS rrf_rank
  FROM (SELECT chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf_score, string_agg(channel, ',' ORDER BY channel) AS channels FROM both_ GROUP BY 1)
), merged AS (
  SELECT fused.*, coalesce(quality::DOUBLE, rrf_score) AS final_score, source_id, relative_path, text,
         row_number() OVER (ORDER BY quality IS NULL, (1 - quality) * 1e9 + doc_id, rrf_rank) AS final_rank
  FROM fused JOIN active USING (chunk_id) LEFT JOIN labels ON doc_id = source_file_id WHERE rrf_rank <= 20
)"""
_EXCERPT = "substr(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' '), 1, {})"
_COMPLETE = """, complete AS (
  SELECT f.*, coalesce(lacking, 0) = 0 AS complete FROM files f LEFT JOIN (
    SELECT c.source_file_id AS id, c.generation AS active_generation, count(*) FILTER (WHERE v.chunk_id IS NULL) AS lacking
    FROM chunks c LEFT JOIN (SELECT * FROM vectors WHERE embedding_space_id = 'space-a') v ON v.chunk_id = c.chunk_id AND v.embedding_input_hash = c.embedding_input_hash
    GROUP BY ALL) USING (id, active_generation)
), scan AS (
  SELECT source_id, relative_path, mtime_ns + CASE WHEN id % 4 = 1 THEN 5 WHEN id % 9 = 4 THEN 100000000000000000 ELSE 0 END AS mtime_ns, size,
         CASE WHEN id % 8 = 1 THEN 'other' ELSE sha256 END AS sha256, id % 23 <> 0 AS in_scope
  FROM files WHERE id % 10 <> 2 AND id % 19 <> 0
  UNION ALL SELECT source_id, 'new/' || relative_path, mtime_ns, size, sha256, true FROM files WHERE id % 31 = 5
), j AS (
  SELECT source_id, relative_path, m.id, m.missing_count AS was, s.sha256 IS NOT NULL AS seen, coalesce(s.in_scope, false) AS there,
         coalesce(NOT m.rechunk_required AND m.active_generation > 0, false) AS kept, coalesce(s.mtime_ns = m.mtime_ns AND s.size = m.size AND m.status IN ('indexed', 'missing_pending'), false) AS stamped,
         coalesce(m.complete, false) AS complete, 1700000100000000000 - s.mtime_ns >= 30000000000 AS quiet, coalesce(s.sha256 = m.sha256, false) AS same, m.active_generation
  FROM scan s FULL JOIN complete m USING (source_id, relative_path)
), diff AS (
  SELECT *, CASE WHEN action IN ('missing', 'delete') AND NOT seen THEN coalesce(was, 0) + 1 WHEN action = 'waiting_stable' THEN coalesce(was, 0) ELSE 0 END::BIGINT AS missing_count
  FROM (SELECT *, CASE WHEN there AND kept AND stamped AND complete THEN 'unchanged'
                       WHEN there AND NOT (kept AND stamped) AND NOT quiet THEN 'waiting_stable'
                       WHEN there AND kept AND same AND complete THEN 'unchanged'
                       WHEN there THEN 'index' WHEN id IS NULL THEN 'ignored' WHEN seen THEN 'delete' WHEN coalesce(was, 0) + 1 >= 2 THEN 'delete' ELSE 'missing' END AS action FROM j)
)"""
_ROOTS = """, roots AS (
  SELECT id, CASE WHEN substr(id, 4)::INT % 3 = 0 THEN '/data/src1/' || id ELSE absolute_path END AS path FROM sources
)"""

_ROLL = """, sc AS (
  SELECT source_id, relative_path, selected AND NOT (source_id = 'src2' AND relative_path LIKE 'de/%') AS selected FROM scope
), up AS (
  SELECT source_id, selected, array_to_string(p[1:i], '/') AS dir FROM (SELECT *, string_split(relative_path, '/') AS p, unnest(range(1, len(string_split(relative_path, '/')))) AS i FROM sc)
), roll AS (
  SELECT source_id, dir, count(*) AS n_files, count(*) FILTER (WHERE selected) AS n_selected FROM up GROUP BY ALL
), full_ AS (SELECT source_id, dir FROM roll WHERE n_files = n_selected AND n_selected > 0
)"""

_BODY = {
    "lexical_fields": _LEX + """
SELECT chunk_id, max(t) FILTER (WHERE field = 'title') AS lex_title, max(t) FILTER (WHERE field = 'heading_path') AS lex_heading_path, max(t) FILTER (WHERE field = 'filename') AS lex_filename,
       max(n) FILTER (WHERE field = 'text') AS n_text_tokens, sha256(max(t) FILTER (WHERE field = 'text')) AS lex_text_sha256
FROM flat GROUP BY 1""",
    "retrieval_text": """SELECT chunk_id, sha256('Title: ' || title || chr(10) || CASE WHEN heading_path <> '' THEN 'Heading path: ' || heading_path || chr(10) ELSE '' END
  || 'Filename: ' || filename || CASE WHEN text <> '' THEN chr(10) || 'Text:' || chr(10) || text ELSE '' END) AS retrieval_sha256 FROM chunks""",
    "embedding_input_hash": "SELECT chunk_id, embedding_input_hash FROM chunks",
    "content_hash": "SELECT content_hash, count(*) AS n, min(chunk_id) AS first_chunk FROM chunks GROUP BY 1",
    "chunk_identity": "SELECT id, id || ':' || active_generation || ':0' AS chunk_id, string_split(relative_path, '/')[-1] AS filename, regexp_replace(string_split(relative_path, '/')[-1], '\\.[^.]+$', '') AS stem FROM files",
    "excerpt_projection": f"SELECT chunk_id, '/data/' || source_id || '/' || relative_path AS path, {_EXCERPT.format(220)} AS excerpt FROM active",
    "postings_df": "SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS tf FROM terms GROUP BY 1",
    "corpus_stats": "SELECT count(*) AS n_chunks, round(avg(n_terms), 9) AS avg_terms FROM lengths",
    "bm25_single_field": _bm25("('text', 1.0::DOUBLE), ('title', 0.0), ('heading_path', 0.0), ('filename', 0.0)") + " SELECT chunk_id, round(score, 9) AS score FROM bm",
    "bm25_four_field": _FOUR + " SELECT chunk_id, round(score, 9) AS score FROM bm",
    "fts_topk": _FOUR + " SELECT chunk_id, round(score, 9) AS score FROM (SELECT chunk_id, score FROM bm JOIN active USING (chunk_id) ORDER BY score, chunk_id LIMIT 20)",
    "fts_source_filter": _FOUR + " SELECT chunk_id, round(score, 9) AS score FROM (SELECT chunk_id, score FROM bm JOIN active USING (chunk_id) WHERE source_id IN ('src1', 'src2', 'src3') ORDER BY score, chunk_id LIMIT 20)",
    "fts_batch_topk": """, w(field, w) AS (VALUES ('text', 1.0::DOUBLE), ('title', 6.0), ('heading_path', 4.0), ('filename', 2.0)
), q AS (
  SELECT DISTINCT query_id, array_to_string(run, ' ') AS phrase, run FROM (
    SELECT item_id AS query_id, list_filter(string_split_regex(strip_accents(trim(tok, '_-/')), '[^\\p{L}\\p{N}\\p{M}\\p{Co}]+'), lambda x: x <> '') AS run
    FROM (SELECT item_id, unnest(regexp_extract_all(replace(lower(text || ' doc-' || item_id || '.txt'), 'ß', 'ss'), '[\\p{L}\\p{N}_.+#/-]+')) AS tok FROM benchmark)) WHERE len(run) > 0
), parts AS (SELECT phrase, len(run) AS size, unnest(run) AS term, generate_subscripts(run, 1) AS j FROM (SELECT DISTINCT phrase, run FROM q)
), f AS (
  SELECT chunk_id, phrase, sum(w) AS f FROM (
    SELECT chunk_id, field, phrase FROM terms JOIN parts USING (term) GROUP BY chunk_id, field, phrase, size, place - j HAVING count(*) = size) JOIN w USING (field) GROUP BY ALL
), df AS (SELECT phrase, count(*) AS df FROM f GROUP BY 1
), st AS (SELECT count(*) AS n, avg(n_terms) AS a FROM lengths
), s AS (
  SELECT query_id, chunk_id, round(0.0 - sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n_terms / a))), 9) AS score
  FROM q JOIN f USING (phrase) JOIN df USING (phrase) JOIN lengths USING (chunk_id), st WHERE chunk_id IN (SELECT chunk_id FROM active) GROUP BY ALL
)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS rank FROM s) WHERE rank <= 10""",
    "knn_cosine": f"SELECT chunk_id, round(score, 9) AS score FROM (SELECT chunk_id, {_COS} AS score FROM vectors ORDER BY 2, 1 LIMIT 40)",
    "knn_l2": f"SELECT chunk_id, round(score, 9) AS score FROM (SELECT chunk_id, {_L2} AS score FROM vectors ORDER BY 2, 1 LIMIT 40)",
    "knn_dot": f"SELECT chunk_id, round(score, 9) AS score FROM (SELECT chunk_id, 1 - list_inner_product(vector, {_AT}) AS score FROM vectors ORDER BY 2, 1 LIMIT 40)",
    "knn_prefilter": f"SELECT chunk_id, round(score, 9) AS score FROM (SELECT chunk_id, {_COS} AS score FROM vectors WHERE embedding_space_id = 'space-a' AND source_id IN ('src1', 'src2', 'src3', 'src4') ORDER BY 2, 1 LIMIT 40)",
    "knn_batch": """SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS rank
  FROM (SELECT q.vec_id AS query_id, chunk_id, list_cosine_distance(vector, q.embedding::DOUBLE[]) AS score FROM vectors, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q)) WHERE rank <= 5""",
    "vector_normalize": """SELECT vec_id, round(list_sum(v) / sqrt(list_inner_product(v, v)), 9) AS total, round(list_max(v) / sqrt(list_inner_product(v, v)), 9) AS largest
FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)""",
    "vector_metadata": "SELECT chunk_id, embedding_input_hash, embedding_space_id, generation FROM vectors WHERE chunk_id IN (SELECT chunk_id FROM allowed)",
    "vector_upsert": """SELECT chunk_id, 'space-a' AS embedding_space_id, generation + CASE WHEN embedding_space_id = 'space-b' THEN 100 ELSE 0 END AS generation FROM vectors
UNION ALL SELECT chunk_id, 'space-c', generation FROM chunks WHERE generation = 0""",
    "rrf_fusion": _SEARCH + " SELECT chunk_id, round(rrf_score, 9) AS rrf_score, channels, rrf_rank FROM fused",
    "rerank_merge": _SEARCH + " SELECT chunk_id, final_rank, round(final_score, 9) AS final_score FROM merged",
    "per_file_cap": "SELECT source_id, relative_path, id FROM (SELECT source_id, (size // 1000)::VARCHAR AS relative_path, id, row_number() OVER (PARTITION BY source_id, size // 1000 ORDER BY id) AS n FROM files) WHERE n <= 2",
    "hybrid_search": _SEARCH + f""" SELECT chunk_id, source_id, relative_path, {_EXCERPT.format(260)} AS excerpt, round(final_score, 9) AS final_score
FROM (SELECT *, row_number() OVER (PARTITION BY source_id, relative_path ORDER BY final_rank) AS n FROM merged) WHERE n <= 2 ORDER BY final_rank LIMIT 5""",
    "search_diagnostics": _SEARCH + """ SELECT 'keyword' AS stage, chunk_id, rank FROM words WHERE rank <= 10 UNION ALL SELECT 'vector', chunk_id, rank FROM near WHERE rank <= 10
UNION ALL SELECT 'fusion', chunk_id, rrf_rank FROM fused WHERE rrf_rank <= 10 UNION ALL SELECT 'rerank', chunk_id, final_rank FROM merged WHERE final_rank <= 10""",
    "degraded_fts_only": _SEARCH + " SELECT chunk_id, round(1.0::DOUBLE / (60 + rank), 9) AS rrf_score FROM words WHERE rank <= 5",
    "eligible_sources": "SELECT id, display_name FROM eligible",
    "stale_sources": "SELECT id, why_not FROM reasons WHERE why_not IS NOT NULL",
    "active_chunks_view": "SELECT chunk_id, source_id, relative_path FROM active",
    "glob_scope_filter": """SELECT s.id, s.relative_path LIKE '%.md' AS markdown,
  regexp_matches(s.relative_path, '^en/(.*/)?doc_[^/]5[^/]*\\.txt$') OR regexp_matches(s.relative_path, '^fr/[^/]*\\.md$') AS mixed,
  regexp_matches(s.relative_path, '(^|/)doc_[^/]*[^0-4/]\\.txt$') AS name_only, selected FROM scope s""",
    "hidden_path_filter": "SELECT id, relative_path FROM files WHERE relative_path LIKE '%/.drafts/%' OR relative_path LIKE '%/node_modules/%'",
    "batch_lookup": "SELECT 1000000 - source_file_id AS pos, chunk_id, source_id FROM active WHERE source_file_id % 3 = 0",
    "unknown_ids": "SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT id FROM files WHERE status <> 'error')",
    "chunk_stats": "SELECT doc_id AS source_file_id, 1::BIGINT AS first_line, length(regexp_replace(text, '\\s', '', 'g')) AS n_letters FROM documents WHERE trim(text) <> ''",
    "scan_diff": _COMPLETE + " SELECT source_id, relative_path, action, missing_count FROM diff",
    "run_counters": _COMPLETE + """ SELECT source_id, count(*) FILTER (WHERE action NOT IN ('missing', 'delete')) AS scanned_files, count(*) FILTER (WHERE action = 'index') AS indexed_files,
  count(*) FILTER (WHERE action = 'missing') AS missing_files, count(*) FILTER (WHERE action = 'delete') AS deleted_files FROM diff GROUP BY 1""",
    "missing_confirmation": _COMPLETE + " SELECT id, action, missing_count FROM diff WHERE action IN ('missing', 'delete')",
    "stability_gate": _COMPLETE + " SELECT source_id, relative_path FROM diff WHERE action = 'waiting_stable'",
    "generation_swap": """SELECT source_id, active_generation, status, count(*) AS n, count(pending_generation) AS n_pending FROM (
  SELECT source_id, CASE WHEN sw THEN pending_generation ELSE active_generation END AS active_generation, CASE WHEN sw THEN 'indexed' ELSE status END AS status, CASE WHEN sw THEN NULL ELSE pending_generation END AS pending_generation
  FROM (SELECT *, pending_generation IS NOT NULL AND id % 5 <> 0 AS sw FROM files)) GROUP BY ALL""",
    "vector_reuse": "SELECT a.chunk_id, k.reused_from FROM active a LEFT JOIN (SELECT embedding_input_hash, min(chunk_id) AS reused_from FROM vectors WHERE embedding_space_id = 'space-a' GROUP BY 1) k USING (embedding_input_hash)",
    "inactive_gc": """SELECT chunk_id, source_file_id, generation FROM chunks c WHERE NOT EXISTS (
  SELECT 1 FROM files f WHERE f.id = c.source_file_id AND (c.generation = f.active_generation OR c.generation = f.pending_generation))""",
    "tombstone_antijoin": "SELECT source_id, count(*) AS n FROM vectors WHERE embedding_input_hash <> 'changed' AND source_id <> 'src17' GROUP BY 1",
    "void_tombstones": "SELECT source_id, count(*) AS n, sum(source_file_id)::BIGINT AS ids FROM vectors WHERE NOT (source_file_id % 3 = 0 AND source_file_id % 2 = 1) GROUP BY 1",
    "rechunk_plan": """SELECT coalesce(why_not, 'queued') AS outcome, count(*) AS n_sources, coalesce(sum(n), 0)::BIGINT AS n_files
FROM reasons r LEFT JOIN (SELECT source_id, count(*) AS n FROM files WHERE active_generation > 0 GROUP BY 1) f ON f.source_id = r.id GROUP BY 1""",
    "rechunk_marks": """SELECT f.source_id, count(*) FILTER (WHERE active_generation > 0 OR rechunk_required) AS n_marked,
  CASE WHEN bool_or(why_not IS NULL) AND f.source_id NOT IN (SELECT source_id FROM jobs WHERE status = 'queued') THEN epoch(TIMESTAMP '2024-02-01 00:00:00')::BIGINT ELSE -1 END AS requested_at,
  CASE WHEN bool_or(why_not IS NULL) AND f.source_id NOT IN (SELECT source_id FROM jobs WHERE status = 'queued') THEN 'queued' END AS job
FROM files f JOIN reasons r ON r.id = f.source_id GROUP BY 1""",
    "catalog_upsert": "SELECT source_id, CASE WHEN id % 4 = 0 THEN 'indexed' ELSE status END AS status, count(*) AS n, sum(size)::BIGINT AS n_bytes FROM files GROUP BY ALL",
    "cascade_delete": "SELECT c.chunk_id FROM chunks c JOIN files f ON f.id = c.source_file_id JOIN sources s ON s.id = f.source_id WHERE s.enabled",
    "latest_per_source": "SELECT source_id, max(id) AS id, arg_max(status, id) AS status FROM jobs GROUP BY 1",
    "source_stats": """SELECT source_id, count(DISTINCT f.id) AS n_files, count(c.chunk_id) AS n_chunks, count(DISTINCT CASE WHEN status = 'indexed' THEN f.id END) AS n_indexed, count(DISTINCT CASE WHEN status = 'error' THEN f.id END) AS n_error,
  count(DISTINCT CASE WHEN status = 'waiting_stable' THEN f.id END) AS n_waiting, count(DISTINCT CASE WHEN status = 'missing_pending' THEN f.id END) AS n_missing
FROM files f LEFT JOIN chunks c ON c.source_file_id = f.id AND c.generation = f.active_generation GROUP BY 1""",
    "job_counts": "SELECT status, sum(n)::BIGINT AS n FROM (SELECT status, count(*) AS n FROM jobs GROUP BY 1 UNION ALL VALUES ('queued', 0), ('running', 0)) GROUP BY 1",
    "job_queue_head": "SELECT j.id, source_id, display_name FROM jobs j JOIN sources s ON s.id = j.source_id WHERE status = 'queued' AND enabled AND NOT scope_cleanup_pending ORDER BY requested_at, j.id LIMIT 1",
    "job_history": """SELECT row_number() OVER (ORDER BY b, s) AS place, id, status FROM (
  SELECT *, status NOT IN ('queued', 'running') AS b, CASE WHEN status IN ('queued', 'running') THEN id ELSE -id END AS s FROM jobs ORDER BY b, s LIMIT 50)""",
    "recent_runs": "SELECT count(*) FILTER (WHERE status = 'succeeded') AS n_succeeded, count(*) FILTER (WHERE status = 'failed') AS n_failed FROM (SELECT * FROM jobs WHERE status NOT IN ('queued', 'running') ORDER BY id DESC LIMIT 10)",
    "failed_files": "SELECT f.id, display_name, relative_path, f.last_error FROM files f JOIN sources s ON s.id = f.source_id WHERE status = 'error' ORDER BY mtime_ns DESC, f.id LIMIT 20",
    "error_summary": "SELECT source_id, place, id, last_error FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY NOT contains(last_error, 'provider action required'), relative_path) AS place FROM files WHERE status = 'error') WHERE place <= 5",
    "doctor_counts": """SELECT *, CASE WHEN n_action_required > 0 THEN 'error' WHEN n_file_errors > 0 OR n_consent_current < n_sources THEN 'warning' ELSE 'ok' END AS verdict FROM (
  SELECT count(*) AS n_sources, count(*) FILTER (WHERE enabled) AS n_enabled, count(*) FILTER (WHERE auto_sync) AS n_auto_sync, count(*) FILTER (WHERE consent_identity = 'current') AS n_consent_current FROM sources), (
  SELECT count(*) FILTER (WHERE active_generation > 0) AS n_files, count(*) FILTER (WHERE status = 'error') AS n_file_errors, count(*) FILTER (WHERE contains(last_error, 'provider action required')) AS n_action_required FROM files), (
  SELECT count(*) AS n_active_chunks FROM active)""",
    "vector_integrity": """SELECT a.source_id, CASE WHEN v.chunk_id IS NULL THEN 'missing' WHEN v.embedding_input_hash <> a.embedding_input_hash OR embedding_space_id <> 'space-a' THEN 'invalid' ELSE 'found' END AS state, count(*) AS n
FROM active a LEFT JOIN vectors v USING (chunk_id) GROUP BY ALL""",
    "doctor_report": """, seen AS (
  SELECT place, count(*) AS n_enabled, count(*) FILTER (WHERE consent_identity = 'current') AS n_consent_current, count(*) FILTER (WHERE auto_sync) AS n_auto_sync
  FROM sources, (VALUES ('stopped'), ('running')) p(place) WHERE enabled AND (place = 'stopped' OR consent_identity = 'current') GROUP BY 1
), broken AS (
  SELECT count(*) AS e, count(*) FILTER (WHERE regexp_matches(last_error, 'provider action required|HTTP 40[123]')) AS a FROM files WHERE status = 'error' AND source_id IN (SELECT id FROM sources WHERE enabled)
), undone AS (
  SELECT count(*) AS o, count(*) FILTER (WHERE epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(CASE WHEN status = 'running' THEN coalesce(started_at, requested_at) ELSE requested_at END) > 900) AS s
  FROM jobs WHERE status IN ('queued', 'running')
), failing AS (
  SELECT count(*) AS v FROM active a LEFT JOIN vectors v USING (chunk_id) WHERE v.chunk_id IS NULL OR v.embedding_input_hash <> a.embedding_input_hash OR embedding_space_id <> 'space-a'
), n AS (
  SELECT seen.*, (SELECT count(*) FROM active) AS n_active_chunks, if(place = 'stopped', e, 0) AS n_file_errors, if(place = 'stopped', a, 0) AS n_action_required,
         if(place = 'stopped', o, 0) AS n_open, if(place = 'stopped', s, 0) AS n_stuck, if(place = 'stopped', v, 0) AS n_failing FROM seen, broken, undone, failing
), told AS (
  SELECT *, list_filter([CASE WHEN n_stuck > 0 THEN 'one or more knowledge tasks appear stuck' WHEN n_open > 0 AND place = 'stopped' THEN 'knowledge tasks remain open while the coordinator is not running' END,
      CASE WHEN n_failing > 0 THEN 'one or more active vectors are missing or invalid' END], lambda x: x IS NOT NULL) AS errors,
    list_filter([CASE WHEN n_enabled = 0 THEN 'no enabled knowledge source' WHEN n_active_chunks = 0 THEN 'no active knowledge chunks' WHEN n_consent_current <> n_enabled THEN 'one or more source consents are stale'
      WHEN n_auto_sync <> n_enabled THEN 'one or more enabled sources are not set to auto-sync' END,
      CASE WHEN n_action_required > 0 THEN 'provider credentials, account balance, quota, or model access requires attention before failed files can be retried' WHEN n_file_errors > 0 THEN 'one or more source files failed to index' END,
      CASE WHEN place = 'stopped' THEN 'knowledge coordinator is not running' END, CASE WHEN n_stuck = 0 AND n_open > 0 AND place = 'running' THEN 'knowledge tasks are still open' END], lambda x: x IS NOT NULL) AS warnings FROM n
)
SELECT * EXCLUDE (errors, warnings), CASE WHEN len(errors) > 0 THEN 'error' WHEN len(warnings) > 0 THEN 'warning' ELSE 'ok' END AS status,
  CASE WHEN len(errors || warnings) = 0 THEN 'knowledge backend is ready' ELSE 'knowledge backend has errors: ' || array_to_string(errors || warnings, '; ') END AS message FROM told""",
    "stuck_tasks": """SELECT id, source_id, status, age_seconds FROM (
  SELECT *, (epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(CASE WHEN status = 'running' THEN coalesce(started_at, requested_at) ELSE requested_at END))::BIGINT AS age_seconds FROM jobs WHERE status IN ('queued', 'running')) WHERE age_seconds > 900""",
    "retry_due": """SELECT id, coalesce(next_at, -1) AS next_at, coalesce(next_at <= epoch(TIMESTAMP '2024-02-01 00:00:00'), true) AS due FROM (
  SELECT id, (epoch(last_scan_at) + CASE WHEN last_error IN ('HTTP 401', 'HTTP 402', 'HTTP 403') THEN 3600 ELSE 600 END)::BIGINT AS next_at FROM sources WHERE auto_sync)""",
    "preview_estimate": """SELECT source_id, n_files, n_bytes, n_chunks, n_tokens, round(n_tokens / 1e6 * 0.02::DOUBLE, 4) AS cost FROM (
  SELECT source_id, count(*) AS n_files, sum(size)::BIGINT AS n_bytes, sum(greatest(1, ceil(size / 2400.0::DOUBLE)))::BIGINT AS n_chunks, sum(size // 2)::BIGINT AS n_tokens FROM files GROUP BY 1)""",
    "scope_rollup": _ROLL + " SELECT source_id, dir, n_files, n_selected, CASE WHEN n_selected = 0 THEN 'off' WHEN n_selected = n_files THEN 'full' ELSE 'partial' END AS state FROM roll",
    "scope_minimal_cover": _ROLL + """ SELECT source_id, path, kind FROM (
  SELECT source_id, dir AS path, 'directory' AS kind FROM full_ UNION ALL SELECT source_id, relative_path, 'file' FROM sc WHERE selected) n
WHERE NOT EXISTS (SELECT 1 FROM full_ f WHERE f.source_id = n.source_id AND starts_with(n.path, f.dir || '/'))""",
    "scope_truncation": _ROLL + """, cover AS (SELECT source_id, path, kind, count(*) OVER (PARTITION BY source_id) AS n FROM (
  SELECT source_id, dir AS path, 'directory' AS kind FROM full_ UNION ALL SELECT source_id, relative_path, 'file' FROM sc WHERE selected) n
  WHERE NOT EXISTS (SELECT 1 FROM full_ f WHERE f.source_id = n.source_id AND starts_with(n.path, f.dir || '/')))
SELECT source_id, path, kind, false AS truncated FROM cover WHERE n <= 12 UNION ALL SELECT DISTINCT source_id, NULL, NULL, true FROM cover WHERE n > 12""",
    "root_overlap": _ROOTS + " SELECT a.id AS outer_id, b.id AS inner_id FROM roots a JOIN roots b ON a.id <> b.id AND (b.path = a.path OR starts_with(b.path, a.path || '/'))",
    "source_registration": _ROOTS + """ SELECT n.id, CASE WHEN n.id = 'src5' THEN 'id exists' WHEN n.id = 'src8' THEN 'id repeats' ELSE 'root overlaps another' END AS why
FROM (SELECT * FROM roots UNION ALL SELECT id, '/elsewhere' FROM roots WHERE id = 'src8') n
WHERE n.id IN ('src5', 'src8') OR substr(n.id, 4)::INT % 2 = 0 AND EXISTS (SELECT 1 FROM roots o WHERE o.id <> n.id AND (o.path = n.path OR starts_with(o.path, n.path || '/') OR starts_with(n.path, o.path || '/')))""",
    "tree_page": _ROLL + """ SELECT source_id, path, kind FROM (SELECT source_id, dir AS path, 'directory' AS kind FROM roll UNION ALL SELECT source_id, relative_path, 'file' FROM sc)
WHERE source_id > 'src1' OR source_id = 'src1' AND (string_split(path, '/') > ['en'] OR path = 'en' AND kind > 'directory')
ORDER BY source_id, string_split(path, '/'), kind LIMIT 200""",
    "scope_patterns": _ROLL + """, cover AS (SELECT source_id, path, kind FROM (
  SELECT source_id, dir AS path, 'directory' AS kind FROM full_ UNION ALL SELECT source_id, relative_path, 'file' FROM sc WHERE selected) n
  WHERE NOT EXISTS (SELECT 1 FROM full_ f WHERE f.source_id = n.source_id AND starts_with(n.path, f.dir || '/')))
SELECT DISTINCT source_id, CASE WHEN kind = 'file' THEN path ELSE path || '/' || tail END AS pattern FROM cover, (VALUES ('**/*.md'), ('*.md'), ('**/*.txt'), ('*.txt')) v(tail)""",
    "consent_renewal": "SELECT id FROM sources WHERE enabled AND consent_identity <> 'next' AND id NOT IN (SELECT source_id FROM jobs WHERE id % 7 = 0 AND status IN ('queued', 'running'))",
    "source_removal": """SELECT chunk_id, source_id, true AS scope_cleanup FROM vectors WHERE source_id IN ('src2', 'src4', 'src8')
  AND source_id NOT IN (SELECT source_id FROM jobs WHERE id % 7 = 0 AND status IN ('queued', 'running'))""",
    "removal_refusals": """SELECT * FROM (SELECT a.id, CASE WHEN s.id IS NULL THEN 'unknown' WHEN a.id IN (SELECT source_id FROM jobs WHERE id % 7 = 0 AND status IN ('queued', 'running')) THEN 'a job is open'
    WHEN scope_cleanup_pending THEN 'a scope cleanup is pending' END AS why
  FROM (VALUES ('src2'), ('src4'), ('src8'), ('src17'), ('nowhere')) a(id) LEFT JOIN sources s USING (id)) WHERE why IS NOT NULL""",
    "scope_change": """SELECT s.id, CASE WHEN busy THEN consent_identity ELSE 'renewed' END AS consent_identity, NOT busy AS narrowed, (scope_cleanup_pending OR NOT busy) AND pending AS scope_cleanup_pending,
  CASE WHEN busy THEN 'a job is open' END AS why
FROM (SELECT *, id IN (SELECT source_id FROM jobs WHERE status IN ('queued', 'running') AND requested_at >= TIMESTAMP '2024-01-31 23:50:00') AS busy,
             id IN (SELECT source_id FROM vectors WHERE embedding_space_id = 'space-b' AND embedding_input_hash = 'changed') AS pending FROM sources) s""",
    "job_recovery": """SELECT source_id, CASE WHEN error IS NULL THEN status ELSE 'failed' END AS status, error, count(*) AS n FROM (
  SELECT j.source_id, j.status, CASE WHEN j.status IN ('queued', 'running') THEN CASE WHEN NOT s.enabled THEN 'source is disabled during indexer recovery'
    WHEN s.scope_cleanup_pending THEN 'source scope cleanup is pending during indexer recovery' END END AS error
  FROM jobs j LEFT JOIN sources s ON s.id = j.source_id) GROUP BY ALL""",
    "rebuild_page": """SELECT chunk_id, source_id FROM active WHERE source_id > 'src2' OR source_id = 'src2' AND (source_file_id > 100 OR source_file_id = 100 AND ordinal > 0)
ORDER BY source_id, source_file_id, ordinal LIMIT 256""",
    "vector_rebuild": """SELECT chunk_id, source_id, 'space-n' AS embedding_space_id, embedding_input_hash, length('Title: ' || title || chr(10) || CASE WHEN heading_path <> '' THEN 'Heading path: ' || heading_path || chr(10) ELSE '' END
  || 'Filename: ' || filename || CASE WHEN text <> '' THEN chr(10) || 'Text:' || chr(10) || text ELSE '' END)::BIGINT AS n_chars
FROM active WHERE source_id IN (SELECT id FROM eligible)""",
    "integrity_sample": """SELECT a.chunk_id, CASE WHEN v.chunk_id IS NULL THEN 'missing' ELSE 'invalid' END AS state FROM active a LEFT JOIN vectors v USING (chunk_id)
WHERE v.chunk_id IS NULL OR v.embedding_input_hash <> a.embedding_input_hash OR embedding_space_id <> 'space-a' ORDER BY 1 LIMIT 50""",
}

#: The chunks that segmented_bm25's last segment leaves.
_EDITED = PRELUDE.replace(
    "SELECT doc_id || ':' || g || ':0' AS chunk_id, doc_id AS source_file_id, g AS generation, 0 AS ordinal, text,",
    "SELECT doc_id || ':' || CASE WHEN doc_id % 9 = 4 THEN 9 ELSE g END || ':0' AS chunk_id, doc_id AS source_file_id, g AS generation, 0 AS ordinal, CASE WHEN doc_id % 9 = 4 THEN 'release notes: ' ELSE '' END || text AS text,",
).replace("[1 + doc_id % 2, 0] ELSE [1 + doc_id % 2] END) AS g FROM documents)", "[1 + doc_id % 2] ELSE [1 + doc_id % 2] END) AS g FROM documents WHERE doc_id % 9 = 4 OR doc_id % 11 <> 5)")

_PREFIX = f"'{INPUT_VERSION}' || chr(0) || '{IDENTITY}' || chr(0)"
_CHUNKS = {
    "chunk_documents_plain": chunks_sql("SELECT doc_id AS source_file_id, lang || '/doc_' || doc_id || '.txt' AS relative_path, text AS content FROM documents", Limits(), _PREFIX),
    "chunk_markdown": chunks_sql(
        """SELECT conv_id AS source_file_id, 'chats/' || conv_id || '.md' AS relative_path,
    '# Chat ' || conv_id || chr(10) || chr(10) || string_agg('## ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id""",
        Limits(400, 600, "length", 40), _PREFIX),
}

ORACLE = {name: PRELUDE + body for name, body in _BODY.items()} | _CHUNKS | {"segmented_bm25": _EDITED + _BODY["bm25_four_field"], "fts_blockmax": PRELUDE + _BODY["fts_topk"]}

"""The SQL that the general data-pipeline queries are compared with."""

P3_FOUND = r"""
WITH since AS (SELECT max(started_at) AS t FROM pipeline_runs WHERE run_status = 'ok' AND run_mode = 'normal'),
hex AS (
  SELECT song_dir, written_at, log_id, arrived_at, stages,
    list_transform([inputs.audio.sha256, inputs.lyrics_timeline.sha256, inputs.config_sha256],
      lambda h: regexp_replace(regexp_replace(regexp_replace(lower(h), '[\s:_\-]+', '', 'g'), '^(sha-?256|0x)+', ''), '^0+([0-9a-f])', '\1')) AS hashes,
    list_sort(list_transform(map_entries(stages), lambda e: {'k': e.key, 's': e.value.signature})) AS signatures,
    coalesce(len(list_filter(map_entries(stages), lambda e: coalesce(e.value.status NOT IN ('done', 'skipped'), true))) > 0, false) AS open
  FROM artifact_log),
now AS (SELECT * FROM hex QUALIFY row_number() OVER (PARTITION BY song_dir ORDER BY written_at DESC, log_id DESC) = 1),
seen AS (SELECT hex.* FROM hex, since WHERE arrived_at < since.t QUALIFY row_number() OVER (PARTITION BY song_dir ORDER BY written_at DESC, log_id DESC) = 1)
SELECT now.song_dir FROM now LEFT JOIN seen ON now.song_dir IS NOT DISTINCT FROM seen.song_dir
WHERE seen.log_id IS NULL OR seen.open OR now.hashes IS DISTINCT FROM seen.hashes OR now.signatures IS DISTINCT FROM seen.signatures
"""

P7_FOUND = """
WITH sides AS (
  SELECT artifact_id, 'final' AS basis, start_ms AS s, end_ms AS e FROM alignment_lines
  UNION SELECT artifact_id, 'original', original_start_ms, original_end_ms FROM alignment_lines),
ok AS (SELECT * FROM sides WHERE s < e),
marked AS (
  SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY artifact_id, basis ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ok),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY artifact_id, basis ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM marked),
periods AS (SELECT artifact_id, basis, k, min(s) AS s, max(e) AS e FROM numbered GROUP BY ALL)
SELECT artifact_id, basis, 'period' AS kind, s AS start_ms, e AS end_ms FROM periods
UNION ALL
SELECT artifact_id, basis, 'gap', pe, s FROM (SELECT *, lag(e) OVER (PARTITION BY artifact_id, basis ORDER BY s) AS pe FROM periods) WHERE pe IS NOT NULL
"""

SQL: dict[str, str] = {"p3_found": P3_FOUND, "p7_found": P7_FOUND}

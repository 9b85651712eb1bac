"""Queries of the timeline operators over the driver's tables, each with the SQL it is compared with.

Songs are ``song_dir`` or ``artifact_id``, lines are rows of ``lyrics_timeline`` and
``alignment_lines``; event series stand in for energy frames.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.functions import text as T
from strophe.operators import align, display, intervals, metrics, offset, reading, runs, signal, stages
from strophe.plans import prepare
from strophe.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _lines(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """Alignment lines, each once, in their last delivery."""
    df = table(spark, sf, "alignment_lines")
    cols = list(columns) or [c for c in df.columns if c not in ("line_key", "updated_at")]
    return df.groupBy("line_key").agg(F.max_by(F.struct(*cols), "updated_at").alias("r")).select("line_key", "r.*")


WS = r"[\t\n\x0B\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINES = "l AS (SELECT * FROM alignment_lines QUALIFY row_number() OVER (PARTITION BY line_key ORDER BY updated_at DESC) = 1)"
CLEAN = f"""c AS (
  SELECT line_id, song_dir, song_id, source_index, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS text, coalesce(start_ms, 0) AS start_ms, coalesce(end_ms, 0) AS end_ms
  FROM (SELECT * FROM lyrics_timeline QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY loaded_at DESC) = 1)
  WHERE length(regexp_replace(coalesce(text, ''), '^{WS}+|{WS}+$', '', 'g')) > 0)"""
UNITS = "0-9A-Za-z぀-ヿ㐀-鿿"


def mora_sql(c: str) -> str:
    return f"regexp_extract_all(regexp_replace({c}, '[^{UNITS}]+([{T.SMALL}])', '\\1', 'g'), '(?:[0-9A-Za-z]+|[぀-ヿ㐀-鿿])[{T.SMALL}]*')"


def hira_sql(c: str) -> str:
    return f"translate({c}, '{T.KATAKANA}', '{T.HIRAGANA}')"


NON_SUNG_SQL = "regexp_matches(text, '(?i)" + T.NON_SUNG.replace(r"\s", WS) + "')"
CATEGORY_SQL = """CASE WHEN regexp_matches(text, '[぀-ヿ]') AND regexp_matches(text, '[A-Za-z]') THEN 'kana_latin' WHEN regexp_matches(text, '[぀-ヿ]') THEN 'kana_no_latin'
  WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin_without_kana' WHEN regexp_matches(text, '[㐀-鿿]') THEN 'han_without_kana' ELSE 'other' END"""


SPELLED_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.HEPBURN.items()) + "}"


# ------------------------------------------------------------------- sources, text


@query(f"WITH {CLEAN} SELECT line_id, song_dir, source_index, text, start_ms, end_ms, start_ms - lag(end_ms) OVER (PARTITION BY song_dir ORDER BY source_index, line_id) AS gap_ms FROM c")
def timeline_build(spark, sf):
    """Clean timelines with the gap before each line."""
    c = prepare.clean_timeline(table(spark, sf, "lyrics_timeline"))
    w = Window.partitionBy("song_dir").orderBy("source_index", "line_id")
    return c.select("line_id", "song_dir", "source_index", "text", "start_ms", "end_ms", (F.col("start_ms") - F.lag("end_ms").over(w)).alias("gap_ms"))


@query(
    f"""WITH {CLEAN}, r AS (SELECT *, {NON_SUNG_SQL} AS quiet, replace({hira_sql('text')}, ' ', '') AS reading FROM c),
m AS (SELECT song_id, CASE WHEN quiet THEN 'non_sung' WHEN reading = '' THEN 'unresolved' ELSE 'interpolation' END AS status, CASE WHEN quiet OR end_ms <= start_ms THEN 0 ELSE len({mora_sql('reading')}) END AS mora FROM r)
SELECT song_id, status, count(*) AS lines, sum(mora)::BIGINT AS mora FROM m GROUP BY ALL"""
)
def reading_baseline(spark, sf):
    """The flagship: clean, classify, read, split and time every line, then count by song and status; JVM-side throughout."""
    c = prepare.clean_timeline(table(spark, sf, "lyrics_timeline"))
    quiet = T.non_sung(F.col("text"))
    said = F.when(quiet, "").otherwise(F.replace(T.kata_to_hira(F.col("text")), F.lit(" "), F.lit("")))
    status = F.when(quiet, "non_sung").when(F.length("reading") == 0, "unresolved").otherwise("interpolation")
    timed = c.withColumn("reading", said).withColumn("mora", intervals.split(T.split_mora(F.col("reading")), F.col("start_ms"), F.col("end_ms")))
    return timed.groupBy("song_id", status.alias("status")).agg(F.count("*").alias("lines"), F.sum(F.size("mora")).alias("mora"))


@query(f"WITH {CLEAN} SELECT line_id, {NON_SUNG_SQL} AS non_sung, {CATEGORY_SQL} AS category, regexp_matches(text, '^[぀-ヿ㐀-鿿]') AS japanese FROM c")
def line_scripts(spark, sf):
    c, t = prepare.clean_timeline(table(spark, sf, "lyrics_timeline")), F.col("text")
    return c.select("line_id", T.non_sung(t).alias("non_sung"), T.script_category(t).alias("category"), T.is_japanese(t).alias("japanese"))


@query(
    f"""WITH {CLEAN}, n AS (SELECT song_dir, sum(length(regexp_replace(text, '[^぀-ヿ]', '', 'g'))) AS kana, sum(length(regexp_replace(text, '[^㐀-鿿]', '', 'g'))) AS han FROM c GROUP BY 1)
SELECT song_dir, kana::BIGINT AS kana, han::BIGINT AS han FROM n WHERE kana > 0 AND kana / (kana + han) >= 0.08"""
)
def japanese_songs(spark, sf):
    c = prepare.clean_timeline(table(spark, sf, "lyrics_timeline"))
    n = lambda p: F.sum(F.length(F.regexp_replace("text", f"[^{p}]", "")))
    return c.groupBy("song_dir").agg(n("぀-ヿ").alias("kana"), n("㐀-鿿").alias("han")).filter("kana > 0 and kana / (kana + han) >= 0.08")


@query(f"WITH {LINES} SELECT line_key, {hira_sql('reading')} AS hira, regexp_replace({hira_sql('reading')}, '[^぀-ヿー]', '', 'g') AS canon FROM l")
def canonical_readings(spark, sf):
    r = F.col("reading")
    return _lines(spark, sf, "reading").select("line_key", T.kata_to_hira(r).alias("hira"), T.canonical_reading(r).alias("canon"))


@query(f"WITH {LINES} SELECT line_key, len({mora_sql('reading')})::INT AS n, array_to_string({mora_sql('reading')}, '|') AS mora FROM l WHERE reading IS NOT NULL")
def mora_split(spark, sf):
    m = T.split_mora(F.col("reading"))
    return _lines(spark, sf, "reading").filter("reading is not null").select("line_key", F.size(m).alias("n"), F.array_join(m, "|").alias("mora"))


@query(
    f"""WITH {LINES}, h AS (SELECT line_key, regexp_replace({hira_sql('reading')}, '(っ+)((?:\\P{{L}}|ー)+)(\\p{{L}})', '\\2\\1\\3', 'g') AS r FROM l),
p AS (SELECT line_key, list_transform(regexp_extract_all(r, '(?s)っ*(?:{'|'.join(T.HEPBURN_TWO)}|[^っ])|っ+$'), lambda x: [replace(x, 'っ', ''), x]) AS parts FROM h),
v AS (SELECT line_key, list_transform(parts, lambda x: [coalesce({SPELLED_SQL}[x[1]], x[1]), x[2]]) AS parts FROM p)
SELECT line_key, array_to_string(list_filter(list_transform(parts, lambda x: CASE WHEN starts_with(x[2], 'っ') AND regexp_matches(x[1], '^\\p{{L}}') THEN x[1][1] || x[1] ELSE x[1] END), lambda v: v <> ''), ' ') AS romaji FROM v"""
)
def romaji_spelling(spark, sf):
    return _lines(spark, sf, "reading").select("line_key", T.romaji(F.col("reading")).alias("romaji"))


@query("SELECT doc_id, sha256(text) AS sha, length(text)::BIGINT AS n FROM documents")
def sha_signature(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.length("text").cast("bigint").alias("n"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def event_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


# ------------------------------------------------------------------- intervals


@query(
    f"""WITH {LINES}, m AS (SELECT line_key, start_ms, end_ms, {mora_sql('reading')} AS v FROM l WHERE end_ms > start_ms),
u AS (SELECT line_key, start_ms, end_ms, len(v) AS n, unnest(v) AS text, unnest(range(len(v))) AS i FROM m)
SELECT line_key, i::INT AS pos, text, start_ms + round_even((end_ms - start_ms) * i / n, 0)::BIGINT AS start_ms, start_ms + round_even((end_ms - start_ms) * (i + 1) / n, 0)::BIGINT AS end_ms FROM u"""
)
def interval_split(spark, sf):
    parts = intervals.split(T.split_mora(F.col("reading")), F.col("start_ms"), F.col("end_ms"))
    return _lines(spark, sf, "reading", "start_ms", "end_ms").select("line_key", F.posexplode(parts).alias("pos", "m")).select("line_key", "pos", "m.text", "m.start_ms", "m.end_ms")


@query(
    f"""WITH {LINES}, o AS (SELECT *, (artifact_id % 7 - 3) * 400 AS d FROM l)
SELECT line_key, start_ms AS original_start_ms, end_ms AS original_end_ms, greatest(0, start_ms + d) AS start_ms, greatest(greatest(0, start_ms + d), end_ms + d) AS end_ms FROM o WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL"""
)
def global_shift(spark, sf):
    lines = _lines(spark, sf, "artifact_id", "start_ms", "end_ms").filter("start_ms is not null and end_ms is not null")
    return intervals.shift(lines, (F.col("artifact_id") % 7 - 3) * 400).select("line_key", "original_start_ms", "original_end_ms", "start_ms", "end_ms")


@query(
    f"""WITH {LINES}, w AS (SELECT artifact_id, source_index, line_key, start_ms AS s, end_ms AS e, lag(start_ms) OVER p AS ps, lag(end_ms) OVER p AS pe FROM l WINDOW p AS (PARTITION BY artifact_id ORDER BY source_index, line_key))
SELECT artifact_id, source_index, line_key, 'missing_time' AS problem FROM w WHERE s IS NULL OR e IS NULL
UNION ALL SELECT artifact_id, source_index, line_key, 'negative_time' FROM w WHERE s < 0 OR e < 0
UNION ALL SELECT artifact_id, source_index, line_key, 'inverted' FROM w WHERE e < s
UNION ALL SELECT artifact_id, source_index, line_key, 'unsorted' FROM w WHERE s < ps
UNION ALL SELECT artifact_id, source_index, line_key, 'overlaps_previous' FROM w WHERE s < pe"""
)
def validate_lines(spark, sf):
    return intervals.lint(_lines(spark, sf, "artifact_id", "source_index", "start_ms", "end_ms"), ["artifact_id"], ["source_index", "line_key"])


_BOUNDS = """CASE WHEN singing_start_ms IS NOT NULL AND singing_end_ms IS NOT NULL AND isfinite(activity_confidence) AND activity_confidence >= 0.35
  AND greatest(start_ms, least(end_ms, singing_start_ms)) < greatest(start_ms, least(end_ms, singing_end_ms)) THEN 1 END"""


@query(
    f"""WITH {LINES}, t AS (SELECT * FROM l WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL), b AS (SELECT *, {_BOUNDS} AS ok, greatest(start_ms, least(end_ms, singing_start_ms)) AS a, greatest(start_ms, least(end_ms, singing_end_ms)) AS z FROM t),
k AS (SELECT *, coalesce(activity_confidence >= 0.45 AND isfinite(activity_confidence) AND singing_start_ms IS NOT NULL AND singing_end_ms IS NOT NULL AND a < z, false) AS sure FROM b)
SELECT line_key, CASE WHEN ok = 1 THEN a END AS voice_start, CASE WHEN ok = 1 THEN z END AS voice_end, CASE WHEN sure THEN greatest(start_ms, a - 120) ELSE greatest(0, start_ms - 500) END AS window_start,
  CASE WHEN sure THEN least(end_ms, z + 120) ELSE end_ms + 500 END AS window_end, CASE WHEN sure THEN 'activity' ELSE 'line' END AS window_source FROM k"""
)
def activity_bounds(spark, sf):
    lines = _lines(spark, sf, "start_ms", "end_ms", "singing_start_ms", "singing_end_ms", "activity_confidence").filter("start_ms is not null and end_ms is not null")
    c = [F.col(x) for x in ("start_ms", "end_ms", "singing_start_ms", "singing_end_ms", "activity_confidence")]
    # a bound that is missing must stay missing when it is clamped
    sure = c[2].isNotNull() & c[3].isNotNull()
    b, w = display.reliable_bounds(*c), align.window(c[0], c[1], F.when(sure, c[2]), F.when(sure, c[3]), F.when(sure, c[4]))
    return lines.select("line_key", b["start_ms"].alias("voice_start"), b["end_ms"].alias("voice_end"), w["start_ms"].alias("window_start"), w["end_ms"].alias("window_end"), w["source"].alias("window_source"))


@query(
    f"""WITH {LINES}, t AS (SELECT * FROM l WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL),
s AS (SELECT *, coalesce(reading = '', true) OR coalesce(status = 'non_sung', false) AS silent, coalesce(nullif(alignment_status, ''), status) AS state, {_BOUNDS} AS ok, greatest(start_ms, least(end_ms, singing_start_ms)) AS a, greatest(start_ms, least(end_ms, singing_end_ms)) AS z FROM t),
p AS (SELECT *, NOT silent AND coalesce(state = 'ctc', false) AS ctc FROM s)
SELECT line_key, CASE WHEN silent THEN 'line_interpolation' WHEN ctc THEN CASE WHEN timing_source = 'ctc_rescaled' THEN 'ctc_rescaled' ELSE 'ctc' END WHEN ok = 1 THEN 'activity_interpolation' ELSE 'line_interpolation' END AS timing_source,
  CASE WHEN silent OR ctc THEN 0 WHEN CASE WHEN ok = 1 THEN a < z ELSE start_ms < end_ms END THEN len({mora_sql('reading')}) ELSE 0 END::INT AS mora,
  CASE WHEN silent OR ctc OR NOT CASE WHEN ok = 1 THEN a < z ELSE start_ms < end_ms END OR len({mora_sql('reading')}) = 0 THEN NULL WHEN ok = 1 THEN a ELSE start_ms END AS first_ms FROM p"""
)
def timing_policy(spark, sf):
    lines = _lines(spark, sf, "text", "reading", "start_ms", "end_ms", "singing_start_ms", "singing_end_ms", "activity_confidence", "status", "alignment_status", "timing_source", "warnings").filter("start_ms is not null and end_ms is not null")
    return display.timing_policy(lines).select("line_key", "timing_source", F.coalesce(F.size("mora"), F.lit(0)).alias("mora"), F.get("mora", F.lit(0))["start_ms"].alias("first_ms"))


@query(
    f"""WITH {LINES}, p AS (SELECT line_key, unnest(range(length(text))) AS pos, surface_spans FROM l), s AS (SELECT line_key, unnest(surface_spans) AS sp, unnest(range(len(surface_spans))) AS k FROM l),
j AS (SELECT p.line_key, p.pos, min(s.k) AS span_pos FROM p LEFT JOIN s ON p.line_key = s.line_key AND s.sp.surface_start <= p.pos AND p.pos < s.sp.surface_end GROUP BY ALL)
SELECT line_key, pos::INT AS pos, span_pos::INT AS span_pos FROM j"""
)
def containment_join(spark, sf):
    """The first surface span around every character."""
    lines = _lines(spark, sf, "text", "surface_spans")
    points = lines.filter("length(text) > 0").select("line_key", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("pos"))
    spans = lines.select("line_key", F.posexplode("surface_spans").alias("span_pos", "s")).select("line_key", "span_pos", "s.surface_start", "s.surface_end")
    return intervals.contained(points, spans, ["line_key"], "pos", "surface_start", "surface_end", ["span_pos"]).select("line_key", "pos", "span_pos")


@query(f"WITH {LINES} SELECT artifact_id, count(*) AS lines, min(start_ms) AS first_ms, max(end_ms) AS last_ms FROM l WHERE end_ms > start_ms GROUP BY 1")
def lasting_lines(spark, sf):
    """Lines that last, by artifact: what a search for a shift starts from."""
    lines = intervals.lasting(_lines(spark, sf, "artifact_id", "start_ms", "end_ms"))
    return lines.groupBy("artifact_id").agg(F.count("*").alias("lines"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"))


@query(
    f"""WITH {LINES} SELECT a.line_key AS line_a, b.line_key AS line_b FROM l a JOIN l b ON a.artifact_id = b.artifact_id AND a.end_ms > b.original_start_ms AND a.start_ms < b.original_end_ms WHERE a.line_key <> b.line_key"""
)
def overlap_join(spark, sf):
    """Lines whose final time meets another line's original time in the same artifact."""
    lines = _lines(spark, sf, "artifact_id", "start_ms", "end_ms", "original_start_ms", "original_end_ms")
    a = lines.select("artifact_id", F.col("line_key").alias("line_a"), F.col("start_ms").alias("s"), F.col("end_ms").alias("e"))
    b = lines.select("artifact_id", F.col("line_key").alias("line_b"), F.col("original_start_ms").alias("os"), F.col("original_end_ms").alias("oe"))
    return intervals.overlapping(a, b, ["artifact_id"], "s", "e", "os", "oe").filter("line_a != line_b").select("line_a", "line_b")


@query(
    f"""WITH {LINES}, t AS (SELECT * FROM l WHERE start_ms < end_ms),
m AS (SELECT *, coalesce(start_ms >= max(end_ms) OVER (PARTITION BY artifact_id ORDER BY start_ms, end_ms, line_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM t)
SELECT artifact_id, line_key, sum(fresh::INT) OVER (PARTITION BY artifact_id ORDER BY start_ms, end_ms, line_key ROWS UNBOUNDED PRECEDING)::BIGINT AS grp FROM m"""
)
def overlap_groups(spark, sf):
    lines = _lines(spark, sf, "artifact_id", "start_ms", "end_ms").filter("start_ms < end_ms")
    return intervals.overlap_groups(lines, ["artifact_id"], ["start_ms", "end_ms", "line_key"], "start_ms", "end_ms").select("artifact_id", "line_key", "grp")


@query(
    f"""WITH {LINES}, t AS (SELECT *, max(end_ms) OVER (PARTITION BY artifact_id) AS hi FROM l WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL),
o AS (SELECT *, greatest(0, max(least(hi, start_ms)) OVER (PARTITION BY artifact_id ORDER BY source_index, line_key ROWS UNBOUNDED PRECEDING)) AS a FROM t)
SELECT line_key, a AS start_ms, greatest(a, least(hi, end_ms)) AS end_ms FROM o"""
)
def monotone_onsets(spark, sf):
    lines = _lines(spark, sf, "artifact_id", "source_index", "start_ms", "end_ms").filter("start_ms is not null and end_ms is not null")
    lines = lines.withColumn("hi", F.max("end_ms").over(Window.partitionBy("artifact_id")))
    return intervals.monotone(lines, ["artifact_id"], ["source_index", "line_key"], "start_ms", "end_ms", F.lit(0), F.col("hi")).select("line_key", "start_ms", "end_ms")


@query(
    f"""WITH {LINES}, t AS (SELECT *, coalesce(alignment_status = 'ctc', false) AS ok, max(end_ms) OVER (PARTITION BY artifact_id) AS hi FROM l WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL),
e AS (SELECT *, coalesce(ok <> lag(ok) OVER p, true)::INT AS edge, lag(end_ms) OVER p AS pe, lead(start_ms) OVER p AS ns FROM t WINDOW p AS (PARTITION BY artifact_id ORDER BY source_index, line_key)),
r AS (SELECT *, sum(edge) OVER (PARTITION BY artifact_id ORDER BY source_index, line_key ROWS UNBOUNDED PRECEDING) AS run FROM e),
q AS (SELECT *, row_number() OVER (PARTITION BY artifact_id, run ORDER BY source_index, line_key) - 1 AS i, count(*) OVER (PARTITION BY artifact_id, run) AS n,
  first_value(pe) OVER (PARTITION BY artifact_id, run ORDER BY source_index, line_key) AS l0, last_value(ns) OVER (PARTITION BY artifact_id, run ORDER BY source_index, line_key ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS r0 FROM r),
g AS (SELECT *, CASE WHEN l0 IS NULL THEN least(0, coalesce(r0, hi)) ELSE l0 END AS lo, greatest(CASE WHEN l0 IS NULL THEN least(0, coalesce(r0, hi)) ELSE l0 END, coalesce(r0, hi)) AS ro FROM q)
SELECT line_key, NOT ok AS filled, CASE WHEN ok THEN start_ms ELSE lo + round_even((ro - lo) * i / n, 0)::BIGINT END AS start_ms, CASE WHEN ok THEN end_ms ELSE lo + round_even((ro - lo) * (i + 1) / n, 0)::BIGINT END AS end_ms FROM g"""
)
def gap_fill(spark, sf):
    """Lines without accepted alignment share the time between their aligned neighbours."""
    lines = _lines(spark, sf, "artifact_id", "source_index", "start_ms", "end_ms", "alignment_status").filter("start_ms is not null and end_ms is not null")
    lines = lines.withColumn("hi", F.max("end_ms").over(Window.partitionBy("artifact_id"))).withColumn("ok", F.coalesce(F.col("alignment_status") == "ctc", F.lit(False)))
    return intervals.fill_gaps(lines, ["artifact_id"], ["source_index", "line_key"], F.col("ok"), "start_ms", "end_ms", F.lit(0).cast("bigint"), F.col("hi")).select("line_key", "filled", "start_ms", "end_ms")


@query(
    f"""WITH {LINES}, e AS (SELECT *, coalesce(status <> lag(status) OVER (PARTITION BY artifact_id ORDER BY source_index, line_key), true)::INT AS f FROM l),
g AS (SELECT *, sum(f) OVER (PARTITION BY artifact_id ORDER BY source_index, line_key ROWS UNBOUNDED PRECEDING) AS grp FROM e)
SELECT artifact_id, grp::BIGINT AS grp, min(status) AS status, count(*) AS n, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY artifact_id, grp"""
)
def consecutive_groups(spark, sf):
    lines = _lines(spark, sf, "artifact_id", "source_index", "status", "start_ms", "end_ms")
    w = Window.partitionBy("artifact_id").orderBy("source_index", "line_key")
    g = lines.withColumn("_f", F.coalesce(F.col("status") != F.lag("status").over(w), F.lit(True)).cast("int")).withColumn("grp", F.sum("_f").over(w))
    return g.groupBy("artifact_id", "grp").agg(F.min("status").alias("status"), F.count("*").alias("n"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


@query(
    f"""WITH {LINES}, u AS (SELECT artifact_id, source_index AS i, start_ms AS s, end_ms AS e FROM l WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL),
t AS (SELECT artifact_id, unnest(range(0, max(e), 10000)) AS t FROM u GROUP BY 1)
SELECT t.artifact_id, t.t, arg_max(i, {{'s': s, 'i': i}}) FILTER (s <= t.t AND t.t < e) AS current, arg_max(i, {{'s': s, 'i': i}}) FILTER (s < t.t - 100) AS previous, arg_min(i, {{'s': s, 'i': i}}) FILTER (s > t.t + 100) AS next
FROM t LEFT JOIN u ON t.artifact_id = u.artifact_id GROUP BY ALL"""
)
def playback_lookup(spark, sf):
    """The current, previous and next line of each artifact every ten seconds."""
    u = _lines(spark, sf, "artifact_id", "source_index", "start_ms", "end_ms").filter("start_ms is not null and end_ms is not null").select("artifact_id", F.col("source_index").alias("surface_index"), "start_ms", "end_ms")
    t = u.groupBy("artifact_id").agg(F.max("end_ms").alias("m")).filter("m > 0").select("artifact_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1, F.lit(10000).cast("bigint"))).alias("t"))
    return display.playback(u, t, ["artifact_id"])


# ------------------------------------------------------------------- series


@query(
    """WITH h AS (SELECT *, last_value(CASE WHEN value >= 60 THEN 1 WHEN value < 20 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS on0 FROM events),
o AS (SELECT *, coalesce(on0, 0) AS st FROM h), e AS (SELECT *, coalesce(st <> lag(st) OVER (PARTITION BY user_id ORDER BY event_id), true)::INT AS f FROM o),
g AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS k FROM e), r AS (SELECT user_id, k, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g WHERE st = 1 GROUP BY ALL)
SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY first) - 1)::INT AS run, first, last, n FROM r"""
)
def hysteresis_runs(spark, sf):
    on = signal.hysteresis(table(spark, sf, "events"), ["user_id"], "event_id", F.col("value"), F.lit(20), F.lit(60))
    return signal.runs(on, ["user_id"], "event_id").select("user_id", "run", "first", "last", "n")


@query("SELECT event_id, (sum((value >= 30)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) >= 3)::INT AS sustained FROM events")
def erosion(spark, sf):
    flags = table(spark, sf, "events").withColumn("flag", (F.col("value") >= 30).cast("int"))
    return signal.erode(flags, ["user_id"], "event_id", "flag", 3).select("event_id", "sustained")


@query("SELECT event_type, round(quantile_cont(value, 0.2), 6) AS p20, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def energy_percentiles(spark, sf):
    p = signal.percentiles(table(spark, sf, "events"), ["event_type"], "value", [0.2, 0.9, 0.95])
    return p.select("event_type", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p20", "p90", "p95"))])


@query(
    """WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL '2 hours', ts), time_bucket(INTERVAL '2 hours', ts) - INTERVAL '2 hours', time_bucket(INTERVAL '2 hours', ts) - INTERVAL '4 hours']) AS start FROM events)
SELECT event_type, start, count(*) AS n, round(sqrt(avg(value * value) + 1e-12), 6) AS rms FROM w GROUP BY ALL"""
)
def sliding_windows(spark, sf):
    e = table(spark, sf, "events").withColumn("_ts", F.col("ts").cast("timestamp"))
    g = e.groupBy("event_type", F.window("_ts", "6 hours", "2 hours").alias("w")).agg(F.count("*").alias("n"), F.round(F.sqrt(F.avg(F.col("value") * F.col("value")) + 1e-12), 6).alias("rms"))
    return g.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "rms")


_SERIES = """b AS (SELECT event_type AS k, date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS h, avg(value) AS v FROM events GROUP BY ALL),
top AS (SELECT k, max(h) AS top FROM b GROUP BY 1), g AS (SELECT k, unnest(range(top + 1)) AS h, top FROM top), s AS (SELECT g.k, g.h, coalesce(b.v, 0) AS v FROM g LEFT JOIN b USING (k, h)),
pair AS (SELECT k, h, v AS a, coalesce(lead(v) OVER (PARTITION BY k ORDER BY h), v) AS b FROM s),
st AS (SELECT event_type AS k, event_id, date_diff('minute', TIMESTAMP '2024-01-01', ts) / 60.0::DOUBLE AS t FROM events WHERE value > 150),
o AS (SELECT k, event_id, t, unnest(range(-6, 7)) AS "offset" FROM st),
x AS (SELECT o.*, p.w, p.n, greatest(0.0, least(top.top::DOUBLE, t + "offset" + p.d)) AS x FROM o JOIN top USING (k), (VALUES ('onset', 1.0::DOUBLE, 0.55::DOUBLE), ('after', 3.5::DOUBLE, 0.25::DOUBLE), ('local', 0.0::DOUBLE, 0.20::DOUBLE), ('before', -2.5::DOUBLE, 0.0::DOUBLE)) p(n, d, w)),
y AS (SELECT x.*, a + (b - a) * (x - floor(x)) AS v FROM x JOIN pair ON x.k = pair.k AND pair.h = floor(x)::BIGINT),
c AS (SELECT k, event_id, "offset", sum(v * w) / greatest(sum(CASE WHEN n = 'before' THEN v END), 1e-5) AS c FROM y GROUP BY ALL),
score AS (SELECT k, "offset", avg(ln(1 + greatest(0.0, least(20.0, c)))) AS score FROM c GROUP BY ALL)"""


def _grid_parts(spark, sf):
    """(starts with their event as line, series) of every event type, and the grid of shifts."""
    e = table(spark, sf, "events").withColumn("k", F.col("event_type"))
    origin = F.lit("2024-01-01").cast("timestamp_ntz")
    hour = F.timestamp_diff("HOUR", origin, F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz"))
    b = e.groupBy("k", hour.alias("frame_idx")).agg(F.avg("value").alias("value"))
    grid = b.groupBy("k").agg(F.max("frame_idx").alias("m")).select("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m"))).alias("frame_idx"))
    series = grid.join(b, ["k", "frame_idx"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    starts = e.filter("value > 150").select("k", F.col("event_id").alias("line"), (F.timestamp_diff("MINUTE", origin, F.col("ts")) / 60.0).alias("start_ms"))
    return starts, series, ["k"], -6, 6, 1, 0.0, 1.0, 0.01


def _grid(spark, sf):
    return offset.grid_scores(*_grid_parts(spark, sf))


@query(f'WITH {_SERIES} SELECT k, "offset"::INT AS shift, round(score, 6) AS score FROM score')
def offset_grid(spark, sf):
    """Mean contrast of an hourly series around high events for every shift of the grid."""
    return _grid(spark, sf).select("k", F.col("offset").alias("shift"), F.round("score", 6).alias("score"))


@query(
    f"""WITH {_SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, "offset") AS rank, greatest(lag(score) OVER q, lead(score) OVER q) AS neighbour FROM score WINDOW q AS (PARTITION BY k ORDER BY "offset"))
SELECT k, rank::INT AS rank, "offset"::INT AS shift, round(score, 6) AS score, round(score - neighbour, 6) AS margin FROM r WHERE rank <= 3"""
)
def topk_candidates(spark, sf):
    r = offset.ranked(_grid(spark, sf), ["k"]).filter("rank <= 3")
    return r.select("k", "rank", F.col("offset").alias("shift"), F.round("score", 6).alias("score"), F.round(F.col("score") - F.col("neighbour"), 6).alias("margin"))


@query(
    f"""WITH {_SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, "offset") AS rank, greatest(lag(score) OVER q, lead(score) OVER q) AS nb FROM score WINDOW q AS (PARTITION BY k ORDER BY "offset")),
z AS (SELECT k, max(score) FILTER ("offset" = 0) AS zero FROM score GROUP BY 1), d AS (SELECT r.*, z.zero, score - zero >= 0.08 AND score - coalesce(nb, 0) >= 0.01 AND "offset" NOT IN (-6, 6) AS ok FROM r JOIN z USING (k) WHERE rank = 1)
SELECT k, CASE WHEN ok THEN "offset" ELSE 0 END::INT AS offset_ms, CASE WHEN ok THEN 'candidate' ELSE 'uncertain' END AS status, round(score - zero, 6) AS gain FROM d"""
)
def offset_estimate(spark, sf):
    return offset.estimate(_grid(spark, sf), ["k"], -6, 6).select("k", "offset_ms", "status", F.round("gain", 6).alias("gain"))


@query(
    f"""WITH {LINES}, n AS (SELECT artifact_id, row_number() OVER (PARTITION BY artifact_id ORDER BY source_index, line_key) - 1 AS i, original_start_ms AS s, original_end_ms AS e FROM l WHERE original_start_ms IS NOT NULL AND original_end_ms IS NOT NULL),
g AS (SELECT *, s - lag(e) OVER (PARTITION BY artifact_id ORDER BY i) AS gap FROM n),
v AS (SELECT artifact_id, start_ms AS a, max(end_ms) AS b FROM l WHERE start_ms < end_ms GROUP BY ALL),
f AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY artifact_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS fresh FROM v),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY artifact_id ORDER BY a ROWS UNBOUNDED PRECEDING) AS k FROM f), r AS (SELECT artifact_id, k, min(a) AS a, max(b) AS b FROM p GROUP BY ALL),
q AS (SELECT artifact_id, row_number() OVER w - 1 AS run, a AS onset, coalesce(lag(b) OVER w, 0) AS quiet FROM r WINDOW w AS (PARTITION BY artifact_id ORDER BY a)),
h AS (SELECT q.artifact_id, run, onset, count(*) FILTER (onset - s BETWEEN -2000 AND 2000) AS n, min(s) FILTER (onset - s BETWEEN -2000 AND 2000 AND i = 0) AS intro, arg_min({{'i': i, 's': s, 'gap': gap}}, i) FILTER (onset - s BETWEEN -2000 AND 2000) AS ln
  FROM q LEFT JOIN g ON q.artifact_id = g.artifact_id WHERE onset - quiet >= 2000 GROUP BY ALL),
k AS (SELECT *, CASE WHEN run = 0 THEN intro IS NOT NULL ELSE n = 1 AND coalesce(ln.gap >= 2000, false) END AS ok FROM h)
SELECT artifact_id, run::INT AS run, onset, CASE WHEN ok THEN CASE WHEN run = 0 THEN 0 ELSE ln.i END END::INT AS line_index, CASE WHEN run = 0 THEN 'intro' ELSE 'interlude' END AS kind,
  CASE WHEN NOT ok THEN CASE WHEN run = 0 THEN 'intro_not_near_first_lyric' WHEN n <> 1 THEN 'ambiguous_lyric_boundary' ELSE 'no_explicit_lyric_gap' END END AS reason FROM k"""
)
def boundary_anchors(spark, sf):
    """Onsets of the final timeline after silence, tied to the original line that can begin there."""
    lines = _lines(spark, sf, "artifact_id", "source_index", "start_ms", "end_ms", "original_start_ms", "original_end_ms")
    w = Window.partitionBy("artifact_id").orderBy("source_index", "line_key")
    timed = lines.filter("original_start_ms is not null and original_end_ms is not null").select("artifact_id", "line_key", "source_index", F.col("original_start_ms").alias("start_ms"), F.col("original_end_ms").alias("end_ms"))
    timed = timed.withColumn("line_index", F.row_number().over(w) - 1)
    sung = runs.periods_and_gaps(lines, ["artifact_id"]).filter("kind = 'period'")
    o = Window.partitionBy("artifact_id").orderBy("start_ms")
    onsets = sung.select("artifact_id", (F.row_number().over(o) - 1).alias("run"), F.col("start_ms").alias("onset"), F.coalesce(F.lag("end_ms").over(o), F.lit(0)).alias("quiet_start"))
    return offset.anchors(onsets, timed, ["artifact_id"], -2000, 2000).select("artifact_id", "run", "onset", "line_index", "kind", "reason")


@query(f"""WITH {_SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, "offset") AS rank FROM score), n AS (SELECT k, count(*) AS line_starts FROM st GROUP BY 1)
SELECT k, max("offset") FILTER (rank = 1)::INT AS offset_ms, string_agg("offset"::INT::VARCHAR, ',' ORDER BY rank) FILTER (rank <= 10) AS candidates, any_value(line_starts) AS line_starts FROM r LEFT JOIN n USING (k) GROUP BY 1""")
def offset_report(spark, sf):
    """The ungated search report of every series."""
    starts = _grid_parts(spark, sf)[0]
    r = offset.report(_grid(spark, sf), starts, ["k"])
    return r.select("k", "offset_ms", F.array_join(F.transform("candidates", lambda c: c["offset_ms"].cast("string")), ",").alias("candidates"), "line_starts")


@query(
    f"""WITH {_SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, "offset") AS rank FROM score), best AS (SELECT k, "offset" AS o FROM r WHERE rank = 1 AND "offset" <> 0),
t AS (SELECT r.k, arg_min("offset", rank) AS v FROM r JOIN best USING (k) WHERE abs("offset" - o) >= 3 AND abs("offset") >= 3 GROUP BY 1)
SELECT k, o::INT AS shift FROM best UNION SELECT k, 0 FROM best UNION SELECT k, v::INT FROM t"""
)
def compared_shifts(spark, sf):
    """The shifts that the best shift of every series would be verified on."""
    grid = _grid(spark, sf)
    best = offset.ranked(grid, ["k"]).filter("rank = 1").select("k", F.col("offset").alias("offset_ms"))
    return offset.compared_offsets(grid, best, ["k"], 3).select("k", F.col("offset").alias("shift"))


@query(
    f"""WITH {_SERIES}, th AS (SELECT k, greatest(quantile_cont(v, 0.25) * 1.8, quantile_cont(v, 0.5) * 0.45, 1e-4) AS t FROM s GROUP BY 1),
w0 AS (SELECT event_type AS k, event_id, floor(date_diff('minute', TIMESTAMP '2024-01-01', ts) / 60.0)::BIGINT AS a FROM events WHERE value > 150),
j0 AS (SELECT w0.k, event_id, a, a + 24 AS b, avg((s.v >= t)::INT) AS ratio, min(s.h) FILTER (s.v >= t) AS f, max(s.h) FILTER (s.v >= t) AS g FROM w0 LEFT JOIN s ON s.k = w0.k AND s.h BETWEEN a AND a + 24 LEFT JOIN th ON th.k = w0.k GROUP BY ALL),
o0 AS (SELECT *, coalesce(ratio >= 0.12 AND least(b, g + 1) > greatest(a, f - 1), false) AS ok FROM j0)
SELECT k, event_id, CASE WHEN ok THEN greatest(a, f - 1) ELSE a END AS active_start_ms, CASE WHEN ok THEN least(b, g + 1) ELSE b END AS active_end_ms, round(coalesce(ratio, 0), 4) AS activity_ratio, CASE WHEN ok THEN 'energy_window' ELSE 'anchor_fallback' END AS method FROM o0"""
)
def activity_baseline(spark, sf):
    """Simple activity bounds in an hourly series, a day after every high event."""
    starts, series, *_ = _grid_parts(spark, sf)
    lines = starts.select("k", F.col("line").alias("event_id"), F.floor("start_ms").alias("start_ms"), (F.floor("start_ms") + 24).alias("end_ms"))
    got = signal.baseline_bounds(lines, series.select("k", "frame_idx", F.col("value").alias("rms")), ["k"], "event_id", 0.0, 1.0, 1)
    return got.select("k", "event_id", "active_start_ms", "active_end_ms", "activity_ratio", "method")


@query(
    f"""WITH {LINES}, t AS (SELECT line_key, start_ms, greatest(end_ms, start_ms + 1) AS stop, {mora_sql('reading')} AS v FROM l WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL),
u AS (SELECT line_key, start_ms, stop, len(v) AS n, unnest(v) AS text, unnest(range(len(v))) AS i FROM t)
SELECT line_key, i::INT AS pos, text, start_ms + round_even((stop - start_ms) * i / n, 0)::BIGINT AS start_ms, start_ms + round_even((stop - start_ms) * (i + 1) / n, 0)::BIGINT AS end_ms FROM u"""
)
def lasting_split(spark, sf):
    """The offline split of every line: lines without time count as a millisecond."""
    lines = _lines(spark, sf, "reading", "start_ms", "end_ms").filter("start_ms is not null and end_ms is not null")
    parts = intervals.split_lasting(T.split_mora(F.col("reading")), F.col("start_ms"), F.col("end_ms"))
    return lines.select("line_key", F.posexplode(parts).alias("pos", "m")).select("line_key", "pos", "m.text", "m.start_ms", "m.end_ms")


# ------------------------------------------------------------------- metrics, stages


_METRICS = f"""{LINES}, f AS (SELECT *, coalesce(reading <> '', false) AND coalesce(status <> 'non_sung', true) AS eligible, coalesce(alignment_status = 'ctc', false) AS accepted FROM l),
m AS (SELECT *, eligible AND NOT accepted AS fallback, {CATEGORY_SQL.replace('text', "coalesce(text, '')")} AS category,
  list_filter([CASE WHEN len(list_filter(warnings, lambda w: contains(w, 'empty target or audio shorter'))) > 0 THEN 'empty_target_or_audio_too_short' END, CASE WHEN coverage < 0.8 THEN 'coverage_below_threshold' END,
    CASE WHEN ctc_score < -2.25 THEN 'ctc_score_below_threshold' END, CASE WHEN ctc_score <= -1e8 THEN 'no_feasible_ctc_path_or_empty_input' END], lambda x: x IS NOT NULL) AS r0 FROM f),
mm AS (SELECT *, CASE WHEN NOT fallback THEN [] WHEN len(r0) > 0 THEN r0 ELSE ['other_or_rounded_threshold_boundary'] END AS reasons FROM m)"""


def _metrics(spark, sf):
    return metrics.line_metrics(_lines(spark, sf, "artifact_id", "song_dir", "text", "reading", "status", "alignment_status", "timing_source", "coverage", "ctc_score", "warnings"))


@query(f"WITH {_METRICS} SELECT line_key, category, eligible, accepted, fallback, array_to_string(reasons, ',') AS reasons FROM mm")
def line_metrics(spark, sf):
    return _metrics(spark, sf).select("line_key", "category", "eligible", "accepted", "fallback", F.array_join("fallback_reasons", ",").alias("reasons"))


@query(
    f"""WITH {_METRICS} SELECT category, status, count(*) AS lines, count(*) FILTER (eligible) AS eligible, count(*) FILTER (accepted) AS accepted, count(*) FILTER (fallback) AS fallback,
  round(count(*) FILTER (accepted) / nullif(count(*) FILTER (eligible), 0), 6) AS acceptance_rate FROM mm GROUP BY ROLLUP (category, status)"""
)
def rollup_metrics(spark, sf):
    return metrics.rollup(_metrics(spark, sf), ["category", "status"])


@query(
    f"""WITH {LINES}, j AS (SELECT artifact_id, CASE WHEN count(*) FILTER (status IS NULL) > 0 THEN 'failed' ELSE 'ok' END AS state, count(*) AS lines, count(*) FILTER (coalesce(reading <> '', false) AND coalesce(status <> 'non_sung', true)) AS eligible,
  count(*) FILTER (alignment_status = 'ctc') AS accepted, max(end_ms) / 1000.0 AS seconds FROM l GROUP BY 1)
SELECT state, count(*) AS jobs, sum(lines)::BIGINT AS lines, sum(eligible)::BIGINT AS eligible, sum(accepted)::BIGINT AS accepted, round(sum(accepted) / nullif(sum(eligible), 0), 6) AS acceptance_rate, round(coalesce(sum(seconds), 0), 3) AS seconds FROM j GROUP BY 1"""
)
def job_states(spark, sf):
    """Artifacts as jobs, by state: lines, acceptance and seconds."""
    lines = _lines(spark, sf, "artifact_id", "reading", "status", "alignment_status", "end_ms")
    eligible = F.coalesce(F.col("reading") != "", F.lit(False)) & F.coalesce(F.col("status") != "non_sung", F.lit(True))
    jobs = lines.groupBy("artifact_id").agg(
        F.when(F.count(F.when(F.col("status").isNull(), 1)) > 0, "failed").otherwise("ok").alias("state"), F.count("*").alias("lines"), F.count(F.when(eligible, 1)).alias("eligible"),
        F.count(F.when(F.col("alignment_status") == "ctc", 1)).alias("accepted"), (F.max("end_ms") / 1000).alias("seconds"),
    )
    return metrics.job_rollup(jobs, ["state"])


@query(
    f"""WITH {LINES}, w AS (SELECT unnest(warnings) AS note, artifact_id FROM l) SELECT note, count(*) AS n, count(DISTINCT artifact_id) AS jobs FROM w GROUP BY 1"""
)
def warning_counts(spark, sf):
    w = _lines(spark, sf, "artifact_id", "warnings").select("artifact_id", F.explode("warnings").alias("note"))
    return w.groupBy("note").agg(F.count("*").alias("n"), F.countDistinct("artifact_id").alias("jobs"))


@query(f"WITH {_METRICS} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM mm) GROUP BY 1")
def fallback_reasons(spark, sf):
    return metrics.reason_counts(_metrics(spark, sf))


@query(
    f"""WITH {_METRICS}, c AS (SELECT song_dir, count(*) AS lines, count(*) FILTER (accepted) AS accepted, count(*) FILTER (fallback) AS fallback FROM mm GROUP BY 1),
k AS (SELECT song_dir, reason, count(*) AS n FROM (SELECT song_dir, unnest(reasons) AS reason FROM mm) GROUP BY ALL), t AS (SELECT song_dir, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM k GROUP BY 1)
SELECT c.*, t.reasons FROM c LEFT JOIN t USING (song_dir)"""
)
def song_summary(spark, sf):
    s = metrics.song_summary(_metrics(spark, sf), "song_dir")
    return s.select("song_dir", "lines", "accepted", "fallback", F.array_join(F.transform(F.map_entries("reasons"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("reasons"))


@query(
    f"""WITH {LINES}, v AS (SELECT line_key, 'sudachi' AS b, reading AS r, 1 AS p FROM l WHERE reading IS NOT NULL UNION ALL SELECT line_key, 'openjtalk', {hira_sql('text')}, 2 FROM l WHERE text IS NOT NULL UNION ALL SELECT line_key, 'pykakasi', reading[:-2], 3 FROM l WHERE reading IS NOT NULL),
c AS (SELECT line_key, regexp_replace({hira_sql('r')}, '[^぀-ヿー]', '', 'g') AS canon, count(*) AS support, arg_min(r, p) AS value, min(p) AS p FROM v GROUP BY ALL),
n AS (SELECT *, count(*) OVER (PARTITION BY line_key) AS n, max(support) OVER (PARTITION BY line_key) AS most FROM c),
o AS (SELECT *, most = 1 AND n > 1 AS clash FROM n)
SELECT line_key, CASE WHEN n = 1 THEN 'unanimous' WHEN clash THEN 'conflict' ELSE 'majority' END AS status, value AS reading, support FROM o QUALIFY row_number() OVER (PARTITION BY line_key ORDER BY CASE WHEN clash THEN p ELSE 0 END, support DESC, canon) = 1"""
)
def reading_vote(spark, sf):
    lines = _lines(spark, sf, "text", "reading")
    long = lines.select("line_key", F.inline(F.array(
        F.struct(F.lit("sudachi").alias("backend"), F.col("reading").alias("value")),
        F.struct(F.lit("openjtalk").alias("backend"), T.kata_to_hira(F.col("text")).alias("value")),
        F.struct(F.lit("pykakasi").alias("backend"), F.expr("left(reading, greatest(0, length(reading) - 1))").alias("value")),
    ))).filter("value is not null")
    return reading.vote(long, ["line_key"], "backend", "value")


@query(
    f"""WITH {LINES}, t AS (SELECT * FROM lyrics_timeline QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY loaded_at DESC) = 1)
SELECT line_id, song_dir, source_index, length(regexp_replace(coalesce(text, ''), '^{WS}+|{WS}+$', '', 'g')) = 0 AS blank FROM t WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.song_dir = t.song_dir AND l.source_index = t.source_index)"""
)
def omitted_lines(spark, sf):
    """Timeline rows that no aligned line stands for."""
    t = table(spark, sf, "lyrics_timeline")
    once = t.groupBy("line_id").agg(F.max_by(F.struct("song_dir", "source_index", "text"), "loaded_at").alias("r")).select("line_id", "r.*")
    return once.join(table(spark, sf, "alignment_lines").select("song_dir", "source_index"), ["song_dir", "source_index"], "left_anti").select("line_id", "song_dir", "source_index", T.is_blank(F.col("text")).alias("blank"))


@query(
    """WITH s AS (SELECT * FROM artifact_log QUALIFY row_number() OVER (PARTITION BY song_dir ORDER BY written_at DESC, log_id DESC) = 1),
d AS (SELECT song_dir, coalesce(stages['reading'].status = 'done', false) AS r, coalesce(stages['demucs'].status = 'done', false) AS d, coalesce(stages['ctc'].status = 'done', false) AS c FROM s)
SELECT song_dir, CASE WHEN c THEN 'ready' WHEN d THEN 'demucs_ready' WHEN r THEN 'reading_ready' ELSE 'pending' END AS status, r AND c AS hit, array_to_string(list_filter([CASE WHEN NOT (c AND r) THEN 'ctc' END, CASE WHEN NOT r THEN 'reading' END], lambda x: x IS NOT NULL), ',') AS todo FROM d"""
)
def stage_plan(spark, sf):
    """What each directory's last state lacks if its inputs and the settings stay as they are."""
    state = stages.latest(table(spark, sf, "artifact_log"))
    current = state.select("song_dir", F.col("inputs.audio.sha256").alias("audio_sha"), F.col("inputs.lyrics_timeline.sha256").alias("timeline_sha"), F.transform_values("stages", lambda k, v: v["signature"]).alias("signatures"))
    state = state.withColumn("inputs", F.struct(F.struct(F.coalesce("inputs.audio.sha256", F.lit("")).alias("sha256")).alias("audio"), F.struct(F.coalesce("inputs.lyrics_timeline.sha256", F.lit("")).alias("sha256")).alias("lyrics_timeline")))
    current = current.withColumns({c: F.coalesce(c, F.lit("")) for c in ("audio_sha", "timeline_sha")})
    current = current.withColumn("signatures", F.transform_values("signatures", lambda k, v: F.coalesce(v, F.lit(""))))
    state = state.withColumn("stages", F.transform_values("stages", lambda k, v: F.struct(v["status"].alias("status"), F.coalesce(v["signature"], F.lit("")).alias("signature"))))
    plan = stages.plan(state, current, ["reading", "ctc"])
    return plan.join(state.select("song_dir", stages.overall(F.col("stages")).alias("status")), "song_dir").select("song_dir", "status", "hit", F.array_join("todo", ",").alias("todo"))


@query(
    f"""WITH {LINES}, s AS (SELECT song_id, count(*) AS lines, count(DISTINCT song_dir) AS dirs FROM l GROUP BY 1), m AS (SELECT id, max(duration_ms) AS duration_ms FROM song_metadata GROUP BY 1)
SELECT s.song_id, lines, dirs, duration_ms FROM s LEFT JOIN m ON s.song_id = m.id"""
)
def song_lookup(spark, sf):
    """Lines and directories per song with the longest known duration."""
    s = _lines(spark, sf, "song_id", "song_dir").groupBy("song_id").agg(F.count("*").alias("lines"), F.countDistinct("song_dir").alias("dirs"))
    m = table(spark, sf, "song_metadata").groupBy(F.col("id").alias("song_id")).agg(F.max("duration_ms").alias("duration_ms"))
    return s.join(m, "song_id", "left")


@query(f"WITH {LINES} SELECT artifact_id, count(*) AS lines, arg_min(text, struct_pack(i := source_index, k := line_key)) AS first_text, sum(coalesce(start_ms, 0))::BIGINT AS starts FROM l GROUP BY 1")
def artifact_json(spark, sf):
    """Artifacts written as one JSON document each and read again."""
    from strophe.sources import catalog

    lines = _lines(spark, sf, "artifact_id", "source_index", "text", "start_ms", "end_ms").withColumn("at", F.struct("source_index", "line_key"))
    docs = catalog.artifacts(lines.select("artifact_id", "at", "text", "start_ms", "end_ms"), "artifact_id", "at")
    back = docs.select("artifact_id", F.from_json("artifact", "schema_version int, lines array<struct<text:string,start_ms:bigint,end_ms:bigint>>").alias("a"))
    total = F.aggregate(F.transform("a.lines", lambda x: F.coalesce(x["start_ms"], F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return back.select("artifact_id", F.size("a.lines").cast("bigint").alias("lines"), F.col("a.lines")[0]["text"].alias("first_text"), total.alias("starts"))


# ------------------------------------------------------------------- folds (compared with brute force in tests)


@query(
    """WITH x AS (SELECT vec_id, label, list_transform(range(8), lambda t: list_transform(range(8), lambda i: embedding[t * 8 + i + 1]::DOUBLE)) AS f FROM embeddings),
p AS (SELECT vec_id, [label % 7 + 1, (label + 2) % 7 + 1, label % 7 + 1] AS g, list_transform(f, lambda r: list_transform(r, lambda v: v - ln(list_sum(list_transform(r, lambda u: exp(u)))))) AS lp FROM x),
s AS (SELECT vec_id, list_sum(list_transform(lp, lambda r: r[1])) AS blank, list_transform(range(9), lambda t: list_sum(list_transform(lp[1:t], lambda r: r[g[1] + 1] - r[1]))) AS a,
  list_transform(range(9), lambda t: list_sum(list_transform(lp[1:t], lambda r: r[g[2] + 1] - r[1]))) AS b FROM p),
q AS (SELECT i.v AS f1, j.v AS l1, k.v AS f2, l.v AS l2, m.v AS f3, n.v AS l3 FROM range(9) i(v) JOIN range(9) j(v) ON i.v < j.v JOIN range(9) k(v) ON j.v <= k.v JOIN range(9) l(v) ON k.v < l.v JOIN range(9) m(v) ON l.v <= m.v JOIN range(9) n(v) ON m.v < n.v),
z AS (SELECT vec_id, f1, l1, f2, l2, f3, l3, blank + coalesce(a[l1 + 1], 0) - coalesce(a[f1 + 1], 0) + coalesce(b[l2 + 1], 0) - coalesce(b[f2 + 1], 0) + coalesce(a[l3 + 1], 0) - coalesce(a[f3 + 1], 0) AS total FROM s, q)
SELECT vec_id, round(max(total) / 8, 6) AS score, arg_max(concat(f1, '-', l1, ',', f2, '-', l2, ',', f3, '-', l3), total) AS spans, NULL::VARCHAR AS error FROM z GROUP BY 1"""
)
def forced_alignment(spark, sf):
    """The best path of three labels through 8 frames of 8 labels, taken from every embedding."""
    e = table(spark, sf, "embeddings")
    logits = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, 8), lambda x: x.cast("double")))
    target = F.array(F.col("label") % 7 + 1, (F.col("label") + 2) % 7 + 1, F.col("label") % 7 + 1).cast("array<int>")
    got = align.align_segments(e.select("vec_id", logits.alias("logits"), target.alias("target")), ["vec_id"])
    return got.select("vec_id", F.round("score", 6).alias("score"), F.array_join(F.transform("spans", lambda s: F.concat(s["first"], F.lit("-"), s["last"])), ",").alias("spans"), "error")


def _units_of_lines(spark, sf):
    """Every line; null times are 0, and a line that ends before its start is empty."""
    lines = _lines(spark, sf, "text", "reading", "start_ms", "end_ms", "singing_start_ms", "singing_end_ms", "activity_confidence", "status", "alignment_status", "timing_source", "surface_spans", "warnings")
    start = F.coalesce("start_ms", F.lit(0).cast("bigint"))
    return lines.withColumns({"start_ms": start, "end_ms": F.greatest("end_ms", start)})


@query()
def span_repair(spark, sf):
    """Mora intervals of every line, squeezed so that some collapse, then repaired inside the line."""
    lines = _units_of_lines(spark, sf)
    mora = intervals.split(T.split_mora(F.col("reading")), F.col("start_ms"), F.col("end_ms"))
    spans = F.transform(mora, lambda m, i: F.struct(m["start_ms"].alias("start_ms"), F.when(i % 3 == 1, m["start_ms"]).otherwise(m["end_ms"]).alias("end_ms")))
    fixed = align.repair_spans(lines.select("line_key", "start_ms", "end_ms", spans.alias("spans")), "spans", "start_ms", "end_ms")
    return fixed.select("line_key", F.posexplode("spans").alias("pos", "s")).select("line_key", "pos", F.col("s.start_ms").alias("start_ms"), F.col("s.end_ms").alias("end_ms"))


@query(
    f"""WITH {LINES}, t AS (SELECT line_key, reading, coalesce(start_ms, 0) AS lo, greatest(end_ms, coalesce(start_ms, 0)) AS hi FROM l), m AS (SELECT line_key, lo, hi, {mora_sql('reading')} AS v FROM t WHERE hi > lo),
u AS (SELECT line_key, lo, hi, len(v) AS n, unnest(range(len(v))) AS i FROM m),
h AS (SELECT *, CASE WHEN i % 2 = 1 THEN 0 ELSE round_even((hi - lo) * (i + 1) / n, 0) - round_even((hi - lo) * i / n, 0) END::BIGINT AS held FROM u WHERE hi - lo >= n),
a AS (SELECT line_key, list_sort(list(held) FILTER (held > 0)) AS alive FROM h GROUP BY 1),
w AS (SELECT h.*, CASE WHEN held > 0 THEN held ELSE alive[len(alive) // 2 + 1] END AS w FROM h JOIN a USING (line_key) WHERE len(alive) > 0),
p AS (SELECT *, greatest(1, round_even((hi - lo) * w / sum(w) OVER (PARTITION BY line_key), 0))::BIGINT AS part FROM w),
c AS (SELECT *, CASE WHEN i = n - 1 THEN hi ELSE least(hi - (n - 1 - i), lo + sum(part) OVER (PARTITION BY line_key ORDER BY i)) END::BIGINT AS stop FROM p)
SELECT line_key, i::INT AS pos, coalesce(lag(stop) OVER (PARTITION BY line_key ORDER BY i), lo)::BIGINT AS start_ms, stop AS end_ms FROM c"""
)
def span_redistribution(spark, sf):
    lines = _units_of_lines(spark, sf)
    mora = intervals.split(T.split_mora(F.col("reading")), F.col("start_ms"), F.col("end_ms"))
    spans = F.transform(mora, lambda m, i: F.struct(m["start_ms"].alias("start_ms"), F.when(i % 2 == 1, m["start_ms"]).otherwise(m["end_ms"]).alias("end_ms")))
    got = align.redistribute_spans(lines.select("line_key", "start_ms", "end_ms", spans.alias("spans")), "spans", "start_ms", "end_ms")
    return got.select("line_key", F.posexplode("spans").alias("pos", "s")).select("line_key", "pos", F.col("s.start_ms").alias("start_ms"), F.col("s.end_ms").alias("end_ms"))


@query()
def display_timeline(spark, sf):
    """One unit per displayed character of every line, after the timing policy."""
    timed = display.with_display_units(display.timing_policy(_units_of_lines(spark, sf)))
    return timed.select("line_key", F.posexplode("display_units").alias("pos", "u")).select("line_key", "pos", "u.text", "u.start_ms", "u.end_ms", "u.romaji")


@query()
def display_checks(spark, sf):
    """Defects of the display timeline: there must be none of text and order."""
    timed = display.with_display_units(display.timing_policy(_units_of_lines(spark, sf)))
    checks = metrics.unit_checks(F.col("display_units"), F.coalesce("text", F.lit("")))
    return timed.select("line_key", *[c.alias(n) for n, c in checks.items()])


@query(
    f"""WITH {LINES}, t AS (SELECT line_key, text, reading, length(text) AS n, length(reading) AS m, regexp_extract(text, '[ぁ-ゖァ-ヺー]+') AS kana FROM l WHERE text <> '' AND reading <> ''),
a AS (SELECT *, instr(text, kana) - 1 AS lead, instr(reading, {hira_sql('kana')}) - 1 AS anchor, list_filter(range(n), lambda i: NOT regexp_full_match(substring(text, i::BIGINT + 1, 1), '{WS}|[\\x1c-\\x1f]')) AS seen FROM t),
c AS (SELECT *, CASE WHEN n = m THEN list_transform(range(n), lambda i: [i, i + 1, i, i + 1]) WHEN kana <> '' AND lead > 0 AND anchor > 0 THEN list_concat([[0, lead, 0, anchor]], list_transform(range(lead, n), lambda i: [i, i + 1, anchor - lead + i, least(m, anchor - lead + i + 1)]))
  ELSE list_transform(range(len(seen)), lambda k: [seen[k + 1], seen[k + 1] + 1, round_even(m * k / len(seen), 0)::BIGINT, round_even(m * (k + 1) / len(seen), 0)::BIGINT]) END AS cells,
  CASE WHEN n = m THEN 'same' WHEN kana <> '' AND lead > 0 AND anchor > 0 THEN 'anchor' ELSE 'share' END AS how FROM a),
e AS (SELECT line_key, text, reading, how, unnest(range(len(cells))) AS pos, unnest(cells) AS x FROM c),
s AS (SELECT line_key, pos, how, substring(text, x[1]::BIGINT + 1, (x[2] - x[1])::BIGINT) AS surface, CASE WHEN x[4] > x[3] THEN substring(reading, x[3]::BIGINT + 1, (x[4] - x[3])::BIGINT) ELSE '' END AS part FROM e),
h AS (SELECT *, regexp_replace({hira_sql('part')}, '(っ+)((?:\\P{{L}}|ー)+)(\\p{{L}})', '\\2\\1\\3', 'g') AS r FROM s),
p AS (SELECT *, list_transform(regexp_extract_all(r, '(?s)っ*(?:{'|'.join(T.HEPBURN_TWO)}|[^っ])|っ+$'), lambda y: [replace(y, 'っ', ''), y]) AS parts FROM h),
v AS (SELECT *, list_transform(parts, lambda y: [coalesce({SPELLED_SQL}[y[1]], y[1]), y[2]]) AS said FROM p)
SELECT line_key, pos::INT AS pos, surface, part AS reading, CASE WHEN regexp_full_match(surface, '(?:{WS})*(?:[぀-ヿ㐀-鿿](?:{WS})*)+') THEN
    array_to_string(list_filter(list_transform(said, lambda y: CASE WHEN starts_with(y[2], 'っ') AND regexp_matches(y[1], '^\\p{{L}}') THEN y[1][1] || y[1] ELSE y[1] END), lambda z: z <> ''), ' ') ELSE '' END AS romaji,
  CASE WHEN how = 'anchor' AND pos = 0 THEN 'low' WHEN how <> 'share' THEN 'medium' WHEN regexp_matches(surface, '^[぀-ヿ]') THEN 'medium' ELSE 'low' END AS mapping_confidence FROM v"""
)
def surface_mapping(spark, sf):
    """Surface spans of every line from its text and reading alone."""
    spans = reading.with_spans(_lines(spark, sf, "text", "reading"))
    return spans.select("line_key", F.posexplode("surface_spans").alias("pos", "s")).select("line_key", "pos", "s.surface", "s.reading", "s.romaji", "s.mapping_confidence")


@query()
def alignment_targets(spark, sf):
    """Latin labels and vocabulary coverage of every line."""
    lines = reading.with_spans(_lines(spark, sf, "text", "reading"))
    return reading.with_target(lines).select("line_key", "target", F.round("coverage", 6).alias("coverage"), F.size("records").alias("labels"))


@query(
    f"""WITH {_SERIES}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, "offset") AS rank, greatest(lag(score) OVER q, lead(score) OVER q) AS nb FROM score WINDOW q AS (PARTITION BY k ORDER BY "offset")),
z AS (SELECT k, max(score) FILTER ("offset" = 0) AS zero FROM score GROUP BY 1), d AS (SELECT r.*, score - zero >= 0.08 AND score - coalesce(nb, 0) >= 0.01 AND "offset" NOT IN (-6, 6) AS ok FROM r JOIN z USING (k) WHERE rank = 1),
e AS (SELECT k, CASE WHEN ok THEN "offset" ELSE 0 END AS o FROM d), line AS (SELECT k, event_id, "offset", ln(1 + greatest(0.0, least(20.0, c))) AS v FROM c),
v AS (SELECT e.k, e.o, count(*) AS n, count(*) FILTER (a.v - b.v >= 0.15) AS wins FROM e JOIN line a ON a.k = e.k AND a."offset" = e.o JOIN line b ON b.k = e.k AND b.event_id = a.event_id AND b."offset" = 0 WHERE e.o <> 0 GROUP BY ALL)
SELECT e.k, CASE WHEN n >= 2 AND wins >= ceil(n * 2 / 3) THEN e.o ELSE 0 END::INT AS offset_ms, CASE WHEN e.o = 0 THEN 'uncertain' WHEN n >= 2 AND wins >= ceil(n * 2 / 3) THEN 'candidate' ELSE 'uncertain' END AS status,
  CASE WHEN e.o = 0 THEN 'not_needed' WHEN n >= 2 AND wins >= ceil(n * 2 / 3) THEN 'accepted' WHEN n IS NULL THEN 'insufficient_evidence' ELSE 'rejected' END AS verification FROM e LEFT JOIN v USING (k)"""
)
def offset_verification(spark, sf):
    """Proposed shifts of the grid, checked against no shift on the scores of single starts."""
    proposal = offset.estimate(_grid(spark, sf), ["k"], -6, 6).select("k", "offset_ms", "status")
    scores = offset.start_scores(*_grid_parts(spark, sf))
    keep = scores.join(proposal.select("k", "offset_ms"), "k").filter("offset = 0 or offset = offset_ms").drop("offset_ms")
    return offset.verify(keep, proposal, ["k"])


@query(
    f"""WITH {CLEAN}, r AS (SELECT *, greatest(start_ms, end_ms) AS stop, {NON_SUNG_SQL} AS quiet, replace({hira_sql('text')}, ' ', '') AS reading FROM c)
SELECT song_dir, 'line_interpolation' AS timing_source, count(*) AS lines, sum(length(text))::BIGINT AS units, sum(CASE WHEN quiet OR stop <= start_ms THEN 0 ELSE len({mora_sql('reading')}) END)::BIGINT AS mora FROM r GROUP BY 1"""
)
def prepared_lines(spark, sf):
    """The flow of ``prepare`` from raw timelines to displayable lines, counted by song directory and timing source."""
    from strophe.config import Config

    done = prepare.prepare(table(spark, sf, "lyrics_timeline").withColumn("end_ms", F.greatest("end_ms", "start_ms")), Config(g2p_backend="kana"))
    return done.groupBy("song_dir", "timing_source").agg(F.count("*").alias("lines"), F.sum(F.size("display_units")).alias("units"), F.sum(F.size("mora")).alias("mora"))

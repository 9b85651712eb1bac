"""The flow over a whole catalog from timelines to displayable lines, without the audio and alignment stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.config import Config
from strophe.functions import text as T
from strophe.operators import display, intervals, reading, stages


def clean_timeline(lines: DataFrame) -> DataFrame:
    """Lyric lines delivered possibly several times: one row a line, blank ones gone, missing times 0."""
    order = F.struct("loaded_at", "line_id")
    once = lines.groupBy("line_id").agg(F.max_by(F.struct(*[c for c in lines.columns if c != "line_id"]), order).alias("r")).select("line_id", "r.*")
    return once.filter(~T.is_blank(F.col("text"))).withColumns({"text": T.strip(F.col("text")), "start_ms": F.coalesce("start_ms", F.lit(0)), "end_ms": F.coalesce("end_ms", F.lit(0))})


def reading_lines(lines: DataFrame, backend: str = "kana", lexicon: DataFrame | None = None) -> DataFrame:
    """Status, reading, timed mora and surface spans of clean lines."""
    quiet = T.non_sung(F.col("text"))
    said = reading.convert(lines, backend, lexicon)
    said = said.withColumn("reading", F.when(quiet, "").otherwise(F.col("reading")))
    status = F.when(quiet, "non_sung").when(F.length("reading") == 0, "unresolved").otherwise("interpolation")
    out = said.withColumns(
        {"status": status, "method": F.when(quiet, "text_rule").otherwise(backend), "warnings": F.when(quiet, F.array(F.lit("metadata-like line"))).otherwise(F.array().cast("array<string>")), "mora": intervals.split(T.split_mora(F.col("reading")), F.col("start_ms"), F.col("end_ms"))}
    )
    return reading.with_spans(out, tokens="tokens")


def prepare(lines: DataFrame, config: Config, state: DataFrame | None = None, current: DataFrame | None = None, lexicon: DataFrame | None = None, offsets: DataFrame | None = None) -> DataFrame:
    """Finished lines of all songs that need work. ``state`` and ``current`` (see ``stages.plan``) leave out songs
    whose results stand; ``offsets`` (song_dir, offset_ms) shifts lines once."""
    work = clean_timeline(lines)
    if state is not None and current is not None:
        hits = stages.plan(state, current, ["reading"]).filter("hit").select("song_dir")
        work = work.join(hits, "song_dir", "left_anti")
    out = reading_lines(work, config.g2p_backend, lexicon)
    if offsets is not None:
        out = out.join(offsets.select("song_dir", "offset_ms"), "song_dir", "left")
        out = intervals.shift(out, F.coalesce("offset_ms", F.lit(0))).drop("offset_ms")
        out = out.withColumn("mora", intervals.split(T.split_mora(F.col("reading")), F.col("start_ms"), F.col("end_ms")))
    for name, kind in (("alignment_status", "string"), ("timing_source", "string"), ("singing_start_ms", "bigint"), ("singing_end_ms", "bigint"), ("activity_confidence", "double")):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(None).cast(kind))
    timed = display.timing_policy(out, config.activity_projection_confidence_threshold)
    return display.with_display_units(timed, config.activity_projection_confidence_threshold)

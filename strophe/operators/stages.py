"""Which stages of which songs have to run: state tables keyed by input hashes and setting signatures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str = "song_dir") -> DataFrame:
    """The last state written for each song."""
    return log.groupBy(key).agg(F.max_by(F.struct("inputs", "stages"), F.struct("written_at", "log_id")).alias("s")).select(key, "s.inputs", "s.stages")


def done(stages: Column, stage: str, signature: Column | None = None) -> Column:
    """Whether a stage is done, with a given signature if there is one."""
    s = stages[stage]
    ok = s["status"] == "done"
    return F.coalesce(ok if signature is None else ok & (s["signature"] == signature), F.lit(False))


def plan(state: DataFrame, current: DataFrame, wanted: Sequence[str], key: str = "song_dir") -> DataFrame:
    """(key, hit, reuse_reading, keep_ctc, todo) for the songs of ``current`` (key, audio_sha, timeline_sha, signatures map).

    A song is a hit if its inputs are unchanged and all wanted stages are done under the current
    signatures. A reading is reused under the same conditions; an alignment only with its reading."""
    both = current.join(state, key, "left")
    same = F.coalesce((F.col("inputs.audio.sha256") == F.col("audio_sha")) & (F.col("inputs.lyrics_timeline.sha256") == F.col("timeline_sha")), F.lit(False))
    fine = {s: same & done(F.col("stages"), s, F.col("signatures")[s]) for s in {*wanted, "reading", "ctc"}}
    all_done = same
    for s in wanted:
        all_done = all_done & fine[s]
    todo = F.array_compact(F.array(*[F.when(~fine[s] | (~fine["reading"] if s == "ctc" else F.lit(False)), F.lit(s)) for s in sorted(wanted)]))
    return both.select(key, all_done.alias("hit"), fine["reading"].alias("reuse_reading"), (fine["reading"] & fine["ctc"]).alias("keep_ctc"), F.when(all_done, F.array().cast("array<string>")).otherwise(todo).alias("todo"))


def overall(stages: Column) -> Column:
    return F.when(done(stages, "ctc"), "ready").when(done(stages, "demucs"), "demucs_ready").when(done(stages, "reading"), "reading_ready").otherwise("pending")


def unfinished_jobs(jobs: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Jobs without a result, so that a run goes on where the last one ended."""
    return jobs.join(results.select(key).distinct(), key, "left_anti")


def drifted(manifest: DataFrame, current: DataFrame, keys: Sequence[str], hash_col: str) -> DataFrame:
    """Inputs whose hash isn't the one that the manifest froze, or that are gone."""
    now = current.select(*keys, F.col(hash_col).alias("_now"))
    return manifest.join(now, list(keys), "left").filter(~F.col(hash_col).eqNullSafe(F.col("_now"))).drop("_now")

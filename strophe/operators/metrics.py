"""Quality of aligned lines and its roll-up over songs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.functions import text as T

#: Score from which down there was no path (a fixed value).
NO_PATH = -1e8


def line_metrics(lines: DataFrame, coverage_at_least: float = 0.8, score_at_least: float = -2.25, stage_done: Column | None = None) -> DataFrame:
    """Lines with category, eligible, accepted, fallback and all ``fallback_reasons`` that apply."""
    done = F.lit(True) if stage_done is None else F.coalesce(stage_done, F.lit(False))
    eligible = F.coalesce(F.length("reading") > 0, F.lit(False)) & F.coalesce(F.col("status") != "non_sung", F.lit(True))
    ok = F.coalesce(F.col("alignment_status") == "ctc", F.lit(False))
    warnings = F.coalesce("warnings", F.array().cast("array<string>"))
    found = F.array_compact(
        F.array(
            F.when(F.exists(warnings, lambda w: w.contains("empty target or audio shorter")), "empty_target_or_audio_too_short"),
            F.when(F.col("coverage") < coverage_at_least, "coverage_below_threshold"),
            F.when(F.col("ctc_score") < score_at_least, "ctc_score_below_threshold"),
            F.when(F.col("ctc_score") <= NO_PATH, "no_feasible_ctc_path_or_empty_input"),
        )
    )
    reasons = F.when(~done, F.array(F.lit("ctc_stage_error_or_not_done"))).when(F.size(found) > 0, found).otherwise(F.array(F.lit("other_or_rounded_threshold_boundary")))
    out = lines.withColumns({"category": T.script_category(F.coalesce("text", F.lit(""))), "has_digits": F.coalesce(F.col("text").rlike(r"\p{Nd}"), F.lit(False)), "eligible": eligible, "accepted": ok})
    out = out.withColumn("fallback", F.col("eligible") & ~F.col("accepted"))
    return out.withColumn("fallback_reasons", F.when(F.col("fallback"), reasons).otherwise(F.array().cast("array<string>")))


def rollup(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """Lines, eligible, accepted, fallback and the acceptance rate for every grouping of ``by`` and in total, in one pass."""
    n = lambda c: F.count(F.when(F.col(c), 1))
    got = metrics.rollup(*by).agg(F.count("*").alias("lines"), n("eligible").alias("eligible"), n("accepted").alias("accepted"), n("fallback").alias("fallback"))
    return got.withColumn("acceptance_rate", F.round(F.col("accepted") / F.nullif("eligible", F.lit(0)), 6))


def reason_counts(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return metrics.select(*keys, F.explode("fallback_reasons").alias("reason")).groupBy(*keys, "reason").agg(F.count("*").alias("n"))


def song_summary(metrics: DataFrame, key: str) -> DataFrame:
    """One row per song with its counts and a map of its reasons; counted by (song, reason) first, so a song's rows are never gathered."""
    n = lambda c: F.count(F.when(F.col(c), 1))
    counts = metrics.groupBy(key).agg(F.count("*").alias("lines"), n("eligible").alias("eligible"), n("accepted").alias("accepted"), n("fallback").alias("fallback"))
    reasons = reason_counts(metrics, [key]).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"))
    return counts.join(reasons, key, "left")


def unit_checks(units: Column, text: Column) -> dict[str, Column]:
    """Defects of a line's display units: visible ones without duration, text that isn't the line's, onsets that fall."""
    pairs = F.arrays_zip(F.slice(units, 1, F.greatest(F.size(units) - 1, F.lit(0))).alias("a"), F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))).alias("b"))
    return {
        "zero_duration_visible_units": F.size(F.filter(units, lambda u: (u["end_ms"] <= u["start_ms"]) & ~T.is_blank(u["text"]))),
        "display_text_matches": F.array_join(F.transform(units, lambda u: u["text"]), "") == text,
        "display_onset_monotonic": F.forall(pairs, lambda p: p["b"]["start_ms"] >= p["a"]["start_ms"]),
    }


def job_rollup(jobs: DataFrame, by: list[str]) -> DataFrame:
    """(by, jobs, lines, eligible, accepted, acceptance_rate, seconds) of rows per job; the rate is null where nothing was eligible."""
    n = jobs.groupBy(*by).agg(F.count("*").alias("jobs"), *(F.sum(c).alias(c) for c in ("lines", "eligible", "accepted")), F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)), 3).alias("seconds"))
    return n.select(*by, "jobs", "lines", "eligible", "accepted", F.round(F.col("accepted") / F.nullif("eligible", F.lit(0)), 6).alias("acceptance_rate"), "seconds")

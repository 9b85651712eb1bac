"""A global time shift of a song's lines, from how its energy series rises at the line starts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.operators import signal
from strophe.operators.intervals import clamp

# Least gain over no shift and least lead over the neighbours; probes around a start (ms) and their weights.
MIN_GAIN, MIN_MARGIN = 0.08, 0.01
PROBES = {"onset": (100, 0.55), "after": (350, 0.25), "local": (0, 0.20)}
BEFORE = -250


def grid_scores(starts: DataFrame, series: DataFrame, keys: Sequence[str], low: int, high: int, step: int, first: float, hop: float, probe_scale: float = 1.0) -> DataFrame:
    """(keys, offset, score) of every candidate shift: mean of log1p(contrast) over the starts (keys, start_ms)."""
    per = start_scores(starts.select(*keys, "start_ms", F.monotonically_increasing_id().alias("line")), series, keys, low, high, step, first, hop, probe_scale)
    return per.groupBy(*keys, "offset").agg(F.avg("score").alias("score"))


def start_scores(starts: DataFrame, series: DataFrame, keys: Sequence[str], low: int, high: int, step: int, first: float, hop: float, probe_scale: float = 1.0) -> DataFrame:
    """(keys, line, offset, score) of every candidate shift at every single start (keys, line, start_ms): log1p(contrast).

    The grid has a bounded size, so each start is multiplied by it and all probes become equi joins
    on frame numbers (series: keys, frame_idx, value on a regular grid from ``first`` by ``hop``)."""
    top = series.groupBy(*keys).agg(F.max("frame_idx").alias("_top"))
    offsets = F.sequence(F.lit(low), F.lit(high), F.lit(step))
    at = starts.select(*keys, "line", "start_ms").withColumn("offset", F.explode(offsets))
    probes = F.array(*[F.struct(F.lit(n).alias("probe"), F.lit(float(d * probe_scale)).alias("d")) for n, d in [*((k, v[0]) for k, v in PROBES.items()), ("before", BEFORE)]])
    spread = at.withColumn("_p", F.explode(probes)).join(top, list(keys))
    x = clamp((F.col("start_ms") + F.col("offset") + F.col("_p.d") - first) / hop, F.lit(0.0), F.col("_top").cast("double"))
    spread = spread.select(*keys, "line", "offset", F.col("_p.probe").alias("probe"), x.alias("_x"), "_top").withColumn("_k", F.floor("_x"))
    # a frame and its successor in one row, so that one equi join interpolates
    w = Window.partitionBy(*keys).orderBy("frame_idx")
    pairs = series.select(*keys, F.col("frame_idx").alias("_k"), F.col("value").alias("_a"), F.coalesce(F.lead("value").over(w), F.col("value")).alias("_b"))
    got = spread.join(pairs, [*keys, "_k"]).withColumn("v", F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_x") - F.col("_k")))
    value = lambda n: F.max(F.when(F.col("probe") == n, F.col("v")))
    per = got.groupBy(*keys, "line", "offset").agg((sum((value(n) * w for n, (_, w) in PROBES.items()), F.lit(0.0)) / F.greatest(value("before"), F.lit(1e-5))).alias("c"))
    return per.select(*keys, "line", "offset", F.log1p(clamp(F.col("c"), F.lit(0.0), F.lit(20.0))).alias("score"))


def ranked(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rank`` by falling score (the lower offset first among equals) and ``neighbour``, the better of the offsets beside."""
    by_score = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "offset")
    by_offset = Window.partitionBy(*keys).orderBy("offset")
    return scores.withColumn("rank", F.row_number().over(by_score)).withColumn("neighbour", F.greatest(F.lag("score").over(by_offset), F.lead("score").over(by_offset)))


def anchors(runs: DataFrame, lines: DataFrame, keys: Sequence[str], low: int, high: int, silence: int = 2000, tolerance: int = 800) -> DataFrame:
    """Vocal runs (keys, run, onset, quiet_start) after silence, tied to the one line that can begin there.

    (keys, run, onset, line_index, kind, low, high, reason): the intro only to line 0, an interlude only to a
    line that is alone in reach and follows a gap of its own; ``reason`` says why a run isn't an anchor.
    ``lines``: keys, line_index, start_ms, end_ms."""
    w = Window.partitionBy(*keys).orderBy("line_index")
    gap = lines.withColumn("gap", F.col("start_ms") - F.lag("end_ms").over(w)).select(*keys, "line_index", "start_ms", "gap")
    quiet = runs.filter(F.col("onset") - F.col("quiet_start") >= silence)
    near = quiet.alias("q").join(gap.alias("g"), list(keys), "left")
    reach = (F.col("onset") - F.col("start_ms")).between(low, high)
    hits = near.groupBy(*keys, "run", "onset").agg(
        F.count(F.when(reach, 1)).alias("n"),
        F.min(F.when(reach & (F.col("line_index") == 0), F.col("start_ms"))).alias("intro"),
        F.min(F.when(reach, F.struct("line_index", "start_ms", "gap"))).alias("line"),
    )
    first = F.col("run") == 0
    alone = F.col("n") == 1
    own_gap = F.coalesce(F.col("line.gap") >= silence, F.lit(False))
    ok = F.when(first, F.col("intro").isNotNull()).otherwise(alone & own_gap)
    start = F.when(first, F.col("intro")).otherwise(F.col("line.start_ms"))
    reason = F.when(first, "intro_not_near_first_lyric").when(~alone, "ambiguous_lyric_boundary").otherwise("no_explicit_lyric_gap")
    return hits.select(
        *keys, "run", "onset",
        F.when(ok, F.when(first, F.lit(0)).otherwise(F.col("line.line_index"))).cast("int").alias("line_index"),
        F.when(first, "intro").otherwise("interlude").alias("kind"),
        F.when(ok, F.col("onset") - start - tolerance).alias("low"),
        F.when(ok, F.col("onset") - start + tolerance).alias("high"),
        F.when(~ok, reason).alias("reason"),
    )


def vocal_runs(series: DataFrame, keys: Sequence[str], hop: float, sustain: int = 200) -> DataFrame:
    """(keys, run, onset, quiet_start) of the sustained runs of a frame series (keys, frame_idx, t_ms, rms)."""
    p = signal.percentiles(series, keys, "rms", [0.2, 0.95])
    low, high = signal.thresholds(F.col("p")[0], F.col("p")[1])
    marked = series.join(p.select(*keys, low.alias("_low"), high.alias("_high")), list(keys))
    on = signal.hysteresis(marked, keys, "t_ms", F.col("rms"), F.col("_low"), F.col("_high"))
    kept = signal.runs(on, keys, "t_ms").filter(F.col("n") * hop >= sustain)
    w = Window.partitionBy(*keys).orderBy("first")
    return kept.select(
        *keys,
        (F.row_number().over(w) - 1).cast("int").alias("run"),
        F.greatest(F.lit(0), F.bround(F.col("first") - 15, 0).cast("bigint")).alias("onset"),
        F.coalesce(F.bround(F.lag("last").over(w) + 15, 0).cast("bigint"), F.lit(0)).alias("quiet_start"),
    )


def estimate(scores: DataFrame, keys: Sequence[str], low: int, high: int, tolerance: int = 800, found: DataFrame | None = None, unchecked: str = "disabled", songs: DataFrame | None = None) -> DataFrame:
    """(keys, offset_ms, status, selected, score, zero_score, gain, margin, raw_best, boundary_status): the best shift that all anchors
    allow, taken only if it beats no shift and its neighbours clearly, isn't at an end of the grid
    and doesn't contradict the best shift without anchors. ``scores`` must hold offset 0.

    ``boundary_status`` says what became of the anchors: ``unchecked`` (disabled, no_vocal_stem) without ``found``,
    else checked, no_reliable_anchors, energy_conflict or conflicting_or_out_of_range_anchors. ``songs`` (keys, lines,
    frames) adds the songs that have no scores: no_lines, or no_activity."""
    r = ranked(scores, keys)
    if found is not None:
        bad = r.join(found.filter("reason is null").select(*keys, "low", "high"), list(keys)).filter((F.col("offset") < F.col("low")) | (F.col("offset") > F.col("high")))
        r = r.join(bad.select(*keys, "offset").distinct().withColumn("_bad", F.lit(True)), [*keys, "offset"], "left").withColumn("ok", F.col("_bad").isNull()).drop("_bad")
        tied = found.filter("reason is null").select(*keys).distinct().withColumn("tied", F.lit(True))
        r = r.join(tied, list(keys), "left")
    else:
        r = r.withColumn("ok", F.lit(True)).withColumn("tied", F.lit(None).cast("boolean"))
    row = F.struct("rank", "offset", "score", "neighbour")
    best = r.groupBy(*keys).agg(
        F.min_by(row, "rank").alias("raw"), F.min_by(row, F.when(F.col("ok"), F.col("rank"))).alias("own"), F.max(F.when(F.col("offset") == 0, F.col("score"))).alias("zero_score"), F.max("tied").alias("tied")
    )
    b = F.coalesce("own", "raw")
    gain, margin = b["score"] - F.col("zero_score"), b["score"] - F.coalesce(b["neighbour"], F.lit(0.0))
    clash = F.coalesce(F.col("tied") & F.col("own").isNotNull() & (F.abs(b["offset"] - F.col("raw.offset")) > tolerance), F.lit(False))
    ok = F.col("own").isNotNull() & (gain >= MIN_GAIN) & (margin >= MIN_MARGIN) & ~b["offset"].isin(low, high) & ~clash
    tied = F.coalesce("tied", F.lit(False))
    boundary = F.when(tied & F.col("own").isNull(), "conflicting_or_out_of_range_anchors").when(clash, "energy_conflict").when(tied, "checked").otherwise("no_reliable_anchors") if found is not None else F.lit(unchecked)
    out = best.select(
        *keys,
        F.when(ok, b["offset"]).otherwise(0).alias("offset_ms"),
        F.when(ok, "candidate").otherwise("uncertain").alias("status"),
        F.col("own.offset").alias("selected"),
        b["score"].alias("score"), "zero_score", gain.alias("gain"), margin.alias("margin"), F.col("raw.offset").alias("raw_best"), boundary.alias("boundary_status"),
    )
    if songs is None:
        return out
    lacking = F.when(F.coalesce("lines", F.lit(0)) == 0, "no_lines").when(F.coalesce("frames", F.lit(0)) == 0, "no_activity")
    every = songs.select(*keys, lacking.alias("_lacking")).join(out, list(keys), "left")
    kept = [c for c in out.columns if c not in (*keys, "offset_ms", "status")]
    there = F.col("_lacking").isNull()
    return every.select(
        *keys, F.when(there, F.col("offset_ms")).otherwise(0).alias("offset_ms"), F.coalesce("_lacking", "status").alias("status"), *(F.when(there, F.col(c)).alias(c) for c in kept)
    )


def compared_offsets(scores: DataFrame, proposal: DataFrame, keys: Sequence[str], apart: int = 240) -> DataFrame:
    """(keys, offset): the shifts that a proposal (keys, offset_ms) is verified on: itself, none, and the best ranked
    candidate at least ``apart`` from both. A proposal of no shift needs no verification and has no rows."""
    own = proposal.filter("offset_ms != 0").select(*keys, "offset_ms")
    third = ranked(scores, keys).join(own, list(keys)).filter((F.abs(F.col("offset") - F.col("offset_ms")) >= apart) & (F.abs("offset") >= apart)).groupBy(*keys).agg(F.min_by("offset", "rank").alias("offset"))
    return own.select(*keys, F.explode(F.array(F.col("offset_ms"), F.lit(0).cast(own.schema["offset_ms"].dataType))).alias("offset")).unionByName(third).distinct()


def report(scores: DataFrame, starts: DataFrame, keys: Sequence[str], shown: int = 10) -> DataFrame:
    """The ungated report of a search: (keys, offset_ms, candidates, line_starts), the candidates by falling score to
    eight digits, and how many starts the shift moves. ``scores`` hold a grid, so a song's candidates are bounded."""
    best = ranked(scores, keys).filter(F.col("rank") <= shown).groupBy(*keys).agg(
        F.min_by("offset", "rank").alias("offset_ms"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "offset", "score"))), lambda c: F.struct(c["offset"].alias("offset_ms"), F.round(c["score"], 8).alias("score"))).alias("candidates")
    )
    n = starts.groupBy(*keys).agg(F.count("*").alias("line_starts"))
    return best.join(n, list(keys), "left")


def representatives(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first, middle and last short line with a reading of each song."""
    d = F.col("end_ms") - F.col("start_ms")
    good = lines.filter((F.length("reading") > 0) & d.between(500, 6000) & (F.length("reading") <= 64))
    w = Window.partitionBy(*keys).orderBy("source_index")
    n = F.count("*").over(Window.partitionBy(*keys))
    k = F.row_number().over(w) - 1
    return good.withColumn("_k", k).withColumn("_n", n).filter((F.col("_k") == 0) | (F.col("_k") == F.floor(F.col("_n") / 2)) | (F.col("_k") == F.col("_n") - 1)).drop("_k", "_n")


def verify(scores: DataFrame, proposal: DataFrame, keys: Sequence[str], margin: float = 0.15) -> DataFrame:
    """(keys, offset_ms, status, verification): a proposed shift stands only if it beats every competitor on two
    thirds of the lines that both have, at least two. ``scores``: keys, offset, line, score (null: no path)."""
    chosen = proposal.select(*keys, F.col("offset_ms").alias("_sel"))
    mine = scores.join(chosen, list(keys)).filter("offset = _sel").select(*keys, "line", F.col("score").alias("a"))
    other = scores.join(chosen, list(keys)).filter("offset != _sel").select(*keys, "line", "offset", F.col("score").alias("b"))
    delta = other.join(mine, [*keys, "line"], "left").withColumn("d", F.col("a") - F.col("b"))
    per = delta.groupBy(*keys, "offset").agg(F.count("d").alias("n"), F.count(F.when(F.col("d") >= margin, 1)).alias("wins"))
    won = per.groupBy(*keys).agg(F.min((F.col("n") >= 2) & (F.col("wins") >= F.ceil(F.col("n") * 2 / 3))).alias("won"))
    out = proposal.join(won, list(keys), "left")
    zero = F.col("offset_ms") == 0
    stands = F.coalesce("won", F.lit(False))
    return out.select(
        *keys,
        F.when(zero | stands, F.col("offset_ms")).otherwise(0).alias("offset_ms"),
        F.when(zero | stands, F.col("status")).otherwise("uncertain").alias("status"),
        F.when(zero, "not_needed").when(stands, "accepted").when(F.col("won").isNull(), "insufficient_evidence").otherwise("rejected").alias("verification"),
    )

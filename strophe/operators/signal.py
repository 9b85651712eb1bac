"""Framed energy series: windows over regular samples, activity runs and lookups."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophe.operators.intervals import clamp

# Floor of an energy, minimum threshold, and the onset and end thresholds relative to percentiles.
TINY, LEAST = 1e-12, 1e-4
LOW_FLOOR, LOW_PEAK, HIGH_LOW, HIGH_PEAK = 3.0, 0.04, 2.0, 0.08


def frames(chunks: DataFrame, keys: Sequence[str], rate: int, hop_ms: int, window_ms: int) -> DataFrame:
    """RMS frames (keys, frame_idx, t_ms, rms) of PCM chunks (keys, first_sample bigint, pcm array<float>).

    Chunks of a track may lie in any partitions; each must reach ``window - hop`` samples into its
    successor, so that the frames that begin in it are whole. Chunks begin at multiples of the hop."""
    hop = max(1, rate * hop_ms // 1000)
    size = max(hop, rate * window_ms // 1000)
    kinds = ", ".join(f"`{k}` {chunks.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for row in pdf.itertuples(index=False):
                x = np.asarray(row.pcm, "float64")
                n = 1 + (len(x) - size) // hop if len(x) >= size else 0
                if not n:
                    continue
                energy = np.concatenate([[0.0], np.cumsum(x * x)])
                at = np.arange(n) * hop
                idx = row.first_sample // hop + np.arange(n)
                part = pd.DataFrame({"frame_idx": idx, "t_ms": (idx * hop + size / 2) * 1000.0 / rate, "rms": np.sqrt(np.maximum(energy[at + size] - energy[at], 0) / size + TINY)})
                for k in keys:
                    part[k] = getattr(row, k)
                parts.append(part)
            if parts:
                yield pd.concat(parts)[[*keys, "frame_idx", "t_ms", "rms"]]

    return chunks.select(*keys, "first_sample", "pcm").mapInPandas(run, f"{kinds}, frame_idx bigint, t_ms double, rms double").dropDuplicates([*keys, "frame_idx"])


def chunk_pcm(pcm: np.ndarray, rate: int, hop_ms: int, window_ms: int, frames_per_chunk: int = 30_000) -> list[tuple[int, list[float]]]:
    """Chunks of a track as ``frames`` takes them."""
    hop = max(1, rate * hop_ms // 1000)
    size = max(hop, rate * window_ms // 1000)
    step = frames_per_chunk * hop
    return [(a, pcm[a : a + step + size - hop].tolist()) for a in range(0, max(1, len(pcm)), step)]


def percentiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """Exact, linearly interpolated percentiles in an array."""
    return df.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in at])).alias("p"))


def thresholds(p20: Column, p95: Column) -> tuple[Column, Column]:
    """(low, high) of the onset detector; null where a track is silent."""
    low = F.greatest(F.lit(LEAST), F.least(LOW_FLOOR * p20, LOW_PEAK * p95))
    return F.when(p95 >= LEAST, low), F.when(p95 >= LEAST, F.greatest(HIGH_LOW * low, HIGH_PEAK * p95))


def hysteresis(df: DataFrame, keys: Sequence[str], order: str, value: Column, low: Column, high: Column) -> DataFrame:
    """``on``: switched on at ``high``, off under ``low``, otherwise as before (the last decision, which is one window function)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    decided = F.when(value >= high, 1).when(value < low, 0)
    return df.withColumn("on", F.coalesce(F.last(decided, ignorenulls=True).over(w), F.lit(0)))


def runs(df: DataFrame, keys: Sequence[str], order: str, flag: str = "on") -> DataFrame:
    """(keys, run, first, last, n): maximal runs of rows whose flag is 1, numbered in order."""
    w = Window.partitionBy(*keys).orderBy(order)
    edged = df.withColumn("_e", F.coalesce(F.col(flag) != F.lag(flag).over(w), F.lit(True)).cast("int")).withColumn("_k", F.sum("_e").over(w))
    got = edged.filter(F.col(flag) == 1).groupBy(*keys, "_k").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    return got.withColumn("run", F.row_number().over(Window.partitionBy(*keys).orderBy("first")) - 1).drop("_k")


def erode(df: DataFrame, keys: Sequence[str], order: str, flag: str, run: int) -> DataFrame:
    """``sustained``: the flag holds on all of a centred window of ``run`` rows."""
    before, after = run - 1 - (run - 1) // 2, (run - 1) // 2
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, after)
    return df.withColumn("sustained", (F.sum(flag).over(w) >= run).cast("int"))


def interpolate(points: DataFrame, series: DataFrame, keys: Sequence[str], at: str, first: float, hop: float) -> DataFrame:
    """``value`` of a series (keys, frame_idx, value) on a regular grid at arbitrary times, linear between frames, held at the ends.

    A grid needs no range join: the two neighbours are equi joins on the frame number."""
    last = series.groupBy(*keys).agg(F.max("frame_idx").alias("_top"))
    p = points.join(last, list(keys))
    x = clamp((F.col(at) - first) / hop, F.lit(0.0), F.col("_top").cast("double"))
    p = p.withColumn("_x", x).withColumn("_k", F.floor("_x")).withColumn("_j", F.least(F.col("_k") + 1, F.col("_top")))
    a = series.select(*keys, F.col("frame_idx").alias("_k"), F.col("value").alias("_va"))
    b = series.select(*keys, F.col("frame_idx").alias("_j"), F.col("value").alias("_vb"))
    got = p.join(a, [*keys, "_k"]).join(b, [*keys, "_j"])
    return got.withColumn("value", F.col("_va") + (F.col("_vb") - F.col("_va")) * (F.col("_x") - F.col("_k"))).drop("_x", "_k", "_j", "_top", "_va", "_vb")


def voice_bounds(lines: DataFrame, series: DataFrame, keys: Sequence[str], line: str, hop_ms: int = 50) -> DataFrame:
    """Lines with ``singing_start_ms``, ``singing_end_ms``, ``activity_confidence`` from frames (keys, frame_idx, rms).

    Lines under 300 ms or two frames and lines without sustained activity stay without bounds."""
    stats = percentiles(series, keys, "rms", [0.2, 0.9]).select(*keys, F.col("p")[0].alias("_floor"), F.col("p")[1].alias("_peak"))
    s = F.greatest(F.lit(0), F.col("start_ms"))
    e = F.greatest(s, F.col("end_ms"))
    spans = lines.filter((e - s) >= 300).select(*keys, line, s.alias("_s"), e.alias("_e"), F.floor(s / hop_ms).alias("_l"), F.ceil(e / hop_ms).alias("_r"))
    # the frames of a line by number: the line is spread over its frames, so the join is an equi join
    spread = spans.withColumn("frame_idx", F.explode(F.sequence("_l", F.col("_r") - 1)))
    inside = spread.join(series.select(*keys, "frame_idx", "rms"), [*keys, "frame_idx"]).join(stats, list(keys))
    each = Window.partitionBy(*keys, line)
    inside = inside.withColumn("_p", F.expr("percentile(rms, 0.9)").over(each)).withColumn("_n", F.count("*").over(each))
    thr = F.greatest(F.col("_floor") * 2.2, F.col("_peak") * 0.12, F.col("_p") * 0.16, F.lit(LEAST))
    inside = inside.withColumn("_t", thr).withColumn("_on", (F.col("rms") >= F.col("_t")).cast("int"))
    need = max(1, round(150 / hop_ms))
    held = erode(inside, [*keys, line], "frame_idx", "_on", need).withColumn("_ok", F.when(F.col("_n") >= need, F.col("sustained")).otherwise(F.col("_on")))
    got = held.filter("_ok = 1 and _n >= 2").groupBy(*keys, line).agg(
        F.min(F.col("frame_idx") - F.col("_l")).alias("_f"), F.max(F.col("frame_idx") - F.col("_l")).alias("_g"), *(F.first(c).alias(c) for c in ("_s", "_e", "_p", "_t"))
    )
    end = F.least(F.col("_e"), F.col("_s") + (F.col("_g") + 1) * hop_ms + 120)
    found = got.select(
        *keys,
        line,
        F.greatest(F.col("_s"), F.col("_s") + F.col("_f") * hop_ms - 80).cast("bigint").alias("singing_start_ms"),
        F.when(F.col("_e") - end < 250, F.col("_e")).otherwise(end).cast("bigint").alias("singing_end_ms"),
        F.round(clamp((F.col("_p") - F.col("_t")) / F.greatest(F.col("_p"), F.lit(1e-6)), F.lit(0.0), F.lit(1.0)), 3).alias("activity_confidence"),
    )
    return lines.drop("singing_start_ms", "singing_end_ms", "activity_confidence").join(found, [*keys, line], "left")


def baseline_bounds(lines: DataFrame, series: DataFrame, keys: Sequence[str], line: str, first: float, hop: float, margin: float = 40) -> DataFrame:
    """Lines with the simple activity bounds of a series (keys, frame_idx, rms) on a regular grid: ``active_start_ms``, ``active_end_ms``,
    ``activity_ratio`` (share of the line's frames that are active) and ``method`` (energy_window, or anchor_fallback with the line's own times).

    A frame is active above 1.8 of the track's lower quartile, 0.45 of its median and a floor; under a share of 0.12 no bound is trusted."""
    stats = percentiles(series, keys, "rms", [0.25, 0.5]).select(*keys, F.greatest(F.col("p")[0] * 1.8, F.col("p")[1] * 0.45, F.lit(LEAST)).alias("_t"))
    span = lines.filter("end_ms > start_ms").select(*keys, line, F.ceil((F.col("start_ms") - first) / hop).alias("_l"), F.floor((F.col("end_ms") - first) / hop).alias("_r")).filter("_l <= _r")
    spread = span.withColumn("frame_idx", F.explode(F.sequence("_l", "_r")))  # the join is an equi join on frame numbers
    inside = spread.join(series.select(*keys, "frame_idx", "rms"), [*keys, "frame_idx"]).join(stats, list(keys))
    on = F.col("rms") >= F.col("_t")
    got = inside.groupBy(*keys, line).agg(F.avg(on.cast("double")).alias("_ratio"), F.min(F.when(on, F.col("frame_idx"))).alias("_f"), F.max(F.when(on, F.col("frame_idx"))).alias("_g"))
    out = lines.join(got, [*keys, line], "left")
    at = lambda c: (F.lit(first) + F.col(c) * hop).cast("bigint")
    a = F.greatest(F.col("start_ms"), at("_f") - F.lit(margin).cast("bigint"))
    b = F.least(F.col("end_ms"), at("_g") + F.lit(margin).cast("bigint"))
    trusted = F.coalesce((F.col("_ratio") >= 0.12) & (b > a), F.lit(False))
    return out.select(
        *lines.columns,
        F.when(trusted, a).otherwise(F.col("start_ms")).alias("active_start_ms"), F.when(trusted, b).otherwise(F.col("end_ms")).alias("active_end_ms"),
        F.round(F.coalesce("_ratio", F.lit(0.0)), 4).alias("activity_ratio"), F.when(trusted, "energy_window").otherwise("anchor_fallback").alias("method"),
    )


def compare_bounds(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, start_delta, end_delta, ratio_delta): what the bounds of lines by two tracks differ by, for lines of both."""
    cols = ["active_start_ms", "active_end_ms", "activity_ratio"]
    x, y = (d.select(*keys, *(F.col(c).alias(f"{n}{c}") for c in cols)) for d, n in ((a, "a_"), (b, "b_")))
    names = ("start_delta", "end_delta", "ratio_delta")
    return x.join(y, list(keys)).select(*keys, *((F.col(f"b_{c}") - F.col(f"a_{c}")).alias(n) for c, n in zip(cols, names)))


def mixed_down(tracks: DataFrame, keys: Sequence[str], at: str = "frame_idx", value: str = "value") -> DataFrame:
    """(keys, at, value): the sum of several tracks at each time."""
    return tracks.groupBy(*keys, at).agg(F.sum(value).alias(value))

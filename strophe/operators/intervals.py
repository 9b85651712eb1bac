"""Integer-millisecond intervals: splitting, shifting, clamping, joining and repairing.

Integers are rounded half to even (``bround``) wherever an interval is divided.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(c: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, c))


def cut(start: Column, end: Column, i: Column, n: Column) -> Column:
    """The i-th of n + 1 integer boundaries that divide [start, end)."""
    return start + F.bround((end - start) * i / n, 0).cast("bigint")


def split(values: Column, start: Column, end: Column) -> Column:
    """The values with the equal integer parts of an interval; none if there is no value or no time."""
    none = F.array().cast("array<struct<text:string,start_ms:bigint,end_ms:bigint>>")

    def parts(v: Column) -> Column:
        n = F.size(v)
        cuts = F.transform(v, lambda x, i: F.struct(x.alias("text"), cut(start, end, i, n).alias("start_ms"), cut(start, end, i + 1, n).alias("end_ms")))
        return F.when((n > 0) & (end > start), cuts).otherwise(none)

    # the values are bound to a variable: an expression used inside a lambda is evaluated for every element
    return F.get(F.transform(F.array(values), parts), F.lit(0))


def lasting(df: DataFrame, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Rows whose interval has a positive duration."""
    return df.filter(F.col(end) > F.col(start))


def split_lasting(values: Column, start: Column, end: Column) -> Column:
    """``split`` for the offline path: an interval without time counts as one millisecond long, and no part ends before it begins."""
    return split(values, start, F.greatest(end, start + 1))


def shift(df: DataFrame, offset: Column, start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """Both times moved by an offset, never under 0 and never inverted; the times before are kept in ``original_*``.

    The new times derive from the original ones, so shifting twice changes nothing more."""
    s0 = F.coalesce(f"original_{start}", start) if f"original_{start}" in df.columns else F.col(start)
    e0 = F.coalesce(f"original_{end}", end) if f"original_{end}" in df.columns else F.col(end)
    kept = df.withColumns({f"original_{start}": s0, f"original_{end}": e0})
    s = F.greatest(F.lit(0), F.col(f"original_{start}") + offset)
    return kept.withColumns({start: s, end: F.greatest(s, F.col(f"original_{end}") + offset)})


def contained(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, low: str, high: str, rank: Sequence[str]) -> DataFrame:
    """Points with the first span [low, high) that contains each (left join; equi keys first, so it plans as a hash or merge join)."""
    p = points.withColumn("_p", F.struct(*keys, at))
    on = [p[k].eqNullSafe(spans[k]) for k in keys] + [(p[at] >= spans[low]) & (p[at] < spans[high])]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = p.join(spans, cond, "left").select(*[p[c] for c in points.columns], *[spans[c] for c in spans.columns if c not in keys])
    w = Window.partitionBy(*keys, at).orderBy(*rank)
    return joined.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def overlapping(a: DataFrame, b: DataFrame, keys: Sequence[str], a_low: str, a_high: str, b_low: str, b_high: str) -> DataFrame:
    """Pairs of intervals with the same keys that share time."""
    cond = (a[a_high] > b[b_low]) & (a[a_low] < b[b_high])
    for k in keys:
        cond = cond & (a[k] == b[k])
    return a.join(b, cond).select(*[a[c] for c in a.columns], *[b[c] for c in b.columns if c not in keys])


def overlap_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str, breaks: Column | None = None) -> DataFrame:
    """``grp``: number of the run of connected overlaps a row belongs to; a row where ``breaks`` holds stands alone."""
    w = Window.partitionBy(*keys).orderBy(*order)
    brk = F.coalesce(breaks, F.lit(False)) if breaks is not None else F.lit(False)
    out = df.withColumn("_brk", brk)
    out = out.withColumn("_seg", F.sum(F.col("_brk").cast("int") + F.coalesce(F.lag(F.col("_brk").cast("int")).over(w), F.lit(0))).over(w))
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order)
    reach = F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col(start) >= reach, F.lit(True)) | F.col("_brk")
    return out.withColumn("_f", fresh.cast("int")).withColumn("grp", F.sum("_f").over(w)).drop("_brk", "_seg", "_f")


def monotone(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str, end: str, low: Column, high: Column) -> DataFrame:
    """Onsets never fall and stay in [low, high]; ends never precede their onset."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    onset = F.greatest(low, F.max(F.least(high, F.col(start))).over(w))
    return df.withColumn("_a", onset).withColumn(end, F.greatest(F.col("_a"), F.least(high, F.col(end)))).withColumn(start, F.col("_a")).drop("_a")


def fill_gaps(df: DataFrame, keys: Sequence[str], order: Sequence[str], mapped: Column, start: str, end: str, low: Column, high: Column, wall: Column | None = None) -> DataFrame:
    """Runs of unmapped rows share the gap between their neighbours evenly; the ends of the row's own bounds close open gaps.

    ``wall`` rows (blanks) keep their time and end a run. ``filled`` tells which rows were placed."""
    wall = F.coalesce(wall, F.lit(False)) if wall is not None else F.lit(False)
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_in", ~mapped & ~wall).withColumn("_edge", F.coalesce(F.col("_in") != F.lag("_in").over(w), F.lit(True)).cast("int"))
    out = out.withColumn("_run", F.sum("_edge").over(w))
    out = out.withColumn("_prev", F.lag(end).over(w)).withColumn("_next", F.lead(start).over(w))
    run = Window.partitionBy(*keys, "_run")
    by = run.orderBy(*order)
    out = (
        out.withColumn("_i", F.row_number().over(by) - 1)
        .withColumn("_n", F.count(F.lit(1)).over(run))
        .withColumn("_left0", F.first("_prev").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("_right0", F.last("_next").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    right = F.coalesce("_right0", high)
    left = F.when(F.col("_left0").isNull(), F.least(low, right)).otherwise(F.col("_left0"))
    out = out.withColumn("_l", left).withColumn("_r", F.greatest(left, right))
    a, b = cut(F.col("_l"), F.col("_r"), F.col("_i"), F.col("_n")), cut(F.col("_l"), F.col("_r"), F.col("_i") + 1, F.col("_n"))
    out = out.withColumns({"_a": F.when(F.col("_in"), a).otherwise(F.col(start)), "_b": F.when(F.col("_in"), b).otherwise(F.col(end))})
    return out.withColumns({start: F.col("_a"), end: F.col("_b"), "filled": F.col("_in")}).drop("_in", "_edge", "_run", "_prev", "_next", "_i", "_n", "_left0", "_right0", "_l", "_r", "_a", "_b")


def lint(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """One row per violation: missing, negative, inverted or unsorted times (keys, order, problem)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("_ps", F.lag(start).over(w)).withColumn("_pe", F.lag(end).over(w))
    s, e = F.col(start), F.col(end)
    problems = F.array_compact(
        F.array(
            F.when(s.isNull() | e.isNull(), "missing_time"),
            F.when((s < 0) | (e < 0), "negative_time"),
            F.when(e < s, "inverted"),
            F.when(s < F.col("_ps"), "unsorted"),
            F.when(s < F.col("_pe"), "overlaps_previous"),
        )
    )
    return df.withColumn("problem", F.explode(problems)).select(*keys, *order, "problem")

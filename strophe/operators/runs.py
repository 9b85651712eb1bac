"""Continuous periods and gaps of intervals by compressed run bitmaps.

Time is discrete (1 ms). A bitmap of an entity and a time shard of 2**16 ms holds the set
milliseconds as sorted runs [start, end). An interval
sets bits in its first and last shard; the whole shards between are one run of full shards, so a
very long interval costs three rows, not one per shard.

Union: within a shard equal starts keep the longest run before anything is shuffled (exact, and
it bounds a shard's rows by 65,536 whatever the entity's share of all rows), then a running
maximum over the sorted starts gives the shard's set runs.

Stitching: shards stand in blocks of 2**10. What is set before a shard and the run that ends after
it are found inside the block first, then over one summary row per block, so even an entity that
holds a third of all rows is spread over as many tasks as it has blocks, and every window only looks back.

Defined results: rows with a null bound or start >= end set no bit; touching runs belong together;
repeated rows change nothing; an entity without bits has no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_BITS = 16
#: Shards of a block, as a power of two.
BLOCK_BITS = 10


def _pieces(df: DataFrame, entity: Sequence[str], start: str, end: str) -> DataFrame:
    """(entity, fill, shard, s, e): the parts of each interval in its first and last shard, and a fill run between."""
    s, e = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    first, last = F.shiftright(s, SHARD_BITS), F.shiftright(e - 1, SHARD_BITS)
    edge = lambda k: F.shiftleft(k, SHARD_BITS)
    piece = lambda fill, shard, a, b: F.struct(F.lit(fill).alias("fill"), shard.alias("shard"), a.alias("s"), b.alias("e"))
    parts = F.array_compact(
        F.array(
            F.when(first == last, piece(False, first, s, e)).otherwise(piece(False, first, s, edge(first + 1))),
            F.when(last > first, piece(False, last, edge(last), e)),
            F.when(last > first + 1, piece(True, first + 1, edge(first + 1), edge(last))),
        )
    )
    return df.filter(s.isNotNull() & e.isNotNull() & (s < e)).select(*entity, F.inline(parts))


def run_bitmaps(df: DataFrame, entity: Sequence[str], start: str, end: str) -> DataFrame:
    """(entity, shard, fill, runs): one compressed bitmap per entity and occupied shard, plus runs of full shards (``fill``)."""
    longest = _pieces(df, entity, start, end).groupBy(*entity, "fill", "shard", "s").agg(F.max("e").alias("e"))
    shard = Window.partitionBy(*entity, "shard", "fill").orderBy("s")
    reached = F.max("e").over(shard.rowsBetween(Window.unboundedPreceding, -1))
    runs = (
        longest.withColumn("fresh", F.coalesce(F.col("s") > reached, F.lit(True)).cast("int"))
        .withColumn("run", F.sum("fresh").over(shard.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*entity, "shard", "fill", "run")
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
    )
    # at most 32,768 runs stand apart in a shard
    return runs.groupBy(*entity, "shard", "fill").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("runs"))


def periods_and_gaps(df: DataFrame, entity: Sequence[str], start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """(entity, kind, start_ms, end_ms): maximal set runs (``period``) and the clear runs between neighbours (``gap``).

    A cut is a place where a period begins: (p, s), where p is the set time reached before (null at
    an entity's first period) and s the start. The period ends at the p of the next cut, or with the entity."""
    maps = run_bitmaps(df, entity, start, end).select(
        *entity, F.shiftright("shard", BLOCK_BITS).alias("block"), F.col("fill").cast("int").alias("_f"), F.col("runs")[0]["s"].alias("first"), F.element_at("runs", -1)["e"].alias("last"), "runs"
    )
    key = [*entity, "block"]
    whole, order = Window.partitionBy(*entity), lambda w: w.orderBy("first", F.col("_f").desc())
    back = (Window.unboundedPreceding, -1)
    same = lambda a, b: reduce(lambda x, y: x & y, (a[k].eqNullSafe(b[k]) for k in key))
    # what is set before each block, and where the entity ends
    blocks = maps.groupBy(*key).agg(F.max("last").alias("last"))
    before = blocks.withColumn("_in", F.max("last").over(whole.orderBy("block").rowsBetween(*back))).drop("last")
    maps = maps.join(before, same(maps, before), "left").select(maps["*"], before["_in"])
    maps = maps.withColumn("carry", F.greatest("_in", F.max("last").over(order(Window.partitionBy(*key)).rowsBetween(*back))))
    at = F.transform("runs", lambda r, i: F.struct(F.greatest(F.col("carry"), F.when(i > 0, F.get(F.col("runs"), i - 1)["e"])).alias("p"), r["s"].alias("s")))
    cuts = maps.withColumn("cuts", F.filter(at, lambda c: c["p"].isNull() | (c["s"] > c["p"]))).filter(F.size("cuts") > 0).select(*key, "first", "_f", "cuts")
    # the period that a row's last cut begins ends before the next row's first cut, in this block or a later one
    head = F.col("cuts")[0]["p"]
    cuts = cuts.withColumn("_next", F.lead(head).over(order(Window.partitionBy(*key))))
    heads = cuts.groupBy(*key).agg(F.min_by(head, F.struct("first", -F.col("_f"))).alias("_head"))
    heads = blocks.join(heads, same(blocks, heads), "left").select(blocks["*"], heads["_head"])
    after = heads.withColumn("_later", F.last("_head", ignorenulls=True).over(whole.orderBy(F.col("block").desc()).rowsBetween(*back))).withColumn("_end", F.max("last").over(whole)).drop("last", "_head")
    cuts = cuts.join(after, same(cuts, after), "left").select(cuts["*"], after["_later"], after["_end"])
    ends = F.concat(F.transform(F.slice("cuts", 2, F.size("cuts")), lambda c: c["p"]), F.array(F.coalesce("_next", "_later", "_end")))
    found = F.concat(
        F.zip_with("cuts", ends, lambda c, e: F.struct(F.lit("period").alias("kind"), c["s"].alias("start_ms"), e.alias("end_ms"))),
        F.transform(F.filter("cuts", lambda c: c["p"].isNotNull()), lambda c: F.struct(F.lit("gap").alias("kind"), c["p"].alias("start_ms"), c["s"].alias("end_ms"))),
    )
    return cuts.select(*entity, F.inline(found))


def line_periods(lines: DataFrame) -> DataFrame:
    """Periods and gaps of each artifact's lines by final and by original times: (artifact_id, basis, kind, start_ms, end_ms)."""
    both = lines.select(
        "artifact_id",
        F.inline(
            F.array(
                F.struct(F.lit("final").alias("basis"), F.col("start_ms").cast("bigint").alias("a"), F.col("end_ms").cast("bigint").alias("b")),
                F.struct(F.lit("original").alias("basis"), F.col("original_start_ms").cast("bigint").alias("a"), F.col("original_end_ms").cast("bigint").alias("b")),
            )
        ),
    )
    return periods_and_gaps(both, ["artifact_id", "basis"], "a", "b")

"""Mixing of sources to target weights by entropy balancing.

Every token is a unit with base rate 1. Among all rates that meet the token constraints the ones
of least relative entropy are exp(lambda . features) of a document; lambda is the minimum of a
convex dual, found by Newton steps whose gradient and Hessian are sums over all documents, taken
by Spark. Rates are capped at a source's ``max_repeats`` inside the dual. Rates become whole
copies: the floor, and one more for the documents whose hash falls under a threshold of their
source, chosen over a histogram of the hashes so that the tokens of the copies meet the target.

Defined results: the total is the largest that no source's cap makes impossible, or as given;
documents of null or unlisted sources, null and empty texts get no copies; a listed source without
tokens contributes nothing and its share is reported as 0; rows of one id count once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm import tokens
from strophe.session import cut_lineage

#: Bins of the hash histogram at each of two levels.
BINS = 4096
#: Newton steps at most, and the relative error of the constraints that ends them.
STEPS, TOLERANCE = 40, 1e-9


def source_name(c: Column) -> Column:
    """A source in any spelling: case, blanks and separators don't count."""
    return F.regexp_replace(F.trim(F.lower(F.regexp_replace(c, r"(?U)[\s\-_./]+", " "))), " ", "_")


def token_counts(df: DataFrame, key: str, text: str, path: str = tokens.VOCABULARY) -> DataFrame:
    """(key, tokens): one row for every row; 0 for null and empty texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        for batch in batches:
            names = batch.schema.names[:-1]
            n = [len(enc(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*names, "tokens"])

    keep = [c for c in df.columns if c != text]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"{schema}, tokens bigint")


class Balance(NamedTuple):
    """The multipliers, the Newton steps that were taken, and the largest relative error of a constraint that is left."""

    multipliers: np.ndarray
    steps: int
    residual: float


def entropy_balance(units: DataFrame, weight: str, features: list[str], targets: list[float], cap: str | None = None) -> Balance:
    """lambda of the rates min(cap, exp(lambda . features)) whose weighted feature sums are ``targets``.

    Damped Newton on the dual from 0; each step is one aggregation of K + K*(K+1)/2 sums over all rows.
    Rows of equal features and caps are summed up once before, so a step reads what differs only."""
    alike = [*features, *([cap] if cap else [])]
    units = cut_lineage(units.groupBy(*alike).agg(F.sum(weight).alias(weight)))
    k = len(features)
    lam = np.zeros(k)
    goal = np.array(targets, float)
    scale = np.maximum(np.abs(goal), 1.0)

    def sums(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        dot = sum((F.lit(float(a)) * F.col(f) for a, f in zip(at, features)), F.lit(0.0))
        top = F.ln(F.col(cap)) if cap else F.lit(700.0)
        free = dot < top
        rate = F.exp(F.least(dot, top))
        # conjugate of the capped entropy: exp below the cap, a straight line above
        value = F.when(free, rate).otherwise(rate * (1 + dot - top))
        w = F.col(weight)
        cols = [F.sum(w * value)]
        cols += [F.sum(w * rate * F.col(f)) for f in features]
        cols += [F.sum(F.when(free, w * rate * F.col(features[i]) * F.col(features[j])).otherwise(0.0)) for i in range(k) for j in range(i, k)]
        row = [float(x or 0.0) for x in units.agg(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()]
        hess = np.zeros((k, k))
        it = iter(row[1 + k :])
        for i in range(k):
            for j in range(i, k):
                hess[i, j] = hess[j, i] = next(it)
        return row[0] - float(at @ goal), np.array(row[1 : 1 + k]) - goal, hess

    value, grad, hess = sums(lam)
    taken = 0
    for _ in range(STEPS):
        if np.all(np.abs(grad) <= TOLERANCE * scale):
            break
        ridge = 1e-12 * max(1.0, float(np.trace(hess)) / k)
        step = np.linalg.lstsq(hess + ridge * np.eye(k), -grad, rcond=None)[0]
        step = np.clip(step, -4.0, 4.0)
        size = 1.0
        while True:
            trial = sums(lam + size * step)
            if trial[0] <= value + 1e-12 * abs(value) or size < 1e-3:
                break
            size /= 2
        lam = lam + size * step
        value, grad, hess = trial
        taken += 1
    return Balance(lam, taken, float(np.max(np.abs(grad) / scale, initial=0.0)))


def mix(
    documents: DataFrame, key: str, source: str, text: str, targets: DataFrame, total: float | None = None, path: str = tokens.VOCABULARY, margins: dict[str, dict[str, float]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(key, source, tokens, rate, copies) of the documents used, and the report
    (source, target_share, actual_share, tokens, documents, max_copies, newton_steps, residual).

    ``targets`` (source, target_share, max_repeats) is a parameter table of a row per source. ``margins`` adds
    constraints: {column: {value: share of all tokens}}. Documents of one source then get different
    rates, tilted by their values; other values of the column take what is left.
    """
    want = {}
    for r in targets.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").collect():  # a row per listed source
        if r["s"] is not None and r["target_share"] and r["target_share"] > 0 and (r["max_repeats"] or 0) > 0:
            want[r["s"]] = (float(r["target_share"]), int(r["max_repeats"]))
    names = sorted(want)
    margins = margins or {}
    marks = [F.col(c).cast("string").alias(f"m{i}") for i, c in enumerate(margins)]
    rows = documents.select(F.col(key).alias("key"), source_name(F.col(source).cast("string")).alias("source"), *marks, F.col(text).alias("text"))
    rows = rows.filter(F.col("source").isin(names) & F.col("key").isNotNull()) if names else rows.limit(0)
    kept = [f"m{i}" for i in range(len(margins))]
    best = F.max_by(F.struct("source", *kept), F.struct("tokens", "source", *kept)).alias("b")
    counted = cut_lineage(token_counts(rows, "key", "text", path).groupBy("key").agg(best, F.max("tokens").alias("tokens")).filter("tokens > 0").select("key", "b.*", "tokens"))

    have = {r["source"]: int(r["n"]) for r in counted.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}  # a row per listed source
    there = [s for s in names if have.get(s)]
    weight = sum(want[s][0] for s in there)
    if not there:
        empty = counted.select("key", "source", "tokens", F.lit(0.0).alias("rate"), F.lit(0).alias("copies")).limit(0)
        return empty.withColumnRenamed("key", key), _report(empty, targets, Balance(np.zeros(0), 0, 0.0))
    most = min(want[s][1] * have[s] / (want[s][0] / weight) for s in there)
    total = most if total is None else min(float(total), most)
    goal = {s: total * want[s][0] / weight for s in there}

    cap_of = F.lit(None).cast("double")
    for s in there:
        cap_of = F.when(F.col("source") == s, float(want[s][1])).otherwise(cap_of)
    conditions = [(F.col("source") == s, goal[s]) for s in there]
    conditions += [(F.coalesce(F.col(f"m{i}") == v, F.lit(False)), total * share) for i, shares in enumerate(margins.values()) for v, share in sorted(shares.items())]
    units = counted.withColumn("cap", cap_of).withColumn("w", F.col("tokens").cast("double")).withColumns({f"f{i}": c.cast("double") for i, (c, _) in enumerate(conditions)})
    solved = entropy_balance(units, "w", [f"f{i}" for i in range(len(conditions))], [g for _, g in conditions], "cap")

    # a document's rate: the exponential of its own features' multipliers, up to its source's cap
    dot = sum((F.lit(float(m)) * F.col(f"f{i}") for i, m in enumerate(solved.multipliers)), F.lit(0.0))
    rated = units.select("key", "source", "tokens", "cap", F.exp(F.least(dot, F.ln("cap"))).alias("rate"))
    near = F.abs(F.col("rate") - F.round("rate")) < 1e-9  # whole rates but for rounding
    rated = rated.withColumn("whole", F.when(near, F.round("rate")).otherwise(F.floor("rate")).cast("bigint"))
    rated = rated.withColumn("part", F.when(near, F.lit(0.0)).otherwise(F.col("rate") - F.col("whole"))).withColumn("room", F.col("whole") < F.col("cap"))
    # the fraction of a rate is the chance of one copy more: a hash over the fraction, so that one threshold serves all rates of a source
    chance = F.shiftrightunsigned(F.xxhash64("key", F.lit("copies")), 16) / F.greatest(F.col("part"), F.lit(1e-6))
    rated = rated.withColumn("u", F.least(chance, F.lit(float((1 << 48) - 1))).cast("bigint")) if margins else rated.withColumn("u", F.shiftrightunsigned(F.xxhash64("key", F.lit("copies")), 16))
    threshold = _thresholds(rated, goal)
    under = F.lit(False)
    for s in there:
        under = F.when(F.col("source") == s, F.col("u") < threshold[s]).otherwise(under)
    used = rated.select("key", "source", "tokens", "rate", (F.col("whole") + (F.col("room") & under).cast("int")).cast("int").alias("copies")).filter("copies > 0")
    return used.withColumnRenamed("key", key), _report(used, targets, solved)


def _thresholds(rated: DataFrame, goal: dict[str, float]) -> dict[str, int]:
    """For each source the hash under which a document gets one copy more: the tokens of all copies meet the goal to about one document.

    Two histograms of BINS bins a source (bounded whatever the number of documents), the second inside the bin where the goal is met."""
    span = 1 << 48
    base = {r["source"]: float(r["n"]) for r in rated.groupBy("source").agg(F.sum(F.col("whole") * F.col("tokens")).alias("n")).collect()}
    low = {s: 0 for s in goal}
    width = span
    for _ in range(2):
        start = F.lit(0).cast("bigint")
        for s in goal:
            start = F.when(F.col("source") == s, F.lit(low[s]).cast("bigint")).otherwise(start)
        step = width // BINS
        inside = rated.filter(F.col("room") & (F.col("u") >= start) & (F.col("u") < start + width))
        bins = inside.groupBy("source", F.floor((F.col("u") - start) / step).cast("int").alias("bin")).agg(F.sum("tokens").alias("n")).collect()
        per: dict[str, dict[int, int]] = {}
        for r in bins:
            per.setdefault(r["source"], {})[r["bin"]] = int(r["n"])
        for s in goal:
            at = base.get(s, 0.0)
            cut = low[s]
            for b in range(BINS):
                n = per.get(s, {}).get(b, 0)
                if at + n > goal[s]:
                    if at + n / 2 < goal[s] and step < 1 << 30:
                        at, cut = at + n, low[s] + (b + 1) * step
                    break
                at, cut = at + n, low[s] + (b + 1) * step
            base[s], low[s] = at, cut
        width = step
    return low


def _report(used: DataFrame, targets: DataFrame, solved: Balance) -> DataFrame:
    got = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("max_copies"))
    whole = got.agg(F.sum("tokens").alias("total"))
    want = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share")).distinct()
    n = F.coalesce("tokens", F.lit(0))
    return (
        want.join(F.broadcast(got), "source", "left")
        .crossJoin(F.broadcast(whole))  # one row
        .select("source", "target_share", F.round(F.coalesce(n / F.col("total"), F.lit(0.0)), 6).alias("actual_share"), n.cast("bigint").alias("tokens"), F.coalesce("documents", F.lit(0)).cast("bigint").alias("documents"), F.coalesce("max_copies", F.lit(0)).alias("max_copies"), F.lit(solved.steps).alias("newton_steps"), F.lit(solved.residual).alias("residual"))
    )

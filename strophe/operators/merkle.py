"""Incremental processing by a stored Merkle tree over key ranges.

Keys are spread over ranges by the leading bits of a hash of the key. A leaf is one key with the
digest of its state; a range's digest is the xor and the count of its leaves' digests, an upper
range's the same of its lower ranges. The tree is stored: the digests of all ranges in one small
table, the leaves in one folder per upper range. Comparing starts at the root, goes down only into
ranges whose current and saved digests differ, and reads only these ranges' leaves.

A leaf holds two digests: ``state``, and ``done``, what has been processed of it. They differ for a
key that the last run saw unfinished, so its range differs until it has been processed.

Output and tree are published together: the ranges that changed are written into a fresh version
folder, the others stay where they are, and one small manifest that names the folder of every range
becomes visible by one atomic rename. A run that dies before it leaves the last version in force,
so nothing is skipped or repeated. This needs a file system whose rename is atomic and fails on an
existing target (HDFS, local); on object stores the manifest folder must lie on such a system.

Defined results: keys that are null form a leaf of their own; a key without a saved state is
changed; repeated rows of a key resolve to the greatest (time, sequence); empty tables give an
empty tree whose root equals that of any other empty tree.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.session import cut_lineage, shared_dir

#: Bits of the key hash that number the ranges of the two levels under the root. Leaves and output are stored by
#: upper range, so each version writes and each comparison opens at most 2**UPPER folders.
UPPER, LOWER = 4, 16


def hex_value(c: Column) -> Column:
    """A hash as its hexadecimal value: prefix, blanks, separators, case and leading zeros don't count; null stays null."""
    bare = F.regexp_replace(F.lower(c), r"(?U)[\s:_\-]+", "")
    bare = F.regexp_replace(bare, r"^(?:sha-?256|0x)+", "")
    return F.regexp_replace(bare, r"^0+(?=.)", "")


def digest(*cols: Column) -> Column:
    """64 bits over values that may be null; null differs from every value."""
    return F.xxhash64(F.concat_ws("\u0001", *(F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("\u0000")) for c in cols)))


def log_state(inputs: Column, stages: Column) -> Column:
    """The digest of what counts as state of a directory: input hashes and the signature of every stage."""
    hashes = [hex_value(inputs[a]["sha256"]) for a in ("audio", "lyrics_timeline")] + [hex_value(inputs["config_sha256"])]
    entries = F.array_sort(F.transform(F.map_entries(stages), lambda e: F.struct(e["key"].alias("k"), e["value"]["signature"].alias("s"))))
    return digest(*hashes, F.to_json(entries, {"ignoreNullFields": "false"}))


def unfinished(stages: Column) -> Column:
    """Whether a stage is neither done nor skipped."""
    return F.coalesce(F.exists(F.map_values(stages), lambda v: ~F.coalesce(v["status"].isin("done", "skipped"), F.lit(False))), F.lit(False))


def _range(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\u0000"))), 64 - bits).cast("int")


def _summed(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*(F.bit_xor(c).alias(c) for c in columns), F.sum("n").alias("n"))


def range_digests(leaves: DataFrame) -> DataFrame:
    """(upper, lower, state, done, n) of the lowest ranges of leaves (key, state, done). The key is mixed into
    a leaf's digest, so equal states of two keys can't cancel out. At most 2**LOWER rows."""
    mixed = leaves.select(
        _range(F.col("key"), UPPER).alias("upper"), _range(F.col("key"), LOWER).alias("lower"), F.xxhash64("key", "state").alias("state"), F.xxhash64("key", "done").alias("done"), F.lit(1).cast("bigint").alias("n")
    )
    return _summed(mixed, ["upper", "lower"], ["state", "done"])


def differing_ranges(saved: DataFrame, now: DataFrame) -> DataFrame:
    """(upper, lower) of the lowest ranges where the current ``state`` isn't the saved ``done``, found from the root down.
    Both are tables of range digests, at most 2**LOWER rows."""
    a = saved.select("upper", "lower", F.col("done").alias("a"), F.lit(0).cast("bigint").alias("b"), F.col("n").alias("na"), F.lit(0).cast("bigint").alias("nb"))
    b = now.select("upper", "lower", F.lit(0).cast("bigint").alias("a"), F.col("state").alias("b"), F.lit(0).cast("bigint").alias("na"), F.col("n").alias("nb"))
    both = a.unionByName(b)
    level = lambda df, by: df.groupBy(*by).agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    lowest = level(both, ["upper", "lower"])
    upper = level(lowest, ["upper"])
    differs = "not (a <=> b and na <=> nb)"
    root = upper.agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("na").alias("na"), F.sum("nb").alias("nb")).filter(differs)
    inside = upper.filter(differs).join(F.broadcast(root.select(F.lit(True).alias("_open"))), how="cross").select("upper")  # one row or none
    return lowest.join(F.broadcast(inside), "upper", "left_semi").filter(differs).select("upper", "lower")


def _small(ranges: DataFrame) -> DataFrame:
    """Numbers of ranges, at most 2**LOWER rows, as a table of the driver."""
    return ranges.sparkSession.createDataFrame(ranges.select("upper", "lower").toPandas(), "upper int, lower int")


class MerkleStore:
    """Versions of an output with its tree under one folder of a Hadoop file system.

    ``<root>/v=<id>/leaves|output/upper=<range>`` hold what a version wrote, ``<root>/v=<id>/ranges`` all range
    digests; ``<root>/manifests/<number>.json`` name the version's folders, and the newest is in force.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict | None:
        """The version in force. Its manifest is the newest complete one, so a crash between
        writing and naming it changes nothing."""
        at = self._path(f"{self.root}/manifests")
        if not self._fs.exists(at):
            return None
        names = sorted(x.getPath().getName() for x in self._fs.listStatus(at) if x.getPath().getName().endswith(".json"))
        if not names:
            return None
        stream = self._fs.open(self._path(f"{self.root}/manifests/{names[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def remove(self) -> None:
        self._fs.delete(self._path(self.root), True)

    def ranges(self) -> DataFrame:
        """The saved range digests; empty before the first version."""
        m = self.manifest()
        if m is None:
            return self.spark.createDataFrame([], "upper int, lower int, state bigint, done bigint, n bigint")
        return self.spark.read.parquet(f"{self.root}/v={m['version']}/ranges")

    def _stored(self, what: str, uppers: Sequence[int] | None = None) -> DataFrame | None:
        """The stored leaves or output of these upper ranges (all if None): only their folders are read."""
        parts = (self.manifest() or {"parts": {}})["parts"]
        paths = [f"{self.root}/v={v}/{what}/upper={u}" for u, v in sorted(parts.items()) if uppers is None or int(u) in set(uppers)]
        paths = [p for p in paths if self._fs.exists(self._path(p))]  # a range may have leaves and no output
        return self.spark.read.parquet(*paths) if paths else None

    def output(self) -> DataFrame | None:
        return self._stored("output")

    def leaves(self, like: DataFrame, at: DataFrame) -> DataFrame:
        """The saved leaves of the ranges ``at`` (upper, lower), with the columns of ``like``."""
        uppers = [r["upper"] for r in at.select("upper").distinct().collect()]  # at most 2**UPPER
        got = self._stored("leaves", uppers)
        if got is None:
            return like.limit(0)
        return got.join(F.broadcast(at), "lower", "left_semi").select(*like.columns)  # at most 2**LOWER rows

    def diff(self, current: DataFrame) -> DataFrame:
        """(key, change) of a whole current state ``current`` (key, state), one row a key, against the saved tree: added, changed, removed.
        Also keys whose saved state hasn't been processed are changed."""
        now = current.select("key", "state", F.col("state").alias("done"))
        at = _small(differing_ranges(self.ranges(), range_digests(now)))
        saved = self.leaves(now, at)
        own = now.withColumn("lower", _range(F.col("key"), LOWER)).join(F.broadcast(at), "lower", "left_semi").select("key", "state")
        return _changes(saved, own)

    def changed_since(self, fresh: DataFrame) -> DataFrame:
        """(key, change) after the rows ``fresh`` (key, version, state) that the saved tree hasn't seen; of a key the
        greatest version counts, which may be the saved one. Leaves are read only of ranges that fresh
        rows touch or that hold something unprocessed; the digests of all others are the saved ones."""
        fresh = fresh.groupBy("key").agg(F.max_by(F.struct("version", "state"), "version").alias("f"), F.max_by(F.col("state"), F.struct("version", "state")).alias("state")).select("key", "f.version", "state")
        saved = self.ranges()
        touched = fresh.select(_range(F.col("key"), UPPER).alias("upper"), _range(F.col("key"), LOWER).alias("lower"))
        visit = _small(touched.union(saved.filter("not (state <=> done)").select("upper", "lower")).distinct())
        old = self.leaves(fresh.withColumn("done", F.col("state")), visit)
        both = old.select("key", "version", "state").unionByName(fresh)
        now = both.groupBy("key").agg(F.max_by("state", F.struct("version", "state")).alias("state"))
        digests = range_digests(now.withColumn("done", F.col("state"))).unionByName(saved.join(F.broadcast(visit), ["upper", "lower"], "left_anti"))
        at = differing_ranges(saved, digests)
        own = now.withColumn("lower", _range(F.col("key"), LOWER)).join(F.broadcast(at), "lower", "left_semi").select("key", "state")
        return _changes(old.withColumn("lower", _range(F.col("key"), LOWER)).join(F.broadcast(at), "lower", "left_semi"), own)

    def publish(self, output: DataFrame | None, leaves: DataFrame, key: str, uppers: Sequence[int] | None = None) -> str:
        """Write output (with column ``key``; None where the tree is all there is) and leaves (key, state, done, maybe version), then make both visible at
        once; returns the version. With ``uppers`` only these upper ranges are written and the others stay as they are."""
        last = self.manifest()
        number = (last["number"] if last else 0) + 1
        version = f"{number:012d}-{uuid.uuid4().hex[:8]}"
        base = f"{self.root}/v={version}"
        some = lambda df: df if uppers is None else df.filter(F.col("upper").isin(list(uppers)))
        tree = some(leaves.withColumn("upper", _range(F.col("key"), UPPER)).withColumn("lower", _range(F.col("key"), LOWER)))
        tree.repartitionByRange("upper", "lower").sortWithinPartitions("upper", "lower").write.partitionBy("upper").parquet(f"{base}/leaves")
        if output is not None:
            some(output.withColumn("upper", _range(F.col(key), UPPER))).repartitionByRange("upper").write.partitionBy("upper").parquet(f"{base}/output")
        wrote = self._folders(f"{base}/leaves")
        written = range_digests(self.spark.read.parquet(f"{base}/leaves")) if wrote else self.ranges().limit(0)
        if uppers is not None:
            written = written.unionByName(self.ranges().filter(~F.col("upper").isin(list(uppers))))
        written.coalesce(1).write.parquet(f"{base}/ranges")
        parts = {} if uppers is None or last is None else {u: v for u, v in last["parts"].items() if int(u) not in set(uppers)}
        parts |= dict.fromkeys(wrote, version)
        if output is not None and (lone := set(self._folders(f"{base}/output")) - set(wrote)):
            raise ValueError(f"output rows without a leaf in the ranges {sorted(lone)}")
        draft = self._path(f"{base}/manifest.draft")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps({"number": number, "version": version, "parts": parts}).encode()))
        stream.close()
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        # named by number alone: of two writers of the same number only one rename succeeds
        if not self._fs.rename(draft, self._path(f"{self.root}/manifests/{number:012d}.json")):
            raise RuntimeError(f"version {number} was published by another run")
        return version

    def _folders(self, at: str) -> list[str]:
        if not self._fs.exists(self._path(at)):
            return []
        names = (x.getPath().getName() for x in self._fs.listStatus(self._path(at)))
        return sorted(n.removeprefix("upper=") for n in names if n.startswith("upper="))


def _changes(saved: DataFrame, now: DataFrame) -> DataFrame:
    a, b = saved.select("key", F.col("done").alias("a")), now.select("key", F.col("state").alias("b"))
    both = a.withColumn("b", F.lit(None).cast("bigint")).unionByName(b.withColumn("a", F.lit(None).cast("bigint")))
    state = both.groupBy("key").agg(F.max("a").alias("a"), F.max("b").alias("b")).filter("not (a <=> b)")
    return state.select("key", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


# ------------------------------------------------------------------- an append-only log


def last_successful(runs: DataFrame) -> DataFrame:
    """One row (since) of the latest normal run with status ok: its started_at, null if there is none."""
    ok = (F.col("run_status") == "ok") & (F.col("run_mode") == "normal")
    return runs.filter(ok).agg(F.max("started_at").alias("since"))


def log_rows(log: DataFrame) -> DataFrame:
    """(key, version, state, done) of every row of the log; a state with an unfinished stage hasn't been processed."""
    state = log_state(F.col("inputs"), F.col("stages"))
    rows = log.select(F.col("song_dir").alias("key"), F.struct("written_at", "log_id").alias("version"), state.alias("state"), unfinished(F.col("stages")).alias("open"))
    return rows.select("key", "version", "state", F.when(F.col("open"), F.bitwise_not("state")).otherwise(F.col("state")).alias("done"))


def publish_run(store: MerkleStore, log: DataFrame, since) -> str:
    """What a run that started at ``since`` publishes beside its output: the tree over the states of all directories it saw."""
    seen = log_rows(log.filter(F.col("arrived_at") < F.lit(since)))
    leaves = seen.groupBy("key").agg(F.max_by(F.struct("version", "state", "done"), "version").alias("s")).select("key", "s.*")
    return store.publish(None, leaves, "key")


def changed_directories(log: DataFrame, runs: DataFrame, store: MerkleStore | None = None) -> DataFrame:
    """The directories that the next run has to process: (song_dir).

    With the ``store`` that the last successful run published only the rows that arrived since then are read, and
    the leaves of the ranges that they touch. Without one its tree is first made from the rows that the run saw, in the shared folder."""
    since = last_successful(runs).first()["since"]
    own = store is None
    if own:
        store = MerkleStore(log.sparkSession, f"{shared_dir(log.sparkSession)}/merkle-{uuid.uuid4().hex}")
        if since is not None:
            publish_run(store, log, since)
    fresh = log if since is None else log.filter(~F.coalesce(F.col("arrived_at") < F.lit(since), F.lit(False)))
    found = store.changed_since(log_rows(fresh).select("key", "version", "state")).filter("change != 'removed'").select(F.col("key").alias("song_dir"))
    if own:
        found = cut_lineage(found)  # the rows found, before the tree that they were found in goes
        store.remove()
    return found

"""Schemas that drift between files: tree edit scripts and one consistent table.

Each file gets a schema tree with a profile per member (presence, JSON types, a sketch of its
values). The tree edit distance between the trees of consecutive files, with children unordered
and costs for adding, deleting, renaming and moving a member, yields a minimum-cost script; the
scripts of a feed are compiled into one projection per file that maps its members to the first
names, and applied to every row.

Renaming costs what the names and the value profiles of the two members differ by. Two members
that stand side by side in a part of all files carry different information and are never a
renaming of each other.

Defined results: broken, null and non-object payloads have no members; a file without members is
skipped over when it is compared (its successor has no changes against it); a member whose values
are all null has no type and doesn't count as retyped; files delivered twice count once.
"""

from __future__ import annotations

import heapq
import json
import math
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.operators.shred import strict_json
from strophe.session import cut_lineage

TYPES = ("string", "integer", "number", "boolean", "array", "object")
#: Distinct values that a sketch keeps (the smallest hashes: equal value sets keep equal hashes).
SKETCH = 48
ADD, DELETE, MOVE = 1.0, 1.0, 1.5
#: A renaming that costs more than this is an addition and a deletion.
RENAME_MOST = 1.0
#: Part of the files that have the rarer of two members in which both must stand to be different things.
BESIDE = 0.02
#: Words that members are named by and that mean the same.
SYNONYMS = (
    ("start", "begin", "from", "onset"), ("end", "stop", "finish", "until"), ("source", "src", "origin"),
    ("status", "state"), ("timing", "time"), ("version", "ver", "rev"), ("coverage", "cov"), ("align", "alignment", "aligned"), ("id", "key"),
)
_WORD = {w: group[0] for group in SYNONYMS for w in group}
#: Words that say little: unit and kind of a value.
_LIGHT = frozenset({"ms", "name", "of", "the", "value", "is", "line", "field"})


def name_words(name: str) -> list[str]:
    """The words of a member's name in any spelling of compounds."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name)
    return [_WORD.get(w, w) for w in re.split(r"[^0-9a-z]+", spaced.lower()) if w]


def name_distance(a: str, b: str) -> float:
    """0 for the same words in any spelling or order, 1 for names without a common word."""
    x, y = set(name_words(a)), set(name_words(b))
    if x == y or "".join(sorted(x)) == "".join(sorted(y)):
        return 0.0
    weight = lambda s: sum(0.25 if w in _LIGHT else 1.0 for w in s)
    common = set(x & y)
    total = weight(x | y)
    share = weight(common) / total if total else 0.0
    if not (common - _LIGHT):  # abbreviations
        for u in x - _LIGHT:
            for v in y - _LIGHT:
                if min(len(u), len(v)) >= 3 and (u.startswith(v) or v.startswith(u)):
                    share = max(share, 0.6)
    return 1.0 - share


def value_distance(a: dict, b: dict) -> float:
    """How much two value profiles differ, 0 to 1. Kinds of spelling (a number as string, a value
    wrapped in an array or object) count little, the values themselves much."""
    if not a["n"] or not b["n"]:
        return 0.5
    if a["num"] >= 0.5 and b["num"] >= 0.5:
        if (a["frac"] > 0.1) != (b["frac"] > 0.1) and max(a["distinct"], b["distinct"]) > 3:
            return 1.0
        if a["distinct"] <= 2 and b["distinct"] <= 2 and (a["lo"], a["hi"]) != (b["lo"], b["hi"]):
            return 0.4  # constants of a file (versions) move on
        span = max(a["hi"], b["hi"]) - min(a["lo"], b["lo"])
        if span <= 0:
            return 0.0
        over = min(a["hi"], b["hi"]) - max(a["lo"], b["lo"])
        return min(1.0, max(0.0, 1.0 - over / span))
    if (a["num"] >= 0.5) != (b["num"] >= 0.5):
        return 0.9
    x, y = set(a["sketch"]), set(b["sketch"])
    if not x or not y:
        return 0.5
    inner = len(x & y)
    return 1.0 - inner / min(len(x), len(y)) * (0.5 + 0.5 * inner / len(x | y))


def rename_cost(old: dict, new: dict) -> float:
    """Below RENAME_MOST only if the values agree with the names, or either is beyond doubt."""
    n, v = name_distance(old["name"], new["name"]), value_distance(old, new)
    if n == 0.0:
        return 0.1 * v
    numbers = old["num"] >= 0.5 and new["num"] >= 0.5
    # ranges of numbers agree by chance, vocabularies hardly
    if numbers:
        return 0.9 * n + 0.6 * v if n < 0.9 else 2.0
    return 0.8 * n + 0.8 * v if v > 0.35 or n < 0.9 else 0.5 * n + 1.2 * v


def assign(costs: list[list[float]], skip: float) -> list[tuple[int, int]]:
    """Pairs (row, column) of minimum total cost, where leaving a row and a column unpaired costs ``skip`` together
    (shortest augmenting paths)."""
    n, m = len(costs), len(costs[0]) if costs else 0
    if not n or not m:
        return []
    size = n + m
    big = [[(costs[i][j] if i < n and j < m else skip / 2 if (i < n) != (j < m) else 0.0) for j in range(size)] for i in range(size)]
    u, v, match = [0.0] * (size + 1), [0.0] * (size + 1), [0] * (size + 1)
    for i in range(1, size + 1):
        match[0], j0 = i, 0
        least, used, way = [float("inf")] * (size + 1), [False] * (size + 1), [0] * (size + 1)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], float("inf"), 0
            for j in range(1, size + 1):
                if not used[j]:
                    c = big[i0 - 1][j - 1] - u[i0] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(size + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j] - 1 < n and costs[match[j] - 1][j - 1] < skip]


#: Ways to pair the free objects of two trees that are tried one by one; beyond, pairings are improved step by step.
MOST_PAIRINGS = 5_000


def _pairings(a: list[dict], b: list[dict]) -> Iterator[dict[tuple, tuple]]:
    """All ways to pair some of a with some of b, as path -> path."""
    if not a:
        yield {}
        return
    for rest in _pairings(a[1:], b):
        yield rest
        used = set(rest.values())
        for y in b:
            if y["path"] not in used:
                yield {a[0]["path"]: y["path"], **rest}


def _count_pairings(n: int, m: int) -> int:
    return sum(math.comb(n, k) * math.comb(m, k) * math.factorial(k) for k in range(min(n, m) + 1))


class _Trees:
    """Two schema trees. Members of equal path are kept: a name that both files have at one place didn't go.

    The others are free. A mapping pairs free members one to one; it costs what its renamings and
    moves cost and ADD or DELETE for every member that is left. A pair is a move if the parents aren't paired. Given
    which free objects are paired, the cost of every other pair is known, and the best rest is an
    assignment; so the minimum over the pairings of objects is the edit distance with moves."""

    def __init__(self, old: list[dict], new: list[dict], apart: frozenset[tuple[str, str]]) -> None:
        x, y = {p["path"]: p for p in old}, {p["path"]: p for p in new}
        self.kept = sorted(x.keys() & y.keys())
        self.old, self.new = x, y
        self.gone, self.came = [x[k] for k in sorted(x.keys() - y.keys())], [y[k] for k in sorted(y.keys() - x.keys())]
        inner = {k[:-1] for k in (*x, *y)}
        self.objects = [p for p in self.gone if p["path"] in inner], [p for p in self.came if p["path"] in inner]
        self.apart = apart
        self._same = {(g["path"], f["path"]): self._alike(g, f) for g in self.gone for f in self.came}

    def _alike(self, g: dict, f: dict) -> float:
        """The cost of calling one the other, wherever they stand."""
        both = ADD + DELETE
        if g["name"] == f["name"]:
            return 0.1 * value_distance(g, f) if g["types"] == f["types"] else both
        return both if (g["name"], f["name"]) in self.apart else min(both, rename_cost(g, f) * both / RENAME_MOST)

    def cost(self, g: dict, f: dict, objects: dict[tuple, tuple]) -> float:
        a, b = g["path"][:-1], f["path"][:-1]
        at_home = objects.get(a) == b or (a == b and a not in objects and b not in objects.values())
        return self._same[g["path"], f["path"]] + (0.0 if at_home else MOVE)

    def best(self, objects: dict[tuple, tuple]) -> tuple[float, dict[tuple, tuple]]:
        """(cost, mapping) of the cheapest mapping that pairs just these objects."""
        total = sum(self.cost(self.old[a], self.new[b], objects) for a, b in objects.items())
        taken = set(objects.values())
        g, f = [p for p in self.gone if p["path"] not in objects], [p for p in self.came if p["path"] not in taken]
        inner = {p["path"] for p in self.objects[0]}, {p["path"] for p in self.objects[1]}
        both = ADD + DELETE
        costs = [[both if p["path"] in inner[0] and q["path"] in inner[1] else min(both, self.cost(p, q, objects)) for q in f] for p in g]
        pairs = assign(costs, both)
        total += sum(costs[i][j] for i, j in pairs) + DELETE * (len(g) - len(pairs)) + ADD * (len(f) - len(pairs))
        return total, objects | {g[i]["path"]: f[j]["path"] for i, j in pairs}

    def solve(self) -> tuple[float, dict[tuple, tuple]]:
        a, b = self.objects
        rank = lambda found: (round(found[0], 9), sorted(found[1].items()))
        if _count_pairings(len(a), len(b)) <= MOST_PAIRINGS:
            return min(map(self.best, _pairings(a, b)), key=rank)
        # so many new and lost objects at once: from no pair on, the best single change of the pairing as long as one helps
        now: dict[tuple, tuple] = {}
        found = self.best(now)
        while True:
            tries = [{k: v for k, v in now.items() if k != x} for x in now]
            tries += [{k: v for k, v in now.items() if v != q["path"]} | {p["path"]: q["path"]} for p in a for q in b if now.get(p["path"]) != q["path"]]
            better = min(((self.best(t), t) for t in tries), key=lambda u: rank(u[0]), default=None)
            if better is None or better[0][0] >= found[0] - 1e-9:
                return found
            found, now = better


def edit_script(old: list[dict], new: list[dict], apart: frozenset[tuple[str, str]] = frozenset()) -> list[dict]:
    """The minimum-cost script between two schema trees given as profiles with ``path`` (a tuple; entries of arrays are members named [])."""
    trees = _Trees(old, new, apart)
    mapping = trees.solve()[1]
    script = [{"kind": "retyped", "path": k, "old": k} for k in trees.kept if trees.old[k]["types"] and trees.new[k]["types"] and trees.old[k]["types"] != trees.new[k]["types"]]
    for a, b in sorted(mapping.items()):
        home = mapping.get(a[:-1], a[:-1]) == b[:-1]
        if a[-1] != b[-1] or not home:
            script.append({"kind": "renamed" if home else "moved", "path": b, "old": a})
    script += [{"kind": "removed", "path": g["path"], "old": g["path"]} for g in trees.gone if g["path"] not in mapping]
    taken = set(mapping.values())
    return script + [{"kind": "added", "path": f["path"], "old": ()} for f in trees.came if f["path"] not in taken]


# ---------------------------------------------------------------------------------------- profiles

_PROFILE = "feed string, file_seq int, path array<string>, types int, n bigint, seen bigint, nums bigint, fracs bigint, lo double, hi double, sketch array<int>"


#: The bit of a JSON value's type.
_TYPE = {str: 1, int: 2, float: 4, bool: 8, list: 16, dict: 32}


def _plain(v: object) -> object:
    """The value inside the wrappings that a retyping puts around it."""
    while isinstance(v, (list, dict)) and len(v) == 1:
        v = v[0] if isinstance(v, list) else next(iter(v.values()))
    return v


class _Stats:
    """What is known of one member of one file. Values are hashed when there are many or at the end, each distinct one once."""

    __slots__ = ("types", "n", "seen", "nums", "fracs", "lo", "hi", "values", "hashes")

    def __init__(self) -> None:
        self.types = self.n = self.seen = self.nums = self.fracs = 0
        self.lo, self.hi = float("inf"), float("-inf")
        self.values: set[str] = set()
        self.hashes: list[int] = []

    def number(self, x: float) -> None:
        self.nums += 1
        self.fracs += not x.is_integer()
        if x < self.lo:
            self.lo = x
        if x > self.hi:
            self.hi = x

    def add(self, v: object) -> None:
        self.seen += 1
        if v is None:
            return
        self.n += 1
        kind = v.__class__
        self.types |= _TYPE[kind]
        if kind is list or kind is dict:
            v = _plain(v)
            kind = v.__class__
        if kind is str:
            if v[:1] in _BEGINS_NUMBER:
                try:
                    x = float(v)
                    if x == x:
                        self.number(x)
                except ValueError:
                    pass
            self.values.add(v)
        elif kind is int or kind is float:
            self.number(float(v))
            self.values.add(repr(v))
        else:
            self.values.add(json.dumps(v, sort_keys=True, ensure_ascii=False))
        if len(self.values) > 16 * SKETCH:
            self.sketch()

    def sketch(self) -> list[int]:
        from xxhash import xxh32_intdigest

        self.hashes = heapq.nsmallest(SKETCH, {*self.hashes, *(xxh32_intdigest(v) - 2**31 for v in self.values)})
        self.values.clear()
        return self.hashes


#: What a number in a string can begin with.
_BEGINS_NUMBER = frozenset("0123456789+-. \tinINfF")


def _object(payload: str | None) -> dict | None:
    try:
        v = strict_json(payload) if payload is not None else None
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


#: Members of files that a task holds profiles of before it passes them on.
MOST_HELD = 20_000


def _partials(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Profiles of the members at every depth, one per file and member of a partition (more often only beyond MOST_HELD)."""
    stats: dict[tuple, _Stats] = {}

    def rows() -> pa.RecordBatch:
        made = [
            (k[0], k[1], list(k[2:]), s.types, s.n, s.seen, s.nums, s.fracs, s.lo if s.nums else None, s.hi if s.nums else None, s.sketch()) for k, s in stats.items()
        ]
        cols = list(zip(*made)) or [[]] * 11
        kinds = [pa.string(), pa.int32(), pa.list_(pa.string()), pa.int32(), *[pa.int64()] * 4, *[pa.float64()] * 2, pa.list_(pa.int32())]
        stats.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["feed", "file_seq", "path", "types", "n", "seen", "nums", "fracs", "lo", "hi", "sketch"])

    for batch in batches:
        for feed, seq, payload in zip(*(c.to_pylist() for c in batch.columns)):
            v = _object(payload)
            stack = [] if v is None else [((feed, seq), v)]
            while stack:
                at, obj = stack.pop()
                for k, x in obj.items():
                    key = (*at, k)
                    s = stats.get(key)
                    if s is None:
                        s = stats[key] = _Stats()
                    s.add(x)
                    kind = x.__class__
                    if kind is dict:
                        stack.append((key, x))
                    elif kind is list:  # entries that are objects share one schema
                        inner = [e for e in x if isinstance(e, dict)]
                        if inner:
                            own = stats.setdefault((*key, "[]"), _Stats())
                            for e in inner:
                                own.add(e)
                                stack.append(((*key, "[]"), e))
        if len(stats) > MOST_HELD:
            yield rows()
    yield rows()


def profiles(exports: DataFrame) -> DataFrame:
    """One row per (feed, file_seq, path): the schema tree of every file with value profiles.

    Rows are profiled where they are read; one partial row per file, member and partition is
    shuffled, and sketches are cut to SKETCH hashes again when they are merged."""
    part = exports.select(F.col("feed").cast("string"), F.col("file_seq").cast("int"), F.col("payload").cast("string")).mapInArrow(_partials, _PROFILE)
    return part.groupBy("feed", "file_seq", "path").agg(
        F.bit_or("types").alias("types"), F.sum("n").alias("n"), F.sum("seen").alias("seen"), F.sum("nums").alias("nums"), F.sum("fracs").alias("fracs"),
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, SKETCH).alias("sketch"),
    )


def _files(profile: DataFrame) -> DataFrame:
    """One row per file with its members; their number is that of a schema, not of rows."""
    return profile.groupBy("feed", "file_seq").agg(F.array_sort(F.collect_list(F.struct("path", "types", "n", "seen", "nums", "fracs", "lo", "hi", "sketch"))).alias("members"))


def _member(row) -> dict:
    n = row["n"]
    types = row["types"]
    if types & 4:
        types &= ~2  # integers among numbers with a fraction
    return {
        "path": tuple(row["path"]), "name": row["path"][-1], "types": types, "n": n, "num": row["nums"] / n if n else 0.0, "frac": row["fracs"] / row["nums"] if row["nums"] else 0.0,
        "lo": row["lo"], "hi": row["hi"], "sketch": list(row["sketch"]), "distinct": len(row["sketch"]),
    }


def _transitions(profile: DataFrame, gaps: bool = False) -> DataFrame:
    """(feed, file_seq, before, members) of every file that follows a file of the same feed, with ``gaps`` also over missing numbers."""
    files = _files(profile)
    order = Window.partitionBy("feed").orderBy("file_seq")
    return files.withColumn("before", F.lag("members").over(order)).withColumn("last", F.lag("file_seq").over(order)).filter(F.col("last").isNotNull() if gaps else F.col("last") == F.col("file_seq") - 1).drop("last")


def _apart(profile: DataFrame, moves: DataFrame) -> DataFrame:
    """(feed, file_seq, apart): of the pairs (lost member, new member) of a transition those that stand side by side in files, not only in an odd one."""
    top = profile.filter(F.size("path") == 1).select("feed", "file_seq", F.col("path")[0].alias("name"))
    names = lambda c: F.transform(F.filter(c, lambda m: F.size(m["path"]) == 1), lambda m: m["path"][0])
    pairs = (
        moves.select("feed", "file_seq", F.array_except(names("before"), names("members")).alias("gone"), F.array_except(names("members"), names("before")).alias("fresh"))
        .select("feed", "file_seq", F.explode("gone").alias("g"), "fresh")
        .select("feed", "file_seq", "g", F.explode("fresh").alias("f"))
    )
    wanted = pairs.select("g", "f").distinct()
    sets = top.groupBy("feed", "file_seq").agg(F.collect_set("name").alias("names"))
    shapes = sets.groupBy(F.array_sort("names").alias("names")).agg(F.count("*").alias("files"))  # files of one shape count together
    alone = shapes.select(F.explode("names").alias("name"), "files").groupBy("name").agg(F.sum("files").alias("files"))
    beside = shapes.select(F.explode("names").alias("g"), "names", "files").select("g", F.explode("names").alias("f"), "files").join(wanted, ["g", "f"], "left_semi").groupBy("g", "f").agg(F.sum("files").alias("both"))
    rarer = beside.join(alone.select(F.col("name").alias("g"), F.col("files").alias("n_g")), "g").join(alone.select(F.col("name").alias("f"), F.col("files").alias("n_f")), "f")
    sure = rarer.filter(F.col("both") >= BESIDE * F.least("n_g", "n_f")).select("g", "f")
    return pairs.join(sure, ["g", "f"], "left_semi").groupBy("feed", "file_seq").agg(F.collect_list(F.struct("g", "f")).alias("apart"))


def edit_scripts(exports: DataFrame, gaps: bool = False) -> DataFrame:
    """The edit script of every file against the file before it: (feed, file_seq, change_kind, field_path, old_path).
    With ``gaps`` the file before is the last one there is, else the one numbered one less."""
    profile = cut_lineage(profiles(exports))  # a row per file and member; read several times below
    moves = _transitions(profile, gaps)
    changed = moves.filter(
        F.transform("before", lambda m: F.struct(m["path"], m["types"])) != F.transform("members", lambda m: F.struct(m["path"], m["types"]))
    )
    both = changed.join(_apart(profile, moves), ["feed", "file_seq"], "left")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for feed, seq, before, members, apart in zip(pdf["feed"], pdf["file_seq"], pdf["before"], pdf["members"], pdf["apart"]):
                no = frozenset((p["g"], p["f"]) for p in apart) if apart is not None else frozenset()
                for s in edit_script([_member(m) for m in before], [_member(m) for m in members], no):
                    rows.append((feed, seq, s["kind"], list(s["path"]), list(s["old"])))
            yield pd.DataFrame(rows, columns=["feed", "file_seq", "change_kind", "field_path", "old_path"])

    return both.select("feed", "file_seq", "before", "members", "apart").mapInPandas(run, "feed string, file_seq int, change_kind string, field_path array<string>, old_path array<string>")


def top_level_changes(exports: DataFrame) -> DataFrame:
    """Changes of the top-level members: (feed, file_seq, change_kind, field_name, old_name)."""
    s = edit_scripts(exports).filter((F.size("field_path") == 1) & F.col("change_kind").isin("added", "removed", "retyped", "renamed"))
    return s.select(
        "feed", "file_seq", "change_kind", F.col("field_path")[0].alias("field_name"), F.when(F.col("change_kind") == "renamed", F.col("old_path")[0]).otherwise("").alias("old_name")
    )


def _placed(v: dict, to: dict[tuple, tuple]) -> dict[tuple, object]:
    """The members of a record at every depth under their first paths."""
    out: dict[tuple, object] = {}
    stack = [((), (), v)]
    while stack:
        path, first, obj = stack.pop()
        for k, x in obj.items():
            own, place = (*path, k), to.get((*path, k), (*first, k))
            out[place] = x
            if isinstance(x, dict):
                stack.append((own, place, x))
    return out


def _first_paths(plan: list[dict], seq: int) -> dict[tuple, tuple]:
    """Where the members of file ``seq`` stood at first: the renamings and moves up to it, one after the other."""
    to: dict[tuple, tuple] = {}
    for step in sorted(plan, key=lambda s: s["file_seq"]):
        if step["file_seq"] <= seq:
            now, was = tuple(step["now"]), tuple(step["was"])
            first = to.pop(was, None)
            if first is None:  # inside an object that itself was renamed or moved
                cut = next((k for k in range(len(was) - 1, 0, -1) if was[:k] in to), 0)
                first = (*to[was[:cut]], *was[cut:]) if cut else was
            to[now] = first
    return to


def consistent_table(exports: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Every row of every file in one table. The renamings and moves of a feed, at every depth, are compiled into one
    projection per file from the places in force there to the feed's first places; ``columns`` (name -> type; a
    dot leads into an object) become columns, other top-level members stay in the map ``extra``; a record counts once.

    A value that doesn't fit its column's type is null in the column and kept in ``extra``; a value in a
    wrapping of one member or entry fills the column, and the wrapping is kept in ``extra``."""
    scripts = edit_scripts(exports, gaps=True).filter(F.col("change_kind").isin("renamed", "moved") & ~F.array_contains("field_path", "[]"))
    # per feed: its changes in order (schema-sized); replayed on the row's own file number
    plan = scripts.groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("file_seq", F.col("field_path").alias("now"), F.col("old_path").alias("was")))).alias("plan"))
    rows = exports.groupBy("export_id").agg(F.max_by(F.struct("feed", "file_seq", "payload"), "written_at").alias("r")).select("export_id", "r.feed", "r.file_seq", "r.payload")
    joined = rows.join(plan, "feed", "left").select("export_id", "feed", "file_seq", "payload", "plan")
    names = {n: tuple(n.split(".")) for n in columns}
    shown = lambda x: None if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, dict] = {}
        paths = set(names.values())
        for batch in batches:
            ids, feeds, seqs, texts, plans = (batch.column(i) for i in range(5))
            cols: dict[str, list] = {n: [] for n in names}
            extra, kept = [], []
            for i, (feed, seq, text) in enumerate(zip(feeds.to_pylist(), seqs.to_pylist(), texts.to_pylist())):
                v = _object(text)
                if v is None:
                    continue
                to = known.get((feed, seq))
                if to is None:
                    to = known[feed, seq] = _first_paths(plans[i].as_py() or [], seq)
                flat = _placed(v, to)
                rest = []
                for n, path in names.items():
                    x = flat.get(path)
                    cols[n].append(shown(_plain(x)))
                    if isinstance(x, (dict, list)) and len(x) == 1:
                        rest.append((n, shown(x)))
                for k, x in v.items():
                    place = to.get((k,), (k,))
                    if place not in paths:
                        rest.append((".".join(place), shown(x)))
                extra.append(rest)
                kept.append(i)
            take = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(take), feeds.take(take), seqs.take(take), *(pa.array(cols[n], pa.string()) for n in names), pa.array(extra, pa.map_(pa.string(), pa.string()))],
                names=["export_id", "feed", "file_seq", *names, "extra"],
            )

    out = joined.mapInArrow(run, "export_id bigint, feed string, file_seq int" + "".join(f", `{n}` string" for n in names) + ", extra map<string,string>")
    col = lambda n: F.col(f"`{n}`")
    unfit = F.map_from_entries(
        F.array_compact(
            F.array(*(F.when(col(n).isNotNull() & col(n).try_cast(t).isNull() & ~F.map_contains_key("extra", n), F.struct(F.lit(n).alias("key"), col(n).alias("value"))) for n, t in columns.items()))
        )
    )
    return out.select("export_id", "feed", "file_seq", *(col(n).try_cast(t).alias(n) for n, t in columns.items()), F.map_concat("extra", unfit).alias("extra"))

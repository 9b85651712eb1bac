"""The general data-pipeline operators against brute force."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strophe.operators import drift, merkle, runs, shred
from strophe.plans import problem_sql, problems

# ------------------------------------------------------------------ shredding


def brute_children(payloads):
    """Straight recursive reading of the statement."""

    def value(v):
        if isinstance(v, str) and v.lstrip()[:1] in "[{" and v.strip():
            try:
                return json.loads(v)
            except ValueError:
                return v
        return v

    def listed(v):
        v = value(v)
        return [] if v is None else v if isinstance(v, list) else [v]

    def find(v):
        level = [v]
        while level:
            nxt = []
            for x in level:
                if isinstance(x, dict):
                    if "lines" in x:
                        return x
                    nxt += x.values()
                elif isinstance(x, list):
                    nxt += x
            level = nxt
        return None

    out = set()
    for key, text in payloads:
        try:
            art = find(shred.strict_json(text)) if text is not None else None
        except ValueError:
            continue
        for i, line in enumerate(listed(art["lines"]) if art else []):
            if line is None:
                continue
            out.add((key, i, "line", -1, -1))
            if not isinstance(line, dict):
                continue
            mora = listed(line.get("mora"))
            for member, name, link in (("mora", "mora", None), ("tokens", "token", None), ("surface_spans", "span", "span_mora"), ("display_units", "unit", "unit_mora")):
                for p, x in enumerate(listed(line.get(member))):
                    if x is None:
                        continue
                    out.add((key, i, name, p, -1))
                    if isinstance(x, dict) and name == "mora":
                        out |= {(key, i, "char", c, p) for c, y in enumerate(listed(x.get("chars"))) if y is not None}
                    if isinstance(x, dict) and link:
                        out |= {(key, i, link, m, p) for m in listed(x.get("mora_indices")) if isinstance(m, int) and 0 <= m < len(mora) and mora[m] is not None}
    return out


ODD = [
    '{"lines":[{"mora":[{"chars":[{"a":1},null,{"a":2}]},null],"surface_spans":{"mora_indices":0},"display_units":[null,{"mora_indices":[0,1,7,-1,null,0]}]}]}',
    '{"data":{"x":[{"lines":{"tokens":"[{\\"t\\":1}]","mora":"{\\"chars\\":\\"[1,2]\\"}"}}]}}',
    '{"lines":[null,{"mora":"plain"},5]}', '{"lines":null}', '{"lines":[', None, "null", "[]", "3", '{"x":1}', '{"lines":[{"mora":[]}]}', "", '{"lines":[{"x":NaN}]}',
]


def test_children_equal_brute_force(spark, small):
    raw = spark.read.parquet(f"{small}/artifact_raw.parquet")
    odd = spark.createDataFrame([(10_000_000 + i, p) for i, p in enumerate(ODD)], "artifact_id bigint, payload string")
    both = raw.select("artifact_id", "written_at", "payload").unionByName(odd.withColumn("written_at", F.lit("2024-01-01").cast("timestamp_ntz")))
    rows = both.collect()
    got = [tuple(r) for r in shred.artifact_children(both).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_children([(r.artifact_id, r.payload) for r in rows])


def test_adjacency_round_trip(spark):
    docs = ['{"a":[1,{"b":null,"c":"x"},[]],"d":{},"e":true,"f":1.5}', "[]", None, "{broken", '"text"']
    df = spark.createDataFrame(list(enumerate(docs)), "k int, p string")
    rows = shred.adjacency(df, "k", "p").collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc, []).append(r)
    assert set(by) == {0, 1}

    def build(nodes, n):
        me = next(r for r in nodes if r.node == n)
        kids = sorted((r for r in nodes if r.parent == n), key=lambda r: r.ordinal)
        if me.kind == "object":
            return {r.label: build(nodes, r.node) for r in kids}
        if me.kind == "array":
            return [build(nodes, r.node) for r in kids]
        return None if me.kind == "null" else me.scalar if me.scalar in ("x",) else json.loads(me.scalar)

    for k in by:
        assert build(by[k], 0) == json.loads(docs[k])


def test_entity_table_has_scalars_and_clashing_columns(spark):
    p = '{"lines":[{"text":"a","start_ms":5,"mora":[{"text":"x","chars":[{"text":"q"}]}]},{"start_ms":"7"}]}'
    raw = spark.createDataFrame([(1, p, 9, "z")], "artifact_id bigint, payload string, pos int, child string").withColumn("written_at", F.lit(None).cast("timestamp_ntz"))
    lines = shred.entity_table(raw, "line", {"text": "string", "start_ms": "bigint"}).orderBy("line_pos").collect()
    assert [(r.line_pos, r.text, r.start_ms) for r in lines] == [(0, "a", 5), (1, None, 7)]
    chars = shred.entity_table(raw, "char", {"text": "string"}).collect()
    assert [(r.line_pos, r.pos, r.parent_pos, r.text) for r in chars] == [(0, 0, 0, "q")]
    assert shred.artifact_children(raw.limit(0)).count() == 0


# ------------------------------------------------------------------ increments


def test_changed_directories_equal_sql(spark, small):
    c = duckdb.connect()
    for t in ("artifact_log", "pipeline_runs"):
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    want = {r[0] for r in c.execute(problem_sql.P3_FOUND).fetchall()}
    assert {r.song_dir for r in problems.p3_found(spark, small).collect()} == want


LOG = "log_id bigint, song_dir string, written_at timestamp_ntz, arrived_at timestamp_ntz, inputs struct<audio:struct<path:string,sha256:string>,lyrics_timeline:struct<path:string,sha256:string>,config_sha256:string>, stages map<string,struct<status:string,signature:string>>"


def test_spellings_status_and_unfinished(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    row = lambda i, s, w, a, h, st: (i, s, t(w), t(a), (("p", h), ("p", "0a"), None), {"reading": st})
    log = spark.createDataFrame(
        [
            row(1, "same", 1, 1, "AB01", ("done", "s")), row(2, "same", 2, 9, " sha256:ab01", ("error", "s")),
            row(3, "hash", 1, 1, "ab", ("done", "s")), row(4, "hash", 2, 9, "ac", ("done", "s")),
            row(5, "null", 1, 1, None, ("done", "s")), row(6, "null", 2, 9, "ac", ("done", "s")),
            row(7, "open", 1, 1, "ab", ("pending", None)), row(8, "new", 1, 9, "ab", ("done", "s")),
            row(9, "late", 3, 1, "ab", ("done", "s")), row(10, "late", 2, 9, "zz", ("done", "s")), row(11, "sig", 1, 1, "ab", ("skipped", "s")), row(12, "sig", 2, 9, "ab", ("skipped", None)),
        ],
        LOG,
    )
    runs_ = spark.createDataFrame([(1, t(5), "ok", "normal"), (2, t(20), "ok", "dry"), (3, t(21), "failed", "normal")], "run_id bigint, started_at timestamp_ntz, run_status string, run_mode string")
    assert {r.song_dir for r in merkle.changed_directories(log, runs_).collect()} == {"hash", "null", "open", "new", "sig"}
    assert {r.song_dir for r in merkle.changed_directories(log, runs_.limit(0)).collect()} == {"same", "hash", "null", "open", "new", "late", "sig"}
    assert merkle.changed_directories(log.limit(0), runs_).count() == 0


def found(df):
    return {tuple(r) for r in df.select("key", "change").collect()}


def test_store_publishes_output_and_tree_together(spark, tmp_path):
    store = merkle.MerkleStore(spark, f"file://{tmp_path}/store")
    table = lambda rows: spark.createDataFrame(rows, "key string, state bigint").withColumn("done", F.col("state"))
    first = table([("a", 1), ("b", 2), ("c", 3), (None, 9)])
    assert found(store.diff(first)) == {("a", "added"), ("b", "added"), ("c", "added"), (None, "added")}
    store.publish(first, first, "key")
    assert store.diff(first).count() == 0
    second = table([("a", 1), ("b", 5), ("d", 4), (None, 9)])
    want = {("b", "changed"), ("c", "removed"), ("d", "added")}
    assert found(store.diff(second)) == want
    # a run that dies after writing its files but before the rename changes nothing
    second.write.parquet(f"file://{tmp_path}/store/v=dead/leaves/upper=1")
    again = merkle.MerkleStore(spark, f"file://{tmp_path}/store")
    assert found(again.diff(second)) == want
    # only the ranges of changed keys are written again
    keys = [k for k, _ in want]
    uppers = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "key string").select(merkle._range(F.col("key"), merkle.UPPER)).distinct().collect()]
    version = again.publish(second, second, "key", uppers)
    assert again.diff(second).count() == 0 and {r.key for r in again.output().collect()} == {"a", "b", "d", None}
    assert {v for u, v in again.manifest()["parts"].items() if int(u) in uppers} == {version} and version not in {v for u, v in again.manifest()["parts"].items() if int(u) not in uppers}
    empty = merkle.MerkleStore(spark, f"file://{tmp_path}/empty")
    empty.publish(first.limit(0), first.limit(0), "key")
    assert empty.diff(first.limit(0)).count() == 0 and empty.diff(first).count() == 4


def test_files_read_grow_with_the_changes(spark, tmp_path):
    store = merkle.MerkleStore(spark, f"file://{tmp_path}/store")
    version = F.struct(F.lit(1).alias("t"))
    leaves = spark.range(300).select(F.concat(F.lit("k"), "id").alias("key"), version.alias("version"), F.xxhash64("id").alias("state")).withColumn("done", F.col("state"))
    store.publish(leaves, leaves, "key")
    newer = F.struct(F.lit(2).alias("t"))
    some = lambda n: leaves.filter(F.substring("key", 2, 9).cast("int") < n).select("key", newer.alias("version"), (F.col("state") + 1).alias("state"))
    read = {}
    for n in (0, 1, 4):
        fresh = some(n)
        visit = fresh.select(merkle._range(F.col("key"), merkle.UPPER).alias("upper"), merkle._range(F.col("key"), merkle.LOWER).alias("lower")).distinct()
        read[n] = len(store.leaves(leaves, visit).inputFiles()) if n else 0
        assert {r.key for r in store.changed_since(fresh).collect()} == {f"k{i}" for i in range(n)}
    assert read[1] < read[4] < len(store._stored("leaves").inputFiles())
    # older rows and rows without news change nothing
    old = leaves.limit(5).select("key", F.struct(F.lit(0).alias("t")).alias("version"), F.lit(7).cast("bigint").alias("state"))
    assert store.changed_since(old).count() == 0 and store.changed_since(leaves.select("key", newer.alias("version"), "state")).count() == 0


def test_child_tables_have_the_children_found(spark, small):
    """Every child that p1_found lists is a row of its kind's flat table, and no other."""
    want = problems.p1_found(spark, small).cache()
    for kind, name in (("mora", "p1_mora"), ("token", "p1_tokens"), ("span", "p1_spans"), ("unit", "p1_units"), ("char", "p1_chars")):
        keys = ["artifact_id", "line_pos", "pos"] + (["parent_pos"] if kind == "char" else [])
        got = problems.QUERIES[name](spark, small).select(*keys)
        listed = want.filter(F.col("child") == kind).select(*keys)
        assert listed.exceptAll(got).count() == got.exceptAll(listed).count() == 0, kind


# ------------------------------------------------------------------ drift


def exports(spark, files):
    rows, i = [], 0
    for (feed, seq), docs in files.items():
        for d in docs:
            i += 1
            rows.append((i, feed, seq, json.dumps(d) if not isinstance(d, str) and d is not None else d))
    return spark.createDataFrame(rows, "export_id bigint, feed string, file_seq int, payload string").withColumn("written_at", F.lit("2024-01-01").cast("timestamp_ntz"))


def test_changes_of_each_kind(spark):
    words = ["ctc", "fallback", "activity"]
    old = [{"start_ms": i * 100, "alignment_status": words[i % 3], "coverage": 0.5, "n": i, "gone": "x", "mix": i} for i in range(20)]
    new = [{"begin_ms": i * 110, "alignmentStatus": words[i % 3], "coverage": "0.5", "n": i + 0.5, "fresh": [1], "mix": None} for i in range(20)]
    df = exports(spark, {("f", 0): [*old, "{broken", None, "[1]"], ("f", 1): new, ("f", 3): old, ("g", 1): new})
    got = {tuple(r) for r in drift.top_level_changes(df).collect()}
    assert got == {
        ("f", 1, "renamed", "begin_ms", "start_ms"), ("f", 1, "renamed", "alignmentStatus", "alignment_status"), ("f", 1, "retyped", "coverage", ""),
        ("f", 1, "retyped", "n", ""), ("f", 1, "removed", "gone", ""), ("f", 1, "added", "fresh", ""),
    }
    assert {tuple(r) for r in drift.top_level_changes(df.unionAll(df)).collect()} == got
    assert drift.top_level_changes(df.limit(0)).count() == 0


def test_members_side_by_side_are_no_renaming(spark):
    a = [{"method": w} for w in ("x", "y", "z")]
    b = [{"backend": w} for w in ("x", "y", "z")]
    assert {r.change_kind for r in drift.top_level_changes(exports(spark, {("f", 0): a, ("f", 1): b})).collect()} == {"renamed"}
    both = [{"method": "x", "backend": "y"}]
    assert {r.change_kind for r in drift.top_level_changes(exports(spark, {("f", 0): a, ("f", 1): b, ("g", 0): both})).collect()} == {"added", "removed"}


def test_assignment_is_optimal():
    import itertools

    rng = random.Random(4)
    for _ in range(60):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        costs = [[round(rng.random() * 3, 2) for _ in range(m)] for _ in range(n)]
        got = sum(costs[i][j] for i, j in drift.assign(costs, 2.0)) + (min(n, m) - len(drift.assign(costs, 2.0))) * 2.0
        k = min(n, m)
        best = min(sum(min(2.0, costs[i][j]) for i, j in zip(rows, cols)) for rows in itertools.permutations(range(n), k) for cols in itertools.permutations(range(m), k))
        assert got == pytest.approx(best)


def test_nested_moves(spark):
    profile = lambda path, types=2, lo=0.0, hi=9.0: {"path": path, "name": path[-1], "types": types, "n": 5, "num": 1.0 if types == 2 else 0.0, "frac": 0.0, "lo": lo, "hi": hi, "sketch": [1, 2, 3], "distinct": 3}
    old = [profile(("w",), 32), profile(("w", "start"))]
    new = [profile(("w",), 32), profile(("start",))]
    assert [(s["kind"], s["path"], s["old"]) for s in drift.edit_script(old, new)] == [("moved", ("start",), ("w", "start"))]


def brute_distance(old, new):
    """The least cost over all one-to-one mappings of the members that don't stand in both trees."""
    trees = drift._Trees(old, new, frozenset())
    inner = [{k[:-1] for k in (*trees.old, *trees.new)}] * 2

    def go(i, used, pairs):
        if i == len(trees.gone):
            objects = {a: b for a, b in pairs if a in inner[0] and b in inner[1]}
            cost = sum(min(2.0, trees.cost(trees.old[a], trees.new[b], objects)) if (a, b) not in objects.items() else trees.cost(trees.old[a], trees.new[b], objects) for a, b in pairs)
            return cost + drift.DELETE * (len(trees.gone) - len(pairs)) + drift.ADD * (len(trees.came) - len(pairs))
        best = go(i + 1, used, pairs)
        for f in trees.came:
            if f["path"] not in used:
                best = min(best, go(i + 1, used | {f["path"]}, [*pairs, (trees.gone[i]["path"], f["path"])]))
        return best

    return go(0, frozenset(), [])


def random_tree(rng):
    paths, names = set(), ["aa", "bb_aa", "cc", "dd", "ee_cc"]
    for _ in range(rng.randint(1, 4)):
        parent = rng.choice([(), *[q for q in paths if len(q) < 3]])
        paths.add((*parent, rng.choice(names)))
    inner = {q[:-1] for q in paths}
    profile = lambda q: {"path": q, "name": q[-1], "types": 32 if q in inner else rng.choice([1, 2]), "n": 5, "num": 0.0, "frac": 0.0, "lo": 0.0, "hi": 0.0, "sketch": rng.sample(range(6), 3), "distinct": 3}
    return [profile(q) for q in sorted(paths)]


@pytest.mark.parametrize("most", [drift.MOST_PAIRINGS, 0])
def test_edit_distance_is_minimal(monkeypatch, most):
    monkeypatch.setattr(drift, "MOST_PAIRINGS", most)
    rng, worse = random.Random(11), 0
    for _ in range(150):
        old, new = random_tree(rng), random_tree(rng)
        got, want = drift._Trees(old, new, frozenset()).solve()[0], brute_distance(old, new)
        assert got >= want - 1e-9
        worse += got > want + 1e-9
    assert worse == 0 if most else worse <= 8


def test_arrays_and_objects_are_descended(spark):
    old = [{"box": {"start": i, "word": f"w{i}"}, "rows": [{"note": f"n{i}"}]} for i in range(9)]
    new = [{"frame": {"start": i, "word": f"w{i}"}, "rows": [{"notes": f"n{i}"}]} for i in range(9)]
    moved = [{"start": i, "frame": {"word": f"w{i}"}, "rows": [{"notes": f"n{i}"}]} for i in range(9)]
    df = exports(spark, {("f", 0): old, ("f", 1): new, ("f", 3): moved})
    got = {(r.file_seq, r.change_kind, tuple(r.field_path), tuple(r.old_path)) for r in drift.edit_scripts(df, gaps=True).collect()}
    assert got == {(1, "renamed", ("frame",), ("box",)), (1, "renamed", ("rows", "[]", "notes"), ("rows", "[]", "note")), (3, "moved", ("start",), ("frame", "start"))}
    table = drift.consistent_table(df, {"box.start": "bigint", "box.word": "string"}).orderBy("export_id").collect()
    assert [(r["box.start"], r["box.word"]) for r in table] == [(i, f"w{i}") for i in range(9)] * 3


def test_wrappings_are_kept(spark):
    df = exports(spark, {("f", 0): [{"a": 5}, {"a": {"v": 6}}, {"a": [7]}, {"a": [1, 2]}]})
    got = [(r.a, dict(r.extra)) for r in drift.consistent_table(df, {"a": "bigint"}).orderBy("export_id").collect()]
    assert got == [(5, {}), (6, {"a": '{"v": 6}'}), (7, {"a": "[7]"}), (None, {"a": "[1, 2]"})]


def test_one_consistent_table(spark):
    old = [{"song_dir": "d", "start_ms": i * 10, "status": "ctc"} for i in range(5)]
    new = [{"song_dir": "d", "startMs": str(i * 10), "status": "ctc", "extra_one": 1} for i in range(5)]
    odd = [{"song_dir": "d", "startMs": "?", "status": None, "extra_one": 2}]
    got = drift.consistent_table(exports(spark, {("f", 0): old, ("f", 1): new + odd}), {"song_dir": "string", "start_ms": "bigint"}).orderBy("export_id").collect()
    assert [r.start_ms for r in got] == [0, 10, 20, 30, 40] * 2 + [None]
    assert got[-1].extra["start_ms"] == "?" and got[5].extra["extra_one"] == "1"


# ------------------------------------------------------------------ periods


def brute_periods(rows):
    by = {}
    for k, s, e in rows:
        if s is not None and e is not None and s < e:
            by.setdefault(k, []).append((s, e))
    out = set()
    for k, spans in by.items():
        spans.sort()
        merged = [list(spans[0])]
        for s, e in spans[1:]:
            if s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {(k, "period", s, e) for s, e in merged} | {(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


@pytest.mark.parametrize("seed,scale", [(1, 300), (2, 70_000), (3, 400_000), (4, 5_000_000)])
def test_periods_equal_brute_force(spark, seed, scale):
    rng = random.Random(seed)
    rows = []
    for k in range(6):
        for _ in range(rng.randint(1, 40)):
            s = rng.randint(-scale, scale)
            rows.append((k, s, s + rng.choice([rng.randint(-5, 60), rng.randint(0, scale // 3), 65_536, 131_072])))
    rows += [(7, None, 5), (7, 5, None), (7, 5, 5), (8, 65_536, 131_072), (8, 131_072, 131_073), (9, 0, 10**12), (9, 10**12 + 1, 10**12 + 2), (None, 1, 2)]
    rows += rows[:5]
    got = [tuple(r) for r in runs.periods_and_gaps(spark.createDataFrame(rows, "k int, start_ms bigint, end_ms bigint"), ["k"]).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_periods(rows)


def test_line_periods_equal_sql(spark, small):
    c = duckdb.connect()
    c.execute(f"create view alignment_lines as select * from '{small}/alignment_lines.parquet'")
    assert {tuple(r) for r in problems.p7_found(spark, small).collect()} == set(c.execute(problem_sql.P7_FOUND).fetchall())
    empty = spark.read.parquet(f"{small}/alignment_lines.parquet").limit(0)
    assert runs.line_periods(empty).count() == 0

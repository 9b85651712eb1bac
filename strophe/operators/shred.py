"""Shredding of deeply nested JSON into an adjacency table and into flat entity tables.

Every value of a document becomes one row *(node, parent, label, ordinal, scalar)*: objects and
arrays are inner nodes, scalars are leaves, an array entry has no label and counts from 0.
A document's nodes stand together, so joining an object node with its scalar children is a
join on node numbers inside one Arrow batch: only finished entity rows leave the Python worker
and the (large) adjacency table itself is never shuffled.

Defined results: null, broken and non-container payloads give no nodes; null array entries keep
their position but give no entity row; a value that stands alone where an array is expected is
its only entry, and a string that holds JSON text of an array or object is read as that value;
artifacts delivered again count once (the latest delivery wins per line and child kind).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NULL, SCALAR, OBJECT, ARRAY = 0, 1, 2, 3

#: Child arrays of a line, and the entity name of their entries.
LINE_CHILDREN = {"mora": "mora", "tokens": "token", "surface_spans": "span", "display_units": "unit"}
#: Arrays of references to a sibling by position: owner entity -> entity name of the link.
LINKS = {"surface_spans": "span_mora", "display_units": "unit_mora"}
#: Members that hold arrays; a lone value there is the only entry.
ARRAY_MEMBERS = frozenset([*LINE_CHILDREN, "lines", "chars", "mora_indices"])

ADJACENCY = "node int, parent int, label string, ordinal int, kind string, scalar string"
KINDS = {NULL: "null", SCALAR: "scalar", OBJECT: "object", ARRAY: "array"}


class Nodes:
    """A growing adjacency table of one Arrow batch; ``root`` numbers the batch's documents."""

    __slots__ = ("root", "parent", "label", "ordinal", "kind", "scalar")

    def __init__(self) -> None:
        self.root: list[int] = []
        self.parent: list[int] = []
        self.label: list[str | None] = []
        self.ordinal: list[int] = []
        self.kind: list[int] = []
        self.scalar: list[object] = []

    def add(self, root: int, parent: int, label: str | None, ordinal: int, kind: int, scalar: object = None) -> int:
        self.root.append(root)
        self.parent.append(parent)
        self.label.append(label)
        self.ordinal.append(ordinal)
        self.kind.append(kind)
        self.scalar.append(scalar)
        return len(self.parent) - 1


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


#: JSON as the standard has it, without NaN and infinities.
strict_json = json.JSONDecoder(parse_constant=_no_constant).decode


def _embedded(value: object) -> object:
    """A string that is itself JSON text of an array or object, read as that."""
    if isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        try:
            return strict_json(value)
        except ValueError:
            return value
    return value


def shred_value(out: Nodes, root: int, value: object, arrays: frozenset[str] = frozenset(), keep: frozenset[str] | None = None) -> None:
    """Append the nodes of one document. ``arrays``: members always read as arrays.
    ``keep``: the labels that are stored (column pruning); None stores every member."""
    add = out.add
    stack: list[tuple[object, int, str | None, int]] = [(value, -1, None, 0)]
    while stack:
        v, parent, label, ordinal = stack.pop()
        if label in arrays and v is not None:
            v = _embedded(v)
            if not isinstance(v, list):
                v = [v]
        if isinstance(v, dict):
            me = add(root, parent, label, ordinal, OBJECT)
            for i, (k, x) in enumerate(v.items()):
                if keep is None or k in keep:
                    stack.append((x, me, k, i))
        elif isinstance(v, list):
            me = add(root, parent, label, ordinal, ARRAY)
            for i, x in enumerate(v):
                if x.__class__ is int:
                    add(root, me, None, i, SCALAR, x)
                elif x is not None or keep is None:
                    stack.append((x, me, None, i))
        elif v is None:
            add(root, parent, label, ordinal, NULL)
        else:
            add(root, parent, label, ordinal, SCALAR, v)


def find_artifact(value: object) -> dict | None:
    """The outermost object with a member ``lines``, wherever it stands (breadth first)."""
    level = [value]
    while level:
        below: list[object] = []
        for v in level:
            if isinstance(v, dict):
                if "lines" in v:
                    return v
                below.extend(v.values())
            elif isinstance(v, list):
                below.extend(v)
        level = [v for v in below if isinstance(v, (dict, list))]
    return None


def _parse(payload: str | None) -> object:
    if payload is None:
        return None
    try:
        return strict_json(payload)
    except (ValueError, RecursionError):
        return None


def adjacency(df: DataFrame, key: str, payload: str) -> DataFrame:
    """The full adjacency table of a column of JSON documents: key and the columns of ADJACENCY."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for start in range(0, len(texts), 64):
                out = Nodes()
                base: list[int] = []
                for i in range(start, min(start + 64, len(texts))):
                    base.append(len(out.parent))
                    value = _parse(texts[i])
                    if isinstance(value, (dict, list)):
                        shred_value(out, i, value)
                first = np.array(base, "int64")
                root = np.array(out.root, "int64")
                shift = first[root - start] if len(root) else root
                parent = np.array(out.parent, "int64")
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(root, pa.int64())),
                        pa.array(np.arange(len(root)) - shift, pa.int32()),
                        pa.array(np.where(parent < 0, -1, parent - shift), pa.int32()),
                        pa.array(out.label, pa.string()),
                        pa.array(out.ordinal, pa.int32()),
                        pa.array([KINDS[k] for k in out.kind], pa.string()),
                        pa.array([None if k != SCALAR else s if isinstance(s, str) else json.dumps(s) for k, s in zip(out.kind, out.scalar)], pa.string()),
                    ],
                    names=["doc", "node", "parent", "label", "ordinal", "kind", "scalar"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(payload)).mapInArrow(run, f"doc {kind}, {ADJACENCY}")


def _index(value: object) -> int:
    """A mora position as it may be spelled; -1 when it is none."""
    if isinstance(value, bool):
        return -1
    if isinstance(value, int):
        return value if 0 <= value < 2**31 else -1
    if isinstance(value, float) and value.is_integer():
        return _index(int(value))
    if isinstance(value, str) and value.strip().isdecimal():
        return _index(int(value))
    return -1


def _entities(out: Nodes) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Joins entry nodes with their array and owner nodes: entity -> (root, line, line position, pos, parent_pos)."""
    parent = np.array(out.parent, "int64")
    n = len(parent)
    names = {x: i for i, x in enumerate(dict.fromkeys([None, *ARRAY_MEMBERS]))}
    label = np.fromiter((names.get(x, -1) for x in out.label), "int16", n)
    ordinal = np.array(out.ordinal, "int64")
    kind = np.array(out.kind, "int8")
    root = np.array(out.root, "int64")
    up = np.where(parent < 0, 0, parent)
    holder = label[up]  # the label of the array that an entry stands in
    owner = up[up]  # the object that has that array
    entry = np.nonzero((label == names[None]) & (parent >= 0) & (kind[up] == ARRAY) & (kind != NULL))[0]
    found = {}
    hold = holder[entry]
    lines = entry[hold == names["lines"]]
    found["line"] = (root[lines], lines, ordinal[lines], np.full(len(lines), -1), np.full(len(lines), -1))
    mora_keys = np.empty(0, "int64")
    for member, name in LINE_CHILDREN.items():
        e = entry[hold == names[member]]
        line = owner[e]
        e, line = e[holder[line] == names["lines"]], line[holder[line] == names["lines"]]
        found[name] = (root[e], line, ordinal[line], ordinal[e], np.full(len(e), -1))
        if name == "mora":
            mora_keys = line * 2**31 + ordinal[e]
    e = entry[hold == names["chars"]]
    mora = owner[e]
    line = owner[mora]
    found["char"] = (root[e], line, ordinal[line], ordinal[e], ordinal[mora])
    e = entry[(hold == names["mora_indices"]) & (kind[entry] == SCALAR)]
    value = np.fromiter((_index(out.scalar[i]) for i in e), "int64", len(e))
    for member, name in LINKS.items():
        has = holder[owner[e]] == names[member]
        x, at = e[has], value[has]
        line = owner[owner[x]]
        ok = (at >= 0) & np.isin(line * 2**31 + at, mora_keys)
        found[name] = (root[x][ok], line[ok], ordinal[line[ok]], at[ok], ordinal[owner[x]][ok])
    return found


def _packed(batches: Iterable[pa.RecordBatch], docs: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, times, texts = batch.column(0), batch.column(1), batch.column(2)
        for start in range(0, batch.num_rows, docs):
            out = Nodes()
            for i in range(start, min(start + docs, batch.num_rows)):
                value = _parse(texts[i].as_py())
                artifact = find_artifact(value) if value is not None else None
                if artifact is not None:
                    shred_value(out, i, {"lines": artifact["lines"]}, ARRAY_MEMBERS, ARRAY_MEMBERS)
            for name, (root, line, line_pos, pos, parent_pos) in _entities(out).items():
                if not len(root):
                    continue
                order = np.lexsort((pos, parent_pos, line))
                root, line, line_pos, pos, parent_pos = (a[order] for a in (root, line, line_pos, pos, parent_pos))
                fresh = np.r_[True, (line[1:] != line[:-1]) | (pos[1:] != pos[:-1]) | (parent_pos[1:] != parent_pos[:-1])]
                root, line, line_pos, pos, parent_pos = (a[fresh] for a in (root, line, line_pos, pos, parent_pos))
                first = np.nonzero(np.r_[True, line[1:] != line[:-1]])[0]
                offsets = pa.array(np.r_[first, len(line)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(root[first], pa.int64())),
                        times.take(pa.array(root[first], pa.int64())),
                        pa.array(line_pos[first], pa.int32()),
                        pa.array([name] * len(first), pa.string()),
                        pa.ListArray.from_arrays(offsets, pa.array(pos, pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(parent_pos, pa.int32())),
                    ],
                    names=["artifact_id", "written_at", "line_pos", "child", "pos", "parent_pos"],
                )


def artifact_children(raw: DataFrame, docs_per_step: int = 16) -> DataFrame:
    """Lines and all their children, every child naming its parent:
    (artifact_id, line_pos, child, pos, parent_pos).

    The positions of one line's children travel packed in two arrays, so what is shuffled to
    count repeated deliveries once is a row per line and child kind, not one per child.
    """
    packed = raw.select(
        F.col("artifact_id").cast("bigint").alias("artifact_id"), F.col("written_at").cast("timestamp_ntz").alias("written_at"), F.col("payload").cast("string").alias("payload")
    ).mapInArrow(
        lambda it: _packed(it, docs_per_step),
        "artifact_id bigint, written_at timestamp_ntz, line_pos int, child string, pos array<int>, parent_pos array<int>",
    )
    once = packed.groupBy("artifact_id", "line_pos", "child").agg(
        F.max_by(F.struct("pos", "parent_pos"), F.struct(F.coalesce("written_at", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")), "pos", "parent_pos")).alias("p")
    )
    return once.select("artifact_id", "line_pos", "child", F.inline(F.arrays_zip(F.col("p.pos").alias("pos"), F.col("p.parent_pos").alias("parent_pos"))))


def _scalar(value: object) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def entity_table(raw: DataFrame, entity: str, fields: dict[str, str]) -> DataFrame:
    """One entity kind as a flat table: its keys and the scalar children named in ``fields``
    (name -> Spark type), pivoted from the adjacency table; a missing scalar is null.

    Lines have (artifact_id, line_pos), their children also pos, ``char`` also parent_pos.
    """
    member = {v: k for k, v in LINE_CHILDREN.items()} | {"line": "lines", "char": "chars"}
    path = {"line": ["lines"], "char": ["lines", "mora", "chars"]}.get(entity) or ["lines", member[entity]]
    keep = ARRAY_MEMBERS | frozenset(fields)
    names = list(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, times, texts = batch.column(0), batch.column(1), batch.column(2)
            for start in range(0, batch.num_rows, 16):
                out = Nodes()
                for i in range(start, min(start + 16, batch.num_rows)):
                    value = _parse(texts[i].as_py())
                    artifact = find_artifact(value) if value is not None else None
                    if artifact is not None:
                        shred_value(out, i, {"lines": artifact["lines"]}, frozenset(path), keep)
                ents = _entity_nodes(out, path)
                if not len(ents):
                    continue
                parent, ordinal, root = np.array(out.parent, "int64"), np.array(out.ordinal, "int64"), np.array(out.root, "int64")
                at = {int(e): i for i, e in enumerate(ents)}
                cols: dict[str, list[str | None]] = {n: [None] * len(ents) for n in names}
                for i, (p, lab, kind) in enumerate(zip(out.parent, out.label, out.kind)):
                    if lab in cols and kind == SCALAR and (j := at.get(p)) is not None:
                        cols[lab][j] = _scalar(out.scalar[i])
                up2 = parent[parent[ents]]  # owner object
                minus = np.full(len(ents), -1)
                line = ents if entity == "line" else up2 if entity != "char" else parent[parent[up2]]
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(root[ents], pa.int64())),
                        times.take(pa.array(root[ents], pa.int64())),
                        pa.array(ordinal[line], pa.int32()),
                        pa.array(minus if entity == "line" else ordinal[ents], pa.int32()),
                        pa.array(ordinal[up2] if entity == "char" else minus, pa.int32()),
                        *(pa.array(cols[n], pa.string()) for n in names),
                    ],
                    names=["artifact_id", "written_at", "line_pos", "pos", "parent_pos", *names],
                )

    flat = raw.select(F.col("artifact_id").cast("bigint").alias("artifact_id"), F.col("written_at").cast("timestamp_ntz").alias("written_at"), F.col("payload").cast("string").alias("payload")).mapInArrow(
        run, "artifact_id bigint, written_at timestamp_ntz, line_pos int, pos int, parent_pos int" + "".join(f", `{n}` string" for n in names)
    )
    once = flat.groupBy("artifact_id", "line_pos", "pos", "parent_pos").agg(F.max_by(F.struct(*names), F.coalesce("written_at", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz"))).alias("v"))
    return once.select("artifact_id", "line_pos", "pos", "parent_pos", *(F.col(f"v.{n}").try_cast(t).alias(n) for n, t in fields.items()))


def _entity_nodes(out: Nodes, path: list[str]) -> np.ndarray:
    """The non-null entries of the arrays at a path of members."""
    ok: list[int] = []
    depth: dict[int, int] = {}  # array node -> depth in path it stands for
    entry: dict[int, int] = {}
    for i, (p, lab, kind) in enumerate(zip(out.parent, out.label, out.kind)):
        if lab is None:
            if p < 0:
                entry[i] = 0
            elif p in depth and kind != NULL:
                entry[i] = depth[p] + 1
                if depth[p] + 1 == len(path):
                    ok.append(i)
        elif p in entry and entry[p] < len(path) and lab == path[entry[p]] and kind == ARRAY:
            depth[i] = entry[p]
    return np.array(ok, "int64")

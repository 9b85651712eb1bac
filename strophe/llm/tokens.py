"""Encoding of a corpus with a public byte-level BPE vocabulary.

Every text is cut into overlapping chunks. Each chunk is split into pre-tokens as if the text began
with it; the split pattern looks ahead but never back, so from the first boundary that two
neighbouring chunks share in their overlap (they resynchronise there) both go on alike: the left
chunk counts up to it, the right one from it. Two chunks that share none become one of double
size. The pre-tokens between these points are encoded and their ids put together. A text of more than ``SEGMENT``
characters is first cut the same way into overlapping segments that different tasks split, so no
task works through a very long text alone.

Defined results: a null and an empty text have the ids ``EMPTY`` (an empty list); strings of
special tokens in a text are ordinary text; decoding concatenates the raw bytes of the ids.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophe.session import cut_lineage

#: The split pattern of the vocabulary (a fixed value, described with the vocabulary files).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = os.environ.get("STROPHE_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
EMPTY: list[int] = []
#: Characters of a chunk, and by how many it reaches into the next.
CHUNK, OVERLAP = 1_000, 100
#: Chunks of a segment, and its overlap in characters.
SEGMENT, SEGMENT_OVERLAP = 1_000_000, 2_000
#: Pre-tokens whose ids a worker keeps.
KEPT = 200_000


@lru_cache(4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def encoding(path: str = VOCABULARY):
    import tiktoken

    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def encode(text: str | None, path: str = VOCABULARY) -> list[int]:
    return encoding(path).encode_ordinary(text) if text else list(EMPTY)


def decode(ids: Iterable[int], path: str = VOCABULARY) -> str:
    known = _bytes_of(path)
    return b"".join(known[i] for i in ids).decode("utf-8")


@lru_cache(4)
def _bytes_of(path: str) -> dict[int, bytes]:
    return {i: b for b, i in _ranks(path).items()}


def _ends(parts: list[str], start: int) -> np.ndarray:
    return start + np.cumsum(np.fromiter(map(len, parts), "int64", len(parts)))


def meeting(left: np.ndarray, right: np.ndarray, limit: int) -> int:
    """The first boundary that both chunks have, before ``limit``, where the left one was cut; -1 if they share none."""
    common = np.intersect1d(left[left < limit], right, assume_unique=True)
    return int(common[0]) if len(common) else -1


def pre_tokens(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[list[str], int]:
    """(pre-tokens of the text, chunks that were put together), by overlapping chunks."""
    split, n = _pattern().findall, len(text)
    out: list[str] = []
    # the chunk at hand: where its pre-tokens count from, its pre-tokens, their ends, and where it was cut
    begin, width = 0, chunk
    cut = min(n, begin + width + overlap)
    left = split(text[:cut])
    ends, joined = _ends(left, 0), 1
    while cut < n:
        start = begin + width
        stop = min(n, start + chunk + overlap)
        right = split(text[start:stop])
        right_ends = _ends(right, start)
        at = meeting(ends, right_ends, cut)
        if at < 0:  # nowhere in step: both become one chunk, of twice the size so that long runs stay linear
            width *= 2
            cut = min(n, begin + width + overlap)
            left = split(text[begin:cut])
            ends = _ends(left, begin)
            continue
        out += left[: int(np.searchsorted(ends, at)) + 1]
        k = int(np.searchsorted(right_ends, at)) + 1
        left, ends = right[k:], right_ends[k:]
        begin, width, cut, joined = at, max(1, start + chunk - at), stop, joined + 1
    return out + left, joined


class Encoder:
    """Ids of texts by their pre-tokens; those of recent pre-tokens are kept."""

    def __init__(self, path: str = VOCABULARY) -> None:
        self._encode, self._known = encoding(path).encode_ordinary, {}

    def ids(self, parts: Iterable[str]) -> list[int]:
        known, out = self._known, []
        for p in parts:
            got = known.get(p)
            if got is None:
                if len(known) >= KEPT:
                    known.clear()
                got = known[p] = self._encode(p)
            out += got
        return out

    def __call__(self, text: str | None, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
        return self.ids(pre_tokens(text, chunk, overlap)[0]) if text else list(EMPTY)


@lru_cache(2)
def encoder(path: str = VOCABULARY) -> Encoder:
    return Encoder(path)


def _encode_batches(path: str, chunk: int, overlap: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids = [enc(t, chunk, overlap) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], names=[*part.schema.names[:-1], "ids"])

    return run


def _split_batches(segment: int, overlap: int, chunk: int, chunk_overlap: int):
    """Boundaries of segments inside their overlaps, counted from where the next segment begins. None stands after a
    blank: how blanks are split depends on what follows, which a piece doesn't have."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for i, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ends = _ends(pre_tokens(t, chunk, chunk_overlap)[0], 0)
                ends = ends[[not t[e - 1].isspace() for e in ends]]
                heads.append(ends[ends < overlap].tolist() if i else [0])
                tails.append((ends[(ends >= segment) & (ends < len(t))] - segment).tolist() if len(t) > segment else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], names=[*batch.schema.names, "heads", "tails"])

    return run


def token_ids(
    df: DataFrame, key: str, text: str, path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, segment: int = SEGMENT, segment_overlap: int = SEGMENT_OVERLAP
) -> DataFrame:
    """(key, ids): one row for every row, whatever the length of its text."""
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    encode = _encode_batches(path, chunk, overlap)
    longest = rows.agg(F.max(F.length("text"))).first()[0] or 0
    if longest <= segment + segment_overlap:
        return rows.mapInArrow(encode, f"key {kind}, ids array<int>").select(F.col("key").alias(key), "ids")

    long = F.coalesce(F.length("text") > segment + segment_overlap, F.lit(False))
    short_ids = rows.filter(~long).mapInArrow(encode, f"key {kind}, ids array<int>")
    big = cut_lineage(rows.filter(long).withColumn("doc", F.monotonically_increasing_id()))  # the numbers must not be drawn again
    n = F.ceil(F.length("text") / segment).cast("int")
    cut = big.select("doc", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("text").substr(i * segment + 1, F.lit(segment + segment_overlap)))).alias("i", "part"))
    split = cut.mapInArrow(_split_batches(segment, segment_overlap, chunk, overlap), "doc bigint, i int, part string, heads array<int>, tails array<int>")
    order = Window.partitionBy("doc").orderBy("i")
    meet = split.withColumn("last", F.lead("i").over(order).isNull()).withColumn("end", F.array_min(F.array_intersect("tails", F.lead("heads").over(order))))
    meet = meet.withColumn("apart", ~F.col("last") & F.col("end").isNull())
    # after two segments that share no boundary nothing is in step any more: the rest of the text is one piece
    lost = F.max("apart").over(order.rowsBetween(Window.unboundedPreceding, -1))
    meet = meet.withColumn("begin", F.when(F.coalesce(lost, F.lit(False)), -1).otherwise(F.coalesce(F.lag("end").over(order), F.lit(0))))
    meet = meet.withColumn("piece", F.sum((F.col("begin") >= 0).cast("int")).over(order))
    inner = F.when(F.col("begin") < 0, F.lit(0)).otherwise(F.col("begin"))
    stop = F.when(F.col("last"), F.length("part")).when(F.col("apart") | (F.col("begin") < 0), F.lit(segment)).otherwise(F.col("end") + segment)
    own = meet.select("doc", "piece", "i", F.col("part").substr(inner + 1, stop - inner).alias("t"))
    pieces = own.groupBy("doc", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "").alias("text"))
    encoded = pieces.mapInArrow(encode, "doc bigint, piece bigint, ids array<int>")
    joined = encoded.groupBy("doc").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    long_ids = big.select("key", "doc").join(joined, "doc").select("key", "ids")
    return short_ids.unionAll(long_ids).select(F.col("key").alias(key), "ids")

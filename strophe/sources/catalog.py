"""Catalogs of song directories: metadata.json, lyrics_timeline.json and one audio file each."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophe.operators import signal

ROW = "struct<text:string,start_ms:string,end_ms:string,romanization:string>"
METADATA = "id bigint, name string, artist string, album string, duration_ms bigint"


def song_id(path: Column) -> Column:
    """The directory that a file of a song stands in."""
    return F.element_at(F.split(F.url_decode(path), "/"), -2)


def whole_number(c: Column) -> Column:
    """A time as it may be written: missing and empty are 0, fractions are cut off, anything else is null."""
    return F.when(c.isNull() | (c == ""), F.lit(0)).otherwise(F.regexp_replace(c, r"^(-?\d+)\.\d+$", "$1").try_cast("bigint")).cast("bigint")


def timeline(spark: SparkSession, root: str) -> DataFrame:
    """(song_id, source_index, text, start_ms, end_ms, romanization) of every entry of every timeline, in file order."""
    raw = spark.read.text(f"{root}/*/lyrics_timeline.json", wholetext=True).select(song_id(F.input_file_name()).alias("song_id"), "value")
    rows = raw.select("song_id", F.posexplode(F.from_json("value", f"array<{ROW}>")).alias("source_index", "r"))
    return rows.select("song_id", "source_index", F.col("r.text").alias("text"), whole_number(F.col("r.start_ms")).alias("start_ms"), whole_number(F.col("r.end_ms")).alias("end_ms"), F.col("r.romanization").alias("romanization"))


def metadata(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.text(f"{root}/*/metadata.json", wholetext=True)
    return raw.select(song_id(F.input_file_name()).alias("song_id"), F.from_json("value", METADATA).alias("m")).select("song_id", "m.*")


def audio(spark: SparkSession, root: str) -> DataFrame:
    """(song_id, path, sha256, content): the first audio file by name of each song; unfinished downloads don't count."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "audio.*").load(f"{root}/*").filter(~F.col("path").endswith(".part"))
    w = Window.partitionBy("song_id").orderBy("path")
    first = files.select(song_id(F.col("path")).alias("song_id"), "path", "content").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return first.select("song_id", "path", F.sha2("content", 256).alias("sha256"), "content")


def input_errors(spark: SparkSession, root: str) -> DataFrame:
    """(song_id, problem): what keeps a directory from being processed; all violations, not the first."""
    times = timeline(spark, root)
    raw = spark.read.text(f"{root}/*/lyrics_timeline.json", wholetext=True).select(song_id(F.input_file_name()).alias("song_id"), F.trim("value").alias("value"))
    meta = spark.read.text(f"{root}/*/metadata.json", wholetext=True).select(song_id(F.input_file_name()).alias("song_id"), F.trim("value").alias("value"))
    files = spark.read.format("binaryFile").load(f"{root}/*").select(song_id(F.col("path")).alias("song_id"), F.element_at(F.split("path", "/"), -1).alias("file"))
    has = files.groupBy("song_id").agg(
        F.max(F.col("file") == "metadata.json").alias("m"), F.max(F.col("file") == "lyrics_timeline.json").alias("t"), F.max(F.col("file").startswith("audio.") & ~F.col("file").endswith(".part")).alias("a")
    )
    missing = has.select("song_id", F.explode(F.array_compact(F.array(F.when(~F.col("m"), "no metadata"), F.when(~F.col("t"), "no timeline"), F.when(~F.col("a"), "no audio")))).alias("problem"))
    shape = lambda df, kind, what: df.filter(~F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith(kind), F.lit(False))).select("song_id", F.lit(what).alias("problem"))
    w = Window.partitionBy("song_id").orderBy("source_index")
    s, e = F.col("start_ms"), F.col("end_ms")
    checks = F.array_compact(F.array(F.when(s.isNull() | e.isNull(), "invalid times"), F.when((s < 0) | (e < s), "invalid interval"), F.when(s < F.col("_before"), "not sorted")))
    bad = times.withColumn("_before", F.lag("start_ms").over(w)).withColumn("problem", F.explode(checks)).select("song_id", "problem")
    return missing.unionAll(shape(raw, "ARRAY", "timeline is no array of objects")).unionAll(shape(meta, "OBJECT", "metadata is no object")).unionAll(bad).distinct()


def wav_frames(files: DataFrame, hop_ms: int, window_ms: int) -> DataFrame:
    """RMS frames (song_id, frame_idx, t_ms, rms) of WAV files (song_id, content), mixed down to one channel.

    A file is decoded in its own task in blocks, so its samples never become rows."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for song, content in zip(pdf["song_id"], pdf["content"]):
                rate, pcm = read_wav(content)
                hop = max(1, rate * hop_ms // 1000)
                size = max(hop, rate * window_ms // 1000)
                for first, chunk in signal.chunk_pcm(pcm, rate, hop_ms, window_ms):
                    x = np.asarray(chunk, "float64")
                    n = 1 + (len(x) - size) // hop if len(x) >= size else 0
                    if n:
                        energy = np.concatenate([[0.0], np.cumsum(x * x)])
                        at, idx = np.arange(n) * hop, first // hop + np.arange(n)
                        yield pd.DataFrame({"song_id": song, "frame_idx": idx, "t_ms": (idx * hop + size / 2) * 1000.0 / rate, "rms": np.sqrt(np.maximum(energy[at + size] - energy[at], 0) / size + signal.TINY)})

    return files.select("song_id", "content").mapInPandas(run, "song_id string, frame_idx bigint, t_ms double, rms double")


def read_wav(content: bytes) -> tuple[int, np.ndarray]:
    """(rate, samples in [-1, 1]) of 8, 16, 24 or 32 bit PCM."""
    with wave.open(io.BytesIO(content)) as f:
        width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
        data = f.readframes(f.getnframes())
    if width == 3:  # the three bytes as the upper ones of four
        raw = np.frombuffer(data, "uint8").reshape(-1, 3)
        x = (np.c_[np.zeros(len(raw), "uint8"), raw].view("<i4").ravel() >> 8).astype("float32")
    else:
        x = np.frombuffer(data, {1: "uint8", 2: "<i2", 4: "<i4"}[width]).astype("float32")
    x = (x - 128) / 128 if width == 1 else x / float(1 << (8 * width - 1))
    return rate, x.reshape(-1, channels).mean(axis=1)


def exports(df: DataFrame, path: str, kind: str = "json") -> None:
    """Write a result; the committer makes it visible only when it is whole. CSV has nested values as JSON."""
    if kind == "csv":
        nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("struct", "array", "map")}
        df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns]).write.mode("overwrite").option("header", True).csv(path)
    else:
        getattr(df.write.mode("overwrite"), kind)(path)


def artifacts(lines: DataFrame, key: str, order: str) -> DataFrame:
    """(key, artifact): the lines of a song as one JSON document, in order."""
    body = F.struct(*[c for c in [order, *(x for x in lines.columns if x not in (key, order))]])
    return lines.groupBy(key).agg(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.array_sort(F.collect_list(body)).alias("lines"))).alias("artifact"))


def load_artifacts(spark: SparkSession, path: str, line_schema: str) -> DataFrame:
    """(song_id, schema_version, lines) of artifact files; broken files and other versions are left out."""
    raw = spark.read.text(path, wholetext=True).select(song_id(F.input_file_name()).alias("song_id"), F.from_json("value", f"schema_version int, lines array<struct<{line_schema}>>").alias("a"))
    return raw.filter("a.schema_version = 1 and a.lines is not null").select("song_id", "a.*")

"""The text queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import garbled, langid, lookalike, mixing, subjects, tokens
from strophe.session import table

GARBLED_FIELDS = (("lyrics_timeline", "text", "line_id"), ("song_metadata", "name", "meta_id"), ("song_metadata", "artist", "meta_id"))


def _garbled(spark: SparkSession, sf: str) -> DataFrame:
    fields = [(table(spark, sf, t), t, f, k) for t, f, k in GARBLED_FIELDS]
    model = garbled.fit(spark, [(df, k, f) for df, _, f, k in fields], garbled.SAMPLE)
    parts = [garbled.damage(df, k, f, model).select(F.lit(t).alias("tbl"), F.lit(f).alias("fld"), F.col("key").cast("bigint").alias("rec_id"), "text", "restored") for df, t, f, k in fields]
    return reduce(DataFrame.unionAll, parts)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _garbled(spark, sf).select("tbl", "fld", "rec_id").distinct()


def p5_restored(spark: SparkSession, sf: str) -> DataFrame:
    """Damaged values with their restored form, null where nothing could be put right."""
    return _garbled(spark, sf).select("tbl", "fld", "rec_id", F.when(F.col("restored") != F.col("text"), F.col("restored")).alias("restored")).distinct()


LABELLED = (("documents", "doc_id", "text", "lang"), ("lyrics_timeline", "line_id", "text", "lang"), ("alignment_lines", "line_key", "reading", "reading_lang"))


def _stretches(spark: SparkSession, sf: str) -> list[tuple[str, DataFrame]]:
    tables = [(table(spark, sf, t), t, k, x, label) for t, k, x, label in LABELLED]
    filters = langid.train(spark, [(df, k, x, label) for df, _, k, x, label in tables])
    lines = tables[1][0]
    repair = garbled.repairer(spark, garbled.fit(spark, [(lines, "line_id", "text")]))
    return [(t, langid.languages(df, k, x, label, filters, t == "documents", repair if t == "lyrics_timeline" else None)) for df, t, k, x, label in tables]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [langid.mislabelled(found).select(F.lit(t).alias("tbl"), "rec_id", "seg", "lang") for t, found in _stretches(spark, sf)]
    return reduce(DataFrame.unionAll, parts)


def p2_stretches(spark: SparkSession, sf: str) -> DataFrame:
    """Language and confidence of every stretch of every text with words."""
    parts = [found.select(F.lit(t).alias("tbl"), F.col("key").alias("rec_id"), "seg", "lang", F.round("confidence", 4).alias("confidence")) for t, found in _stretches(spark, sf)]
    return reduce(DataFrame.unionAll, parts).distinct()


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    lyrics = table(spark, sf, "lyrics_timeline")
    damaged = garbled.damage_test(spark, garbled.fit(spark, [(lyrics, "line_id", "text")]))
    pairs = lookalike.twins(lyrics, "song_dir", "line_id", "text", damaged)
    spans = lookalike.false_surfaces(table(spark, sf, "alignment_lines"))
    return pairs.select(F.lit("lyrics_timeline").alias("tbl"), "key_a", "key_b").unionAll(spans.select(F.lit("alignment_lines").alias("tbl"), F.col("line_key").alias("key_a"), F.col("pos").alias("key_b")))


def p6_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every lyric line in its consistent form."""
    return lookalike.forms(table(spark, sf, "lyrics_timeline"), ["line_id"], "text").select("line_id", "form").distinct()


def p6_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every lyric line with the smallest line_id of its song directory that looks the same."""
    return lookalike.classes(table(spark, sf, "lyrics_timeline"), "song_dir", "line_id", "text").select("line_id", "class_key")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_ids(table(spark, sf, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, sf, "documents"), "doc_id", "source", "text", table(spark, sf, "mix_targets"))


def p9_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Copies of every document used in the mix."""
    return _mix(spark, sf)[0].select("doc_id", "source", "tokens", "copies")


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares reached."""
    return _mix(spark, sf)[1]


def _about(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    filters = langid.train(spark, [(documents, "doc_id", "text", "lang", langid.SAMPLE_DOCUMENTS)])
    labels = table(spark, sf, "subject_labels").select(F.col("doc_id").cast("bigint").alias("key"), "subject")
    return subjects.about(documents, "doc_id", "text", labels, table(spark, sf, "subjects"), filters)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return _about(spark, sf).select(F.col("key").alias("doc_id"), "subject")


def p10_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and sentences of each subject in each source."""
    documents = table(spark, sf, "documents").select("doc_id", mixing.source_name(F.col("source")).alias("source"))
    found = _about(spark, sf).join(documents, F.col("key") == F.col("doc_id"))
    return found.groupBy("source", "subject").agg(F.count("*").alias("documents"), F.sum("sentences").alias("sentences"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_stretches, p5_found, p5_restored, p6_found, p6_forms, p6_classes, p8_ids, p9_copies, p9_shares, p10_found, p10_composition)}
SQL: dict[str, str] = {}

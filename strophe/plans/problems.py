"""The general data-pipeline queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strophe.operators import drift, merkle, runs, shred
from strophe.session import table

LINE_FIELDS = {"source_index": "int", "text": "string", "reading": "string", "start_ms": "bigint", "end_ms": "bigint", "status": "string", "timing_source": "string", "alignment_status": "string"}
EXPORT_COLUMNS = {
    "song_dir": "string", "source_index": "int", "schema_version": "double", "start_ms": "bigint", "end_ms": "bigint", "timing_source": "string",
    "alignment_status": "string", "status": "string", "method": "string", "coverage": "double", "ctc_score": "double",
}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return shred.artifact_children(table(spark, sf, "artifact_raw"))


def p1_lines(spark: SparkSession, sf: str) -> DataFrame:
    return shred.entity_table(table(spark, sf, "artifact_raw"), "line", LINE_FIELDS).drop("pos", "parent_pos")


def p1_mora(spark: SparkSession, sf: str) -> DataFrame:
    return shred.entity_table(table(spark, sf, "artifact_raw"), "mora", {"text": "string", "start_ms": "bigint", "end_ms": "bigint", "method": "string", "frame_confidence": "double"}).drop("parent_pos")


def p1_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return shred.entity_table(table(spark, sf, "artifact_raw"), "token", {"text": "string", "start_ms": "bigint", "end_ms": "bigint", "source_unit": "string", "frame_confidence": "double"}).drop("parent_pos")


def p1_spans(spark: SparkSession, sf: str) -> DataFrame:
    fields = {"surface": "string", "surface_start": "int", "surface_end": "int", "reading": "string", "reading_start": "int", "reading_end": "int", "mapping_confidence": "string", "alignment_reading": "string"}
    return shred.entity_table(table(spark, sf, "artifact_raw"), "span", fields).drop("parent_pos")


def p1_units(spark: SparkSession, sf: str) -> DataFrame:
    return shred.entity_table(table(spark, sf, "artifact_raw"), "unit", {"text": "string", "surface_index": "int", "start_ms": "bigint", "end_ms": "bigint", "reading": "string", "romaji": "string"}).drop("parent_pos")


def p1_chars(spark: SparkSession, sf: str) -> DataFrame:
    return shred.entity_table(table(spark, sf, "artifact_raw"), "char", {"text": "string", "start_ms": "bigint", "end_ms": "bigint", "frame_confidence": "double"})


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.changed_directories(table(spark, sf, "artifact_log"), table(spark, sf, "pipeline_runs"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.top_level_changes(table(spark, sf, "line_exports"))


def p4_lines(spark: SparkSession, sf: str) -> DataFrame:
    return drift.consistent_table(table(spark, sf, "line_exports"), EXPORT_COLUMNS)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return runs.line_periods(table(spark, sf, "alignment_lines"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_lines, p1_mora, p1_tokens, p1_spans, p1_units, p1_chars, p3_found, p4_found, p4_lines, p7_found)}

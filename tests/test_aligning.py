"""The alignment of lines from emissions, its gate and its notes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.config import Config
from strophe.operators import offset, reading
from strophe.plans import aligning

VOCABULARY = {"_": 0, **{c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyz'")}}
SPANS = "array<struct<surface:string,surface_start:int,surface_end:int,reading:string,reading_start:int,reading_end:int,alignment_reading:string>>"


def logits(word, frames=3, lead=2):
    """Emissions that say a word: ``lead`` blanks, then some frames a letter."""
    said = [0] * lead + [VOCABULARY[c] for c in word for _ in range(frames)] + [0] * lead
    return [[12.0 if k == s else 0.0 for k in range(len(VOCABULARY))] for s in said]


def lines(spark):
    rows = [
        ("s", 0, "かさ", "かさ", "ctc", 0, 1000, None, None, None), ("s", 1, "かさ", "かさ", "x", 1000, 2000, 1100, 1900, 0.9), ("s", 2, "作詞：x", "", "non_sung", 0, 10, None, None, None),
        ("s", 3, "かさ", "かさ", "x", 2000, 3000, None, None, None), ("s", 4, "漢字", "漢字", "x", 3000, 4000, None, None, None), ("s", 5, "かさ", "かさ", "x", 4000, 4002, None, None, None),
    ]
    return spark.createDataFrame(rows, "song string, i int, text string, reading string, status string, start_ms bigint, end_ms bigint, singing_start_ms bigint, singing_end_ms bigint, activity_confidence double").withColumns(
        {"surface_spans": F.array().cast(SPANS), "warnings": F.array(F.lit("old")), "mora": F.lit(None).cast("array<struct<text:string,start_ms:bigint,end_ms:bigint>>")}
    )


def emissions(spark):
    good, wrong = logits("kasa"), logits("zzzz")
    rows = [("s", 0, good, 0.0, 16_000), ("s", 1, good, 980.0, 16_640), ("s", 3, wrong, 2000.0, 16_000), ("s", 4, good, 3000.0, 16_000), ("s", 5, good, 4000.0, 16_000)]
    return spark.createDataFrame(rows, "song string, i int, logits array<array<double>>, left_ms double, samples int")


def test_lines_are_aligned_and_gated(spark):
    got = {r.i: r for r in aligning.align_lines(lines(spark), emissions(spark), ["song", "i"], VOCABULARY, Config(ctc_model="given")).collect()}
    assert len(got) == 6
    first = got[0]
    assert first.alignment_status == "ctc" and first.timing_source == "ctc" and first.method == "demucs+ctc" and first.warnings == ["old"]
    assert [(m.text, m.start_ms, m.end_ms) for m in first.mora] == [("か", 125, 500), ("さ", 500, 875)] and [t.text for t in first.tokens] == list("kasa")
    assert first.coverage == 1 and first.ctc_window.source == "line_bounds" and got[1].ctc_window.source == "activity_bounds"
    assert (got[1].ctc_window.start_ms, got[1].ctc_window.end_ms) == (1000, 2000)
    assert got[2].alignment_status is None and got[2].mora is None and got[2].ctc_window is None
    assert got[3].alignment_status == "fallback" and aligning.GATE in got[3].warnings and got[3].mora is None
    assert aligning.NO_TARGET in got[4].warnings and got[4].ctc_score < -1e8
    assert got[5].alignment_status == "fallback" and all(4000 <= t.start_ms <= t.end_ms <= 4002 for t in got[5].tokens)
    none = {r.i: r for r in aligning.align_lines(lines(spark), emissions(spark).limit(0), ["song", "i"], VOCABULARY, Config(ctc_model="given")).collect()}
    assert all(aligning.NO_TARGET in none[i].warnings for i in (0, 1, 3, 4, 5))
    with pytest.raises(reading.StageUnavailable):
        aligning.align_lines(lines(spark), emissions(spark), ["song", "i"], {"a": 0}, Config(ctc_model="given"))


def test_one_bad_line_does_not_end_the_job(spark):
    bad = emissions(spark).withColumn("logits", F.when(F.col("i") == 0, F.array(F.array(F.lit(1.0)), F.array(F.lit(1.0)), F.array(F.lit(1.0)), F.array(F.lit(1.0)))).otherwise(F.col("logits")))
    got = {r.i: r for r in aligning.align_lines(lines(spark), bad, ["song", "i"], VOCABULARY, Config(ctc_model="given")).collect()}
    assert got[0].alignment_error and got[0].alignment_status == "fallback" and got[1].alignment_status == "ctc"


def test_redistribution_when_tokens_collapse():
    line = {"text": "かさ", "reading": "かさ", "surface_spans": [], "start_ms": 0, "end_ms": 60, "window_start": 0, "window_end": 60, "spread_start": 0, "spread_end": 60}
    x = np.array(logits("kasa", frames=1, lead=0))
    got = aligning.align_one(line, x, -600.0, 16_000, VOCABULARY, 0, Config(ctc_model="given"))
    assert got["alignment_status"] in ("ctc", "fallback") and all(0 <= t["start_ms"] <= t["end_ms"] <= 60 for t in got["tokens"])


def test_scores_of_shifts_and_their_verification(spark):
    good, wrong = logits("kasa"), logits("kazo")
    rows = [("s", i, o, "かさ", "かさ", good if o == 880 else wrong, 16_000) for i in range(3) for o in (880, 0, -1000)] + [("s", 9, 880, "漢", "漢", good, 16_000), ("s", 8, 880, "かさ", "かさ", good[:2], 16_000), ("s", 7, 880, "かさ", "かさ", None, 0)]
    seg = spark.createDataFrame(rows, "song string, line int, offset int, text string, reading string, logits array<array<double>>, samples int").withColumn("surface_spans", F.array().cast(SPANS))
    scores = aligning.emission_scores(seg, ["song", "line", "offset"], VOCABULARY, Config(ctc_model="given"))
    reasons = {r.line: r.reason for r in scores.filter("score is null").collect()}
    assert reasons == {9: "invalid_window_or_vocabulary", 8: "collapsed_raw_alignment", 7: "invalid_window_or_vocabulary"}
    proposal = spark.createDataFrame([("s", 880, "candidate")], "song string, offset_ms int, status string")
    r = offset.verify(scores.select("song", "line", "offset", "score"), proposal, ["song"]).first()
    assert (r.offset_ms, r.verification) == (880, "accepted")


def test_compared_offsets_keep_apart(spark):
    grid = spark.createDataFrame([("s", o, v) for o, v in ((880, 1.2), (840, 1.1), (-1000, 1.0), (0, 0.5), (200, 1.15))], "song string, offset int, score double")
    proposal = spark.createDataFrame([("s", 880), ("t", 0)], "song string, offset_ms int")
    assert {(r.song, r.offset) for r in offset.compared_offsets(grid, proposal, ["song"]).collect()} == {("s", 880), ("s", 0), ("s", -1000)}


def test_statuses_of_the_estimator(spark):
    scores = spark.createDataFrame([(s, o, 1.0 + (0.5 if o == 40 else 0.0)) for s in ("a", "b", "c") for o in (-80, -40, 0, 40, 80)], "song string, offset int, score double")
    found = spark.createDataFrame([("a", 0, 60, None), ("b", 100, 200, None), ("c", None, None, "no_explicit_lyric_gap")], "song string, low int, high int, reason string")
    songs = spark.createDataFrame([("a", 3, 9), ("b", 3, 9), ("c", 3, 9), ("d", 0, 9), ("e", 3, 0)], "song string, lines int, frames int")
    got = {r.song: (r.offset_ms, r.status, r.boundary_status) for r in offset.estimate(scores, ["song"], -80, 80, 30, found, songs=songs).collect()}
    assert got == {"a": (40, "candidate", "checked"), "b": (0, "uncertain", "conflicting_or_out_of_range_anchors"), "c": (40, "candidate", "no_reliable_anchors"), "d": (0, "no_lines", None), "e": (0, "no_activity", None)}
    assert offset.estimate(scores, ["song"], -80, 80, unchecked="no_vocal_stem").first().boundary_status == "no_vocal_stem"

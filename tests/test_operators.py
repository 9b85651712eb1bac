"""Timeline operators on small tables."""

import io
import json
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.config import Config
from strophe.functions import text as T
from strophe.operators import display, intervals, metrics, offset, reading, signal, stages
from strophe.sources import catalog


def test_text_functions(spark):
    words = ["きゃっと", "ラムネ", "まっちゃ 12ab", "ー", "っ", "あ・い", "", "夏だっ漢", "カ゛ャ", "ゔぁ", "っっか!", "っ・か", "っーあ"]
    df = spark.createDataFrame([(w,) for w in [*words, None]], "w string")
    rows = df.select("w", T.split_mora(F.col("w")).alias("m"), T.romaji(F.col("w")).alias("r"), T.kata_to_hira(F.col("w")).alias("h")).collect()
    for r in rows:
        if r.w is not None:
            assert list(r.m) == reading._MORA.findall(reading._DROP.sub("", r.w))
            assert r.r == reading.spell(r.w)
            assert r.h == reading.hira(r.w)
    assert reading.spell("まっちゃ") == "ma ccha" and reading.mora_ranges("きゃっと") == [(0, 2), (2, 3), (3, 4)]
    flags = spark.createDataFrame([("編曲：demo",), ("~music~",), ("music of mine",), ("　",), ("lyrics : x",)], "w string").select(T.non_sung(F.col("w")).alias("n"), T.is_blank(F.col("w")).alias("b")).collect()
    assert [(r.n, r.b) for r in flags] == [(True, False), (True, False), (False, False), (False, True), (True, False)]
    ruby = spark.createDataFrame([("漢字（かんじ）だ",), ("なし",)], "w string").select(T.ruby(F.col("w")).alias("r")).collect()
    assert [tuple(r.r) for r in ruby] == [("漢字だ", "かんじ"), ("なし", None)]


def test_split_rounds_half_even_and_covers(spark):
    df = spark.createDataFrame([(["a", "b", "c"], 0, 10), (["a"], 5, 5), ([], 0, 9), (None, 0, 9)], "v array<string>, s bigint, e bigint")
    rows = df.select(intervals.split(F.col("v"), F.col("s"), F.col("e")).alias("p")).collect()
    assert [(x.start_ms, x.end_ms) for x in rows[0].p] == [(0, 3), (3, 7), (7, 10)]
    assert rows[1].p == [] and rows[2].p == []


def test_shift_applies_once(spark):
    df = spark.createDataFrame([(1, 3000, 4000), (2, 100, 50)], "k int, start_ms bigint, end_ms bigint")
    once = intervals.shift(df, F.lit(-880))
    twice = intervals.shift(once, F.lit(-880))
    assert once.orderBy("k").collect() == twice.orderBy("k").collect()
    assert [(r.start_ms, r.end_ms) for r in once.orderBy("k").collect()] == [(2120, 3120), (0, 0)]


def test_overlap_groups_and_breaks(spark):
    rows = [(1, 0, 10), (2, 5, 8), (3, 9, 12), (4, 12, 20), (5, 15, 18)]
    df = spark.createDataFrame(rows, "i int, s bigint, e bigint").withColumn("k", F.lit(1))
    assert [r.grp for r in intervals.overlap_groups(df, ["k"], ["i"], "s", "e").orderBy("i").collect()] == [1, 1, 1, 2, 2]
    cut = intervals.overlap_groups(df, ["k"], ["i"], "s", "e", F.col("i") == 2).orderBy("i").collect()
    assert len({r.grp for r in cut[:3]}) == 3


def test_timing_policy(spark):
    base = {"text": "なつ", "reading": "なつ", "start_ms": 0, "end_ms": 1000, "singing_start_ms": 300, "singing_end_ms": 700, "activity_confidence": 0.8, "status": "interpolation", "alignment_status": "fallback", "timing_source": None, "warnings": [], "mora": None}
    schema = "text string, reading string, start_ms bigint, end_ms bigint, singing_start_ms bigint, singing_end_ms bigint, activity_confidence double, status string, alignment_status string, timing_source string, warnings array<string>, mora array<struct<text:string,start_ms:bigint,end_ms:bigint>>"
    anchored = [{"text": "x", "start_ms": 5, "end_ms": 9}]
    variants = [base, {**base, "activity_confidence": math.nan}, {**base, "alignment_status": "ctc", "mora": anchored}, {**base, "status": "non_sung"}, {**base, "reading": None}, {**base, "alignment_status": "ctc", "timing_source": "ctc_rescaled"}]
    df = spark.createDataFrame([tuple(v[k.split()[0]] for k in [c.strip() for c in schema.split(", ")]) for v in variants], schema)
    once = display.timing_policy(df)
    rows = once.collect()
    assert [r.timing_source for r in rows] == ["activity_interpolation", "line_interpolation", "ctc", "line_interpolation", "line_interpolation", "ctc_rescaled"]
    assert [(m.start_ms, m.end_ms) for m in rows[0].mora] == [(300, 500), (500, 700)]
    assert rows[1].warnings == ["activity endpoint unavailable; using line interpolation"]
    assert [tuple(m) for m in rows[2].mora] == [("x", 5, 9)]
    assert display.timing_policy(once).drop("activity_confidence").collect() == once.drop("activity_confidence").collect()


def brute_runs(values, low, high):
    on, out = 0, []
    for v in values:
        on = 1 if v >= high else 0 if v < low else on
        out.append(on)
    return out


def test_hysteresis_matches_a_loop(spark):
    v = np.random.default_rng(3).random(300)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "k int, i int, v double")
    got = [r.on for r in signal.hysteresis(df, ["k"], "i", F.col("v"), F.lit(0.3), F.lit(0.7)).orderBy("i").collect()]
    assert got == brute_runs(v, 0.3, 0.7)


@pytest.mark.parametrize("run", [1, 2, 3, 4, 5])
def test_erosion_matches_convolution(spark, run):
    flags = np.random.default_rng(run).integers(0, 2, 60)
    df = spark.createDataFrame([(1, i, int(x)) for i, x in enumerate(flags)], "k int, i int, f int")
    got = [r.sustained for r in signal.erode(df, ["k"], "i", "f", run).orderBy("i").collect()]
    assert got == (np.convolve(flags, np.ones(run, int), "same") >= run).astype(int).tolist()


def test_interpolation_matches_numpy(spark):
    y = np.random.default_rng(1).random(40)
    series = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(y)], "k int, frame_idx bigint, value double")
    at = [-30.0, 0.0, 15.0, 16.2, 200.7, 405.0, 9999.0]
    got = signal.interpolate(spark.createDataFrame([(1, a) for a in at], "k int, t double"), series, ["k"], "t", 15.0, 10.0).orderBy("t").collect()
    assert np.allclose([r.value for r in got], np.interp(at, 15 + 10 * np.arange(40), y))


def wav(samples, rate):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_frames_of_chunks_equal_frames_of_the_whole(spark):
    rate, hop, size = 1000, 10, 30
    x = np.random.default_rng(2).random(1234).astype("float32") - 0.5
    want = [math.sqrt(np.mean(x[i : i + size].astype("float64") ** 2) + 1e-12) for i in range(0, len(x) - size + 1, hop)]
    chunks = [("s", a, c) for a, c in signal.chunk_pcm(x, rate, 10, 30, frames_per_chunk=7)]
    got = signal.frames(spark.createDataFrame(chunks, "song_id string, first_sample bigint, pcm array<float>"), ["song_id"], rate, 10, 30).orderBy("frame_idx").collect()
    assert np.allclose([r.rms for r in got], want) and [r.t_ms for r in got[:2]] == [15.0, 25.0]


def series(spark, spans, total=24000, hop=10):
    t = np.arange(15, total, hop)
    v = np.full(len(t), 0.001)
    for a, b in spans:
        v[(t >= a) & (t < b)] = 1.0
    return spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(zip(t, v))], "song_id string, frame_idx bigint, t_ms double, rms double")


def anchors(spark, spans, lines):
    runs = offset.vocal_runs(series(spark, spans), ["song_id"], 10)
    table = spark.createDataFrame([("s", i, a, b) for i, (a, b) in enumerate(lines)], "song_id string, line_index int, start_ms bigint, end_ms bigint")
    return offset.anchors(runs, table, ["song_id"], -2000, 2000).orderBy("run").collect()


def test_anchors_golden(spark):
    got = anchors(spark, [(3800, 7000)], [(3510, 5355), (5355, 7205)])
    assert len(got) == 1 and got[0].line_index == 0 and got[0].low > -1680 and got[0].low <= 160 <= got[0].high
    got = anchors(spark, [(3000, 5000), (11000, 15000)], [(3000, 12000), (12000, 16000)])
    assert [(r.kind, r.reason) for r in got] == [("intro", None), ("interlude", "no_explicit_lyric_gap")]
    got = anchors(spark, [(3000, 5000), (12000, 15000)], [(3000, 5000), (12000, 15000)])
    assert [(r.kind, r.line_index) for r in got] == [("intro", 0), ("interlude", 1)]
    got = anchors(spark, [(3000, 5000), (12000, 15000)], [(3000, 5000), (12000, 13000), (13500, 15000)])
    assert [r.reason for r in got] == [None, "ambiguous_lyric_boundary"]
    got = anchors(spark, [(3000, 5000), (9000, 11000)], [(9000, 11000)])
    assert got[0].reason == "intro_not_near_first_lyric" and all(r.line_index is None for r in got[:1])
    got = anchors(spark, [(1000, 1100), (4000, 8000)], [(4000, 8000)])
    assert len(got) == 1 and 3950 <= got[0].onset <= 4050
    assert anchors(spark, [(0, 20000)], [(4000, 8000)]) == []


def test_grid_scores_match_numpy(spark):
    rng = np.random.default_rng(7)
    y = rng.random(2400)
    t = 15 + 10 * np.arange(2400)
    starts = [3000, 7000, 15000]
    sdf = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "song_id string, frame_idx bigint, value double")
    got = offset.grid_scores(spark.createDataFrame([("s", a) for a in starts], "song_id string, start_ms bigint"), sdf, ["song_id"], -200, 200, 40, 15.0, 10.0)
    f = lambda p: np.interp(np.array(starts) + p, t, y)
    for r in got.collect():
        c = (0.55 * f(r.offset + 100) + 0.25 * f(r.offset + 350) + 0.2 * f(r.offset)) / np.maximum(f(r.offset - 250), 1e-5)
        assert r.score == pytest.approx(float(np.mean(np.log1p(np.clip(c, 0, 20)))))


def test_verification(spark):
    scores = [("a", o, i, s) for o, row in ((880, [3.0, 3.0, 3.0]), (0, [1.0, 1.0, 2.95])) for i, s in enumerate(row)] + [("b", 880, 0, 1.0), ("b", 0, 0, 0.0), ("c", 880, 0, 1.0), ("c", 880, 1, 1.0), ("c", 0, 0, 1.0), ("c", 0, 1, 1.0)]
    df = spark.createDataFrame(scores, "k string, offset int, line int, score double")
    proposal = spark.createDataFrame([("a", 880, "candidate"), ("b", 880, "candidate"), ("c", 880, "candidate"), ("d", 0, "candidate")], "k string, offset_ms int, status string")
    got = {r.k: (r.offset_ms, r.verification) for r in offset.verify(df, proposal, ["k"]).collect()}
    assert got == {"a": (880, "accepted"), "b": (0, "rejected"), "c": (0, "rejected"), "d": (0, "not_needed")}


def test_config():
    for bad in (
        {"g2p_backend": "x"}, {"sample_rate": 0}, {"offset_step_ms": 0}, {"offset_low_ms": 1, "offset_high_ms": 0}, {"ctc_margin_ms": -1},
        {"ctc_coverage_threshold": 1.5}, {"ctc_score_threshold": math.nan}, {"vocals_format": "ogg"}, {"offset_acoustic_verify": True},
    ):
        with pytest.raises(ValueError):
            Config(**bad)
    assert Config().signature("reading") != Config(offset_step_ms=20).signature("reading")
    assert Config().signature("demucs") == Config(offset_step_ms=20).signature("demucs")


def test_stage_plan(spark):
    state = spark.createDataFrame(
        [("a", (("x",), ("y",)), {"reading": ("done", "1"), "ctc": ("done", "2")}), ("b", (("x",), ("y",)), {"reading": ("done", "1"), "ctc": ("error", "2")}), ("c", (("old",), ("y",)), {"reading": ("done", "1")})],
        "song_dir string, inputs struct<audio:struct<sha256:string>,lyrics_timeline:struct<sha256:string>>, stages map<string,struct<status:string,signature:string>>",
    )
    now = spark.createDataFrame([(s, "x", "y", {"reading": "1", "ctc": "2"}) for s in "abcd"], "song_dir string, audio_sha string, timeline_sha string, signatures map<string,string>")
    got = {r.song_dir: (r.hit, list(r.todo)) for r in stages.plan(state, now, ["reading", "ctc"]).collect()}
    assert got == {"a": (True, []), "b": (False, ["ctc"]), "c": (False, ["ctc", "reading"]), "d": (False, ["ctc", "reading"])}


def test_line_metrics_and_rollup(spark):
    rows = [("a", "夏", "なつ", "x", "fallback", 0.5, -2.5, []), ("a", "~music~", "", "non_sung", None, None, None, []), ("b", "summer", "さまー", "x", "ctc", 1.0, -1.0, [])]
    df = spark.createDataFrame(rows, "song string, text string, reading string, status string, alignment_status string, coverage double, ctc_score double, warnings array<string>")
    m = metrics.line_metrics(df)
    got = m.orderBy("song", "text").collect()
    assert list(next(r for r in got if r.text == "夏").fallback_reasons) == ["coverage_below_threshold", "ctc_score_below_threshold"]
    assert [r.fallback for r in got if r.text == "~music~"] == [False]
    total = metrics.rollup(m, ["song"]).filter("song is null").first()
    assert (total.lines, total.eligible, total.accepted, total.fallback, total.acceptance_rate) == (3, 2, 1, 1, 0.5)
    failed = metrics.line_metrics(df, stage_done=F.lit(False)).filter("fallback").first()
    assert list(failed.fallback_reasons) == ["ctc_stage_error_or_not_done"]


def test_vote(spark):
    rows = [(1, "sudachi", "なつ"), (1, "openjtalk", "ナツ"), (1, "pykakasi", "なつ"), (2, "sudachi", "なつ"), (2, "openjtalk", "か"), (2, "pykakasi", "か"), (3, "sudachi", "あ"), (3, "openjtalk", "い"), (3, "pykakasi", "う")]
    got = {r.k: (r.status, r.reading) for r in reading.vote(spark.createDataFrame(rows, "k int, b string, v string"), ["k"], "b", "v").collect()}
    assert got == {1: ("unanimous", "なつ"), 2: ("majority", "か"), 3: ("conflict", "あ")}


def test_lexicon_and_missing_backends(spark):
    lines = spark.createDataFrame([("夏は来ぬ",), (None,)], "text string")
    words = spark.createDataFrame([("夏", "ナツ", "noun"), ("は", "ハ", "particle"), ("来ぬ", "キヌ", "verb"), ("来", "ライ", "verb")], "surface string, reading string, pos string")
    got = reading.convert(lines, "lexicon", words).collect()
    assert got[0].reading == "なつはきぬ" and got[0].tokens[1].alignment_reading == "わ" and got[1].reading == ""
    with pytest.raises(reading.StageUnavailable):
        reading.convert(lines, "sudachi")
    with pytest.raises(ValueError):
        reading.convert(lines, "nothing")


def test_catalog_and_prepare(spark, tmp_path):
    from strophe.plans import prepare

    good = tmp_path / "a song"
    good.mkdir()
    (good / "metadata.json").write_text('{"id": 1, "name": "n"}')
    (good / "lyrics_timeline.json").write_text(json.dumps([{"text": "なつです", "start_ms": 100, "end_ms": 1100}, {"text": "編曲：demo", "start_ms": 1200, "end_ms": "1300"}, {"text": " ", "start_ms": 1300.7}, {"text": "い", "start_ms": 1400, "end_ms": 1400}]))
    (good / "audio.wav").write_bytes(wav(np.ones(1000) * 0.5, 1000))
    (good / "audio.mp3.part").write_bytes(b"x")
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "lyrics_timeline.json").write_text('{"a": 1}')
    rows = catalog.timeline(spark, str(tmp_path)).filter("song_id = 'a song'").orderBy("source_index").collect()
    assert [(r.source_index, r.start_ms, r.end_ms) for r in rows] == [(0, 100, 1100), (1, 1200, 1300), (2, 1300, 0), (3, 1400, 1400)]
    errors = {(r.song_id, r.problem) for r in catalog.input_errors(spark, str(tmp_path)).collect()}
    assert {("bad", "no metadata"), ("bad", "no audio"), ("bad", "timeline is no array of objects"), ("a song", "invalid interval")} <= errors
    sound = catalog.audio(spark, str(tmp_path)).collect()
    assert [(r.song_id, r.path.rsplit("/", 1)[1]) for r in sound] == [("a song", "audio.wav")]
    frames = catalog.wav_frames(catalog.audio(spark, str(tmp_path)), 50, 100).orderBy("frame_idx").collect()
    assert len(frames) == 19 and frames[0].rms == pytest.approx(0.5, abs=1e-3)
    lines = catalog.timeline(spark, str(tmp_path)).filter("song_id = 'a song'").select(F.col("source_index").cast("bigint").alias("line_id"), F.col("song_id").alias("song_dir"), "source_index", "text", "start_ms", "end_ms", F.lit(0).alias("loaded_at"))
    done = {r.line_id: r for r in prepare.prepare(lines, Config(g2p_backend="kana")).collect()}
    assert sorted(done) == [0, 1, 3] and done[1].status == "non_sung" and done[3].mora == []
    assert [u.text for u in done[0].display_units] == list("なつです") and len(done[0].mora) == 4
    catalog.exports(catalog.timeline(spark, str(tmp_path)), str(tmp_path / "out"), "csv")
    assert catalog.artifacts(spark.createDataFrame([("s", 1, "b"), ("s", 0, "a")], "k string, i int, t string"), "k", "i").first().artifact == '{"schema_version":1,"lines":[{"i":0,"t":"a"},{"i":1,"t":"b"}]}'


def test_voice_bounds(spark):
    lines = spark.createDataFrame([("s", 0, 1000, 5000), ("s", 1, 6000, 6100)], "song_id string, source_index int, start_ms bigint, end_ms bigint")
    frames = [("s", i, 1.0 if 40 <= i < 60 else 0.001) for i in range(200)]
    got = {r.source_index: r for r in signal.voice_bounds(lines, spark.createDataFrame(frames, "song_id string, frame_idx bigint, rms double"), ["song_id"], "source_index").collect()}
    assert (got[0].singing_start_ms, got[0].singing_end_ms) == (1970, 3070) and got[0].activity_confidence == pytest.approx(0.84, abs=0.05)
    assert got[1].singing_start_ms is None


def test_streaming(spark, tmp_path):
    from strophe.streaming import activity

    rows = [(1, f"2024-01-01 00:{m:02d}:00", 3.0) for m in (0, 5, 12, 50)]
    src = spark.createDataFrame(rows, "user_id int, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    for name, df in (("w", activity.sliding(stream, "ts", "user_id", "value")), ("s", activity.sessions(stream, "ts", "user_id"))):
        q = df.writeStream.outputMode("complete" if name == "w" else "append").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert all(r.rms == pytest.approx(3.0) for r in spark.table("w").collect()) and spark.table("w").count() > 0


def test_a_large_lexicon_is_joined_instead_of_sent(spark):
    lines = spark.createDataFrame([(1, "君は夏"), (2, ""), (3, None), (4, "君は夏")], "k int, text string")
    lexicon = spark.createDataFrame([("君", "キミ", "noun"), ("は", "ハ", "particle"), ("夏", "なつ", "noun"), ("夏", "なつ", "noun")], "surface string, reading string, pos string")
    sent = reading.convert(lines, "lexicon", lexicon).select("k", "reading", "tokens").collect()
    joined = reading.convert(lines, "lexicon", lexicon, most_sent=2).select("k", "reading", "tokens").collect()
    assert sorted(sent) == sorted(joined) and {r.k: r.reading for r in sent}[1] == "きみはなつ"
    assert [t.alignment_reading for t in sorted(sent)[0].tokens] == [None, "わ", None]


def test_playback_of_overlapping_units(spark):
    units = spark.createDataFrame([("a", 0, 0, 25_000), ("a", 1, 1_000, 2_000), ("a", 2, 30_000, 30_000), ("a", 3, None, 5)], "k string, surface_index int, start_ms bigint, end_ms bigint")
    times = spark.createDataFrame([("a", 0), ("a", 1_500), ("a", 24_999), ("a", 1_100), ("a", 1_101), ("b", 5), ("a", None)], "k string, t bigint")
    got = {(r.k, r.t): (r.current, r.previous, r.next) for r in display.playback(units, times, ["k"]).collect()}
    assert got[("a", 0)] == (0, None, 1) and got[("a", 1_500)] == (1, 1, 2) and got[("a", 24_999)] == (0, 1, 2)
    assert got[("a", 1_100)][1] == 0 and got[("a", 1_101)][1] == 1 and got[("b", 5)] == (None, None, None)

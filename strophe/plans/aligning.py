"""Alignment of whole catalogs: from lines and emissions to timed mora, with the gate and its notes.

An acoustic model's output is an input: one row of emissions per line (or line and shift). Lines meet
their emissions by an equi join, and everything after that stays on the line's own row in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophe.config import Config
from strophe.operators import align, reading

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Samples that a model needs at least (a fixed value).
RECEPTIVE = 400
NO_TARGET = "CTC empty target or audio shorter than model receptive field"
NO_EVIDENCE = "CTC global redistribution skipped: no positive acoustic token evidence"
NO_ROOM = "CTC global duration redistribution unavailable"
REDISTRIBUTED, REPAIRED = "CTC global duration redistribution applied", "CTC local span repair applied"
SILENT_MARK, GATE, COLLAPSED = "CTC zero-duration punctuation accepted", "CTC quality gate failed", "CTC produced zero-duration token; using interpolation"
TOKEN = "struct<text:string,source_reading_index:int,source_mora_indices:array<int>,source_unit:string,source_text:string,source_surface_start:int,source_surface_end:int,start_ms:bigint,end_ms:bigint,frame_confidence:double>"
MORA = "struct<text:string,start_ms:bigint,end_ms:bigint,source_mora_indices:array<int>,source_surface_start:int,source_surface_end:int,frame_confidence:double,chars:string>"
RESULT = f"alignment_status string, coverage double, ctc_score double, ctc_target string, tokens array<{TOKEN}>, ctc_mora array<{MORA}>, ctc_source string, notes array<string>, error string"


def check_vocabulary(vocabulary: dict[str, int], blank: int) -> None:
    if any(c not in vocabulary or vocabulary[c] == blank for c in LETTERS):
        raise reading.StageUnavailable("alignment needs a vocabulary of Latin letters and a blank of its own")


def _grouped(tokens: list[dict]) -> list[dict]:
    """Consecutive tokens of one unit as one mora."""
    out = []
    for _, same in groupby(tokens, key=lambda t: t["source_unit"]):
        g = list(same)
        out.append({
            "text": g[0]["source_text"], "start_ms": g[0]["start_ms"], "end_ms": g[-1]["end_ms"], "source_mora_indices": g[0]["source_mora_indices"], "source_surface_start": g[0]["source_surface_start"],
            "source_surface_end": g[0]["source_surface_end"], "frame_confidence": round(float(np.mean([t["frame_confidence"] for t in g])), 3), "chars": "".join(t["text"] for t in g),
        })
    return out


def align_one(line: dict, logits: np.ndarray | None, left: float, samples: int, vocabulary: dict[str, int], blank: int, config: Config) -> dict:
    """The alignment of one line whose emissions begin at ``left`` ms and stand for ``samples`` samples."""
    records, coverage, whole = reading.target(line["text"] or "", line["reading"] or "", line["surface_spans"], set(vocabulary))
    out = {"alignment_status": "fallback", "coverage": round(coverage, 3), "ctc_target": whole, "tokens": [], "ctc_mora": None, "ctc_source": None, "notes": [], "ctc_score": align.INFEASIBLE, "error": None}
    if logits is None or samples < RECEPTIVE or not records:
        return out | {"notes": [NO_TARGET]}
    labels = [vocabulary[r["text"]] for r in records]
    probs = align.log_softmax(logits) if len(logits) else logits
    frames, score = align.viterbi(probs, labels, blank)
    step = samples * 1000 / config.sample_rate / max(1, len(logits))
    at = np.clip(np.rint(left + np.array(frames, float).reshape(-1, 2) * step).astype("int64"), line["start_ms"], line["end_ms"])
    raw = [(int(a), max(int(a), int(b))) for a, b in at]
    sure = [round(float(probs[a:b, k].mean()), 3) if b > a else -99.0 for (a, b), k in zip(frames, labels)]
    spans, moved = align.repair(raw, line["window_start"], line["window_end"])
    letters = [r["text"] in LETTERS for r in records]
    lasting = lambda some: [b > a for (a, b), ok in zip(some, letters) if ok]
    good = coverage >= config.ctc_coverage_threshold and score >= config.ctc_score_threshold
    evidence, spread, notes = any(lasting(raw)), False, []
    if good and any(letters) and not evidence:
        notes.append(NO_EVIDENCE)
    elif good and any(letters) and not all(lasting(spans)):
        wide = align.redistribute(raw, line["spread_start"], line["spread_end"])
        if wide is not None and all(lasting(wide)):
            spans, spread = wide, True
        else:
            notes.append(NO_ROOM)
    tokens = [{**r, "start_ms": a, "end_ms": b, "frame_confidence": c} for r, (a, b), c in zip(records, spans, sure)]
    if good and evidence and any(letters) and all(lasting(spans)):
        notes += [REDISTRIBUTED] if spread else [REPAIRED] if moved else []
        notes += [SILENT_MARK] if any(not ok and b <= a for (a, b), ok in zip(spans, letters)) else []
        out |= {"alignment_status": "ctc", "ctc_mora": _grouped(tokens), "ctc_source": "ctc_rescaled" if spread else "ctc"}
    else:
        notes += [GATE] + ([COLLAPSED] if any(letters) and not all(lasting(spans)) else [])
    return out | {"tokens": tokens, "notes": notes, "ctc_score": round(score, 4)}


def align_lines(lines: DataFrame, emissions: DataFrame, keys: Sequence[str], vocabulary: dict[str, int], config: Config, blank: int = 0) -> DataFrame:
    """Lines with ``mora``, ``tokens``, ``alignment_status``, ``coverage``, ``ctc_score``, ``ctc_window``, ``timing_source``, ``method`` and new warnings.

    ``lines`` have text, reading, status, surface_spans, start_ms, end_ms, singing_start_ms, singing_end_ms, activity_confidence, mora and
    warnings; ``emissions`` (keys, logits, left_ms, samples) hold the model's output for the window of a line.
    Lines without a reading and non-sung lines pass unchanged. A line that fails says why in ``alignment_error`` and doesn't affect others."""
    check_vocabulary(vocabulary, blank)
    s, e, va, vb = (F.col(c) for c in ("start_ms", "end_ms", "singing_start_ms", "singing_end_ms"))
    bounded = F.coalesce((F.coalesce("activity_confidence", F.lit(0.0)) >= config.activity_confidence_threshold) & ~F.isnan(F.coalesce("activity_confidence", F.lit(0.0))) & (va < vb), F.lit(False))
    near = F.lit(config.ctc_activity_margin_ms)
    sought = lines.withColumns({
        "window_start": F.when(bounded, F.greatest(s, va - near)).otherwise(s), "window_end": F.when(bounded, F.least(e, vb + near)).otherwise(e),
        "spread_start": F.when(bounded, F.greatest(s, va)).otherwise(s), "spread_end": F.when(bounded, F.least(e, vb)).otherwise(e),
        "window_source": F.when(bounded, "activity_bounds").otherwise("line_bounds"), "_sung": F.coalesce(F.col("reading") != "", F.lit(False)) & F.coalesce(F.col("status") != "non_sung", F.lit(True)),
    })
    work = sought.filter("_sung").select(*keys, "text", "reading", "surface_spans", "start_ms", "end_ms", "window_start", "window_end", "spread_start", "spread_end")
    kinds = ", ".join(f"`{k}` {lines.schema[k].dataType.simpleString()}" for k in keys)
    names = [part.strip().split(" ", 1)[0] for part in ("alignment_status", "coverage", "ctc_score", "ctc_target", "tokens", "ctc_mora", "ctc_source", "notes", "error")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = []
            for row in pdf.to_dict("records"):
                try:
                    spans = row["surface_spans"]
                    row["surface_spans"] = [dict(x) for x in spans] if spans is not None else []
                    logits = row["logits"]
                    x = None if logits is None else np.array([np.asarray(r, "float64") for r in logits]).reshape(len(logits), -1)
                    got.append(align_one(row, x, float(row["left_ms"] or 0) if x is not None else 0.0, int(row["samples"] or 0) if x is not None else 0, vocabulary, blank, config))
                except Exception as err:  # one bad line must not end the job
                    got.append({"alignment_status": "fallback", "tokens": [], "notes": [GATE], "error": f"{type(err).__name__}: {err}"})
            out = pdf[list(keys)].copy()
            for n in names:
                out[n] = pd.Series([g.get(n) for g in got], index=out.index, dtype=object)
            for n in ("coverage", "ctc_score"):
                out[n] = out[n].astype("Float64")
            yield out

    met = work.join(emissions.select(*keys, "logits", "left_ms", "samples"), list(keys), "left")
    done = met.mapInPandas(run, f"{kinds}, {RESULT}").withColumnRenamed("error", "alignment_error")
    own = [c for c in lines.columns if c not in ("alignment_status", "coverage", "ctc_score", "tokens", "timing_source", "method", "warnings", "mora", "ctc_window")]
    every = sought.join(done.withColumnsRenamed({c: f"_{c}" for c in ("alignment_status", "coverage", "ctc_score", "tokens")}), list(keys), "left")
    was = lambda c, kind: F.col(c) if c in lines.columns else F.lit(None).cast(kind)
    ok = F.coalesce(F.col("_alignment_status") == "ctc", F.lit(False))
    plain = F.transform("ctc_mora", lambda m: F.struct(m["text"].alias("text"), m["start_ms"].alias("start_ms"), m["end_ms"].alias("end_ms")))
    return every.select(
        *own,
        F.when(ok, plain).otherwise(was("mora", "array<struct<text:string,start_ms:bigint,end_ms:bigint>>")).alias("mora"), F.when(ok, F.col("ctc_mora")).alias("aligned_mora"), F.col("_tokens").alias("tokens"),
        F.coalesce("_alignment_status", was("alignment_status", "string")).alias("alignment_status"), F.col("_coverage").alias("coverage"), F.col("_ctc_score").alias("ctc_score"),
        F.when(F.col("_sung"), F.struct(F.col("window_start").alias("start_ms"), F.col("window_end").alias("end_ms"), F.col("window_source").alias("source"), F.col("ctc_target").alias("target"))).alias("ctc_window"),
        F.when(ok, F.col("ctc_source")).otherwise(was("timing_source", "string")).alias("timing_source"), F.when(ok, "demucs+ctc").otherwise(was("method", "string")).alias("method"),
        F.concat(F.coalesce(was("warnings", "array<string>"), F.array().cast("array<string>")), F.coalesce("notes", F.array().cast("array<string>"))).alias("warnings"), "alignment_error",
    )


def emission_scores(segments: DataFrame, keys: Sequence[str], vocabulary: dict[str, int], config: Config, blank: int = 0) -> DataFrame:
    """(keys, score, reason): the mean emission of a line's tokens in its segment, so that likely blanks are no evidence.

    ``segments`` (keys, text, reading, surface_spans, logits, samples) hold a line at one shift; the score is null with a
    reason where the window or the vocabulary doesn't do, or a token gets no frame. ``offset.verify`` compares such scores."""
    check_vocabulary(vocabulary, blank)
    kinds = ", ".join(f"`{k}` {segments.schema[k].dataType.simpleString()}" for k in keys)

    def one(row: dict) -> tuple[float | None, str | None]:
        spans = row["surface_spans"]
        records, coverage, _ = reading.target(row["text"] or "", row["reading"] or "", [dict(x) for x in spans] if spans is not None else [], set(vocabulary))
        if row["logits"] is None or not len(row["logits"]) or (row["samples"] or 0) < RECEPTIVE or not records or coverage < config.ctc_coverage_threshold:
            return None, "invalid_window_or_vocabulary"
        labels = [vocabulary[r["text"]] for r in records]
        probs = align.log_softmax(np.array([np.asarray(r, "float64") for r in row["logits"]]))
        frames, _ = align.viterbi(probs, labels, blank)
        if any(b <= a for a, b in frames):
            return None, "collapsed_raw_alignment"
        score = float(np.mean([probs[a:b, k].mean() for (a, b), k in zip(frames, labels)]))
        return (score, None) if np.isfinite(score) else (None, "non_finite_score")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [one(r) for r in pdf.to_dict("records")]
            out = pdf[list(keys)].copy()
            out["score"], out["reason"] = pd.array([g[0] for g in got], "Float64"), pd.Series([g[1] for g in got], index=out.index, dtype=object)
            yield out

    return segments.select(*keys, "text", "reading", "surface_spans", "logits", "samples").mapInPandas(run, f"{kinds}, score double, reason string")

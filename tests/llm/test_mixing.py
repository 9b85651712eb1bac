import os

import pytest

from strophe.llm import mixing, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary files here")


def docs(spark):
    rows = [(i, "big" if i % 3 else " Tiny", "word " * (5 + i % 17)) for i in range(300)] + [(1000, None, "word"), (1001, "other", "word"), (1002, "big", None), (1003, "big", ""), (5, "big", "word " * 10)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string")


def test_mix_meets_shares_and_caps(spark):
    targets = spark.createDataFrame([("big", 0.3, 1), ("tiny", 0.6, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    used, report = mixing.mix(docs(spark), "doc_id", "source", "text", targets)
    rows = used.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(1 <= r.copies <= (3 if r.source == "tiny" else 1) for r in rows)
    got = {r.source: r for r in report.collect()}
    assert got["absent"].actual_share == 0 and got["big"].actual_share == pytest.approx(1 / 3, abs=0.01) and got["tiny"].actual_share == pytest.approx(2 / 3, abs=0.01)
    assert sum(r.tokens * r.copies for r in rows) == sum(r.tokens for r in got.values())


def test_mix_is_solved_by_newton_steps(spark, monkeypatch):
    targets = spark.createDataFrame([("big", 0.3, 1), ("tiny", 0.6, 3)], "source string, target_share double, max_repeats int")
    rates = lambda: {r.source: r.rate for r in mixing.mix(docs(spark), "doc_id", "source", "text", targets)[0].select("source", "rate").distinct().collect()}
    solved = rates()
    monkeypatch.setattr(mixing, "STEPS", 0)
    assert set(rates().values()) == {1.0} and solved["tiny"] > 1.2 and solved["big"] <= 1.0


def test_mix_of_nothing(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    used, report = mixing.mix(docs(spark).limit(0), "doc_id", "source", "text", targets)
    assert used.count() == 0 and report.first().actual_share == 0


def test_newton_solves_overlapping_constraints(spark):
    """Two features that documents share: rates must reproduce given weighted sums."""
    rows = [(float(1 + i % 5), float(i % 2), float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "w double, a double, b double")
    want = [sum(w * a * 0.7 for w, a, _ in rows), sum(w * b * 0.9 for w, _, b in rows)]
    lam = mixing.entropy_balance(df, "w", ["a", "b"], want).multipliers
    import math

    got = [sum(w * f[k] * math.exp(lam[0] * f[0] + lam[1] * f[1]) for w, *f in rows) for k in (0, 1)]
    assert got == pytest.approx(want, rel=1e-6)


def test_margins_tilt_documents_of_one_source(spark):
    """Sources and languages overlap: rates within a source differ by language, and both kinds of shares are met."""
    rows = [(i, "big" if i % 3 else "tiny", ("en", "de", None)[i % 5 % 3], "word " * (5 + i % 17)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, text string")
    targets = spark.createDataFrame([("big", 0.5, 2), ("tiny", 0.5, 4)], "source string, target_share double, max_repeats int")
    used, report = mixing.mix(df, "doc_id", "source", "text", targets, total=30_000, margins={"lang": {"en": 0.25, "de": 0.6}})
    got = used.join(df.select("doc_id", "lang"), "doc_id").collect()
    n = sum(r.tokens * r.copies for r in got)
    share = lambda f: sum(r.tokens * r.copies for r in got if f(r)) / n
    assert share(lambda r: r.source == "big") == pytest.approx(0.5, abs=0.005)
    assert share(lambda r: r.lang == "en") == pytest.approx(0.25, abs=0.02) and share(lambda r: r.lang == "de") == pytest.approx(0.6, abs=0.02)
    assert len({round(r.rate, 6) for r in got if r.source == "big"}) == 3
    row = report.first()
    assert row.newton_steps > 1 and row.residual < 1e-6

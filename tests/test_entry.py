"""The driver contract, and every query with SQL on the smallest data."""

import os

import duckdb
import pytest

from strophe.plans import queries


def test_contract(spark, small):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, small, name):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f[:-8]} as select * from '{small}/{f}'")
    df = queries.QUERIES[name](spark, small)
    cols = sorted(df.columns)
    rel = c.execute(queries.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    key = lambda row: tuple(round(v, 5) if isinstance(v, float) else v for v in row)
    want = sorted((key(tuple(r[names.index(x)] for x in cols)) for r in rel.fetchall()), key=repr)
    got = sorted((key(tuple(r[x] for x in cols)) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_fold_runs(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() > 0


def test_display_has_no_defects(spark, small):
    bad = queries.display_checks(spark, small).filter("not display_text_matches or not display_onset_monotonic")
    assert bad.count() == 0


def test_shifts_are_verified_on_single_starts(spark, small, monkeypatch):
    scores = []
    monkeypatch.setattr(queries.offset, "verify", lambda s, proposal, keys: scores.append(s))
    queries.offset_verification(spark, small)
    per = scores[0].groupBy("k", "offset").agg({"line": "count", "score": "avg"}).collect()
    assert per and all(r["count(line)"] >= 2 for r in per)
    grid = {(r.k, r.shift): r.score for r in queries.offset_grid(spark, small).collect()}
    assert all(r["avg(score)"] == pytest.approx(grid[r.k, r.offset], abs=1e-5) for r in per)


def test_lines_without_usable_times_are_displayed(spark, small):
    want = {r.line_key for r in queries._lines(spark, small, "text").collect()}
    assert {r.line_key for r in queries.display_checks(spark, small).select("line_key").collect()} == want

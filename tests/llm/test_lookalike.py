import unicodedata

import pytest

from strophe.llm import lookalike
from strophe.llm.lookalike import form, token_kind

SAME = [
    ("Ｆｏｍｏｓ ｃｏｒａçãｏ", "Fomos coração"), (unicodedata.normalize("NFD", "été à la forêt"), "été à la forêt"), ("Fomоѕ", "Fomos"), ("ﾄﾞｱとｷﾞﾀｰ", "ドアとギター"),
    ("もう⼀度", "もう一度"), ("口ビーの力ーテン", "ロビーのカーテン"), ("坂道ヘ", "坂道へ"), ("二ュース", "ニュース"), ("a b c", "a b c"), ("か　ぜ", "か ぜ"),
    ("sal​t﻿ wi­nd⁠", "salt wind"), (unicodedata.normalize("NFD", "한글"), "한글"), ("Ιn Αthens", "In Athens"), ("naïve", "naïve"), (" x ", "x"), ("？", "?"),
    ("привет", "привeт"), ("москва", "мoсква"), ("ΓΕΙΑ", "ΓEΙΑ"), ("ΓΕΙΑ", "ГЕІА"), ("Ꭺ", "A"), ("ɡo", "go"), ("ёж", "ëж"), ("е́до", "éдо"),
]
DIFFER = [("Salt", "salt"), ("etoile", "étoile"), ("salt", "salt!"), ("…", "..."), ("か", "が"), ("っ", "つ"), ("a b", "ab"), ("m²", "m2"), ("’", "'"), ("–", "-")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert form(a) == form(b)
    assert form(form(a)) == form(a)


@pytest.mark.parametrize("a,b", DIFFER)
def test_differ(a, b):
    assert form(a) != form(b)


def test_scripts():
    assert lookalike.resolve("привeт") == ("mixed", "Cyrl") and lookalike.resolve("ΓEΙΑ") == ("mixed", "Grek") and lookalike.resolve("дλж")[1] is None and lookalike.resolve("дαж")[1] == "Cyrl"
    assert form("привeт") == "привет" and form("мoсква") == "москва" and form("ёлка") == "ёлка" and form("ψυχή") == "ψυχή"
    assert token_kind("cоp") == "mixed" and token_kind("сор") == "whole" and token_kind("дом") == "single" and token_kind("cop") == "single"
    assert form("дом") == "дом" and form("сор") == "cop"


def test_twins(spark):
    rows = [("d", 1, "salt wind"), ("d", 2, "salt wind"), ("d", 3, "sаlt wind"), ("e", 4, "salt wind"), ("d", 5, "salt wind"), ("d", 6, " ​"), ("d", 7, ""), ("d", 8, None), (None, 9, "salt wind"), ("d", 2, "salt wind"), ("d", 10, "Salt wind")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "g string, k bigint, t string, form string")
    want = {(1, 2), (1, 3), (2, 3), (2, 5), (3, 5)}
    assert {tuple(r) for r in lookalike.twins(df, "g", "k", "t").collect()} == want
    damaged = lambda texts: [" " in t for t in texts]
    assert {tuple(r) for r in lookalike.twins(df, "g", "k", "t", damaged).collect()} == {(1, 3), (3, 5)}
    assert lookalike.twins(df.limit(0), "g", "k", "t").count() == 0
    assert lookalike.forms(df, ["k"], "t").count() == 8
    members = {r.k: r.class_key for r in lookalike.classes(df, "g", "k", "t").collect()}
    assert members == {1: 1, 2: 1, 3: 1, 4: 4, 5: 1, 10: 10}


def test_surfaces(spark):
    span = lambda s, a, b: (s, a, b)
    rows = [(1, "salt wind", [span("salt", 0, 4), span("ｗind", 5, 9), span("wend", 5, 9), None, span("sаlt", 0, 4), span(None, 0, 4), span("salt", None, 4)]), (2, None, [span("x", 0, 1)]), (3, "x", None), (1, "salt wind", [span("salt", 0, 4), span("ｗind", 5, 9)])]
    df = spark.createDataFrame(rows, "line_key bigint, text string, surface_spans array<struct<surface:string,surface_start:int,surface_end:int>>")
    assert {tuple(r) for r in lookalike.false_surfaces(df).collect()} == {(1, 1), (1, 4)}

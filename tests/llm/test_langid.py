import random
import re
import time

import numpy as np
import pandas as pd
import pytest

from strophe.llm import garbled, langid, queries
from tests.llm.test_garbled import CLEAN


def corpus(seed, n, noise=0.0):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lang = rng.choice(sorted(CLEAN))
        s = CLEAN[lang]
        if lang not in ("ja", "zh"):
            w = s.split(" ")
            a = rng.randrange(0, len(w) - 5)
            s = " ".join(w[a : a + 6])
        label = rng.choice(langid.LANGS) if rng.random() < noise else lang
        out.append((s, lang, label))
    return out


@pytest.fixture(scope="module")
def filters():
    rows = corpus(1, 1500, noise=0.08)
    return langid.Filters.train([langid.plain(t) for t, _, _ in rows], [langid.LANGS.index(x) for _, _, x in rows])


def names(found):
    return [[langid.LANGS[a] for a, _ in x] for x in found]


def test_bloom_false_positives_are_low(filters):
    h = np.random.default_rng(0).integers(0, 2**32, 20000, dtype="uint64").astype("uint32")
    p = filters.positions(h)
    mask = filters.table[p[0]] & filters.table[p[1]]
    assert all(((mask >> i) & 1).mean() < 0.02 for i in range(8))


def test_single_languages(filters):
    rows = corpus(2, 300)
    got = names(langid.Splitter(filters, False).split([t for t, _, _ in rows]))
    assert sum(g == [lang] for g, (_, lang, _) in zip(got, rows)) >= 295


def test_stretches(filters):
    a, b = "Je rêve toujours, je vois une étoile fêlée", "until the salt wind is gone from the harbour cranes"
    lines = [f"{a} / {b}", f"{b}; {a}; {b}", "もう一度遠い海へ帰りたい" + b, f"{b}　我把带盐的风留在了北方的雨旁边", "もう一度遠い海へ帰りたい 请不要忘记安静的河和坏掉的罗盘"]
    assert names(langid.Splitter(filters, False).split(lines)) == [["fr", "en"], ["en", "fr", "en"], ["ja", "en"], ["en", "zh"], ["ja", "zh"]]
    doc = f"{a}. {a}.\n{b}. Zankolu. 77!\n\n{b}."
    assert names(langid.Splitter(filters, True).split([doc])) == [["fr", "en"]]


def test_no_words(filters):
    assert names(langid.Splitter(filters, False).split(["", "1, 2, 3", "♪", "Na na na", "ラララ", "~ ~", "\n", "x" * 500, "[SEP] [CLS]", "<|endoftext|>"])) == [[]] * 10
    assert names(langid.Splitter(filters, False).split([])) == []


def test_spelling_tricks_change_nothing(filters):
    t = "Je rêve toujours, je vois une étoile fêlée"
    wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in t)
    assert names(langid.Splitter(filters, False).split([wide, t.upper(), t.replace("e", "е", 2)])) == [["fr"]] * 3


def test_words_are_judged_alike_beside_any_other(filters):
    a = "je rêve toujours, je vois une étoile fêlée zq"
    alone, beside = (filters.words(langid.Grams(t)) for t in ([a], [a, "もう一度遠い海へ帰りたい"]))
    assert (alone == beside[: len(alone)]).all()


@pytest.mark.parametrize("second", [False, True])
def test_ngrams_count_alike_in_any_batch(filters, second):
    df = pd.DataFrame([(t, label, 1 + i % 3 // 2) for i, (t, _, label) in enumerate(corpus(4, 120, noise=0.3))], columns=["t", "l", "n"])
    first = filters if second else None
    count = lambda parts: pd.concat(list(langid._counted(iter(parts), first))).groupby(["g", "l"]).n.sum()
    assert count([df]).equals(count([df[i : i + 1] for i in range(len(df))]))


def test_sung_syllables():
    plain = re.compile(r"(?<![^\W\d_])(?:" + langid._SYLLABLES + r")+(?![^\W\d_])")
    rng, parts = random.Random(6), ["la", "na", "oh", "hmm", "mm", "m", "a", "x", "-", " ", "ラ", "ー", "나", "啦", "1", "_", "é", "lala"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(10)))
        assert langid._sung(t) == [m.span() for m in plain.finditer(t)]


def test_long_runs_of_a_letter_take_no_time(filters):
    start = time.process_time()
    langid.Splitter(filters, False).split(["m" * 36 + "x", "m" * 36 + "e"])
    assert time.process_time() - start < 1


def test_ends_of_sentences():
    rng = random.Random(7)
    for _ in range(2000):
        t = "".join(rng.choice(".!?…。！？\n\r \"»)」』a漢　") for _ in range(rng.randrange(20)))
        assert {m.end() for m in langid._ENDS.finditer(t)} == {m.end() for m in langid._SENTENCE.finditer(t)}
    assert langid._SENTENCE.split("One. Two。三！\nFour") == ["One.", "Two。", "三！", "", "Four"]


def test_slices():
    assert langid.slices([3, 3, 9, 1], 6) == [(0, 2), (2, 3), (3, 4)] and langid.slices([], 5) == []


def test_labels_and_table(spark, filters):
    t = "Je rêve toujours, je vois une étoile fêlée"
    rows = [(1, t, "fr"), (2, t, "FR-ca"), (3, t, None), (4, t, "en"), (5, None, "fr"), (6, " ", "fr"), (7, t, "French"), (8, t, "und"), (4, t, "en"), (9, f"{t} / until the salt wind is gone", "fr")]
    df = spark.createDataFrame(rows, "k bigint, text string, label string")
    found = langid.languages(df, "k", "text", "label", filters, False)
    got = {tuple(r) for r in langid.mislabelled(found).collect()}
    assert got == {(3, -1, "fr"), (4, -1, "fr"), (8, -1, "fr"), (9, 0, "fr"), (9, 1, "en")}
    assert all(0.5 < r.confidence <= 1 for r in found.collect())
    assert langid.languages(df.limit(0), "k", "text", "label", filters, False).count() == 0
    empty = langid.train(spark, [(df.limit(0), "k", "text", "label", 10)])
    assert langid.languages(df, "k", "text", "label", empty, False).count() == 0


def test_filters_come_from_all_labelled_rows(spark, monkeypatch):
    # kana and han apart: the local training cuts their words by where they stand among all texts
    rows = [(t, x) for t, lang, x in corpus(3, 14000, noise=0.08) if lang not in ("ja", "zh")][:10000]
    rows = [(t + " " + "".join(chr(97 + int(d)) for d in f"{i // 2:05}"), x) for i, (t, x) in enumerate(rows)]  # words that few rows have
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "id bigint, text string, lang string")
    df = df.unionAll(df.limit(300))  # repeated rows count once
    names = {"doc_id": "id", "line_id": "id", "line_key": "id", "reading": "text", "reading_lang": "lang"}
    monkeypatch.setattr(queries, "table", lambda spark, sf, t: df.withColumns({k: df[c] for k, c in names.items()}))
    monkeypatch.setattr(garbled, "fit", lambda spark, columns: None)
    monkeypatch.setattr(garbled, "repairer", lambda spark, model: None)
    got = []
    monkeypatch.setattr(langid, "languages", lambda df, k, x, label, filters, *_: got.append(filters))
    queries._stretches(spark, "")
    every = [(langid.plain(t), langid.LANGS.index(x)) for t, x in rows] * 3
    assert (got[0].table == langid.Filters.train(*map(list, zip(*every))).table).all()


def test_filters_grow_with_their_ngrams(spark, monkeypatch):
    monkeypatch.setattr(langid, "BITS", 6)
    df = spark.createDataFrame([(i, t, x) for i, (t, _, x) in enumerate(corpus(1, 1500, noise=0.08))], "k bigint, text string, label string")
    f = langid.train(spark, [(df, "k", "text", "label")])
    assert len(f.table) > 1 << 6 and f.false.max() < 0.2
    assert names(langid.Splitter(f, False).split(["Je rêve toujours, je vois une étoile fêlée"])) == [["fr"]]
    empty = langid.train(spark, [(df.limit(0), "k", "text", "label")])
    assert not empty.table.any()

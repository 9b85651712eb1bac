"""Damage that is made is found and undone; clean spellings aren't touched."""

import random
import zlib

import pytest

from strophe.llm import garbled, langid, lookalike, queries

CLEAN = {
    "fr": "Où s'en va la lumière du port après l'été ? Je rêve toujours, je vois une étoile fêlée et le cœur endormi, là où naît la forêt",
    "pt": "Não esqueças a canção da varanda nem uma bússola quebrada amanhã, que já vem o coração adormecido e o último bonde",
    "de": "Die Brücke über Nebel bleibt, denn ein müder Kompass ruft mich für später zurück und die letzte Straßenbahn hütet das schöne Rätsel",
    "es": "Aquí no queda más que el último tranvía y una estación sin nombre mañana, el corazón dormido y una brújula rota junto al río",
    "ja": "もう一度遠い海へ帰りたい どうして春風はこんなに青いの 窓辺に消える手紙を見ていた 冬が来ると星空が泣いているような夜",
    "ko": "오늘 밤 부서진 나침반 아래에서 기다릴게 우리는 소금 바람 같은 사이였어 나와 함께 달려 항구의 불빛 너머로",
    "zh": "请不要忘记安静的河和坏掉的罗盘 我把带盐的风留在了北方的雨旁边 这里除了没寄出的信什么都没有",
    "en": "The harbour cranes keep calling me back from a field of static until the salt wind is gone",
}


def texts(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = CLEAN[rng.choice(sorted(CLEAN))]
        if " " in s:
            w = s.split(" ")
            a = rng.randrange(0, max(1, len(w) - 4))
            s = " ".join(w[a : a + rng.randint(3, 9)])
        out.append(s)
    return out


@pytest.fixture(scope="module")
def model():
    return garbled.Model.fit([f"{t} {i % 7}" for i, t in enumerate(texts(1, 2500))])


CHAINS = [(("utf-8", b),) for b in ("latin_1", "cp1252", "mac_roman", "cp437", "cp932", "gbk")] + [(("euc_jp", "latin_1"),), (("cp949", "latin_1"),), (("cp932", "cp1252"),), (("gbk", "latin_1"),), (("utf-8", "cp1252"), ("utf-8", "cp1252"))]


@pytest.mark.parametrize("chain", CHAINS)
def test_made_damage_is_found_and_mostly_undone(model, chain):
    found = undone = n = 0
    for t in texts(2, 150):
        g = garbled.garble(t, chain)
        if g is None or g == t or not any(ord(c) > 127 for c in t):
            continue
        n += 1
        hit, back = model.restore(g)
        found += hit
        undone += back == t
    assert n and found >= 0.95 * n
    if chain[0][1] not in ("cp932", "gbk"):  # those lose characters
        assert undone >= 0.8 * n


def test_scripts_that_sort_last_are_learned():
    many = [f"étoile fêlée {i}" for i in range(garbled.SAMPLE + 100)]
    korean = [f"{t} {i % 7}" for i, t in enumerate(texts(4, 3000)) if "\uac00" <= t[0] <= "\ud7a3"]
    m = garbled.Model.fit(many + korean)
    t = CLEAN["ko"][:17]
    assert m.restore(t) == (False, t)
    for chain in [(("utf-8", "cp1252"),), (("cp949", "latin_1"),)]:
        assert m.restore(garbled.garble(t, chain)) == (True, t)


@pytest.mark.parametrize("chain", [(("euc_jp", "latin_1"),), (("utf-8", "cp437"),)])
def test_a_chain_that_ranks_last_is_tried_too(model, monkeypatch, chain):
    t = "もう一度遠い海へ"
    g = garbled.garble(t, chain)
    ranked = model.stretches(g)
    last = sorted(ranked, key=lambda x: garbled.invert(g, model.chains[x[1]]) == t)
    assert len(last) > 16
    monkeypatch.setattr(model, "stretches", lambda text: last if text == g else [])
    assert model.undo_once(g) == t


def test_lost_characters_count(model):
    assert model.restore("Aqu� no queda m�s")[0]


def test_clean_texts_stay(model):
    assert [t for t in texts(3, 400) if model.restore(t)[0]] == []
    assert model.restore("") == (False, "") and model.restore("plain ascii") == (False, "plain ascii")


def test_half_damaged(model):
    good, bad = "もう一度遠い海へ", garbled.garble("帰りたい", (("utf-8", "cp1252"),))
    assert model.restore(good + bad) == (True, good + "帰りたい")


def test_many_damaged_words_between_clean_ones(model):
    bad = garbled.garble("fêlée", (("utf-8", "cp1252"),))
    for n in (3, 9, 14):
        words = ["l'été", "fêlée"] * n
        assert model.restore(" ".join(bad if w == "fêlée" else w for w in words)) == (True, " ".join(words))


def test_chain_inversion_is_exact():
    for chain in garbled.CHAINS:
        for t in CLEAN.values():
            g = garbled.garble(t, chain)
            back = garbled.invert(g, chain) if g is not None else None
            assert back is None or back == t or chain[-1][1] in garbled._WIDE


def test_lines_with_one_wrong_letter_are_repaired_before_their_language_is_decided(spark, model, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda spark, sf, t: spark.range(0))
    monkeypatch.setattr(garbled, "fit", lambda spark, columns: model)
    monkeypatch.setattr(langid, "train", lambda spark, tables: None)
    monkeypatch.setattr(langid, "languages", lambda df, k, x, label, filters, long, repair: repair)
    repair = dict(queries._stretches(spark, ""))["lyrics_timeline"]
    lines = ["lumière du port", "o último bonde", "não esqueças"]
    for t in lines:
        g = t.replace("è", "Ã¨").replace("ú", "Ãº").replace("ã", "Ã£")
        assert g != t and model.restore(g) == (True, t)
        assert repair([g, t]) == [t, t]


def test_tables(spark, model):
    g = garbled.garble("étoile fêlée", (("utf-8", "latin_1"),))
    df = spark.createDataFrame([(1, g, "x"), (1, g, "x"), (2, None, "x"), (3, "", "x"), (4, "étoile fêlée", "x")], "k bigint, t string, text string")
    rows = garbled.damage(df, "k", "t", model).distinct().collect()
    assert [(r.key, r.restored) for r in rows] == [(1, "étoile fêlée")]
    assert garbled.damage(df.limit(0), "k", "t", model).count() == 0
    assert garbled.fit(spark, [(df.limit(0), "k", "t")]).restore("é") is not None


def test_many_texts_are_garbled_as_each_is():
    many = [*CLEAN.values(), "a\ufffd", "\x80", "©", "ｱ", "é"]
    for chain, made in zip(garbled.CHAINS, garbled._garble_all(many), strict=True):
        if chain[0][1] != "euc_jp":  # there a text cut short is replaced by another number of marks
            each = [g for t in many if (g := garbled.garble(t, chain)) is not None and g != t and g.count("\ufffd") * 2 < len(g)]
            assert made == each


@pytest.mark.parametrize("query", ["p2", "p6"])
def test_the_model_comes_from_all_lines(spark, monkeypatch, query):
    rows = [(i, f"{t} {i % 4001}") for i, t in enumerate(texts(5, 9000))]
    df = spark.createDataFrame(rows, "line_id bigint, text string").repartition(3)
    monkeypatch.setattr(queries, "table", lambda spark, sf, t: df)
    got = []
    monkeypatch.setattr(garbled, "repairer", lambda spark, model: got.append(model))
    monkeypatch.setattr(garbled, "damage_test", lambda spark, model: got.append(model))
    monkeypatch.setattr(langid, "train", lambda spark, tables: None)
    monkeypatch.setattr(langid, "languages", lambda *_: None)
    monkeypatch.setattr(lookalike, "twins", lambda *_: spark.createDataFrame([], "key_a bigint, key_b bigint"))
    monkeypatch.setattr(lookalike, "false_surfaces", lambda *_: spark.createDataFrame([], "line_key bigint, pos bigint"))
    queries._stretches(spark, "") if query == "p2" else queries.p6_found(spark, "")
    assert (got[0].clean != garbled.fit(spark, [(df, "line_id", "text")], garbled.SAMPLE).clean).any()
    every = sorted({t for _, t in rows})
    whole = garbled.Model.of(*garbled.tally(every, [zlib.crc32(t.encode()) for t in every]))
    assert len(every) > 8000 and got[0].chains == whole.chains
    assert (got[0].clean == whole.clean).all() and (got[0].ratio == whole.ratio).all()


def test_bytes_of_stretches_are_cut_from_the_whole():
    texts = ["Ã©tÃ© \uf8f0あ\xa0", "もう一度 é 帰り", "눈 덮인 창문", "请不要忘记", "", "abc"]
    for t in texts:
        for name in (*garbled._NARROW, *garbled._WIDE):
            whole = garbled._Written(t, name)
            assert all(whole.part(x, y) == garbled.unread(t[x:y], name) for x in range(len(t)) for y in range(x, len(t) + 1))

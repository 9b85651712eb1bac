"""Held-out accuracy on made documents in two languages."""

import random

import numpy as np

from strophe.llm import langid, subjects

NOUNS = {
    "en": {"cooking": "broth stew oven dough onion soup pan sauce".split(), "law": "court judge verdict lawsuit statute contract witness appeal".split()},
    "de": {"cooking": "brühe eintopf backofen teig zwiebel suppe pfanne soße".split(), "law": "gericht richter urteil klage gesetz vertrag zeuge berufung".split()},
}
TEMPLATES = {"en": ["They asked whether the {} had anything to do with the {}.", "In the end the {} matters more than the {}."], "de": ["Niemand wusste, warum der {} wichtig ist, bis der {} dazukam.", "Zuerst kommt der {}, danach erst der {}."]}
FILLER = {"en": ["The intro is quiet, then the drums come in.", "The key changes twice and the scale feels borrowed.", "It still bothers me."], "de": ["Das Intro ist leise, dann kommt das Schlagzeug.", "Das stört mich noch immer.", "Der Refrain kommt etwas zu früh."]}


def made(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        g = rng.choice(["en", "de"])
        about = set(rng.choice([["cooking"], ["law"], ["cooking", "law"], []]))
        lines = [rng.choice(FILLER[g]) for _ in range(4)]
        for s in about:
            lines += [rng.choice(TEMPLATES[g]).format(*rng.sample(NOUNS[g][s], 2)) for _ in range(3)]
        for s in {"cooking", "law"} - about:
            if rng.random() < 0.3:  # a single mention
                lines.append(rng.choice(TEMPLATES[g]).format(*rng.sample(NOUNS[g][s], 2)))
        rng.shuffle(lines)
        out.append((i, " ".join(lines), g, about))
    return out


def test_held_out_accuracy(spark):
    rows = made(1, 400)
    docs = spark.createDataFrame([(i, t, g, "clash") for i, t, g, _ in rows] + [(900, None, None, ""), (901, "", "en", ""), (902, "♪ 12", "en", "")], "doc_id bigint, text string, lang string, key string").repartition(3)
    labels = spark.createDataFrame([(i, s) for i, _, _, a in rows[:120] for s in (a or {"none"})] * 2, "key bigint, subject string")
    names = spark.createDataFrame([("cooking",), ("law",)], "subject string")
    filters = langid.train(spark, [(docs, "doc_id", "text", "lang", 500)])
    got = {}
    for r in subjects.about(docs, "doc_id", "text", labels, names, filters).collect():
        got.setdefault(r.key, set()).add(r.subject)
    assert not {900, 901, 902} & set(got)
    tp = fp = fn = 0
    for i, _, _, a in rows[120:]:
        g = got.get(i, set())
        tp, fp, fn = tp + len(g & a), fp + len(g - a), fn + len(a - g)
    assert 2 * tp / (2 * tp + fp + fn) > 0.93
    assert subjects.about(docs, "doc_id", "text", labels.limit(0), names, filters).count() == 0
    assert subjects.about(docs.limit(0), "doc_id", "text", labels, names, filters).count() == 0


def test_decomposition_spans_the_leading_space(spark):
    rng = np.random.default_rng(0)
    words = ["w" + "abcdefghij"[i // 10] + "abcdefghij"[i % 10] for i in range(40)]
    docs = [(k, " ".join(rng.choice(words[: 20] if k % 2 else words[20:], 12))) for k in range(120)]
    df = spark.createDataFrame(docs, "k bigint, t string")
    feats = subjects.features(df, "k", "t", langid.Filters(np.zeros(1 << langid.BITS, "uint8"))).cache()
    space = subjects.decompose(feats, dims=2, passes=8)
    x = np.zeros((120, len(space.used)))
    for r in feats.collect():
        for i in r.ids:
            if space.row[i] >= 0:
                x[r.key, space.row[i]] = space.weight[space.row[i]]
    tf = {r.key: np.bincount(space.row[np.array(r.ids)][space.row[np.array(r.ids)] >= 0], minlength=len(space.used)) for r in feats.collect()}
    for k, n in tf.items():
        x[k] = np.where(n > 0, (1 + np.log(np.maximum(n, 1))) * space.weight, 0)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    want = np.linalg.svd(x, full_matrices=False)[2][:2]
    assert np.linalg.norm(want @ space.vectors) > 0.98 * np.sqrt(2)

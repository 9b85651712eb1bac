"""One consistent form of text that looks the same but differs in its characters.

For every token the resolved script sets of its letters are intersected: a letter counts with every
script that has a letter drawn alike. Letters of several scripts make a mixed-script token; a token
that another script can spell entirely is a whole-script confusable. A token is respelled in the
first script (in the order of ``SCRIPTS``) that can spell all of it, so the form depends on what is
seen only; where no script can, each letter takes the first letter drawn like it. Kana and han
drawn alike are told apart by their neighbours. What remains is normalised: widths, separate
accents, characters that don't show, kinds of blanks, radicals.

Case, punctuation, missing accents and other letters stay different. Defined results: null and
blank texts have no form and no partner; damaged texts look like no other; repeated rows count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scripts whose letters stand in for each other, in the order in which they are preferred.
SCRIPTS = ("Latn", "Grek", "Cyrl", "Armn", "Cher")
#: Letters drawn alike (fixed values of the common confusables); of each script at most one is used for spelling, the first.
ALIKE = (
    "aаɑα", "cсϲ", "dԁ", "eе", "gɡց", "hһհ", "iіι", "jјϳ", "lӏ", "nո", "oоοօ", "pрρ", "qԛ", "sѕ", "uսʋ", "vѵν", "wԝ", "xх", "yу",
    "AАΑᎪ", "BВΒᏴ", "CСϹᏟ", "DᎠ", "EЕΕᎬ", "GԌᏀ", "HНΗᎻ", "IІΙӀ", "JЈᎫ", "KКΚᏦ", "LᏞ", "MМΜᎷ", "NΝ", "OОΟՕ", "PРΡᏢ", "QԚ", "RᎡ", "SЅՏᏚ", "TТΤᎢ", "UՍ", "VѴᏙ", "WԜᎳ", "XХΧ", "YҮΥᎩ", "ZΖᏃ",
    "ΓГᎱ", "ΠП", "ΦФ", "κк", "ϰк", "ΛЛ",
)
#: Kana and han letters drawn alike: katakana, and the hiragana or han letter.
ALIKE_KANA = (("ヘ", "へ"), ("ベ", "べ"), ("ペ", "ぺ"), ("リ", "り"), ("ロ", "口"), ("タ", "夕"), ("カ", "力"), ("ニ", "二"), ("エ", "工"), ("ト", "卜"), ("ハ", "八"), ("チ", "千"), ("ミ", "三"), ("ー", "一"))

_KATA = {a: b for a, b in ALIKE_KANA} | {b: b for _, b in ALIKE_KANA}
_BACK = {b: a for a, b in ALIKE_KANA}
_HIDDEN = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0100-\U000e01ef"
_BLANKS = "\t\n\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_HIDE, _BLANK = re.compile(f"[{_HIDDEN}]+"), re.compile(f"[{_BLANKS}]")
_FOREIGN = re.compile("[\u0250-\u02af\u0370-\u052f\u0531-\u0587\u13a0-\u13ff]")
_KANJI = re.compile("[" + "".join(a + b for a, b in ALIKE_KANA) + "]")


@lru_cache(None)
def _forms() -> dict[int, str]:
    """Characters that are another character in another width or font, or a radical drawn as a letter."""
    out = {}
    for i in (*range(0x2E80, 0x2FE0), *range(0x2100, 0x2150), *range(0x2160, 0x2180), *range(0xF900, 0xFB00), *range(0xFF01, 0xFFEF), *range(0x1D400, 0x1D800), *range(0x2F800, 0x2FA20)):
        d = unicodedata.decomposition(chr(i)).split()
        if d and (d[0] in ("<wide>", "<narrow>", "<font>", "<compat>") or not d[0].startswith("<")) and chr(i) != "℃":
            out[i] = unicodedata.normalize("NFKC", chr(i))
    out[0x2EA0], out[0x2EC4] = "民", "西"
    return out


@lru_cache(None)
def _plain() -> re.Pattern:
    """Texts of only these characters are their own form (apart from blanks at the ends)."""
    odd = "".join(re.escape(chr(i)) for i in sorted(_forms()) if i < 0x10000)
    return re.compile(f"[{_HIDDEN}{_BLANKS}\u0300-\u036f\u1100-\u11ff\u3099\u309a\U0001d400-\U0001d7ff\U0002f800-\U0002fa1f{odd}]|" + _FOREIGN.pattern + "|" + _KANJI.pattern)


def script(c: str) -> str:
    """The script of a letter as far as it matters here; '' for marks, digits and the like."""
    o = ord(c)
    if o < 0x2B0:
        return "Latn" if c.isalpha() else ""
    for name, a, b in (("Grek", 0x370, 0x3FF), ("Cyrl", 0x400, 0x52F), ("Armn", 0x530, 0x58F), ("Cher", 0x13A0, 0x13FF), ("Latn", 0x1E00, 0x1EFF), ("Grek", 0x1F00, 0x1FFF), ("Hira", 0x3041, 0x309F), ("Kana", 0x30A0, 0x30FF), ("Hani", 0x3400, 0x9FFF), ("Hang", 0xAC00, 0xD7A3)):
        if a <= o <= b:
            return name
    return ""


@lru_cache(None)
def _alike() -> dict[str, dict[str, str]]:
    """Letter -> the letter of each script that is drawn like it."""
    out: dict[str, dict[str, str]] = {}
    for letters in ALIKE:
        known = {}
        for c in letters:
            known.setdefault(script(c), c)
        for c in letters:
            out.setdefault(c, {}).update({k: v for k, v in known.items() if k not in out.get(c, {})})
    return out


def scripts(c: str) -> frozenset[str]:
    """The resolved scripts of a letter: its own, and those that have a letter drawn alike."""
    return frozenset((script(c), *_alike().get(c, ())))


_TOKEN = re.compile("(?:[^\\W\\d_][\u0300-\u036f]*)+")
_EAST = frozenset(("", "Hira", "Kana", "Hani", "Hang"))


def resolve(token: str) -> tuple[str, str | None]:
    """(kind, script) of a token: 'single', 'mixed' or 'whole' (of one script, but another that is preferred can spell
    it), and the script that can spell all of its letters; None where none can or none is needed."""
    letters = [c for c in token if script(c) not in _EAST]  # kana, han and hangul stand beside letters of any script
    own = {script(c) for c in letters}
    if not letters:
        return "single", None
    every = frozenset.intersection(*map(scripts, letters))
    best = next((s for s in SCRIPTS if s in every), None)
    return ("mixed" if len(own) > 1 else "whole" if best is not None and best not in own else "single"), best


def token_kind(token: str) -> str:
    return resolve(token)[0]


def _respell(token: str) -> str:
    """The token (accents apart) in the script that can spell it."""
    best, alike = resolve(token)[1], _alike()
    if best is None:
        first = lambda c: next((alike[c][s] for s in SCRIPTS if s in alike[c]), c)
        return "".join(first(c) if c in alike else c for c in token)
    return "".join(alike[c].get(best, c) if c in alike else c for c in token)


def _kana(text: str) -> str:
    """Kana and han drawn alike: katakana beside katakana, otherwise the other letter. Depends on the drawn form only."""
    drawn = [_KATA.get(c, c) for c in text]
    out = list(drawn)
    for i, c in enumerate(drawn):
        if c not in _BACK:
            continue
        j, k = i - 1, i + 1
        before = next((drawn[x] for x in range(j, max(-1, j - 3), -1) if drawn[x] not in _BACK), "")
        after = next((drawn[x] for x in range(k, min(len(drawn), k + 3)) if drawn[x] not in _BACK), "")
        near = script(before or " ") == "Kana"
        out[i] = _BACK[c] if (near and c not in "へべぺり") or script(after or " ") == "Kana" else c
    return "".join(out)


def form(text: str) -> str:
    """The one form of all texts that look like this one."""
    if not text.isascii() and (_plain().search(text) or not unicodedata.is_normalized("NFC", text)):
        text = _HIDE.sub("", text).translate(_forms())
        text = unicodedata.normalize("NFC", text)
        text = _BLANK.sub(" ", text)
        if _FOREIGN.search(text):  # accents apart: a letter drawn alike stays so under its accents
            text = unicodedata.normalize("NFC", _TOKEN.sub(lambda m: _respell(m.group()), unicodedata.normalize("NFD", text)))
        if _KANJI.search(text):
            text = _kana(text)
    elif _BLANK.search(text):
        text = _BLANK.sub(" ", text)
    return text.strip(" ")


def _digest(text: str) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(text.encode("utf-8", "surrogatepass"))


def forms(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, text, form): the consistent form of every non-blank text."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["form"] = pd.Series([form(t) for t in pdf["text"]], dtype=object, index=pdf.index)
            yield pdf[pdf["form"] != ""]

    rows = df.select(*keys, F.col(text).cast("string").alias("text")).filter("text is not null")
    return rows.mapInPandas(run, ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", text string, form string")


def twins(df: DataFrame, group: str, key: str, text: str, repair=None) -> DataFrame:
    """(key_a, key_b): rows of one group whose texts look the same but aren't equal.

    Only digests of the forms are shuffled; groups of a single spelling drop out before texts are
    compared, and only the rest is checked for damage."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shown = [form(t) for t in pdf["text"]]
            pdf["form"] = [_digest(s) if s else None for s in shown]
            pdf["spelling"] = [_digest(t) for t in pdf["text"]]
            yield pdf.loc[[bool(s) for s in shown], ["grp", "key", "form", "spelling"]]

    rows = df.select(F.col(group).alias("grp"), F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).filter("text is not null and grp is not null")
    kind = rows.schema["grp"].dataType.simpleString()
    seen = rows.mapInPandas(run, f"grp {kind}, key bigint, form binary, spelling binary")
    many = seen.groupBy("grp", "form").agg(F.min("spelling").alias("a"), F.max("spelling").alias("b")).filter("a != b").select("grp", "form")
    lines = seen.join(many, ["grp", "form"], "left_semi").distinct()
    if repair is not None:
        texts = rows.join(lines.select("grp", "key").distinct(), ["grp", "key"], "left_semi").distinct()

        def damaged(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                flags = repair(list(pdf["text"]))
                yield pdf.loc[np.array(flags, bool), ["grp", "key"]]

        lines = lines.join(texts.mapInPandas(damaged, f"grp {kind}, key bigint").distinct(), ["grp", "key"], "left_anti")
    a, b = lines.alias("a"), lines.alias("b")
    on = (F.col("a.grp") == F.col("b.grp")) & (F.col("a.form") == F.col("b.form")) & (F.col("a.key") < F.col("b.key")) & (F.col("a.spelling") != F.col("b.spelling"))
    return a.join(b, on).select(F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b")).distinct()


def classes(df: DataFrame, group: str, key: str, text: str) -> DataFrame:
    """(group, key, class_key): membership of every non-blank row in the class of rows of its group that look the same;
    the class is named by its smallest key. Pairs within a class needn't be listed to use it."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["form"] = [_digest(f) if (f := form(t)) else None for t in pdf["text"]]
            yield pdf.loc[pdf["form"].notna(), ["grp", "key", "form"]]

    rows = df.select(F.col(group).alias("grp"), F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).filter("text is not null and grp is not null")
    seen = rows.mapInPandas(run, f"grp {rows.schema['grp'].dataType.simpleString()}, key bigint, form binary").distinct()
    heads = seen.groupBy("grp", "form").agg(F.min("key").alias("class_key"))
    return seen.join(heads, ["grp", "form"]).select(F.col("grp").alias(group), F.col("key").alias(key), "class_key")


def false_surfaces(lines: DataFrame) -> DataFrame:
    """(line_key, pos): spans whose surface looks like, but isn't, the characters of the line that it stands for.

    Equal surfaces are left out by the JVM before anything goes to Python."""
    span = F.transform(
        "surface_spans",
        lambda s, i: F.struct(i.cast("bigint").alias("pos"), s["surface"].alias("surface"), F.col("text").substr(s["surface_start"] + 1, s["surface_end"] - s["surface_start"]).alias("own"), s["surface_start"].alias("a"), s["surface_end"].alias("b")),
    )
    odd = F.filter(span, lambda s: (s["surface"] != s["own"]) & (s["a"] >= 0) & (s["b"] > s["a"]))
    rows = lines.select(F.col("line_key").cast("bigint").alias("line_key"), F.inline(odd)).select("line_key", "pos", "surface", "own")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            same = [bool(f := form(s)) and f == form(o) for s, o in zip(pdf["surface"], pdf["own"])]
            yield pdf.loc[np.array(same, bool), ["line_key", "pos"]]

    return rows.mapInPandas(run, "line_key bigint, pos bigint").distinct()

"""Text decoded with the wrong character encoding: finding it and undoing it.

A multinomial classifier over hashed byte bigrams (of the UTF-8 form) is trained on synthetically
garbled records: all clean records pass through every encoding chain, a chain being one or two
steps "written in A, read as B"; tasks count bigrams, which are summed (``fit``). For a text, every chain's bigram log ratios
against the clean class are summed over the best stretch of the text (so damage in part of a
text isn't diluted); the best chain is inverted on that stretch, and the inversion counts only
if every step is strictly decodable and the clean model prefers its result.

Defined results: null and empty texts are clean; a text with U+FFFD has lost characters and is
damaged whether or not the rest can be restored; repeated rows count once.
"""

from __future__ import annotations

import codecs
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm.sampling import smallest

#: Buckets that byte bigrams are hashed to.
BUCKETS = 1 << 16
#: Values of a column that problem 5 fits the classifier on, at most.
SAMPLE = 6000
#: Log ratio that a stretch must reach to be looked at, and to count where it can't be inverted.
LOOK, SURE = 6.0, 40.0
#: Results of recent texts that a worker keeps, at most.
KEPT = 20_000
#: A bigram is odd by as much as its clean log-probability is below this; an inversion counts if it
#: takes away at least EASED of oddness and leaves no more than LEFT of it.
ODD, EASED, LEFT = -9.5, 4.0, 0.4

_WIDE = ("cp932", "euc_jp", "gbk", "big5", "cp949")
_NARROW = ("latin_1", "cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp1250", "iso8859_15")


@lru_cache(None)
def _single(name: str) -> tuple[str, dict[str, int]]:
    """A one-byte encoding as 256 characters and back; undefined bytes are C1 controls, as browsers read them."""
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return "".join(chars), {c: b for b, c in reversed(list(enumerate(chars)))}


def read_as(data: bytes, name: str) -> str:
    """Decode, with replacement characters where a multi-byte encoding can't."""
    if name in _NARROW:
        return codecs.charmap_decode(data, "strict", _single(name)[0])[0]
    return data.decode(name, "replace")


def unread(text: str, name: str) -> bytes | None:
    """The bytes that were read as ``text``; None if no bytes give it."""
    if name in _NARROW:
        back = _single(name)[1]
        try:
            return bytes([back[c] for c in text])
        except KeyError:
            return None
    try:
        return text.replace("", "\xa0").encode(name)
    except UnicodeEncodeError:
        if name == "cp932":
            out = bytearray()
            for c in text:
                if 0xF8F0 <= ord(c) <= 0xF8F3:
                    out += bytes([(0xA0, 0xFD, 0xFE, 0xFF)[ord(c) - 0xF8F0]])
                    continue
                try:
                    out += c.encode(name)
                except UnicodeEncodeError:
                    return None
            return bytes(out)
        return None


def _chains() -> list[tuple[tuple[str, str], ...]]:
    one = [("utf-8", b) for b in (*_NARROW, *_WIDE)]
    one += [(a, b) for a in _WIDE for b in ("latin_1", "cp1252")]
    one += [(a, b) for a in _WIDE for b in _WIDE if a != b]
    one += [("latin_1", b) for b in ("mac_roman", "cp437", "cp850", "cp1251", "koi8_r")]
    one += [("mac_roman", "latin_1"), ("cp437", "latin_1"), ("latin_1", "utf-8")]
    two = [(("utf-8", a), ("utf-8", b)) for a in ("latin_1", "cp1252") for b in ("latin_1", "cp1252")]
    return [(x,) for x in one] + two


CHAINS = _chains()


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """``text`` after the chain; None where a step can't write it."""
    for a, b in chain:
        try:
            data = text.encode(a) if a != "latin_1" else text.encode("cp1252")
        except UnicodeEncodeError:
            return None
        text = read_as(data, b)
    return text


def invert(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text before the chain, if each step is strictly decodable."""
    if chain[-1][1] == "utf-8":
        return None  # reading with replacement loses the bytes
    data = unread(text, chain[-1][1])
    return None if data is None else _unwrite(data, chain)


def _unwrite(data: bytes, chain: tuple[tuple[str, str], ...]) -> str | None:
    """``invert`` from the bytes that the last step read."""
    a = chain[-1][0]
    if a == "utf-8" and data and (0x80 <= data[0] < 0xC2 or data[-1] >= 0xC0):
        return None  # starts or ends within a character, the usual failure
    try:
        text = data.decode("cp1252" if a == "latin_1" else a)
    except UnicodeDecodeError:
        return None
    return invert(text, chain[:-1]) if len(chain) > 1 else text


class _Written:
    """A text in the encoding that it was read in, from which the bytes of any stretch are cut."""

    def __init__(self, text: str, name: str) -> None:
        # the encodings have no state: a stretch's bytes are those of its characters
        if name in _NARROW:
            back = _single(name)[1]
            self.lacking = [n for n, c in enumerate(text) if c not in back]
            self.data, self.ends = bytes([back.get(c, 0) for c in text]), None
            return
        parts = [unread(c, name) for c in text]
        self.lacking = [n for n, b in enumerate(parts) if b is None]
        self.data = b"".join(b or b"" for b in parts)
        self.ends = [0, *accumulate(len(b or b"") for b in parts)]

    def part(self, x: int, y: int) -> bytes | None:
        """The bytes of text[x:y]; None if the encoding lacks one of its characters."""
        if self.lacking and (n := bisect_left(self.lacking, x)) < len(self.lacking) and self.lacking[n] < y:
            return None
        return self.data[x:y] if self.ends is None else self.data[self.ends[x] : self.ends[y]]


def _alike(a: str, b: str) -> int:
    """How many characters two texts begin with alike."""
    for n, (c, d) in enumerate(zip(a, b)):
        if c != d:
            return n
    return min(len(a), len(b))


#: Characters that no undamaged text has.
_UNREADABLE = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\ue000-\uf8ff\ufffd]")


def _bigrams(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, "uint8").astype("uint32")
    return (((b[:-1] * 256 + b[1:]) * np.uint32(2654435761)) >> np.uint32(16)).astype("int32")


def _pad(text: str) -> bytes:
    return b" " + text.encode("utf-8", "replace") + b" "


class Model:
    """Log ratios of every chain against the clean class, per bucket."""

    def __init__(self, ratio: np.ndarray, clean: np.ndarray, chains: list) -> None:
        self.ratio, self.clean, self.chains = ratio, clean, chains
        self.most = ratio.max(axis=0)
        self.by_bigram = np.ascontiguousarray(ratio.T)
        self._seen: dict[str, tuple[bool, str]] = {}

    @classmethod
    def fit(cls, texts: Iterable[str]) -> Model:
        """From records that are mostly clean: those with lost or control characters are left out."""
        return cls.of(*tally(sorted({t for t in texts if t and not _plainly_damaged(t)})))

    @classmethod
    def of(cls, counts: np.ndarray, made: np.ndarray) -> Model:
        """From the counts of ``tally``, which add up over texts."""
        smooth = lambda c, a: np.log((c + a) / (c.sum() + a * BUCKETS))
        # a bigram is as likely as in the kind of text that has it most; one that few records have may be damage
        kinds = [c for c in counts[:_KINDS] if c.sum()]
        clean = np.stack([smooth(np.where(c >= 1 + c.sum() / 20000, c, c / 4), 0.02) for c in kinds] or [np.zeros(BUCKETS)]).max(axis=0)
        extra = counts[_KINDS]
        clean = np.maximum(clean, np.where(extra >= 3, smooth(extra, 0.02), -99)) if extra.sum() else clean
        enough = [k for k in range(len(CHAINS)) if made[k] >= 5]
        rows, chains = [smooth(counts[_KINDS + 1 + k], 0.02) - clean for k in enough], [CHAINS[k] for k in enough]
        ratio = np.stack(rows) if rows else np.full((1, BUCKETS), -1.0)
        return cls(np.clip(ratio, -6, 6).astype("float32"), clean.astype("float32"), chains or [()])

    def stretches(self, text: str) -> list[tuple[float, int, int, int]]:
        """(log ratio, chain, first byte, end byte) of the best stretch of each promising chain, best first."""
        data = _pad(text)
        h = _bigrams(data)
        gain = self.most[h]
        if gain[gain > 0].sum() < LOOK or text.isascii():
            return []
        r = self.by_bigram[h]
        total = np.concatenate([np.zeros((1, r.shape[1]), "float32"), np.cumsum(r, axis=0)])
        low = np.minimum.accumulate(total, axis=0)
        rise = total - low
        end = rise.argmax(axis=0)
        best = rise[end, np.arange(r.shape[1])]
        out = []
        for c in np.nonzero(best >= LOOK)[0]:
            start = int(np.nonzero(total[: end[c] + 1, c] == low[end[c], c])[0][-1])
            out.append((float(best[c]), int(c), start, int(end[c]) + 1))
        return sorted(out, reverse=True)

    def oddness(self, text: str) -> float:
        return float(np.maximum(0.0, ODD - self.clean[_bigrams(_pad(text))]).sum())

    def undo_once(self, text: str, found: list[tuple[float, int, int, int]] | None = None) -> str | None:
        """One damaged stretch put right, if a predicted chain is strictly invertible there and the result is clean.
        ``found`` are the text's stretches where they are known."""
        data = _pad(text)
        best: tuple[float, str] | None = None
        found = self.stretches(text) if found is None else found
        all_odd = self.oddness(text)
        if not found or all_odd < EASED / 8:
            return None
        # a chain of two steps also points at its first step, which then is undone again
        named = [(self.chains[c], a, b) for _, c, a, b in found]
        own, other = [t for t in named if t[0][0][0] == "utf-8"], [t for t in named if t[0][0][0] != "utf-8"]
        tries = own[:10] + other[:6]
        tries += [(c, *tries[0][1:]) for c in dict.fromkeys((t[0][-1],) for t in named if len(t[0]) > 1)]
        tries += own[10:]
        sure = False
        words, runs = [m.span() for m in re.finditer(r"\S+", text)], [m.span() for m in _ODD_RUN.finditer(text)]
        written: dict[str, _Written] = {}
        for k, (chain, a, b) in enumerate(tries + other[6:]):
            if k == len(tries) and sure:
                break  # the others' turn comes when nothing strict is left to undo
            strict = chain[0][0] == "utf-8" and chain[-1][1] != "utf-8"  # hardly anything but damage decodes
            i = max(0, len(data[:a].decode("utf-8", "ignore")) - 1)
            j = min(len(text), max(len(data[: b + 1].decode("utf-8", "ignore")) - 1, i + 1))
            last = chain[-1][1]
            if last == "utf-8":
                continue  # reading with replacement loses the bytes
            if last not in written:
                written[last] = _Written(text, last)
            whole = written[last]
            for x, y in _spans(len(text), words, runs, i, j):
                piece = text[x:y]
                if piece.isascii() or (wrote := whole.part(x, y)) is None:
                    continue  # ASCII is the same in all encodings
                back = _unwrite(wrote, chain)
                if not back or back == piece or _UNREADABLE.search(back):
                    continue
                # the stretch that changed, in its surroundings
                left, right = text[max(0, x - 2) : x], text[y : y + 2]
                p = _alike(piece, back)
                q = min(_alike(piece[::-1], back[::-1]), min(len(piece), len(back)) - p)
                changed = len(piece) - p - q
                result = back[p : len(back) - q]
                if not strict and (changed < (3 if chain[-1][1] in _WIDE else 2 if chain[0][0] in _WIDE else 1) or sum(x.isalnum() for x in result) < 0.6 * len(result)):
                    continue  # few characters and marks make sense in another encoding by chance
                if chain[0][0] not in ("utf-8", *_WIDE) and all(x.isascii() or "\xc0" <= x <= "\u024f" for x in piece[p : len(piece) - q]):
                    continue  # accented letters are likelier meant than misread
                p, q = max(0, p - 2), max(0, q - 2)
                before = self.oddness(left + piece[p : len(piece) - q] + right)
                after = self.oddness(left + back[p : len(back) - q] + right)
                gain = before - after
                enough = gain > (0 if chain[-1][1] in _NARROW else EASED / 4) if strict else gain >= EASED and after <= (LEFT + 0.2 * (changed >= 6)) * before
                if enough and (best is None or gain > best[0]):
                    best, sure = (gain, text[:x] + back + text[y:]), strict
                    if self.oddness(best[1]) < 0.1 * all_odd:
                        return best[1]
        return best[1] if best else None

    def restore(self, text: str) -> tuple[bool, str]:
        """(damaged, text with every invertible stretch put right)."""
        damaged = "�" in text or bool(re.search("[\x80-\x9f]", text))
        if text.isascii():
            return False, text
        found = self.stretches(text)
        if not found and not damaged:
            return False, text
        now = text
        while (back := self.undo_once(now, found if now == text else None)) is not None:
            further = len(back) < len(now) or self.oddness(back) < self.oddness(now)  # a layer or an oddity less: this ends
            now, damaged = back if further else now, True
            if not further:
                break
        return damaged or (bool(found) and found[0][0] >= SURE), now

    def known(self, text: str) -> tuple[bool, str]:
        """``restore``, with the results for recent texts kept."""
        got = self._seen.get(text)
        if got is None:
            if len(self._seen) >= KEPT:
                self._seen.clear()
            got = self._seen[text] = self.restore(text)
        return got

    def suspicious(self, texts: list[str]) -> np.ndarray:
        """Which texts can hold damage at all: one pass over the bytes of a batch."""
        data = [_pad(t) for t in texts]
        joined = b"".join(data)
        if not joined:
            return np.zeros(0, bool)
        h = _bigrams(joined + b" ")
        starts = np.r_[0, np.cumsum([len(d) for d in data])[:-1]]
        total = np.add.reduceat(np.maximum(self.most[h] - 1.5, 0), starts)
        strange = np.add.reduceat(np.maximum(ODD - self.clean[h], 0), starts)
        ascii_ = np.array([t.isascii() for t in texts])
        lost = np.array(["\ufffd" in t for t in texts])
        return ((total >= LOOK / 2) & (strange >= EASED / 4) | lost) & ~ascii_


_SCRIPTS = (re.compile("[\u3040-\u30ff\uff66-\uff9f]"), re.compile("[\uac00-\ud7a3\u1100-\u11ff]"), re.compile("[\u4e00-\u9fff]"), re.compile("[^\x00-\x7f]"))


def _script(text: str) -> int:
    return next((i for i, p in enumerate(_SCRIPTS) if p.search(text)), len(_SCRIPTS))


def _plainly_damaged(text: str) -> bool:
    """Damage that needs no model; such records aren't fitted on."""
    if text.isascii():
        return False
    if _LOST.search(text):
        return True
    runs = _BEYOND.findall(text)
    if any(len(_SIGNS.findall(r)) * 3 > len(r) for r in runs if len(r) > 3):
        return True
    for r in runs:
        for name in (*_NARROW, "cp932", "gbk"):
            if name in _NARROW and r[0] not in _single(name)[1]:
                continue
            data = unread(r, name)
            if data is not None and len(data) > 1:
                try:
                    data.decode("utf-8")
                    return True
                except UnicodeDecodeError as e:
                    if e.start * 2 > len(data) and e.start > 6:
                        return True
    return False


_LOST, _BEYOND, _SIGNS = re.compile("[\x80-\x9f\ue000-\uf8ff\ufffd]"), re.compile("[^\x00-\x7f]{2,}"), re.compile("[\xa1-\xbf\xd7\xf7]")


def _count(texts: list[str]) -> np.ndarray:
    if not texts:
        return np.zeros(BUCKETS)
    return np.bincount(_bigrams(f" {'  '.join(texts)}  ".encode("utf-8", "replace")), minlength=BUCKETS).astype("float64")


#: Kinds of text that are counted apart.
_KINDS = len(_SCRIPTS) + 1


def _write(texts: list[str], name: str) -> tuple[list[int], bytes]:
    """Which of the texts an encoding can write, and these with zeros between."""
    try:  # all at once where it can write all
        return list(range(len(texts))), "\0".join(texts).encode("cp1252" if name == "latin_1" else name)
    except UnicodeEncodeError:
        pass
    at, out = [], []
    for i, t in enumerate(texts):
        try:
            out.append(t.encode("cp1252" if name == "latin_1" else name))
            at.append(i)
        except UnicodeEncodeError:
            pass
    return at, b"\0".join(out)


def _garble_all(texts: list[str]) -> Iterator[list[str]]:
    """``garble`` of all texts (none holds a zero) at once, for each chain: those that change and stay half readable."""
    written = {a: _write(texts, a) for a in {chain[0][0] for chain in CHAINS}}
    for chain in CHAINS:
        at, data = written[chain[0][0]]
        read = read_as(data, chain[0][1])
        for a, b in chain[1:]:
            own, data = _write(read.split("\0") if at else [], a)
            at, read = [at[i] for i in own], read_as(data, b)
        changed = [g for i, g in zip(at, read.split("\0") if at else [], strict=True) if g != texts[i]]
        yield [g for g in changed if g.count("\ufffd") * 2 < len(g)] if "\ufffd" in read else [g for g in changed if g]


def tally(texts: list[str], places: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bigrams of the texts of each kind, of their look-alikes and of what each chain makes of them, a row each;
    and how many texts each chain garbles. ``places`` choose each text's look-alike (else the order does)."""
    counts, made = np.zeros((_KINDS + 1 + len(CHAINS), BUCKETS)), np.zeros(len(CHAINS))
    kinds: list[list[str]] = [[] for _ in range(_KINDS)]
    for t in texts:
        kind = _script(t)
        kinds[kind].extend((t, t.upper(), t.lower()) if kind >= 3 else (t,))
    for k, found in enumerate((*kinds, _lookalikes(texts, places))):
        counts[k] = _count(found)
    for k, found in enumerate(_garble_all([t.replace("\0", " ") for t in texts if not t.isascii()])):
        counts[_KINDS + 1 + k], made[k] = _count(found), len(found)
    return counts, made


#: Characters beyond ASCII that stand together, but for one between.
_ODD_RUN = re.compile(r"[^\x00-\x7f\u3000-\uffff]+(?:[ -~]?[^\x00-\x7f\u3000-\uffff]+)*")


def _spans(size: int, words: list[tuple[int, int]], runs: list[tuple[int, int]], i: int, j: int) -> list[tuple[int, int]]:
    """The whole text, then places around [i, j): damage rarely starts exactly where the evidence does."""
    out = [(0, size)]
    out += [(x, y) for x in range(max(0, i - 3), min(i + 4, j)) for y in range(min(size, j + 3), max(i, j - 4), -1) if x < y]
    a = max([x for x, _ in words if x <= i], default=i)
    b = min([y for _, y in words if y >= j], default=j)
    out.append((a, b))
    out += [(x, y) for x, y in runs if x <= i < y or i <= x < j][:1]
    return list(dict.fromkeys(s for s in out if s[0] < s[1]))


def _lookalikes(texts: list[str], places: list[int] | None = None) -> list[str]:
    """Undamaged spellings that a corpus also holds: other widths, separate accents, blanks, letters drawn alike."""
    import unicodedata

    greek = str.maketrans("aeopcxyijsABEHIKMNOPTXo", "аеорсхуіјѕАВЕНІКМΝОРТХο")
    wide = {c: chr(c + 0xFEE0) for c in range(0x21, 0x7F)}
    out = []
    for k, t in zip(range(len(texts)) if places is None else places, texts):
        kind = k % 6
        if kind == 0:
            out.append(t.translate(wide))
        elif kind == 1:
            out.append(unicodedata.normalize("NFD", t))
        elif kind == 2:
            out.append(t.replace(" ", (" ", " ", " ", " ", "　", " ")[k // 6 % 6]))
        elif kind == 3:
            letters = list(t)
            letters[::4] = t[::4].translate(greek)
            out.append("".join(letters))
        elif kind == 4:
            out.append(("​", "‌", "‍", "⁠", "﻿", "­", "‎")[k // 6 % 7].join((t[: len(t) // 2], t[len(t) // 2 :])))
        else:
            out.append(t.replace("'", "’").replace(" - ", " – "))
    narrow, radicals = _narrow_kana(), _radicals()
    katakana, drawn = re.compile("[\u30a1-\u30fa]"), re.compile(f"[{''.join(map(chr, radicals))}]")
    for t in texts:
        if t.isascii():
            continue
        if katakana.search(t):
            out.append(unicodedata.normalize("NFD", t).translate(narrow))
        if drawn.search(t):
            out.append(t.translate(radicals))
    return out


@lru_cache(1)
def _narrow_kana() -> dict[int, str]:
    """Katakana and their separate marks in half width."""
    import unicodedata

    return {ord(unicodedata.normalize("NFKC", chr(i))): chr(i) for i in range(0xFF61, 0xFFA0)}


@lru_cache(1)
def _radicals() -> dict[int, str]:
    """Han letters that are also encoded as radicals."""
    import unicodedata

    return {ord(unicodedata.normalize("NFKC", chr(i))): chr(i) for i in range(0x2F00, 0x2FD6)}


def fit(spark: SparkSession, columns: list[tuple[DataFrame, str, str]], sample: int | None = None) -> Model:
    """Train on all distinct values of each (table, key column, text column), or on at most ``sample`` of each.

    Of all values each task sends its counts, at most a row per chain and bucket; the driver gets their sums."""
    if sample is not None:
        texts: set[str] = set()
        for df, key, column in columns:
            texts.update(r["t"] for r in smallest(df.select(F.col(key).alias("key"), F.col(column).cast("string").alias("t")).filter("t is not null"), "key", sample))
        return Model.fit(texts)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = made = None
        for pdf in batches:
            texts = [t for t in pdf["t"] if not _plainly_damaged(t)]
            more = tally(texts, [zlib.crc32(t.encode("utf-8", "replace")) for t in texts])
            counts, made = more if counts is None else (np.add(counts, more[0], out=counts), made + more[1])
        if counts is not None:
            flat = np.concatenate([counts.ravel(), made])
            at = np.nonzero(flat)[0]
            yield pd.DataFrame({"at": at.astype("int32"), "n": flat[at].astype("int64")})

    values = reduce(DataFrame.unionAll, [df.select(F.col(column).cast("string").alias("t")).filter("t != ''") for df, _, column in columns]).distinct()
    total = values.mapInPandas(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    rows = _KINDS + 1 + len(CHAINS)
    flat = np.zeros(rows * BUCKETS + len(CHAINS))
    flat[total["at"].to_numpy()] = total["n"].to_numpy()
    return Model.of(flat[: rows * BUCKETS].reshape(rows, BUCKETS), flat[rows * BUCKETS :])


def repairer(spark: SparkSession, model: Model):
    """A function for Python workers that puts the wrongly decoded ones of a list of texts right."""
    shared = _share(spark, model)

    def run(texts: list[str]) -> list[str]:
        m = _worker_model(shared)
        out = list(texts)
        for i in np.nonzero(m.suspicious(out))[0] if out else []:
            out[i] = m.known(out[i])[1]
        return out

    return run


def damage_test(spark: SparkSession, model: Model):
    """A function for Python workers that tells which of a list of texts are damaged."""
    shared = _share(spark, model)

    def run(texts: list[str]) -> list[bool]:
        m = _worker_model(shared)
        return [bool(s) and m.known(t)[0] for t, s in zip(texts, m.suspicious(texts))] if texts else []

    return run


def _share(spark: SparkSession, model: Model):
    """The model for workers, with a name of its own; chains x BUCKETS half floats: 9 MB."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, model.ratio.astype("float16"), model.clean, model.chains))


_models: dict[str, Model] = {}


def _worker_model(shared) -> Model:
    """The model of a broadcast, unpacked once a worker."""
    name, ratio, clean, chains = shared.value
    if name not in _models:
        _models.clear()
        _models[name] = Model(ratio.astype("float32"), clean, chains)
    return _models[name]


def damage(df: DataFrame, key: str, column: str, model: Model) -> DataFrame:
    """(key, text, restored) of the damaged values of a column; a value that repeats is looked at once per batch."""
    shared = _share(df.sparkSession, model)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = _worker_model(shared)
        for pdf in batches:
            texts = pdf["text"].to_numpy()
            hit = np.nonzero(m.suspicious(list(texts)))[0] if len(texts) else np.empty(0, int)
            keep, restored = [], []
            for i in hit:
                t = texts[i]
                damaged, back = m.known(t)
                if damaged:
                    keep.append(i)
                    restored.append(back)
            out = pdf.iloc[keep].copy()
            out["restored"] = pd.Series(restored, dtype=object, index=out.index)
            yield out

    rows = df.select(F.col(key).alias("key"), F.col(column).cast("string").alias("text")).filter(F.col("text").isNotNull())
    return rows.mapInPandas(run, f"key {df.schema[key].dataType.simpleString()}, text string, restored string")

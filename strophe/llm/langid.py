"""Languages of texts and of the stretches of texts in several languages.

Every character n-gram is looked up in bit-sliced Bloom filters: position ``h`` of the table is a
byte whose bit L says that some n-gram of language L hashes there, so the AND over an n-gram's
positions gives all languages that contain it at once. Per-language popcounts over a unit (a
sentence of a document, a word of a line) are corrected for the filters' false positives and
become log-likelihoods; a Viterbi pass with a price on every change of language splits a text.

An n-gram belongs to a language if it is frequent enough there against every other language, so
wrong labels in the training texts don't leak n-grams into other languages' filters. Training counts
the n-grams of all labelled texts in Spark; the table grows with the n-grams it holds (``train``).

Defined results: null, empty and wordless texts have no language and give no row; names, numbers,
marks and sung syllables are no evidence; repeated rows count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm.sampling import smallest
from strophe.session import cut_lineage

LANGS = ("en", "ja", "es", "fr", "de", "pt", "ko", "zh")
#: Spellings of the languages' names in labels (fixed values of ISO 639 and common names).
NAMES = {
    "en": ("en", "eng", "english", "englisch", "anglais", "ingles", "inglés"),
    "ja": ("ja", "jpn", "jp", "japanese", "日本語", "japonais"),
    "es": ("es", "spa", "esp", "spanish", "castilian", "español", "espanol"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "ko": ("ko", "kor", "kr", "korean", "한국어"),
    "zh": ("zh", "zho", "chi", "cmn", "cn", "chinese", "mandarin", "中文", "汉语"),
}
#: Labelled documents that problem 10 trains the filters on, at most.
SAMPLE_DOCUMENTS = 3000
#: log2 of the filter's positions at least and at most (four times the n-grams of a language in between), and hash functions.
BITS, MOST_BITS, HASHES = 20, 24, 2
#: An n-gram is a language's if its share there is at least this part of its largest share anywhere.
SHARE = 0.4
#: Times that an n-gram of several languages should have been seen in another before its absence means something.
UNSEEN = 15.0
#: Characters that are worked on at once.
STEP = 250_000
#: Price of a change of language, in nats, between the sentences of a document and the words of a line.
CHANGE_SENTENCE, CHANGE_WORD = 6.0, 9.0
#: Log-likelihood of an n-gram that a language has and has not; neighbours overlap, so they are weak evidence each.
HIT, MISS = 0.5, -1.0

_SYLLABLES = "la|na|oh|ooh|ah|aah|hey|yeah|yea|da|du|dum|do|sha|mm++|hmm++|woah|whoa|wo|ei|ay|uh|ha|ho|doo|ba|bam|ら|ラ|な|ナ|あ|ア|ー|お|オ|ん|ン|う|ウ|え|エ|ぁ|ァ|わ|ワ|い|イ|나|라|아|오|우|워|예|에|헤이|음|啦|啊|哦|呜|噢|嗯|呀|喔|嘿"
_SUNG = re.compile(f"(?:{_SYLLABLES})+")


def _singing() -> np.ndarray:
    """0 no letter, 1 a letter of sung syllables, 2 another letter; for all characters."""
    table = np.zeros(0x110000, "uint8")
    for m in re.finditer(r"[^\W\d_]+", np.arange(0x110000, dtype="uint32").tobytes().decode("utf-32-le", "surrogatepass")):
        table[m.start() : m.end()] = 2
    table[[ord(c) for c in set(_SYLLABLES) if c.isalpha()]] = 1
    return table


_SINGING = _singing()


def _sung(text: str) -> list[tuple[int, int]]:
    """Where runs of letters are sung syllables from end to end; few runs have only letters of such and are matched."""
    kind = _SINGING[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "uint32")]
    step = np.diff((kind > 0).view("int8"), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.nonzero(step == 1)[0], np.nonzero(step == -1)[0]
    others = np.r_[0, np.cumsum(kind == 2)]
    few = others[starts] == others[ends]
    return [(a, b) for a, b in zip(starts[few].tolist(), ends[few].tolist()) if _SUNG.fullmatch(text, a, b)]


def label_code(c: Column) -> Column:
    """The code that a label names in any spelling; null if it names none of the languages."""
    bare = F.regexp_extract(F.lower(F.trim(c)), r"^([\p{L}]+)", 1)
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(bare.isin(*names), code).otherwise(out)
    return out


#: Strings that are marks of formats and models, and addresses; they are no words (fixed values).
_MARKERS = re.compile(r"<\|[^<>|\n]{1,40}\|>|</?[A-Za-z_]{1,20}>|\[/?[A-Z_]{2,20}\]|\{\{[^{}\n]{1,40}\}\}|https?://\S+")


def plain(text: str) -> str:
    """Lower case, compatibility forms and look-alike letters resolved: spelling tricks aren't another language."""
    if "<" in text or "[" in text or "{" in text or "://" in text:
        text = _MARKERS.sub(" ", text)
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", text)
    text = _HIDDEN.sub("", text)
    if _FOREIGN.search(text):
        text = text.translate(_LATIN)
    return text.lower()


_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
_FOREIGN = re.compile("[\u0370-\u03ff\u0400-\u04ff]")
_LATIN = str.maketrans("аеорсхуіјѕһԁАВЕНІКМОРСТХУЅЈοαΑΒΕΖΗΙΚΜΝΟΡΤΥΧν", "aeopcxyijshdABEHIKMOPCTXYSJoaABEZHIKMNOPTYXv")


def _classes() -> np.ndarray:
    """0 no letter, 1 letters of words with blanks between, 2 kana and han; for the characters of the first two planes."""
    table = np.zeros(0x32000, "uint8")
    for a, b in ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x300, 0x36F), (0x370, 0x52F), (0x1100, 0x11FF), (0x1E00, 0x1EFF), (0xAC00, 0xD7A3)):
        table[a : b + 1] = 1
    for a, b in ((0x3005, 0x3007), (0x3041, 0x3096), (0x309D, 0x309F), (0x30A1, 0x30FA), (0x30FC, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x31FFF)):
        table[a : b + 1] = 2
    return table


_CLASS = _classes()
_KANA = np.zeros(0x3100, bool)
_KANA[0x3041:0x3100] = True
#: Languages of a filter byte as eight counters in one word.
_LANES = np.array([sum(((m >> i) & 1) << (8 * i) for i in range(8)) for m in range(256)], "uint64")
_LONGEST = 200  # letters of a word; a longer run is cut (it would overflow the counters)


class Grams:
    """The n-grams of a batch of texts, by size: hashes in order and the word each is of.

    Words are runs of letters of one class; runs of kana and han also end where kana gives way to
    han, and after 64 letters; other runs of more than 200 letters are cut after every 64. N-grams of 3 to 5 letters may take in the blank around a word,
    those of kana and han have 1 to 3 letters.
    """

    def __init__(self, texts: list[str]) -> None:
        self.text = "\n".join(texts) + "\n"
        cp = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "uint32")
        kind = _CLASS[np.minimum(cp, len(_CLASS) - 1)]
        n = len(cp)
        kana = _KANA[np.minimum(cp, len(_KANA) - 1)]
        edge = np.r_[True, (kind[1:] != kind[:-1]) | ((kind[1:] == 2) & ((kana[:-1] & ~kana[1:]) | (np.arange(1, n) % 64 == 0)))] & (kind > 0)
        word = np.cumsum(edge, dtype="int32") - 1
        size = np.bincount(word[kind > 0]) if edge.any() else np.zeros(1, "int64")
        if size.max() > _LONGEST:  # letters without blanks between are cut like those of kana and han
            inner = np.arange(n) - np.nonzero(edge)[0][np.maximum(word, 0)]
            edge |= (kind > 0) & (size[np.maximum(word, 0)] > _LONGEST) & (inner % 64 == 0)
            word = np.cumsum(edge, dtype="int32") - 1
        self.starts = np.nonzero(edge)[0]
        self.words = len(self.starts)
        self.dense = kind[self.starts] == 2  # words of kana and han
        word = np.where(kind > 0, word, -1)
        one = np.where(kind == 0, np.uint32(32), cp) * np.uint32(0x9E3779B1)
        h = one
        self.families: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(1, 6):
            if k > 1:
                if n < k:
                    break
                h = (h[:-1] * np.uint32(0x85EBCA6B)) ^ one[k - 1 :]
            first, last = word[: n - k + 1], word[k - 1 :]
            if k <= 3:
                at = np.nonzero((kind[: n - k + 1] == 2) & (first == last))[0]
                if len(at):
                    self.families.append((h[at], first[at]))
            if k >= 3:
                inner = word[1 : n - k + 2]
                ok = (kind[1 : n - k + 2] == 1) & (inner == word[k - 2 : n - 1])
                ok &= ((first == inner) | (kind[: n - k + 1] == 0)) & ((last == inner) | (kind[k - 1 :] == 0))
                at = np.nonzero(ok)[0]
                if len(at):
                    self.families.append((h[at], inner[at]))

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.families:
            return np.empty(0, "uint32"), np.empty(0, "int32")
        return np.concatenate([f[0] for f in self.families]), np.concatenate([f[1] for f in self.families])


def _positions(h: np.ndarray, bits: int) -> list[np.ndarray]:
    mix = h ^ (h >> np.uint32(15))
    return [(mix * np.uint32(c)) >> np.uint32(32 - bits) for c in (0x2C1B3C6D, 0x297A2D39)[:HASHES]]


def _set(table: np.ndarray, ids: np.ndarray, counts: np.ndarray, total: np.ndarray) -> None:
    """Put n-grams, counted by language, into the filters of the languages that have them; ``total`` are the languages' counts of all."""
    share = counts / np.maximum(total, 1)
    has = (share >= SHARE * share.max(axis=0)) & (counts >= 2)
    # what several languages have (names) is no evidence against one whose texts are too few to show it
    common = has.sum(axis=0) >= 3
    usual = np.where(has, share, 0).sum(axis=0) / np.maximum(has.sum(axis=0), 1)
    has |= common & (total * usual < UNSEEN)
    for i in range(8):
        for p in _positions(ids[has[i]], len(table).bit_length() - 1):
            # each position takes the languages of all n-grams that hash to it
            table[p] |= np.uint8(1 << i)


def _owners(texts: list[str], grams: Grams) -> np.ndarray:
    """The text that each word is of."""
    return np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), grams.starts, side="right") if texts else np.empty(0, int)


class Filters:
    """Bit-sliced Bloom filters of all languages: one byte per position, one bit per language."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table
        fill = np.array([((table >> np.uint8(i)) & 1).mean() for i in range(8)])
        self.false = fill**HASHES

    def positions(self, h: np.ndarray) -> list[np.ndarray]:
        return _positions(h, len(self.table).bit_length() - 1)

    @classmethod
    def train(cls, texts: list[str], langs: list[int]) -> Filters:
        """From labelled texts of which some labels are wrong; a second round leaves out texts that the first contradicts."""
        grams = Grams(texts)
        line, lang = _owners(texts, grams), np.array(langs, int)
        h, unit = grams.all()
        first = cls(cls._build(h, lang[line][unit]))
        ok = first.agrees(texts, grams, lang)[line][unit]
        return cls(cls._build(h[ok], lang[line][unit][ok])) if ok.any() else first

    def agrees(self, texts: list[str], grams: Grams, lang: np.ndarray) -> np.ndarray:
        """Whether each text's likeliest language is the given one."""
        per = np.zeros((len(texts), 8))
        if grams.words:
            own = _owners(texts, grams)
            at = np.nonzero(np.r_[True, own[1:] != own[:-1]])[0]
            per[own[at]] = np.add.reduceat(self.words(grams).astype("float64"), at, axis=0)
        return (per.argmax(axis=1) == lang) & (per.max(axis=1) > 0) if len(texts) else np.empty(0, bool)

    @classmethod
    def _build(cls, h: np.ndarray, lang: np.ndarray) -> np.ndarray:
        table = np.zeros(1 << BITS, "uint8")
        if not len(h):
            return table
        ids, inverse = np.unique(h, return_inverse=True)
        counts = np.zeros((8, len(ids)))
        for i in range(8):
            counts[i] = np.bincount(inverse[lang == i], minlength=len(ids))
        _set(table, ids, counts, counts.sum(axis=1, keepdims=True))
        return table

    def words(self, grams: Grams) -> np.ndarray:
        """(words, 8): log-likelihood of every word by the corrected popcounts of its n-grams."""
        n = np.zeros(grams.words, "float32")
        seen = np.zeros((grams.words, 8), "float32")
        for h, unit in grams.families:
            p = self.positions(h)
            mask = self.table.take(p[0])
            for q in p[1:]:
                mask &= self.table.take(q)
            at = np.nonzero(np.r_[True, unit[1:] != unit[:-1]])[0]
            words = unit[at]
            n[words] += np.diff(np.r_[at, len(unit)])
            seen[words] += np.add.reduceat(_LANES.take(mask), at).view("uint8").reshape(-1, 8)
        true = np.clip((seen - n[:, None] * self.false.astype("float32")) / (1 - self.false).astype("float32"), 0, n[:, None])
        out = MISS * n[:, None] + (HIT - MISS) * true
        # n-grams that no language has (names) say nothing; one word of blanks-between scripts can't decide alone
        half = np.maximum(out[:, :4], out[:, 4:])  # faster than a maximum along short rows
        half = np.maximum(half[:, :2], half[:, 2:])
        best = np.maximum(half[:, :1], half[:, 1:])
        return np.maximum(out, best - np.where(grams.dense, 8.0 + n, 8.0)[:, None]).astype("float32") - np.minimum(best, 0).astype("float32")


_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”’)\]]*\s+|(?<=[。！？])[」』”’）]*|\n+|\r+")
#: Matches that end where those of _SENTENCE do; the set in front lets the search skip all other characters.
_ENDS = re.compile(r"[.!?…。！？\n\r](?:(?<=[.!?…])[\"'»”’)\]]*\s+|(?<=[。！？])[」』”’）]*|(?<=\n)\n*|(?<=\r)\r*)")


def _viterbi(score: np.ndarray, owner: np.ndarray, count: int, price: float) -> np.ndarray:
    """The best language of every unit, for units in order of their owner (texts side by side, one step at a time)."""
    path = np.full(len(owner), -1, "int8")
    if not len(owner):
        return path
    first = np.searchsorted(owner, np.arange(count))
    length = np.bincount(owner, minlength=count)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    steps = int(length[order[0]])
    active = np.array([np.searchsorted(-length[order], -t, side="left") for t in range(steps)])  # texts longer than t
    best = score[first[order]].astype("float64")
    back = [np.zeros((len(order), 8), "int8")]
    for t in range(1, steps):
        a = active[t]
        cur = best[:a]
        top = cur.argmax(axis=1)
        jump = cur[np.arange(a), top] - price
        stay = cur >= jump[:, None]
        back.append(np.where(stay, np.arange(8, dtype="int8"), top[:, None].astype("int8")))
        best[:a] = np.where(stay, cur, jump[:, None]) + score[first[order[:a]] + t]
    state = np.zeros(len(order), "int8")
    state[:] = best.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        at = first[order[:a]] + t
        path[at] = state[:a]
        if t:
            state[:a] = back[t][np.arange(a), state[:a]]
    return path


class Splitter:
    """Stretches of languages of texts, by sentences or by words."""

    def __init__(self, filters: Filters, sentences: bool) -> None:
        self.filters, self.sentences = filters, sentences
        self.price = CHANGE_SENTENCE if sentences else CHANGE_WORD

    def split(self, texts: list[str]) -> list[list[tuple[int, float]]]:
        """For each text (language, confidence) of its maximal stretches, in order."""
        texts = [plain(t).replace("\n", "\r") for t in texts]
        grams = Grams(texts)
        score = self.filters.words(grams)
        ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.empty(0, int)
        owner = np.searchsorted(ends, grams.starts, side="right")
        joined = grams.text
        if sung := _sung(joined):
            for a, b in np.searchsorted(grams.starts, sung).tolist():
                score[a:b] = 0.0
        if self.sentences:
            cuts = np.array([m.end() for m in _ENDS.finditer(joined)], "int64")
            sent = np.searchsorted(cuts, grams.starts, side="right")
            at = np.nonzero(np.r_[True, sent[1:] != sent[:-1]])[0] if len(sent) else np.empty(0, int)
            s = np.add.reduceat(score, at, axis=0) if len(at) else score
            best = s.max(axis=1, keepdims=True)
            score = np.maximum(s, best - 16.0)
            owner = owner[np.r_[at[1:], len(owner)] - 1] if len(at) else owner
        path = _viterbi(score, owner, len(texts), self.price)
        out: list[list[tuple[int, float]]] = [[] for _ in texts]
        if not len(path):
            return out
        new = np.r_[True, (path[1:] != path[:-1]) | (owner[1:] != owner[:-1])]
        runs = np.nonzero(new)[0]
        total = np.add.reduceat(score.astype("float64"), runs, axis=0)
        every, lang = np.arange(len(runs)), path[runs]
        top = total[every, lang]
        total[every, lang] = -np.inf
        margin = top - total.max(axis=1)
        sure = (top > 0.5) & (margin >= 2.0)  # the rest are names, marks, sung syllables
        confidences = 1 / (1 + np.exp(-np.minimum(30.0, margin[sure] / 2)))
        for text, lang, confidence in zip(owner[runs][sure].tolist(), lang[sure].tolist(), confidences.tolist()):
            got = out[text]
            if got and got[-1][0] == lang:
                got[-1] = (lang, max(got[-1][1], confidence))
            else:
                got.append((lang, confidence))
        return out


def sentence_languages(filters: Filters, sentences: list[str]) -> np.ndarray:
    """The language of each sentence by itself; len(LANGS) where there is no evidence."""
    texts = [plain(t).replace("\n", "\r") for t in sentences]
    grams = Grams(texts)
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.empty(0, int)
    per = np.zeros((len(texts), 8))
    np.add.at(per, np.searchsorted(ends, grams.starts, side="right"), filters.words(grams))
    return np.where(per.max(axis=1) > 0.5, per.argmax(axis=1), len(LANGS)) if len(texts) else np.empty(0, "int64")


def slices(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Consecutive ranges of about ``most`` in total; one larger text makes a range of its own."""
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            out.append((start, i))
            start, total = i, 0
        total += n
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


def train(spark: SparkSession, sources: list[tuple]) -> Filters:
    """Filters from the labelled texts of each (table, key column, text column, label column): from all of them, or,
    where a bound is given as a fifth value, from so many of each at most.

    Of all texts each is counted as often as it has rows that differ. Tasks count n-grams by language, Spark adds them up
    and sets the table's bits; only the table comes to the driver. The second round subtracts what the texts count that
    the first contradicts."""
    tables = [df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("t"), label_code(F.col(label)).alias("l")).filter("t is not null and l is not null") for df, key, text, label, *_ in sources]
    if all(len(s) > 4 for s in sources):
        rows = [r for df, s in zip(tables, sources) for r in smallest(df, "key", s[4])]
        return Filters.train([plain(r["t"]).replace("\n", " ") for r in rows], [LANGS.index(r["l"]) for r in rows])
    texts = cut_lineage(reduce(DataFrame.unionAll, [df.distinct().groupBy("t", "l").agg(F.count("*").alias("n")) for df in tables]))
    counts = cut_lineage(_added(texts.mapInPandas(lambda batches: _counted(batches, None), _GRAMS)))
    first, _ = _filters(counts)
    shared = spark.sparkContext.broadcast(first.table)
    wrong = texts.mapInPandas(lambda batches: _counted(batches, Filters(shared.value)), _GRAMS)
    rest = counts.unionAll(_added(wrong)).groupBy("g").agg(*[F.sum(c).alias(c) for c in _SUMS])
    second, some = _filters(cut_lineage(rest))
    return second if some else first


_SUMS = [f"l{i}" for i in range(8)]
_GRAMS = "g int, l int, n bigint"


def _added(grams: DataFrame) -> DataFrame:
    """(g, l0..l7): how often each n-gram was seen in each language."""
    return grams.groupBy("g").agg(*[F.sum(F.when(F.col("l") == i, F.col("n")).otherwise(0)).alias(c) for i, c in enumerate(_SUMS)])


def _counted(batches: Iterable[pd.DataFrame], first: Filters | None) -> Iterator[pd.DataFrame]:
    """(n-gram, language, times) of texts; if there are filters, of those that they contradict, less than nothing."""
    for pdf in batches:
        for (lang, once), part in pdf.groupby([pdf["l"], pdf["n"] == 1]):  # most texts count once: their n-grams need no weights
            every = [plain(t).replace("\n", " ") for t in part["t"]]
            every = [t + " " * (-(len(t) + 1) % 64) for t in every]  # words are cut alike wherever a text stands
            code, times = LANGS.index(lang), part["n"].to_numpy("int64")
            for a, b in slices([len(t) for t in every], STEP):
                # after blanks, so that the first text's first word has one before it as the others' have
                texts, often = [" " * 63, *every[a:b]], np.r_[0, times[a:b]]
                grams = Grams(texts)
                if first is not None:
                    wrong = np.nonzero(~first.agrees(texts, grams, np.full(len(texts), code)))[0]
                    texts, often = [texts[i] for i in wrong], often[wrong]
                    grams = Grams(texts)
                h, unit = grams.all()
                if once:
                    ids, n = np.unique(h, return_counts=True)
                else:
                    ids, inverse = np.unique(h, return_inverse=True)
                    n = np.bincount(inverse, weights=often[_owners(texts, grams)[unit]], minlength=len(ids))
                yield pd.DataFrame({"g": ids.view("int32"), "l": np.full(len(ids), code, "int32"), "n": n.astype("int64") * (1 if first is None else -1)})


def _filters(counts: DataFrame) -> tuple[Filters, bool]:
    """The filters of counted n-grams, and whether any is left."""
    row = counts.agg(*[F.sum(c).alias(c) for c in _SUMS], *[F.count_if(F.col(c) >= 2).alias(f"{c}_ids") for c in _SUMS]).first()
    total = np.array([[row[c] or 0] for c in _SUMS], "float64")
    bits = min(MOST_BITS, max(BITS, (4 * max(row[f"{c}_ids"] for c in _SUMS) - 1).bit_length()))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << bits, "uint8")
        for pdf in batches:
            _set(table, pdf["g"].to_numpy("int32").view("uint32"), pdf[_SUMS].to_numpy("float64").T, total)
        at = np.nonzero(table)[0]
        yield pd.DataFrame({"at": at.astype("int32"), "bits": table[at].astype("int16")})

    found = counts.mapInPandas(run, "at int, bits smallint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << bits, "uint8")
    table[found["at"].to_numpy()] = found["bits"].to_numpy().astype("uint8")
    return Filters(table), bool(total.any())


def languages(df: DataFrame, key: str, text: str, label: str, filters: Filters, sentences: bool, repair=None) -> DataFrame:
    """(key, seg, lang, confidence, label): every stretch of every text with words; ``label`` is the code its label names.
    ``repair`` is an optional function of a list of texts that puts wrongly decoded ones right first."""
    shared = df.sparkSession.sparkContext.broadcast(filters.table)  # a byte per position

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        splitter = Splitter(Filters(shared.value), sentences)
        for pdf in batches:
            which, texts = pd.factorize(pdf["text"])
            texts = list(texts)  # one that repeats is looked at once per batch
            if repair is not None:
                texts = repair(texts)
            found = []
            for a, b in slices([len(t) for t in texts], STEP):
                found += splitter.split(texts[a:b])
            found = [found[i] for i in which]
            counts = [len(x) for x in found]
            out = pdf.loc[pdf.index.repeat(counts), ["key", "label"]].copy()
            out["seg"] = np.concatenate([np.arange(c, dtype="int32") for c in counts]) if counts else np.empty(0, "int32")
            out["n"] = np.repeat(counts, counts).astype("int32")
            out["lang"] = pd.Series([LANGS[a] for x in found for a, _ in x], dtype=object, index=out.index)
            out["confidence"] = np.array([c for x in found for _, c in x], "float64")
            yield out

    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text"), label_code(F.col(label)).alias("label")).filter("text is not null and trim(text) != ''")
    return rows.mapInPandas(run, "key bigint, label string, seg int, n int, lang string, confidence double")


def mislabelled(found: DataFrame) -> DataFrame:
    """(rec_id, seg, lang): one row with seg -1 for a text in one language whose label doesn't name it, all stretches of a text in several."""
    wrong = (F.col("n") > 1) | ~F.col("label").eqNullSafe(F.col("lang"))
    return found.filter(wrong).select(F.col("key").alias("rec_id"), F.when(F.col("n") > 1, F.col("seg")).otherwise(-1).cast("int").alias("seg"), "lang").distinct()

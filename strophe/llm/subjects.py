"""Subject areas of documents.

Terms are words (pairs of letters for scripts without blanks), weighted by the square of their
inverse frequency within their language: words of phrasing are common in each language, words of
a subject are not. A truncated singular value decomposition of the documents by terms, computed
by distributed subspace iteration over all documents, gives every term a vector; a sentence is
the weighted sum of its terms' vectors. Each language has its own block of the matrix and its own leading
directions: one decomposition of all would spend them on the languages with most documents. Seed centroids per language and subject (and one for text about no
subject) come from labelled documents and are refined in turns: sentences of labelled documents go
to the nearest of their document's centroids, sentences of documents that are clearly about a
subject join with a small weight. A document is about the subjects that are nearest by cosine for
at least ``SENTENCES`` of its sentences.

Defined results: null, empty and wordless texts have no subject; without labelled documents there
are no centroids and no rows; repeated labels count once; a label that is no listed subject means none.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophe.llm import langid
from strophe.session import cut_lineage

#: Hash buckets of the terms of a language, and the languages (the last for text of none).
BUCKETS, LANGUAGES = 1 << 14, len(langid.LANGS) + 1
#: Dimensions (of each language) and passes of the decomposition; power of the inverse frequency; least sentences of a term.
DIMS, PASSES, POWER, LEAST = 64, 4, 2.0, 3
#: A sentence counts for a centroid from this cosine and lead over the next on.
COSINE, LEAD = 0.2, 0.05
#: Sentences that make a subject of a document.
SENTENCES = 2
#: Rounds of refinement on labelled documents, then on all; weight, lead and sentences that let others join.
ROUNDS, JOIN_ROUNDS, JOIN_WEIGHT, JOIN_LEAD, JOIN_SENTENCES = 4, 2, 0.3, 0.2, 4
#: Rows of a block of the term matrix as it is summed up.
BLOCK = 2048
#: Tasks of a pass at most (more partitions are taken together), and partials that one group adds up.
MOST_TASKS, FAN_IN = 2048, 48

_WORD = re.compile(r"[^\W\d_]+")
_NO_BLANKS = re.compile("[぀-ヿ㐀-鿿]")


def terms(sentence: str) -> list[str]:
    out = []
    for m in _WORD.finditer(sentence.lower()):
        w = m.group()
        if _NO_BLANKS.match(w):
            out += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
        else:
            out.append(w[:2] if "가" <= w[0] <= "힣" else w)  # Korean words end in particles
    return out


def _term_ids(sentence: str, lang: int) -> list[int]:
    from xxhash import xxh32_intdigest

    return [lang * BUCKETS + xxh32_intdigest(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in dict.fromkeys(terms(sentence))]


def features(documents: DataFrame, key: str, text: str, filters: langid.Filters) -> DataFrame:
    """(key, ends, ids): the distinct term ids of each sentence, one after the other; ``ends`` says where each sentence ends."""
    shared = documents.sparkSession.sparkContext.broadcast(filters.table)  # 2**BITS bytes

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = langid.Filters(shared.value)
        for pdf in batches:
            texts = list(pdf["text"])
            for a, b in langid.slices([len(t) for t in texts], langid.STEP):
                parts = [[s for s in langid._SENTENCE.split(t) if s and s.strip()] for t in texts[a:b]]
                flat = [s for p in parts for s in p]
                langs = langid.sentence_languages(find, flat)
                ids = [_term_ids(s, int(g)) for s, g in zip(flat, langs)]
                rows, at = [], 0
                for p in parts:
                    own = ids[at : at + len(p)]
                    at += len(p)
                    rows.append((np.cumsum([len(x) for x in own]).astype("int32").tolist(), [i for x in own for i in x]))
                yield pd.DataFrame({"key": pdf["key"].iloc[a:b].to_numpy(), "ends": [r[0] for r in rows], "ids": [r[1] for r in rows]})

    rows = documents.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("text")).filter("text is not null and text != ''")
    return rows.mapInPandas(run, "key bigint, ends array<int>, ids array<int>")


def _small(batches: Iterable[pd.DataFrame], rows: int = 500) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for a in range(0, len(pdf), rows):
            yield pdf.iloc[a : a + rows]


def _flat(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, sentence of each id, document of each sentence) of a batch; sentences without terms drop out."""
    ends = [np.asarray(e, "int64") for e in pdf["ends"]]
    sizes = [np.diff(np.r_[0, e]) for e in ends]
    ids = np.concatenate([np.asarray(x, "int64") for x in pdf["ids"]]) if len(pdf) else np.empty(0, "int64")
    size = np.concatenate(sizes) if sizes else np.empty(0, "int64")
    doc = np.repeat(np.arange(len(pdf)), [len(s) for s in sizes])
    keep = size > 0
    doc, size = doc[keep], size[keep]
    return ids, np.repeat(np.arange(len(size)), size), doc


def _by_run(rows: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Sums of values (n, K) over runs of equal, ascending rows."""
    out = np.zeros((count, values.shape[1]), "float32")
    if len(rows):
        at = np.nonzero(np.r_[True, rows[1:] != rows[:-1]])[0]
        out[rows[at]] = np.add.reduceat(values, at, axis=0)
    return out


class Space:
    """Terms in use with their weights, and their vectors once decomposed."""

    def __init__(self, used: np.ndarray, weight: np.ndarray, vectors: np.ndarray) -> None:
        self.used, self.weight, self.vectors = used, weight, vectors
        self.row = np.full(LANGUAGES * BUCKETS, -1, "int32")
        self.row[used] = np.arange(len(used))

    def sentences(self, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit vectors, language, document) of the sentences of a batch."""
        ids, sent, doc = _flat(pdf)
        row = self.row[ids]
        ok = row >= 0
        vec = _by_run(sent[ok], self.weight[row[ok]][:, None] * self.vectors[row[ok]], len(doc))
        norm = np.linalg.norm(vec, axis=1, keepdims=True)
        lang = np.zeros(len(doc), "int64")
        lang[sent] = ids // BUCKETS
        return vec / np.maximum(norm, 1e-9), lang, doc


def _frequencies(feats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sentences that have a term, by term id, and sentences by language, over all documents."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(LANGUAGES * BUCKETS, "int64"), np.zeros(LANGUAGES, "int64")
        for pdf in batches:
            ids, sent, _ = _flat(pdf)
            df += np.bincount(ids, minlength=len(df))
            first = np.r_[True, sent[1:] != sent[:-1]] if len(sent) else np.empty(0, bool)
            n += np.bincount(ids[first] // BUCKETS, minlength=LANGUAGES)
        at = np.nonzero(df)[0]
        yield pd.DataFrame({"id": np.r_[at, -1 - np.arange(LANGUAGES)], "n": np.r_[df[at], n]})

    df, n = np.zeros(LANGUAGES * BUCKETS), np.zeros(LANGUAGES)
    for r in feats.mapInPandas(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():  # a row per hash bucket
        if r["id"] < 0:
            n[-1 - r["id"]] = r["n"]
        else:
            df[r["id"]] = r["n"]
    return df, n


def _few(feats: DataFrame) -> DataFrame:
    """The same rows in at most MOST_TASKS partitions: each task of a pass sends the whole matrix once, so their number bounds what is shuffled."""
    n = feats.rdd.getNumPartitions()
    return feats.coalesce(MOST_TASKS) if n > MOST_TASKS else feats


def _sum_blocks(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of matrices that partitions send in blocks (block, salt, bytes), in rounds that add at most FAN_IN partials a group."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, "float32").astype("float64") for b in pdf["data"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "salt": [pdf["salt"].iloc[0] // FAN_IN], "data": [total.astype("float32").tobytes()]})

    tasks = MOST_TASKS
    while tasks > 1:
        parts = parts.groupBy("block", "salt").applyInPandas(add, "block int, salt int, data binary")
        tasks = -(-tasks // FAN_IN)
    out = np.zeros(shape, "float64")
    for r in parts.collect():  # the matrix itself
        part = np.frombuffer(r["data"], "float32").reshape(-1, shape[1])
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
    return out


def _emit(matrix: np.ndarray) -> pd.DataFrame:
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId()
    blocks = [matrix[i : i + BLOCK] for i in range(0, len(matrix), BLOCK)]
    some = [i for i, b in enumerate(blocks) if b.any()]
    return pd.DataFrame({"block": pd.array(some, "int32"), "salt": pd.array([pid // FAN_IN] * len(some), "int32"), "data": pd.Series([blocks[i].astype("float32").tobytes() for i in some], dtype=object)})


def decompose(feats: DataFrame, dims: int = DIMS, passes: int = PASSES, seed: int = 7) -> Space:
    """The leading right singular vectors of each language's block of the weighted documents-by-terms matrix; each pass reads all documents once."""
    df, n = _frequencies(feats)
    used = np.nonzero(df >= LEAST)[0]
    idf = np.log(np.maximum(n[used // BUCKETS], 1) / np.maximum(df[used], 1)) if len(used) else np.empty(0)
    space = Space(used, (np.maximum(idf, 0) ** POWER).astype("float32"), np.zeros((len(used), 0), "float32"))
    k = max(1, min(dims, len(used)))
    q = np.random.default_rng(seed).standard_normal((len(used), k)).astype("float32")
    sc = feats.sparkSession.sparkContext
    for _ in range(passes if len(used) else 0):
        shared = sc.broadcast((used, space.weight, q))  # at most LANGUAGES * BUCKETS rows of dims floats

        def run(batches: Iterable[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            used, weight, q = shared.value
            row_of = Space(used, weight, q).row
            total = np.zeros(q.shape, "float32")
            for pdf in _small(batches):
                ids, sent, doc = _flat(pdf)
                row = row_of[ids]
                ok = row >= 0
                # a row of the matrix is what a document has in one language
                pair, tf = np.unique((doc[sent[ok]] * LANGUAGES + ids[ok] // BUCKETS) * len(used) + row[ok], return_counts=True)
                if not len(pair):
                    continue
                d, t = pair // len(used), pair % len(used)
                v = ((1 + np.log(tf)) * weight[t]).astype("float32")
                v /= np.maximum(np.sqrt(np.bincount(d, v * v, minlength=len(pdf) * LANGUAGES)).astype("float32")[d], 1e-9)
                y = _by_run(d, v[:, None] * q[t], len(pdf) * LANGUAGES)
                order = np.argsort(t, kind="stable")
                ts = t[order]
                at = np.nonzero(np.r_[True, ts[1:] != ts[:-1]])[0]
                total[ts[at]] += np.add.reduceat(v[order][:, None] * y[d[order]], at, axis=0)
            yield _emit(total)

        z = _sum_blocks(_few(feats).mapInPandas(run, "block int, salt int, data binary"), q.shape)
        q = np.zeros_like(q)
        for g in np.unique(used // BUCKETS):
            own = np.nonzero(used // BUCKETS == g)[0]
            part = np.linalg.qr(z[own])[0]
            q[own, : part.shape[1]] = part
        shared.unpersist()
    space.vectors = q
    return space


def _nearest(vec: np.ndarray, lang: np.ndarray, cent: np.ndarray) -> np.ndarray:
    """Cosines of sentences with the centroids of their language; 0 where it has none of a kind."""
    own = cent / np.maximum(np.linalg.norm(cent, axis=2, keepdims=True), 1e-9)
    out = np.zeros((len(vec), cent.shape[1]), "float32")
    for g in np.unique(lang):
        at = lang == g
        out[at] = vec[at] @ own[g].T.astype("float32")
    return out


def _choice(cos: np.ndarray, least: float, lead: float) -> np.ndarray:
    """The nearest centroid of every sentence, 0 (about no subject) where it isn't near or clear enough."""
    if not len(cos):
        return np.empty(0, "int64")
    top = cos.argmax(axis=1)
    two = np.partition(cos, -2, axis=1)[:, -2:] if cos.shape[1] > 1 else np.c_[np.zeros(len(cos)), cos]
    return np.where((two[:, 1] > least) & (two[:, 1] - two[:, 0] >= lead), top, 0)


def centroids(feats: DataFrame, labels: DataFrame, names: list[str], space: Space) -> np.ndarray | None:
    """(languages, 1 + subjects, dims): sums of sentence vectors; the first kind is about no subject. ``labels``: (key, subject)."""
    place = {s: i + 1 for i, s in enumerate(names)}
    shape = (LANGUAGES, len(names) + 1, space.vectors.shape[1])
    sc = feats.sparkSession.sparkContext
    shared = sc.broadcast((space.used, space.weight, space.vectors))  # as in decompose
    known = labels.filter("key is not null and subject is not null").groupBy("key").agg(F.collect_set("subject").alias("subjects"))
    seeds = cut_lineage(feats.join(known, "key").select("ends", "ids", "subjects"))

    def collect(rows: DataFrame, run, wide: int = 0) -> np.ndarray:
        flat = _sum_blocks(_few(rows).mapInPandas(run, "block int, salt int, data binary"), (shape[0] * shape[1], shape[2] + wide))
        return flat.reshape(shape[0], shape[1], shape[2] + wide)

    def from_seeds(cent: np.ndarray | None):
        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sp = Space(*shared.value)
            total = np.zeros((shape[0] * shape[1], shape[2] + (cent is None)), "float64")
            for pdf in _small(batches):
                vec, lang, doc = sp.sentences(pdf)
                allow = np.zeros((len(pdf), shape[1]), bool)
                for i, s in enumerate(pdf["subjects"]):
                    allow[i, [place[x] for x in s if x in place]] = True
                if cent is None:  # at first every sentence is about its document's subjects
                    allow[:, 0] = ~allow.any(axis=1)
                    share = allow / allow.sum(axis=1, keepdims=True)
                    counted = np.c_[vec, np.ones(len(vec))]
                    for k in range(shape[1]):
                        np.add.at(total, lang * shape[1] + k, counted * share[doc, k][:, None])
                else:
                    allow[:, 0] = True
                    best = np.where(allow[doc], _nearest(vec, lang, cent), -9).argmax(axis=1)
                    np.add.at(total, lang * shape[1] + best, vec)
            yield _emit(total)

        return run

    def from_all(cent: np.ndarray):
        def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sp = Space(*shared.value)
            total = np.zeros((shape[0] * shape[1], shape[2]), "float64")
            for pdf in _small(batches):
                vec, lang, doc = sp.sentences(pdf)
                best = _choice(_nearest(vec, lang, cent), COSINE, JOIN_LEAD)
                count = np.bincount(doc * shape[1] + best, minlength=len(pdf) * shape[1]).reshape(-1, shape[1])
                sure = (best > 0) & (count[doc, best] >= JOIN_SENTENCES)
                np.add.at(total, lang[sure] * shape[1] + best[sure], vec[sure])
            yield _emit(total)

        return run

    first = collect(seeds, from_seeds(None), wide=1)
    if not first.any():
        return None
    # a subject is what its documents have beyond all labelled ones of the language: phrasing drops out
    every = first.sum(axis=1, keepdims=True)
    mean = lambda x: x[..., :-1] / np.maximum(x[..., -1:], 1e-9)
    cent = mean(first) - mean(every)
    cent[first[..., -1] == 0] = 0
    cent[:, 0] = np.where(first[:, 0, -1:] > 0, mean(first[:, 0]), mean(every[:, 0]))
    for _ in range(ROUNDS):
        cent = collect(seeds, from_seeds(cent))
    for _ in range(JOIN_ROUNDS):
        cent = collect(seeds, from_seeds(cent)) + JOIN_WEIGHT * collect(feats, from_all(cent))
    return cent


def about(documents: DataFrame, key: str, text: str, labels: DataFrame, subjects: DataFrame, filters: langid.Filters) -> DataFrame:
    """(key, subject, sentences): every subject of every document. ``labels``: (key, subject); ``subjects``: a row per subject."""
    spark: SparkSession = documents.sparkSession
    names = sorted({r["subject"] for r in subjects.select("subject").distinct().collect() if r["subject"]})  # the parameter table
    feats = cut_lineage(features(documents, key, text, filters))
    space = decompose(feats)
    cent = centroids(feats, labels, names, space) if len(space.used) and names else None
    schema = "key bigint, subject string, sentences int"
    if cent is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast((space.used, space.weight, space.vectors, cent.astype("float32")))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used, weight, vectors, cent = shared.value
        sp = Space(used, weight, vectors)
        for pdf in _small(batches):
            vec, lang, doc = sp.sentences(pdf)
            best = _choice(_nearest(vec, lang, cent), COSINE, LEAD)
            count = np.bincount(doc * cent.shape[1] + best, minlength=len(pdf) * cent.shape[1]).reshape(-1, cent.shape[1])
            d, s = np.nonzero(count[:, 1:] >= SENTENCES)
            yield pd.DataFrame({"key": pdf["key"].to_numpy()[d], "subject": pd.Series([names[i] for i in s], dtype=object), "sentences": count[d, s + 1].astype("int32")})

    return feats.mapInPandas(run, schema)

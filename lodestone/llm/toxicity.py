"""Toxicity by multiple-instance learning: noisy-or over sentence scores, trained from document labels.

Null and empty texts get the score of no sentence, 0. Without labelled documents of both kinds nothing is known: every score
is 0 and no document is rejected. Repeated rows are scored one by one; an empty table gives no rows; texts are scored whole; a
column named as the result is gets underscores in front of the result's name.
"""
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.common import spare, trim

SAMPLE, LONGEST, VOCAB, MIN_DOCS = 2500, 50_000, 3000, 4  # training rows of each label, their most bytes, words kept, documents a word needs
BEGINNINGS = ((), (4, 5), (3, 4, 5, 6))  # lengths of word beginnings, which inflected forms share; chosen on training rows
BLOCK = 50_000  # words that the fit turns into numbers at once
_WORD, _END = re.compile(r"\w+"), re.compile(r"[.!?\n]+")


def sentences(text: str | None) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in _END.finditer(text or ""):
        out.append((at, m.end()))
        at = m.end()
    return out + [(at, len(text))] if text and at < len(text) else out


def parts(word: str, lengths: tuple[int, ...]) -> list[str]:
    """A word's cues: itself and its beginnings."""
    return [word, *("^" + word[:k] for k in lengths if len(word) >= k)]


def held_out(mod: int, rest: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == rest


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit on a hash sample of about `sample` whole documents of each label, never of held-out rows."""
    known = labels.where(~held_out(5, 0) & F.col("toxic").isNotNull()).select("doc_id", "toxic")
    counts = dict(map(tuple, known.groupBy("toxic").count().collect()))
    share = F.coalesce(*[F.when(F.col("toxic") == k, F.lit(min(1.0, sample / n))) for k, n in counts.items()], F.lit(0.0))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    short = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST)
    rows = short.join(F.broadcast(some), "doc_id").orderBy("doc_id").limit(3 * sample).collect()
    y, texts = np.array([r.toxic for r in rows], float), [r.text for r in rows]
    del rows
    model = choose(texts, y)
    del texts
    trim()
    return model


def choose(texts: list[str | None], y: np.ndarray) -> dict:
    """The model of the lengths of word beginnings that serve best on every fifth training row, fitted on all of them."""
    if len(np.unique(y)) < 2:
        return {"bias": None, "words": {}, "lengths": ()}
    part, bags = np.arange(len(y)) % 5 == 0, Bags.of(texts)
    if len(np.unique(y[~part])) < 2:
        return fit(bags, y, BEGINNINGS[0])
    some, rest = bags.pick(part), bags.pick(~part)

    def loss(lengths: tuple[int, ...]) -> float:
        p = np.clip(chances(some, fit(rest, y[~part], lengths)), 1e-6, 1 - 1e-6)
        return -float(np.mean(np.where(y[part] == 1, np.log(p), np.log1p(-p))))

    return fit(bags, y, min(BEGINNINGS, key=loss))


class Bags:
    """Texts as numbers, for the fit on the driver: the distinct words of each sentence, in the order of the documents."""

    def __init__(self, names: list[str], words: np.ndarray, sizes: np.ndarray, docs: np.ndarray):
        self.names, self.words, self.sizes, self.docs = names, words, sizes, docs  # words by id; ids; words a sentence; sentences a document

    @classmethod
    def of(cls, texts: list[str | None]) -> "Bags":
        ids: dict[str, int] = {}
        words, sizes, docs = array("i"), array("i"), array("i")
        for text in texts:
            spans = sentences(text)
            for a, b in spans:
                words.extend(got := sorted({ids.setdefault(w, len(ids)) for w in _WORD.findall(text[a:b].lower())}))
                sizes.append(len(got))
            docs.append(len(spans))
        return cls(list(ids), *(np.array(x, np.int32) for x in (words, sizes, docs)))

    def pick(self, part: np.ndarray) -> "Bags":
        kept = np.repeat(part, self.docs)
        return Bags(self.names, self.words[np.repeat(kept, self.sizes)], self.sizes[kept], self.docs[part])

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, sentence, document) of whole documents, in blocks of about BLOCK words."""
        if not len(self.docs):
            return
        last = np.cumsum(self.docs)
        at = np.append(0, np.cumsum(self.sizes, dtype=np.int64))
        ends = at[last]  # of the documents, in words
        d = 0
        while d < len(self.docs):
            e = max(d + 1, int(np.searchsorted(ends, (ends[d - 1] if d else 0) + BLOCK, "right")))
            s0, s1 = int(last[d - 1]) if d else 0, int(last[e - 1])
            n = self.sizes[s0:s1]
            yield self.words[at[s0] : at[s1]], np.repeat(np.arange(s0, s1), n), np.repeat(np.repeat(np.arange(d, e), self.docs[d:e]), n)
            d = e


def beginning(word: str, k: int) -> str | None:
    """The cue of length k, or the word itself for 0."""
    return word if not k else "^" + word[:k] if len(word) >= k else None


def frequent(bags: Bags, y: np.ndarray, k: int) -> list[tuple[str, float, float]]:
    """(cue, documents of label 0, of label 1) of the cues of one length that MIN_DOCS documents hold."""
    ids: dict[str, int] = {}
    of = np.array([-1 if (c := beginning(w, k)) is None else ids.setdefault(c, len(ids)) for w in bags.names], np.int32)
    n, seen = len(ids), np.zeros((2, len(ids)))
    for word, _, doc in bags.blocks():
        cue = of[word]
        pairs = np.unique(doc[cue >= 0] * n + cue[cue >= 0]) if n else np.zeros(0, int)
        for label in (0, 1):
            seen[label] += np.bincount(pairs[y[pairs // max(1, n)] == label] % max(1, n), minlength=n)
    often = seen.sum(0) >= MIN_DOCS
    return [(c, *seen[:, i]) for c, i in ids.items() if often[i]]


def entries(bags: Bags, vocab: dict[str, int], lengths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sparse matrix of sentences and cues, by blocks: (sentences that hold cues, cues of each, columns)."""
    n, out = max(1, len(vocab)), []
    column = [np.array([vocab.get(beginning(w, k), -1) for w in bags.names], np.int32) for k in (0, *lengths)]
    for word, sent, _ in bags.blocks():
        found = [(c[word], sent) for c in column]
        x = np.unique(np.concatenate([s[c >= 0] * n + c[c >= 0] for c, s in found]))
        rows, sizes = np.unique(x // n, return_counts=True)
        if len(rows):
            out.append((rows.astype(np.int32), sizes.astype(np.int32), (x % n).astype(np.int16 if n < 1 << 15 else np.int32)))
    return out


def likely(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], w: np.ndarray, bias: float, n: int) -> np.ndarray:
    """The probability of each of n sentences."""
    z = np.full(n, bias)
    for rows, sizes, cols in blocks:
        z[rows] += np.add.reduceat(w[cols], np.cumsum(sizes) - sizes)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(p: np.ndarray, di: np.ndarray, n: int) -> np.ndarray:
    """The probability of each of n documents from its sentences'; di: their documents."""
    return 1 - np.exp(np.bincount(di, np.log1p(-np.minimum(p, 1 - 1e-9)), n))


def chances(bags: Bags, model: dict) -> np.ndarray:
    """Scores of the documents, as Scorer gives them up to rounding."""
    names = list(model["words"])
    w = np.array([model["words"][x] for x in names])
    p = likely(entries(bags, {x: i for i, x in enumerate(names)}, model["lengths"]), w, model["bias"], len(bags.sizes))
    return noisy_or(p, np.repeat(np.arange(len(bags.docs)), bags.docs), len(bags.docs))


def fit(bags: Bags, y: np.ndarray, lengths: tuple[int, ...]) -> dict:
    """Noisy-or over logistic sentence scores, by full-batch Adam on the documents' log-likelihood."""
    n0, n1 = max(1, (y == 0).sum()), max(1, (y == 1).sum())
    found = [x for k in (0, *lengths) for x in frequent(bags, y, k)]
    gain = {c: abs(np.log((b + 0.5) / n1) - np.log((a + 0.5) / n0)) * np.sqrt(a + b) for c, a, b in found}
    vocab = {c: i for i, c in enumerate(sorted(gain, key=lambda c: (-gain[c], c))[:VOCAB])}
    del found, gain
    blocks, di = entries(bags, vocab, lengths), np.repeat(np.arange(len(y)), bags.docs)
    w, b, m, v = np.zeros(len(vocab) + 1), -4.0, 0.0, 0.0
    w[-1] = b
    for step in range(1, 301):
        p = likely(blocks, w, w[-1], len(di))
        doc = np.clip(noisy_or(p, di, len(y)), 1e-9, 1 - 1e-9)
        # noisy-or: d log-likelihood / dz of a sentence = (y/P - 1) * p
        gz = ((y / doc - 1)[di] * p) / max(1, len(y))
        g = 1e-4 * w
        g[-1] -= gz.sum()
        for rows, sizes, cols in blocks:
            g[:-1] -= np.bincount(cols, np.repeat(gz[rows], sizes), len(vocab))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {"bias": float(w[-1]), "words": {k: float(w[i]) for k, i in vocab.items() if abs(w[i]) > 0.01}, "lengths": lengths}


class Scorer:
    """Applies a model; remembers which of its cues a word holds."""

    def __init__(self, model: dict, memo: int = 300_000):
        self.words, self.bias, self.lengths, self.memo, self.known = model["words"], model["bias"], model["lengths"], memo, {}

    def held(self, word: str) -> tuple[str, ...]:
        got = tuple(c for c in parts(word, self.lengths) if c in self.words)
        if len(self.known) >= self.memo:
            self.known.clear()
        if len(word) < 40:
            self.known[word] = got
        return got

    def one(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Document score, and (start, end, score) of offending sentences."""
        none, bad, known = 0.0, [], self.known
        if self.bias is None:
            return 0.0, bad
        for a, b in sentences(text):
            found = set()
            for w in _WORD.findall(text[a:b].lower()):
                c = known.get(w)
                if c is None:
                    c = self.held(w)
                if c:
                    found.update(c)
            z = self.bias + sum(self.words[x] for x in sorted(found))
            p = 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))
            none += math.log1p(-min(p, 1 - 1e-9))
            if p >= 0.5:
                bad.append((a, b, p))
        return 1 - math.exp(none), bad


def score(docs: DataFrame, model: dict, name: str = "toxicity") -> tuple[DataFrame, str]:
    """docs plus struct<score, offending array<struct<start, end, score>>>, in one pass without a shuffle; and its column's name."""
    sent, name = docs.sparkSession.sparkContext.broadcast(model), spare(docs, name)

    @F.pandas_udf("score double, offending array<struct<start:int,end:int,score:double>>")
    def f(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for s in it:
            got = [scorer.one(t) for t in s]
            yield pd.DataFrame({"score": [x for x, _ in got], "offending": [[{"start": a, "end": b, "score": c} for a, b, c in y] for _, y in got]})
            trim()

    return docs.withColumn(name, f(F.col("text"))), name


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    x, name = score(docs.select("doc_id", "text"), train(docs, labels))
    s = F.col(name)["score"]
    return x.select("doc_id", held_out(5, 0).alias("held_out"), s.alias("score"), (s >= 0.5).cast("int").alias("predicted"), F.size(F.col(name)["offending"]).alias("n_offending"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score below 0.5."""
    x, name = score(docs, train(docs, labels))
    return x.where(F.col(name)["score"] < 0.5).select(docs.columns)

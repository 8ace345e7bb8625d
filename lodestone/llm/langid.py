"""Language identification: family first, then one-versus-one linear support vector machines inside the family.

Features are hashed byte trigrams of the whole lower-cased text. Null text or text without a letter is `und`, score 0, as is
every text where no labelled one is there to learn from. Ties of votes go to the surer, then the first language. Repeated rows
are predicted one by one; an empty table gives no rows; long texts are read whole; a column named `language` stays, the result
then has underscores in front.
"""
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.common import spare

SAMPLE, LONGEST, DIM = 400, 50_000, 4096  # training documents of a language in expectation, their most bytes, hashed features
# Language families by ISO 639-1 code; a code not listed is a family of its own.
FAMILIES = {"germanic": "en de nl sv da no is", "romance": "fr es it pt ro ca gl", "slavic": "ru uk pl cs sk bg sr hr sl"}
_LETTER = re.compile(r"[^\W\d_]")


def family(lang: str) -> str:
    return next((f for f, codes in FAMILIES.items() if lang in codes.split()), lang)


def features(text: str) -> np.ndarray:
    b = np.frombuffer(f"  {text.lower()}  ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    h = ((b[:-2] * 40503 + b[1:-1] * 2654435 + b[2:] * 97) >> 3) % DIM
    x = np.sqrt(np.bincount(h, minlength=DIM))
    return x / np.linalg.norm(x)


def svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 15) -> np.ndarray:
    """Dual coordinate descent for the hinge loss; y is -1 or 1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, a, q = np.zeros(x.shape[1]), np.zeros(len(x)), (x * x).sum(1)
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            new = min(c, max(0.0, a[i] - (y[i] * (x[i] @ w) - 1) / q[i]))
            w += (new - a[i]) * y[i] * x[i]
            a[i] = new
    return w


def ovo(x: np.ndarray, names: np.ndarray) -> list[tuple[str, str, np.ndarray]]:
    out = []
    for a, b in combinations(sorted(set(names)), 2):
        rows = (names == a) | (names == b)
        out.append((a, b, svm(x[rows], np.where(names[rows] == a, 1.0, -1.0))))
    return out


def train(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """Fit on a hash sample of about `sample` whole documents of each language, never of held-out rows."""
    known = docs.where(F.col("lang").isNotNull() & (F.octet_length("text") <= LONGEST) & (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 != 2))
    counts = dict(map(tuple, known.groupBy("lang").count().collect()))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, sample / n))) for k, n in counts.items()], F.lit(0.0))
    rows = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000).select("doc_id", "text", "lang").orderBy("doc_id").collect()
    rows = [r for r in rows if _LETTER.search(r.text)]
    if not rows:
        return {"families": [], "inside": {}, "langs": {}}
    x, names = np.array([features(r.text) for r in rows]), np.array([r.lang for r in rows])
    fams = np.array([family(n) for n in names])
    langs = {f: sorted(set(names[fams == f])) for f in sorted(set(fams))}
    return {"families": ovo(x, fams), "inside": {f: ovo(x[fams == f], names[fams == f]) for f in langs}, "langs": langs}


def _vote(x: np.ndarray, models: list, names: list[str]) -> tuple[str, float]:
    won, sure = dict.fromkeys(names, 0), dict.fromkeys(names, 1.0)
    for a, b, w in models:
        p = 1 / (1 + np.exp(-2 * float(x @ w[:-1] + w[-1])))
        won[a if p >= 0.5 else b] += 1
        sure[a], sure[b] = min(sure[a], p), min(sure[b], 1 - p)
    best = max(names, key=lambda n: (won[n], sure[n]))
    return best, sure[best]


def predict_one(text: str | None, model: dict) -> tuple[str, float]:
    if not text or not _LETTER.search(text) or not model["langs"]:
        return "und", 0.0
    x = features(text)
    fam, p = _vote(x, model["families"], list(model["langs"]))
    lang, q = _vote(x, model["inside"][fam], model["langs"][fam])
    return lang, float(p * q)


def predict(docs: DataFrame, model: dict, name: str = "language") -> tuple[DataFrame, str]:
    """docs plus struct<lang_pred, score>, and the name of its column."""
    sent, name = docs.sparkSession.sparkContext.broadcast(model), spare(docs, name)

    @F.pandas_udf("lang_pred string, score double")
    def f(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            yield pd.DataFrame([predict_one(t, sent.value) for t in s], columns=["lang_pred", "score"])

    return docs.withColumn(name, f(F.col("text"))), name


def query(docs: DataFrame) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    x, name = predict(docs.select("doc_id", "text"), train(docs))
    return x.select("doc_id", held.alias("held_out"), F.col(name)["lang_pred"].alias("lang_pred"), F.col(name)["score"].alias("score"))

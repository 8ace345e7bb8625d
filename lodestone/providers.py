"""Embedding providers: profiles, the protocol, a deterministic hash provider, an optional ONNX one."""
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lodestone.functions import text, vectors


class ModelFailure(Exception):
    """A model gave no vector, or not one for each passage."""


@dataclass(frozen=True)
class Profile:
    """Model, dimension, context, and the token budget: body, overlap, title, prepared passage, context."""
    key: str
    model: str
    dimension: int
    budget: tuple[int, int, int, int, int]
    query_prefix: str = ""
    titled: bool = False

    def __post_init__(self):
        text.check_budget(*self.budget)


# The known profiles.
BGE = Profile("bge-small-en-v1.5", "bge-small-en-v1.5", 384, (400, 100, 64, 465, 512), text.BGE_QUERY)
GEMMA = Profile("embeddinggemma-300m", "embeddinggemma-300m", 768, (3000, 256, 128, 4096, 8192), text.GEMMA_QUERY, True)


class Provider(Protocol):
    profile: Profile

    def tokens(self, word: str) -> int: ...

    def embed(self, passages: list[str]) -> np.ndarray: ...


class HashProvider:
    """Bag-of-words vectors from checksums: the same on every machine, without a model."""

    def __init__(self, profile: Profile = BGE):
        self.profile = profile

    def tokens(self, word: str) -> int:
        return 1

    def embed(self, passages: list[str]) -> np.ndarray:
        return np.array([vectors.hash_vector(p, self.profile.dimension) for p in passages], np.float32).reshape(len(passages), self.profile.dimension)


class OnnxProvider:
    """A text model in ONNX form with its tokenizer file; the session is made once a worker."""

    def __init__(self, profile: Profile, model_file: str, tokenizer_file: str):
        self.profile, self.files, self.session = profile, (model_file, tokenizer_file), None

    def __getstate__(self):
        return {"profile": self.profile, "files": self.files, "session": None}

    def _open(self):
        if self.session is None:
            import onnxruntime
            from tokenizers import Tokenizer

            self.session = (onnxruntime.InferenceSession(self.files[0]), Tokenizer.from_file(self.files[1]))
        return self.session

    def tokens(self, word: str) -> int:
        return len(self._open()[1].encode(word, add_special_tokens=False).ids)

    def embed(self, passages: list[str]) -> np.ndarray:
        session, tok = self._open()
        out = []
        for p in passages:
            ids = np.array([tok.encode(p).ids], np.int64)
            given = {"input_ids": ids, "attention_mask": np.ones_like(ids), "token_type_ids": np.zeros_like(ids)}
            v = np.asarray(session.run(None, {i.name: given[i.name] for i in session.get_inputs()})[0])
            v = (v[0, 0] if v.ndim == 3 else v[0]).astype(float)
            out.append((v / np.linalg.norm(v)).astype(np.float32))
        return np.array(out)


def checked(provider: Provider, passages: list[str]) -> np.ndarray:
    """One valid vector a passage, in order, or ModelFailure."""
    got = provider.embed(passages)
    if len(got) != len(passages):
        raise ModelFailure(f"{len(got)} vectors for {len(passages)} passages")
    if len(got) and (got.shape[1] != provider.profile.dimension or not np.isfinite(got).all() or not got.any(1).all()):
        raise ModelFailure("a vector of another dimension, or without a finite length")
    return got


def embedded(passages: Column, provider: Provider) -> Column:
    """Vectors of a column of passages, batch by batch."""
    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def f(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series(list(checked(provider, s.tolist())), dtype=object)

    return f(passages)


def query_vector(provider: Provider, query: str) -> list[float]:
    return checked(provider, [provider.profile.query_prefix + query])[0].tolist()


def entries(posts: DataFrame, provider: Provider) -> DataFrame:
    """Index entries of posts: word windows, each a passage under the title, embedded; summaries have none."""
    p = provider.profile
    full = posts.where("completeness = 'FULL'").select("post_id", "site_id", text.title_line(F.col("title"), p.budget[2]).alias("line"), text.words(F.col("body")).alias("ws"))
    w = full.select("*", F.explode(text.window_starts(F.size("ws"))).alias("idx")).select("post_id", "site_id", "line", "idx", text.window(F.col("ws"), F.col("idx")).alias("text"))
    made = text.gemma_passage(F.col("line"), F.col("text")) if p.titled else text.passage(F.col("line"), F.col("text"))
    return w.select("post_id", "site_id", F.lit("CHUNK").alias("kind"), F.col("idx").cast("long").alias("idx"), "text", F.lit(None).cast("string").alias("image_url"), embedded(made, provider).alias("embedding"))

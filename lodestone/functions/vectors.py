"""Vectors: validity, length, similarity, storage form, and a deterministic embedder for tests."""
import base64
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Product in double precision; null where the lengths differ or a value is missing."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def valid(v: Column, dimension: int) -> Column:
    """Exact dimension and a finite length other than zero."""
    return F.coalesce(F.size(v) == dimension, F.lit(False)) & has_length(v)


def has_length(v: Column) -> Column:
    n = norm(v)
    return F.coalesce(~F.isnan(n) & (n < float("inf")) & (n > 0), F.lit(False))


def normalised(v: Column) -> Column:
    """Unit vector of floats, divided in double precision; null for what is not valid."""
    return F.when(has_length(v), F.transform(_doubles(v), lambda x: (x / norm(v)).cast("float")))


@F.pandas_udf(T.StringType())
def encoded(s: pd.Series) -> pd.Series:
    """Base64 of little-endian 32-bit floats."""
    return s.map(lambda v: base64.b64encode(np.asarray(v, "<f4").tobytes()).decode(), na_action="ignore")


def decode(text: str) -> list[float] | None:
    try:
        raw = base64.b64decode(text, validate=True)
    except ValueError:
        return None
    return None if len(raw) % 4 else np.frombuffer(raw, "<f4").tolist()


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decoded(s: pd.Series) -> pd.Series:
    """The vector of a base64 text; null for bad base64 or a length that is no multiple of four."""
    return s.map(decode, na_action="ignore")


def hash_vector(text: str, dimension: int) -> np.ndarray:
    """Bag of words, each word's sign and place from its checksum; no words give the first axis."""
    v = np.zeros(dimension)
    for w in text.lower().split():
        h = zlib.crc32(w.encode())
        v[h % dimension] += 1 if h >> 31 else -1
    n = np.linalg.norm(v)
    if n == 0:
        v[0], n = 1.0, 1.0
    return (v / n).astype(np.float32)

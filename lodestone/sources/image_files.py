"""Images from folders and from the web, and their rasters."""
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lodestone.functions import images, urls

FETCH = "url string, outcome string, reason string, content binary"
HOPS = 3


def local(spark: SparkSession, path: str) -> DataFrame:
    """path, outcome, content of image files; larger ones than the limit are refused unread."""
    f = spark.read.format("binaryFile").load(path)
    big = F.col("length") > images.MAX_BYTES
    return f.select("path", F.when(big, "TOO_LARGE").otherwise("FETCHED").alias("outcome"), F.when(~big, F.col("content")).alias("content"))


def fetch_one(url: str, opener: Callable, permits: Callable[[str], bool]) -> tuple[str, str | None, bytes | None]:
    """(outcome, reason, content); opener(url) gives (status, location, content type, length, bytes)."""
    for _ in range(HOPS + 1):
        if not url.lower().startswith("https://"):
            return "REJECTED", "NOT_HTTPS", None
        if not permits(url):
            return "REJECTED", "ADDRESS_NOT_PERMITTED", None
        try:
            status, location, kind, length, content = opener(url)
        except OSError:
            return "UNAVAILABLE", None, None
        if 300 <= status < 400 and location:
            url = urls.resolve(url, location) or ""
            continue
        if status in (408, 429) or status >= 500:
            return "UNAVAILABLE", None, None
        if not 200 <= status < 300:
            return "REJECTED", "HTTP_STATUS", None
        if (kind or "").split(";")[0].strip().lower() not in images.TYPES:
            return "REJECTED", "UNSUPPORTED_TYPE", None
        if (length or 0) > images.MAX_BYTES or len(content) > images.MAX_BYTES:
            return "REJECTED", "TOO_LARGE", None
        return "FETCHED", None, content
    return "REJECTED", "TOO_MANY_REDIRECTS", None


def fetch(addresses: DataFrame, opener: Callable, permits: Callable[[str], bool] = lambda url: True) -> DataFrame:
    """url, outcome, reason, content of a frame of addresses, read by the executors."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            yield pd.DataFrame([(u, *fetch_one(u, opener, permits)) for u in p["url"]], columns=["url", "outcome", "reason", "content"])

    return addresses.select("url").mapInPandas(run, FETCH)


def rasters(spark: SparkSession, path: str) -> DataFrame:
    """origin, verdict, width, height, data (RGB bytes) of image files; sizes are judged before pixels are turned."""
    i = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")

    @F.pandas_udf(T.BinaryType())
    def rgb(data: pd.Series, channels: pd.Series) -> pd.Series:
        def one(d, n):
            x = np.frombuffer(d, np.uint8).reshape(-1, n)
            return (np.repeat(x, 3, 1) if n == 1 else x[:, 2::-1]).tobytes()
        return pd.Series([one(d, n) if n > 0 else None for d, n in zip(data, channels, strict=True)])

    verdict = F.when(F.col("nChannels") <= 0, "UNDECODABLE").otherwise(images.decoded_size(F.col("width"), F.col("height")))
    return i.select("origin", verdict.alias("verdict"), "width", "height", F.when(verdict == "OK", rgb("data", "nChannels")).alias("data"))


def patches(raster_rows: DataFrame) -> DataFrame:
    """Rasters (width, height, data) resized to their target and cut: patches (2520 x 768 floats), places, tokens."""
    size = images.target_size(F.col("width"), F.col("height"))

    @F.pandas_udf("patches binary, places binary, real int")
    def cut(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for w, h, data, tw, th in it:
            rows = []
            for a, b, d, x, y in zip(w, h, data, tw, th, strict=True):
                p, at = images.patchify(images.resize(np.frombuffer(d, np.uint8).reshape(b, a, 3), x, y))
                rows.append((p.astype("<f4").tobytes(), at.astype("<i4").tobytes(), int((at[:, 0] >= 0).sum())))
            yield pd.DataFrame(rows, columns=["patches", "places", "real"])

    x = raster_rows.withColumn("target", size)
    return x.withColumn("cut", cut("width", "height", "data", "target.width", "target.height")).withColumn("grid", images.patch_grid(F.col("target.width"), F.col("target.height")))

"""The three tools: search_posts, get_post, find_posts_like_image; and their failures."""
import datetime
import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from lodestone import providers
from lodestone.functions import urls
from lodestone.operators import posts as P, search as S


class InvalidArguments(ValueError):
    """A tool argument is unknown, missing, of the wrong type, or no date or whole number."""


class InvalidImageQuery(ValueError):
    """NOT_ABSOLUTE_PATH, UNSUPPORTED_EXTENSION, NOT_A_READABLE_FILE, FILE_TOO_LARGE, NOT_HTTPS or MALFORMED_URL."""


class ImageSearchFailed(Exception):
    """The image was refused, or could not be had."""


def arguments(given: dict, **kinds: tuple[str, bool]) -> dict:
    """Checked arguments; kinds: name=(string, date or number, required). Numbers may be floats of whole value and saturate."""
    if odd := sorted(set(given) - set(kinds)):
        raise InvalidArguments(f"unknown argument: {odd[0]}")
    out = {}
    for name, (kind, required) in kinds.items():
        v = given.get(name)
        if v is None:
            if required:
                raise InvalidArguments(f"missing argument: {name}")
        elif kind == "number":
            if isinstance(v, bool) or not isinstance(v, int | float) or v != v or (isinstance(v, float) and abs(v) != float("inf") and v != int(v)):
                raise InvalidArguments(f"{name} must be a whole number")
            v = int(max(-(2**31), min(2**31 - 1, v)))
        elif not isinstance(v, str):
            raise InvalidArguments(f"{name} must be a string")
        elif kind == "date":
            try:
                if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", v):
                    raise ValueError
                datetime.date.fromisoformat(v)
            except ValueError:
                raise InvalidArguments(f"{name} must be a date, yyyy-MM-dd") from None
        out[name] = v
    return out


def image_query(raw: str) -> tuple[str, str]:
    """("REMOTE", url) or ("LOCAL", path), the first broken rule being reported."""
    t = raw.strip()
    if re.match(urls.URL_START, t):
        if re.search(urls.ILLEGAL, t):
            raise InvalidImageQuery("MALFORMED_URL")
        if not t.lower().startswith("https://"):
            raise InvalidImageQuery("NOT_HTTPS")
        if not re.match(urls.ADDRESS, t):
            raise InvalidImageQuery("MALFORMED_URL")
        return "REMOTE", t
    if not os.path.isabs(t):
        raise InvalidImageQuery("NOT_ABSOLUTE_PATH")
    if not re.fullmatch(r"(?i).+\.(jpg|jpeg|png|gif)", os.path.basename(t)):
        raise InvalidImageQuery("UNSUPPORTED_EXTENSION")
    if not (os.path.isfile(t) and os.access(t, os.R_OK)):
        raise InvalidImageQuery("NOT_A_READABLE_FILE")
    if os.path.getsize(t) > 10_485_760:
        raise InvalidImageQuery("FILE_TOO_LARGE")
    return "LOCAL", t


def failure(e: Exception) -> str:
    """What a tool's user is told: own words for bad arguments, queries and references, else something general."""
    if isinstance(e, InvalidArguments | S.InvalidSearchQuery | InvalidImageQuery | ImageSearchFailed):
        return str(e)
    return "the embedding model failed" if isinstance(e, providers.ModelFailure) else "an unexpected error occurred"


class Archive:
    """Posts, and their index entries (post_id, site_id, kind, idx, text, image_url, embedding)."""

    def __init__(self, posts: DataFrame, entries: DataFrame, provider: providers.Provider, image_embedder: Callable[[str, str], list[float]] | None = None):
        self.posts, self.entries, self.provider, self.image_embedder = posts, entries, provider, image_embedder

    def _search(self, vector: list[float], site: str | None, start: str | None, end: str | None, limit: int | None) -> DataFrame:
        if site is not None and not re.match(urls.SITE_ID, site):
            raise InvalidArguments(f"unknown site: {site}")
        inside = self.posts.where(S.scope(site, start, end))
        spark = self.posts.sparkSession
        q = spark.createDataFrame([(0, [float(x) for x in vector])], "query_id int, vector array<double>")
        scoped = self.entries.join(inside.select("post_id"), "post_id", "left_semi")
        top = S.ranked(S.best_entry(S.scores(scoped, q)), inside, limit)
        return S.result_view(top, inside, self.entries).orderBy(F.desc("score"), F.desc("published"), "post_id")

    def search_posts(self, **given) -> DataFrame:
        a = arguments(given, query=("string", True), site=("string", False), **{"from": ("date", False)}, to=("date", False), limit=("number", False))
        return self._search(providers.query_vector(self.provider, S.query_text(a["query"])), a["site"], a["from"], a["to"], a["limit"])

    def find_posts_like_image(self, **given) -> DataFrame:
        a = arguments(given, image=("string", True), site=("string", False), **{"from": ("date", False)}, to=("date", False), limit=("number", False))
        kind, place = image_query(a["image"])
        if self.image_embedder is None:
            raise ImageSearchFailed("the embedding model reads no images")
        return self._search(self.image_embedder(kind, place), a["site"], a["from"], a["to"], a["limit"])

    def get_post(self, **given) -> DataFrame:
        """One row with found and, where it is true, the post's view."""
        a = arguments(given, post=("string", True))
        ref = self.posts.sparkSession.createDataFrame([(a["post"],)], "ref string")
        kind = ref.select(urls.reference_kind(F.col("ref"))).first()[0]
        if kind not in ("ID", "URL"):
            raise InvalidArguments(f"not a post reference ({kind}): {a['post']}")
        return P.by_id(self.posts, ref).select("ref", "found", "post_id").join(P.view(self.posts), "post_id", "left")

"""Python data source over the two platforms' listings, live or from recorded pages.

    spark.dataSource.register(Listing)
    spark.read.format("blog_listing").option("platform", "WORDPRESS").option("base", "https://h").load()

Rows are (page, pos, json). `since` (ISO time) asks for changes only; `recorded` names a folder of page-N.json files, with the
reported total in total.txt, in place of the network.
"""
import json
import os
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE_SIZES = {"WORDPRESS": 100, "BLOGGER": 150}


class SourceUnavailable(Exception):
    """A listing could not be read: no answer, a status other than 200, or an unexpected body."""


def has_more(total: str | None, size: int, reached: int, received: int, short_ends: bool) -> bool:
    """The reported total decides where it is readable, else a full page means more; Blogger also ends at a short page."""
    try:
        known = max(0, int((total or "").strip()))
    except ValueError:
        known = None
    more = received >= size if known is None else reached < known
    return more and (received >= size or not short_ends)


def address(platform: str, base: str, page: int, since: str | None) -> str:
    if platform == "WORDPRESS":
        q = {"per_page": 100, "page": page, "orderby": "modified", "order": "asc", **({"modified_after": since} if since else {})}
        return f"{base.rstrip('/')}/wp-json/wp/v2/posts?{urllib.parse.urlencode(q)}"
    q = {"alt": "json", "max-results": 150, "start-index": 1 + 150 * (page - 1), "orderby": "updated", **({"updated-min": since} if since else {})}
    return f"{base.rstrip('/')}/feeds/posts/default?{urllib.parse.urlencode(q)}"


def get_json(url: str) -> tuple[object, dict]:
    try:
        with urllib.request.urlopen(url, timeout=30) as r:
            if r.status != 200:
                raise SourceUnavailable(f"status {r.status}")
            return json.load(r), dict(r.headers)
    except (OSError, ValueError, urllib.error.URLError) as e:
        raise SourceUnavailable(str(e)) from e


def entries_of(platform: str, body: object, headers: dict) -> tuple[list, str | None]:
    """A page's entries and the reported total: pages for WordPress, entries for Blogger."""
    if platform == "WORDPRESS":
        if not isinstance(body, list):
            raise SourceUnavailable("the body is no array")
        return body, {k.lower(): v for k, v in headers.items()}.get("x-wp-totalpages")
    feed = body.get("feed") if isinstance(body, dict) else None
    found = feed.get("entry", []) if isinstance(feed, dict) else None
    if not isinstance(found, list):
        raise SourceUnavailable("no feed in the body")
    return found, (feed.get("openSearch$totalResults") or {}).get("$t")


class Listing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blog_listing"

    def schema(self) -> str:
        return "page int, pos int, json string"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options)


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.platform, self.base = options["platform"].upper(), options.get("base", "")
        self.since, self.recorded = options.get("since"), options.get("recorded")

    def fetch(self, page: int) -> tuple[list, str | None]:
        if not self.recorded:
            return entries_of(self.platform, *get_json(address(self.platform, self.base, page, self.since)))
        at, total = os.path.join(self.recorded, f"page-{page}.json"), os.path.join(self.recorded, "total.txt")
        headers = {"X-WP-TotalPages": open(total).read()} if os.path.exists(total) else {}
        try:
            with open(at, encoding="utf-8") as f:
                return entries_of(self.platform, json.load(f), headers)
        except (OSError, ValueError) as e:
            raise SourceUnavailable(str(e)) from e

    def partitions(self) -> list[InputPartition]:
        # a listing is a chain of pages: the next one's existence is known only after this one
        return [InputPartition(1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page, reached, size = partition.value, 0, PAGE_SIZES[self.platform]
        while True:
            found, total = self.fetch(page)
            for pos, e in enumerate(found):
                yield page, pos, json.dumps(e, ensure_ascii=False)
            reached = page if self.platform == "WORDPRESS" else reached + len(found)
            if not has_more(total, size, reached, len(found), self.platform == "BLOGGER"):
                return
            page += 1

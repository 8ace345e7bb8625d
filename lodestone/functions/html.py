"""HTML to text and images, by Arrow batches over the standard library's parser."""
import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from lodestone.functions import urls

# Elements that are dropped, and elements that end a paragraph.
DROPPED = {"script", "style", "noscript", "template"}
BLOCKS = set("address article aside blockquote dd details div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
MARK, NBSP = " ", " "
IMAGE = T.StructType([T.StructField(c, T.StringType()) for c in ("url", "alt_text", "caption")])


class Reader(HTMLParser):
    """Collects paragraphs, and images with their figure's caption."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.pre, self.dropped = [], [], None, []
        self.images, self.figures = [], []

    def handle_starttag(self, tag, attrs):
        if tag in DROPPED:
            self.dropped.append(tag)
        if self.dropped:
            return
        if tag == "img":
            self.images.append((dict(attrs), self.figures[-1] if self.figures else None))
        elif tag == "figure":
            self.figures.append({"depth": 0, "caption": None})
        elif self.figures:
            f = self.figures[-1]
            if tag == "figcaption" and f["depth"] == 0 and f["caption"] is None:
                f["caption"] = []
            if tag not in VOID:
                f["depth"] += 1
        if tag == "pre":
            self.end()
            self.pre = self.pre or []
        elif tag == "br":
            (self.now if self.pre is None else self.pre).append(MARK if self.pre is None else "\n")
        elif tag in BLOCKS and self.pre is None:
            self.end()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in DROPPED:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.dropped:
            if tag == self.dropped[-1]:
                self.dropped.pop()
            return
        if tag == "figure" and self.figures:
            self.figures.pop()
        elif self.figures and self.figures[-1]["depth"] and tag not in VOID:
            self.figures[-1]["depth"] -= 1
        if tag == "pre" and self.pre is not None:
            self.end_pre()
        elif tag in BLOCKS and self.pre is None:
            self.end()

    def handle_data(self, data):
        if self.dropped:
            return
        (self.now if self.pre is None else self.pre).append(data)
        if self.figures and self.figures[-1]["caption"] is not None and self.figures[-1]["depth"]:
            self.figures[-1]["caption"].append(data)

    def end(self):
        text = re.sub(f" ?{MARK} ?", "\n", re.sub(r"[ \t\n\r\f\v]+", " ", "".join(self.now).replace(NBSP, " "))).strip()
        self.now = []
        if text:
            self.blocks.append(text)

    def end_pre(self):
        text, self.pre = "".join(self.pre).replace(NBSP, " ").rstrip(), None
        text = re.sub("^\n+", "", text)
        if text.strip():
            self.blocks.append(text)


def read(html: str | None) -> Reader:
    r = Reader()
    r.feed(html or "")
    r.close()
    if r.pre is not None:
        r.end_pre()
    r.end()
    return r


def text_of(html: str | None) -> str | None:
    """Paragraphs parted by empty lines; preformatted text kept; null stays null."""
    return None if html is None else "\n\n".join(read(html).blocks)


def decode_one(text: str | None) -> str | None:
    return None if text is None else unescape(text).replace(NBSP, " ")


def candidates(html: str | None, post_url: str | None) -> list[dict]:
    """Images in order, with classes, sizes, alternative text, caption and the address chosen from srcset or src."""
    out = []
    for attrs, figure in read(html).images:
        a = {k: v or "" for k, v in attrs.items()}
        wide = [(int(m[2]), -i, m[1]) for i, m in enumerate(re.finditer(r"([^\s,]\S*)\s+(\d{1,9})w\s*(?:,|$)", a.get("srcset", "")))]
        wide = [x for x in wide if x[0] <= 2048]
        link = max(wide)[2] if wide else a.get("src", "").strip()
        url = urls.resolve(post_url, link) if link else None
        caption = " ".join("".join((figure or {}).get("caption") or []).split())
        out.append({"url": url, "classes": a.get("class", ""), "width": a.get("width", ""), "height": a.get("height", ""), "alt_text": " ".join(a.get("alt", "").split()), "caption": caption})
    return out


def excluded(c: dict) -> str | None:
    """The first rule that excludes an image candidate."""
    if {"emoji", "wp-smiley"} & set(c["classes"].split()):
        return "EMOJI"
    if any(re.fullmatch(r"[0-9]{1,9}", x.strip()) and int(x) < 64 for x in (c["width"], c["height"])):
        return "TOO_SMALL"
    return None if c["url"] and re.match(r"(?i)https://[^/?#]", c["url"]) else "NOT_HTTPS"


def images_of(html: str | None, post_url: str | None) -> list[dict]:
    """Kept images, the first of each address; scheme and host compare without case."""
    out = {}
    for c in candidates(html, post_url):
        if excluded(c) is None:
            head = re.match(r"[^/]*//[^/?#]*", c["url"])[0]
            out.setdefault(head.lower() + c["url"][len(head) :], {k: c[k] for k in ("url", "alt_text", "caption")})
    return list(out.values())


@F.pandas_udf(T.StringType())
def html_to_text(s: pd.Series) -> pd.Series:
    return s.map(text_of, na_action="ignore")


@F.pandas_udf(T.StringType())
def decode_entities(s: pd.Series) -> pd.Series:
    return s.map(decode_one, na_action="ignore")


@F.pandas_udf(T.ArrayType(IMAGE))
def extract_images(html: pd.Series, post_url: pd.Series) -> pd.Series:
    return pd.Series([images_of(h, u) for h, u in zip(html, post_url, strict=True)])


def title(raw: Column, kind: Column) -> Column:
    """Plain text of a title: html and xhtml are read as HTML, all else stays as it is."""
    return F.when(kind.isin("html", "xhtml"), html_to_text(raw)).otherwise(raw)

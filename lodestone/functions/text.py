"""Word, passage, snippet, tag and key expressions."""
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# White space of words and queries, white space that strip() of tags and titles removes, window sizes.
WORD_GAP = "[\\p{IsWhite_Space}\\x{1C}-\\x{1F}]+"
STRIP = "[\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{1680}\\x{2000}-\\x{2006}\\x{2008}-\\x{200A}\\x{2028}\\x{2029}\\x{205F}\\x{3000}]+"
CHUNK_WORDS, STEP, PIECE, SNIPPET, TITLE_TOKENS = 300, 250, 64, 60, 64
BODY_TOKENS, OVERLAP_WORDS, OVERLAP_TOKENS, PASSAGE_VERSION = 400, 50, 100, 1
BGE_QUERY = "Represent this sentence for searching relevant passages: "
GEMMA_QUERY = "task: search result | query: "


def words(c: Column) -> Column:
    """Non-empty words, cut into pieces of at most 64 code points."""
    ws = F.filter(F.split(c, WORD_GAP), lambda w: w != "")
    cut = F.flatten(F.transform(ws, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / PIECE).cast("int")), lambda i: F.substr(w, i * PIECE + 1, F.lit(PIECE)))))
    return F.when(F.exists(ws, lambda w: F.length(w) > PIECE), cut).otherwise(ws)


def normalised(c: Column) -> Column:
    return F.array_join(words(c), " ")


def strip_ws(c: Column) -> Column:
    """Without white space of the words' class at both ends."""
    return F.regexp_replace(c, f"^{WORD_GAP}|{WORD_GAP}$", "")


def java_strip(c: Column) -> Column:
    """Without white space at both ends; no-break spaces stay."""
    return F.regexp_replace(c, f"^{STRIP}|{STRIP}$", "")


def snippet(c: Column) -> Column:
    """First 60 single-space words, and an ellipsis when more follow."""
    ws = F.split(c, " ")
    return F.when(truncated(c), F.concat(F.array_join(F.slice(ws, 1, SNIPPET), " "), F.lit(" …"))).otherwise(c)


def truncated(c: Column) -> Column:
    return F.size(F.split(c, " ")) > SNIPPET


def window_starts(n: Column) -> Column:
    """Numbers of the windows over n one-token words; no word gives one empty window."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - CHUNK_WORDS) / STEP)).cast("int"))


def window(ws: Column, k: Column) -> Column:
    """Text of window k: 300 words, 250 apart."""
    return F.array_join(F.slice(ws, k * STEP + 1, F.lit(CHUNK_WORDS)), " ")


def windows_by_cost(costs: list[int], target: int = CHUNK_WORDS, body: int = BODY_TOKENS, overlap: int = OVERLAP_WORDS, cap: int = OVERLAP_TOKENS) -> list[tuple[int, int]]:
    """(start, end) of greedy windows: as many words as the target and the token budget allow, one at least.

    The next window repeats the words before its start that fit the overlap's words, its token cap and the budget that the word
    after them leaves, and begins at least one word later.
    """
    out, start, end, n = [], 0, 0, len(costs)
    while end < n or not out:
        end, left = start, body
        while end < n and end - start < target and costs[end] <= left:
            left -= costs[end]
            end += 1
        end = min(n, max(end, start + 1))
        out.append((start, end))
        left, back = min(cap, body - (costs[end] if end < n else 0)), end
        while back > 0 and end - back < overlap and costs[back - 1] <= left:
            left -= costs[back - 1]
            back -= 1
        start = max(back, start + 1)
    return out


def token_windows(rows: DataFrame, cost: Callable[[str], int]) -> DataFrame:
    """doc_id, start, end, tokens of the windows of (doc_id, ws) under a token budget, `cost` giving each word's tokens."""
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            out = []
            for d, ws in zip(p["doc_id"], p["ws"], strict=True):
                c = [cost(w) for w in ws] if ws is not None else []
                out += [(d, a, b, sum(c[a:b])) for a, b in windows_by_cost(c)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "tokens"])

    return rows.select("doc_id", "ws").mapInPandas(run, "doc_id long, start int, end int, tokens int")


def title_line(c: Column, budget: int = TITLE_TOKENS) -> Column:
    """Longest prefix of whole one-token words within the budget."""
    return F.array_join(F.slice(words(c), 1, budget), " ")


def title_prefix(costs: list[int], budget: int = TITLE_TOKENS) -> int:
    """Words of a title that fit a token budget, up to the first that does not."""
    n = 0
    while n < len(costs) and costs[n] <= budget:
        budget -= costs[n]
        n += 1
    return n


def passage(title: Column, chunk: Column) -> Column:
    return F.array_join(F.filter(F.array(title, chunk), lambda x: x != ""), "\n")


def gemma_passage(title: Column, chunk: Column) -> Column:
    return F.concat(F.lit("title: "), F.when(title == "", "none").otherwise(title), F.lit(" | text: "), chunk)


def fingerprint(recipe: str, title: Column, body: Column, images: Column | None = None) -> Column:
    """SHA-256 of recipe, title, body and the url and description of each image, by lines."""
    lines = F.array(F.lit(recipe), title, body)
    if images is not None:
        lines = F.concat(lines, F.flatten(F.transform(images, lambda i: F.array(i["url"], i["description"]))))
    return F.sha2(F.array_join(lines, "\n"), 256)


def recipe(model: str, prep: str | None = None, budget: tuple[int, int, int, int, int] | None = None, images: bool = False) -> str:
    """Identity of everything that shapes index entries; budget: body, overlap, title, prepared, context tokens."""
    parts = [model, f"w{CHUNK_WORDS}-t{BODY_TOKENS}-o{OVERLAP_WORDS}-oc{OVERLAP_TOKENS}-c{PIECE}", f"tt{TITLE_TOKENS}-p{PASSAGE_VERSION}"]
    if prep is not None:
        parts += [f"prep-{prep}", "b-{}-o-{}-t-{}-p-{}-c-{}".format(*check_budget(*budget))]
    return "/".join([*parts, "images-v1"] if images else parts)


def check_budget(body: int, overlap: int, title: int, prepared: int, context: int) -> tuple[int, int, int, int, int]:
    """The budget, if body > 0, 0 <= overlap < body and 0 <= title <= prepared <= context."""
    if not (body > 0 and 0 <= overlap < body and 0 <= title <= prepared <= context):
        raise ValueError(f"token budget out of order: {(body, overlap, title, prepared, context)}")
    return body, overlap, title, prepared, context


def tags(c: Column) -> Column:
    """Stripped tags without blank ones, first seen of those equal but for case."""
    clean = F.filter(F.transform(F.filter(c, lambda t: t.isNotNull()), java_strip), lambda t: t != "")
    keys = F.transform(clean, F.lower)
    return F.filter(clean, lambda t, i: F.array_position(keys, F.lower(t)) == i + 1)


def tag_set(c: Column) -> Column:
    """Comparable form of tags: a sorted set without case."""
    return F.array_sort(F.transform(tags(c), F.lower))


def image_description(alt: Column, caption: Column, url: Column) -> Column:
    """Alternative text, else caption, else the address, with single spaces."""
    text = F.when(normalised(alt) != "", alt).when(normalised(caption) != "", caption).otherwise(F.concat(F.lit("Image: "), url))
    return normalised(text)


def file_key(c: Column) -> Column:
    """Bytes other than a-z, 0-9, _ and - as %hh, in lower-case hex."""
    pairs = F.filter(F.split(F.lower(F.hex(F.encode(c, "UTF-8"))), "(?<=\\G..)"), lambda h: h != "")
    return F.array_join(F.transform(pairs, lambda h: F.when(F.unhex(h).cast("string").rlike("^[a-z0-9_-]$"), F.unhex(h).cast("string")).otherwise(F.concat(F.lit("%"), h))), "")

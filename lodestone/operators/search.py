"""Search: scope, scores, best entry per post, ranking, result views."""
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions import text, vectors
from lodestone.operators.posts import nz_date

# Limits of results and queries.
MOST, DEFAULT, LONGEST_QUERY = 20, 10, 1000


class InvalidSearchQuery(ValueError):
    """BLANK, TOO_LONG or FROM_AFTER_TO."""


def query_text(raw: str) -> str:
    """The stripped query; blank ones, and those over 1000 UTF-16 units, are refused."""
    import regex

    t = regex.sub(r"^[\p{White_Space}\x1c-\x1f]+|[\p{White_Space}\x1c-\x1f]+$", "", raw)
    if not t:
        raise InvalidSearchQuery("BLANK")
    if len(t.encode("utf-16-le")) // 2 > LONGEST_QUERY:
        raise InvalidSearchQuery("TOO_LONG")
    return t


def scope(site: str | None = None, start: str | None = None, end: str | None = None) -> Column:
    """Condition over site_id and published_at; both days count, by the calendar of New Zealand."""
    if start and end and start > end:
        raise InvalidSearchQuery("FROM_AFTER_TO")
    day, rules = nz_date(F.col("published_at")), [F.lit(True)]
    if site is not None:
        rules.append(F.col("site_id") == site)
    if start:
        rules.append(day >= F.lit(start).cast("date"))
    if end:
        rules.append(day <= F.lit(end).cast("date"))
    return reduce(and_, rules)


def clamp(limit: int | None) -> int:
    return DEFAULT if limit is None else min(MOST, max(1, limit))


def scores(entries: DataFrame, queries: DataFrame) -> DataFrame:
    """Each entry with each query (query_id, vector): a few vectors that a user gave, so their frame is sent to all tasks.

    Entries whose vector has another length, or holds missing or non-finite values, have no score and drop out.
    """
    q = F.broadcast(queries.select("query_id", F.col("vector").alias("_q")).withColumn("_one", F.lit(1)))
    s = vectors.dot(F.col("embedding"), F.col("_q"))
    x = entries.withColumn("_one", F.lit(1)).join(q, "_one").withColumn("score", s).drop("_q", "_one")
    return x.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))


def best_entry(scored: DataFrame) -> DataFrame:
    """query_id, post_id, score, kind, idx: a post's best entry, chunks before images, then the lower index."""
    best = F.min(F.struct((-F.col("score")).alias("s"), F.col("kind").alias("kind"), F.col("idx").alias("idx"))).alias("m")
    out = scored.groupBy("query_id", "post_id").agg(best)
    return out.select("query_id", "post_id", (-F.col("m.s")).alias("score"), F.col("m.kind").alias("kind"), F.col("m.idx").alias("idx"))


def ranked(best: DataFrame, posts: DataFrame, limit: int | None = None) -> DataFrame:
    """The best posts of one query: by score, newer first, then id; at most `limit`, which is held to 1 to 20."""
    x = best.join(posts.select("post_id", "published_at"), "post_id")
    return x.orderBy(F.desc("score"), F.desc("published_at"), "post_id").limit(clamp(limit))


def ranked_each(best: DataFrame, posts: DataFrame, limit: int | None = None) -> DataFrame:
    """`ranked` for many queries at once, with the rank in each."""
    from pyspark.sql import Window as W

    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("published_at"), "post_id")
    return best.join(posts.select("post_id", "published_at"), "post_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= clamp(limit))


def result_view(matches: DataFrame, posts: DataFrame, entries: DataFrame) -> DataFrame:
    """Results as search_posts shows them: three decimals, day in New Zealand, snippet of the entry's text, image if one matched."""
    t = F.coalesce("text", F.lit(""))
    x = matches.drop("published_at").join(posts.select("post_id", "title", "url", "site_id", "published_at"), "post_id").join(entries.select("post_id", "kind", "idx", "text", "image_url"), ["post_id", "kind", "idx"])
    return x.select("post_id", "title", "url", F.col("site_id").alias("site"), nz_date(F.col("published_at")).alias("published"), F.round("score", 3).alias("score"), text.snippet(t).alias("snippet"), text.truncated(t).alias("truncated"), F.when(F.col("kind") == "IMAGE", F.col("image_url")).alias("matched_image"))

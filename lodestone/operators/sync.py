"""Synchronising a site's listing with stored posts: revisions, withdrawals, checkpoints, reports."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone.functions import text, urls

ASPECTS = ["TITLE", "BODY", "COMPLETENESS", "TAGS", "URL", "PUBLISHED_AT", "IMAGES"]
RANGE = 4096  # pages whose running maximum one task computes


def _uri(c: Column) -> Column:
    """An address whose scheme and host compare without case."""
    head = F.regexp_extract(c, r"^([^/?#]*//[^/?#]*)?", 0)
    return F.concat(F.lower(head), F.substr(c, F.length(head) + 1))


def contents(posts: DataFrame, prefix: str) -> DataFrame:
    """post_id, time and a comparable value of each aspect; long texts as digests, so that no body is shuffled."""
    images = F.transform("images", lambda i: F.struct(_uri(i["url"]).alias("url"), i["alt_text"].alias("alt_text"), i["caption"].alias("caption")))
    aspects = [F.sha2("title", 256), F.sha2("body", 256), F.col("completeness"), F.to_json(text.tag_set(F.col("tags"))), _uri(F.col("url")), F.col("published_at").cast("string"), F.sha2(F.to_json(images), 256)]
    return posts.select("post_id", F.col("updated_at").alias(f"{prefix}_at"), F.array(*aspects).alias(prefix))


def _differing(new: str, old: str) -> Column:
    flags = F.zip_with(F.col(new), F.col(old), lambda a, b: ~a.eqNullSafe(b))
    return F.filter(F.array(*map(F.lit, ASPECTS)), lambda a, i: F.get(flags, i))


def _revision(known: Column, new_at: Column, old_at: Column, changed: Column) -> Column:
    kind = F.when(~known, "PUBLISHED").when(new_at < old_at, "STALE").when(F.size(changed) > 0, "CHANGED")
    return kind.when(new_at > old_at, "TOUCHED").otherwise("UNCHANGED")


def classify(new: DataFrame, old: DataFrame) -> DataFrame:
    """post_id, revision, changed aspects of each snapshot against the stored posts; one snapshot a post."""
    x = contents(new, "new").join(contents(old, "old"), "post_id", "left").withColumn("diff", _differing("new", "old"))
    kind = _revision(F.col("old").isNotNull(), F.col("new_at"), F.col("old_at"), F.col("diff"))
    return x.select("post_id", kind.alias("revision"), F.when(kind == "CHANGED", F.col("diff")).otherwise(F.array().cast("array<string>")).alias("changed"))


def fold(feed: DataFrame) -> DataFrame:
    """key, arrival, revision of a feed (key, arrival, updated_at, kind, content) with any number of entries a key.

    Entries apply in arrival order: what is older than the last one that applied is STALE; NOT_PUBLIC withdraws the post, which a
    later entry publishes again; MALFORMED entries are SKIPPED and do not count.
    """
    w = W.partitionBy("key").orderBy("arrival")
    x = feed.withColumn("life", F.count(F.when(F.col("kind") == "NOT_PUBLIC", 1)).over(w.rowsBetween(W.unboundedPreceding, -1)))
    live = F.col("kind") == "AVAILABLE"
    past = W.partitionBy("key", "life").orderBy("arrival").rowsBetween(W.unboundedPreceding, -1)
    x = x.withColumn("last_at", F.max(F.when(live, F.col("updated_at"))).over(past))
    # what applied last has the largest time so far, and of equal ones it came last
    x = x.withColumn("applies", live & (F.col("last_at").isNull() | (F.col("updated_at") >= F.col("last_at"))))
    x = x.withColumn("held", F.last(F.when(F.col("applies"), F.struct("content")), ignorenulls=True).over(past))
    seen = F.col("last_at").isNotNull()
    kind = F.when(F.col("kind") == "MALFORMED", "SKIPPED").when(F.col("kind") == "NOT_PUBLIC", F.when(seen, "WITHDRAWN").otherwise("SKIPPED"))
    kind = kind.when(~seen, "PUBLISHED").when(~F.col("applies"), "STALE").when(~F.col("content").eqNullSafe(F.col("held.content")), "CHANGED")
    return x.select("key", "arrival", kind.when(F.col("updated_at") > F.col("last_at"), "TOUCHED").otherwise("UNCHANGED").alias("revision"))


def duplicate_urls(snapshots: DataFrame, stored: DataFrame, site_host: Column) -> DataFrame:
    """post_id, owner: snapshots on the site's host whose address a stored post of another id has."""
    s = snapshots.where(urls.on_site(F.col("url"), site_host)).select("post_id", urls.normalised(F.col("url")).alias("address"))
    o = stored.select(F.col("post_id").alias("owner"), urls.normalised(F.col("url")).alias("address"))
    return s.join(o, "address").where("post_id <> owner").groupBy("post_id").agg(F.min("owner").alias("owner"))


def not_public(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """post_id, outcome of entries that are no longer public: withdrawn where stored, else skipped."""
    s = stored.select("post_id", F.lit(True).alias("known"))
    return entries.where("kind = 'NOT_PUBLIC'").select("post_id").distinct().join(s, "post_id", "left").select("post_id", F.when(F.col("known"), "NO_LONGER_PUBLIC").otherwise("SKIPPED").alias("outcome"))


def verdict(listed: DataFrame) -> DataFrame:
    """One row: WITHDRAW, or the warning that suppresses withdrawals; an empty listing is tested first."""
    n, odd = F.count(F.lit(1)), F.coalesce(F.bool_or(F.col("post_id").isNull()), F.lit(False))
    return listed.agg(F.when(n == 0, "EMPTY_LISTING_WITHDRAWALS_SUPPRESSED").when(odd, "UNIDENTIFIED_MALFORMED_ENTRY_WITHDRAWALS_SUPPRESSED").otherwise("WITHDRAW").alias("verdict"))


def unlisted(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """Stored posts to withdraw; an empty listing, or one with an unreadable id, withdraws nothing."""
    # the verdict is one row
    allowed = verdict(listed).where("verdict = 'WITHDRAW'").select(F.lit(1).alias("one"))
    return stored.join(listed.select("post_id"), "post_id", "left_anti").withColumn("one", F.lit(1)).join(F.broadcast(allowed), "one", "left_semi").drop("one")


def site_removed(stored: DataFrame, sites: DataFrame) -> DataFrame:
    """post_id, reason of posts whose site is configured no more."""
    return stored.join(sites.select("site_id"), "site_id", "left_anti").select("post_id", F.lit("SITE_REMOVED").alias("reason"))


def high_water(feed: DataFrame) -> DataFrame:
    """Running maximum of ts by page (null times do not count): within ranges of pages, and over the ranges' maxima before."""
    pages = feed.groupBy("page").agg(F.max("ts").alias("m")).withColumn("range", F.floor(F.col("page") / RANGE))
    tops = pages.groupBy("range").agg(F.max("m").alias("top"))
    tops = tops.select("range", F.max("top").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    within = F.max("m").over(W.partitionBy("range").orderBy("page").rowsBetween(W.unboundedPreceding, W.currentRow))
    return pages.withColumn("mark", within).join(tops, "range").select("page", F.greatest("mark", "carried").alias("mark"))


def checkpoint(pages: DataFrame) -> DataFrame:
    """site_id, mark after a run of (site_id, change_order, page, last_page, failed, mark): oldest-first sources advance after every

    page that was read, others only with the last one; a failed page and all after it leave the last safe mark.
    """
    w = W.partitionBy("site_id").orderBy("page").rowsBetween(W.unboundedPreceding, W.currentRow)
    ok = pages.withColumn("broken", F.max(F.col("failed").cast("int")).over(w)).where("broken = 0")
    safe = F.when((F.col("change_order") == "OLDEST_FIRST"), F.max("mark")).when(F.bool_or("last_page"), F.max("mark"))
    got = ok.groupBy("site_id", "change_order").agg(safe.alias("mark"))
    return pages.select("site_id").distinct().join(got.select("site_id", "mark"), "site_id", "left")


def changes_since(seen: Column) -> Column:
    """Where the next incremental run begins: an hour before the mark; null means everything."""
    return seen - F.expr("INTERVAL 1 HOUR")


def advance(seen: Column, mark: Column) -> Column:
    return F.greatest(seen, mark)


def reconcile_due(last: Column, now: Column) -> Column:
    return last.isNull() | (last < now - F.expr("INTERVAL 24 HOURS"))


def site_modes(sites: DataFrame, checkpoints: DataFrame, requested: str, now: Column) -> DataFrame:
    """site_id, mode: an incremental run becomes a reconciling one for sites where that is due."""
    x = sites.join(checkpoints.select("site_id", "last_reconciled_at"), "site_id", "left")
    mode = F.when(F.lit(requested == "RECONCILE") | reconcile_due(F.col("last_reconciled_at"), now), "RECONCILE").otherwise("INCREMENTAL")
    return x.select("site_id", mode.alias("mode"))


def outcome(pages: Column, failed: Column, running: Column) -> Column:
    return F.when(running, "SKIPPED").when(~failed, "COMPLETED").when(pages > 0, "PARTIAL").otherwise("FAILED")


def reconciled_at(mode: Column, listing: Column, now: Column, before: Column) -> Column:
    """A site counts as reconciled only if its withdrawals were allowed."""
    return F.when((mode == "RECONCILE") & (listing == "WITHDRAW"), now).otherwise(before)


def report(revisions: DataFrame) -> DataFrame:
    """Counts by site of (site_id, revision): touched and stale posts count as unchanged."""
    n = lambda *kinds: F.count(F.when(F.col("revision").isin(*kinds), 1))
    return revisions.groupBy("site_id").agg(n("PUBLISHED").alias("published"), n("CHANGED").alias("revised"), n("UNCHANGED", "TOUCHED", "STALE").alias("unchanged"), n("WITHDRAWN").alias("withdrawn"), n("SKIPPED").alias("skipped"))

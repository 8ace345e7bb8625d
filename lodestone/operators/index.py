"""Keeping the vector index in step with the catalogue: decisions, orphans, load rules, image attempts."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone.functions import text, urls

METADATA = ["site_id", "url", "title", "tag_set", "published_at", "updated_at"]
DUPLICATE = "duplicate post ID in the catalog listing"


def metadata(posts: DataFrame) -> DataFrame:
    """post_id, the six fields of a post's index metadata (tags as a set), and what else the frame holds of an index row."""
    rest = [c for c in ("completeness", "fingerprint", "kind", "reason") if c in posts.columns]
    return posts.select("post_id", "site_id", "url", "title", F.array_sort(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))).alias("tag_set"), "published_at", "updated_at", *rest)


def catalog_entries(states: DataFrame) -> DataFrame:
    """Each catalogue state with kind READABLE, UNREADABLE (the id is sound, the rest is not) or UNIDENTIFIED, and a reason."""
    sound = F.regexp_extract("post_id", urls.POST_ID, 1).rlike(urls.SITE_ID) & ~F.regexp_extract("post_id", urls.POST_ID, 2).rlike(r"^\s*$")
    missing = F.when(F.col("title").isNull(), "title").when(F.col("body").isNull(), "body").when(F.col("url").isNull(), "url").when(F.col("published_at").isNull() | F.col("updated_at").isNull(), "time")
    bad = F.when(missing.isNotNull(), F.concat(F.lit("missing "), missing)).when(~F.coalesce(F.col("completeness").isin("FULL", "SUMMARY"), F.lit(False)), "unknown completeness")
    kind = F.when(~F.coalesce(sound, F.lit(False)), "UNIDENTIFIED").when(bad.isNotNull(), "UNREADABLE").otherwise("READABLE")
    return states.withColumn("kind", kind).withColumn("reason", F.when(kind == "UNIDENTIFIED", F.concat(F.lit("not a post id: "), F.coalesce("post_id", F.lit("")))).otherwise(bad))


def listed_once(entries: DataFrame) -> DataFrame:
    """Ids listed more than once become one unreadable entry each."""
    known = entries.where("kind <> 'UNIDENTIFIED'")
    w = W.partitionBy("post_id")
    x = known.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("k", F.row_number().over(w.orderBy("kind"))).where("k = 1").drop("k")
    return x.withColumn("kind", F.when(F.col("n") > 1, "UNREADABLE").otherwise(F.col("kind"))).withColumn("reason", F.when(F.col("n") > 1, DUPLICATE).otherwise(F.col("reason"))).drop("n")


def plan(entries: DataFrame, index: DataFrame) -> DataFrame:
    """post_id, outcome, reason of a reconciliation of catalogue entries (kind, reason, metadata, fingerprint) with the index.

    Summaries are never indexed. Orphans of the index go, unless an entry without readable id may be one of them.
    """
    has = {"kind": F.lit("READABLE"), "reason": F.lit(None).cast("string")}
    e = entries.withColumns({c: v for c, v in has.items() if c not in entries.columns})
    # at most one row says that orphan removal is suppressed
    blocked = e.where("kind = 'UNIDENTIFIED'").select(F.lit(1).alias("one")).limit(1)
    c = metadata(listed_once(e)).withColumnRenamed("fingerprint", "current").withColumn("listed", F.lit(True))
    i = metadata(index).select("post_id", "fingerprint", *[F.col(m).alias(f"i_{m}") for m in METADATA]).withColumn("indexed", F.lit(True))
    x = c.join(i, "post_id", "full").withColumn("one", F.lit(1)).join(F.broadcast(blocked.withColumn("blocked", F.lit(True))), "one", "left")
    same = F.lit(True)
    for m in METADATA:
        same = same & F.col(m).eqNullSafe(F.col(f"i_{m}"))
    gone = F.when(F.col("indexed"), "REMOVED").otherwise("EXCLUDED")
    out = F.when(F.col("listed").isNull(), F.when(F.col("blocked"), None).otherwise("REMOVED")).when(F.col("kind") == "UNREADABLE", "FAILED").when(F.col("completeness") == "SUMMARY", gone)
    out = out.when(F.col("indexed").isNull(), "ADDED").when(~F.col("current").eqNullSafe(F.col("fingerprint")), "RE_EMBEDDED").when(~same, "METADATA_REFRESHED").otherwise("UNCHANGED")
    return x.select("post_id", out.alias("outcome"), "reason").where("outcome is not null")


def orphans(index: DataFrame, entries: DataFrame) -> DataFrame:
    """Ids of the index that no entry has, by id."""
    return index.join(entries.select("post_id"), "post_id", "left_anti").select("post_id").orderBy("post_id")


def suppressed(index: DataFrame, entries: DataFrame) -> DataFrame:
    """Orphans that stay, and the sorted reasons why."""
    reasons = entries.where("kind = 'UNIDENTIFIED'").agg(F.array_sort(F.collect_set("reason")).alias("reasons"), F.lit(1).alias("one"))
    known = entries.where("kind <> 'UNIDENTIFIED'")
    return index.join(known.select("post_id"), "post_id", "left_anti").withColumn("one", F.lit(1)).join(F.broadcast(reasons), "one").where(F.size("reasons") > 0).select("post_id", F.array_join("reasons", "; ").alias("reasons"))


def report(outcomes: DataFrame) -> DataFrame:
    """outcome, n of a plan's rows, one outcome an id."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def apply(index: DataFrame, entries: DataFrame, outcomes: DataFrame, embed) -> DataFrame:
    """The index after a plan: `embed` turns new and changed entries into index rows, refreshed ones keep their vectors."""
    fresh = entries.join(outcomes.where("outcome in ('ADDED', 'RE_EMBEDDED')").select("post_id"), "post_id", "left_semi")
    moved = outcomes.where("outcome = 'METADATA_REFRESHED'").select("post_id")
    fields = ["site_id", "url", "title", "tags", "published_at", "updated_at"]
    new = entries.join(moved, "post_id", "left_semi").select("post_id", *fields)
    kept = index.join(outcomes.where("outcome in ('REMOVED', 'RE_EMBEDDED', 'METADATA_REFRESHED')").select("post_id"), "post_id", "left_anti")
    refreshed = index.drop(*fields).join(new, "post_id")
    return kept.unionByName(refreshed).unionByName(embed(fresh))


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    """post_id, outcome of removals by event: an id that is not indexed is ALREADY_ABSENT."""
    held = index.select("post_id").distinct().withColumn("held", F.lit(True))
    return ids.select("post_id").distinct().join(held, "post_id", "left").select("post_id", F.when(F.col("held"), "REMOVED").otherwise("ALREADY_ABSENT").alias("outcome"))


def load_status(expected_place: Column, place: Column, fmt: Column, model: Column, sizes: Column, current_model: str, dimension: int) -> Column:
    """First rule that a stored index file breaks, or LOADED; `sizes` are its vectors' lengths, null for undecodable ones."""
    bad = F.exists(sizes, lambda n: n.isNull() | (n != dimension))
    return (
        F.when(~expected_place.eqNullSafe(place), "UNREADABLE: wrong location").when(~F.coalesce(fmt.isin(1, 2), F.lit(False)), "UNREADABLE: unknown format")
        .when(model.isNull(), "UNREADABLE: no model").when(model != current_model, "INCOMPATIBLE_MODEL").when(bad, "UNREADABLE: dimension").otherwise("LOADED")
    )


def settled(attempts: Column) -> Column:
    """Images whose attempt was INDEXED or SKIPPED; PENDING ones are tried again, since the stored fingerprint lacks them."""
    return F.filter(attempts, lambda a: a["status"] != "PENDING")


def fingerprints(recipe: str, title: Column, body: Column, attempts: Column) -> tuple[Column, Column]:
    """The fingerprint over all images, and the one that is stored."""
    return text.fingerprint(recipe, title, body, attempts), text.fingerprint(recipe, title, body, settled(attempts))


def adopt(legacy: DataFrame, current: DataFrame) -> DataFrame:
    """Rows of an index without profile join the profile's, unless their id is there."""
    return current.unionByName(legacy.join(current.select("post_id"), "post_id", "left_anti").select(current.columns))

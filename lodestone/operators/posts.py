"""Row mappers of the two platforms, post views and events."""
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.functions import html, text, urls

STATE = ["url", "title", "body", "completeness", "tags", "images", "published_at", "updated_at"]


def _at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def gmt(c: Column) -> Column:
    """Time of a zone-less text that means UTC; null for anything else."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?$"), F.try_to_timestamp(F.concat(c, F.lit("Z"))))


def offset_time(c: Column) -> Column:
    """Time of a text with an offset; null for anything else."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(c))


def _entry(source_id: Column, updated: Column, updated_name: str, public: Column, published: Column, published_name: str, link: Column, site_host: Column) -> tuple[Column, Column]:
    """kind and reason of a source entry, the first broken rule deciding."""
    on = urls.on_site(link, site_host)
    web = F.coalesce((urls.scheme(link) == "https") & urls.host(link).isNotNull(), F.lit(False))
    reason = F.when(source_id.isNull(), "missing or invalid id").when(updated.isNull(), f"missing or invalid {updated_name}")
    reason = reason.when(~public, None).when(published.isNull(), f"missing or invalid {published_name}")
    reason = reason.when(~web, F.concat(F.lit("Not an absolute https link: '"), link, F.lit("'"))).when(~on, F.concat(F.lit("Link "), link, F.lit(" is not on the site host "), site_host))
    kind = F.when(source_id.isNull() | updated.isNull(), "MALFORMED").when(~public, "NOT_PUBLIC").when(reason.isNotNull(), "MALFORMED").otherwise("AVAILABLE")
    return kind, reason


def snapshot(df: DataFrame) -> DataFrame:
    """updated_at is never before published_at."""
    return df.withColumn("updated_at", F.greatest("updated_at", "published_at"))


def map_wordpress(entries: DataFrame, tag_names: DataFrame, as_text=html.html_to_text) -> DataFrame:
    """Source entries of (site_id, site_host, page, pos, json), with tag names (tag_id, name) joined in the tags' order.

    A tag without name, or an id that is no whole number, is dropped with a note. Malformed and not public entries keep their
    id and time, as far as they are readable, and nothing else.
    """
    v = F.try_parse_json("json")
    id_kind, id_text = _kind(v, "$.id"), _at(v, "$.id")
    readable = id_kind.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$") | ((id_kind == "STRING") & ~id_text.rlike(r"^\s*$"))
    text_at = lambda path: F.when(_kind(v, path) == "STRING", _at(v, path))
    x = entries.select(
        "site_id", "site_host", "page", "pos", F.when(readable, id_text).alias("source_post_id"),
        gmt(text_at("$.modified_gmt")).alias("updated_at"), gmt(text_at("$.date_gmt")).alias("published_at"), F.coalesce(_at(v, "$.link"), F.lit("")).alias("link"),
        (~F.coalesce(_at(v, "$.content.protected", "boolean"), F.lit(False)) & (F.coalesce(_at(v, "$.status"), F.lit("publish")) == "publish")).alias("public"),
        F.coalesce(_at(v, "$.title.rendered"), F.lit("")).alias("raw_title"), F.coalesce(_at(v, "$.content.rendered"), F.lit("")).alias("raw_body"),
        F.coalesce(_at(v, "$.tags", "array<string>"), F.array().cast("array<string>")).alias("tag_ids"),
    )
    key = ["site_id", "page", "pos"]
    named = x.select(*key, F.posexplode("tag_ids").alias("k", "tag")).withColumn("tag_id", F.when(F.col("tag").rlike(r"^-?\d{1,18}$"), F.col("tag")).cast("long"))
    named = named.join(tag_names.select("tag_id", "name"), "tag_id", "left")
    note = F.when(F.col("name").isNull(), F.concat(F.lit("unknown tag id "), "tag", F.lit(" was dropped")))
    folded = named.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("k", "name", note.alias("note")))).alias("t"))
    folded = folded.select(*key, F.filter(F.col("t")["name"], lambda n: n.isNotNull()).alias("names"), F.filter(F.col("t")["note"], lambda n: n.isNotNull()).alias("found"))
    kind, reason = _entry(F.col("source_post_id"), F.col("updated_at"), "modified_gmt", F.col("public"), F.col("published_at"), "date_gmt", F.col("link"), F.col("site_host"))
    x = x.withColumn("kind", kind).withColumn("reason", reason).join(folded, key, "left")
    ok = lambda c: F.when(F.col("kind") == "AVAILABLE", c)
    none = F.array().cast("array<string>")
    return snapshot(x.select(
        *key, "kind", "source_post_id", "reason", ok(F.concat_ws(":", "site_id", "source_post_id")).alias("post_id"), ok(F.col("link")).alias("url"),
        ok(as_text(F.col("raw_title"))).alias("title"), ok(as_text(F.col("raw_body"))).alias("body"), ok(F.lit("FULL")).alias("completeness"),
        ok(text.tags(F.coalesce("names", none))).alias("tags"), ok(html.extract_images(F.col("raw_body"), F.col("link"))).alias("images"),
        ok(F.col("published_at")).alias("published_at"), "updated_at", ok(F.coalesce("found", none)).alias("notes"),
    ))


def map_blogger(entries: DataFrame, as_text=html.html_to_text) -> DataFrame:
    """Source entries of (site_id, site_host, page, pos, json); without content the summary is the body, and has no images."""
    v = F.try_parse_json("json")
    t = lambda path: F.coalesce(F.when(_kind(v, f"$.{path}['$t']") == "STRING", _at(v, f"$.{path}['$t']")), F.lit(""))
    links = F.coalesce(_at(v, "$.link", "array<struct<rel:string,href:string>>"), F.array().cast("array<struct<rel:string,href:string>>"))
    full = _at(v, "$.content['$t']", "variant").isNotNull()
    x = entries.select(
        "site_id", "site_host", "page", "pos", F.nullif(F.regexp_extract(t("id"), r"\.post-(\d+)$", 1), F.lit("")).alias("source_post_id"),
        offset_time(t("updated")).alias("updated_at"), offset_time(t("published")).alias("published_at"),
        F.coalesce(F.get(F.filter(links, lambda x: x["rel"] == "alternate"), 0)["href"], F.lit("")).alias("link"),
        t("title").alias("raw_title"), F.coalesce(_at(v, "$.title.type"), F.lit("text")).alias("title_type"),
        F.when(full, t("content")).otherwise(t("summary")).alias("raw_body"), F.when(full, "FULL").otherwise("SUMMARY").alias("completeness"),
        F.coalesce(F.transform(_at(v, "$.category", "array<struct<term:string>>"), lambda c: c["term"]), F.array().cast("array<string>")).alias("terms"),
    )
    kind, reason = _entry(F.col("source_post_id"), F.col("updated_at"), "updated time", F.lit(True), F.col("published_at"), "published time", F.col("link"), F.col("site_host"))
    x = x.withColumn("kind", kind).withColumn("reason", reason)
    ok = lambda c: F.when(F.col("kind") == "AVAILABLE", c)
    images = F.when(F.col("completeness") == "FULL", html.extract_images(F.col("raw_body"), F.col("link"))).otherwise(F.array().cast("array<struct<url:string,alt_text:string,caption:string>>"))
    plain = F.when(F.col("title_type").isin("html", "xhtml"), as_text(F.col("raw_title"))).otherwise(F.col("raw_title"))
    return snapshot(x.select(
        "site_id", "page", "pos", "kind", "source_post_id", "reason", ok(F.concat_ws(":", "site_id", "source_post_id")).alias("post_id"), ok(F.col("link")).alias("url"),
        ok(plain).alias("title"), ok(as_text(F.col("raw_body"))).alias("body"), ok(F.col("completeness")).alias("completeness"), ok(text.tags(F.col("terms"))).alias("tags"),
        ok(images).alias("images"), ok(F.col("published_at")).alias("published_at"), "updated_at",
    ))


def has_more(reported_total: Column, page_size: Column, reached: Column, received: Column, short_page_ends: Column) -> Column:
    """Whether a listing has another page: a readable total decides, else a full page; some sources also end at a short page."""
    t = F.trim(reported_total)
    number = F.when(t.rlike(r"^[+-]?\d{1,10}$"), F.regexp_replace(t, "^[+]", "")).cast("long")
    total = F.when(number.between(-(2**31), 2**31 - 1), F.greatest(F.lit(0), number))
    more = F.when(total.isNotNull(), reached < total).otherwise(received >= page_size)
    return more & (~short_page_ends | (received >= page_size))


def nz_date(c: Column) -> Column:
    """Calendar day in New Zealand of a UTC time."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit("Pacific/Auckland"), c.cast("timestamp_ntz")))


def view(posts: DataFrame) -> DataFrame:
    """A post as get_post shows it."""
    return posts.select("post_id", "title", "url", F.col("site_id").alias("site"), nz_date(F.col("published_at")).alias("published"), "published_at", "updated_at", "tags", "completeness", "body")


def events(changes: DataFrame) -> DataFrame:
    """Integration events of (post_id, revision, changed, reason, post state): only published, revised and withdrawn posts have one."""
    kind = F.when(F.col("revision") == "PUBLISHED", "PUBLISHED").when(F.col("revision") == "CHANGED", "REVISED").when(F.col("revision") == "WITHDRAWN", "WITHDRAWN")
    held = F.col("type") != "WITHDRAWN"
    out = changes.withColumn("type", kind).where("type is not null")
    return out.select("type", "post_id", *[F.when(held, F.col(c)).alias(c) if c != "url" else F.col(c) for c in STATE], F.when(F.col("type") == "REVISED", F.col("changed")).alias("changed"), F.when(~held, F.col("reason")).alias("reason"))


def index_changes(event_rows: DataFrame) -> DataFrame:
    """What the index has to do for each event: an upsert for published and revised posts, else a removal."""
    return event_rows.select("post_id", F.when(F.col("type").isin("PUBLISHED", "REVISED"), "UPSERT").otherwise("REMOVE").alias("change"))


def by_id(posts: DataFrame, references: DataFrame) -> DataFrame:
    """ref, found, post_id of references to posts by id or address; the reference's kind decides how it is looked up."""
    r = references.select("ref", urls.reference_kind(F.col("ref")).alias("kind"), F.regexp_replace("ref", r"^\s+|\s+$", "").alias("key"))
    ids = r.where("kind = 'ID'").join(posts.select("post_id"), F.col("key") == F.col("post_id"), "left").select("ref", "kind", "post_id")
    addresses = r.where("kind = 'URL'").withColumn("address", urls.look_up(F.col("key")))
    stored = posts.select("post_id", urls.normalised(F.col("url")).alias("address"))
    by_url = addresses.join(stored, "address", "left").select("ref", "kind", "post_id")
    bad = r.where("kind not in ('ID', 'URL')").select("ref", "kind", F.lit(None).cast("string").alias("post_id"))
    return ids.unionByName(by_url).unionByName(bad).withColumn("found", F.col("post_id").isNotNull())

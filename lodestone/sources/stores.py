"""Stores of posts, checkpoints and index entries as partitioned JSON, with quarantine of what cannot be read."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.functions import vectors

FORMAT, READABLE = 2, (1, 2)
IMAGES = "array<struct<url:string,altText:string,caption:string>>"
POST = f"format int, postId string, canonicalUrl string, title string, body string, completeness string, tags array<string>, images {IMAGES}, publishedAt string, updatedAt string, site_id string, _corrupt string"
CHECKPOINT = "format int, siteId string, changesSeenUpTo string, lastReconciledAt string, _corrupt string"
ENTRY = "format int, postId string, modelId string, recipe string, fingerprint string, kind string, idx long, text string, image_url string, vector string, profile string, site_id string, _corrupt string"
_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def _written(c: str):
    return F.date_format(c, _TIME)


def _read(spark: SparkSession, path: str, schema: str, reason) -> tuple[DataFrame, DataFrame]:
    """Readable rows, and the quarantine: rows with the reason why they are not."""
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.withColumn("_reason", F.when(F.col("_corrupt").isNotNull(), "not readable JSON").when(~F.coalesce(F.col("format").isin(*READABLE), F.lit(False)), "unknown format").otherwise(reason))
    return rows.where("_reason is null").drop("_reason", "_corrupt"), rows.where("_reason is not null").select(F.coalesce("_corrupt", F.to_json(F.struct(*[c for c in rows.columns if not c.startswith("_")]))).alias("content"), F.col("_reason").alias("reason"))


def save_posts(posts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder a site; `overwrite` replaces only the sites that posts holds."""
    images = F.transform("images", lambda i: F.struct(i["url"].alias("url"), i["alt_text"].alias("altText"), i["caption"].alias("caption")))
    out = posts.select(F.lit(FORMAT).alias("format"), F.col("post_id").alias("postId"), F.col("url").alias("canonicalUrl"), "title", "body", "completeness", "tags", images.alias("images"), _written("published_at").alias("publishedAt"), _written("updated_at").alias("updatedAt"), "site_id")
    out.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false").partitionBy("site_id").json(path)


def load_posts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Posts, and the quarantine. A post whose id belongs to another site's folder is not readable; format 1 has no images."""
    place = F.when(F.substring_index("postId", ":", 1) != F.col("site_id"), "wrong location").when(F.col("postId").isNull(), "no id")
    good, bad = _read(spark, path, POST, place)
    images = F.transform(F.coalesce("images", F.array().cast(IMAGES)), lambda i: F.struct(i["url"].alias("url"), i["altText"].alias("alt_text"), i["caption"].alias("caption")))
    time = lambda c: F.try_to_timestamp(F.col(c))
    return good.select(F.col("postId").alias("post_id"), "site_id", F.col("canonicalUrl").alias("url"), "title", "body", "completeness", "tags", images.alias("images"), time("publishedAt").alias("published_at"), time("updatedAt").alias("updated_at")), bad


def save_checkpoints(marks: DataFrame, path: str) -> None:
    marks.select(F.lit(1).alias("format"), F.col("site_id").alias("siteId"), _written("changes_seen_up_to").alias("changesSeenUpTo"), _written("last_reconciled_at").alias("lastReconciledAt")).write.mode("overwrite").json(path)


def load_checkpoints(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    good, bad = _read(spark, path, CHECKPOINT, F.when(F.col("siteId").isNull(), "no id"))
    return good.select(F.col("siteId").alias("site_id"), F.try_to_timestamp("changesSeenUpTo").alias("changes_seen_up_to"), F.try_to_timestamp("lastReconciledAt").alias("last_reconciled_at")), bad


def health(quarantine: DataFrame) -> DataFrame:
    """One row: DAMAGED where anything is in quarantine, which makes the next run a full one."""
    return quarantine.agg(F.when(F.count(F.lit(1)) > 0, "DAMAGED").otherwise("HEALTHY").alias("health"))


def save_index(entries: DataFrame, path: str, profile: str, model: str, recipe: str) -> None:
    """Index entries by profile and site, vectors as base64 of 32-bit floats."""
    out = entries.select(F.lit(FORMAT).alias("format"), F.col("post_id").alias("postId"), F.lit(model).alias("modelId"), F.lit(recipe).alias("recipe"), "fingerprint", "kind", F.col("idx").cast("long").alias("idx"), "text", "image_url", vectors.encoded(F.col("embedding")).alias("vector"), F.lit(profile).alias("profile"), "site_id")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("profile", "site_id").json(path)


def load_index(spark: SparkSession, path: str, profile: str, model: str, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Entries of a profile and model, and the quarantine; entries of another model are left out without a word."""
    size = F.size(vectors.decoded(F.col("vector")))
    reason = F.when(F.substring_index("postId", ":", 1) != F.col("site_id"), "wrong location").when(F.col("modelId").isNull(), "no model").when((F.col("modelId") == model) & ~F.coalesce(size == dimension, F.lit(False)), "dimension")
    good, bad = _read(spark, path, ENTRY, reason)
    mine = good.where((F.col("profile") == profile) & (F.col("modelId") == model))
    return mine.select(F.col("postId").alias("post_id"), "site_id", "recipe", "fingerprint", "kind", "idx", "text", "image_url", vectors.decoded(F.col("vector")).alias("embedding")), bad

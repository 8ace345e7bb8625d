"""Rules of the sites configuration; all violations are reported."""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestone.functions import urls

SITES = "syncEveryHours string, sites array<struct<id:string,platform:string,baseUrl:string>>"


def definitions(config: DataFrame) -> DataFrame:
    """pos, id, platform, base_url of the sites of a configuration (column json)."""
    return config.select(F.posexplode(F.from_json("json", SITES)["sites"]).alias("pos", "s")).select("pos", "s.id", "s.platform", F.col("s.baseUrl").alias("base_url"))


def interval_problem(value: Column) -> Column:
    """Hours between runs: whole and at least 1; null where absent or sound."""
    return F.when(value.isNull(), None).when(~value.rlike(r"^-?\d{1,18}$"), "INVALID_SYNC_INTERVAL").when(F.when(value.rlike(r"^-?\d{1,18}$"), value).cast("long") < 1, "INVALID_SYNC_INTERVAL")


def base_url_problem(c: Column) -> Column:
    https = F.coalesce(urls.scheme(c) == "https", F.lit(False))
    return F.when(~https, "BASE_URL_NOT_ABSOLUTE_HTTPS").when(c.rlike("[?#]"), "BASE_URL_HAS_QUERY_OR_FRAGMENT")


def violations(sites: DataFrame) -> DataFrame:
    """kind, detail of every broken rule of (pos, id, platform, base_url); repeats count once each, from the second on."""
    known = F.coalesce(F.col("id").rlike(urls.SITE_ID), F.lit(False))
    none = sites.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit("NO_SITES").alias("kind"), F.lit("").alias("detail"))
    row = lambda kind, c: (F.lit(kind).alias("kind"), F.coalesce(c, F.lit("")).alias("detail"))
    bad_id = sites.where(~known).select(*row("INVALID_SITE_ID", F.col("id")))
    platform = sites.where(~F.coalesce(F.lower("platform").isin("wordpress", "blogger"), F.lit(False))).select(*row("UNSUPPORTED_PLATFORM", F.col("platform")))
    problem = sites.withColumn("kind", base_url_problem(F.col("base_url")))
    url = problem.where("kind is not null").select("kind", F.coalesce("base_url", F.lit("")).alias("detail"))
    again = lambda key: F.row_number().over(W.partitionBy(key).orderBy("pos"))
    ids = sites.where(known).withColumn("k", again("id")).where("k > 1").select(*row("DUPLICATE_SITE_ID", F.col("id")))
    sound = problem.where("kind is null").withColumn("key", urls.normalised(F.col("base_url")))
    bases = sound.withColumn("k", again("key")).where("k > 1").select(*row("DUPLICATE_BASE_URL", F.col("base_url")))
    return none.unionByName(ids).unionByName(bases).unionByName(bad_id).unionByName(platform).unionByName(url)

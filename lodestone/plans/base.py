"""Registry of queries with their DuckDB SQL, and the views that both are defined over."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
IMAGE = "struct<url:string,alt_text:string,caption:string>"


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark, sf_dir):
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def values(spark: SparkSession, rows: str, names: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t({names})")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts made of documents and labels."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.selectExpr(
        "doc_id", "source AS site_id", "concat(source, ':', doc_id) AS post_id", "array_join(slice(split(text, ' '), 1, 8), ' ') AS title", "text AS body",
        "CASE WHEN quality = 0 THEN 'SUMMARY' ELSE 'FULL' END AS completeness", "array(lang) AS tags", "concat('https://', source, '.example.org/', doc_id, '/') AS url",
        f"cast(array() AS array<{IMAGE}>) AS images", "timestamp_seconds(1704067200 + doc_id * 3600) AS published_at", "timestamp_seconds(1704067200 + doc_id * 3600 + n_chars) AS updated_at",
    )


P = """p AS (
  SELECT d.doc_id, d.source AS site_id, d.source || ':' || d.doc_id AS post_id, array_to_string(string_split(text, ' ')[1:8], ' ') AS title, text AS body,
    CASE WHEN quality = 0 THEN 'SUMMARY' ELSE 'FULL' END AS completeness, [lang] AS tags, 'https://' || source || '.example.org/' || d.doc_id || '/' AS url,
    []::STRUCT(url VARCHAR, alt_text VARCHAR, caption VARCHAR)[] AS images,
    TIMESTAMP '2024-01-01' + to_hours(d.doc_id) AS published_at, TIMESTAMP '2024-01-01' + to_hours(d.doc_id) + to_seconds(n_chars) AS updated_at
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

# Two states of the catalogue: every post is in one of them at least, and each aspect changes in some posts of the newer.
_CHANGES = {
    "title": "CASE WHEN doc_id % 17 = 0 THEN concat(title, ' (2)') ELSE title END",
    "body": "CASE WHEN doc_id % 11 = 0 THEN concat(body, '!') ELSE body END",
    "completeness": "CASE WHEN doc_id % 23 = 0 THEN CASE WHEN completeness = 'FULL' THEN 'SUMMARY' ELSE 'FULL' END ELSE completeness END",
    "url": "CASE WHEN doc_id % 29 = 0 THEN concat(url, 'x') WHEN doc_id % 43 = 0 THEN replace(url, 'https://', 'HTTPS://') ELSE url END",
}


def states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The newer and the older state."""
    p = posts(spark, sf_dir)
    new = p.where("doc_id % 7 <> 0 OR doc_id % 5 = 0").withColumns(
        {k: F.expr(v) for k, v in _CHANGES.items()}
        | {
            "tags": F.expr("CASE WHEN doc_id % 13 = 0 THEN array('new') WHEN doc_id % 41 = 0 THEN array(tags[0], upper(tags[0])) ELSE tags END"),
            "images": F.expr("CASE WHEN doc_id % 37 = 0 THEN array(named_struct('url', concat(url, 'a.png'), 'alt_text', 'a', 'caption', '')) ELSE images END"),
            "published_at": F.expr("published_at + CASE WHEN doc_id % 31 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END"),
            "updated_at": F.expr("updated_at + CASE WHEN doc_id % 19 = 0 THEN INTERVAL -1 HOUR WHEN doc_id % 3 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END"),
        }
    )
    return new, p.where("doc_id % 5 <> 0")


STATES = f"""{P},
o AS (SELECT * FROM p WHERE doc_id % 5 <> 0),
n AS (
  SELECT doc_id, site_id, post_id, {", ".join(f"{v} AS {k}" for k, v in _CHANGES.items())},
    CASE WHEN doc_id % 13 = 0 THEN ['new'] WHEN doc_id % 41 = 0 THEN [tags[1], upper(tags[1])] ELSE tags END AS tags,
    CASE WHEN doc_id % 37 = 0 THEN [{{'url': url || 'a.png', 'alt_text': 'a', 'caption': ''}}] ELSE images END AS images,
    published_at + CASE WHEN doc_id % 31 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS published_at,
    updated_at + CASE WHEN doc_id % 19 = 0 THEN -INTERVAL 1 HOUR WHEN doc_id % 3 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS updated_at
  FROM p WHERE doc_id % 7 <> 0 OR doc_id % 5 = 0)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index entries made of embeddings, some without a vector and some with a value that is no number."""
    return read(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "concat('v:', lpad(cast(vec_id % 100 AS string), 3, '0')) AS post_id", "floor(vec_id / 100) AS idx", "CASE WHEN vec_id % 7 = 0 THEN 'IMAGE' ELSE 'CHUNK' END AS kind",
        "CASE WHEN vec_id % 53 = 0 THEN NULL WHEN vec_id % 59 = 0 THEN concat(array(float('NaN')), slice(embedding, 2, 63)) ELSE embedding END AS embedding",
    )


def entry_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts of those entries; ten posts share each time."""
    return entries(spark, sf_dir).select("post_id").distinct().selectExpr("post_id", "concat('src', cast(substr(post_id, 3) AS int) % 10) AS site_id", "timestamp_seconds(1704067200 + floor(cast(substr(post_id, 3) AS int) / 10) * 86400) AS published_at")


V = """v AS (
  SELECT vec_id, 'v:' || lpad((vec_id % 100)::VARCHAR, 3, '0') AS post_id, vec_id // 100 AS idx, CASE WHEN vec_id % 7 = 0 THEN 'IMAGE' ELSE 'CHUNK' END AS kind,
    'src' || (vec_id % 10) AS site_id, TIMESTAMP '2024-01-01' + to_days((vec_id % 100 // 10)::INT) AS published_at,
    CASE WHEN vec_id % 53 = 0 OR vec_id % 59 = 0 THEN NULL ELSE embedding::DOUBLE[] END AS e
  FROM embeddings)"""


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the events, arriving out of order."""
    return read(spark, sf_dir, "events").selectExpr(
        "user_id AS key", "(event_id % 97) * 100000000000 + event_id AS arrival", "ts AS updated_at", "event_type AS content",
        "CASE event_type WHEN 'error' THEN 'MALFORMED' WHEN 'signup' THEN 'NOT_PUBLIC' ELSE 'AVAILABLE' END AS kind",
    )


FEED = """f AS (
  SELECT user_id AS key, (event_id % 97) * 100000000000 + event_id AS arrival, ts AS updated_at, event_type AS content,
    CASE event_type WHEN 'error' THEN 'MALFORMED' WHEN 'signup' THEN 'NOT_PUBLIC' ELSE 'AVAILABLE' END AS kind
  FROM events)"""

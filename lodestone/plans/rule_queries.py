"""Queries of image, network, configuration and validation rules."""
from pyspark.sql import functions as F

from lodestone.functions import images as I, text as X, urls as U, vectors as V
from lodestone.operators import config, posts as M
from lodestone.plans.base import entries, query, read, values

GRID = "SELECT a * 37 AS w, b * 41 AS h FROM range(1, 120) x(a), range(1, 120) y(b)"


def grid(s):
    return s.range(119 * 119).selectExpr("(floor(id / 119) + 1) * 37 AS w", "(id % 119 + 1) * 41 AS h")


query("img_size_rules", f"WITH g AS ({GRID}) SELECT w, h, CASE WHEN w * h > 16777216 THEN 'TOO_LARGE' WHEN least(w, h) < 64 THEN 'TOO_SMALL' ELSE 'OK' END AS verdict FROM g")(
    lambda s, d: grid(s).select("w", "h", I.decoded_size(F.col("w"), F.col("h")).alias("verdict"))
)
query(
    "img_raster_rules",
    f"""WITH g AS (SELECT w - 400 AS w, h - 400 AS h, CASE WHEN w % 2 = 0 THEN (w - 400) * (h - 400) * 3 ELSE w END AS n FROM ({GRID}))
SELECT w, h, CASE WHEN w <= 0 OR h <= 0 THEN 'NON_POSITIVE_DIMENSION' WHEN w * h > 16777216 THEN 'TOO_MANY_PIXELS' WHEN n <> 3 * w * h THEN 'DATA_LENGTH_MISMATCH' ELSE 'OK' END AS verdict FROM g""",
)(lambda s, d: grid(s).selectExpr("w - 400 AS w", "h - 400 AS h", "CASE WHEN w % 2 = 0 THEN (w - 400) * (h - 400) * 3 ELSE w END AS n").select("w", "h", I.raster(F.col("w"), F.col("h"), F.col("n")).alias("verdict")))
_TARGET = f"""g AS (SELECT w, h FROM ({GRID}) UNION ALL VALUES (1024, 768), (1, 1), (4000, 100), (10000, 10), (10, 10000)),
f AS (SELECT w, h, sqrt(645120::DOUBLE / (w::DOUBLE * h)) AS f FROM g),
s AS (SELECT w, h, (floor(f * w / 48) * 48)::INT AS sw, (floor(f * h / 48) * 48)::INT AS sh FROM f),
t AS (SELECT w, h, CASE WHEN sw = 0 THEN 48 WHEN sh = 0 THEN least(w // h * 48, 13440) ELSE sw END::INT AS width, CASE WHEN sw = 0 THEN least(h // w * 48, 13440) WHEN sh = 0 THEN 48 ELSE sh END::INT AS height FROM s)"""


def targets(s):
    more = values(s, "(1024L, 768L), (1L, 1L), (4000L, 100L), (10000L, 10L), (10L, 10000L)", "w, h")
    return grid(s).unionByName(more).select("w", "h", I.target_size(F.col("w"), F.col("h")).alias("t")).select("w", "h", "t.*")


query("img_target_size", f"WITH {_TARGET} SELECT w, h, width, height FROM t")(lambda s, d: targets(s))
query("img_patch_grid", f"WITH {_TARGET} SELECT w, h, ((width // 16) * (height // 16))::INT AS patches, ((width // 48) * (height // 48))::INT AS tokens FROM t")(
    lambda s, d: targets(s).select("w", "h", I.patch_grid(F.col("width"), F.col("height")).alias("g")).select("w", "h", "g.*")
)
query("img_input_ids", "SELECT n, (n + 4)::INT AS n_ids, 2 + 255999 + 258882 + 1 + 258880 * n AS total, 258882 AS second_last FROM range(0, 300) t(n)")(
    lambda s, d: s.range(300).select(F.col("id").alias("n"), I.input_ids(F.col("id").cast("int")).alias("ids")).select("n", F.size("ids").alias("n_ids"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.element_at("ids", -2).alias("second_last"))
)
_SRCSETS = "(1, 'a.png 300w, b.png 900w, c.png 4000w'), (2, 'a.png 900w, b.png 900w'), (3, 'a.png 2x, b.png'), (4, ''), (5, 'a.png 2048w,b.png 2049w'), (6, ', a,b.png 10w ,c.png 9w')"
query("img_srcset", "SELECT * FROM (VALUES (1, 'b.png'), (2, 'a.png'), (3, NULL), (4, NULL), (5, 'a.png'), (6, 'a,b.png')) t(id, url)")(lambda s, d: values(s, _SRCSETS, "id, srcset").select("id", I.srcset_choice(F.col("srcset")).alias("url")))
_EXCLUDED = "(1, 'a emoji', '', '', 'https://h/a'), (2, 'emojis', '63', '', 'https://h/a'), (3, '', '64', ' 12 ', 'https://h/a'), (4, '', '10%', '5em', 'https://h/a'), (5, '', '', '', 'http://h/a'), (6, '', '', '', NULL), (7, 'wp-smiley', '1', '1', 'http://h')"
query("img_exclusion", "SELECT * FROM (VALUES (1, 'EMOJI'), (2, 'TOO_SMALL'), (3, 'TOO_SMALL'), (4, 'KEPT'), (5, 'NOT_HTTPS'), (6, 'NOT_HTTPS'), (7, 'EMOJI')) t(id, rule)")(
    lambda s, d: values(s, _EXCLUDED, "id, classes, width, height, url").select("id", I.exclusion(F.col("classes"), F.col("width"), F.col("height"), F.col("url")).alias("rule"))
)


@query("img_patchify_sum")
def img_patchify_sum(s, d):
    from lodestone.sources import image_files

    rows = s.range(6).select(F.lit(96).alias("width"), (F.lit(48) + F.col("id").cast("int") * 16).alias("height"), F.col("id"))
    rows = rows.withColumn("data", F.unhex(F.repeat(F.lpad(F.hex(F.col("id") * 20 + 10), 2, "0"), (F.col("width") * F.col("height") * 3).cast("int"))))
    return image_files.patches(rows).select("id", F.col("target.width").alias("width"), F.col("target.height").alias("height"), F.col("cut.real").alias("real"), F.length("cut.patches").alias("bytes"))


query("http_status_class", "SELECT c AS status, CASE WHEN c BETWEEN 200 AND 299 THEN 'SUCCESS' WHEN c BETWEEN 300 AND 399 AND c % 2 = 0 THEN 'REDIRECT' WHEN c IN (408, 429) OR c >= 500 THEN 'TRANSIENT' ELSE 'PERMANENT' END AS class FROM range(100, 600) t(c)")(
    lambda s, d: s.range(100, 600).select(F.col("id").alias("status"), I.status_class(F.col("id"), F.when(F.col("id") % 2 == 0, "x")).alias("class"))
)
_HEADERS = "(1, 'image/PNG; q=1', 10L), (2, 'text/html', 99999999L), (3, 'image/gif', 10485761L), (4, 'image/jpeg', 10485760L), (5, NULL, 1L), (6, ' image/gif ', NULL)"
query("http_header_refusal", "SELECT * FROM (VALUES (1, 'OK'), (2, 'UNSUPPORTED_TYPE'), (3, 'TOO_LARGE'), (4, 'OK'), (5, 'UNSUPPORTED_TYPE'), (6, 'OK')) t(id, verdict)")(
    lambda s, d: values(s, _HEADERS, "id, type, length").select("id", I.header_refusal(F.col("type"), F.col("length")).alias("verdict"))
)
query(
    "net_address_category",
    """WITH a AS (SELECT i AS id, (i * 2654435761) % 4294967296 AS n FROM range(0, 40000) t(i) UNION ALL SELECT * FROM (VALUES (-1, 2130706433), (-2, 0), (-3, 167772161), (-4, 2886729729), (-5, 3232235521), (-6, 1681915905), (-7, 2851995649)) u)
SELECT id, CASE WHEN n >> 24 = 127 THEN 'LOOPBACK' WHEN n >> 16 = 43518 OR n = 0 OR n >> 28 = 14 THEN 'NON_ROUTABLE'
  WHEN n >> 24 = 10 OR n >> 20 = 2753 OR n >> 16 = 49320 OR n >> 22 = 401 THEN 'PRIVATE_NETWORK' ELSE 'PUBLIC' END AS category FROM a""",
)(
    lambda s, d: s.range(40000).selectExpr("id", "(id * 2654435761) % 4294967296 AS n").unionByName(values(s, "(-1L, 2130706433L), (-2L, 0L), (-3L, 167772161L), (-4L, 2886729729L), (-5L, 3232235521L), (-6L, 1681915905L), (-7L, 2851995649L)", "id, n"))
    .selectExpr("id", "concat_ws('.', shiftright(n, 24), shiftright(n, 16) & 255, shiftright(n, 8) & 255, n & 255) AS a").select("id", I.ipv4_category(F.col("a")).alias("category"))
)
_V6 = "(1, '::1', 'LOOPBACK'), (2, 'fe80::1', 'NON_ROUTABLE'), (3, 'fd00::5', 'PRIVATE_NETWORK'), (4, '2001:db8::1', 'PUBLIC'), (5, 'ff02::1', 'NON_ROUTABLE'), (6, '::', 'NON_ROUTABLE'), (7, '10.1.2.3', 'PRIVATE_NETWORK')"
query("net_address_category_v6", f"SELECT id, want AS category FROM (VALUES {_V6}) t(id, a, want)")(lambda s, d: values(s, _V6, "id, a, want").select("id", I.address_category(F.col("a")).alias("category")))
_SETS = "(1, array('PUBLIC')), (2, array('PRIVATE_NETWORK', 'LOOPBACK')), (3, array('NON_ROUTABLE', 'LOOPBACK')), (4, array('LOOPBACK', 'LOOPBACK')), (5, cast(array() AS array<string>))"
query("net_permitted", "SELECT * FROM (VALUES (1, 'PUBLIC', false), (2, 'PRIVATE_NETWORK,PUBLIC', true), (3, 'PUBLIC', false), (4, 'LOOPBACK,PRIVATE_NETWORK,PUBLIC', true), (5, '', false)) t(id, permitted, private_too)")(
    lambda s, d: values(s, _SETS, "id, c").select("id", I.permitted(F.col("c")).alias("p")).select("id", F.array_join("p", ",").alias("permitted"), I.permits_all(F.col("p"), F.array(F.lit("PUBLIC"), F.lit("PRIVATE_NETWORK"))).alias("private_too"))
)

_SITES = "(0, 'a', 'WordPress', 'https://a.example'), (1, 'A b', 'blogger', 'https://b.example/'), (2, 'a', 'joomla', 'http://c.example'), (3, 'a', 'BLOGGER', 'https://A.example:443/'), (4, 'd', 'wordpress', 'https://d.example/?q=1'), (5, 'e', 'wordpress', NULL), (6, 'A b', 'blogger', 'https://e.example/x')"
query(
    "cfg_site_rules",
    """SELECT * FROM (VALUES ('DUPLICATE_SITE_ID', 'a'), ('DUPLICATE_SITE_ID', 'a'), ('DUPLICATE_BASE_URL', 'https://A.example:443/'), ('INVALID_SITE_ID', 'A b'), ('INVALID_SITE_ID', 'A b'),
  ('UNSUPPORTED_PLATFORM', 'joomla'), ('BASE_URL_NOT_ABSOLUTE_HTTPS', 'http://c.example'), ('BASE_URL_HAS_QUERY_OR_FRAGMENT', 'https://d.example/?q=1'), ('BASE_URL_NOT_ABSOLUTE_HTTPS', '')) t(kind, detail)""",
)(lambda s, d: config.violations(values(s, _SITES, "pos, id, platform, base_url")))
query("cfg_duplicates", "SELECT source AS id, (count(*) - 1)::BIGINT AS repeats FROM documents GROUP BY source HAVING count(*) > 1")(
    lambda s, d: config.violations(read(s, d, "documents").selectExpr("doc_id AS pos", "source AS id", "'blogger' AS platform", "concat('https://h/', doc_id) AS base_url")).where("kind = 'DUPLICATE_SITE_ID'").groupBy(F.col("detail").alias("id")).agg(F.count("*").alias("repeats"))
)
query("cfg_scan", "SELECT * FROM (VALUES (0, 'a', 'BLOGGER', 'https://a.example'), (1, 'b', NULL, 'https://b.example')) t(pos, id, platform, base_url)")(
    lambda s, d: config.definitions(values(s, """('{"syncEveryHours": 12, "sites": [{"id": "a", "platform": "BLOGGER", "baseUrl": "https://a.example"}, {"id": "b", "baseUrl": "https://b.example"}]}')""", "json"))
)
_HOURS = "(1, NULL), (2, '24'), (3, '0'), (4, '-5'), (5, '1.5'), (6, 'soon'), (7, '1')"
query("cfg_interval", "SELECT * FROM (VALUES (1, NULL), (2, NULL), (3, 'INVALID_SYNC_INTERVAL'), (4, 'INVALID_SYNC_INTERVAL'), (5, 'INVALID_SYNC_INTERVAL'), (6, 'INVALID_SYNC_INTERVAL'), (7, NULL)) t(id, problem)")(
    lambda s, d: values(s, _HOURS, "id, v").select("id", config.interval_problem(F.col("v")).alias("problem"))
)
query("flt_id_syntax", "SELECT doc_id, doc_id % 6 IN (0, 4) AS sound FROM documents")(
    lambda s, d: read(s, d, "documents").selectExpr("doc_id", "CASE doc_id % 6 WHEN 0 THEN concat(source, ':', doc_id, ':b') WHEN 1 THEN source WHEN 2 THEN concat(source, ':  ') WHEN 3 THEN concat('UP:', doc_id) WHEN 4 THEN concat(source, ':', text, 'x') ELSE concat(repeat('a', 41), ':', doc_id) END AS id")
    .select("doc_id", (F.regexp_extract("id", U.POST_ID, 1).rlike(U.SITE_ID) & ~F.regexp_extract("id", U.POST_ID, 2).rlike(r"^\s*$")).alias("sound"))
)
query(
    "vec_validity",
    "SELECT vec_id, vec_id % 11 NOT IN (1, 2, 3, 4, 5) AS valid FROM embeddings",
)(
    lambda s, d: read(s, d, "embeddings").selectExpr("vec_id", "CASE vec_id % 11 WHEN 1 THEN concat(array(float('NaN')), slice(embedding, 2, 63)) WHEN 2 THEN concat(array(float('Infinity')), slice(embedding, 2, 63)) WHEN 3 THEN slice(embedding, 1, 63) WHEN 4 THEN array_repeat(float(0), 64) WHEN 5 THEN NULL ELSE embedding END AS e")
    .select("vec_id", V.valid(F.col("e"), 64).alias("valid"))
)
query(
    "vec_normalise",
    """WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE * 3) AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda v: v * v))) AS n FROM x)
SELECT vec_id, round(list_sum(list_transform(e, lambda v: (v / n)::FLOAT::DOUBLE)), 5) AS total, round(e[1] / n, 5) AS first FROM n""",
)(lambda s, d: read(s, d, "embeddings").select("vec_id", V.normalised(F.transform(F.col("embedding").cast("array<double>"), lambda v: v * 3)).alias("e")).select("vec_id", F.round(F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"), F.round(F.col("e")[0].cast("double"), 5).alias("first")))
query("vec_similarity", "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE b.vec_id = 0")(
    lambda s, d: read(s, d, "embeddings").join(F.broadcast(read(s, d, "embeddings").where("vec_id = 0").selectExpr("embedding AS q", "1 AS one")), F.col("one") == 1).select("vec_id", F.round(V.dot(F.col("embedding"), F.col("q")), 6).alias("score"))
)
query("vec_codec", "SELECT vec_id, 344 AS chars, true AS same FROM embeddings")(
    lambda s, d: read(s, d, "embeddings").withColumn("t", V.encoded("embedding")).select("vec_id", F.length("t").alias("chars"), (V.decoded("t") == F.col("embedding")).alias("same"))
)
query("mth_clamp", "SELECT i AS id, least(20, greatest(1, i - 30))::INT AS k FROM range(0, 100) t(i)")(lambda s, d: s.range(100).select("id", F.least(F.lit(20), F.greatest(F.lit(1), F.col("id") - 30)).cast("int").alias("k")))

_TOTALS = "(0, NULL), (1, 'abc'), (2, ' 7 '), (3, '-3'), (4, '250'), (5, '99999999999')"
query(
    "sync_paging",
    """WITH t(k, total, n) AS (VALUES (0, NULL, NULL), (1, 'abc', NULL), (2, ' 7 ', 7), (3, '-3', 0), (4, '250', 250), (5, '99999999999', NULL)), g AS (SELECT k, n, r.i AS reached, 98 + c.i AS received, b.i = 1 AS ends FROM t, range(0, 10) r(i), range(0, 4) c(i), range(0, 2) b(i))
SELECT k, reached, received, ends, (CASE WHEN n IS NOT NULL THEN reached < n ELSE received >= 100 END) AND (NOT ends OR received >= 100) AS more FROM g""",
)(
    lambda s, d: s.range(80).selectExpr("floor(id / 8) AS reached", "98 + floor(id / 2) % 4 AS received", "id % 2 = 1 AS ends").crossJoin(values(s, _TOTALS, "k, total"))
    .select("k", "reached", "received", "ends", M.has_more(F.col("total"), F.lit(100), F.col("reached"), F.col("received"), F.col("ends")).alias("more"))
)

"""Queries of row mappers, synchronisation, checkpoints and the change feed."""
import uuid

from pyspark.sql import functions as F

from lodestone.operators import posts as M, sync as Y
from lodestone.plans.base import FEED, STATES, P, feed, posts, query, read, states, values
from lodestone.storage import shared_dir
from lodestone.streaming import feed as stream

_DIFF = """x AS (
  SELECT n.post_id, n.site_id, o.post_id IS NOT NULL AS known, n.updated_at AS nu, o.updated_at AS ou, list_filter([
    CASE WHEN n.title IS DISTINCT FROM o.title THEN 'TITLE' END, CASE WHEN n.body IS DISTINCT FROM o.body THEN 'BODY' END,
    CASE WHEN n.completeness IS DISTINCT FROM o.completeness THEN 'COMPLETENESS' END,
    CASE WHEN list_sort(list_distinct(list_transform(n.tags, lambda t: lower(t)))) IS DISTINCT FROM list_sort(list_distinct(list_transform(o.tags, lambda t: lower(t)))) THEN 'TAGS' END,
    CASE WHEN lower(n.url) IS DISTINCT FROM lower(o.url) THEN 'URL' END, CASE WHEN n.published_at IS DISTINCT FROM o.published_at THEN 'PUBLISHED_AT' END,
    CASE WHEN len(n.images) > 0 THEN 'IMAGES' END], lambda c: c IS NOT NULL) AS diff
  FROM n LEFT JOIN o ON n.post_id = o.post_id),
r AS (SELECT *, CASE WHEN NOT known THEN 'PUBLISHED' WHEN nu < ou THEN 'STALE' WHEN len(diff) > 0 THEN 'CHANGED' WHEN nu > ou THEN 'TOUCHED' ELSE 'UNCHANGED' END AS revision FROM x)"""
query("sync_classify", f"WITH {STATES}, {_DIFF} SELECT post_id, revision FROM r")(lambda s, d: Y.classify(*states(s, d)).select("post_id", "revision"))
query("sync_changed_aspects", f"WITH {STATES}, {_DIFF} SELECT post_id, array_to_string(diff, ',') AS changed FROM r WHERE revision = 'CHANGED'")(
    lambda s, d: Y.classify(*states(s, d)).where("revision = 'CHANGED'").select("post_id", F.array_join("changed", ",").alias("changed"))
)
query(
    "sync_report",
    f"""WITH {STATES}, {_DIFF} SELECT site_id, count(*) FILTER (revision = 'PUBLISHED') AS published, count(*) FILTER (revision = 'CHANGED') AS revised,
  count(*) FILTER (revision IN ('STALE', 'TOUCHED', 'UNCHANGED')) AS unchanged, 0::BIGINT AS withdrawn, 0::BIGINT AS skipped FROM r GROUP BY site_id""",
)(lambda s, d: Y.report(Y.classify(*states(s, d)).withColumn("site_id", F.substring_index("post_id", ":", 1))))
_FOLD = f"""{FEED},
l AS (SELECT *, count(*) FILTER (kind = 'NOT_PUBLIC') OVER (PARTITION BY key ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS life FROM f),
h AS (SELECT *, max(updated_at) FILTER (kind = 'AVAILABLE') OVER w AS last_at, arg_max(content, {{'u': updated_at, 'a': arrival}}) FILTER (kind = 'AVAILABLE') OVER w AS held
  FROM l WINDOW w AS (PARTITION BY key, life ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT key, arrival, CASE WHEN kind = 'MALFORMED' THEN 'SKIPPED' WHEN kind = 'NOT_PUBLIC' THEN CASE WHEN last_at IS NULL THEN 'SKIPPED' ELSE 'WITHDRAWN' END WHEN last_at IS NULL THEN 'PUBLISHED'
  WHEN updated_at < last_at THEN 'STALE' WHEN content <> held THEN 'CHANGED' WHEN updated_at > last_at THEN 'TOUCHED' ELSE 'UNCHANGED' END AS revision FROM h)"""
query("sync_fold", f"WITH {_FOLD} SELECT key, arrival, revision FROM r")(lambda s, d: Y.fold(feed(s, d)))
query("sync_feed_report", f"WITH {_FOLD} SELECT key % 7 AS site_id, {', '.join(f'''count(*) FILTER (revision IN ({k})) AS {n}''' for n, k in (('published', "'PUBLISHED'"), ('revised', "'CHANGED'"), ('unchanged', "'UNCHANGED', 'TOUCHED', 'STALE'"), ('withdrawn', "'WITHDRAWN'"), ('skipped', "'SKIPPED'")))} FROM r GROUP BY 1")(
    lambda s, d: Y.report(Y.fold(feed(s, d)).withColumn("site_id", F.col("key") % 7))
)
query("sync_withdraw_unlisted", f"WITH {STATES} SELECT o.post_id FROM o WHERE o.post_id NOT IN (SELECT post_id FROM n)")(lambda s, d: Y.unlisted(states(s, d)[1].select("post_id"), states(s, d)[0].select("post_id")))


@query(
    "sync_withdraw_guarded",
    f"""WITH {STATES}, c AS (SELECT count(*) AS lost FROM o WHERE o.post_id NOT IN (SELECT post_id FROM n))
SELECT 'empty' AS listing, 'EMPTY_LISTING_WITHDRAWALS_SUPPRESSED' AS verdict, 0::BIGINT AS withdrawn UNION ALL
SELECT 'unreadable', 'UNIDENTIFIED_MALFORMED_ENTRY_WITHDRAWALS_SUPPRESSED', 0 UNION ALL SELECT 'whole', 'WITHDRAW', lost FROM c""",
)
def sync_withdraw_guarded(s, d):
    new, old = states(s, d)
    listed, stored, out = new.select("post_id"), old.select("post_id"), None
    for name, rows in (("empty", listed.where("1 = 0")), ("unreadable", listed.unionByName(values(s, "(cast(NULL AS string))", "post_id"))), ("whole", listed)):
        n = Y.unlisted(stored, rows).agg(F.count("*").alias("withdrawn"), F.lit(1).alias("one"))
        got = Y.verdict(rows).withColumn("one", F.lit(1)).join(F.broadcast(n), "one").select(F.lit(name).alias("listing"), "verdict", "withdrawn")
        out = got if out is None else out.unionByName(got)
    return out


query("sync_site_removed", f"WITH {P} SELECT post_id, 'SITE_REMOVED' AS reason FROM p WHERE site_id LIKE 'src1%'")(lambda s, d: Y.site_removed(posts(s, d), posts(s, d).where("site_id NOT LIKE 'src1%'").select("site_id").distinct()))
query(
    "sync_not_public",
    """WITH s AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND user_id % 3 > 0), e AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup')
SELECT 'u:' || e.user_id AS post_id, CASE WHEN s.user_id IS NULL THEN 'SKIPPED' ELSE 'NO_LONGER_PUBLIC' END AS outcome FROM e LEFT JOIN s ON e.user_id = s.user_id""",
)(lambda s, d: Y.not_public(feed(s, d).selectExpr("kind", "concat('u:', key) AS post_id"), read(s, d, "events").where("event_type = 'purchase' AND user_id % 3 > 0").selectExpr("concat('u:', user_id) AS post_id").distinct()))
query(
    "sync_duplicate_url",
    """WITH a AS (SELECT doc_id, source || ':' || doc_id AS post_id, 'https://shared.example.org/' || (doc_id // 3) AS url FROM documents)
SELECT x.post_id, min(y.post_id) AS owner FROM a x JOIN a y ON x.url = y.url AND x.post_id <> y.post_id AND y.doc_id % 2 = 0 WHERE x.doc_id % 5 <> 1 GROUP BY x.post_id""",
)(
    lambda s, d: Y.duplicate_urls(
        posts(s, d).selectExpr("post_id", "CASE WHEN doc_id % 5 = 1 THEN concat('https://other.example.org/', floor(doc_id / 3)) ELSE concat('https://Shared.example.org:443/', floor(doc_id / 3), '/') END AS url"),
        posts(s, d).where("doc_id % 2 = 0").selectExpr("post_id", "concat('https://shared.example.org/', floor(doc_id / 3), '#x') AS url"), F.lit("SHARED.example.org"),
    )
)
query("sync_checkpoint_by_page", "WITH m AS (SELECT event_id // 100 AS page, max(ts) AS m FROM events GROUP BY 1) SELECT page, max(m) OVER (ORDER BY page) AS mark FROM m")(
    lambda s, d: Y.high_water(read(s, d, "events").selectExpr("floor(event_id / 100) AS page", "ts"))
)
query("sync_high_water", "SELECT user_id % 5 AS site, max(CASE WHEN event_id % 10 > 0 THEN ts END) AS mark FROM events GROUP BY 1")(
    lambda s, d: read(s, d, "events").groupBy((F.col("user_id") % 5).alias("site")).agg(F.max(F.expr("CASE WHEN event_id % 10 > 0 THEN ts END")).alias("mark"))
)
_PAGES = """g AS (SELECT user_id % 6 AS site_id, CASE WHEN user_id % 2 = 0 THEN 'OLDEST_FIRST' ELSE 'NEWEST_FIRST' END AS change_order, event_id // 100 AS page, max(ts) AS mark FROM events GROUP BY 1, 2, 3),
q AS (SELECT *, page = max(page) OVER (PARTITION BY site_id) AS last_page, site_id >= 2 AND page = 5 + site_id AS failed FROM g)"""
def _pages(s, d):
    from pyspark.sql import Window as W

    g = read(s, d, "events").groupBy(F.expr("user_id % 6 AS site_id"), F.expr("CASE WHEN user_id % 2 = 0 THEN 'OLDEST_FIRST' ELSE 'NEWEST_FIRST' END AS change_order"), F.expr("floor(event_id / 100) AS page")).agg(F.max("ts").alias("mark"))
    return g.withColumn("last_page", F.col("page") == F.max("page").over(W.partitionBy("site_id"))).withColumn("failed", F.expr("site_id >= 2 AND page = 5 + site_id"))


query("sync_checkpoint_after_run", f"""WITH {_PAGES}, z AS (SELECT site_id, min(page) FILTER (failed) AS stop FROM q GROUP BY 1)
SELECT q.site_id, max(mark) FILTER ((stop IS NULL OR page < stop) AND (change_order = 'OLDEST_FIRST' OR stop IS NULL)) AS mark FROM q JOIN z ON q.site_id = z.site_id GROUP BY q.site_id""")(lambda s, d: Y.checkpoint(_pages(s, d)))
_MARKS = """m AS (SELECT user_id, CASE WHEN user_id % 9 > 0 THEN max(ts) END AS seen, CASE WHEN user_id % 7 > 0 THEN max(ts) - to_hours(user_id % 49) END AS reconciled, max(ts) AS now FROM events GROUP BY user_id)"""


def _marks(s, d):
    m = read(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("now"))
    return m.selectExpr("user_id", "CASE WHEN user_id % 9 > 0 THEN now END AS seen", "CASE WHEN user_id % 7 > 0 THEN now - make_interval(0, 0, 0, 0, cast(user_id % 49 AS int)) END AS reconciled", "now")


query("sync_changes_since", f"WITH {_MARKS} SELECT user_id, seen - INTERVAL 1 HOUR AS since FROM m")(lambda s, d: _marks(s, d).select("user_id", Y.changes_since(F.col("seen")).alias("since")))
query("sync_advance", f"WITH {_MARKS} SELECT user_id, greatest(seen, reconciled) AS mark FROM m")(lambda s, d: _marks(s, d).select("user_id", Y.advance(F.col("seen"), F.col("reconciled")).alias("mark")))
query("sync_reconcile_due", f"WITH {_MARKS} SELECT user_id, reconciled IS NULL OR reconciled < now - INTERVAL 24 HOUR AS due FROM m")(lambda s, d: _marks(s, d).select("user_id", Y.reconcile_due(F.col("reconciled"), F.col("now")).alias("due")))
query(
    "sync_modes",
    f"""WITH {_MARKS}, t AS (SELECT max(now) AS now FROM m), n AS (SELECT m.user_id AS site_id, reconciled FROM m WHERE user_id % 4 > 0)
SELECT u.user_id AS site_id, CASE WHEN n.reconciled IS NULL OR n.reconciled < TIMESTAMP '2024-01-02' THEN 'RECONCILE' ELSE 'INCREMENTAL' END AS mode FROM m u LEFT JOIN n ON u.user_id = n.site_id""",
)(
    lambda s, d: Y.site_modes(_marks(s, d).selectExpr("user_id AS site_id"), _marks(s, d).where("user_id % 4 > 0").selectExpr("user_id AS site_id", "reconciled AS last_reconciled_at"), "INCREMENTAL", F.expr("TIMESTAMP_NTZ '2024-01-03 00:00:00'"))
)
query("sync_outcome", "SELECT p AS pages, f AS failed, r AS running, CASE WHEN r THEN 'SKIPPED' WHEN NOT f THEN 'COMPLETED' WHEN p > 0 THEN 'PARTIAL' ELSE 'FAILED' END AS outcome FROM range(0, 3) a(p), (VALUES (true), (false)) b(f), (VALUES (true), (false)) c(r)")(
    lambda s, d: s.range(12).selectExpr("floor(id / 4) AS pages", "id % 2 = 0 AS failed", "floor(id / 2) % 2 = 0 AS running").select("*", Y.outcome(F.col("pages"), F.col("failed"), F.col("running")).alias("outcome"))
)
query("sync_mark_reconciled", "SELECT m AS mode, v AS verdict, CASE WHEN m = 'RECONCILE' AND v = 'WITHDRAW' THEN 2 ELSE 1 END AS at FROM (VALUES ('RECONCILE'), ('INCREMENTAL')) a(m), (VALUES ('WITHDRAW'), ('EMPTY_LISTING_WITHDRAWALS_SUPPRESSED')) b(v)")(
    lambda s, d: values(s, "('RECONCILE', 'WITHDRAW'), ('RECONCILE', 'EMPTY_LISTING_WITHDRAWALS_SUPPRESSED'), ('INCREMENTAL', 'WITHDRAW'), ('INCREMENTAL', 'EMPTY_LISTING_WITHDRAWALS_SUPPRESSED')", "mode, verdict").select("mode", "verdict", Y.reconciled_at(F.col("mode"), F.col("verdict"), F.lit(2), F.lit(1)).alias("at"))
)
query("sync_overlap_reread", f"WITH {STATES} SELECT 'CHANGED' AS revision, 0::BIGINT AS n")(
    # what a run read before and reads again changes nothing
    lambda s, d: Y.classify(states(s, d)[0], states(s, d)[0]).agg(F.lit("CHANGED").alias("revision"), F.count(F.when(F.col("revision") != "UNCHANGED", 1)).alias("n"))
)
query("map_snapshot_times", f"WITH {P} SELECT post_id, greatest(published_at, updated_at - to_hours(doc_id % 5)) AS updated_at FROM p")(
    lambda s, d: M.snapshot(posts(s, d).withColumn("updated_at", F.expr("updated_at - make_interval(0, 0, 0, 0, cast(doc_id % 5 AS int))"))).select("post_id", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))
)
query("map_times", "SELECT * FROM (VALUES (1, TIMESTAMP '2024-03-01 10:00:00', NULL), (2, NULL, TIMESTAMP '2024-03-01 00:00:00.5'), (3, NULL, NULL), (4, NULL, NULL), (5, NULL, NULL)) t(id, gmt, with_offset)")(
    lambda s, d: values(s, "(1, '2024-03-01T10:00:00'), (2, '2024-03-01T13:00:00.500+13:00'), (3, '2024-13-01T10:00:00'), (4, ''), (5, NULL)", "id, t").select("id", M.gmt(F.col("t")).cast("timestamp_ntz").alias("gmt"), M.offset_time(F.col("t")).cast("timestamp_ntz").alias("with_offset"))
)

_WP = r"""
('{"id": 7, "modified_gmt": "2024-02-01T10:00:00", "date_gmt": "2024-01-01T10:00:00", "status": "publish", "link": "https://h.example/7/", "title": {"rendered": "Seven"}, "content": {"rendered": "<p>Body <b>7</b></p><img src=a.png>"}, "tags": [2, 9, "x", 1, 2]}'),
('{"id": "b:8", "modified_gmt": "2024-02-01T10:00:00", "date_gmt": "2024-03-01T10:00:00", "link": "https://H.example/8", "title": {"rendered": "Eight"}}'),
('{"id": 1.5, "modified_gmt": "2024-02-02T10:00:00"}'), ('{"id": " ", "modified_gmt": "bad"}'), ('{"id": 9}'),
('{"id": 10, "modified_gmt": "2024-02-03T10:00:00", "status": "draft"}'), ('{"id": 11, "modified_gmt": "2024-02-03T10:00:00", "content": {"protected": true}}'),
('{"id": 12, "modified_gmt": "2024-02-03T10:00:00", "date_gmt": 5}'), ('{"id": 13, "modified_gmt": "2024-02-03T10:00:00", "date_gmt": "2024-01-01T10:00:00", "link": "http://h.example/13"}'),
('{"id": 14, "modified_gmt": "2024-02-03T10:00:00", "date_gmt": "2024-01-01T10:00:00", "link": "https://other.example/14"}')"""


def _numbered(s, rows):
    x = s.sql(f"SELECT posexplode(array({rows})) AS (pos, json)")
    return x.selectExpr("'s' AS site_id", "'h.example' AS site_host", "1 AS page", "pos", "json")


@query(
    "map_wordpress",
    """SELECT * FROM (VALUES (0, 'AVAILABLE', '7', NULL, 'Seven', 'Body 7', 'Java,spark', 'unknown tag id 9 was dropped;unknown tag id x was dropped', 'https://h.example/7/a.png', TIMESTAMP '2024-02-01 10:00:00'),
  (1, 'AVAILABLE', 'b:8', NULL, 'Eight', '', '', '', '', TIMESTAMP '2024-03-01 10:00:00'), (2, 'MALFORMED', NULL, 'missing or invalid id', NULL, NULL, NULL, NULL, NULL, TIMESTAMP '2024-02-02 10:00:00'),
  (3, 'MALFORMED', NULL, 'missing or invalid id', NULL, NULL, NULL, NULL, NULL, NULL), (4, 'MALFORMED', '9', 'missing or invalid modified_gmt', NULL, NULL, NULL, NULL, NULL, NULL),
  (5, 'NOT_PUBLIC', '10', NULL, NULL, NULL, NULL, NULL, NULL, TIMESTAMP '2024-02-03 10:00:00'), (6, 'NOT_PUBLIC', '11', NULL, NULL, NULL, NULL, NULL, NULL, TIMESTAMP '2024-02-03 10:00:00'),
  (7, 'MALFORMED', '12', 'missing or invalid date_gmt', NULL, NULL, NULL, NULL, NULL, TIMESTAMP '2024-02-03 10:00:00'),
  (8, 'MALFORMED', '13', 'Not an absolute https link: ''http://h.example/13''', NULL, NULL, NULL, NULL, NULL, TIMESTAMP '2024-02-03 10:00:00'),
  (9, 'MALFORMED', '14', 'Link https://other.example/14 is not on the site host h.example', NULL, NULL, NULL, NULL, NULL, TIMESTAMP '2024-02-03 10:00:00')) t(pos, kind, source_post_id, reason, title, body, tags, notes, images, updated_at)""",
)
def map_wordpress(s, d):
    names = values(s, "(1L, 'spark'), (2L, ' Java ')", "tag_id, name")
    x = M.map_wordpress(_numbered(s, ", ".join(r.strip().removeprefix("(").removesuffix(")") for r in _split(_WP))), names)
    return x.select("pos", "kind", "source_post_id", "reason", "title", "body", F.array_join("tags", ",").alias("tags"), F.array_join("notes", ";").alias("notes"), F.array_join(F.col("images.url"), ",").alias("images"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


def _split(rows: str) -> list[str]:
    """The quoted JSON rows of a list of VALUES."""
    import re

    return re.findall(r"\('.*?'\)", rows, re.S)


@query("map_tags_join", "SELECT doc_id, 't' || (doc_id % 5) || ',t' || ((doc_id + 1) % 5) AS tags, 1 AS notes FROM documents")
def map_tags_join(s, d):
    e = read(s, d, "documents").selectExpr("'s' AS site_id", "'h.example' AS site_host", "doc_id AS page", "0 AS pos", """concat('{"id": ', doc_id, ', "modified_gmt": "2024-02-01T10:00:00", "date_gmt": "2024-01-01T10:00:00", "link": "https://h.example/", "tags": [', doc_id % 5, ', 99, ', (doc_id + 1) % 5, ']}') AS json""")
    names = s.range(5).selectExpr("id AS tag_id", "concat('t', id) AS name")
    return M.map_wordpress(e, names).select(F.col("page").alias("doc_id"), F.array_join("tags", ",").alias("tags"), F.size("notes").alias("notes"))


_BL = r"""
('{"id": {"$t": "tag:blogger.com,1999:blog-1.post-42"}, "updated": {"$t": "2024-02-01T10:00:00.000+13:00"}, "published": {"$t": "2024-01-01T10:00:00Z"}, "title": {"type": "html", "$t": "A <b>title</b>"}, "content": {"$t": "<p>Full</p><img src=\'/i.png\'>"}, "category": [{"term": "x"}, {"term": " X "}, {"term": "y"}], "link": [{"rel": "self", "href": "https://no.example/"}, {"rel": "alternate", "href": "https://h.example/42"}]}'),
('{"id": {"$t": "blog-1.post-43"}, "updated": {"$t": "2024-02-01T10:00:00Z"}, "published": {"$t": "2024-01-01T10:00:00Z"}, "title": {"type": "text", "$t": "A <b>"}, "summary": {"$t": "Short<img src=/i.png>"}, "link": [{"rel": "alternate", "href": "https://h.example/43"}]}'),
('{"id": {"$t": "post-44x"}, "updated": {"$t": "2024-02-01T10:00:00Z"}}'), ('{"id": {"$t": "b.post-45"}, "updated": {"$t": "2024-02-01"}}'), ('{"id": {"$t": "b.post-46"}, "updated": {"$t": "2024-02-01T10:00:00Z"}}'),
('{"id": {"$t": "b.post-47"}, "updated": {"$t": "2024-02-01T10:00:00Z"}, "published": {"$t": "2024-01-01T10:00:00Z"}}')"""


@query(
    "map_blogger",
    """SELECT * FROM (VALUES (0, 'AVAILABLE', '42', NULL, 'A title', 'Full', 'FULL', 'x,y', 'https://h.example/i.png', TIMESTAMP '2024-01-31 21:00:00'), (1, 'AVAILABLE', '43', NULL, 'A <b>', 'Short', 'SUMMARY', '', '', TIMESTAMP '2024-02-01 10:00:00'),
  (2, 'MALFORMED', NULL, 'missing or invalid id', NULL, NULL, NULL, NULL, NULL, TIMESTAMP '2024-02-01 10:00:00'), (3, 'MALFORMED', '45', 'missing or invalid updated time', NULL, NULL, NULL, NULL, NULL, NULL),
  (4, 'MALFORMED', '46', 'missing or invalid published time', NULL, NULL, NULL, NULL, NULL, TIMESTAMP '2024-02-01 10:00:00'),
  (5, 'MALFORMED', '47', 'Not an absolute https link: ''''', NULL, NULL, NULL, NULL, NULL, TIMESTAMP '2024-02-01 10:00:00')) t(pos, kind, source_post_id, reason, title, body, completeness, tags, images, updated_at)""",
)
def map_blogger(s, d):
    x = M.map_blogger(_numbered(s, ", ".join(r.removeprefix("(").removesuffix(")") for r in _split(_BL))))
    return x.select("pos", "kind", "source_post_id", "reason", "title", "body", "completeness", F.array_join("tags", ",").alias("tags"), F.array_join(F.col("images.url"), ",").alias("images"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


query("post_events", f"WITH {STATES}, {_DIFF} SELECT post_id, CASE revision WHEN 'PUBLISHED' THEN 'PUBLISHED' ELSE 'REVISED' END AS type, CASE WHEN revision = 'CHANGED' THEN array_to_string(diff, ',') END AS changed FROM r WHERE revision IN ('PUBLISHED', 'CHANGED') UNION ALL SELECT post_id, 'WITHDRAWN', NULL FROM o WHERE post_id NOT IN (SELECT post_id FROM n)")(
    lambda s, d: _events(s, d).select("post_id", "type", F.array_join("changed", ",").alias("changed"))
)


def _events(s, d):
    new, old = states(s, d)
    seen = new.join(Y.classify(new, old), "post_id").withColumn("reason", F.lit(None).cast("string"))
    gone = old.join(Y.unlisted(old.select("post_id"), new.select("post_id")), "post_id").withColumns({"revision": F.lit("WITHDRAWN"), "changed": F.array().cast("array<string>"), "reason": F.lit("NO_LONGER_LISTED")})
    return M.events(seen.unionByName(gone))


query("index_changes", f"WITH {STATES}, {_DIFF} SELECT post_id, 'UPSERT' AS change FROM r WHERE revision IN ('PUBLISHED', 'CHANGED') UNION ALL SELECT post_id, 'REMOVE' FROM o WHERE post_id NOT IN (SELECT post_id FROM n)")(lambda s, d: M.index_changes(_events(s, d)))
_STREAM = """g AS (SELECT user_id, max(event_id) FILTER (event_type = 'signup') AS gone FROM events GROUP BY user_id),
a AS (SELECT e.* FROM events e JOIN g ON e.user_id = g.user_id WHERE event_type NOT IN ('error', 'signup') AND (gone IS NULL OR event_id > gone))"""
query("feed_stream_upsert", f"WITH {_STREAM} SELECT user_id AS key, max(ts) AS updated_at, arg_max(event_id, {{'t': ts, 'e': event_id}}) AS arrival, arg_max(event_type, {{'t': ts, 'e': event_id}}) AS content FROM a GROUP BY user_id")(
    lambda s, d: stream.run(stream.events(s, d), f"{shared_dir(s)}/feed-{uuid.uuid4().hex}").withColumn("content", F.substring_index("content", "|", 1))
)

"""Queries of the index, search, look-ups and stores."""
import uuid

from pyspark.sql import functions as F

from lodestone import providers
from lodestone.functions import text as X, vectors as V
from lodestone.operators import index as N, posts as M, search as S
from lodestone.plans.base import STATES, P, entries, entry_posts, posts, query, read, states, values
from lodestone.plans.base import V as VIEW
from lodestone.sources import stores
from lodestone.storage import shared_dir


def catalogue(s, d):
    """Catalogue entries and index rows, with content fingerprints."""
    new, old = states(s, d)
    fp = X.fingerprint("r1", F.col("title"), F.col("body"))
    return new.withColumn("fingerprint", fp), old.withColumn("fingerprint", fp)


_PLAN = """x AS (SELECT coalesce(n.post_id, o.post_id) AS post_id, CASE WHEN n.post_id IS NULL THEN 'REMOVED' WHEN n.completeness = 'SUMMARY' THEN CASE WHEN o.post_id IS NULL THEN 'EXCLUDED' ELSE 'REMOVED' END
  WHEN o.post_id IS NULL THEN 'ADDED' WHEN n.title <> o.title OR n.body <> o.body THEN 'RE_EMBEDDED'
  WHEN n.url <> o.url OR list_sort(list_distinct(n.tags)) <> list_sort(list_distinct(o.tags)) OR n.published_at <> o.published_at OR n.updated_at <> o.updated_at THEN 'METADATA_REFRESHED' ELSE 'UNCHANGED' END AS outcome
  FROM n FULL JOIN o ON n.post_id = o.post_id)"""
query("idx_decisions", f"WITH {STATES}, {_PLAN} SELECT post_id, outcome FROM x")(lambda s, d: N.plan(*catalogue(s, d)).select("post_id", "outcome"))
query("idx_report", f"WITH {STATES}, {_PLAN} SELECT outcome, count(*) AS n FROM x GROUP BY outcome")(lambda s, d: N.report(N.plan(*catalogue(s, d))))
query("idx_orphans", f"WITH {STATES} SELECT o.post_id FROM o ANTI JOIN n ON o.post_id = n.post_id")(lambda s, d: N.orphans(states(s, d)[1], states(s, d)[0]))
query(
    "idx_duplicates",
    f"""WITH {STATES}, {_PLAN} SELECT x.post_id, CASE WHEN n.doc_id % 20 = 1 THEN 'FAILED' ELSE outcome END AS outcome, CASE WHEN n.doc_id % 20 = 1 THEN 'duplicate post ID in the catalog listing' END AS reason
FROM x LEFT JOIN n ON x.post_id = n.post_id""",
)(lambda s, d: N.plan(catalogue(s, d)[0].unionByName(catalogue(s, d)[0].where("doc_id % 20 = 1")), catalogue(s, d)[1]))


def unreadable(s, d):
    """The newer state, where some entries have lost their id and some their title."""
    new, old = catalogue(s, d)
    new = new.withColumns({"post_id": F.expr("CASE WHEN doc_id % 50 = 0 THEN concat('?', doc_id) ELSE post_id END"), "title": F.expr("CASE WHEN doc_id % 50 = 3 THEN NULL ELSE title END")})
    return N.catalog_entries(new), old


query("idx_catalog_entries", f"WITH {STATES} SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'UNIDENTIFIED' WHEN doc_id % 50 = 3 THEN 'UNREADABLE' ELSE 'READABLE' END AS kind, CASE WHEN doc_id % 50 = 0 THEN 'not a post id: ?' || doc_id WHEN doc_id % 50 = 3 THEN 'missing title' END AS reason FROM n")(
    lambda s, d: unreadable(s, d)[0].select("doc_id", "kind", "reason")
)
query(
    "idx_orphans_suppressed",
    f"""WITH {STATES}, b AS (SELECT string_agg('not a post id: ?' || doc_id, '; ' ORDER BY 'not a post id: ?' || doc_id) AS reasons FROM n WHERE doc_id % 50 = 0)
SELECT o.post_id, reasons FROM o, b WHERE (o.doc_id NOT IN (SELECT doc_id FROM n) OR o.doc_id % 50 = 0) AND reasons IS NOT NULL""",
)(lambda s, d: N.suppressed(unreadable(s, d)[1], unreadable(s, d)[0]))
query(
    "idx_plan_suppressed",
    f"""WITH {STATES}, {_PLAN} SELECT x.post_id, CASE WHEN n.doc_id % 50 = 3 THEN 'FAILED' ELSE outcome END AS outcome FROM x JOIN n ON x.post_id = n.post_id WHERE n.doc_id % 50 <> 0""",
)(lambda s, d: N.plan(*unreadable(s, d)).select("post_id", "outcome"))
query("idx_remove", f"WITH {STATES} SELECT p.post_id, CASE WHEN o.post_id IS NULL THEN 'ALREADY_ABSENT' ELSE 'REMOVED' END AS outcome FROM p LEFT JOIN o ON p.post_id = o.post_id")(lambda s, d: N.remove(states(s, d)[1], posts(s, d)))
@query("idx_apply", f"""WITH {STATES}, {_PLAN} SELECT x.post_id, n.title, outcome IN ('ADDED', 'RE_EMBEDDED') AS fresh FROM x JOIN n ON x.post_id = n.post_id WHERE outcome NOT IN ('REMOVED', 'EXCLUDED')""")
def idx_apply(s, d):
    new, old = catalogue(s, d)
    cols = ["post_id", "site_id", "url", "title", "tags", "published_at", "updated_at", "fingerprint"]
    out = N.apply(old.select(*cols, F.lit(False).alias("fresh")), new, N.plan(new, old), lambda e: e.select(*cols, F.lit(True).alias("fresh")))
    return out.select("post_id", "title", "fresh")


_FILES = "(1, 'a/x', 'a/x', 2, 'm', array(4)), (2, 'a/x', 'a/y', 9, NULL, array(3)), (3, 'a/x', 'a/x', 9, NULL, array(3)), (4, 'a/x', 'a/x', 1, NULL, array(3)), (5, 'a/x', 'a/x', 1, 'old', array(3)), (6, 'a/x', 'a/x', 1, 'm', array(4, 3)), (7, 'a/x', 'a/x', 1, 'm', array(NULL)), (8, 'a/x', 'a/x', 1, 'm', cast(array() AS array<int>))"
query("idx_load_rules", "SELECT * FROM (VALUES (1, 'LOADED'), (2, 'UNREADABLE: wrong location'), (3, 'UNREADABLE: unknown format'), (4, 'UNREADABLE: no model'), (5, 'INCOMPATIBLE_MODEL'), (6, 'UNREADABLE: dimension'), (7, 'UNREADABLE: dimension'), (8, 'LOADED')) t(id, status)")(
    lambda s, d: values(s, _FILES, "id, want, place, fmt, model, sizes").select("id", N.load_status(F.col("want"), F.col("place"), F.col("fmt"), F.col("model"), F.col("sizes"), "m", 4).alias("status"))
)


@query(
    "idx_image_settled",
    f"""WITH {P}, a AS (SELECT doc_id, 'r1' || chr(10) || title || chr(10) || body AS b, chr(10) || 'https://h/1' || chr(10) || 'one' AS i, chr(10) || 'https://h/2' || chr(10) || 'two' AS j FROM p)
SELECT doc_id, sha256(b || i || j) AS current, sha256(CASE WHEN doc_id % 2 = 0 THEN b || i || j ELSE b || j END) AS stored FROM a""",
)
def idx_image_settled(s, d):
    attempts = F.expr("array(named_struct('url', 'https://h/1', 'description', 'one', 'status', CASE WHEN doc_id % 2 = 0 THEN 'INDEXED' ELSE 'PENDING' END), named_struct('url', 'https://h/2', 'description', 'two', 'status', 'SKIPPED'))")
    current, stored = N.fingerprints("r1", F.col("title"), F.col("body"), attempts)
    return posts(s, d).select("doc_id", current.alias("current"), stored.alias("stored"))


query("idx_recipe", "SELECT 'm/w300-t400-o50-oc100-c64/tt64-p1' AS plain, 'm/w300-t400-o50-oc100-c64/tt64-p1/prep-2/b-400-o-100-t-64-p-465-c-512/images-v1' AS full")(
    lambda s, d: s.range(1).select(F.lit(X.recipe("m")).alias("plain"), F.lit(X.recipe("m", "2", (400, 100, 64, 465, 512), True)).alias("full"))
)
query("idx_adopt", f"WITH {STATES} SELECT coalesce(n.post_id, o.post_id) AS post_id, n.post_id IS NULL AS adopted FROM n FULL JOIN o ON n.post_id = o.post_id")(
    lambda s, d: N.adopt(states(s, d)[1].select("post_id", F.lit(True).alias("adopted")), states(s, d)[0].select("post_id", F.lit(False).alias("adopted")))
)


def _q(s, d, where="vec_id = 1"):
    return read(s, d, "embeddings").where(where).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


_SCORED = f"""{VIEW}, q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE {{where}}),
s AS (SELECT v.*, query_id, list_dot_product(e, qv) AS score FROM v, q WHERE e IS NOT NULL),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, post_id ORDER BY score DESC, kind, idx) AS k FROM s)"""
_ONE = _SCORED.format(where="vec_id = 1")
query("search_best_entry", f"WITH {_ONE} SELECT post_id, round(score, 6) AS score, kind, idx FROM b WHERE k = 1")(
    lambda s, d: S.best_entry(S.scores(entries(s, d), _q(s, d))).select("post_id", F.round("score", 6).alias("score"), "kind", "idx")
)
query("search_ranked", f"WITH {_ONE} SELECT post_id, round(score, 6) AS score, kind, idx FROM b WHERE k = 1 ORDER BY b.score DESC, published_at DESC, post_id LIMIT 10")(
    lambda s, d: S.ranked(S.best_entry(S.scores(entries(s, d), _q(s, d))), entry_posts(s, d)).select("post_id", F.round("score", 6).alias("score"), "kind", "idx")
)
# Equal scores on purpose: the newer post comes first, then the id.
query("search_ties", f"WITH {_ONE} SELECT post_id, round(score, 1) AS score FROM b WHERE k = 1 ORDER BY round(b.score, 1) DESC, published_at DESC, post_id LIMIT 20")(
    lambda s, d: S.ranked(S.best_entry(S.scores(entries(s, d), _q(s, d))).withColumn("score", F.round("score", 1)), entry_posts(s, d), 99).select("post_id", "score")
)
query("search_scoped_topk", f"WITH {_ONE} SELECT post_id, round(score, 6) AS score, kind, idx FROM b WHERE k = 1 AND site_id = 'src3' AND published_at BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-07' ORDER BY b.score DESC, published_at DESC, post_id LIMIT 5")(
    lambda s, d: _scoped(s, d, entry_posts(s, d).where(S.scope("src3", "2024-01-02", "2024-01-07")))
)


def _scoped(s, d, inside):
    found = entries(s, d).join(inside.select("post_id"), "post_id", "left_semi")
    return S.ranked(S.best_entry(S.scores(found, _q(s, d))), inside, 5).select("post_id", F.round("score", 6).alias("score"), "kind", "idx")


_MANY = _SCORED.format(where="vec_id BETWEEN 1 AND 8")
query("search_many_queries", f"WITH {_MANY}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, published_at DESC, post_id) AS rank FROM b WHERE k = 1) SELECT query_id, post_id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10")(
    lambda s, d: S.ranked_each(S.best_entry(S.scores(entries(s, d), _q(s, d, "vec_id BETWEEN 1 AND 8"))), entry_posts(s, d)).select("query_id", "post_id", F.round("score", 6).alias("score"), "rank")
)
query("search_mixed_entries", f"WITH {_ONE}, t AS (SELECT post_id, round(score, 1) AS score, kind, idx FROM s) SELECT post_id, max(score) + 0.0::DOUBLE AS score, arg_min(kind, {{'s': -score, 'k': kind, 'i': idx}}) AS kind, arg_min(idx, {{'s': -score, 'k': kind, 'i': idx}}) AS idx FROM t GROUP BY post_id")(
    lambda s, d: S.best_entry(S.scores(entries(s, d).where("kind = 'CHUNK'").unionByName(entries(s, d).where("kind = 'IMAGE'")), _q(s, d)).withColumn("score", F.round("score", 1))).drop("query_id")
)


@query("search_text_hash")
def search_text_hash(s, d):
    from lodestone.api import Archive

    p = posts(s, d)
    provider = providers.HashProvider()
    return Archive(p, providers.entries(p, provider), provider).search_posts(query="the house and the garden", limit=5)


@query(
    "search_result_view",
    f"""WITH {P}, x AS (SELECT *, (doc_id % 1000) / 1003.0 AS raw FROM p)
SELECT post_id, title, url, site_id AS site, (timezone('Pacific/Auckland', timezone('UTC', published_at)))::DATE AS published, round(raw, 3)::DOUBLE AS score, array_to_string(string_split(body, ' ')[1:60], ' ') || CASE WHEN len(string_split(body, ' ')) > 60 THEN ' …' ELSE '' END AS snippet,
  len(string_split(body, ' ')) > 60 AS truncated, CASE WHEN doc_id % 2 = 0 THEN url || 'i.png' END AS matched_image FROM x""",
)
def search_result_view(s, d):
    p = posts(s, d)
    m = p.selectExpr("post_id", "CASE WHEN doc_id % 2 = 0 THEN 'IMAGE' ELSE 'CHUNK' END AS kind", "0 AS idx", "cast((doc_id % 1000) / 1003.0D AS double) AS score", "published_at")
    e = p.selectExpr("post_id", "CASE WHEN doc_id % 2 = 0 THEN 'IMAGE' ELSE 'CHUNK' END AS kind", "0 AS idx", "body AS text", "concat(url, 'i.png') AS image_url")
    return S.result_view(m, p, e)


query("flt_nz_dates", "SELECT doc_id, (timezone('Pacific/Auckland', timezone('UTC', TIMESTAMP '2024-01-01' + to_hours(doc_id))))::DATE::VARCHAR AS day FROM documents")(lambda s, d: posts(s, d).select("doc_id", M.nz_date(F.col("published_at")).cast("string").alias("day")))
_DAY = "(timezone('Pacific/Auckland', timezone('UTC', published_at)))::DATE"
query("flt_site", f"WITH {P} SELECT post_id FROM p WHERE site_id = 'src3'")(lambda s, d: posts(s, d).where(S.scope("src3")).select("post_id"))
query("flt_date_range", f"WITH {P} SELECT post_id FROM p WHERE {_DAY} BETWEEN DATE '2024-01-10' AND DATE '2024-01-20'")(lambda s, d: posts(s, d).where(S.scope(start="2024-01-10", end="2024-01-20")).select("post_id"))
query("flt_scope", f"WITH {P} SELECT post_id FROM p WHERE site_id = 'src5' AND {_DAY} >= DATE '2024-01-05'")(lambda s, d: posts(s, d).where(S.scope("src5", "2024-01-05")).select("post_id"))
query("flt_completeness", f"WITH {P} SELECT completeness, count(*) AS n FROM p GROUP BY completeness")(lambda s, d: posts(s, d).groupBy("completeness").agg(F.count("*").alias("n")))


def _reference(kind):
    """References to all posts by id or address, some with a port or user, some unknown and some none at all."""
    return "SELECT doc_id, post_id AS want, " + (
        "CASE doc_id % 4 WHEN 0 THEN concat(' ', post_id, ' ') WHEN 1 THEN concat(post_id, 'x') WHEN 2 THEN post_id ELSE concat('NO:', doc_id) END AS ref FROM p"
        if kind == "id" else "CASE doc_id % 5 WHEN 0 THEN replace(url, 'https', 'http') WHEN 1 THEN replace(url, '.org/', '.org:443/') WHEN 2 THEN concat(url, '#top') WHEN 3 THEN replace(url, 'https://', 'ftp://') ELSE concat(url, '?x=1') END AS ref FROM p"
    )


def _looked_up(kind):
    def f(s, d):
        posts(s, d).createOrReplaceTempView("p")
        return M.by_id(posts(s, d), s.sql(_reference(kind)).select("ref")).select("ref", "kind", "found", "post_id")
    return f


query("get_post_by_id", f"WITH {P}, r AS ({_reference('id')}) SELECT ref, CASE WHEN doc_id % 4 = 3 THEN 'INVALID_ID' ELSE 'ID' END AS kind, doc_id % 2 = 0 AS found, CASE WHEN doc_id % 2 = 0 THEN want END AS post_id FROM r")(_looked_up("id"))
query("get_post_by_url", f"WITH {P}, r AS ({_reference('url')}) SELECT ref, CASE WHEN doc_id % 5 = 3 THEN 'INVALID_URL' ELSE 'URL' END AS kind, doc_id % 5 < 3 AS found, CASE WHEN doc_id % 5 < 3 THEN want END AS post_id FROM r")(_looked_up("url"))
query("get_post_view", f"WITH {P} SELECT post_id, title, url, site_id AS site, {_DAY} AS published, updated_at, lang AS tags, p.completeness, md5(body) AS body FROM p JOIN documents USING (doc_id)")(
    lambda s, d: M.view(posts(s, d)).select("post_id", "title", "url", "site", "published", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), F.array_join("tags", ",").alias("tags"), "completeness", F.md5("body").alias("body"))
)
query("set_distinct_sites", "SELECT DISTINCT source AS site_id FROM documents")(lambda s, d: posts(s, d).select("site_id").distinct())
query("export_sorted_posts", "SELECT source || ':' || doc_id AS post_id FROM documents ORDER BY 1")(lambda s, d: posts(s, d).select("post_id").orderBy("post_id"))


@query("store_posts", f"WITH {P} SELECT post_id, site_id, url, title, md5(body) AS body, completeness, tags[1] AS tag, published_at, updated_at FROM p")
def store_posts(s, d):
    path = f"{shared_dir(s)}/posts-{uuid.uuid4().hex}"
    stores.save_posts(posts(s, d), path)
    good, _ = stores.load_posts(s, path)
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return good.select("post_id", "site_id", "url", "title", F.md5("body").alias("body"), "completeness", F.col("tags")[0].alias("tag"), ntz("published_at"), ntz("updated_at"))


@query(
    "store_quarantine",
    f"""WITH {P}, r AS (SELECT CASE doc_id % 10 WHEN 0 THEN 'not readable JSON' WHEN 1 THEN 'unknown format' WHEN 2 THEN 'wrong location' ELSE 'good' END AS reason FROM p)
SELECT reason, count(*) AS n, CASE WHEN reason = 'good' THEN 'HEALTHY' ELSE 'DAMAGED' END AS health FROM r GROUP BY reason""",
)
def store_quarantine(s, d):
    path = f"{shared_dir(s)}/damaged-{uuid.uuid4().hex}"
    line = "CASE doc_id % 10 WHEN 0 THEN '{\"format\": 2, ' ELSE to_json(named_struct('format', CASE WHEN doc_id % 10 = 1 THEN 9 ELSE 1 END, 'postId', CASE WHEN doc_id % 10 = 2 THEN concat('x', post_id) ELSE post_id END, 'title', title)) END AS value"
    posts(s, d).selectExpr("site_id", line).write.partitionBy("site_id").text(path)
    good, bad = stores.load_posts(s, path)
    counts = bad.groupBy("reason").agg(F.count("*").alias("n")).withColumn("health", F.lit("DAMAGED"))
    state = stores.health(good.where("1 = 0")).select(F.lit(1).alias("one"), "health")
    return counts.unionByName(good.agg(F.count("*").alias("n"), F.lit(1).alias("one")).join(F.broadcast(state), "one").select(F.lit("good").alias("reason"), "n", "health"))


@query("store_checkpoints", "SELECT user_id AS site_id, max(ts) AS seen, CASE WHEN user_id % 2 = 0 THEN min(ts) END AS reconciled FROM events GROUP BY user_id")
def store_checkpoints(s, d):
    path = f"{shared_dir(s)}/marks-{uuid.uuid4().hex}"
    m = read(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("a"), F.min("ts").alias("b"))
    stores.save_checkpoints(m.selectExpr("cast(user_id AS string) AS site_id", "cast(a AS timestamp) AS changes_seen_up_to", "CASE WHEN user_id % 2 = 0 THEN cast(b AS timestamp) END AS last_reconciled_at"), path)
    return stores.load_checkpoints(s, path)[0].select(F.col("site_id").cast("long").alias("site_id"), F.col("changes_seen_up_to").cast("timestamp_ntz").alias("seen"), F.col("last_reconciled_at").cast("timestamp_ntz").alias("reconciled"))


@query("store_index", "SELECT 'v:' || vec_id AS post_id, vec_id % 7 AS idx, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings WHERE embedding IS NOT NULL")
def store_index(s, d):
    path = f"{shared_dir(s)}/index-{uuid.uuid4().hex}"
    e = read(s, d, "embeddings").where("embedding IS NOT NULL").selectExpr("concat('v:', vec_id) AS post_id", "'v' AS site_id", "'CHUNK' AS kind", "vec_id % 7 AS idx", "'t' AS text", "cast(NULL AS string) AS image_url", "'f' AS fingerprint", "embedding")
    stores.save_index(e, path, "p1", "m", "r1")
    good, _ = stores.load_index(s, path, "p1", "m", 64)
    return good.select("post_id", "idx", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))

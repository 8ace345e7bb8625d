"""Queries of text, address and HTML functions."""
from pyspark.sql import functions as F

from lodestone.functions import html, text as X, urls as U
from lodestone.plans.base import P, posts, query, read, values

GAP = "[\\t\\n\\x0b\\x0c\\r\\x85\\x1c-\\x1f\\p{Z}]+"


def words(c: str) -> str:
    """DuckDB: words of a text, cut into pieces of 64 characters."""
    return (
        f"flatten(list_transform(list_filter(regexp_split_to_array({c}, '{GAP}'), lambda w: w <> ''), "
        "lambda w: list_transform(range(0, ((length(w) - 1) // 64) + 1), lambda i: substr(w, (i * 64 + 1)::int, 64))))"
    )


def doc(f, *names):
    return lambda s, d: read(s, d, "documents").select("doc_id", *[c.alias(n) for c, n in zip(f(F.col("text")), names, strict=True)])


query("str_words", f"SELECT doc_id, len({words('text')})::INT AS n_words FROM documents")(doc(lambda t: [F.size(X.words(t))], "n_words"))
query("str_pieces", f"SELECT doc_id, list_max(list_transform({words('text')}, lambda w: length(w)))::INT AS longest FROM documents")(doc(lambda t: [F.array_max(F.transform(X.words(t), F.length))], "longest"))
query("str_collapse", f"SELECT doc_id, md5(array_to_string({words('text')}, ' ')) AS norm_md5 FROM documents")(doc(lambda t: [F.md5(X.normalised(t))], "norm_md5"))
query("str_strip", f"SELECT doc_id, md5(regexp_replace(regexp_replace(chr(160) || ' ' || text || chr(9), '^{GAP}', ''), '{GAP}$', '')) AS strip_md5 FROM documents")(
    doc(lambda t: [F.md5(X.strip_ws(F.concat(F.lit("  "), t, F.lit("\t"))))], "strip_md5")
)
query(
    "str_snippet",
    """SELECT doc_id, len(string_split(text, ' ')) > 60 AS truncated,
  CASE WHEN len(string_split(text, ' ')) > 60 THEN array_to_string(string_split(text, ' ')[1:60], ' ') || ' …' ELSE text END AS snippet FROM documents""",
)(doc(lambda t: [X.truncated(t), X.snippet(t)], "truncated", "snippet"))
query("str_title_line", f"SELECT doc_id, array_to_string({words('text')}[1:64], ' ') AS line FROM documents")(doc(lambda t: [X.title_line(t)], "line"))
query(
    "str_fingerprint",
    f"WITH {P} SELECT doc_id, sha256('r1' || chr(10) || title || chr(10) || body || CASE WHEN doc_id % 2 = 0 THEN chr(10) || url || chr(10) || 'an image' ELSE '' END) AS fingerprint FROM p",
)(lambda s, d: posts(s, d).select("doc_id", X.fingerprint("r1", F.col("title"), F.col("body"), F.expr("CASE WHEN doc_id % 2 = 0 THEN array(named_struct('url', url, 'description', 'an image')) ELSE cast(array() AS array<struct<url:string,description:string>>) END")).alias("fingerprint")))
query("str_passage_bge", f"WITH {P} SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 OR title = '' THEN body ELSE title || chr(10) || body END) AS passage_md5 FROM p")(
    lambda s, d: posts(s, d).select("doc_id", F.md5(X.passage(F.expr("CASE WHEN doc_id % 3 = 0 THEN '' ELSE title END"), F.col("body"))).alias("passage_md5"))
)
query("str_passage_gemma", f"WITH {P} SELECT doc_id, md5('title: ' || CASE WHEN doc_id % 3 = 0 OR title = '' THEN 'none' ELSE title END || ' | text: ' || body) AS passage_md5 FROM p")(
    lambda s, d: posts(s, d).select("doc_id", F.md5(X.gemma_passage(F.expr("CASE WHEN doc_id % 3 = 0 THEN '' ELSE title END"), F.col("body"))).alias("passage_md5"))
)
query("str_query_prefix", f"WITH {P} SELECT doc_id, 'Represent this sentence for searching relevant passages: ' || title AS bge, 'task: search result | query: ' || title AS gemma FROM p")(
    lambda s, d: posts(s, d).select("doc_id", F.concat(F.lit(X.BGE_QUERY), "title").alias("bge"), F.concat(F.lit(X.GEMMA_QUERY), "title").alias("gemma"))
)
query(
    "str_file_key",
    f"""WITH {P}, h AS (SELECT doc_id, lower(hex(encode(post_id || ' ' || title))) AS h FROM p)
SELECT doc_id, array_to_string(list_transform(range(0, length(h) // 2), lambda i: CASE
  WHEN regexp_matches(substr(h, (2 * i + 1)::INT, 2), '^(3[0-9]|6[1-9a-f]|7[0-9a]|5f|2d)$') THEN decode(unhex(substr(h, (2 * i + 1)::INT, 2)))
  ELSE '%' || substr(h, (2 * i + 1)::INT, 2) END), '') AS key FROM h""",
)(lambda s, d: posts(s, d).select("doc_id", X.file_key(F.concat_ws(" ", "post_id", "title")).alias("key")))
query(
    "str_tags",
    """WITH t AS (SELECT doc_id, [' ' || lang || ' ', upper(lang), '  ', source, lang || 'x', NULL, source] AS raw FROM documents)
SELECT doc_id, lang || ',' || source || ',' || lang || 'x' AS tags, array_to_string(list_sort([lang, source, lang || 'x']), ',') AS tag_set FROM t JOIN documents USING (doc_id)""",
)(lambda s, d: read(s, d, "documents").select("doc_id", F.expr("array(concat(' ', lang, ' '), upper(lang), '  ', source, concat(lang, 'x'), NULL, source)").alias("raw")).select("doc_id", F.array_join(X.tags(F.col("raw")), ",").alias("tags"), F.array_join(X.tag_set(F.col("raw")), ",").alias("tag_set")))
_IMAGES = "(1, 'an  alt', 'c'), (2, ' ', 'the\ncaption'), (3, '', ''), (4, NULL, NULL)"
query("str_image_description", "SELECT * FROM (VALUES (1, 'an alt'), (2, 'the caption'), (3, 'Image: https://h/a.png'), (4, 'Image: https://h/a.png')) t(id, description)")(
    lambda s, d: values(s, _IMAGES.replace("\n", "\\n"), "id, alt, caption").select("id", X.image_description(F.coalesce("alt", F.lit("")), F.coalesce("caption", F.lit("")), F.lit("https://h/a.png")).alias("description"))
)


@query(
    "win_chunks",
    f"""WITH w AS (SELECT doc_id, {words("text")} AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(0, 1 + greatest(0, ceil((len(ws) - 300) / 250.0))::INT)) AS k FROM w)
SELECT doc_id, k::INT AS idx, md5(array_to_string(ws[k * 250 + 1 : k * 250 + 300], ' ')) AS chunk_md5 FROM i""",
)
def win_chunks(s, d):
    w = read(s, d, "documents").select("doc_id", X.words(F.col("text")).alias("ws"))
    return w.select("doc_id", "ws", F.explode(X.window_starts(F.size("ws"))).alias("idx")).select("doc_id", "idx", F.md5(X.window(F.col("ws"), F.col("idx"))).alias("chunk_md5"))


query("win_chunk_counts", f"WITH w AS (SELECT doc_id, len({words('text')}) AS n FROM documents) SELECT doc_id, (1 + greatest(0, ceil((n - 300) / 250.0)))::INT AS n_chunks FROM w")(
    doc(lambda t: [F.size(X.window_starts(F.size(X.words(t))))], "n_chunks")
)


@query("win_chunks_token_budget")
def win_chunks_token_budget(s, d):
    return X.token_windows(read(s, d, "documents").select("doc_id", X.words(F.col("text")).alias("ws")), lambda w: -(-len(w) // 4))


@query("agg_token_totals", f"WITH w AS (SELECT doc_id, {words('text')} AS ws FROM documents) SELECT doc_id, coalesce(list_sum(list_transform(ws, lambda w: (length(w) + 3) // 4)), 0)::BIGINT AS tokens FROM w")
def agg_token_totals(s, d):
    ws = read(s, d, "documents").select("doc_id", X.words(F.col("text")).alias("ws"))
    return ws.select("doc_id", F.aggregate("ws", F.lit(0).cast("long"), lambda n, w: n + F.floor((F.length(w) + 3) / 4)).alias("tokens"))


# Each address of the pages, and forms of it with ports, user, fragment and trailing slashes, and some that are none.
_FORMS = """SELECT page_id, k, CASE k WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^(https?://[^/?#]+)', '{0}:8080') WHEN 2 THEN regexp_replace(url, '^(https?://[^/?#]+)', '{0}:443')
  WHEN 3 THEN regexp_replace(url, '^(https?://[^/?#]+)', '{0}:80') WHEN 4 THEN concat(upper(substr(url, 1, 12)), substr(url, 13), '#part') WHEN 5 THEN regexp_replace(url, '^(https?)://', '{0}://me:pw@')
  WHEN 6 THEN concat(regexp_replace(url, '[?#].*$', ''), '//') WHEN 7 THEN concat('not a ', url) ELSE concat(url, ' ') END AS u"""
_URL_PARTS = r"""f AS ({forms} FROM pages, range(0, 9) t(k)),
x AS (SELECT page_id, k, u, regexp_extract(u, '^([a-zA-Z]+)://(?:[^/?#@]*@)?([^/?#:@]+)(?::([0-9]+))?(/[^?#]*)?([?][^#]*)?(#.*)?$', ['scheme', 'host', 'port', 'path', 'query', 'part']) AS a,
  NOT contains(u, ' ') AND u NOT LIKE '%#%#%' AS sound FROM f),
y AS (SELECT *, lower(a.scheme) AS scheme, lower(a.host) || CASE WHEN a.port IN ('', '443') OR (lower(a.scheme) = 'http' AND a.port = '80') THEN '' ELSE ':' || a.port END
  || regexp_replace(a.path, '/$', '') || a.query AS rest FROM x)""".format(forms=_FORMS.format("\\1"))


def forms(s, d):
    read(s, d, "pages").createOrReplaceTempView("lodestone_pages")
    return s.sql(_FORMS.format("$1") + " FROM lodestone_pages CROSS JOIN VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8) AS t(k)")


query("url_normalise", f"WITH {_URL_PARTS} SELECT page_id, k::INT AS k, CASE WHEN sound AND scheme = 'https' THEN 'https://' || rest END AS url FROM y")(lambda s, d: forms(s, d).select("page_id", "k", U.normalised(F.col("u")).alias("url")))
query("url_look_up", f"WITH {_URL_PARTS} SELECT page_id, k::INT AS k, CASE WHEN sound AND scheme IN ('http', 'https') THEN 'https://' || rest END AS url FROM y")(lambda s, d: forms(s, d).select("page_id", "k", U.look_up(F.col("u")).alias("url")))
query("url_on_site", f"WITH {_URL_PARTS} SELECT page_id, k::INT AS k, sound AND scheme = 'https' AND lower(a.host) = (SELECT min(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1))) FROM pages) AS on_site FROM y")(
    lambda s, d: forms(s, d).join(F.broadcast(read(s, d, "pages").agg(F.min(U.host(F.col("url"))).alias("site"), F.lit(1).alias("one"))), F.col("one") == 1).select("page_id", "k", U.on_site(F.col("u"), F.col("site")).alias("on_site"))
)
query(
    "url_reference_kind",
    f"""WITH {_URL_PARTS} SELECT page_id, k::INT AS k, CASE WHEN k = 8 AND NOT contains(trim(u), ' ') THEN 'URL' WHEN k = 7 THEN 'INVALID_ID' WHEN sound THEN 'URL' ELSE 'INVALID_URL' END AS kind FROM y
UNION ALL SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN -2 ELSE -1 END::INT, CASE doc_id % 4 WHEN 0 THEN 'ID' WHEN 1 THEN 'INVALID_ID' WHEN 2 THEN 'INVALID_ID' ELSE 'BLANK' END FROM documents""",
)(
    lambda s, d: forms(s, d).select("page_id", "k", U.reference_kind(F.col("u")).alias("kind")).unionByName(
        read(s, d, "documents").selectExpr("doc_id AS page_id", "CASE WHEN doc_id % 4 = 3 THEN -2 ELSE -1 END AS k", "CASE doc_id % 4 WHEN 0 THEN concat(' ', source, ':', doc_id, ':x') WHEN 1 THEN concat(upper(source), ':', doc_id) WHEN 2 THEN concat(source, ': ') ELSE '  ' END AS u").select("page_id", "k", U.reference_kind(F.col("u")).alias("kind"))
    )
)
query(
    "url_resolve",
    """SELECT page_id, k::INT AS k, CASE k WHEN 0 THEN 'https://h.example/a/b/i.png' WHEN 1 THEN 'https://h.example/i.png' WHEN 2 THEN 'https://c.example/i.png' WHEN 3 THEN 'https://h.example/a/i.png' END AS url
FROM pages, range(0, 5) t(k)""",
)(lambda s, d: read(s, d, "pages").crossJoin(values(s, "(0, 'i.png'), (1, '/i.png'), (2, '//c.example/i.png'), (3, '../i.png'), (4, 'bad url')", "k, link")).select("page_id", "k", U.resolved(F.lit("https://h.example/a/b/post"), F.col("link")).alias("url")))
query("html_to_text")(lambda s, d: read(s, d, "pages").select("page_id", html.html_to_text(F.col("html")).alias("text")))
query("html_title", "SELECT page_id, regexp_extract(html, '(?s)<title>([^<&]*)</title>', 1) AS title FROM pages")(
    lambda s, d: read(s, d, "pages").select("page_id", html.title(F.regexp_extract("html", "(?s)<title>([^<&]*)</title>", 1), F.lit("text")).alias("title"))
)
_ENTITIES = "(1, 'a &amp; b', 'a & b'), (2, '&lt;p&gt;', '<p>'), (3, 'x&nbsp;y', 'x y'), (4, '&#65;&#x42;', 'AB'), (5, 'plain', 'plain')"
query("html_entities", f"SELECT id, want AS text FROM (VALUES {_ENTITIES}) t(id, raw, want)")(lambda s, d: values(s, _ENTITIES, "id, raw, want").select("id", html.decode_entities(F.col("raw")).alias("text")))
query(
    "html_images",
    """SELECT * FROM (VALUES (0, 'https://h/p/a.png', 'two words', ''), (1, 'https://h/b.png', '', 'A caption'), (2, 'https://h/w900.png', '', '')) t(pos, url, alt_text, caption)""",
)(
    lambda s, d: values(s, """('<img src="a.png" alt=" two  words "><img class="x emoji" src="e.png"><img src="t.png" width="10"><figure><img src="/b.png"><figcaption>A <b>caption</b></figcaption></figure><img src="http://h/n.png"><img src="HTTPS://H/b.png"><img srcset="w300.png 300w, /w900.png 900w, w4000.png 4000w">')""", "html")
    .select(F.posexplode_outer(html.extract_images(F.col("html"), F.lit("https://h/p/post"))).alias("pos", "i")).select("pos", "i.*")
)

"""Golden cases, edge rows and brute force of the catalogue and search operators."""
import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import api, providers
from lodestone.functions import html, images, text, urls, vectors
from lodestone.operators import index, posts, search, sync
from lodestone.plans.base import posts as fixture_posts
from lodestone.sources import image_files, platforms, stores
from lodestone.streaming import feed

SF = "/root/testdata/sf0.001"
POST = "post_id string, site_id string, url string, title string, body string, completeness string, tags array<string>, images array<struct<url:string,alt_text:string,caption:string>>, published_at timestamp, updated_at timestamp"
T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def col(spark, rows, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}").orderBy("i").select(f(F.col("x"))).collect()]


def post(pid="s:1", **given):
    base = {"post_id": pid, "site_id": "s", "url": "https://h/1", "title": "t", "body": "b", "completeness": "FULL", "tags": ["x"], "images": [], "published_at": T0, "updated_at": T0}
    return tuple({**base, **given}.values())


def test_words(spark):
    assert col(spark, ["a\tb\n\nc d   e\x1cf", "x" * 1000, "", None], text.normalised) == ["a b c d e f", " ".join(["x" * 64] * 15 + ["x" * 40]), "", None]
    assert col(spark, [" \u00a0 a b\u3000\x1f"], text.strip_ws) == ["a b"] and col(spark, ["\u00a0a\u3000 \x1f"], text.java_strip) == ["\u00a0a"]


def test_windows(spark):
    def windows(c):
        return F.transform(text.window_starts(F.size(text.words(c))), lambda k: text.window(text.words(c), k))

    got = col(spark, [" ".join(f"w{i}" for i in range(1, n + 1)) for n in (120, 300, 301, 700)] + [""], windows)
    assert [[(w.split()[0], w.split()[-1]) for w in g] for g in got[:4]] == [[("w1", "w120")], [("w1", "w300")], [("w1", "w300"), ("w251", "w301")], [("w1", "w300"), ("w251", "w550"), ("w501", "w700")]]
    assert got[4] == [""]


def test_windows_by_cost():
    w = text.windows_by_cost
    assert w([]) == [(0, 0)] and w([2] * 500)[:2] == [(0, 200), (150, 350)] and w([4] * 500)[:2] == [(0, 100), (75, 175)]
    assert w([1, 500, 1]) == [(0, 1), (1, 2), (2, 3)]
    assert w([2] * 60 + [350]) == [(0, 60), (35, 61)]
    assert w([1] * 4, target=2, overlap=5) == [(0, 2), (1, 3), (2, 4)]
    for n in (0, 1, 299, 300, 301, 550, 551, 1234):
        assert w([1] * n) == [(250 * i, min(n, 250 * i + 300)) for i in range(1 + max(0, -(-(n - 300) // 250)))]


def test_snippet_titles_and_passages(spark):
    long = " ".join(["a"] * 300)
    assert col(spark, [long, "a b", ""], text.snippet) == [" ".join(["a"] * 60) + " …", "a b", ""]
    assert col(spark, [long], text.title_line) == [" ".join(["a"] * 64)] and text.title_prefix([10, 50, 10, 1]) == 2
    assert col(spark, ["", "t"], lambda c: text.passage(c, F.lit("x"))) == ["x", "t\nx"]
    assert col(spark, ["", "t"], lambda c: text.gemma_passage(c, F.lit("x"))) == ["title: none | text: x", "title: t | text: x"]
    assert col(spark, ["A b/é_-9"], text.file_key) == ["%41%20b%2f%c3%a9_-9"]
    for bad in ((0, 0, 0, 0, 0), (5, 5, 1, 2, 3), (5, 1, 4, 3, 9), (5, 1, 1, 9, 3)):
        with pytest.raises(ValueError):
            text.check_budget(*bad)


def test_tags(spark):
    assert col(spark, [[" Java ", "java", "", None, "b", "JAVA"], []], text.tags, "array<string>") == [["Java", "b"], []]


def test_urls(spark):
    rows = ["https://H:443/Path/Case/#x", "https://h:80/p", "https://h:4433/a", "http://h/a", "https://h/a//", "https://h?q=1", "not a url", "https://h/a b", "https://me@h/x", "https://h/%zz", None]
    assert col(spark, rows, urls.normalised) == ["https://h/Path/Case", "https://h:80/p", "https://h:4433/a", None, "https://h/a/", "https://h?q=1", None, None, "https://h/x", None, None]
    rows = ["http://h:80/a/?r=5", "http://h:8080/x", "https://h:80/p", "http://h:443/q", "HTTP://H/a#f", "ftp://h/a"]
    assert col(spark, rows, urls.look_up) == ["https://h/a?r=5", "https://h:8080/x", "https://h:80/p", "https://h/q", "https://h/a", None]
    assert col(spark, [" https://h/x ", "ftp://h", "s:1:2", "S:1", "s: ", "", None], urls.reference_kind) == ["URL", "INVALID_URL", "ID", "INVALID_ID", "INVALID_ID", "BLANK", "BLANK"]
    assert col(spark, ["https://H/x", "http://h/x", "https://g/x", None], lambda c: urls.on_site(c, F.lit("h"))) == [True, False, False, False]


def test_html():
    t = html.text_of
    assert t("<p>One&nbsp;line</p><script>x('</p>')</script><pre>  a\n  b</pre><p>Two</p>") == "One line\n\n  a\n  b\n\nTwo"
    assert t("<table><tr><td>a</td><td>b</td></tr></table>") == "a\n\nb" and t("<p>one<br>two</p>") == "one\ntwo" and t("<!-- c -->x <b>y</b>") == "x y" and t("") == "" and t(None) is None
    got = html.images_of('<figure><img src="/a.png" alt=" x  y "><div><figcaption>no</figcaption></div><figcaption>Cap <i>t</i></figcaption></figure><img src="HTTPS://H/a.png"><img src="http://h/b.png"><img class="emoji" src="/c.png"><img src="/d.png" height="63">', "https://h/p")
    assert [g["url"] for g in got] == ["https://h/a.png"] and got[0]["alt_text"] == "x y"


def test_revisions(spark):
    old = [post(f"s:{i}") for i in range(1, 20)]
    later, sooner = T0 + dt.timedelta(hours=1), T0 - dt.timedelta(hours=1)
    new = [
        post("s:1"), post("s:2", updated_at=later), post("s:3", updated_at=sooner, title="new"), post("s:4", title="new"), post("s:5", body="new"), post("s:6", completeness="SUMMARY"), post("s:7", tags=["X", "x"]),
        post("s:8", tags=["y"]), post("s:9", url="HTTPS://H/1"), post("s:10", url="https://h/2"), post("s:11", published_at=later), post("s:12", images=[("https://h/i", "", "")]), post("s:13", title=None, tags=None), post("s:99"),
    ]
    got = {r.post_id: (r.revision, r.changed) for r in sync.classify(spark.createDataFrame(new, POST), spark.createDataFrame(old, POST)).collect()}
    changed = {4: ["TITLE"], 5: ["BODY"], 6: ["COMPLETENESS"], 8: ["TAGS"], 10: ["URL"], 11: ["PUBLISHED_AT"], 12: ["IMAGES"], 13: ["TITLE", "TAGS"]}
    want = {f"s:{i}": ("CHANGED", c) for i, c in changed.items()} | {"s:1": ("UNCHANGED", []), "s:2": ("TOUCHED", []), "s:3": ("STALE", []), "s:7": ("UNCHANGED", []), "s:9": ("UNCHANGED", []), "s:99": ("PUBLISHED", [])}
    assert got == want


def test_fold_against_a_state_machine(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(8), i, T0 + dt.timedelta(hours=rng.randrange(12)), rng.choice(["AVAILABLE"] * 6 + ["NOT_PUBLIC", "MALFORMED"]), rng.choice("abc")) for i in range(600)]
    want, state = {}, {}
    for k, i, at, kind, content in rows:
        if kind == "MALFORMED" or (kind == "NOT_PUBLIC" and k not in state):
            want[k, i] = "SKIPPED"
        elif kind == "NOT_PUBLIC":
            want[k, i] = "WITHDRAWN"
            del state[k]
        elif k not in state:
            want[k, i], state[k] = "PUBLISHED", (at, content)
        elif at < state[k][0]:
            want[k, i] = "STALE"
        else:
            want[k, i] = "CHANGED" if content != state[k][1] else "TOUCHED" if at > state[k][0] else "UNCHANGED"
            state[k] = (at, content)
    f = spark.createDataFrame(rows, "key int, arrival int, updated_at timestamp, kind string, content string")
    assert {(r.key, r.arrival): r.revision for r in sync.fold(f).collect()} == want
    assert set(want.values()) == {"SKIPPED", "WITHDRAWN", "PUBLISHED", "STALE", "CHANGED", "TOUCHED", "UNCHANGED"}
    # the stream's state after any batches is the last state of its rule
    got = feed.upsert(spark.createDataFrame([], feed.STATE), f.select(F.col("key").cast("long").alias("key"), F.col("arrival").cast("long").alias("arrival"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "kind", "content"))
    assert {r.key for r in got.collect()} == set(state)


def test_withdraw_guard(spark):
    stored = spark.createDataFrame([("a",), ("b",)], "post_id string")
    listed = lambda *x: spark.createDataFrame([(v,) for v in x], "post_id string")
    assert [r[0] for r in sync.unlisted(stored, listed("a")).collect()] == ["b"]
    assert sync.unlisted(stored, listed()).isEmpty() and sync.unlisted(stored, listed("a", None)).isEmpty()
    assert sync.verdict(listed()).first()[0].startswith("EMPTY") and sync.verdict(listed(None)).first()[0].startswith("UNIDENTIFIED")


def test_reconcile(spark):
    kind = POST + ", fingerprint string"
    new = [post("P:1") + ("a",), post("s:2") + ("b2",), post("s:3", tags=["y"]) + ("c",), post("s:4") + ("d",), post("s:5", completeness="SUMMARY") + ("e",), post("s:6", completeness="SUMMARY") + ("f",), post("s:7") + ("g",), post("s:7") + ("g",), post("s:8", title="n") + ("h",)]
    new[0] = post("s:1") + ("a",)
    old = [post(f"s:{i}") + (f,) for i, f in ((2, "b"), (3, "c"), (4, "d"), (6, "f"), (7, "g"), (8, "h"), (9, "o"))]
    n, o = spark.createDataFrame(new, kind), spark.createDataFrame(old, kind)
    want = {"s:1": "ADDED", "s:2": "RE_EMBEDDED", "s:3": "METADATA_REFRESHED", "s:4": "UNCHANGED", "s:5": "EXCLUDED", "s:6": "REMOVED", "s:7": "FAILED", "s:8": "METADATA_REFRESHED", "s:9": "REMOVED"}
    assert {r.post_id: r.outcome for r in index.plan(n, o).collect()} == want
    odd = index.catalog_entries(n.unionByName(spark.createDataFrame([post("?") + ("z",)], kind)))
    assert {r.post_id: r.outcome for r in index.plan(odd, o).collect()} == {k: v for k, v in want.items() if k != "s:9"}
    assert index.plan(n.limit(0), o).select("outcome").distinct().collect() == [("REMOVED",)] and index.plan(n.limit(0), o.limit(0)).isEmpty()
    again = index.plan(n.where("post_id = 's:4'"), o.where("post_id = 's:4'")).collect()
    assert [(r.post_id, r.outcome) for r in again] == [("s:4", "UNCHANGED")]


def test_ranking(spark):
    kind = "post_id string, kind string, idx long, embedding array<double>"
    e = spark.createDataFrame([("a", "CHUNK", 0, [0.9, 0.0]), ("a", "CHUNK", 1, [0.8, 0.0]), ("a", "CHUNK", 2, None), ("b", "IMAGE", 0, [0.85, 0.0]), ("b", "CHUNK", 5, [0.85, 0.0]), ("b", "CHUNK", 4, [0.85, 0.0]), ("c", "CHUNK", 0, [float("nan"), 0.0]), ("d", "CHUNK", 0, [0.85, 0.0]), ("f", "CHUNK", 0, [0.85, 0.0]), ("g", "CHUNK", 0, [1.0])], kind)
    p = spark.createDataFrame([(x, T0 + dt.timedelta(days=n)) for x, n in (("a", 0), ("b", 0), ("c", 9), ("d", 5), ("f", 0))], "post_id string, published_at timestamp")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, vector array<double>")
    best = search.best_entry(search.scores(e, q))
    got = [(r.post_id, r.score, r.kind, r.idx) for r in search.ranked(best, p).collect()]
    assert got == [("a", 0.9, "CHUNK", 0), ("d", 0.85, "CHUNK", 0), ("b", 0.85, "CHUNK", 4), ("f", 0.85, "CHUNK", 0)]
    assert [search.clamp(x) for x in (-5, 0, 1, 20, 21, None)] == [1, 1, 1, 20, 20, 10]
    assert len(search.ranked(best, p, -5).collect()) == 1


def test_nz_dates(spark):
    times = ["2024-03-31T10:59:59Z", "2024-03-31T11:30:00Z", "2024-04-30T11:59:59.999Z", "2024-04-30T12:00:00Z"]
    assert [str(x) for x in col(spark, times, lambda c: posts.nz_date(F.to_timestamp(c)))] == ["2024-03-31", "2024-04-01", "2024-04-30", "2024-05-01"]
    p = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t string").withColumn("published_at", F.to_timestamp("t"))
    assert [r.i for r in p.where(search.scope(start="2024-04-01", end="2024-04-01")).collect()] == [1]
    with pytest.raises(search.InvalidSearchQuery, match="FROM_AFTER_TO"):
        search.scope(start="2024-04-02", end="2024-04-01")


def test_query_text():
    assert search.query_text("  a b\x1c") == "a b"
    for bad, why in ((" \t", "BLANK"), ("😀" * 501, "TOO_LONG")):
        with pytest.raises(search.InvalidSearchQuery, match=why):
            search.query_text(bad)


def test_images(spark):
    rows = spark.createDataFrame([(200, None), (301, "x"), (304, None), (429, None), (404, None)], "s int, l string")
    assert [r[0] for r in rows.select(images.status_class(F.col("s"), F.col("l"))).collect()] == ["SUCCESS", "REDIRECT", "PERMANENT", "TRANSIENT", "PERMANENT"]
    sizes = spark.createDataFrame([(1024, 768), (768, 1024), (1, 1), (4000, 100), (10000, 10), (10, 10000)], "w int, h int")
    assert [tuple(r[0]) for r in sizes.select(images.target_size(F.col("w"), F.col("h"))).collect()] == [(912, 672), (672, 912), (768, 768), (5040, 96), (13440, 48), (48, 13440)]
    ids = spark.range(1).select(images.input_ids(F.lit(266))).first()[0]
    assert len(ids) == 270 and ids[:3] == [2, 255999, 258880] and ids[-2:] == [258882, 1]


def test_resize_and_patches():
    rng = np.random.default_rng(1)
    flat = np.full((50, 70, 3), 77, np.uint8)
    assert (images.resize(flat, 96, 48) == 77).all() and images.resize(flat, 70, 50) is flat
    x = rng.integers(0, 256, (96, 96, 3), np.uint8)
    small = images.resize(x, 48, 48)
    assert small.shape == (48, 48, 3) and abs(float(small.mean()) - float(x.mean())) < 1
    patches, places = images.patchify(x)
    assert patches.shape == (2520, 768) and (places[:36].tolist() == [[c, r] for r in range(6) for c in range(6)]) and (places[36:] == -1).all() and not patches[36:].any()
    assert np.allclose(patches[7].reshape(16, 16, 3), x[16:32, 16:32] / 255)


def test_fetch():
    ok = (200, None, "image/png; x=1", 3, b"png")
    answers = {"https://a/1": ok, "https://a/2": (302, "/1", None, None, b""), "https://a/3": (302, "/3", None, None, b""), "https://a/4": (503, None, None, None, b""), "https://a/5": (404, None, None, None, b""), "https://a/6": (200, None, "text/html", 1, b""), "https://a/7": (200, None, "image/gif", 10_485_761, b""), "https://a/8": (301, "http://a/1", None, None, b"")}
    got = {u: image_files.fetch_one(u, answers.__getitem__, lambda u: "//bad" not in u)[:2] for u in [*answers, "https://bad/x", "http://a/1"]}
    assert got == {"https://a/1": ("FETCHED", None), "https://a/2": ("FETCHED", None), "https://a/3": ("REJECTED", "TOO_MANY_REDIRECTS"), "https://a/4": ("UNAVAILABLE", None), "https://a/5": ("REJECTED", "HTTP_STATUS"), "https://a/6": ("REJECTED", "UNSUPPORTED_TYPE"), "https://a/7": ("REJECTED", "TOO_LARGE"), "https://a/8": ("REJECTED", "NOT_HTTPS"), "https://bad/x": ("REJECTED", "ADDRESS_NOT_PERMITTED"), "http://a/1": ("REJECTED", "NOT_HTTPS")}


def test_vectors(spark):
    rows = [[3.0, 4.0], [float("nan"), 1.0], [float("inf"), 1.0], [0.0, 0.0], [1.0], None, [None, 1.0]]
    assert col(spark, rows, lambda c: vectors.valid(c, 2), "array<double>") == [True] + [False] * 6
    unit = col(spark, rows[:2], vectors.normalised, "array<double>")
    assert unit[0] == pytest.approx([0.6, 0.8]) and unit[1] is None
    assert vectors.decode("AAAA") is None and vectors.decode("!") is None and vectors.decode("AACAPw==") == [1.0]


def test_provider_failures():
    class Bad(providers.HashProvider):
        def embed(self, passages):
            return super().embed(passages[1:])

    with pytest.raises(providers.ModelFailure):
        providers.checked(Bad(), ["a", "b"])
    assert providers.checked(providers.HashProvider(), []).shape[0] == 0
    assert np.allclose(np.linalg.norm(providers.HashProvider().embed(["a b", ""]), axis=1), 1)


def test_tools(spark):
    p = fixture_posts(spark, SF)
    provider = providers.HashProvider()
    archive = api.Archive(p, providers.entries(p, provider), provider)
    some = p.where("completeness = 'FULL' and length(body) between 200 and 900").orderBy("doc_id").first()
    got = archive.search_posts(query=some.body, limit=3.0).collect()
    assert len(got) == 3 and [r.score for r in got] == sorted((r.score for r in got), reverse=True) and some.post_id in [r.post_id for r in got]
    assert all(r.site == some.site_id for r in archive.search_posts(query="the", site=some.site_id, **{"from": "2024-01-01"}).collect())
    assert archive.get_post(post=some.post_id).first().body == some.body and archive.get_post(post=some.url.replace("https", "http")).first().found
    assert not archive.get_post(post="s:none").first().found
    for bad in ({}, {"query": 1}, {"query": "a", "limit": 1.5}, {"query": "a", "from": "2024-1-1"}, {"query": "a", "to": "2024-02-30"}, {"query": "a", "x": 1}, {"query": "a", "site": "No"}, {"query": " "}):
        with pytest.raises((api.InvalidArguments, search.InvalidSearchQuery)) as e:
            archive.search_posts(**bad)
        assert api.failure(e.value) == str(e.value)
    assert api.failure(providers.ModelFailure("secret")) == "the embedding model failed" and "secret" not in api.failure(KeyError("secret"))
    with pytest.raises(api.ImageSearchFailed):
        archive.find_posts_like_image(image="https://h/a.png")


def test_image_queries(tmp_path):
    good = tmp_path / "a.PNG"
    good.write_bytes(b"x")
    assert api.image_query(f" {good} ") == ("LOCAL", str(good)) and api.image_query("https://h/a")[0] == "REMOTE"
    for bad, why in (("a.png", "NOT_ABSOLUTE_PATH"), ("/x/a.txt", "UNSUPPORTED_EXTENSION"), ("/x/none.png", "NOT_A_READABLE_FILE"), ("http://h/a", "NOT_HTTPS"), ("https:///a", "MALFORMED_URL"), ("https://h/a b", "MALFORMED_URL")):
        with pytest.raises(api.InvalidImageQuery, match=why):
            api.image_query(bad)


def test_listing_source(spark, tmp_path):
    spark.dataSource.register(platforms.Listing)
    for n, k in ((1, 100), (2, 100), (3, 5)):
        (tmp_path / f"page-{n}.json").write_text(json.dumps([{"id": 1000 * n + i} for i in range(k)]))
    read = spark.read.format("blog_listing").option("platform", "wordpress").option("recorded", str(tmp_path))
    assert read.load().count() == 205
    (tmp_path / "total.txt").write_text("2")
    assert read.load().agg(F.max("page")).first()[0] == 2
    (tmp_path / "total.txt").unlink()
    (tmp_path / "page-1.json").write_text('{"feed": {"openSearch$totalResults": {"$t": "9"}, "entry": [{"id": {"$t": "x"}}]}}')
    assert spark.read.format("blog_listing").option("platform", "BLOGGER").option("recorded", str(tmp_path)).load().collect()[0].json == '{"id": {"$t": "x"}}'
    with pytest.raises(platforms.SourceUnavailable):
        platforms.entries_of("WORDPRESS", {"code": "x"}, {})
    assert platforms.address("BLOGGER", "https://h/", 2, None).endswith("max-results=150&start-index=151&orderby=updated")


def test_stores(spark, tmp_path):
    p = spark.createDataFrame([post("s:1", images=[("https://h/i", "a", "")]), post("s:2", tags=None)], POST)
    stores.save_posts(p, f"{tmp_path}/posts")
    stores.save_posts(spark.createDataFrame([post("r:1", site_id="r")], POST), f"{tmp_path}/posts")
    good, bad = stores.load_posts(spark, f"{tmp_path}/posts")
    assert {tuple(r) for r in good.select("post_id", "updated_at").collect()} == {(x, T0.replace(tzinfo=None)) for x in ("s:1", "s:2", "r:1")} or good.count() == 3
    assert good.where("post_id = 's:1'").first().images[0].url == "https://h/i" and stores.health(bad).first()[0] == "HEALTHY"


def test_streaming(spark, tmp_path):
    rows = [(1, 1, "view"), (1, 2, "signup"), (2, 3, "view"), (2, 4, "error"), (3, 5, "signup"), (3, 6, "click"), (1, 7, "purchase")]
    df = spark.createDataFrame([(u, i, dt.datetime(2024, 1, 1, 0, i), t, float(i)) for u, i, t in rows], "user_id long, event_id long, ts timestamp_ntz, event_type string, value double")
    for k in range(3):
        df.where(F.expr(f"event_id > {k * 3} and event_id <= {k * 3 + 3}")).coalesce(1).write.parquet(f"{tmp_path}/events.parquet/part={k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events.parquet/*")
    got = feed.run(feed.entries(stream), f"file://{tmp_path}/state")
    assert {(r.key, r.content) for r in got.collect()} == {(1, "purchase|7.0"), (2, "view|3.0"), (3, "click|6.0")}
    log = feed.cycle([("reconcile", lambda: 1), ("sync", lambda: 1 / 0), ("reconcile", lambda: 1)])
    assert log == {"0:reconcile": "done", "1:sync": "failed: division by zero", "2:reconcile": "done"}

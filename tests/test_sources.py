"""Landed feeds, item lists, repositories and pages to raw articles."""

import datetime as dt
import hashlib
import random
import re

from pyspark.sql import functions as F

from newslake import config
from newslake.operators import feeds, ingest, similarity
from newslake.sources import landing, page_text, sinks

NOW = dt.datetime(2024, 1, 31)


def now():
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def test_standard_feed_items(spark, tmp_path):
    (tmp_path / "f.xml").write_text("""<rss xmlns:dc="d" xmlns:media="m" xmlns:content="c"><channel>
    <item><title>A</title><link>l1</link><description></description><content:encoded>body</content:encoded><pubDate>Mon, 29 Jan 2024 10:00:00 GMT</pubDate><dc:creator>Ann</dc:creator>
      <category>x</category><category>y</category><media:content url="i1"/><media:thumbnail url="i2"/></item>
    <item><title>B</title><link>l2</link><pubDate>Tue, 30 Jan 2024 10:00:00 +0200</pubDate><author>Bob</author><media:thumbnail url="i2"/><enclosure url="i3"/></item>
    <item><link>l3</link><isoDate>2024-01-28T01:02:03Z</isoDate><enclosure url="i3"/></item>
    <item><title>D</title><pubDate>soon</pubDate></item></channel></rss>""")
    got = {r.url: r for r in landing.feed(spark, str(tmp_path / "f.xml")).collect()}
    assert got["l1"].published_at == dt.datetime(2024, 1, 29, 10) and (got["l1"].author, got["l1"].content, got["l1"].image_url, got["l1"].categories) == ("Ann", "body", "i1", ["x", "y"])
    assert got["l2"].published_at == dt.datetime(2024, 1, 30, 8) and (got["l2"].author, got["l2"].image_url) == ("Bob", "i2")
    assert got["l3"].published_at == dt.datetime(2024, 1, 28, 1, 2, 3) and (got["l3"].title, got["l3"].image_url) == ("", "i3")
    assert got[""].published_at is None and got[""].title == "D"


def test_atom_entries(spark, tmp_path):
    (tmp_path / "a.xml").write_text("""<feed><entry><title>A</title><link href="self" rel="self"/><link href="u"/><summary>s</summary><updated>2024-01-05T00:00:00Z</updated><author><name>Ann</name></author><category term="t"/></entry></feed>""")
    r = landing.atom(spark, str(tmp_path / "a.xml")).first()
    assert (r.title, r.url, r.content, r.author, r.categories, r.published_at) == ("A", "u", "s", "Ann", ["t"], dt.datetime(2024, 1, 5))


def test_item_lists_keep_the_first_of_each_url(spark):
    items = spark.createDataFrame([(k, f"u{k // 2}") for k in range(200)], "item_id long, url string")
    lists = [("best", p, 10 + p) for p in range(25)] + [("new", p, p) for p in range(40)] + [("top", p, 60 + p) for p in range(60)] + [("other", 0, 199)]
    got = landing.listed_items(items, spark.createDataFrame(lists, "list string, pos int, item_id long")).collect()
    want, seen = [], set()
    for name, most in landing.ITEM_LISTS:
        for n, p, i in sorted(lists, key=lambda x: x[1]):
            if n == name and p < most and i // 2 not in seen:
                seen.add(i // 2)
                want.append(i)
    assert sorted(r.item_id for r in got) == sorted(want)


def test_repositories(spark):
    page = """<article><h2><a href="/ann/rocket">ann / rocket</a></h2><p class="col-9">Fast <b>things</b></p><span itemprop="programmingLanguage">C++</span>
    <a href="/ann/rocket/stargazers"><svg></svg> 1,234,567</a><a href="/ann/rocket/forks">89</a>
    <a href="/bob" data-hovercard-type="user"><img alt="@bob" src="pic"></a><span class="d-inline-block float-sm-right"><svg></svg> 1,024 stars today</span></article><article><p>no link</p></article>"""
    df = spark.createDataFrame([(page,), (None,)], "html string")
    r = landing.repository_pages(df).first()
    assert (r.author, r.name, r.description, r.language, r.stars, r.forks, r.stars_today) == ("ann", "rocket", "Fast things", "C++", 1234567, 89, 1024)
    assert [tuple(b) for b in r.built_by] == [("bob", "https://github.com/bob", "pic")]
    a = landing.repository_articles(landing.repository_pages(df), now()).first()
    assert a.title == "[GitHub Trending] ann/rocket: Fast things" and a.summary == "⭐ 1,234,567 stars | 1024 today | 89 forks | C++"
    assert a.categories == ["technology", "github", "opensource", "c"] and a.image_url == "pic" and a.source_id == "github-trending"


def test_active_sources(spark):
    rows = [("a", "ai", True, 3), ("b", "ai", False, 9), ("c", "sec", True, 5)]
    df = spark.createDataFrame(rows, "source_id string, category string, is_active boolean, priority int")
    assert [r.source_id for r in landing.active_sources(df).collect()] == ["c", "a"]
    assert [r.source_id for r in landing.active_sources(df, "ai").collect()] == ["a"]


def test_page_text(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><nav>menu</nav><header>top</header><div class="read">dropped by a part</div><div id="promo-1"><p>buy<p>now</div>
    <p>One &amp; <b>two</b><p class=x>Three<ul><li>a<li class="ad">b<li>c</ul><noscript>n</noscript><br>end <i>Read more: </i></body></html>"""
    got = {r.k: r.t for r in spark.createDataFrame([(1, page), (2, None), (3, "")], "k int, html string").select("k", page_text.page_text(F.col("html")).alias("t")).collect()}
    assert got == {1: "T One & twoThreeacend", 2: "", 3: ""}


def test_page_text_against_a_plain_version():
    """Well-formed random trees: the text outside unwanted elements, by recursion."""
    r = random.Random(3)

    def tree(depth):
        if depth == 0 or r.random() < 0.3:
            word = f"w{r.randrange(1000)} "
            return word, word
        tag, named = r.choice(["div", "span", "nav", "footer", "section", "aside", "b"]), r.choice(["", "", ' class="x"', ' id="sponsored"', ' class="a shadow"'])
        parts = [tree(depth - 1) for _ in range(r.randint(1, 4))]
        gone = tag in page_text.UNWANTED or any(p in named.split("=")[-1] for p in page_text.UNWANTED_PARTS)
        return f"<{tag}{named}>{''.join(p[0] for p in parts)}</{tag}>", "" if gone else "".join(p[1] for p in parts)

    for _ in range(200):
        html, want = tree(5)
        assert page_text.text_of(html) == want


def test_union_of_sources_and_ingest(spark):
    """Rows of sources with different columns; the first of a batch stays, and a source of tech only is not filtered."""
    a = spark.createDataFrame([(1, "Python software release", "http://a.com/x", "text one " * 30, "Blog", "blog"), (2, "Python software release", "http://a.com/x/", "text one " * 30, "Blog", "blog"), (3, "Nothing here", "http://a.com/y", "plain", "Blog", "blog")], "raw_id long, title string, url string, content string, source_name string, source_id string")
    b = spark.createDataFrame([(4, "Some repo", "http://g.com/r", "github-trending", "Trending", ["x"]), (5, None, "http://g.com/n", "github-trending", "Trending", ["x"])], "raw_id long, title string, url string, source_id string, source_name string, categories array<string>")
    raw = ingest.union_sources(a, b).selectExpr("*", "cast(null as string) summary", "cast(null as timestamp) published_at", "cast(null as string) author", "cast(null as string) image_url")
    store = spark.createDataFrame([(9, "Old", "x", "http://g.com/r")], "article_id long, title string, content string, source_url string")
    out = ingest.ingest(raw, store, now())
    got = {r.article_id: (r.match_type, r.matched_id, r.matched_raw_id) for r in out.collect()}
    assert got == {1: ("none", None, None), 2: ("url", None, 1), 4: ("url", 9, None), 5: ("error", None, None)}
    totals = {r.source_name: (r.fetched, r.added, r.duplicates, r.errors) for r in ingest.totals(raw, out).collect()}
    assert totals == {"Blog": (3, 1, 1, 0), "Trending": (2, 0, 1, 1), None: (5, 1, 2, 1)}
    assert re.match("[0-9a-f]{32}$", ingest.added(out).first().fingerprint)


def test_daily_feed_log_and_expiry(spark, tmp_path):
    top = spark.createDataFrame([(1, 0.5), (2, 0.4)], "article_id long, final_score double")
    feed = str(tmp_path / "feed")
    for day, rows in (("2024-01-30", top), ("2024-01-31", top), ("2024-01-31", top.where("article_id = 2"))):
        sinks.write_daily_feed(rows, F.lit(day), feed)
    got = spark.read.parquet(feed).select("article_id", F.col("feed_date").cast("string")).collect()
    assert sorted(map(tuple, got)) == [(1, "2024-01-30"), (2, "2024-01-30"), (2, "2024-01-31")]
    log = str(tmp_path / "log")
    sinks.append_log(top, log)
    sinks.append_log(top, log)
    assert spark.read.parquet(log).count() == 4
    rows = spark.createDataFrame([(1, NOW), (2, NOW - dt.timedelta(days=31)), (3, None)], "article_id long, published_at timestamp")
    cut = now() - F.expr("INTERVAL 30 DAYS")
    assert [r.article_id for r in sinks.expire(rows, cut).collect()] == [1]
    assert tuple(feeds.deleted_before(rows, cut).first()) == (1, 2)


def test_cluster_ids_of_any_size(spark):
    group = spark.range(30_000).selectExpr("id node", "0L component").union(spark.range(60, 63).selectExpr("id", "60L")).union(spark.range(7, 9).selectExpr("id", "7L"))
    want = {0: range(30_000), 60: range(60, 63), 7: (7, 8)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)  # a cluster over many batches, and many a batch
    try:
        for rows in (group, group.repartition(7)):
            ids = {r.component: r.cluster_id for r in similarity.cluster_ids(rows).collect()}
            assert ids == {k: hashlib.md5("|".join(sorted(map(str, v))).encode()).hexdigest()[:16] for k, v in want.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert similarity.cluster_ids(group.where("false")).count() == 0


def test_near_match_makes_or_joins_a_cluster(spark):
    body = "word " * 60
    rows = [(1, "Google releases quantum chip today", body, "http://a/1", "c1"), (2, "Google releases quantum chip now again", body, "http://a/2", None)]
    store = spark.createDataFrame(rows, "article_id long, title string, content string, source_url string, cluster_id string")
    new = [(9, "Google releases quantum chip today ok", body, "http://a/9"), (8, "Google releases quantum chip now", body, "http://a/8"), (7, "Unlike anything", body, "http://a/7"), (6, "x", "y", "http://a/1/")]
    batch = spark.createDataFrame(new, "article_id long, title string, content string, source_url string")
    got = {r.article_id: (r.action, r.matched_id) for r in similarity.duplicate_decisions(batch, store).collect()}
    assert got[6] == ("skip", 1) and got[7] == ("store_new", None)
    assert {got[9][0], got[8][0]} <= {"skip", "add_to_cluster", "create_cluster"}
    near = {a: m for a, (action, m) in got.items() if action.endswith("cluster")}
    assert all(got[a][0] == ("add_to_cluster" if m == 1 else "create_cluster") for a, m in near.items())
    matches = similarity.duplicate_matches(batch, store, config.Clustering(max_comparisons=1)).collect()
    assert all(r["rank"] == 1 for r in matches) and len({r.article_id for r in matches}) == len(matches)

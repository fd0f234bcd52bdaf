"""Registered queries of sources and sinks: tables landed as JSON, XML and HTML files and read in again, the article store
by day, appends, daily feeds and logs. What they write lies beside the session's checkpoints, by a new name each time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslake import config
from newslake.operators.dedupe import keyed
from newslake.plans.ingesting import CUT
from newslake.plans.queries import _FINGERPRINT, day, query, sql_day
from newslake.sources import files, landing, sinks, store
from newslake.streaming import landed
from newslake.views import ARTICLE_SQL, articles, as_of, bare_articles, table

NOW = f"TIMESTAMP '{config.AS_OF}'"
_SITE = "https://s.example.com/"


def _story(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stories: id, title (null for every 13th), body ('' for every 7th), url ('' for every 11th), at."""
    i = F.col("article_id")
    return bare_articles(spark, sf_dir).select(
        i.alias("id"), F.when(i % 13 != 0, F.regexp_replace("title", r"[^\w .,]", "")).alias("title"), F.when(i % 7 != 0, F.regexp_replace(F.substring("content", 1, 400), r"[^\w .,]", " ")).otherwise("").alias("body"),
        F.when(i % 11 != 0, F.concat(F.lit(_SITE), i.cast("string"))).otherwise("").alias("url"), F.col("published_at").alias("at"),
    )


_STORY = f"""WITH {ARTICLE_SQL}, story AS (SELECT article_id AS id, CASE WHEN article_id % 13 <> 0 THEN regexp_replace(title, '[^\\w .,]', '', 'g') END AS title,
  CASE WHEN article_id % 7 <> 0 THEN regexp_replace(substring(content, 1, 400), '[^\\w .,]', ' ', 'g') ELSE '' END AS body, CASE WHEN article_id % 11 <> 0 THEN '{_SITE}' || CAST(article_id AS VARCHAR) ELSE '' END AS url, published_at AS pub FROM article)"""
_ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _payloads(rows: DataFrame, author: bool) -> DataFrame:
    """Stories as news payloads, one JSON object a line with a list of articles."""
    i = F.col("id")
    source = F.when(i % 5 == 0, F.struct(F.lit("").alias("name"))).otherwise(F.struct(F.concat(F.lit("Paper "), (i % 3).cast("string")).alias("name")))
    one = F.struct("title", "url", F.col("body").alias("content"), F.concat(F.lit("About "), i.cast("string")).alias("description"), source.alias("source"), F.date_format("at", _ISO).alias("publishedAt"), *([F.concat(F.lit("by "), i.cast("string")).alias("author"), F.lit("https://i.example.com/x.png").alias("urlToImage")] if author else [F.lit("https://i.example.com/y.png").alias("image")]))
    return rows.groupBy(F.floor(i / 1000).alias("page")).agg(F.to_json(F.struct(F.collect_list(one).alias("articles"))).alias("value")).select("value")


_NEWS = _STORY + """ SELECT title, url, md5(CASE WHEN body <> '' THEN body ELSE 'About ' || CAST(id AS VARCHAR) END) AS content_md5, CASE WHEN id % 5 = 0 THEN '{name}' ELSE 'Paper ' || CAST(id % 3 AS VARCHAR) END AS source_name, {author} AS author, {image} AS image_url, {at} AS published
  FROM story WHERE coalesce(title, '') <> '' AND url <> ''"""


def _news(spark: SparkSession, sf_dir: str, name: str, author: bool) -> DataFrame:
    """Landed in two parts and read as a file stream after each, so the second run reads the new files alone."""
    rows = _story(spark, sf_dir)
    root = files.scratch(spark, "news")
    for part in (0, 1):
        _payloads(rows.where(F.col("id") % 2 == part), author).write.mode("append").text(f"{root}/in")
        landed.append_new_files(landed.news(spark, f"{root}/in", name, author), f"{root}/out", f"{root}/checkpoint")
    out = spark.read.parquet(f"{root}/out")
    return out.select("title", "url", F.md5("content").alias("content_md5"), "source_name", "author", "image_url", day("published_at").alias("published"))


@query(_NEWS.format(name="NewsAPI", author="'by ' || CAST(id AS VARCHAR)", image="'https://i.example.com/x.png'", at=sql_day("pub")))
def landed_news(spark, sf_dir):
    return _news(spark, sf_dir, "NewsAPI", True)


@query(_NEWS.format(name="GNews", author="CAST(NULL AS VARCHAR)", image="'https://i.example.com/y.png'", at=sql_day("pub")))
def landed_news_second(spark, sf_dir):
    return _news(spark, sf_dir, "GNews", False)


@query(_STORY + f""" SELECT id AS item_id, coalesce(title, 'Untitled') AS title, url, md5(body) AS content_md5, md5(substring(body, 1, 300)) AS summary_md5, {sql_day('pub')} AS published, CAST(id % 90 AS VARCHAR) AS score, CAST(id % 17 AS VARCHAR) AS comments FROM story WHERE id % 4 <> 0 AND url <> ''""")
def landed_items(spark, sf_dir):
    i, root = F.col("id"), files.scratch(spark, "items")
    rows = _story(spark, sf_dir).select("id", F.when(i % 4 == 0, "job").otherwise("story").alias("type"), "title", "url", F.col("body").alias("text"), F.lit("someone").alias("by"), (i % 90).alias("score"), (i % 17).alias("descendants"), F.unix_timestamp("at").alias("time"))
    rows.write.json(root)
    out = landing.link_items(spark, root)
    return out.select("item_id", "title", "url", F.md5("content").alias("content_md5"), F.md5("summary").alias("summary_md5"), day("published_at").alias("published"), F.col("metadata")["score"].alias("score"), F.col("metadata")["comments"].alias("comments"))


@query(_STORY + f""" SELECT trim(title) AS title, url, md5(CASE WHEN id % 2 = 0 THEN 'About ' || CAST(id AS VARCHAR) ELSE 'Body ' || CAST(id AS VARCHAR) END) AS content_md5, {sql_day('pub')} AS published, 'writer ' || CAST(id % 9 AS VARCHAR) AS author, CASE WHEN id % 3 <> 0 THEN 'https://i.example.com/' || CAST(id AS VARCHAR) END AS image_url FROM story WHERE trim(title) <> '' AND url <> ''""")
def landed_feed(spark, sf_dir):
    i, root = F.col("id"), files.scratch(spark, "feed")
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    number = i.cast("string")
    body = F.when(i % 2 == 0, tag("description", F.concat(F.lit("About "), number))).otherwise(tag("content:encoded", F.concat(F.lit("Body "), number)))
    image = F.when(i % 3 == 1, F.concat(F.lit('<media:thumbnail url="https://i.example.com/'), number, F.lit('"/>'))).when(i % 3 == 2, F.concat(F.lit('<enclosure url="https://i.example.com/'), number, F.lit('"/>'))).otherwise("")
    rows = _story(spark, sf_dir).where("trim(title) <> '' and url <> ''")
    item = tag("item", F.concat(tag("title", F.trim("title")), tag("link", F.col("url")), body, tag("pubDate", F.date_format("at", "EEE, d MMM yyyy HH:mm:ss 'GMT'")), tag("dc:creator", F.concat(F.lit("writer "), (i % 9).cast("string"))), image))
    open_ = '<rss xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:media="http://search.yahoo.com/mrss/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>'
    feeds = rows.groupBy(F.floor(i / 1000).alias("page")).agg(F.concat(F.lit(open_), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("value"))
    feeds.write.partitionBy("page").text(root)  # a feed a file
    out = landing.feed(spark, root)
    return out.select("title", "url", F.md5("content").alias("content_md5"), day("published_at").alias("published"), "author", "image_url")


@query(_STORY + """ SELECT 'owner' || CAST(id % 40 AS VARCHAR) AS author, 'repo' || CAST(id AS VARCHAR) AS name, md5(trim(coalesce(title, ''))) AS description_md5, CASE WHEN id % 5 <> 0 THEN 'Language' || CAST(id % 5 AS VARCHAR) END AS language, id * 1117 AS stars, id * 13 AS forks, CAST(id % 1300 AS BIGINT) AS stars_today FROM story""")
def landed_repositories(spark, sf_dir):
    i, root = F.col("id"), files.scratch(spark, "repositories")
    number = lambda x: F.format_number(x, 0)
    path = F.concat(F.lit("/owner"), (i % 40).cast("string"), F.lit("/repo"), i.cast("string"))
    language = F.when(i % 5 != 0, F.concat(F.lit('<span itemprop="programmingLanguage">Language'), (i % 5).cast("string"), F.lit("</span>"))).otherwise("")
    row = F.concat(F.lit('<article><h2><a href="'), path, F.lit('">x</a></h2><p>'), F.coalesce("title", F.lit("")), F.lit("</p>"), language, F.lit('<a href="'), path, F.lit('/stargazers">'), number(i * 1117), F.lit('</a><a href="'), path, F.lit('/forks">'), number(i * 13), F.lit('</a><span class="d-inline-block float-sm-right">'), number(i % 1300), F.lit(" stars today</span></article>"))
    pages = _story(spark, sf_dir).groupBy(F.floor(i / 1000).alias("page")).agg(F.concat(F.lit("<html><body>"), F.array_join(F.collect_list(row), ""), F.lit("</body></html>")).alias("value")).select("value")
    pages.write.text(root)
    out = landing.repository_pages(spark.read.option("wholetext", True).text(root).select(F.explode(F.split("value", "(?<=</html>)\\s*")).alias("html")))
    return out.select("author", "name", F.md5("description").alias("description_md5"), "language", "stars", "forks", "stars_today")


@query(f"WITH {ARTICLE_SQL}, src AS (SELECT source_name AS source_id, max(category_slug) AS category, count(*) AS priority, source_name <> 'src3' AS is_active FROM article GROUP BY 1) SELECT source_id, category, priority FROM src WHERE is_active AND category = 'fr' UNION ALL SELECT source_id, category, priority FROM src WHERE is_active")
def source_registry(spark, sf_dir):
    registry = bare_articles(spark, sf_dir).groupBy(F.col("source_name").alias("source_id")).agg(F.max("category_slug").alias("category"), F.count("*").alias("priority")).withColumn("is_active", F.col("source_id") != "src3")
    columns = ("source_id", "category", "priority")
    return landing.active_sources(registry, "fr").select(*columns).union(landing.active_sources(registry).select(*columns))


# ---- the article store ------------------------------------------------------------------------------------------
def _stored(spark: SparkSession, sf_dir: str) -> str:
    path = files.scratch(spark, "articles")
    rows = bare_articles(spark, sf_dir).select("article_id", "title", "published_at", ((F.col("article_id") * 13) % 101).cast("double").alias("score"))
    store.append(rows, path)
    return path


@query(f"WITH {ARTICLE_SQL} SELECT article_id, title, {sql_day('published_at')} AS published FROM article WHERE published_at >= {NOW} - INTERVAL 72 HOUR")
def store_window(spark, sf_dir):
    return store.window(spark, _stored(spark, sf_dir), as_of(), 72).select("article_id", "title", day("published_at").alias("published"))


@query(f"WITH {ARTICLE_SQL} SELECT article_id, CASE WHEN published_at >= {NOW} - INTERVAL 30 HOUR AND article_id % 3 = 0 THEN -1.0::DOUBLE ELSE CAST(article_id * 13 % 101 AS DOUBLE) END AS score FROM article")
def store_updates(spark, sf_dir):
    path = _stored(spark, sf_dir)
    changes = store.window(spark, path, as_of(), 30).where("article_id % 3 = 0").select("article_id", F.lit(-1.0).alias("score"))
    store.update(spark, path, changes, "article_id", ["score"])
    return spark.read.parquet(path).select("article_id", "score")


@query(f"WITH {ARTICLE_SQL} SELECT article_id, {sql_day('published_at')} AS published FROM article WHERE published_at >= {NOW} - INTERVAL 50 HOUR")
def store_expiry(spark, sf_dir):
    path = _stored(spark, sf_dir)
    store.expire(spark, path, as_of() - F.expr("INTERVAL 50 HOURS"))
    return spark.read.parquet(path).select("article_id", day("published_at").alias("published"))


@query(f"""WITH {ARTICLE_SQL}, k AS (SELECT article_id, source_url, {_FINGERPRINT} AS fingerprint, published_at >= TIMESTAMP '{CUT}' AS late FROM article),
a1 AS (SELECT *, min(article_id) OVER (PARTITION BY source_url) AS u FROM k WHERE NOT late), a2 AS (SELECT *, min(article_id) OVER (PARTITION BY fingerprint) AS f FROM a1 WHERE u = article_id), a AS (SELECT * FROM a2 WHERE f = article_id),
b1 AS (SELECT *, min(article_id) OVER (PARTITION BY source_url) AS u FROM k WHERE late AND source_url NOT IN (SELECT source_url FROM a)), b2 AS (SELECT *, min(article_id) OVER (PARTITION BY fingerprint) AS f FROM b1 WHERE u = article_id AND fingerprint NOT IN (SELECT fingerprint FROM a))
SELECT article_id FROM a UNION ALL SELECT article_id FROM b2 WHERE f = article_id""")
def insert_new(spark, sf_dir):
    path = files.scratch(spark, "inserted")
    rows = articles(spark, sf_dir)
    rows = rows.join(keyed(rows).select("article_id", "fingerprint"), "article_id").select("article_id", "source_url", "fingerprint", "published_at")
    sinks.append_new(rows.where(f"published_at < timestamp'{CUT}'"), None, path)
    sinks.append_new(rows.where(f"published_at >= timestamp'{CUT}'"), spark.read.parquet(path), path)
    return spark.read.parquet(path).select("article_id")


@query(f"WITH {ARTICLE_SQL}, r AS (SELECT article_id, strftime(published_at, '%Y-%m-%d') AS feed_date, article_id * 13 % 101 AS score FROM article), o AS (SELECT *, row_number() OVER (PARTITION BY feed_date ORDER BY score DESC, article_id) AS rank FROM r) SELECT feed_date, article_id, rank FROM o WHERE rank <= 5")
def daily_feed_table(spark, sf_dir):
    """Each day's five best, written day by day; the last day is written twice and replaces itself alone."""
    path = files.scratch(spark, "feeds")
    rows = bare_articles(spark, sf_dir).select("article_id", F.to_date("published_at").alias("d"), ((F.col("article_id") * 13) % 101).alias("score"))
    days = [r[0] for r in rows.select("d").distinct().orderBy("d").collect()]  # a handful
    for d in [*days, *days[-1:]]:
        top = rows.where(F.col("d") == F.lit(d)).orderBy(F.desc("score"), "article_id").limit(5)
        place = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "article_id")))
        ranked = top.agg(place.alias("l")).select(F.posexplode("l").alias("pos", "x")).select(F.col("x.article_id").alias("article_id"), (F.col("pos") + 1).cast("long").alias("rank"))
        sinks.write_daily_feed(ranked, F.lit(d), path)
    return spark.read.parquet(path).select(F.col("feed_date").cast("string").alias("feed_date"), "article_id", "rank")


@query("SELECT event_type AS kind, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY 1")
def notification_log(spark, sf_dir):
    path = files.scratch(spark, "log")
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"))
    for part in range(3):
        sinks.append_log(events.where(F.col("event_id") % 3 == part), path)
    return spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))

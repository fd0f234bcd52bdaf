"""Landed files to raw articles: two JSON news payloads, link-aggregator items, feeds in XML, and pages of repositories."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslake.operators.dedupe import in_list_order

NEWS = "articles array<struct<title:string,url:string,content:string,description:string,author:string,urlToImage:string,image:string,publishedAt:string,source:struct<name:string,id:string,url:string>>>"
ITEM = "id long, type string, title string, url string, text string, by string, score long, descendants long, time long"


def _filled(*columns: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in columns], F.lit(""))


def news_json(spark: SparkSession, path: str, name: str, author: bool = True) -> DataFrame:
    """Rows with a title and a url; content falls back to the description, the source's name to `name`."""
    return news_rows(spark.read.schema(NEWS).option("multiLine", True).json(path), name, author)


def news_rows(payloads: DataFrame, name: str, author: bool = True, bad: str | None = None) -> DataFrame:
    """The same of parsed payloads; with bad, the column of unparsed text, rows that have it stay and have it alone."""
    a = payloads.select(F.explode_outer("articles").alias("a"), *([bad] if bad else []))
    rows = a.select(
        *([bad] if bad else []), "a.title", "a.url", _filled(F.col("a.content"), F.col("a.description")).alias("content"), _filled(F.col("a.description")).alias("summary"),
        F.coalesce(F.when(F.col("a.source.name") != "", F.col("a.source.name")), F.lit(name)).alias("source_name"),
        (F.col("a.author") if author else F.lit(None).cast("string")).alias("author"), F.coalesce("a.urlToImage", "a.image").alias("image_url"),
        F.try_to_timestamp("a.publishedAt").alias("published_at"), F.array(F.lit("technology")).alias("categories"),
    )
    whole = (F.coalesce("title", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")
    return rows.where(whole | F.col(bad).isNotNull() if bad else whole)


def link_items(spark: SparkSession, path: str) -> DataFrame:
    return item_rows(spark.read.schema(ITEM).json(path))


def item_rows(items: DataFrame) -> DataFrame:
    """The same of parsed items."""
    rows = items.where("type = 'story' and coalesce(url, '') <> ''")
    return rows.select(
        F.col("id").alias("item_id"), F.coalesce(F.when(F.col("title") != "", F.col("title")), F.lit("Untitled")).alias("title"), "url", _filled(F.col("text")).alias("content"),
        F.substring(_filled(F.col("text")), 1, 300).alias("summary"), F.timestamp_seconds("time").alias("published_at"), F.col("by").alias("author"),
        F.create_map(F.lit("score"), F.col("score").cast("string"), F.lit("comments"), F.col("descendants").cast("string")).alias("metadata"),
    )


#: The lists of items in their order, with how many of each are taken.
ITEM_LISTS = (("top", 50), ("new", 30), ("best", 20))


def listed_items(items: DataFrame, lists: DataFrame) -> DataFrame:
    """Items (item_id, url, ...) of lists (list, pos, item_id), the first of each list, in the order of ITEM_LISTS; of items
    with one url the first stays. At most 100 places are read, so the order is one small window."""
    order, most = F.lit(None).cast("int"), F.lit(0)
    for i, (name, n) in enumerate(ITEM_LISTS):
        order, most = F.when(F.col("list") == name, i).otherwise(order), F.when(F.col("list") == name, n).otherwise(most)
    places = lists.withColumn("list_order", order).where((F.col("pos") >= 0) & (F.col("pos") < most))
    return in_list_order(places.join(items, "item_id"), "url", ["list_order", "pos"])


FEED = (
    "title string, link string, description string, `content:encoded` string, pubDate string, isoDate string, creator string, `dc:creator` string, `dc:date` string, author string, category array<string>,"
    " `media:content` struct<_url:string>, `media:thumbnail` struct<_url:string>, enclosure struct<_url:string>"
)
ENTRY = "title string, link array<struct<_href:string,_rel:string>>, summary string, content string, published string, updated string, author struct<name:string>, category array<struct<_term:string>>"
#: Dates of feeds: "Mon, 29 Jan 2024 10:00:00 GMT" with the day left out, as its name need not be right; ISO dates.
_DATES = ("d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm z", "d MMM yyyy HH:mm Z")


def feed_date(x: Column) -> Column:
    bare = F.trim(F.regexp_replace(x, r"^\s*[A-Za-z]{3,9},\s*", ""))
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in _DATES], F.try_to_timestamp(x))


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS feeds."""
    rows = spark.read.format("xml").option("rowTag", "item").schema(FEED).load(path)
    c = lambda name: F.col(f"`{name}`")
    return rows.select(
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("link", F.lit("")).alias("url"), _filled(F.col("description"), c("content:encoded")).alias("content"),
        F.coalesce(feed_date(F.col("pubDate")), feed_date(F.col("isoDate")), feed_date(c("dc:date"))).alias("published_at"), F.coalesce("creator", c("dc:creator"), "author").alias("author"),
        F.col("category").alias("categories"), F.coalesce(c("media:content")["_url"], c("media:thumbnail")["_url"], F.col("enclosure._url")).alias("image_url"),
    )


def atom(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feeds, as rows like those of feed; the link is the one without a rel, or the alternate."""
    rows = spark.read.format("xml").option("rowTag", "entry").schema(ENTRY).load(path)
    link = F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    return rows.select(
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce(link, F.lit("")).alias("url"), _filled(F.col("content"), F.col("summary")).alias("content"),
        F.coalesce(feed_date(F.col("published")), feed_date(F.col("updated"))).alias("published_at"), F.col("author.name").alias("author"),
        F.transform("category", lambda x: x["_term"]).alias("categories"), F.lit(None).cast("string").alias("image_url"),
    )


class _Repositories(HTMLParser):
    """Rows of a page that lists repositories in <article> elements."""

    def __init__(self):
        super().__init__()
        self.rows, self.row, self.field, self.depth = [], None, None, []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        href, kind = a.get("href") or "", (a.get("class") or "").split()
        if tag == "article":
            self.row = dict.fromkeys(("path", "description", "language", "stars", "forks", "today"), "") | {"built_by": []}
        elif self.row is not None:
            if tag == "a" and not self.row["path"] and href.count("/") == 2:
                self.row["path"] = href
            elif tag == "a" and a.get("data-hovercard-type") == "user":
                self.row["built_by"].append([href, "", ""])
            elif tag == "img" and self.row["built_by"] and not self.row["built_by"][-1][2]:
                self.row["built_by"][-1][1:] = [(a.get("alt") or "").replace("@", ""), a.get("src") or ""]
            elif tag == "p":
                self.field = "description"
            elif a.get("itemprop") == "programmingLanguage":
                self.field = "language"
            elif tag == "a" and href.endswith("/stargazers"):
                self.field = "stars"
            elif tag == "a" and href.endswith("/forks"):
                self.field = "forks"
            elif "float-sm-right" in kind:
                self.field = "today"

    def handle_data(self, data):
        if self.row is not None and self.field:
            self.row[self.field] += data

    def handle_endtag(self, tag):
        if tag == "article" and self.row is not None:
            self.rows.append(self.row)
            self.row = None
        if tag not in ("svg", "path", "img", "b", "i", "em", "strong"):
            self.field = None


REPOSITORY = "author string, name string, url string, description string, language string, stars string, forks string, today string, built_by array<struct<username:string,href:string,avatar:string>>"


def repository_pages(pages: DataFrame, html_col: str = "html", site: str = "https://github.com") -> DataFrame:
    """One row per repository; all commas of a number are dropped (the first alone would misread 1,234,567)."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for html in part[html_col]:
                p = _Repositories()
                p.feed(html or "")
                for r in p.rows:
                    if r["path"]:
                        _, author, name = r["path"].split("/")
                        built = [{"username": u, "href": site + h, "avatar": i} for h, u, i in r["built_by"]]
                        out.append((author, name, site + r["path"], r["description"].strip(), r["language"].strip() or None, r["stars"].strip(), r["forks"].strip(), r["today"].strip(), built))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in REPOSITORY.split(", ")])

    rows = pages.select(html_col).mapInPandas(parse, REPOSITORY)
    number = lambda x: F.coalesce(F.expr(f"try_cast(regexp_replace({x}, ',', '') as long)"), F.lit(0))
    today = "regexp_extract(today, '([0-9][0-9,]*)[ ]+stars', 1)"
    return rows.withColumns({"stars": number("stars"), "forks": number("forks"), "stars_today": number(today)}).drop("today")


def repository_articles(repositories: DataFrame, as_of: Column) -> DataFrame:
    """Repositories as raw articles of the trending source."""
    text = lambda n: F.format_number(n, 0)
    language = F.when(F.col("language") != "", F.col("language"))
    tag = F.coalesce(F.regexp_replace(F.lower(language), "[^a-z0-9]", ""), F.lit("general"))
    return repositories.select(
        F.concat(F.lit("[GitHub Trending] "), "author", F.lit("/"), "name", F.lit(": "), F.substring("description", 1, 100)).alias("title"), "url", F.col("description").alias("content"),
        F.concat(F.lit("⭐ "), text("stars"), F.lit(" stars | "), F.col("stars_today").cast("string"), F.lit(" today | "), text("forks"), F.lit(" forks"), F.coalesce(F.concat(F.lit(" | "), language), F.lit(""))).alias("summary"),
        F.lit("GitHub Trending").alias("source_name"), F.lit("github-trending").alias("source_id"), "author", F.get("built_by", F.lit(0))["avatar"].alias("image_url"), as_of.alias("published_at"),
        F.array(F.lit("technology"), F.lit("github"), F.lit("opensource"), tag).alias("categories"),
    )


def active_sources(registry: DataFrame, category: str | None = None) -> DataFrame:
    df = registry.where("is_active")
    return (df.where(F.col("category") == category) if category else df).orderBy(F.desc("priority"), "source_id")

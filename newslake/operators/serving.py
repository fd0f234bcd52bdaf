"""Rows that the reading services return: article, bookmark, history, category, notification and cluster projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslake import config
from newslake.functions.text import capitalized
from newslake.operators.feeds import offset_page, with_category

FEED_ROW = (
    "article_id", "title", "summary", "source_url", "source_name", "image_url", "category_name", "category_slug", "tags", "author", "published_at", "score", "read_time", "is_featured",
)


def feed_rows(articles: DataFrame, categories: DataFrame) -> DataFrame:
    return with_category(articles, categories).select(*FEED_ROW)


def detail_rows(articles: DataFrame, categories: DataFrame) -> DataFrame:
    return with_category(articles, categories).select(*FEED_ROW, "content", "view_count", "bookmark_count")


def news_rows(articles: DataFrame) -> DataFrame:
    """The older form, with its own names of source and score."""
    return articles.select(
        "article_id", "title", "summary", F.col("source_name").alias("source"), "source_url", "image_url", F.col("category_slug").alias("category"), "tags", "read_time",
        F.col("score").alias("relevance_score"), "published_at", "created_at",
    )


def bookmark_rows(bookmarks: DataFrame, articles: DataFrame, categories: DataFrame) -> DataFrame:
    """bookmarks with their article as a struct, null where it is missing."""
    a = with_category(articles, categories)
    fields = {"id": "article_id", "title": "title", "summary": "summary", "source": "source_name", "image_url": "image_url", "category": "category_name", "read_time": "read_time", "published_at": "published_at"}
    one = a.select("article_id", F.struct(*[F.col(c).alias(n) for n, c in fields.items()]).alias("article"))
    return bookmarks.join(one, "article_id", "left").select("bookmark_id", "user_id", "article", "folder", "notes", "created_at")


def bookmark_page(bookmarks: DataFrame, articles: DataFrame, categories: DataFrame, user_id, folder: str | None = None, page: int = 1, limit: int = 20) -> DataFrame:
    """A user's bookmarks, newest first; only the page's bookmarks are joined."""
    mine = bookmarks.where(F.col("user_id") == user_id)
    mine = mine.where(F.col("folder") == folder) if folder is not None else mine
    return bookmark_rows(offset_page(mine, [F.desc("created_at"), F.desc("bookmark_id")], page, limit), articles, categories)


def folder_list(bookmarks: DataFrame) -> DataFrame:
    """(user_id, folder, n) of each user's folders, by name."""
    return bookmarks.where("folder is not null").groupBy("user_id", "folder").agg(F.count("*").alias("n")).orderBy("user_id", "folder")


def bookmarked_ids(bookmarks: DataFrame) -> DataFrame:
    """(user_id, n, article_ids ascending and distinct)."""
    return bookmarks.groupBy("user_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("article_id")).alias("article_ids"))


def history_rows(history: DataFrame, articles: DataFrame, categories: DataFrame, first: int = 20) -> DataFrame:
    """history (user_id, read_history array<struct<article_id, read_at>>): the first entries with their articles, null
    where an article is missing."""
    rows = history.select("user_id", F.posexplode(F.slice("read_history", 1, first)).alias("pos", "x")).select("user_id", "pos", "x.article_id", "x.read_at")
    one = with_category(articles, categories).select("article_id", "title", "category_name")
    return rows.join(one, "article_id", "left").select("user_id", "pos", "article_id", "read_at", "title", "category_name")


def category_rows(categories: DataFrame) -> DataFrame:
    """Active categories in their order."""
    return categories.where("is_active").select("name", "slug", "description", "icon", "color", "article_count", "sort_order").orderBy("sort_order", "name")


def seed_categories(spark: SparkSession) -> DataFrame:
    """The dimension as first loaded; a load replaces all rows."""
    rows = [(*r, True) for r in config.CATEGORY_SEEDS]
    return spark.createDataFrame(rows, "slug string, name string, description string, icon string, color string, sort_order int, is_active boolean")


def by_key(key: Column, values: dict[str, str], default: str) -> Column:
    """A small dictionary with a default."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def with_new_categories(categories: DataFrame, slugs: DataFrame) -> DataFrame:
    """categories and a row for each slug of slugs (slug) that has none yet."""
    new = slugs.select("slug").where("slug is not null").distinct().join(categories.select("slug"), "slug", "left_anti")
    icon, color, order = config.CATEGORY_DEFAULT
    slug, name = F.col("slug"), capitalized(F.col("slug"))
    rows = new.select(
        "slug", name.alias("name"), F.concat(name, F.lit(" news and articles")).alias("description"), by_key(slug, config.CATEGORY_ICONS, icon).alias("icon"),
        by_key(slug, config.CATEGORY_COLORS, color).alias("color"), F.lit(order).alias("sort_order"), F.lit(True).alias("is_active"),
    )
    return categories.unionByName(rows)


def notification_titles(log: DataFrame, articles: DataFrame) -> DataFrame:
    """(notification_id, titles): titles of each notification's article_ids in their order; missing articles are left out."""
    ids = log.select("notification_id", F.posexplode("article_ids").alias("pos", "article_id"))
    found = ids.join(articles.select("article_id", "title"), "article_id").groupBy("notification_id").agg(F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("t"))
    empty = F.expr("cast(array() as array<string>)")
    return log.select("notification_id").join(found, "notification_id", "left").select("notification_id", F.coalesce(F.transform("t", lambda x: x["title"]), empty).alias("titles"))


def notification_history(log: DataFrame, kind: str | None = None, status: str | None = None, page: int = 1, limit: int = 20) -> DataFrame:
    """Newest first, without the tokens."""
    log = log.where(F.col("type") == kind) if kind else log
    log = log.where(F.col("status") == status) if status else log
    return offset_page(log.drop("device_tokens"), [F.desc("created_at"), F.desc("notification_id")], page, limit, 100)


def users_of_token(users: DataFrame, token: str) -> DataFrame:
    return users.where(F.array_contains("device_tokens", token))


def notifiable(users: DataFrame) -> DataFrame:
    return users.where("notifications_enabled and size(device_tokens) > 0")


def user_counts(users: DataFrame) -> DataFrame:
    """All, active, and notifiable users."""
    return users.agg(F.count("*").alias("users"), F.count_if("is_active").alias("active"), F.count_if(F.expr("notifications_enabled and size(device_tokens) > 0")).alias("notifiable"))


def of_ids(articles: DataFrame, ids: DataFrame) -> DataFrame:
    return articles.join(ids.select("article_id").distinct(), "article_id", "left_semi")


def cluster_list(clusters: DataFrame, limit: int = 50) -> DataFrame:
    """Clusters of two or more, the largest first; filtered before the limit, ties by id."""
    return clusters.where("size >= 2").orderBy(F.desc("size"), "cluster_id").limit(limit)

"""Reader activity: bookmarks, read history, device tokens, recipients and send waves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bookmark_state(toggles: DataFrame) -> DataFrame:
    """toggles (user_id, article_id): bookmarked after an odd number of them."""
    return toggles.groupBy("user_id", "article_id").agg((F.count("*") % 2 == 1).alias("bookmarked"))


def bulk_bookmarked(ids: DataFrame, bookmarks: DataFrame) -> DataFrame:
    marks = bookmarks.select("user_id", "article_id").distinct().withColumn("_m", F.lit(True))
    return ids.join(marks, ["user_id", "article_id"], "left").withColumn("bookmarked", F.coalesce("_m", F.lit(False))).drop("_m")


def folder_counts(bookmarks: DataFrame, user_col: str = "user_id") -> DataFrame:
    return bookmarks.groupBy(user_col, "folder").agg(F.count("*").alias("n"))


def read_history(reads: DataFrame, most: int = 100) -> DataFrame:
    """Latest read of each article by user, the most recent `most`. Reads are reduced to one per article first."""
    last = reads.groupBy("user_id", "article_id").agg(F.max("read_at").alias("read_at"))
    w = Window.partitionBy("user_id").orderBy(F.desc("read_at"), "article_id")
    return last.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= most)


def token_owner(events: DataFrame) -> DataFrame:
    """events (token, user_id, op, ts, event_id): a token is its last registering user's; gone if unregistered last."""
    last = events.groupBy("token").agg(F.max_by(F.struct("user_id", "op"), F.struct("ts", "event_id")).alias("x"))
    return last.where("x.op = 'register'").select("token", "x.user_id")


def recipients(users: DataFrame, as_of: Column, kind: str = "digest", category: str | None = None) -> DataFrame:
    """Active users with notifications on and a token; digests within an hour of their preferred hour (no midnight wrap,
    an unparsable hour passes), topic alerts where `categories` has the category."""
    df = users.where("is_active and notifications_enabled and size(device_tokens) > 0")
    if kind == "topic":
        return df.where(F.array_contains("categories", category))
    hour = F.expr("try_cast(split(notification_time, ':')[0] as int)")
    return df.where(hour.isNull() | (F.abs(hour - F.hour(as_of)) <= 1)) if kind == "digest" else df


def distinct_tokens(df: DataFrame) -> DataFrame:
    return df.select(F.explode("device_tokens").alias("token")).distinct()


def without_tokens(users: DataFrame, invalid: DataFrame) -> DataFrame:
    """users with invalid tokens removed from their lists; by anti-join, whatever their number."""
    kept = users.select("user_id", F.posexplode("device_tokens").alias("pos", "token")).join(invalid.select("token").distinct(), "token", "left_anti")
    lists = kept.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("_t"))
    empty = F.expr("cast(array() as array<string>)")
    return users.join(lists, "user_id", "left").withColumn("device_tokens", F.coalesce("_t", empty)).drop("_t")


def category_tokens(users: DataFrame) -> DataFrame:
    """(category, token) of users by each of their categories."""
    rows = users.select(F.explode("categories").alias("category"), "device_tokens")
    return rows.select("category", F.explode("device_tokens").alias("token")).distinct()


def send_waves(tokens: DataFrame, size: int = 500, per_bucket: int = 100_000) -> DataFrame:
    """(token, wave): waves of at most `size` tokens, all but the last full. Tokens are dealt by hash into buckets of about
    `per_bucket`; a rank is a bucket's offset and the rank by token inside it, so no window spans the table."""
    buckets = max(1, -(-tokens.count() // per_bucket))
    b = tokens.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)))
    n = b.groupBy("bucket").agg(F.count("*").alias("n"))
    # one row a bucket
    base = n.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = b.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("token")))
    return ranked.join(base.select("bucket", "base"), "bucket").select("token", F.floor((F.col("base") + F.col("k") - 1) / size).alias("wave"))


def topic_audience(articles: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Users by article whose category they follow; counted, not listed."""
    n = recipients(users, as_of, "all").select(F.explode(F.array_distinct("categories")).alias("category_slug")).groupBy("category_slug").agg(F.count("*").alias("audience"))
    return articles.select("article_id", "category_slug").join(n, "category_slug", "left").select("article_id", F.coalesce("audience", F.lit(0)).alias("audience"))

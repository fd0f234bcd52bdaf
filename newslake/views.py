"""Article-shaped views of the raw tables, as DataFrames and as the equal SQL for oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newslake.config import AS_OF


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def key_number(props):
    return F.regexp_extract(props, "[0-9]+", 0).cast("long")


def counters(events: DataFrame) -> DataFrame:
    """Views and bookmarks by article (engagement counters from the event log)."""
    return events.groupBy(key_number(F.col("props")).alias("article_id")).agg(
        F.count_if(F.col("event_type") == "view").alias("view_count"), F.count_if(F.col("event_type") == "purchase").alias("bookmark_count")
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    # titles are cut before the joins, so that a query without contents shuffles none
    d, p = bare_articles(spark, sf_dir), table(spark, sf_dir, "pages").select("page_id", "url")
    ev = counters(table(spark, sf_dir, "events")).withColumnRenamed("article_id", "event_of")
    rows = d.join(p, d.article_id == p.page_id, "left").join(ev, d.article_id == ev.event_of, "left")
    return rows.select(
        *d.columns,
        F.coalesce("url", F.concat(F.lit("https://"), F.col("source_name"), F.lit(".example.com/a/"), F.col("article_id").cast("string"))).alias("source_url"),
        F.coalesce("view_count", F.lit(0)).alias("view_count"),
        F.coalesce("bookmark_count", F.lit(0)).alias("bookmark_count"),
    )


ARTICLE_SQL = f"""ev AS (
  SELECT CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS article_id,
         CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS view_count,
         CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS bookmark_count
  FROM events GROUP BY 1),
article AS (
  SELECT d.doc_id AS article_id, substring(split_part(d.text, chr(10), 1), 1, 300) AS title, d.text AS content, d.source AS source_name,
         d.lang AS category_slug, TIMESTAMP '{AS_OF}' - INTERVAL '1' MINUTE * CAST((d.doc_id * 37) % 5760 AS INT) AS published_at,
         coalesce(p.url, concat('https://', d.source, '.example.com/a/', CAST(d.doc_id AS VARCHAR(20)))) AS source_url,
         coalesce(ev.view_count, 0) AS view_count, coalesce(ev.bookmark_count, 0) AS bookmark_count
  FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id LEFT JOIN ev ON ev.article_id = d.doc_id)"""


def with_articles(sql: str) -> str:
    return f"WITH {ARTICLE_SQL}\n{sql}" if not sql.lstrip().startswith(",") else f"WITH {ARTICLE_SQL}{sql}"


LANGS = ("en", "fr", "de", "es")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users from customers: a category by key, a second for every fifth, a notification hour, and the tokens their sign-ups registered."""
    c = table(spark, sf_dir, "customer")
    lang = lambda k: F.element_at(F.array(*map(F.lit, LANGS)), (k % 4 + 1).cast("int"))
    more = F.when(F.col("c_custkey") % 5 == 0, F.array(lang(F.col("c_custkey") + 1))).otherwise(F.expr("cast(array() as array<string>)"))
    return c.select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.array(lang(F.col("c_custkey"))), more).alias("categories"), lang(F.col("c_custkey")).alias("category"),
        F.concat((F.col("c_custkey") % 24).cast("string"), F.lit(":00")).alias("notification_time"),
        (F.col("c_custkey") % 3 != 0).alias("notifications_enabled"),
        (F.col("c_acctbal") > 0).alias("is_active"),
        F.array_distinct(F.array(F.concat(F.lit("t"), (F.col("c_custkey") % 997).cast("string")), F.concat(F.lit("t"), (F.col("c_custkey") % 991).cast("string")))).alias("device_tokens"),
    )


USERS_SQL = """app_user AS (
  SELECT c_custkey AS user_id, CASE c_custkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END AS category,
         CASE WHEN c_custkey % 5 = 0 THEN CASE c_custkey % 4 WHEN 3 THEN 'en' WHEN 0 THEN 'fr' WHEN 1 THEN 'de' ELSE 'es' END END AS second_category,
         c_custkey % 24 AS pref_hour, c_custkey % 3 <> 0 AS notifications_enabled, c_acctbal > 0 AS is_active,
         't' || CAST(c_custkey % 997 AS VARCHAR) AS t1, 't' || CAST(c_custkey % 991 AS VARCHAR) AS t2
  FROM customer)"""


def bare_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles without page URLs and counters: one scan, no join."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("article_id"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 300).alias("title"),
        F.col("text").alias("content"),
        F.col("source").alias("source_name"),
        F.col("lang").alias("category_slug"),
        F.timestamp_seconds(F.unix_timestamp(as_of()) - 60 * ((F.col("doc_id") * 37) % 5760)).alias("published_at"),
    )


def full_articles(spark: SparkSession, sf_dir: str, base: DataFrame | None = None) -> DataFrame:
    """Articles with every stored column; those the test tables lack are derived from the id."""
    i = F.col("article_id")
    ai = F.struct(F.concat(F.lit("Brief: "), F.substring("title", 1, 40)).alias("title"), F.when(i % 3 == 1, "").otherwise(F.substring("content", 1, 160)).alias("summary"), F.when(i % 4 == 0, "A major step.").otherwise("").alias("why_it_matters"))
    return (articles(spark, sf_dir) if base is None else base).withColumns({
        "summary": F.substring("content", 1, 200), "image_url": F.when(i % 7 != 0, F.concat(F.lit("https://img.example.com/"), i.cast("string"), F.lit(".png"))),
        "author": F.when(i % 5 != 0, F.concat(F.lit("author"), (i % 17).cast("string"))), "tags": F.array("category_slug", F.concat(F.lit("t"), (i % 9).cast("string"))),
        "score": ((i * 13) % 101).cast("double"), "read_time": (i % 30 + 1).cast("int"), "is_featured": i % 50 == 0, "ai_summary": F.when(i % 3 != 0, ai),
        "created_at": F.col("published_at") + F.expr("INTERVAL 1 HOUR"),
    })


FULL_SQL = """, full_article AS (SELECT *, substring(content, 1, 200) AS summary,
  CASE WHEN article_id % 7 <> 0 THEN 'https://img.example.com/' || CAST(article_id AS VARCHAR) || '.png' END AS image_url,
  CASE WHEN article_id % 5 <> 0 THEN 'author' || CAST(article_id % 17 AS VARCHAR) END AS author, category_slug || ',t' || CAST(article_id % 9 AS VARCHAR) AS tags,
  CAST(article_id * 13 % 101 AS DOUBLE) AS score, CAST(article_id % 30 + 1 AS INTEGER) AS read_time, article_id % 50 = 0 AS is_featured,
  CASE WHEN article_id % 3 <> 0 THEN 'Brief: ' || substring(title, 1, 40) END AS ai_title, CASE WHEN article_id % 3 = 2 THEN substring(content, 1, 160) WHEN article_id % 3 = 1 THEN '' END AS ai_summary,
  CASE WHEN article_id % 3 <> 0 THEN CASE WHEN article_id % 4 = 0 THEN 'A major step.' ELSE '' END END AS ai_why, published_at + INTERVAL 1 HOUR AS created_at FROM article)"""

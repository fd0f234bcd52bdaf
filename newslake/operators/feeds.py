"""Feeds, pages, search and counts over articles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newslake.config import Ranking
from newslake.operators.ranking import rank_scores, window_scan


def clamp_page(page: int, limit: int, most: int = 50, default: int = 20) -> tuple[int, int]:
    limit = limit if limit and limit > 0 else default
    return max(1, page or 1), min(most, max(1, limit))


def offset_page(df: DataFrame, order: list[Column], page: int, limit: int, most: int = 50) -> DataFrame:
    page, limit = clamp_page(page, limit, most)
    return df.orderBy(*order).offset((page - 1) * limit).limit(limit)


def page_info(df: DataFrame, page: int, limit: int, most: int = 50) -> DataFrame:
    page, limit = clamp_page(page, limit, most)
    total = df.agg(F.count("*").alias("total"))
    return total.select("total", F.ceil(F.col("total") / limit).alias("total_pages"), (F.lit(page * limit) < F.col("total")).alias("has_more"), F.lit(page > 1).alias("has_previous"))


def keyset_page(df: DataFrame, field: str, value, last_id, limit: int, id_col: str = "article_id", ascending: bool = False) -> DataFrame:
    """Rows after (value, last_id) in descending order (or ascending), one more than the limit to tell whether there are
    more. A previous cursor is read in the other direction than its page's."""
    x, i = F.col(field), F.col(id_col)
    past = (x > value) | ((x == value) & (i > last_id)) if ascending else (x < value) | ((x == value) & (i < last_id))
    order = (F.asc(field), F.asc(id_col)) if ascending else (F.desc(field), F.desc(id_col))
    return df.where(past if last_id is not None else F.lit(True)).orderBy(*order).limit(limit + 1)


def keyset_cursors(page: DataFrame, field: str, limit: int, has_cursor: bool, id_col: str = "article_id", ascending: bool = False) -> DataFrame:
    """One row of a keyset_page: has_more, the next cursor (next_value, next_id: the page's last row, null if that is the
    end) and the previous one (prev_value, prev_id: its first row, to be read in the other direction; null without a cursor)."""
    at = F.struct(F.col(field).alias("v"), F.col(id_col).alias("i"))
    rows = page.agg(F.sort_array(F.collect_list(at), asc=ascending).alias("l"))  # limit + 1 rows
    has_more = F.size("l") > limit
    last, first = F.when(has_more, F.get("l", F.lit(limit - 1))), F.when(F.lit(has_cursor), F.get("l", F.lit(0)))
    return rows.select(has_more.alias("has_more"), last["v"].alias("next_value"), last["i"].alias("next_id"), first["v"].alias("prev_value"), first["i"].alias("prev_id"))


def article_filter(df: DataFrame, category: str | None = None, since: Column | None = None, until: Column | None = None, featured: bool | None = None, text: str | None = None) -> DataFrame:
    """Filters that are given, and no others."""
    if category is not None:
        df = df.where(F.col("category_slug") == category)
    if since is not None:
        df = df.where(F.col("published_at") >= since)
    if until is not None:
        df = df.where(F.col("published_at") <= until)
    if featured is not None:
        df = df.where(F.col("is_featured") == featured)
    if text:
        df = df.where(F.contains(F.lower("title"), F.lit(text.lower())))
    return df


def with_category(df: DataFrame, categories: DataFrame, most: int = 100_000) -> DataFrame:
    """Left join with the category dimension; the name defaults to ''. Broadcast only if it has at most `most` rows."""
    c = categories.select(F.col("slug").alias("category_slug"), F.col("name").alias("category_name"))
    small = c.limit(most + 1).count() <= most
    return df.join(F.broadcast(c) if small else c, "category_slug", "left").withColumn("category_name", F.coalesce("category_name", F.lit("")))


def latest_feed(df: DataFrame, page: int = 1, limit: int = 20, category: str | None = None) -> DataFrame:
    """Newest first, then by score (0 if there is none)."""
    score = F.desc(F.coalesce("score", F.lit(0.0))) if "score" in df.columns else F.lit(0)
    return offset_page(article_filter(df, category=category), [F.desc("published_at"), score, F.col("article_id")], page, limit)


def top_feed(df: DataFrame, limit: int = 10, most: int = 20, score: str = "score") -> DataFrame:
    return df.orderBy(F.desc(score), F.desc("published_at"), "article_id").limit(clamp_page(1, limit, most, 10)[1])


def top_rescored(df: DataFrame, as_of: Column, limit: int = 10, config: Ranking = Ranking()) -> DataFrame:
    """The top of the window by stored score, in that order, scored afresh (clusters play no part)."""
    best = top_feed(window_scan(df, as_of, int(config.max_age_hours)), limit, 50)
    fresh = rank_scores(best.drop("cluster_id", "related_count"), as_of, config)
    return fresh.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("published_at"), "article_id")))


def today_feed(df: DataFrame, as_of: Column) -> DataFrame:
    return df.where(F.col("published_at") >= as_of - F.expr("INTERVAL 24 HOURS"))


def today_by_score(df: DataFrame, as_of: Column, page: int = 1, limit: int = 20) -> DataFrame:
    return offset_page(today_feed(df, as_of), [F.desc("score"), F.col("article_id")], page, limit)


#: Weights of the searched fields.
SEARCH_WEIGHTS = {"title": 10, "summary": 5, "tags": 3}


def search(df: DataFrame, query: str, weights: dict[str, int] | None = None) -> DataFrame:
    """(article_id, published_at, text_score): sum over fields of weight * occurrences of the query's terms. Any term
    matches; a blank query matches nothing."""
    terms = [t for t in re.split(r"[^a-z0-9]+", query.lower()) if t]
    if not terms:
        return df.select("article_id", "published_at", F.lit(0).cast("long").alias("text_score")).where(F.lit(False))
    hits, kinds = F.lit(0).cast("long"), dict(df.dtypes)
    for field, weight in (weights or SEARCH_WEIGHTS).items():
        words = F.array_join(field, " ") if kinds[field].startswith("array") else F.coalesce(field, F.lit(""))
        found = F.filter(F.split(F.lower(words), r"[^a-z0-9]+"), lambda t: t.isin(*terms))
        hits = hits + F.size(found) * weight
    return df.select("article_id", "published_at", hits.alias("text_score")).where("text_score > 0")


def search_page(df: DataFrame, query: str, page: int = 1, limit: int = 20, by_date: bool = False) -> DataFrame:
    """A page of the best matches: by text score and then newest first, or newest first alone."""
    order = [F.desc("published_at"), F.col("article_id")]
    return offset_page(search(df, query), order if by_date else [F.desc("text_score"), *order], page, limit)


def counts_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def sample_by(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.min("article_id").alias("article_id"), F.min_by("title", "article_id").alias("title"))


def category_refresh(categories: DataFrame, df: DataFrame) -> DataFrame:
    n = df.groupBy(F.col("category_slug").alias("slug")).agg(F.count("*").alias("article_count"))
    return categories.join(n, "slug", "left").withColumn("article_count", F.coalesce("article_count", F.lit(0)))


def ids_in_order(lists: DataFrame, df: DataFrame, ids: str, key: list[str]) -> DataFrame:
    """Articles of each row's id list in list order; ids without an article are dropped."""
    return lists.select(*key, F.posexplode(ids).alias("pos", "article_id")).join(df, "article_id").select(*key, "pos", *df.columns)


def deleted_before(df: DataFrame, cutoff: Column, column: str = "published_at") -> DataFrame:
    """(kept, deleted) of a retention run."""
    keep = F.coalesce(F.col(column) >= cutoff, F.lit(False))
    return df.agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("deleted"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) by table."""
    counts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out
